"""Operator 13: the prefix trie of conversations, by partition refinement.

All conversations begin in one class, the root. A round splits each class that is still active by the next turns of its members: by
one turn in the first round, then by 2, 4 and so on up to STRIDE turns at once, so that deep shared beginnings take few rounds.
Classes of one conversation are retired: what follows is a chain of nodes without branches, whose values are known, and comes
straight from the conversation's turns. Folding back needs no rounds: each node's values are added to its smallest member, whose
shared nodes are all its ancestors, as a running sum from the deepest up, and then summed per node over the members.

Turns go by digests of role and text, and classes by digests of the turns that lead to them, so that no text is shuffled. All counts
are sums of partial sums; a class with a third of all conversations is no task's. Only the digest of the ids that end at a node
needs them in order: they stream by, sorted, one id at a time.

Null roles and texts are empty. Turns of one conversation stand by turn (nulls first), then by digest; repeated rows are turns of their own.
Rows without a conversation id belong to no conversation. Without conversations there is no root. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, table

#: Turns by which a round splits classes, at most.
STRIDE = 32
#: Conversations that share beginnings: FAMILY ids in a row take up to SHARED turns from the first of them.
FAMILY, SHARED = 20, 3


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, i (from 1), turn's digest ``t`` and its ``words``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("conv"), "turn", F.unhex(F.md5(said.cast("binary"))).alias("t"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("conv").orderBy("turn", "t")
    return rows.select("conv", F.row_number().over(order).alias("i"), "t", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) that take their first turns, none to SHARED by a hash of the id, from the first of their family, and
    the turns (conv, d, t, words, length) that they have then."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    firsts = own.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    p = F.least("h", F.coalesce("there", F.lit(0)))
    convs = cut(own.join(firsts, "base", "left").select("conv", "base", "h", p.alias("p"), (p + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where((F.col("i") <= SHARED) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("base"), F.col("i").alias("d"), "t", "words")
    taken = convs.join(heads, "base").where("d <= h").select("conv", "d", "t", "words", "length")
    rest = turns.join(convs, "conv").where("i > h").select("conv", (F.col("i") - F.col("h") + F.col("p")).alias("d"), "t", "words", "length")
    return convs.select("conv", "length"), cut(taken.unionByName(rest))


def refined(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, d, key, words, length, n and rep for each conversation and depth at which it is in a class of several, and at the root:
    the class, its size and its smallest member."""
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep"))
    rows = convs.crossJoin(F.broadcast(root)).select(  # one row
        "conv", F.lit(0).alias("d"), F.unhex(F.md5(F.lit(b""))).alias("key"), F.lit(0).cast("long").alias("words"), "length", "n", "rep")
    parts, depth, stride, rest = [cut(rows)], 0, 1, turns
    while not (active := parts[-1].where((F.col("d") == depth) & (F.col("n") > 1) & (F.col("length") > depth)).select("conv", F.col("key").alias("class"))).isEmpty():
        rest = cut(rest.drop("class").where(F.col("d") > depth).join(active, "conv"))  # turns of active classes only
        line = F.collect_list("t").over(Window.partitionBy("conv").orderBy("d"))  # as many as a stride, at most
        key = F.unhex(F.md5(F.concat("class", F.aggregate(line, F.lit(b""), lambda a, x: F.concat(a, x)))))
        keyed = cut(rest.where(F.col("d") <= depth + stride).select("conv", "d", key.alias("key"), "words", "length"))
        shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep")).where("n > 1"))
        parts.append(cut(keyed.join(shared, "key").select(*parts[0].columns)))
        depth, stride = depth + stride, min(2 * stride, STRIDE)
    return functools.reduce(DataFrame.unionByName, parts)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends and ends_sha256 of (key, id) in order."""
    key, n, digest = None, 0, None
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "ends", "ends_sha256"])
    for batch in batches:
        done = []
        for k, i in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), strict=True):
            if k != key:
                if n:
                    done.append((key, n, digest.hexdigest()))
                key, n, digest = k, 0, hashlib.sha256()
            digest.update(f",{i}".encode() if n else f"{i}".encode())
            n += 1
        if done:
            yield pack(done)
    if n:
        yield pack([(key, n, digest.hexdigest())])


def _id_digest(ends) -> F.Column:
    """The digest of one id where ``ends``, and of none else."""
    return F.sha2(F.when(ends, F.col("conv").cast("string")).otherwise(F.lit("")).cast("binary"), 256)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    along = Window.partitionBy("conv").orderBy("d")
    up = Window.partitionBy("conv").orderBy(F.desc("d"))
    own = F.when(F.col("conv") == F.col("rep"), (F.col("n") - 1) * F.col("words")).otherwise(F.lit(0))
    rows = refined(convs, turns).withColumn("own", own).withColumns({
        "parent": F.lag("rep").over(along), "above": F.lag("key").over(along), "below": F.sum("own").over(up), "top": F.max("d").over(Window.partitionBy("conv"))})
    rows = cut(rows)
    tops = rows.where("d = top").select("conv", "top", F.col("rep").alias("top_rep"), F.col("key").alias("top_key"), "length")
    ids = rows.where("d = length").select("key", F.col("conv").alias("id"))
    ends = cut(map_batches(ids.repartition("key").sortWithinPartitions("key", "id"), _ends, "key binary, ends long, ends_sha256 string"))
    nodes = rows.where("conv = rep").select("key", "conv", "d", "parent", "above", "n").join(ends, "key", "left")  # a row per class
    leaves = nodes.where("ends = n").select("conv", F.lit(1).alias("_leaf"))  # a class that ends here has its smallest member for a leaf
    leaf = F.when(F.col("length") > F.col("top"), 1).otherwise(F.coalesce("_leaf", F.lit(0)))
    sums = rows.join(leaves, "conv", "left").groupBy("key").agg(F.sum(leaf).alias("n_leaves"), F.sum("below").alias("saved_tokens"))
    children = nodes.where("above IS NOT NULL").select(F.col("above").alias("key")).unionByName(tops.where("length > top").select(F.col("top_key").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n_children"))
    none = F.sha2(F.lit(b""), 256)
    many = nodes.join(sums, "key").join(children, "key", "left").select(
        F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    last = F.col("d") == F.col("length")
    chains = turns.drop("length").join(tops, "conv").where("d > top").select(
        F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("top") + 1, F.col("top_rep")).otherwise(F.col("conv")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), _id_digest(last).alias("ends_sha256"))
    return many.unionByName(chains)


def query(spark, sf_dir):
    return trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


# crc32 of the characters of a text of ASCII, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda y, _: xor(y >> 1, 3988292384::BIGINT * (y & 1)))))"""
#: Every sequence of turns as a path of digests; what lies below a node are the paths that start with its own.
ORACLE_SQL = rf"""
WITH o AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
           FROM conversations WHERE conv_id IS NOT NULL),
     t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) AS i FROM o),
     h AS (SELECT DISTINCT c, {_CRC.format("c::VARCHAR")} % 4 AS h FROM o),
     r AS (SELECT h.c, 0 AS part, t.i, t.t, t.words FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.i <= h.h UNION ALL SELECT h.c, 1, t.i, t.t, t.words FROM h JOIN t ON t.c = h.c AND t.i > h.h),
     d AS (SELECT c, row_number() OVER w AS d, string_agg(t, '') OVER w AS path, words FROM r WINDOW w AS (PARTITION BY c ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
     e AS (SELECT c, d, path, words FROM d UNION ALL SELECT c, 0, '', 0 FROM h),
     l AS (SELECT c, max(d) AS length FROM e GROUP BY c),
     n AS (SELECT path, min(d) AS d, min(c) AS rep, count(*) AS n, any_value(words) AS words, coalesce(string_agg(CASE WHEN d = length THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM e JOIN l USING (c) GROUP BY path),
     k AS (SELECT p.path, count(q.path) AS children FROM n AS p LEFT JOIN n AS q ON q.d = p.d + 1 AND q.path[:p.d * 32] = p.path GROUP BY p.path)
SELECT n.rep AS conv_id, n.d::BIGINT AS depth, any_value(u.rep) AS parent_conv_id, any_value(n.n) AS n_convs, any_value(k.children) AS n_children, count(*) FILTER (bk.children = 0) AS n_leaves,
       CAST(sum((b.n - 1) * b.words) AS BIGINT) AS saved_tokens, sha256(any_value(n.ends)) AS ends_sha256
FROM n JOIN k USING (path) LEFT JOIN n AS u ON u.d = n.d - 1 AND u.path = n.path[:32 * u.d] JOIN n AS b ON starts_with(b.path, n.path) JOIN k AS bk ON bk.path = b.path
GROUP BY n.path, n.rep, n.d
"""
