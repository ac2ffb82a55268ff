"""Operator 5: near-duplicates by MinHash with tensored banding.

Two collections of ``SIDE`` pairs of minhashes stand for SIDE * SIDE tables: table (i, j) has the i-th pair of the one
and the j-th pair of the other as its key, so 4 * SIDE minhashes give SIDE squared keys of four. Documents meet in a
table only if they meet in its first pair, so keys are formed only where first pairs meet. A link of similarity 0.75
shares no key with probability 2 * (1 - 0.75 ** 2) ** SIDE, 0.0005, and is still found where others join its ends.

Documents of equal shingle sets are one class, whatever their ids. In each table of two or more classes, all are confirmed
against its first on full sets. Where a table still holds several components, the pairs over component borders follow,
all of them: of each pair the one table with the least (i, j) gives it, if sizes and a 1536-bit sketch allow 0.75 (an
estimate below 0.67 for a true 0.75 is 4.7 deviations away), and full sets confirm it. Large tables are split for that,
so that no task has all pairs of one. So a large group of near copies costs a comparison each; pairs that are close and
not linked are compared one by one.

Documents without words are linked with nothing. A row without an id is linked with nothing and stays. Repeated rows are
in one class. Rows that share an id and differ in text are compared by their own texts; each has the smallest id of its
own group.
"""

from __future__ import annotations

from collections import OrderedDict
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, cut, map_batches, per_slice, table, texts_of
from .components import components

SHINGLE, SIMILAR = 5, 75
SIDE, EACH = 10, 2
SKETCH_BITS, SKETCH_DIFFER = 1536, 253
#: Rows of a table that one task pairs with the others of that table.
SPLIT = 1000

_MIX, _END = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


HASHES, SKETCH = _multipliers(1, 2 * SIDE * EACH), _multipliers(2, SKETCH_BITS)

_words: dict[bytes, int] = {}


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; of the whole sequence if it has fewer words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _words
    if len(known) > 100_000:
        known.clear()
    codes = []
    for w in words:
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh3_64_intdigest(w)
        codes.append(code)
    h = np.array(codes, np.uint64)
    k = min(SHINGLE, len(h))
    mixed = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed += h[j : len(h) - k + 1 + j]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _END + np.uint64(k)
    return np.unique(mixed)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minhashes for each set; no set is empty."""
    data = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(data * m, starts) >> np.uint64(32) for m in HASHES], axis=1)


def sketch(hashes: np.ndarray) -> list[int]:
    """1536 one-bit minhashes of a set, as 64-bit integers."""
    least = np.concatenate([(hashes[:, None] * SKETCH[k : k + 64]).min(axis=0) for k in range(0, SKETCH_BITS, 64)])
    bits = (least * _END) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8)).view("<i8").tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < SIMILAR * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (small + large - both)


def _signed(docs: DataFrame) -> DataFrame:
    """row, id, text_hash, n_shingles, digest of the set (null if empty), and the pairs of both collections as arrays."""
    rest = T._parse_datatype_string("text_hash long, n_shingles long, digest binary, first array<long>, second array<long>")
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["id"], *rest])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in texts_of(batch, "text")]
        full = [s for s in sets if len(s)]
        first = second = np.zeros((0, SIDE), np.int64)
        if full:
            mins = minhashes(full).reshape(-1, 2 * SIDE, EACH)
            keys = ((mins[:, :, 0] << np.uint64(32)) | mins[:, :, 1]).view(np.int64)
            first, second = keys[:, :SIDE], keys[:, SIDE:]
        put = iter(zip(first.tolist(), second.tolist(), strict=True))
        pairs = [next(put) if len(s) else (None, None) for s in sets]
        digests = [md5(s.tobytes()).digest() if len(s) else None for s in sets]
        columns = [*(batch.column(c) for c in ("row", "id", "text_hash")), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())]
        columns += [pa.array([p[k] for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    keyed = docs.withColumns({"row": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text")})
    return per_slice(keyed, "text", work, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on full sets."""
    one, two = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")

    def run(batches):
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            links = []
            for k in range(batch.num_rows):
                a = batch.column("a")[k].as_py()
                if a not in held:
                    held[a] = shingles((batch.column("text_a")[k].as_py() or "").encode())
                    if len(held) > 16:
                        held.popitem(last=False)
                b = shingles((batch.column("text_b")[k].as_py() or "").encode())
                links.append(similar(held[a], b))
            mask = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return map_batches(rows, run, "a long, b long")


def _tables(classes: DataFrame) -> DataFrame:
    """table (key), i, j, id, n_shingles of the classes that share a table with another."""
    one = classes.select("id", F.posexplode("first").alias("i", "pair"))
    shared = one.groupBy("i", "pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = one.join(shared, ["i", "pair"])  # most classes meet no other in their first pairs
    both = met.join(classes.select("id", "n_shingles", "second"), "id").select("id", "n_shingles", "i", "pair", F.posexplode("second").alias("j", "other"))
    keyed = cut(both.select(F.xxhash64("i", "j", "pair", "other").alias("table"), "i", "j", "id", "n_shingles"))
    full = keyed.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1").drop("n")
    return cut(keyed.join(full, "table"))


def _across(tables: DataFrame, comps: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a table."""
    rows = tables.drop("least").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("table").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("lo < hi").select("table", F.ceil(F.col("n") / SPLIT).cast("int").alias("splits"))
    open_ = cut(rows.join(mixed, "table"))
    members = open_.select("id").distinct()
    bits = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(f"s{k}", T.LongType()) for k in range(SKETCH_BITS // 64))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [sketch(shingles(t)) for t in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([m[k] for m in made], pa.int64()) for k in range(SKETCH_BITS // 64))], names=bits.names)

    own = per_slice(texts.join(members, "id", "left_semi").select("id", "text"), "text", work, bits)
    # pairs of minhashes as 32-bit hashes: enough to tell which table is the first that two classes share
    short = classes.select("id", *(F.transform(c, lambda x: F.hash(x)).alias(c) for c in ("first", "second")))
    own = cut(own.join(short, "id"))
    wide = open_.join(own, "id")
    a = wide.withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits").cast("long")).cast("int")).alias("a")
    b = wide.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).alias("b")
    col = lambda side, name: F.col(f"{side}.{name}")
    differ = sum((F.bit_count(col("a", f"s{k}").bitwiseXOR(col("b", f"s{k}"))) for k in range(SKETCH_BITS // 64)), F.lit(0))
    small, large = (f(col("a", "n_shingles"), col("b", "n_shingles")) for f in (F.least, F.greatest))
    least = lambda side: F.array_position(F.zip_with(col("a", side), col("b", side), lambda x, y: x == y), True) - 1
    fits = (
        (col("a", "table") == col("b", "table")) & (col("a", "split") == col("b", "split")) & (col("a", "id") < col("b", "id")) & (col("a", "component") != col("b", "component"))
        & (100 * small >= SIMILAR * large) & (differ <= SKETCH_DIFFER) & (least("first") == col("a", "i")) & (least("second") == col("a", "j"))
    )
    return a.join(b, fits).select(col("a", "id").alias("a"), col("b", "id").alias("b")).distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each row of ``docs``: ``row``, ``id``, ``text_hash``, ``n_shingles``, ``component`` (a number of its group; null where
    nothing can be linked) and ``component_id`` (the smallest id of its group)."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    signed = cut(_signed(own))
    sets = signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    least = sets.groupBy("digest").agg(F.min("row").alias("class"), F.min("id").alias("least_id"))  # a class is a set
    firsts = sets.join(least.select(F.col("class").alias("row")), "row")
    classes = cut(firsts.select(F.col("row").alias("id"), F.col("id").alias("doc"), "text_hash", "n_shingles", "first", "second"))
    tables = _tables(classes)
    chosen = classes.select(F.col("id").alias("class"), F.col("doc").alias("id"), "text_hash").join(tables.select(F.col("id").alias("class")).distinct(), "class")
    texts = own.withColumn("text_hash", F.xxhash64("text")).join(chosen, ["id", "text_hash"])
    texts = cut(texts.groupBy(F.col("class").alias("id")).agg(F.min("text").alias("text")))  # repeated rows
    tested = tables.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    stars = cut(_confirmed(tested, texts))
    across = cut(_confirmed(_across(tables, components(stars), classes, texts), texts))
    comps = components(stars.union(across)).join(least.select(F.col("class").alias("id"), "least_id"), "id")
    smallest = comps.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = comps.join(smallest, "component").select(F.col("id").alias("class"), "component", "component_id")
    found = least.join(linked, "class", "left").select("digest", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = signed.select("row", "id", "text_hash", "n_shingles", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(found, "digest", "left")
    return out.select("row", "id", "text_hash", "n_shingles", "component", F.coalesce("component_id", "id").alias("component_id"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``text_hash``, ``n_shingles``, ``component_id`` (the smallest id of its
    group; null without an id)."""
    return _grouped(docs, doc_id, text).select("id", "text_hash", "n_shingles", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``docs``, unchanged: one of its smallest id. Rows without words or without an id stay, repeated
    or not."""
    found = cut(_grouped(docs, doc_id, text).where(F.col("component").isNotNull()).select("id", "text_hash", "component"))
    kept = found.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("one"))
    mine = found.select("id", "text_hash", "component").distinct().join(kept, "component")
    mine = mine.select("id", "text_hash", (F.struct("id", "text_hash") == F.col("one")).alias("stays"))
    rows = docs.select(F.struct("*").alias("doc"))
    keyed = rows.withColumns({"id": F.col("doc").getField(doc_id), "text_hash": F.xxhash64(F.col("doc").getField(text))})
    joined = keyed.join(mine, ["id", "text_hash"], "left")
    nth = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("stays"))  # of rows that are the same document
    return joined.withColumn("nth", nth).where(F.col("stays").isNull() | (F.col("stays") & (F.col("nth") == 1))).select("doc.*")


def query(spark, sf_dir):
    found = groups(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0),
     n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
     common AS (SELECT a.r AS a, b.r AS b, count(*) AS x FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
     link AS (SELECT a, b FROM common JOIN n AS na ON na.r = a JOIN n AS nb ON nb.r = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
     reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id, d.doc_id = min(e.doc_id) AS kept
FROM reach JOIN d ON d.r = reach.a JOIN d AS e ON e.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
