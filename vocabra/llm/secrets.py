"""Operator 10: secret scans with multipart credential linking, with DataFrame functions only.

Patterns give parts with their spans, all in one scan: whole texts are split at the matches of each kind, and running sums
over the lengths of gaps and matches give the places. Strong parts (assignments, access keys, long hex strings) are always reported. Weak ones
(names of accounts, strings that look like secret keys, endpoints) are reported only next to their complement: parts are
put in bins as wide as the reach, and an interval join over a bin and its neighbours links an identifier with a secret;
an endpoint is reported if both stand within its reach. A bin has room for a bounded number of parts, which bounds the
pairs.

Null or empty texts have no parts. Rows that have id and text in common are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind: pattern, the group that must have a least length, that length. Kinds are listed in the order of reports.
STRONG = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
#: A base64 key with its padding, or a key of the signs of URLs that has letters of both cases and a digit.
BASE64 = r"(?<![A-Za-z0-9/+])(?=[0-9a-f]*[A-Zg-z/+])(?=[A-Za-z/+]*[0-9])[A-Za-z0-9/+]{32,}+={0,2}(?![A-Za-z0-9/+=])"
URL_SAFE = r"(?<![A-Za-z0-9/+_-])(?=[A-Za-z0-9_-]{32})(?=[A-Z0-9_-]*[a-z])(?=[a-z0-9_-]*[A-Z])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{32,}+={0,2}(?![A-Za-z0-9/+=_-])"
WEAK = {
    "ident": (r"""(?i:(?<![A-Za-z0-9])(user(?:_?name|_?id)?|login|account(?:_?name|_?id)?|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    "key": (f"{URL_SAFE}|{BASE64}", 0, 32),
    "endpoint": (r"(?i:https?|s3|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 10),
}
#: What a part stands for when parts are linked.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "key": "secret", "endpoint": "endpoint"}
#: Code points between two linked parts, at most.
REACH = 200


#: Matches of these runs that are too short are many and never matter; a long run holds no earlier match.
_LONG_RUNS = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def _matches(text: Column, rank: int, kind: str, pattern: str, group: int) -> Column:
    """An array with a struct for each match: rank of the kind, number, lengths of the gap before it, of the match and of the
    group. Texts without a match, nearly all, are gone through once."""
    pattern = _LONG_RUNS.get(kind, pattern)
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(whole.alias("m"), own.alias("g"), F.split(text, pattern, -1).alias("gap"))
    made = F.transform(found, lambda x, n: F.struct(F.lit(rank).alias("rank"), n.alias("n"), size(x["gap"]).alias("gap"), size(x["m"]).alias("m"), size(x["g"]).alias("g")))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<rank:int,n:int,gap:int,m:int,g:int>>"))


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All parts, strong and weak: id, text_hash, kind, start, end (code points, end exclusive). Repeated rows count once."""
    kinds = STRONG | WEAK
    every = F.flatten(F.array(*(_matches(F.col(text), rank, kind, pattern, group) for rank, (kind, (pattern, group, _)) in enumerate(kinds.items()))))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.explode(every).alias("x")).select("id", "text_hash", "x.*")
    rows = rows.dropDuplicates(["id", "text_hash", "rank", "n"])
    upto = F.sum(F.col("gap") + F.col("m")).over(Window.partitionBy("id", "text_hash", "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    kind, least = (F.element_at(F.array(*map(F.lit, x)), F.col("rank") + 1) for x in (list(kinds), [n for _, _, n in kinds.values()]))
    rows = rows.select("id", "text_hash", kind.alias("kind"), (upto - F.col("m")).alias("start"), upto.alias("end"), "m", "g", least.alias("least"))
    return rows.where((F.col("m") > 0) & (F.col("g") >= F.col("least"))).drop("m", "g", "least")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts of ``found`` that have their complement within ``reach``; no part twice."""
    role = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))[F.col("kind")]
    doc = ["id", "text_hash"]
    parts_ = found.withColumn("role", role)
    near = parts_.where("role <> 'endpoint'").select(*doc, F.col("role").alias("other"), F.col("start").alias("a"), F.col("end").alias("b"))
    # a part is in every bin that it touches, widened by the reach on one side of the join only
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    weak = parts_.where(F.col("kind").isin(*WEAK)).select("*", bins(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach).alias("bin"))
    near = near.select("*", bins(F.col("a"), F.col("b")).alias("bin"))
    gap = F.greatest(F.col("a") - F.col("end"), F.col("start") - F.col("b"))
    same = [weak[c].eqNullSafe(near[c]) for c in doc]
    pairs = weak.join(near, [*same, weak["bin"] == near["bin"], gap <= reach, F.col("role") != F.col("other")]).select(*(weak[c] for c in doc), "kind", "start", "end", "role", "other")
    sides = pairs.groupBy(*doc, "kind", "start", "end", "role").agg(F.max((F.col("other") == "identifier").cast("int")).alias("i"), F.max((F.col("other") == "secret").cast("int")).alias("s"))
    return sides.where((F.col("role") != "endpoint") | (F.col("i") + F.col("s") == 2)).select(*doc, "kind", "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """id, text_hash and ``spans`` (array of struct(start, rank, kind, end), ordered) of each document that has some."""
    found = parts(docs, doc_id, text)
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate([*STRONG, *WEAK]) for x in (kind, k)))[F.col("kind")]
    reported = found.where(F.col("kind").isin(*STRONG)).unionByName(linked(found, reach))
    return reported.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    joined = joined.select("doc_id", spans.alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return joined.select(
        "doc_id", *(of(kind).alias(f"n_{kind}") for kind in STRONG),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
