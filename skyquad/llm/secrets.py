"""Operator 4: secret scans with multipart credential linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquad.llm.common import documents, fresh

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs of 32 and of 4 + 12 characters or more: the same matches as of the open patterns, without the short ones that fail.
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
_ENDPOINT = r"""https?://[^\x00-\x20"'<>\x7F]+"""
_IDENT = r"""(?i:\b(?:user_?name|login|client_?id|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
_TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: One search for all weak parts: their matches do not overlap.
_WEAK = f"{_ENDPOINT}|{_IDENT}|{_TOKEN}"
_ORDER = {"assign": 0, "access": 1, "hex": 2, "endpoint": 3, "ident": 4, "token": 5}
_KEY = ["doc_id", "th"]


def _found(text: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern and the lengths of what stands before each, or null."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("gaps")))


def parts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, kind, start, end): base spans and weak parts, in code points, once for rows with equal doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    every = F.array(*[_found(text, k, p) for k, p in (("assign", _ASSIGN), ("access", _ACCESS), ("hex", _HEX), ("weak", _WEAK))])
    runs = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x"))
    rows = runs.select(*_KEY, "x.kind", F.posexplode(F.arrays_zip("x.m", F.slice("x.gaps", 1, F.size("x.m")).alias("gap"))).alias("i", "y"))
    rows = rows.select(*_KEY, "kind", "i", F.col("y.m").alias("m"), F.col("y.gap").alias("gap")).dropDuplicates([*_KEY, "kind", "i"])
    before = Window.partitionBy(*_KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("m")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(before).cast("long")).withColumn("start", F.col("end") - size)
    kind = F.when(F.col("kind") != "weak", F.col("kind")).when(F.col("m").rlike(f"^(?:{_ENDPOINT})$"), "endpoint").when(F.col("m").rlike(f"^(?:{_IDENT})$"), "ident").otherwise("token")
    rows = rows.withColumn("kind", kind)
    short = (F.col("kind") == "assign") & (F.char_length(F.regexp_extract("m", _ASSIGN, 2)) < 8)
    #: what a base span covers already is no weak part
    based = F.col("kind").isin("ident", "token") & F.col("m").rlike(f"{_ACCESS}|{_HEX}")
    return rows.filter(~short & ~based).select(*_KEY, "kind", "start", "end")


def link(found: DataFrame, reach: int = 256) -> DataFrame:
    """The rows of found that are reported: base spans, and weak parts with complementary parts within reach code points.

    Scopes are joined as intervals: starts fall into buckets of reach code
    points, of which each keeps only the first and last start of each role, so
    that a weak part meets three buckets at most, however many parts they hold.
    A token needs an identifier; an identifier needs a secret; an endpoint needs both.
    """
    base = F.col("kind").isin("assign", "access", "hex")
    role = F.when(F.col("kind").isin("access", "ident"), "id").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    found = found.withColumns({"role": role, "bucket": F.floor(F.col("start") / reach)})
    extent = found.filter("role <> 'endpoint'").groupBy(*_KEY, "bucket", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    extent = extent.select(F.col("doc_id").alias("_id"), F.col("th").alias("_h"), F.col("bucket").alias("at"), F.col("role").alias("other"), "lo", "hi")
    weak = found.filter(~base).withColumn("near", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    apart = (F.col("other") != F.col("role")) & F.when(F.col("near") < F.col("bucket"), F.col("hi") >= F.col("start") - reach).when(F.col("near") > F.col("bucket"), F.col("lo") <= F.col("start") + reach).otherwise(True)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_h")) & (F.col("near") == F.col("at"))
    near = weak.join(extent, same).filter(apart).select(*_KEY, "kind", "start", "end", "other")
    linked = near.groupBy(*_KEY, "kind", "start", "end").agg(F.count_distinct("other").alias("n")).filter(F.col("n") >= F.when(F.col("kind") == "endpoint", 2).otherwise(1)).drop("n")
    return found.filter(base).select(*_KEY, "kind", "start", "end").unionByName(linked)


def scan(docs: DataFrame, reach: int = 256) -> DataFrame:
    """docs with base and spans, arrays of (start, rank, kind, end) in order.

    Spans of the base patterns always stay; weak parts (URLs, identifiers,
    tokens of 20 characters or more with letters and digits) are added where
    complementary parts co-occur within reach code points. A null text is
    empty; texts of any length are searched whole. Rows with equal doc_id and
    text get equal spans, rows that share an id only (null too) their own. Of
    spans with one start (ties) the base ones come first, in the order of the
    kinds. An empty table gives an empty result. Columns of docs named base or
    spans are replaced, all others stay as they are.
    """
    docs = docs.drop("base", "spans")
    own, left, right = fresh(docs, "th", "id", "h")
    rank = F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv])
    one = F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end")
    per = link(parts(docs.select("doc_id", "text")), reach).groupBy(*_KEY).agg(F.array_sort(F.collect_list(one)).alias("spans"))
    per = per.select(F.col("doc_id").alias(left), F.col("th").alias(right), "spans")
    out = docs.withColumn(own, F.xxhash64("text"))
    out = out.join(per, F.col("doc_id").eqNullSafe(F.col(left)) & (F.col(own) == F.col(right)), "left").drop(own, left, right)
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")))
    return out.withColumn("base", F.filter("spans", lambda s: s["rank"] <= 2))


def _line(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(_line("base"), 256).alias("base_sha256"), _line("spans").alias("spans"))
