"""Operator 7: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquad.llm.common import WORD, broadcast_to, documents, fresh, written

#: Draws have 13 hexadecimal digits, 52 bits, so that a double holds them exactly.
_DRAW = float(16**13)
#: Sources, about 60 bytes each, whose targets may be broadcast.
SOURCES = 200_000


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Rows (source, source_size, target), one a source, from rows (source, size).

    Sources in order of code point, null last, have the weights in turn. The
    targets are min(most * source_size, level * weight) for the one level at
    which they sum to share of all sizes: what sharing out again what is cut
    off comes to. Only a row for each source is in one task here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by_need = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / free)
    #: the first source, by need, that the level leaves below its cap sets it for all after it
    open_level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)
    return per.select("source", "source_size", F.least("cap", F.coalesce(open_level["level"] * F.col("w"), F.col("cap"))).alias("target"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that the document's id (its text where the id is null) and the seed decide."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(_DRAW)


def mix(docs: DataFrame, seed: int = 7, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), sources: int = SOURCES) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the row).

    copies is floor(rate) plus one if the row's hashed draw is below the rate's
    fraction. The targets, a row for each source, are broadcast up to so many
    sources, so that no text is shuffled; beyond, the rows are shuffled by source.

    A null or empty text has size 0 and counts as such; a long one counts whole;
    a source of size 0 has target and rate 0. Null is a source of its own. Rows
    with the same id share a draw (rows without id, with the same text), as do
    repeated rows. Sources of equal need (ties) are taken in order of code
    point. An empty table gives an empty result. Columns of docs with the names
    of the new ones are replaced, all others stay as they are.
    """
    sized = docs.drop("size", "source_size", "target", "rate", "copies").withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    (name,) = fresh(sized, "source")
    targets = written(source_targets(sized.select("source", "size"), share, most, weights), "targets").select(F.col("source").alias(name), "source_size", "target")
    out = sized.join(broadcast_to(targets, targets.count(), sources), F.col("source").eqNullSafe(F.col(name))).drop(name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif(F.col("source_size"), F.lit(0)).cast("double")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate)
    one = (draw(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("copies", F.floor("rate") + one)


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its copies say."""
    (name,) = fresh(mixed, "copy")
    many = F.col(copies)
    return mixed.withColumn(name, F.explode(F.when(many > 0, F.sequence(F.lit(1).cast("long"), many)).otherwise(F.array().cast("array<bigint>")))).drop(name)


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, all columns as they are, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "source", "text")
    out = emit(mix(packed, **options))
    return out.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
with d as (select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
p as (select source, sum(size)::double as s, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w from d group by source),
q as (select *, s * 2.0::double as cap from p),
r as (select *, (sum(s) over () * 1.5::double - coalesce(sum(cap) over o, 0.0::double)) / (sum(w) over () - coalesce(sum(w) over o, 0.0::double)) as level from q
  window o as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
l as (select level as lv from r where level * w <= cap order by cap / w limit 1),
t as (select source, s, least(cap, coalesce((select lv from l) * w, cap)) as target from r),
x as (select d.doc_id, d.size, t.s, t.target, case when t.s > 0 then t.target / t.s else 0.0::double end as rate,
  ('0x' || substr(md5(coalesce(d.doc_id::varchar, 'null:' || md5(coalesce(d.text, ''))) || ':7'), 1, 13))::bigint::double / 4503599627370496.0::double as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, s::bigint as source_size, target, size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) as taken from x
"""
