"""Operator 6: line dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import STRIP, broadcast_to, documents, fresh, lower_ascii, text_hash, written

#: Positions of dropped lines, 4 bytes each and 32 more for each document, that may be broadcast.
BROADCAST = 2_000_000
_LAST = (1 << 63) - 1
_ROW = ["doc", "th", "th2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_positions(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """Rows (doc, th, th2, gone): for each document that loses lines their positions.

    Lines are exploded with their positions and keyed by 128 bits of the
    stripped, A-Z lower-cased line; that is written once, 28 bytes a line and
    the document's own numbers, and both counted and looked up from there.
    """
    text = F.coalesce("text", F.lit(""))
    # hashed before lines are exploded: beside the explode, each line's row would hash its whole text
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), *text_hash(F.col("text")), _lines(lower_ascii(text)).alias("lines"))
    # outer, though a text always has a line: for the plain form Spark would test the size of the list and so split each text twice
    rows = whole.select(*_ROW, F.posexplode_outer("lines").alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(STRIP))).filter(F.char_length("line") >= least_chars)
    lines = written(rows.select(*_ROW, "pos", F.xxhash64("line").alias("k"), F.xxhash64(F.lit("second"), "line").alias("k2")), "lines")
    here = F.struct(*_ROW)
    if least_docs == 2:  # the least and the greatest document tell whether there are two
        per = lines.groupBy("k", "k2").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first < last").drop("last")
    else:
        per = lines.select("k", "k2", *_ROW).distinct().groupBy("k", "k2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs).drop("n")
    shared = written(per, "line_dedup_keys")
    return lines.join(shared, ["k", "k2"]).filter(here > F.col("first")).groupBy(*_ROW).agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2, most: int = BROADCAST) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: lines that at least least_docs documents share stay only in the one with the smallest doc_id.

    Lines are never shuffled, only their hashes. The positions to drop are
    broadcast up to most of them; beyond, they are joined to the texts by a
    shuffle. Both ways give the same rows. The other lines of a text are put
    together in order, whatever its length.

    A document is a row's doc_id and text: rows that share an id but not a text
    are different documents, of which the one with the lesser hash of its text
    comes first; repeated rows are one document, and keep the same lines. A null
    doc_id comes after all others. A null or empty text is one empty line and
    stays the empty text. Keys below least_chars code points always stay. An
    empty table gives an empty result. Columns of docs named n_lines, n_dropped
    or kept_text are replaced, all others stay as they are.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    drops = written(shared_positions(docs.select("doc_id", "text"), least_chars, least_docs), "line_dedup_positions")
    positions = drops.agg(F.coalesce(F.sum(F.size("gone") + 8), F.lit(0))).first()[0]
    doc, th, th2, gone, parts, flags = names = fresh(docs, *_ROW, "gone", "parts", "flags")
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))} | dict(zip((th, th2), text_hash(F.col("text")), strict=True)))
    drops = broadcast_to(drops.select(*[F.col(a).alias(b) for a, b in zip((*_ROW, "gone"), names, strict=False)]), positions, most)
    out = keyed.join(drops, [doc, th, th2], "left").withColumn(parts, _lines(F.col("text")))
    # a flag for each line up to the last that goes, so that each line is looked up in one step
    gap = F.transform(gone, lambda g, i: F.concat(F.array_repeat(F.lit(False), g - F.when(i == 0, -1).otherwise(F.get(gone, i - 1)) - 1), F.array(F.lit(True))))
    out = out.withColumn(flags, F.flatten(gap))
    stay = F.filter(parts, lambda x, i: ~F.coalesce(F.get(flags, i), F.lit(False)))
    # flags is named twice, so that it is computed once for a text and not put into the function for each line
    kept = F.when(F.col(flags).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n"))
    out = out.withColumns({"n_lines": F.size(parts).cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"), "kept_text": kept})
    return out.drop(*names)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from d),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, coalesce(k.doc_id > s.first, false) as gone from k left join s using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
