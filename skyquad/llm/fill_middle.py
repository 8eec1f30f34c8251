"""Operator 12: fill-in-middle transformation by DuckDB inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import documents, small_batches

NEW = "n long, form string, prefix_chars long, middle_chars long, output string"
#: The steps over the relation batch (i, doc_id, text); rate, spm and seed are numbers.
_STEPS = r"""
with units as (select i, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as h from batch),
drawn as (select *, len(u) as n, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2, ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from units),
cut as (select *, (least(h1 % (n + 1), h2 % (n + 1)))::bigint as a, (greatest(h1 % (n + 1), h2 % (n + 1)))::bigint as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {spm} then 'spm' else 'psm' end as form from drawn),
parts as (select i, n, form, t, array_to_string(list_slice(u, 1, a), '') as p, array_to_string(list_slice(u, a + 1, b), '') as m, array_to_string(list_slice(u, b + 1, n), '') as s from cut)
select n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end as output
from parts order by i"""


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """docs with n (lines of the text), form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate of 100 texts are rearranged, spm of 100 of those with the suffix first;
    cuts and form are drawn from a hash of seed and doc_id, so reruns and
    retried tasks agree. Each Arrow batch is one relation of a DuckDB connection
    of its own task, with one thread; nothing crosses batches, so nothing is
    shuffled and a batch's bytes bound the memory.

    A null or empty text is plain, its output empty; a text that holds a marker
    is plain. A text of any length is one row of a batch and is cut whole. A
    null doc_id draws as the empty one; repeated rows, and rows that share an
    id, draw alike. An empty table gives an empty result. Columns of docs named
    like a new one are replaced, all others stay as they are.
    """
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in NEW.split(", ")]
    docs = docs.drop(*names)
    schema = docs.limit(0).selectExpr("*", *[f"cast(null as {kind}) as {name}" for name, kind in (x.split() for x in NEW.split(", "))]).schema
    at = {c.lower(): i for i, c in enumerate(docs.columns)}
    sql = _STEPS.format(rate=int(rate), spm=int(spm), seed=int(seed))

    def rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for b in batches:
                con.register("batch", pa.table({"i": pa.array(range(b.num_rows), pa.int64()), "doc_id": b.column(at["doc_id"]), "text": b.column(at["text"])}))
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield pa.record_batch([*b.columns, *[pa.concat_arrays(out[c].chunks) if b.num_rows else pa.array([], out[c].type) for c in names]], names=[*b.schema.names, *names])

    return docs.mapInArrow(rearranged, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: Cuts by lengths in place of lists; the text itself stands for what is rebuilt from the output.
OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as l, sha256('7:' || doc_id) as h from documents),
k as (select *, [length(x) + 1 for x in l] as size, len(l) - (l[-1] = '')::int as n from d),
c as (select *, ('0x' || h[1:8])::ubigint % (n + 1) as c1, ('0x' || h[9:16])::ubigint % (n + 1) as c2, ('0x' || h[25:32])::ubigint % 100 < 50 as back, t = '' or regexp_matches(t, '<[PSM]>') as plain from k),
e as (select *, least(length(t), coalesce(list_sum(size[1:least(c1, c2)]), 0))::bigint as a, least(length(t), coalesce(list_sum(size[1:greatest(c1, c2)]), 0))::bigint as b from c),
o as (select *, case when plain then t when back then concat('<S>', substr(t, b + 1), '<P>', substr(t, 1, a), '<M>', substr(t, a + 1, b - a)) else concat('<P>', substr(t, 1, a), '<S>', substr(t, b + 1), '<M>', substr(t, a + 1, b - a)) end as output from e)
select doc_id, n::bigint as n, case when plain then 'plain' when back then 'spm' else 'psm' end as form, case when not plain then a end as prefix_chars, case when not plain then b - a end as middle_chars,
  sha256(output) as output_sha256, sha256(t) as restored_sha256 from o
"""
