"""Operator 5: exact dedup as a stateful stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import documents, shared_dir, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would reserve more than they hold
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(frame: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return frame.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))


def stream_groups(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Rows (digest, doc_id, path, row, n): what the state holds of each digest once all files at path have been read.

    The state, in RocksDB on the executors' disks with its changelog in
    state_dir, has no watermark and so never expires: a digest met again in a
    later file, batch or restart finds its entry, which has the largest doc_id
    so far, where that text is (file and row) and the number of rows. A rerun
    with the same state_dir reads new files only. Each batch writes the entries
    that it changed to a folder of its own, so that a repeated batch replaces
    what it wrote before.
    """
    state_dir = state_dir or shared_dir(spark, "dedup_state")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    source = f"{path[:-1]}[{path[-1]}]"  # as a pattern it can name one file as well as a folder
    groups = _rows(reader.parquet(source), digest).groupBy("digest").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_dir}/groups/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        groups.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    kind = "digest binary, keep struct<doc_id: bigint, path: string, row: bigint>, n bigint, batch int"
    last = spark.read.schema(kind).parquet(f"{state_dir}/groups").groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))
    return last.select("digest", "keep.doc_id", "keep.path", "keep.row", "n")


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of the Parquet files at path.

    Rows whose digest is in the state more than once are hits: their full bytes
    are compared with those of the text at the state's locator. Where a digest
    stands for different texts, its rows are grouped by the texts themselves.

    A null text is the empty text. A null doc_id is smaller than all others. Of
    rows with equal text and equal doc_id the one that stands last, by file and
    row, is kept. No files or no rows: an empty result. Other columns are ignored.
    """
    state = written(stream_groups(spark, path, digest, state_dir, files_per_batch), "dedup_groups")
    rows = _rows(spark.read.parquet(path), digest)
    hits = state.filter("n > 1").select("digest", F.col("path").alias("at"), F.col("row").alias("at_row"))
    met = rows.join(hits, "digest").select("digest", "text", (F.col("path").eqNullSafe(F.col("at")) & F.col("row").eqNullSafe(F.col("at_row"))).alias("keeps"))
    first = met.filter("keeps").select("digest", F.col("text").alias("kept_text"))
    odd = written(met.join(first, "digest").filter(F.col("text") != F.col("kept_text")).select("digest").distinct(), "dedup_odd")
    narrow = rows.select("doc_id", "digest", "path", "row", F.sha2("text", 256).alias("text_sha256"))
    out = narrow.join(state.select("digest", F.col("doc_id").alias("keep_id"), F.col("path").alias("at"), F.col("row").alias("at_row"), F.col("n").alias("group_size")), "digest")
    if not odd.isEmpty():
        apart = rows.join(odd, "digest")
        by_text = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(by_text, ["digest", "text"]).select("digest", "doc_id", "path", "row", F.sha2("text", 256).alias("text_sha256"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.path").alias("at"), F.col("keep.row").alias("at_row"), "group_size")
        out = out.join(odd, "digest", "left_anti").unionByName(apart)
    kept = F.col("path").eqNullSafe(F.col("at")) & F.col("row").eqNullSafe(F.col("at_row"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet")


OP5_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
