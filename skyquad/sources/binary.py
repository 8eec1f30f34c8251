"""Fixed-layout catalog files as Spark data sources: "astr" (a catalog) and "adb" (a solver database).

Readers split a file by ranges of records, so tasks hold no more than a range.
Files have one header, so a writer's tasks write their records to parts beside
the target, which commit() puts together in the order of the partitions, a
block at a time.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

from skyquad.errors import BadMagic, FormatError, PatternOutOfRange, StarOutOfRange, Truncated, UnsupportedVersion
from skyquad.functions.vectors import unit_vector

#: Fixed layouts, little-endian. ASTR: magic, version, stars, epoch, padding; then id, ra and dec in degrees, mag (NaN: unknown), x, y, z.
ASTR_HEAD = struct.Struct("<4sIIff")
ASTR_STAR = np.dtype([("id", "<u4"), ("ra_deg", "<f4"), ("dec_deg", "<f4"), ("mag", "<f4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4")])
#: ADB: magic, version, stars, patterns, least and most field, faintest magnitude, epoch, size and bins of patterns, 24 reserved bytes.
ADB_HEAD = struct.Struct("<4sIIIfffIII24x")
ADB_STAR = np.dtype([("catalog_id", "<u4"), ("ra_rad", "<f4"), ("dec_rad", "<f4"), ("x_unit", "<f4"), ("y_unit", "<f4"), ("z_unit", "<f4"), ("mag", "<f4")])
ADB_PATTERN = np.dtype([("s0", "<u2"), ("s1", "<u2"), ("s2", "<u2"), ("s3", "<u2")])
#: A database of more stars than 16 bits number: the same layout with 32-bit numbers, under a magic of its own, so that readers of 16 bits refuse it.
WIDE_PATTERN = np.dtype([("s0", "<u4"), ("s1", "<u4"), ("s2", "<u4"), ("s3", "<u4")])
ASTR_MAGIC, ADB_MAGIC, WIDE_MAGIC, VERSION, MAX_STARS = b"ASTR", b"ADB\0", b"ADBW", 1, 65_536
SCHEMAS = {
    "astr": "position long, id long, ra_deg double, dec_deg double, mag double, x double, y double, z double",
    "stars": "star_index int, catalog_id long, ra_rad float, dec_rad float, x_unit float, y_unit float, z_unit float, mag float",
    "patterns": "pattern_index long, s0 int, s1 int, s2 int, s3 int",
    "header": "version long, n_stars long, n_patterns long, min_fov_deg float, max_fov_deg float, max_mag float, epoch long, pattern_size long, pattern_bins long",
}


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def checked_head(raw: bytes, layout: struct.Struct, magic: bytes) -> tuple:
    if len(raw) < layout.size:
        raise Truncated("the header is too short")
    values = layout.unpack(raw)
    if values[0] != magic and (magic, values[0]) != (ADB_MAGIC, WIDE_MAGIC):
        raise BadMagic(f"wrong magic {values[0]!r}")
    if values[1] != VERSION:
        raise UnsupportedVersion(f"unknown version {values[1]}")
    return values


def head(path: str, layout: struct.Struct, magic: bytes) -> tuple:
    files, at = store(path)
    with files.open_input_file(at) as f:
        return checked_head(f.read(layout.size), layout, magic)


def pattern_kind(magic: bytes) -> np.dtype:
    return WIDE_PATTERN if magic == WIDE_MAGIC else ADB_PATTERN


def columns_of(section: str, rows, first: int) -> list[pa.Array]:
    """The columns of SCHEMAS of a section's records, numbered from first; of the header, its values but for the magic."""
    if section == "header":
        return [pa.array([v], t) for v, t in zip(rows, [*[pa.int64()] * 3, *[pa.float32()] * 3, *[pa.int64()] * 3], strict=True)]
    number = np.arange(first, first + len(rows))
    if section == "astr":
        return [pa.array(number, pa.int64()), pa.array(rows["id"].astype(np.int64)), *[pa.array(rows[c].astype(np.float64), from_pandas=c == "mag") for c in ("ra_deg", "dec_deg", "mag", "x", "y", "z")]]
    if section == "stars":
        return [pa.array(number, pa.int32()), pa.array(rows["catalog_id"].astype(np.int64)), *[pa.array(rows[c].astype(np.float32)) for c in ADB_STAR.names[1:]]]
    return [pa.array(number, pa.int64()), *[pa.array(rows[c].astype(np.int32)) for c in ADB_PATTERN.names]]


@dataclass
class Span(InputPartition):
    first: int
    count: int


class Records(DataSourceReader):
    """Reads a section; an equality filter on the record's position reads that record only."""

    def __init__(self, path: str, section: str, a_part: int):
        self.path, self.section, self.a_part, self.only = path, section, a_part, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("position",), ("star_index",), ("pattern_index",)):
                self.only = f.value
            yield f  # Spark checks them again

    def layout(self) -> tuple[np.dtype | None, int, int]:
        """Type, place and number of the section's records."""
        if self.section == "astr":
            return ASTR_STAR, ASTR_HEAD.size, head(self.path, ASTR_HEAD, ASTR_MAGIC)[2]
        h = head(self.path, ADB_HEAD, ADB_MAGIC)
        if self.section == "header":
            return None, 0, 1
        return (ADB_STAR, ADB_HEAD.size, h[2]) if self.section == "stars" else (pattern_kind(h[0]), ADB_HEAD.size + ADB_STAR.itemsize * h[2], h[3])

    def partitions(self) -> list[InputPartition]:
        kind, at, n = self.layout()
        files, where = store(self.path)
        if kind is not None and files.get_file_info(where).size < at + n * kind.itemsize:
            raise Truncated(f"{self.section}: the file is cut short")
        if self.only is not None and kind is not None:
            return [Span(self.only, 1 if 0 <= self.only < n else 0)]
        return [Span(i, min(self.a_part, n - i)) for i in range(0, n, self.a_part)] or [Span(0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        if part.count == 0:
            return
        names = [c.split()[0] for c in SCHEMAS[self.section].split(", ")]
        if self.section == "header":
            yield pa.RecordBatch.from_arrays(columns_of("header", head(self.path, ADB_HEAD, ADB_MAGIC)[1:], 0), names=names)
            return
        kind, at, _ = self.layout()
        files, where = store(self.path)
        step = 1 << 16
        with files.open_input_file(where) as f:
            for i in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - i)
                f.seek(at + i * kind.itemsize)
                rows = np.frombuffer(f.read(n * kind.itemsize), dtype=kind)
                yield pa.RecordBatch.from_arrays(columns_of(self.section, rows, i), names=names)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    count: int


def records_of(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    """A batch's rows as records; an unknown number is a NaN. What a field cannot hold is an error."""
    out = np.zeros(batch.num_rows, dtype=kind)
    for name, column in zip(kind.names, batch.columns, strict=True):
        if kind[name].kind == "f":
            out[name] = column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        else:
            values = column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            out[name] = values.astype(kind[name], casting="unsafe")
            if (out[name].astype(np.int64) != values).any():
                raise FormatError(f"{name}: {values[out[name].astype(np.int64) != values][0]} does not fit the format")
    return out


class RecordWriter(DataSourceArrowWriter):
    """Writes the batches of one section to parts, which commit() puts together."""

    def __init__(self, path: str, kind: np.dtype):
        self.path, self.kind = path, kind

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        name, n = f"{self.path}.part-{context.partitionId()}-{context.taskAttemptId()}", 0
        files, at = store(name)
        with files.open_output_stream(at) as f:
            for batch in rows:
                f.write(records_of(batch, self.kind).tobytes())
                n += batch.num_rows
        return Part(context.partitionId(), name, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        files, at = store(self.path)
        with files.open_output_stream(at) as out:
            out.write(ASTR_HEAD.pack(ASTR_MAGIC, VERSION, sum(p.count for p in parts), self.epoch, 0.0) if self.kind == ASTR_STAR else b"")
            for p in parts:
                with files.open_input_file(store(p.path)[1]) as f:
                    while block := f.read(1 << 22):
                        out.write(block)
                files.delete_file(store(p.path)[1])

    def abort(self, messages) -> None:
        for p in messages:
            if p:
                files, at = store(p.path)
                files.delete_file(at)

    epoch = 2000.0


class Astr(DataSource):
    @classmethod
    def name(cls) -> str:
        return "astr"

    def schema(self) -> str:
        return SCHEMAS["astr"]

    def reader(self, schema) -> Records:
        return Records(self.options["path"], "astr", int(self.options.get("records", 1 << 20)))

    def writer(self, schema, overwrite) -> RecordWriter:
        w = RecordWriter(self.options["path"], ASTR_STAR)
        w.epoch = float(self.options.get("epoch", 2000.0))
        return w


class Adb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "adb"

    def schema(self) -> str:
        return SCHEMAS["patterns" if (section := self.options.get("section", "stars")) == "wide" else section]

    def reader(self, schema) -> Records:
        return Records(self.options["path"], self.options.get("section", "stars"), int(self.options.get("records", 1 << 20)))

    def writer(self, schema, overwrite) -> RecordWriter:
        return RecordWriter(self.options["path"], {"stars": ADB_STAR, "patterns": ADB_PATTERN, "wide": WIDE_PATTERN}[self.options.get("section", "stars")])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Astr)
    spark.dataSource.register(Adb)


def read_astr(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("astr").load(path)


def write_astr(stars: DataFrame, path: str, epoch: float = 2000.0) -> None:
    """Writes (id, ra_deg, dec_deg, mag) in the order of position, or of id where there is none; unit vectors are computed here."""
    register(stars.sparkSession)
    v = unit_vector("ra_deg", "dec_deg")
    order = "position" if "position" in stars.columns else "id"
    rows = stars.repartitionByRange(order).sortWithinPartitions(order)
    rows.select("id", "ra_deg", "dec_deg", "mag", v.x.alias("x"), v.y.alias("y"), v.z.alias("z")).write.format("astr").option("epoch", epoch).mode("append").save(path)


def read_adb(spark: SparkSession, path: str, section: str = "stars") -> DataFrame:
    """Section header, stars or patterns of a solver database."""
    register(spark)
    return spark.read.format("adb").option("section", section).load(path)


def record(spark: SparkSession, path: str, section: str, number: int) -> DataFrame:
    """The star or pattern of a number, alone; a number that the file does not have is an error."""
    h = head(path, ADB_HEAD, ADB_MAGIC)
    n, kind = (h[2], StarOutOfRange) if section == "stars" else (h[3], PatternOutOfRange)
    if not 0 <= number < n:
        raise kind(f"{number} of {n}")
    return read_adb(spark, path, section).filter(F.col("star_index" if section == "stars" else "pattern_index") == number)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for a database's content: its header, the numbers of its records and sums of their hashes, taken where the records are read. Equal bytes have equal names under any path."""
    parts = [str(tuple(read_adb(spark, path, "header").first()))]
    for section in ("stars", "patterns"):
        df = read_adb(spark, path, section)
        found = df.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), *df.columns).cast("decimal(38,0)")) for k in (1, 2)]).first()
        parts.append(str(tuple(found)))
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def write_adb(stars: DataFrame, patterns: DataFrame, path: str, min_fov_deg: float = 0.0, max_fov_deg: float = 180.0, max_mag: float = 7.0, epoch: int = 2000, pattern_size: int = 4, pattern_bins: int = 50) -> int:
    """Writes a solver database and returns its number of stars. Patterns name stars by 16-bit numbers; where there are more than 65,536 stars, by 32-bit ones, under another magic."""
    register(stars.sparkSession)
    columns = ["catalog_id", "ra_rad", "dec_rad", "x_unit", "y_unit", "z_unit", "mag"]
    n, m = stars.count(), patterns.count()
    wide = n > MAX_STARS
    sections = ("stars", "wide" if wide else "patterns")
    for df, order, names, section in ((stars, "star_index", columns, sections[0]), (patterns, "pattern_index", list(ADB_PATTERN.names), sections[1])):
        df.repartitionByRange(order).sortWithinPartitions(order).select(*names).write.format("adb").option("section", section).mode("append").save(f"{path}.{section}")
    files, at = store(path)
    with files.open_output_stream(at) as out:
        out.write(ADB_HEAD.pack(WIDE_MAGIC if wide else ADB_MAGIC, VERSION, n, m, min_fov_deg, max_fov_deg, max_mag, epoch, pattern_size, pattern_bins))
        for section in sections:
            with files.open_input_file(f"{at}.{section}") as f:
                while block := f.read(1 << 22):
                    out.write(block)
            files.delete_file(f"{at}.{section}")
    return n


def read_pattern_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Stars, patterns and properties of a pattern archive (.npz) with star_table, star_catalog_IDs, pattern_catalog and props_packed. Pickled objects are refused; the format's 65,536 stars bound what the driver reads."""
    with np.load(path, allow_pickle=False) as z:
        table, ids, patterns, props = z["star_table"], z["star_catalog_IDs"], z["pattern_catalog"], z["props_packed"]
    ids = ids if ids.ndim == 1 else ids[:, 0]
    stars = {"star_index": np.arange(len(table), dtype=np.int32), "catalog_id": ids.astype(np.int64), **{c: table[:, k].astype(np.float32) for k, c in enumerate(("ra_rad", "dec_rad", "x_unit", "y_unit", "z_unit", "mag"))}}
    rows = {"pattern_index": np.arange(len(patterns), dtype=np.int64), **{f"s{k}": patterns[:, k].astype(np.int32) for k in range(4)}}
    named = {k: props[k].item() for k in props.dtype.names or ()}
    return spark.createDataFrame(pa.table(stars)), spark.createDataFrame(pa.table(rows)), named


def archive_to_adb(spark: SparkSession, source: str, target: str, keep_zero: bool = True) -> DataFrame:
    """Converts a pattern archive and returns the header that was written."""
    from skyquad.operators.synthetic import drop_zero_patterns

    stars, patterns, props = read_pattern_archive(spark, source)
    patterns = patterns if keep_zero else drop_zero_patterns(patterns)
    write_adb(stars, patterns, target, float(props.get("min_fov", 0.0)), float(props.get("max_fov", 180.0)), float(props.get("star_max_magnitude", 7.0)), pattern_bins=int(props.get("pattern_bins", 50)))
    return read_adb(spark, target, "header")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, fov_min_deg, fov_max_deg, mag_limit, size_mb, ready) of a folder's archives; a missing folder has none."""
    schema = "id string, path string, fov_min_deg double, fov_max_deg double, mag_limit double, size_mb double, ready boolean"
    files, at = store(folder)
    from pyarrow import fs

    if files.get_file_info(at).type != fs.FileType.Directory:
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]*)\.npz$", 1).alias("id"), "path", F.lit(0.0).alias("fov_min_deg"), F.lit(180.0).alias("fov_max_deg"), F.lit(7.0).alias("mag_limit"), (F.col("length") / 1048576.0).alias("size_mb"), F.lit(True).alias("ready"))
