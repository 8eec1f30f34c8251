"""Solver databases that stand as bytes in a column: many in one table, decoded where their rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquad.errors import FormatError, Truncated
from skyquad.sources.binary import ADB_HEAD, ADB_MAGIC, ADB_PATTERN, ADB_STAR, SCHEMAS, VERSION, checked_head, columns_of, pattern_kind

#: Records of a batch that leaves a task.
STEP = 1 << 16


def _section(data: bytes, section: str) -> tuple[tuple, int, int]:
    """The header and the place and number of a section's records; FormatError if the bytes cannot hold them."""
    head = checked_head(bytes(data[: ADB_HEAD.size]), ADB_HEAD, ADB_MAGIC)
    kind, at, n = (ADB_STAR, ADB_HEAD.size, head[2]) if section == "stars" else (pattern_kind(head[0]), ADB_HEAD.size + ADB_STAR.itemsize * head[2], head[3])
    if section != "header" and len(data) < at + n * kind.itemsize:
        raise Truncated(f"{section}: {max(0, len(data) - at) // kind.itemsize} of {n} records are there")
    return head, at, n


def decoded(databases: DataFrame, section: str = "stars", key: str = "db_id", content: str = "content") -> DataFrame:
    """(key, error and the section's columns: header, stars or patterns) of databases (key, content).

    A database whose header or section is broken or cut short has one row, with
    error and nothing else; sections are looked at by themselves, so stars can
    be read where patterns are cut off. Null content is an empty one. Rows leave
    in batches, so a database's records are never all in memory as rows.
    """
    names = [c.split()[0] for c in SCHEMAS[section].split(", ")]
    schema = f"`{key}` {databases.schema[key].dataType.simpleString()}, error string, {SCHEMAS[section]}"

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind_of = b.column(0).type
            for i in range(b.num_rows):
                data = b.column(1)[i].as_buffer() if b.column(1)[i].is_valid else pa.py_buffer(b"")
                own = lambda n, i=i: pa.array([b.column(0)[i].as_py()] * n, kind_of)
                try:
                    head, at, n = _section(memoryview(data), section)
                except FormatError as e:
                    types = columns_of(section, ((VERSION, 0, 0, 0.0, 0.0, 0.0, 0, 0, 0) if section == "header" else np.zeros(0, ADB_STAR if section == "stars" else ADB_PATTERN)), 0)
                    yield pa.RecordBatch.from_arrays([own(1), pa.array([f"{type(e).__name__}: {e}"]), *[pa.nulls(1, t.type) for t in types]], names=[key, "error", *names])
                    continue
                if section == "header":
                    yield pa.RecordBatch.from_arrays([own(1), pa.nulls(1, pa.string()), *columns_of(section, head[1:], 0)], names=[key, "error", *names])
                    continue
                rows = np.frombuffer(data, ADB_STAR if section == "stars" else pattern_kind(head[0]), n, at)
                for first in range(0, n, STEP):
                    part = rows[first : first + STEP]
                    yield pa.RecordBatch.from_arrays([own(len(part)), pa.nulls(len(part), pa.string()), *columns_of(section, part, first)], names=[key, "error", *names])

    return databases.select(F.col(f"`{key}`"), F.col(f"`{content}`")).mapInArrow(expanded, schema)
