"""Operator 1: token ids in files of patched frame-of-reference blocks."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquad.llm.common import documents, shared_dir, small_batches, written

#: Ids in a block.
BLOCK = 1024
#: The share of a block's ids whose bits decide its width; the others' upper bits are exceptions.
PERCENTILE = 90
#: Pieces that are encoded as one text: with 2,000 the tokenizer took nearly twice as long.
AT_ONCE = 100
_MAGIC = b"PFRB0001"
_TAIL = struct.Struct("<QQQ8s")  # ids, documents, where the footer starts, magic
_FAR = re.compile(r"(?<=\S) (?=\S)")
#: What \s means to re, for Arrow's expressions; texts where a space is in a longer run, or ends one; pieces that may not stay apart from a space before them.
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUN = f"[{_SPACE}] (?:[{_SPACE}]|\\z)"
_ODD = f"^$|^[{_SPACE}]| "


def widths(blocks: np.ndarray, percentile: float) -> np.ndarray:
    """Bits for each row of the array of offsets: enough for the given percentile of its values."""
    k = max(int(np.ceil(percentile / 100 * blocks.shape[1])) - 1, 0)
    return np.ceil(np.log2(np.partition(blocks, k, axis=1)[:, k].astype(np.float64) + 1)).astype(np.int64)


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low width bits of each value, one after the other from the lowest bit on, as a row of bytes for each row of values.

    Each 32 values fill width whole words, so a value's word and place in it
    are the same for all runs of 32 and all rows at once.
    """
    n, m = values.shape
    runs = -(-m // 32)
    padded = np.zeros((n, runs * 32), dtype=np.uint32)
    padded[:, :m] = values & np.uint32((1 << width) - 1)
    padded = np.ascontiguousarray(padded.reshape(n * runs, 32).T)
    words = np.zeros((width, n * runs), dtype=np.uint32)
    for j in range(32):
        at, shift = divmod(j * width, 32)
        words[at] |= padded[j] << np.uint32(shift)
        if shift + width > 32:
            words[at + 1] |= padded[j] >> np.uint32(32 - shift)
    return np.ascontiguousarray(words.T, dtype="<u4").view(np.uint8).reshape(n, runs * width * 4)[:, : (m * width + 7) // 8]


def pack(ids: np.ndarray, percentile: float = PERCENTILE, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bytes of the blocks of ids (unsigned 32-bit), and the length of each block.

    A block: minimum, number of ids, width, number of exceptions; the low width
    bits of each id less the minimum; then the exceptions' places and upper bits.
    """
    out: list[bytes] = []
    whole = len(ids) // block * block
    for part in (ids[:whole].reshape(-1, block), ids[whole:].reshape(1, -1)):
        if part.size == 0:
            continue
        least = part.min(axis=1)
        over = part - least[:, None]
        width = widths(over, percentile)
        packed: list[bytes] = [b""] * len(part)
        for w in np.unique(width):
            if w:
                at = np.flatnonzero(width == w)
                for i, r in zip(at, packed_bits(over[at], int(w)), strict=True):
                    packed[i] = r.tobytes()
        upper = np.where(width[:, None] < 32, over >> np.minimum(width, 31).astype(np.uint32)[:, None], np.uint32(0))
        for i, head in enumerate(least):
            where = np.flatnonzero(upper[i])
            out.append(struct.pack("<IHBH", head, part.shape[1], width[i], len(where)) + packed[i] + where.astype("<u2").tobytes() + upper[i, where].astype("<u4").tobytes())
    return b"".join(out), np.array([len(x) for x in out], dtype=np.int64)


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these places of data."""
    out = []
    for at in starts:
        least, n, width, extra = struct.unpack_from("<IHBH", data, at)
        at += 9
        size = (n * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        over = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)
        at += size
        where = np.frombuffer(data, "<u2", extra, at)
        over[where] |= np.frombuffer(data, "<u4", extra, at + 2 * extra) << np.uint32(width)
        out.append(over + np.uint32(least))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class FileOf:
    """A file being made: ids are packed as soon as a run of whole blocks is there, so that no more than that run stands unpacked."""

    def __init__(self, run: int = 128 * BLOCK) -> None:
        self.run, self.waiting, self.held, self.packed = run, [], 0, []
        self.sizes: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.run:
            self._pack(self.held // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for at in range(0, n, self.run):
            data, sizes = pack(ids[at : min(at + self.run, n)])
            self.packed.append(data)
            self.sizes.append(sizes)
        self.waiting, self.held = [ids[n:].copy()], len(ids) - n

    def parts(self) -> Iterator[bytes]:
        """The file's bytes: magic, blocks, then the index (where blocks start; the documents' ids, null flags and numbers of ids) and the tail."""
        self._pack(self.held)
        sizes = np.concatenate([np.zeros(1, np.int64), *self.sizes])
        starts = len(_MAGIC) + np.cumsum(sizes)
        yield _MAGIC
        yield from self.packed
        yield starts[:-1].astype("<u8").tobytes()
        yield np.array([x or 0 for x in self.doc_ids], dtype="<i8").tobytes()
        yield np.array([x is not None for x in self.doc_ids], dtype=np.uint8).tobytes()
        yield np.array(self.counts, dtype="<u8").tobytes()
        yield _TAIL.pack(self.ids, len(self.doc_ids), int(starts[-1]), _MAGIC)


def read_file(data: bytes, block: int = BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document, in order. Blocks are found by the index and unpacked as they are needed."""
    n, docs, at, magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
    if magic != _MAGIC or data[: len(_MAGIC)] != _MAGIC:
        raise ValueError("not a file of token blocks")
    nb = -(-n // block)
    starts = np.frombuffer(data, "<u8", nb, at).astype(np.int64)
    keys = np.frombuffer(data, "<i8", docs, at + 8 * nb)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * nb + 8 * docs)
    counts = np.frombuffer(data, "<u8", docs, at + 8 * nb + 9 * docs).astype(np.int64)
    ends = np.cumsum(counts)
    held, first, chunk = np.zeros(0, np.uint32), 0, 512  # ids from place first on are held
    for k, ok, c, e in zip(keys, known, counts, ends, strict=True):
        a, parts = int(e - c), []
        while first + len(held) < e:
            parts.append(held[max(0, a - first) :])
            nxt = (first + len(held)) // block
            first, held = nxt * block, unpack(data, starts[nxt : nxt + chunk])
        parts.append(held[max(0, a - first) : int(e) - first])
        yield (int(k) if ok else None), a, np.concatenate(parts)


class Pieces:
    """Known pieces of texts and the ids of a space and each piece: those of piece k are ids[starts[k] : starts[k + 1]]."""

    def __init__(self) -> None:
        self.names, self.ids, self.starts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])


@lru_cache(maxsize=2)
def encoder(path: str, most: int = 400_000) -> Callable[[list[str]], list[bytes]]:
    """A function that gives texts' ids as unsigned 32-bit integers, exactly as the tokenizer at path encodes each whole text.

    A byte-level tokenizer with the usual splitting pattern never merges over a
    single space between two visible characters; such texts are cut there, and
    each distinct piece is encoded once. Other tokenizers get whole texts. Up to
    most pieces are kept, about 40 bytes a piece, and those of the texts at
    hand; then all are forgotten and encoded again as they come up.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, extra = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
    apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and not any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in extra)

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    if not apart:
        return lambda texts: [x.tobytes() for x in whole(texts)]
    vocabulary = model.get_vocab()
    opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # tokens that begin with a space
    known = Pieces()

    def one_by_one(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = whole(texts)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def apart_by_a_space(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return one_by_one([" " + p for p in pieces.to_pylist()])

    def spaced(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each piece, and how many each has. Pieces that surely stay apart are encoded in one text; a space's token begins each."""
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(pieces), AT_ONCE), len(pieces)).astype(np.int32)), pieces.cast(pa.string()))
        joined = np.concatenate(whole([" " + t for t in pc.binary_join(lists, " ").to_pylist()]))
        starts = np.flatnonzero(opens[joined])
        if len(starts) != len(pieces):
            return apart_by_a_space(pieces)
        return joined, np.diff(starts, append=len(joined))

    def learn(fresh: pa.Array) -> None:
        odd = pc.match_substring_regex(fresh, _ODD)
        for pieces, how in ((fresh.filter(pc.invert(odd)), spaced), (fresh.filter(odd), apart_by_a_space)):
            if len(pieces):
                known.add(pieces, *how(pieces))

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        nonlocal known
        if len(known.names) > most:
            known = Pieces()
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        runs = pc.match_substring_regex(texts, _RUN)
        cut = pc.split_pattern(texts.filter(pc.invert(runs)), " ").cast(kind := pa.large_list(pa.large_string()))
        if len(cut) < len(texts):
            cut = pa.concat_arrays([cut, pa.array([_FAR.split(t) for t in texts.filter(runs).to_pylist()], kind)])
            cut = cut.take(pa.array(np.argsort(np.argsort(np.asarray(runs), kind="stable"), kind="stable")))  # in the order of the texts
        ends = np.cumsum(np.asarray(cut.value_lengths()).astype(np.int64))
        heads = np.concatenate([np.zeros(1, np.int64), ends[:-1]])  # a text's first piece has no space before it
        coded = cut.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        later = np.ones(len(codes), dtype=bool)
        later[heads] = False
        wanted = np.zeros(len(names), dtype=bool)
        wanted[codes[later]] = True
        fresh = names.filter(pc.and_(pa.array(wanted), pc.invert(pc.is_in(names, value_set=known.names))))
        if len(fresh):
            learn(fresh)
        at = pc.fill_null(pc.index_in(names, value_set=known.names), 0).to_numpy().astype(np.int64)[codes]
        head_ids, head_sizes = one_by_one(names.take(pa.array(codes[heads])).to_pylist())
        at[heads] = len(known.names) + np.arange(len(heads))
        ids, starts = np.concatenate([known.ids, head_ids]), np.concatenate([known.starts, known.starts[-1] + np.cumsum(head_sizes)])
        sizes = (starts[1:] - starts[:-1])[at]
        upto = np.cumsum(sizes)
        out = ids[np.repeat(starts[at] - upto + sizes, sizes) + np.arange(upto[-1])]
        edges = [0, *upto[ends - 1].tolist()]
        return [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    return encode


def runs_of(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """(place, texts, nulls as empty ones) in runs of most characters, or of one text."""
    texts = pc.fill_null(texts, "")
    ends, first = np.cumsum(np.asarray(pc.utf8_length(texts)).astype(np.int64)), 0
    while first < len(texts):
        past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, texts.slice(first, past - first)
        first = past


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, ids_a_file: int = 1 << 22) -> DataFrame:
    """Writes the files to folder, a place that all executors share, and returns their manifest: (part, seq, path, docs, ids).

    Documents are dealt out by ranges of doc_id and sorted in each range, so
    that files in the order (part, seq) hold them in ascending order. A task
    starts a new file after ids_a_file ids. A file is written under another
    name and then moved: a repeated task puts the same bytes in its place.

    A null text is empty and has the end id alone. Null ids come first; rows
    with equal ids are ordered by a hash of their texts. An empty table gives
    no file. Texts of any length are encoded whole. Columns other than doc_id
    and text are not written.
    """
    small_batches(docs.sparkSession)

    def wrote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, attempt, encode, end, seq = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 0
        file = FileOf()

        def put() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}.pfr"
            with store.open_output_stream(f"{base}/_{attempt}-{name}") as f:
                for x in file.parts():
                    f.write(x)
            store.move(f"{base}/_{attempt}-{name}", f"{base}/{name}")
            return pa.record_batch([[part], [seq], [name], [len(file.doc_ids)], [file.ids]], names=["part", "seq", "name", "docs", "ids"])

        for b in batches:
            keys = b["doc_id"].to_pylist()
            for at, texts in runs_of(b["text"]):
                for k, x in zip(keys[at : at + len(texts)], encode(texts), strict=True):
                    file.add(k, np.frombuffer(x + end, dtype="<u4"))
                    if file.ids >= ids_a_file:
                        yield put()
                        file, seq = FileOf(), seq + 1
        if file.doc_ids:
            yield put()

    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    dealt = order.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return written(dealt.mapInArrow(wrote, "part long, seq long, name string, docs long, ids long"), "token_manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, name) from the files: start counts the ids of all documents before."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["name"].to_pylist(), b["content"], strict=True):
                rows = [(k, a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, a, x in read_file(data.as_buffer().to_pybytes())]
                k, a, n, c = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array([name] * len(k))], names=["doc_id", "at", "n_tokens", "ids_crc32", "name"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    rows = files.mapInArrow(read, "doc_id long, at long, n_tokens long, ids_crc32 long, name string")
    return rows.join(bases, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "name")


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs as files of token blocks and reads them back: (doc_id, start, n_tokens, ids_crc32, name). An empty table gives an empty result."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token_files")
    manifest = write_files(docs, tokenizer, folder, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, name string")
    return read_files(spark, folder, manifest)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(documents(spark, sf_dir), default_tokenizer()).select("doc_id", "start", "n_tokens", "ids_crc32")
