"""Operator 9: stupid-backoff scores from relational n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import WORD, documents, lower_ascii, shared_dir, small_batches

#: Words in a batch of documents of one fold, unless one document has more. Entries of count tables in a bucket, of which a task holds one at a time.
WORDS, ENTRIES = 1 << 21, 1 << 21
#: The bucket of a batch's number of words.
_ALL = -1
_PAIR, _THREE = ([np.uint64(x) for x in xs] for xs in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)))


def fold_of(doc_id: Column) -> Column:
    """0 or 1, by the first digit of the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 1), 16, 10).cast("long") % 2


class Grams(NamedTuple):
    """The hashes of a batch's words, then of its pairs, then of its threes, and the places of the words that end the pairs and the threes."""

    keys: np.ndarray
    two: np.ndarray
    three: np.ndarray


def grams(words: np.ndarray, sizes: np.ndarray) -> Grams:
    """The n-grams of documents of these sizes, from their words' 64-bit hashes; none crosses a document's edge."""
    nth = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    two, three = np.flatnonzero(nth >= 1), np.flatnonzero(nth >= 2)
    pairs = words[two - 1] * _PAIR[0] + words[two] * _PAIR[1]
    threes = words[three - 2] * _THREE[0] + words[three - 1] * _THREE[1] + words[three] * _THREE[2]
    return Grams(np.concatenate([words, pairs, threes]), two, three)


def squeezed(*arrays: np.ndarray) -> bytes:
    """The arrays, first all first bytes of an array's numbers, then all second ones and so on, compressed."""
    return pa.compress(b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays), codec="zstd", asbytes=True)


def spread(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    """The arrays of n numbers that squeezed() has put into data."""
    sizes = [n * np.dtype(t).itemsize for t in types]
    raw, at, out = np.frombuffer(pa.decompress(data, sum(sizes), codec="zstd"), np.uint8), 0, []
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, n).T).view(t).reshape(n))
        at += size
    return out


def partial_counts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, entries, the entries' hashes and counts) for each bucket, the first bits of a hash. Hashes are in order, each given by its distance from the one before."""
    keys, counts = np.unique(keys, return_counts=True)
    low = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    edges = [*np.searchsorted(keys, low).tolist(), len(keys)]
    for b, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if end > start:
            yield b, end - start, squeezed(np.diff(keys[start:end], prepend=low[b]), counts[start:end].astype(np.uint32))


def other_counts(rows: list[tuple[int, int, bytes]], bucket: int, bits: int) -> list[bytes]:
    """For each of a bucket's rows (fold, entries, data), how often the other fold has its n-grams, in their order."""
    low, held = np.uint64(bucket) << np.uint64(64 - bits), []
    for _, n, data in rows:
        steps, counts = spread(data, n, "<u8", "<u4")
        held.append((low + np.cumsum(steps, dtype=np.uint64), counts))
    tables = []
    for fold in (0, 1):
        mine = [h for h, (f, *_) in zip(held, rows, strict=True) if f == fold]
        keys = np.concatenate([k for k, _ in mine]) if mine else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        counts = np.concatenate([c for _, c in mine])[order].astype(np.int64) if mine else np.zeros(0, np.int64)
        tables.append((keys[first], np.add.reduceat(counts, first) if len(first) else counts))
    out = []
    for (keys, _), (fold, *_) in zip(held, rows, strict=True):
        known, counts = tables[1 - fold]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        out.append(squeezed(np.where(known[at] == keys, counts[at], 0) if len(known) else np.zeros(len(keys), np.int64)))
    return out


def document_scores(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, total: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs found, threes found, score) of each document of a batch; counts: the other fold's, of the batch's n-grams in the order of their hashes."""
    g, n = grams(words, sizes), len(words)
    c = counts[np.unique(g.keys, return_inverse=True)[1]]
    c1, c2, c3 = c[:n], np.zeros(n, np.int64), np.zeros(n, np.int64)
    c2[g.two], c3[g.three] = c[n : n + len(g.two)], c[n + len(g.two) :]
    depth = np.zeros(n)
    depth[g.two] = 1
    depth[g.three] = 2
    log = lambda x: np.log(np.maximum(x, 1))
    before = lambda x: np.concatenate([x[:1], x[:-1]])
    alone = depth * np.log(alpha) + log(c1) - np.log(max(total, 1))
    pair = np.maximum(depth - 1, 0) * np.log(alpha) + log(c2) - before(log(c1))
    x = np.where(c3 > 0, log(c3) - before(log(c2)), np.where(c2 > 0, pair, alone))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    of = lambda w: np.bincount(doc, weights=w, minlength=len(sizes)).astype(np.float64)
    return of(c2 > 0).astype(np.int64), of(c3 > 0).astype(np.int64), of(x)


class Batch:
    """Documents of one fold on their way into a batch."""

    def __init__(self, fold: int) -> None:
        self.fold, self.ids, self.sizes, self.words, self.held = fold, [], [], [], 0

    def add(self, ids: pa.Array, sizes: np.ndarray, words: np.ndarray) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.words.append(words)
        self.held += len(words)

    def table(self) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """(what is kept of the batch, its words' hashes, its documents' sizes). Words are kept as numbers, the more frequent first, their hashes once, each by its distance from the one before."""
        sizes, words = np.concatenate(self.sizes), np.concatenate(self.words)
        known, number, counts = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-np.log2(counts).astype(np.int64), kind="stable")  # hashes are in order among words about as frequent
        rank = np.empty(len(known), dtype=np.int32)
        rank[order] = np.arange(len(known), dtype=np.int32)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(rank[number]))
        # the hashes go with the first document
        hashes = pa.LargeListArray.from_arrays(pa.array(np.minimum(np.arange(len(sizes) + 1), 1) * len(known)), pa.array(np.diff(known[order], prepend=np.uint64(0)).view(np.int64)))
        return pa.table({"doc_id": pa.chunked_array(self.ids), "w": lists, "known": hashes}), words, sizes


def backoff_scores(docs: DataFrame, alpha: float = 0.4, most_words: int = WORDS) -> DataFrame:
    """docs' rows (doc_id, n_words, n_bigrams, n_trigrams, score): the sum of the words' log scores.

    Documents are dealt into two folds, and each is scored by the counts of the
    other fold. A word w after u v scores c(u v w) / c(u v) if the other fold has
    the three, else alpha * c(v w) / c(v) if it has the two, else alpha * alpha *
    c(w) / N; a document's second word starts at the pair, its first one at
    c(w) / N. A word that the other fold lacks counts as if it occurred once.
    n_bigrams, n_trigrams: pairs and threes that the other fold has.

    Tasks count the words, pairs and threes of batches of documents of one fold.
    These partial counts, one entry an n-gram and batch however often it occurs,
    are grouped by buckets of the n-grams' 64-bit hashes and summed by fold; each
    batch's entries meet the other fold's counts there, which are grouped by
    batch and summed along its documents. A batch's words wait in a file of the
    shared folder, so that no position is ever shuffled. A hot n-gram has an
    entry a batch, and buckets grow in number with the input, not in size.

    A null or empty text has no words and score 0; long texts count whole. Rows
    with equal doc_id and text get equal scores (ties), and each counts. A null
    doc_id is in the fold of the empty text. An empty table gives an empty
    result. Other columns, of any names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "scored_batches")
    text = lower_ascii(F.coalesce("text", F.lit("")))
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))
    rows = docs.select("doc_id", "text").select("doc_id", fold_of(F.col("doc_id")).cast("int").alias("fold"), words.alias("w"))
    length = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # a word is about six characters, and comes up as a word, in a pair and in a three
    bits = max(6, int(length / 2 / ENTRIES).bit_length())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, attempt, made = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        open_ = [Batch(0), Batch(1)]

        def put(batch: Batch) -> pa.RecordBatch:
            name = f"{part:06d}-{made:06d}.parquet"
            table, words, sizes = batch.table()
            with store.open_output_stream(f"{base}/_{attempt}-{name}") as f:
                parquet.write_table(table, f, compression="zstd", use_dictionary=False, column_encoding=dict.fromkeys(("w.list.element", "known.list.element"), "BYTE_STREAM_SPLIT"))
            store.move(f"{base}/_{attempt}-{name}", f"{base}/{name}")
            rows = [(_ALL, len(words), b""), *partial_counts(grams(words, sizes).keys, bits)]
            b, n, data = zip(*rows, strict=True)
            return pa.record_batch([pa.array(b, pa.int32()), pa.array([name] * len(b)), pa.array([batch.fold] * len(b), pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "batch", "fold", "n", "data"])

        for b in batches:
            folds, lists = np.asarray(b["fold"]), b["w"]
            sizes, words = np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(sizes)
            start = 0
            while start < len(sizes):
                # whole documents, up to as many words as a batch has
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_words, "right")))
                run = words[ends[start] - sizes[start] : ends[end - 1]]
                for f in (0, 1):
                    at = np.flatnonzero(folds[start:end] == f)
                    if not len(at):
                        continue
                    mine = run[np.repeat(folds[start:end] == f, sizes[start:end])]
                    if open_[f].held and open_[f].held + len(mine) > most_words:
                        yield put(open_[f])
                        open_[f], made = Batch(f), made + 1
                    open_[f].add(b["doc_id"].slice(start, end - start).take(pa.array(at)), sizes[start:end][at], mine)
                start = end
        for batch in open_:
            if batch.ids:
                yield put(batch)
                made += 1

    def met(table: pa.Table) -> pa.Table:
        bucket, folds, n = table["bucket"][0].as_py(), table["fold"].to_pylist(), table["n"].to_pylist()
        if bucket == _ALL:
            total = [sum(k for k, f in zip(n, folds, strict=True) if f == fold) for fold in (0, 1)]
            n, data = [total[1 - f] for f in folds], [b""] * len(folds)
        else:
            data = other_counts(list(zip(folds, n, table["data"].to_pylist(), strict=True)), bucket, bits)
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{base}/{table['batch'][0].as_py()}") as f:
            kept = parquet.read_table(f).combine_chunks()
        rows = sorted(zip(table["bucket"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.int64), *(spread(data, n, "<i8")[0] for _, n, data in rows[1:])])
        lists = kept["w"].combine_chunks()
        known, sizes = np.cumsum(kept["known"].combine_chunks().flatten().to_numpy().view(np.uint64), dtype=np.uint64), np.asarray(lists.value_lengths()).astype(np.int64)
        pairs, threes, score = document_scores(known[lists.flatten().to_numpy()], sizes, counts, rows[0][1], alpha)
        return pa.table({"doc_id": kept["doc_id"], "n_words": pa.array(sizes), "n_bigrams": pa.array(pairs), "n_trigrams": pa.array(threes), "score": pa.array(score)})

    partial = rows.mapInArrow(counted, "bucket int, batch string, fold int, n long, data binary")
    answers = partial.groupBy("bucket").applyInArrow(met, "batch string, bucket int, n long, data binary")
    id_type = dict(rows.dtypes)["doc_id"]
    return answers.groupBy("batch").applyInArrow(summed, f"doc_id {id_type}, n_words long, n_bigrams long, n_trigrams long, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(documents(spark, sf_dir)).withColumn("score", F.round("score", 4))


OP9_SQL = r"""
with d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 1))::int % 2 as fold,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, fold, unnest(w) as w, unnest(list_prepend(null, w[:-2])) as v, unnest(list_prepend(null, list_prepend(null, w))[:len(w)]) as u, generate_subscripts(w, 1) as i from d),
n1 as (select fold, w, count(*)::double as c from p group by all),
n2 as (select fold, v, w, count(*)::double as c from p where i > 1 group by all),
n3 as (select fold, u, v, w, count(*)::double as c from p where i > 2 group by all),
t as (select fold, count(*)::double as n from p group by fold),
s as (select p.doc_id, b.c is not null as hit, e.c is not null as hit3, case when e.c is not null then ln(e.c) - ln(uv.c)
    when b.c is not null then case when p.i > 2 then ln(0.4::double) else 0 end + ln(b.c) - ln(cv.c)
    else least(p.i - 1, 2) * ln(0.4::double) + ln(greatest(coalesce(cw.c, 1), 1)) - ln(coalesce(t.n, 1)) end as x
  from p left join n3 e on p.i > 2 and e.fold <> p.fold and e.u = p.u and e.v = p.v and e.w = p.w
    left join n2 uv on p.i > 2 and uv.fold <> p.fold and uv.v = p.u and uv.w = p.v
    left join n2 b on p.i > 1 and b.fold <> p.fold and b.v = p.v and b.w = p.w
    left join n1 cv on cv.fold <> p.fold and cv.w = p.v left join n1 cw on cw.fold <> p.fold and cw.w = p.w left join t on t.fold <> p.fold)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_bigrams, 0)::bigint as n_bigrams, coalesce(n_trigrams, 0)::bigint as n_trigrams, round(coalesce(score, 0), 4) as score
from d left join (select doc_id, count(*) filter (hit) as n_bigrams, count(*) filter (hit3) as n_trigrams, sum(x) as score from s group by doc_id) using (doc_id)
"""
