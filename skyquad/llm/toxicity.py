"""Operator 10: toxicity by a character n-gram linear classifier with naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import documents, small_batches

#: Features are the bins of a hash of 2 ** BITS values.
BITS = 20
#: Lengths, in code points, of the character n-grams.
ORDERS = (3, 4, 5)
#: Parts of the labelled rows that choose() keeps back in turn.
FOLDS = 4
#: Code points whose n-grams are hashed at once; a longer text is hashed by itself.
_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Model:
    """weight: of each bin, the log-count ratio already multiplied in. A text's score is the logistic of bias plus the weights of the bins that it has."""

    weight: np.ndarray
    bias: float


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, nulls as empty ones, in runs of _AT_ONCE code points or of one text."""
    held, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if held and size + len(t) > _AT_ONCE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def bins(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the bins of its n-grams, A-Z lower-cased, repeats included; a null or empty text has none.

    An n-gram never reaches over a text's end, and each text is taken whole.
    """
    for some in _slices(texts):
        x = np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4")
        x = np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint32) * np.uint32(0x85EBCA6B)
        hashed = []
        for n in ORDERS:
            h = np.full(max(len(x) - n + 1, 0), n, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + x[k : k + len(h)]
            hashed.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
        b = 0
        for t in some:
            a, b = b, b + len(t)
            yield np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(ORDERS, hashed, strict=True)])


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(label, bins as int32 bytes, fold) of the documents of up to per_class doc_ids of each label, those with the smallest hash of doc_id.

    A doc_id counts once: with its greatest label, and of the texts that it has
    with the one of the least hash. fold, 0 to FOLDS - 1, is by the text, so
    that equal texts are in one. Only these documents' texts are shuffled.
    """
    order = F.xxhash64(F.lit("toxicity sample"), "doc_id")
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    picked = [known.filter(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # 2 * per_class rows at most
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["label"].cast(pa.int32()), pa.array([np.unique(x).tobytes() for x in bins(b["text"])], pa.binary()), b["fold"]], names=["label", "bins", "fold"])

    fold = F.pmod(F.col("t.h"), F.lit(FOLDS)).cast("int").alias("fold")
    return rows.select("label", F.col("t.text").alias("text"), fold).mapInArrow(featured, "label int, bins binary, fold int")


def fit(rows: list[tuple[int, bytes]], share: float, least_docs: int = 5, least_z: float = 4.0, epochs: int = 30, l2: float = 1e-2, rate: float = 0.1, seed: int = 10) -> Model:
    """A model from rows (label, bins); share: of label 1 among the texts that scores are made for, to which the bias is set.

    A bin's ratio is the log of its smoothed share of the label 1 rows over that
    of the label 0 rows, as in naive Bayes; bins of fewer than least_docs rows,
    or whose shares differ by less than least_z standard errors, have no
    weight. On features scaled by their ratio a logistic regression is fitted
    by AdaGrad. With one class only, every text gets share.
    """
    y = np.array([k for k, _ in rows], dtype=np.float64)
    dims, prior = 1 << BITS, np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    if len(rows) == 0 or y.min() == y.max():
        return Model(np.zeros(dims, np.float32), float(prior))
    sets = [np.frombuffer(x, dtype=np.int32) for _, x in rows]
    counts = [np.zeros(dims), np.zeros(dims)]
    for k, x in zip(y, sets, strict=True):
        counts[int(k)][x] += 1
    n1, both = y.sum(), counts[0] + counts[1]
    n0, p = len(y) - n1, both / len(y)
    z = (counts[1] / n1 - counts[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    kept = (both >= least_docs) & (np.abs(z) >= least_z)
    sets = [x[kept[x]] for x in sets]
    ratio = np.where(kept, np.log((counts[1] + 1) / (n1 + 2)) - np.log((counts[0] + 1) / (n0 + 2)), 0.0)
    w, g2, bias, b2, draw = np.zeros(dims), np.full(dims, 1e-8), 0.0, 1e-8, np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(draw.permutation(len(y)), max(1, len(y) // 128)):
            x = np.concatenate([sets[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(sets[i]) for i in part])
            e = (1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[x] * ratio[x], len(part)), -30, 30))) - y[part]) / len(part)
            used, where = np.unique(x, return_inverse=True)
            g = np.bincount(where, e[row] * ratio[x], len(used)) + l2 * w[used]
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
            b2 += e.sum() ** 2
            bias -= rate * e.sum() / np.sqrt(b2)
    return Model((w * ratio).astype(np.float32), float(bias + prior - np.log(n1 / n0)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, share: float = 0.4) -> Model:
    """Fits on at most per_class labelled rows of each class, in one task, whose input that bound makes independent of the table's size; the driver gets the weights only.

    Scores take share of the texts as label 1, so that they do not depend on how
    many rows of either label happen to be there.
    """
    small_batches(docs.sparkSession)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(k, x) for b in batches for k, x in zip(b["label"].to_pylist(), b["bins"].to_pylist(), strict=True)]
        model = fit(sorted(rows), share)
        at = np.flatnonzero(model.weight).astype(np.int32)
        yield pa.record_batch([[at.tobytes()], [model.weight[at].tobytes()], [model.bias]], names=["at", "weight", "bias"])

    got = labelled(docs, labels, per_class).repartition(1).mapInArrow(fitted, "at binary, weight binary, bias double").first()
    weight = np.zeros(1 << BITS, np.float32)
    if got is None:  # no labelled rows at all, so no task
        return fit([], share)
    weight[np.frombuffer(got["at"], np.int32)] = np.frombuffer(got["weight"], np.float32)
    return Model(weight, got["bias"])


def average_precision(y: np.ndarray, z: np.ndarray) -> float:
    """The mean, over the rows of label 1, of the share of label 1 among the rows that score at least as high."""
    order = np.argsort(-z, kind="stable")
    hits = y[order] == 1
    last = np.searchsorted(-z[order], -z[order], side="right")  # of equal scores
    return float((np.cumsum(hits)[last - 1] / last)[hits].mean()) if hits.any() else 0.0


def choose(docs: DataFrame, labels: DataFrame, settings: list[dict], shares: list[float], per_class: int = 1500, reject: float = 0.7, most_wrong: float = 0.01) -> list[tuple]:
    """Rows (setting, average precision, share, recall, false positives, F1), the best first, from labelled rows that are learned from.

    Each setting, a dict of fit()'s arguments, is fitted FOLDS times without one
    fold, which it then scores; every pair of a setting and a fold is a task's
    row, over the labelled rows, whose number per_class bounds. The rule: the
    setting of the greatest average precision over all scores so made, of equal
    ones the first in the list; with it the share of the greatest recall at
    reject among those with false positives of at most most_wrong, of equal ones
    the least. Rates are those of rows outside of the fit. Pass no
    held-out rows: what is chosen by them cannot be judged by them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = sorted((r["label"], bytes(r["bins"]), r["fold"]) for r in labelled(docs, labels, per_class).toLocalIterator())  # 2 * per_class rows at most
    shared = spark.sparkContext.broadcast(rows)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["id"].to_pylist():
                which, fold = divmod(i, FOLDS)
                model = fit([(k, x) for k, x, f in shared.value if f != fold], 0.5, **settings[which])
                back = [(k, model.weight[np.frombuffer(x, np.int32)].sum(dtype=np.float64) + model.bias) for k, x, f in shared.value if f == fold]
                yield pa.record_batch([[which] * len(back), [k for k, _ in back], [float(z) for _, z in back]], schema=pa.schema([("which", pa.int32()), ("label", pa.int32()), ("z", pa.float64())]))

    tasks = len(settings) * FOLDS
    got = spark.range(0, tasks, 1, tasks).mapInArrow(tried, "which int, label int, z double").toPandas()
    out = []
    for which, part in got.groupby("which"):
        y, z = part["label"].to_numpy(), part["z"].to_numpy()
        for share in shares:
            p = z + np.log(share / (1 - share)) >= np.log(reject / (1 - reject))
            hit, wrong = int((p & (y == 1)).sum()), int((p & (y == 0)).sum())
            ones, zeros = int((y == 1).sum()), int((y == 0).sum())
            out.append((which, average_precision(y, z), share, hit / max(ones, 1), wrong / max(zeros, 1), 2 * hit / max(hit + wrong + ones, 1)))
    out.sort(key=lambda r: (-r[1], r[0], r[4] > most_wrong, -r[3], r[2]))
    return [(settings[r[0]], *r[1:]) for r in out]


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with score, or a column of another name (0 to 1, higher: more likely toxic), of whole texts, however long.

    A null or empty text has the bias's score; so has one without any weighed
    n-gram. Repeated rows and equal texts get equal scores. A null doc_id is no
    different. An empty table gives an empty result. A column of docs of that
    name is replaced; all others stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(name)
    shared = spark.sparkContext.broadcast((model.weight, model.bias))  # 2 ** BITS numbers whatever the input
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        weighed = weight != 0
        for b in batches:
            z = np.array([weight[np.unique(x[weighed[x]])].sum(dtype=np.float64) for x in bins(b["text"])], dtype=np.float64) + bias
            yield pa.record_batch([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*b.schema.names, name])

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept back from learning: crc32 of its id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train_on(spark: SparkSession, sf_dir: str) -> Model:
    """A model from the labelled documents of a folder of tables that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return train(documents(spark, sf_dir).filter(~held_out(F.col("doc_id"))), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir).select("doc_id", "text"), train_on(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
