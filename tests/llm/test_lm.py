"""Scores from partial counts of batches: batches of any size, and bytes that they take."""

import io

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet

from skyquad.llm import common, lm_scoring
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most_words", [1, 700])
def test_small_batches(spark, most_words):
    docs = common.documents(spark, SF)
    same(lm_scoring.backoff_scores(docs, most_words=most_words).selectExpr("doc_id", "n_words", "n_bigrams", "n_trigrams", "round(score, 4) score"), lm_scoring.OP9_SQL, SF)


def test_bytes_of_a_word():
    """Entries of the count tables and the words that wait take fewer than 15 bytes a word, where a row for each position took 22; a hot word has one entry."""
    r = np.random.default_rng(4)
    names = r.integers(0, 1 << 63, 1 << 20, dtype=np.uint64)
    words, sizes = names[np.minimum(r.zipf(1.2, 400_000), len(names)) - 1], np.full(800, 500)
    batch = lm_scoring.Batch(0)
    batch.add(pa.array(np.arange(800)), sizes, words)
    kept, *_ = batch.table()
    parquet.write_table(kept, file := io.BytesIO(), compression="zstd", use_dictionary=False)
    entries = list(lm_scoring.partial_counts(lm_scoring.grams(words, sizes).keys, 6))
    assert sum(len(data) for *_, data in entries) + len(file.getvalue()) < 15 * len(words)
    assert sum(n for _, n, _ in entries) == len(np.unique(lm_scoring.grams(words, sizes).keys))


def test_counts_of_the_other_fold():
    keys = [np.array(k, dtype=np.uint64) for k in ([1, 1, 5], [1, 7, 1 << 60], [1, 5, 5], [9])]
    rows = [(f, n, data) for f, k in zip((0, 0, 1, 1), keys, strict=True) for b, n, data in lm_scoring.partial_counts(k, 3) if b == 0]
    got = [lm_scoring.spread(x, n, "<i8")[0].tolist() for x, (_, n, _) in zip(lm_scoring.other_counts(rows, 0, 3), rows, strict=True)]
    assert got == [[1, 2], [1, 0, 0], [3, 1], [0]]
