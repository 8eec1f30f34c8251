"""Operator 13: base spans against the contract's patterns, the trees against exhaustive splits, what the model adds on planted texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from skyquad.llm import common, personal

SF = "/root/testdata/sf0.1"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text):
    """(start, rank, end) by the patterns as they are written."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a1@.-", "0123.255 ", "+1 (02)5-7.9", "4 5-1+@a.(", "0123456789", "ab@.%+_é \n1"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(50)))
        assert personal.base_spans(text) == plain(text), text


def test_base_spans_of_whole_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in personal.op13_personal_data(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        base = plain(t or "")
        line = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[d]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and [got[d][f"n_{k}"] for k in personal.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert not line or set(line.split(",")) <= set(got[d]["spans"].split(","))


@pytest.fixture(scope="module")
def model(spark):
    return personal.train(spark.read.parquet(f"{SF}/documents.parquet"))


def valid(r):
    digits = "".join(str(r.randrange(10)) for _ in range(15))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_what_the_model_adds(model):
    """Numbers that fail as one match are found one by one; decoys beside them, and in clean texts, are not."""
    r, hits, wanted, wrong = random.Random(13), 0, 0, 0
    for _ in range(400):
        phone = f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}"
        card = valid(r)
        decoy = card[:-1] + str((int(card[-1]) + r.randrange(1, 10)) % 10)
        for text, want in ((f"ca {phone} {card} ende", [("phone", phone), ("card", card)]), (f"la {card} {decoy} oui", [("card", card)]), (f"in {decoy} und", []), (f"the {decoy[:9]} of {decoy[:7]}", []), ("no numbers at all. here", [])):
            added = [(personal.KINDS[k], text[a:b]) for a, k, b, s in personal.select(text, model) if s is not None]
            hits += sum(w in added for w in want)
            wanted += len(want)
            wrong += sum(a not in want for a in added)
    assert hits >= 0.95 * wanted and wrong <= 0.02 * wanted


def test_a_first_split_is_the_best_of_all():
    r = np.random.default_rng(5)
    x = r.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (r.random(300) < 0.1)).astype(int)
    model = personal.boost(x, y, np.ones(300), rounds=1)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(f, t):
        left = x[:, f] <= t
        parts = [(g[m].sum() ** 2 / (h[m].sum() + 1.0), h[m].sum()) for m in (left, ~left)]
        return sum(a for a, _ in parts) if min(b for _, b in parts) >= 1 else 0.0

    best = max((gain(f, t), f, t) for f in range(4) for t in range(11))
    assert (model.feature[0][0], model.threshold[0][0]) == best[1:] == (2, 6)
    many = personal.boost(x, y, np.ones(300))
    assert ((many.score(x) > 0.5) == (y == 1)).mean() > 0.89


def test_cuts_keep_the_precision_on_the_rows_that_set_them():
    r = np.random.default_rng(1)
    x = np.zeros((4000, len(personal.FEATURES)))
    x[:, 0] = r.integers(0, 4, 4000)
    x[:, 1] = r.random(4000)
    y = (r.random(4000) < x[:, 1]).astype(int)
    y[x[:, 0] == 3] = 0
    model = personal.boost(x, y, np.ones(4000))
    cut = personal.cuts(model, x, y, np.ones(4000), 0.9, 20)
    s = model.score(x)
    for k in range(3):
        own = (x[:, 0] == k) & (s >= cut[k])
        assert y[own].mean() >= 0.9 and own.sum() >= 20
    assert cut[3] == np.inf and (personal.no_model().cut == np.inf).all()


def test_one_class_or_no_rows(spark):
    assert (personal.train(spark.createDataFrame([], "doc_id long, text string")).cut == np.inf).all()
    none = personal.train(spark.createDataFrame([(1, None), (2, "a@b.example c")], "doc_id long, text string"))
    assert (none.cut == np.inf).all()


def test_odd_rows_and_columns(spark, model):
    phone = "+1 (212) 555-1234 4000000000000002 end"
    rows = [(1, None, "u"), (2, "", "u"), (None, phone, "u"), (None, phone, "u"), (5, "é𝔘 x.1@mail.example.com, 1.2.3.4", "u"), (6, "a" * 300_000 + "@", "u"), (7, "1 " * 50_000 + "+" * 50_000, "u"), (8, "+1" + " " * 200_000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    began = time.time()
    got = sorted(personal.find(docs, model, redact=True).collect(), key=lambda x: (x["doc_id"] or 99, x["text"] or ""))
    assert time.time() - began < 60 and len(got) == len(rows)
    assert [x["spans"] for x in got[:2]] == [[], []] and [x["redacted"] for x in got[:2]] == ["", ""]
    assert got[2]["redacted"] == "é𝔘 [EMAIL], [IP]" and [(x["kind"], x["start"]) for x in got[2]["spans"]] == [("email", 3), ("ip", 25)]
    assert got[-1]["redacted"] == got[-2]["redacted"] == "[PHONE] [CARD] end" and all(x["score"] > 0.5 for x in got[-1]["spans"])
    assert personal.find(common.written(docs.limit(0), "none"), model).collect() == []
    assert personal.redacted("ab 12 34 cd", [(3, 2, 6, None), (4, 3, 8, 0.9), (9, 0, 11, None)]) == "ab [CARD] [EMAIL]"


def test_all_candidates_count(spark, monkeypatch):
    """Trees of a table are those of all its candidates in one array, however they are dealt, and copies of the table change no split."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(1500)
    rows = personal.labelled(docs).filter("not held").collect()
    x, y = np.array([r["x"] for r in rows], dtype=float), np.array([r["label"] for r in rows])
    grown = personal.grown
    monkeypatch.setattr(personal, "grown", lambda *a, **k: grown(*a, **k | {"rounds": 4}))
    got, want = personal.train(docs, a_part=50), personal.boost(x, y, np.ones(len(x)), rounds=4)
    assert np.array_equal(got.feature, want.feature) and np.array_equal(got.threshold, want.threshold) and got.value == pytest.approx(want.value)
    assert np.array_equal(personal.train(docs).value, got.value)
    held = personal.labelled(docs).filter("held").collect()
    hx, hy = np.array([r["x"] for r in held], dtype=float), np.array([r["label"] for r in held])
    plain_cut = personal.cuts(want, hx, hy, np.ones(len(hx)), 0.95, 20)
    assert got.cut == pytest.approx(plain_cut, abs=2 / personal.STEPS)
