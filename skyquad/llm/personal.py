"""Operator 13: personal data by gradient boosting over candidate spans.

Generators of high recall propose overlapping spans. Four strict patterns give
the base spans, which always stay; where a pattern has looked at a span, its
answer is the span's label. Boosted trees learn from these labels which format
and context a true span has, and are then asked about spans that no pattern has
looked at by itself: parts of matches that failed as a whole, or written-out
addresses. A threshold for each kind, set on documents kept apart, decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquad.llm.common import documents, forget, small_batches, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SPANS = "array<struct<start: bigint, rank: int, kind: string, end: bigint, score: double>>"
FEATURES = ("kind", "length", "digits", "groups", "first_group", "last_group", "longest_group", "shortest_group", "separators", "plus", "brackets", "luhn", "largest_part", "distinct_digits", "local", "labels", "last_label", "last_label_letters", "left", "right", "word_before", "cue")
#: The longest span that a generator proposes, and the most digits.
LONGEST, DIGITS = 96, 19
#: Derivatives are counted in 1 / UNIT, so that the sums over 4 billion rows are exact; a cut is one of STEPS steps.
UNIT, STEPS = float(1 << 20), 1 << 20
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NEAR_HOST = re.compile(r"[A-Za-z0-9.-]+")
_AT = r"\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20"
#: What is looked for in a text: finding a fixed string is many times faster than a pattern.
_AT_FORMS = tuple(f(x) for x in (" at ", "(at)", "[at]", "( at )", "[ at ]") for f in (str, str.upper))
_DOT = r"(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)"
_SPELT = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_DOTTED_RUN = re.compile(r"[0-9][0-9.]{6,}")
_QUAD = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PHONE_RUN = re.compile(r"[0-9][ ().0-9-]{6,}")
_GROUP = re.compile(r"[0-9]+")
_CUE = re.compile(r"phone|mobile|tel|call|fax|mail|card|visa|credit|account|addr|host|server|ip\b", re.I)


def luhn(digits: str) -> bool:
    twice = sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])
    return (twice + sum(map(int, digits[::-2]))) % 10 == 0


def _octet(part: str) -> bool:
    """Whether a number is at most 255, however many digits it has."""
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _dotted(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of _QUAD or _DOTTED, looked for in runs of digits and dots only."""
    for run in _DOTTED_RUN.finditer(text):
        yield from pattern.finditer(text, *run.span())


def _ats(text: str) -> Iterator[tuple[int, int]]:
    """Places of a written-out at sign with one blank on either side."""
    for form in _AT_FORMS:
        i = text.find(form)
        while i >= 0:
            j = i + len(form)
            yield i - (form[0] != " " and text[i - 1 : i] == " "), j + (form[0] != " " and text[j : j + 1] == " ")
            i = text.find(form, j - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the strict patterns, in order, each in time linear in the text."""
    out = []
    if "@" in text:
        end = 0
        for m in _HOST.finditer(text):
            start = _local_start(text, m.start(), end)
            if start < m.start():
                out.append((start, EMAIL, m.end()))
                end = m.end()
    out += [(m.start(), IP, m.end()) for m in _dotted(_QUAD, text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _GROUP.findall(m[0]))) <= 15]
    return sorted(out)


def _windows(groups: list[tuple[int, int]], least: int, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of neighbouring groups with least to most digits in all."""
    for i, (start, _) in enumerate(groups):
        n = 0
        for a, b in groups[i : i + most]:
            n += b - a
            if n > most or b - start > LONGEST:
                break
            if n >= least:
                yield start, b


def proposals(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, asked) of overlapping spans; asked: a strict pattern has decided on exactly this span or on one that it cuts."""
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            start, near = _local_start(text, at, max(0, at - LONGEST)), _NEAR_HOST.match(text, at + 1, at + LONGEST)
            end = at + 1 + len(near[0].rstrip(".-")) if near else 0
            if start < at and end > at + 1:
                yield EMAIL, start, end, True
                if (cut := text.rfind(".", at, end)) > at:
                    yield EMAIL, start, cut, True
            at = text.find("@", at + 1)
    for left, right in _ats(text):
        start, host = _local_start(text, left, max(0, left - LONGEST)), _SPELT.match(text, right, right + LONGEST)
        if start < left and host:
            yield EMAIL, start, host.end(), False
    for m in _dotted(_DOTTED, text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i in range(len(groups) - 3):
            if groups[i + 3][1] - groups[i][0] <= LONGEST:
                yield IP, groups[i][0], groups[i + 3][1], len(groups) == 4
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 8:
            for start, end in _windows([g.span() for g in _GROUP.finditer(text, *m.span())], 8, DIGITS):
                yield CARD, start, end, (start, end) == m.span()
    for m in _PHONE_RUN.finditer(text):
        for start, end in _windows([g.span() for g in _GROUP.finditer(text, *m.span())], 7, 15):
            start -= text[start - 1 : start] == "("
            start -= text[start - 1 : start] == "+"
            yield PHONE, start, end, text[start] != "+" or end == m.start() + len(m[0].rstrip(" ().-"))


def _side(c: str) -> int:
    return 0 if c in ("", "\n") else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """The numbers of FEATURES. What makes a match of a strict pattern fail as a whole, the digits beside it, is not among them."""
    span = text[start:end]
    groups = [len(g) for g in _GROUP.findall(span)]
    digits = "".join(_GROUP.findall(span))
    before = text[max(0, start - 24) : start]
    word = re.search(r"\w*\W*\Z", before)[0]
    local = labels = last = letters = largest = -1
    if kind == EMAIL:
        cut = re.split(r"@|" + _AT, span, maxsplit=1, flags=re.I)
        host = re.split(_DOT, cut[-1], flags=re.I)
        local, labels, last, letters = len(cut[0]), len(host), len(host[-1]), host[-1].isalpha()
    if kind == IP:
        largest = max(int(p[:6]) for p in span.split("."))
    lengths = groups or [0]
    return [kind, len(span), len(digits), len(groups), lengths[0], lengths[-1], max(lengths), min(lengths), len(set(span) - set("0123456789") - (_LOCAL if kind == EMAIL else set())), span[0] == "+", (span.count("(") == span.count(")")) + 2 * ("(" in span), kind == CARD and luhn(digits), largest, len(set(digits)), local, labels, last, letters, _side(text[start - 1 : start]), _side(text[end : end + 1]), len(word.strip()), _CUE.search(before) is not None]


class _Base:
    """Base spans of a text by places, to be asked what they overlap."""

    def __init__(self, base: list[tuple[int, int, int]]) -> None:
        self.exact = {(k, a, b) for a, k, b in base}
        self.starts = np.array([a for a, _, _ in base], dtype=np.int64)
        self.ends = np.maximum.accumulate(np.array([b for _, _, b in base], dtype=np.int64)) if base else self.starts

    def overlaps(self, start: int, end: int) -> bool:
        i = np.searchsorted(self.starts, end)  # those that begin before end
        return bool(i and self.ends[i - 1] > start)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """The base spans and the candidates (kind, start, end, label): 1 for a base span, 0 for what a strict pattern turned down or cuts, -1 where none was asked."""
    base = base_spans(text)
    known, out = _Base(base), []
    for kind, start, end, asked in dict.fromkeys(proposals(text)):
        label = 1 if (kind, start, end) in known.exact else 0 if asked or known.overlaps(start, end) else -1
        out.append((kind, start, end, label))
    return base, out


@dataclass(frozen=True)
class Model:
    """Trees of depth 3 as arrays: a split's feature and threshold for each of 7 nodes, a value for each of 8 leaves. cut: the least score that is enough, for each kind."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float
    cut: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            z += v[node - 7]
        return 1 / (1 + np.exp(-z))


def no_model() -> Model:
    return Model(np.zeros((0, 7), np.int64), np.zeros((0, 7)), np.zeros((0, 8)), -30.0, np.full(len(KINDS), np.inf))


def histograms(at: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: list[tuple], bias: float, tree: tuple, level: int, bins: int) -> np.ndarray:
    """The sums of the first and second derivatives of the log loss for each node of a level of the tree that grows, feature and bin.

    trees and tree split by bins: (feature, bin, value). at has each row's bins.
    Derivatives are whole multiples of a small unit, so that sums of parts are
    the same in any order.
    """
    z, rows = np.full(len(at), bias), np.arange(len(at))

    def below(feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        node = np.zeros(len(at), dtype=np.int64)
        for _ in range(levels):
            node = 2 * node + 1 + (at[rows, feature[node]] > cut[node])
        return node - (2**levels - 1)

    for feature, cut, value in trees:
        z += value[below(feature, cut, 3)]
    p = 1 / (1 + np.exp(-z))
    many, width = 2**level, at.shape[1]
    cell = ((below(*tree, level)[:, None] * width + np.arange(width)) * bins + at).ravel()
    return np.stack([np.bincount(cell, np.repeat(np.rint(v * UNIT) * weight, width), many * width * bins).reshape(many, width, bins) for v in (p - y, p * (1 - p))]) / UNIT


def grown(sums: Callable[..., np.ndarray], edges: list[np.ndarray], share: float, rounds: int = 60, rate: float = 0.2, bins: int = 32, least: float = 1.0, l2: float = 1.0) -> tuple[Model, list[tuple]]:
    """Gradient boosting of the log loss with Newton steps: the trees by thresholds and by bins. sums(trees, bias, tree, level) gives histograms() of all rows; share: of label 1; least: the least sum of second derivatives in a leaf."""
    share = np.clip(share, 1e-4, 1 - 1e-4)
    bias = float(np.log(share / (1 - share)))
    trees: list[tuple] = []
    for _ in range(rounds):
        feature, cut = np.zeros(7, dtype=np.int64), np.full(7, bins)
        for level in range(3):
            first, many = 2**level - 1, 2**level
            gs, hs = sums(trees, bias, (feature, cut), level).cumsum(axis=3)
            total_g, total_h = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
            gain[(hs < least) | (total_h - hs < least)] = 0
            gain = gain.reshape(many, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(many), best] > 1e-9):
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, b
        k, last = np.arange(4), (feature[3:], np.minimum(cut[3:], bins - 1))
        left = [v[k, *last] for v in (gs, hs)]
        parts = [np.stack([v, t[:, 0, 0] - v], axis=1).ravel() for v, t in zip(left, (total_g, total_h), strict=True)]
        trees.append((feature, cut, -rate * parts[0] / (parts[1] + l2)))
    threshold = [[edges[f][b] if b < bins else np.inf for f, b in zip(feature, cut, strict=True)] for feature, cut, _ in trees]
    return Model(np.stack([t[0] for t in trees]), np.array(threshold, dtype=np.float64), np.stack([t[2] for t in trees]), bias, np.full(len(KINDS), np.inf)), trees


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, bins: int = 32) -> Model:
    """grown() of rows in memory, on at most bins values a feature."""
    if not (0 < (weight * y).sum() < weight.sum()):
        return no_model()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    at = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    return grown(lambda *state: histograms(at, y, weight, *state, bins), edges, (weight * y).sum() / weight.sum(), rounds=rounds, bins=bins)[0]


def cuts(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float, least: int) -> np.ndarray:
    """For each kind the least score, one half or more, from which on precision of the candidates are true, if at least least of them are; else none is enough."""
    out = np.full(len(KINDS), np.inf)
    s = model.score(x)
    for k in range(len(KINDS)):
        own = np.flatnonzero(x[:, 0] == k)
        own = own[np.argsort(-s[own], kind="stable")]
        right, all_ = np.cumsum(weight[own] * y[own]), np.cumsum(weight[own])
        last = np.r_[s[own][1:] != s[own][:-1], True] if len(own) else np.zeros(0, bool)  # equal scores stand or fall together
        good = np.flatnonzero(last & (s[own] >= 0.5) & (right >= precision * all_) & (np.cumsum(y[own]) >= least))
        if len(good):
            out[k] = s[own][good[-1]]
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, label, held, x): a row for each candidate that a strict pattern has decided on; held: whether its text, one in four by a hash, sets the cuts."""
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, h in zip(*[b[c].to_pylist() for c in ("text", "h")], strict=True):
                rows += [(k, label, h % 4 == 3, list(map(float, features(text, k, s, e)))) for k, s, e, label in candidates(text)[1] if label >= 0]
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float32())]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "label", "held", "x"])

    texts = docs.filter(F.col("text").rlike("[0-9@]")).select("text", F.crc32(F.col("text").cast("binary")).alias("h"))
    return texts.mapInArrow(found, "kind int, label int, held boolean, x array<float>")


def quantiles(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """For each feature of rows (x, n: how often) the distinct values at the quantiles, fewer than bins, from all rows."""
    values = rows.select("n", F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.sum("n").alias("n"))
    ranked = values.withColumns({"upto": F.sum("n").over(Window.partitionBy("f").orderBy("v")), "all": F.sum("n").over(Window.partitionBy("f"))})
    at = F.exists(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.floor(k * (F.col("all") - 1) / bins).between(F.col("upto") - F.col("n"), F.col("upto") - 1))
    found = ranked.filter(at).select("f", "v").collect()  # fewer than bins a feature
    return [np.array(sorted(r["v"] for r in found if r["f"] == f), dtype=np.float64) for f in range(len(FEATURES))]


def train(docs: DataFrame, precision: float = 0.95, least: int = 20, bins: int = 32, a_part: int = 100_000) -> Model:
    """Trees and cuts from every candidate that a strict pattern has decided on.

    Candidates whose features lie in the same bins are one row with a count.
    Three quarters of the texts fit the trees: for each level of a tree, tasks
    of about a_part rows sum their histograms, of a fixed size, and the driver
    adds those up and chooses the splits. The other texts set the cuts, by
    counts for each step of the score.
    """
    spark = docs.sparkSession
    rows = written(labelled(docs).groupBy("kind", "label", "held", "x").agg(F.count(F.lit(1)).alias("n")), "personal_candidates")
    counts = {r["label"]: r["n"] for r in rows.filter("not held").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        forget(rows)
        return no_model()
    edges = quantiles(rows.filter("not held"), bins)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b["x"].flatten(), dtype=np.float64).reshape(b.num_rows, len(FEATURES))
            at = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
            yield pa.record_batch([b["kind"], b["label"], b["held"], pa.array([r.tobytes() for r in at], pa.binary()), b["n"]], names=["kind", "label", "held", "at", "n"])

    cells = rows.mapInArrow(binned, "kind int, label int, held boolean, at binary, n long").groupBy("kind", "label", "held", "at").agg(F.sum("n").alias("n"))
    cells = written(cells, "personal_cells")
    forget(rows)
    size = cells.filter("not held").count()
    fit = written(cells.filter("not held").repartition(max(1, -(-size // a_part))), "personal_fit")

    def columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.frombuffer(b"".join(x for b in batches for x in b["at"].to_pylist()), np.uint8).reshape(-1, len(FEATURES))
        return at.astype(np.int64), *[np.concatenate([np.asarray(b[c], dtype=np.float64) for b in batches]) for c in ("label", "n")]

    def sums(*state) -> np.ndarray:
        def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := [b for b in batches if b.num_rows]:
                yield pa.record_batch([[histograms(*columns(held), *state, bins).tobytes()]], names=["sums"])

        total = np.zeros((2, 2 ** state[-1], len(FEATURES), bins))
        for r in fit.mapInArrow(of_part, "sums binary").collect():  # at most 90 kB from each task
            total += np.frombuffer(r["sums"]).reshape(total.shape)
        return total

    model, _ = grown(sums, edges, counts[1] / (counts[0] + counts[1]), bins=bins)
    middles = [np.r_[e, np.inf] for e in edges]  # a value for each bin, on the same side of all thresholds

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = columns([b])[0]
            x = np.stack([m[c] for m, c in zip(middles, at.T, strict=True)], axis=1)
            yield pa.record_batch([b["kind"], b["label"], pa.array(np.floor(model.score(x) * STEPS).astype(np.int64)), b["n"]], names=["kind", "label", "step", "n"])

    steps = cells.filter("held").mapInArrow(scored, "kind int, label int, step long, n long").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("y"))
    above = Window.partitionBy("kind").orderBy(F.desc("step"))  # STEPS rows at most
    upto = steps.withColumns({"right": F.sum("y").over(above), "all": F.sum("n").over(above)})
    good = upto.filter((F.col("step") >= STEPS // 2) & (F.col("right") >= precision * F.col("all")) & (F.col("right") >= least))
    cut = np.full(len(KINDS), np.inf)
    for r in good.groupBy("kind").agg(F.min("step").alias("step")).collect():
        cut[r["kind"]] = r["step"] / STEPS
    for df in (cells, fit):
        forget(df)
    return Model(model.feature, model.threshold, model.value, model.bias, cut)


def select(text: str, model: Model) -> list[tuple[int, int, int, float | None]]:
    """(start, rank, end, score) of the base spans (score None) and of the best candidates beside them, that no strict pattern was asked about, which do not overlap."""
    base, found = candidates(text)
    out: list[tuple[int, int, int, float | None]] = [(a, k, b, None) for a, k, b in base]
    known = _Base(base)
    found = [c for c in found if c[3] == -1 and np.isfinite(model.cut[c[0]]) and not known.overlaps(c[1], c[2])]
    if found:
        scores = model.score(np.array([features(text, k, a, b) for k, a, b, _ in found], dtype=np.float64))
        order = sorted((-s, a - b, a, k, b) for s, (k, a, b, _) in zip(scores, found, strict=True) if s >= model.cut[k])
        taken: set[int] = set()  # places of spans of bounded length
        for s, _, a, k, b in order:
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                out.append((a, k, b, float(-s)))
    return sorted(out, key=lambda t: t[:3])


def redacted(text: str, spans: list[tuple[int, int, int, float | None]]) -> str:
    """text with each span, or run of overlapping ones, as the name of its first kind in brackets."""
    out, at = [], 0
    for a, k, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: Model, redact: bool = False) -> DataFrame:
    """docs with spans: structs (start, rank, kind, end, score) in order, code points, end exclusive; with redact also redacted, the text without them.

    Base spans have no score. A null text is empty; texts are searched whole,
    in time linear in their length but for spans beside each other, which are
    bounded in length. Repeated rows and equal texts get equal spans; a null
    doc_id is no different. Of spans with one start (ties) the first kind comes
    first; of overlapping candidates the highest score, then the longest, then
    the first is taken. An empty table gives an empty result. Columns of docs
    named spans or redacted are replaced, all others stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("spans", *["redacted"] * redact)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers
    new = {"spans": SPANS} | ({"redacted": "string"} if redact else {})
    schema = docs.limit(0).selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in new.items()]).schema
    at = [c.lower() for c in docs.columns].index("text")
    kind_of = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            spans = [select(t, shared.value) for t in texts]
            more = [pa.array([[{"start": a, "rank": k, "kind": KINDS[k], "end": e, "score": s} for a, k, e, s in x] for x in spans], kind_of)]
            if redact:
                more.append(pa.array([redacted(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))
            yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, *new])

    return docs.mapInArrow(searched, schema)


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    base = F.filter("spans", lambda s: s["score"].isNull())
    out = find(docs, train(docs)).select("doc_id", "spans", base.alias("base"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))
