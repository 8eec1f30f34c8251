"""Operator 12: odd rows against a plain version, and rates."""

import hashlib
import random
import re

from skyquad.llm import fill_middle


def plain(doc_id, text, rate=100, spm=50, seed=7):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_odd_rows_against_a_plain_version(spark):
    r = random.Random(3)
    texts = [None, "", "\n", "\n\n", "a", "a\nb<S>c", "<", "<S\nP>\n<M", "\x00 \r\n\u2028é\n𝔘", "long line " * 50_000 + "\nend", "x\n" * 30_000]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "no id\nat all\n"), (4, "a"), (4, "a")]
    rows += [(100 + i, "".join(r.choice("ab<>PSM\n\n é") for _ in range(r.randrange(60)))) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "u", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, units string, i long")
    for rate, spm, seed in ((100, 50, 7), (40, 20, 1)):
        out = fill_middle.fill_in_middle(docs, rate, spm, seed)
        got = out.withColumn("again", fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form"))).orderBy("i").collect()
        assert [(x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) for x in got] == [plain(d, t, rate, spm, seed) for d, t in rows]
        assert [x["again"] for x in got] == [t or "" for _, t in rows] and all(x["units"] == "u" for x in got)


def test_columns_that_clash_are_replaced_and_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([("k", "a\nb", 5, "x")], "doc_id string, text string, n int, OUTPUT string")
    (row,) = fill_middle.fill_in_middle(docs).collect()
    assert row["n"] == 2 and row["output"] == plain("k", "a\nb")[4] and set(row.asDict()) == {"doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"}
    assert fill_middle.fill_in_middle(docs.filter("false")).collect() == []
