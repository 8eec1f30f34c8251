"""Operator 2: benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquad.llm.common import broadcast_to, documents, fresh, lower_ascii, text_hash, written

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of the benchmark, 8 bytes each in a hash table, that may be broadcast.
SHINGLES = 500_000
#: Rows to drop, about 50 bytes each, that may be broadcast.
BROADCAST = 500_000
_ROW = ["doc_id", "th", "th2"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def shingles(words: Column, k: int) -> Column:
    """A hash of each k words in a row, by position, of an array of words; each word is hashed once."""
    # transform() of one element binds the words' hashes once
    one = lambda i, h: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)])
    of = lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: one(i, h))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), of), 1)


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Rows (item, win): every window of window words of each item, the item's whole text where it is shorter."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return items.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i") + 1, F.lit(window)).alias("win")).distinct()


def measured(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, most: int = SHINGLES) -> DataFrame:
    """One row for each of docs: doc_id, th, th2 (128 bits of its text), n_words, n_hit, items (sorted ids).

    A window occurs in a document only if all its shingles do, so each window's
    necessary prefix is its rarest shingle over all documents. Document shingles
    meet the benchmark's in one pass over the texts, which counts the words too;
    what met is written, counted for the order by rarity, and joined with the
    prefix shingles. A candidate place must leave room for the window before and
    behind (position and length bounds), and is then compared word by word with
    the document's text. The benchmark's shingles are broadcast up to most of
    them; beyond, the join shuffles.
    """
    wins = written(windows_of(benchmark, window).withColumn("win_id", F.xxhash64("win")), "windows")
    parts = wins.select("win_id", "win").distinct().withColumn("k", F.least(F.size("win"), F.lit(shingle)))
    sizes = sorted(r["k"] for r in parts.select("k").distinct().collect()) or [shingle]  # shingle values at most
    tokens = None
    for k in sizes:
        x = parts.filter(F.col("k") == k).select("win_id", "win", F.posexplode(shingles(F.col("win"), k)).alias("j", "h"))
        tokens = x if tokens is None else tokens.unionByName(x)
    tokens = written(tokens, "window_shingles")
    known = tokens.select(F.col("h").alias("known")).distinct()
    known = broadcast_to(known, known.count(), most)
    keyed = docs.select("doc_id", *text_hash(F.col("text")), words_of(F.col("text")).alias("w"))
    met = None
    for k in sizes:
        each = shingles(F.col("w"), k)
        if met is None:  # each document's last element is null and stays, so that it has a row with its number of words
            each = F.concat(each, F.array(F.lit(None).cast("bigint")))
        x = keyed.select(*_ROW, F.size("w").cast("long").alias("n_words"), F.posexplode(each).alias("pos", "h")).join(known, F.col("h") == F.col("known"), "left").filter("h is null or known is not null").drop("known")
        met = x if met is None else met.unionByName(x)
    met = written(met, "met_shingles")
    every, met = met.filter("h is null").select(*_ROW, "n_words"), met.filter("h is not null")
    often = met.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    rarest = tokens.join(often, "h", "left").groupBy("win_id").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h", "j", "win")).alias("r")).filter("r.often > 0")
    prefix = rarest.select("win_id", "r.h", "r.j", "r.win")
    places = met.join(prefix, "h").select(*_ROW, "n_words", "win_id", "win", (F.col("pos") - F.col("j")).alias("start"))
    places = places.filter((F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.col("n_words")))
    places = written(places.groupBy(*_ROW).agg(F.collect_set(F.struct("start", F.size("win").alias("len"), F.array_join("win", " ").alias("win"), "win_id")).alias("places")), "window_places")
    key = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th")) & (F.col(f"{a}.th2") == F.col(f"{b}.th2"))
    texts = docs.select("doc_id", "text", *text_hash(F.col("text"))).alias("d").join(places.alias("p"), key("d", "p")).select("d.doc_id", "d.th", "d.th2", "places", words_of(F.col("d.text")).alias("w"))
    held = F.filter("places", lambda p: F.array_join(F.slice(F.col("w"), p["start"] + 1, p["len"]), " ") == p["win"])
    hits = written(texts.select(*_ROW, F.explode(held).alias("p")).select(*_ROW, "p.start", "p.len", "p.win_id").distinct(), "window_hits")
    so_far = Window.partitionBy(*_ROW).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(so_far), F.lit(0))), F.lit(0))
    spans = hits.groupBy(*_ROW, "start").agg(F.max("len").alias("len")).withColumn("new", new).groupBy(*_ROW).agg(F.sum("new").cast("long").alias("n_hit"))
    found = hits.join(wins.select("item", "win_id"), "win_id").groupBy(*_ROW).agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = spans.alias("s").join(found.alias("f"), key("s", "f")).select("s.doc_id", "s.th", "s.th2", "n_hit", "items")
    out = every.alias("e").join(per.alias("p"), key("e", "p"), "left")
    return out.select("e.doc_id", "e.th", "e.th2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, most: int = SHINGLES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids) and contaminated; see measured().

    Null or empty texts have no words and no hits; an item without words has no
    window; an item without id counts as the id ''. Rows with equal doc_id and
    text get equal results, rows that share an id only (null too) their own.
    Windows that several items share (ties) count for each item and hit a word
    once. Texts of any length are searched whole. An empty table of documents
    gives an empty result, an empty benchmark one without hits. Columns of docs
    with the names of the new ones are replaced, all others stay as they are.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    names = fresh(docs, "id", "th", "th2")
    rows = measured(docs.select("doc_id", "text"), benchmark, window, shingle, most).dropDuplicates(_ROW)
    rows = rows.select(*[F.col(a).alias(b) for a, b in zip(_ROW, names, strict=True)], "n_words", "n_hit", "items")
    hashed = text_hash(F.col("text"))
    on = F.col("doc_id").eqNullSafe(F.col(names[0])) & (hashed[0] == F.col(names[1])) & (hashed[1] == F.col(names[2]))
    return docs.join(rows, on).drop(*names).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, most: int = BROADCAST) -> DataFrame:
    """The rows of docs without any window of the benchmark, all columns as they are; odd rows as in contaminated().

    The keys of the contaminated rows are broadcast up to most of them.
    """
    names = fresh(docs, "id", "th", "th2")
    hit = measured(docs.select("doc_id", "text"), benchmark, window, shingle).filter("n_hit > 0").select(*[F.col(a).alias(b) for a, b in zip(_ROW, names, strict=True)]).distinct()
    hit = written(hit, "contaminated")
    hashed = text_hash(F.col("text"))
    on = F.col("doc_id").eqNullSafe(F.col(names[0])) & (hashed[0] == F.col(names[1])) & (hashed[1] == F.col(names[2]))
    return docs.join(broadcast_to(hit, hit.count(), most), on, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measured(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (select distinct item, array_to_string(w[i + 1 : i + 10], ' ') as win, least(len(w), 10) as n from (select item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as i from b where len(w) > 0)),
s as (select distinct n from v),
p as (select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as win from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d, s where len(w) >= n)),
h as (select p.doc_id, p.n, p.i, v.item from p join v on p.win = v.win and p.n = v.n),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from h) group by doc_id),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""
