"""Operator 3: n-gram Jaccard self-join by T-occurrence search (DivideSkip).

Lists of tokens are divided into long and short ones by their lengths, the short
ones merged by a shuffle, pairs that the merge counts too rarely pruned, and the
rest of the tokens looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquad.llm.common import WORD, broadcast_to, documents, forget, lower_ascii, row_of, small_batches, text_hash, written

#: What stands for a null id inside.
_NULL = -(1 << 63)
#: Sizes of sets fall into classes whose bounds are this far apart.
_CLASS = 1.025
#: How fast the share of lists that are merged grows with the length of the longest, see long_lists().
MU = 0.02
#: A list of more entries is put aside where it can be: looking a pair up ships two sets of some hundred tokens, about as many bytes as so many entries.
LONG = 128
#: Rows (doc, two hashes) to drop that may be broadcast, about 50 bytes each.
BROADCAST = 500_000


def shingle_set(text: Column, k: int) -> Column:
    """The sorted distinct hashes of a text's k-word shingles; with fewer words, of the whole sequence; without words, none."""
    w = F.transform(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))
    one = lambda i, w: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    # transform() of one element binds the words once, so that they are not found again for each shingle
    of = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: one(i, w))).when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), w))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.array_distinct(F.element_at(F.transform(F.array(w), of), 1)))


def needed(n: Column, m: Column, num: int, den: int) -> Column:
    """T: the least overlap with which sets of n and m members link: den * overlap >= num * union."""
    return F.ceil(((n + m) * num) / F.lit(float(num + den))).cast("long")


def spare(n: Column, num: int, den: int) -> Column:
    """How many of its n members a set may have outside of any one that it links with: den * overlap >= num * n."""
    return F.floor(n * (den - num) / F.lit(float(den)))


def size_class(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1.0)).cast("double")) / float(np.log(_CLASS))).cast("int")


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Rows (node, comp) for the nodes of edges (a, b): comp is the least node that can be reached.

    Large-star and small-star steps in turn: each joins every edge's ends to the
    least neighbour, which is a grouped minimum, so no group is ever gathered.
    The number of rounds grows with the logarithm of a chain's length; should
    most_rounds not be enough, it is an error, never less of a result.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    told = lambda r: r.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = told(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))  # each node's smaller neighbours
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b")
        after = written(small.union(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), name)
        now = told(after)
        forget(edges)
        edges = after
        # two runs with the same rows have come to rest: each node then hangs on its least one
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not come to rest")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def probed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of which at least need of a's tokens, from place skip on in the order of its lists, are in b.

    Each of these tokens is looked up in b's sorted tokens by binary search.
    """
    small_batches(pairs.sparkSession)
    x = pairs.join(nodes.select(F.col("node").alias("a"), F.col("tokens").alias("long")), "a").withColumn("long", F.expr("slice(long, cast(skip as int) + 1, greatest(size(long) - cast(skip as int), 0))"))
    x = x.join(nodes.select(F.col("node").alias("b"), F.sort_array("tokens").alias("whole")), "b").select("a", "b", "need", "long", "whole")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for need, long, whole in zip(batch["need"].to_pylist(), batch["long"], batch["whole"], strict=True):
                long, whole = long.values.to_numpy(zero_copy_only=False), whole.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(whole, long)
                keep.append(bool(len(whole)) and int((whole[np.minimum(at, len(whole) - 1)] == long).sum()) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return x.mapInArrow(search, "a long, b long")


def can_link(n: str, own: str, m: str, other: str, num: int, den: int) -> Column:
    """Whether two sets can link at all: neither shares the tokens that no other node has."""
    return F.least(F.col(n) - F.col(own), F.col(m) - F.col(other)) >= needed(F.col(n), F.col(m), num, den)


def long_lists(t: Column, longest: Column, beyond: Column) -> Column:
    """L: how many of a set's longest lists are put aside in a search for T shared tokens.

    By the length of the longest one T / (MU * log2(longest) + 1), but at least
    those beyond LONG entries, and T - 1 at most, so that a pair that links has
    at least T - L >= 1 tokens in the short lists. The longer the lists, the more
    of them are merged, and the fewer pairs are left to look up; what is merged
    over the bound of T - 1 are lists of LONG entries, so that it grows with the
    input.
    """
    return F.greatest(F.least(t - 1, F.greatest(beyond, F.floor(t / (MU * F.log2(F.greatest(longest, F.lit(1)).cast("double")) + 1) + 1e-9))), F.lit(0))


def inverted(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (node, n, own, depth, longest, beyond, tokens) of sets (node, n, set) that can link with another.

    tokens: those that another set has too, shortest inverted list first; own:
    how many there are beside them; depth and longest: the mean length and the greatest of all the set's lists; beyond: how many have more than LONG entries. Sets
    with more tokens of their own than a link leaves room for drop out.
    """
    rows = sets.select("node", "n", F.explode("set").alias("token"))
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = rows.join(lists, "token").groupBy("node").agg(F.max("n").alias("n"), F.sum("df").alias("depth"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    return held.select("node", "n", (F.col("n") - F.size("t")).alias("own"), (F.col("depth") / F.col("n")).alias("depth"), F.array_max("t.df").alias("longest"), F.size(F.filter("t.df", lambda x: x > LONG)).cast("long").alias("beyond"), F.col("t.token").alias("tokens")).filter(F.col("own") <= spare(F.col("n"), num, den))


def centre_pairs(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, skip, need): each node with the deepest node of each of its short lists.

    As many as the short lists have rows. In a large group of near copies the
    deepest node is the one that the others were made from, or close to it.
    """
    short = F.slice("tokens", F.lit(1), F.greatest((spare(F.col("n"), num, den) + 1 - F.col("own")).cast("int"), F.lit(0)))
    rows = nodes.select("node", "n", "own", "depth", F.explode(short).alias("token"))
    centres = rows.groupBy("token").agg(F.max(F.struct("depth", -F.col("node"), "node", F.col("n").alias("m"), F.col("own").alias("other"))).alias("c")).select("token", F.col("c.node").alias("centre"), "c.m", "c.other")
    met = rows.join(centres, "token").filter(F.col("node") != F.col("centre")).filter(can_link("n", "own", "m", "other", num, den))
    return met.select(F.col("node").alias("a"), F.col("centre").alias("b"), F.lit(0).cast("long").alias("skip"), needed(F.col("n"), F.col("m"), num, den).alias("need")).distinct()


def occurrences(nodes: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, hits, skip, need) of nodes of different components that may link, by merging short lists.

    A link needs T shared tokens, by the sizes of both sets. Of the lists of a
    node's tokens the L longest are put aside, see long_lists(); the others, its
    short ones, are merged: rows (a, b) are counted over them, and pairs counted
    fewer than T - L times cannot link and go before anything is looked up. What
    is left has the number of tokens still needed in the long lists and their
    place. T and L grow with the partner's size, so a token's list is entered
    only in the classes of sizes for which it is short.

    Of two nodes the one of the smaller component asks. A list with one
    component only is not entered: pairs within a component are not searched
    for, so it counts for none of the others. In a large group of near copies, whose common
    lists are long, the nodes that link with its centre are one component, do
    not ask, and are met only in the short lists of the nodes outside.
    """
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    named = nodes.join(labels.join(sizes, "comp"), "node", "left").select("node", "n", "own", "longest", "beyond", F.coalesce("comp", "node").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"), F.posexplode("tokens").alias("at", "token"))
    named = written(named, "list_rows")
    mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("members").alias("most")).filter("lo < hi")
    n, place = F.col("n"), F.col("own") + F.col("at") + 1
    # sizes of partners, and the T of the smallest, for which most lists are short
    least = F.ceil(n * num / F.lit(float(den)) - 1e-6)
    largest = F.floor(n * den / F.lit(float(num)) + 1e-6)
    asks = named.withColumn("place", place).filter(F.col("place") <= n - long_lists(needed(n, least, num, den), F.col("longest"), F.col("beyond")))
    asks = asks.join(mixed, "token").filter("members < most or comp < hi")
    # the list is short while L <= n - place, which holds while T - 1 <= n - place, or beyond is and T < (n - place + 1) * (MU * log2(longest) + 1)
    far = F.ceil((n - F.col("place") + 1) * (MU * F.log2(F.greatest("longest", F.lit(1)).cast("double")) + 1))
    top = F.greatest(n - F.col("place") + 1, F.when(F.col("beyond") <= n - F.col("place"), far).otherwise(F.lit(0)))
    asks = asks.withColumn("reach", F.least(F.floor(top * F.lit((num + den) / num) + 1e-6) - n, largest)).filter(F.col("reach") >= least)
    asks = asks.select("token", F.col("node").alias("a"), "n", "own", "longest", "beyond", "comp", "members", "place", F.explode(F.sequence(size_class(least), size_class(F.col("reach")))).alias("class"))
    held = named.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("own").alias("other"), F.col("comp").alias("cb"), F.col("members").alias("mb"), size_class(F.col("n")).alias("class"))
    t = needed(F.col("n"), F.col("m"), num, den)
    aside = long_lists(t, F.col("longest"), F.col("beyond"))
    outer = (F.col("members") < F.col("mb")) | ((F.col("members") == F.col("mb")) & (F.col("comp") < F.col("cb")))
    met = asks.join(held, ["token", "class"]).filter(outer & (F.col("place") <= n - aside) & can_link("n", "own", "m", "other", num, den))
    found = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), *[F.max(c).alias(c) for c in ("n", "m", "own", "longest", "beyond")]).filter(F.col("hits") >= t - aside)
    return found.select("a", "b", "hits", F.greatest(n - aside - F.col("own"), F.lit(0)).alias("skip"), (t - F.col("hits")).alias("need"))


def link_rows(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (node, comp) of all nodes that link with another.

    First each node is held against the centres of its short lists, which makes
    one component of a large group of near copies from pairs in proportion to
    its size. Then all links between different components are searched for, and
    join these, so that no link is left out.
    """
    first = written(probed(written(centre_pairs(nodes, num, den), "centre_pairs"), nodes), "centre_links")
    joined = written(components(first, "centre_components"), "centre_labels")
    second = written(probed(written(occurrences(nodes, joined, num, den), "occurrences"), nodes), "cross_links")
    if second.isEmpty():
        return joined
    over = second.join(joined.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    merged = components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "cross_components")
    merged = written(merged.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "cross_labels")
    named = joined.join(merged, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return named.unionByName(merged.join(joined, merged["comp"] == joined["node"], "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp")))


def membership(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row for each of docs: doc, th, th2 (its id and 128 bits of its text), n (size of its set), first (struct doc, th, th2: the least row that links reach, itself if none).

    Equal sets are one node, named by 128 bits of the set, so copies cost one
    set. A node surely links with no other if it has more tokens of its own, in
    no other node, than a link leaves room for: that is decided for most texts
    by a band of the tokens (those with the least hashes), and for the rest by
    all tokens. What is left is searched, see link_rows().
    """
    row = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), *text_hash(F.col("text"))]
    band = min(1.0, 5 / 3 * (1 - num / den))
    low = F.lit(int(-(1 << 63) + band * ((1 << 64) - 1)) if band < 1 else (1 << 63) - 1).cast("long")
    parsed = docs.select(*row, shingle_set(F.col("text"), k).alias("set"))
    name = [F.xxhash64("set").alias("h"), F.xxhash64(F.lit("second"), "set").alias("h2")]
    members = written(parsed.select("doc", "th", "th2", F.size("set").cast("long").alias("n"), *name, F.filter("set", lambda t: t <= low).alias("band")), "set_members")
    # the tokens of the band that one name has only; a name of 64 bits that two sets share counts as without own tokens
    alone = members.select("h", F.explode("band").alias("token")).groupBy("token").agg(F.min("h").alias("h"), F.max("h").alias("other")).filter("h = other")
    own = alone.groupBy("h").agg(F.count(F.lit(1)).alias("own"))
    every = members.filter("n > 0").groupBy("h", "h2").agg(F.min(F.struct("doc", "th", "th2")).alias("first"), F.max("n").alias("n"))
    every = written(every, "set_names")
    shared = every.groupBy("h").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("lo < hi").select("h")
    left = every.join(own.join(shared, "h", "left_anti"), "h", "left").filter(F.coalesce("own", F.lit(0)) <= spare(F.col("n"), num, den))
    left = written(left.select("h", "h2", "n", "first", F.monotonically_increasing_id().alias("node")), "band_nodes")
    some = broadcast_to(left.select("first.*", "node"), left.count(), BROADCAST)
    sets = docs.select(*row, "text").join(some, ["doc", "th", "th2"]).select("node", shingle_set(F.col("text"), k).alias("set"))
    sets = sets.withColumn("n", F.size("set").cast("long")).dropDuplicates(["node"])
    nodes = written(inverted(sets, num, den), "inverted_lists")
    labels = written(link_rows(nodes, num, den), "node_labels")
    named = left.join(labels, "node").select("h", "h2", "first", "comp")
    least = named.groupBy("comp").agg(F.min("first").alias("reached"))
    reached = every.join(named.join(least, "comp").select("h", "h2", "reached"), ["h", "h2"], "left").select("h", "h2", F.coalesce("reached", "first").alias("reached"))
    alike = members.select("doc", "th", "th2", "n", "h", "h2").join(reached, ["h", "h2"], "left")
    return alike.select("doc", "th", "th2", "n", F.when(F.col("n") > 0, F.col("reached")).otherwise(F.struct("doc", "th", "th2")).alias("first"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs' rows (doc_id, n_shingles, component_id): documents link when den * shared >= num * all of their shingles.

    component_id is the least doc_id of all documents that links reach. A text
    without words, or null, has no shingles and is its own component. A null
    doc_id is less than all others: its group's component_id is null. Rows with
    equal doc_id are separate rows with their own sets; repeated rows have equal
    results. Equal sets (ties) share a component. Long texts are taken whole: a
    text's set is one array of 8 bytes a word in its own row. An empty table
    gives an empty result. Columns other than doc_id and text are ignored.
    """
    back = lambda c: F.when(c != _NULL, c)
    rows = membership(docs.select("doc_id", "text"), k, num, den)
    return rows.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("first.doc")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, most: int = BROADCAST) -> DataFrame:
    """docs without those that links, as in jaccard_components(), join to a lesser row: by doc_id (null first), then by a hash of the text.

    Of rows that are equal in doc_id and text one stays; rows that share an id
    but not a text are separate. Rows without words all stay. All columns stay
    as they are, whatever their names. An empty table gives an empty result.
    What drops out is broadcast up to most rows; beyond, texts are shuffled.
    """
    rows = written(membership(docs.select("doc_id", "text"), k, num, den), "membership").filter("n > 0")
    here = F.struct("doc", "th", "th2")
    per = rows.groupBy("doc", "th", "th2").agg(F.count(F.lit(1)).alias("times"), F.max((here != F.col("first")).cast("int")).alias("gone")).filter("gone = 1 or times > 1")
    per = written(per, "to_drop")
    keyed = docs.select(row_of(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), *text_hash(F.col("text")))
    marked = keyed.join(broadcast_to(per, per.count(), most), ["doc", "th", "th2"], "left")
    again = marked.filter("gone = 0").dropDuplicates(["doc", "th", "th2"])
    return marked.filter("gone is null").unionByName(again).select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=4, num=85, den=100)
