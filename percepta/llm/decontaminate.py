"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.llm.text import words
from percepta.shared import freed, lookup_join, packed, written

BITS = 256
#: Bits of a Hamming block; a fingerprint is an array of BITS / BLOCK of them.
BLOCK = 16


def _grams(h: str, width: int) -> Column:
    """Hashes of the runs of `width` words in an array of word hashes; none if it has fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(F.lit(width), *[F.get(F.col(h), i + j) for j in range(width)]))
    return F.when(F.size(h) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def _shingles(h: str, k: int) -> Column:
    """The k-word shingles; with fewer words, one of them all; none without words."""
    out = _grams(h, k)
    for width in range(1, k):
        out = F.when(F.size(h) == width, _grams(h, width)).otherwise(out)
    return out


def _hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_h", F.transform(words(F.lower(F.col(text))), lambda w: F.xxhash64(w)))


def _fingerprints(features: DataFrame, keys: list[str]) -> DataFrame:
    """features(keys…, h, tf, idf): the signs of BITS random projections, as an array of Hamming blocks.

    Each occurrence of a shingle is a feature of its own, of weight √idf: the cosine of two such vectors is the mass that they
    share over the geometric mean of their masses, so at a similarity of s it is 2s / (1 + s) at least, whatever the
    weights. A coefficient is the sum of two uniform halves of a hash: with signs alone, sums of few features come out
    zero too often.
    """
    each = features.select(*keys, "h", F.sqrt("idf").alias("w"), F.explode(F.sequence(F.lit(1), F.col("tf").cast("int"))).alias("nth"))
    each = each.select(*keys, "w", F.xxhash64(F.lit(41), "h", "nth").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(BITS // BLOCK - 1))).alias("block"))

    def projected(i: int) -> Column:
        x = F.xxhash64(F.lit(i), "block", "f")
        return F.sum(F.col("w") * (F.shiftright(x, 32) + x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)))

    sums = each.groupBy(*keys, "block").agg(*[projected(i).alias(f"b{i}") for i in range(BLOCK)])
    bits = reduce(lambda a, b: a + b, [F.when(F.col(f"b{i}") > 0, 1 << i).otherwise(0) for i in range(BLOCK)])
    blocks = sums.select(*keys, F.struct("block", bits.alias("bits")).alias("b"))
    return blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["bits"]).alias("fp"))


def _within(a: str, b: str, radius: int) -> Column:
    """Whether two fingerprints differ in at most radius bits, by their Hamming blocks.

    By the pigeonhole principle fingerprints within the radius differ in radius // blocks bits at most in one block at least, so
    a pair of which all blocks differ by more is settled; no pair within the radius is lost.
    """
    far = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    near = F.exists(far, lambda n: n <= radius // (BITS // BLOCK))
    return near & (F.aggregate(far, F.lit(0), lambda acc, n: acc + n) <= radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 63, most_seeds: int = 2_000_000, most_texts: int = 200_000) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: the documents that hold a passage like a benchmark item, one row for each document, item and row of docs.

    Words are runs without ASCII blanks, lower-cased. A window is as long as the item, in words. Similarity is the weighted
    Jaccard similarity of the k-word shingles of window and item, with their counts, weighted by how rare a shingle is
    among the items: ln(1 + items / items that have it). Without a common shingle it is 0. At `similarity` the window shares that share
    of the item's mass at least, so it shares one of the item's rarest shingles that make up the rest. Texts are searched for these seeds
    first. Where a text and an item share one, the masses of all shingles that they share are summed over every window of the text (a running sum
    over the words where shared shingles enter and leave it), and each window in which `similarity` of the item's mass can be reached is
    a candidate, wherever in it the shared words stand: parts may be moved, exchanged, put in or left out. Equal windows are fingerprinted once.

    A window and its item are compared by the Hamming blocks of their SimHash fingerprints of 256 bits: none within `radius` is
    lost. At a similarity of 0.8 the distance is 39 bits on average and beyond 63 for fewer than
    one pair in 30,000; exact copies have 0. Pairs within the radius are verified exactly. start is the first word of the best window (the first of equals).

    The seeds are broadcast if they are at most most_seeds and small; else every shingle's rows are dealt over shares. Null and
    empty texts and items match nothing; repeated items match each by its item_id; very long texts are searched whole.
    Texts that occur more than once are searched once for each row but their windows are compared once. Extra columns are ignored.
    """
    items = _hashed(benchmark.select("item_id", F.col("text").alias("t")), "t").filter(F.size("_h") > 0)
    items = items.select("item_id", F.size("_h").alias("n"), F.md5("t").alias("same"), _shingles("_h", k).alias("s"))
    names = written(items.select("item_id", "same"), "items")
    items = written(items.dropDuplicates(["same"]).select("same", "n", F.posexplode("s").alias("q", "h")), "item-shingles")
    total = items.select("same").distinct().count()
    rare = written(items.select("same", "h").distinct().groupBy("h").agg(F.log(1 + F.lit(float(total)) / F.count("*")).alias("idf")), "weights")
    weighed = items.join(rare, "h")
    wanted = written(weighed.groupBy("same", "n", "h").agg(F.count("*").alias("tf"), F.first("idf").alias("idf")), "wanted")
    # Items of fewer than k words are one shingle of their own width; at most k widths.
    widths = sorted({min(r.n, k) for r in items.select("n").distinct().filter(F.col("n") < k).collect()} | {k})
    rarest = Window.partitionBy("same").orderBy(F.col("idf").desc(), "h", "q")
    ahead = F.coalesce(F.sum("idf").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    mass = F.sum("idf").over(Window.partitionBy("same"))
    seeds = weighed.select("same", "n", "h", "q", (ahead <= mass * (1 - similarity) + 1e-9).alias("seeds"))
    seeds = written(seeds.filter("seeds").select("h", "same", "n", "q"), "seeds")

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter(F.col("text").isNotNull())
    t1, t2 = F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")
    said = _hashed(keyed.select("text", t1, t2), "text").select("t1", "t2", F.size("_h").alias("words"), "_h")
    said = reduce(DataFrame.unionByName, [said.select("t1", "t2", "words", F.posexplode(_grams("_h", w)).alias("at", "h")) for w in widths])
    hits = lookup_join(said, seeds, ["h"], "inner", most_rows=most_seeds, spread=[F.col("t1"), F.col("at")])
    pairs_of = written(hits.select("t1", "t2", "same").distinct(), "hit-pairs")
    hit_texts = written(pairs_of.select("t1", "t2").distinct(), "hit-texts")
    found = lookup_join(keyed.select("doc_id", "text", t1, t2), hit_texts, ["t1", "t2"], "inner", most_rows=most_texts)
    texts = written(_hashed(found.groupBy("t1", "t2").agg(F.first("text").alias("text")), "text").select("t1", "t2", "_h"), "texts")
    shared = reduce(DataFrame.unionByName, [texts.select("t1", "t2", F.size("_h").alias("words"), F.posexplode(_grams("_h", w)).alias("at", "h")) for w in widths])
    shared = lookup_join(shared, wanted.select("same", "n", "h", "idf"), ["h"], "inner", most_rows=most_seeds, spread=[F.col("t1"), F.col("at")])
    shared = shared.join(pairs_of, ["t1", "t2", "same"], "left_semi")
    last = F.greatest(F.col("words") - F.col("n"), F.lit(0))  # a text may be shorter than the item
    enters, leaves = F.greatest(F.col("at") - F.col("n") + F.least(F.col("n"), F.lit(k)), F.lit(0)), F.least("at", last) + 1
    events = shared.select("t1", "t2", "same", "n", F.explode(F.array(F.struct(enters.alias("start"), F.col("idf").alias("w")), F.struct(leaves.alias("start"), (-F.col("idf")).alias("w")))).alias("e"))
    events = events.groupBy("t1", "t2", "same", "n", "e.start").agg(F.sum("e.w").alias("w"))
    along = Window.partitionBy("t1", "t2", "same").orderBy("start")
    events = events.select("t1", "t2", "same", "n", "start", F.sum("w").over(along).alias("mass"), F.lead("start").over(along).alias("next"))
    goal = wanted.groupBy("same").agg((F.sum(F.col("tf") * F.col("idf")) * similarity - 1e-6).alias("goal"))
    hits = events.join(goal, "same").filter("next is not null and mass >= goal")
    hits = written(hits.select("t1", "t2", "same", "n", F.explode(F.sequence(F.col("start"), F.col("next") - 1)).alias("start")), "hits")
    windows = hits.join(texts, ["t1", "t2"]).withColumn("_h", F.slice("_h", F.col("start") + 1, F.col("n")))
    wid = F.md5(F.array_join(F.transform("_h", lambda x: x.cast("string")), ","))
    windows = written(windows.select("t1", "t2", "same", "n", "start", wid.alias("wid"), "_h"), "windows")
    contents = windows.groupBy("wid", "n").agg(F.first("_h").alias("_h")).select("wid", "n", F.explode(_shingles("_h", k)).alias("h"))
    contents = contents.groupBy("wid", "n", "h").agg(F.count("*").alias("tf"))
    contents = lookup_join(contents, rare, ["h"], most_rows=most_seeds, spread=[F.col("wid")])
    contents = written(contents.select("wid", "n", "h", "tf", F.coalesce("idf", F.lit(math.log(1 + total))).alias("idf")), "window-shingles")

    pairs = windows.select("wid", "n", "same").distinct()
    pairs = pairs.join(_fingerprints(contents, ["wid", "n"]), ["wid", "n"]).join(_fingerprints(wanted, ["same"]).withColumnRenamed("fp", "ifp"), "same")
    near = written(pairs.filter(_within("fp", "ifp", radius)).select("wid", "n", "same"), "near")
    both = near.join(contents, ["wid", "n"]).join(wanted.select("same", "h", F.col("tf").alias("itf")), ["same", "h"])
    common = both.groupBy("wid", "n", "same").agg(F.sum(F.least("tf", "itf") * F.col("idf")).alias("both"))
    weight = F.sum(F.col("tf") * F.col("idf"))
    sims = common.join(contents.groupBy("wid", "n").agg(weight.alias("a")), ["wid", "n"]).join(wanted.groupBy("same").agg(weight.alias("b")), "same")
    sims = sims.withColumn("similarity", F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).filter(F.col("similarity") >= similarity - 1e-9)
    best = windows.select("t1", "t2", "same", "n", "start", "wid").join(sims.select("wid", "n", "same", "similarity"), ["wid", "n", "same"])
    best = best.groupBy("t1", "t2", "same", "n").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("b"))
    each = F.struct("item_id", (-F.col("b.s")).alias("similarity"), F.col("b.start").alias("start"), F.col("n").alias("n_words"))
    best = written(best.join(names, "same").groupBy("t1", "t2").agg(F.collect_list(each).alias("m")), "contaminated")
    freed(names, items, rare, wanted, seeds, pairs_of, hits, hit_texts, texts, windows, contents, near)
    out = lookup_join(keyed.select("doc_id", t1, t2), best, ["t1", "t2"], "inner", most_rows=most_texts)
    return out.select("doc_id", "t1", "t2", F.explode("m").alias("m")).select("doc_id", "m.*", "t1", "t2")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text holds no passage like a benchmark item, with all their columns, whatever the names."""
    bad = written(contaminated(docs, benchmark, **options).select("t1", "t2").distinct().withColumn("bad", F.lit(True)), "bad-texts")
    marked = packed(docs).withColumns({"t1": F.xxhash64("row.text"), "t2": F.xxhash64(F.lit(7), "row.text")})
    return lookup_join(marked, bad, ["t1", "t2"], spread=[F.col("row.doc_id")]).filter(F.col("bad").isNull()).select("row.*")
