"""Phrase collocations: only padded longest windows are counted; ROLLUP sums them to all shorter phrases."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from percepta.llm.text import ascii_lower
from percepta.shared import fits, freed, written

#: Where texts fall into pieces, and what divides the words of a piece.
CUTS, GAPS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are taken apart at once.
SLICE = 8 << 20
#: Of the bits for pairs: 16 for each pair, but no more than 2 to this power, 32 MB.
MOST_BITS = 28
#: Bits that one row holds on their way to the driver, as a power of two.
RUN_BITS = 15


class Frequent(NamedTuple):
    """Words that may be in a phrase: langs, distinct words, and for each language the sorted numbers of its frequent words and, where known, of its frequent pairs (first · len(words) + second).

    Where the pairs are too many, bits holds those of their hashes: a pair without its bit is rare."""

    langs: list[str]
    words: list[str]
    singles: list[np.ndarray]
    pairs: list[np.ndarray] | None = None
    bits: np.ndarray | None = None


def _slices(batch) -> Iterator[tuple]:
    """(lang, texts) of a batch: runs of rows of one language with about SLICE bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc

    for lang in batch.column("lang").unique():
        texts = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            yield lang.as_py(), texts.slice(at, to - at)
            at = to


def _words(texts):
    """All words of the texts in order, dictionary-encoded, and for each whether it begins a piece."""
    import pyarrow as pa

    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins = np.zeros(len(data), bool)
    begins[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = True
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:]
    first = np.flatnonzero(first)
    ends = np.append((np.cumsum(inside, dtype=np.int64) - 1)[first], inside.sum()).astype(np.int32)
    said = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])).dictionary_encode()
    cuts = np.cumsum((kind == 2) | begins, dtype=np.int32)[first]
    return said, np.diff(cuts, prepend=-1) != 0


def _word_counts(batches: Iterable) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for lang, texts in _slices(batch):
            said, _ = _words(texts)
            n = np.bincount(said.indices.to_numpy(), minlength=len(said.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), said.dictionary, pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _bit_of(lang, first: np.ndarray, second: np.ndarray, power: int) -> np.ndarray:
    """The number of a pair's bit among 2 to the power."""
    h = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(lang).astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(64 - power)).astype(np.int64)


def _bits(pairs: DataFrame) -> np.ndarray:
    """The bits of pairs(lang, w1, w2): each run of them is made in a task, the driver gets 32 MB at most."""
    power = min(MOST_BITS, max(RUN_BITS, int(16 * pairs.count()).bit_length()))

    def placed(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = np.unique(_bit_of(*(batch.column(c).to_numpy() for c in ("lang", "w1", "w2")), power))
            yield pa.RecordBatch.from_arrays([pa.array(at >> RUN_BITS), pa.array(at & ((1 << RUN_BITS) - 1))], names=["run", "at"])

    def packed(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for found in batch.column("found"):
                run = np.zeros(1 << RUN_BITS, bool)
                run[found.values.to_numpy()] = True
                rows.append(np.packbits(run, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(rows, pa.binary())], names=["run", "raw"])

    runs = pairs.mapInArrow(placed, "run long, at long").groupBy("run").agg(F.collect_set("at").alias("found"))
    out = np.zeros(1 << (power - 3), np.uint8)
    for run, raw in zip(*runs.mapInArrow(packed, "run long, raw binary").toArrow().to_pydict().values(), strict=True):
        out[run << (RUN_BITS - 3) : (run + 1) << (RUN_BITS - 3)] = np.frombuffer(raw, np.uint8)
    return out


def _windows(shared, width: int):
    """Windows of `width` frequent words that begin at each of them, as numbers, and their count c; -1 beyond the piece and from the first word or pair on that is rare.

    Windows of one or two words are counted by slice, longer ones have a row each.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        frequent: Frequent = shared.value
        known, base = pa.array(frequent.words, pa.string()), len(frequent.words) + 1
        langs = {v: i for i, v in enumerate(frequent.langs)}
        names = ["lang", *(f"w{k + 1}" for k in range(width)), "c"]

        def batch_of(lang: int, columns: list[np.ndarray], c: np.ndarray):
            columns = columns + [np.full(len(c), -1)] * (width - len(columns))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), lang, np.int32)), *(pa.array(v.astype(np.int32)) for v in columns), pa.array(c.astype(np.int64))], names=names)

        for batch in batches:
            for name, texts in _slices(batch):
                if name not in langs:
                    continue
                lang = langs[name]
                said, breaks = _words(texts)
                number = pc.fill_null(pc.index_in(said.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                number = np.where(np.isin(number, frequent.singles[lang]), number, -1)[said.indices.to_numpy()]
                if frequent.pairs is not None and len(number):
                    pairs = number[:-1] * (base - 1) + number[1:]
                    among = frequent.pairs[lang]
                    at = np.searchsorted(among, pairs)
                    rare = np.append(among, -1)[at] != pairs if len(among) else np.ones(len(pairs), bool)
                    breaks[1:] |= rare
                elif frequent.bits is not None and len(number):
                    at = _bit_of(lang, number[:-1], number[1:], len(frequent.bits).bit_length() + 2)
                    breaks[1:] |= (frequent.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
                # A pad between pieces and at the end.
                at = np.arange(len(number)) + np.cumsum(breaks)
                padded = np.full((int(at[-1]) + 1 if len(at) else 0) + width, -1, np.int64)
                padded[at] = number
                at = at[number >= 0]
                longer = (padded[at + 1] >= 0) & (padded[at + 2] >= 0) if width > 2 else np.zeros(len(at), bool)
                short = at[~longer]
                key, c = np.unique(padded[short] * base + padded[short + 1] + 1, return_counts=True)
                yield batch_of(lang, [key // base, key % base - 1], c)
                at = at[longer]
                columns = [padded[at], padded[at + 1]]
                for k in range(2, width):
                    columns.append(np.where(columns[-1] >= 0, padded[at + k], -1))
                yield batch_of(lang, columns, np.ones(len(at)))

    return run


def string_windows(docs: DataFrame, width: int) -> DataFrame:
    """lang and w1 … of the windows that begin at every word of docs(lang, text), '' beyond a piece: columns led by 0, 1, … words, in the JVM."""
    pieces = F.filter(F.transform(F.split(ascii_lower(F.col("text")), CUTS, -1), lambda p: F.array_remove(F.split(p, GAPS, -1), "")), lambda w: F.size(w) > 0)
    rows = docs.select("lang", F.explode(pieces).alias("w"))
    led = [F.concat(F.slice("w", k + 1, F.size("w")), F.array_repeat(F.lit(""), k)).alias(f"w{k + 1}") for k in range(width)]
    return rows.select("lang", F.inline(F.arrays_zip(*led)), F.lit(1).alias("c"))


def phrase_counts(windows: DataFrame, width: int, least: int, pad) -> DataFrame:
    """lang, k, w1 …, f: every phrase of up to `width` words that occurs `least` times or more, from the counts of padded longest windows.

    A phrase's occurrences are the windows that begin with it. ROLLUP sums the counts over the last word, the last two and so on. Windows
    of more than two words are counted first, so that each distinct one is summed into its prefixes once; pairs come counted by slice.
    """
    names = [f"w{k + 1}" for k in range(width)]
    counted = windows.groupBy("lang", *names).agg(F.sum("c").alias("c")) if width > 2 else windows
    summed = counted.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    # With the last j columns summed away the grouping number is 2^j - 1; a pad left among the others is no word.
    k = reduce(lambda e, j: F.when(F.col("g") == (1 << j) - 1, width - j).otherwise(e), range(width), F.lit(0))
    kept = summed.filter(F.col("f") >= least).withColumn("k", k).filter("k > 0")
    return kept.filter(F.get(F.array(*names), F.col("k") - 1) != F.lit(pad)).select("lang", "k", *names, "f")


def collocations(docs: DataFrame, least: int = 100, width: int = 5, top: int = 2000, most_words: int = 1_000_000, most_bytes: int = 48 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `width` words by how much they cohere.

    Texts are lower-cased (A-Z), fall into pieces at .,;:!? and line breaks, and those into words at blanks and tabs. f counts
    overlapping occurrences within pieces. A phrase of a = f >= least is cut after its first k words into parts of l and r occurrences; its
    score is the least floor(1000 · a · n / (l · r)) over k (ties: the smallest k), n being the language's words. Phrases that lie
    within a longer one of equal count go. Whole numbers of up to 38 digits are used, so scores are exact.

    A phrase holds no word or pair that is rarer than itself: words are counted first, and where the frequent ones fit in most_words rows and most_bytes
    they are sent to all tasks; windows of two then give the frequent pairs, and the longest windows end at rare words and at rare pairs; if the pairs
    are more than most_words, at pairs whose hash no frequent one has (32 MB of bits at most). Beyond the bound of words, windows are made of all words as they are, with equal results and a
    larger shuffle. Windows are counted in two steps, so common phrases don't meet in one task.

    A null language is und; null and empty texts have no words; texts are taken whole, whatever their length; repeated rows
    count again; equal scores and counts rank by the phrase's UTF-8 bytes; an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "words-of-languages")
    common = written(words.filter(F.col("n") >= least).select("lang", "word"), "frequent-words")
    freed(words)
    names = [f"w{k + 1}" for k in range(width)]
    if fits(common, most_words, most_bytes):
        phrases = _from_frequent(rows, common, width, least, most_words)
    else:
        phrases = phrase_counts(string_windows(rows, width), width, least, "").select("lang", "k", F.slice(F.array(*names), F.lit(1), F.col("k")).alias("words"), "f")
    phrases = written(phrases.withColumn("phrase", F.array_join("words", " ")), "phrases")
    out = ranked(phrases, totals, top)
    freed(common)
    return out


def _from_frequent(rows: DataFrame, common: DataFrame, width: int, least: int, most_pairs: int) -> DataFrame:
    """lang, k, words, f of all frequent phrases, by numbers of the frequent words, which are few enough to be sent to all tasks."""
    found = common.toArrow().to_pydict()
    langs, words = sorted(set(found["lang"])), sorted(set(found["word"]))
    lang_at, word_at = ({v: i for i, v in enumerate(x)} for x in (langs, words))
    singles: list[list[int]] = [[] for _ in langs]
    for lang, word in zip(found["lang"], found["word"], strict=True):
        singles[lang_at[lang]].append(word_at[word])
    frequent = Frequent(langs, words, [np.sort(np.array(v, np.int64)) for v in singles])
    context = rows.sparkSession.sparkContext

    def counts(shared, width: int) -> DataFrame:
        schema = ", ".join(["lang int", *(f"w{k + 1} int" for k in range(width)), "c long"])
        return written(phrase_counts(rows.mapInArrow(_windows(shared, width), schema), width, least, -1), f"phrases-{width}")

    pairs = counts(context.broadcast(frequent), 2).filter("k = 2").select("lang", "w1", "w2")
    if fits(pairs, most_pairs):
        seen = {n: c.to_numpy() for n, c in zip(pairs.columns, pairs.toArrow().columns, strict=True)}
        keys = seen["w1"].astype(np.int64) * len(words) + seen["w2"]
        frequent = frequent._replace(pairs=[np.sort(keys[seen["lang"] == i]) for i in range(len(langs))])
    else:
        frequent = frequent._replace(bits=_bits(pairs))
    shared = context.broadcast(frequent)
    return counts(shared, width).mapInArrow(_named(shared, width), "lang string, k int, words array<string>, f long")


def _named(shared, width: int):
    """The words of phrases that are given as numbers."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        frequent: Frequent = shared.value
        for batch in batches:
            sizes = batch.column("k").to_pylist()
            numbers = zip(*(batch.column(f"w{k + 1}").to_pylist() for k in range(width)), strict=True)
            said = [[frequent.words[i] for i in row[:k]] for row, k in zip(numbers, sizes, strict=True)]
            langs = [frequent.langs[i] for i in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), batch.column("k"), pa.array(said, pa.list_(pa.string())), batch.column("f")], names=["lang", "k", "words", "f"])

    return run


def ranked(phrases: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The result of collocations() from phrases(lang, k, words, phrase, f), which hold every part of each of them, and the words of each language."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    long = phrases.filter("k > 1").select("lang", "words", "k", "phrase", F.col("f").alias("a"))
    part = phrases.select("lang", "phrase", "f")
    join = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.lit(1), F.col("cut")).alias("first"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(F.broadcast(totals), "lang")
    over = (exact("l") * exact("r")).cast("decimal(38,0)")
    under = ((exact("a") * 1000).cast("decimal(23,0)") * F.col("n").cast("decimal(15,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumns({"under": under, "over": over}).withColumn("score", F.expr("under div over"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = long.filter("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    inner = inner.groupBy("lang", join(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("outer"))
    left = best.join(inner, ["lang", "phrase"], "left").filter("outer is null or outer < a")
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").cast("long").alias("score"))


SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w))
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT f.lang, f.k, f.phrase, string_split(f.phrase, ' ') AS w, f.f AS a, n.n FROM f JOIN n USING (lang) WHERE f.k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.n, l.f AS l, r.f AS r, c.cut, (1000::HUGEINT * c.a * c.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))
), kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
