"""Quality rules whose cutoffs are risk-controlled: exact binomial tests on labelled holdouts limit the false rejections of every stratum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.llm.text import BLANKS, words
from percepta.shared import freed, lookup_join, packed, written

#: rule: measure, measure it is divided by, whether values above or below are rejected, cutoffs in thousandths from lenient to strict.
RULES: dict[str, tuple[str, str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", "above", (2000, 1000, 500, 300, 200, 100)),
    "repeats": ("n_repeat_words", "n_words", "above", (450, 400, 300, 200, 100)),
    "lines": ("n_dup_lines", "n_lines", "above", (800, 600, 400, 300, 200)),
    "capitals": ("n_capitals", "word_chars", "above", (900, 700, 500, 400, 300, 200)),
    "marks": ("n_marks", "n_words", "above", (1000, 700, 500, 300, 200, 100)),
    "long_words": ("word_chars", "n_words", "above", (15_000, 12_000, 10_000, 8_000)),
    "short_words": ("word_chars", "n_words", "below", (1500, 2000, 2500, 3000)),
}
#: rule, numerator, denominator, above or below, cutoff: in the order in which cells are numbered from 0.
CELLS = [(rule, a, b, side, cut) for rule, (a, b, side, cuts) in RULES.items() for cut in cuts]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]


def _bound(value: Column, use) -> Column:
    """use(value), evaluating value once although use names it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(said: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are compared by hashes of 64 bits."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def at(s: Column) -> Column:
            same = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
            starts = F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            more = lambda acc, x: F.struct((x + 3).alias("end"), (acc["n"] + x + 3 - F.greatest(acc["end"], x)).alias("n"))
            return F.aggregate(starts, zero, more, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bound(pairs, at))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return _bound(said, lambda w: F.when(F.size(w) < 3, 0).otherwise(_bound(windows(w), covered)))


def measured(text: Column) -> Column:
    """A struct of MEASURES (long) of a whole text; all 0 for null and blank texts.

    word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_lines: lines with a word; n_dup_lines: those equal to an earlier
    one; n_repeat_words: words in 3-word windows found twice or more; n_capitals: upper-case letters; n_marks: ! and ?.
    """
    said = F.coalesce(text, F.lit(""))
    without = lambda what: F.length(said) - F.length(F.translate(said, what, ""))
    lines = F.filter(F.split(said, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = _bound(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    of = {
        "n_words": F.size(words(said)),
        "word_chars": F.length(F.regexp_replace(said, BLANKS, "")),
        "n_symbols": without("#*$%&|<>"),
        "n_dup_lines": n_lines["all"] - n_lines["distinct"],
        "n_repeat_words": _repeat_words(words(said)),
        "n_lines": n_lines["all"],
        "n_capitals": F.length(said) - F.length(F.regexp_replace(said, r"\p{Lu}", "")),
        "n_marks": without("!?"),
    }
    return F.struct(*[of[m].cast("long").alias(m) for m in MEASURES])


def _hits(m: Column) -> Column:
    """For every cell of CELLS whether a text's measures are beyond its cutoff: whole numbers are compared, so there is no rounding."""
    beyond = lambda a, b, side, cut: 1000 * m[a] > cut * m[b] if side == "above" else 1000 * m[a] < cut * m[b]
    return F.array(*[beyond(a, b, side, cut) for _, a, b, side, cut in CELLS])


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln of the chance of k or fewer successes in n trials; from k > p · n on it is given as 0, as no test passes there."""
    first = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))
    odds = math.log(p) - math.log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i) / (i + 1)) + odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["sum"], term) - top))).alias("sum"))

    below = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > p * n, F.lit(0.0)).otherwise(F.aggregate(below, first, add, lambda acc: acc["sum"]))


def tuning(doc_id: Column) -> Column:
    """Whether a labelled document orders the cutoffs; the others test them."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 4), 16, 10).cast("int") % 2 == 0


def fit_cutoffs(rows: DataFrame, labels: DataFrame, label: str = "quality", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """stratum, cells (accepted numbers of CELLS), n_good, n_false and log_p: cutoffs that reject at most `risk` of a stratum's good documents.

    rows(doc_id, stratum, m: measures). Good is a label of 1, bad one of 0; the largest label of an id counts, null labels and ids don't.
    Documents that fail the base rules are left out, as they go whatever the cutoffs are. The tuning half of the labelled documents puts
    the cells of its stratum in order: fewest good documents rejected first, then most bad ones; cells that reject no bad document or
    more than `risk` of the good ones are left out. The other half tests the union of the first cells of that order, one cell more at a time:
    a step passes if as few good documents rejected as were seen (n_false of n_good) have a binomial chance of at most error / strata
    where the true share is `risk` (so the exact upper bound is at most `risk`), and the first that fails ends the sequence.
    Steps in a fixed order need no other correction, the strata share `error` evenly (Bonferroni): with a chance of 1 - error at least,
    no stratum at all loses more than `risk` of its good documents. Of the steps that passed, the one is taken whose gain on the
    tuning half is largest (share of bad documents rejected less that of good ones; the shortest of equals). A stratum with too few labels to
    pass has no row, and nothing is rejected there. All labelled rows count, by sums for each cell.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) == 1).alias("good"))
    seen = rows.filter(~base_failed(F.col("m"))).join(y, "doc_id")
    seen = written(seen.select("stratum", tuning(F.col("doc_id")).alias("tune"), "good", _hits(F.col("m")).alias("hits")), "labelled-hits")
    each = seen.filter("tune").select("stratum", "good", F.posexplode("hits").alias("cell", "hit"))
    counts = each.groupBy("stratum", "cell").agg(F.count_if("good").alias("goods"), F.count_if(~F.col("good")).alias("bads"), F.count_if(F.col("hit") & F.col("good")).alias("g"), F.count_if(F.col("hit") & ~F.col("good")).alias("b"))
    order = Window.partitionBy("stratum").orderBy("g", F.col("b").desc(), "cell")
    path = counts.filter((F.col("b") > 0) & (F.col("g") <= risk * F.col("goods"))).withColumn("step", F.row_number().over(order))
    path = written(path.select("stratum", "step", "cell", "goods", "bads"), "path")
    paths = written(path.groupBy("stratum").agg(F.collect_list(F.struct("step", "cell")).alias("path")), "paths")
    met = lookup_join(seen, paths, ["stratum"], "inner")
    first = F.array_min(F.transform(F.filter("path", lambda p: F.get("hits", p["cell"])), lambda p: p["step"]))
    met = met.groupBy("stratum", first.alias("step")).agg(*[F.count_if(t & g).alias(n) for n, t, g in (("test_good", ~F.col("tune"), F.col("good")), ("tune_good", F.col("tune"), F.col("good")), ("tune_bad", F.col("tune"), ~F.col("good")))])
    met = written(met, "met")
    total = met.groupBy("stratum").agg(F.sum("test_good").alias("n_good"))
    steps = path.join(met, ["stratum", "step"], "left").join(total, "stratum").join(F.broadcast(total.agg(F.count("*").alias("strata"))))
    upto = Window.partitionBy("stratum").orderBy("step")
    so_far = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("long")
    steps = steps.withColumns({"n_false": so_far("test_good"), "gain": so_far("tune_bad") / F.greatest(F.col("bads"), F.lit(1)) - so_far("tune_good") / F.greatest(F.col("goods"), F.lit(1))})
    steps = steps.withColumn("log_p", log_binomial_tail(F.col("n_false"), F.col("n_good"), risk)).withColumn("passed", F.min(F.col("log_p") <= F.log(F.lit(error) / F.col("strata"))).over(upto))
    best = steps.filter("passed").groupBy("stratum").agg(F.max(F.struct("gain", -F.col("step"), "n_good", "n_false", "log_p")).alias("best"), F.collect_list(F.struct("step", "cell")).alias("cells"))
    taken = best.select("stratum", F.transform(F.filter("cells", lambda c: c["step"] <= -F.col("best")["col2"]), lambda c: c["cell"]).alias("cells"), "best.n_good", "best.n_false", "best.log_p")
    out = written(taken, "cutoffs")
    freed(seen, path, paths, met)
    return out


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows(stratum, m, …) with base_failed, rule (the first rule of RULES beyond its cutoff, else null) and kept."""
    out = lookup_join(rows, cutoffs.select("stratum", "cells"), ["stratum"])
    hit = F.array_min(F.filter(F.coalesce("cells", F.array().cast("array<int>")), lambda c: F.get(_hits(F.col("m")), c)))
    rule = F.get(F.array(*[F.lit(c[0]) for c in CELLS]), hit)
    out = out.withColumns({"base_failed": base_failed(F.col("m")), "rule": rule})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("cells")


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """doc_id, MEASURES, base_failed, rule and kept for every row of docs, over whole texts.

    A text fails the base rules with fewer than 50 words, or if more than half of its words are in repeated windows; null, empty and blank
    texts thus fail. Of the others those go that are beyond a cutoff of their stratum, as fit_cutoffs() says (a null stratum is
    the stratum und). Texts are read once, without a shuffle, whatever their length; equal texts of a stratum and repeated rows
    are judged alike; null ids are rows like any other; an empty table gives an empty result, without labels only the
    base rules hold. Other columns of docs are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("und")).alias("stratum"), measured(F.col("text")).alias("m"))
    rows = written(rows, "measures")
    out = judged(rows, fit_cutoffs(rows, labels, **options))
    return out.select("doc_id", *[F.col(f"m.{m}").alias(m) for m in MEASURES], "base_failed", "rule", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The rows of docs that judge_documents() keeps, with all their columns, whatever the names."""
    rows = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"row.`{stratum}`").cast("string"), F.lit("und")).alias("stratum"), measured(F.col("row.text")).alias("m"))
    return judged(rows, fit_cutoffs(rows.drop("row"), labels, **options)).filter("kept").select("row.*")


def describe(cutoffs: DataFrame) -> DataFrame:
    """stratum, rule, side and the strictest accepted cutoff in thousandths, for people to read."""
    named = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("side"), F.lit(c).alias("cutoff")) for r, _, _, s, c in CELLS])
    each = cutoffs.select("stratum", F.explode(F.transform("cells", lambda c: F.get(named, c))).alias("c")).select("stratum", "c.*")
    return each.groupBy("stratum", "rule", "side").agg(F.when(F.first("side") == "above", F.min("cutoff")).otherwise(F.max("cutoff")).alias("cutoff"))


def _cell_sql() -> str:
    """The condition of every cell as a DuckDB list of booleans."""
    return "[" + ", ".join(f"1000 * {a} {'>' if side == 'above' else '<'} {cut} * {b}" for _, a, b, side, cut in CELLS) + "]"


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, w1, w2, w3) AS n
  FROM (SELECT id, i, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), repeated AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY id
), m AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_capitals,
         length(t) - length(translate(t, '!?', '')) AS n_marks
  FROM d LEFT JOIN repeated r USING (id)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_cell_sql()} AS hits FROM m
), y AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
seen AS (
  SELECT j.stratum, y.good, j.hits, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 2 = 0 AS tune
  FROM j JOIN y USING (doc_id) WHERE NOT base_failed
), counts AS (
  SELECT stratum, cell, count(*) FILTER (good) AS goods, count(*) FILTER (NOT good) AS bads, count(*) FILTER (hit AND good) AS g, count(*) FILTER (hit AND NOT good) AS b
  FROM (SELECT stratum, good, unnest(hits) AS hit, unnest(range({len(CELLS)})) AS cell FROM seen WHERE tune) GROUP BY stratum, cell
), path AS (
  SELECT stratum, cell, goods, bads, row_number() OVER (PARTITION BY stratum ORDER BY g, b DESC, cell) AS step
  FROM counts WHERE b > 0 AND g <= 0.02::DOUBLE * goods
), first AS (
  SELECT s.stratum, s.tune, s.good, (SELECT min(p.step) FROM path p WHERE p.stratum = s.stratum AND s.hits[p.cell + 1]) AS step FROM seen s
), tested AS (
  SELECT p.stratum, p.step, p.cell, count(*) FILTER (f.good AND NOT f.tune) AS n_good, count(*) FILTER (f.good AND NOT f.tune AND f.step <= p.step) AS n_false,
         count(*) FILTER (NOT f.good AND f.tune AND f.step <= p.step)::DOUBLE / greatest(any_value(p.bads), 1) - count(*) FILTER (f.good AND f.tune AND f.step <= p.step)::DOUBLE / greatest(any_value(p.goods), 1) AS gain
  FROM path p JOIN first f USING (stratum) GROUP BY p.stratum, p.step, p.cell
), levels AS (
  SELECT *, CASE WHEN n_false > 0.02::DOUBLE * n_good THEN 1.0::DOUBLE ELSE
           list_sum(list_transform(range(0, n_false + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.02::DOUBLE) + (n_good - i) * ln(0.98::DOUBLE)))) END AS p
  FROM tested
), passed AS (
  SELECT *, bool_and(p <= 0.05::DOUBLE / (SELECT count(DISTINCT stratum) FROM levels)) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM levels
), best AS (SELECT stratum, step FROM passed WHERE ok QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, step) = 1),
taken AS (SELECT p.stratum, list(p.cell) AS cells FROM path p JOIN best b ON p.stratum = b.stratum AND p.step <= b.step GROUP BY p.stratum)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(len(list_filter(cells, lambda c: hits[c + 1])), 0) = 0 AS kept
FROM j LEFT JOIN taken USING (stratum)
"""
