"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percepta.llm.text import words
from percepta.shared import lookup_join, written

#: Slots of the keys for each factor of e.
SLOTS = 256
#: Signs that mark junk rather than prose, for quality_weight.
SIGNS = "#$%&*<>{}[]|\\^~=_+@"


def quality_weight(text: Column) -> Column:
    """From 1 for prose down to 0.05 for texts full of signs; 1 for empty texts and null."""
    n = F.length(text)
    signs = n - F.length(F.translate(text, SIGNS, ""))
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), 1 / (1 + F.lit(20.0) * F.try_divide(signs, n)))), F.lit(1.0))


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), most_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes by them. No
    target exceeds most_epochs times its source's size; what is above is shared again by weight until none is above.
    In closed form: sources sorted by cap / weight fill up in that order, and the rest share what is left. The windows run
    over one row for each source.
    """
    every = Window.partitionBy()
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit([float(w) for w in weights]).cast("array<double>"), (n % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * most_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    # The first source, in the order of filling, that its level doesn't fill sets the level of all after it.
    t = t.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    t = t.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), most_epochs: int = 2, seed: str = "mix-1", weight: Column | None = None, keep: list[str] | None = None, rows_per_bin: int = 10_000, most_sources: int = 50_000) -> DataFrame:
    """How many words of every document a mix takes: doc_id, size, source_size, target, taken, and the columns in keep.

    size is the number of words (null text: 0). A source whose target holds e complete epochs takes every document e
    times; then documents in the order of their keys, -ln(u) / weight, are taken once more while the middle of the
    document lies within what is left of the target, so that the taken words miss the target by half a document at most.
    u comes from MD5 of seed, doc_id and text: reruns agree. A null doc_id counts as an empty one; repeated rows
    share a key and are dealt by their size only, so it is defined how many of them are taken, not which.

    The order within a source is cut into slots of almost equal keys, which are counted, and slots into bins of about
    rows_per_bin rows, whatever the weights; bins are summed first and their prefix sums joined back, so that a source
    with a third of all rows is sorted in as many tasks as it has bins. Only rows of one and the same key can't be parted.
    Null and empty texts have size 0 and are taken with 0 words. Extra columns are left out unless kept.
    """
    keep = keep or []
    w = quality_weight(F.col("text")) if weight is None else weight
    u = (F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))), F.lit(1), F.lit(12)), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
    size = F.size(words(F.col("text"))).cast("long")
    rows = written(docs.select("doc_id", F.col("source").alias("_src"), size.alias("_size"), (-F.log(u) / w).alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in keep if c not in ("doc_id", "source")]), "sized")
    totals = written(rows.groupBy(F.col("_src").alias("source")).agg(F.sum("_size").alias("source_size")), "sources")
    plan = targets(totals.select("source", "source_size"), share, weights, most_epochs)
    full = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    plan = plan.withColumn("epochs", full).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    named = lambda c: [F.coalesce(c, F.lit("")).alias("_s"), c.isNull().alias("_none")]
    plan = written(plan.select(*named(F.col("source")), "source_size", "target", "epochs", "rest"), "plan")
    rows = lookup_join(rows.select("*", *named(F.col("_src"))), plan, ["_s", "_none"], most_rows=most_sources, spread=[F.col("_key")])
    # Slots of keys that differ by 1/256 at most keep the order, and are counted; neighbouring slots then form the bins.
    rows = rows.withColumn("_slot", F.floor(F.log("_key") * SLOTS))
    slots = written(rows.groupBy("_s", "_none", "_slot").agg(F.sum("_size").alias("_in"), F.count("*").alias("_n")), "slots")
    ahead = Window.partitionBy("_s", "_none").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    slots = slots.select("_s", "_none", "_slot", F.floor(before("_n") / rows_per_bin).alias("_bin"), before("_in").alias("_before"))
    first = F.min("_before").over(Window.partitionBy("_s", "_none", "_bin"))
    slots = written(slots.select("_s", "_none", "_slot", "_bin", first.alias("_ahead")), "bins")
    rows = lookup_join(rows, slots, ["_s", "_none", "_slot"], spread=[F.col("_key")])
    order = Window.partitionBy("_s", "_none", "_bin").orderBy("_key", F.col("doc_id").asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    more = (F.col("rest") > 0) & (start + F.col("_size") / 2.0 <= F.col("rest"))
    taken = (F.col("epochs") + more.cast("long")) * F.col("_size")
    extra = [(F.col("_src") if c == "source" else F.col(f"_keep_{c}")).alias(c) for c in keep if c != "doc_id"]
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), *extra)
