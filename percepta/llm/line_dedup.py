"""Line dedup by how frequent a line is within its site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.llm.url_rules import host_and_path
from percepta.shared import lookup_join, packed, written

#: Pages that hold a line at least for it to be boilerplate: a line of a single page repeats nothing, whatever the site's size.
REPEATED = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def site_of(value: Column) -> Column:
    """The host of a URL; any other value stands for its site itself."""
    return F.when(F.instr(value, "://") > 0, host_and_path(value)[0]).otherwise(value)


def drop_boilerplate_lines(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = 0.1, most_sites: int = 50_000) -> DataFrame:
    """Drops the lines that stand on more than `ratio` of a site's pages; a line of a single page never drops.

    site names a column of URLs, whose hosts are the sites, or of site names. Adds n_lines and n_dropped (long; columns of
    these names are replaced) and replaces the text by what is left of it; all rows stay, in any number, and
    rows of which nothing is dropped keep their text as it is. Lines end at a line feed and are compared without blanks
    at their ends; blank lines never drop. Exact copies of a page within a site count as one page, in the line's count as in the
    site's, else a page that was copied often would pass for boilerplate. A null site is a site of its own; a null
    text stays null with n_lines 0. All other columns come back as they are, whatever their names.

    A site has at most (mean distinct lines of a page) / ratio boilerplate lines, so the list of each is short; the sites
    that have any are broadcast up to most_sites lists, else joined with every site dealt over shares. Lines are
    counted by 64-bit hashes.
    """
    docs = docs.drop("n_lines", "n_dropped")
    rows = packed(docs).withColumns({"site": site_of(F.col(f"row.`{site}`").cast("string")), "said": F.col(f"row.`{text}`")})
    # A null site is joined as an empty name beside a flag.
    rows = rows.select("row", "said", F.coalesce("site", F.lit("")).alias("s"), F.col("site").isNull().alias("none"))
    key = ["s", "none"]
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("said")), _stripped), lambda x: x != ""), lambda x: F.xxhash64(x)))
    copies = rows.filter(F.col("said").isNotNull()).select(*key, F.xxhash64("said").alias("copy"), F.length("said").alias("n"), hashes.alias("lines"))
    pages = written(copies.groupBy(*key, "copy", "n").agg(F.first("lines").alias("lines")), "pages")
    totals = pages.groupBy(*key).agg(F.count("*").alias("total"))
    counts = pages.select(*key, F.explode("lines").alias("line")).groupBy(*key, "line").agg(F.count("*").alias("pages"))
    common = counts.filter(F.col("pages") >= REPEATED).join(totals, key).filter(F.col("pages") > F.col("total") * ratio)
    lists = written(common.groupBy(*key).agg(F.collect_set("line").alias("common")), "boilerplate")
    marked = lookup_join(rows, lists, key, most_rows=most_sites, spread=[F.xxhash64("said")])
    some = F.coalesce("common", F.array().cast("array<bigint>"))
    stays = lambda x: ~F.array_contains(some, F.xxhash64(_stripped(x))) | (_stripped(x) == "")
    marked = marked.withColumn("left", F.when(F.size(some) > 0, F.filter(_lines(F.col("said")), stays)))
    marked = marked.withColumn("n_lines", F.when(F.col("said").isNull(), 0).otherwise(F.size(_lines(F.col("said")))).cast("long"))
    marked = marked.withColumn("n_dropped", F.when(F.col("left").isNull(), 0).otherwise(F.col("n_lines") - F.size("left")).cast("long"))
    left = F.when(F.col("n_dropped") > 0, F.array_join("left", "\n")).otherwise(F.col("said"))
    return marked.select(*[left.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns], "n_lines", "n_dropped")
