"""URL filter: host suffixes and path prefixes looked up by short hashes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.llm.text import ascii_lower
from percepta.shared import lookup_join, packed, written

#: Hex digits of SHA-256 that form the short hash.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end.

    Null, or no ://: both empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_rules: int = 100_000, most_verdicts: int = 200_000, salts: int = 32) -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    rules(host, path, verdict): a rule fits its host and all subdomains of it if the URL's path starts with the
    rule's path. Of the rules that fit, the one with the longest host and path together wins, then the longer host, then
    block. Rules with a null part are left out; repeated rules count once. Without a rule: rule null, verdict `default`.

    Each distinct (host, path) is expanded into the host suffixes whose number of labels, and the path prefixes whose
    length, some rule has. The short hash of each expression is equi-joined with the rules' short hashes; a match counts
    if the full SHA-256 digests agree too. The rules are broadcast if they are at most most_rules; else the
    expressions are joined over `salts` shares of each short hash, since an expression such as a top-level domain may
    stand for a third of all URLs. So are the verdicts of the pairs that some rule fits, beyond
    most_verdicts. Columns host, path, rule and verdict of the input are replaced; rows keep their number.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(f"row.`{url}`"))
    parsed = packed(pages).select("row", host.alias("host"), path.alias("path"))
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("|"), p), 256)
    labels = lambda h: F.size(F.split(h, r"\."))
    rules = rules.select(ascii_lower(F.col("host")).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")).dropna().distinct()
    rules = rules.withColumn("digest", digest(F.col("rh"), F.col("rp"))).withColumn("short", F.substr("digest", F.lit(1), F.lit(SHORT)))
    rules = written(rules, "rules")
    # Distinct label counts and path lengths of rules: at most as many as a URL has labels and letters.
    shapes = rules.agg(F.collect_set(labels(F.col("rh"))).alias("n"), F.collect_set(F.length("rp")).alias("m")).first()

    keys = parsed.select("host", "path").filter("host <> ''").distinct()
    parts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.filter(F.lit(shapes.n).cast("array<int>"), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(F.lit(shapes.m).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    said = keys.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    said = said.withColumn("full", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substr("full", F.lit(1), F.lit(SHORT)))
    met = lookup_join(said, rules, ["short"], "inner", most_rows=most_rules, salts=salts, spread=[F.col("host"), F.col("path")])
    rank = F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("h"), F.col("rv") == "block", F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict"))
    best = met.filter("full = digest").groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    best = written(best, "url-verdicts")
    # A (host, path) that many rows share is dealt over shares too, or the verdicts are few enough to broadcast.
    out = lookup_join(parsed, best, ["host", "path"], most_rows=most_verdicts, salts=salts)
    return out.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
