"""Secret scan that links the parts of multipart credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.shared import freed, lookup_join, packed, written

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "endpoint", "identifier")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: a bare run that may be a secret key, also right after an equals sign as in env files, and where it may be used.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
#: Host names are maximal runs of their letters that end in a service's domain: no repetition within a repetition.
ENDPOINT = r"""(?:https?://[^\x20\x09-\x0D"'<>]{4,}|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]*[A-Za-z0-9-]\.(?:amazonaws\.com|azure\.com|googleapis\.com|internal|local)\b(?::[0-9]{1,5})?)"""
#: Weak access identifiers: a named account or client, or a mail address.
NAMED = r"""(?i:client_?id|key_?id|account(?:_?(?:id|name))?|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]{1,63}){1,126}"
IDENTIFIER = f"(?:{NAMED}|{MAIL})"

#: Spans that are appended one by one.
_BLOCK = 256
_SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost matches that don't overlap, in code points, whose group has `least` code points at least.

    The parts between matches come from split and the matches from regexp_extract_all, so starts are sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"))), groups, lambda s, g: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), F.length(g).alias("len")))
    none = F.array().cast(_SPANS)

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + s["n"]).alias("end"))).cast(_SPANS)
        return F.struct((start + s["n"]).cast("bigint").alias("at"), F.when(s["len"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def folded(all_steps: Column) -> Column:
        """Blocks of spans one after the other: appending copies a block at most, so the work is linear in the spans."""
        of = lambda acc, b: F.aggregate(F.slice(all_steps, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), add)
        grown = lambda acc, b: F.element_at(F.transform(F.array(of(acc, b)), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), 1)
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(all_steps) / _BLOCK).cast("int")), zero, grown, lambda acc: F.flatten(acc["out"]))

    spans = F.element_at(F.transform(F.array(steps), folded), 1)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    names = F.lit(list(KINDS)).cast("array<string>")
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find_secrets(docs: DataFrame, text: str = "text", scope: int = 400, most_rows: int = 200_000) -> DataFrame:
    """Adds the spans of secrets to every row of docs, over whole texts (null: empty).

    Strong kinds are always reported: assign (a named value of 12 characters or more), access (an access identifier) and hex
    (a run of 16 hex digits or more). Weak kinds stand for one part of a credential and are reported only beside the
    parts that complete it, which start within `scope` code points of it:
    weak_secret (a bare run of 40) beside an access or weak identifier; identifier (a named account or client, a mail
    address) beside a secret (assign, hex or weak_secret); endpoint (a URL or service host) beside both.
    A weak part that lies within a part of another kind is no part of its own, except that an address within an
    endpoint doesn't hide it.

    Weak parts are found only in texts that have an identifier of either kind. They meet their complements in an equi-join
    on text and scope-sized bin (each part in its own and both neighbouring bins), so one long text is dealt over its bins, and
    a bin holds at most as many parts as fit in it. Parts belong to a text, so copies are linked once; in a bin, parts
    meet at most once for each kind and start, so spans with equal starts are ties that all stay.

    Adds spans_list (array of start, rank in KINDS, end), spans, base (strong ones joined alike), n_assign, n_access
    and n_hex (long). Rows keep their number; columns of these names are replaced, all others stay, whatever their names.
    """
    docs = docs.drop("spans_list", "spans", "base", "n_assign", "n_access", "n_hex")
    rows = packed(docs).withColumn("said", F.coalesce(F.col(f"row.`{text}`"), F.lit("")))
    strong = lambda c: {"assign": _spans(c, ASSIGN, "assign", 2, 12), "access": _spans(c, ACCESS, "access"), "hex": _spans(c, HEX, "hex")}
    whole = F.col("said")

    weak = rows.filter(whole.rlike(f"{ACCESS}|{IDENTIFIER}")).select("said").distinct()
    weak_parts = [_spans(whole, p, kind) for p, kind in ((WEAK_SECRET, "weak_secret"), (ENDPOINT, "endpoint"), (IDENTIFIER, "identifier"))]
    parts = weak.select(F.md5("said").alias("at"), F.explode(F.concat(*strong(whole).values(), *weak_parts)).alias("p"))
    parts = written(parts.select("at", "p.*"), "parts")
    bin_of = F.floor(F.col("start") / scope)
    other = parts.select("at", *[F.col(c).alias(f"o_{c}") for c in ("start", "rank", "end")], F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    kind = {k: F.col("rank") == i for i, k in enumerate(KINDS)}
    o_kind = {k: F.col("o_rank") == i for i, k in enumerate(KINDS)}
    pairs = parts.filter(F.col("rank") >= 3).withColumn("bin", bin_of).join(other, ["at", "bin"])
    pairs = pairs.filter((F.col("o_rank") != F.col("rank")) & (F.abs(F.col("start") - F.col("o_start")) <= scope))
    hides = ~o_kind["identifier"] & ~(kind["endpoint"] & o_kind["weak_secret"])
    covers = hides & (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end"))
    # A named access identifier is the access identifier itself.
    covers = covers | (kind["identifier"] & o_kind["access"] & (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start")))
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    beside = pairs.groupBy("at", "start", "rank", "end").agg(has(o_kind["access"] | o_kind["identifier"]).alias("who"), has(F.col("o_rank").isin(0, 2, 3)).alias("secret"), has(covers).alias("covered"))
    complete = (kind["weak_secret"] & F.col("who")) | (kind["identifier"] & F.col("secret")) | (kind["endpoint"] & F.col("who") & F.col("secret"))
    linked = beside.filter(~F.col("covered") & complete)
    linked = written(linked.groupBy("at").agg(F.collect_list(F.struct("start", "rank", "end")).cast(_SPANS).alias("more")), "linked")
    freed(parts)

    rows = rows.select("row", F.md5("said").alias("at"), *[c.alias(k) for k, c in strong(whole).items()])
    rows = lookup_join(rows, linked, ["at"], most_rows=most_rows)
    base = F.array_sort(F.concat(*KINDS[:3]))
    every = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast(_SPANS))))
    return rows.select("row.*", every.alias("spans_list"), _joined(every).alias("spans"), _joined(base).alias("base"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]])
