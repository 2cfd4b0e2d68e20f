"""Demonstrations: recorded transitions, their episodes, noise and samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percepta.operators.scans import Scan, scanned
from percepta.shared import freed, lookup_join, written


def _recording() -> Scan:
    """(rows, completed episodes; step of the row and steps since the last end as a · steps before + b; whether the row ends its episode)."""

    def elements(values):
        done = np.nan_to_num(values[0])
        one = np.ones(len(done))
        return one, done, one, one, 1 - done, 1 - done, done

    def combine(e, f):
        return e[0] + f[0], e[1] + f[1], f[2] * e[4], f[2] * e[5] + f[3], f[4] * e[4], f[4] * e[5] + f[5], f[6]

    return Scan([()] * 7, elements, combine, lambda e: [e[1] - e[6], e[3], e[0]])


def recorded(stream: DataFrame, key: str = "buffer_id", order: str = "seq", most: int | None = 100_000, block: int = 500_000) -> DataFrame:
    """The last `most` transitions of each buffer (all if None), with episode (0, 1, …; a new one after each done) and step.

    Episodes are counted before old transitions leave, so an episode may have lost its first steps. Null done counts as not done; rows
    without a buffer or order are left out. All counts are prefix sums, so buffers of more than `block` rows are dealt over tasks, as scanned() says.
    """
    rest = [c for c in stream.columns if c not in (key, order)]
    out = scanned(stream, key, order, [F.col("done").cast("double")], _recording(), "episode_ double, step_ double, nth_ double", block=block, keep=rest)
    if most is not None:
        n = stream.filter(F.col(order).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_"))
        out = lookup_join(out, n, [key], "inner").filter(F.col("nth_") > F.col("rows_") - most)
    return out.select(*stream.columns, F.col("episode_").cast("long").alias("episode"), F.col("step_").cast("int").alias("step"))


def episode(transitions: DataFrame, number: int) -> DataFrame:
    """The transitions of one episode; none if there is no such episode."""
    return transitions.filter(F.col("episode") == number)


def buffer_statistics(transitions: DataFrame) -> DataFrame:
    """One row: completed episodes, transitions, and average, largest and least reward and length; zeros without a completed episode."""
    each = transitions.groupBy("episode_id").agg(F.count("*").alias("n"), F.sum("reward").alias("r"), F.bool_or("done").alias("done"))
    own = lambda f, c: F.coalesce(f(F.when(F.col("done"), F.col(c))).cast("double"), F.lit(0.0))
    episodes = F.count_if("done")
    cols = [own(f, c).alias(f"{n}_{m}") for c, m in (("r", "reward"), ("n", "episode_length")) for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))]
    return each.agg(episodes.alias("num_episodes"), F.when(episodes > 0, F.sum("n")).otherwise(0).alias("num_transitions"), *cols)


def with_noise(transitions: DataFrame, observations: list[tuple[str, str]], actions: list[str], sigma: float = 0.01, seed: int = 0) -> DataFrame:
    """Normal noise on observations and actions; an observation and the next one, given as a pair, move by the same amount."""
    moved = {}
    for i, pair in enumerate(observations):
        noise = F.col(f"noise {i}")
        moved |= {c: F.col(c) + sigma * noise for c in pair}
    drawn = transitions.withColumns({f"noise {i}": F.randn(seed + i) for i in range(len(observations))})
    out = drawn.withColumns(moved | {c: F.col(c) + sigma * F.randn(seed + 1000 + i) for i, c in enumerate(actions)})
    return out.drop(*[f"noise {i}" for i in range(len(observations))])


def sample_batch(transitions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n transitions without replacement, all if there are no more: the least of a seeded hash of the row's key."""
    return transitions.orderBy(F.xxhash64(F.lit(seed), "episode_id", "step"), "episode_id", "step").limit(n)


def sample_trajectory(transitions: DataFrame, length: int, seed: int = 0, order: tuple[str, ...] = ("episode_id", "step")) -> DataFrame:
    """`length` transitions in a row from a seeded start; ValueError if there are fewer. Rows are numbered by range, not in one task."""
    import random

    ranged = transitions.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged")
    counts = {r.part: (r.n, r.first) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()}
    total = sum(n for n, _ in counts.values())
    if total == 0:
        return transitions.limit(0)
    if length > total:
        raise ValueError(f"{total} transitions hold no trajectory of {length}")
    start, before, rule = random.Random(seed).randint(0, total - length), 0, F.lit(False)
    for part in sorted(counts):
        n, first = counts[part]
        nth = F.col("at") - first + before
        rule = rule | ((F.col("part") == part) & (nth >= start) & (nth < start + length))
        before += n
    out = written(ranged.filter(rule).drop("part", "at"), "trajectory")
    freed(ranged)
    return out
