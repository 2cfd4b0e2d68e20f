"""Tables in the folder that driver and executors share, and joins whose small side is measured first."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; a temporary folder only where that is unset on a local master, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="percepta-")
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/percepta-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at, files = _hadoop(spark, path)
        files.delete(at, True)
    except Exception:  # the JVM may have ended before
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors. by: a column whose values get folders of their own."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def large(df: DataFrame) -> DataFrame:
    """df, not to be broadcast in its next join: the files of a written table are far smaller than its rows, so by their size Spark would send millions of rows through the driver."""
    return df.hint("merge")


def freed(*tables: DataFrame) -> None:
    """Deletes tables that written() made; their last reader must be done. Other DataFrames are left alone."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            _remove(t.sparkSession, path)


def packed(df: DataFrame) -> DataFrame:
    """df as one struct column, row: beside it an operator's own columns can't clash with the input's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


#: Rows of one key that are left to one task of a join.
CROWD = 50_000


def fits(table: DataFrame, most_rows: int, most_bytes: int = 64 << 20) -> bool:
    """Whether a table is small enough to broadcast: its rows are counted and, if it was written, its files measured."""
    if path := _PATHS.get(table):
        at, files = _hadoop(table.sparkSession, path)
        if files.getContentSummary(at).getLength() > most_bytes:
            return False
    return table.limit(most_rows + 1).count() <= most_rows


def lookup_join(left: DataFrame, table: DataFrame, on: list[str], how: str = "left", most_rows: int = 200_000, salts: int = 32, spread: list[Column] | None = None, crowded: DataFrame | None = None) -> DataFrame:
    """Joins left to a written table that has few rows for each key.

    A table of at most most_rows rows and 64 MB of files is broadcast. Beyond, the two are merged and neither goes through the driver: only left's rows of keys that
    have more than CROWD of them, or a null, are dealt over `salts` shares, and only these keys' rows of the table are repeated for each share, so that a key with a
    third of all rows has no task of its own. crowded: a table of these keys where they are known; else left's rows are counted.
    """
    if fits(table, most_rows):
        return left.join(F.broadcast(table), on, how)
    names = {c.lower() for c in (*left.columns, *table.columns)}
    salt, mark = "salt", "crowd"
    while salt in names:
        salt += "_"
    while mark in names:
        mark += "_"
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    hashable = [F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    dealt = F.pmod(F.xxhash64(*(spread or hashable or [F.lit(0)])), F.lit(salts)).cast("int")
    if crowded is None:
        crowded = left.groupBy(on).agg(F.count("*").alias(mark)).filter(F.col(mark) > CROWD)
    # One key for each CROWD rows at most.
    crowded = written(crowded.select(*on, F.lit(True).alias(mark)), "crowded")
    apart = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in on])
    shares = F.array(F.lit(0))
    if crowded.limit(1).count():
        left, table = (d.join(F.broadcast(crowded), on, "left") for d in (left, table))
        apart, shares = apart | F.col(mark).isNotNull(), F.when(F.col(mark), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(shares)
    left = left.withColumn(salt, F.when(apart, dealt).otherwise(0)).drop(mark)
    table = table.withColumn(salt, F.explode(shares)).drop(mark)
    return large(left).join(table, [*on, salt], how).drop(salt)


def crowded_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, most_rows: int = 1024) -> DataFrame:
    """Inner join for keys that have many rows on both sides: those with more than most_rows rows of right are dealt over shares of that many by `spread`,
    and left's rows go to each share, so that neither the pairs of one key nor its rows of right meet in one task."""
    full = right.groupBy(on).agg(F.ceil(F.count("*") / most_rows).cast("int").alias("shares_")).filter("shares_ > 1")
    full = written(full, "crowded-keys")
    left, right = lookup_join(left, full, on), lookup_join(right, full, on, spread=[spread])
    left = left.withColumn("share_", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares_") - 1, F.lit(0))))).drop("shares_")
    right = right.withColumn("share_", F.when(F.col("shares_").isNotNull(), F.pmod(F.xxhash64(spread), F.col("shares_"))).otherwise(0).cast("int")).drop("shares_")
    return large(left).join(right, [*on, "share_"]).drop("share_")


def _nodes(column) -> list:
    """Values that can be compared and hashed; structs as tuples of their fields."""
    fields = [column.field(k).to_pylist() for k in range(column.type.num_fields)]
    return list(zip(*fields, strict=True)) if fields else column.to_pylist()


def _forest(batches):
    """Of the edges in a partition, a spanning forest whose edges point to the least node."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(*(_nodes(batch.column(k)) for k in (0, 1)), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 20_000):
        part = pairs[i : i + 20_000]
        names = [[f.name for f in kind.field(k).type] if pa.types.is_struct(kind.field(k).type) else None for k in (0, 1)]
        ends = [[dict(zip(names[k], p[k], strict=True)) if names[k] else p[k] for p in part] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(ends[k], type=kind.field(k).type) for k in (0, 1)], schema=kind)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node that can be reached.

    Edges are first thinned to a forest within each partition; then least labels pass along the edges and along
    themselves (pointer jumping), so rounds grow with the logarithm of the diameter. Each round is a written table.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    thin = edges.mapInArrow(_forest, edges.schema)
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(thin.select(F.explode(ways).alias("e")).select("e.*").distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), f"{name}-labels")
    while True:
        near = large(both).join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        least = written(large(labels).join(near, "a").select("a", F.least("l", "m").alias("l"), F.col("l").alias("was")), f"{name}-least")
        if not least.filter("l <> was").limit(1).count():
            freed(both, least)
            out = labels.withColumnsRenamed({"a": "node", "l": "component"})
            _PATHS[out] = _PATHS.pop(labels)
            return out
        # Labels are joined to the few rows of labels that stand for others, so a giant component's label is one lookup.
        tops = written(large(least).join(least.select(F.col("l").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("l"), F.col("l").alias("top")), f"{name}-tops")
        step = lookup_join(least, tops, ["l"], "inner", spread=[F.col("a")]).select("a", F.col("top").alias("l"))
        before, labels = labels, written(step, f"{name}-labels")
        freed(before, least, tops)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
