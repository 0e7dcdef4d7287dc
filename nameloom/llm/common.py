"""What the operators share: tables, shared folders, Arrow runs, components."""

from __future__ import annotations

import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set on
    the context; a temporary one only in local mode with neither set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nameloom-"))
    return context.getCheckpointDir().get()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives
    executors.  The folder goes when the driver ends, or before by release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nameloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found._nameloom_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for t in tables:
        place, system = _place(t.sparkSession, t._nameloom_path)
        system.delete(place, True)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As written(), dealt by a hash of key, so that a later grouping by key reads
    it where it lies and shuffles only the other side.  Its name is in the
    session's current database for a moment."""
    spark = df.sparkSession
    name = f"nameloom_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).bucketBy(n, key).saveAsTable(name)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return found


def slices(batches, rows: int = 512):
    """The batches, a few rows at a time, so that few texts are Python objects at once."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def per_process(key, build):
    """build() once per Python worker process, kept between tasks."""
    kept = sys.__dict__.setdefault("_nameloom_kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def runs(batches, keys: list[str]):
    """Runs of equal keys of a partition that is sorted by them, as tables.

    Holds one run and one batch at a time; callers bound the runs."""
    import numpy as np

    held = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        columns = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:]):
            if held and a:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.concat_tables(held)


#: Edges that a task contracts at a time (some 100 MB while it does).
EDGES = 1_000_000


def stars(u, v):
    """Edges as stars on the smallest id of each component: ids hook to the least
    neighbouring root and paths are halved until nothing changes."""
    import numpy as np

    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(u):
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        now = root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            break
        root = now
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other], ids[root[other]]


def _forest(most: int):
    """Per partition: the edges contracted, `most` at a time."""

    def run(batches):
        import numpy as np

        held, n = [], 0

        def out():
            made = stars(*(np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= most:
                yield out()
                n = 0
        yield out()

    return run


def with_least(both: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their u's minimum.  Both sides are tables, so Spark broadcasts
    minima that it knows to be small and else may split a hub's partition, which
    it could not if the minima came straight from their aggregation."""
    return both.join(least, "u")


def components(edges: DataFrame, label: str = "components", most: int = EDGES) -> DataFrame:
    """(id, component): the smallest id reachable over edges (u, v), for every
    id that has an edge to another one.

    Tasks contract `most` edges at a time to stars.  As many tasks as the measured
    edges need contract again; a single one's stars are the result.  Several are
    followed by a large-star and a small-star step, until that changes no edge.
    Hubs are safe: minima are pre-aggregated and written before they are joined.
    A round's tables go once the next one's edges are written."""
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = written(e.mapInArrow(_forest(most), "u long, v long"), label)
    size = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = size(e)
    while now[0]:
        tasks = -(-now[0] // most)
        packed = written((e.coalesce(1) if tasks == 1 else e.repartition(tasks)).mapInArrow(_forest(2 * most), "u long, v long"), label)
        release(e)
        e = packed
        if tasks == 1:
            break
        e = written(e.distinct(), label)
        release(packed)
        before = size(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = with_least(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        after = written(small.distinct(), label)
        release(e, least, large, low)
        e, now = after, size(after)
        if now == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
