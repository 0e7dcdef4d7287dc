"""Embedding near-duplicates and exact top-k search.

Near-duplicates: random-hyperplane signs in several tables, cosines in double
precision, distributed components.  Search: an impact-ordered index that is read
score at a time, stops on proof and rescores exactly.
"""

from __future__ import annotations

import math
import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, per_process, runs, stars, written

#: Vectors of a block of a large bucket.
BLOCK = 2048


def _planes(tables: int, bits: int, size: int, seed: int):
    import numpy as np

    return per_process(("planes", tables, bits, size, seed), lambda: np.random.RandomState(seed + size).standard_normal((size, tables * bits)))


def _by_size(lists):
    """(size, rows, matrix) of a list column, for each size in it."""
    import numpy as np

    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, values[starts[rows][:, None] + np.arange(size)]


def _sign(tables: int, bits: int, seed: int):
    """Each valid vector: label, size, its bits in every table (32 bits each),
    itself and its digest."""

    def run(batches):
        import hashlib

        import numpy as np

        for b in batches:
            for size, rows, x in _by_size(b.column(2)):
                s = (x.astype(np.float64) @ _planes(tables, bits, size, seed) >= 0).reshape(len(x), tables, bits)
                signs = (s @ (1 << np.arange(bits))).astype("<u4")
                data = [v.tobytes() for v in x]
                own = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(own), b.column(1).take(own), pa.array(np.full(len(x), size, np.int32)), pa.array([v.tobytes() for v in signs], pa.binary()), pa.array(data, pa.binary()), pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in data], pa.binary())],
                    names=["vec_id", "label", "size", "signs", "data", "digest"],
                )

    return run


def _compare(least: float, kind: str):
    """Runs of (t, bucket, i, j): exact cosines between blocks i and j of a bucket
    of table t.  A pair counts in the first table where it meets, and parts of
    blocks that all met before are skipped.  Gives the links of each vector (as
    many as the vectors that its neighbours stand for) and a forest of them, never
    the pairs."""

    def run(batches):
        import numpy as np

        none = np.zeros(0, np.int64)
        made = ([], [], [])

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in made], names=["vec_id", "n", "root"])
            for x in made:
                x.clear()
            return batch

        for t in runs(batches, ["t", "bucket", "i", "j"]):
            if t.num_rows < 2:
                continue
            table, i, j = (t.column(c)[0].as_py() for c in ("t", "i", "j"))
            signs = np.frombuffer(b"".join(t.column("signs").to_pylist()), "<u4").reshape(t.num_rows, -1)
            order = np.lexsort(signs[:, :table].T) if table else np.arange(t.num_rows)
            signs = signs[order]
            ids, salts, weight = (t.column(c).to_numpy()[order] for c in ("vec_id", "salt", "weight"))
            x = np.frombuffer(b"".join(t.column("data").to_pylist()), kind).reshape(len(ids), -1)[order].astype(np.float64)
            norm = np.sqrt((x * x).sum(1))
            left, right = np.flatnonzero(salts == i), np.flatnonzero(salts == j)
            links = np.zeros(len(ids), np.int64)
            us, vs = [none], [none]
            for at in range(0, len(left), 256):
                own = left[at : at + 256]
                for to in range(at if i == j else 0, len(right), 1024):
                    other = right[to : to + 1024]
                    met = [k for k in range(table) if (signs[own, k] == signs[own[0], k]).all() and (signs[other, k] == signs[own[0], k]).all()]
                    if met:
                        continue
                    hit = (x[own] @ x[other].T) / (norm[own][:, None] * norm[other][None, :]) >= least
                    if i == j:
                        hit &= own[:, None] < other[None, :]
                    for k in range(table):
                        if hit.any():
                            hit &= signs[own, k][:, None] != signs[other, k][None, :]
                    if hit.any():
                        links[own] += hit @ weight[other]
                        links[other] += weight[own] @ hit
                        u, v = np.nonzero(hit)
                        u, v = stars(own[u], other[v])
                        us.append(u)
                        vs.append(v)
            some = np.flatnonzero(links)
            if len(some):
                u, v = np.concatenate(us), np.concatenate(vs)
                u, v = stars(ids[u], ids[v])
                made[0].extend((ids[some], u))
                made[1].extend((links[some], np.zeros(len(u), np.int64)))
                made[2].extend((ids[some], v))
            if sum(map(len, made[0])) > 100_000:
                yield out()
        yield out()

    return run


def _finite(c):
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _once(rows: DataFrame, usable, *fields: str) -> tuple[DataFrame, bool]:
    """The usable rows, an id's smallest if it has several, and whether any id
    repeats: only ids are counted, and only rows of repeated ones are shuffled."""
    twice = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "twice")
    good = rows.where(usable)
    if twice.isEmpty():
        return good, False
    least = good.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct(*fields)).alias("x")).select("vec_id", "x.*")
    return good.join(twice, "vec_id", "left_anti").unionByName(least), True


def tables_for(n: int, least: float, recall: float, target: int) -> tuple[int, int]:
    """Bits and tables for n vectors of a label: so many bits that a bucket holds
    about `target`, and so many tables that a pair at cosine `least` meets in one
    of them with probability `recall` at least."""
    bits = min(30, max(3, int(math.log2(max(1, n) / target)) if n > target else 0))
    meet = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = 0.95, target: int = 512, seed: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept.  Vectors of one label and one size are
    linked if their cosine is at least `least`; every link reported is exact, and
    a pair at 0.93 meets in a table with probability `recall` at least, closer ones
    more often.  Bits and tables follow from the size of the largest label.

    Null labels, null or zero vectors and those with null or non-finite parts
    stand alone.  An id that repeats is one vector (the smallest valid one, with
    its label); rows with a null id have no identity and are left out, as are
    other columns.

    Equal vectors of a label are one class, compared once and counted by how many
    they are.  Buckets of more than `block` classes are dealt in blocks, and each
    pair of blocks is a unit of work, so no task gathers a bucket.
    """
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).where("vec_id is not null")
    usable = F.coalesce(F.col("label").isNotNull() & _finite(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False))
    one, repeated = _once(rows, usable, "label", "v")
    if bits is None or tables is None:
        most = rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bits, tables = tables_for(most, least, recall, target)
    signed = written(one.select("vec_id", "label", "v").mapInArrow(_sign(tables, bits, seed), "vec_id long, label string, size int, signs binary, data binary, digest binary"), "signs")

    same = ["label", "size", "digest"]
    equal = written(signed.groupBy(*same).agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep")).where("weight > 1"), "equal")
    classes = signed.join(equal, same, "left").where("rep is null or rep = vec_id").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))

    # the signs of table t: bytes 4t + 1 .. 4t + 4
    bucket = F.xxhash64("label", "size", F.expr("substring(signs, 4 * t + 1, 4)"))
    posts = classes.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("bucket", bucket)
    hot = posts.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = written(hot.select("t", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    blocks = F.coalesce("blocks", F.lit(1))
    meet = posts.join(hot, ["t", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    meet = meet.select("t", "bucket", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "vec_id", "weight", "signs", "data")
    meet = meet.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
    found = written(meet.mapInArrow(_compare(least, kind), "vec_id long, n long, root long"), "links")

    parts = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("rep"), "component")
    linked = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n_links"))
    linked = written(linked.join(parts, "rep", "left"), "linked")
    members = signed.select("vec_id", *same).join(equal, same).select("vec_id", "rep", "weight")
    ids = rows.select("vec_id").distinct() if repeated else rows.select("vec_id")
    out = ids.join(members, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id")).join(linked, "rep", "left")
    n_links = F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n_links", F.lit(0))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


class ImpactIndex:
    """Integer vectors as postings: for each component and quantised level a
    segment of members.  A segment's impact on a query is its level's middle times
    the query's component; what a level hides and what isn't read yet are bounded."""

    def __init__(self, ids, values, levels: int = 20):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        n, self.size = self.values.shape
        members, component, least, most = [], [], [], []
        for d in range(self.size):
            own = self.values[:, d].astype(np.int64)
            step = max(1, -(-int(own.max() - own.min() + 1) // levels))
            by = np.argsort(own, kind="stable")
            level = (own[by] - own[by[0]]) // step
            for found in np.split(by, np.flatnonzero(np.diff(level)) + 1):
                members.append(found)
                component.append(d)
                least.append(int(own[found[0]]))
                most.append(int(own[found[-1]]))
        self.members = np.concatenate(members).astype(np.uint16 if n <= 65536 else np.int32)
        self.ends = np.cumsum([len(m) for m in members])
        self.component, self.least, self.most = (np.array(x, np.int64) for x in (component, least, most))

    def ready(self):
        """What queries need and isn't worth storing."""
        import numpy as np

        self.segments = np.split(self.members.astype(np.int64), self.ends[:-1])
        self.lengths = np.diff(self.ends, prepend=0)
        self.twice = self.least + self.most  # twice the middle: stays an integer
        self.width = self.most - self.least
        self.reach = np.maximum(np.abs(self.least), np.abs(self.most))
        # sums of products below 2 ** 53 are exact in double precision
        self.exact = self.values.astype(np.float64) if float(self.reach.max()) ** 2 * self.size < 2**52 else self.values.astype(np.int64)
        return self

    def scores(self, members, query):
        """Exact inner products of some members."""
        import numpy as np

        rows = self.exact[members]
        if rows.dtype == np.float64 and float(np.abs(query).max()) * float(self.reach.max()) * self.size < 2**52:
            return (rows @ query.astype(np.float64)).astype(np.int64)
        return rows.astype(np.int64) @ query

    def top(self, query, k: int, own: int, enough: float = 0.5):
        """The k highest (score, id) of members other than own, ties to smaller ids.

        Segments are read by descending impact.  All accumulators are wrong by at
        most `doubt`, and the k-th best of a few members that lead so far, scored
        exactly, is a score that the result reaches.  Reading stops when no more
        than `enough` of the members can still reach it, or at the last segment;
        those that can are rescored."""
        import numpy as np

        q = query.astype(np.int64)
        alive = np.ones(len(self.ids), bool)
        alive[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = False
        keep = min(k, int(alive.sum()))
        if not keep:
            return []
        size = np.abs(q)[self.component]
        add = self.twice * q[self.component]
        order = np.argsort(-np.abs(add), kind="stable")
        # doubled, as the accumulators: what is hidden in levels, by component
        hidden = np.zeros(self.size, np.int64)
        np.maximum.at(hidden, self.component, size * self.width)
        got = np.zeros(len(self.ids), np.int64)
        at, total, floor = 0, len(order), None
        small = 2.0 * float(np.abs(q).max()) * float(self.reach.max()) * self.size < 2**52
        possible = np.flatnonzero(alive)
        for stop in sorted({max(1, total * x // 8) for x in (2, 3, 4, 5, 6, 7)} | {total}):
            some = order[at:stop]
            members = np.concatenate([self.segments[s] for s in some.tolist()])
            if small:  # sums in double precision are exact
                got += np.bincount(members, np.repeat(add[some].astype(np.float64), self.lengths[some]), len(got)).astype(np.int64)
            else:
                np.add.at(got, members, np.repeat(add[some], self.lengths[some]))
            at = stop
            # and what a component not read can still add: its largest segment to come
            rest = np.zeros(self.size, np.int64)
            if at < total:
                later = order[at:]
                np.maximum.at(rest, self.component[later], 2 * size[later] * self.reach[later])
            doubt = int(np.maximum(hidden, rest).sum())
            some = min(len(possible), max(4 * k, 32))
            leading = possible[np.argpartition(-got[possible], some - 1)[:some]]
            best = np.sort(self.scores(leading, q))[-keep]
            floor = best if floor is None else max(floor, best)
            possible = np.flatnonzero(alive & (got + doubt >= 2 * floor))
            if len(possible) <= max(4 * k, enough * len(got)):
                break
        score = self.scores(possible, q)
        best = np.lexsort((self.ids[possible], -score))[:k]
        return [(int(score[b]), int(self.ids[possible[b]])) for b in best]


def _vectors(t):
    """Ids and integer components of rows (vec_id, size, data); a row's integers
    are as wide as its data are long."""
    import numpy as np

    data = t.column("data").to_pylist()
    size = t.column("size")[0].as_py()
    wide = max(map(len, data)) // size
    if all(len(d) == wide * size for d in data):
        values = np.frombuffer(b"".join(data), f"<i{wide}").reshape(len(data), size)
    else:
        values = np.array([np.frombuffer(d, f"<i{len(d) // size}") for d in data])
    return np.asarray(t.column("vec_id")), values


def _build(key, t):
    index = ImpactIndex(*_vectors(t))
    return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "index": pa.array([pickle.dumps(index.__dict__, 5)], pa.binary())})


def _search(k: int):
    def run(key, indexes, queries):
        import numpy as np

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not indexes.num_rows or not queries.num_rows:
            return schema.empty_table()
        index = ImpactIndex.__new__(ImpactIndex)
        index.__dict__.update(pickle.loads(indexes.column("index")[0].as_py()))
        index.ready()
        found = [(own, i, s) for own, q in zip(*_vectors(queries)) for s, i in index.top(np.asarray(q), k, int(own))]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], schema=schema)

    return run


def _integers(scale: int):
    """Components to floor(scale * x), as narrow as a row's integers allow."""

    def run(batches):
        import numpy as np

        for b in batches:
            for size, rows, x in _by_size(b.column(1)):
                whole = np.floor(x.astype(np.float64) * float(scale)).astype(np.int64)
                most = np.maximum(whole.max(1), -1 - whole.min(1))
                wide = np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8)).tolist()
                data = [v.astype(f"<i{w}").tobytes() for v, w in zip(whole, wide)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.full(len(x), size, np.int32)), pa.array(data, pa.binary())], names=["vec_id", "size", "data"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, query_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`
    the k highest integer inner products with the other rows, ties to smaller ids.
    Components become floor(scale * x).

    Null vectors and ids and vectors with null or non-finite components take no
    part; empty vectors don't either.  An id that repeats is one vector (the
    smallest).  Vectors are only scored against vectors of their size.  Fewer
    than k candidates give fewer ranks.  Other columns are left out.

    The rows lie in shards, whose indexes are built once and written; a block of
    queries meets a shard's index in one task.  The number of shards and blocks
    follows from the row count, so neither grows.  A shard's answers are its k
    best, so k per shard and query come back.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    usable = F.coalesce(_finite(F.col("v")) & (F.size("v") > 0), F.lit(False))
    one, _ = _once(rows, usable, "v")
    rows = written(one.select("vec_id", "v").mapInArrow(_integers(scale), "vec_id long, size int, data binary"), "integers")
    n = rows.count()
    # small tables get as many shards as there are cores, of 2048 rows at least
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // 2048))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // query_rows))
    hashed = F.xxhash64("vec_id")
    indexes = rows.withColumn("shard", F.pmod(hashed, F.lit(shards))).groupBy("size", "shard").applyInArrow(_build, "size int, shard long, index binary")
    indexes = written(indexes, "indexes").withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    asked = queries.withColumn("block", F.pmod(hashed, F.lit(blocks))).withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    by = ("size", "shard", "block")
    found = indexes.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """DuckDB SQL for exact_top_k over embeddings (its ids don't repeat)."""
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), scored as (
  select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score
  from v q join v on len(q.e) = len(v.e) and q.vec_id <> v.vec_id where q.vec_id % {every} = 0
)
select query_id, rank, vec_id, score from (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
) where rank <= {k}
"""
