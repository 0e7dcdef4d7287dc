"""Bulk-synchronous best-fit packing of documents into sequences.

Documents are cut and measured in one pass.  A superstep range-sorts the pieces
still to be placed and the gaps of open sequences by size, the largest first:

1. Every range is swept in a task of its own.  A piece takes its successor, the
   smallest gap that still holds it; what remains of the gap comes up again when
   the sweep gets down to its size.
2. Pieces that found no gap in their range take those left over in ranges above,
   the nearest first.  Conflicts are resolved by rank: counts per range say which
   ranks of pieces meet which ranks of gaps, and a join brings them together.
3. Pieces for which no gap is left open sequences, the largest first, as many as
   their total length needs at least.

Gaps are updated and the superstep repeats until all pieces are placed.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding, shipped
from .common import per_process, slices, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"
#: Pieces and gaps of a range.
RANGE = 400_000


def measured(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document: ids, then end_id; cut if over capacity, so
    that only the first piece is shorter than capacity.  Added tokens that a text
    spells are read as such.  key is unique."""
    source = shipped(path)

    def cut(batches):
        import numpy as np
        from pyspark import TaskContext

        task = TaskContext.get()
        key = (task.partitionId() if task else 0) << 40
        encode = per_process(("bpe", source[0]), lambda: encoding(source, pattern)).encode
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "", allowed_special="all")
                ids.append(end_id)
                data = np.array(ids, "<u4").tobytes()
                total = len(ids)
                at, end, k = 0, (total - 1) % capacity + 1, 0
                while at < total:
                    rows.append((doc_id, k, at, end - at, zlib.crc32(data[4 * at : 4 * end]), key))
                    at, end, k, key = end, end + capacity, k + 1, key + 1
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


GAP, PIECE = 0, 1
#: What a sweep says of a row: a piece that is placed, one that isn't, a gap that
#: any range below may use, a gap that is smaller than its range.
PLACED, LEFT, OVER, SMALL = "placed", "left", "over", "small"
SWEPT = "state string, part int, rank long, size long, key long, sequence long, offset long"


def sweep(rows, capacity: int):
    """Rows (size, kind, key), sizes descending and gaps before pieces of their
    size, to (state, rank, size, key, sequence, offset).  A gap's key is its
    sequence; ranks count pieces left and gaps over, each in descending order."""
    open_, later = [], []  # by size, the smallest first; remainders, the largest first
    left, size = 0, capacity
    for size, kind, key in rows:
        if kind == GAP:
            heapq.heappush(open_, (size, key))
            continue
        while later and -later[0][0] >= size:
            gap, sequence = heapq.heappop(later)
            heapq.heappush(open_, (-gap, sequence))
        if not open_:
            yield LEFT, left, size, key, None, None
            left += 1
            continue
        gap, sequence = heapq.heappop(open_)
        yield PLACED, None, size, key, sequence, capacity - gap
        if gap - size >= size:
            heapq.heappush(open_, (gap - size, sequence))
        elif gap > size:
            heapq.heappush(later, (size - gap, sequence))
    for rank, (gap, sequence) in enumerate(sorted(open_, reverse=True)):
        yield OVER, rank, gap, sequence, sequence, None
    for gap, sequence in later:
        yield SMALL, None, -gap, sequence, sequence, None


def _sweep(capacity: int):
    schema = pa.schema([("state", pa.string()), ("part", pa.int32()), ("rank", pa.int64()), ("size", pa.int64()), ("key", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId() if task else 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held = []

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held.clear()
            return made

        for state, *rest in sweep(rows, capacity):
            held.append((state, part, *rest))
            if len(held) >= 20_000:
                yield out()
        if held:
            yield out()

    return run


def crossed(left: dict[int, tuple[int, int]], over: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of pieces left meet which ranks of gaps over: (range of pieces,
    first rank, how many, range of gaps, their last rank, pieces per gap).

    left: pieces of a range and the largest size; over: gaps of a range and the
    smallest.  Ranges go down in size, so a range's pieces take the smallest gaps
    of the nearest range above, and as many to a gap as surely fit."""
    out, free = [], []
    for part in sorted({*left, *over}):
        n, largest = left.get(part, (0, 1))
        rank = 0
        while n and free:
            above, gaps, least = free.pop()
            fit = least // largest
            need = -(-n // fit)
            take = min(n, gaps * fit)
            out.append((part, rank, take, above, gaps - 1, fit))
            if gaps > need:
                free.append((above, gaps - need, least))
            rank, n = rank + take, n - take
        if part in over:
            free.append((part, *over[part]))
    return out


def _superstep(items: DataFrame, n: int, capacity: int, rows: int):
    """One superstep over items (size, kind, key), of which there are n: (the
    placed: key, sequence, offset; the items left; how many these are at most)."""
    spark = items.sparkSession
    state = lambda x: swept.where(F.col("state") == x)
    ranges = -(-n // rows)
    ordered = items.repartitionByRange(ranges, F.desc("size"), "kind", "key") if ranges > 1 else items.coalesce(1)
    swept = written(ordered.sortWithinPartitions(F.desc("size"), "kind", "key").mapInArrow(_sweep(capacity), SWEPT), "swept")
    # numbers per range
    found = swept.groupBy("state", "part").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("size").alias("least"), F.max("size").alias("most")).collect()
    of = lambda x: {r["part"]: r for r in found if r["state"] == x}
    placed = state(PLACED).select("key", "sequence", "offset")
    if not of(LEFT):
        return placed, None, 0
    met = crossed({p: (r["n"], r["most"]) for p, r in of(LEFT).items()}, {p: (r["n"], r["least"]) for p, r in of(OVER).items()})
    taken = {part: rank + n for part, rank, n, *_ in met}
    table = F.broadcast(spark.createDataFrame(met, "part int, first long, n long, above int, last long, fit long"))
    pairs = state(LEFT).join(table, "part").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    gap_rank = F.col("last") - F.floor((F.col("rank") - F.col("first")) / F.col("fit"))
    pairs = pairs.select("key", F.col("size").alias("length"), F.col("above").alias("part"), gap_rank.alias("rank"), F.col("rank").alias("nth"))
    # a gap's pieces lie one after another: at most capacity of them
    pairs = pairs.groupBy("part", "rank").agg(F.array_sort(F.collect_list(F.struct("nth", "key", "length"))).alias("pieces"))
    start = F.struct((capacity - F.col("size")).alias("at"), F.array().cast("array<struct<key:bigint,offset:bigint>>").alias("out"))
    laid = F.aggregate("pieces", start, lambda s, p: F.struct((s["at"] + p["length"]).alias("at"), F.concat(s["out"], F.array(F.struct(p["key"].alias("key"), s["at"].alias("offset")))).alias("out")))
    used = state(OVER).join(pairs, ["part", "rank"], "left").withColumn("laid", F.when(F.col("pieces").isNotNull(), laid))

    # what found no gap
    without = state(LEFT).join(F.broadcast(spark.createDataFrame([*taken.items()], "part int, taken long")), "part", "left").where(F.col("rank") >= F.coalesce("taken", F.lit(0)))
    rest = without.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.sum((F.col("size") * 2 > capacity).cast("long")).alias("big"), F.min("size").alias("least")).orderBy("part").collect()
    waiting, total = sum(r["n"] for r in rest), sum(r["total"] for r in rest)
    free = sum(r["total"] for r in found if r["state"] in (OVER, SMALL)) - (sum(r["total"] for r in of(LEFT).values()) - total)
    if not of(PLACED) and not met:
        free = 0  # no gap holds any of it
    # the largest open as many sequences as all of it needs at least
    opening = max(-(-(total - free) // capacity), sum(r["big"] for r in rest))
    first, opened = max(0, opening), {}
    for r in rest:
        opened[r["part"]] = taken.get(r["part"], 0) + min(first, r["n"])
        first -= min(first, r["n"])
    without = without.join(F.broadcast(spark.createDataFrame([*opened.items()], "part int, opened long")), "part").withColumn("opens", F.col("rank") < F.col("opened"))

    pieces = "array<struct<key:bigint,offset:bigint>>"
    row = lambda df, size, kind, key, out=F.lit(None): df.select(size.cast("long").alias("size"), F.lit(kind).alias("kind"), key.alias("key"), out.cast(pieces).alias("pieces"))
    step = row(used, F.coalesce(capacity - F.col("laid.at"), F.col("size")), GAP, F.col("key"), F.col("laid.out"))
    step = step.unionByName(row(state(SMALL), F.col("size"), GAP, F.col("key")))
    step = step.unionByName(row(without.where("opens"), capacity - F.col("size"), GAP, F.col("key"), F.array(F.struct("key", F.lit(0).cast("long").alias("offset")))))
    step = written(step.unionByName(row(without.where("not opens"), F.col("size"), PIECE, F.col("key"))), "step")
    more = step.select(F.col("key").alias("sequence"), F.explode("pieces").alias("p"))
    placed = placed.unionByName(more.select("p.key", "sequence", "p.offset"))
    waiting -= min(max(0, opening), waiting)
    if not waiting:
        return placed, None, 0
    # a gap that is smaller than all that is left stays as it is
    least = min(r["least"] for r in rest)
    gaps = sum(r["n"] for r in found if r["state"] in (OVER, SMALL)) + max(0, opening)
    return placed, step.where(F.col("size") >= least).select("size", "kind", "key"), waiting + gaps


def best_fit_pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rows: int = RANGE) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  Null texts count as empty: end_id alone.  Null ids and repeated rows
    are packed as documents of their own; other columns are left out.

    Ranges hold about `rows` pieces and gaps.  They are told apart by size and
    then by a key of its own for every piece, so equal lengths and repeated rows
    fall to many ranges.
    """
    pieces = written(measured(docs, path, pattern, capacity, end_id, id_col, text_col), "pieces")
    n = pieces.count()
    placed = docs.sparkSession.createDataFrame([], "key long, sequence long, offset long")
    items = pieces.select(F.col("length").alias("size"), F.lit(PIECE).alias("kind"), "key")
    while n:
        found, items, n = _superstep(items, n, capacity, rows)
        placed = placed.unionByName(found)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), F.col("offset"))
