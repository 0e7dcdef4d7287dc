"""Quality classifier: random Fourier features of document statistics, ridge
scores by partition-summed normal equations, isotonic calibration.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process, slices, written

#: Marks whose shares are statistics of their own.
MARKS = "!?.,:;|#%&*$@_-=/'\"()[]{}<>0123456789"
NAMES = ["log_bytes", "log_words", "word_mean", "word_spread", "distinct", "lines", "line_mean", "line_repeats", "packed", "upper", "lower", "space", "newline", "digit", "high", "controls"] + [f"mark{i}" for i in range(len(MARKS) - 10)]


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; an empty one has zeros."""
    import math

    import numpy as np
    import zstandard

    if not text:
        return [0.0] * len(NAMES)
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    w = max(1, len(words))
    packed = len(per_process("zstd", lambda: zstandard.ZstdCompressor(level=1)).compress(data))
    out = [math.log1p(n), math.log1p(len(words)), float(sizes.mean()), float(sizes.std()), len(set(words)) / w, math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), min(packed / n, 2.0)]
    share = h / n
    out += [float(x) for x in (share[65:91].sum(), share[97:123].sum(), share[32], share[10], share[48:58].sum(), share[128:].sum(), share[:9].sum() + share[11:32].sum())]
    # a mark's share is at most one per word: counted by word, where the statistic doesn't thin out
    out += [min(2.0, float(h[ord(m)]) / w) for m in MARKS if not m.isdigit()]
    return out


def _measure(carry: list[str]):
    def run(batches):
        for b in slices(batches, 256):
            rows = [statistics(t or "") for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(NAMES)
            carried = [b.column(b.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([b.column(0), *carried, *(pa.array(c, pa.float64()) for c in columns)], names=["doc_id", *carry, *NAMES])

    return run


class Fourier:
    """Random features whose inner products approximate a Gaussian kernel."""

    def __init__(self, mean, spread, features: int, width: float, seed: int):
        import numpy as np

        r = np.random.RandomState(seed)
        self.mean, self.spread = np.array(mean), np.array(spread)
        self.w = r.standard_normal((len(mean), features)) / (width * len(mean) ** 0.5)
        self.b = r.uniform(0, 2 * np.pi, features)

    def __call__(self, x):
        import numpy as np

        z = np.clip((x - self.mean) / self.spread, -6, 6)
        phi = np.cos(z @ self.w + self.b) * (2 / len(self.b)) ** 0.5
        return np.hstack([np.ones((len(x), 1)), phi])


def _matrix(batch, names):
    import numpy as np

    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names])


#: Folds of the training rows for calibration.
FOLDS = 4
#: Sums that one task adds up.
FAN_IN = 16


def _normal(fourier):
    """Per partition and fold: the sums of phi phi' and phi y."""

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        total = {}
        for b in slices(batches, 4096):
            phi, y, fold = fourier(_matrix(b, NAMES)), _matrix(b, ["y"]), b.column(b.schema.get_field_index("fold")).to_numpy()
            for k in np.unique(fold).tolist():
                own = phi[fold == k]
                total[k] = total.get(k, 0) + np.hstack([own.T @ own, own.T @ y[fold == k]])
        task = TaskContext.get()
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId() if task else 0], pa.int64()), pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "fold", "sums"])

    return run


def _add(key, t):
    import numpy as np

    total = sum(np.frombuffer(x.as_buffer()) for x in t.column("sums"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "fold": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _added(sums: DataFrame, parts: int) -> DataFrame:
    """Sums of at most `parts` partitions, added up FAN_IN at a time until few are left."""
    while parts > 4:
        parts = -(-parts // FAN_IN)
        sums = sums.select(F.floor(F.col("part") / FAN_IN).alias("part"), "fold", "sums").groupBy("part", "fold").applyInArrow(_add, "part long, fold int, sums binary")
    return sums


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """(x, sum of y, count) in order of x to the knots of the non-decreasing fit."""
    blocks: list[list[float]] = []
    for x, y, n in points:
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def _score(fourier, weights, knots, carry):
    def run(batches):
        import numpy as np

        for b in slices(batches, 256 if carry else 4096):
            if weights is None:
                s = np.full(b.num_rows, 0.5)
            else:
                raw = np.clip(fourier(_matrix(b, NAMES)) @ weights, -1, 2)
                # the last thousandth keeps the order within flat stretches
                s = 0.999 * np.interp(raw, *knots) + 0.001 * (raw + 1) / 3
            carried = [b.column(b.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([b.column(0), *carried, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", *carry, "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = 300, width: float = 1.0, ridge: float = 1e-3, bins: int = 2000, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, and its columns
    named in `carry`.

    Learns only from labelled rows whose crc32(id as text) mod 3 is not 1; all of
    them, without a sample.  What is gathered is of fixed size: means, a square of
    features + 1 for each of FOLDS folds, added up by a tree, and a histogram of
    `bins`.  The calibration sees only scores of rows by weights that were fitted
    without their fold.

    Null and empty texts have a score of their own statistics (zeros).  Rows with
    a null id are scored and neither train nor are held out.  Labels other than 0
    and 1 are ignored; a document labelled more than once counts with the mean.
    Repeated rows return a row each.  Without any usable label all scores are 0.5.
    """
    import numpy as np

    carry = list(carry)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c for c in carry if c != "text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*carry).schema)
    measured = written(rows.mapInArrow(_measure(carry), f"doc_id long, {kept}" + ", ".join(f"{c} double" for c in NAMES)), "statistics")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))

    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held)
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = measured.join(known, "doc_id")
    moments = measured.agg(*(F.avg(c).alias(f"m_{c}") for c in NAMES), *(F.stddev_pop(c).alias(f"s_{c}") for c in NAMES)).first()
    fourier, weights, knots = None, None, None
    if moments[0] is not None:
        fourier = Fourier([moments[f"m_{c}"] for c in NAMES], [moments[f"s_{c}"] or 1.0 for c in NAMES], features, width, seed)
        train = train.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")).select(*NAMES, "y", "fold")
        sums = train.mapInArrow(_normal(fourier), "part long, fold int, sums binary")
        parts = max(measured.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        by_fold = {}
        for r in _added(sums, parts).collect():
            by_fold[r["fold"]] = by_fold.get(r["fold"], 0) + np.frombuffer(r["sums"])
        if by_fold:
            size = features + 1
            total = sum(by_fold.values())

            def solved(sums):
                square = sums.reshape(size, size + 1)
                return np.linalg.solve(square[:, :size] + ridge * max(square[0, 0], 1.0) / size * np.eye(size), square[:, size])

            weights = solved(total)
            # a row is calibrated by the weights of the folds that it isn't in
            without = {k: solved(total - own) if len(by_fold) > 1 else weights for k, own in by_fold.items()}
            raw = train.mapInArrow(_raw(fourier, without), "raw double, y double")
            bin_of = F.floor((F.col("raw") + 1) / 3 * bins)
            points = raw.groupBy(bin_of.alias("k")).agg(F.avg("raw").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("k").collect()
            knots = isotonic([(p["x"], p["y"], p["n"]) for p in points])
    scored = measured.mapInArrow(_score(fourier, weights, knots, carry), f"doc_id long, {kept}score double, predicted int")
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", *carry)


def _raw(fourier, without):
    def run(batches):
        import numpy as np

        for b in slices(batches, 4096):
            phi, fold = fourier(_matrix(b, NAMES)), b.column(b.schema.get_field_index("fold")).to_numpy()
            raw = np.zeros(len(phi))
            for k in np.unique(fold).tolist():
                raw[fold == k] = phi[fold == k] @ without[k]
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(raw, -1, 2)), b.column(b.schema.get_field_index("y"))], names=["raw", "y"])

    return run
