"""kNN joins of a query table R and a training table S, exact and along space-filling curves.

Both take rows (id, q, target...): q is an array of bigint coordinates. Both give (r_id, s_id, d2, target, rank): the k nearest by
squared distance, then by s_id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.curves import curve_key
from tideline.functions.scaling import shifted
from tideline.operators.ranges import bucket_column, range_bounds

_BLOCK = 4096


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda t, d: t + d)


def nearest(pairs: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k pairs of the smallest (d2, s_id) of each r_id (and value of `by`), as rank 1..k."""
    w = Window.partitionBy(*by, "r_id").orderBy("d2", "s_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _coordinates(table: pa.Table) -> np.ndarray:
    q = table.column("q").combine_chunks()
    return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1)


def _distances(r: np.ndarray, s: np.ndarray, largest: int) -> np.ndarray:
    """Exact squared distances; largest bounds the coordinates' size."""
    bound = 4 * largest * largest * r.shape[1]
    if bound < 2**53:  # all terms are integers that a double holds
        x, y = r.astype(np.float64), s.astype(np.float64)
        return ((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T).astype(np.int64)
    out = np.zeros((len(r), len(s)), np.int64)
    if largest >= 2**62:
        raise ValueError("coordinates are too far apart for a bigint distance")
    for j in range(r.shape[1]):
        apart = r[:, j, None] - s[None, :, j]
        if bound >= 2**63 and int(np.abs(apart).max(initial=0)) ** 2 * r.shape[1] >= 2**63:
            raise ValueError("coordinates are too far apart for a bigint distance")
        out += apart * apart
    return out


def _block_join(k: int, by: str | None, differ: str | None):
    schema = pa.schema([*([(by, pa.int64())] if by else []), ("r_id", pa.int64()), ("s_id", pa.int64()), ("d2", pa.int64()), ("target", pa.float64())])
    far = np.iinfo(np.int64).max

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        r, s = _coordinates(left), _coordinates(right)
        ids = right.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        s, ids, targets = s[order], ids[order], right.column("target").to_numpy(zero_copy_only=False)[order]
        largest = max(abs(int(x)) for m in (r, s) for x in (m.min(initial=0), m.max(initial=0)))
        own = left.column("id").to_numpy()
        groups = [t.column("apart").to_numpy(zero_copy_only=False) for t in (left, right)] if differ else None
        n, parts = min(k, len(s)), []
        for low in range(0, len(r), 512):
            d2 = _distances(r[low : low + 512], s, largest)
            barred = groups[0][low : low + 512, None] == groups[1][order][None, :] if groups else None
            if int(d2.max()) < far // len(s) - 1:  # distance and place in one number: ids ascend, so ties fall to the smaller one
                rank = d2 * len(s) + np.arange(len(s))
                if barred is not None:
                    rank[barred] = far
                near = np.argpartition(rank, n - 1, axis=1)[:, :n]
            else:
                near = np.argsort(np.where(barred, far, d2) if barred is not None else d2, axis=1, kind="stable")[:, :n]
            at = np.arange(len(d2))[:, None]
            keep = ~barred[at, near] if barred is not None else np.ones(near.shape, bool)
            parts.append((np.broadcast_to(own[low : low + 512, None], near.shape)[keep], ids[near[keep]], d2[at, near][keep], targets[near[keep]]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        first = [np.full(len(columns[0]), left.column(by)[0].as_py())] if by else []
        return pa.table([pa.array(c, f.type) for c, f in zip([*first, *columns], schema, strict=True)], schema=schema)

    return join


def knn_exact(r: DataFrame, s: DataFrame, k: int, r_rows: int | None = None, s_rows: int | None = None, block: int = _BLOCK, by: str | None = None, differ: str | None = None) -> DataFrame:
    """Every query row against every training row, in square blocks: no pair becomes a row, each block pair keeps k rows a query.

    by: a bigint column of both; rows meet within its values only (candidates of a search). differ: an integer column of both; rows
    with the same value do not meet (folds), null meets all. Rows with null coordinates have no neighbours and are none."""
    n_r = max(1, math.ceil((r_rows if r_rows is not None else r.count()) / block))
    n_s = max(1, math.ceil((s_rows if s_rows is not None else s.count()) / block))

    def of(df: DataFrame, n: int, m: int, own: str, other: str) -> DataFrame:
        target = F.col("target").cast("double") if "target" in df.columns else F.lit(None).cast("double")
        extra = [F.col(by).cast("bigint").alias(by)] if by else []
        extra += [F.coalesce(F.col(differ).cast("bigint"), F.lit(-1 if own == "rb" else -2)).alias("apart")] if differ else []
        known = F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull())
        # new names, so that two sides made of one table do not share columns
        return df.where(known).select(F.col("id").alias("id"), F.col("q").alias("q"), target.alias("target"), *extra, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    keys = [*([by] if by else []), "rb", "sb"]
    left, right = of(r, n_r, n_s, "rb", "sb"), of(s, n_s, n_r, "sb", "rb")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_join(k, by, differ), f"{f'{by} bigint, ' if by else ''}r_id bigint, s_id bigint, d2 bigint, target double")
    return nearest(pairs, k, [by] if by else [])


def curve_positions(points: DataFrame, buckets: int | None = None, rate: float | None = None) -> DataFrame:
    """points (shift_id, key, src, id, ...) with pos: the number of S rows (src 1) at or before the row in order of (key, src, id).

    Two levels: a running count within ranges of keys, plus the ranges' own starts. The ranges' bounds come from a sort of the sampled
    rows of a shift in one task; no other task sees a whole shift. By default a range has about a million rows, there are 8 at least, and
    the sample has 1000 rows for each, so both follow the input. Equal keys fall into one range."""
    if buckets is None or rate is None:
        n = points.count()
        buckets = buckets or max(8, math.ceil(n / 1_000_000))
        rate = rate or min(1.0, 1000 * buckets / max(1, n))
    bounds = range_bounds(points, ["shift_id"], "key", buckets, rate)
    placed = points.withColumn("bucket", bucket_column(bounds, "shift_id", "key"))
    totals = placed.groupBy("shift_id", "bucket").agg(F.sum("src").alias("n"))  # a row for each range
    before = Window.partitionBy("shift_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shift_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shift_id", "bucket").orderBy("key", "src", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumn("own", F.sum("src").over(within))
    return counted.join(F.broadcast(starts), ["shift_id", "bucket"]).withColumn("pos", F.col("start") + F.col("own")).drop("start", "own", "bucket")


def knn_curve_candidates(r: DataFrame, s: DataFrame, k: int, vectors: Sequence[Sequence[int]], curve: str, bits: int, offset: int = 0, buckets: int | None = None, rate: float | None = None) -> DataFrame:
    """(r_id, s_id, d2, target): for each shift the k training rows before and the k after a query row on the curve, once each.

    Coordinates plus offset plus shift must be in 0..2**bits-1. The joins are equi-joins on curve positions, 2k for each query row
    and shift, whatever the sizes of R and S."""
    side = lambda df, src: df.select(F.lit(src).alias("src"), "id", "q", (F.col("target").cast("double") if src and "target" in df.columns else F.lit(None).cast("double")).alias("target"))
    both = side(r, 0).unionByName(side(s, 1))
    moved = [[x + offset for x in v] for v in vectors]
    points = shifted(both, moved).withColumn("key", curve_key(F.col("p"), curve, bits)).drop("p")
    placed = curve_positions(points, buckets, rate)
    asks = placed.where("src = 0").select("shift_id", F.col("id").alias("r_id"), F.col("q").alias("rq"), F.explode(F.sequence(F.col("pos") - (k - 1), F.col("pos") + k)).alias("pos"))
    rows = placed.where("src = 1").select("shift_id", "pos", F.col("id").alias("s_id"), F.col("q").alias("sq"), "target")
    met = asks.where("pos > 0").join(rows, ["shift_id", "pos"])
    pairs = met.select("r_id", "s_id", squared_distance(F.col("rq"), F.col("sq")).alias("d2"), "target")
    return pairs.groupBy("r_id", "s_id").agg(F.first("d2").alias("d2"), F.first("target").alias("target"))


def knn_curve(r: DataFrame, s: DataFrame, k: int, vectors: Sequence[Sequence[int]], curve: str, bits: int, offset: int = 0, buckets: int | None = None, rate: float | None = None) -> DataFrame:
    return nearest(knn_curve_candidates(r, s, k, vectors, curve, bits, offset, buckets, rate), k)


def coordinate_span(r: DataFrame, s: DataFrame, vectors: Sequence[Sequence[int]]) -> tuple[int, int]:
    """The offset that makes all coordinates 0 or more, and the bits that the largest shifted one needs."""
    ends = r.select("q").unionByName(s.select("q")).agg(F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    return -low, max(1, (high - low + max((max(v) for v in vectors), default=0)).bit_length())


def sample_rate(rows: int, epsilon: float) -> float:
    """min(1, 1 / (epsilon**2 * rows)): about 1 / epsilon**2 rows are expected."""
    return 1.0 if rows < 1 else min(1.0, 1 / (epsilon * epsilon * rows))


def sampled(points: DataFrame, rates: dict[int, float], seed: int) -> DataFrame:
    """A Bernoulli sample by source; it depends on the seed and the ids only, so it is the same in any partitioning and engine."""
    draw = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    rate = F.coalesce(*[F.when(F.col("src") == src, F.lit(float(x))) for src, x in rates.items()])
    return points.where(draw < rate)
