"""Statistics as Column expressions, and the few that need a whole group as Python functions over Arrow groups."""

from __future__ import annotations

from math import erfc, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The standard normal quantile at 0.975.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson score interval of k successes in n trials, clipped to [0, 1]; null without trials."""
    p, size = F.try_divide(k, n), n.cast("double")
    centre, spread = p + z * z / (2 * size), z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    scale = 1 + z * z / size
    bound = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return bound((centre - spread) / scale), bound((centre + spread) / scale)


def nearest_rank(column: str, q: float) -> Column:
    """An observed value: the smallest with at least the share q of the values at or below it. One group must fit a task; see the sketches for more."""
    values = F.sort_array(F.collect_list(column))
    return F.get(values, F.greatest(F.lit(0), F.ceil(F.size(values) * F.lit(q)) - 1).cast("int"))


def nearest_ranks(df: DataFrame, key: str, column: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column per share): nearest-rank percentiles per group. Values are counted before the shuffle, and a group's window runs over its distinct
    values only; nulls do not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy(column)
    running = counts.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(Window.partitionBy(key))})
    return running.groupBy(key).agg(*[F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(q))), F.col(column))).alias(name) for name, q in shares.items()])


def pool_adjacent(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Weighted non-decreasing least-squares fit of (x, y, weight): (x, fitted) in order of x."""
    blocks: list[list] = []
    for x, y, w in sorted(points):
        blocks.append([y, w, [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            weight = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / weight, weight, a[2] + b[2]])
    return [(x, y) for y, _, xs in blocks for x in xs]


def isotonic(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, n, fitted): a monotone fit of mean y on x per key. Rows are averaged per (key, x) first, so a group holds distinct x only."""
    means = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, x).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))

    def fit(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        fitted = dict(pool_adjacent([(r[x], r["mean"], r["n"]) for r in rows]))
        return pa.Table.from_pylist([{key: r[key], x: r[x], "n": r["n"], "fitted": fitted[r[x]]} for r in rows], schema=pa.schema([table.schema.field(key), table.schema.field(x), ("n", pa.int64()), ("fitted", pa.float64())]))

    kinds = dict(means.dtypes)
    return means.groupBy(key).applyInArrow(fit, f"`{key}` {kinds[key]}, `{x}` {kinds[x]}, n bigint, fitted double")


#: Below this many pairs the test is exact, below that it is resampled; how often, and what counts as a tie.
EXACT_BELOW, CLOSED_FORM_FROM, RESAMPLES, TIE = 20, 200, 9_999, 1e-12


def sign_flip_p(differences: list[float], seed: str) -> float | None:
    """Two-sided p of the paired sign-flip test: of all signs, of RESAMPLES drawn ones, or by the closed form; null without pairs."""
    import hashlib

    import numpy as np

    x = np.asarray(differences, dtype=np.float64)
    n, total = len(x), abs(float(x.sum())) if len(x) else 0.0
    if not n:
        return None
    least = total - TIE * float(np.abs(x).sum())
    if n < EXACT_BELOW:
        sums = np.zeros(1)
        for v in x:
            sums = np.concatenate([sums + v, sums - v])
        return float(np.mean(np.abs(sums) >= least))
    if n < CLOSED_FORM_FROM:
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(seed.encode()).digest()[:8], "big"))
        signs = rng.integers(0, 2, size=(RESAMPLES, n)) * 2 - 1
        return float((1 + np.sum(np.abs(signs @ x) >= least)) / (RESAMPLES + 1))
    squares = float((x * x).sum())
    return 1.0 if squares <= 0 else erfc(total / sqrt(squares) / sqrt(2))


@F.arrow_udf(DoubleType())
def _small_p(differences: pa.Array, seed: pa.Array) -> pa.Array:
    return pa.array([None if d is None else sign_flip_p(d, s or "") for d, s in zip(differences.to_pylist(), seed.to_pylist())], type=pa.float64())


@F.arrow_udf(DoubleType())
def _erfc(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else erfc(x) for x in column.to_pylist()], type=pa.float64())


def sign_flip(df: DataFrame, key: str, difference: str) -> DataFrame:
    """(key, n, mean, p) of paired differences. Groups of CLOSED_FORM_FROM pairs and more need their sums only, which are pushed below the
    shuffle; of smaller ones the differences themselves are gathered, fewer than that many a group."""
    sums = df.where(F.col(difference).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(difference).alias("s"), F.sum(F.col(difference) ** 2).alias("q"))
    few = df.join(sums.where(F.col("n") < CLOSED_FORM_FROM).select(key), key, "left_semi").where(F.col(difference).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.col(difference).cast("double"))).alias("d"))
    small = few.select(key, _small_p(F.col("d"), F.col(key).cast("string")).alias("small"))
    large = F.when(F.col("q") > 0, _erfc(F.abs("s") / F.sqrt("q") / F.lit(sqrt(2)))).otherwise(1.0)
    return sums.join(small, key, "left").select(key, "n", (F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") < CLOSED_FORM_FROM, F.col("small")).otherwise(large).alias("p"))
