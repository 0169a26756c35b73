"""Table operations that keep a labelled table's semantics on Spark.

Null group keys are dropped, null join keys match, nulls sort last in either direction,
ties keep the first row, an empty sum is 0, a comparison with a missing value is unequal.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pairs of null keys that a task of a join makes, and tasks that make them; with more pairs than that, tasks have more.
PAIRS = 1 << 24
TASKS = 10_000
# Rows that a task writes for them, each once for every block of the other side.
COPIES = 1 << 20


def order(*columns: str, descending: bool = False) -> list[Column]:
    """Nulls last either way."""
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]


def top_k(df: DataFrame, column: str, k: int, tie: str, largest: bool = True) -> DataFrame:
    """The k rows of largest (or least) value; equal values in order of ``tie``."""
    return df.orderBy(*order(column, descending=largest), F.col(tie)).limit(k)


def capped(df: DataFrame, cap: int = 200) -> tuple[DataFrame, bool]:
    """At most ``cap`` rows, and whether there were more."""
    return df.limit(cap), df.limit(cap + 1).count() > cap


def differs(a: Column, b: Column) -> Column:
    """Unequal, or one of them missing."""
    return F.coalesce(a != b, F.lit(True))


def stock_consistency(df: DataFrame) -> DataFrame:
    """Rows whose stated stock isn't opening + in - sold, with what was expected; the table itself stays as it is."""
    need = ["product_id", "product_name", "opening_stock", "stock_in", "units_sold", "hand_in_stock"]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    expected = F.col("opening_stock") + F.col("stock_in") - F.col("units_sold")
    rows = df.withColumn("expected_hand_in_stock", expected)
    return rows.where(differs(F.col("hand_in_stock"), F.col("expected_hand_in_stock"))).withColumn("difference", F.col("hand_in_stock") - F.col("expected_hand_in_stock"))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, total stock, total value, inconsistent rows; null where columns are missing."""
    has = set(df.columns)
    expected = F.col("opening_stock") + F.col("stock_in") - F.col("units_sold")
    whole = {"product_id", "product_name", "opening_stock", "stock_in", "units_sold", "hand_in_stock"} <= has
    return df.agg(
        F.count("*").alias("n_rows"),
        (F.coalesce(F.sum("hand_in_stock"), F.lit(0)) if "hand_in_stock" in has else F.lit(None).cast("bigint")).alias("total_stock"),
        (F.coalesce(F.sum("cost_price_total_usd"), F.lit(0)) if "cost_price_total_usd" in has else F.lit(None).cast("bigint")).alias("total_value"),
        (F.count_if(differs(F.col("hand_in_stock"), expected)) if whole else F.lit(None).cast("bigint")).alias("n_inconsistent"),
    )


def group_agg(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(*aggregates)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``values`` of a column by row; 0 where there are none."""
    return df.dropna(subset=[row, column]).groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def with_margins(counts: DataFrame, row: str, values: list) -> DataFrame:
    """A crosstab with an ``All`` column and an ``All`` row; the row names become text."""
    every = reduce(add, [F.col(f"`{v}`") for v in values])
    wide = counts.select(F.col(row).cast("string").alias(row), *[F.col(f"`{v}`") for v in values], every.alias("All"))
    return wide.unionByName(wide.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(str(c)) for c in [*values, "All"]]).withColumn(row, F.lit("All")))


def pivot(df: DataFrame, row: str, column: str, values: list, aggregate: Column) -> DataFrame:
    """Any aggregate of ``values`` of a column by row; null where there are no rows."""
    return df.dropna(subset=[row, column]).groupBy(row).pivot(column, values).agg(aggregate)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    return df.dropna(subset=[row, column]).groupBy(row).pivot(column, values).agg(F.avg(value))


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other.

    Every null key meets every other, so pairs grow with the square of the input: where one task can't have them all, they are made apart.
    """
    if how == "cross":
        return left.crossJoin(right)
    a, b = left[left_on], right[right_on]
    whole = left.join(right, a.eqNullSafe(b), how)
    if "semi" in how or "anti" in how:
        return whole
    m = right.where(b.isNull()).count()
    n = left.where(a.isNull()).count() if m else 0
    if n * m <= PAIRS:
        return whole
    # with null keys on both sides, none of them stays alone, whatever the kind of join
    known = left.where(a.isNotNull()).join(right.where(b.isNotNull()), a == b, how)
    return known.union(_product(left.where(a.isNull()), right.where(b.isNull()), n, m))


def _product(left: DataFrame, right: DataFrame, n: int, m: int) -> DataFrame:
    """All pairs of ``n`` and ``m`` rows: blocks of each side meet in tasks of about ``PAIRS``, and only the smaller side's block is held."""
    pairs = max(PAIRS, n * m // TASKS)
    held = min(n, m, math.isqrt(pairs))
    across = -(-n // (held if n <= m else pairs // held))
    down = -(-m // (pairs // held if n <= m else held))

    def dealt(rows: DataFrame, copies: int, blocks: int, cells) -> DataFrame:
        """Rows by hash in one of the blocks, once for each cell of it; equal rows are numbered, so a task that runs again deals alike."""
        rows = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])
        numbered = rows.repartition(-(-copies // COPIES), *rows.columns).withColumn("_n", F.row_number().over(Window.partitionBy(*rows.columns).orderBy(F.lit(0))))
        block = F.pmod(F.xxhash64(*numbered.columns), F.lit(blocks)).cast("int")
        return numbered.select(*rows.columns, F.explode(cells(block)).alias("_cell")).repartitionById(across * down, F.col("_cell"))

    a = dealt(left, n * down, across, lambda i: F.sequence(i * down, i * down + down - 1))
    b = dealt(right, m * across, down, lambda j: F.sequence(j, j + (across - 1) * down, F.lit(down)))
    a, b = (a.hint("shuffle_hash"), b) if n <= m else (a, b.hint("shuffle_hash"))
    return a.join(b, "_cell").drop("_cell")


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_of_each(df: DataFrame, keys: list[str], *by: Column | str) -> DataFrame:
    """One row for each key, the first in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, variable, value)


def dummies(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).alias(f"{column}_{v}") for v in values])


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins: (edge, next edge]; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Values at the shares of the sorted column, straight lines between neighbours; nulls don't count.

    An approximate sketch brackets the two ranks of each share within a few ten-thousandths of the rows, and only the values of the
    brackets are counted exactly: no task holds all distinct values.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    edges = sorted({e for s in shares for e in (max(0.0, s - 0.001), min(1.0, s + 0.001))})
    ends = rows.agg(F.count("*").alias("n"), F.percentile_approx("v", edges, 10_000).alias("at")).first()
    if not ends["n"]:
        return [None] * len(shares)
    at = dict(zip(edges, ends["at"], strict=True))
    out: list[float | None] = []
    for share in shares:
        lo, hi = at[max(0.0, share - 0.001)], at[min(1.0, share + 0.001)]
        below = rows.where(F.col("v") < lo).count()
        rank = share * (ends["n"] - 1) - below
        inside = rows.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("c"))
        upto = inside.withColumn("upto", F.sum("c").over(Window.orderBy("v")))
        first, second = int(rank), int(-(-rank // 1))
        pair = upto.agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > second, F.col("v"))).alias("b")).first()
        out.append(pair["a"] + (pair["b"] - pair["a"]) * (rank - first))
    return out


def qcut(df: DataFrame, column: str, q: int, name: str = "bin") -> DataFrame:
    """Bins of about equal counts between exact percentiles; the least value belongs to bin 0."""
    edges = exact_quantiles(df, column, [i / q for i in range(1, q)])
    above = [(F.col(column) > e).cast("int") for e in edges if e is not None]
    return df.withColumn(name, F.when(F.col(column).isNotNull(), sum(above[1:], above[0]) if above else F.lit(0)))


def rank(column: str, method: str = "average", partition: list[str] = ()) -> Column:
    """Ranks of ascending values; ties share their average, least or dense rank, or go by row with ``first``."""
    w = Window.partitionBy(*partition).orderBy(F.col(column).asc_nulls_last())
    if method == "average":
        ties = F.count("*").over(Window.partitionBy(*partition, column))
        return F.rank().over(w) + (ties - 1) / 2
    return {"min": F.rank, "dense": F.dense_rank, "first": F.row_number}[method]().over(w)


def rolling_mean(column: str, n: int, partition: list[str], by: str) -> Column:
    """Mean of the last n rows; null for the first n - 1."""
    w = Window.partitionBy(*partition).orderBy(by).rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) == n, F.avg(column).over(w))


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def modulo(a: Column, b: Column) -> Column:
    """With the divisor's sign."""
    return a - F.floor(a / b) * b


def zfill(text: Column, width: int) -> Column:
    """Zeros before the digits, behind a sign."""
    sign = F.when(text.rlike("^[+-]"), F.substring(text, 1, 1)).otherwise("")
    return F.when(F.length(text) >= width, text).otherwise(F.concat(sign, F.lpad(F.substring(text, F.length(sign) + 1, F.length(text)), F.greatest(F.lit(width) - F.length(sign), F.lit(0)), F.lit("0"))))


def sample_skew(column: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(column: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(column)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))
