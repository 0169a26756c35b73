"""What the methods of labelled tables and columns do, on Spark.

Rows have no order of their own here, so whatever depends on one takes the columns that give it.  Missing
values are nulls; NaN is a number that poisons plain aggregates and is skipped by the ``nan_`` ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

# --- order, position, samples


def along(partition: list[str], by: list[str]) -> WindowSpec:
    """Rows of a group in their order, nulls last."""
    return Window.partitionBy(*partition).orderBy(*[F.col(c).asc_nulls_last() for c in by])


def rows_between(df: DataFrame, by: list[str], start: int, stop: int) -> DataFrame:
    """Rows start to stop (excluded) in the order of ``by``."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in by]).offset(start).limit(max(0, stop - start))


def tail(df: DataFrame, by: list[str], k: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in by]).limit(k)


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the least seeded hashes of a unique key: the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


# --- missing values


def missing(value: Column, floating: bool = False) -> Column:
    """Null, or NaN in a column of floating numbers."""
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def fill_forward(column: str, partition: list[str], by: list[str]) -> Column:
    return F.last(column, ignorenulls=True).over(along(partition, by).rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(column: str, partition: list[str], by: list[str]) -> Column:
    return F.first(column, ignorenulls=True).over(along(partition, by).rowsBetween(0, Window.unboundedFollowing))


def interpolated(df: DataFrame, column: str, partition: list[str], by: list[str], name: str) -> DataFrame:
    """``df`` and under a new name straight lines by position between known values; nulls at the start stay, those at the end take the last value."""
    w = along(partition, by)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    numbered = df.withColumn("_n", F.row_number().over(w)).withColumn("_at", F.when(F.col(column).isNotNull(), F.col("_n")))
    lo, hi = F.last(column, True).over(before), F.first(column, True).over(after)
    lo_at, hi_at = F.max("_at").over(before), F.min("_at").over(after)
    line = F.when(F.col("_at").isNotNull() | hi.isNull(), lo).otherwise(lo + (hi - lo) * (F.col("_n") - lo_at) / (hi_at - lo_at))
    return numbered.withColumn(name, line).drop("_n", "_at")


def replaced(value: Column, old_new: dict) -> Column:
    """Values that the mapping has, changed; others as they are."""
    out = value
    for old, new in reversed(old_new.items()):
        out = F.when(value.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(out)
    return out


# --- along a group


def shifted(column: str, n: int, partition: list[str], by: list[str]) -> Column:
    """The value n rows before (after, if n is negative)."""
    return F.lag(column, n).over(along(partition, by)) if n >= 0 else F.lead(column, -n).over(along(partition, by))


def changed_share(column: str, partition: list[str], by: list[str]) -> Column:
    """Change against the row before, as part of it."""
    before = F.lag(column).over(along(partition, by))
    return F.col(column).cast("double") / before - 1


def running(column: str, how: str, partition: list[str], by: list[str]) -> Column:
    """Sum, maximum, minimum or product of a group's rows so far; null where the row's own value is."""
    w = along(partition, by).rowsBetween(Window.unboundedPreceding, 0)
    over = {"sum": F.sum, "max": F.max, "min": F.min, "prod": F.product, "mean": F.avg, "count": F.count}[how](column).over(w)
    return F.when(F.col(column).isNotNull(), over)


def rolling(column: str, how: str, n: int, partition: list[str], by: list[str], least: int | None = None) -> Column:
    """Of the last n rows, null with fewer than ``least`` (n, if not given) values."""
    w = along(partition, by).rowsBetween(-(n - 1), 0)
    value = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}[how](column).over(w)
    return F.when(F.count(column).over(w) >= (n if least is None else least), value)


def expanding(column: str, how: str, partition: list[str], by: list[str], least: int = 1) -> Column:
    w = along(partition, by).rowsBetween(Window.unboundedPreceding, 0)
    value = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}[how](column).over(w)
    return F.when(F.count(column).over(w) >= least, value)


def exponential_mean(column: str, alpha: float, partition: list[str], by: list[str]) -> Column:
    """Weighted mean with weights (1 - alpha)^age.

    Rows so old that their weight is below a double's resolution are left out, so a row looks back a bounded number of rows.
    """
    reach = 1 if alpha >= 1 else math.ceil(math.log(1e-17) / math.log(1 - alpha))
    held = F.collect_list(F.col(column).cast("double")).over(along(partition, by).rowsBetween(-reach, 0))
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("w"))
    keep = 1 - alpha
    return F.aggregate(held, start, lambda a, v: F.struct((a["x"] * keep + v).alias("x"), (a["w"] * keep + 1.0).alias("w")), lambda a: a["x"] / a["w"])


def nth(df: DataFrame, keys: list[str], by: list[str], n: int) -> DataFrame:
    """The row number n, from 0, of each group; rows without a key are in none."""
    return df.dropna(subset=keys).withColumn("_n", F.row_number().over(along(keys, by))).where(F.col("_n") == n + 1).drop("_n")


def number_in_group(keys: list[str], by: list[str]) -> Column:
    return F.row_number().over(along(keys, by)) - 1


def repeated(keys: list[str], by: list[str]) -> Column:
    """Whether a row with the same keys comes before."""
    return F.row_number().over(along(keys, by)) > 1


def first_known(column: str, by: list[str]) -> Column:
    """Aggregate: the first value of a group that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(*by)))


def last_known(column: str, by: list[str]) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*by)))


def spread_back(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with its group's aggregates on every row, null for rows without a key.

    By a join with the aggregated table: a common key is pre-aggregated, and AQE splits its join.
    """
    sums = df.dropna(subset=keys).groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(sums, keys, "left")


def groups_where(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """The rows of the groups whose aggregate condition holds."""
    return df.join(df.dropna(subset=keys).groupBy(*keys).agg(condition.alias("_c")).where("_c").drop("_c"), keys, "left_semi")


# --- shapes


def combine_first(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Values of ``left``, where it has none those of ``right``, of all keys of either."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, f in (("a", left), ("b", right)) if c in f.columns]).alias(c)
    return a.join(b, on, "full").select(*[pick(c) for c in names])


def compared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, self, other: a row for each value that differs between tables with the same keys; two nulls don't."""
    own = [c for c in left.columns if c not in keys]
    both = left.alias("a").join(right.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("self"), F.col(f"b.{c}").cast("string").alias("other")) for c in own])
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.explode(pairs).alias("x")).select(*keys, "x.*").where(~F.col("self").eqNullSafe(F.col("other")))


def stacked(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, value, without missing values."""
    return df.unpivot(keys, columns, "column", "value").where("value IS NOT NULL")


def unstacked(df: DataFrame, keys: list[str], column: str, value: str, names: list) -> DataFrame:
    """A column for each of ``names``; keys and names are unique together."""
    return df.groupBy(*keys).pivot(column, names).agg(F.first(value))


def transposed(df: DataFrame, key: str, columns: list[str], names: list) -> DataFrame:
    """The columns as rows and the listed keys as columns."""
    return df.where(F.col(key).isin(names)).unpivot(key, columns, "column", "value").groupBy("column").pivot(key, names).agg(F.first("value"))


def resampled(df: DataFrame, time: str, unit: str, **aggregates: Column) -> DataFrame:
    """A row for each day, hour or so from the first to the last, those without rows too: counts and sums are 0 there.

    Only the two ends are gathered; the bins between are made from them.
    """
    bins = df.groupBy(F.date_trunc(unit, time).alias("bin")).agg(*[a.alias(n) for n, a in aggregates.items()])
    ends = df.agg(F.date_trunc(unit, F.min(time)).alias("a"), F.date_trunc(unit, F.max(time)).alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("bin"))
    return spine.join(bins, "bin", "left").select("bin", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in aggregates])


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, p25, p50, p75, max; quartiles are exact."""
    def one(c: str) -> Column:
        q = F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(c).cast("double").alias("max"))

    return df.agg(F.array(*map(one, columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.join(counts.agg(F.max("count").alias("count")), "count").select(column)


# --- numbers


def to_number(text: Column) -> Column:
    """A number, or null for what doesn't read as one."""
    return F.when(F.trim(text).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.trim(text).try_cast("double"))


def nan_min(column: str) -> Column:
    return F.min(F.when(~F.isnan(column), F.col(column)))


def nan_max(column: str) -> Column:
    return F.max(F.when(~F.isnan(column), F.col(column)))


def nan_mean(column: str) -> Column:
    return F.avg(F.when(~F.isnan(column), F.col(column)))


def nan_sum(column: str) -> Column:
    return F.coalesce(F.sum(F.when(~F.isnan(column), F.col(column))), F.lit(0.0))


def nan_median(column: str) -> Column:
    return F.median(F.when(~F.isnan(column), F.col(column)))


def poisoned(aggregate: Column, column: str) -> Column:
    """An aggregate that is NaN if any value is."""
    return F.when(F.bool_or(F.isnan(column)), F.lit(float("nan"))).otherwise(aggregate)


def is_close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), F.lit(False))


def is_finite(a: Column) -> Column:
    return ~F.isnan(a) & (F.abs(a) < float("inf"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lo, hi, n of equal widths from the least to the greatest value; the last bin has both its ends."""
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).where("a IS NOT NULL")
    # equal ends make bins about the value
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.floor((F.col(column) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / bins
    spine = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b").select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"))
    return spine.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sorted_values(values: Column) -> Column:
    return F.array_sort(values)


def sorting_order(values: Column) -> Column:
    """Places, from 0, in the order of the values; equal ones as they stand."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda x: x["i"])


def unique_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def steps(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """n numbers from start to stop, both included: (position, value)."""
    return spark.range(n).select(F.col("id").alias("position"), (F.lit(float(start)) + F.col("id") * ((stop - start) / max(1, n - 1))).alias("value"))


def stepped(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """start, start + step, ... before stop."""
    return spark.range(start, stop, step).select(F.col("id").alias("value"))


def date_range(spark: SparkSession, start: str, end: str, every: str = "1 day") -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval {every})")).alias("at"))


# --- text and time


def title(text: Column) -> Column:
    """Letters after anything but a letter in upper case, all others in lower case."""
    chars = F.split(F.lower(text), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def sliced(text: Column, start: int, stop: int | None = None) -> Column:
    """Characters start to stop (excluded) from 0; negative ones count from the end."""
    n = F.length(text)
    at = lambda k: F.lit(k) if k >= 0 else F.greatest(n + k, F.lit(0))
    end = n if stop is None else at(stop)
    return F.when(text.isNotNull(), F.substring(text, at(start) + 1, F.greatest(end - at(start), F.lit(0))))


def part_of(text: Column, separator: str, k: int) -> Column:
    """Part k, from 0, of a text cut at a literal separator; null if there are fewer."""
    return F.get(F.split(text, F.lit("\\Q" + separator + "\\E")), F.lit(k))


def padded(text: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Filled to ``width``, never cut."""
    room = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    if side == "left":
        return F.concat(F.repeat(F.lit(fill), room), text)
    if side == "right":
        return F.concat(text, F.repeat(F.lit(fill), room))
    # of an odd number the one more goes left if the width is odd
    left = (room / 2).cast("int") + F.when((room % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
    return F.concat(F.repeat(F.lit(fill), left), text, F.repeat(F.lit(fill), room - left))


def literal_replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def time_parts(at: Column) -> dict[str, Column]:
    """Year to hour, quarter, weekday from Monday as 0, its name, and the days of the month."""
    return {
        "year": F.year(at),
        "month": F.month(at),
        "day": F.dayofmonth(at),
        "hour": F.hour(at),
        "quarter": F.quarter(at),
        "weekday": F.weekday(at),
        "day_name": F.date_format(at, "EEEE"),
        "days_in_month": F.dayofmonth(F.last_day(at)),
    }


# The directives of C's strftime and the letters of Spark's patterns.
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "j": "DDD", "%": "'%'"}


def strftime(at: Column, pattern: str) -> Column:
    """Text of a time by a pattern of C's directives."""
    out, quoted = "", ""

    def close() -> str:
        return "'" + quoted.replace("'", "''") + "'" if quoted else ""

    i = 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            if pattern[i + 1] not in _DIRECTIVES:
                raise ValueError(f"directive %{pattern[i + 1]} is not supported")
            out, quoted, i = out + close() + _DIRECTIVES[pattern[i + 1]], "", i + 2
        else:
            quoted, i = quoted + pattern[i], i + 1
    return F.date_format(at, out + close())


def to_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time, or null for what doesn't read as one."""
    return F.try_to_timestamp(text, F.lit(pattern))


def later(at: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    return at + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))
