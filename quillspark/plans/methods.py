"""Queries of the table and column methods (operators/frames.py), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, tabular
from .registry import query, table

#: Events in whole hundredths, some of them missing.
_E = "e AS (SELECT event_id, user_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS gap FROM events)"
_BY_USER = "PARTITION BY user_id ORDER BY event_id"


def _events(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", cents.alias("cents"), F.when(F.col("event_id") % 3 != 0, cents).alias("gap"))


_USER, _ORDER = ["user_id"], ["event_id"]


@query("b3_rows_between", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 25")
def b3_rows_between(spark, sf_dir):
    return frames.rows_between(table(spark, sf_dir, "orders"), ["o_orderkey"], 25, 65).select("o_orderkey", "o_custkey")


@query("b3_tail", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 12")
def b3_tail(spark, sf_dir):
    return frames.tail(table(spark, sf_dir, "orders"), ["o_orderkey"], 12).select("o_orderkey", "o_orderdate")


@query("b3_sample_size", "SELECT least(50, count(*)) AS n, least(50, count(*)) AS n_distinct FROM customer")
def b3_sample_size(spark, sf_dir):
    return frames.sample(table(spark, sf_dir, "customer"), "c_custkey", 50).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("n_distinct"))


@query("b2_assign_rename_drop_astype", "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_acctbal > 0 AS positive FROM customer")
def b2_assign_rename_drop_astype(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"})
    return rows.withColumns({"nation": F.col("c_nationkey").cast("string"), "positive": F.col("c_acctbal") > 0}).drop("c_nationkey", "c_acctbal", "c_mktsegment")


@query("b5_isin_between_mask", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN p_size END AS kept, CASE WHEN p_size BETWEEN 10 AND 20 THEN NULL ELSE p_size END AS masked FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def b5_isin_between_mask(spark, sf_dir):
    inside = F.col("p_size").between(10, 20)
    rows = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23"))
    return rows.select("p_partkey", F.when(inside, F.col("p_size")).alias("kept"), F.when(~inside, F.col("p_size")).alias("masked"))


@query("b6_fillna", f"WITH {_E} SELECT event_id, coalesce(gap, 0) AS filled FROM e")
def b6_fillna(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "gap").na.fill(0, ["gap"]).withColumnRenamed("gap", "filled")


@query("b6_dropna", f"WITH {_E} SELECT event_id, gap FROM e WHERE gap IS NOT NULL")
def b6_dropna(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "gap").dropna(subset=["gap"])


@query("b6_replace", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def b6_replace(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.replaced(F.col("o_orderstatus"), {"F": "done", "O": "open"}).alias("status"))


@query("b6_ffill_bfill", f"WITH {_E} SELECT event_id, last_value(gap IGNORE NULLS) OVER ({_BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward, first_value(gap IGNORE NULLS) OVER ({_BY_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM e")
def b6_ffill_bfill(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", frames.fill_forward("gap", _USER, _ORDER).alias("forward"), frames.fill_backward("gap", _USER, _ORDER).alias("backward"))


@query(
    "b6_interpolate",
    f"""WITH {_E}, n AS (SELECT *, row_number() OVER ({_BY_USER}) AS n FROM e), k AS (SELECT *, CASE WHEN gap IS NOT NULL THEN n END AS place FROM n),
        s AS (SELECT event_id, n, gap, last_value(gap IGNORE NULLS) OVER b AS lo, first_value(gap IGNORE NULLS) OVER a AS hi, max(place) OVER b AS lo_at, min(place) OVER a AS hi_at FROM k
              WINDOW b AS ({_BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({_BY_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_id, round(CASE WHEN gap IS NOT NULL OR hi IS NULL THEN lo ELSE lo + (hi - lo) * (n - lo_at) / (hi_at - lo_at) END, 4) AS line FROM s""",
)
def b6_interpolate(spark, sf_dir):
    return frames.interpolated(_events(spark, sf_dir), "gap", _USER, _ORDER, "line").select("event_id", F.round("line", 4).alias("line"))


@query("b7_duplicated", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS repeated FROM orders")
def b7_duplicated(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.repeated(["o_custkey"], ["o_orderkey"]).alias("repeated"))


@query("b7_drop_duplicates", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def b7_drop_duplicates(spark, sf_dir):
    return tabular.first_of_each(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("b8_transform", f"WITH {_E} SELECT event_id, sum(cents) OVER (PARTITION BY user_id) AS total, cents - max(cents) OVER (PARTITION BY user_id) AS below FROM e")
def b8_transform(spark, sf_dir):
    rows = frames.spread_back(_events(spark, sf_dir), _USER, total=F.sum("cents"), most=F.max("cents"))
    return rows.select("event_id", "total", (F.col("cents") - F.col("most")).alias("below"))


@query("b8_filter", f"WITH {_E} SELECT event_id FROM e WHERE user_id IN (SELECT user_id FROM e GROUP BY 1 HAVING avg(cents) > 2500 AND count(*) > 3)")
def b8_filter(spark, sf_dir):
    return frames.groups_where(_events(spark, sf_dir), _USER, (F.avg("cents") > 2500) & (F.count("*") > 3)).select("event_id")


@query("b8_nth_cumcount", f"WITH n AS (SELECT event_id, user_id, row_number() OVER ({_BY_USER}) - 1 AS number FROM events) SELECT user_id, event_id, number FROM n WHERE number = 2")
def b8_nth_cumcount(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("number", frames.number_in_group(_USER, _ORDER))
    return frames.nth(rows, _USER, _ORDER, 2).select("user_id", "event_id", "number")


@query("b8_first_last_known", f"WITH {_E} SELECT user_id, arg_min(gap, event_id) FILTER (WHERE gap IS NOT NULL) AS first_gap, arg_max(gap, event_id) FILTER (WHERE gap IS NOT NULL) AS last_gap, count(gap) AS n_gap, count(*) AS size FROM e GROUP BY 1")
def b8_first_last_known(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(frames.first_known("gap", _ORDER).alias("first_gap"), frames.last_known("gap", _ORDER).alias("last_gap"), F.count("gap").alias("n_gap"), F.count("*").alias("size"))


@query(
    "b9_rank_methods",
    f"""WITH {_E} SELECT event_id, rank() OVER w AS least, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS first FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""",
)
def b9_rank_methods(spark, sf_dir):
    first = F.row_number().over(frames.along(_USER, ["event_type", "event_id"]))
    return _events(spark, sf_dir).select("event_id", tabular.rank("event_type", "min", _USER).alias("least"), tabular.rank("event_type", "dense", _USER).alias("dense"), first.alias("first"))


@query("b10_shift_pct_change", f"WITH {_E} SELECT event_id, lag(cents, 2) OVER w AS before, lead(cents) OVER w AS after, round(CAST(cents AS DOUBLE) / nullif(lag(cents) OVER w, 0) - 1, 4) AS share FROM e WINDOW w AS ({_BY_USER})")
def b10_shift_pct_change(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("some", F.nullif("cents", F.lit(0)))
    share = F.col("cents").cast("double") / frames.shifted("some", 1, _USER, _ORDER) - 1
    return rows.select("event_id", frames.shifted("cents", 2, _USER, _ORDER).alias("before"), frames.shifted("cents", -1, _USER, _ORDER).alias("after"), F.round(share, 4).alias("share"))


@query("b10_changed_share", "SELECT o_orderkey, round(o_orderkey / lag(CAST(o_orderkey AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, 6) AS share FROM orders WHERE o_orderkey > 0")
def b10_changed_share(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey > 0")
    return rows.select("o_orderkey", F.round(frames.changed_share("o_orderkey", ["o_custkey"], ["o_orderkey"]), 6).alias("share"))


@query("b10_running", f"WITH {_E} SELECT event_id, CASE WHEN gap IS NOT NULL THEN max(gap) OVER w END AS most, CASE WHEN gap IS NOT NULL THEN min(gap) OVER w END AS least, CASE WHEN gap IS NOT NULL THEN CAST(sum(gap) OVER w AS BIGINT) END AS total FROM e WINDOW w AS ({_BY_USER})")
def b10_running(spark, sf_dir):
    run = lambda how: frames.running("gap", how, _USER, _ORDER)
    return _events(spark, sf_dir).select("event_id", run("max").alias("most"), run("min").alias("least"), run("sum").alias("total"))


@query("b10_cumprod", "SELECT l_orderkey, l_linenumber, l_partkey, round(product(1 + l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax ROWS UNBOUNDED PRECEDING), 8) AS growth FROM lineitem")
def b10_cumprod(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("factor", 1 + F.col("l_tax"))
    growth = frames.running("factor", "prod", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(growth, 8).alias("growth"))


@query(
    "b11_rolling_expanding",
    f"""WITH {_E} SELECT event_id, CASE WHEN count(cents) OVER r >= 4 THEN round(avg(cents) OVER r, 4) END AS mean4, CASE WHEN count(cents) OVER r >= 2 THEN max(cents) OVER r END AS max4, CASE WHEN count(cents) OVER w >= 3 THEN round(avg(cents) OVER w, 4) END AS mean_so_far
        FROM e WINDOW r AS ({_BY_USER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w AS ({_BY_USER} ROWS UNBOUNDED PRECEDING)""",
)
def b11_rolling_expanding(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(frames.rolling("cents", "mean", 4, _USER, _ORDER), 4).alias("mean4"), frames.rolling("cents", "max", 4, _USER, _ORDER, 2).alias("max4"), F.round(frames.expanding("cents", "mean", _USER, _ORDER, 3), 4).alias("mean_so_far"))


@query(
    "b11_ewm",
    f"""WITH {_E}, n AS (SELECT event_id, user_id, cents, row_number() OVER ({_BY_USER}) AS n FROM e)
        SELECT event_id, round(list_sum(list_transform(l, lambda x: x.c * power(0.7, m - x.n))) / list_sum(list_transform(l, lambda x: power(0.7, m - x.n))), 4) AS mean
        FROM (SELECT event_id, n AS m, list({{'c': cents, 'n': n}}) OVER ({_BY_USER} ROWS UNBOUNDED PRECEDING) AS l FROM n)""",
)
def b11_ewm(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(frames.exponential_mean("cents", 0.3, _USER, _ORDER), 4).alias("mean"))


@query(
    "b12_resample_spine",
    "WITH b AS (SELECT date_trunc('hour', ts) AS bin, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events WHERE event_id % 7 = 0 GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL 1 HOUR)) AS bin) SELECT s.bin, coalesce(n, 0) AS n, CAST(coalesce(cents, 0) AS BIGINT) AS cents FROM s LEFT JOIN b ON s.bin = b.bin",
)
def b12_resample_spine(spark, sf_dir):
    """Hours of the events of every seventh number, those without any too."""
    return frames.resampled(_events(spark, sf_dir).where("event_id % 7 = 0"), "ts", "hour", n=F.count("*"), cents=F.sum("cents"))


@query(
    "b13_describe",
    "".join(
        f"{' UNION ALL ' if i else ''}SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM part"
        for i, c in enumerate(("p_size", "p_retailprice"))
    ),
)
def b13_describe(spark, sf_dir):
    out = frames.described(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return out.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("b13_modes", "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size FROM c WHERE n = (SELECT max(n) FROM c)")
def b13_modes(spark, sf_dir):
    return frames.modes(table(spark, sf_dir, "part"), "p_size")


@query("b13_cov", "SELECT round(covar_samp(l_quantity, l_discount), 6) AS cov FROM lineitem")
def b13_cov(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cov"))


@query(
    "b14_text",
    """SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, starts_with(p_name, 'a') AS begins, ends_with(p_name, 'e') AS ends, replace(p_name, 'a.', 'x') AS replaced, string_split(p_name, ' ')[2] AS second, substr(p_name, 2, 3) AS part, right(p_name, 3) AS last3,
              lpad(CAST(p_size AS VARCHAR), CAST(greatest(5, length(CAST(p_size AS VARCHAR))) AS INT), '*') AS padded, p_brand || '-' || p_type AS joined, regexp_extract(p_brand, '#([0-9]+)', 1) AS number FROM part""",
)
def b14_text(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(name).alias("up"),
        F.length(name).alias("n"),
        F.startswith(name, F.lit("a")).alias("begins"),
        F.endswith(name, F.lit("e")).alias("ends"),
        frames.literal_replaced(name, "a.", "x").alias("replaced"),
        frames.part_of(name, " ", 1).alias("second"),
        frames.sliced(name, 1, 4).alias("part"),
        frames.sliced(name, -3).alias("last3"),
        frames.padded(F.col("p_size").cast("string"), 5, "left", "*").alias("padded"),
        F.concat_ws("-", "p_brand", "p_type").alias("joined"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"),
    )


@query("b14_title", "SELECT p_partkey, list_aggregate(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(x[i - 1:i - 1], '[a-z]') THEN upper(x[i:i]) ELSE x[i:i] END), 'string_agg', '') AS title FROM (SELECT p_partkey, lower(p_name || ' o''neil-' || p_brand) AS x FROM part)")
def b14_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", frames.title(F.concat("p_name", F.lit(" o'neil-"), "p_brand")).alias("title"))


@query("b14_zfill", "SELECT c_custkey, CASE WHEN v < 0 THEN '-' || lpad(CAST(-v AS VARCHAR), CAST(greatest(7, length(CAST(-v AS VARCHAR))) AS INT), '0') ELSE lpad(CAST(v AS VARCHAR), CAST(greatest(8, length(CAST(v AS VARCHAR))) AS INT), '0') END AS filled FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer)")
def b14_zfill(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tabular.zfill(F.floor("c_acctbal").cast("string"), 8).alias("filled"))


@query(
    "b15_time",
    """SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, quarter(ts) AS quarter, isodow(ts) - 1 AS weekday, dayname(ts) AS day_name, day(last_day(ts)) AS days_in_month, strftime(ts, '%d/%m/%Y at %H:%M') AS shown, date_trunc('hour', ts) AS floored FROM events""",
)
def b15_time(spark, sf_dir):
    at = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in frames.time_parts(at).items()], frames.strftime(at, "%d/%m/%Y at %H:%M").alias("shown"), F.date_trunc("hour", at).alias("floored"))


@query("b16_combine_first", "SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, s_nationkey) AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def b16_combine_first(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return frames.combine_first(a, b, ["id"])


@query("b16_compare", "SELECT c_custkey AS id, 'nation' AS \"column\", CAST(c_nationkey AS VARCHAR) AS self, CAST(s_nationkey AS VARCHAR) AS other FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey")
def b16_compare(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return frames.compared(a, b, ["id"])


@query("b17_stack", "SELECT p_partkey, 'p_name' AS \"column\", p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_type IS NOT NULL")
def b17_stack(spark, sf_dir):
    return frames.stacked(table(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_type"])


@query("b17_unstack", "SELECT o_custkey, max(n) FILTER (WHERE o_orderstatus = 'F') AS \"F\", max(n) FILTER (WHERE o_orderstatus = 'O') AS \"O\" FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def b17_unstack(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return frames.unstacked(counts, ["o_custkey"], "o_orderstatus", "n", ["F", "O"])


@query("b17_transpose", "SELECT 'n_name' AS \"column\", max(n_name) FILTER (WHERE n_nationkey = 3) AS \"3\", max(n_name) FILTER (WHERE n_nationkey = 7) AS \"7\" FROM nation UNION ALL SELECT 'n_regionkey', max(CAST(n_regionkey AS VARCHAR)) FILTER (WHERE n_nationkey = 3), max(CAST(n_regionkey AS VARCHAR)) FILTER (WHERE n_nationkey = 7) FROM nation")
def b17_transpose(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string"))
    return frames.transposed(rows.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", ["n_name", "n_regionkey"], [3, 7])


@query(
    "n1_math",
    "SELECT c_custkey, abs(c_acctbal) AS size, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, round(exp(c_acctbal / 10000), 6) AS e, round(sqrt(abs(c_acctbal)), 6) AS root, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS l10, sign(c_acctbal) AS sign, round_even(c_nationkey / 2, 0) AS half_even FROM customer",
)
def n1_math(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.abs(b).alias("size"), F.ceil(b).alias("up"), F.floor(b).alias("down"), F.round(F.exp(b / 10000), 6).alias("e"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.round(F.ln(F.abs(b) + 1), 6).alias("l"), F.round(F.log10(F.abs(b) + 1), 6).alias("l10"), F.signum(b).cast("int").alias("sign"), F.bround(F.col("c_nationkey") / 2, 0).alias("half_even"))


@query("n2_to_number", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN CAST(page_id AS DOUBLE) ELSE page_id * 1000.0 END AS number FROM pages")
def n2_to_number(spark, sf_dir):
    p = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 3 == 0, F.concat(p, F.lit("d"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), p, F.lit(" "))).otherwise(F.concat(p, F.lit("e3")))
    return table(spark, sf_dir, "pages").select("page_id", frames.to_number(text).alias("number"))


@query("n2_to_time", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 1 DAY + INTERVAL 2 HOUR END AS later FROM orders")
def n2_to_time(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 5 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.later(frames.to_time(text), days=1, hours=2).alias("later"))


@query("n3_ranges", "SELECT 'date' AS kind, CAST(strftime(x, '%Y%m%d') AS DOUBLE) AS value FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)) AS x) UNION ALL SELECT 'arange', CAST(unnest(range(3, 20, 4)) AS DOUBLE) UNION ALL SELECT 'linspace', i * 0.25 FROM range(0, 5) AS t(i)")
def n3_ranges(spark, sf_dir):
    dates = frames.date_range(spark, "2024-02-27", "2024-03-02").select(F.lit("date").alias("kind"), F.date_format("at", "yyyyMMdd").cast("double").alias("value"))
    return dates.unionByName(frames.stepped(spark, 3, 20, 4).select(F.lit("arange").alias("kind"), F.col("value").cast("double").alias("value"))).unionByName(frames.steps(spark, 0, 1, 5).select(F.lit("linspace").alias("kind"), "value"))


@query("n4_prod_any_all", "SELECT l_returnflag, round(product(1 + l_discount / 1000), 6) AS prod, bool_or(l_quantity > 49) AS any, bool_and(l_quantity > 0) AS all, count(*) FILTER (WHERE l_tax <> 0) AS nonzero FROM lineitem WHERE l_orderkey < 2000 GROUP BY 1")
def n4_prod_any_all(spark, sf_dir):
    """Of the orders before number 2,000: a product of all rows leaves the range of a double."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey < 2000")
    return rows.groupBy("l_returnflag").agg(F.round(F.product(1 + F.col("l_discount") / 1000), 6).alias("prod"), F.bool_or(F.col("l_quantity") > 49).alias("any"), F.bool_and(F.col("l_quantity") > 0).alias("all"), F.count_if(F.col("l_tax") != 0).alias("nonzero"))


_NAN = "CASE WHEN event_id % 4 = 0 THEN 'nan'::DOUBLE ELSE value END"


@query("n5_nan_aware", f"WITH v AS (SELECT event_type, {_NAN} AS v, value FROM events) SELECT event_type, min(v) FILTER (WHERE NOT isnan(v)) AS least, max(v) FILTER (WHERE NOT isnan(v)) AS most, round(avg(v) FILTER (WHERE NOT isnan(v)), 4) AS mean, round(median(v) FILTER (WHERE NOT isnan(v)), 4) AS mid, round(coalesce(sum(v) FILTER (WHERE NOT isnan(v)), 0), 2) AS total, bool_or(isnan(v)) AS poisoned FROM v GROUP BY 1")
def n5_nan_aware(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rows.groupBy("event_type").agg(frames.nan_min("v").alias("least"), frames.nan_max("v").alias("most"), F.round(frames.nan_mean("v"), 4).alias("mean"), F.round(frames.nan_median("v"), 4).alias("mid"), F.round(frames.nan_sum("v"), 2).alias("total"), F.isnan(frames.poisoned(F.median("v"), "v")).alias("poisoned"))


@query("n6_close_finite", f"SELECT event_id, isnan({_NAN}) AS nan, NOT isnan({_NAN}) AS finite, abs(value - (value + 0.00001 * (event_id % 30))) <= 1e-8 + 1e-5 * abs(value + 0.00001 * (event_id % 30)) AS close FROM events")
def n6_close_finite(spark, sf_dir):
    v = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.isnan(v).alias("nan"), frames.is_finite(v).alias("finite"), frames.is_close(F.col("value"), F.col("value") + F.lit(0.00001) * (F.col("event_id") % 30)).alias("close"))


@query("n7_histogram", "WITH e AS (SELECT CAST(min(p_size) AS DOUBLE) AS a, CAST(max(p_size) AS DOUBLE) AS b FROM part), c AS (SELECT CAST(least(floor((p_size - a) / (b - a) * 7), 6) AS INT) AS bin, count(*) AS n FROM part, e GROUP BY 1) SELECT CAST(i AS INT) AS bin, round(a + (b - a) * i / 7, 6) AS lo, round(a + (b - a) * (i + 1) / 7, 6) AS hi, coalesce(n, 0) AS n FROM range(0, 7) AS t(i) CROSS JOIN e LEFT JOIN c ON bin = i")
def n7_histogram(spark, sf_dir):
    return frames.histogram(table(spark, sf_dir, "part"), "p_size", 7).select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("n8_sort_argsort_unique", "SELECT o_custkey, array_to_string(list_sort(l), ',') AS sorted, array_to_string(list_sort(list_distinct(l)), ',') AS uniq, array_to_string(list_transform(list_sort(list_transform(range(1, len(l) + 1), lambda i: {'v': l[i], 'i': i})), lambda x: x.i - 1), ',') AS places FROM (SELECT o_custkey, list(o_orderkey % 7 ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)")
def n8_sort_argsort_unique(spark, sf_dir):
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k % 7).alias("l"))
    shown = lambda c: F.array_join(c.cast("array<string>"), ",")
    return held.select("o_custkey", shown(frames.sorted_values(F.col("l"))).alias("sorted"), shown(frames.unique_sorted(F.col("l"))).alias("uniq"), shown(frames.sorting_order(F.col("l"))).alias("places"))


_TYPES = ["click", "view", "purchase"]


@query(
    "a7_crosstab_margins",
    "WITH c AS (SELECT CAST(user_id % 5 AS VARCHAR) AS bucket, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in _TYPES) + ", count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS \"All\" FROM events GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'All', " + ", ".join(f'CAST(sum("{t}") AS BIGINT)' for t in [*_TYPES, "All"]) + " FROM c",
)
def a7_crosstab_margins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 5)
    return tabular.with_margins(tabular.crosstab(rows, "bucket", "event_type", _TYPES), "bucket", _TYPES)


@query("a7_pivot_sum", "SELECT user_id % 5 AS bucket, " + ", ".join(f"CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = '{t}') AS BIGINT) AS \"{t}\"" for t in _TYPES) + " FROM events GROUP BY 1")
def a7_pivot_sum(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("bucket", F.col("user_id") % 5)
    return tabular.pivot(rows, "bucket", "event_type", _TYPES, F.sum("cents"))


@query("r5_explode", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 0")
def r5_explode(spark, sf_dir):
    words = F.when(F.col("p_partkey") % 3 > 0, F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode_outer(words).alias("word"))


@query("f13_string_filters", "SELECT p_partkey FROM part WHERE (starts_with(p_name, 'b') OR ends_with(p_type, 'L')) AND p_name LIKE '%a_%' AND NOT contains(p_brand, '5')")
def f13_string_filters(spark, sf_dir):
    either = F.startswith(F.col("p_name"), F.lit("b")) | F.endswith(F.col("p_type"), F.lit("L"))
    return table(spark, sf_dir, "part").where(either & F.col("p_name").like("%a_%") & ~F.contains(F.col("p_brand"), F.lit("5"))).select("p_partkey")


@query("f9_missing_numbers", "SELECT count(*) FILTER (WHERE event_id % 4 = 0 OR event_id % 9 = 0) AS missing, count(*) FILTER (WHERE event_id % 9 = 0) AS nulls FROM events")
def f9_missing_numbers(spark, sf_dir):
    v = F.when(F.col("event_id") % 9 != 0, F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").agg(F.count_if(frames.missing(v, floating=True)).alias("missing"), F.count_if(frames.missing(v)).alias("nulls"))


@query("t9_sorted_extremes", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS argmin, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS argmax FROM orders GROUP BY 1")
def t9_sorted_extremes(spark, sf_dir):
    first = lambda sign: F.struct("o_totalprice", sign * F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", first(1)).alias("argmin"), F.max_by("o_orderkey", first(-1)).alias("argmax"))
