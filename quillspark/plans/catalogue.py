"""Every registered query over the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy, validators
from ..operators import documents, fuzzy, tabular
from ..sources import files, grid, providers
from . import agent, methods, reports, safe_sql  # methods and reports register queries of their own
from .registry import ORACLE_SQL, QUERIES, query, table

__all__ = ["ORACLE_SQL", "QUERIES", "methods", "reports"]


_STOCK_SQL = """
    e AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DECIMAL(18,2)) AS x FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey AS product_id, CAST(0 AS DECIMAL(18,2)) AS opening_stock, x AS stock_in, CAST(0 AS DECIMAL(18,2)) AS units_sold, CAST(o_totalprice AS DECIMAL(18,2)) AS hand_in_stock FROM orders LEFT JOIN e ON o_orderkey = l_orderkey)"""


def _stock(spark, sf_dir):
    """Orders as stock records: what their lines bring in, and what is stated to be there."""
    d = lambda c, k: F.col(c).cast(f"decimal({k},2)")
    zero = F.lit(0).cast("decimal(18,2)")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(d("l_extendedprice", 18) * (1 - d("l_discount", 4)) * (1 + d("l_tax", 4))).cast("decimal(18,2)").alias("x"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select(F.col("o_orderkey").alias("product_id"), F.col("o_orderpriority").alias("product_name"), zero.alias("opening_stock"), F.col("x").alias("stock_in"), zero.alias("units_sold"), d("o_totalprice", 18).alias("hand_in_stock"), d("o_totalprice", 18).alias("cost_price_total_usd"))


@query(
    "a2_order_total_reconcile",
    f"WITH {_STOCK_SQL} SELECT product_id AS o_orderkey, hand_in_stock AS stated, stock_in AS expected, hand_in_stock - stock_in AS difference FROM s WHERE coalesce(hand_in_stock <> stock_in, true)",
)
def a2_order_total_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose stated total differs from the one recomputed from their lines, or has no lines."""
    out = tabular.stock_consistency(_stock(spark, sf_dir))
    return out.select(F.col("product_id").alias("o_orderkey"), F.col("hand_in_stock").alias("stated"), F.col("expected_hand_in_stock").cast("decimal(18,2)").alias("expected"), F.col("difference").cast("decimal(19,2)").alias("difference"))


def money(c: str, digits: int = 18):
    return F.col(c).cast(f"decimal({digits},2)")


@query(
    "a1_table_profile",
    f"WITH {_STOCK_SQL} SELECT count(*) AS n_rows, CAST(coalesce(sum(hand_in_stock), 0) AS DECIMAL(28,2)) AS total_stock, CAST(coalesce(sum(hand_in_stock), 0) AS DECIMAL(28,2)) AS total_value, count(*) FILTER (WHERE coalesce(hand_in_stock <> stock_in, true)) AS n_inconsistent FROM s",
)
def a1_table_profile(spark, sf_dir):
    out = tabular.profile(_stock(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("total_stock", "total_value")})


@query("a3_nunique", "SELECT count(DISTINCT o_custkey) AS n_customers FROM orders")
def a3_nunique(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("n_customers"))


@query("a4_empty_sum", "SELECT coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS total FROM orders WHERE o_orderkey < 0")
def a4_empty_sum(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey < 0").agg(F.coalesce(F.sum(money("o_totalprice")), F.lit(0)).cast("decimal(38,2)").alias("total"))


@query(
    "a5_group_agg",
    """SELECT p_brand, count(*) AS n, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS total, min(CAST(p_retailprice AS DECIMAL(18,2))) AS least, max(CAST(p_retailprice AS DECIMAL(18,2))) AS most
       FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""",
)
def a5_group_agg(spark, sf_dir):
    p = money("p_retailprice")
    return tabular.group_agg(table(spark, sf_dir, "part"), ["p_brand"], F.count("*").alias("n"), F.sum(p).cast("decimal(38,2)").alias("total"), F.min(p).alias("least"), F.max(p).alias("most"))


@query("a6_value_counts", "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def a6_value_counts(spark, sf_dir):
    return tabular.value_counts(table(spark, sf_dir, "events"), "event_type")


_EVENT_TYPES = ["click", "view", "purchase", "signup", "scroll"]


@query(
    "a7_crosstab",
    "SELECT user_id % 10 AS bucket, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in _EVENT_TYPES) + " FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1",
)
def a7_crosstab(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    return tabular.crosstab(rows, "bucket", "event_type", _EVENT_TYPES)


@query(
    "a7_pivot",
    "SELECT user_id % 10 AS bucket, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 4) AS \"{t}\"" for t in _EVENT_TYPES) + " FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1",
)
def a7_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    out = tabular.pivot_mean(rows, "bucket", "event_type", "value", _EVENT_TYPES)
    return out.select("bucket", *[F.round(t, 4).alias(t) for t in _EVENT_TYPES])


@query(
    "a8_quantiles_std",
    """SELECT round(median(l_quantity), 4) AS median_qty, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(stddev_pop(l_quantity), 4) AS std_pop,
       round(stddev_samp(l_quantity), 4) AS std_samp, round(var_pop(l_quantity), 4) AS var_pop, count(*) FILTER (WHERE l_discount <> 0) AS n_nonzero FROM lineitem""",
)
def a8_quantiles_std(spark, sf_dir):
    r = lambda c: F.round(c, 4)
    rows = table(spark, sf_dir, "lineitem")
    picked = {"median_qty": tabular.exact_quantiles(rows, "l_quantity", [0.5])[0], "p90": tabular.exact_quantiles(rows, "l_extendedprice", [0.9])[0]}
    return rows.agg(*[F.lit(round(v, 4)).alias(n) for n, v in picked.items()], r(F.stddev_pop("l_quantity")).alias("std_pop"), r(F.stddev_samp("l_quantity")).alias("std_samp"), r(F.var_pop("l_quantity")).alias("var_pop"), F.count_if(F.col("l_discount") != 0).alias("n_nonzero"))


@query("a8_corr", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def a8_corr(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("a8_skew_kurtosis", "SELECT round(skewness(l_quantity), 4) AS skew, round(kurtosis(l_quantity), 4) AS kurt FROM lineitem")
def a8_skew_kurtosis(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(tabular.sample_skew("l_quantity"), 4).alias("skew"), F.round(tabular.sample_kurtosis("l_quantity"), 4).alias("kurt"))


@query("t1_topk_ties", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10")
def t1_topk_ties(spark, sf_dir):
    return tabular.top_k(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", 10, "p_partkey")


@query("t2_nsmallest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 7")
def t2_nsmallest(spark, sf_dir):
    return tabular.top_k(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 7, "c_custkey", largest=False)


@query("t3_nested_topk", "SELECT * FROM (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10) ORDER BY p_size, p_partkey LIMIT 3")
def t3_nested_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return tabular.top_k(tabular.top_k(rows, "p_retailprice", 10, "p_partkey"), "p_size", 3, "p_partkey", largest=False)


@query("t4_row_cap", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 200")
def t4_row_cap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity").limit(200)


@query("t9_argmax_argmin", "SELECT p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY 1")
def t9_argmax_argmin(spark, sf_dir):
    by = F.struct("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", by).alias("dearest"), F.min_by("p_partkey", by).alias("cheapest"))


@query("f1_threshold", "SELECT p_partkey, p_size FROM part WHERE p_size < 30")
def f1_threshold(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size") < 30).select("p_partkey", "p_size")


@query("f3_ci_equals", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def f3_ci_equals(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.lower("c_mktsegment") == "building").select("c_custkey", "c_mktsegment")


@query("f4_ci_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def f4_ci_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").where(agent.product_filter("p_name", "Ring")).select("p_partkey", "p_name")


@query("f6_derived", "SELECT s_suppkey AS supplier, CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 2 AS DECIMAL(20,2)) AS doubled FROM supplier")
def f6_derived(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), (money("s_acctbal") * 2).cast("decimal(20,2)").alias("doubled"))


@query("f8_where_select_clip", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, least(greatest(c_acctbal, 0), 5000) AS clipped FROM customer")
def f8_where_select_clip(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"), F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0)).alias("clipped"))


@query("f9_null_predicates", "SELECT count(*) FILTER (WHERE lang IS NULL) AS no_lang, count(*) FILTER (WHERE text IS NOT NULL) AS with_text FROM documents")
def f9_null_predicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("text").isNotNull()).alias("with_text"))


@query("f13_regex_filter", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.]+/fr/') ")
def f13_regex_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[a-z0-9.]+/fr/")).select("page_id")


_J = {
    "inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "left": "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    "right": "SELECT c_custkey, s_suppkey FROM customer RIGHT JOIN supplier ON c_custkey = 2 * s_suppkey",
    "outer": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 5",
    "cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "nullsafe": "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey END AS j FROM supplier) ON k IS NOT DISTINCT FROM j",
}


@query("j1_merge_inner", _J["inner"])
def j1_merge_inner(spark, sf_dir):
    return tabular.merge(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey").select("n_name", "r_name")


@query("j1_merge_left", _J["left"])
def j1_merge_left(spark, sf_dir):
    return tabular.merge(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_custkey", "s_suppkey", "left").select("c_custkey", "s_suppkey")


@query("j1_merge_right", _J["right"])
def j1_merge_right(spark, sf_dir):
    right = table(spark, sf_dir, "supplier").withColumn("k", 2 * F.col("s_suppkey"))
    return tabular.merge(table(spark, sf_dir, "customer"), right, "c_custkey", "k", "right").select("c_custkey", "s_suppkey")


@query("j1_merge_outer", _J["outer"])
def j1_merge_outer(spark, sf_dir):
    right = table(spark, sf_dir, "supplier").withColumn("k", 5 + F.col("s_suppkey"))
    return tabular.merge(table(spark, sf_dir, "customer"), right, "c_custkey", "k", "outer").select("c_custkey", "s_suppkey")


@query("j1_merge_cross", _J["cross"])
def j1_merge_cross(spark, sf_dir):
    return tabular.merge(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "", "", "cross").select("n_name", "r_name")


@query("j1_merge_nullsafe", _J["nullsafe"])
def j1_merge_nullsafe(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("k"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey")).alias("j"))
    return tabular.merge(left, right, "k", "j").select("c_custkey", "s_suppkey")


@query(
    "j7_anti_unassigned",
    "SELECT doc_id, quality FROM (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) UNION ALL SELECT doc_id, -1 AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def j7_anti_unassigned(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rest = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left_anti").withColumn("quality", F.lit(-1))
    return labels.unionByName(rest)


_FAMILIES = {"apache": ("apache license", "version 2", "licensed under"), "cc": ("creative commons", "cc by", "licensed under"), "gpl": ("general public license", "gnu", "licensed under"), "mit": ("mit license", "released under", "licensed under")}


def _keywords(spark):
    return spark.createDataFrame([(t, k) for t, words in _FAMILIES.items() for k in words], "type string, keyword string")


_VOTE_SQL = (
    "WITH s AS (SELECT doc_id, "
    + ", ".join("(" + " + ".join(f"CAST(regexp_matches(lower(text), '(^|[^a-z0-9]){k}([^a-z0-9]|$)') AS INT)" for k in words) + f") AS {t}" for t, words in _FAMILIES.items())
    + " FROM documents), r AS (SELECT doc_id, unnest([" + ", ".join(f"{{'n': {t}, 't': '{t}'}}" for t in _FAMILIES) + "]) AS x FROM s), o AS (SELECT doc_id, x.t AS t, x.n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.t) AS k FROM r) "
)


@query(
    "p20_keyword_vote",
    _VOTE_SQL + "SELECT a.doc_id, a.t AS best_type, a.n AS best, b.n AS runner_up, CASE WHEN a.n >= 2 AND a.n > b.n THEN a.t END AS vote FROM o a JOIN o b ON a.doc_id = b.doc_id WHERE a.k = 1 AND b.k = 2",
)
def p20_keyword_vote(spark, sf_dir):
    return documents.keyword_vote(table(spark, sf_dir, "documents").select("doc_id", "text"), _keywords(spark))


@query("j8_keyword_theta", _VOTE_SQL + "SELECT t AS type, count(*) AS n_docs FROM o WHERE n > 0 GROUP BY 1")
def j8_keyword_theta(spark, sf_dir):
    lowered = F.lower("text")
    hits = F.array(*[F.when(_any_word(lowered, words), t) for t, words in _FAMILIES.items()])
    return table(spark, sf_dir, "documents").select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("type")).groupBy("type").agg(F.count("*").alias("n_docs"))


def _any_word(text, words):
    found = F.lit(False)
    for w in words:
        found = found | documents.has_keyword(text, w)
    return found


@query(
    "p22_class_score",
    """WITH d AS (SELECT doc_id, 0.6 * least(1.0, CAST(n_chars AS DOUBLE) / 3989.3) + 0.4 * CASE WHEN lang IS NULL THEN 0.5 WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS s FROM documents)
       SELECT doc_id, round(s, 3) AS confidence, round(s, 3) < 0.85 AS review_required FROM d""",
)
def p22_class_score(spark, sf_dir):
    score = documents.classification_score(F.col("n_chars") / F.lit(3989.3), F.lit("en"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("s")).select("doc_id", "s.confidence", "s.review_required")


@query("u1_concat", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u1_concat(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return tabular.concat(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("u4_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def u4_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).distinct().exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).distinct())


@query("u5_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def u5_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("u6_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u6_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query(
    "w1_history_last5",
    """SELECT conv_id, turn, coalesce(string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN substr(text, 1, 600) ELSE text END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations""",
)
def w1_history_last5(spark, sf_dir):
    return agent.history(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).select("conv_id", "turn", "history")


@query("w2_first_wins", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def w2_first_wins(spark, sf_dir):
    """The first document of each text, by a hash of it: a text that a third of all rows share is one partial aggregate for each task."""
    first = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "source")).alias("f"))
    return first.select("f.doc_id", "f.source")


@query(
    "w4_preferred_order",
    """SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS n FROM events) WHERE n = 1""",
)
def w4_preferred_order(spark, sf_dir):
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    best = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct(order.alias("o"), "event_id", "event_type")).alias("b"))
    return best.select("user_id", "b.event_id", "b.event_type")


@query(
    "w9_cumsum_diff_rank_roll",
    """
    WITH e AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
    SELECT event_id, sum(cents) OVER w AS running, cents - lag(cents) OVER w AS diff,
           rank() OVER (PARTITION BY user_id ORDER BY cents) + (count(*) OVER (PARTITION BY user_id, cents) - 1) / 2.0 AS rnk,
           CASE WHEN count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
                THEN sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS roll3
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    """,
)
def w9_cumsum_diff_rank_roll(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    last3 = w.rowsBetween(-2, 0)
    return e.select("event_id", F.sum("cents").over(w).alias("running"), (F.col("cents") - F.lag("cents").over(w)).alias("diff"), tabular.rank("cents", "average", ["user_id"]).alias("rnk"), F.when(F.count("*").over(last3) == 3, F.sum("cents").over(last3)).alias("roll3"))


@query("r_melt", "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def r_melt(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return tabular.melt(rows, ["p_partkey"], ["p_size", "p_retailprice"])


_STATUS = ["F", "O", "P"]


@query("r_dummies", "SELECT o_orderkey, " + ", ".join(f"coalesce(o_orderstatus = '{s}', false) AS \"o_orderstatus_{s}\"" for s in _STATUS) + " FROM orders")
def r_dummies(spark, sf_dir):
    return tabular.dummies(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", _STATUS).drop("o_orderstatus")


@query("r_cut", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'mid' WHEN p_size > 30 AND p_size <= 100 THEN 'large' END AS bin FROM part")
def r_cut(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tabular.cut(F.col("p_size"), [0, 10, 30, 100], ["small", "mid", "large"]).alias("bin"))


@query(
    "r_qcut",
    "WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS e FROM part) SELECT p_partkey, CAST(p_retailprice > e[1] AS INT) + CAST(p_retailprice > e[2] AS INT) + CAST(p_retailprice > e[3] AS INT) AS bin FROM part, q",
)
def r_qcut(spark, sf_dir):
    return tabular.qcut(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 4).select("p_partkey", "bin")


@query("r_resample", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1")
def r_resample(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


@query(
    "m1_mask",
    """SELECT c_custkey, list_aggregate(list_transform(range(1, length(c_name) + 1), lambda i: CASE WHEN regexp_matches(c_name[i:i], '[A-Za-z0-9]') AND length(regexp_replace(substr(c_name, i + 1), '[^A-Za-z0-9]', '', 'g')) >= 4 THEN '•' ELSE c_name[i:i] END), 'string_agg', '') AS masked FROM customer""",
)
def m1_mask(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", privacy.mask_value(F.col("c_name")).alias("masked"))


_SPACE_SQL = r"[\t\n\x0B\f\r ]"
_PII_SQL = (rf"\b[0-9]{{4}}{_SPACE_SQL}?[0-9]{{4}}{_SPACE_SQL}?[0-9]{{4}}\b", r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", r"\b[0-9]{9,18}\b", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+", rf"\+?[0-9][0-9\t\n\x0B\f\r -]{{8,}}[0-9]")


def _scrub_sql(column: str) -> str:
    for p in _PII_SQL:
        column = f"regexp_replace({column}, '{p}', '[redacted]', 'g')"
    return column


@query("m5_scrub", f"SELECT doc_id, md5({_scrub_sql('text')}) AS scrubbed_md5 FROM documents")
def m5_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(privacy.scrub_pii(F.col("text")).cast("binary")).alias("scrubbed_md5"))


@query("m6_contains", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in _PII_SQL))
def m6_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(privacy.contains_pii(F.col("text"))).select("doc_id")


@query("m3_mask_text")
def m3_mask_text(spark, sf_dir):
    masked = privacy.mask_numbers_in_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", masked.alias("masked")).where(F.contains("masked", F.lit(privacy.MASK)))


@query("m10_compact", r"SELECT c_custkey, upper(regexp_replace(c_name, '[\s\-_.,/#]', '', 'g')) AS compacted FROM customer")
def m10_compact(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.replace(privacy.compact(F.col("c_name")), F.lit("#"), F.lit("")).alias("compacted"))


@query("m11_coerce", "SELECT c_custkey, translate(upper(c_mktsegment), 'OQDIL|ZSBGT', '00011125867') AS coerced FROM customer")
def m11_coerce(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", privacy.to_digits(F.upper("c_mktsegment")).alias("coerced"))


AS_OF = "2025-06-30"


def as_of():
    return F.lit(AS_OF).cast("date")


def _verdict(df, key, code, struct):
    """key, the code judged, and the verdict as plain columns."""
    return df.select(key, code.alias("code"), struct.alias("v")).select(key, "code", "v.normalized", "v.passed", F.array_join("v.notes", "; ").alias("notes"), "v.coerced")


def _list_lookup(rows) -> str:
    return "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in rows) + "]"


_AADHAAR_CODE = "lpad(CAST(c_custkey * 7919 + 200000000000 AS VARCHAR), 12, '0')"


@query(
    "v1_verhoeff",
    f"""WITH RECURSIVE k AS (SELECT c_custkey, {_AADHAAR_CODE} AS code FROM customer),
        s AS (SELECT c_custkey, code, 0 AS i, 0 AS c FROM k UNION ALL
              SELECT c_custkey, code, i + 1, ({_list_lookup(validators.VERHOEFF_D)})[c + 1][({_list_lookup(validators.VERHOEFF_P)})[i % 8 + 1][CAST(code[12 - i] AS INT) + 1] + 1] FROM s WHERE i < 12)
        SELECT c_custkey, code, substr(code, 1, 4) || ' ' || substr(code, 5, 4) || ' ' || substr(code, 9, 4) AS normalized, c = 0 AS passed, CASE WHEN c = 0 THEN '' ELSE 'Verhoeff checksum failed' END AS notes, false AS coerced FROM s WHERE i = 12""",
)
def v1_verhoeff(spark, sf_dir):
    code = F.lpad((F.col("c_custkey") * 7919 + 200_000_000_000).cast("string"), 12, "0")
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", code, validators.aadhaar(code))


_PAN_SQL = "chr(CAST(65 + c_custkey % 26 AS INT)) || 'BC' || chr(CAST(65 + c_custkey % 13 AS INT)) || 'K' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || chr(CAST(65 + c_custkey % 7 AS INT))"


def _letter(n):
    return F.char(65 + F.col("c_custkey") % n)


@query(
    "v2_pan",
    f"""WITH k AS (SELECT c_custkey, {_PAN_SQL} AS code FROM customer)
        SELECT c_custkey, code, code AS normalized, code[4] IN ('A','B','C','F','G','H','L','J','P','T','K') AS passed,
               CASE WHEN code[4] IN ('A','B','C','F','G','H','L','J','P','T','K') THEN '' ELSE '4th character ''' || code[4] || ''' is not a valid PAN holder-type code' END AS notes, false AS coerced FROM k""",
)
def v2_pan(spark, sf_dir):
    code = F.concat(_letter(26), F.lit("BC"), _letter(13), F.lit("K"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), _letter(7))
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", code, validators.pan(code))


@query(
    "v3_ifsc",
    """WITH k AS (SELECT c_custkey, 'abcd' || CASE WHEN c_custkey % 3 = 0 THEN 'O' WHEN c_custkey % 3 = 1 THEN '0' ELSE '9' END || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer)
       SELECT c_custkey, code, upper(substr(code, 1, 4)) || CASE WHEN c_custkey % 3 < 2 THEN '0' ELSE '9' END || substr(code, 6) AS normalized, c_custkey % 3 < 2 AS passed,
              CASE c_custkey % 3 WHEN 0 THEN 'position 5: ''O''→''0''' WHEN 1 THEN '' ELSE 'IFSC must be 4 letters, ''0'', then 6 alphanumerics (11 chars)' END AS notes, c_custkey % 3 = 0 AS coerced FROM k""",
)
def v3_ifsc(spark, sf_dir):
    third = F.col("c_custkey") % 3
    code = F.concat(F.lit("abcd"), F.when(third == 0, "O").when(third == 1, "0").otherwise("9"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", code, validators.ifsc(code))


@query(
    "v4_account",
    """WITH k AS (SELECT c_custkey, repeat('4', CAST(5 + c_custkey % 16 AS INT)) AS code FROM customer)
       SELECT c_custkey, code, code AS normalized, length(code) BETWEEN 9 AND 18 AS passed, CASE WHEN length(code) BETWEEN 9 AND 18 THEN '' ELSE 'account number length ' || length(code) || ' outside 9-18' END AS notes, false AS coerced FROM k""",
)
def v4_account(spark, sf_dir):
    code = F.repeat(F.lit("4"), (5 + F.col("c_custkey") % 16).cast("int"))
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", code, validators.account(code))


@query(
    "v5_digits",
    """SELECT c_custkey, c_name AS code, translate(upper(regexp_replace(c_name, '[\\s\\-_.,/]', '', 'g')), 'OQDIL|ZSBGT', '00011125867') AS normalized,
       regexp_matches(translate(upper(regexp_replace(c_name, '[\\s\\-_.,/]', '', 'g')), 'OQDIL|ZSBGT', '00011125867'), '^[0-9]+$') AS passed FROM customer""",
)
def v5_digits(spark, sf_dir):
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"), validators.digits(F.col("c_name"))).select("c_custkey", "code", "normalized", "passed")


@query(
    "v6_amount",
    """WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Rs. ' || o_orderkey || ',500/-' WHEN 1 THEN '₹' || o_orderkey || '.50' WHEN 2 THEN 'INR ' || o_orderkey ELSE o_orderkey || ' only' END AS code FROM orders)
       SELECT o_orderkey, code, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '500' WHEN 1 THEN o_orderkey || '.50' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || 'only' END AS normalized,
              o_orderkey % 4 < 3 AS passed, CASE WHEN o_orderkey % 4 < 3 THEN '' ELSE 'amount is not a valid number' END AS notes, false AS coerced FROM k""",
)
def v6_amount(spark, sf_dir):
    k, s = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    code = F.when(k == 0, F.concat(F.lit("Rs. "), s, F.lit(",500/-"))).when(k == 1, F.concat(F.lit("₹"), s, F.lit(".50"))).when(k == 2, F.concat(F.lit("INR "), s)).otherwise(F.concat(s, F.lit(" only")))
    return _verdict(table(spark, sf_dir, "orders"), "o_orderkey", code, validators.amount(code))


_WORDS = (("Fifty thousand only", 50_000), ("Rupees one lakh twenty five thousand", 125_000), ("two crore three lakhs", 20_300_000), ("hundred", 100), ("nine hundred ninety nine", 999), ("Seven lac and eleven", 700_011), ("zero", 0), ("only", None), ("fifty grand", None))


@query("v7_words", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {'CAST(NULL AS BIGINT)' if n is None else n})" for w, n in _WORDS) + ") AS t(words, number)")
def v7_words(spark, sf_dir):
    return spark.createDataFrame([(w,) for w, _ in _WORDS], "words string").select("words", validators.words_to_number(F.col("words")).alias("number"))


_DATE_FORMATS = (("dd/MM/yyyy", "%d/%m/%Y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("dd/MM/yy", "%d/%m/%y"), ("dd-MM-yy", "%d-%m-%y"), ("dd.MM.yy", "%d.%m.%y"), ("dd MMM yyyy", "%d %b %Y"), ("dd MMMM yyyy", "%d %B %Y"), ("dd/MMM/yyyy", "%d/%b/%Y"), ("ddMMyyyy", "%d%m%Y"))


@query(
    "v8_dates",
    "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, (_, f) in enumerate(_DATE_FORMATS)) + " END AS code, strftime(o_orderdate, '%Y-%m-%d') AS normalized, true AS passed FROM orders",
)
def v8_dates(spark, sf_dir):
    code = F.lit(None).cast("string")
    for i, (f, _) in enumerate(_DATE_FORMATS):
        code = F.when(F.col("o_orderkey") % 10 == i, F.date_format("o_orderdate", f)).otherwise(code)
    return _verdict(table(spark, sf_dir, "orders"), "o_orderkey", code, validators.date_value(code, "date", as_of())).select("o_orderkey", "code", "normalized", "passed")


@query(
    "v9_date_past",
    f"""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%d') AS normalized, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) <= DATE '{AS_OF}' AS passed FROM orders""",
)
def v9_date_past(spark, sf_dir):
    code = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 28 * 12), "dd/MM/yyyy")
    return _verdict(table(spark, sf_dir, "orders"), "o_orderkey", code, validators.date_value(code, "date_past", as_of())).select("o_orderkey", "normalized", "passed")


_STATES = validators.STATE_CODES.split()


@query(
    "v10_driving_licence",
    f"""WITH k AS (SELECT c_custkey, ({[*_STATES, 'XX']!r})[CAST(c_custkey % {len(_STATES) + 1} AS INT) + 1] AS st, 1930 + c_custkey % 110 AS y, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS n FROM customer)
        SELECT c_custkey, st || '-14 ' || y || ' ' || n AS code, st || '14 ' || y || ' ' || n AS normalized, st <> 'XX' AND y BETWEEN 1950 AND 2025 AS passed FROM k""",
)
def v10_driving_licence(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, [*_STATES, "XX"])), (F.col("c_custkey") % (len(_STATES) + 1)).cast("int"))
    code = F.concat(state, F.lit("-14 "), (1930 + F.col("c_custkey") % 110).cast("string"), F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", code, validators.driving_licence(code, as_of())).select("c_custkey", "code", "normalized", "passed")


@query("v11_passport", "SELECT c_custkey, chr(CAST(65 + c_custkey % 26 AS INT)) || lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 8 END, '0') AS code, c_custkey % 2 = 0 AS passed FROM customer")
def v11_passport(spark, sf_dir):
    c = F.col("c_custkey")
    code = F.concat(_letter(26), F.when(c % 2 == 0, F.lpad(c.cast("string"), 7, "0")).otherwise(F.lpad(c.cast("string"), 8, "0")))
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", code, validators.passport(code)).select("c_custkey", "code", "passed")


def _digit_sql(text: str) -> str:
    return f"list_sum(list_transform(range(1, length({text}) + 1), lambda i: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({text})[i:i]) - CASE WHEN strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({text})[i:i]) > 0 THEN 1 ELSE 0 END) * ([7, 3, 1])[(i - 1) % 3 + 1])) % 10"


@query("v12_mrz_digit", f"WITH k AS (SELECT c_custkey, upper(replace(c_name, '#', '<')) AS code FROM customer) SELECT c_custkey, code, CAST({_digit_sql('code')} AS INT) AS check_digit FROM k")
def v12_mrz_digit(spark, sf_dir):
    code = F.upper(F.replace("c_name", F.lit("#"), F.lit("<")))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"), validators.mrz_check_digit(code).cast("int").alias("check_digit"))


@query(
    "v14_mrz_line",
    f"""WITH k AS (SELECT c_custkey, 'K' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '<' AS doc FROM customer),
        a AS (SELECT c_custkey, doc || CAST((CAST({_digit_sql('doc')} AS INT) + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS d FROM k),
        b AS (SELECT c_custkey, d, d || '9002011' || '3001019' || '<<<<<<<<<<<<<<<' AS core FROM a)
        SELECT c_custkey, substr(d, 1, 10) || 'IND' || '9002011' || 'M' || '3001019' || '<<<<<<<<<<<<<<' || '<' || CAST({_digit_sql('core')} AS INT) AS code, c_custkey % 4 <> 0 AND {_digit_sql("'900201'")} = 1 AND {_digit_sql("'300101'")} = 9 AS passed FROM b""",
)
def v14_mrz_line(spark, sf_dir):
    digit = validators.mrz_check_digit
    doc = F.concat(F.lit("K"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit("<"))
    d = F.concat(doc, ((digit(doc) + F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0)) % 10).cast("string"))
    core = F.concat(d, F.lit("9002011" + "3001019" + "<" * 15))
    code = F.concat(d, F.lit("IND9002011M3001019" + "<" * 15), digit(core).cast("string"))
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", code, validators.mrz_line(code)).select("c_custkey", "code", "passed")


@query("v16_name", "SELECT c_custkey, c_name AS code, regexp_matches(c_name, '[A-Za-z]') AND NOT regexp_matches(c_name, '[0-9]') AS passed FROM customer")
def v16_name(spark, sf_dir):
    return _verdict(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"), validators.name(F.col("c_name"))).select("c_custkey", "code", "passed")


@query("v17_place", "SELECT n_nationkey, n_name AS code, regexp_matches(n_name, '^[A-Za-z][A-Za-z .,''\\-]*$') AS passed FROM nation")
def v17_place(spark, sf_dir):
    return _verdict(table(spark, sf_dir, "nation"), "n_nationkey", F.col("n_name"), validators.place(F.col("n_name"))).select("n_nationkey", "code", "passed")


@query("v19_address", "SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])[0-9]{6}([^A-Za-z0-9_]|$)') AS passed FROM documents")
def v19_address(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", validators.address(F.col("text"))["passed"].alias("passed"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("v20_checkbox", "SELECT o_orderkey, o_orderpriority AS normalized, true AS passed FROM orders WHERE o_orderpriority IN (" + ", ".join(f"'{p}'" for p in _PRIORITIES) + ")")
def v20_checkbox(spark, sf_dir):
    options = F.array(*map(F.lit, _PRIORITIES))
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(*_PRIORITIES))
    return rows.select("o_orderkey", validators.checkbox(F.lower("o_orderpriority"), options).alias("v")).select("o_orderkey", "v.normalized", "v.passed")


_READS_SQL = "r AS (SELECT l_partkey, CASE WHEN l_quantity < 10 THEN NULL ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS key, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"


def _reads(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_quantity") >= 10, (F.col("l_suppkey") % 3).cast("string")).alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


_CONSENSUS_SQL = f"""{_READS_SQL},
    k AS (SELECT l_partkey, key, count(*) AS n, min(pos) AS first FROM r WHERE key IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT l_partkey, key, n, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, first, key) AS o, max(n) OVER (PARTITION BY l_partkey) AS most FROM k),
    t AS (SELECT l_partkey, max(key) FILTER (WHERE o = 1) AS top_key, max(n) AS top_count, count(*) AS n_distinct, count(*) FILTER (WHERE n = most) > 1 AS tied FROM m GROUP BY 1),
    a AS (SELECT l_partkey, count(*) AS n_reads, count(*) FILTER (WHERE key IS NULL) AS n_empty FROM r GROUP BY 1),
    c AS (SELECT a.l_partkey, top_key, top_count, n_distinct, n_reads, n_empty, coalesce(tied, false) AS tied, coalesce(n_distinct > 1 AND (top_count < 2 OR tied), false) AS disagreement FROM a LEFT JOIN t USING (l_partkey))"""


@query("p23_consensus", f"WITH {_CONSENSUS_SQL} SELECT *, round(CASE WHEN disagreement THEN 0.0 ELSE top_count / n_reads END, 4) AS agreement FROM c")
def p23_consensus(spark, sf_dir):
    return documents.consensus(_reads(spark, sf_dir), ["l_partkey"]).withColumn("agreement", F.round("agreement", 4))


_EVIDENCE_SQL = """e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) % 5 * 25 AS agreement, CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 100 END AS validation,
    CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 60 END AS legibility, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 80 END AS ocr, l_linenumber % 4 > 0 AS majority, l_linenumber % 5 = 0 AS empty, l_linenumber % 7 = 0 AS coerced, l_suppkey % 2 = 0 AS hand, l_suppkey % 3 AS n_reads FROM lineitem)"""


_CAPS_SQL = (("NOT majority", 40, "independent reads disagree (no majority) -> capped at 0.4"), ("empty", 75, "at least one independent read found no value -> capped at 0.75"), ("coalesce(validation = 0, false)", 70, "format/checksum validation failed -> capped at 0.7"), ("coerced", 84, "confusable characters were normalised -> capped at 0.84"), ("hand AND n_reads < 2", 80, "fewer than two vision reads for a handwritten field -> capped at 0.8"))


@query(
    "p25_score_caps",
    f"""WITH {_EVIDENCE_SQL},
        s0 AS (SELECT *, (35 * agreement + coalesce(20 * validation, 0) + coalesce(15 * legibility, 0) + coalesce((CASE WHEN hand THEN 5 ELSE 10 END) * ocr, 0) + 10 * 50)
              / (35 + (CASE WHEN validation IS NULL THEN 0 ELSE 20 END) + (CASE WHEN legibility IS NULL THEN 0 ELSE 15 END) + (CASE WHEN ocr IS NULL THEN 0 WHEN hand THEN 5 ELSE 10 END) + 10) AS now, '' AS caps FROM e),
        {", ".join(f"s{i} AS (SELECT * REPLACE (CASE WHEN {c} AND now > {cap} + 1e-9 THEN {cap} ELSE now END AS now, CASE WHEN {c} AND now > {cap} + 1e-9 THEN caps || '{t};' ELSE caps END AS caps) FROM s{i - 1})" for i, (c, cap, t) in enumerate(_CAPS_SQL, 1))}
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(now / 5 + 0.97) AS fifth, caps FROM s{len(_CAPS_SQL)}""",
)
def p25_score_caps(spark, sf_dir):
    i = F.col("l_quantity").cast("bigint")
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (i % 5 * 0.25).alias("agreement"), F.when(i % 3 == 1, 0.0).when(i % 3 == 2, 1.0).alias("validation"), F.when(line % 2 != 0, 0.6).alias("legibility"), F.when(line % 3 != 0, 0.8).alias("ocr"), F.lit(None).cast("double").alias("proximity"), F.lit(0.5).alias("image_quality"), (line % 4 > 0).alias("majority"), (line % 5 == 0).alias("some_read_empty"), (line % 7 == 0).alias("coerced"), (supp % 2 == 0).alias("handwritten"), (supp % 3).alias("n_vision_reads"), F.lit(False).alias("missing"))
    return documents.confidence(e).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("confidence") * 20 + 0.97).cast("double").alias("fifth"), F.array_join(F.transform("caps_applied", lambda c: F.concat(c, F.lit(";"))), "").alias("caps"))


@query("p26_legibility", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(greatest(0.0, CASE WHEN l_linenumber % 2 = 0 THEN (1.0 + 0.25) / 2 ELSE 0.5 END - 0.15 * (l_suppkey % 3)), 4) AS legibility FROM lineitem")
def p26_legibility(spark, sf_dir):
    labels = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("clear"), F.lit("poor"), F.lit(""))).otherwise(F.array(F.lit("smudged")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(documents.legibility(labels, F.col("l_suppkey") % 3), 4).alias("legibility"))


@query("p27_needs_review", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_discount < 0.05")
def p27_needs_review(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(documents.badge(F.col("l_discount") * 10, 0.5) != "green").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


_ACTION_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(reason), '{w}')" for w in words) + f" THEN '{a}'" for words, a in documents.ACTIONS) + " ELSE 'Visually verify ''' || o_orderpriority || ''' against the source image and approve or correct it.' END"
_REASONS = ("independent reads disagree", "value not found", "validation: MRZ checksum", "validation: format", "normalisation: position 1", "classifier below threshold", "confidence 0.70 below threshold", "unsupported type")


@query("p37_action", f"WITH r AS (SELECT o_orderkey, o_orderpriority, ({list(_REASONS)!r})[CAST(o_orderkey % {len(_REASONS)} AS INT) + 1] AS reason FROM orders) SELECT o_orderkey, {_ACTION_SQL} AS action FROM r")
def p37_action(spark, sf_dir):
    reason = F.get(F.array(*map(F.lit, _REASONS)), (F.col("o_orderkey") % len(_REASONS)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.suggested_action(reason, F.col("o_orderpriority")).alias("action"))


def _order_fields(spark, sf_dir):
    """Orders as documents and their lines as fields, for the reports."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("d"))
    key = F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"))
    low = F.col("d") < 0.05
    fields = lines.select(key.alias("document_id"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("field"), F.when(F.col("d") > 0, F.col("d").cast("decimal(4,2)").cast("string")).alias("raw_value"), F.array().cast("array<string>").alias("candidates"), (F.col("d") * 10).alias("confidence"), low.alias("review_required"), F.when(low, F.array(F.lit("validation: below"))).otherwise(F.array().cast("array<string>")).alias("review_reasons"), F.col("l_linenumber").alias("page"))
    docs = table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("document_id"), F.col("o_orderpriority").alias("source_file"), F.array(F.lit(1), F.lit(2)).alias("pages"), F.col("o_orderstatus").alias("document_type"), F.lit(0.5).alias("confidence"), (F.col("o_orderstatus") == "P").alias("review_required"), F.lit("e").alias("evidence"), F.array(F.lit("classifier unsure"), F.lit("other")).alias("warnings"), F.lit(0.85).alias("threshold"))
    return docs, fields


_F_SQL = "f AS (SELECT 'order-' || l_orderkey AS document_id, l_linenumber, min(l_discount) AS d FROM lineitem GROUP BY 1, 2), o AS (SELECT 'order-' || o_orderkey AS document_id, o_orderpriority AS source_file, o_orderstatus AS document_type FROM orders)"


@query(
    "p36_flag_rows",
    f"""WITH {_F_SQL}
        SELECT source_file, document_id, '1,2' AS page, document_type AS predicted_document_type, '(document classification)' AS field_name, 'e' AS raw_candidate, 0.5 AS confidence, 0.85 AS threshold, 'classifier unsure' AS review_reason, 'Confirm the predicted document type.' AS suggested_reviewer_action FROM o WHERE document_type = 'P'
        UNION ALL SELECT source_file, document_id, CAST(l_linenumber AS VARCHAR), document_type, 'line_' || l_linenumber, CASE WHEN d > 0 THEN CAST(CAST(d AS DECIMAL(4,2)) AS VARCHAR) ELSE '' END, round(d * 10, 6), 0.85, 'validation: below', 'Check the value against the image; if read correctly, the source document itself fails the format rule.' FROM f JOIN o USING (document_id) WHERE d < 0.05""",
)
def p36_flag_rows(spark, sf_dir):
    return documents.flag_rows(*_order_fields(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    "a10_summary",
    f"""WITH {_F_SQL}, s AS (SELECT document_id, round(avg(d * 10), 3) AS mean_field_confidence, count(*) AS fields_total, count(*) FILTER (WHERE NOT d < 0.05) AS fields_auto_accepted, count(*) FILTER (WHERE d < 0.05) AS fields_for_review, count(*) FILTER (WHERE NOT d > 0) AS fields_missing FROM f GROUP BY 1)
        SELECT document_id, source_file, '1,2' AS pages, document_type, 0.5 AS classification_confidence, mean_field_confidence, coalesce(fields_total, 0) AS fields_total, coalesce(fields_auto_accepted, 0) AS fields_auto_accepted, coalesce(fields_for_review, 0) AS fields_for_review, coalesce(fields_missing, 0) AS fields_missing,
               document_type = 'P' OR coalesce(fields_for_review > 0, false) AS document_review_required FROM o LEFT JOIN s USING (document_id)""",
)
def a10_summary(spark, sf_dir):
    return documents.summary_rows(*_order_fields(spark, sf_dir))


@query("a11_batch_metrics", f"WITH {_F_SQL} SELECT (SELECT count(*) FROM o) AS documents, count(*) FILTER (WHERE NOT d < 0.05) AS accepted, count(*) AS fields FROM f JOIN o USING (document_id)")
def a11_batch_metrics(spark, sf_dir):
    docs, fields = _order_fields(spark, sf_dir)
    rows = documents.summary_rows(docs, fields)
    return rows.agg(F.count("*").alias("documents"), F.sum("fields_auto_accepted").alias("accepted"), F.sum("fields_total").alias("fields"))


@query("a12_usage", "SELECT event_type AS model, count(*) FILTER (WHERE user_id % 3 = 0) AS live, count(*) FILTER (WHERE user_id % 3 = 1) AS cached, count(*) FILTER (WHERE user_id % 3 = 2) AS failed FROM events GROUP BY 1")
def a12_usage(spark, sf_dir):
    state = F.get(F.array(F.lit("live"), F.lit("cached"), F.lit("failed")), (F.col("user_id") % 3).cast("int"))
    return providers.usage(table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), state.alias("state")))


@query("a13_rollup", "SELECT c_mktsegment AS method, CAST(c_nationkey AS VARCHAR) AS error, string_agg(c_name, ', ' ORDER BY c_name) AS fields FROM customer GROUP BY 1, 2")
def a13_rollup(spark, sf_dir):
    return documents.failed_passes(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").cast("string").alias("error"), F.col("c_name").alias("field")))


@query("p38_doc_id", "SELECT doc_id, substr(sha1(text), 1, 10) || '-p' || doc_id || '-' || (doc_id + 1) AS document_id FROM documents")
def p38_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", documents.document_id(F.col("text").cast("binary"), F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("document_id"))


@query("p21_sanitise_groups", "SELECT * FROM (VALUES ('a', '1', 'passport', 0.9), ('a', '2', 'pan_card', 0.8), ('b', '1,2', 'unknown_or_other', 0.0)) AS t(sha1, pages, document_type, confidence)")
def p21_sanitise_groups(spark, sf_dir):
    groups = spark.createDataFrame([("a", 0, [1, 1, 7], "passport", 0.9), ("a", 1, [1, 2], "pan_card", 0.8)], "sha1 string, group_pos int, pages array<int>, document_type string, confidence double")
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "sha1 string, page_no int")
    out = documents.sanitise_groups(groups, pages)
    return out.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(
    "p28_ocr_support",
    r"""WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[\s.,]', '', 'g')) AS have, upper(regexp_replace(lang || ' ' || source, '[\s.,]', '', 'g')) AS want FROM documents)
        SELECT doc_id, CASE WHEN have IS NULL OR have = '' THEN NULL ELSE 1.0 END AS support FROM d""",
)
def p28_ocr_support(spark, sf_dir):
    """Whether each document's whole text, after which its language and source are written, supports these: texts that hold the value are settled in the JVM."""
    key = F.concat_ws(" ", "lang", "source")
    text = F.when(F.coalesce(F.regexp_replace("text", r"[\s.,]", ""), F.lit("")) != "", F.concat("text", F.lit(" "), key))
    return table(spark, sf_dir, "documents").select("doc_id", fuzzy.ocr_support(key, text).alias("support"))


@query("p28_best_window")
def p28_best_window(spark, sf_dir):
    """How far each product's name is supported by its brand and type: short texts, none of which holds it."""
    return table(spark, sf_dir, "part").select("p_partkey", fuzzy.ocr_support(F.col("p_name"), F.concat("p_brand", "p_type", F.lit(" "), "p_name", F.lit("x")).substr(F.lit(1), F.length("p_name") + F.lit(20))).alias("support"))


@query("p30_anchor_region", "SELECT p_partkey, p_size - 12 AS x0, p_size * 2 - 21 AS y0, least(1000, p_size + 10 + 450) AS x1, p_size * 2 + 5 + 21 AS y1 FROM part")
def p30_anchor_region(spark, sf_dir):
    s = F.col("p_size")
    box = F.struct(s.alias("x0"), (s * 2).alias("y0"), (s + 10).alias("x1"), (s * 2 + 5).alias("y1"))
    return table(spark, sf_dir, "part").select("p_partkey", fuzzy.anchor_region(box, F.lit("right"), F.lit(1000), F.lit(1400)).alias("r")).select("p_partkey", "r.*")


@query("p41_page_quality", "SELECT p_partkey, round(0.45 * least(1.0, (p_size * 9.7 + 0.31) / 300.0) + 0.30 * least(1.0, (p_size + 0.3) / 60.0) + 0.25 * least(1.0, p_retailprice / 1003.7), 3) AS quality FROM part")
def p41_page_quality(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", documents.page_quality(F.col("p_size") * 9.7 + 0.31, F.col("p_size") + 0.3, F.col("p_retailprice") * (1000 / 1003.7)).alias("quality"))


def _grid(spark):
    rows = [(0, ["Stock report", None, None], ["text", "null", "null"]), (1, [None, None, None], ["null"] * 3), (2, ["Product ID", "Opening \nStock", "Price (USD)"], ["text"] * 3), (3, ["P1", "5", "2.5"], ["text", "number", "number"]), (4, ["P2", None, "3"], ["text", "null", "number"]), (5, [None, None, None], ["null"] * 3)]
    return spark.createDataFrame(rows, "row_idx int, cells array<string>, cell_kind array<string>")


@query("s1_load_grid", "SELECT * FROM (VALUES ('P1', 5, 2.5), ('P2', NULL, 3.0)) AS t(product_id, opening_stock, price_usd)")
def s1_load_grid(spark, sf_dir):
    return grid.load_grid(_grid(spark))


@query("s2_header_detect", "SELECT 2 AS header_row")
def s2_header_detect(spark, sf_dir):
    return spark.createDataFrame([(grid.header_row(_grid(spark)),)], "header_row int")


@query(
    "s6_infer",
    """SELECT 'c_custkey' AS name, 'bigint' AS kind UNION ALL SELECT 'c_acctbal', CASE WHEN (SELECT bool_and(c_acctbal % 1 = 0) FROM customer) THEN 'bigint' ELSE 'double' END UNION ALL SELECT 'c_name', 'string'""",
)
def s6_infer(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_acctbal", "c_name")])
    return spark.createDataFrame(list(grid.infer_types(rows).items()), "name string, kind string")


@query(
    "s9_content_hash",
    "SELECT page_id, sha1(html) AS sha1, CASE WHEN html = '' THEN 'empty file' WHEN page_id % 2 = 0 THEN 'could not decode the file' ELSE 'unsupported file type .html' END AS error FROM pages",
)
def s9_content_hash(spark, sf_dir):
    suffix = F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".html")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("x/"), F.col("page_id").cast("string"), suffix).alias("path"), F.col("html").cast("binary").alias("content"))
    return files.gate(rows).select(F.regexp_extract("name", "^[0-9]+", 0).cast("bigint").alias("page_id"), "sha1", "error")


@query(
    "s23_fallback",
    """SELECT CAST(user_id AS VARCHAR) AS query, event_type AS provider FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, event_id) AS n FROM events) WHERE n = 1""",
)
def s23_fallback(spark, sf_dir):
    source = F.struct(F.lit("t").alias("title"), F.lit("https://example.org").alias("url"), F.lit("").alias("snippet"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("provider"), F.col("event_id").alias("priority"), F.lit("a").alias("answer"), F.when(F.col("value") > 50, F.array(source)).otherwise(F.array().cast("array<struct<title:string,url:string,snippet:string>>")).alias("sources"), F.lit(None).cast("string").alias("error"))
    return providers.fallback(rows).select("query", "provider")


@query("s16_first_items", "SELECT document_id, field, value FROM (SELECT o_custkey AS document_id, o_orderpriority AS field, nullif(o_orderstatus, 'P') AS value, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def s16_first_items(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("field"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("value"))
    return providers.first_items(rows).select("document_id", "field", "value")


@query("s18_expected_reads", "SELECT c_custkey AS document_id, CASE WHEN s_suppkey IS NULL THEN 'field missing from batched response' END AS error FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def s18_expected_reads(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("f").alias("field"))
    got = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), F.lit("f").alias("field"), F.lit(None).cast("string").alias("error"))
    return providers.expected_reads(expected, got, "vision_crop").select("document_id", "error")


@query("j9_cache_anti", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def j9_cache_anti(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", providers.request_key(F.lit("p"), F.lit("m"), F.col("doc_id"), F.sha1("text")).alias("request_key"))
    return providers.unanswered(keyed, keyed.where("doc_id % 3 = 0")).select("doc_id")


@query("q_safe_sql", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 200")
def q_safe_sql(spark, sf_dir):
    done = safe_sql.run(table(spark, sf_dir, "part"), "SELECT p_brand, count(*) AS n FROM df WHERE p_size > 10 GROUP BY p_brand ORDER BY n DESC, p_brand", seconds=120)
    if not done.ok:
        raise RuntimeError(done.error)
    return done.rows


@query(
    "p24_field_assembly",
    f"""WITH {_READS_SQL.replace("CASE WHEN l_quantity < 10 THEN NULL ELSE CAST(l_suppkey % 3 AS VARCHAR) END", "CASE WHEN l_quantity < 10 THEN NULL ELSE 'Read' || chr(CAST(65 + l_suppkey % 3 AS INT)) END")},
    n AS (SELECT l_partkey, key, pos, row_number() OVER (PARTITION BY l_partkey ORDER BY pos, key) AS rn FROM r), q AS (SELECT * FROM n),
    k AS (SELECT l_partkey, key, count(*) AS c, min(rn) AS first FROM q WHERE key IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT l_partkey, key, c, row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, first) AS o, max(c) OVER (PARTITION BY l_partkey) AS most FROM k),
    t AS (SELECT l_partkey, max(key) FILTER (WHERE o = 1) AS top_key, max(c) AS top, count(*) AS d, count(*) FILTER (WHERE c = most) > 1 AS tied FROM m GROUP BY 1),
    a AS (SELECT l_partkey, count(*) AS reads FROM q GROUP BY 1)
    SELECT CAST(a.l_partkey AS VARCHAR) AS document_id, CASE WHEN NOT coalesce(d > 1 AND (top < 2 OR tied), false) THEN top_key END AS raw_value, top_key IS NULL OR coalesce(d > 1 AND (top < 2 OR tied), false) AS withheld, coalesce(d, 0) AS n_candidates, reads AS n_reads FROM a LEFT JOIN t USING (l_partkey)""",
)
def p24_field_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_quantity") >= 10, F.concat(F.lit("Read"), F.char(65 + F.col("l_suppkey") % 3))).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"))
    rn = F.row_number().over(Window.partitionBy("l_partkey").orderBy("p", F.col("value").asc_nulls_last()))
    method = F.get(F.array(F.lit("vision_full_page"), F.lit("vision_crop"), F.lit("vision_crop_binarized")), (F.col("pos") - 1) % 3)
    reads = rows.withColumn("pos", rn).select(F.col("l_partkey").cast("string").alias("document_id"), F.lit("bank_name").alias("field"), "pos", method.alias("method"), "value", F.lit("clear").alias("legibility"), F.array().cast("array<string>").alias("ambiguous"), F.lit(True).alias("label_visible"), F.lit(None).cast("string").alias("error"))
    ids = reads.select("document_id").distinct()
    specs = ids.select("document_id", F.lit("bank_name").alias("field"), F.lit("text").alias("validator"), F.lit("handwritten").alias("kind"), F.array().cast("array<string>").alias("options"))
    context = ids.select("document_id", F.lit("bank_name").alias("field"), F.lit(None).cast("double").alias("ocr"), F.lit(1.0).alias("proximity"), F.lit(0.9).alias("image_quality"), F.lit("r").alias("region_desc"))
    out = documents.resolve_fields(specs, reads, context, as_of())
    n_reads = F.size(F.filter("method", lambda m: m.startswith("vision")))
    return out.select("document_id", "raw_value", (F.col("raw_value").isNull()).alias("withheld"), F.size("candidates").cast("bigint").alias("n_candidates"), n_reads.cast("bigint").alias("n_reads"))
