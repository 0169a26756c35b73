"""Quality rules whose thresholds limit the share of good documents rejected, per stratum.

Rules are ratios of a text in whole thousandths.  For every rule and stratum
(language), the labelled good documents are a holdout on which a cutoff is
chosen: reject what lies above it.  With k of n good documents above a cutoff, the
exact binomial probability of at most k rejections, were the true rate ``ALPHA`` / rules, is the
p-value of the claim that the rate is larger.  The cutoff taken is the
lowest whose p-value is at most ``DELTA`` / (rules * strata) (Bonferroni); as
cutoffs are tried from the highest down and k only grows, that is fixed-sequence
testing and needs no further correction.  So with confidence 1 - DELTA the rules
together reject at most ALPHA of the good documents of every stratum.  A stratum with too few
labelled good documents gets no cutoff, and its documents are not rejected by these rules.

All of it is DataFrame expressions: metrics are one pass over the texts, and the holdout is
aggregated to at most 1,001 values for each rule and stratum before it is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut

ALPHA, DELTA = 0.02, 0.05
RULES = ("symbol_share", "dup_line_share", "repeat_share", "shout_share")
TOP = 1000

_SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows that a text has twice or more.

    Windows are compared by 64-bit hashes.  Without a repeated hash the answer is
    0; else the hashes are sorted with their places, and the words that repeated
    windows cover are summed in order of place.
    """
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(marked, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h))))


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = rows.select(
        "doc_id",
        "stratum",
        _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), F.length(F.regexp_replace(F.array_join(w, ""), "[^A-Z!?]+", "")).alias("shouts"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("x"),
    )
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    return counted.select("doc_id", "stratum", long("w.n_words", "n_words"), long("w.word_chars", "word_chars"), long("n_symbols", "n_symbols"), long("x.n_dup_lines", "n_dup_lines"), long("w.n_repeat_words", "n_repeat_words"), long("x.n_lines", "n_lines"), long("w.shouts", "n_shouts"))


def _share(part: str, whole: str) -> Column:
    return F.expr(f"least({TOP}L, 1000 * {part} div greatest({whole}, 1L))")


def _shares() -> dict[str, Column]:
    return {"symbol_share": _share("n_symbols", "word_chars"), "dup_line_share": _share("n_dup_lines", "n_lines"), "repeat_share": _share("n_repeat_words", "n_words"), "shout_share": _share("n_shouts", "word_chars")}


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Exact P(X <= k) for X ~ Binomial(n, p): terms from k down, each from the one before, while they matter.

    The term at k is taken in logarithms by Stirling's series for log gamma after ten shifts (error below 1e-14).
    """

    def log_gamma(x: Column) -> Column:
        z = x + 10.0
        shift = F.lit(0.0)
        for i in range(10):
            shift = shift + F.log(x + float(i))
        series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
        return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift

    n, k = n.cast("double"), k.cast("double")
    log_term = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    # beyond 40 standard deviations below k the terms add nothing to a double
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p)) + 40)).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), start, lambda a, i: _let(a["t"] * (k - i) / (n - k + i + 1) * ((1 - p) / p), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))), lambda a: a["s"])
    return F.exp(log_term) * total


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff for every rule (null: none), from labelled good documents that pass the base rules."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = measured.join(good, "doc_id", "left_semi").where(~_base_failed())
    shares = _shares()
    long = rows.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), shares[r].alias("value")) for r in RULES])).alias("r")).select("stratum", "r.rule", "r.value")
    counts = long.groupBy("stratum", "rule", "value").agg(F.count("*").alias("c"))
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    ranked = counts.withColumn("above", F.sum("c").over(down) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy("stratum", "rule")))
    tests = F.lit(float(len(RULES))) * F.greatest(F.col("strata"), F.lit(1))
    strata = measured.sparkSession.range(1).join(counts.agg(F.countDistinct("stratum").alias("strata")).hint("broadcast"), how="left").select("strata")
    tested = ranked.join(F.broadcast(strata), F.lit(True)).withColumn("p", _binomial_tail(F.col("n"), F.col("above"), alpha / len(RULES)))
    passed = tested.where(F.col("above") < F.col("n") * (alpha / len(RULES))).where(F.col("p") <= delta / tests)
    lowest = passed.groupBy("stratum", "rule").agg(F.min("value").alias("cutoff"))
    return lowest.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff")).select(F.col("stratum"), *[F.col(r).alias(f"max_{r}") for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the cutoffs that held for each row of ``docs``.

    Null and empty texts have no words, so the base rules reject them.  A null
    language is a stratum of its own, as is the empty one with it.  Repeated rows come back as often; repeated
    labels count once, a document labelled both ways counts as good.  Other columns are not looked at.
    """
    measured = cut(metrics(docs), "rule-metrics")  # a few numbers for each row, read twice
    limits = cutoffs(measured, labels, alpha, delta)  # a row for each stratum
    rows = measured.join(limits.withColumnRenamed("stratum", "_s"), measured["stratum"] == F.col("_s"), "left")
    over = F.lit(False)
    for rule, share in _shares().items():
        over = over | F.coalesce(share > F.col(f"max_{rule}"), F.lit(False))
    rows = rows.withColumn("base_failed", _base_failed())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same rules and cutoffs in SQL: the binomial tail is summed term by term.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(array_to_string(words, ''), '[^A-Z!?]', '', 'g')) AS BIGINT) AS n_shouts
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        [least({TOP}, 1000 * n_symbols // greatest(word_chars, 1)), least({TOP}, 1000 * n_dup_lines // greatest(n_lines, 1)), least({TOP}, 1000 * n_repeat_words // greatest(n_words, 1)), least({TOP}, 1000 * n_shouts // greatest(word_chars, 1))] AS shares FROM m),
h AS (SELECT stratum, unnest(range(1, {len(RULES) + 1})) AS rule, shares FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
v AS (SELECT stratum, rule, shares[rule] AS value, count(*) AS n FROM h GROUP BY 1, 2, 3),
k AS (SELECT stratum, rule, value, sum(n) OVER (PARTITION BY stratum, rule ORDER BY value DESC) - n AS above, sum(n) OVER (PARTITION BY stratum, rule) AS total FROM v),
p AS (SELECT *, list_sum(list_transform(range(0, CAST(above AS BIGINT) + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln({ALPHA / len(RULES)}) + (total - i) * ln(1 - {ALPHA / len(RULES)})))) AS tail FROM k WHERE above < total * {ALPHA / len(RULES)}),
l AS (SELECT stratum, rule, min(value) AS cutoff FROM p WHERE tail <= {DELTA} / ({len(RULES)} * (SELECT greatest(count(DISTINCT stratum), 1) FROM v)) GROUP BY 1, 2),
o AS (SELECT stratum, map_from_entries(list((rule, cutoff))) AS cut FROM l GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT list_bool_or(list_transform(range(1, {len(RULES) + 1}), lambda i: coalesce(shares[i] > cut[i], false))) AS kept
FROM s LEFT JOIN o ON s.stratum = o.stratum
"""
