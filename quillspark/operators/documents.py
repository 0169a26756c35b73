"""Scored document fields: vote, sanitise, agree, score, check, report.

All of it is relational: ``field_reads`` (document_id, field, pos, method, value, legibility,
ambiguous, label_visible, error) joins the catalogue of fields, and every step is a group, a
window or a CASE.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validators import comparison_key, mrz_date, mrz_part, validate, words_to_number

THRESHOLD = 0.85
# Weights of the evidence, scores of legibility labels, and caps in the order in which they are tried.
WEIGHTS = {"agreement": 0.35, "validation": 0.20, "legibility": 0.15, "ocr": 0.10, "proximity": 0.10, "image_quality": 0.10}
HANDWRITTEN_OCR = 0.05
LEGIBILITY = {"clear": 1.0, "partial": 0.6, "poor": 0.25, "absent": 0.0}
CAPS = (
    (0.40, "NOT majority", "independent reads disagree (no majority)"),
    (0.75, "some_read_empty", "at least one independent read found no value"),
    (0.70, "validation = 0", "format/checksum validation failed"),
    (0.84, "coerced", "confusable characters were normalised"),
    (0.80, "handwritten AND n_vision_reads < 2", "fewer than two vision reads for a handwritten field"),
)
# Fields whose values may be seen elsewhere in a batch.
HINT_GROUPS = {"application_number": "application/policy number", "policy_number": "application/policy number", "place": "place", "place_of_birth": "place"}


def keyword_pattern(keyword: str) -> str:
    """A whole word or phrase: no letter or digit on either side."""
    return f"(?<![a-z0-9]){re.escape(keyword)}(?![a-z0-9])"


def has_keyword(lowered: Column, keyword: str) -> Column:
    """Whether a lower-case text has a keyword; the pattern is tried only where its letters stand."""
    return F.contains(lowered, F.lit(keyword)) & F.regexp_like(lowered, F.lit(keyword_pattern(keyword)))


def keyword_vote(texts: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, best_type, best, runner_up, vote): the type of most distinct keywords, if two at least and strictly ahead.

    ``keywords`` (type, keyword) is a catalogue of tens of rows; each becomes a literal pattern, so texts are
    neither joined with it nor is a pattern compiled for a row.
    """
    listed: dict[str, list[str]] = {}
    for r in keywords.distinct().orderBy("type", "keyword").collect():
        listed.setdefault(r["type"], []).append(r["keyword"])
    lowered = texts.select(key, F.lower("text").alias("_low"))
    count = lambda words: reduce(add, [F.coalesce(has_keyword(F.col("_low"), w).cast("int"), F.lit(0)) for w in words])
    scored = lowered.select(key, F.array(*[F.struct((-count(words)).alias("n"), F.lit(t).alias("type")) for t, words in listed.items()]).alias("s"))
    ranked = scored.select(key, F.array_sort("s").alias("s"))
    best, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    n, runner = -best["n"], F.coalesce(-second["n"], F.lit(0))
    return ranked.select(key, best["type"].alias("best_type"), n.alias("best"), runner.alias("runner_up"), F.when((n >= 2) & (n > runner), best["type"]).alias("vote"))


def sanitise_groups(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """(sha1, pages, document_type, confidence): every page in one group, the first that claims it; pages that none claims are unknown.

    ``groups``: sha1, group_pos, pages, document_type, confidence.  ``pages``: sha1, page_no.
    """
    claims = groups.select("sha1", "group_pos", "document_type", "confidence", F.explode("pages").alias("page_no")).join(pages, ["sha1", "page_no"])
    first = claims.withColumn("n", F.row_number().over(Window.partitionBy("sha1", "page_no").orderBy("group_pos"))).where("n = 1")
    held = first.groupBy("sha1", "group_pos").agg(F.sort_array(F.collect_list("page_no")).alias("pages"), F.first("document_type").alias("document_type"), F.first("confidence").alias("confidence"))
    free = pages.join(first, ["sha1", "page_no"], "left_anti").groupBy("sha1").agg(F.sort_array(F.collect_list("page_no")).alias("pages")).withColumns({"group_pos": F.lit(None).cast("int"), "document_type": F.lit("unknown_or_other"), "confidence": F.lit(0.0)})
    return held.unionByName(free).select("sha1", "pages", "document_type", "confidence").orderBy("sha1", F.element_at("pages", 1))


def document_id(content: Column, pages: Column) -> Column:
    return F.concat(F.substring(F.sha1(content), 1, 10), F.lit("-p"), F.array_join(pages.cast("array<string>"), "-"))


def classification_score(model: Column, document_type: Column, vote: Column, threshold: float = THRESHOLD) -> Column:
    """struct(confidence, review_required): 0.6 of the model's and 0.4 of the keywords' word, 0.5 of it where they have none."""
    agree = F.when(vote.isNull(), 0.5).when(vote == document_type, 1.0).otherwise(0.0)
    confidence = F.bround(0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), model)) + 0.4 * agree, 3)
    return F.struct(confidence.alias("confidence"), ((document_type == "unknown_or_other") | (confidence < threshold)).alias("review_required"))


def consensus(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, top_key, top_count, n_distinct, n_reads, n_empty, tied, disagreement, agreement.

    ``reads`` has ``key`` (null: an empty read) and ``pos``; failed reads are left out before.  The
    most frequent key wins, the first seen of equals.
    """
    by_key = reads.where("key IS NOT NULL").groupBy(*keys, "key").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(*keys)
    ranked = by_key.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "first", "key"))).withColumn("most", F.max("n").over(w))
    top = ranked.groupBy(*keys).agg(F.max(F.when(F.col("r") == 1, F.col("key"))).alias("top_key"), F.max("n").alias("top_count"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") == F.col("most")).alias("n_top"))
    seen = reads.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.count_if(F.col("key").isNull()).alias("n_empty"))
    out = seen.join(top, keys, "left").withColumn("tied", F.coalesce(F.col("n_top") > 1, F.lit(False)))
    out = out.withColumn("disagreement", F.coalesce((F.col("n_distinct") > 1) & ((F.col("top_count") < 2) | F.col("tied")), F.lit(False)))
    return out.withColumn("agreement", F.when(F.col("disagreement"), 0.0).otherwise(F.col("top_count") / F.col("n_reads"))).drop("n_top")


def legibility(labels: Column, ambiguous: Column) -> Column:
    """Mean score of the labels that aren't blank, less 0.15 for each ambiguous character; null without labels."""
    known = F.create_map(*[x for k, v in LEGIBILITY.items() for x in (F.lit(k), F.lit(v))])
    values = F.transform(F.filter(labels, lambda x: x.isNotNull() & (x != "")), lambda x: F.coalesce(known[x], F.lit(0.5)))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.when(F.size(values) > 0, F.greatest(F.lit(0.0), mean - 0.15 * ambiguous))


def confidence(evidence: DataFrame) -> DataFrame:
    """``evidence`` with confidence and caps_applied.

    Weights of what is known are brought to a sum of one; caps are listed if they lower the value reached so far.
    """
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        own = F.when(F.col("handwritten"), HANDWRITTEN_OCR).otherwise(w) if name == "ocr" else F.lit(w)
        value = F.col(name)
        total = total + F.when(value.isNull(), 0.0).otherwise(own * F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
        weight = weight + F.when(value.isNull(), 0.0).otherwise(own)
    base = F.when(weight > 0, total / weight).otherwise(0.0)
    out = evidence.withColumn("_now", base).withColumn("caps_applied", F.array().cast("array<string>"))
    for cap, when, reason in CAPS:
        lowers = F.coalesce(F.expr(when), F.lit(False)) & (F.col("_now") > cap)
        out = out.withColumn("caps_applied", F.when(lowers, F.array_append("caps_applied", F.lit(f"{reason} -> capped at {cap:.2f}".replace("0.40", "0.4").replace("0.70", "0.7").replace("0.80", "0.8")))).otherwise(F.col("caps_applied")))
        out = out.withColumn("_now", F.when(lowers, cap).otherwise(F.col("_now")))
    gone = F.col("missing")
    out = out.withColumn("confidence", F.when(gone, 0.0).otherwise(F.bround("_now", 3)))
    return out.withColumn("caps_applied", F.when(gone, F.array(F.lit("missing value -> 0.0"))).otherwise(F.col("caps_applied"))).drop("_now")


def _list(*items: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in items]), lambda x: x.isNotNull())


def resolve_fields(specs: DataFrame, reads: DataFrame, context: DataFrame, as_of: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each expected field of each document, from independent reads.

    ``specs``: document_id, field, validator, kind, options.  ``reads``: document_id,
    field, pos, method, value, legibility, ambiguous, label_visible, error.
    ``context``: document_id, field, ocr, proximity, image_quality, region_desc.
    Returns the value (withheld where reads disagree), its candidates, method trail,
    evidence, confidence, review flag and reasons in a fixed order.
    """
    key = ["document_id", "field"]
    own = specs.join(reads, key, "left")
    own = own.withColumn("value", F.when(F.trim("value") != "", F.trim("value")))
    own = own.withColumn("v", F.when(F.col("value").isNotNull(), validate(F.col("validator"), F.col("value"), F.col("options"), as_of)))
    own = own.withColumn("key", F.when(F.col("error").isNull(), comparison_key(F.col("v.normalized"), F.col("value"))))
    good = own.where("method IS NOT NULL AND error IS NULL")
    agreed = consensus(good, key)
    preference = F.when(F.col("kind") != "printed", F.when(F.col("method") == "vision_crop", 0).when(F.col("method") == "vision_crop_binarized", 1).otherwise(2)).otherwise(F.when(F.col("method") == "vision_full_page", 0).otherwise(1))
    with_top = good.join(agreed.select(*key, "top_key"), key).withColumn("agrees", F.coalesce(F.col("key") == F.col("top_key"), F.lit(False))).withColumn("preference", preference)
    by = F.struct("preference", "pos")
    rolled = with_top.groupBy(*key).agg(
        F.min_by(F.when(F.col("agrees"), F.col("value")), F.when(F.col("agrees"), by)).alias("chosen"),
        F.min_by(F.when(F.col("agrees"), F.col("v")), F.when(F.col("agrees"), by)).alias("verdict"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("pos", "value")))), lambda x: x["value"]).alias("values"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "method"))), lambda x: x["method"]).alias("method"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("key").isNull(), F.struct("pos", "method")))), lambda x: x["method"]).alias("empty_methods"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("pos", F.concat("method", F.lit("='"), "value", F.lit("'")).alias("t"))))), lambda x: x["t"]).alias("said"),
        F.collect_list(F.when(F.col("agrees"), F.col("legibility"))).alias("labels"),
        F.max_by(F.when(F.col("agrees"), F.col("ambiguous")), F.struct(F.when(F.col("agrees"), F.size("ambiguous")), -F.col("preference"), -F.col("pos"))).alias("ambiguous"),
        F.bool_or(F.coalesce("label_visible", F.lit(False))).alias("label_seen"),
    )
    failed = own.where("error IS NOT NULL").groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "error"))), lambda x: F.concat(F.lit("a vision pass failed: "), x["error"])).alias("failed"))
    rows = specs.join(agreed, key, "left").join(rolled, key, "left").join(failed, key, "left").join(context, key, "left")
    none = F.array().cast("array<string>")
    n_ambiguous = F.coalesce(F.size("ambiguous"), F.lit(0))
    rows = rows.withColumns(
        {
            "missing": F.col("top_key").isNull(),
            "handwritten": F.col("kind") != "printed",
            "disagreement": F.coalesce("disagreement", F.lit(False)),
            "majority": ~F.coalesce("disagreement", F.lit(False)),
            "n_vision_reads": F.coalesce("n_reads", F.lit(0)),
            "some_read_empty": F.coalesce(F.col("n_empty") > 0, F.lit(False)),
            "coerced": F.coalesce(F.col("verdict.coerced"), F.lit(False)),
            "validation": F.col("verdict.passed").cast("double"),
            "n_ambiguous": F.greatest(n_ambiguous, F.lit(0)),
            "proximity": F.when((F.col("proximity") == 0.5) & F.coalesce("label_seen", F.lit(False)), 0.8).otherwise(F.col("proximity")),
        }
    )
    scored = confidence(rows.withColumn("legibility", legibility(F.coalesce("labels", none), F.col("n_ambiguous"))))
    invalid = F.col("verdict.passed") == False  # noqa: E712
    noted = lambda head: F.transform(F.coalesce("verdict.notes", none), lambda n: F.concat(F.lit(head), n))
    reasons = F.concat(
        F.coalesce("failed", none),
        _list((F.col("missing"), F.lit("value not found or unreadable in any pass"))),
        F.when(
            ~F.col("missing"),
            F.concat(
                _list((F.col("disagreement"), F.concat(F.lit("independent reads disagree: "), F.array_join("said", " | ")))),
                F.when(invalid, noted("validation: ")).when(F.col("coerced"), noted("normalisation: ")).otherwise(none),
                _list(
                    (F.col("some_read_empty"), F.concat(F.lit("some passes returned no value: "), F.array_join("empty_methods", ", "))),
                    (F.col("n_ambiguous") > 0, F.concat(F.lit("ambiguous characters reported: "), F.array_join(F.slice("ambiguous", 1, 4), "; "))),
                    (F.col("proximity") < 1, F.concat(F.lit("label proximity not fully confirmed ("), "region_desc", F.lit(")"))),
                ),
                F.col("caps_applied"),
            ),
        ).otherwise(none),
    )
    low = F.concat(F.lit("confidence "), F.format_number("confidence", 2), F.lit(f" below threshold {threshold:.2f}"))
    review = F.col("missing") | (F.col("confidence") < threshold) | F.col("disagreement") | F.coalesce(invalid, F.lit(False))
    out = scored.withColumn("review_required", review).withColumn("_r", F.array_distinct(reasons))
    flagged = F.when(F.col("missing"), F.col("_r")).when(F.size("_r") == 0, F.array(low)).when(F.col("confidence") < threshold, F.concat(F.array(low), "_r")).otherwise(F.col("_r"))
    withheld = F.col("missing") | F.col("disagreement")
    trail = F.concat(F.coalesce("method", none), F.when(F.col("ocr").isNotNull(), F.array(F.lit("ocr_tesseract"))).otherwise(none), F.when(F.col("verdict.passed").isNotNull(), F.array(F.lit("validator"))).otherwise(none))
    return out.select(
        *key,
        F.when(~withheld, F.col("chosen")).alias("raw_value"),
        F.when(~withheld, F.col("verdict.normalized")).alias("normalized_value"),
        "confidence",
        trail.alias("method"),
        "review_required",
        F.when(F.col("review_required"), flagged).otherwise(F.filter("_r", lambda r: r.startswith("validation"))).alias("review_reasons"),
        "handwritten",
        F.array_distinct(F.coalesce("values", none)).alias("candidates"),
        F.struct(*[F.bround(c, 3).alias(c) for c in WEIGHTS]).alias("confidence_components"),
    )


def _conflict(fields: DataFrame, found: DataFrame, cap: float = 0.6) -> DataFrame:
    """Cap what a check found (document_id, field, reason) and send it to review."""
    grouped = found.groupBy("document_id", "field").agg(F.sort_array(F.collect_list("reason")).alias("_why"))
    both = fields.join(grouped.hint("merge"), ["document_id", "field"], "left")
    hit = F.col("_why").isNotNull()
    return both.withColumns({"confidence": F.when(hit, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")), "review_required": F.col("review_required") | hit, "review_reasons": F.when(hit, F.concat("review_reasons", "_why")).otherwise(F.col("review_reasons"))}).drop("_why")


def cross_field_checks(fields: DataFrame, types: DataFrame, as_of: Column) -> DataFrame:
    """``fields`` after the checks within each document: passport and MRZ, dates in order, figures and words, no future dates.

    ``types``: document_id, document_type.  Absent values are in no conflict.
    Fields are often unpivoted from wide rows, which Spark takes for less than they are; so nothing of them is broadcast, and
    they are shuffled before they are sorted by document.
    """
    value = F.col("normalized_value")
    one = lambda name, c=value: F.max(F.when(F.col("field") == name, c)).alias(name)
    wide = fields.repartition("document_id").groupBy("document_id").agg(*[one(n) for n in ("passport_number", "date_of_birth", "date_of_expiry", "mrz_line_2", "date_of_issue", "valid_till", "amount_in_figures")], one("amount_in_words", F.col("raw_value")))
    wide = wide.hint("merge").join(types.repartition("document_id").distinct(), "document_id")
    mrz, kind = F.when(F.length("mrz_line_2") == 44, F.col("mrz_line_2")), F.col("document_type")
    says = {"passport_number": F.regexp_replace(mrz_part(mrz, "document_number"), "<", ""), "date_of_birth": mrz_date(mrz_part(mrz, "birth_date"), True, as_of), "date_of_expiry": mrz_date(mrz_part(mrz, "expiry_date"), False, as_of)}
    today = F.date_format(as_of, "yyyy-MM-dd")
    words = words_to_number(F.col("amount_in_words"))
    checks = [(kind == "passport", n, F.col(n) != v, F.concat(F.lit("conflicts with MRZ value "), v)) for n, v in says.items()]
    checks += [
        (kind == "passport", "date_of_expiry", F.col("date_of_expiry") <= F.col("date_of_birth"), F.lit("expiry date is not after date of birth")),
        (kind == "driving_licence", "valid_till", F.col("valid_till") <= F.col("date_of_issue"), F.lit("valid-till date is not after the issue date")),
        (kind == "driving_licence", "date_of_issue", F.col("valid_till").isNotNull() & (F.col("date_of_issue") > today), F.lit("issue date is in the future")),
        (kind == "nach_ecs_mandate", "amount_in_figures", words.cast("string") != F.substring_index("amount_in_figures", ".", 1), F.concat(F.lit("amount in figures differs from amount in words ("), words.cast("string"), F.lit(")"))),
    ]
    found = wide.select("document_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(k & c, F.lit(False)), F.struct(F.lit(n).alias("field"), r.alias("reason"))) for k, n, c, r in checks]), lambda x: x.isNotNull())).alias("x")).select("document_id", "x.*")
    late = fields.hint("merge").join(types, "document_id").where(F.col("field").startswith("date") & ~kind.isin("passport", "driving_licence") & (value > today)).select("document_id", "field", F.lit("date is in the future").alias("reason"))
    return _conflict(fields, found.unionByName(late))


def cross_document_hints(fields: DataFrame, files: DataFrame) -> DataFrame:
    """``fields`` with hints on flagged ones: the first two values of their group that other files hold for sure.

    Values are pre-aggregated to (group, value) with the files' least and greatest names, so a value that many
    documents share is one row, and only two values of a group can ever be shown.
    """
    group = F.create_map(*[x for k, v in HINT_GROUPS.items() for x in (F.lit(k), F.lit(v))])[F.col("field")]
    rows = fields.join(files, "document_id").withColumn("grp", group)
    sure = rows.where("grp IS NOT NULL AND normalized_value IS NOT NULL AND NOT review_required").groupBy("grp", "normalized_value").agg(F.min("source_file").alias("lo"), F.max("source_file").alias("hi"))
    # a value counts for a file if any other file has it; three values suffice to have two for every file but those of one file alone
    several = sure.where("lo <> hi").withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("normalized_value"))).where("n <= 2")
    single = sure.where("lo = hi").withColumn("n", F.row_number().over(Window.partitionBy("grp", "lo").orderBy("normalized_value"))).where("n <= 2")
    first = single.withColumn("m", F.dense_rank().over(Window.partitionBy("grp").orderBy("normalized_value")))
    # of the values of single files the least two of each file, and of these the least of the group: four cover any one file's absence
    listed = several.select("grp", "normalized_value", F.lit(None).cast("string").alias("only")).unionByName(first.where("m <= 4").select("grp", "normalized_value", F.col("lo").alias("only")))
    known = listed.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("normalized_value", "only"))).alias("known"))
    flagged = rows.where("review_required AND grp IS NOT NULL").join(F.broadcast(known), "grp")
    others = F.slice(F.transform(F.filter("known", lambda k: k["only"].isNull() | (k["only"] != F.col("source_file"))), lambda k: k["normalized_value"]), 1, 2)
    hints = flagged.select("document_id", "field", "grp", others.alias("values")).where(F.size("values") > 0)
    text = F.concat(F.lit("review hint only (not used to fill): "), "grp", F.lit(" read confidently elsewhere in this batch as "), F.array_join("values", ", "))
    hints = hints.select("document_id", "field", text.alias("_hint"))
    return fields.join(hints, ["document_id", "field"], "left").withColumn("review_reasons", F.when(F.col("_hint").isNotNull(), F.array_append("review_reasons", F.col("_hint"))).otherwise(F.col("review_reasons"))).drop("_hint")


# What a reviewer is told, by the first of these words that a reason has.
ACTIONS = (
    (("unsupported", "not one of the ten"), "Confirm the document type; route to the correct workflow or reject it."),
    (("not found", "missing", "not extracted"), "Locate the field on the page and key it in manually, or request a clearer scan."),
    (("disagree",), "Compare the listed candidates against the highlighted region and enter the correct value."),
    (("mrz",), "Re-read the MRZ and visual zone; a mismatch can indicate a misread or an altered document."),
    (("validation", "checksum"), "Check the value against the image; if read correctly, the source document itself fails the format rule."),
    (("normalis", "ambiguous"), "Confirm the ambiguous characters (0/O, 1/I/L, 5/S, 8/B) against the image."),
    (("classifier", "classification"), "Confirm the predicted document type."),
)


def suggested_action(reason: Column, field: Column) -> Column:
    low = F.lower(reason)
    out = F
    for words, action in ACTIONS:
        has = F.lit(False)
        for w in words:
            has = has | low.contains(w)
        out = out.when(has, action)
    return out.otherwise(F.concat(F.lit("Visually verify '"), field, F.lit("' against the source image and approve or correct it.")))


def flag_rows(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """The review queue: documents whose classification needs review, then fields that do.

    ``documents``: document_id, source_file, pages, document_type, confidence, review_required, evidence, warnings, threshold.
    """
    about = F.filter("warnings", lambda w: w.contains("classifier") | w.contains("unsupported") | w.contains("not one of"))
    why = F.when(F.size(about) > 0, F.array_join(about, "; ")).otherwise(F.concat(F.lit("classification confidence "), F.format_number("confidence", 2), F.lit(" below threshold")))
    page = F.array_join(F.col("pages").cast("array<string>"), ",")
    first = documents.where("review_required").select("source_file", "document_id", page.alias("page"), F.col("document_type").alias("predicted_document_type"), F.lit("(document classification)").alias("field_name"), F.col("evidence").alias("raw_candidate"), "confidence", "threshold", why.alias("review_reason"), suggested_action(why, F.lit("document type")).alias("suggested_reviewer_action"))
    rows = fields.where("review_required").join(documents.select("document_id", "source_file", "document_type", "threshold"), "document_id")
    reason = F.when(F.size("review_reasons") > 0, F.array_join("review_reasons", "; ")).otherwise("below threshold")
    lead = F.coalesce(F.get("review_reasons", F.lit(0)), F.lit("below threshold"))
    second = rows.select("source_file", "document_id", F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"), F.col("document_type").alias("predicted_document_type"), F.col("field").alias("field_name"), F.coalesce("raw_value", F.array_join("candidates", " | ")).alias("raw_candidate"), "confidence", "threshold", reason.alias("review_reason"), suggested_action(lead, F.col("field")).alias("suggested_reviewer_action"))
    return first.unionByName(second)


def summary_rows(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for each document: fields in all, accepted, for review and missing, and their mean confidence."""
    counts = fields.groupBy("document_id").agg(F.count("*").alias("fields_total"), F.count_if(~F.col("review_required")).alias("fields_auto_accepted"), F.count_if("review_required").alias("fields_for_review"), F.count_if(F.col("raw_value").isNull() & (F.size("candidates") == 0)).alias("fields_missing"), F.bround(F.avg("confidence"), 3).alias("mean_field_confidence"), F.bool_or("review_required").alias("_any"))
    out = documents.join(counts, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("document_id", "source_file", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "document_type", F.col("confidence").alias("classification_confidence"), zero("fields_total"), zero("fields_auto_accepted"), zero("fields_for_review"), zero("fields_missing"), "mean_field_confidence", (F.col("review_required") | F.coalesce("_any", F.lit(False))).alias("document_review_required"))


def failed_passes(reads: DataFrame) -> DataFrame:
    """(method, error, fields): which fields each failure of a method touched."""
    return reads.where("error IS NOT NULL").groupBy("method", "error").agg(F.array_join(F.sort_array(F.collect_list("field")), ", ").alias("fields"))


def badge(confidence: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(confidence >= threshold, "green").when(confidence >= 0.5, "orange").otherwise("red")


def page_quality(sharpness: Column, contrast: Column, min_side: Column) -> Column:
    """0.45 of sharpness, 0.30 of contrast and 0.25 of resolution, each at most one."""
    part = lambda c, whole: F.least(F.lit(1.0), c / whole)
    return F.bround(0.45 * part(sharpness, 300.0) + 0.30 * part(contrast, 60.0) + 0.25 * part(min_side, 1000.0), 3)
