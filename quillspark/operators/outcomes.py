"""What becomes of a file's documents besides the scored fields: text of page groups, results without a model, what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.privacy import SENSITIVE_FIELDS, mask_field, mask_numbers_in_text
from .documents import THRESHOLD, badge

UNKNOWN = "unknown_or_other"
# What results say where no fields were read.
OFFLINE = "vision model not configured: classification is OCR-keyword only and no fields were extracted"
OFFLINE_EVIDENCE = "OCR keyword vote only (vision model not configured)"
OFFLINE_FIELD = "vision model not configured; field not extracted"
UNSUPPORTED = "unsupported document: no fields extracted; routed to the human-review queue"


def page_group_text(pages: DataFrame, keys: list[str], page: str = "page_no", text: str = "text") -> DataFrame:
    """keys and the texts of a group's pages in their order, with spaces between."""
    held = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["t"]), " ").alias("text"))


def offline_documents(votes: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """Results without a model: the type of the keyword vote (key, vote), confidence 0.4, or unknown with 0; all for review."""
    return votes.select(
        key,
        F.coalesce("vote", F.lit(UNKNOWN)).alias("document_type"),
        F.when(F.col("vote").isNotNull(), 0.4).otherwise(0.0).alias("confidence"),
        F.lit(True).alias("review_required"),
        F.lit(OFFLINE_EVIDENCE).alias("evidence"),
        F.col("vote").alias("keyword_vote"),
        F.lit(threshold).alias("threshold"),
        F.array(F.lit(OFFLINE)).alias("warnings"),
    )


def offline_fields(documents: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """Every expected field of a known type (document_type, field, kind, auxiliary) as missing; auxiliary ones aren't listed."""
    listed = specs.where(~F.coalesce("auxiliary", F.lit(False))).select("document_type", "field", "kind")
    return documents.select(key, "document_type").join(F.broadcast(listed), "document_type").select(key, "field", F.lit(0.0).alias("confidence"), F.lit(True).alias("review_required"), (F.col("kind") != "printed").alias("handwritten"), F.array(F.lit(OFFLINE_FIELD)).alias("review_reasons"))


def short_circuit(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose fields are read, and those of unknown type: for review, with a warning, and without fields."""
    unknown = F.col("document_type") == UNKNOWN
    rest = documents.where(unknown).withColumns({"review_required": F.lit(True), "warnings": F.array_append("warnings", F.lit(UNSUPPORTED))})
    return documents.where(~unknown), rest


def in_file_order(files: list[DataFrame]) -> DataFrame:
    """The documents of several files in the files' order, each numbered by file_pos."""
    out = None
    for i, f in enumerate(files):
        one = f.withColumn("file_pos", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def handwritten_only(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents with a handwritten field."""
    return documents.join(fields.where("handwritten").select("document_id").distinct(), "document_id", "left_semi")


def shown_fields(fields: DataFrame, full: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """document_id, field, value, confidence as a badge, handwritten, methods, review, reasons: masked unless ``full``."""
    value = F.coalesce("normalized_value", "raw_value")
    value = value if full else mask_field(F.col("field"), value)
    reasons = F.array_join("review_reasons", "; ")
    reasons = reasons if full else mask_numbers_in_text(reasons)
    return fields.select(
        "document_id",
        "field",
        F.coalesce(F.nullif(value, F.lit("")), F.lit("— (null)")).alias("value"),
        F.concat(F.when(F.col("review_required"), F.when(badge(F.col("confidence"), threshold) == "red", "red").otherwise("orange")).otherwise("green"), F.lit(" "), F.format_number("confidence", 2)).alias("confidence"),
        F.coalesce("handwritten", F.lit(False)).alias("handwritten"),
        F.array_join("method", ", ").alias("methods"),
        F.when(F.col("review_required"), "REVIEW").otherwise("auto-accept").alias("review"),
        F.substring(reasons, 1, 300).alias("reasons"),
    )


def masked_flags(flags: DataFrame) -> DataFrame:
    """The review queue as it is shown: identifiers in candidates and reasons masked."""
    own = F.when(F.col("field_name").isin(*SENSITIVE_FIELDS), mask_field(F.col("field_name"), F.col("raw_candidate"))).otherwise(mask_numbers_in_text(F.col("raw_candidate")))
    return flags.withColumns({"raw_candidate": own, "review_reason": mask_numbers_in_text(F.col("review_reason"))})


def masked_documents(documents: DataFrame) -> DataFrame:
    """Documents with numbers in their warnings and evidence masked."""
    return documents.withColumns({"warnings": F.transform("warnings", mask_numbers_in_text), "evidence": mask_numbers_in_text(F.col("evidence"))})


def masked_fields(fields: DataFrame) -> DataFrame:
    """Fields with values, candidates, evidence and reasons masked: sensitive ones whole, others where numbers stand in them.

    A missing value stays missing.
    """
    def own(v: Column) -> Column:
        return F.when(v.isNull() | (v == ""), v).when(F.col("field").isin(*SENSITIVE_FIELDS), mask_field(F.col("field"), v)).otherwise(mask_numbers_in_text(v))

    changed = {c: own(F.col(c)) for c in ("raw_value", "normalized_value") if c in fields.columns}
    changed |= {c: mask_numbers_in_text(F.col(c)) for c in ("evidence",) if c in fields.columns}
    changed["candidates"] = F.transform("candidates", lambda c: F.when(F.col("field").isin(*SENSITIVE_FIELDS), mask_field(F.col("field"), c)).otherwise(mask_numbers_in_text(c)))
    changed["review_reasons"] = F.transform("review_reasons", mask_numbers_in_text)
    return fields.withColumns(changed)


def skew(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the median slope, in degrees, of the lines (x1, y1, x2, y2) at most ten degrees off; 0 with fewer than three.

    A page's lines are a bounded group.
    """
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    flat = F.when(F.abs(angle) <= 10, angle)
    return lines.groupBy(*keys).agg(F.when(F.count(flat) >= 3, F.median(flat)).otherwise(0.0).alias("angle"))


def paced(requests: DataFrame, by: str, arrival: str, order: list[str], per_minute: float) -> DataFrame:
    """``requests`` with ``start``, in seconds: each at its arrival, but at least a fixed time after the one before of the same model.

    start(i) is the largest of arrival(j) + (i - j) * interval over j <= i, so it is one running maximum.
    """
    interval = 60.0 / per_minute if per_minute > 0 else 0.0
    w = Window.partitionBy(by).orderBy(arrival, *order)
    numbered = requests.withColumn("_i", F.row_number().over(w))
    ahead = F.max(F.col(arrival) - F.col("_i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start", ahead + F.col("_i") * interval).drop("_i")
