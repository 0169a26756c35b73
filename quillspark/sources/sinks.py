"""Reports as files.  CSV has CRLF line ends, True and False, and nothing for nulls."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAG_COLUMNS = ("source_file", "document_id", "page", "predicted_document_type", "field_name", "raw_candidate", "confidence", "threshold", "review_reason", "suggested_reviewer_action")
SUMMARY_COLUMNS = ("document_id", "source_file", "pages", "document_type", "classification_confidence", "fields_total", "fields_auto_accepted", "fields_for_review", "fields_missing", "mean_field_confidence", "document_review_required")


def csv_cell(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    return F.when(c, "True").when(~c, "False").alias(name) if kind == "boolean" else c.cast("string").alias(name)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """The named columns, in order, as one file with a header; other columns are left out."""
    df.select(*[csv_cell(df, c) for c in columns]).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "").csv(path)


def to_document_json(df: DataFrame) -> DataFrame:
    """(document_id, json) with nulls kept."""
    return df.select("document_id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_documents(df: DataFrame, path: str) -> None:
    """Every document as a line of JSON; what an earlier run left goes."""
    to_document_json(df).select("json").write.mode("overwrite").text(path)


def write_batch(documents: DataFrame, fields: DataFrame, flags: DataFrame, summary: DataFrame, errors: DataFrame, path: str, threshold: float, run: str = "{}") -> None:
    """All of a batch's reports under a folder: documents and flags as lines of JSON, review queue and summary as CSV, and a line about the run.

    Documents carry their fields; nothing is gathered into one row but the errors by file.
    """
    own = fields.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("field", *[c for c in fields.columns if c not in ("document_id", "field")]))).alias("fields"))
    write_documents(documents.join(own, "document_id", "left"), f"{path}/documents")
    flags.select(F.to_json(F.struct(*FLAG_COLUMNS), {"ignoreNullFields": "false"}).alias("json")).write.mode("overwrite").text(f"{path}/flags")
    write_csv(flags, f"{path}/flagging_report", FLAG_COLUMNS)
    write_csv(summary, f"{path}/extraction_summary", SUMMARY_COLUMNS)
    about = errors.agg(F.map_from_entries(F.collect_list(F.struct("name", "error"))).alias("file_errors"))
    about.select(F.to_json(F.struct(F.lit(threshold).alias("threshold"), "file_errors", F.parse_json(F.lit(run)).alias("run"))).alias("json")).write.mode("overwrite").text(f"{path}/run")


def read_batch(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, dict]:
    """Documents (of a given schema), errors by file (name, error) and the run of what ``write_batch`` left."""
    about = spark.read.json(f"{path}/run", "threshold double, file_errors map<string,string>, run string")
    errors = about.select(F.explode("file_errors").alias("name", "error"))
    return spark.read.json(f"{path}/documents", schema), errors, json.loads(about.first()["run"] or "{}")


def zip_documents(df: DataFrame, path: str, most: int = 10_000) -> int:
    """json/<document_id>.json of every document in one zip file of the driver's, for a download; more than ``most`` documents are an error."""
    rows = to_document_json(df)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a zip file holds {most} documents at most; write them as lines")
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for r in rows.orderBy("document_id").toLocalIterator():
            out.writestr(f"json/{r['document_id']}.json", r["json"])
            n += 1
    return n


def transcript(turns: list, title: str = "Transcript", about: str = "") -> str:
    """A session's turns in markdown: question, intent, answer, and the statement that was run or its error."""
    out = [f"# {title}", ""] + ([about, ""] if about else [])
    for i, t in enumerate(turns, 1):
        out += [f"## {i}. {t.question}", "", f"*Intent:* `{t.intent or 'n/a'}`", "", t.text, ""]
        if t.sql:
            out += ["```sql", t.sql, "```", ""]
        if t.error:
            out += [f"Error: `{t.error}`", ""]
    return "\n".join(out)


def batch_json(documents: DataFrame, errors: DataFrame, threshold: float) -> DataFrame:
    """One row: threshold, documents in order of their ids, and errors by file."""
    docs = to_document_json(documents).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("document_id", "json"))), lambda x: x["json"]), ",").alias("d"))
    bad = errors.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "error")))).alias("e"))
    return docs.crossJoin(bad).select(F.concat(F.lit(f'{{"threshold":{threshold},"documents":['), F.coalesce("d", F.lit("")), F.lit('],"file_errors":'), "e", F.lit("}")).alias("json"))


def flags_json(flags: DataFrame, threshold: float) -> DataFrame:
    """One row: threshold, number of flags, flags."""
    rows = flags.agg(F.count("*").alias("flag_count"), F.sort_array(F.collect_list(F.struct(*FLAG_COLUMNS))).alias("flags"))
    return rows.select(F.to_json(F.struct(F.lit(threshold).alias("threshold"), "flag_count", "flags"), {"ignoreNullFields": "false"}).alias("json"))
