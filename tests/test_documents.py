import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog, documents

DAY = datetime.date(2025, 6, 30)
READ = "document_id string, field string, pos int, method string, value string, legibility string, ambiguous array<string>, label_visible boolean, error string"
SPEC = "document_id string, field string, validator string, kind string, options array<string>"
CONTEXT = "document_id string, field string, ocr double, proximity double, image_quality double, region_desc string"
METHODS = ("vision_full_page", "vision_crop", "vision_crop_binarized")


def resolve(spark, cases):
    """cases: field -> (validator, kind, values); a value of None is an empty read, an Exception a failed one."""
    reads, specs, context = [], [], []
    for field, (validator, kind, values, *more) in cases.items():
        specs.append(("d", field, validator, kind, []))
        context.append(("d", field, more[0] if more else 1.0, 1.0, 0.9, "here"))
        for i, v in enumerate(values):
            failed = isinstance(v, Exception)
            reads.append(("d", field, i, METHODS[i], None if failed else v, "clear", ["x is 5 or S"] if v == "AMBIG" else [], True, str(v) if failed else None))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = documents.resolve_fields(frame(specs, SPEC), frame(reads, READ), frame(context, CONTEXT), F.lit(DAY))
    return {r.field: r for r in out.collect()}


def test_field_scenarios(spark):
    got = resolve(
        spark,
        {
            "agree": ("pan", "printed", ["ABCPK1234Q", "abcpk 1234q"]),
            "missing": ("name", "printed", [None, " "], None),
            "three ways": ("account", "handwritten", ["40012345678", "40012345618", "40012345670"]),
            "majority": ("account", "handwritten", ["40012345678", "40012345678", "40012345618"], 0.5),
            "failed": ("account", "handwritten", ["40012345678", RuntimeError("boom"), "40012345678"]),
            "format": ("pan", "printed", ["PQRDX1234Z", "PQRDX1234Z"]),
            "half": ("name", "printed", ["Ann", None]),
            "ambiguous": ("text", "handwritten", ["AMBIG", "ambig", "ambig"]),
            "date": ("date_past", "printed", ["01/02/1990", "01-02-1990"]),
        },
    )
    assert not got["agree"].review_required and got["agree"].confidence >= 0.85 and got["agree"].review_reasons == []
    assert got["agree"].method == ["vision_full_page", "vision_crop", "ocr_tesseract", "validator"]
    assert got["missing"].confidence == 0 and got["missing"].review_reasons == ["value not found or unreadable in any pass"]
    three = got["three ways"]
    assert three.raw_value is None and three.normalized_value is None and three.confidence <= 0.40 and len(three.candidates) == 3
    assert "independent reads disagree" in three.review_reasons[1]
    assert got["majority"].raw_value == "40012345678" and got["majority"].review_required
    assert got["failed"].method[:2] == ["vision_full_page", "vision_crop_binarized"] and got["failed"].raw_value
    assert got["format"].raw_value == "PQRDX1234Z" and got["format"].confidence <= 0.70 and got["format"].review_required
    assert any(r.startswith("some passes returned no value: vision_crop") for r in got["half"].review_reasons) and got["half"].confidence <= 0.75
    assert got["date"].normalized_value == "1990-02-01"
    assert got["ambiguous"].raw_value == "ambig"
    for r in got.values():  # what always holds
        assert 0 <= r.confidence <= 1 and (r.normalized_value is not None or r.review_required)
        assert r.review_required or r.confidence >= 0.85


def test_caps_and_their_order(spark):
    base = dict(agreement=1.0, validation=1.0, legibility=1.0, ocr=1.0, proximity=1.0, image_quality=1.0, handwritten=False, n_vision_reads=2, majority=True, some_read_empty=False, coerced=False, missing=False)
    rows = [{**base}, {**base, "majority": False, "coerced": True}, {**base, "coerced": True, "validation": 0.0}, {**base, "handwritten": True, "n_vision_reads": 1}, {**base, "missing": True}, {**base, "ocr": None, "validation": None, "agreement": 0.5}]
    out = documents.confidence(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in base.items()))).collect()
    assert [r.confidence for r in out] == [1.0, 0.4, 0.7, 0.8, 0.0, 0.75]
    assert out[1].caps_applied == ["independent reads disagree (no majority) -> capped at 0.4"]
    assert out[2].caps_applied == ["format/checksum validation failed -> capped at 0.7"] and out[4].caps_applied == ["missing value -> 0.0"]


FIELDS = "document_id string, field string, raw_value string, normalized_value string, confidence double, review_required boolean, review_reasons array<string>, candidates array<string>, page int"


def fields(spark, rows):
    return spark.createDataFrame([(d, f, v, v, 0.95, flagged, [], [], 1) for d, f, v, flagged in rows], FIELDS)


def test_cross_checks_and_hints(spark):
    line = "K1234567<" + "4" + "IND" + "900201" + "1" + "M" + "300101" + "9" + "<" * 14 + "<" + "0"
    rows = fields(spark, [("p", "passport_number", "K1234568", False), ("p", "date_of_birth", "1990-02-01", False), ("p", "date_of_expiry", "2030-01-01", False), ("p", "mrz_line_2", line, False), ("n", "amount_in_figures", "75000", False), ("n", "amount_in_words", "Seventy thousand only", False), ("l", "date_of_issue", "2020-01-01", False), ("l", "valid_till", "2019-01-01", False), ("b", "date", "2030-01-01", False), ("b", "place", "Pune", False), ("c", "place", None, True), ("e", "place", "Agra", False)])
    types = spark.createDataFrame([("p", "passport"), ("n", "nach_ecs_mandate"), ("l", "driving_licence"), ("b", "moral_hazard_questionnaire"), ("c", "multiple_policies_consent"), ("e", "multiple_policies_consent")], "document_id string, document_type string")
    out = {(r.document_id, r.field): r for r in documents.cross_field_checks(rows, types, F.lit(DAY)).collect()}
    flagged = {k for k, r in out.items() if r.confidence == 0.6}
    assert flagged == {("p", "passport_number"), ("n", "amount_in_figures"), ("l", "valid_till"), ("b", "date")}
    assert all(out[k].review_required and out[k].review_reasons for k in flagged)
    files = spark.createDataFrame([(d, f"{d}.pdf") for d in "pnlbce"], "document_id string, source_file string")
    hinted = {(r.document_id, r.field): r.review_reasons for r in documents.cross_document_hints(rows, files).collect()}
    assert hinted["c", "place"] == ["review hint only (not used to fill): place read confidently elsewhere in this batch as Agra, Pune"]
    assert not any(v for k, v in hinted.items() if k != ("c", "place"))


def test_vote_groups_and_catalogue(spark):
    texts = spark.createDataFrame([(1, "NACH mandate UMRN debit"), (2, "specs only"), (3, "passport and income tax"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.vote for r in documents.keyword_vote(texts, catalog.doc_keywords(spark)).collect()}
    assert got == {1: "nach_ecs_mandate", 2: None, 3: None, 4: None}
    specs = catalog.field_specs(spark)
    assert specs.count() == 45 and specs.where("auxiliary").count() == 1 and specs.select("doc_type").distinct().count() == 10


def test_reports(spark, tmp_path):
    from quillspark.sources import sinks

    docs = spark.createDataFrame([("d", "a.pdf", [1, 2], "pan_card", 0.5, True, "seen", ["classifier unsure", "x"], 0.85)], "document_id string, source_file string, pages array<int>, document_type string, confidence double, review_required boolean, evidence string, warnings array<string>, threshold double")
    rows = fields(spark, [("d", "pan_number", "X", True), ("d", "full_name", None, True), ("d", "date_of_birth", "1990-01-01", False)])
    flags = documents.flag_rows(docs, rows)
    assert flags.count() == 3 and set(flags.columns) == set(sinks.FLAG_COLUMNS)
    (s,) = documents.summary_rows(docs, rows).collect()
    assert (s.fields_total, s.fields_auto_accepted, s.fields_for_review, s.fields_missing, s.pages, s.document_review_required) == (3, 1, 2, 1, "1,2", True)
    sinks.write_csv(documents.summary_rows(docs, rows), str(tmp_path / "s"), sinks.SUMMARY_COLUMNS)
    raw = next((tmp_path / "s").glob("part-*")).read_bytes()
    assert raw.count(b"\r\n") == 2 and raw.rstrip().endswith(b"True")
    assert json.loads(sinks.flags_json(flags, 0.85).first().json)["flag_count"] == 3
    whole = json.loads(sinks.batch_json(docs, spark.createDataFrame([("b.png", "empty file")], "name string, error string"), 0.85).first().json)
    assert whole["file_errors"] == {"b.png": "empty file"} and whole["documents"][0]["document_id"] == "d"


def test_batch_is_written_and_read(spark, tmp_path):
    import zipfile
    from types import SimpleNamespace

    from quillspark.sources import sinks

    docs = spark.createDataFrame([("d2", "b.png", 0.5), ("d1", "a.png", 0.9)], "document_id string, source_file string, confidence double")
    fields = spark.createDataFrame([("d1", "place", "X", None), ("d1", "name", "Y", 0.5)], "document_id string, field string, raw_value string, confidence double")
    flags = spark.createDataFrame([("a.png", "d1", "1", "pan_card", "name", None, 0.5, 0.85, "r", "act")], ", ".join(f"{c} {'double' if c in ('confidence', 'threshold') else 'string'}" for c in sinks.FLAG_COLUMNS))
    summary = docs.select(*[F.lit("x").alias(c) for c in sinks.SUMMARY_COLUMNS])
    errors = spark.createDataFrame([("c.png", "empty file")], "name string, error string")
    for _ in range(2):  # an earlier run's files go
        sinks.write_batch(docs, fields, flags, summary, errors, str(tmp_path), 0.85, '{"model": "m", "calls": 3}')
    back, bad, run = sinks.read_batch(spark, str(tmp_path), "document_id string, confidence double, fields array<struct<field: string, raw_value: string, confidence: double>>")
    assert {r.document_id: [tuple(f) for f in r.fields or []] for r in back.collect()} == {"d1": [("name", "Y", 0.5), ("place", "X", None)], "d2": []}
    assert [tuple(r) for r in bad.collect()] == [("c.png", "empty file")] and run == {"model": "m", "calls": 3}
    assert sinks.zip_documents(docs, str(tmp_path / "d.zip")) == 2
    with zipfile.ZipFile(tmp_path / "d.zip") as z:
        assert z.namelist() == ["json/d1.json", "json/d2.json"] and json.loads(z.read("json/d1.json"))["confidence"] == 0.9
    with pytest.raises(ValueError):
        sinks.zip_documents(docs, str(tmp_path / "e.zip"), most=1)
    text = sinks.transcript([SimpleNamespace(question="How many?", intent="data", text="Two.", sql="SELECT 2", error=None)])
    assert text.startswith("# Transcript") and "```sql\nSELECT 2\n```" in text and "*Intent:* `data`" in text
