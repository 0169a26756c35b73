"""What comes from outside (models, recognition, search) enters as relations behind these interfaces."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.privacy import scrub_pii

# sent to workers by value, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Planner(Protocol):
    def plan(self, question: str, history: str, schema: str) -> dict[str, Any]: ...


class SearchProvider(Protocol):
    def search(self, query: str) -> dict[str, Any]: ...


class PageMaker(Protocol):
    """A file's pages as images."""

    def pages(self, name: str, content: bytes) -> list[bytes]: ...


class WordReader(Protocol):
    """The words of a page: (text, left, top, width, height, block, par, line)."""

    def words(self, image: bytes) -> list[tuple[str, int, int, int, int, int, int, int]]: ...


class CropReader(Protocol):
    """The text of a part of a page; ``zone`` for the machine readable one."""

    def text(self, image: bytes, zone: bool) -> str: ...


class Classifier(Protocol):
    """Groups of a file's pages: {pages, document_type, confidence, evidence}."""

    def groups(self, images: list[bytes]) -> list[dict[str, Any]]: ...


def file_pages(files: DataFrame, maker: PageMaker) -> DataFrame:
    """sha1, page_no, image, error of the files (sha1, name, content): a file that can't be opened, or has no page, is one row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sha1, name, content in zip(frame["sha1"], frame["name"], frame["content"], strict=True):
                try:
                    images, error = maker.pages(name, bytes(content)), "the file has no pages"
                except Exception as wrong:  # whatever a decoder raises is that file's error, not the batch's
                    images, error = [], f"could not open the file: {wrong}"
                out += [(sha1, k, image, None) for k, image in enumerate(images, 1)] or [(sha1, None, None, error)]
            yield pd.DataFrame(out, columns=["sha1", "page_no", "image", "error"]).astype({"page_no": "Int32"})

    return files.select("sha1", "name", "content").mapInPandas(run, "sha1 string, page_no int, image binary, error string")


def page_words(pages: DataFrame, reader: WordReader) -> DataFrame:
    """sha1, page_no, text, left, top, width, height, block, par, line: a row for each word that isn't blank."""
    names = ["text", "left", "top", "width", "height", "block", "par", "line"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(sha1, page, *w) for sha1, page, image in zip(frame["sha1"], frame["page_no"], frame["image"], strict=True) for w in reader.words(bytes(image)) if w[0].strip()]
            yield pd.DataFrame(out, columns=["sha1", "page_no", *names])

    return pages.where("image IS NOT NULL").select("sha1", "page_no", "image").mapInPandas(run, "sha1 string, page_no int, text string, " + ", ".join(f"{n} int" for n in names[1:]))


def crop_texts(crops: DataFrame, reader: CropReader) -> DataFrame:
    """document_id, field, text of the crops (document_id, field, validator, image)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [reader.text(bytes(i), v == "mrz2") for i, v in zip(frame["image"], frame["validator"], strict=True)]
            yield pd.DataFrame({"document_id": frame["document_id"], "field": frame["field"], "text": text})

    return crops.where("image IS NOT NULL").select("document_id", "field", "validator", "image").mapInPandas(run, "document_id string, field string, text string")


def classifier_groups(pages: DataFrame, classifier: Classifier) -> DataFrame:
    """sha1, group_pos, pages, document_type, confidence, evidence of every file; confidence within 0 and 1, evidence at most 200 characters.

    A file's pages are gathered in order, as one row: a file is a bounded group.
    """
    files = pages.where("image IS NOT NULL").groupBy("sha1").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "image"))), lambda x: x["image"]).alias("images"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sha1, images in zip(frame["sha1"], frame["images"], strict=True):
                for k, g in enumerate(classifier.groups([bytes(i) for i in images])):
                    out.append((sha1, k, list(g["pages"]), g["document_type"], max(0.0, min(1.0, float(g["confidence"]))), str(g.get("evidence", ""))[:200]))
            yield pd.DataFrame(out, columns=["sha1", "group_pos", "pages", "document_type", "confidence", "evidence"])

    return files.mapInPandas(run, "sha1 string, group_pos int, pages array<int>, document_type string, confidence double, evidence string")


@dataclass
class ScriptedProvider:
    """Answers in the order given; keeps what it was asked."""

    answers: list[Any]
    asked: list[Any] = field(default_factory=list)

    def _next(self, *what: Any) -> Any:
        self.asked.append(what)
        answer = self.answers[min(len(self.asked), len(self.answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer

    def plan(self, question: str, history: str, schema: str) -> dict[str, Any]:
        return self._next(question, history, schema)

    def search(self, query: str) -> dict[str, Any]:
        return self._next(query)


def lenient_json(text: str) -> dict[str, Any]:
    """The object of an answer that may stand in fences or prose; ValueError if there is none."""
    decoder = json.JSONDecoder()
    for at, c in enumerate(text):
        if c == "{":
            try:
                found = decoder.raw_decode(text, at)[0]
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    raise ValueError("no JSON object in the answer")


def request_key(provider: Column, model: Column, *parts: Column) -> Column:
    """Key of a cached response; parts are told apart even if they hold the separator."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in (provider, model, *parts)])), 256)


def unanswered(requests: DataFrame, cache: DataFrame, key: str = "request_key") -> DataFrame:
    return requests.join(cache.select(key).distinct(), key, "left_anti")


def first_items(items: DataFrame) -> DataFrame:
    """Of a page read's items the first of each field; blank values are null."""
    w = Window.partitionBy("document_id", "field").orderBy("pos")
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("value", F.when(F.trim("value") != "", F.trim("value")))


def expected_reads(expected: DataFrame, got: DataFrame, method: str) -> DataFrame:
    """One read for each expected (document_id, field); what a batched response lacks is an error."""
    rows = expected.select("document_id", "field").join(got.withColumn("_got", F.lit(True)), ["document_id", "field"], "left")
    return rows.withColumn("method", F.lit(method)).withColumn("error", F.when(F.col("_got").isNull(), "field missing from batched response").otherwise(F.col("error"))).drop("_got")


def fallback(results: DataFrame) -> DataFrame:
    """The answer of each query: the first provider with sources, else the first without an error; all failed: one row that lists why.

    ``results``: query, provider, priority, answer, sources, error.
    """
    n = F.when(F.col("error").isNull(), F.size("sources")).otherwise(-1)
    w = Window.partitionBy("query").orderBy(F.when(n > 0, 0).when(n == 0, 1).otherwise(2), "priority")
    why = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("priority", F.concat("provider", F.lit(": "), "error").alias("e")))).over(Window.partitionBy("query"))), lambda x: x["e"]), "; ")
    best = results.withColumn("_why", why).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    failed = F.col("error").isNotNull()
    return best.select("query", F.when(~failed, F.col("provider")).alias("provider"), F.when(~failed, F.col("answer")).alias("answer"), "sources", F.when(failed, F.col("_why")).alias("error"))


def http_sources(sources: Column, most: int = 5, snippet: int = 300) -> Column:
    """Sources with a web address, at most five, their snippets cut."""
    held = F.filter(sources, lambda s: s["url"].rlike("^https?://"))
    return F.slice(F.transform(held, lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url"), F.substring(s["snippet"], 1, snippet).alias("snippet"))), 1, most)


def safe_queries(queries: Column) -> Column:
    """struct(query, error): a query without identifiers and outer spaces; an error if nothing is left of it."""
    clean = F.trim(scrub_pii(queries))
    empty = F.coalesce(clean, F.lit("")) == ""
    return F.struct(F.when(~empty, clean).alias("query"), F.when(empty, "The search query was empty after removing sensitive values.").alias("error"))


def safe_answers(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """query, asked, sources, error: what was asked of a provider for each query (query, text), and its sources (asked, sources) with a web address."""
    asked = queries.select("query", safe_queries(F.col("text")).alias("s")).select("query", F.col("s.query").alias("asked"), "s.error")
    return asked.join(answers, "asked", "left").select("query", "asked", F.filter("sources", lambda x: x["url"].rlike("^https?://")).alias("sources"), "error")


def nullable_types(schema: Any) -> Any:
    """A JSON schema for a provider that has no unions: of a type and null the type, marked nullable; nothing about additional properties."""
    if isinstance(schema, list):
        return [nullable_types(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: nullable_types(v) for k, v in schema.items() if k != "additionalProperties"}
    kinds = schema.get("type")
    if isinstance(kinds, list):
        out["type"] = next((k for k in kinds if k != "null"), "string")
        if "null" in kinds:
            out["nullable"] = True
    return out


def cited_first(sources: Column) -> Column:
    """Sources with a snippet before those without, otherwise as they came."""
    return F.concat(F.filter(sources, lambda s: s["snippet"] != ""), F.filter(sources, lambda s: F.coalesce(s["snippet"], F.lit("")) == ""))


def source_list(sources: Column, most: int = 6) -> Column:
    """A numbered list in markdown; says so if there is nothing to list."""
    lines = F.transform(F.slice(sources, 1, most), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.translate(F.coalesce(s["title"], s["url"]), "[]", "()"), F.lit("]("), s["url"], F.lit(")")))
    return F.when(F.size(sources) > 0, F.array_join(lines, "\n")).otherwise("No sources were returned.")


def usage(calls: DataFrame) -> DataFrame:
    """Calls by model: live, cached, failed."""
    return calls.groupBy("model").pivot("state", ["live", "cached", "failed"]).agg(F.count(F.lit(1))).na.fill(0)
