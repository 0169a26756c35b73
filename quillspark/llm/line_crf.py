"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours; the field has two
states, good and bad.  Labels are known by document only, so training starts
with every line labelled as its document and then twice relabels the lines of bad
documents by the field's own marginals (a bad document keeps at least its worst line).
A document's raw quality is the mean of its lines' marginals of the good
state, weighted by length; a logistic curve, fit on the training documents, makes it
the probability of label 1.

Training takes the lines' features of at most ``TRAIN_DOCS`` labelled documents and ``TRAIN_LINES`` lines (the
least hashes of doc_id) to the driver, never their texts; features are made where
the texts are.  Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, drop, python_ready
from .wordkernel import Words, mix

TRAIN_DOCS, TRAIN_LINES = 3000, 300_000
ROUNDS = (80, 40, 40)
#: A longer document is several chains in training, so that steps stay few.
CHAIN = 200

_RATIO = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6])
_EDGES = {
    "symbols": _RATIO,
    "shouts": _RATIO,
    "upper": _RATIO,
    "digits": _RATIO,
    "points": _RATIO,
    "foreign": _RATIO,
    "length": np.array([1, 8, 20, 40, 80, 160, 400]),
    "word": np.array([1.5, 2.5, 3.5, 4.5, 5.5, 7, 10]),
    "words": np.array([1, 2, 4, 8, 16, 32, 64]),
    "distinct": np.array([0.05, 0.2, 0.4, 0.6, 0.8, 0.9, 0.999]),
    "longest": np.array([4, 8, 12, 16, 20, 30, 60]),
    "seen": np.array([0.5]),
    "closed": np.array([0.5]),
}
#: Features that a line also takes from the line before and the line after.
_NEAR = ("symbols", "shouts", "upper", "distinct", "length", "seen")

_CLASS = {name: np.zeros(256, dtype=bool) for name in ("symbols", "shouts", "upper", "digits", "points", "foreign")}
_CLASS["symbols"][list(b"#*$%&|<>^~_=+\\@{}[]")] = True
_CLASS["shouts"][list(b"!?")] = True
_CLASS["upper"][0x41:0x5B] = True
_CLASS["digits"][0x30:0x3A] = True
_CLASS["points"][list(b".,;:'\"()-")] = True
_CLASS["foreign"][0x80:] = True


class Lines:
    """The lines of a batch of texts and their features; every text has at least one line."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        raw, offsets = words.raw, words.offsets
        n = len(offsets) - 1
        breaks = np.flatnonzero(raw == 10)
        starts = np.concatenate((offsets[:-1], breaks + 1))
        doc = np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1))
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.append(starts[1:] - 1, 0)
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, dtype=bool)
        ends[last] = offsets[doc[last] + 1]
        self.doc, self.size = doc, ends - starts
        self.first = np.searchsorted(doc, np.arange(n + 1))

        ink = np.maximum(self._count(raw > 0x20, starts, ends), 1)
        value = {name: self._count(kind[raw], starts, ends) / ink for name, kind in _CLASS.items()}
        chars = self._count((raw & 0xC0) != 0x80, starts, ends)
        line = np.searchsorted(starts, words.start, side="right") - 1
        many = np.bincount(line, minlength=len(starts))
        size = words.end - words.start
        longest = np.zeros(len(starts))
        np.maximum.at(longest, line, size)
        key = mix(words.hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=len(starts))
        # a line seen before in its document, by the sum of its words' places and hashes
        place = np.arange(len(line)) - np.concatenate(([0], np.cumsum(many)))[line]
        total = np.zeros(len(starts), dtype=np.uint64)
        np.add.at(total, line, mix(words.hashes ^ place.astype(np.uint64)))
        total = mix(total + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        seen = np.ones(len(starts), dtype=bool)
        seen[np.unique(total, return_index=True)[1]] = False
        closing = np.zeros(len(starts), dtype=bool)
        full = ends > starts
        closing[full] = np.isin(raw[ends[full] - 1], np.frombuffer(b'.!?:"', dtype=np.uint8))
        value |= {"length": chars, "word": self._bytes(size, line, len(starts)) / np.maximum(many, 1), "words": many, "distinct": distinct / np.maximum(many, 1), "longest": longest, "seen": seen & (many > 0), "closed": closing}
        self.columns = self._columns(value)

    @staticmethod
    def _count(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    @staticmethod
    def _bytes(size: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(line, weights=size, minlength=n)

    def _columns(self, value: dict[str, np.ndarray]) -> np.ndarray:
        """For each line the numbers of its features, one from each group."""
        out, base = [], 0
        bins = {name: np.searchsorted(edges, value[name], side="right") for name, edges in _EDGES.items()}
        for name, edges in _EDGES.items():
            out.append(bins[name] + base)
            base += len(edges) + 1
        n = len(self.doc)
        for step in (-1, 1):
            at = np.arange(n) + step
            inside = (at >= 0) & (at < n)
            at = np.where(inside, at, 0)
            inside &= self.doc[at] == self.doc if n else inside
            for name in _NEAR:
                out.append(np.where(inside, bins[name][at] + 1, 0) + base)
                base += len(_EDGES[name]) + 2
        return np.stack(out, axis=1) if n else np.zeros((0, len(out)), dtype=np.int64)


FEATURES = sum(len(e) + 1 for e in _EDGES.values()) + 2 * sum(len(_EDGES[n]) + 2 for n in _NEAR)


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the states of each line, summed marginals of neighbouring states, and the log of the sums over all labellings.

    ``emit`` has a row for each line (log potentials), chain i is lines first[i] to first[i + 1].
    All chains take a step at once, the longest first.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    top = emit.max(axis=1, keepdims=True)
    e, t = np.exp(emit - top), np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
    steps = int(length[0]) if len(length) else 0
    active = [int(n) for n in np.searchsorted(-length, -np.arange(steps), side="left")]
    for k in range(steps):
        at = begin[: active[k]] + k
        a = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    for k in range(steps - 2, -1, -1):
        at = begin[: active[k + 1]] + k
        beta[at] = (e[at + 1] * beta[at + 1] / scale[at + 1][:, None]) @ t.T
    node = alpha * beta
    node /= node.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    if len(at):
        pair = (alpha[at - 1].T @ (e[at] * beta[at] / scale[at][:, None])) * t
    return node, pair, float(np.log(scale).sum() + top.sum())


def _emissions(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    good = np.zeros(len(columns))
    for j in range(columns.shape[1]):
        good += weights[columns[:, j]]
    return np.stack((np.zeros_like(good), good), axis=1)


def _fit(columns: np.ndarray, first: np.ndarray, states: np.ndarray, weights: np.ndarray, trans: np.ndarray, rounds: int, line_weight: float = 1e-3) -> None:
    """Ascend the penalised log likelihood in place, by steps of Adam's size."""
    moment = [np.zeros_like(weights), np.zeros_like(trans)]
    square = [np.zeros_like(weights), np.zeros_like(trans)]
    inner = np.ones(len(states), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    counted = np.zeros((2, 2))
    np.add.at(counted, (states[at - 1], states[at]), 1)
    n = len(states)
    for k in range(1, rounds + 1):
        node, pair, _ = forward_backward(_emissions(columns, weights), first, trans)
        miss = states - node[:, 1]
        seen = sum(np.bincount(columns[:, j], weights=miss, minlength=FEATURES) for j in range(columns.shape[1]))
        up = [seen / n - line_weight * weights, (counted - pair) / n - line_weight * trans]
        for value, m, s, g in zip((weights, trans), moment, square, up, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            value += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)


def _raw(lines: Lines | Training, node: np.ndarray) -> np.ndarray:
    """Mean of the good state's marginals, weighted by length, as log odds."""
    n = len(lines.first) - 1
    weight = lines.size + 1.0
    mean = np.bincount(lines.doc, weights=weight * node[:, 1], minlength=n) / np.maximum(np.bincount(lines.doc, weights=weight, minlength=n), 1)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


class Training:
    """The lines of training documents: document, size and features of each, from two byte strings a document."""

    def __init__(self, sizes: list[bytes], columns: list[bytes]):
        many = np.array([len(s) // 4 for s in sizes], dtype=np.int64)
        self.doc, self.first = np.repeat(np.arange(len(many)), many), np.concatenate(([0], np.cumsum(many)))
        self.size = np.frombuffer(b"".join(sizes), dtype="<i4")
        self.columns = np.frombuffer(b"".join(columns), dtype="<i2").reshape(len(self.size), len(_EDGES) + 2 * len(_NEAR))


def line_features(texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """Sizes (32 bits) and features (16 bits) of each text's lines."""
    lines = Lines(texts)
    size, columns = lines.size.astype("<i4"), lines.columns.astype("<i2")
    spans = list(zip(lines.first[:-1], lines.first[1:], strict=True))
    return [size[a:b].tobytes() for a, b in spans], [columns[a:b].tobytes() for a, b in spans]


def train(lines: Training, labels: np.ndarray) -> dict[str, np.ndarray]:
    """The field's weights and transitions and the curve's two numbers; without both labels all scores are the share of label 1."""
    weights, trans, curve = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)
    if len(labels) == 0 or labels.min() == labels.max():
        curve[0] = 0.0 if len(labels) == 0 else (4.0 if labels.max() else -4.0)
        return {"weights": weights, "trans": trans, "curve": curve}
    extra = np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)])
    first = np.append(extra, lines.first[-1])
    states = labels[lines.doc].astype(np.int64)
    for k, rounds in enumerate(ROUNDS):
        _fit(lines.columns, first, states, weights, trans, rounds)
        node = forward_backward(_emissions(lines.columns, weights), lines.first, trans)[0]
        if k + 1 < len(ROUNDS):
            states = np.where(labels[lines.doc] == 1, 1, (node[:, 1] > 0.5).astype(np.int64))
            worst = np.lexsort((node[:, 1], lines.doc))[lines.first[:-1]]
            states[worst[labels == 0]] = 0
    x, y = _raw(lines, node), labels.astype(float)
    curve[:] = (0.0, 1.0)
    design = np.stack((np.ones_like(x), x), axis=1)
    for _ in range(30):  # Newton's method with a weak pull towards the plain log odds
        p = 1 / (1 + np.exp(-(design @ curve)))
        gradient = design.T @ (y - p) - 0.1 * (curve - np.array([0.0, 1.0]))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        curve += np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    curve[1] = max(curve[1], 1e-3)
    return {"weights": weights, "trans": trans, "curve": curve}


def _score(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines(batch.column(1))
            node = forward_backward(_emissions(lines.columns, model["weights"]), lines.first, model["trans"])[0]
            score = 1 / (1 + np.exp(-(model["curve"][0] + model["curve"][1] * _raw(lines, node))))
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array(np.diff(lines.first), pa.int64()), pa.array(np.bincount(lines.doc, weights=node[:, 0] > 0.5, minlength=batch.num_rows).astype(np.int64))], names=["doc_id", "score", "n_lines", "n_bad_lines"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id's decimal text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, columns = line_features(batch.column(2))
        many = pa.array([len(s) // 4 for s in size], pa.int64())
        yield pa.record_batch([batch.column(0), batch.column(1), many, pa.array(size, pa.binary()), pa.array(columns, pa.binary())], names=["doc_id", "quality", "n_lines", "size", "columns"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> dict[str, np.ndarray]:
    """A model from labelled documents that aren't held out; of rows that share a doc_id the least label and text count.

    At most ``train_docs`` documents, in the order of a hash of doc_id, and of these as many as have ``train_lines`` lines together.
    """
    ids = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = cut(texts.select("doc_id", "quality", "text").mapInArrow(_featured, "doc_id bigint, quality int, n_lines bigint, size binary, columns binary"), "crf-features")
    so_far, left_out = 0, []
    for r in rows.select("doc_id", "n_lines").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most train_docs rows of two numbers
        if so_far + r.n_lines <= train_lines:
            so_far += r.n_lines
        else:
            left_out.append(r.doc_id)
    few = rows.where(~F.col("doc_id").isin(left_out)).orderBy("doc_id").select("quality", "size", "columns").toArrow()
    drop(rows)
    return train(Training(few.column("size").to_pylist(), few.column("columns").to_pylist()), few.column("quality").to_numpy().astype(np.int64))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold), n_lines, n_bad_lines for every row of ``docs``.

    Null and empty texts are one empty line.  A null doc_id isn't held out; repeated rows come back as
    often.  Columns of either table other than doc_id, text and quality are not looked at.
    """
    python_ready(docs.sparkSession)
    model = fit(docs, labels)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(_score(model), "doc_id bigint, score double, n_lines bigint, n_bad_lines bigint")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_lines", "n_bad_lines")


def _keep_good(model: dict[str, np.ndarray], threshold: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(model)
        for batch in batches:
            text = batch.column(column)
            scored = next(score(iter([pa.record_batch([pa.nulls(len(text), pa.int64()), text], names=["doc_id", "text"])])))
            yield batch.filter(pa.compute.greater_equal(scored.column("score"), threshold))

    return run


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``.

    Null and empty texts are one empty line and scored as that; repeated rows stay or go together; an empty table
    gives no rows.  Columns other than text don't matter to a row's score, whatever their names and nulls.
    """
    python_ready(docs.sparkSession)
    return docs.mapInArrow(_keep_good(fit(docs, labels), threshold, docs.columns.index("text")), docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_bad_lines of every document."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
