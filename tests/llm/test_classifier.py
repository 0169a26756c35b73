import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm.line_crf import _EDGES, _NEAR, Lines, Training, fit, forward_backward, good_documents, line_features, quality, train


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 11])
    emit, trans = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    node, pair, total = forward_backward(emit, first, trans)
    want_pair, want_total = np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        marginal, z, pairs = np.zeros((b - a, 2)), 0.0, np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(emit[a + i, s] for i, s in enumerate(y)) + sum(trans[s, t] for s, t in zip(y, y[1:], strict=False)))
            z += w
            for i, s in enumerate(y):
                marginal[i, s] += w
            for s, t in zip(y, y[1:], strict=False):
                pairs[s, t] += w
        assert np.allclose(node[a:b], marginal / z)
        want_pair += pairs / z
        want_total += np.log(z)
    assert np.allclose(pair, want_pair) and total == pytest.approx(want_total)


def test_lines():
    lines = Lines(pa.array(["a b\n\nc", "", None, "x\n"]))
    assert lines.size.tolist() == [3, 0, 1, 0, 0, 1, 0] and lines.first.tolist() == [0, 3, 4, 5, 7]


def naive_features(text):
    """The numbers of every line's features, a line and a character at a time."""
    lines = (text or "").split("\n")
    split = lambda s: [w for w in re.split("[\x20\x09-\x0d]+", s) if w]
    kinds = {"symbols": "#*$%&|<>^~_=+\\@{}[]", "shouts": "!?", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "points": ".,;:'\"()-"}
    bins, seen = [], set()
    for line in lines:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        raw, words = line.encode(), [w.encode() for w in split(low)]
        ink = max(1, sum(b > 0x20 for b in raw))
        v = {k: sum(b in kind.encode() for b in raw) / ink for k, kind in kinds.items()}
        v["foreign"] = sum(b >= 0x80 for b in raw) / ink
        v |= {"length": len(line), "words": len(words), "word": sum(map(len, words)) / max(1, len(words)), "distinct": len(set(words)) / max(1, len(words)), "longest": max(map(len, words), default=0)}
        v |= {"seen": bool(words) and tuple(words) in seen, "closed": line[-1:] in ("." , "!", "?", ":", '"') and line != ""}
        seen.add(tuple(words))
        bins.append({k: sum(v[k] >= e for e in edges) for k, edges in _EDGES.items()})
    rows = []
    for i, b in enumerate(bins):
        row, base = [], 0
        for k, edges in _EDGES.items():
            row.append(base + b[k])
            base += len(edges) + 1
        for j in (i - 1, i + 1):
            for k in _NEAR:
                row.append(base + (bins[j][k] + 1 if 0 <= j < len(bins) else 0))
                base += len(_EDGES[k]) + 2
        rows.append(row)
    return rows


def test_features_are_those_of_a_plain_reading(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [None, "", "\n", "a\nA\n\nb!\n a \n", "é? É:\nx # 1,2\n\t\n", "THE THE\nthe the"]
    lines = Lines(pa.array(texts))
    for i, text in enumerate(texts):
        assert lines.columns[lines.first[i] : lines.first[i + 1]].tolist() == naive_features(text), text


def test_training_is_bounded_by_lines(spark, docs_of):
    docs = docs_of([(k, "\n".join(["a line"] * (1 + 50 * (k % 3)))) for k in range(60)])
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(60)], "doc_id bigint, quality int")
    small, large = fit(docs, labels, train_lines=100), fit(docs, labels)
    assert abs(large["weights"]).sum() > 0 and not np.array_equal(small["weights"], large["weights"])
    assert fit(docs, labels, train_lines=0)["curve"].tolist() == [0, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(r.predicted for r in bad) <= 0.25 * len(bad)
    assert np.mean([g.score > b.score for g in good for b in bad]) > 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality(odd, labels).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (6, 7)}) == 1
    assert quality(none, labels).collect() == [] and quality(odd, labels.where("false")).count() == 11
    assert good_documents(odd, labels).columns == odd.columns


def test_one_label_only():
    model = train(Training(*line_features(pa.array(["a", "b"]))), np.array([1, 1]))
    assert model["curve"][0] > 0
