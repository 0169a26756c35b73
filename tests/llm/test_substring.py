import random
import re

import numpy as np
import pyarrow as pa

from quillspark.llm import substring_dedup
from quillspark.llm.substring_dedup import _summed, align, chain, covering, repeated_passages, without_passages


def words(rng, n, tag):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def test_chain_is_the_best_of_all_orders():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(2, 9)
        xs, ys = np.array([rng.randrange(30) for _ in range(n)]), np.array([rng.randrange(30) for _ in range(n)])
        best = 0.0
        for mask in range(1, 1 << n):
            pts = sorted((xs[i], ys[i]) for i in range(n) if mask >> i & 1)
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pts, pts[1:], strict=False)):
                best = max(best, 5 * len(pts) - 0.1 * sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(pts, pts[1:], strict=False)))
        found = chain(xs, ys)
        score = lambda p: 5 * len(p) - 0.1 * sum(xs[b] - xs[a] + ys[b] - ys[a] for a, b in zip(p, p[1:], strict=False))
        assert abs(max(map(score, found), default=5.0) - best) < 1e-9


def test_align_finds_an_edited_passage():
    a = np.arange(200, dtype=np.uint64)
    b = np.concatenate((np.arange(1000, 1030), np.arange(50, 90), [5000, 5001], np.arange(91, 140), np.arange(2000, 2020))).astype(np.uint64)
    (s, e, t, f, n), = align(a, b, np.array([60, 100]), np.array([40, 81]), 50, 80)
    assert (s, e, t, f) == (50, 140, 30, 121) and n == 89


def test_planted_passages_and_cut(docs_of):
    rng = random.Random(3)
    passage = words(rng, 60, "p")
    edited = list(passage)
    edited[20], edited[41] = "x", "y"
    pairs = [(10, " ".join(words(rng, 80, "a") + passage + words(rng, 30, "b")))]
    pairs += [(20 + k, " ".join(words(rng, 40, "c") + (passage if k else edited) + words(rng, 40, "d"))) for k in range(50)]
    pairs += [(100 + k, " ".join(words(rng, 120, "e"))) for k in range(20)]
    pairs += [(200, "Zeile eins é\n" + " ".join(passage[:49])), (300, pairs[0][1]), (301, pairs[0][1])]
    docs = docs_of(pairs)
    found = repeated_passages(docs)
    rows = found.collect()
    assert {r.doc_id for r in rows} == {20 + k for k in range(50)} | {300, 301}
    assert {r.source_doc_id for r in rows} <= {10, 20}
    one = next(r for r in rows if r.doc_id == 25)
    assert (one.start_word, one.end_word, one.equal_words) == (40, 100, 60)
    text = dict(pairs)[25]
    assert text[one.start_char : one.end_char] == " ".join(passage)
    left = {r.doc_id: r for r in without_passages(docs, found).collect()}
    assert set(left) == {i for i, _ in pairs} - {300, 301}
    assert left[10].text == pairs[0][1] and " ".join(passage) not in left[25].text and left[25].n_chars == len(left[25].text)
    assert len(left[25].text.split()) == 80


def test_a_passage_whose_parts_occur_in_different_documents(docs_of):
    rng = random.Random(11)
    a, b = words(rng, 30, "a"), words(rng, 30, "b")
    pad = lambda part: " ".join(words(rng, 40, "f") + part + words(rng, 40, "g"))
    rows = repeated_passages(docs_of([(1, pad(a)), (2, pad(b)), (100, pad(a + b)), (150, pad(a)), (160, pad(b)), (200, pad(a + b))])).collect()
    assert [(r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.equal_words) for r in rows] == [(200, 100, 40, 100, 60)]


def test_repeated_word_passages(docs_of):
    rows = repeated_passages(docs_of([(1, "The " * 80), (2, "begin " + "The " * 70)])).collect()
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(2, 1)} and max(r.end_word - r.start_word for r in rows) >= 60


def test_odd_rows(odd, none):
    assert {(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in repeated_passages(odd).collect()} == {(7, 6, 0, 24_000)}
    assert repeated_passages(none).collect() == []
    out = without_passages(odd, repeated_passages(odd))
    assert out.columns == odd.columns and out.count() == 10


def _split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def _common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def against_brute_force(df, aligned=40):
    """Every run of 50 words that an earlier document has is within the passages found, and every passage is what it says."""
    text = {r.doc_id: r.text for r in df.collect()}
    words = {i: _split(t) for i, t in text.items()}
    rows = repeated_passages(df).collect()
    covered = {i: set() for i in words}
    for k, r in enumerate(rows):
        own, source = words[r.doc_id][r.start_word : r.end_word], words[r.source_doc_id][r.source_start : r.source_end]
        assert r.source_doc_id < r.doc_id and len(own) >= 50 and 100 * r.equal_words >= 80 * max(len(own), len(source))
        assert _split(text[r.doc_id][r.start_char : r.end_char]) == own or (r.start_word, r.end_char) == (0, len(text[r.doc_id]))
        if k < aligned and len(own) < 500:
            assert _common(own, source) >= r.equal_words
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    held = set()
    for i in sorted(words):
        runs = [tuple(words[i][p : p + 50]) for p in range(len(words[i]) - 49)]
        for p, run in enumerate(runs):
            assert run not in held or covered[i] >= set(range(p, p + 50)), (i, p)
        held.update(runs)
    return rows


def test_whole_query_against_brute_force(spark, sf):
    assert against_brute_force(spark.read.parquet(f"{sf}/documents.parquet"))


def test_documents_made_of_the_same_parts(docs_of):
    """Every pair of parts has its own first document, so passages fall into many sources."""
    rng = random.Random(23)
    parts = [words(rng, 30, f"p{k}x") for k in range(8)]
    docs = [(k, " ".join(sum((rng.choice(parts) for _ in range(rng.randrange(2, 7))), []) + words(rng, 5, "u"))) for k in range(50)]
    assert len({r.source_doc_id for r in against_brute_force(docs_of(docs))}) > 10


def test_edited_passages(docs_of):
    """Of sixty-word passages with up to two words replaced all are found; with more, and the share found, as the docstring says."""
    rng = random.Random(5)
    docs, edits = [], {}
    for k in range(120):
        passage = words(rng, 60, "p")
        docs.append((k, " ".join(words(rng, 40, "a") + passage + words(rng, 40, "b"))))
        copy, edits[1000 + k] = list(passage), k % 5
        for at in rng.sample(range(5, 55), k % 5):
            copy[at] = f"e{rng.randrange(10**6)}"
        docs.append((1000 + k, " ".join(words(rng, 40, "c") + copy + words(rng, 40, "d"))))
    found = {r.doc_id for r in repeated_passages(docs_of(docs)).collect()}
    share = {n: sum(i in found for i, m in edits.items() if m == n) / 24 for n in range(5)}
    assert share[0] == share[1] == share[2] == 1 and share[3] >= 0.9 and share[4] >= 0.75, share


def test_few_diagonals_hold_all_runs():
    rng = random.Random(7)
    for _ in range(200):
        ties = [(rng.randrange(3), p, rng.randrange(6)) for p in range(40) for _ in range(rng.randrange(3))] or [(0, 1, 2)]
        other, p, y = (np.array(c) for c in zip(*ties, strict=True))
        found = covering(other, p, y)
        assert {q for _, lo, hi, _ in found for q in range(lo, hi + 1)} == set(p.tolist())
        assert all((o, q, q + d) in ties for o, lo, hi, d in found for q in range(lo, hi + 1))
    # a source's one run against many places, and a source that has them all in order
    p = np.arange(100)
    assert covering(np.repeat([1, 2], 100), np.tile(p, 2), np.concatenate((np.zeros(100, dtype=int), p + 7))) == [(2, 0, 99, 7)]


def test_common_keys_give_the_same_passages(docs_of, monkeypatch):
    rng = random.Random(29)
    line = words(rng, 30, "l")
    docs = docs_of([(k, " ".join(words(rng, 20, "a") + line + (line if k % 3 else []) + words(rng, 20, "b"))) for k in range(40)])
    rows = sorted(map(tuple, repeated_passages(docs).collect()))
    assert len({r[0] for r in rows}) > 20
    for sample in (1, 50):
        monkeypatch.setattr(substring_dedup, "SAMPLE", sample)
        assert sorted(map(tuple, repeated_passages(docs).collect())) == rows


def test_common_keys_are_summed_up_without_a_join(docs_of, monkeypatch):
    rng = random.Random(31)
    line = words(rng, 70, "l")
    docs = docs_of([(k, " ".join(words(rng, 20, "a") + line + words(rng, 20, "b"))) for k in range(40)])
    plans = {}
    real = substring_dedup.cut

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(substring_dedup, "SAMPLE", 50)
    monkeypatch.setattr(substring_dedup, "cut", seen)
    assert {r.doc_id for r in repeated_passages(docs).collect()} == set(range(1, 40))
    assert "LeftSemi" not in plans["sub-anchors"] and "MapInArrow" in plans["sub-anchors"]


def test_summed_gives_a_row_for_each_key_of_a_batch():
    rng = random.Random(37)
    for _ in range(50):
        rows = [(d, *zip(*((h, rng.randrange(99)) for h in rng.sample(range(-9, 9), rng.randrange(1, 12))), strict=True)) for d in rng.sample(range(50), 12)] + [(7, (), ())]
        keys = rng.sample(range(-12, 12), 5)
        batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([list(r[1]) for r in rows], pa.list_(pa.int64())), pa.array([list(r[2]) for r in rows], pa.list_(pa.int32()))], names=["doc_id", "hashes", "places"])
        found = next(_summed(keys)(iter([batch]))).to_pydict()
        held = {k: sorted((d, p) for d, hs, ps in rows for h, p in zip(hs, ps, strict=True) if h == k) for k in keys}
        assert list(zip(*found.values(), strict=True)) == [(k, *held[k][0], held[k][-1][0]) for k in sorted(keys) if held[k]]
