import random
import re

import numpy as np

from quillspark.llm.decontaminate import leaks, op9_benchmark_decontamination, smith_waterman, without_leaks


def plain(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores():
    rng = np.random.default_rng(2)
    for _ in range(80):
        a, b = rng.integers(0, 5, rng.integers(0, 14)), rng.integers(0, 5, rng.integers(0, 14))
        assert smith_waterman(a, b)[0] == plain(a.tolist(), b.tolist())


def test_edited_copies_are_found_and_clean_documents_are_not(spark, docs_of):
    rng = random.Random(7)
    common = "the of and to in that is was for it".split()
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"v{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(40))) for k in range(20)]
    docs, held = [], set()
    for k in range(200):
        body = [word() for _ in range(150)]
        if k % 2:
            item, text = items[k % 20]
            copy = [f"q{rng.randrange(99)}" if rng.random() < (0.15 if k % 4 == 1 else 0) else w for w in text.split()]
            body[70:70] = copy
            held.add((k, item))
        docs.append((k, " ".join(body)))
    bench = spark.createDataFrame([*items, (50, None), (51, "a b"), (None, "x y z w")], "item_id bigint, text string")
    df = docs_of(docs)
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == held
    assert sorted(r.doc_id for r in without_leaks(df, bench).collect()) == [k for k in range(200) if k % 2 == 0]


def test_an_item_that_every_document_holds(spark, docs_of):
    item = " ".join(f"z{i}" for i in range(30))
    df = docs_of([(k, f"a{k} b{k} {item} c{k}") for k in range(60)])
    rows = leaks(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert len(rows) == 60 and all(r.similarity == 1 and r.start_word == 2 and r.end_word == 32 for r in rows)


def test_an_exact_and_an_edited_copy_of_one_item(spark, docs_of):
    item = [f"z{i}" for i in range(22)]
    edited = [f"q{i}" if i in (4, 9, 14, 19) else w for i, w in enumerate(item)]
    docs = [(1, item), (2, edited), (3, [f"n{i}" for i in range(40)]), (4, ["a", "p", "q", "r", "b"])]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "p q r")], "item_id bigint, text string")
    rows = leaks(docs_of([(k, " ".join(w)) for k, w in docs]), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in rows) == [(1, 1, 44), (2, 1, 32), (4, 2, 6)]


def test_odd_rows(spark, odd, none):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    bench = spark.createDataFrame([(1, "the same line")], "item_id bigint, text string")
    assert leaks(odd, empty).collect() == [] and leaks(none, bench).collect() == []
    assert [(r.doc_id, r.item_id, r.start_word, r.end_word, r.similarity) for r in leaks(odd, bench).collect()] == [(9, 1, 0, 3, 1.0)]
    assert without_leaks(none, bench).columns == none.columns and without_leaks(odd, bench).count() == 10


def test_the_whole_query_finds_what_aligning_everything_finds(spark, sf):
    """Every document against every item that shares enough of its words for the threshold."""
    held = {}
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = split(d.text)
        have = set(words)
        for item, own in items.items():
            if len(own) >= 3 and sum(w in have for w in own) >= 0.6 * len(own):
                number = {w: i for i, w in enumerate({*words, *own})}
                score = smith_waterman(np.array([number[w] for w in words]), np.array([number[w] for w in own]))[0]
                if score >= 0.6 * 2 * len(own):
                    held[d.doc_id, item] = score
    assert held and {(r.doc_id, r.item_id): r.score for r in op9_benchmark_decontamination(spark, sf).collect()} == held
