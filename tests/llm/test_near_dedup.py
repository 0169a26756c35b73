import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import minhash_dedup
from quillspark.llm.components import components
from quillspark.llm.minhash_dedup import near_duplicates, one_of_each_group

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(pairs, percent=85):
    s = [(i, sets(t)) for i, t in pairs]
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(set)
    for k, (_, v) in enumerate(s):
        for g in v:
            lists[g].add(k)
    for k, (_, v) in enumerate(s):
        for m in {m for g in v for m in lists[g] if m > k}:
            shared = len(v & s[m][1])
            if 100 * shared >= percent * len(v | s[m][1]):
                parent[find(m)] = find(k)
    least = {}
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {(i, len(v), least.get(find(k))) for k, (i, v) in enumerate(s)}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_family_whose_links_do_not_all_meet_the_centre(docs_of):
    """Copies with more and more edits of one base: many pairs are just above or below the threshold."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    pairs = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(12)}"
        pairs.append((1000 - k, " ".join(copy)))
    pairs += [(2000 + k, " ".join(base[20:60] + [f"u{k}.{i}" for i in range(80)])) for k in range(40)]  # one passage, otherwise unlike
    assert got(docs_of(pairs)) == brute(pairs)


def test_small_sets(docs_of):
    pairs = [(k, " ".join("abcdefghijklm"[a:b])) for k, (a, b) in enumerate([(0, 11), (1, 12), (0, 12), (0, 4), (0, 5), (0, 4), (2, 13), (0, 10)])]
    assert got(docs_of(pairs)) == brute(pairs)


def test_odd_rows(odd, none):
    out = near_duplicates(odd).collect()
    assert len(out) == 11 and near_duplicates(none).collect() == []
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[1].kept
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 6
    assert by[None].component_id is None and by[9].component_id == 9


def test_one_of_each_group_keeps_columns_and_one_row(odd):
    out = one_of_each_group(odd)
    assert out.schema == odd.schema
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [1, 2, 3, 4, 6, 8, 9]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u int, v int")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    with pytest.raises(RuntimeError):
        components(edges, rounds=1)


def test_python_workers_hold_little(spark, docs_of):
    near_duplicates(docs_of([(1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    member = pa.struct([("key", pa.binary()), ("root", pa.binary()), ("n", pa.int64()), ("values", pa.list_(pa.int64()))])
    rows = [[], [{"key": b"a", "root": b"r", "n": 2, "values": [5, 7]}, {"key": b"b", "root": b"s", "n": 0, "values": []}], [{"key": b"c", "root": b"r", "n": 1, "values": [9]}]]
    found = list(minhash_dedup._sides(pa.array(rows, pa.list_(member)).slice(1)))
    assert all(isinstance(m["values"], np.ndarray) for side in found for m in side)
    assert [[m | {"values": m["values"].tolist()} for m in side] for side in found] == rows[1:]
