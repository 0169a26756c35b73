import itertools
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from quillspark.llm import tokens
from quillspark.llm.packing import combinations, fullest, pack, tokenizer_path
from quillspark.llm.tokens import WordTokenizer


def test_fullest_is_the_best_of_all_subsets():
    rng = random.Random(4)
    for _ in range(80):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        best = max(first + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if first + sum(c) <= 40)
        got = fullest(counts, 40)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_combinations_take_every_piece_once():
    histogram = {7: 1000, 13: 1, 64: 5, 30: 17}
    taken = dict.fromkeys(histogram, 0)
    for chosen, times in combinations(histogram, 64):
        assert sum(chosen) <= 64
        for x in chosen:
            taken[x] += times
    assert taken == histogram and combinations({}, 64) == []


def test_ids_are_the_tokenizer_s(spark, sf):
    plain = Tokenizer.from_file(tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", "don't.", "it's!!", "é.,", "x²!", "1.5,", "l'été.", "ab\x1cc.", "İ.", "Ω.", "a<|endoftext|>b", "ÉCOLE!!  z"]
    assert [x.tolist() for x in WordTokenizer(tokenizer_path(), memo=50)(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_looked_up_once_a_batch():
    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            Counted.n += 1
            return super().get(key, default)

    encode = WordTokenizer(tokenizer_path())
    encode._memo = Counted()
    ids = [x.tolist() for x in encode(["over and over " * 500, None, "", "and OVER"])]
    plain = Tokenizer.from_file(tokenizer_path())
    assert ids == [plain.encode(t, add_special_tokens=False).ids for t in ("over and over " * 500, "", "", "and OVER")]
    assert Counted.n < 20


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = ["one two one.", "two three é", "", "eleven one"]
    right = [x.tolist() for x in WordTokenizer(tokenizer_path())(texts)]
    plain = Tokenizer.from_file(tokenizer_path())
    assert right == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    class Colliding(tokens.Words):
        def _hash(self, data):
            return super()._hash(data) % np.uint64(2)

    monkeypatch.setattr(tokens, "Words", Colliding)
    assert [x.tolist() for x in WordTokenizer(tokenizer_path())(texts)] == right


def test_packed_documents_come_back(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select((odd.doc_id + 10**6).alias("doc_id"), "text"))
    rows = pack(docs).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
    encode = WordTokenizer(tokenizer_path())
    for d in docs.distinct().collect():
        if d.doc_id is None:
            continue
        ids = np.append(encode([d.text])[0], np.uint32(1)).astype("<u4")
        for r in pieces[d.doc_id]:
            assert r.start == 4096 * r.piece and r.length == len(ids[r.start : r.start + 4096])
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_special_tokens_written_out(docs_of):
    ids = np.array([320, 49407, 321, 1], dtype="<u4")
    (row,) = pack(docs_of([(1, "a<|endoftext|>b")])).collect()
    assert (row.length, row.ids_crc32) == (4, zlib.crc32(ids.tobytes()))


def test_empty(none):
    assert pack(none).collect() == []
