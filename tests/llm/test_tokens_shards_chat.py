import hashlib
import itertools
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers

from quillspark.llm.chat import _digests, _expand, CONTROLS, SEGMENT, digests, escape, examples, full_examples, op7_chat_formatting, parse, render, unescape
from quillspark.llm.scratch import new_path
from quillspark.llm.sharding import fisher_yates, op6_sharding, read_shards, shard_schema, write_shards
from quillspark.llm.unigram import VOCABULARY, UnigramCounter, token_counts, vocabulary


def test_counts_are_those_of_the_unigram_tokenizer(spark, sf):
    pieces, by_bytes = vocabulary(public_tokenizers.path(VOCABULARY))
    plain = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256))], unk_id=0, byte_fallback=True))
    plain.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["a", " ", "  a   b ", "\n\n", "日本\U0001f600 é́", "x" * 5000, "▁▁ ▁"]
    count = UnigramCounter(pieces, by_bytes, memo=100)
    assert [count(t)[0] for t in texts] == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ties_and_unknowns_match_every_segmentation():
    pieces = [("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.0), ("aba", -6.0), ("▁", -1.0)]
    count = UnigramCounter(pieces, False)
    score, least = dict(pieces), min(s for _, s in pieces) - 10
    for n in range(1, 6):
        for text in map("".join, itertools.product("abc", repeat=n)):
            best = None
            for mask in range(1 << (n - 1)):
                parts, at = [], 0
                for i in range(n):
                    if i == n - 1 or mask >> i & 1:
                        parts.append(text[at : i + 1])
                        at = i + 1
                if all(p in score or len(p) == 1 for p in parts):
                    total = sum(score.get(p, least) for p in parts)
                    best = total if best is None or total > best else best
            assert count.path(text)[1] == best
    assert count.path("aba")[0] == 2 and count.path("ab")[0] == 1  # of -5 and -6, and of two equal ones the longest last piece
    assert count.path("cc")[0] == 1


def test_counts_of_odd_rows(odd, none):
    rows = token_counts(odd).collect()
    assert len(rows) == 11 and token_counts(none).collect() == []
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0} and len({r.n_tokens for r in rows if r.doc_id in (6, 7)}) == 1


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(0)
    seen = {}
    for _ in range(6000):
        k = tuple(fisher_yates(3, rng).tolist())
        seen[k] = seen.get(k, 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 850


def _shards(spark, df, **kw):
    path = new_path(spark, "test-shards")
    write_shards(df, path, **kw)
    return read_shards(spark, path, shard_schema(df))


def test_shards_hold_every_row_once(spark, odd, docs_of):
    hot = docs_of([(5, "hot")] * 700 + [(k, f"text {k}") for k in range(300)])
    for df in (odd, hot):
        for size in (1 << 20, 2000):
            out = _shards(spark, df, bucket_bytes=size)
            rows = out.collect()
            key = lambda r: tuple(map(repr, r))
            assert sorted(map(key, out.select(*df.columns).collect())) == sorted(map(key, df.collect()))
            counts = [sum(r._shard == k for r in rows) for k in range(8)]
            assert max(counts) - min(counts) <= 1
            assert all(sorted(r._slot for r in rows if r._shard == k) == list(range(counts[k])) for k in range(8))


def test_shards_are_the_same_again(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = lambda df: {(r.doc_id, r._shard, r._slot) for r in df.collect()}
    assert place(_shards(spark, docs)) == place(_shards(spark, docs.repartition(7)))
    assert place(_shards(spark, docs)) != place(_shards(spark, docs, seed=9))


def test_copies_do_not_depend_on_the_partitioning(spark, docs_of):
    hot = docs_of([(5, "hot")] * 900 + [(k, f"text {k}") for k in range(300)])
    place = lambda df: sorted((repr(tuple(r))) for r in df.collect())
    first = _shards(spark, hot.repartition(3), bucket_bytes=2000)
    assert place(first) == place(_shards(spark, hot.repartition(11, "text"), bucket_bytes=2000))
    counts = {r._shard: r["count"] for r in first.where("doc_id = 5").groupBy("_shard").count().collect()}
    assert min(counts.values()) > 80 and len(counts) == 8  # 112 of 150 on average


def test_own_columns_called_like_those_of_the_shards(spark):
    df = spark.createDataFrame([(1, 2, 3, {"a": [1]}), (None, None, None, None)], "_SHARD int, _slot int, __slot int, m map<string, array<int>>")
    out = _shards(spark, df)
    assert out.columns == ["__SHARD", "___slot", "__slot", "m", "_slot", "_shard"]
    assert sorted((str(tuple(r)[:4]), r._slot) for r in out.collect()) == [("(1, 2, 3, {'a': [1]})", 0), ("(None, None, None, None)", 0)]


def test_no_rows(spark, none, sf, tmp_path):
    assert _shards(spark, none).collect() == []
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    out = op6_sharding(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_sharding_query(spark, sf):
    rows = op6_sharding(spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t) + 1, zlib.crc32(t)) for i, t in docs.items()} and len(rows) == len(docs)
    for k in range(8):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots))) and len(slots) in (len(docs) // 8, -(-len(docs) // 8))


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> < \\ [\\INST]", "<<<s>", "<<SYS>><\\<SYS>>", " [/INST]", "[", "<s:assistant>x</s>", "", "a\n\nb"])
def test_escapes(text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROLS)
    for role in ("user", "a b\n]%<>é", ""):
        assert [(a, b) for a, b, _, _ in parse(render(role, text)[0] + render("assistant", text)[0])] == [(role, text), ("assistant", text)]


def test_conversations_come_back(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r.conv_id: r for r in op7_chat_formatting(spark, sf).collect()}
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append(r)
    by[-7] = None
    assert set(got) == set(by)
    for conv, rows in by.items():
        said = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")] if rows is None else [(r.role, r.text or "") for r in sorted(rows, key=lambda r: r.turn)]
        loss = "".join(t for role, t in said if role == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(said), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples_are_prefixes(spark):
    rows = [(1, 0, "system", "s", 0), (1, 1, "user", "q", 0), (1, 2, "assistant", "a", 0), (1, 3, "user", None, 0), (1, 4, "assistant", "b", 0), (1, 5, "user", "end", 0), (2, 0, "user", "alone", 0), (None, None, None, None, 0)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, example int")
    stored = examples(turns)
    # an example has all of its context, and just its own reply is trained
    assert sorted((r.conv_id or 0, r.example, r.n_turns, r.prefix_chars, [t for _, t, _, _ in parse(r.text)], r.text[r.loss_start : r.loss_end] if r.loss_start else None) for r in stored.collect()) == [
        (0, 0, 1, 0, [""], None),
        (1, 0, 3, 0, ["s", "q", "a"], "a"),
        (1, 1, 5, 0, ["s", "q", "a", "", "b"], "b"),
        (1, 2, 6, 0, ["s", "q", "a", "", "b", "end"], None),
        (2, 0, 1, 0, ["alone"], None),
    ]
    for segment in (1, 30, 1 << 14):
        cut = examples(turns, segment)
        whole = sorted(full_examples(cut, [1]).where("loss_start IS NOT NULL").collect(), key=lambda r: r.example)
        assert [r.text[r.loss_start : r.loss_end] for r in whole] == ["a", "b"] and [len(list(parse(r.text))) for r in whole] == [3, 5]
        assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in digests(cut).collect()) == [(0, 1, 0), (1, 6, 2), (2, 1, 0)]
        assert digests(cut).where("conv_id = 1").first().formatted_chars == max(len(r.text) for r in full_examples(cut, [1]).collect())
    assert examples(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


def test_a_long_conversation_has_whole_contexts_too(spark, tmp_path):
    said = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * 200) for k in range(60)]
    turns = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    rows = sorted(examples(turns).collect(), key=lambda r: r.example)
    assert len(rows[-1].text) > 3 * SEGMENT and {r.prefix_chars for r in rows} == {0}
    assert [[(role, text) for role, text, _, _ in parse(r.text)] for r in rows] == [[t[2:] for t in said[: 2 * k + 2]] for k in range(30)]
    assert [r.text[r.loss_start : r.loss_end] for r in rows] == [t[3] for t in said[1::2]]
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    key = lambda r: r.conv_id
    got = sorted(op7_chat_formatting(spark, str(tmp_path)).collect(), key=key)
    assert [r for r in got if r.conv_id == 1] == sorted(digests(examples(turns, SEGMENT)).collect(), key=key)


def test_a_conversation_of_many_turns(spark):
    """Half of the turns are one run without an assistant; time and memory stay linear in the turns."""
    n = 64_000
    rows = pa.record_batch([pa.array([1] * n), pa.array(["user"] * (n // 2) + ["user", "assistant"] * (n // 4)), pa.array([f"turn {i} </s>" for i in range(n)])], names=["conv_id", "role", "text"])
    begun = time.process_time()
    out = pa.Table.from_batches(_expand(SEGMENT)(rows.slice(k, 1000) for k in range(0, n, 1000)))
    assert time.process_time() - begun < 10
    assert max(map(len, out.column("text").to_pylist())) < SEGMENT + 100
    rows_read = out.select(["conv_id", "prefix_chars", "text", "loss_start", "loss_end"]).to_batches()
    (digest,) = pa.Table.from_batches(_digests(iter(rows_read))).to_pylist()
    replies = "".join(f"turn {i} </s>" for i in range(n // 2 + 1, n, 2))
    assert (digest["n_turns"], digest["loss_chars"], digest["loss_sha256"]) == (n, len(replies), hashlib.sha256(replies.encode()).hexdigest())
    swapped = [out.select(["conv_id", "prefix_chars", "text", "loss_start", "loss_end"]).take([1, 0]).to_batches()[0]]
    with pytest.raises(ValueError):
        list(_digests(iter(swapped)))
