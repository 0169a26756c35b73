"""Benchmark items that documents hold, exact, edited or paraphrased.

1. The items' n-grams (three words, 64-bit hashes) are a sorted table that goes to every
   task if it has at most ``TABLE`` rows; a larger benchmark is gone through
   in parts of that size, so what is broadcast has a fixed bound.
2. One pass over the documents finds every n-gram of the table.  Hits of a
   document and an item on neighbouring diagonals make a window: the words
   about them, wide enough for a whole copy.  A window needs ``SEEDS`` distinct
   n-grams, one if the item has fewer than ``SHORT`` words, and enough of the item's words for the
   threshold.  How common an n-gram is doesn't matter: a copy may have kept just the common ones.
3. Smith-Waterman over words (equal +2, other -1, gap -1) scores window against item;
   the score over that of a whole copy is the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, python_ready
from .wordkernel import Words, as_long, as_word, ragged, shingles

GRAM, SEEDS = 3, 2
#: Score, as part of a whole copy's, from which an item counts as held.
THRESHOLD = 0.6
#: Copies at the threshold of items from this length on have at least ``SEEDS`` n-grams, whichever words were replaced.
SHORT = 16
#: Windows that one task aligns, about.
ALIGNED = 200
TABLE = 2_000_000
EQUAL, OTHER, SPACE = 2, -1, -1


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(best score, start, end) of a local alignment of b's words within a; start and end are in a."""
    best, at = 0, (0, 0)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    begun = np.zeros(len(b) + 1, dtype=np.int64)
    ramp = np.arange(len(b) + 1, dtype=np.int64) * -SPACE
    for i in range(len(a)):
        step = np.where(b == a[i], EQUAL, OTHER)
        new, start = np.zeros_like(row), np.full_like(begun, i + 1)
        diagonal = row[:-1] + step
        np.maximum(diagonal, row[1:] + SPACE, out=new[1:])
        start[1:] = np.where(diagonal >= row[1:] + SPACE, np.where(row[:-1] > 0, begun[:-1], i), begun[1:])
        dead = new <= 0
        new[dead], start[dead] = 0, i + 1
        # gaps along b: the best of new[k] + SPACE * (j - k) over k <= j
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(b) + 1), 0))
        row, begun = top - ramp, start[source]
        row[0] = 0
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (int(begun[j]), i + 1)
    return best, at[0], at[1]


def _windows(grams: np.ndarray, first: np.ndarray, items: np.ndarray, places: np.ndarray, item_words: dict[int, np.ndarray], needs: dict[int, int], threshold: float):
    """Windows of documents about hits; ``grams`` is sorted, ``first`` bounds each one's (item, place) entries."""
    lengths = {name: len(w) for name, w in item_words.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            ids, item_out, starts, parts = [], [], [], []
            for i in range(batch.num_rows):
                own = words.of(i)
                h = shingles(own, GRAM)
                if len(h) == 0 or len(grams) == 0:
                    continue
                at = np.searchsorted(grams, h)
                at[at == len(grams)] = 0
                hit = np.flatnonzero(grams[at] == h)
                if len(hit) == 0:
                    continue
                g = at[hit]
                many = first[g + 1] - first[g]
                pos = np.repeat(hit, many)
                entry = np.repeat(first[g] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                item, gram = items[entry], np.repeat(g, many)
                begin = pos - places[entry]  # where the item would begin
                order = np.lexsort((begin, item))
                item, begin, gram, pos = item[order], begin[order], gram[order], pos[order]
                slack = np.array([max(8, lengths[x] // 4) for x in item.tolist()])
                edge = np.flatnonzero((item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])) + 1
                for lo, hi in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(item)])), strict=True):
                    name = int(item[lo])
                    if len(np.unique(gram[lo:hi])) < needs[name]:
                        continue
                    wide = max(8, lengths[name] // 4)
                    # a long chain of beginnings (an item repeated at once) is cut into windows of bounded length
                    a = max(0, int(begin[lo]) - wide)
                    end = min(len(own), int(begin[hi - 1]) + lengths[name] + wide)
                    while a < end:
                        b = min(end, a + 4 * lengths[name] + 4 * wide)
                        here = np.unique(gram[lo:hi][(pos[lo:hi] >= a) & (pos[lo:hi] < b)])
                        # equal words are a bound for the score
                        if len(here) >= needs[name] and np.isin(item_words[name], own[a:b]).sum() >= threshold * lengths[name]:
                            ids.append(batch.column(0)[i].as_py())
                            item_out.append(name)
                            starts.append(a)
                            parts.append(as_long(own[a:b]))
                        if b == end:
                            break
                        a = b - lengths[name] - wide
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(item_out, pa.int64()), pa.array(starts, pa.int64()), ragged(parts, pa.int64())], names=["doc_id", "item_id", "base", "words"])

    return run


def _scores(item_words: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                item, base = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                words, own = as_word(batch.column(3)[i].values.to_numpy()), item_words[item]
                score, start, end = smith_waterman(words, own)
                if score >= threshold * EQUAL * len(own):
                    out.append((batch.column(0)[i].as_py(), item, base + start, base + end, score, score / (EQUAL * len(own))))
            kinds = [pa.int64()] * 5 + [pa.float64()]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "score", "similarity"])

    return run


def _part(docs: DataFrame, items: list[tuple[int, np.ndarray]], threshold: float) -> DataFrame:
    """Matches of some items, all of whose n-grams fit the table."""
    grams = [shingles(w, GRAM) for _, w in items]
    flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
    who = np.repeat(np.array([i for i, _ in items], dtype=np.int64), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    table, first = np.unique(flat[order], return_index=True)
    first = np.append(first, len(flat))
    needs = {i: 1 if len(w) < SHORT else min(SEEDS, len(np.unique(g))) for (i, w), g in zip(items, grams, strict=True)}
    # in a table of their own, so that they are dealt to tasks by their number: the work is in the alignment, not in the bytes
    found = cut(docs.mapInArrow(_windows(table, first, who[order], place[order], dict(items), needs, threshold), "doc_id bigint, item_id bigint, base bigint, words array<bigint>"), "leak-windows")
    return found.repartition(-(-found.count() // ALIGNED) or 1, "doc_id", "item_id", "base").mapInArrow(_scores(dict(items), threshold), "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, score bigint, similarity double")


def _items(benchmark: DataFrame) -> list[tuple[int, np.ndarray]]:
    """The items as words; a benchmark is a list of test questions, far smaller than any corpus."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL").dropDuplicates().orderBy("item_id", "text").toArrow()
    words = Words(rows.column("text"))
    own: dict[int, np.ndarray] = {}
    for i, item in enumerate(rows.column("item_id").to_pylist()):
        if len(words.of(i)) >= GRAM:
            own.setdefault(item, words.of(i).copy())
    return list(own.items())


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item it holds, at the best place.

    doc_id, item_id, start_word, end_word, score, similarity (1: a whole copy).  Null or empty texts and
    items of fewer than three words hold and are held by nothing; of rows that
    share an item_id the least text counts.  Repeated documents count once; rows with a null doc_id or item_id
    are left out.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    parts, size = [[]], 0
    for item in _items(benchmark):
        if size + len(item[1]) > TABLE and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(item)
        size += len(item[1])
    found = None
    for part in parts:
        one = _part(docs, part, threshold)
        found = one if found is None else found.unionByName(one)
    best = F.max_by(F.struct("start_word", "end_word", "score", "similarity"), F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the documents that hold an item.

    Rows with a null doc_id and null, empty and wordless texts stay; repeated rows stay or go together.  Nulls and the names of
    other columns don't matter.
    """
    held = leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(held, docs["doc_id"].cast("bigint") == held["_id"], "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, end_word, score, similarity of every document and benchmark item it holds."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
