"""Packing documents into sequences by minimum bin slack.

1. Tokenise every document, end it with ``END``, and cut only what is longer
   than a sequence.  Whole sequences are full bins of their own.
2. The rest is a histogram over at most ``size`` lengths.  On it, bin after
   bin, a subset-sum dynamic program over bitsets finds the fullest feasible
   combination of the lengths left, begun with the longest one; the
   combination is removed as often as the counts allow at once, so the
   number of programs depends on the lengths and not on the documents.
3. Pieces of one length are interchangeable: a piece's rank among them (ranks
   are summed from per-bucket counts, so a common length is no hot group)
   and the table of combinations give its sequence and its place there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, python_ready
from .tokens import WordTokenizer

SIZE, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fullest(counts: dict[int, int], size: int) -> list[int]:
    """Lengths (each at most as often as counted) that fill ``size`` best, the longest that is left among them.

    Bit s of a bitset says that s can be reached with the lengths so far; a
    length of n pieces is taken in doublings (1, 2, 4, ... and the rest), and
    the walk back over the kept bitsets gives the combination.
    """
    first = max(counts)
    room = size - first
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, bitset before
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        many = 1
        while left > 0:
            many = min(many, left)
            wider = reach | (reach << (length * many)) & mask
            if wider != reach:
                steps.append((length, many, reach))
                reach = wider
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = [first]
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * many
            total -= length * many
    return chosen


def combinations(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until nothing is left."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    found = []
    while counts:
        chosen = fullest(counts, size)
        need: dict[int, int] = {}
        for x in chosen:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        found.append((chosen, times))
    return found


def _tokenise(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(path)
        for batch in batches:
            ids_of = encode(batch.column(1).to_pylist())
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    for col, value in zip(cols, (doc, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        col.append(value)
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A null or empty text is the end id alone.  Repeated rows and rows with a null
    doc_id are packed as often as they come.  Columns other than doc_id and text are not
    looked at.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(docs.mapInArrow(_tokenise(path or tokenizer_path(), size, end), _PIECES), "pack-pieces")
    pieces = pieces.withColumn("bucket", F.expr("int(pmod(xxhash64(doc_id, piece, ids_crc32), 4096))"))
    # (length, bucket) -> rank of its first piece; at most size * 4096 rows, whatever the input
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(rank) - 1).join(starts.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))

    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    taken = dict.fromkeys(histogram, 0)
    rows, bins = [], 0
    for chosen, times in combinations(histogram, size):
        place, offsets = 0, {}
        for x in chosen:
            offsets.setdefault(x, []).append(place)
            place += x
        for x, at in offsets.items():
            rows.append((x, taken[x], taken[x] + len(at) * times, bins, at))
            taken[x] += len(at) * times
        bins += times
    # a row for each length in each combination: bounded by the lengths, not by the documents
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, [0])], "length bigint, lo bigint, hi bigint, bin bigint, places array<bigint>")
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= lo AND rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.expr("(rank - lo) div size(places)")).alias("sequence_id"), F.expr("places[int((rank - lo) % size(places))]").alias("offset"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
