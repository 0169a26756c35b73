"""Shuffled shards in two passes over the disk, for tables far larger than memory.

1. Scatter: a seeded hash of a record's contents puts it into one of B buckets, B
   such that a bucket fits a task's memory.  A record so common that its copies would fill
   buckets of their own is collapsed into one row with a count; its copies are made
   again with numbers, and record and number are hashed, so they too are scattered uniformly.
2. Each bucket is read whole by one task, put in a canonical order, shuffled by
   Fisher-Yates with a generator seeded by the bucket, and written.

The buckets after one another are one uniform shuffle of the table; shards are
equal cuts of it, so their row counts are at most one apart.  Every step depends on
the seed and the rows' contents alone, neither on their order nor on how they were partitioned: a task
that runs again, and a run over the same rows dealt otherwise, write the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField, StructType

from .scratch import cut, drop, new_path, numbered_copies, python_ready

#: Bytes of a bucket's records, about.
BUCKET_BYTES = 32 << 20
SHARDS, SEED = 8, 20_240_607
#: A side of so many rows of two numbers is broadcast, no larger one.
SMALL = 4_000_000
#: Buckets whose sizes one task sums up.
GROUP = 4096


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform order of n things."""
    order = np.arange(n)
    swaps = (rng.random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    held = order.tolist()
    for k, j in zip(range(n - 1, 0, -1), swaps, strict=True):
        held[k], held[j] = held[j], held[k]
    return np.array(held, dtype=np.int64)


def _shuffle(seed: int, bucket_at: int, order_at: int, place_at: int):
    """Rows of whole buckets in; the same rows out in shuffled order, numbered in their bucket."""

    def one(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pa.array(np.argsort(rows.column(order_at).to_numpy(), kind="stable")))
        order = fisher_yates(rows.num_rows, np.random.default_rng([seed, bucket]))
        out = rows.take(pa.array(order))
        out = out.set_column(place_at, rows.schema.field(place_at), pa.array(np.arange(out.num_rows), pa.int64()))
        yield from out.to_batches(max_chunksize=2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's rows come sorted by bucket
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            buckets = batch.column(bucket_at).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(buckets)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if now is not None and buckets[a] != now:
                    yield from one(int(now), pa.Table.from_batches(held))
                    held = []
                now = buckets[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from one(int(now), pa.Table.from_batches(held))

    return run


def _bytes(schema: StructType) -> Column:
    """Bytes of a record, about: those of its strings, of the JSON of what is nested, and eight for each other column."""
    total = F.lit(8)
    for f in schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            total = total + 8
    return total


def _out_names(columns: list[str]) -> list[str]:
    """The names of the columns in the shards: one that is called _shard or _slot gets underscores until it isn't."""
    taken, out = {"_shard", "_slot", *(c.lower() for c in columns if c.lower() not in ("_shard", "_slot"))}, []
    for c in columns:
        if c.lower() in ("_shard", "_slot"):
            while c.lower() in taken:
                c = "_" + c
            taken.add(c.lower())
        out.append(c)
    return out


def shard_schema(docs: DataFrame) -> StructType:
    """The columns that the shards of ``docs`` are read back with."""
    fields = [StructField(n, f.dataType) for n, f in zip(_out_names(docs.columns), docs.schema, strict=True)]
    return StructType([*fields, StructField("_slot", LongType()), StructField("_shard", IntegerType())])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs``, all columns, as Parquet under ``path``/_shard=k, with each row's place in its shard as _slot.

    Nulls in any column, empty texts, repeated rows and clashing column names are kept as they are, but columns that
    are themselves called _shard or _slot get underscores in front.  An empty table writes no rows.  Read
    back with ``read_shards``.
    """
    spark = docs.sparkSession
    python_ready(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    # two hashes of the whole record tell records apart; the first one orders and deals them.  Spark hashes no maps.
    parts = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema]
    rows = rows.withColumns({"_h": F.xxhash64(F.lit(seed), *parts), "_g": F.xxhash64(F.lit(seed + 2), *parts)})
    counted = cut(rows.groupBy("_h", "_g").agg(F.count("*").alias("_n"), F.sum(_bytes(docs.toDF(*names).schema)).alias("_b")), "shard-records")
    many, size = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    # at most four records for each bucket are common
    limit = max(64, many // (4 * buckets))
    common = counted.where(F.col("_n") > limit).select("_h", "_g", "_n")
    n_common = common.count()
    deal = lambda order: F.pmod(F.xxhash64(F.lit(seed + 1), order), F.lit(buckets)).cast("int")
    again = F.xxhash64("_h", "_k")
    rare = counted.where(F.col("_n") <= limit).select(deal(F.col("_h")).alias("_bucket"), "_n")
    sizes = rare.unionByName(numbered_copies(common, "_n", "_k", ["_h"]).select(deal(again).alias("_bucket"), F.lit(1).cast("bigint").alias("_n"))).groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    starts = cut(_starts(sizes), "shard-starts")
    dealt = rows.withColumn("_order", F.col("_h"))
    if n_common:
        keys = F.broadcast(common) if n_common <= SMALL else common
        whole = rows.join(keys, ["_h", "_g"]).groupBy("_h", "_g").agg(F.first("_n").alias("_n"), F.first(F.struct(*names)).alias("_r"))
        made = numbered_copies(whole, "_n", "_k", ["_h"]).select(*[F.col(f"_r.{c}").alias(c) for c in names], "_h", "_g", again.alias("_order"))
        dealt = dealt.join(keys, ["_h", "_g"], "left_anti").select(*names, "_h", "_g", "_order").unionByName(made)
    dealt = dealt.select(*names, "_order", deal(F.col("_order")).alias("_bucket"), F.lit(0).cast("bigint").alias("_place"))
    at = {c: dealt.columns.index(c) for c in ("_bucket", "_order", "_place")}
    held = dealt.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_bucket")
    mixed = held.mapInArrow(_shuffle(seed, at["_bucket"], at["_order"], at["_place"]), dealt.schema)
    placed = mixed.join(F.broadcast(starts) if buckets <= SMALL else starts, "_bucket").withColumn("_at", F.col("_before") + F.col("_place"))
    # shard k has the places from ceil(k * rows / shards) on
    placed = placed.withColumn("_shard", F.expr(f"int((_at * {shards}) div {max(many, 1)})"))
    placed = placed.withColumn("_slot", F.expr(f"_at - ((_shard * {many}L + {shards - 1}) div {shards})"))
    placed.select(*[F.col(c).alias(n) for c, n in zip(names, _out_names(docs.columns), strict=True)], "_slot", "_shard").write.mode("overwrite").partitionBy("_shard").parquet(path)
    drop(counted, starts)


def _starts(sizes: DataFrame) -> DataFrame:
    """_bucket and how many rows the buckets before it have, summed in groups of buckets."""
    grouped = sizes.withColumn("_group", F.expr(f"_bucket div {GROUP}"))
    within = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_group").agg(F.sum("_n").alias("_n"))  # a row for each GROUP buckets
    ahead = groups.select("_group", F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return grouped.withColumn("_own", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(ahead, "_group").select("_bucket", (F.col("_own") + F.col("_ahead")).alias("_before"))


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all shards, with _slot and _shard; ``schema`` is that of ``shard_schema``, so no rows are no error."""
    return spark.read.schema(schema).parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, read back from the shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "shards")
    write_shards(docs, path)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return read_shards(spark, path, shard_schema(docs)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
