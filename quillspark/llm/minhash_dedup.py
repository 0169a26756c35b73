"""Near-duplicates by bottom-k sketches of one hash function.

1. A document is the set of its distinct five-word shingles (64-bit hashes);
   documents of equal sets are one class.  One pass over the texts yields the
   class key, the set's size and its ``SKETCH`` smallest hashes.
2. Inverted lists: every run of ``RUN`` neighbouring values of a sketch is a
   key.  For sets that a sketch holds whole, two sets of similarity 0.85 always
   share such a run: d values that differ leave a run of (u - d) / (d + 1)
   among u.  For larger sets the chance that 48 values hold no shared run of
   three is below 1e-9 at similarity 0.85.  A passage that many documents
   share puts few of them on one list, since three neighbours must all come
   from it.
3. Each list ties its members to one centre, the member whose lists are the
   longest (the base of a family is on more lists than its copies), so a list
   of n members makes n - 1 pairs and never n squared.
4. The union sketch (the smallest values of both) estimates the similarity;
   pairs far below the threshold go.  The rest are verified on full sets.
5. Two members of a list may be linked though its centre is linked with only
   one of them.  So the family of a centre (all members of its lists) that is
   still in several components is gone through exactly, block against block,
   between sizes that allow a link: first on sketches, which leaves the members
   that have any partner across components, then on the full sets of
   those.  A block pair returns members, or one link from a member to another
   component, and never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, dealt_join, drop, python_ready, trimmed
from .wordkernel import Words, as_long, ragged, shingle_set

SHINGLE, SKETCH, RUN = 5, 48, 3
#: Taken from the threshold for the estimate: a pair at 0.85 is lost with a chance of 2.2e-9, one at 0.80 with 3.4e-8.
MARGIN = 0.35
#: Members of a block at most, and values of a block about.
BLOCK, BLOCK_VALUES = 512, 200_000
#: Rows and bytes of an Arrow batch: executors hold several at once beside their heap.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20

_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def _key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch.column(1))
        sets = [shingle_set(words.of(i), SHINGLE) for i in range(batch.num_rows)]
        yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), ragged([as_long(s[:SKETCH]) for s in sets], pa.int64())], schema=_SETS)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch.column(0))
        sets = [shingle_set(words.of(i), SHINGLE) for i in range(batch.num_rows)]
        yield pa.record_batch([pa.array([_key(s) for s in sets], pa.binary()), ragged([as_long(s) for s in sets], pa.int64())], names=["key", "values"])


def _runs(classes: DataFrame, percent: int) -> DataFrame:
    """(run, key): one row for each run of neighbouring retained values.

    Below 84 percent sets of four and five values may be linked by runs of two and two only, so these have runs of two.
    """
    run = F.expr(f"transform(sequence(1, size(sketch) - {RUN - 1}), i -> xxhash64(slice(sketch, i, {RUN})))")
    keyed = classes.where(F.size("sketch") >= RUN).select("key", F.explode(run).alias("run"))
    if percent >= 84:
        return keyed
    short = F.expr("transform(sequence(1, size(sketch) - 1), i -> xxhash64(slice(sketch, i, 2)))")
    return keyed.unionByName(classes.where("size(sketch) IN (4, 5)").select("key", F.explode(short).alias("run")))


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and union sketch allow the threshold."""
    side = lambda c: classes.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    low = percent / 100 - MARGIN
    # the k smallest of the union, and how many of them are in both
    share = F.expr(f"aggregate(array(slice(sort_array(array_union(sa, sb)), 1, {SKETCH})), 0D, (x, u) -> size(array_intersect(u, array_intersect(sa, sb))) / greatest(size(u), 1))")
    return both.where(share >= low).select("a", "b", "na", "nb")


def _sets_of(wanted: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, values): the full sets of some classes, from the texts."""
    reps = wanted.join(ids, "key").select("rep").distinct()
    texts = docs.join(reps, docs["doc_id"] == reps["rep"], "left_semi").select("text")
    return texts.mapInArrow(trimmed(_full_sets), "key binary, values array<bigint>").dropDuplicates(["key"])


def _verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """Pairs that hold on full sets, as a table; ``ids`` gives a document for each class."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = cut(_sets_of(wanted, docs, ids), "near-sets")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("values").alias(f"v{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("va", "vb")))
    links = cut(both.where(f"100 * shared >= {percent} * (na + nb - shared)").select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
    drop(sets)
    return links


def _sides(column: pa.ListArray) -> Iterator[list[dict]]:
    """The members of each row; their values stay arrays, as numbers of Python's take four times the memory."""
    names = [f.name for f in column.type.value_type]
    for i in range(len(column)):
        fields = column.slice(i, 1).flatten().flatten()
        parts = [[x.values.to_numpy() for x in f] if pa.types.is_list(f.type) else f.to_pylist() for f in fields]
        yield [dict(zip(names, m, strict=True)) for m in zip(*parts, strict=True)]


def _incidence(left: list, right: list):
    """Shared values of every member of ``left`` with every one of ``right``, and whether their components differ."""
    sides = [[np.asarray(m["values"], dtype=np.int64) for m in side] for side in (left, right)]
    flat = np.concatenate(sides[0] + sides[1])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # a value of one member is shared with none
    keep = (count > 1)[inverse]
    tables = []
    at = 0
    for side in sides:
        sizes = [len(v) for v in side]
        rows = np.repeat(np.arange(len(side)), sizes)
        use = keep[at : at + len(rows)]
        table = np.zeros((len(side), int(column[-1]) + 1 if len(column) else 0), dtype=np.float32)
        table[rows[use], column[inverse[at : at + len(rows)]][use]] = 1
        tables.append(table)
        at += len(rows)
    names = {r: i for i, r in enumerate({m["root"] for m in (*left, *right)})}
    of = [np.array([names[m["root"]] for m in side]) for side in (left, right)]
    return (tables[0] @ tables[1].T).astype(np.int64), of[0][:, None] != of[1][None, :], of[1]


def _sizes(side: list) -> np.ndarray:
    return np.array([m["n"] for m in side], dtype=np.int64)


def _flagged(percent: int):
    """Members with any partner across components that their sketches allow: rows, not pairs."""
    low = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, keys = [], []
            for centre, left, right in zip(batch["centre"].to_pylist(), _sides(batch["members"]), _sides(batch["others"]), strict=True):
                shared, far, _ = _incidence(left, right)
                a, b = _sizes(left)[:, None], _sizes(right)[None, :]
                small = np.minimum(a, b)
                good = far & (100 * small >= percent * np.maximum(a, b)) & (shared >= low * np.minimum(small, SKETCH))
                found = [left[i]["key"] for i in np.flatnonzero(good.any(axis=1))] + [right[j]["key"] for j in np.flatnonzero(good.any(axis=0))]
                keys += found
                centres += [centre] * len(found)
            yield pa.record_batch([pa.array(centres, pa.binary()), pa.array(keys, pa.binary())], names=["centre", "key"])

    return run


def _crossing(percent: int):
    """Links across components, exact on full sets: of each member one to each other component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for left, right in zip(_sides(batch["members"]), _sides(batch["others"]), strict=True):
                shared, far, root = _incidence(left, right)
                union = _sizes(left)[:, None] + _sizes(right)[None, :] - shared
                good = far & (100 * shared >= percent * union)
                for i in np.flatnonzero(good.any(axis=1)):
                    at = np.flatnonzero(good[i])
                    for j in at[np.unique(root[at], return_index=True)[1]]:
                        u.append(left[i]["key"])
                        v.append(right[j]["key"])
            yield pa.record_batch([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """centre, members, others: every two members of a family whose sizes allow a link meet in one row.

    ``members`` has centre, key, root, n, values.  Sizes are cut into bands whose ratio is the
    threshold, so partners are in one band or in neighbouring ones; a band is
    cut into blocks of bounded length by a hash of the key, and blocks meet in twos.
    """
    band = F.floor(F.log("n") / -F.log(F.lit(percent / 100))).cast("int")
    members = members.withColumn("band", band)
    counts = members.groupBy("centre", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("values")) / BLOCK_VALUES)).cast("int").alias("blocks"))
    family = counts.groupBy("centre").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("of"))
    m = members.join(family, "centre").withColumn("own", F.expr("int(pmod(xxhash64(11, key), of[band]))"))
    spot = "named_struct('k', {}, 'i', {}, 'l', {}, 'j', {}, 'left', {}, 'right', {})"
    same = f"transform(sequence(0, of[band] - 1), o -> {spot.format('band', 'least(own, o)', 'band', 'greatest(own, o)', 'own <= o', 'own >= o')})"
    up = f"if(of[band + 1] IS NULL, array(), transform(sequence(0, of[band + 1] - 1), o -> {spot.format('band', 'own', 'band + 1', 'o', 'true', 'false')}))"
    down = f"if(of[band - 1] IS NULL, array(), transform(sequence(0, of[band - 1] - 1), o -> {spot.format('band - 1', 'o', 'band', 'own', 'false', 'true')}))"
    placed = m.select("centre", F.struct("key", "root", "n", "values").alias("m"), F.explode(F.expr(f"concat({same}, {up}, {down})")).alias("s"))
    met = placed.groupBy("centre", "s.k", "s.i", "s.l", "s.j").agg(F.collect_list(F.when(F.col("s.left"), F.col("m"))).alias("members"), F.collect_list(F.when(F.col("s.right"), F.col("m"))).alias("others"))
    return met.where("exists(others, o -> exists(members, m -> m.root != o.root))").select("centre", "members", "others")


def _rest(families: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """Links across components within families (centre, key), whatever a family's size, as a table.

    Two members of one list are members of its centre's family; what is linked
    with the centre itself is known already.
    """
    known = families.where("key != centre").join(roots, families["key"] == roots["node"], "left").select("centre", "key", F.coalesce("root", "key").alias("root"))
    mixed = known.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("centre")
    members = known.join(mixed, "centre").join(classes.select("key", F.col("n_shingles").alias("n"), F.col("sketch").alias("values")), "key")
    flagged = cut(_blocks(members, percent).mapInArrow(trimmed(_flagged(percent)), "centre binary, key binary").distinct(), "near-flagged")
    sets = cut(_sets_of(flagged.select("key").distinct(), docs, ids), "near-sets")
    members = known.join(flagged, ["centre", "key"]).join(sets.select("key", F.size("values").alias("n"), "values"), "key")
    links = cut(_blocks(members, percent).select("members", "others").mapInArrow(trimmed(_crossing(percent)), "u binary, v binary").distinct(), "near-more")
    drop(flagged, sets)
    return links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked at ``percent`` and over.

    Words are runs of bytes but 0x20 and 0x09-0x0D after A-Z are lower-cased.
    Null or wordless texts have no shingles and are linked with nothing; fewer
    than five words are one shingle.  Rows repeated as they are come back as
    often; a null doc_id stays null and never names a component that has
    another id.  ``kept`` is doc_id = component_id, null-safe.  Columns of
    ``docs`` other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    python_ready(spark, BATCH_ROWS, BATCH_BYTES)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(docs.mapInArrow(trimmed(_sketches), "doc_id bigint, n_shingles bigint, key binary, sketch array<bigint>"), "near-sketches")
    classes = cut(sets.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "near-classes")
    ids = classes.where("rep IS NOT NULL").select("key", "rep")

    runs = _runs(classes, percent)
    sizes = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    lists = cut(runs.join(sizes, "run"), "near-lists")
    fame = lists.groupBy("key").agg(F.sum("n").alias("fame"))
    centre = lists.join(fame, "key").groupBy("run").agg(F.max(F.struct("fame", "key")).alias("c")).select("run", F.col("c.key").alias("b"))
    families = cut(lists.select("run", "key").join(centre.withColumnRenamed("b", "centre"), "run").select("centre", "key").distinct(), "near-families")
    drop(lists)
    stars = families.where("key != centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    tried = cut(_estimated(stars, classes, percent), "near-stars")
    links = _verified(tried, docs, ids, percent)
    drop(tried)
    roots = components(links, "near-components")
    more = _rest(families, roots, classes, docs, ids, percent)
    drop(families)
    if not more.isEmpty():
        # the components so far are as good as their links
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), "near-components")
    named = roots.join(ids, roots["node"] == ids["key"]).groupBy("root").agg(F.min("rep").alias("component"))
    of_class = roots.join(named, "root").select(F.col("node").alias("key"), "component")
    of_class = cut(classes.select("key", "rep", "n").join(of_class, "key", "left").select("key", "n", F.coalesce("component", "rep").alias("component_id")), "near-named")
    drop(links, more, classes)
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = sets.where("n_shingles > 0").select("doc_id", "n_shingles", "key")
    out = dealt_join(full, of_class, "key", sets.count()).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(empty)
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs``, all columns, with the least doc_id of each group; rows that repeat its id and text go too."""
    stay = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    left = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_id"]), "left_semi")
    more = docs.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    if more.isEmpty():
        return left
    again = left["doc_id"].eqNullSafe(more["_id"])
    return left.join(more, again, "left_anti").unionByName(left.join(more, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, linked at 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
