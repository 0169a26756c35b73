"""Passages that documents share, exact or edited, by collinear chains of seeds.

1. Documents of the same word sequence are one class; only its least doc_id
   goes on, and the others are whole copies of it.
2. Seeds are five-word shingles picked by winnowing over windows of eight:
   any run of twelve equal words holds a common seed.
3. Every seed ties a document to one other place only, that of the least
   document that has the seed, so a seed of n documents makes n - 1 anchors.
   The i-th occurrence in a document meets the i-th in the other.
4. Anchors of a pair of documents are chained in order with a gap cost that
   is linear in both coordinates; a Fenwick tree over the second coordinate
   yields the best predecessor.  A chain has two anchors at least: a single common seed of five words
   is no sign of a passage, and as a corpus grows every seed is shared by chance.  A copied
   passage of fifty words with up to two edits always has a chain if one document is the least
   that has its seeds; an edited passage whose parts occur in different earlier documents may have none.
5. Chains are aligned on the words: equal runs, small gaps by edit distance,
   and both ends extended. Stretches of at least ``min_words`` words with
   at least ``percent`` of them equal are passages.
6. A passage whose parts occur in different earlier documents falls apart in that.
   So steps 3 to 5 are done once more for whole runs of ``min_words`` words within stretches of shared
   seeds: a run is tied to the least document that has all of it.  A run within words that a
   passage found before has as they are is left out, as an earlier document has it; the least document that has a
   run never leaves it out.  So every exact passage of ``min_words`` words is found.  Of the diagonals that
   tie a document's runs as few are aligned as hold them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, dealt_join, drop, numbered_copies, python_ready
from .wordkernel import Words, as_long, mix, ragged, shingles

SEED, WINDOW = 5, 8
MIN_WORDS, PERCENT = 50, 80
#: Gap cost for a word of either side, against SEED for an anchor.
GAP = 0.1
#: Words beside a chain that its ends may be extended over, and the longest gap aligned by edit distance.
FLANK, LONG_GAP = 100, 64
#: Chains with one source that are aligned together.
TOGETHER = 64
#: Places in the sample that shows which keys are common, about.
SAMPLE = 1_000_000
#: Ids up to this number are broadcast.
SMALL = 1_000_000

_CHAIN = "doc_id bigint, source_doc_id bigint, xs array<int>, ys array<int>"
_MARKS = "hashes array<bigint>, places array<int>, again array<bigint>, again_places array<int>"


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every window; within a constant run one for each window."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n <= window:
        return np.array([int(hashes.argmin())])
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    same = np.zeros(len(at), dtype=bool)
    same[1:] = (hashes[at[1:]] == hashes[at[:-1]]) & (at[1:] // window == at[:-1] // window)
    return at[~same]


class Marks:
    """Keys of each document's places: a hash, and for its later occurrences in the document the hash with their number.

    So the i-th occurrence in a document meets the i-th in another; later ones (``again``) meet the first one too.
    """

    def __init__(self) -> None:
        self.columns: list[list[np.ndarray]] = [[], [], [], []]

    def add(self, hashes: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        ranked, at, n = hashes[order], at[order].astype(np.int32), np.arange(len(hashes))
        first = np.ones(len(ranked), dtype=bool)
        first[1:] = ranked[1:] != ranked[:-1]
        nth = n - np.maximum.accumulate(np.where(first, n, 0))
        own = (as_long(np.where(first, ranked, mix(ranked + nth.astype(np.uint64)))), at, as_long(ranked[~first]), at[~first])
        for column, value in zip(self.columns, own, strict=True):
            column.append(value)

    def arrays(self) -> list[pa.Array]:
        return [ragged(c, kind) for c, kind in zip(self.columns, (pa.int64(), pa.int32()) * 2, strict=True)]


def _seeds(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, marks, keys = Words(batch.column(1)), Marks(), []
            chars = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
            for i in range(batch.num_rows):
                own = words.of(i)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                h = shingles(own, SEED) if len(own) >= min_words else own[:0]
                at = winnow(h)
                marks.add(h[at], at)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(words.first)), pa.array(np.diff(chars[words.offsets])), pa.array(keys, pa.binary()), *marks.arrays()], names=["doc_id", "n_words", "n_chars", "key", "hashes", "places", "again", "again_places"])

    return run


def unresolved(n: int, at: np.ndarray, spans: list[tuple[int, int]], min_words: int) -> np.ndarray:
    """Starts of the runs of ``min_words`` words, of ``n``, within stretches of shared seeds and not within one of ``spans``."""
    # a common run's first seed begins within a window of its start, its last one ends within a window of its end
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, np.maximum(at - WINDOW, 0), 1)
    np.add.at(step, np.minimum(at + SEED + WINDOW, n), -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    whole = inside[min_words:] - inside[: max(0, n + 1 - min_words)] == min_words
    for start, end in spans:
        whole[start : max(start, end - min_words + 1)] = False
    return np.flatnonzero(whole)


def _holding(min_words: int):
    """Rows (doc_id, at, spans) of documents that may have unresolved runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                at = batch.column(1)[i].values.to_numpy().astype(np.int64)
                keep.append(len(unresolved(int(at.max()) + SEED + WINDOW, at, [(x["start_word"], x["end_word"]) for x in spans or ()], min_words)) > 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def covering(other: np.ndarray, p: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(other, first start, last start, its place less this one's) of as few diagonals as hold every start in ``p`` of a run that ``other`` has at ``y``."""
    d = y - p
    order = np.lexsort((p, d, other))
    other, p, d = other[order], p[order], d[order]
    edge = np.flatnonzero((other[1:] != other[:-1]) | (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)) + 1
    begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(p)])) - 1
    found: list[tuple[int, int, int, int]] = []
    starts, k, best = np.unique(p).tolist(), 0, (-1, -1)
    reach = -1
    spans = sorted(zip(p[begin].tolist(), p[end].tolist(), begin.tolist(), strict=True))
    for at in starts:
        if at <= reach:
            continue
        while k < len(spans) and spans[k][0] <= at:
            best = max(best, (spans[k][1], k))
            k += 1
        lo, reach, i = spans[best[1]]
        found.append((int(other[i]), lo, reach, int(d[i])))
    return found


def _covers(min_words: int):
    """A chain for each of the diagonals that hold all tied runs of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sources, xs, ys = [], [], [], []
            ties = batch.column(1)
            fields, ends = [ties.values.field(k).to_numpy().astype(np.int64) for k in range(3)], ties.offsets.to_numpy()
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                for other, lo, hi, d in covering(*(f[a:b] for f in fields)):
                    x = np.arange(lo, hi + min_words - SEED + 1, 3 * SEED)
                    row.append(i)
                    sources.append(other)
                    xs.append(x)
                    ys.append(x + d)
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(sources, pa.int64()), ragged(xs, pa.int32()), ragged(ys, pa.int32())], names=["doc_id", "source_doc_id", "xs", "ys"])

    return run


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, marks = Words(batch.column(3)), Marks()
            for i, spans in enumerate(batch.column(2).to_pylist()):
                own = words.of(i)
                at = unresolved(len(own), batch.column(1)[i].values.to_numpy().astype(np.int64), [(x["start_word"], x["end_word"]) for x in spans or ()], min_words)
                marks.add(shingles(own, min_words)[at] if len(at) else own[:0], at)
            yield pa.record_batch([batch.column(0), *marks.arrays()], names=["doc_id", "hashes", "places", "again", "again_places"])

    return run


def chain(xs: np.ndarray, ys: np.ndarray, weight: float = SEED, gap: float = GAP) -> list[list[int]]:
    """Indices of anchors by chain, best chain first; both coordinates rise strictly along a chain.

    Best score of a chain that ends in an anchor: its weight plus the best of
    nothing and score(j) - gap * (dx + dy) over earlier anchors j.  With
    score(j) + gap * (x_j + y_j) in a Fenwick tree of prefix maxima over y, each
    anchor costs two walks of logarithmic length.
    """
    order = np.lexsort((ys, xs))
    rank = np.unique(ys, return_inverse=True)[1] + 1
    size = int(rank.max())
    tree = [(0.0, -1)] * (size + 1)
    score, before = [0.0] * len(xs), [-1] * len(xs)
    x_of, y_of, rank_of = xs.tolist(), ys.tolist(), rank.tolist()
    waiting: list[int] = []
    last_x = None
    for i in order.tolist():
        if x_of[i] != last_x:  # anchors of one x can't follow each other
            for j in waiting:
                entry, k = (score[j] + gap * (x_of[j] + y_of[j]), j), rank_of[j]
                while k <= size:
                    if tree[k][1] < 0 or entry[0] > tree[k][0]:
                        tree[k] = entry
                    k += k & -k
            waiting, last_x = [], x_of[i]
        best, k = (0.0, -1), rank_of[i] - 1
        while k > 0:
            if tree[k][1] >= 0 and (best[1] < 0 or tree[k][0] > best[0]):
                best = tree[k]
            k -= k & -k
        gained = best[0] - gap * (x_of[i] + y_of[i]) if best[1] >= 0 else 0.0
        score[i] = weight + max(0.0, gained)
        before[i] = best[1] if best[1] >= 0 and gained > 0 else -1
        waiting.append(i)
    used = [False] * len(xs)
    found = []
    for i in sorted(range(len(xs)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if len(path) > 1:
            found.append(path[::-1])
    return found


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chain of a pair of documents."""
    for batch in batches:
        row, xs_out, ys_out = [], [], []
        xs_all, ys_all, ends = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy(), batch.column(2).offsets.to_numpy()
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            xs, ys = xs_all[a:b], ys_all[a:b]
            for path in chain(xs, ys):
                row.append(i)
                xs_out.append(xs[path])
                ys_out.append(ys[path])
        at = pa.array(row, pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), ragged(xs_out, pa.int32()), ragged(ys_out, pa.int32())], names=["doc_id", "source_doc_id", "xs", "ys"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chain of a document, with only the text about the chain and its first word's number and place."""
    for batch in batches:
        words, chains = Words(batch.column(1)), batch.column(2)
        source, xs_all, ys_all, group = (chains.flatten().field(k) for k in range(4))
        of = np.repeat(np.arange(batch.num_rows), np.diff(chains.offsets.to_numpy()))
        xs, ends = xs_all.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(np.diff(xs_all.offsets.to_numpy()))))
        a, b = np.maximum(0, xs[ends[:-1]] - FLANK), np.minimum(np.diff(words.first)[of], xs[ends[1:] - 1] + SEED + FLANK)
        at, to = words.start[words.first[of] + a], words.end[words.first[of] + b - 1]
        chars = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
        raw = words.raw.tobytes()
        step = 4096
        for k in range(0, len(of), step):
            here = slice(k, k + step)
            part = pa.array([raw[i:j].decode() for i, j in zip(at[here].tolist(), to[here].tolist(), strict=True)], pa.string())
            columns = [batch.column(0).take(pa.array(of[here])), *(c.slice(k, step) for c in (source, group, xs_all, ys_all)), pa.array(a[here], pa.int32()), pa.array((chars[at] - chars[words.offsets[of]])[here], pa.int32()), part]
            yield pa.record_batch(columns, names=["doc_id", "source_doc_id", "g", "xs", "ys", "base", "char", "part"])


def _edit(a: list[int], b: list[int]) -> list[int]:
    """For each word of a, the place in b of its equal in a longest common order, or -1."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, down = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = down[j + 1] + 1 if a[i] == b[j] else max(down[j], row[j + 1])
    out, i, j = [-1] * n, 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out[i] = j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _extend(equal: np.ndarray) -> int:
    """Words to go on from a chain's end: where 1 for equal and -2 for other words is at its most."""
    if len(equal) == 0:
        return 0
    total = np.cumsum(np.where(equal, 1, -2))
    low = np.flatnonzero(total < -24)
    total = total[: low[0]] if len(low) else total
    k = int(total.argmax()) if len(total) else 0
    return k + 1 if len(total) and total[k] > 0 else 0


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, min_words: int, percent: int, exact: list[list[tuple[int, int]]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other start, other end, equal words) along a chain of seeds at xs in a and ys in b.

    ``exact`` gets for each passage the runs (start, end) of at least ``min_words`` words that b has as they are.
    """
    pairs: dict[int, int] = {}

    def diagonal(x: int, y: int, n: int) -> None:
        hit = np.flatnonzero(a[x : x + n] == b[y : y + n])
        pairs.update(zip((hit + x).tolist(), (hit + y).tolist(), strict=True))

    x, y = int(xs[0]), int(ys[0])
    back = min(x, y)
    k = _extend((a[x - back : x] == b[y - back : y])[::-1])
    diagonal(x - k, y - k, k + SEED)
    x, y = x + SEED, y + SEED
    for u, v in zip(xs[1:].tolist(), ys[1:].tolist(), strict=True):
        dx, dy = u - x, v - y
        if dx < 0 or dy < 0:  # seeds overlap: what is new of the later one
            over = max(-dx, -dy)
            if over < SEED:
                diagonal(u + over, v + over, SEED - over)
        else:
            if dx == dy:
                diagonal(x, y, dx)
            elif dx and dy and max(dx, dy) <= LONG_GAP:
                for i, j in enumerate(_edit(a[x:u].tolist(), b[y:v].tolist())):
                    if j >= 0:
                        pairs[x + i] = y + j
            diagonal(u, v, SEED)
        x, y = max(x, u + SEED), max(y, v + SEED)
    on = min(len(a) - x, len(b) - y)
    diagonal(x, y, _extend(a[x : x + on] == b[y : y + on]))

    at = sorted(pairs)
    if len(at) < min_words * percent // 100:
        return []
    # the best stretches: an equal word weighs 100 - percent, a word of either side without one weighs -percent;
    # where more is lost than min_words equal words weigh, a new one begins, so no run of so many is left out
    found, score, best, lo, hi, n = [], 0, 0, 0, -1, 0

    def close() -> None:
        if hi >= 0 and at[hi] - at[lo] + 1 >= min_words:
            found.append((at[lo], at[hi] + 1, pairs[at[lo]], pairs[at[hi]] + 1, hi - lo + 1))
            if exact is not None:
                x, y = np.array(at[lo : hi + 1]), np.array([pairs[p] for p in at[lo : hi + 1]])
                edge = np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1)) + 1
                ends = zip(np.concatenate(([0], edge)).tolist(), np.concatenate((edge, [len(x)])).tolist(), strict=True)
                exact.append([(int(x[i]), int(x[j - 1]) + 1) for i, j in ends if j - i >= min_words])

    for n, p in enumerate(at):
        if n:
            score -= percent * max(p - at[n - 1] - 1, pairs[p] - pairs[at[n - 1]] - 1)
        if score < 0 or n == 0 or best - score > (100 - percent) * min_words:
            close()
            score, best, lo, hi = 0, 0, n, -1
        score += 100 - percent
        if score >= best:
            best, hi = score, n
    close()
    return found


def _passages(min_words: int, percent: int):
    """Passages of the chains of one source, whose text comes once for them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, chains = Words(batch.column(2)), batch.column(1)
            doc, xs_all, ys_all, base, char, part = (chains.flatten().field(k) for k in range(6))
            of = np.repeat(np.arange(batch.num_rows), np.diff(chains.offsets.to_numpy()))
            parts, other = Words(part), batch.column(0).to_numpy()
            doc, base, char = doc.to_numpy(), base.to_numpy().astype(np.int64), char.to_numpy()
            xs, ys = xs_all.flatten().to_numpy().astype(np.int64), ys_all.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.diff(xs_all.offsets.to_numpy()))))
            out: list[tuple] = []
            for k in range(len(doc)):
                a, zero, lo, span = base[k], parts.offsets[k], parts.first[k], slice(ends[k], ends[k + 1])
                runs: list[list[tuple[int, int]]] = []
                passages = align(parts.of(k), others.of(of[k]), xs[span] - a, ys[span], min_words, percent, runs)
                for (s, e, t, f, n), own in zip(passages, runs, strict=True):
                    at, to = parts.start[lo + s], parts.end[lo + e - 1]
                    begin = char[k] + len(parts.raw[zero:at].tobytes().decode())
                    out.append((doc[k], other[of[k]], a + s, a + e, t, f, n, begin, begin + len(parts.raw[at:to].tobytes().decode()), [{"start_word": int(a + u), "end_word": int(a + v)} for u, v in own]))
            columns = list(zip(*out, strict=True)) if out else [()] * (len(_NAMES) + 1)
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], _EXACT)], names=[*_NAMES, "exact"])

    return run


_NAMES = ["doc_id", "source_doc_id", "start_word", "end_word", "source_start", "source_end", "equal_words", "start_char", "end_char"]
_EXACT = pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64())]))


def one_text_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one row for each doc_id: of several the least text counts."""
    more = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if more.isEmpty():
        return docs
    return docs.join(more, "doc_id", "left_anti").unionByName(docs.join(more, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def _spread(table: DataFrame) -> DataFrame:
    """(doc_id, h, p, later) of the places in a table of ``Marks``; ``later`` are those that meet a first occurrence."""
    side = lambda h, p, later: table.select("doc_id", F.explode(F.arrays_zip(F.col(h).alias("h"), F.col(p).alias("p"))).alias("z")).select("doc_id", "z.h", "z.p", F.lit(later).alias("later"))
    return side("hashes", "places", False).unionByName(side("again", "again_places", True))


def _summed(keys: list[int]):
    """For each of ``keys`` in a batch of (doc_id, hashes, places): the least document with its place, and the last document."""
    wanted = np.sort(np.array(keys, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, p = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            doc = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
            hit = hit[np.lexsort((p[hit], doc[hit], h[hit]))]
            edge = h[hit][1:] != h[hit][:-1]
            first, last = hit[np.concatenate(([True], edge))[: len(hit)]], hit[np.concatenate((edge, [True]))[: len(hit)]]
            yield pa.record_batch([pa.array(h[first]), pa.array(doc[first]), pa.array(p[first]), pa.array(doc[last])], names=["h", "doc_id", "p", "most"])

    return run


def _tied(table: DataFrame, name: str) -> DataFrame:
    """(doc_id, other, p, y): places with a key that several documents have, and the place of the least such document.

    All places are shuffled once, by key.  Keys of more than about 1/1000 of all places, as a sample of documents shows them,
    are summed up batch by batch and broadcast instead; whichever way a key goes, its places are the same.
    """
    marks, first = _spread(table), F.expr("if(later, null, struct(doc_id, p))")
    total = table.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    step = total // SAMPLE + 1
    some = table.where(F.expr(f"pmod(xxhash64(doc_id), {step}) = 0")).select(F.explode("hashes").alias("h"))
    # no more than 1/2000 of the sample's places each, so about 2,000 keys
    common = [r["h"] for r in some.groupBy("h").count().where(F.col("count") * 2000 * step > max(total, SAMPLE)).collect()]
    # a document that has a key again has its first occurrence in hashes
    part = table.where(F.lit(bool(common))).select("doc_id", "hashes", "places").mapInArrow(_summed(common), "h bigint, doc_id bigint, p int, most bigint")
    hot = part.groupBy("h").agg(F.struct(F.min(F.struct("doc_id", "p")).alias("least"), F.max("most").alias("most")).alias("hot"))
    # what is known of a common key's places is all they need, so they are dealt by place
    dealt = marks.join(F.broadcast(hot), "h", "left").withColumn("salt", F.expr("if(hot IS NULL, 0L, xxhash64(doc_id, p))"))
    own = Window.partitionBy("h", "salt")
    dealt = dealt.withColumn("least", F.coalesce("hot.least", F.min(first).over(own))).withColumn("most", F.coalesce("hot.most", F.max("doc_id").over(own)))
    out = dealt.where("least.doc_id != most").select("doc_id", F.col("least.doc_id").alias("other"), "p", F.col("least.p").alias("y"))
    return cut(out, name)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` joined with a table that has a doc_id once at most; if these are few, only texts that it names are shuffled."""
    if ids.count() <= SMALL:
        docs = docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    return docs.join(ids, "doc_id")


def _chained(pairs: DataFrame) -> DataFrame:
    """The chains of anchors (doc_id, other, p, y)."""
    grouped = pairs.groupBy("doc_id", "other").agg(F.sort_array(F.collect_set(F.struct("p", "y"))).alias("a")).where(F.size("a") > 1)
    return grouped.select("doc_id", "other", F.col("a.p").alias("xs"), F.col("a.y").alias("ys")).mapInArrow(_chains, _CHAIN)


def _aligned(chains: DataFrame, docs: DataFrame, min_words: int, percent: int, name: str) -> DataFrame:
    """Passages along chains (doc_id, source_doc_id, xs, ys)."""
    chains = cut(chains, f"{name}-chains")
    # a source's chains go in groups, and its text to each of them
    sources = cut(chains.groupBy("source_doc_id").agg(F.count("*").alias("n")), f"{name}-sources")
    group = F.expr(f"pmod(xxhash64(doc_id, xs), (n - 1) div {TOGETHER} + 1)")
    own = dealt_join(chains, sources, "source_doc_id", chains.count()).groupBy("doc_id").agg(F.collect_list(F.struct("source_doc_id", "xs", "ys", group.alias("g"))).alias("chains"))
    own = cut(own, f"{name}-own")
    sliced = _texts(docs, own).select("doc_id", "text", "chains").mapInArrow(_slices, "doc_id bigint, source_doc_id bigint, g bigint, xs array<int>, ys array<int>, base int, char int, part string")
    sliced = sliced.groupBy("source_doc_id", "g").agg(F.collect_list(F.struct("doc_id", "xs", "ys", "base", "char", "part")).alias("chains"))
    texts = _texts(docs, sources.select(F.col("source_doc_id").alias("doc_id"), F.expr(f"(n - 1) div {TOGETHER} + 1").alias("groups"))).withColumnRenamed("doc_id", "source_doc_id")
    texts = numbered_copies(texts, "groups", "g", ["source_doc_id"])
    found = sliced.join(texts, ["source_doc_id", "g"]).select("source_doc_id", "chains", "text").mapInArrow(_passages(min_words, percent), ", ".join(f"{c} bigint" for c in _NAMES) + ", exact array<struct<start_word: bigint, end_word: bigint>>")
    out = cut(found, f"{name}-passages")
    drop(chains, sources, own)
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each passage of a document that an earlier one (by doc_id) has too.

    doc_id, source_doc_id, start_word, end_word, source_start, source_end (words from
    0, ends excluded), equal_words, start_char, end_char (code points of the text).
    Words are as in the near-duplicate operator.  Null or wordless texts, texts
    of fewer than ``min_words`` words and rows with a null doc_id have none.  Of rows that share a
    doc_id the least text counts; passages repeated within one document only are
    no matter here.  Columns other than doc_id and text are not looked at.
    """
    python_ready(docs.sparkSession, size=4 << 20)
    docs = one_text_each(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL"))
    seeds = cut(docs.mapInArrow(_seeds(min_words), f"doc_id bigint, n_words bigint, n_chars bigint, key binary, {_MARKS}").where(F.col("n_words") >= min_words), "sub-seeds")
    first = cut(seeds.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sub-classes")
    copies = cut(dealt_join(seeds.select("doc_id", "n_words", "n_chars", "key"), first.where("n > 1"), "key", seeds.count()).where("doc_id != rep").select("doc_id", "rep", "n_words", "n_chars"), "sub-copies")
    # one row for each class: the rest of its rows say the same
    others = copies.select("doc_id")
    ours = seeds.join(F.broadcast(others) if copies.count() <= SMALL else others, "doc_id", "left_anti")
    anchors = _tied(ours, "sub-anchors")
    drop(seeds, first)
    near = _aligned(_chained(anchors.where("doc_id != other")), docs, min_words, percent, "sub-near")

    # runs of min_words words in stretches of shared seeds, but for those that an earlier document was found to have as they are
    exact = near.select("doc_id", F.explode("exact").alias("e")).groupBy("doc_id").agg(F.collect_list("e").alias("spans"))
    stretches = anchors.groupBy("doc_id").agg(F.collect_list("p").alias("at")).join(exact, "doc_id", "left")
    stretches = cut(stretches.mapInArrow(_holding(min_words), stretches.schema), "sub-stretches")
    runs = _texts(docs, stretches).select("doc_id", "at", "spans", "text").mapInArrow(_runs(min_words), f"doc_id bigint, {_MARKS}")
    runs = cut(runs.where(F.size("hashes") > 0), "sub-runs")
    drop(anchors, stretches)
    tied = _tied(runs, "sub-tied")
    drop(runs)
    # a run is looked at in one document, and as few as hold them all are
    ties = tied.where("doc_id != other").groupBy("doc_id").agg(F.collect_list(F.struct("other", "p", "y")).alias("ties"))
    far = _aligned(ties.mapInArrow(_covers(min_words), _CHAIN), docs, min_words, percent, "sub-far")
    drop(tied)
    zero, whole = F.lit(0).cast("bigint"), F.col("n_words")
    same = copies.select("doc_id", F.col("rep").alias("source_doc_id"), zero.alias("start_word"), whole.alias("end_word"), zero.alias("source_start"), whole.alias("source_end"), whole.alias("equal_words"), zero.alias("start_char"), F.col("n_chars").alias("end_char"))
    return near.select(*_NAMES).unionByName(far.select(*_NAMES)).distinct().unionByName(same)


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages cut out of their texts, n_chars counted anew; documents that were nothing else go.

    The first document of a passage keeps it.  All columns and their types stay.
    """
    spans = passages.groupBy(F.col("doc_id").alias("_q_id")).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("_q_spans"))
    both = docs.join(spans, docs["doc_id"] == spans["_q_id"], "left")
    # walk the spans in order: what lies between the end reached so far and the next start stays
    walk = F.expr("aggregate(_q_spans, struct(0L AS at, '' AS out), (s, p) -> struct(greatest(s.at, p.end_char) AS at, s.out || if(p.start_char > s.at, substring(text, int(s.at) + 1, int(p.start_char - s.at)) || ' ', '') AS out), s -> s.out || substring(text, int(s.at) + 1))")
    both = both.withColumn("_q_text", F.when(F.col("_q_spans").isNull(), F.col("text")).otherwise(walk))
    both = both.where("_q_spans IS NULL OR _q_text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    fresh = {"text": F.col("_q_text"), "n_chars": F.when(F.col("_q_spans").isNull(), F.col("n_chars")).otherwise(F.length("_q_text").cast("bigint"))}
    return both.select(*[fresh[c].alias(c) if c in fresh else docs[c] for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage of at least 50 words, 80 percent of them equal, that an earlier document has too."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
