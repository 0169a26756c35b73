"""Token counts by a unigram model without the tokens themselves.

An Aho-Corasick automaton lists the vocabulary's matches that end at every
character; a Viterbi pass carries the best score up to there and the number of pieces of
that best path.  Ties are as in the tokenizer: starts are tried from the
left, and only a strictly better score replaces the path held, so of equal ones the
longest last piece stays.  A character that no piece of one character covers
may be an unknown of score (least score - 10); it counts as its UTF-8 bytes where the vocabulary
falls back to bytes, else neighbouring unknowns count as one.

Scores of the vocabulary file are whole numbers, which doubles add exactly, so
a text's path is that of its parts wherever no piece can cross: at a line
break, and before a space mark that follows another character.  Parts are memoised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import python_ready

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 500_000


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The ordinary pieces of a sentencepiece file with their scores, and whether it has byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [(model.id_to_piece(i), float(model.get_score(i))) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return plain, any(model.is_byte(i) for i in ids)


class UnigramCounter:
    """Counts pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, memo: int = MEMO):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                scores.setdefault(piece, score)
        for piece, score in scores.items():
            self._automaton.add_word(piece, (len(piece), score))
        if scores:
            self._automaton.make_automaton()
        self._unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self._single = {p for p in scores if len(p) == 1}
        self._bytes = byte_fallback
        # where no piece may cross; a piece that has a mark or a break elsewhere takes the cut away
        inner = any(MARK in p.lstrip(MARK) for p in scores)
        breaks = any("\n" in p and p != "\n" for p in scores)
        cuts = [] if inner else [f"(?<=[^{MARK}])(?={MARK})"]
        cuts += [] if breaks else [r"(?=\n)", r"(?<=\n)"]
        self._cut = re.compile("|".join(cuts)) if cuts and byte_fallback else None
        self._memo: dict[str, tuple[int, float, int]] = {}
        self._most = memo

    def path(self, text: str) -> tuple[int, float, int]:
        """(pieces, score, unknown characters) of the best path over one part."""
        n = len(text)
        if n == 0:
            return 0, 0.0, 0
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self._automaton):
            for end, entry in self._automaton.iter(text):
                found[end].append(entry)
        best, count, unknown, held = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            char = text[end - 1]
            options = sorted(found[end - 1], reverse=True)  # longest first: leftmost start first
            top = start = None
            for size, score in options:
                total = best[end - size] + score
                if top is None or total > top:
                    top, start = total, end - size
            if char not in self._single:
                total = best[end - 1] + self._unknown
                if top is None or total > top:
                    top, start = total, -1
            best[end] = top
            if start >= 0:
                count[end], unknown[end] = count[start] + 1, unknown[start]
            else:
                held[end] = True
                more = len(char.encode()) if self._bytes else int(not held[end - 1])
                count[end], unknown[end] = count[end - 1] + more, unknown[end - 1] + 1
        return count[n], best[n], unknown[n]

    def __call__(self, text: str | None) -> tuple[int, float, int]:
        """(pieces, score, unknown characters) of a whole text; nothing for a null or an empty one.

        As in the vocabulary's tokenizer, a mark goes before the text and stands for every space.
        """
        if not text:
            return 0, 0.0, 0
        memo, pieces, score, unknown = self._memo, 0, 0.0, 0
        if len(memo) > self._most:
            memo.clear()
        text = MARK + text.replace(" ", MARK)
        for part in self._cut.split(text) if self._cut else [text]:
            known = memo.get(part)
            if known is None:
                known = memo[part] = self.path(part)
            pieces += known[0]
            score += known[1]
            unknown += known[2]
        return pieces, score, unknown


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = UnigramCounter(*vocabulary(path))
        for batch in batches:
            rows = [count(t) for t in batch.column(1).to_pylist()]
            pieces, scores, unknown = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(pieces, pa.int64()), pa.array(scores, pa.float64()), pa.array(unknown, pa.int64())], names=["doc_id", "n_tokens", "best_score", "n_unknown_chars"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, best_score, n_unknown_chars for every row of ``docs``.

    Null and empty texts have no tokens.  Rows come back as often as they come, null doc_ids too;
    other columns are not looked at.  One pass, no shuffle.
    """
    python_ready(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(path), "doc_id bigint, n_tokens bigint, best_score double, n_unknown_chars bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and its token count for every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
