"""Token ids of whole texts by a public word-level BPE file, with a bounded memo of words.

The tokenizer normalises, drops white space and never lets a token cross it,
so a text's ids are those of its white-space separated parts in order.  Parts
are ASCII lower-cased first (the tokenizer would do it anyway).  A run of
ASCII marks (no apostrophe) behind a letter or digit is a word of its own for the tokenizer,
so a part's stem and its marks are looked up apart; what is new goes through
the tokenizer in one batch.  The file's special tokens, written out in a text, are those tokens: the text is cut
at them first, and what lies between is ordinary text, as the tokenizer's plain call has it.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .wordkernel import LOWER, Words, same_words

MEMO = 1_000_000

#: A stem that ends in an ASCII letter or digit or in a Latin letter of two bytes (U+00DF-U+00F6, U+00F8-U+00FF), and marks.
_MARKED = re.compile(rb"(.*(?:[0-9a-z]|\xc3[\x9f-\xb6\xb8-\xbf]))[!-&(-/:-@\[-`{-~]+\Z", re.DOTALL)


class WordTokenizer:
    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = {t.content: np.array([i], dtype=np.uint32) for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special}
        self._cut = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) or "(?!)")
        # after the cut no text holds one; lower-cased words that look like one are no special tokens
        self._tokenizer.encode_special_tokens = True
        self._memo: dict[bytes, bytes] = {}
        self._last = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        self._last[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._most = memo

    def _learn(self, parts: list[bytes]) -> None:
        """Put new parts into the memo.

        A part of letters alone is one word for the tokenizer, and only a word's last
        token ends it; so such parts go in as one text, whose ids are cut at those
        tokens.  Should their number differ, the parts go in one by one as the others do.
        """
        memo, rest = self._memo, []
        letters = [p for p in parts if p.decode().isalpha()]
        for at in range(0, len(letters), 1024):
            some = letters[at : at + 1024]
            ids = np.array(self._tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self._last[ids]) + 1
            if len(ends) != len(some):
                rest += some
                continue
            raw, begin = ids.tobytes(), 0
            for part, end in zip(some, (4 * ends).tolist(), strict=True):
                memo[part] = raw[begin:end]
                begin = end
        known = set(letters)
        rest += [p for p in parts if p not in known]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            found = self._tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            for part, ids in zip(some, found, strict=True):
                memo[part] = array("I", ids.ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as uint32; none for a null."""
        texts = [t or "" for t in texts]
        if not any(map(self._cut.search, texts)):
            return self._plain(texts)
        parts = [self._cut.split(t) for t in texts]
        ids = iter(self._plain([p for own in parts for p in own]))
        out = []
        for text, own in zip(texts, parts, strict=True):
            found = [next(ids) for _ in own]
            for k, name in enumerate(self._cut.findall(text)):
                found.insert(2 * k + 1, self._special[name])
            out.append(np.concatenate(found) if len(found) > 1 else found[0])
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special tokens.

        A batch's words are told apart by their hashes, so each is looked up once; should two words have one hash, all are told apart by their bytes.
        """
        memo = self._memo
        if len(memo) > self._most:
            memo.clear()
        words = Words(pa.array(texts, pa.large_string()))
        data, n = LOWER[words.raw], len(words.start)
        if n == 0:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        order = np.argsort(words.hashes)
        ranked = words.hashes[order]
        edge = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        first, which = order[edge], np.empty(n, dtype=np.int64)
        which[order] = np.cumsum(edge) - 1
        text = data.tobytes()
        if not same_words(data, words.start, words.end, first[which]):
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
            own = list(known)
        else:
            own = [text[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        found = list(map(memo.get, own))
        new = [w for w, ids in zip(own, found, strict=True) if ids is None]
        if new:
            ends = {w: m.end(1) for w in new if (m := _MARKED.match(w))}
            stems = {w[:k] for w, k in ends.items()} | {w[k:] for w, k in ends.items()}
            self._learn([p for p in stems.union(w for w in new if w not in ends) if p not in memo])
            for w, k in ends.items():
                memo[w] = memo[w[:k]] + memo[w[k:]]
            found = [memo[w] if ids is None else ids for w, ids in zip(own, found, strict=True)]
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        many, begin = size[which], (np.cumsum(size) - size)[which]
        end = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(begin - end[:-1], many) + np.arange(end[-1])]
        cuts = end[words.first].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
