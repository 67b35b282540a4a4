"""Token ids of many texts at once, each distinct part of a word coded only once.

The tokenizer folds case and composes characters inside a word, and its split
into parts never crosses blanks, so a text's ids are the ids of its words one
after another. Words of ASCII and Latin-1 letters, digits and signs are cut into
the same parts here, on arrays: runs of letters, single digits, runs of signs.
Words with anything else (other scripts, apostrophes, angle brackets, controls)
go whole through the tokenizer. Coded parts are kept by hash in a table of
bounded size; what does not fit is coded anew in each batch.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .words import SPACE, raw, span_hashes

SLOTS = 1 << 21
KEPT_IDS = 6_000_000
_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[128:] = _ODD
_KIND[:32] = _ODD
_KIND[[0x27, 0x3C, 0x7F]] = _ODD
_KIND[SPACE] = _BLANK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER


class TokenTable:
    """Tokenizer file with its table of coded parts."""

    def __init__(self, path: str, end_id: int = 1):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for parts that are lower case and composed
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.end_id = end_id
        self.key = np.zeros(SLOTS, np.uint64)
        self.at = np.full(SLOTS, -1, np.int32)  # slot -> part
        self.pool = np.array([end_id], np.uint32)  # ids of all parts; part 0 is the end token
        self.begin, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        part = np.full(len(h), -1, np.int32)
        for shift in (43, 22, 1):
            slot = (h >> np.uint64(shift)).astype(np.int64) & (SLOTS - 1)
            hit = (self.key[slot] == h) & (part < 0)
            part[hit] = self.at[slot[hit]]
        return part

    def _keep(self, h: np.ndarray, part: np.ndarray) -> None:
        for shift in (43, 22, 1):
            slot = (h >> np.uint64(shift)).astype(np.int64) & (SLOTS - 1)
            free = np.flatnonzero(self.at[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            use = free[one]
            self.key[slot[use]], self.at[slot[use]] = h[use], part[use]
            rest = np.ones(len(h), bool)
            rest[use] = False
            h, part = h[rest], part[rest]

    def _add(self, tokenizer, texts: list[str]) -> np.ndarray:
        """Code new parts; their numbers."""
        if not texts:
            return np.zeros(0, np.int32)
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.uint32, n.sum())
        first = len(self.begin)
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.pool = np.concatenate([self.pool, flat])
        return np.arange(first, first + len(texts), dtype=np.int32)

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end token, and where each text's begin."""
        data, off = raw(text)
        n = len(data)
        low = data.copy()
        kind = _KIND[data]
        caps = (data >= 65) & (data < 91)
        low[caps] += 32
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        tail = data[lead + 1] if n else data
        lead = lead[(tail != 0x97) & (tail != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        up = lead[data[lead + 1] < 0x9F] + 1
        low[up] += 32

        inside = kind != _BLANK
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        new_word = edge[:n].copy()
        new_word[1:] |= ~inside[:-1]
        word_start = np.flatnonzero(inside & new_word)
        odd_word = np.zeros(len(word_start), bool)
        word_of = np.searchsorted(word_start, np.flatnonzero(kind == _ODD), "right") - 1
        odd_word[word_of] = True
        # inside an odd word nothing is cut
        word_no = np.cumsum(inside & new_word) - 1
        odd = inside & odd_word[word_no] if len(word_start) else inside
        cut = new_word.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut = inside & (new_word | (cut & ~odd))
        start = np.flatnonzero(cut)
        stop = np.ones(n, bool)
        stop[:-1] = cut[1:] | ~inside[1:] | edge[1:n]
        end = np.flatnonzero(inside & stop) + 1
        del word_no, cut, stop, caps

        own = odd[start]
        h = span_hashes(low, start, end)
        if own.any():  # case matters for the tokenizer's special strings
            h[own] = span_hashes(data, start[own], end[own]) ^ np.uint64(0x5555555555555555)
        part = self._find(h)
        miss = np.flatnonzero(part < 0)
        kept = (len(self.pool), len(self.begin))
        if len(miss):
            value, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            code = np.empty(len(value), np.int32)
            for which, tokenizer, source in ((False, self.bare, low), (True, self.whole, data)):
                sel = np.flatnonzero(own[one] == which)
                view = source.tobytes() if len(sel) else b""
                texts = [view[a:b].decode("utf-8", "replace") for a, b in zip(start[one[sel]], end[one[sel]])]
                code[sel] = self._add(tokenizer, texts)
            part[miss] = code[back]
        first = np.searchsorted(start, off)
        part = np.insert(part, first[1:], 0)
        size = self.length[part]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[part] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        bounds = np.concatenate([[0], total])[first + np.arange(len(first))] if len(total) else np.zeros(1, np.int64)
        if len(miss):
            if len(self.pool) <= KEPT_IDS:
                self._keep(value, code)
            else:  # full: forget what this batch added
                self.pool, self.begin, self.length = self.pool[: kept[0]], self.begin[: kept[1]], self.length[: kept[1]]
        return ids, bounds


_TABLES: dict[tuple[str, int], TokenTable] = {}


def token_table(path: str, end_id: int = 1) -> TokenTable:
    """The table of this process."""
    if (path, end_id) not in _TABLES:
        _TABLES[path, end_id] = TokenTable(path, end_id)
    return _TABLES[path, end_id]
