"""Whole-text encoding with a public tokenizer, at table speed.

A byte-level BPE never merges across pre-token borders. Such a border lies before a single space, and before and
after a single line feed, that has no white space beside it; and between a Latin letter and a following comma or
full stop. Texts are cut there, each distinct cut is encoded once by the `tokenizers` library, and the ids are
joined. A text with white space of other kinds than ASCII's is encoded by the library in one piece. Either way
the ids equal those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
import sys

import numpy as np

from keyloom.llm.bytetext import ragged, slices, span_hashes

#: Cuts kept in memory by one Python worker, 30 bytes or so each; beyond it the table starts anew.
TABLE_CUTS = 600_000
#: Cuts learned lately, up to which they stay in a table of their own.
LATE_CUTS = 100_000
_OTHER_BLANKS = re.compile("[\x00\x1c-\x1f\x85\xa0 ᠎ -     　]")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's definition, read on the driver and shipped with the tasks (1.5 MB, a fixed size)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where cuts begin: texts' starts, their closing zero bytes, and the sure borders."""
    begins = np.zeros(len(data), bool)
    begins[starts[:-1]] = True
    begins[starts[1:] - 1] = True
    mid, before, after = data[1:-1], data[:-2], data[2:]
    lone = (mid == 32) | (mid == 10)
    lone &= ~_WHITE[before] & ~_WHITE[after]
    begins[1:-1] |= lone
    begins[2:] |= lone & (mid == 10)
    letter = _LETTER[before]
    letter[1:] |= (before[:-1] == 0xC3) & (before[1:] >= 0x80) & (before[1:] != 0x97) & (before[1:] != 0xB7)
    begins[1:-1] |= letter & ((mid == 44) | (mid == 46))
    return np.flatnonzero(begins)


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two tables of distinct keys as one, in order of keys."""
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))


class Encoder:
    """Encodes lists of texts into flat id arrays with offsets."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        pre = repr(self.tok.pre_tokenizer)
        self.cuttable = self.tok.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre
        self.line_feed = np.array(self.tok.encode("\n", add_special_tokens=False).ids)
        self._empty()

    def _empty(self) -> None:
        """No cuts known: (sorted keys, first ids, sizes) of the many, and of those learned lately."""
        none = lambda: (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.known, self.late, self.ids = none(), none(), np.empty(0, self.dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encode_cuts(self, cuts: list[str]) -> list[np.ndarray]:
        """Cuts without white space but for a leading space go to the library many at a time, a line feed between."""
        out: list[np.ndarray | None] = [None] * len(cuts)
        plain = [i for i, c in enumerate(cuts) if c[1:].split() == [c[1:]] and c[0] not in "\t\n\r\x0b\x0c"] if len(self.line_feed) == 1 else []
        groups = [plain[i : i + 32] for i in range(0, len(plain), 32)]
        for group, e in zip(groups, self.tok.encode_batch_fast(["\n".join([cuts[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(ids == self.line_feed[0])
            if len(ends) == len(group) - 1:
                for i, a, b in zip(group, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)]):
                    out[i] = ids[a:b]
        return [self.whole(c) if x is None else x for c, x in zip(cuts, out)]

    def _learn(self, keys: np.ndarray, cuts: list[str]) -> None:
        found = self._encode_cuts(cuts)
        size = np.fromiter(map(len, found), np.int64, len(found))
        added = (keys, len(self.ids) + np.cumsum(size) - size, size)
        self.ids = np.concatenate([self.ids, *found])
        # The large table is copied seldom.
        self.late = _merged(self.late, added)
        if len(self.late[0]) > LATE_CUTS:
            self.known, self.late = _merged(self.known, self.late), tuple(x[:0] for x in added)

    def _entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, size) of each key's cut; size -1 where it isn't known."""
        at, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for k, a, n in (self.known, self.late):
            if len(k):
                where = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                hit = k[where] == keys
                at[hit], size[hit] = a[where[hit]], n[where[hit]]
        return at, size

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's offset and the end). Null counts as empty."""
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if not self.cuttable or ((not t.isascii() or "\0" in t or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t) and _OTHER_BLANKS.search(t))}
        flat, counts = [], []
        for i, j, data, starts in slices(["" if k in odd else t for k, t in enumerate(texts)]):
            begin = _cuts(data, starts)
            end = np.append(begin[1:], len(data))
            text_of = np.searchsorted(starts, begin, "right") - 1
            real = begin != starts[text_of + 1] - 1  # not a closing zero byte
            begin, end, text_of = begin[real], end[real], text_of[real]
            keys, first, which = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
            if len(self.known[0]) > TABLE_CUTS:
                self._empty()
            if len(new := np.flatnonzero(self._entries(keys)[1] < 0)):
                raw = data.tobytes()
                self._learn(keys[new], [raw[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())])
            at, size = (x[which] for x in self._entries(keys))
            ids = self.ids[np.repeat(at, size) + ragged(size)] if len(size) else self.ids[:0]
            count = np.bincount(text_of, size, j - i).astype(np.int64)
            if here := [k for k in range(i, j) if k in odd]:
                parts = np.split(ids, np.cumsum(count)[:-1])
                for k in here:
                    parts[k - i] = self.whole(texts[k])
                count = np.array([len(p) for p in parts], np.int64)
                ids = np.concatenate(parts)
            flat.append(ids)
            counts.append(count)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.empty(0, np.int64)]))]).astype(np.int64)
        return np.concatenate([*flat, np.empty(0, self.dtype)]), offsets


def encoder(definition: str) -> Encoder:
    """This worker's encoder: kept from task to task, as workers are reused."""
    kept = sys.__dict__.setdefault("_keyloom_encoders", {})
    key = hash(definition)
    if key not in kept:
        kept[key] = Encoder(definition)
    return kept[key]
