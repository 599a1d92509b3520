"""Byte-level BPE over whole columns of text: split in numpy, each distinct word encoded once.

The vocabulary is a file of the `tokenizers` library, whose path is a
parameter; ids equal those of that library, which takes the file's added tokens
where a text spells them out. A worker keeps the ids of the words it has met, up
to KEPT of them.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import tiktoken

from .common import mix64
from .words import _powers

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White_Space of Unicode and the contractions that the splitter knows (fixed values).
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a worker keeps.
KEPT = 600_000
_GAP = re.compile(r"(?<=\S) (?=\S)")


def _kind(code: int) -> int:
    if code in _SPACES:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], OTHER)


def _kinds(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    far = codes > 0xFFFF
    if not far.any():
        return table[codes]
    out = table[np.where(far, 0, codes)]
    found, which = np.unique(codes[far], return_inverse=True)
    out[far] = np.array([_kind(int(c)) for c in found], np.uint8)[which]
    return out


def word_starts(codes: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the splitter's words begin; firsts: where texts begin."""
    kind = _kinds(codes, table)
    begin = np.zeros(len(codes), bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin[firsts] = True
    after = np.flatnonzero(begin & (kind != SPACE))
    after = after[after > 0]
    text_start = np.zeros(len(codes), bool)
    text_start[firsts] = True
    after = after[(kind[after - 1] == SPACE) & ~text_start[after]]
    begin[after - 1] = True
    begin[after[codes[after - 1] == 32]] = False
    for i in np.flatnonzero((codes == 39) & begin).tolist():
        tail = "".join(map(chr, codes[i + 1 : i + 3]))
        size = 2 if tail[:1] and tail[0] in _SHORT else 3 if tail in _LONG else 0
        if size and not text_start[i + 1 : i + size].any():
            begin[i + 1 : i + size] = False
            if i + size < len(codes):
                begin[i + size] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes lists of texts; made once a worker for each vocabulary file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        #: The added tokens, and what finds them, the longest first.
        self._special = special
        self._spelt = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # the 256 printable stand-ins of the bytes: those that print stand for themselves, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        stand = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(stand[c] for c in word): i for word, i in vocab.items() if word not in special}
        self._bpe = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends_sentence = np.zeros(max(vocab.values()) + 2, bool)
        for word, i in ranks.items():
            self.ends_sentence[i] = word.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")
        self._table = np.array([_kind(c) for c in range(0x10000)], np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._known, self._at, self._size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self._known) + len(words) > KEPT:
            self._forget()
        found = [self._bpe._core_bpe.encode_single_piece(w.encode("utf-8", "replace")) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.uint32, int(size.sum()))
        at = len(self._ids) + np.cumsum(size) - size
        place = np.searchsorted(self._known, hashes)
        self._known, self._at, self._size = np.insert(self._known, place, hashes), np.insert(self._at, place, at), np.insert(self._size, place, size)
        self._ids = np.concatenate((self._ids, flat))

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate(([0], np.cumsum(lengths)))
        starts = word_starts(codes, edges[:-1][lengths > 0], self._table)
        ends = np.append(starts[1:], len(codes))
        power, inverse = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.minimum(np.searchsorted(self._known, distinct), max(0, len(self._known) - 1))
            new = self._known[place] != distinct if len(self._known) else np.ones(len(distinct), bool)
            if not new.any():
                break
            if len(self._known) + int(new.sum()) > KEPT:
                self._forget()
                new[:] = True
            self._learn(distinct[new], [joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        size, at = self._size[place][which], self._at[place][which]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self._ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, edges)])

    def encode(self, texts: list[str], piece: int = 1 << 20):
        """(index, ids) of each text in order; whole texts, of any length."""
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) <= piece):
                held += len(texts[j])
                j += 1
            if j == i + 1 and held > 2 * piece:
                yield i, self._spelling(texts[i], piece)
            else:
                # texts that spell out an added token are few, and encoded for themselves
                odd = [k for k in range(i, j) if self._spelt and self._spelt.search(texts[k])]
                ids, sizes = self._piece(["" if k in odd else texts[k] for k in range(i, j)] if odd else texts[i:j])
                at = np.concatenate(([0], np.cumsum(sizes)))
                for k in range(i, j):
                    yield k, self._spelling(texts[k], piece) if k in odd else ids[at[k - i] : at[k - i + 1]]
            i = j

    def _spelling(self, text: str, piece: int) -> np.ndarray:
        """A text cut at the added tokens."""
        parts = self._spelt.split(text) if self._spelt else [text]
        return np.concatenate([np.array([self._special[x]], np.uint32) if k % 2 else self._long(x, piece) for k, x in enumerate(parts)])

    def _long(self, text: str, piece: int) -> np.ndarray:
        parts, begin = [np.zeros(0, np.uint32)], 0
        while begin < len(text):
            gap = _GAP.search(text, begin + piece) if begin + piece < len(text) else None
            end = gap.start() if gap else len(text)
            parts.append(self._piece([text[begin:end]])[0])
            begin = end
        return np.concatenate(parts)
