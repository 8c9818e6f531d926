"""A byte-pair model file as flat numpy tables: encoding by merge rounds, decoding by gathering bytes.

Texts are cut into words where no piece can span (a space mark after another
character), every distinct word is encoded once, and all words of a batch are
merged together. A round finds the least pair rank of each word (a segment of
the flat symbol array), merges its leftmost occurrences that do not overlap,
and compacts the arrays. Words without a pair leave; the rounds end with the
last word.

Scores need not fall from a piece to its extensions: a merge may make a pair
that goes before the next occurrence of the round. Such a merge holds back
the word's occurrences behind it that it could reach, for a later round.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import numpy as np

MARK = "▁"
#: Distinct words that a task remembers before it starts anew.
WORDS_KEPT = 200_000
#: Characters of a text that are cut into words at a time.
PART_CHARS = 1 << 20
_CHARS = 0x110000
_NONE = np.iinfo(np.int32).max
#: Kinds of pieces and of models in model files (fixed values of the format).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)
_BPE = 2
_UNKNOWN_TEXT = " ⁇ "

codecs.register_error("orrery_each_byte", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1 ... (sizes[i] of them) of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class PieceModel:
    """Encoding and decoding as the sentencepiece library does them for BPE models with byte pieces and no normalisation; ValueError for other models."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        of = lambda n: dict(_fields(b"".join(v for k, v in fields if k == n)))
        trained, normal = of(2), of(3)
        parts = [dict(_fields(v)) for k, v in fields if k == 1]
        pieces = [p[1].decode() for p in parts]
        kinds = np.array([p.get(3, _NORMAL) for p in parts])
        scores = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in parts])
        plain = trained.get(3) == _BPE and trained.get(35) and normal.get(1) == b"identity" and normal.get(4) == 0 and normal.get(3, 1) and normal.get(5, 1) and not trained.get(24)
        if not plain or np.isin(kinds, (_USER, _UNUSED)).any() or (kinds == _BYTE).sum() != 256:
            raise ValueError(f"{path}: not a BPE model with byte pieces, without normalisation and user-defined pieces")
        self.size = len(pieces)
        self.end = pieces.index("</s>")
        self.bytes = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)])
        normal_ids = np.flatnonzero(kinds == _NORMAL)
        self._symbols(pieces, scores, normal_ids)
        self._surfaces(pieces, kinds)
        self._word_pattern({pieces[i]: scores[i] for i in normal_ids})
        self._forget()

    def _symbols(self, pieces: list[str], scores: np.ndarray, ids: np.ndarray) -> None:
        """Symbols are pieces by id, and characters that are no piece by size + code point."""
        self.symbol = np.arange(_CHARS, dtype=np.int64) + self.size
        vocabulary = {pieces[i]: int(i) for i in ids}
        for piece, i in vocabulary.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        known = lambda s: vocabulary[s] if s in vocabulary else self.symbol[ord(s)] if len(s) == 1 else -1
        self.wide = self.size + _CHARS
        pairs, beside = {}, set()
        for piece, i in vocabulary.items():
            for k in range(1, len(piece)):
                beside.add(ord(piece[k - 1]) * _CHARS + ord(piece[k]))
                left, right = known(piece[:k]), known(piece[k:])
                if left >= 0 and right >= 0:
                    pairs[left * self.wide + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        rank = np.full(self.size, _NONE, np.int32)
        rank[ids] = np.unique(-scores[ids], return_inverse=True)[1]
        self.ranks = rank[self.merged]
        self.beside = np.array(sorted(beside), np.int64)
        self.longest = max(map(len, vocabulary))

    def _surfaces(self, pieces: list[str], kinds: np.ndarray) -> None:
        """What each id is in decoded text."""
        shown = []
        for piece, kind in zip(pieces, kinds, strict=True):
            if kind == _BYTE:
                shown.append(bytes([int(piece[3:5], 16)]))
            else:
                shown.append({_CONTROL: "", _UNKNOWN: _UNKNOWN_TEXT}.get(kind, piece.replace(MARK, " ")).encode())
        self.surface = np.frombuffer(b"".join(shown), np.uint8)
        self.surface_size = np.array([len(s) for s in shown])
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.control = kinds == _CONTROL
        self.leads = np.array([k == _NORMAL and p.startswith(MARK) for p, k in zip(pieces, kinds, strict=True)])

    def _word_pattern(self, scores: dict[str, float]) -> None:
        """Words are cut before a mark that follows another character.

        Marks alone are merged last and from the left if their pieces share
        the least score and none but the last mark joins a letter. If the
        longest of them then is made of the first marks of a run, whatever
        follows, a run is cut after as many: what is left of it is merged as
        if it began there.
        """
        if any(MARK in p.lstrip(MARK) for p in scores):
            self.words = re.compile(".+", re.S)
            return
        marks = {len(p): s for p, s in scores.items() if p == MARK * len(p) and len(p) > 1}
        others = [s for p, s in scores.items() if p.strip(MARK)]
        last = len(set(marks.values())) == 1 and min(others) > max(marks.values()) and not any(p.startswith(MARK * 2) and p.strip(MARK) for p in scores)
        most = max(marks, default=0)
        if last and all(self._of_marks(n) == self._of_marks(most) + self._of_marks(n - most) for n in range(most + 1, 2 * most + 1)) and len(self._of_marks(most)) == 1:
            self.words = re.compile(f"{MARK}{{{most}}}(?={MARK})|{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _of_marks(self, n: int) -> list[int]:
        """The pieces of so many marks."""
        return self._merge(np.full(n, self.symbol[ord(MARK)]), np.zeros(n, np.int64))[0].tolist()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id last, and where each text's begin (and the end)."""
        found, sizes = [], np.ones(len(texts), np.int64)
        words, owners, held = [], [], 0

        def encoded() -> None:
            ids, counts = self._encode_words(words)
            found.append((ids, np.repeat(np.array([o for o, _ in owners], np.int64), np.add.reduceat(counts, [at for _, at in owners]))))

        for i, text in enumerate(texts):
            for part in self._parts(text):
                owners.append((i, len(words)))
                words += self.words.findall(part)
                held += len(part)
                if held >= PART_CHARS:
                    encoded()
                    words, owners, held = [], [], 0
        if words:
            encoded()
        for _, owner in found:
            sizes += np.bincount(owner, minlength=len(texts))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        out = np.full(starts[-1], self.end, np.int32)
        inner = np.ones(len(out), bool)
        inner[starts[1:] - 1] = False
        if found:
            out[inner] = np.concatenate([ids for ids, _ in found])
        return out, starts

    def _parts(self, text: str) -> Iterator[str]:
        """The text with a mark in front, cut before spaces that follow another character."""
        start, front = 0, MARK
        while start < len(text):
            at = text.find(" ", start + PART_CHARS)
            while 0 < at < len(text) and text[at - 1] in (" ", MARK):
                at = text.find(" ", at + 1)
            at = len(text) if at < 0 else at
            yield front + text[start:at].replace(" ", MARK)
            start, front = at, ""

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        if len(self.slot) > WORDS_KEPT:
            self._forget()
        fresh = [w for w in dict.fromkeys(words) if w not in self.slot]
        if fresh:
            ids, sizes = self.encode_distinct(fresh)
            first = len(self.slot)
            self.slot.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        sizes = self.starts[slots + 1] - self.starts[slots]
        return self.flat[spread(self.starts[slots], sizes)], sizes

    def encode_distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # a word ends too where two characters stand together in no piece
        apart = (owner[1:] != owner[:-1]) | ~_among(codes[:-1] * _CHARS + codes[1:], self.beside)[0]
        segment = np.concatenate(([0], np.cumsum(apart)))
        segment_owner = owner[np.concatenate(([True], apart))]
        symbols, segment = self._merge(self.symbol[codes], segment)
        ids, sizes = self._as_ids(symbols)
        return ids, np.bincount(segment_owner[segment], sizes, len(words)).astype(np.int64)

    def _as_ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each has: a character that is no piece becomes the pieces of its bytes."""
        sizes = np.ones(len(symbols), np.int64)
        foreign = np.flatnonzero(symbols >= self.size)
        if not len(foreign):
            return symbols, sizes
        raw = [chr(c).encode() for c in (symbols[foreign] - self.size).tolist()]
        sizes[foreign] = [len(r) for r in raw]
        ids = np.repeat(symbols, sizes)
        ids[spread((np.cumsum(sizes) - sizes)[foreign], sizes[foreign])] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, sizes

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; the greatest rank stands for no piece."""
        hit, at = _among(left * self.wide + right, self.keys)
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def _merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and segments after all merges; segments are in ascending order before and after."""
        done = []
        while len(sym):
            same = np.append(seg[1:] == seg[:-1], False)
            rank = np.full(len(sym), _NONE, np.int32)
            piece = np.zeros(len(sym), np.int64)
            at = np.flatnonzero(same)
            rank[at], piece[at] = self._ranked(sym[at], sym[at + 1])
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            sizes = np.diff(np.append(starts, len(seg)))
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == _NONE, sizes)
            if over.any():
                done.append((sym[over], seg[over]))
                stay = ~over
                sym, seg, rank, piece = sym[stay], seg[stay], rank[stay], piece[stay]
                sizes, least = sizes[least < _NONE], least[least < _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = self._ready(sym, seg, rank, piece, _alternate(at))
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seg = sym[keep], seg[keep]
        if not done:
            return sym, seg
        order = np.argsort(np.concatenate([s for _, s in done]), kind="stable")
        return np.concatenate([x for x, _ in done])[order], np.concatenate([s for _, s in done])[order]

    def _ready(self, sym, seg, rank, piece, at: np.ndarray) -> np.ndarray:
        """The occurrences that may merge at once: none behind one whose merge makes a pair that goes first and could reach it.

        Such a merge and what follows from it make one growing piece, so what
        it can reach lies within the longest piece, and so for the other one.
        """
        more = np.flatnonzero(seg[at[1:]] == seg[at[:-1]])
        if not len(more):
            return at
        made, own, n = piece[at], rank[at], len(sym)
        first = np.zeros(len(at), bool)
        right = np.flatnonzero((at + 2 < n) & (seg[np.minimum(at + 2, n - 1)] == seg[at]))
        first[right] = self._ranked(made[right], sym[at[right] + 2])[0] <= own[right]
        left = np.flatnonzero((at > 0) & (seg[at - 1] == seg[at]))
        touching = np.concatenate(([False], at[1:] - at[:-1] == 2))
        before = np.where(touching, np.roll(made, 1), sym[at - 1])
        first[left] |= self._ranked(before[left], made[left])[0] <= own[left]
        if not first.any():
            return at
        near = np.concatenate(([False], (seg[at[1:]] == seg[at[:-1]]) & (at[1:] - at[:-1] <= 2 * self.longest)))
        group = np.cumsum(~near)
        earlier = np.cumsum(first) - first
        group_start = np.flatnonzero(~near)
        return at[earlier == earlier[group_start][group - 1]]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of runs of ids: a mark in front goes, control ids are empty, bytes that are no UTF-8 become U+FFFD each."""
        sizes = self.surface_size[ids]
        begins = self.surface_start[ids].copy()
        spoken = np.flatnonzero(~self.control[ids])
        at = np.searchsorted(spoken, starts)
        firsts = spoken[at[:-1][at[:-1] < at[1:]]]
        firsts = firsts[self.leads[ids[firsts]]]
        sizes[firsts] -= 1
        begins[firsts] += 1
        raw = self.surface[spread(begins, sizes)].tobytes()
        # bytes on the two sides of a control id make no character together
        bounds = np.union1d(starts, np.flatnonzero(self.control[ids]))
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds].tolist()
        parts = [raw[a:b].decode("utf-8", "orrery_each_byte") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        of = np.searchsorted(bounds, starts).tolist()
        return ["".join(parts[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]


def _among(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the ordered ones, and where."""
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of pairs at these positions, the leftmost that do not overlap: every second of a run."""
    begins = np.concatenate(([True], at[1:] != at[:-1] + 1))
    first = at[begins][np.cumsum(begins) - 1]
    return at[(at - first) % 2 == 0]
