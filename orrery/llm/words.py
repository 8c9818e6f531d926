"""Words, word hashes and window hashes of whole texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words are runs of anything but the six ASCII space characters: what bytes.split() gives.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Distinct words whose hashes a task remembers before it starts anew.
WORD_CACHE = 200_000
_ODD_1 = np.uint64(0x9E3779B97F4A7C15)
_ODD_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text (a longer text stands alone)."""
    for batch in batches:
        sizes = text_bytes(batch.column(text))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches filled up to about so many bytes of text, across Arrow's batches."""
    held, size = [], 0
    for part in slices(batches, text, most_bytes):
        n = sum(text_bytes(part.column(text)))
        if held and size + n > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.concat_batches(held)


def text_bytes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, one after another, and where each text's words begin (and the end)."""
    parts, ends = [], [0]
    get = cache.__getitem__
    for t in texts:
        words = t.split()
        parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        ends.append(ends[-1] + len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(ends, np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int, odd: np.uint64 = _ODD_1) -> np.ndarray:
    """A hash of each window of so many consecutive hashes (across text ends too: the caller leaves those out)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= odd
        out += hashes[k : k + n]
    return mix(out)


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Another hash of each word, for keys of 128 bits."""
    return mix(hashes ^ _ODD_2)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def run_spans(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    starts = runs(sorted_keys).tolist()
    return zip(starts, [*starts[1:], len(sorted_keys)] if starts else [], strict=True)
