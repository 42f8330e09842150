"""Numpy helpers that tokenise and hash a whole Arrow batch of texts at once.

They run inside ``mapInArrow`` tasks. A batch's UTF-8 bytes are handled in slices of
about ``SLICE`` bytes that end between words, so memory doesn't depend on how long a
text is (only one single word longer than a slice would widen its slice).

Words are separated by ASCII bytes only, so working on bytes gives the same words as
working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
#: A chunk of texts that is handled together has about so many bytes.
CHUNK = 1 << 22
_B = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


def table(chars: bytes) -> np.ndarray:
    """A 256-entry mask that is True for the given bytes."""
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


#: Separators of ``[^\x20\x09-\x0D]+``.
BLANK = table(b" \t\n\x0b\x0c\r")
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: ASCII but digits and a-z.
NOT_ALNUM = table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    both = []
    for base in (_B, pow(_B, -1, 1 << 64)):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        both.append(np.cumprod(a, dtype=np.uint64))
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(at):
        at = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that each part has about ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def run_hashes(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, start + size) of some numbers; runs may be taken anywhere."""
    power, inverse = _powers(1 << max(16, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64) * np.uint64(_B))


class Words:
    """All words of some texts: ``hash`` (64 bits), ``start`` and ``end`` (bytes), ``doc`` (index of the text)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK, lower: bool = True):
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[offsets] = True
        found: list[tuple[np.ndarray, ...]] = []
        a = 0
        while a < len(raw):
            b = min(a + SLICE, len(raw))
            while b < len(raw):  # a slice ends before a separator or at a text's end
                stop = np.flatnonzero(separators[LOWER[raw[b : b + 4096]] if lower else raw[b : b + 4096]] | first[b : b + 4096][: len(raw) - b])
                if len(stop):
                    b += int(stop[0])
                    break
                b = min(b + 4096, len(raw))
            found.append(self._slice(a, b, first, separators, lower))
            a = b
        self.start, self.end, self.hash = (np.concatenate(x) if found else np.zeros(0, dtype=t) for x, t in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.int64, np.uint64), strict=True))
        #: Of the first word of each text, and one more at the end.
        self.at = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def _slice(self, a: int, b: int, first: np.ndarray, separators: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
        part = self.raw[a:b]
        if lower:
            part = LOWER[part]
        word = ~separators[part]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | first[a + 1 : b]
        ends[:-1] &= ~word[1:] | first[a + 1 : b]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        n = 1 << max(SLICE, b - a).bit_length() if b - a > SLICE else SLICE
        power, inverse = _powers(n)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s]
        return s + a, e + a, mix(h + (e - s).astype(np.uint64) * np.uint64(_B))

    def code_points(self) -> np.ndarray:
        """Of all words of each text."""
        sums = np.concatenate([[0], np.cumsum(LEADS[self.raw])])
        return np.bincount(self.doc, weights=sums[self.end] - sums[self.start], minlength=self.n).astype(np.int64)


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k word hashes; order matters."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + hashes[j : len(hashes) - k + 1 + j])
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of one text; with fewer words the whole sequence is one."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(windows(hashes, min(k, len(hashes))))
