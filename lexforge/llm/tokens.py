"""Vectorised tokenising of whole texts, as UTF-8 bytes, inside Arrow batches.

Both word rules of this package decide byte by byte: every byte of a non-ASCII
character belongs to a word, so ``[^\\x20\\x09-\\x0D]+`` and
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing A-Z) need no
decoding.  Words are 64-bit hashes of their bytes (a random table entry per
byte in a polynomial modulo 2**64, then a finaliser); n-grams hash the word
hashes.  Texts are handled in chunks of a few MB, long texts whole but hashed
piece by piece, so memory follows the chunk, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = int(_rng.integers(1, 2**62)) * 8 + 5
_R_INV = pow(_R, -1, 2**64)
_Q = (_rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))

SPACE = np.ones(256, dtype=bool)             # words between ASCII white space
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)            # ASCII letters and digits, all non-ASCII
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

PIECE = 1 << 18      # bytes hashed at once
CHUNK = 1 << 21      # bytes of text tokenised at once
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """An independent 64-bit hash of 64-bit hashes."""
    return mix(x * _Q[40 + salt] + _Q[50 + salt])


class Tokens:
    """Words of consecutive texts: byte spans, hashes and text numbers."""

    def __init__(self, blobs: Sequence[bytes | None], word: np.ndarray, lower: bool):
        parts = [b or b"" for b in blobs]
        raw = b"\n".join(parts) + b"\n"
        buf = np.frombuffer(raw, dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        inside = np.concatenate(([False], word[buf]))   # "\n" ends the last word
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        n_bytes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
        self.text_at = np.concatenate(([0], np.cumsum(n_bytes + 1)))   # byte offset of each text
        self.first = np.searchsorted(self.start, self.text_at)   # first word of each text
        self.n_texts = len(parts)
        self.doc = np.repeat(np.arange(self.n_texts), np.diff(self.first))
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self._hashed(self.end)
        return self._hash

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word, as if they were a word; shorter words whole."""
        return self._hashed(np.minimum(self.start + n, self.end))

    def _hashed(self, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to ``end``."""
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            base = self.start[i]
            j = max(int(np.searchsorted(self.end, base + PIECE, "right")), i + 1)
            seg = self.buf[base:self.end[j - 1]]
            acc = np.zeros(len(seg) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[seg] * _powers(_R, len(seg))[:len(seg)], out=acc[1:])
            s, e = self.start[i:j] - base, end[i:j] - base
            out[i:j] = mix((acc[e] - acc[s]) * _powers(_R_INV, len(seg) + 1)[s])
            i = j
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each place, places where all k are in one text)."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = self.hash
        acc = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            acc += h[j:j + n] * _Q[j]
        return mix(acc), np.flatnonzero(self.doc[:n] == self.doc[k - 1:])

    def words(self, lo: int, hi: int) -> list[bytes]:
        raw = self.buf
        return [raw[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi])]


def text_hash(word: bytes) -> int:
    """The hash of one word of letters and digits."""
    return int(Tokens([word], ALNUM, True).hash[0])


def chunks(blobs: Sequence[bytes | None], word: np.ndarray, lower: bool,
           max_bytes: int = CHUNK, max_texts: int = 1 << 30) -> Iterator[tuple[int, int, Tokens]]:
    """(from, to, tokens) over a batch of texts, a few MB at a time."""
    lo, size = 0, 0
    for i, b in enumerate(blobs):
        n = len(b) + 1 if b else 1
        if i > lo and (size + n > max_bytes or i - lo >= max_texts):
            yield lo, i, Tokens(blobs[lo:i], word, lower)
            lo, size = i, 0
        size += n
    if lo < len(blobs):
        yield lo, len(blobs), Tokens(blobs[lo:], word, lower)


def distinct_grams(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: (hashes, offsets), sorted within a text.

    A text of fewer than k words, but not none, has one shingle, the whole
    sequence; a text without words has none.
    """
    g, at = t.grams(k)
    doc, h = t.doc[at], g[at]
    n_words = np.diff(t.first)
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        lo, hi = t.first[d], t.first[d + 1]
        whole = mix((t.hash[lo:hi] * _Q[:hi - lo]).sum(dtype=np.uint64).reshape(1))
        doc, h = np.concatenate((doc, [d])), np.concatenate((h, whole))
    if len(doc) and (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    off = np.searchsorted(doc, np.arange(t.n_texts + 1))
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
        h[lo:hi].sort()
    if len(h):
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(t.n_texts + 1))
