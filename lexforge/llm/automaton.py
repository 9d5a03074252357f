"""Generalised suffix automaton over word ids, and its use on token batches.

The automaton accepts every substring of every pattern.  Streaming a text
through it gives, at each word, the longest suffix of the text so far that
occurs in some pattern (the matching statistic).  Patterns of at least
``window`` words are found by their windows, shorter ones whole; both are
looked up on the automaton's states, not by comparing texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from lexforge.llm.tokens import Tokens


class SuffixAutomaton:
    """Patterns are sequences of words (bytes); ``keys[i]`` names pattern i."""

    def __init__(self, patterns: Sequence[Sequence[bytes]], keys: Sequence, window: int):
        self.window = window
        vocab: dict[bytes, int] = {}
        seqs = [[vocab.setdefault(w, len(vocab)) for w in p] for p in patterns]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._name(seqs, keys)
        self._vocabulary(vocab)
        pairs = {(a, b) for s in seqs for a, b in zip(s, s[1:])}
        self.n_words = len(vocab)
        self.pairs = np.array(sorted(a * (self.n_words + 1) + b for a, b in pairs), dtype=np.int64)
        #: no pattern part shorter than this is ever reported
        self.least = min([window, *(len(s) for s in seqs if s)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _name(self, seqs, keys) -> None:
        """Names of the patterns whose windows (or whole) a state stands for."""
        k = self.window
        by_len = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        self.at_window = [0] * len(self.len)     # the state of the last k words
        for v in by_len:
            up = self.link[v]
            if self.len[v] >= k:
                self.at_window[v] = v if self.len[up] < k else self.at_window[up]
        self.names: dict[int, set] = {}
        short = set()
        for seq, key in zip(seqs, keys):
            v = 0
            for n, c in enumerate(seq, 1):
                v = self.next[v][c]
                if n >= k:
                    self.names.setdefault(self.at_window[v], set()).add(key)
            if 0 < len(seq) < k:
                self.names.setdefault(v, set()).add(key)
                short.add(v)
        self.short = [0] * len(self.len)         # nearest whole short pattern upwards
        for v in by_len:
            self.short[v] = v if v in short else self.short[self.link[v]]

    def _vocabulary(self, vocab: dict[bytes, int]) -> None:
        if not vocab:
            self.words, self.word_ids = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        from lexforge.llm.tokens import SPACE
        t = Tokens([b" ".join(vocab)], SPACE, False)
        order = np.argsort(t.hash)
        self.words, self.word_ids = t.hash[order], order.astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for a word that no pattern has."""
        if not len(self.words):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.word_ids[at], -1)

    def stream(self, ids) -> tuple[list[int], list[int]]:
        """State and longest matching length after each word id."""
        nxt, link, length = self.next, self.link, self.len
        v = n = 0
        states, lengths = [], []
        for c in ids:
            t = nxt[v].get(c)
            while t is None and v:
                v = link[v]
                n = length[v]
                t = nxt[v].get(c)
            if t is None:
                v = n = 0
            else:
                v, n = t, n + 1
            states.append(v)
            lengths.append(n)
        return states, lengths

    def runs(self, t: Tokens) -> list[tuple[int, int, np.ndarray]]:
        """Word ranges that can hold a match of ``least`` words, with their ids.

        Where two neighbouring words are no pair of any pattern the matching
        length falls to at most one word, so streaming may start anew there;
        ranges too short for any reported match are passed over.
        """
        ids = self.ids(t.hash)
        known = ids >= 0
        if not known.any():
            return []
        n = len(ids)
        joined = np.zeros(n, dtype=bool)      # word i goes on from word i - 1
        if n > 1 and len(self.pairs):
            code = ids[:-1] * (self.n_words + 1) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == code) & known[:-1] & known[1:] & (t.doc[:-1] == t.doc[1:])
        begin = np.flatnonzero(known & ~joined)
        # a run ends where the next word does not go on
        stop = np.flatnonzero(known & ~np.concatenate((joined[1:], [False]))) + 1
        keep = stop - begin >= self.least
        return [(int(a), int(b), ids[a:b]) for a, b in zip(begin[keep], stop[keep])]

    def hits(self, t: Tokens) -> list[tuple[int, int, set]]:
        """(first word, end word, pattern names) of every window or whole short pattern."""
        out, k = [], self.window
        for lo, _, ids in self.runs(t):
            states, lengths = self.stream(ids.tolist())
            for i, (v, n) in enumerate(zip(states, lengths)):
                if n >= k:
                    out.append((lo + i + 1 - k, lo + i + 1, self.names[self.at_window[v]]))
                s = self.short[v]
                while s:
                    if self.len[s] <= n:
                        out.append((lo + i + 1 - self.len[s], lo + i + 1, self.names[s]))
                    s = self.short[self.link[s]]
        return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted union of half-open word ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
