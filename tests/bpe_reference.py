"""Plain-Python, one-merge-at-a-time BPE trainer used only as a test oracle."""

from __future__ import annotations


def train_sequential(words: dict[tuple[int, ...], int], pieces: list[str], *, n_merges=None,
                     vocab_size=None, min_frequency=0):
    pieces = list(pieces)
    pid = {p: i for i, p in enumerate(pieces)}
    words = {tuple(k): v for k, v in words.items()}
    merges = []
    while True:
        if n_merges is not None and len(merges) >= n_merges:
            break
        if vocab_size is not None and len(pieces) >= vocab_size:
            break
        counts = {}
        for w, f in words.items():
            for x in range(len(w) - 1):
                counts[(w[x], w[x + 1])] = counts.get((w[x], w[x + 1]), 0) + f
        if not counts:
            break
        (a, b), n = min(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        if n < max(min_frequency, 1):
            break
        s = pieces[a] + pieces[b]
        if s in pid:
            m = pid[s]
        else:
            m = len(pieces)
            pieces.append(s)
            pid[s] = m
        merges.append((a, b, m, n))
        nw = {}
        for w, f in words.items():
            out, x = [], 0
            while x < len(w):
                if x + 1 < len(w) and w[x] == a and w[x + 1] == b:
                    out.append(m)
                    x += 2
                else:
                    out.append(w[x])
                    x += 1
            nw[tuple(out)] = nw.get(tuple(out), 0) + f
        words = nw
    return merges, pieces
