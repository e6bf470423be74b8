"""Run-length index of a small repetitive byte collection (numpy).

The suffix array of the texts, each closed by a separator of its own, gives
the Burrows-Wheeler transform.  Only at the ends of its runs is anything
sampled: the text position and the length of the match across the border.
Inside a run the match length of position j is that of j - 1, less one, so a
single pass over the text from the samples streams the matching statistics of
every position against all other positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MOST_TEXTS = 65_000


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each text); text i ends with the separator 256 + i."""
    if len(texts) > MOST_TEXTS:
        raise ValueError(f"at most {MOST_TEXTS} texts fit one index")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    out = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16)
    out[starts[1:] - 1] = np.arange(256, 256 + len(texts))
    return out, starts[:-1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling from four symbols on; all suffixes differ, as the separators do."""
    n = len(s)
    wide = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.uint64)
    key = (wide[:n] << np.uint64(48)) | (wide[1 : n + 1] << np.uint64(32)) | (wide[2 : n + 2] << np.uint64(16)) | wide[3 : n + 3]
    h = 4
    while True:
        order = np.argsort(key)
        by = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], by[1:] != by[:-1]])).astype(np.uint64)
        if rank[order[-1]] == n:
            return order
        key = rank << np.uint64(32)
        key[: n - h] |= rank[h:]
        h *= 2


def common(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a[i] and b[i]."""
    n, out, at, step = len(s), np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(at):
        span = np.arange(step)
        x, y = a[at] + out[at], b[at] + out[at]
        same = s[np.minimum(x[:, None] + span, n - 1)] == s[np.minimum(y[:, None] + span, n - 1)]
        same &= (np.maximum(x, y)[:, None] + span) < n
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        out[at] += run
        at = at[run == step]
        step = min(step * 2, 64)
    return out


@dataclass
class RunIndex:
    """head/tail: sampled (text position, match length across the run border)."""

    symbols: np.ndarray
    starts: np.ndarray
    runs: int
    head: tuple[np.ndarray, np.ndarray]
    tail: tuple[np.ndarray, np.ndarray]

    @classmethod
    def build(cls, texts: list[bytes]) -> RunIndex:
        s, starts = joined(texts)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        border = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        above, below = sa[border - 1], sa[border]
        length = common(s, above, below)
        zero = np.zeros(1, np.int64)
        # The first suffix has none above it and the last none below it: they match nothing there.
        head = (np.concatenate([below, sa[:1]]), np.concatenate([length, zero]))
        tail = (np.concatenate([above, sa[-1:]]), np.concatenate([length, zero]))
        return cls(s, starts, len(border) + 1, head, tail)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of each position's suffix with one that starts elsewhere."""
        n = len(self.symbols)
        place = np.arange(n)

        def streamed(samples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
            reach = np.zeros(n, np.int64)
            reach[samples[0]] = samples[0] + samples[1]
            return np.maximum.accumulate(reach) - place

        return np.maximum(np.maximum(streamed(self.head), streamed(self.tail)), 0)
