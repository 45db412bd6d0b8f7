"""A run-length index of phrases, and matching statistics streamed through it.

The phrases' Burrows-Wheeler transform is kept as runs; the suffix array is sampled at the first and
last row of each run. A text is streamed from its end: while the row's run has the next byte, the match grows by
a step of the last-to-first mapping; else it goes on from the end of the run of that byte before, or the start of
the one after, whichever suffix (known by its sample) shares more with what is matched, byte by byte. All texts are
streamed side by side, so a step is a handful of array operations. Matches don't cross the ends of phrases.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a suffix that the first sort compares, 9 bits each (bytes from 1; 0: a phrase's end).
FIRST = 7


def joined(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all phrases, each followed by one zero byte; the phrases' starts and lengths."""
    lens = np.array([len(p) for p in phrases], np.int64)
    raw = np.frombuffer(b"\0".join([*phrases, b""]), np.uint8)
    return raw, np.concatenate(([0], (lens + 1).cumsum()[:-1])), lens


def words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every place, without a copy for each."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))


def common_prefix(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of pairs of places, at most ``most``."""
    out = np.zeros(len(most), np.int64)
    open_ = np.nonzero(most > 0)[0]
    while len(open_):
        x = a[at_a[open_] + out[open_]] ^ b[at_b[open_] + out[open_]]
        with np.errstate(over="ignore"):
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3  # 8 if x is 0
        out[open_] += same
        open_ = open_[(same == 8) & (out[open_] < most[open_])]
    return np.minimum(out, most)


class Index:
    """The run-length index of ``phrases`` (in the order of their places in the corpus)."""

    def __init__(self, phrases: list[bytes]) -> None:
        self.raw, self.starts, self.lens = joined(phrases)
        self.words = words(self.raw)
        self.ends = np.repeat(self.starts + self.lens, self.lens + 1)
        sym = self.raw.astype(np.int64) + 1
        sym[self.starts + self.lens] = 0
        sa = self._sorted(sym)
        before = np.roll(sym, 1)
        before[self.starts] = 0
        self._runs(before[sa], sa, np.bincount(sym, minlength=257))

    def _sorted(self, sym: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling; only suffixes that are still tied are sorted again. Equal ones stand by place."""
        n = len(sym)
        at = np.arange(n)
        key = np.zeros(n, np.int64)
        padded = np.concatenate((sym, np.zeros(FIRST, np.int64)))
        for k in range(FIRST):
            key = key << 9 | np.where(at + k <= self.ends, padded[k : k + n], 0)
        sa = np.argsort(key)
        slots, members, key = at, sa, key[sa]
        rank = np.empty(n, np.int64)
        self.halves: np.ndarray | None = None
        depth, longest = FIRST, int(self.lens.max(initial=0)) + 1
        while True:
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[members] = np.maximum.accumulate(np.where(new, slots, 0))  # a suffix's rank: the first slot of its equals
            tied = ~new | np.concatenate((~new[1:], [False]))
            slots, members = slots[tied], members[tied]
            if depth == HALF or self.halves is None and not len(members):
                self.halves = rank.copy()
            if not len(members) or depth >= longest and depth >= HALF:
                break
            after = members + depth
            key = rank[members] << 32 | np.where(after <= self.ends[members], rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key)
            members, key = members[order], key[order]
            sa[slots] = members
            depth *= 2
        if len(members):
            sa[slots] = members[np.argsort(rank[members] << 32 | members)]
        return sa

    def _runs(self, bwt: np.ndarray, sa: np.ndarray, counts: np.ndarray) -> None:
        new = np.concatenate(([True], bwt[1:] != bwt[:-1]))
        self.start = np.nonzero(new)[0]
        self.end = np.append(self.start[1:], len(bwt)) - 1
        head = bwt[self.start]
        self.first_sample, self.last_sample = sa[self.start], sa[self.end]
        self.by = np.argsort(head, kind="stable")
        size = self.end - self.start + 1
        occurrences = np.empty(len(head), np.int64)
        occurrences[self.by] = size[self.by].cumsum() - size[self.by]
        below = np.concatenate(([0], counts.cumsum()[:-1]))  # rows of smaller symbols
        in_bwt = np.bincount(head, size, 257).astype(np.int64)
        earlier = np.concatenate(([0], in_bwt.cumsum()[:-1]))
        self.shift = below[head] + occurrences - earlier[head] - self.start  # last to first: row + shift
        self.head, self.keys = head, head[self.by] * len(head) + self.by

    def repeated(self, group: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
        """For each of the first ``counts`` places of every phrase: whether its ``length`` bytes stand at an earlier place too.

        Only phrases of one ``group`` are compared. Two halves of ranks that overlap say whether windows are equal.
        """
        out = np.zeros(int(counts.sum()), bool)
        several = np.repeat(np.bincount(group)[group] > 1, counts)
        if several.any():
            at = (np.repeat(self.starts - (counts.cumsum() - counts), counts) + np.arange(len(out)))[several]
            key = self.halves[at] << 32 | self.halves[at + length - HALF]
            order = np.argsort(key, kind="stable")
            out[np.nonzero(several)[0][order[1:]]] = key[order[1:]] == key[order[:-1]]
        return out

    def stream(self, phrases: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
        """For each of the first ``counts`` places of every phrase: whether ``length`` bytes from there stand in the index.

        Matching statistics from the end; a phrase leaves when no match that reaches its first places can be long enough.
        """
        raw, starts, lens = joined(phrases)
        text, n_runs = words(raw), len(self.start)
        sym = raw.astype(np.int64) + 1
        out, first = np.zeros(int(counts.sum()), bool), counts.cumsum() - counts
        who, at, match, row = np.arange(len(phrases)), lens - 1, np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        while len(who):
            place = starts[who] + at
            c = sym[place]
            run = np.searchsorted(self.start, row, "right") - 1
            want = c * n_runs + run
            k = np.searchsorted(self.keys, want, "right") - 1
            on = (k >= 0) & (self.keys[np.maximum(k, 0)] == want)
            match = match + 1
            off = np.nonzero(~on)[0]
            if len(off):
                before, after = k[off], k[off] + 1
                run_b, run_a = self.by[np.maximum(before, 0)], self.by[np.minimum(after, n_runs - 1)]
                can_b, can_a = (before >= 0) & (self.head[run_b] == c[off]), (after < n_runs) & (self.head[run_a] == c[off])
                had, next_ = match[off] - 1, place[off] + 1
                shared = []
                for can, sample in ((can_b, self.last_sample[run_b]), (can_a, self.first_sample[run_a])):
                    most = np.where(can, np.minimum(had, self.ends[sample] - sample), 0)
                    shared.append(np.where(can, common_prefix(self.words, sample, text, next_, most), -1))
                use = shared[1] > shared[0]
                best = np.where(use, shared[1], shared[0])
                run[off] = np.where(use, run_a, run_b)
                row[off] = np.where(use, self.start[run_a], self.end[run_b])
                match[off] = best + 1
            row = row + self.shift[run]
            row[match == 0] = 0
            hit = (match >= length) & (at < counts[who])
            out[first[who[hit]] + at[hit]] = True
            at = at - 1
            stay = (at >= 0) & ((at + 1 >= length) | (match + at + 1 >= length))
            if not stay.all():
                who, at, match, row = who[stay], at[stay], match[stay], row[stay]
        return out


#: Depth at which ranks are kept to compare windows of up to twice as many bytes.
HALF = FIRST << 3
