"""External induced sorting: suffixes and common prefixes by induction through disk-backed priority queues.

A suffix is L if it is larger than the next one, else S; an S suffix after an L one is S*. Given the S* suffixes in order, one
ascending pass induces all L suffixes and one descending pass all S suffixes: the passes take suffixes from a queue whose
keys are first characters (within a key, in the order of arrival) and put each one's predecessor back into it. A queue entry is the tuple
(position, common prefix with the entry before it under the same key); the common prefix of two predecessors is one more than the least
common prefix on the way between the two. The order of the S* suffixes comes from the recursion: a first induction sorts the S* substrings,
equal ones get equal names, and the string of names (a half as long at most) is sorted by doubling, up to `cap` characters.

A queue keeps each key's entries as chunks; over its memory budget it writes chunks to a file of the task's temporary
folder and reads them back one by one, so neither pass needs the entries in memory. Text and types may be memory-mapped arrays.
Prefixes over `cap` count as `cap`, and the order of suffixes that share that many characters is arbitrary.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
#: Pairs whose common prefixes are searched together.
BLOCK = 1 << 14
_NONE = np.int32(2**31 - 1)


class Queue:
    """Priority queue with keys 0 to n - 1 and first-in first-out order within a key; `budget` bytes stay in memory."""

    def __init__(self, keys: int, budget: int):
        self.chunks: list[list] = [[] for _ in range(keys)]
        self.budget, self.used, self.file, self.kind = budget, 0, None, np.dtype(np.int64)

    def put(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.kind, size = pos.dtype, pos.nbytes + lcp.nbytes
        if self.used + size <= self.budget:
            self.used += size
            self.chunks[key].append((pos, lcp))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        at = self.file.seek(0, 2)
        self.file.write(pos.tobytes())
        self.file.write(lcp.tobytes())
        self.chunks[key].append((at, len(pos)))

    def _load(self, chunk: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(chunk[0], np.ndarray):
            return chunk
        at, n = chunk
        self.file.seek(at)
        wide = self.kind.itemsize
        data = self.file.read((wide + 4) * n)
        return np.frombuffer(data, self.kind, n), np.frombuffer(data, np.int32, n, wide * n)

    def _join(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        if len(chunks) == 1:
            return self._load(chunks[0])
        pos, lcp = zip(*map(self._load, chunks), strict=True)
        return np.concatenate(pos), np.concatenate(lcp)

    def take(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is under the key, including what arrives there meanwhile, about CHUNK entries at a time."""
        i = 0
        while i < len(found := self.chunks[key]):
            end, size = i, 0
            while end < len(found) and size < CHUNK:
                size += len(found[end][0]) if isinstance(found[end][0], np.ndarray) else found[end][1]
                end += 1
            yield self._join(found[i:end])
            i = end

    def backwards(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts from the last to the first, entries reversed, each with its common prefix with the entry after it (0 for the last)."""
        after, found = np.int32(0), self.chunks[key]
        end = len(found)
        while end:
            i, size = end, 0
            while i and size < CHUNK:
                i -= 1
                size += len(found[i][0]) if isinstance(found[i][0], np.ndarray) else found[i][1]
            pos, lcp = self._join(found[i:end])
            yield pos[::-1], np.concatenate([[after], lcp[:0:-1]]).astype(np.int32)
            after, end = lcp[0], i


def types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S, and the length of the run of equal characters at its start."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    at = np.flatnonzero(step).astype(np.int32 if n < 1 << 31 else np.int64)
    size = np.diff(at, prepend=-1)
    run = np.repeat(at, size)
    run -= np.arange(-1, n - 1, dtype=run.dtype)
    return np.repeat(step[at] > 0, size), run.astype(np.int32, copy=False)


class _Feed:
    """Puts predecessors into a queue and knows the least common prefix since each key's last entry."""

    def __init__(self, queue: Queue, text: np.ndarray, is_s: np.ndarray, keys: int, want_s: bool, cap: int):
        self.queue, self.text, self.is_s, self.want_s, self.cap = queue, text, is_s, want_s, cap
        self.least = np.full(keys, 0, np.int32)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        prev = pos - 1
        ok = (pos > 0) & (self.is_s[prev] == self.want_s)
        where = np.flatnonzero(ok)
        if not len(where):
            np.minimum(self.least, lcp.min(), out=self.least)
            return
        key = self.text[prev[where]]
        order = np.argsort(key, kind="stable")
        where, key = where[order], key[order].astype(np.int64)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        start = np.empty(len(where), np.int64)
        start[1:] = where[:-1] + 1
        start[new] = 0
        padded = np.append(lcp, _NONE)
        ends = np.empty(2 * len(where), np.int64)
        ends[0::2], ends[1::2] = start, where + 1
        least = np.minimum.reduceat(padded, ends)[0::2]
        keys = key[new]
        least[new] = np.minimum(least[new], self.least[keys])
        made = np.minimum(least + 1, self.cap).astype(np.int32)
        stop = np.append(new[1:], len(where))
        np.minimum(self.least, lcp.min(), out=self.least)
        last = where[stop - 1] + 1
        tail = np.minimum.reduceat(padded, np.stack([last, np.full(len(last), len(padded) - 1)], axis=1).ravel())[0::2]
        self.least[keys] = np.where(last < len(lcp), tail, _NONE)
        prev = prev[where]
        for k, a, b in zip(keys.tolist(), new.tolist(), stop.tolist(), strict=True):
            self.queue.put(k, prev[a:b], made[a:b])


def induce(text: np.ndarray, is_s: np.ndarray, run: np.ndarray, star: np.ndarray, star_lcp: np.ndarray, cap: int, budget: int, with_l: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All S suffixes and, if asked, all L ones, from the largest to the smallest, given the S* ones in order: positions,
    common prefix with the suffix that came just before (the next larger one), and whether they are S."""
    keys = int(text.max()) + 1
    up = Queue(keys, budget // 2)
    feed = _Feed(up, text, is_s, keys, False, cap)
    cut = np.searchsorted(text[star], np.arange(keys + 1))
    for c in range(keys):
        first, low = True, 0
        for pos, lcp in up.take(c):
            if first:
                lcp = np.concatenate([np.zeros(1, np.int32), lcp[1:]])
            first, low = False, run[pos[-1]]
            feed.scan(pos, lcp)
        for a in range(cut[c], cut[c + 1], CHUNK):
            b = min(a + CHUNK, cut[c + 1])
            lcp = star_lcp[a:b].copy()
            if a == cut[c]:
                lcp[0] = 0 if first else min(low, run[star[a]])
            feed.scan(star[a:b], lcp)
    down = Queue(keys, budget // 2)
    feed = _Feed(down, text, is_s, keys, True, cap)
    for c in range(keys - 1, -1, -1):
        first, low = True, 0
        for pos, lcp in down.take(c):
            if first:
                lcp = np.concatenate([np.zeros(1, np.int32), lcp[1:]])
            first, low = False, run[pos[-1]]
            feed.scan(pos, lcp)
            yield pos, lcp, True
        down.chunks[c] = []
        if c == 0:  # no suffix follows the last one, so none induces it; it is the smallest
            yield np.array([len(text) - 1], star.dtype), np.array([0 if first else 1], np.int32), True
            first, low = False, 1
        join = True
        for pos, lcp in up.backwards(c):
            if join:
                lcp[0] = 0 if first else min(low, run[pos[0]], cap)
                join = False
            feed.scan(pos, lcp)
            if with_l:
                yield pos, lcp, False
        up.chunks[c] = []


def _hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from cloakframe.llm.shingles import powers

    power, inverse = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return total, inverse


def common_prefix(total: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The common prefix of suffixes a[i] and b[i], up to cap, by binary search over hashes of substrings; in blocks that the processor's cache holds."""
    n, out = len(total) - 1, np.empty(len(a), np.int32)
    for at in range(0, len(a), BLOCK):
        i, j = a[at : at + BLOCK].astype(np.int64), b[at : at + BLOCK].astype(np.int64)
        x, y = inverse[i], inverse[j]
        gap = total[i] * x - total[j] * y
        found = np.zeros(len(i), np.int64)
        most = np.minimum(cap, n - np.maximum(i, j))
        bit = 1 << (int(cap).bit_length() - 1)
        while bit:
            k = np.minimum(found + bit, most)
            same = total[i + k] * x - total[j + k] * y == gap
            found += np.where(same, k - found, 0)
            bit >>= 1
        out[at : at + BLOCK] = found
    return out


def _order(high: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """The order of pairs of numbers from -1 to most (at most 2^31), equal ones in any order."""
    return np.argsort((high + 1) * np.int64(most + 2) + (low + 1))


def sorted_by_doubling(names: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """The order of the suffixes of a string of names; two that agree over `cap` characters (at: where names start) may stand in any order."""
    n = len(names)
    order = np.argsort(names)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(np.diff(names[order], prepend=-1))
    size = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, size)
    live, k = order[np.repeat(size > 1, size)], 1
    far = np.append(at, [at[-1] + cap + 1])
    while len(live):
        ahead = np.minimum(live + k, n)
        near = far[ahead] - at[live] < cap
        live, ahead = live[near], ahead[near]
        if not len(live):
            break
        own, nxt = rank[live], rank[ahead]
        by = _order(own, nxt, n)
        live, own, nxt = live[by], own[by], nxt[by]
        group = np.diff(own, prepend=-2) != 0
        fresh = group | (np.diff(nxt, prepend=-2) != 0)
        first = np.flatnonzero(group)
        place = np.arange(len(live)) - np.repeat(first, np.diff(np.append(first, len(live))))
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(live)))
        # those of a group that are left out here (they agree over cap) keep the group's rank; that is as good as any
        rank[live] = own + np.repeat(place[head], size)
        live, k = live[np.repeat(size > 1, size)], 2 * k
    return np.argsort(rank[:n])


def suffixes(text: np.ndarray, cap: int, budget: int = 1 << 28) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text (its last character is 0, which ends each part; no part is empty) from the largest to the smallest: positions, and common prefixes with the one before."""
    is_s, run = types(text)
    run = np.minimum(run, cap).astype(np.int32)
    star = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32 if len(text) < 1 << 31 else np.int64)
    if len(star):
        seeds = star[np.argsort(text[star], kind="stable")]
        is_star = np.zeros(len(text), bool)
        is_star[star] = True
        by_substring = np.concatenate([p[is_star[p]] for p, _, s in induce(text, is_s, run, seeds, np.zeros(len(seeds), np.int32), 1, budget, False)])[::-1]
        total, inverse = _hashes(text)
        index = np.empty(len(text), star.dtype)
        index[star] = np.arange(len(star), dtype=star.dtype)
        stop = np.append(star[1:] + 1, len(text)).astype(np.int64)  # a substring ends with the next S* character
        size = (stop - star)[index[by_substring]]
        whole = (total[by_substring + size] - total[by_substring]) * inverse[by_substring]
        other = (np.diff(size, prepend=-1) != 0) | np.concatenate([[True], whole[1:] != whole[:-1]])
        names = np.empty(len(star), np.int64)
        names[index[by_substring]] = np.cumsum(other) - 1
        star = star[sorted_by_doubling(names, star, cap)]
        lcp = np.zeros(len(star), np.int32)
        lcp[1:] = common_prefix(total, inverse, star[:-1], star[1:], cap)
    else:
        lcp = np.zeros(0, np.int32)
    for pos, common, _ in induce(text, is_s, run, star, lcp, cap, budget, True):
        yield pos, common


def repeated(text: np.ndarray, weight: np.ndarray, valid: np.ndarray, length: int, budget: int = 1 << 28) -> np.ndarray:
    """Whether the `length` characters from each position on also start elsewhere: positions where valid is false count as none, others by weight."""
    out = np.zeros(len(text), bool)
    held: list[np.ndarray] = []  # of a class that isn't over yet

    def close() -> None:
        if held:
            p = np.concatenate(held)
            held.clear()
            if weight[p].sum() > 1:
                out[p] = True

    for pos, lcp in suffixes(text, length, budget):
        edge = np.flatnonzero(lcp < length)  # where a class begins
        if not len(edge):
            held.append(pos)
            continue
        held.append(pos[: edge[0]])
        close()
        whole = pos[edge[0] : edge[-1]]
        if len(whole):
            at = edge[:-1] - edge[0]
            many = np.add.reduceat(weight[whole], at) > 1
            out[whole[np.repeat(many, np.diff(np.append(at, len(whole))))]] = True
        held.append(pos[edge[-1] :])
    close()
    return out & valid
