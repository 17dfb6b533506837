"""External induced sorting of suffixes with common-prefix values.

Suffixes whose first character is smaller than the next (S) or larger (L) are told apart; those S suffixes that
follow an L one (LMS) are ranked first: their substrings by one induction, the string of these substrings' names by
recursion, or in memory once it has at most `base` names. Then L suffixes are induced from LMS ones in ascending, and
S suffixes from L ones in descending order. Each induction runs on a priority queue of suffix tuples (position, common
prefix with the tuple before), keyed by first character and first-in-first-out within a key; it spills
to disk beyond `budget` bytes and hands out segments. Common prefixes are carried along: that of two tuples of one
key is one more than the least common prefix between those that induced them. They are capped at CAP.

Whatever is as long as the text (its types, runs, hashes, ranks, names, the recursion's string) is written in segments, and lies in
mapped files where it is larger than the budget. In memory are a segment at a time, the queue's budget, the `base` names, and one small
object for each key that has tuples waiting.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import Counter, defaultdict, deque

import numpy as np

from tidemark.llm.kernels import U, mix

CAP = 250
NONE = 255
SEGMENT = 1 << 20


class Space:
    """Arrays in memory up to `budget` bytes each, in mapped files beyond. The folder is the task's own, and what it holds can be made again."""

    def __init__(self, budget: int):
        self.budget, self.made = budget, 0
        self.folder: str | None = None

    def path(self) -> str:
        self.folder = self.folder or tempfile.mkdtemp(prefix="suffixes-")
        self.made += 1
        return os.path.join(self.folder, str(self.made))

    def zeros(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.budget:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None

    def __enter__(self) -> Space:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def blocks(n: int):
    """(first, end) of each segment of n."""
    return ((lo, min(n, lo + SEGMENT)) for lo in range(0, n, SEGMENT))


class TupleQueue:
    """A monotone priority queue of (position, prefix) tuples: first in, first out within a key; spills to disk, a file a spill."""

    def __init__(self, budget: int):
        self.budget, self.held = budget, 0
        self.memory: dict[int, deque] = defaultdict(deque)
        self.files: dict[int, deque] = defaultdict(deque)
        self.waiting: Counter = Counter()
        self.folder: str | None = None
        self.spilled = 0

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.memory[key].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.folder = self.folder or tempfile.mkdtemp(prefix="tuples-")
        name, at = os.path.join(self.folder, str(self.spilled)), 0
        with open(name, "wb") as f:
            for key, parts in self.memory.items():
                if parts:
                    pos, lcp = (np.concatenate(x) for x in zip(*parts))
                    f.write(pos.tobytes())
                    f.write(lcp.tobytes())
                    self.files[key].append((name, at, len(pos), pos.dtype, lcp.dtype, 0))
                    self.waiting[name] += 1
                    at += pos.nbytes + lcp.nbytes
        self.memory.clear()
        self.held = 0
        self.spilled += 1

    def _read(self, entry, first: int, m: int):
        name, at, n, kind, own, _ = entry
        with open(name, "rb") as f:
            f.seek(at + first * kind.itemsize)
            pos = np.frombuffer(f.read(m * kind.itemsize), kind)
            f.seek(at + n * kind.itemsize + first * own.itemsize)
            lcp = np.frombuffer(f.read(m * own.itemsize), own)
        return pos, lcp

    def _done(self, key: int, name: str) -> None:
        if not self.files[key]:
            del self.files[key]
        self.waiting[name] -= 1
        if not self.waiting[name]:
            os.remove(name)

    def pop(self, key: int):
        """The next segment of a key, or None."""
        if key in self.files:
            entry = self.files[key].popleft()
            name, at, n, kind, own, done = entry
            m = min(SEGMENT, n - done)
            found = self._read(entry, done, m)
            if done + m < n:
                self.files[key].appendleft((name, at, n, kind, own, done + m))
            else:
                self._done(key, name)
            return found
        return self._gathered(key, False)

    def _gathered(self, key: int, last: bool):
        """What is held of a key, up to a segment, as one."""
        parts, n = self.memory.get(key), 0
        if not parts:
            return None
        taken = []
        while parts and n < SEGMENT:
            taken.append(parts.pop() if last else parts.popleft())
            n += len(taken[-1][0])
        if not parts:
            del self.memory[key]
        if last:
            taken.reverse()
        pos, lcp = taken[0] if len(taken) == 1 else tuple(np.concatenate(x) for x in zip(*taken))
        self.held -= pos.nbytes + lcp.nbytes
        return pos, lcp

    def pop_last(self, key: int):
        """The segment pushed last, for reading a key backwards."""
        found = self._gathered(key, True)
        if found is None and key in self.files:
            name, at, n, kind, own, done = entry = self.files[key].pop()
            m = min(SEGMENT, n - done)  # here `done` counts from the end
            found = self._read(entry, n - done - m, m)
            if done + m < n:
                self.files[key].append((name, at, n, kind, own, done + m))
            else:
                self._done(key, name)
        return found

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class _Text:
    """A string of small integers that ends with a unique least one, with its types and runs."""

    def __init__(self, t: np.ndarray, space: Space):
        self.t, n = t, len(t)
        self.run, self.s = space.zeros(n, np.uint8), space.zeros(n, bool)
        self.run[n - 1], self.s[n - 1] = 1, True
        for hi in range(n - 1, 0, -SEGMENT):  # from the right: positions lo .. hi - 1, each beside its follower
            lo = max(0, hi - SEGMENT)
            part, at = t[lo : hi + 1], np.arange(hi - lo)
            stop = np.where(part[1:] != part[:-1], at, hi - lo)
            stop = np.minimum.accumulate(stop[::-1])[::-1]
            inside = stop < hi - lo
            length = np.where(inside, stop - at + 1, hi - lo - at + int(self.run[hi]))
            self.run[lo:hi] = np.minimum(length, CAP)
            up = np.append(part[1:] > part[:-1], self.s[hi])
            self.s[lo:hi] = up[stop]
        follows = lambda lo, hi: np.flatnonzero(self.s[lo + 1 : hi + 1] & ~self.s[lo:hi][: len(self.s[lo + 1 : hi + 1])]) + lo + 1
        self.lms = space.zeros(sum(len(follows(lo, hi)) for lo, hi in blocks(n)), np.int64)
        done = 0
        for lo, hi in blocks(n):
            found = follows(lo, hi)
            self.lms[done : done + len(found)] = found
            done += len(found)
        self.keys = max((int(t[lo:hi].max()) for lo, hi in blocks(n)), default=0) + 1


def _starts(x: _Text, order: np.ndarray) -> np.ndarray:
    """Where each key's LMS positions begin in their order."""
    counts = np.zeros(x.keys + 1, np.int64)
    for lo, hi in blocks(len(order)):
        keys, n = np.unique(x.t[order[lo:hi]], return_counts=True)
        counts[keys + 1] += n
    return np.cumsum(counts)


def _induce(x: _Text, order: np.ndarray, lcp: np.ndarray | None, budget: int):
    """Yield (positions, prefixes) of S suffixes and of L suffixes by key, keys descending, tuples descending within:
    each prefix is that with the tuple yielded before, 0 for a key's first. `order`: LMS positions, ascending."""
    t, kind = x.t, np.int32 if len(x.t) < 2**31 else np.int64
    carry = lcp is not None
    first = _starts(x, order)
    many = x.keys if carry else 0  # without prefixes, keys may be very many
    since, stamp, ever = np.full(many, NONE, np.uint8), np.full(many, -1, np.int64), np.zeros(many, bool)

    def feed(queue: TupleQueue, key: int, pos: np.ndarray, own: np.ndarray, want_s: bool) -> None:
        """Push what the tuples of a segment induce."""
        q = pos - 1
        ok = np.flatnonzero((pos > 0) & (x.s[q] == want_s))
        if len(ok):
            to = t[q[ok]]
            by = np.argsort(to, kind="stable")
            idx, to = ok[by], to[by]
            head = np.append(True, to[1:] != to[:-1])
            if carry:
                start = np.where(head, 0, np.append(0, idx[:-1] + 1))
                padded = np.append(own, np.uint8(NONE))
                least = np.minimum.reduceat(padded, np.stack([start, idx + 1], 1).ravel())[::2]
                known = stamp[to] == key
                least = np.where(head, np.minimum(least, since[to]), least)
                value = np.where(head & ~known, np.where(ever[to], 1, 0), np.minimum(least, CAP - 1).astype(np.int16) + 1).astype(np.uint8)
            else:
                value = np.zeros(len(idx), np.uint8)
        if carry:
            tail = np.append(np.minimum.accumulate(own[::-1])[::-1], np.uint8(NONE))
            np.minimum(since, tail[0], out=since)
        if len(ok):
            cut = np.append(np.flatnonzero(head), len(idx))
            targets = to[cut[:-1]]
            if carry:
                since[targets] = tail[idx[cut[1:] - 1] + 1]
                stamp[targets] = key
                ever[targets] = True
            moved = q[idx].astype(kind)
            for a, b, target in zip(cut[:-1].tolist(), cut[1:].tolist(), targets.tolist()):
                queue.push(target, moved[a:b], value[a:b])

    rising, done = TupleQueue(budget), TupleQueue(budget)
    falling = TupleQueue(budget)
    try:
        for key in range(x.keys):
            last = None
            while (seg := rising.pop(key)) is not None:
                pos, own = seg
                done.push(key, pos, own)
                feed(rising, key, pos, own, False)
                last = pos[-1]
            a, b = first[key], first[key + 1]
            for lo in range(a, b, SEGMENT):
                pos = order[lo : min(b, lo + SEGMENT)].astype(kind)
                own = np.array(lcp[lo : lo + len(pos)]) if carry else np.zeros(len(pos), np.uint8)
                if lo == a:
                    own[0] = 0 if last is None else min(x.run[last], x.run[pos[0]])
                feed(rising, key, pos, own, False)
        since[:], stamp[:], ever[:] = NONE, -1, False
        for key in range(x.keys - 1, -1, -1):
            last = None
            if key == 0:  # the end is the only suffix of the least key
                falling.push(0, np.array([len(t) - 1], kind), np.zeros(1, np.uint8))
            while (seg := falling.pop(key)) is not None:
                pos, own = seg
                feed(falling, key, pos, own, True)
                yield pos, own, True
                last = pos[-1]
            over = None  # prefix of the tuple before with this segment's greatest
            while (seg := done.pop_last(key)) is not None:
                pos, own = seg[0][::-1], np.empty(len(seg[0]), np.uint8)
                own[1:] = seg[1][:0:-1]
                own[0] = over if over is not None else (0 if last is None else min(x.run[last], x.run[pos[0]]))
                over = seg[1][0]
                feed(falling, key, pos, own, True)
                yield pos, own, False
    finally:
        for queue in (rising, done, falling):
            queue.close()


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names by prefix doubling in memory."""
    rank, n, step = names.astype(np.int64), len(names), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(0, np.cumsum(key[1:] != key[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def _powers(base: int, n: int):
    """A function for base**i modulo 2**64, i <= n, from two small tables."""
    bits = 16
    low = np.full(1 << bits, base, np.uint64)
    high = np.full((n >> bits) + 1, pow(base, 1 << bits, 1 << 64), np.uint64)
    low[0] = high[0] = 1
    with np.errstate(over="ignore"):
        low, high = np.multiply.accumulate(low), np.multiply.accumulate(high)

    def of(i: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return low[i & ((1 << bits) - 1)] * high[i >> bits]

    return of


def _hashes(t: np.ndarray, space: Space):
    base = 0x9E3779B97F4A7C15
    n = len(t)
    up, down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
    sums, total = space.zeros(n + 1, np.uint64), U(0)
    with np.errstate(over="ignore"):
        for lo, hi in blocks(n):
            part = np.cumsum(mix(t[lo:hi].astype(np.uint64) + U(1)) * up(np.arange(lo, hi))) + total
            sums[lo + 1 : hi + 1] = part
            total = part[-1]

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[b] - sums[a]) * down(a)

    return of


def _prefixes(of, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Common prefixes, up to CAP, of the suffixes at a and b, by doubling steps on hashes."""
    out = np.zeros(len(a), np.int64)
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        p, q = a + out, b + out
        fits = np.maximum(p, q) + step <= n
        p, q = np.where(fits, p, 0), np.where(fits, q, 0)
        out += step * (fits & (of(p, np.minimum(p + step, n)) == of(q, np.minimum(q + step, n))))
    return np.minimum(out, CAP).astype(np.uint8)


def _by_key(x: _Text, space: Space) -> np.ndarray:
    """LMS positions by their first character, dealt out segment by segment."""
    out = space.zeros(len(x.lms), np.int64)
    to = _starts(x, x.lms)
    for lo, hi in blocks(len(x.lms)):
        part = np.array(x.lms[lo:hi])
        key = x.t[part]
        by = np.argsort(key, kind="stable")
        keys, first, n = np.unique(key[by], return_index=True, return_counts=True)
        out[np.repeat(to[keys], n) + np.arange(len(by)) - np.repeat(first, n)] = part[by]
        to[keys] += n
    return out


def _lms_order(x: _Text, of, budget: int, base: int, space: Space) -> np.ndarray:
    """LMS positions in the order of their suffixes."""
    n, m = len(x.t), len(x.lms)
    if m < 2:
        return x.lms
    is_lms, index = space.zeros(n, bool), space.zeros(n, np.int64 if n >= 2**31 else np.int32)
    for lo, hi in blocks(m):
        is_lms[x.lms[lo:hi]] = True
        index[x.lms[lo:hi]] = np.arange(lo, hi)
    ranked, end = space.zeros(m, np.int64), m
    for pos, _, s in _induce(x, _by_key(x, space), None, budget):
        if s:
            own = pos[is_lms[pos]]
            ranked[end - len(own) : end] = own[::-1]
            end -= len(own)
    names, name, before = space.zeros(m + 1, np.int64), 0, None
    for lo, hi in blocks(m):
        at = index[ranked[lo:hi]]
        start = x.lms[at]
        stop = np.where(at + 1 < m, x.lms[np.minimum(at + 1, m - 1)] + 1, n)  # with the next one's first character
        mine = mix(of(start, stop)) ^ (stop - start).astype(np.uint64)
        new = np.append(before is not None and mine[0] != before, mine[1:] != mine[:-1])
        own = name + np.cumsum(new)
        names[at] = own + 1
        name, before = int(own[-1]), mine[-1]
    if name == m - 1:
        return ranked
    if m <= base:
        return x.lms[_doubled(np.array(names[:m]))]
    end = m  # the names end with a 0, which is the least suffix and no LMS
    for pos, _ in suffixes(names, budget, base, space, False):
        own = pos[pos < m]
        ranked[end - len(own) : end] = x.lms[own[::-1]]
        end -= len(own)
    return ranked


def suffixes(t: np.ndarray, budget: int = 64 << 20, base: int = 1 << 23, space: Space | None = None, carry: bool = True):
    """Yield (positions, prefixes), descending: all suffixes of t, whose last item is 0 and its only 0. A prefix is that
    with the suffix before, capped at CAP; 0 where the first item changes. Without `carry`, prefixes mean nothing."""
    with Space(budget) as own:
        space = own if space is None else space
        x = _Text(t, space)
        of = _hashes(t, space)
        order = _lms_order(x, of, budget, base, space)
        lcp = space.zeros(len(order), np.uint8) if carry else None
        for lo, hi in blocks(len(order) - 1) if carry else ():
            lcp[lo + 1 : hi + 1] = _prefixes(of, np.array(order[lo:hi]), np.array(order[lo + 1 : hi + 1]), len(t))
        for pos, own_lcp, _ in _induce(x, order, lcp, budget):
            yield pos, own_lcp
