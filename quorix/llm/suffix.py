"""Suffix-array dedup: bytes of strings that also start elsewhere, by external induced sorting of shards.

Which shard a string belongs to is settled by its content: its designated place is
the least hash among its ``GRAM``-byte pieces, so equal strings have the same piece
there, and strings that share a designated piece are one group. Consecutive starts
with one designated place are a region. Only groups of two regions or more can hold
a repeat; equal regions of a group are counted before the shuffle and their text is
sent once. A shard cuts the regions of its groups into narrow ones, drops those whose
common core no other has, and sorts the suffixes of the rest:

A group of more than ``HOT`` distinct regions isn't sent to one shard: its regions are
cut into narrow ones before the shuffle, equal ones are counted, lone ones dropped, and
the narrow regions are groups of their own; one of those with more than ``HOT`` distinct
texts is cut once more, into single strings, of which equal ones are counted.

Induced sorting: the starred suffixes are named by their substrings and sorted by
recursion where names repeat; queues in the order of (first symbol, rank of the rest)
then induce all others, first the L suffixes upwards, then the S suffixes downwards.
Tuples carry the rank of the suffix they come from; the common prefix of two
neighbours is one more than the least one between their sources, so the common-prefix
values are carried through induction and recursion along with the order.

Text, order, common prefixes, queue runs and all other arrays of more than ``IN_MEMORY``
entries are in files that are memory-mapped; they are made, merged and read in blocks,
and more starred suffixes than that are named by an induction of their own. So what is
in memory at once has a bound, however long the text is.

A start is repeated where a neighbour in the suffix array shares ``length`` bytes with
it, or where its region or narrow region stands more than once (by 64-bit hash). Every
byte covered by a repeated string goes, all occurrences included.

Defined results: null and empty texts, and texts shorter than the string, lose nothing;
rows equal in id and text are two occurrences and are cut alike; nulls in ids are fine;
an empty table gives no rows. The text that is left drops the bytes of a character that
was cut in two.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm.common import CHUNK, Spans, chunks, drop, mix, stored, table, texts_of

LENGTH, GRAM, NARROW = 400, 160, 24
SHARD_BYTES = 2 << 20
#: Distinct regions of a group that go to one shard.
HOT = 2000
#: Longer runs and arrays are in files, and read in blocks.
IN_MEMORY, BLOCK = 1 << 22, 1 << 18
FAR = np.iinfo(np.int64).max


def room(n: int, kind=np.int64) -> np.ndarray:
    """An array of zeros, in a file that is gone with it if it is long."""
    if n <= IN_MEMORY:
        return np.zeros(n, kind)
    fd, path = tempfile.mkstemp()
    os.close(fd)
    try:
        return np.memmap(path, kind, "w+", shape=(n,))
    finally:
        os.unlink(path)


def blocks(n: int) -> list[tuple[int, int]]:
    """All of a short array, or blocks of a long one."""
    step = max(1, n if n <= IN_MEMORY else BLOCK)
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def merge_runs(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct keys and their places as one."""
    n = len(a) + len(b)
    if n <= IN_MEMORY:
        keys = np.concatenate([a, b])
        order = keys.argsort(kind="stable")
        return keys[order], np.concatenate([p, q])[order]
    keys, places = room(n), room(n)
    i = j = done = 0
    step = BLOCK
    while done < n:
        x, y = a[i : i + step], b[j : j + step]
        # Up to the end of the block that ends first, all is there.
        most = min([z[-1] for z, at, whole in ((x, i, a), (y, j, b)) if at + step < len(whole)], default=FAR)
        u, v = int(np.searchsorted(x, most, "right")), int(np.searchsorted(y, most, "right"))
        both = np.concatenate([x[:u], y[:v]])
        order = np.argsort(both, kind="stable")
        keys[done : done + u + v] = both[order]
        places[done : done + u + v] = np.concatenate([p[i : i + u], q[j : j + v]])[order]
        i, j, done = i + u, j + v, done + u + v
    return keys, places


class Queue:
    """A priority queue of (key, place) for batches: sorted runs, merged when a run is less than twice the next."""

    def __init__(self):
        self.runs: list[list] = []  # keys, places, cursor

    def push(self, keys: np.ndarray, places: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        self.put(keys[order], places[order])

    def put(self, keys: np.ndarray, places: np.ndarray) -> None:
        """A run that is sorted."""
        self.runs.append([keys, places, 0])
        while len(self.runs) > 1 and len(self.runs[-2][0]) - self.runs[-2][2] < 2 * (len(self.runs[-1][0]) - self.runs[-1][2]):
            (a, p, i), (b, q, j) = self.runs.pop(), self.runs.pop()
            self.runs.append([*merge_runs(a[i:], p[i:], b[j:], q[j:]), 0])

    def peek(self, most: int):
        """Up to ``most`` least items in order, and the run of each."""
        if len(self.runs) == 1:
            keys, places, at = self.runs[0]
            return (keys := keys[at : at + most]), places[at : at + most], np.zeros(len(keys), np.int64)
        heads = [(r[0][r[2] : r[2] + most], r[1][r[2] : r[2] + most]) for r in self.runs]
        keys = np.concatenate([h[0] for h in heads]) if heads else np.zeros(0, np.int64)
        order = keys.argsort(kind="stable")[:most]
        places = np.concatenate([h[1] for h in heads]) if heads else keys
        run = np.arange(len(heads)).repeat([len(h[0]) for h in heads])
        return keys[order], places[order], run[order]

    def all(self):
        """Batches of all (key, place) in order; the queue is empty then."""
        while self.runs:
            keys, places, runs = self.peek(BLOCK)
            self.take(runs)
            yield keys, places

    def take(self, runs: np.ndarray) -> None:
        if len(self.runs) == 1:
            self.runs[0][2] += len(runs)
            if self.runs[0][2] == len(self.runs[0][0]):
                self.runs = []
            return
        for r, n in zip(self.runs, np.bincount(runs, minlength=len(self.runs))):
            r[2] += int(n)
        self.runs = [r for r in self.runs if r[2] < len(r[0])]


class Minima:
    """Least values of ranges of an array that grows."""

    WIDTH = 32

    def __init__(self, n: int):
        w = self.WIDTH
        blocks = n // w + 2
        self.n = 0
        self.value, self.before, self.after = (room(blocks * w) for _ in range(3))
        self.value[:] = FAR
        deep = max(1, int(blocks).bit_length())
        self.level = room(deep * blocks).reshape(deep, blocks)

    def append(self, x: np.ndarray) -> None:
        w, old = self.WIDTH, self.n
        self.n += len(x)
        self.value[old : self.n] = x
        a, b = old // w, -(-self.n // w)
        part = self.value[a * w : b * w].reshape(-1, w)
        self.before[a * w : b * w] = np.minimum.accumulate(part, 1).ravel()
        self.after[a * w : b * w] = np.minimum.accumulate(part[:, ::-1], 1)[:, ::-1].ravel()
        c = self.n // w
        if c > a:
            self.level[0, a:c] = self.before[a * w + w - 1 : c * w : w]
            for k in range(1, len(self.level)):
                reach = 1 << k - 1
                if reach >= c:  # of no block there are so many before it
                    break
                i = max(a, reach)
                self.level[k, i:c] = np.minimum(self.level[k - 1, i:c], self.level[k - 1, i - reach : c - reach])

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of places a to b, both included."""
        w = self.WIDTH
        x, y = a // w, b // w
        out = np.minimum(self.after[a], self.before[b])
        gap = y - x - 1
        wide = (gap > 0).nonzero()[0]
        if len(wide):
            gap = gap[wide]
            k = np.frexp(gap.astype(np.float64))[1].astype(np.int64) - 1
            last = y[wide] - 1
            out[wide] = np.minimum(out[wide], np.minimum(self.level[k, last], self.level[k, last - gap + (1 << k)]))
        same = (x == y).nonzero()[0]
        if len(same):
            at = a[same, None] + np.arange(w)
            out[same] = np.where(at <= b[same, None], self.value[np.minimum(at, self.n - 1)], FAR).min(1)
        return out


def induce(text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, run: np.ndarray, top: int, cap: int, down: bool):
    """Seeds and the suffixes that they induce, in order, with common prefixes of neighbours, and which are seeds.

    wanted: whether each suffix is of the type that is induced; down: from the largest.
    Keys are (symbol, induced before seeds, rank).
    """
    n = len(text)
    symbol = (lambda p: top - text[p]) if down else (lambda p: text[p])
    total = len(seeds) + int(wanted.sum())
    order, common, seeded = room(total), Minima(total), room(total, bool)
    queue, keys = Queue(), room(len(seeds))
    for a, b in blocks(len(seeds)):  # in the order of their symbols
        keys[a:b] = (symbol(seeds[a:b]).astype(np.int64) << 33) | (1 << 32) | np.arange(a, b)
    if len(seeds):
        queue.put(keys, seeds)
    done, size, last_p, last_key, last_r = 0, 256, -1, -1, -1
    while queue.runs:
        keys, p, runs = queue.peek(size)
        before = np.maximum(p - 1, 0)
        makes = wanted[before]
        makes &= p > 0
        made = np.where(makes, symbol(before), FAR >> 33)
        # What an item makes comes after the items of its symbol that are induced already, but before seeds and larger symbols.
        least = np.minimum.accumulate(made)
        high = keys >> 32
        c, seed = high >> 1, (high & 1).astype(bool)
        # With the seed's bit, as c > least or c = least and seed.
        bad = high[1:] > 2 * least[:-1]
        cut = int(bad.argmax()) + 1 if bad.any() else len(keys)
        size = min(2 * size, 1 << 16, max(64, BLOCK)) if cut == len(keys) else max(64, 2 * cut)
        keys, p, makes, made, c, seed = keys[:cut], p[:cut], makes[:cut], made[:cut], c[:cut], seed[:cut]
        queue.take(runs[:cut])
        rank = keys & 0xFFFFFFFF
        prev_p, prev_key, prev_r = (np.empty(cut, np.int64) for _ in range(3))
        for to, x, first in ((prev_p, p, last_p), (prev_key, keys, last_key), (prev_r, rank, last_r)):
            to[0], to[1:] = first, x[:-1]
        share = np.zeros(cut, np.int64)
        # 0 where the one before has this symbol and both are induced, 1 where only that is, 2 where both are seeds.
        kind = np.where(c == prev_key >> 33, seed + ((prev_key >> 32) & 1), 3)
        both = (kind == 0).nonzero()[0]
        if len(both):
            share[both] = 1 + common.least(prev_r[both] + 1, rank[both])
        if len(both) < cut:
            seam = (kind == 1).nonzero()[0]
            share[seam] = np.minimum(run[p[seam]], run[prev_p[seam]])
            start = (kind == 2).nonzero()[0]
            share[start] = seed_common[rank[start]]
        order[done : done + cut] = p
        seeded[done : done + cut] = seed
        common.append(np.minimum(share, cap))
        at = makes.nonzero()[0]
        queue.push((made[at].astype(np.int64) << 33) | (done + at), p[at] - 1)
        last_p, last_key, last_r = int(p[-1]), int(keys[-1]), int(rank[-1])
        done += cut
    assert done == total and n
    return order, common.value[:done], seeded


def extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray, cap) -> np.ndarray:
    """Common prefixes of suffix pairs that share so much at least, symbol by symbol, up to cap."""
    share, cap = share.copy(), np.broadcast_to(cap, share.shape)
    live = np.flatnonzero(share < cap)
    n = len(text)
    while len(live):
        x, y = a[live] + share[live], b[live] + share[live]
        good = (x < n) & (y < n)
        good[good] = text[x[good]] == text[y[good]]
        live = live[good]
        share[live] += 1
        live = live[share[live] < cap[live]]
    return np.minimum(share, cap)


def types_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How long the run of equal symbols from each suffix on is, and whether the suffix is S (the run goes up); from the end."""
    n = len(text)
    run, small = room(n), room(n, bool)
    for a, b in reversed(blocks(n)):
        x = np.asarray(text[a:b])
        after = np.append(x[1:], text[b] if b < n else FAR)
        new = x != after
        last = np.flatnonzero(new)
        at = np.append(0, np.cumsum(new[:-1]))
        inside = int(last[-1]) + 1 if len(last) else 0
        stop = last[at[:inside]]
        run[a : a + inside] = stop + 1 - np.arange(inside)
        small[a : a + inside] = after[stop] > x[stop]
        if a + inside < b:
            run[a + inside : b] = run[b] + np.arange(b - a - inside, 0, -1)
            small[a + inside : b] = small[b]
    return run, small


def collected(n: int, find) -> np.ndarray:
    """What find(a, b) gives for all blocks of n places, one after the other."""
    out, done = room(sum(len(find(a, b)) for a, b in blocks(n))), 0
    for a, b in blocks(n):
        part = find(a, b)
        out[done : done + len(part)] = part
        done += len(part)
    return out


def named_in_memory(text: np.ndarray, small: np.ndarray, starred: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rank of each starred substring, of equal ones the same: groups split symbol by symbol in order."""
    n, m = len(text), len(starred)
    name = np.zeros(m, np.int64)
    live, depth = np.arange(m), 0
    while len(live):
        at = starred[live] + depth
        key = np.where(at <= ends[live], text[np.minimum(at, n - 1)].astype(np.int64) * 2 + small[np.minimum(at, n - 1)] + 1, 0)
        by = np.lexsort((key, name[live]))
        live, key = live[by], key[by]
        group = name[live]
        first = np.append(True, group[1:] != group[:-1])
        new = first | np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        head = np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))
        name[live] = group + np.repeat(start, np.diff(np.append(start, len(live)))) - head
        size = np.repeat(np.diff(np.append(start, len(live))), np.diff(np.append(start, len(live))))
        live = live[(size > 1) & (starred[live] + depth < ends[live])]
        depth += 1
    _, found = np.unique(name, return_inverse=True)
    return found


def named_by_induction(text: np.ndarray, small: np.ndarray, starred: np.ndarray, ends: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The same: starred suffixes in the order of their first symbols induce the order of the starred substrings."""
    m, queue = len(starred), Queue()
    for a, b in blocks(m):
        queue.push((text[starred[a:b]].astype(np.int64) << 40) | np.arange(a, b), starred[a:b])
    seeds, done = room(m), 0
    for _, places in queue.all():
        seeds[done : done + len(places)] = places
        done += len(places)
    order, _ = induced(text, small, seeds, room(m), run, 1)
    place = lambda x: np.searchsorted(starred, x)
    star = lambda x: starred[np.minimum(place(x), m - 1)] == x
    ranked = collected(len(order), lambda a, b: (x := order[a:b])[star(x)])
    name, last, rank = room(m), -1, -1
    for a, b in blocks(m):
        now = ranked[a:b]
        before = np.append(last if a else now[0], now[:-1])
        x, y = place(now), place(before)
        size = ends[x] - now
        same = size == ends[y] - before
        same[same] = extend(text, now[same], before[same], np.zeros(int(same.sum()), np.int64), size[same] + 1) > size[same]
        if not a:
            same[0] = False
        ranks = rank + np.cumsum(~same)
        name[x] = ranks
        last, rank = int(now[-1]), int(ranks[-1])
    return name


def induced(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, run: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, with common prefixes, from the starred ones in order."""
    n = len(text)
    wanted = room(n, bool)
    for a, b in blocks(n):
        wanted[a:b] = ~small[a:b]
    up, up_common, seeded = induce(text, wanted, seeds, seed_common, run, 0, cap, False)
    large = collected(len(up), lambda a, b: np.flatnonzero(~seeded[a:b]) + a)
    # Neighbouring L suffixes of one symbol are neighbours in the upward order too.
    size = len(large)
    places, down_common, most = room(size), room(size), 0
    for a, b in blocks(size):
        at = large[a:b]
        places[size - b : size - a] = up[at][::-1]
        shares = up_common[at]
        # The share with the one before, of the one that comes next from the other end.
        down_common[size - b + 1 : size - a + 1] = shares[::-1] if a else shares[1:][::-1]
    for a, b in blocks(n):
        wanted[a:b] = small[a:b]
        most = max(most, int(text[a:b].max()))
    wanted[n - 1] = False
    down, common, _ = induce(text, wanted, places, down_common, run, most, cap, True)
    array, prefix = room(n), room(n)
    array[0] = n - 1
    for a, b in blocks(n - 1):
        array[n - b : n - a] = down[a:b][::-1]
        first = max(a, 1)
        prefix[n + 1 - b : n + 1 - first] = common[first:b][::-1]
    return array, prefix


def sort_suffixes(text: np.ndarray, cap: int = FAR >> 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes (up to cap) of each suffix with the one before; text ends with its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    run, small = types_of(text)
    starred = collected(n, lambda a, b: np.flatnonzero(small[a:b] & ~np.append(True if not a else small[a - 1], small[a : b - 1])) + a)
    m = len(starred)
    ends = room(m)
    for a, b in blocks(m):
        ends[a:b] = np.append(starred[a + 1 : b], starred[b] if b < m else n - 1)
    name = named_in_memory(text, small, starred, ends) if m <= IN_MEMORY else named_by_induction(text, small, starred, ends, run)
    order, known = room(m), room(m)
    if max(int(name[a:b].max()) for a, b in blocks(m)) == m - 1:
        for a, b in blocks(m):
            order[name[a:b]] = np.arange(a, b)
    else:
        order, names = sort_suffixes(name)
        for a, b in blocks(m):
            known[a:b] = starred[np.minimum(order[a:b] + names[a:b], m - 1)] - starred[order[a:b]]
        known[0] = 0
    seeds, seed_common = room(m), room(m)
    for a, b in blocks(m):
        seeds[a:b] = starred[order[a:b]]
    for a, b in blocks(m):
        first = max(a, 1)
        seed_common[first:b] = extend(text, seeds[first - 1 : b - 1], seeds[first:b], known[first:b], cap)
    return induced(text, small, seeds, seed_common, run, cap)


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the starts of strings of that length that also start elsewhere in any segment."""
    sizes = np.array([len(s) for s in segments], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum()) + 1
    text = room(n, np.int32)
    for at, part in zip(begin.tolist(), segments):
        text[at : at + len(part)] = np.frombuffer(part, np.uint8)
        text[at : at + len(part)] += 2
        text[at + len(part)] = 1
    array, prefix = sort_suffixes(text, length)
    again = room(n, bool)
    for a, b in blocks(n):
        hit = (prefix[a:b] >= length) | (np.append(prefix[a + 1 : b], prefix[b] if b < n else 0) >= length)
        again[array[a:b][hit]] = True
    found = collected(n, lambda a, b: np.flatnonzero(again[a:b]) + a)
    owner = np.searchsorted(begin, found, "right") - 1
    inside = found - begin[owner]
    good = inside + length <= sizes[owner]
    owner, inside = owner[good], inside[good]
    cut = np.searchsorted(owner, np.arange(len(segments) + 1))
    return [inside[a:b] for a, b in zip(cut, cut[1:])]


def regions(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(group, content, row, first start, last start, designated place) of each region; places are in the data."""
    spans, n = Spans(data), len(data) - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    at = np.arange(n)
    x = spans.hash(at, at + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    least = ((x >> bits) << bits) | at.astype(np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(least))
    row = np.searchsorted(offsets, start, "right") - 1
    good = start + length <= offsets[row + 1]
    start, place, row = start[good], place[good], row[good]
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
    a = place[first]
    content = mix(spans.hash(lo, hi + length) + (a - lo).astype(np.uint64))
    return x[a], content, row[first], lo, hi, a


def cores(text: bytes, at: int, length: int, width: int):
    """(first start, last start, offset of the place from the core, core) of each narrow region of a region."""
    last = len(text) - length
    for j in range(max(0, at - last) // width, at // width + 1):
        core = at - width * j
        s1, s2 = max(0, core - width + 1), min(core, last)
        if s1 <= s2:
            yield s1, s2, j, text[core : core - width + 1 + length]


def narrow_marks(rows: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """Repeated starts, as ranges within each region, of the distinct regions (group, text, offset of the designated place) of a shard.

    Strings of one narrow region have a core in common; where no other region of the
    group has that core there, none of them repeats. Equal narrow regions are sorted once.
    """
    pieces: dict[tuple, list[int]] = {}
    spans: list[list[tuple[int, int, int]]] = []
    for k, (group, text, at) in enumerate(rows):
        mine = [(s1, s2, hash((group, j, core))) for s1, s2, j, core in cores(text, at, length, NARROW)]
        for _, _, key in mine:
            pieces[key] = pieces.get(key, 0) + 1
        spans.append(mine[::-1])
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    segments: dict[bytes, list[tuple[int, int, int]]] = {}
    for k, mine in enumerate(spans):
        # Narrow regions that follow each other and may repeat are sorted as one string.
        open_ = None
        for s1, s2, key in [*mine, (-1, -1, None)]:
            if key is not None and pieces[key] > 1:
                open_ = (open_[0] if open_ else s1, s2)
            elif open_:
                segments.setdefault(rows[k][1][open_[0] : open_[1] + length], []).append((k, *open_))
                open_ = None
    texts = list(segments)
    if texts:
        for text, starts in zip(texts, repeated_starts(texts, length)):
            owners = segments[text]
            for k, s1, s2 in owners:
                if len(owners) > 1:
                    out[k].append((s1, s2))
                elif len(starts):
                    cut = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + 1))
                    out[k] += [(s1 + int(a), s1 + int(b)) for a, b in zip(starts[cut], starts[np.append(cut[1:], len(starts)) - 1])]
    return out


_KEY = "xxhash64(id, text, length(text))"


def covered(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(dk, spans): where repeated strings start, as [first, last] pairs, for each document that has any."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(F.expr(_KEY).alias("dk"), "text")

    def run(batches):
        for batch in chunks(batches, most=CHUNK):
            data, offsets = texts_of(batch)
            group, content, row, lo, hi, at = regions(data, offsets, length, gram)
            # One number for where a region is: first start, further starts, offset of the designated place.
            packed = ((lo - offsets[row]) << 24) | ((hi - lo) << 12) | (at - lo)
            dk = batch.column(0).to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (group.view(np.int64), content.view(np.int64), dk, packed)], ["g", "c", "dk", "pk"])

    if length - gram >= 1 << 12:
        raise ValueError("the piece is too short for the string")
    every = stored(rows.mapInArrow(run, "g long, c long, dk long, pk long"), "regions")
    # Most groups have one region, which repeats nothing: they go first.
    many = stored(every.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select(F.col("g").alias("mg")), "regionmany")
    found = stored(every.join(many.hint("merge"), every.g == many.mg, "left_semi"), "regionsleft")
    drop(every, many)
    # Of each content the number and one place; of each group how many contents.
    kinds = stored(found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("dk").alias("rk"), F.min_by("pk", "dk").alias("pk")), "regionkinds")
    mixed = stored(kinds.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select(F.col("g").alias("mg"), (F.col("m") > HOT).alias("hot")), "regionmixed")
    lo, wide, at = F.shiftright("pk", 24), F.shiftright("pk", 12).bitwiseAND(F.lit(4095)), F.col("pk").bitwiseAND(F.lit(4095))
    sent = kinds.join(mixed.hint("merge"), kinds.g == mixed.mg).select("rk", F.struct("g", "hot", lo.alias("lo"), (lo + wide).alias("hi"), at.alias("at"), (F.col("n") > 1).alias("all")).alias("x"))
    per = stored(sent.groupBy("rk").agg(F.collect_list("x").alias("xs")), "regionsent")
    once = rows.join(per.hint("merge"), rows.dk == per.rk).dropDuplicates(["dk"]).select("dk", "text", "xs")
    cut = stored(once.mapInArrow(_cut(length), f"hot boolean, {_PART}"), "regiontext")
    drop(per, mixed)
    texts, marked = cut.where("not hot").drop("hot"), []
    if not (hot := cut.where("hot").drop("hot")).isEmpty():
        for width in (NARROW, 1):
            hot, few, equal = split(hot, length, width)
            texts, marked = texts.unionByName(few), [*marked, equal]
    size = texts.agg(F.sum(F.length("part") + 1)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    marks = stored(texts.repartitionById(shards, F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")).mapInArrow(_sort(length), "dk long, a int, b int"), "regionmarks")
    drop(cut)
    often = kinds.where("n > 1").select(F.col("g").alias("og"), F.col("c").alias("oc"))
    whole = found.join(often.hint("merge"), (found.g == F.col("og")) & (found.c == F.col("oc")), "left_semi").select("dk", lo.cast("int").alias("a"), (lo + wide).cast("int").alias("b"))
    for equal in marked:
        whole = whole.unionByName(equal)
    spans = whole.unionByName(marks).groupBy("dk").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    out = stored(spans, "regionspans")
    drop(found, kinds, marks)
    return out


def split(regions: DataFrame, length: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The regions (g, dk, lo, at, whole, part) of hot groups as narrow ones: those of groups that are hot still, those of the others, and (dk, a, b) of what is equal.

    A narrow region whose core no other has goes. Of equal ones the least stands for all.
    """
    every = stored(regions.mapInArrow(_narrow(length, width), f"c long, {_PART}"), "narrow")
    order = F.struct("dk", "lo", "at", "whole")
    kinds = stored(every.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(order).alias("x"), F.first("part").alias("part")), "narrowkinds")
    sizes = kinds.groupBy(F.col("g").alias("sg")).agg(F.count("*").alias("m")).where("m > 1")
    left = kinds.join(stored(sizes, "narrowsizes").hint("merge"), F.col("g") == F.col("sg")).select("g", "x.dk", "x.lo", "x.at", (F.col("x.whole") | (F.col("n") > 1)).alias("whole"), "part", "m")
    often = stored(kinds.where("n > 1").select(F.col("g").alias("og"), F.col("c").alias("oc")), "narrowoften")
    equal = every.where("not whole").join(often.hint("merge"), (F.col("g") == F.col("og")) & (F.col("c") == F.col("oc")), "left_semi")
    equal = equal.select("dk", F.col("lo").alias("a"), (F.col("lo") + F.length("part") - length).alias("b"))
    return left.where(F.col("m") > HOT).drop("m"), left.where(F.col("m") <= HOT).drop("m"), equal


_PART = "g long, dk long, lo int, at int, whole boolean, part binary"


def _narrow(length: int, width: int):
    def run(batches):
        for batch in chunks(batches, "part", CHUNK // 4):
            out: list[list] = [[] for _ in range(7)]
            for g, dk, lo, at, whole, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for s1, s2, j, core in cores(part, at, length, width):
                    text = part[s1 : s2 + length]
                    group = xxhash.xxh64_intdigest(core, (g + j * 0x9E3779B97F4A7C15) % (1 << 64))
                    for c, v in zip(out, (xxhash.xxh64_intdigest(text, (group + at - s1) % (1 << 64)), group, dk, lo + s1, at - s1, whole, text)):
                        c.append(v)
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([*signed, *(pa.array(c, t) for c, t in zip(out[2:], kinds))], ["c", "g", "dk", "lo", "at", "whole", "part"])

    return run


def _cut(length: int):
    def run(batches):
        for batch in chunks(batches, most=CHUNK):
            out: list[list] = [[] for _ in range(7)]
            for dk, text, xs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                for x in xs:
                    for c, v in zip(out, (x["hot"], x["g"], dk, x["lo"], x["at"], x["all"], raw[x["lo"] : x["hi"] + length])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], ["hot", "g", "dk", "lo", "at", "whole", "part"])

    return run


def _sort(length: int):
    def run(batches):
        rows, where = [], []
        for batch in batches:
            for g, dk, lo, at, whole, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                rows.append((g, part, at))
                where.append((dk, lo, whole))
        out: list[tuple] = []
        for (dk, lo, whole), marks in zip(where, narrow_marks(rows, length)):
            if not whole:  # else all its occurrences are marked as they are counted
                out += [(dk, lo + a, lo + b) for a, b in marks]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["dk", "a", "b"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, rest: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 of each row; rest: also the text that stays."""
    text = F.coalesce(text_col, F.lit(""))
    clean = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    spans = covered(clean, "id", "text", length, gram).select(F.col("dk").alias("sk"), "spans")
    rows = clean.withColumn("dk", F.expr(_KEY))
    joined = rows.join(spans.hint("merge"), rows.dk == spans.sk, "left").select("id", "text", "spans")
    kind = joined.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches, most=CHUNK):
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, kept, at, n = text.encode(), [], 0, 0
                end = -1
                for x in found or ():
                    a, b = x["a"], x["b"] + length
                    if a > end:
                        n += 1
                        if end >= 0:
                            at = end
                        kept.append(raw[at:a])
                    end = max(end, b)
                kept.append(raw[end:] if end >= 0 else raw)
                left = b"".join(kept)
                for c, v in zip(out, (len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if rest else None)):
                    c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(arrays if rest else arrays[:4])], names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if rest else [])]
    made = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if rest else ""))
    return made.withColumnRenamed("id", id_col)


def op6_suffix(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), rest=True)


QUERIES = {"op6_suffix": op6_suffix}
