"""Repeated passages by compact windows over min-hashes.

A document is its sequence of shingles of ``SHINGLE`` words. For each of several
hash functions a Cartesian tree over the hashed shingles, cut where a range is shorter
than the least passage, gives the compact windows: (l, c, r) says that the minimum of
every stretch between l and r that holds c is at c. Stretches of the least length are
thereby grouped: those that start between two neighbouring breaks of the windows of a
signature's ``HASHES`` functions have one signature, the tuple of their minima, and are
kept as one interval. There are ``SIGNATURES`` signatures, each of functions of its own;
intervals of different documents that agree in any of them are candidates. Such pairs are verified on the shingles themselves (similarity of at least ``percent``),
at every start near the anchor of both intervals, and followed along their diagonal as far as the similarity holds.

Documents with equal texts are one. Signatures that two texts share are joined with the
texts' intervals; of a signature's group the first text is the hub, and a text's
intervals go to the units of its hubs, each unit cut into blocks by bytes. A text's
shingles are made once, in a scan, and only the stretches around its intervals are sent.
In a block an interval is dropped where too few of its shingles occur in any other text
of the block for the similarity to be possible. What is left is verified against the hub;
what the hub does not explain meets all other texts of its signature, in the block and,
for units of several blocks, in a second pass over pairs of blocks. Two texts are compared
once for all signatures they share, not at all where all of that is verified already. A block hands on each
text's merged spans and a spanning forest of links: rows grow with texts, never with
pairs. Exact repeats of ``min_words`` words are always found; a stretch at the very
threshold agrees in no signature with probability (1 - 0.8**2)**4 = 0.017.

Defined results: null texts and texts under ``min_words`` words have no passages.
Repeats inside one document alone are not counted; of a passage that another document
has too, every place is in the spans, and in the first document's ``cut_spans`` none.
Rows that repeat an id with its text share a class, and ``cut_passages`` cuts by text, so
rows with null or repeated ids are each cut as their text is; one row of equal texts stays
whole, that with the smallest row number of the scan. Ids are integers. Only documents with a passage
that another has too are returned; an empty table returns none. ``class_id`` is the smallest id connected
through passages, null only where all ids of the class are.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BESIDE_TEXTS, BROADCAST_BYTES, Scratch, left_join_sized, quoted, table, trimmed
from .near_dedup import _mixed, components, portions, sequences, sorted_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SIGNATURES, HASHES, MIN_WORDS, PERCENT = 5, 4, 2, 50, 80
#: Texts, and shingles, of a block; in pairs of blocks, twice as many texts of either.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
_SEEDS = _mixed(np.arange(1, SIGNATURES * HASHES + 1, dtype=np.uint64) * np.uint64(0x243F6A8885A308D3))


def compact_windows(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, position of the minimum) of each compact window of at least ``least`` values.

    Starts of all stretches of ``least`` values, in order, are split among the windows.
    """
    found, ranges = [], [(0, len(values))]
    while ranges:
        lo, hi = ranges.pop()
        if hi - lo >= least:
            c = lo + int(values[lo:hi].argmin())
            found.append((max(lo, c - least + 1), c))
            ranges.append((lo, c))
            ranges.append((c + 1, hi))
    found.sort()
    both = np.array(found, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def sliding_minima(values: np.ndarray, least: int) -> np.ndarray:
    """The minimum of every stretch of ``least`` values; what ``compact_windows`` finds, for many texts in a row."""
    low, wide = values, 1
    while wide < least:
        step = min(wide, least - wide)
        low, wide = np.minimum(low[step:], low[:-step]), wide + step
    return low


def signature_intervals(seqs: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """(number of the sequence, signature, first start, last start, anchor) of the intervals of stretches of each of the sequences.

    Each of ``SIGNATURES`` signatures has ``HASHES`` functions of its own.
    """
    sizes = np.array([len(s) for s in seqs], dtype=np.int64)
    whole = np.concatenate([*seqs, np.zeros(0, dtype=np.uint64)])
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(seqs)), sizes)[: max(0, len(whole) - least + 1)]
    starts = np.flatnonzero(np.arange(len(of)) + least <= (begin + sizes)[of])  # stretches inside one text
    parts = []
    for n in range(SIGNATURES if len(starts) else 0):
        key, new = np.full(len(starts), n + 1, dtype=np.uint64), np.append(True, of[starts[1:]] != of[starts[:-1]])
        for k, seed in enumerate(_SEEDS[n * HASHES : (n + 1) * HASHES]):
            values = _mixed(whole ^ seed)
            low = sliding_minima(values, least)[starts]
            new[1:] |= low[1:] != low[:-1]  # the same shingle again, a place further on, goes on
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + low)
            if not k:
                of_anchor, minima = values, low
        i = np.flatnonzero(new)
        if len(starts) > LONGEST:  # no interval is longer than can be packed
            i = np.union1d(i, np.arange(0, len(starts), LONGEST))
        j = np.append(i[1:], len(starts)) - 1
        text = of[starts[i]]
        within = np.lib.stride_tricks.sliding_window_view(of_anchor, least)
        anchor = np.concatenate([starts[x] + (within[starts[x]] == minima[x][:, None]).argmax(axis=1) for x in np.array_split(i, len(i) // 8192 + 1)])
        parts.append((text, key[i].view(np.int64), starts[i] - begin[text], starts[j] - begin[text], anchor - begin[text]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))


def alike(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[int]:
    """Offsets at which the stretches of ``least`` shingles of both, as sets, have the similarity."""
    a, b = a.tolist(), b.tolist()
    left, right = Counter(a[:least]), Counter(b[:least])
    shared = len(left.keys() & right.keys())
    found = []
    for k in range(min(len(a), len(b)) - least + 1):
        if k:
            for mine, its, gone, new in ((left, right, a[k - 1], a[k - 1 + least]), (right, left, b[k - 1], b[k - 1 + least])):
                if new not in mine:
                    shared += new in its
                    mine[new] = 0
                mine[new] += 1
                mine[gone] -= 1
                if not mine[gone]:
                    del mine[gone]
                    shared -= gone in its
        if 100 * shared >= percent * (len(left) + len(right) - shared):
            found.append(k)
    return found


FIRST, LONGEST = 36, (1 << 20) - 1


def packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Intervals as one integer each: first, last - first (up to LONGEST), anchor - first."""
    return (first << FIRST) | ((last - first) << 16) | (anchor - first)


#: Marks a place of a text that its unit's hub did not explain.
OPEN = 1 << 62


def unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = (places & ~OPEN) >> FIRST
    return first, first + ((places >> 16) & LONGEST), first + (places & 0xFFFF)


class Block:
    """Stretches of several texts, by which their shared intervals are verified.

    ``texts``: (row, keys, places, starts, lengths, shingles) of each.
    """

    def __init__(self, texts: list[tuple], least: int, percent: int):
        self.least, self.percent = least, percent
        self.need = -(-2 * percent * least // (100 + percent))
        self.row = [t[0] for t in texts]
        count = np.array([len(t[4]) for t in texts])
        lengths = np.concatenate([t[4] for t in texts])
        after = np.cumsum(lengths)
        flat = np.insert(np.concatenate([t[5] for t in texts]), after, 0)  # a gap after each stretch, so that none runs into the next
        gap = np.zeros(len(flat), dtype=bool)
        gap[after + np.arange(len(after))] = True
        upto = np.cumsum(count)
        edges = np.append(0, after + np.arange(1, len(after) + 1))  # where stretches begin
        self.begin, sizes = edges[upto - count], edges[upto] - edges[upto - count]
        within = edges[:-1] - np.repeat(self.begin, count)
        self.shift = [(t[3], within[hi - k : hi]) for t, hi, k in zip(texts, upto.tolist(), count.tolist())]
        # a text may be there twice, as one that is met and as one that meets
        of = np.repeat(np.unique(self.row, return_inverse=True)[1], sizes)
        ids = np.unique(flat, return_inverse=True)[1].astype(np.int64)
        ids[gap] = ids.max(initial=0) + 1 + np.arange(int(gap.sum()))  # equal to nothing
        self.ids, n = ids, len(flat)
        self.place = np.full(int(ids.max(initial=0)) + 1, -1)
        self.flag = np.zeros(len(self.place), dtype=np.uint8)
        in_text = of * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(in_text, kind="stable")
        again = np.flatnonzero(in_text[order[1:]] == in_text[order[:-1]]) + 1
        back = np.full(n, n)
        back[order[again]] = order[again] - order[again - 1]
        self.last_seen = np.arange(n) - back  # where a place's shingle was in its text before, or less than 0
        firsts = np.delete(order, again)
        near = np.flatnonzero(self.last_seen >= np.maximum(np.arange(n) - least + 1, 0))
        self.distinct = least - np.cumsum(np.bincount(np.maximum(near - least + 1, 0), minlength=n + 1) - np.bincount(self.last_seen[near] + 1, minlength=n + 1))  # shingles of the stretch from each start on
        texts_with = np.bincount(ids[firsts], minlength=int(ids.max(initial=0)) + 1)
        window = lambda mask: (lambda c: c[least:] - c[:-least])(np.concatenate([[0], np.cumsum(mask)]))
        if n >= least:
            whole = window(gap) == 0
            self.plain = whole & (window(back < least) == 0)  # stretches without a repeated shingle
            enough = window(texts_with[ids] > 1) >= -(-percent * least // 100)
            able = whole & (enough | ~self.plain)
        else:
            self.plain = able = np.zeros(0, dtype=bool)
        self.plain = np.append(self.plain, np.zeros(n - len(self.plain), dtype=bool))
        self.hopeless = np.append(~able, np.ones(n - len(able), dtype=bool))  # starts of stretches that are like no other text's
        self.able = np.concatenate([[0], np.cumsum(~self.hopeless)])
        self.rough = np.concatenate([[0], np.cumsum(~self.plain)])
        self.texts_with = [dict() for _ in texts]
        self.twins: list[dict] = [{} for _ in texts]  # of a place that stands for others: how far they are
        self.members: dict[int, list[int]] = defaultdict(list)
        self.places_of: dict[int, tuple] = {}
        whole = np.concatenate([t[2] for t in texts])
        many = np.array([len(t[2]) for t in texts])
        first, last, anchor = unpacked(whole)
        low = np.concatenate([self.local(m, part) for m, part in enumerate(np.split(first, np.cumsum(many)[:-1]))])
        first, last, anchor = low, last - first + low, anchor - first + low
        keys = np.concatenate([t[1] for t in texts])
        of_place = np.repeat(np.arange(len(texts)), many)
        self.open = [set() for _ in texts]
        for m, key in zip(*(x[(whole & OPEN) > 0].tolist() for x in (of_place, keys))):
            self.open[m].add(key)
        alive = self.able[last + 1] > self.able[first]
        for m, key, f, t, c in zip(*(x[alive].tolist() for x in (of_place, keys, first, last, anchor))):
            self.texts_with[m].setdefault(key, []).append((f, t, c))
        for m, held in enumerate(self.texts_with):
            for key, places in held.items():
                self.members[key].append(m)
                if len(places) > 1:  # of places with one context the first is compared, and stands for all
                    alike_ = defaultdict(list)
                    for f, t, c in places:
                        alike_[self.ids[f : t + least].tobytes(), c - f].append((f, t, c))
                    held[key] = [g[0] for g in alike_.values()]
                    for (f, _, c), *others in alike_.values():
                        if others:
                            self.twins[m][f, c] = [x - f for x, _, _ in others]
        self.spans: list[list[tuple[int, int, bool]]] = [[] for _ in texts]
        self.size, self.done = sizes, np.zeros(n, dtype=np.uint8)  # starts of stretches: 1 for verified, 2 for verified with an earlier text
        self.top = list(range(len(texts)))
        self.edges: list[tuple[int, int]] = []
        self.explained: dict[int, set[int]] = {}

    def local(self, m: int, position: np.ndarray) -> np.ndarray:
        """Positions in a text as positions in the block."""
        starts, at = self.shift[m]
        k = np.searchsorted(starts, position, side="right") - 1
        return self.begin[m] + at[k] + position - starts[k]

    def of_text(self, m: int, position: int) -> int:
        starts, at = self.shift[m]
        k = int(np.searchsorted(at, position - self.begin[m], side="right")) - 1
        return int(starts[k] + position - self.begin[m] - at[k])

    def find(self, m: int) -> int:
        while self.top[m] != m:
            self.top[m] = self.top[self.top[m]]
            m = self.top[m]
        return m

    def alike(self, a: int, b: int, n: int) -> np.ndarray:
        """Of the ``n`` starts from ``a`` and ``b`` on: whether the stretches of both, as sets, have the similarity."""
        least, long = self.least, n + self.least - 1
        x, y = self.ids[a : a + long], self.ids[b : b + long]
        out, once = np.zeros(n, dtype=bool), self.last_seen[b : b + long] < b
        if self.rough[a + n] == self.rough[a] and once.all():  # a shared shingle counts where a stretch has both of its places
            self.place[y] = np.arange(long)
            at = self.place[x]
            self.place[y] = -1
            i = np.flatnonzero(at >= 0)
            if len(i) >= self.need:
                j = at[i]
                low, high = np.minimum(i, j), np.maximum(i, j) - least + 1
                met = low >= high
                steps = np.bincount(np.maximum(high[met], 0), minlength=long + 1) - np.bincount(low[met] + 1, minlength=long + 1)
                out[:] = np.cumsum(steps)[:n] >= self.need
        else:
            self.flag[x] = 1
            shared = int(np.count_nonzero(self.flag[y[once]]))
            self.flag[x] = 0
            if self.enough(shared, self.fewest(a, n), self.fewest(b, n)):
                out[alike(x, y, least, self.percent)] = True
        return out

    def enough(self, shared, mine, its):
        """Whether so many shared shingles may be those of alike stretches that have at least ``mine`` and ``its`` distinct ones."""
        return (100 + self.percent) * shared >= self.percent * (mine + its)

    def fewest(self, start: int, n: int) -> int:
        """The least number of distinct shingles of the ``n`` stretches from ``start`` on."""
        return int(self.distinct[start : start + n].min())

    def pair(self, a: int, b: int, keys) -> set[int]:
        """The keys whose intervals in both texts have a common stretch; its spans are kept.

        Each start that two intervals have at one distance from their anchors is tested;
        where there is none, the two starts that come nearest to it.
        """
        least, ok, found, twins, diagonals = self.least, set(), set(), [], {}
        asked: dict[int, list[tuple]] = defaultdict(list)
        for key in keys:
            for one in self.texts_with[a][key]:
                for two in self.texts_with[b][key]:
                    (af, al, ac), (bf, bl, bc) = one, two
                    lo, hi = max(af - ac, bf - bc), min(al - ac, bl - bc)
                    sa, sb = (ac + lo, bc + lo) if lo <= hi else (af, bl) if af - ac > bl - bc else (al, bf)
                    asked[sa - sb].append((sb, sb + max(0, hi - lo) + 1, key, one, two))
        for d, items in asked.items():
            items.sort(key=lambda x: x[:2])
            at = 0
            while at < len(items):  # ranges that overlap are tested as one
                lo, hi, upto = items[at][0], items[at][1], at + 1
                while upto < len(items) and items[upto][0] <= hi:
                    hi, upto = max(hi, items[upto][1]), upto + 1
                part, at = items[at:upto], upto
                total = np.concatenate([[0], np.cumsum(self.ids[lo + d : hi - 1 + least + d] == self.ids[lo : hi - 1 + least])])
                equal = total[least:] - total[:-least]
                # as many equal places without repeats are as many equal shingles
                good = (equal == least) | (equal >= self.need) & self.plain[lo:hi] & self.plain[lo + d : hi + d]
                holds = good
                every = bool(good.all())
                if not every and any(not good[x - lo : y - lo].any() for x, y, *_ in part):
                    holds = good | self.alike(lo + d, lo, hi - lo)
                if not holds.any():
                    continue
                for x, y, key, one, two in part:
                    if every or holds[x - lo : y - lo].any():
                        ok.add(key)
                        twins += [(m, other, place, by) for m, other, place in ((a, b, one), (b, a, two)) for by in self.twins[m].get((place[0], place[2]), ())]
                starts = np.flatnonzero(holds) + lo
                self.done[starts + d] |= 3 if self.row[a] > self.row[b] else 1
                self.done[starts] |= 3 if self.row[b] > self.row[a] else 1
                if good.any():
                    if d not in diagonals:
                        diagonals[d] = self._diagonal(a, b, d)
                    b0, same, edges = diagonals[d]
                    fast = np.flatnonzero(good) + lo - b0
                    for x, y in edges[np.unique(np.searchsorted(edges[:, 0], fast, side="right") - 1)].tolist():
                        first, last = np.flatnonzero(same[x : y - 1 + least])[[0, -1]] + x + b0
                        found.add((int(first) + d, int(last) + d, int(first), int(last)))
                if holds is not good:  # words were put in or taken out: from the first to the last shingle that both have
                    for x0, x1 in (np.flatnonzero(np.diff(np.concatenate([[0], (holds & ~good).view(np.int8), [0]]))).reshape(-1, 2) + lo).tolist():
                        u, v = self.ids[x0 + d : x1 - 1 + least + d], self.ids[x0 : x1 - 1 + least]
                        p, q = np.flatnonzero(np.isin(u, v)), np.flatnonzero(np.isin(v, u))
                        found.add((x0 + d + int(p[0]), x0 + d + int(p[-1]), x0 + int(q[0]), x0 + int(q[-1])))
        for a0, a1, b0, b1 in found:
            self._add(a, a0, a1, self.row[a] > self.row[b])
            self._add(b, b0, b1, self.row[b] > self.row[a])
        for m, other, (f, t, _), by in twins:
            self._add(m, f + by, t + by + least - 1, self.row[m] > self.row[other])
        if found and self.find(a) != self.find(b):
            self.top[self.find(b)] = self.find(a)
            self.edges.append((a, b))
        return ok

    def _add(self, m: int, first: int, last: int, cut: bool) -> None:
        self.spans[m].append((self.of_text(m, first), self.of_text(m, last), cut))

    def _diagonal(self, a: int, b: int, d: int) -> tuple:
        """(first position, equal shingles, runs of starts with enough equal places) of both texts shifted by ``d``."""
        end = lambda m: int(self.begin[m] + self.size[m])
        b0 = max(int(self.begin[b]), int(self.begin[a]) - d)
        b1 = min(end(b), end(a) - d)
        same = self.ids[b0 + d : b1 + d] == self.ids[b0:b1]
        total = np.concatenate([[0], np.cumsum(same)])
        good = np.zeros(max(0, b1 - b0), dtype=bool)
        if len(same) >= self.least:
            n = len(same) - self.least + 1
            equal = total[self.least :] - total[: -self.least]
            good[:n] = (equal == self.least) | (equal >= self.need) & self.plain[b0 : b0 + n] & self.plain[b0 + d : b0 + d + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8))).reshape(-1, 2)
        return b0, same, edges

    def covered(self, p: int, q: int, key: int) -> bool:
        """Whether all that two texts might share by a key is in their spans already, and cut from the later one."""
        later = p if self.row[p] > self.row[q] else q
        whole = lambda m, bit: all((self.hopeless[f : t + 1] | (self.done[f : t + 1] & bit > 0)).all() for f, t, _ in self.texts_with[m][key])
        return whole(later, 2) and whole(p + q - later, 1)

    def star(self, hub: int) -> dict[int, set[int]]:
        """What of each text's keys the hub does not explain, after the hub has met all texts."""
        mine, open_ = self.texts_with[hub], {}
        for m in range(len(self.row)):
            if m == hub:
                continue
            shared = [k for k in self.texts_with[m] if k in mine]
            ok = self.pair(hub, m, shared) if shared else set()
            if rest := set(self.texts_with[m]) - ok:
                open_[m] = rest
            self.explained[m] = ok
        return open_

    def among(self, open_: dict[int, set[int]], others: dict[int, int] | None = None) -> None:
        """Texts with open keys against all texts that have these, each pair once.

        With ``others`` (their star's block by text) only these are met, but for those of
        the same star's block, which has compared them, and of two open texts the later one
        meets the earlier.
        """
        row = np.array(self.row)
        is_open = lambda m, key: key in (open_.get(m, ()) if others is None else self.open[m])
        star = np.array([-1 if others is None else others.get(m, -1) for m in range(len(row))])
        opened: dict[int, np.ndarray] = {}
        for p in sorted(open_):
            waiting: dict[int, np.ndarray] = {}
            for key in open_[p]:
                if len(self.members[key]) < 2:
                    continue
                q = self.places(key)[0]
                if key not in opened:
                    opened[key] = np.array([is_open(m, key) for m in q.tolist()])
                if others is None:
                    asked = (row[q] != row[p]) & ~((q < p) & opened[key])
                else:
                    asked = (row[q] != row[p]) & (star[q] >= 0) & (star[q] != self.home[p]) & ~((row[q] > row[p]) & opened[key])
                if asked.any() and len(which := self.sharing(p, key, np.flatnonzero(asked))):
                    waiting[key] = which
            some = 8
            while waiting:  # what a few partners show rules out many of the others
                partners: dict[int, list[int]] = defaultdict(list)
                for key, which in waiting.items():
                    waiting[key] = which = self.possible(p, key, which)
                    for q in np.unique(self.places(key)[0][which]).tolist():
                        partners[q].append(key)
                now = set(list(partners)[:some])
                for q in now:
                    keys = partners[q]
                    if self.find(p) == self.find(q):
                        keys = [k for k in keys if not self.covered(p, q, k)]
                    if keys:
                        self.pair(p, q, keys)
                left = {key: which[[q not in now for q in self.places(key)[0][which].tolist()]] for key, which in waiting.items() if len(which)}
                waiting = {key: which for key, which in left.items() if len(which)}
                some *= 4

    def places(self, key: int) -> tuple[np.ndarray, ...]:
        """Text, first start, last start and anchor of all places of a key; the distinct shingles of one after another, where those of each begin, and the fewest of a stretch."""
        if key not in self.places_of:
            q, first, last, anchor = np.array([(m, *place) for m in self.members[key] for place in self.texts_with[m][key]]).T
            long = last + self.least - first
            begin = np.cumsum(long) - long
            at = np.arange(int(long.sum())) + np.repeat(first - begin, long)
            once = self.last_seen[at] < np.repeat(first, long)
            fewest = np.minimum.reduceat(np.append(self.distinct, self.least), np.stack([first, last + 1], axis=1).ravel())[::2]
            self.places_of[key] = q, first, last, anchor, self.ids[at[once]].astype(np.int32), np.append(0, np.cumsum(once))[begin], fewest
        return self.places_of[key]

    def sharing(self, p: int, key: int, which: np.ndarray) -> np.ndarray:
        """Those places of a key that share as many distinct shingles with one of the text's places as alike stretches do."""
        *_, shingles, begin, fewest = self.places(key)
        if len(which) * 8 < len(begin):  # few of them are asked for
            ends = np.append(begin[1:], len(shingles))
            long = (ends - begin)[which]
            at = np.cumsum(long) - long
            shingles = shingles[np.arange(int(long.sum())) + np.repeat(begin[which] - at, long)]
            begin, fewest, few = at, fewest[which], True
        else:
            few = False
        able = np.zeros(len(begin), dtype=bool)
        for f, t, _ in self.texts_with[p][key]:
            mine = self.ids[f : t + self.least]
            self.flag[mine] = 1
            shared = np.add.reduceat(self.flag[shingles], begin, dtype=np.int64)
            self.flag[mine] = 0
            able |= self.enough(shared, self.fewest(f, t - f + 1), fewest)
        return which[able if few else able[which]]

    def possible(self, p: int, key: int, which: np.ndarray) -> np.ndarray:
        """Those places that ``pair`` may find to share a stretch by the key: what one pass over all of them cannot rule out.

        A stretch of the text is like that at the same distance from the anchor in another
        only if enough of its shingles lie in both. Where shingles repeat, nothing is ruled out.
        """
        least = self.least
        if len(which) < 3 or len(self.texts_with[p][key]) > 1:
            return which
        [(f, t, c)] = self.texts_with[p][key]
        away = np.arange(1 - least, least)
        at = c + away
        inside = np.flatnonzero((at >= f) & (at < t + least))
        mine = self.ids[at[inside]]
        if t > c or self.rough[t + 1] > self.rough[f] or (self.last_seen[at[inside]] >= at[inside[0]]).any():
            return which
        q, bf, bt, bc = (x[which] for x in self.places(key)[:4])
        open_ = (bt > bc) | (self.rough[bt + 1] > self.rough[bf]) | (np.maximum(f - c, bf - bc) > np.minimum(t - c, bt - bc))
        self.place[mine] = inside
        its = bc[:, None] + away
        valid = (its >= bf[:, None]) & (its < bt[:, None] + least)
        where = np.where(valid, self.place[self.ids[np.clip(its, 0, len(self.ids) - 1)]], -1)
        self.place[mine] = -1
        row, j = np.nonzero(where >= 0)
        i, wide = where[row, j], len(away) + 1
        low, high = np.minimum(i, j), np.maximum(np.maximum(i, j) - least + 1, 0)
        both = low >= high
        steps = np.bincount(row[both] * wide + high[both], minlength=len(q) * wide) - np.bincount(row[both] * wide + low[both] + 1, minlength=len(q) * wide)
        near = np.cumsum(steps.reshape(len(q), wide), axis=1)[:, :least] >= self.need
        # of texts that are linked, starts that are in both spans already, and cut from the later text, show nothing new
        linked = np.array([self.find(x) == self.find(p) for x in q.tolist()])
        later = np.array([self.row[x] > self.row[p] for x in q.tolist()])[:, None]
        starts = np.arange(least) + 1 - least
        own, its = (np.take(self.done, np.maximum(x + starts, 0)) for x in (c, bc[:, None]))
        known = linked[:, None] & (own & np.where(later, 1, 2) > 0) & (its & np.where(later, 2, 1) > 0)
        new = (near & ~known).any(axis=1)
        return which[new | open_]


def _intervals(docs: DataFrame, least: int, text_col: str, id_col: str) -> DataFrame:
    """Per row: id, hashes of the text, number of words, and the text's intervals as arrays of keys and packed places."""
    names = ["id", "t1", "t2", "words", "keys", "places"]

    def make(batches):
        for b in batches:
            text = b.column("text")
            for start, n in portions(text, 1 << 20):
                part = b.slice(start, n)
                seqs = sequences(text.slice(start, n), SHINGLE)
                of, key, first, last, anchor = signature_intervals(seqs, least)
                order = np.argsort(of, kind="stable")
                cuts = pa.array(np.searchsorted(of[order], np.arange(len(seqs) + 1)).astype(np.int32))
                place = packed(first, last, anchor)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order], pa.int64())) for x in (key, place)]
                words = pa.array([len(s) + SHINGLE - 1 if len(s) > 1 else min(len(s), 1) for s in seqs], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), words, *lists], names=names)

    text = quoted(text_col)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))
    return rows.mapInArrow(trimmed(make), "id long, t1 long, t2 long, words int, keys array<bigint>, places array<bigint>")


STRETCHES = "unit long, i int, j int, part int, row long, keys array<bigint>, places array<bigint>, starts array<int>, lengths array<int>, shingles array<bigint>"


def _stretches(docs: DataFrame, placed: DataFrame, least: int, text_col: str, id_col: str, beside_texts: int) -> DataFrame:
    """A STRETCHES row for each (unit, i, j, part, keys, places) that a text is placed in.

    ``placed``: row, rep (hashes and id of the row that stands for the text), at. Texts are told from
    the others by a broadcast while that is small, and met by their hashes in a shuffle.
    """

    def cut(seq: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, last, _ = unpacked(places)
        order = np.argsort(first)
        lo, hi = first[order], last[order] + least
        hi = np.maximum.accumulate(hi)
        new = np.append(True, lo[1:] > hi[:-1])
        starts, stops = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
        return starts, stops - starts, np.concatenate([seq[x:y] for x, y in zip(starts.tolist(), stops.tolist())])

    def make(batches):
        fields = [pa.field("unit", pa.int64()), *(pa.field(c, pa.int32()) for c in ("i", "j", "part")), pa.field("row", pa.int64()), *(pa.field(c, pa.list_(pa.int64())) for c in ("keys", "places")), *(pa.field(c, pa.list_(pa.int32())) for c in ("starts", "lengths")), pa.field("shingles", pa.list_(pa.int64()))]
        for b in batches:
            text = b.column("text")
            rows = (x for start, n in portions(text) for x in sequences(text.slice(start, n), SHINGLE))
            for n, seq in enumerate(rows):
                seq, row = seq.view(np.int64), b.column("row")[n].as_py()
                out, made, places_of = [], {}, b.column("at")[n].values
                plain = [places_of.field(c).to_pylist() for c in ("unit", "i", "j", "part")]
                for at, keys, places in zip(zip(*plain), places_of.field("keys"), places_of.field("places")):
                    keys, places = keys.values.to_numpy(), places.values.to_numpy()
                    if (same := places.tobytes()) in made:
                        out.append((*at, row, keys, *made[same]))
                        continue
                    # every stretch that holds the anchor counts, not those alone that have the signature
                    _, last, anchor = unpacked(places)
                    first = np.maximum(anchor - least + 1, 0)
                    places = packed(first, np.minimum(np.minimum(np.maximum(anchor, last), len(seq) - least), first + LONGEST), anchor) | (places & OPEN)
                    made[same] = places, *cut(seq, places)
                    out.append((*at, row, keys, *made[same]))
                for start in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out[start : start + 64]), fields)], schema=pa.schema(fields))

    text = quoted(text_col)
    rows = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), quoted(id_col).cast("long").alias("id"), text.alias("text"))
    ends = placed.select(*(F.col(f"rep.{c}").alias(f"_{c}") for c in ("t1", "t2", "id")), "row")
    same = lambda a, b: (a["t1"] == b["_t1"]) & (a["t2"] == b["_t2"]) & a["id"].eqNullSafe(b["_id"])
    if ends.count() * 200 <= beside_texts:
        rows = rows.join(F.broadcast(ends.drop("row")), same(rows, ends), "left_semi")
    wanted = placed.select("row", "at", *(F.col(f"rep.{c}").alias(f"_{c}") for c in ("t1", "t2", "id")))
    met = rows.join(wanted.hint("merge"), same(rows, wanted))
    return met.select("row", "at", "text").mapInArrow(trimmed(make), STRETCHES)


def _verified(stretches: DataFrame, least: int, percent: int) -> DataFrame:
    """(unit, row, other, spans, cuts, open) of each block: merged spans of its texts, its links, and keys left open.

    Blocks with a part 0 are stars: part 0 is the hub; others are of part 1, or of part 3
    where the unit has several blocks. In blocks without, the texts of part 1 meet those of
    part 2, and four times their star's block is added to the part.
    """
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    schema = pa.schema([("unit", pa.int64()), ("row", pa.int64()), ("other", pa.int64()), ("spans", span), ("cuts", span), ("open", pa.list_(pa.int64()))])

    def joined(spans: list[tuple[int, int]]) -> list[dict]:
        out: list[dict] = []
        for first, last in sorted(set(spans)):
            last += SHINGLE - 1
            if out and out[-1]["last"] >= first - 1:
                out[-1]["last"] = max(out[-1]["last"], last)
            else:
                out.append({"first": first, "last": last})
        return out

    def check(batches):
        for (unit, _, _), group in sorted_groups(batches, ["unit", "i", "j"]):
            texts, part = [], []
            for b in group:
                lists = []
                for c in ("keys", "places", "starts", "lengths", "shingles"):
                    held, at = b.column(c).values.to_numpy(), b.column(c).offsets.to_numpy().tolist()
                    lists.append([held[lo:hi] for lo, hi in zip(at, at[1:])])
                for row, keys, places, starts, lengths, shingles in zip(b.column("row").to_pylist(), *lists):
                    texts.append((row, keys, places, starts.astype(np.int64), lengths.astype(np.int64), shingles))
                part += b.column("part").to_pylist()
            if len(texts) < 2:
                continue
            block, left = Block(texts, least, percent), {}
            if 0 in part:
                block.among(block.star(part.index(0)))
                # in a unit of several blocks, whatever the hub did not explain meets the others
                left = {m: rest for m, p in enumerate(part) if p == 3 and (rest := set(texts[m][1].tolist()) - block.explained[m])}
            else:
                block.home = {m: p // 4 for m, p in enumerate(part)}
                block.among({m: set(block.texts_with[m]) for m, p in enumerate(part) if p % 4 == 1}, {m: p // 4 for m, p in enumerate(part) if p % 4 == 2})
            rows = []
            for m, row in enumerate(block.row):
                if block.spans[m] or m in left:
                    rows.append((unit, row, None, joined([s[:2] for s in block.spans[m]]), joined([s[:2] for s in block.spans[m] if s[2]]), sorted(left.get(m, ()))))
            rows += [(unit, block.row[a], block.row[b], [], [], []) for a, b in block.edges]
            for start in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[start : start + 512]), schema)], schema=schema)

    # tasks of few bytes may take long, so they are not made one
    tasks = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretches.repartition(tasks, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    out = "array<struct<first:int,last:int>>"
    return dealt.mapInArrow(trimmed(check), f"unit long, row long, other long, spans {out}, cuts {out}, open array<bigint>")


def _merged(spans):
    """Sorted (first, last) spans with those that touch made one."""
    empty = F.array().cast("array<struct<first:int,last:int>>")
    return F.aggregate(
        spans,
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1).last >= x.first - 1),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).first.alias("first"), F.greatest(F.element_at(acc, -1).last, x.last).alias("last")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES, beside_texts: int = BROADCAST_BESIDE_TEXTS) -> DataFrame:
    """(id, class_id, class_size, spans, cut_spans, t1, t2, stays) of each row that shares a passage.

    Spans are (first, last) word numbers. ``cut_spans`` are those that a text before it
    (in the operator's own order of texts) has too, so that cutting them everywhere
    leaves one of each passage. Of rows with equal texts of at least ``min_words`` words
    one ``stays``; the others have their whole length there. ``t1`` and ``t2`` are
    hashes of the text; ``class_size`` is the number of rows of the class.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    least = max(1, min_words - SHINGLE + 1)
    if least >= 1 << 16:
        raise ValueError("passages of at most 65,535 words can be asked for")
    marked = scratch.write(_intervals(docs, least, text_col, id_col).withColumn("row", F.monotonically_increasing_id()), "marked")
    rep = F.min(F.struct("row", "t1", "t2", "id")).alias("rep")
    same = marked.groupBy("t1", "t2").agg(rep, F.min("id").alias("least_id"), F.count("*").alias("n"), F.max("words").alias("words"))
    same = scratch.write(same.select(F.col("rep.row").alias("row"), "t1", "t2", "rep", "least_id", "n", "words"), "texts")

    # intervals of one row of each text; the rows of copies are few, or else met in a shuffle
    copies = marked.select("row", "t1", "t2").join(same.where("n > 1").select("t1", "t2", F.col("row").alias("first_row")), ["t1", "t2"]).where("row <> first_row").select("row")
    copies = scratch.write(copies, "copies")
    small = copies.count() * 64 <= broadcast_bytes
    once = marked.select("row", "keys", "places").join(F.broadcast(copies) if small else copies, "row", "left_anti")
    intervals = once.select("row", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    groups = intervals.groupBy("key").agg(F.min("row").alias("hub"), F.max("row").alias("hi")).where("hub <> hi").select("key", "hub")
    groups = scratch.write(groups, "groups")
    pairs = intervals.join(groups.hint("merge"), "key").groupBy("hub", "row").agg(F.collect_list(F.struct("key", "place")).alias("x")).select("hub", "row", F.col("x.key").alias("keys"), F.col("x.place").alias("places"))
    pairs = scratch.write(pairs, "pairs")

    # stars: the hub in each block of its unit, every other text in one
    sizes = pairs.groupBy("hub").agg(F.ceil(F.greatest((F.count("*") - 1) / F.lit(BLOCK), F.sum(F.size("keys")) * least / F.lit(2 * BLOCK_SHINGLES))).cast("int").alias("blocks"))
    sizes = scratch.write(sizes, "sizes")
    met = pairs.join(sizes, "hub")
    is_hub = F.col("row") == F.col("hub")
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    place = lambda i, j, part: F.struct(F.col("hub").alias("unit"), i.cast("int").alias("i"), j.cast("int").alias("j"), part.cast("int").alias("part"), F.col("keys"), F.col("places"))
    blocks = F.when(is_hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    at = F.transform(blocks, lambda j: place(F.lit(0), j, F.when(is_hub, F.lit(0)).when(F.col("blocks") > 1, F.lit(3)).otherwise(F.lit(1))))
    placed = met.select("row", at.alias("at")).groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"))
    placed = scratch.write(placed.join(same.select("row", "rep"), "row"), "star-places")
    args = (least, text_col, id_col, beside_texts)
    stars = scratch.write(_verified(_stretches(docs, placed, *args), least, percent), "stars")

    # units of several blocks: what hubs did not explain meets the other blocks
    wide = sizes.where("blocks > 1").select(F.col("hub").alias("unit"))
    open_ = stars.where(F.size("open") > 0).join(wide, "unit", "left_semi").select("unit", "row", "open")
    open_ = scratch.write(open_, "open")
    found = stars
    if not open_.isEmpty():
        keys = open_.select("unit", F.explode("open").alias("key"))
        lefts = keys.distinct()
        every = pairs.where(~is_hub).select(F.col("hub").alias("unit"), "row", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("unit", "row", "x.keys", "x.places").withColumnsRenamed({"keys": "key", "places": "place"})
        every = every.join(lefts, ["unit", "key"], "left_semi")
        failed = open_.select("unit", "row", F.explode("open").alias("key")).withColumn("failed", F.lit(True))
        every = every.join(failed.distinct(), ["unit", "row", "key"], "left")
        listed = every.groupBy("unit", "row").agg(F.collect_list(F.struct("key", "place", "failed")).alias("x"))
        marked_places = F.transform("x", lambda e: F.when(e.failed, e.place.bitwiseOR(F.lit(OPEN))).otherwise(e.place))
        listed = listed.withColumn("y", F.filter("x", lambda e: e.failed)).select("unit", "row", F.col("x.key").alias("keys"), marked_places.alias("places"), F.col("y.key").alias("left_keys"), F.col("y.place").alias("left_places"))
        listed = scratch.write(listed, "listed")
        counts = listed.groupBy("unit").agg(*(F.ceil(F.greatest(F.count_if(F.size(c) > 0) / F.lit(2 * BLOCK), F.sum(F.size(c)) * least / F.lit(2 * BLOCK_SHINGLES), F.lit(1.0))).cast("int").alias(n) for c, n in (("left_keys", "lefts"), ("keys", "alls"))))
        both = listed.join(counts, "unit").join(sizes.withColumnRenamed("hub", "unit"), "unit").withColumn("home", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        to = lambda i, j, part, k, p: F.struct(F.col("unit"), i.alias("i"), j.alias("j"), (F.col("home") * 4 + part).alias("part"), F.col(k).alias("keys"), F.col(p).alias("places"))
        as_left = F.transform(F.sequence(F.lit(0), F.col("alls") - 1), lambda j: to(own("lefts"), j, 1, "left_keys", "left_places"))
        as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: to(i, own("alls"), 2, "keys", "places"))
        at = F.concat(F.when(F.size("left_keys") > 0, as_left).otherwise(F.slice(as_left, 1, 0)), as_right)
        placed = both.select("row", at.alias("at")).groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at"))
        placed = scratch.write(placed.join(same.select("row", "rep"), "row"), "block-places")
        found = stars.unionByName(scratch.write(_verified(_stretches(docs, placed, *args), least, percent), "among"))

    links = found.where("other IS NOT NULL").select(F.col("row").alias("a"), F.col("other").alias("b")).distinct()
    roots = components(links, scratch, "classes")
    spans = found.where(F.size("spans") > 0).groupBy("row").agg(*(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("spans", "cuts")))
    spans = scratch.write(spans.select("row", _merged(F.col("spans")).alias("spans"), _merged(F.col("cuts")).alias("cut_spans")), "spans")

    # classes by id; equal texts of at least min_words words are a class even without other links
    of_text = same.join(spans, "row", "left").where(F.col("spans").isNotNull() | ((F.col("n") > 1) & (F.col("words") >= min_words)))
    of_text = scratch.write(of_text.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), "of-text")
    classes = of_text.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("class_size"))
    known = scratch.write(of_text.join(classes, "root").select("t1", "t2", F.col("row").alias("first_row"), "n", "words", "class_id", "class_size", "spans", "cut_spans"), "known")
    rows = marked.select("row", "id", "t1", "t2")
    out = left_join_sized(rows, known, ["t1", "t2"], 512, F.col("row"), broadcast_bytes).where(F.col("class_size").isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("words") - 1).alias("last")))
    copied = (F.col("n") > 1) & (F.col("words") >= min_words)
    stays = ~copied | (F.col("row") == F.col("first_row"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return out.select(
        "id",
        "class_id",
        "class_size",
        F.when(copied, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(~stays, whole).otherwise(F.coalesce("cut_spans", none)).alias("cut_spans"),
        "t1",
        "t2",
        stays.alias("stays"),
    )


def cut_passages(docs: DataFrame, found: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each passage left in one document alone, as many rows as before and with the same columns.

    Rows are met by the hashes of their texts. Of rows with equal texts the one that
    ``stays`` is known by its id; where several rows share that id and text, all of them stay.
    """
    text = quoted(text_col)
    marked = docs.select("*", F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit("second"), text).alias("__t2"), quoted(id_col).cast("long").alias("__id"))
    cuts = found.groupBy("t1", "t2", "id").agg(F.max_by("cut_spans", F.col("stays").cast("int")).alias("__cut")).where(F.size("__cut") > 0)
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    kept = F.filter(pieces, lambda _, i: ~F.exists("__cut", lambda s: (i >= s.first) & (i <= s.last)))
    cut = F.when(F.col("__cut").isNull(), text).otherwise(F.concat(head, F.array_join(kept, "")))
    return marked.join(cuts.select("t1", "t2", "id", "__cut").withColumnsRenamed({"t1": "__c1", "t2": "__c2", "id": "__cid"}), (F.col("__t1") == F.col("__c1")) & (F.col("__t2") == F.col("__c2")) & F.col("__id").eqNullSafe(F.col("__cid")), "left").select(*[cut.alias(c) if c == text_col else quoted(c) for c in docs.columns])


def op5_passages(spark, sf_dir):
    found = repeated_passages(table(spark, sf_dir, "documents"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.first.cast("string"), s.last.cast("string"))), ",")
    n_words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.last - s.first + 1)
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", n_words.alias("passage_words"), shown.alias("spans"))


QUERIES = {"op5_passages": op5_passages}
ORACLES: dict[str, str] = {}
