"""Periodic runs of words, found with suffix trees.

A run is a stretch of words with smallest period q, at least max(LEAST, POWER * q)
long, that no neighbouring word extends.  By the runs theorem every run holds the
longest Lyndon word that starts at one of its places, in the order of the words or in
the reverse order, and that Lyndon word ends where the next smaller (greater) suffix
begins.  So the places give two candidates each, (i, j) with period j - i, and each is
extended to the right and to the left by longest common extensions.

Extensions are constant-time: Ukkonen's tree of the words and that of their reversal,
an Euler tour of each with the string depths, and minima over blocks of the tour.  The
trees are built over the stretches that can hold a run: within one, every word of a
run occurs POWER times or more, so words that do not cut the text, again and again
until nothing changes.  That loses no run and leaves most texts without any stretch.

Null and empty texts and texts of white space have no words and no runs.  Repeated rows
and rows of one doc_id are worked on one by one.  Very long texts cost time and memory
in proportion to their length (some 500 bytes for each word that may be in a run).
An empty table gives an empty result.  Columns besides doc_id and text are not read.
"""

import hashlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

LEAST, POWER = 6, 4
TREE_WORDS = 20_000  # stretches of several texts share trees up to about this size
BLOCK = 32  # of the tour, for its minima

Run = tuple[int, int, int]  # start, length, period


def words_of(text: str | None) -> list[bytes]:
    """Stretches between blanks (space and the five controls from tab to return)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def suffix_tree(s: list[int], symbols: int) -> tuple[array, array, dict[int, int]]:
    """Ukkonen's suffix tree of s, whose last symbol occurs once.

    Edges begin at start[v] and end before end[v]; children go by node * symbols + symbol; node 0 is the root."""
    n = len(s)
    start, end, link, child = array("q", [0]), array("q", [0]), array("q", [0]), {}
    node = edge = length = left = 0
    for i, c in enumerate(s):
        left += 1
        waiting = 0  # an inner node without a link
        while left:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i), end.append(n), link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                first = start[below]
                span = end[below] - first
                if length >= span:
                    node, edge, length = below, edge + span, length - span
                    continue
                if s[first + length] == c:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                middle = len(start)
                start.extend((first, i)), end.extend((first + length, n)), link.extend((0, 0))
                child[key] = middle
                start[below] = first + length
                child[middle * symbols + s[first + length]] = below
                child[middle * symbols + c] = middle + 1
                if waiting:
                    link[waiting] = middle
                waiting = middle
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, end, child


class Extensions:
    """Longest common extensions of the suffixes of s in constant time."""

    def __init__(self, s: list[int], symbols: int):
        n = len(s)
        start, end, child = suffix_tree(s, symbols)
        keys, nodes = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)  # by parent, then by the first symbol of the edge
        nodes, parents = nodes[order], keys[order] // symbols
        lo = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        nodes = nodes.tolist()
        depth, tour, first, sorted_suffixes = [0] * len(start), [], [0] * n, []
        todo = [0]
        while todo:
            v = todo.pop()
            if v < 0:  # back at an inner node
                tour.append(depth[~v])
                continue
            d = depth[v]
            if lo[v] == lo[v + 1]:  # a leaf
                suffix = n - d
                first[suffix] = len(tour)
                sorted_suffixes.append(suffix)
            else:
                for w in reversed(nodes[lo[v] : lo[v + 1]]):
                    depth[w] = d + end[w] - start[w]
                    todo += (~v, w)
            tour.append(d)
        self.first, self.order = np.array(first, np.int64), sorted_suffixes
        self._minima(np.array(tour, np.int64))

    def _minima(self, tour: np.ndarray) -> None:
        n = -(-len(tour) // BLOCK)
        grid = np.full(n * BLOCK, np.iinfo(np.int64).max)
        grid[: len(tour)] = tour
        self.tour, grid = grid, grid.reshape(n, BLOCK)
        self.upto = np.minimum.accumulate(grid, 1).ravel()
        self.onward = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [grid.min(1)]
        while 2 << (len(self.table) - 1) <= n:
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b (pairwise different) have in common: the string depth of their lowest common ancestor."""
        x, y = self.first[a], self.first[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        bx, by = x // BLOCK, y // BLOCK
        out = np.minimum(self.onward[x], self.upto[y])
        same = np.flatnonzero(bx == by)
        if len(same):
            lo, hi = x[same], y[same]
            best = self.tour[lo]
            for k in range(1, BLOCK):
                best = np.minimum(best, self.tour[np.minimum(lo + k, hi)])
            out[same] = best
        far = np.flatnonzero(by - bx > 1)
        if len(far):
            lo, hi = bx[far] + 1, by[far]
            level = np.frexp((hi - lo).astype(float))[1] - 1  # log2, rounded down
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                t, i = self.table[k], far[at]
                out[i] = np.minimum(out[i], np.minimum(t[lo[at]], t[hi[at] - (1 << int(k))]))
        return out


def lyndon_ends(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one whose suffix is smaller, and the next whose is greater: where the longest Lyndon word that
    starts there ends, in either order of the symbols; the length where there is none."""
    n = len(rank)
    smaller, greater = np.full(n, n), np.full(n, n)
    for out, sign in ((smaller, 1), (greater, -1)):
        ends, open_ = [n] * n, []
        for i, r in enumerate(rank):
            r *= sign
            while open_ and rank[open_[-1]] * sign > r:
                ends[open_.pop()] = i
            open_.append(i)
        out[:] = ends
    return smaller, greater


def runs_of_symbols(s: np.ndarray, symbols: int) -> np.ndarray:
    """All runs of s, whose last symbol occurs once: rows of start, length, period, sorted by start, then period."""
    n = len(s)
    ahead, back = Extensions(s.tolist(), symbols), Extensions([*s[-2::-1].tolist(), symbols], symbols + 1)
    rank = np.empty(n, np.int64)
    rank[ahead.order] = np.arange(n)
    places, found = np.arange(n), []
    for ends in lyndon_ends(rank.tolist()):
        ok = (ends < n) & ((ends - places) * POWER <= n)
        i, j = places[ok], ends[ok]
        right = ahead(i, j)
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back(n - 1 - i[inner], n - 1 - j[inner])
        period = j - i
        length = period + left + right
        keep = length >= np.maximum(LEAST, POWER * period)
        found.append(np.stack([(i - left)[keep], length[keep], period[keep]], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches that can hold a run: in each, every word occurs POWER times or more.  ids: words as numbers, negative ones occur less often."""
    good = ids >= 0
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]
        long = hi - lo >= LEAST
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return []
        part = np.repeat(np.arange(len(lo)), hi - lo)
        at = np.arange(len(part)) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
        _, back, count = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = at[count[back] >= POWER]
        if len(keep) == len(at):
            return list(zip(lo.tolist(), hi.tolist()))
        good = np.zeros(len(ids), bool)
        good[keep] = True


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, a list of words, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    pieces, held, codes = [], 0, {}

    def flush() -> None:
        nonlocal pieces, held, codes
        if not pieces:
            return
        v, s, at, begins = len(codes), [], 0, []
        for k, (_, _, ids) in enumerate(pieces):
            s += (ids, [v + k])  # each stretch ends with a symbol of its own, so that nothing goes on across it
            begins.append(at)
            at += len(ids) + 1
        rows = runs_of_symbols(np.concatenate(s), v + len(pieces))
        of = np.searchsorted(begins, rows[:, 0], "right") - 1
        for k, (start, length, period) in zip(of.tolist(), rows.tolist()):
            t, lo, _ = pieces[k]
            out[t].append((start - begins[k] + lo, length, period))
        pieces, held, codes = [], 0, {}

    for t, words in enumerate(texts):
        counts = Counter(words)
        often = [w for w, c in counts.items() if c >= POWER]
        if not often:
            continue
        own = dict(zip(often, range(len(often))))
        ids = np.array([own.get(w, -1) for w in words])
        for lo, hi in stretches(ids):
            pieces.append((t, lo, np.array([codes.setdefault(w, len(codes)) for w in words[lo:hi]])))
            held += hi - lo
        if held >= TREE_WORDS:
            flush()
    flush()
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(step).tolist()) if not n]


def longest(runs: list[Run]) -> Run | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten, by CRC-32 of its doc_id, with its words from some place on made periodic; null ids leave the text as it is."""
    n = len(words)
    if doc_id is None or not n or (h := crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


FIELDS = {
    "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string",
}
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _over_texts(docs: DataFrame, fields: dict[str, str], row: Callable, edit: Callable | None) -> DataFrame:
    """doc_id and fields, by row(words, runs) of each document, whose words edit(doc_id, words) may have changed."""

    @F.pandas_udf(f"struct<{','.join(f'{k}:{t}' for k, t in fields.items())}>")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            words = [words_of(t) for t in texts]
            if edit:
                words = [edit(None if i is None else int(i), w) for i, w in zip(ids, words)]
            yield pd.DataFrame([row(w, r) for w, r in zip(words, find_runs(words))], columns=list(fields), dtype=object)
            del words
            release()

    return small_batches(docs).select("doc_id", look(F.col("doc_id").cast("string"), "text").alias("r")).select("doc_id", "r.*")


def periodic_runs(docs: DataFrame, edit: Callable | None = None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and text without their repeats, words joined by a blank."""
    made = lambda words, runs: (runs, b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
    return _over_texts(docs, {"runs": RUNS, "collapsed": "string"}, made, edit)


def run_digests(docs: DataFrame, edit: Callable | None = None) -> DataFrame:
    """doc_id, how many runs, the longest one (nulls if none), and digests of all runs and of the text without their repeats."""

    def row(words, runs):
        best = longest(runs)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        return (len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())

    return _over_texts(docs, FIELDS, row, edit)
