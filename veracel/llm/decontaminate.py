"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items build one automaton.  A document's words
stream through it, and the length of the longest item passage ending at each word
is tracked; where it reaches the window length, or a whole shorter item ends, the
words of the passage are hit.  The automaton is built on the driver, packed into flat
arrays and shipped to the workers; documents are never shuffled.  A benchmark of more
than SHARD_WORDS words is cut into shards of that size (a longer item into pieces that
overlap by a window less one word): one automaton at a time is built, shipped and
streamed over, and only rows that it hits are written, then merged by row.

Null and empty texts have no words and no hits; items without words are ignored;
repeated items count once by their id, a null id reads "null".  Without items
nothing is hit.  Repeated documents each get their own row.  Only doc_id and text
are read, so other columns cannot clash.
"""

import functools
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, materialize, release, small_batches, words

WINDOW = 10
#: Words of the items in one automaton: some 10 MB when packed.
SHARD_WORDS = 200_000
MAX_COVERAGE = 0.5

RUN = re.compile(rb"[^ ]+")


class Automaton:
    """Suffix automaton of all items. State 0 is the root."""

    def __init__(self, items, window: int = WINDOW):
        self.window = window
        self.step, self.link, self.size = [{}], [-1], [0]
        self.windows: dict[int, set[str]] = {}  # state holding a window -> items
        self.whole: dict[int, set[str]] = {}  # state of a whole short item -> items
        for item_id, item_words in items:
            ends, state = [], 0
            for w in item_words:
                state = self._extend(state, w)
                ends.append(state)
            if len(ends) >= window:
                self._ends = getattr(self, "_ends", [])
                self._ends.append((item_id, ends[window - 1 :]))
            elif ends:
                self._short = getattr(self, "_short", [])
                self._short.append((item_id, item_words))
        # later items may split states, so windows are placed once all are in
        for item_id, states in self.__dict__.pop("_ends", []):
            for s in states:
                self.windows.setdefault(self.holder(s), set()).add(item_id)
        for item_id, item_words in self.__dict__.pop("_short", []):
            s = 0
            for w in item_words:
                s = self.step[s][w]
            while self.size[self.link[s]] >= len(item_words):
                s = self.link[s]
            self.whole.setdefault(s, set()).add((len(item_words), item_id))

    def _new(self, size: int, step: dict, link: int) -> int:
        self.step.append(step), self.size.append(size), self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def holder(self, s: int) -> int:
        """The state on s's suffix chain whose strings include the last `window` words."""
        while self.size[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def packed(self) -> "Packed":
        return Packed(self)


class Packed:
    """An automaton in flat arrays: steps of state s are labels[first[s]:first[s + 1]], in order, and where they lead."""

    def __init__(self, auto: Automaton):
        self.window = auto.window
        self.vocab = {w: k for k, w in enumerate(sorted({w for step in auto.step for w in step}))}
        self.first, self.labels, self.leads = array("q", [0]), array("i"), array("i")
        for step in auto.step:
            for k, t in sorted((self.vocab[w], t) for w, t in step.items()):
                self.labels.append(k), self.leads.append(t)
            self.first.append(len(self.labels))
        self.link, self.size = array("i", auto.link), array("i", auto.size)
        self.windows = {s: tuple(items) for s, items in auto.windows.items()}
        self.whole = {s: tuple(items) for s, items in auto.whole.items()}

    def _step(self, s: int, k: int) -> int:
        """Where k leads from s, or -1."""
        lo, hi = self.first[s], self.first[s + 1]
        if hi - lo > 1:
            lo = bisect_left(self.labels, k, lo, hi)
        return self.leads[lo] if lo < hi and self.labels[lo] == k else -1

    def holder(self, s: int) -> int:
        while self.size[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges that are hit, and the items that hit them."""
        step, link, size, window = self._step, self.link, self.size, self.window
        s, n = 0, 0
        found, items, whole = [], set(), self.whole
        for i, k in enumerate(map(self.vocab.get, text_words)):
            if k is None:
                s = n = 0
                continue
            t = step(s, k)
            if t < 0:
                while s and t < 0:
                    s = link[s]
                    t = step(s, k)
                n = size[s]
                if t < 0:
                    continue
            s = t
            n += 1
            if n >= window:
                found.append((i - n + 1, i + 1))
                items.update(self.windows[self.holder(s)])
            if whole:
                u = s
                while u > 0:
                    for m, item in whole.get(u, ()):
                        if m <= n:
                            found.append((i - m + 1, i + 1))
                            items.add(item)
                    u = link[u]
        if not found:
            return [], items
        return merged(found), items

    def clean(self, text: str) -> tuple[str, int, int]:
        """Text without hit passages, its words, and how many of them were hit at first."""
        data, total, first = text.encode("utf-8", "surrogatepass"), None, 0
        while True:  # what a removal brings together may be a passage again
            low = data.translate(WORD_TABLE)
            hit, _ = self.scan(low.split())
            if total is None:
                total, first = len(low.split()), sum(b - a for a, b in hit)
            if not hit:
                return data.decode("utf-8", "surrogatepass"), total, first
            data = without(data, low, hit)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap as one, in order."""
    out = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, low: bytes, hit: list[tuple[int, int]]) -> bytes:
    """data without the words in hit; low: data as words and blanks."""
    at = [m.span() for m in RUN.finditer(low)]
    kept, pos = [], 0
    for a, b in hit:
        kept.append(data[pos : at[a][0]])
        pos = at[b - 1][1]
    return b"".join([*kept, data[pos:]])


def shards(benchmark: DataFrame, window: int = WINDOW, limit: int = SHARD_WORDS) -> Iterator[Packed]:
    """Automata of at most about so many words that together hold all items; one even if there are none."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").distinct().sort("i", "text")
    some, n = [], 0
    for r in rows.toLocalIterator():
        ws = words(r.text)
        for lo in range(0, max(1, len(ws) - window + 1), limit):
            piece = ws[lo : lo + limit + window - 1]
            if some and n + len(piece) > limit + window:
                yield Automaton(some, window).packed()
                some, n = [], 0
            some.append((r.i, piece))
            n += len(piece)
    yield Automaton(some, window).packed()


def _numbered(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.struct("*").alias("doc")).withColumn("row", F.monotonically_increasing_id()), "numbered")


def _ranges(rows: DataFrame, automata: Iterator[Packed]) -> DataFrame:
    """row, ranges and items of the rows that any shard hits; rows: row, text. One shard at a time is in memory."""
    sc, parts = rows.sparkSession.sparkContext, []
    for auto in automata:
        shipped = sc.broadcast(auto)

        @F.pandas_udf("struct<ranges:array<struct<a:int,b:int>>,items:array<string>>")
        def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            auto = shipped.value  # noqa: B023
            for texts in batches:
                got = [auto.scan(words(t)) for t in texts]
                yield pd.DataFrame([([{"a": a, "b": b} for a, b in hit], sorted(items)) for hit, items in got], columns=["ranges", "items"])

        found = small_batches(rows).select("row", look.asNondeterministic()("text").alias("r")).where("size(r.ranges) > 0").select("row", "r.*")
        parts.append(materialize(found, "shard-hits"))
        shipped.unpersist()
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


SHAPE = "n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string"


def _digest(n_words: int, hit: list[tuple[int, int]], items) -> tuple:
    return n_words, sum(b - a for a, b in hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    first, *second = islice(automata := shards(benchmark, window, shard_words), 2)
    names = ["n_words", "n_hit", "n_items", "items_sha256"]
    if not second:
        shipped = docs.sparkSession.sparkContext.broadcast(first)

        @F.pandas_udf(f"struct<{SHAPE}>")
        def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            auto = shipped.value
            for texts in batches:
                yield pd.DataFrame([_digest(len(ws), *auto.scan(ws)) for ws in map(words, texts)], columns=names)

        out = small_batches(docs).select("doc_id", look("text").alias("r"))
    else:
        rows = _numbered(docs.select("doc_id", "text")).select("row", "doc.*")
        found = _ranges(rows.select("row", "text"), chain([first, *second], automata))

        @F.pandas_udf(f"struct<{SHAPE}>")
        def put(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, ranges, items in batches:
                out = [
                    _digest(len(words(t)), merged([(r["a"], r["b"]) for r in ([] if hit is None else hit)]), [] if its is None else its)
                    for t, hit, its in zip(texts, ranges, items)
                ]
                yield pd.DataFrame(out, columns=names)

        out = rows.join(found, "row", "left").select("doc_id", put("text", "ranges", "items").alias("r"))
    return out.select("doc_id", "r.*").withColumn("contaminated", F.col("n_hit") > 0)


def remove_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """docs without passages of items; documents hit in over max_coverage of their words go.
    Documents without hits are unchanged, null texts included. Columns may have any names."""
    first, *second = islice(automata := shards(benchmark, window, shard_words), 2)
    text = [F.col("new.text").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    if not second:
        shipped = docs.sparkSession.sparkContext.broadcast(first)

        @F.pandas_udf("struct<text:string,share:double>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            auto = shipped.value
            for texts in batches:
                rows = []
                for text in texts:
                    if text is None:
                        rows.append((None, 0.0))
                        continue
                    new, total, hit = auto.clean(text)
                    rows.append((new, hit / total if total else 0.0))
                yield pd.DataFrame(rows, columns=["text", "share"])
            release()

        # else the filter below would have every text cut a second time
        marked = small_batches(docs).select(F.struct("*").alias("doc"), cut.asNondeterministic()("text").alias("new"))
        return marked.where(F.col("new.share") <= max_coverage).select(*text)

    @F.pandas_udf("struct<text:string,share:double>")
    def drop(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            rows = []
            for t, hit in zip(texts, ranges):
                data = t.encode("utf-8", "surrogatepass")
                low, hit = data.translate(WORD_TABLE), merged([(r["a"], r["b"]) for r in hit])
                rows.append((without(data, low, hit).decode("utf-8", "surrogatepass"), sum(b - a for a, b in hit) / len(low.split())))
            yield pd.DataFrame(rows, columns=["text", "share"])

    rows, automata = _numbered(docs), chain([first, *second], automata)
    texts = rows.select("row", "doc.text")
    new = None  # row, text, share of hit words at first: of rows with hits
    while True:  # what a removal brings together may be a passage again
        found = materialize(_ranges(texts, automata), "hits")
        if found.isEmpty():
            break
        made = texts.join(found, "row").select("row", drop("text", "ranges").alias("r")).select("row", "r.*")
        if new is not None:
            old = new.select("row", F.col("text").alias("old"), F.col("share").alias("first"))
            made = made.join(old, "row", "full").select("row", F.coalesce("text", "old").alias("text"), F.coalesce("first", "share").alias("share"))
        new = materialize(made, "cut")
        texts = new.select("row", "text").join(found.select("row"), "row", "left_semi")
        automata = shards(benchmark, window, shard_words)
    if new is None:
        return rows.select("doc.*")
    told = rows.join(new.select("row", F.struct("text", "share").alias("new")), "row", "left")
    told = told.where(F.col("new").isNull() | (F.col("new.share") <= max_coverage))
    own = [F.when(F.col("new").isNull(), F.col("doc.text")).otherwise(F.col("new.text")).alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return told.select(*own)
