"""Byte-level BPE by reduction over a tree of text halves.

Both levels are monoids: what a stretch of text encodes to, joined with what its
right neighbour encodes to, is what the two encode to together.

* **Bytes of a piece.**  A piece is encoded in halves.  A sequence of tokens is the
  encoding of its bytes exactly if every two neighbours are the encoding of theirs:
  a merge across a border would come up in those two tokens alone, at the same place in
  the order of ranks.  So where two halves meet, the window of the two tokens there is
  encoded anew and grows, to the left and to the right, until the pairs at both its
  edges hold; then all tokens outside stand.
* **Pieces of a text.**  A text is cut into pieces in halves too.  What the cutting
  pattern does from a place on depends on the text from there on alone, and on no more
  than the piece, one character after it and the REACH characters of a contraction.  So
  the pieces that the end of the left half may have cut short are cut anew, in a window
  that grows into the right half until a cut falls on one of that half.

A piece that is a token itself is that token.  Decoding joins the bytes of tokens up the
tree.  Pieces seen before are kept in two generations, bounded by bytes.

Null and empty texts have no ids.  Repeated rows and rows of one doc_id are encoded one
by one, ties do not arise, and an empty table gives an empty result.  Very long texts and
long pieces without a cut take time and memory in proportion to their length.  Columns
besides doc_id and text are not read.
"""

import functools
import hashlib
import struct
from base64 import b64decode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

LEAF_BYTES = 7  # shorter stretches of a piece are merged at once
LEAF_CHARS = 4096  # shorter texts are cut at once
LEAF_IDS = 4096
WINDOW = 64  # characters of the right half that a window starts with
REACH = 3  # characters that a contraction looks at
KEPT_BYTES = 96 << 20  # of pieces kept, in each of two generations
KEPT_PAIRS = 500_000
KEPT_STRETCHES = 300_000, 16  # stretches whose ids are kept, and their bytes at most
LONGEST_KEPT = 200  # characters of a piece that is kept

NONE = 1 << 60
PACK = [struct.Struct(f"<{n}I").pack for n in range(20)]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Kept(dict):
    """Ids of pieces as bytes; those of the generation before are looked at, else `make` is asked."""

    def __init__(self, make, old: dict):
        self.make, self.old, self.held = make, old, 0

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = got
            self.held += 160 + len(piece) + len(got)
        return got


class Coder:
    """Ids of whole texts and texts of ids, by the ranks of a file and a pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for b, r in self.ranks.items():
            self.bytes_of[r] = b
        self.cut = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stretches: dict[bytes, tuple[int, ...]] = {}
        self.kept = Kept(self._piece, {})

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of a few bytes, kept for the next time."""
        ids = self.stretches.get(data)
        if ids is None:
            ids = self._merge(data)
            if len(data) <= KEPT_STRETCHES[1]:
                self.stretches[data] = ids
        return ids

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Of the neighbours with the least rank, the leftmost are merged until none has a rank."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NONE)
        return tuple([self.ranks[p] for p in parts])

    def holds(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours from their own, which are changed."""
        at = 0  # how many tokens of the right have gone into a window
        while at < len(right) and left and not self.holds(left[-1], right[at]):
            window, take = self.bytes_of[right[at]], 1
            at += 1
            while True:
                window = b"".join(map(self.bytes_of.__getitem__, left[-take:])) + window
                del left[-take:]
                ids = self.merge(window)
                if not left or self.holds(left[-1], ids[0]):
                    break
                take = min(2 * take, len(left))
            left += ids
        left += right[at:] if at else right
        return left

    def encode_bytes(self, data: bytes) -> list[int]:
        n = len(data)
        if n <= LEAF_BYTES:
            return [*(self.stretches.get(data) or self.merge(data))]
        left, right = self.encode_bytes(data[: n // 2]), self.encode_bytes(data[n // 2 :])
        if self.pairs.get((left[-1], right[0])):
            left += right
            return left
        return self.join(left, right)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.encode_bytes(data)
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _cut_again(self, text: str, begin: int, border: int, end: int, pieces: list[str]) -> tuple[list[str], int]:
        """Pieces from begin on, cut anew, up to the first place where one of `pieces`, those of text[border:end], begins; and which one."""
        width = WINDOW
        while True:
            stop = min(border + width, end)
            fresh, at, k, where = [], begin, 0, border
            for p in self.cut(text[begin:stop]):
                if stop < end and (at + len(p) >= stop or at + REACH > stop):
                    break  # the end of the window may have cut it short
                fresh.append(p)
                at += len(p)
                while where < at and k < len(pieces):
                    where += len(pieces[k])
                    k += 1
                if where == at:
                    return fresh, k
            width *= 4

    def pieces(self, text: str, begin: int, end: int) -> list[str]:
        """The pieces that the pattern cuts text[begin:end] into."""
        if end - begin <= LEAF_CHARS:
            return self.cut(text[begin:end])
        border = (begin + end) // 2
        left, right = self.pieces(text, begin, border), self.pieces(text, border, end)
        at = border
        while left:  # what the border may have cut short
            if at < border and at - len(left[-1]) + REACH <= border:
                break
            at -= len(left.pop())
        fresh, k = self._cut_again(text, at, border, end, right)
        left += fresh
        left += right[k:]
        return left

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        ids = b"".join(map(self.kept.__getitem__, self.pieces(text, 0, len(text))))
        if self.kept.held > KEPT_BYTES:
            self.kept = Kept(self._piece, dict(self.kept))
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        if len(self.stretches) > KEPT_STRETCHES[0]:
            self.stretches.clear()
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    """One for each Python worker."""
    return Coder(path, pattern)


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each whole text."""
    given = ranks or default_ranks(), pattern or default_pattern()

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = coder(*given)
        for texts in batches:
            yield pd.Series([of.encode(t) for t in texts], dtype=object)
            release()

    return small_batches(docs).select("doc_id", ids("text").alias("ids"))


def decode_documents(coded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes that the ids of encode_documents stand for; null ids are none."""
    given = ranks or default_ranks(), pattern or default_pattern()

    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = coder(*given)
        for rows in batches:
            yield pd.Series([of.decode(np.frombuffer(r or b"", "<u4")) for r in rows], dtype=object)
            release()

    return small_batches(coded).select("doc_id", data("ids").alias("data"))


def coded_digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, number and SHA-256 of its ids, and SHA-256 of the bytes that they decode to; ids do not leave the task."""
    given = ranks or default_ranks(), pattern or default_pattern()

    @F.pandas_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = coder(*given)
        for texts in batches:
            rows = []
            for t in texts:
                ids = of.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(of.decode(np.frombuffer(ids, "<u4"))).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    return small_batches(docs).select("doc_id", look("text").alias("r")).select("doc_id", "r.*")
