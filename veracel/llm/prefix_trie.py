"""Prefix trie of conversations, with a count-min sketch that keeps single paths out of the shuffle.

A turn is known by the MD5 of role and text, a prefix by the exclusive or of one 128-bit
hash of (place, turn) for each of its turns, so prefixes of any stretch of a conversation
can be put together from stretches of it, and a prefix and its parent differ by one hash.
A node is a group of equal (depth, prefix, parent).

1. Turns are dealt by ranges of (conversation, turn); a long conversation lies in several
   ranges, and each range adds what the ranges before it hold.
2. A count-min sketch of all prefixes: DEEP rows of at most MAX_WIDTH cells of two bits
   (none, one, more), filled by every task and merged cell by cell.  Its size does not grow
   with the input beyond that.
3. A prefix whose estimate is one occurs once, as do all that go on from it: the nodes of
   such a tail are written out where they are.  Only prefixes that may be shared are
   shuffled and grouped exactly; a full sketch sends more of them there and changes no result.
4. Sums over subtrees take no walk up the trie.  A node belongs to its smallest member, so
   the nodes of one conversation are the end of its path, and what they hold below a depth
   is a sum over that path; a node adds up the sums of its members at its depth.

Turns come by turn, null first, then by the digest of role and text (MD5 of the bytes of role, counted, ":", role, text); null role and text
are empty.  Rows without a conv_id belong to no conversation.  Repeated rows are turns of
their own.  Very long texts are hashed where they are and never shuffled; very long
conversations are worked on in ranges.  An empty table has no conversation and no node.
Columns besides conv_id, turn, role and text are not read.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DEEP = 4
MAX_WIDTH = 1 << 26  # cells of a row of the sketch: 32 MB of bits for all rows at most
MIN_WIDTH = 1 << 16
SLICE = 1 << 16  # cells that are merged at a time
EMPTY = hashlib.sha256(b"").hexdigest()
GROUP, SHARED_TURNS = 20, 4  # of rebuilt(): conversations that share a beginning, and the modulus of how many turns

Key = ("depth", "d1", "d2")


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, h1, h2 (the turn's digest) and words of each row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-1 << 63))  # noqa: E731  sorts as the digest does
    return rows.select("conv", "turn", half(1).alias("h1"), half(17).alias("h2"), "words")


def _hashes(place: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), place, "h1", "h2"), F.xxhash64(F.lit(2), place, "h2", "h1")


def _in_ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with `part`, their range, and (conv, part, n, before, total): how many rows of a conversation are in a range, before it and in all."""
    dealt = materialize(rows.repartitionByRange("conv", "turn", "h1").withColumn("part", F.spark_partition_id()), "turns")
    held = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("conv")
    return dealt, held.withColumns({"before": F.sum("n").over(w.orderBy("part")) - F.col("n"), "total": F.sum("n").over(w), "first": F.min("part").over(w)})


def _place() -> Column:
    """A row's place in its conversation, from 0."""
    return F.col("before") + F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "h1", "h2")) - 1


def _beginnings(dealt: DataFrame, held: DataFrame) -> DataFrame:
    """base, first: the first turns, SHARED_TURNS - 1 at most, of every GROUP-th conversation, with their prefixes."""
    base = (F.col("conv") % GROUP == 0) & (F.col("before") < SHARED_TURNS - 1)
    rows = dealt.join(held.where(base), ["conv", "part"]).withColumn("place", _place()).where(F.col("place") < SHARED_TURNS - 1)
    t1, t2 = _hashes(F.col("place"))
    w = Window.partitionBy("conv").orderBy("place")
    made = rows.withColumns({"t1": t1, "t2": t2}).withColumns({"d1": F.bit_xor("t1").over(w), "d2": F.bit_xor("t2").over(w)})
    return made.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "d1", "d2", "words"))).alias("first"))


def prefixes(rows: DataFrame, rebuild: bool) -> DataFrame:
    """conv, part, depth, d1, d2, p1, p2 (the parent's), words of the last turn, is_end: each prefix of each conversation, the empty one too.

    With rebuild, a conversation begins with the first h turns of the one at the start of its group of GROUP, in place of its own first h,
    where h is CRC-32 of its number modulo SHARED_TURNS."""
    dealt, held = _in_ranges(rows)
    held = materialize(held, "ranges")
    each = held.groupBy("conv").agg(F.sum("n").alias("total"), F.min("first").alias("first_part"))
    kind = "array<struct<place:bigint,t1:bigint,t2:bigint,d1:bigint,d2:bigint,words:bigint>>"
    if rebuild:
        each = each.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(_beginnings(dealt, held), "base", "left")
        h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED_TURNS
    else:
        each, h = each.withColumn("first", F.lit(None).cast(kind)), F.lit(0).cast("long")
    each = each.withColumns({"h": h, "first": F.coalesce("first", F.array().cast(kind))}).withColumn("k", F.least("h", F.size("first").cast("long")))
    last = lambda d: F.coalesce(F.get("first", F.col("k").cast("int") - 1)[d], F.lit(0).cast("long"))
    each = materialize(each.withColumns({"x1": last("d1"), "x2": last("d2"), "long": F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))}), "conversations")

    facts = held.select("conv", "part", "n", "before").join(each.select("conv", "total", "h", "k", "x1", "x2", "long"), "conv")
    own = dealt.join(facts, ["conv", "part"]).withColumn("place", _place()).where(F.col("place") >= F.col("h")).withColumn("place", F.col("place") - F.col("h") + F.col("k"))
    t1, t2 = _hashes(F.col("place"))
    w = Window.partitionBy("conv", "part").orderBy("place")
    own = own.withColumns({"t1": t1, "t2": t2}).withColumns({"d1": F.bit_xor("t1").over(w).bitwiseXOR(F.col("x1")), "d2": F.bit_xor("t2").over(w).bitwiseXOR(F.col("x2"))})
    own = materialize(own.select("conv", "part", (F.col("place") + 1).alias("depth"), "d1", "d2", "t1", "t2", "words", (F.col("place") + 1 == F.col("long")).alias("is_end"), (F.col("n") < F.col("total")).alias("spans")), "own-prefixes")
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = own.where("spans").groupBy("conv", "part").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = spans.select("conv", "part", F.bit_xor("s1").over(w).alias("b1"), F.bit_xor("s2").over(w).alias("b2"))  # two rows a range at most
    own = own.join(F.broadcast(before), ["conv", "part"], "left")
    xor = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(F.col(b), F.lit(0)))
    own = own.withColumns({"d1": xor("d1", "b1"), "d2": xor("d2", "b2")}).select("conv", "part", "depth", "d1", "d2", xor("d1", "t1").alias("p1"), xor("d2", "t2").alias("p2"), "words", "is_end")
    lent = each.select("conv", F.col("first_part").alias("part"), "long", F.explode(F.slice("first", F.lit(1), F.col("k").cast("int"))).alias("f")).select(
        "conv", "part", (F.col("f.place") + 1).alias("depth"), "f.d1", "f.d2", F.col("f.d1").bitwiseXOR(F.col("f.t1")).alias("p1"), F.col("f.d2").bitwiseXOR(F.col("f.t2")).alias("p2"), "f.words", (F.col("f.place") + 1 == F.col("long")).alias("is_end")
    )
    zero = F.lit(0).cast("long")
    root = each.select("conv", F.col("first_part").alias("part"), zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("words"), (F.col("long") == 0).alias("is_end"))
    return root.unionByName(lent).unionByName(own)


def cells(d1: np.ndarray, d2: np.ndarray, width: int) -> np.ndarray:
    """The cells of each prefix, one in each row of the sketch, over all rows laid end to end."""
    a, b = d1.view(np.uint64), d2.view(np.uint64) | np.uint64(1)
    return np.stack([((a + np.uint64(r) * b) >> np.uint64(7) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(DEEP)])


def _packed(ones: np.ndarray, more: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(ones).tobytes() + np.packbits(more).tobytes(), 1)


def _planes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), np.uint8)
    return both[: len(both) // 2], both[len(both) // 2 :]


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Bits of the cells that more than one of the rows' prefixes (d1, d2) fell into."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones, more = np.zeros(DEEP * width, bool), np.zeros(DEEP * width, bool)
        for b in batches:
            for at in cells(b["d1"].to_numpy(), b["d2"].to_numpy(), width):
                seen, n = np.unique(at, return_counts=True)
                more[seen] |= ones[seen] | (n > 1)
                ones[seen] = True
        for k in range(DEEP * width // SLICE):
            s = slice(k * SLICE, (k + 1) * SLICE)
            if ones[s].any():
                yield pd.DataFrame({"slice": [k], "planes": [_packed(ones[s], more[s])]})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = more = np.zeros(SLICE // 8, np.uint8)
        for b in batches:
            for data in b.column("planes").to_pylist():
                o, m = _planes(data)
                ones, more = ones | o, more | m | (ones & o)
        yield pa.RecordBatch.from_pydict({"slice": [key[0].as_py()], "more": [more.tobytes()]})

    parts = rows.select("d1", "d2").mapInPandas(count, "slice long, planes binary")
    out = np.zeros(DEEP * width // 8, np.uint8)
    for r in parts.groupBy("slice").applyInArrow(merge, "slice long, more binary").collect():  # as large as the sketch
        out[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["more"], np.uint8)
    return out


def width_for(rows: int) -> int:
    """Cells of a row of the sketch: eight for each prefix, within bounds."""
    return min(MAX_WIDTH, max(MIN_WIDTH, 1 << (8 * max(1, rows) - 1).bit_length()))


def screened(rows: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """rows with `single` and `parent_single`: whether the sketch proves that the prefix, and its parent, occurs once."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def alone(d1: pd.Series, d2: pd.Series) -> pd.Series:
        at = cells(d1.to_numpy(np.int64), d2.to_numpy(np.int64), width)
        more = shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
        return pd.Series(~more.all(0).astype(bool))

    zero = F.lit(0).cast("long")
    own, above = alone("d1", "d2"), alone(F.coalesce("p1", zero), F.coalesce("p2", zero))
    return rows.withColumns({"single": own & (F.col("depth") > 0), "parent_single": above & (F.col("depth") > 1)})


def end_digests(ends: DataFrame) -> DataFrame:
    """Key, ends_sha256: SHA-256 of the numbers of the conversations that end at a node, ascending, joined by commas.

    Numbers are joined within ranges of them; a node's pieces then pass through a task in order and none are gathered."""
    pieces = ends.repartitionByRange("conv").withColumn("piece", F.spark_partition_id()).groupBy("piece", *Key).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("numbers")
    )
    kinds = "depth long, d1 long, d2 long, ends_sha256 string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for b in batches:
            done = []
            for *key, numbers in zip(*[b[k].tolist() for k in Key], b["numbers"]):
                if key != now:
                    if h is not None:
                        done.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256(numbers.encode())
                else:
                    h.update(f",{numbers}".encode())
            yield pd.DataFrame(done, columns=[*Key, "ends_sha256"])
        if h is not None:
            yield pd.DataFrame([(*now, h.hexdigest())], columns=[*Key, "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, *Key).sortWithinPartitions(*Key, "piece").mapInPandas(fold, kinds)


def _below(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Key, n_leaves, saved_tokens.  held: conv, depth, leaf, saved: what a conversation's path holds at a depth.

    Each path is summed from its end, in ranges; of conversations in several ranges each adds what the ranges after it hold."""
    met = rows.select("conv", "part", *Key).join(held, ["conv", "depth"], "left").fillna(0, ["leaf", "saved"])
    w = Window.partitionBy("conv", "part").orderBy(F.desc("depth"))
    met = materialize(met.withColumns({"l": F.sum("leaf").over(w), "s": F.sum("saved").over(w)}), "paths")
    sums = met.groupBy("conv", "part").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    many = Window.partitionBy("conv")
    after = many.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.withColumn("parts", F.count(F.lit(1)).over(many)).where("parts > 1").select("conv", "part", F.sum("l").over(after).alias("al"), F.sum("s").over(after).alias("as"))
    met = met.join(F.broadcast(later), ["conv", "part"], "left")  # two rows a range at most
    add = lambda a, b: F.sum(F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return met.groupBy(*Key).agg(add("l", "al").alias("n_leaves"), add("s", "as").alias("saved_tokens"))


def trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = materialize(prefixes(turns(conversations), rebuild), "prefixes")
    width = width_for(found.count())
    seen = materialize(screened(found, sketch(found.where("depth > 0"), width), width), "screened")
    alone = F.col("single") | F.col("parent_single")
    tails, rows = seen.where(alone), seen.where(~alone)
    tops = tails.where("not parent_single")  # a tail's first node, below one that may be shared

    nodes = materialize(rows.groupBy(*Key, "p1", "p2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("is_end").alias("n_ends"), F.max("words").alias("words"),
    ), "nodes")
    at = lambda df: df.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    below = at(nodes.where("depth > 0")).unionByName(at(tops)).groupBy(*Key).agg(F.count(F.lit(1)).alias("n_children"))

    leaf = nodes.where("n_ends = n_convs").select(F.col("conv_id").alias("conv"), "depth", F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    top = tops.select("conv", (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    own = nodes.where("n_convs > 1 and words > 0").select(F.col("conv_id").alias("conv"), "depth", F.lit(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    held = leaf.unionByName(top).unionByName(own).groupBy("conv", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))

    sums = _below(rows, held)
    ends = end_digests(rows.where("is_end").select("conv", *Key))
    above = nodes.select(F.col("depth").alias("pd"), F.col("d1").alias("q1"), F.col("d2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    parent = (F.col("depth") - 1 == F.col("pd")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2"))
    shared = nodes.join(below, [*Key], "left").join(sums, [*Key], "left").join(ends, [*Key], "left").join(above, parent, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    lone = lambda df, up: df.select(
        F.col("conv").alias("conv_id"), "depth", up.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("is_end"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(F.col("is_end"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    return shared.unionByName(lone(tails.where("parent_single"), F.col("conv"))).unionByName(lone(tops.join(above, parent, "left"), F.col("parent_conv_id")))
