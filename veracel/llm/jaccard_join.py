"""Near duplicates: a self-join on the Jaccard similarity of word n-grams.

Documents with one set of n-grams form a copy class, known by a 128-bit digest of
the set; one text stands for each.  A MinHash LSH forest finds candidates: every
tree is a sorted prefix trie of the signatures, in which a text is a path of minimum
hashes.  Each text starts with its whole path in every tree and shortens it, tree by
tree and level by level, until its own estimate of the recall reaches the target
(see stops).  A node where some text's shortened path ends is cut: all texts below
it meet there, and each text meets others once in a tree, at the highest cut above
its own end.  The estimate of a text rests on its own n-grams, never on the links
found or on other texts, so no group of copies changes which other pairs are found.
With exact=True texts meet in the n-grams of
their prefix filter instead (the |s| - ceil(threshold |s|) + 1 least hashes, of which
a linked pair shares one), which misses nothing and costs more.

Texts that meet are compared exactly.  The members of a meeting point (a node) are
dealt into blocks bounded by bytes and rows; a block is compared within and packed
into one row, and where a node has several blocks the packed rows meet in tiles of
TILE by TILE.  So rows grow with the members, and bytes with members times blocks / TILE.  A comparison gives each
text's number of links and a spanning forest of them, never the pairs; a pair counts
in the least node where it meets.  Of nodes with the same members one is compared.
Classes are the connected components, found by spreading the least digest with
tables between rounds.

Texts of fewer than n words have one n-gram, all their words; texts without words,
null ones included, form one class.  Every row gets its own result, by its text: ids
may be null or repeated, and rows of one id with different texts are different
documents.  class_id and rep_id are the least id of the class and of the copy class
(null where no row there has an id); class_key tells classes apart in any case.
Only doc_id and text are read, so other columns cannot clash.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.network import components
from .common import bounded, materialize, one_each, release, small_batches, text_key, words

NGRAM = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
SLACK = 1  # levels that a text may go beyond the depth that suffices on average
BLOCK = 1024  # texts of a block
BLOCK_BYTES = 2 << 20  # of n-gram hashes in a block, about
TILE = 4  # blocks on each side of a comparison across blocks
CACHE_WORDS = 100_000
PAIRS = 1 << 21  # pairs listed at a time

M64 = (1 << 64) - 1


class _WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_hashes = _WordHashes()


def forget() -> None:
    """Free what a task leaves in its worker."""
    _hashes.clear()
    release()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    k = max(1, len(h) - n + 1)
    out = np.full(k, len(h[:n]), np.uint64)
    for i in range(min(n, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + k])
    return np.unique(out)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, M64, count, np.uint64, endpoint=True) | np.uint64(1), rng.integers(0, M64, count, np.uint64, endpoint=True)


def signature(s: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minimum hash of a set under each permutation, and the member that has it."""
    out, who = np.full(len(perms[0]), M64, np.uint64), np.zeros(len(perms[0]), np.uint64)
    for lo in range(0, len(s), 4096):  # bounded memory for long texts
        part = s[lo : lo + 4096]
        for i in range(0, len(out), 32):
            got = part[None, :] * perms[0][i : i + 32, None] + perms[1][i : i + 32, None]
            got ^= got >> np.uint64(31)
            at = got.argmin(axis=1)
            least = got[np.arange(len(at)), at]
            new = least <= out[i : i + 32]
            out[i : i + 32][new], who[i : i + 32][new] = least[new], part[at][new]
    return out, who


def recall_at(depth: int, trees: int = TREES, threshold: float = THRESHOLD) -> float:
    """Chance that a pair at the threshold shares a prefix of this depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Shorten the prefix from the full depth until the recall is met."""
    while depth > 1 and recall_at(depth, trees, threshold) < recall:
        depth -= 1
    return depth


def chances(sizes: np.ndarray, least: np.ndarray, who: np.ndarray, threshold: float) -> np.ndarray:
    """Estimated chance that a text and one as far from it as the threshold allows share each prefix.

    least, who: signatures, texts x trees x depth.  The other text lacks some of the n-grams, has others more, or
    both; of the three cases (first axis) each that the size allows counts.  A prefix is shared if none of the
    n-grams on it (each counted once) is lacking and no other one hashes below them.  In bins of higher similarity
    all three chances are higher, so a target met here is met in every bin."""
    n = sizes.astype(float)
    keep = np.ceil(np.stack([threshold * n, n, 2 * threshold / (1 + threshold) * n]) - 1e-9)
    more = np.stack([np.zeros_like(n), np.floor(n / threshold - n + 1e-9), n - keep[2]])
    depth = least.shape[2]
    seen = np.zeros(least.shape, np.int64)
    for d in range(depth):
        seen[:, :, d] = (seen[:, :, d - 1] if d else 0) + ~(who[:, :, :d] == who[:, :, d : d + 1]).any(axis=2)
    left = np.arange(depth)
    held = np.cumprod(np.maximum(keep[:, :, None] - left, 0) / np.maximum(n[None, :, None] - left, 1), axis=2)  # of k + 1 n-grams
    above = np.cumsum(np.log1p(-np.minimum(least.astype(float) / 2.0**64, 1 - 1e-9)), axis=2)
    rows = np.arange(len(n))[:, None, None]
    return np.stack([held[c][rows, seen - 1] * np.exp(more[c][:, None, None] * above) for c in range(3)])


def stops(chance: np.ndarray, recall: float, floor: int) -> np.ndarray:
    """Depth at which each text's path ends in each tree: shortened until the estimate reaches the recall, or the floor."""
    missed = np.log1p(-np.minimum(chance, 1 - 1e-12))  # case, text, tree, depth
    cases, texts, trees, depth = missed.shape
    total, met = missed[..., -1].sum(axis=2), np.zeros(texts, bool)
    out = np.full((texts, trees), depth)
    met |= (total <= math.log(1 - recall)).all(axis=0)
    for d in range(depth - 1, floor - 1, -1):
        for t in range(trees):
            total = total + np.where(met, 0, missed[:, :, t, d - 1] - missed[:, :, t, d])
            out[~met, t] = d
            met |= (total <= math.log(1 - recall)).all(axis=0)
    return out


def paths(sets: list[np.ndarray], perms: tuple[np.ndarray, np.ndarray], trees: int, threshold: float, recall: float, floor: int) -> list[list[np.ndarray]]:
    """Of each set its nodes in every tree, from the floor to where its path ends: hashes of the tree's number and the prefix."""
    if not sets:
        return []
    signed = [signature(s, perms) for s in sets]
    least, who = (np.stack(x).reshape(len(sets), trees, -1) for x in zip(*signed))
    ends = stops(chances(np.array([len(s) for s in sets]), least, who, threshold), recall, floor)
    nodes = np.empty(least.shape, np.uint64)
    node = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), least.shape[:2])
    for d in range(least.shape[2]):
        node = nodes[:, :, d] = _mix(node * np.uint64(0x9E3779B97F4A7C15) + least[:, :, d])
    nodes = nodes.view(np.int64)
    return [[path[floor - 1 : end] for path, end in zip(of, e.tolist())] for of, e in zip(nodes, ends)]


def prefix_nodes(s: np.ndarray, threshold: float) -> np.ndarray:
    """The least hashes of a set, of which sets similar by the threshold share at least one."""
    return s[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]


def sign(docs: DataFrame, n: int, threshold: float, trees: int, exact: bool) -> DataFrame:
    """doc_id, tkey (digest of the text), copy (digest of its n-gram set), size of the set, paths (nodes by tree; of exact ones, one by one)."""
    floor = max(1, prefix_depth(trees, threshold=threshold) - SLACK)

    @F.pandas_udf("struct<copy:binary,size:int,paths:array<array<bigint>>>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        perms = _permutations(trees * DEPTH)
        for texts in batches:
            sets = [shingles(t, n) for t in texts]
            some = [s for s in sets if len(s)]
            if exact:
                got = iter([list(prefix_nodes(s, threshold).view(np.int64)[:, None]) for s in some])
            else:
                got = iter(paths(some, perms, trees, threshold, RECALL, floor))
            rows = [(xxhash.xxh128_digest(s.tobytes()), len(s), next(got) if len(s) else []) for s in sets]
            yield pd.DataFrame(rows, columns=["copy", "size", "paths"])
        forget()

    return small_batches(docs).select("doc_id", text_key("text").alias("tkey"), signed("text").alias("r")).select("doc_id", "tkey", "r.*")


def meeting_nodes(reps: DataFrame) -> DataFrame:
    """reps (id, paths) that meet others, with keys: the node where each meets others in every tree.

    A node is cut where a path ends, if another text is below it; of the cuts on a path the highest counts."""
    at = reps.select("id", F.posexplode("paths").alias("tree", "path")).select("id", "tree", F.size("path").alias("end"), F.posexplode("path").alias("depth", "node"))
    cut = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("depth") == F.col("end") - 1).alias("ends")).where("n > 1 and ends")
    cut = bounded(materialize(cut.select("node"), "cuts"))
    tops = at.join(cut, "node").groupBy("id").agg(F.collect_list(F.struct("tree", "depth", "node")).alias("cuts"))  # as many as the text has nodes

    def key(path: Column, tree: Column) -> Column:
        return F.coalesce(F.array_min(F.filter("cuts", lambda c: c["tree"] == tree))["node"], F.element_at(path, -1))

    return reps.join(tops, "id").withColumn("keys", F.transform("paths", key)).drop("cuts", "paths")


class Block:
    """Texts that are compared together: ids (16 bytes each), n-gram sets, nodes and rows of their copy classes."""

    FIELDS = ("ids", "sizes", "grams", "widths", "keys", "copies")

    def __init__(self, ids: list[bytes], sets: list[np.ndarray], keys: list[np.ndarray], copies: np.ndarray):
        self.ids, self.sets, self.keys, self.copies = ids, sets, keys, copies
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def packed(self) -> tuple[bytes, ...]:
        widths = np.array([len(k) for k in self.keys], np.int64)
        return (
            b"".join(self.ids), self.sizes.tobytes(), np.concatenate(self.sets).tobytes(), widths.tobytes(),
            np.concatenate(self.keys).tobytes(), self.copies.tobytes(),
        )

    @classmethod
    def unpack(cls, row) -> "Block":
        sizes, widths = np.frombuffer(row.sizes, np.int64), np.frombuffer(row.widths, np.int64)
        sets = np.split(np.frombuffer(row.grams, np.uint64), np.cumsum(sizes)[:-1])
        keys = np.split(np.frombuffer(row.keys, np.int64), np.cumsum(widths)[:-1])
        return cls([row.ids[i : i + 16] for i in range(0, len(row.ids), 16)], sets, keys, np.frombuffer(row.copies, np.int64))


def overlaps(x: Block, y: Block) -> np.ndarray:
    """How many n-grams each text of x shares with each of y.

    Of n-grams that few texts have the pairs are counted; the others go through a product of matrices."""
    nx, ny = len(x.sets), len(y.sets)
    values, at = np.unique(np.concatenate(x.sets + y.sets), return_inverse=True)
    cut = int(x.sizes.sum())
    ac, bc = at[:cut], at[cut:]
    ar, br = np.repeat(np.arange(nx), x.sizes), np.repeat(np.arange(ny), y.sizes)
    na, nb = np.bincount(ac, minlength=len(values)), np.bincount(bc, minlength=len(values))
    order = np.argsort(bc, kind="stable")
    br, start = br[order], np.cumsum(nb) - nb
    rare = na * nb <= max(nx * ny // 256, 1)
    counts = np.zeros(nx * ny, np.int64)
    few = rare[ac] & (nb[ac] > 0)
    rows, cols = ar[few], ac[few]
    steps = np.cumsum(nb[cols])
    lo = 0
    while lo < len(cols):
        done = int(steps[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(steps, done + PAIRS, "right")))
        k = nb[cols[lo:hi]]
        within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        right = br[np.repeat(start[cols[lo:hi]], k) + within]
        counts += np.bincount(np.repeat(rows[lo:hi], k) * ny + right, minlength=nx * ny)
        lo = hi
    counts = counts.reshape(nx, ny)
    many = np.flatnonzero(~rare & (na > 0) & (nb > 0))
    if len(many):
        place = np.full(len(values), -1)
        place[many] = np.arange(len(many))
        bc = bc[order]
        pa, pb = place[ac], place[bc]
        for lo in range(0, len(many), 1024):
            ma, mb = np.zeros((nx, 1024), np.float32), np.zeros((ny, 1024), np.float32)
            a, b = (pa >= lo) & (pa < lo + 1024), (pb >= lo) & (pb < lo + 1024)
            ma[ar[a], pa[a] - lo] = 1
            mb[br[b], pb[b] - lo] = 1
            counts += (ma @ mb.T).astype(np.int64)
    return counts


def first_met(x: Block, y: Block, i: np.ndarray, j: np.ndarray, node: int, exact: bool) -> np.ndarray:
    """Whether node is the least node that the texts of each pair share."""
    if exact:  # nodes are a set; in a forest there is one of every tree
        return np.array([np.intersect1d(x.keys[a], y.keys[b])[0] == node for a, b in zip(i.tolist(), j.tolist())], bool)
    kx, ky = np.stack(x.keys), np.stack(y.keys)
    first = np.ones(len(i), bool)
    for t in range(kx.shape[1]):
        a = kx[i, t]
        first &= (a != ky[j, t]) | (a >= node)
    return first


def forest(ids: list[bytes], near: np.ndarray) -> dict[bytes, bytes]:
    """Of each linked text but the least of its part: that least one. near: symmetric."""
    left, root = near.any(axis=1), {}
    for r in np.argsort(np.array(ids)).tolist():
        if not left[r]:
            continue
        left[r] = False
        front = np.array([r])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            root.update((ids[v], ids[r]) for v in front.tolist())
    return root


def compare(x: Block, y: Block | None, node: int, threshold: float, exact: bool = False) -> list[tuple]:
    """(id, root, n_links, n_linked_docs) of the linked texts of one block, or of pairs across two."""
    other = y or x
    both = overlaps(x, other)
    i, j = np.nonzero(both)
    if y is None:
        i, j = i[i < j], j[i < j]
    shared = both[i, j]
    near = shared / (x.sizes[i] + other.sizes[j] - shared) >= threshold
    i, j = i[near], j[near]
    if not len(i):
        return []
    new = first_met(x, other, i, j, node, exact)
    at = len(x.ids) if y else 0
    ids, copies = (x.ids + y.ids, np.concatenate([x.copies, y.copies])) if y else (x.ids, x.copies)
    square = np.zeros((len(ids), len(ids)), bool)
    square[i, j + at] = square[j + at, i] = True
    roots = forest(ids, square)
    a, b = np.concatenate([i[new], j[new] + at]), np.concatenate([j[new] + at, i[new]])
    count = np.bincount(a, minlength=len(ids))
    docs = np.bincount(a, weights=copies[b].astype(float), minlength=len(ids)).astype(np.int64)
    return [(v, roots.get(v), c, d) for v, c, d in zip(ids, count.tolist(), docs.tolist()) if c or v in roots]


FOUND = "id binary, root binary, n_links long, n_linked_docs long"
PACKED = ", ".join(f"{c} binary" for c in Block.FIELDS)


def _node_plan(reps: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """key and number of blocks of the nodes to compare: those of two texts or more, of several with the same members the least."""
    met = reps.select("id", "size", F.explode("keys").alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    ).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("grams") * 8 / block_bytes)).cast("int")
    return met.groupBy("n", "grams", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).select("key", blocks.alias("nb"))


def _within(members: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """Results within each block (id is given), and the blocks of nodes with several, packed (id is null)."""
    names = ["id", "root", "n_links", "n_linked_docs", "key", "own", "nb", *Block.FIELDS]

    def block_of(rows: list) -> Block:
        return Block(
            [bytes(r.id) for r in rows], [np.frombuffer(r.grams, np.uint64) for r in rows], [r.keys for r in rows], np.array([r.copies for r in rows], np.int64)
        )

    def results(rows: list) -> tuple[list, pd.DataFrame | None]:
        first, b = rows[0], block_of(rows)
        out = [(*r, first.key, first.own, first.nb, *[None] * 6) for r in compare(b, None, first.key, threshold, exact)] if len(rows) > 1 else []
        packed = pd.DataFrame([(None, None, 0, 0, first.key, first.own, first.nb, *b.packed())], columns=names) if first.nb > 1 else None
        return out, packed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, at, out = [], None, []
        for b in batches:
            for row in b.itertuples(index=False):
                here = (row.key, row.own)
                if here != at and rows:
                    got, packed = results(rows)
                    out += got
                    if packed is not None:
                        yield packed
                    rows = []
                at = here
                rows.append(row)
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if rows:
            got, packed = results(rows)
            out += got
            if packed is not None:
                yield packed
        if out:
            yield pd.DataFrame(out, columns=names)
        release()

    dealt = members.repartition("key", "own").sortWithinPartitions("key", "own", "id")
    return dealt.mapInPandas(run, f"{FOUND}, key long, own int, nb int, {PACKED}")


def _across(blocks: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """Results of each pair of blocks of one node.

    Blocks meet in tiles of TILE by TILE, so a block is sent once for every TILE others."""
    tile = (F.col("own") / TILE).cast("int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(rows.itertuples(index=False), key=lambda r: r.own)
        out = []
        for i, x in enumerate(rows):
            for y in rows[i + 1 :]:
                if x.x == x.y or x.own // TILE != y.own // TILE:  # pairs of one tile meet in the task of that tile alone
                    out += compare(Block.unpack(x), Block.unpack(y), x.key, threshold, exact)
        release()
        return pd.DataFrame(out, columns=["id", "root", "n_links", "n_linked_docs"])

    others = F.sequence(F.lit(0), ((F.col("nb") - 1) / TILE).cast("int"))
    spread = blocks.withColumn("other", F.explode(others)).withColumns({"x": F.least(tile, "other"), "y": F.greatest(tile, "other")})
    return spread.select("key", "x", "y", "own", *Block.FIELDS).groupBy("key", "x", "y").applyInPandas(run, FOUND)


def links(docs: DataFrame, reps: DataFrame, threshold: float, n: int, exact: bool, block: int, block_bytes: int) -> DataFrame:
    """id, root (a linked text or null), n_links, n_linked_docs: partial results per text and block.

    reps: id, row (doc_id and tkey of a text), size, paths, copies."""
    reps = materialize(reps.withColumn("keys", F.flatten("paths")).drop("paths") if exact else meeting_nodes(reps), "meeting")
    plan = _node_plan(reps, block, block_bytes)
    own = F.pmod(F.xxhash64("id", "key"), F.col("nb")).cast("int").alias("own")
    places = reps.select("id", F.explode("keys").alias("key")).join(plan, "key").select("id", F.struct("key", own, "nb").alias("at"))
    met = places.groupBy("id").agg(F.collect_list("at").alias("nodes"))  # as many as the text has nodes
    wanted = materialize(met.join(reps.select("id", "row", "keys", "copies"), "id"), "candidates")

    @F.pandas_udf("binary")
    def set_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, n).tobytes() for t in texts])
        forget()

    row = wanted.select(F.col("row.doc_id").alias("their_id"), F.col("row.tkey").alias("their_key"))
    same = F.col("doc_id").eqNullSafe(F.col("their_id")) & (F.col("tkey") == F.col("their_key"))
    texts = docs.select("doc_id", text_key("text").alias("tkey"), "text").join(bounded(row), same, "left_semi")
    grams = texts.select("tkey", set_of("text").alias("grams")).dropDuplicates(["tkey"])  # of equal texts: the same
    sets = grams.join(wanted.withColumn("tkey", F.col("row.tkey")), "tkey")
    members = sets.select("id", "grams", "keys", "copies", F.inline("nodes"))
    found = materialize(_within(members, threshold, exact), "compared")
    across = materialize(_across(found.where("id is null"), threshold, exact), "compared-blocks")
    return found.where("id is not null").select(*across.columns).unionByName(across)


def _linked(docs: DataFrame, threshold: float, n: int, trees: int, exact: bool, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tkey, copy), and facts of the copy classes of two rows or more or with links."""
    signed = materialize(sign(docs, n, threshold, trees, exact), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    reps = materialize(
        signed.groupBy(F.col("copy").alias("id")).agg(
            F.min(row).alias("row"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"),
            F.first("size").alias("size"), F.first("paths").alias("paths"),  # alike in all rows of the class
        ), "reps",
    )
    found = links(docs, reps, threshold, n, exact, block, block_bytes)
    sums = found.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("linked"))
    facts = reps.select("id", "rep_id", "copies").join(sums, "id", "left").where("copies > 1 or n_links is not null")
    facts = materialize(facts.join(components(found), "id", "left").withColumn("class_key", F.coalesce("class_id", "id")).drop("class_id"), "facts")
    least = facts.groupBy("class_key").agg(F.min("rep_id").alias("class_id"))
    facts = facts.join(least, "class_key").select(
        F.col("id").alias("copy"), "class_key", "class_id", "rep_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_linked_docs"),
    )
    return signed.select("doc_id", "tkey", "copy"), materialize(facts, "class-facts")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, trees: int = TREES, exact: bool = False, block: int = BLOCK, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, class_id (least doc_id of its component), rep_id (of its copy class), n_links (texts linked to it),
    n_linked_docs (documents linked to it, copies included), class_key of every row."""
    rows, facts = _linked(docs, threshold, n, trees, exact, block, block_bytes)
    out = rows.join(bounded(facts), "copy", "left")
    alone = F.col("class_key").isNull()

    def known(c: str, otherwise: Column) -> Column:
        return F.when(alone, otherwise).otherwise(F.col(c)).alias(c)

    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", known("class_id", F.col("doc_id")), known("rep_id", F.col("doc_id")), known("n_links", zero), known("n_linked_docs", zero),
        F.lower(F.hex(F.coalesce("class_key", "copy"))).alias("class_key"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """docs with one document of each class of near duplicates: that of the least doc_id (nulls last, ties by the digest of the text).

    Rows go by doc_id and text; of rows alike in both that with the least JSON text stays."""
    rows, facts = _linked(docs, threshold, NGRAM, TREES, exact, BLOCK, BLOCK_BYTES)
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    many = rows.join(bounded(facts.select("copy", "class_key")), "copy").groupBy("class_key", member.alias("row")).count()
    many = materialize(many, "class-rows")
    stays = many.groupBy("class_key").agg(F.min("row").alias("best"))
    judged = materialize(many.join(bounded(stays), "class_key").select("row.doc_id", "row.tkey", "count", (F.col("row") == F.col("best")).alias("kept")), "judged")
    return one_each(docs, judged)
