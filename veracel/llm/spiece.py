"""SentencePiece models on the tokenizers library.

The model file is a protocol buffer; the few fields that matter are read here and
rebuilt as a tokenizers pipeline: the normaliser (its compiled character map, if
any, and the blank marker), the marker put before the text, the model (unigram
scores, or merges in the order of their scores) and byte fallback.

Merges never cross into a blank marker when no piece has one after another
character (checked), so a text is cut before its markers; workers encode each
distinct cut once, in multithreaded batches, check it against the sentencepiece library and decode it again.
Other models encode and decode whole texts, in multithreaded batches.

Null and empty texts have no ids.  Repeated rows each get their own row; other
columns pass through unread, but those named ids, parity or round_trip, which the
results replace.
"""


import os
import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
CACHE_CUTS = 150_000  # of each of two generations
JOINED = 500  # new cuts in one string
SLICE = 256
LONGEST_KEPT = 256  # characters of a cut that is kept, so the kept cuts are bounded in bytes
SAMPLED = 64  # one text in so many is checked as a whole too


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 0x7F) << shift
        i += 1
        if b[i - 1] < 0x80:
            return value, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """What a model file says: pieces with scores and types, kind and normaliser."""

    def __init__(self, path: str):
        self.path, self.pieces, self.unigram, self.byte_fallback, self.unk = path, [], True, False, 0
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in fields(raw):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                t = dict(fields(value))
                self.unigram, self.byte_fallback, self.unk = t.get(3, 1) == 1, bool(t.get(35, 0)), t.get(40, 0)
            elif number == 3:
                n = dict(fields(value))
                self.charsmap, self.dummy_prefix = n.get(2, b""), bool(n.get(3, 1))
                self.trim, self.escape = bool(n.get(4, 1)), bool(n.get(5, 1))
        self.ids = {p: i for i, (p, *_) in enumerate(self.pieces)}
        self.cuttable = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))
        self.cuttable = self.cuttable and not self.charsmap and not self.trim

    def merges(self) -> list[tuple[str, str]]:
        found = [
            (-score, self.ids[p[:k]], self.ids[p[k:]], p[:k], p[k:])
            for p, score, kind in self.pieces if kind == NORMAL
            for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        ]
        return [(left, right) for *_, left, right in sorted(found)]

    def vocabulary(self) -> list[tuple[str, float]]:
        """Pieces and scores for a unigram model, where a text matches normal and user pieces only, user ones always."""
        scores = [s for _, s, kind in self.pieces if kind == NORMAL] or [0.0]
        return [
            (p, s) if kind == NORMAL
            else (p, len(p.encode()) * max(scores) - 0.1) if kind == USER
            else (p, min(scores) - 1000) if kind == BYTE  # found by its name in a fallback, so the name must stay
            else (f" {p}", s)  # blanks have become markers by then
            for p, s, kind in self.pieces
        ]

    def tokenizer(self, prefix: bool = True):
        """The tokenizers pipeline; prefix=False leaves out the marker before the text."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unk = self.pieces[self.unk][0]
        if self.unigram:
            model = models.Unigram(self.vocabulary(), unk_id=self.unk, byte_fallback=self.byte_fallback)
        else:
            model = models.BPE(self.ids, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        tok = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and prefix:
            steps.append(normalizers.Prepend(MARK))
        tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix and prefix else []
        tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return tok


class Codec:
    """Encodes and decodes texts, and checks both: parity with the sentencepiece library, and that ids decode to the text.

    Where a model can be cut, each distinct cut is encoded, checked and decoded once: ids and text of a whole are those of
    its cuts one after the other.  New cuts go through both libraries many at a time, in one string; a string that
    differs anywhere is gone through again cut by cut.  One text in SAMPLED, by the CRC-32 of its bytes, is compared and
    decoded as a whole besides.  The cuts of two generations are kept, so when the cache is full
    those in use stay."""

    def __init__(self, path: str, verify: bool = True):
        # within a Spark task the library's own threads share the task's cores
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = PieceModel(path)
        self.cut = self.model.cuttable and self.model.dummy_prefix
        self.tok = self.model.tokenizer(prefix=not self.cut)  # a cut brings its own marker
        self.starts = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.cuts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unlike: set[str] = set()  # ids differ from the library's
        self.lossy: set[str] = set()  # ids decode to another text
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)

    def _learn(self, cuts: list[str]) -> None:
        plain = [c for c in cuts if len(c) > 1 and c[1] != " " and MARK not in c]
        joined = [plain[lo : lo + JOINED] for lo in range(0, len(plain), JOINED)]
        wholes = ["".join(some) for some in joined]
        got = [np.array(e.ids, "<u4") for e in self.tok.encode_batch(wholes, add_special_tokens=False)] if wholes else []
        back = self.tok.decode_batch([i.tolist() for i in got], skip_special_tokens=False) if wholes else []
        for some, whole, ids, text in zip(joined, wholes, got, back):
            at = np.flatnonzero(self.starts[ids])
            alike = self.reference is None or np.array_equal(ids, self.reference.encode(whole[1:], num_threads=1))
            if len(at) != len(some) or not alike or text != whole:
                self._learn_singly(some)
                continue
            data, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), len(ids) * 4]
            self.cuts.update(zip(some, map(data.__getitem__, map(slice, (at * 4).tolist(), ends))))
        plain = set(plain)
        self._learn_singly([c for c in cuts if c not in plain])

    def _learn_singly(self, cuts: list[str]) -> None:
        if not cuts:
            return
        got = [e.ids for e in self.tok.encode_batch(cuts, add_special_tokens=False)]
        back = self.tok.decode_batch(got, skip_special_tokens=False)
        # the library puts the marker back; the cut that is nothing but a blank has no equal there
        theirs = self.reference.encode([c[1:] for c in cuts], num_threads=1) if self.reference is not None else got
        for cut, ids, text, other in zip(cuts, got, back, theirs):
            self.cuts[cut] = np.array(ids, "<u4").tobytes()
            if text != cut:
                self.lossy.add(cut)
            if ids != other and len(cut) > 1:
                self.unlike.add(cut)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """(ids as little-endian 32-bit, parity, round trip) of each text."""
        texts = [t or "" for t in texts]
        if not self.cut:
            got = [e.ids if t else [] for e, t in zip(self.tok.encode_batch(texts, add_special_tokens=False), texts)]
            theirs = self.reference.encode(texts, num_threads=1) if self.reference is not None else got
            back = self.tok.decode_batch(got, skip_special_tokens=False)
            return [(np.array(i, "<u4").tobytes(), i == r, t == b) for i, r, t, b in zip(got, theirs, texts, back)]
        parts = [CUT.findall(" " + t) if t else [] for t in texts]
        if len(self.cuts) > CACHE_CUTS:
            self.old, self.cuts = self.cuts, {}
        new = set().union(*parts).difference(self.cuts)
        if again := new & self.old.keys():
            self.cuts.update((c, self.old[c]) for c in again)
            new -= again
        if new:
            self._learn(list(new))
        of = self.cuts.__getitem__
        out = [(b"".join(map(of, p)), self.unlike.isdisjoint(p), self.lossy.isdisjoint(p)) for p in parts]
        for c in [c for c in new if len(c) > LONGEST_KEPT]:
            del self.cuts[c]
        return [self._whole(t, r) if crc32(t.encode("utf-8", "surrogatepass")) % SAMPLED == 0 else r for t, r in zip(texts, out)]

    def _whole(self, text: str, row: tuple[bytes, bool, bool]) -> tuple[bytes, bool, bool]:
        """A row whose whole text is compared with the library's ids, and whose whole ids are decoded."""
        ids = np.frombuffer(row[0], "<u4")
        alike = self.reference is None or np.array_equal(ids, self.reference.encode(text, num_threads=1))
        return row[0], alike, self.decode([row[0]])[0] == text if text else True

    def decode(self, ids: list[bytes]) -> list[str]:
        got = [np.frombuffer(b, "<u4").tolist() for b in ids]
        out = self.tok.decode_batch(got, skip_special_tokens=False)
        return [t[1:] for t in out] if self.cut else out


#: A run of blanks with what follows up to the next blank; newlines stay inside.
CUT = re.compile(r"\x20+[^\x20]*")

_codecs: dict[str, Codec] = {}


def codec(path: str, verify: bool = True) -> Codec:
    """One codec a worker process."""
    if (path, verify) not in _codecs:
        _codecs[path, verify] = Codec(path, verify)
    return _codecs[path, verify]


def slices(items: list) -> Iterator[list]:
    """Items in runs of SLICE, so that few texts are cut up at a time."""
    return (items[i : i + SLICE] for i in range(0, len(items), SLICE))


def encode_documents(docs: DataFrame, model_path: str | None = None, verify: bool = True) -> DataFrame:
    """docs with ids (little-endian 32-bit), parity (sentencepiece gives the same) and round_trip (they decode to the text)."""
    path = model_path or default_model()

    @F.pandas_udf("struct<ids:binary,parity:boolean,round_trip:boolean>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, verify)
        for batch in batches:
            rows = []
            for texts in slices(batch.tolist()):
                rows += c.encode(texts)
            yield pd.DataFrame(rows, columns=["ids", "parity", "round_trip"])
        release()

    coded = small_batches(docs).select(F.struct("*").alias("doc"), encode("text").alias("e"))
    made = {c: F.col("e").getField(c).alias(c) for c in ("ids", "parity", "round_trip")}
    own = [made.pop(c) if c in made else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return coded.select(*own, *made.values())


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """encoded with decoded, the text of its ids."""
    path = model_path or default_model()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, True)
        for ids in batches:
            yield pd.Series([t for some in slices(ids.tolist()) for t in c.decode(some)])

    return encoded.withColumn("decoded", decode("ids"))


def round_trips(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document: how many ids, their CRC, parity, and whether they decode to the text."""
    coded = encode_documents(docs.select("doc_id", "text"), model_path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")
