"""Token ids as length-delimited binary records with an offset index.

A record is: length of the payload (unsigned 64-bit, little-endian), masked
CRC-32 of those eight bytes, payload, masked CRC-32 of the payload, and one
newline.  The payload is the doc_id (signed 64-bit; the least value for null), the
width of an id in bytes (one byte), and the zstd-compressed ids.  A masked
checksum is the checksum rotated right by 15 bits plus 0xa282ead8.

Documents are range-partitioned and sorted by doc_id into files of bounded bytes,
encoded, and written by Spark's own text writer, whose commit protocol makes retries
safe and which reaches any store that Spark does; the newline of a record is its line
end.  The index (file, offset and length of each record, and the ids before it) is
made by reading the files back, and is written beside them (path.index) for shuffled
reads, which seek where the files are on a mounted folder and else read them whole.

Null and empty texts make a record with the end id alone.  Rows with one doc_id
follow each other in the order of their texts.  An empty table writes no record.
"""

import json
import re
import struct
from codecs import charmap_decode
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, small_batches

END_ID = 1
MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
CACHE_WORDS = 300_000  # of each of two generations
SLICE = 256  # texts cut up at a time
LONG_WORD = 256  # bytes; the model alone makes an object of each token, so longer words go through the whole tokenizer
FILE_BYTES = 64 << 20  # of text in a file, about

#: Lower-case letters that no normalizer changes, alone or side by side (Latin-1, Greek, Cyrillic, kana, Han, Hangul
#: syllables), and ASCII marks after them but the apostrophe.
LETTERS = "a-zß-öø-ÿά-ώа-џぁ-ゖァ-ヺ一-龥가-힣"
LETTERS_THEN_MARKS = re.compile(f"([{LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")
#: The cut that takes such letters in one piece and such marks in another.
CUT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: How the byte-level alphabet writes each byte: visible Latin-1 characters as themselves, the others from U+0100 on.
_UNSEEN = [*range(33), *range(127, 161), 173]
BYTE_CHARS = "".join(chr(256 + _UNSEEN.index(b)) if b in _UNSEEN else chr(b) for b in range(256))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def masked(data: bytes) -> int:
    c = crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int, pack) -> bytes:
    payload = struct.pack("<qB", NULL_ID if doc_id is None else doc_id, width) + pack(ids)
    head = struct.pack("<Q", len(payload))
    return b"".join([head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)), b"\n"])


def records(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each record; raises on a wrong length or checksum."""
    import zstandard

    unpack, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(data):
        got = read_record(data, at, unpack)
        yield got
        at += got[1]


def read_record(data: bytes, at: int, unpack=None) -> tuple[int, int, int | None, np.ndarray]:
    if unpack is None:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"record at {at}: wrong length")
    n = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"record at {at}: wrong checksum")
    doc_id, width = struct.unpack_from("<qB", payload)
    ids = np.frombuffer(unpack(payload[9:]), {2: "<u2", 4: "<u4"}[width])
    return at, n + 17, None if doc_id == NULL_ID else doc_id, ids


def by_words(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) lower-cases and never joins characters across white space."""
    steps = spec.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    known = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
    plain = all(n.get("type") in known or (n.get("type") == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in steps)
    cut = spec.get("pre_tokenizer") or {}
    first = cut.get("pretokenizers", [cut])[0]
    apart = first.get("type") in ("Whitespace", "WhitespaceSplit") or (
        first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and not re.search(r"\\S|\\s(?!\\p)|[. ]", first["pattern"].get("Regex", "."))
    )
    return plain and any(n.get("type") == "Lowercase" for n in steps) and apart and not spec.get("post_processor")


def by_letters(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) cuts as CUT does, and its model, with nothing before or after it, encodes each piece."""
    marked = all(re.fullmatch(r"<\|\w+\|>", t["content"]) for t in spec.get("added_tokens") or [])
    steps, model = spec["normalizer"] or {}, spec["model"]
    composed = {n["type"] for n in steps.get("normalizers", [steps]) if n} <= {"NFC", "Replace", "Lowercase"}
    return by_words(spec) and composed and spec["pre_tokenizer"] == CUT and marked and model["type"] == "BPE" and not model.get("dropout")


class Words(dict):
    """Ids of distinct words (UTF-8, A-Z lower-cased), looked up or else encoded by the library, and kept in two generations.

    The library's model gets the letters of LETTERS_THEN_MARKS as the tokenizer itself would hand them over (by_letters
    looks at its file), and a lone stop or marks after them are words of their own; other words, and those of other
    tokenizers, go through the whole tokenizer."""

    def __init__(self, tok, code: str, letters: bool):
        self.tok, self.code, self.letters = tok, code, letters
        self.model, self.old = tok.model, {}

    def turn(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self.encoded(word)
        self[word] = ids
        return ids

    def encoded(self, word: bytes) -> bytes:
        if self.letters and len(word) <= LONG_WORD:
            if word.isalpha():
                return self.piece(word)
            if word[-1] in b".," and word[-2:-1].isalpha():
                return self[word[:-1]] + self[word[-1:]]
            if found := LETTERS_THEN_MARKS.fullmatch(word.decode()):
                return self[found[1].encode()] + self[found[2].encode()] if found[2] else self.piece(word)
        return self.pack(self.tok.encode(word.decode(), add_special_tokens=False).ids)

    def piece(self, letters: bytes) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(charmap_decode(letters, "strict", BYTE_CHARS)[0])])

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)


class Encoder:
    """Ids of whole texts; distinct words are encoded once, by the library.

    Texts are cut at ASCII white space after lower-casing A-Z.  The tokenizer lower-cases and cuts there itself
    (by_words looks at its file, tests compare with whole texts), so only the number of distinct words shrinks;
    another tokenizer encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width, code = (2, "H") if self.tok.get_vocab_size() <= 1 << 16 else (4, "I")
        spec = json.loads(self.tok.to_str())
        self.cut = by_words(spec)
        self.words = Words(self.tok, code, by_letters(spec))

    def encode(self, texts: list[str], end_id: int = END_ID) -> list[bytes]:
        return [ids for lo in range(0, len(texts), SLICE) for ids in self._encode(texts[lo : lo + SLICE], end_id)]

    def _encode(self, texts: list[str], end_id: int) -> list[bytes]:
        end = self.words.pack([end_id])
        if not self.cut:
            return [self.words.pack(e.ids) + end for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.words.turn()
        of = self.words.__getitem__
        return [b"".join([*map(of, t.encode().lower().split()), end]) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Write docs' ids as record files in ascending order of doc_id."""
    tokenizer = tokenizer or default_tokenizer()
    if files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    @F.pandas_udf("binary")
    def framed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import zstandard

        pack, enc = zstandard.ZstdCompressor(level=1).compress, encoder(tokenizer)
        for ids, texts in batches:
            coded = enc.encode([t or "" for t in texts], end_id)
            yield pd.Series([frame(None if d is None else int(d), c, enc.width, pack)[:-1] for d, c in zip(ids, coded)])

    rows = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.select(framed(F.col("doc_id").cast("string"), "text").cast("string").alias("value")).write.text(path)


ENTRY = "struct<doc_id:bigint,offset:bigint,length:bigint,n_tokens:bigint,ids_crc32:bigint,ord:bigint,before:bigint>"


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, doc_id, start, n_tokens, ids_crc32 of every record, checksums checked.

    start: ids in all records before, over the files in the order of their numbers."""

    @F.pandas_udf(f"array<{ENTRY}>")
    def entries(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for files in batches:
            out = []
            for data in files:
                rows, before = [], 0
                for k, (at, n, doc_id, ids) in enumerate(records(bytes(data))):
                    rows.append({"doc_id": doc_id, "offset": at, "length": n, "n_tokens": len(ids), "ids_crc32": crc32(ids.astype("<u4").tobytes()), "ord": k, "before": before})
                    before += len(ids)
                out.append(rows)
            yield pd.Series(out)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    read = materialize(raw.select(name.alias("file"), F.explode(entries("content")).alias("r")).select("file", "r.*"), "index-entries")
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row a file
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
    starts = totals.select("file", (F.sum("n").over(Window.orderBy(number)) - F.col("n")).alias("first"))
    return read.join(F.broadcast(starts), "file").select(
        "file", "offset", "length", "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """doc_id and ids of the records that index names, in any order: each file is opened once, at the offsets wanted.

    Files of a mounted folder (file:) are read by seeking; others, of FILE_BYTES or so, through Spark."""
    wanted = index.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length"))).alias("w"))  # of one file

    @F.pandas_udf("array<array<int>>")
    def pick(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for files, offsets in batches:
            yield pd.Series([[read_record(bytes(d), int(o))[3].tolist() for o in at] for d, at in zip(files, offsets)])

    folder = path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else None

    @F.pandas_udf("array<array<int>>")
    def seek(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for files, offsets, lengths in batches:
            out = []
            for name, at, sizes in zip(files, offsets, lengths):
                with open(f"{folder}/{name}", "rb") as f:
                    rows = []
                    for o, n in zip(at, sizes):
                        f.seek(int(o))
                        rows.append(read_record(f.read(int(n)), 0)[3].tolist())
                out.append(rows)
            yield pd.Series(out)

    if folder:
        got = wanted.select("w", seek("file", F.col("w.offset"), F.col("w.length")).alias("ids"))
    else:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        met = raw.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(wanted, "file")
        got = met.select("w", pick("content", F.col("w.offset")).alias("ids"))
    return got.select(F.explode(F.arrays_zip("w", "ids")).alias("z")).select("z.w.doc_id", "z.ids")


def encode_to_records(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs as record files, read them back, and write their index beside them (path.index); returns the index."""
    spark = docs.sparkSession
    path = path or new_path(spark, "records")
    write_records(docs, path, tokenizer)
    index = build_index(spark, path)
    index.write.parquet(f"{path}.index")
    return spark.read.schema(index.schema).parquet(f"{path}.index")
