"""Secret scan with a recursive decoding worklist.

Every text is layer zero.  A layer is scanned, then each URL-encoded,
Unicode-escaped, base64 or compressed stretch in it is decoded into a new layer
whose characters remember which characters of the original text they came from.
Base64 goes on over line ends and indents and is tried at all four alignments, since a
path or a word before it looks like more of it; readable stretches (UTF-8, UTF-16)
among other bytes count, and compressed bytes are unpacked whether they came as
base64, URL-encoded or escaped (raw deflate as base64 only, at its start or after a slash).  Layers go through a worklist
until none is new; a layer seen before over the same stretch is not entered again,
so cycles end.

Null and empty texts have no spans.  Repeated rows each get their own row.  Only
doc_id and text are read, so other columns cannot clash.
"""

import base64
import bz2
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, small_batches

KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

URL_RUN = re.compile(r"[^\s%]*+(?:%[0-9A-Fa-f]{2}[^\s%]*+)+")
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

NEXT_LINE = re.compile(r"(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
BYTE_ESCAPE = re.compile(r"\\([abfnrtv0\\'\"])")
BYTES_OF = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\""))
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00", re.S)

READABLE = rb"[\t\n\r\x20-\x7e]"
UTF8_RUN = re.compile(rb"(?:" + READABLE + rb"|[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}")
UTF16LE_RUN = re.compile(rb"(?:" + READABLE + rb"\0){12,}")
UTF16BE_RUN = re.compile(rb"(?:\0" + READABLE + rb"){12,}")
#: Bytes that may be deflated without a header: fewer hold no secret.
LEAST_DEFLATED = 12

#: Decoded characters of one layer beyond which it is counted as oversize
#: instead of being unpacked (a compression bomb). Each layer has its own bound.
MAX_LAYER_CHARS = 1 << 26

FIELDS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_decoded_spans", "n_oversize")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


class Layer:
    """A decoded text; character i came from original characters starts[i]..ends[i]."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends


def _chars_of(data: bytes, at: list[tuple[int, int]]) -> tuple[str, list[int], list[int]]:
    """Text of UTF-8 bytes, with the stretch that each character came from."""
    text = data.decode("utf-8")
    starts, ends, k = [], [], 0
    for ch in text:
        n = len(ch.encode("utf-8"))
        starts.append(at[k][0])
        ends.append(at[k + n - 1][1])
        k += n
    return text, starts, ends


def _url_layer(text: str, lo: int, hi: int):
    out, starts, ends, pos = [], [], [], lo
    for m in URL_BYTES.finditer(text, lo, hi):
        for i in range(pos, m.start()):
            out.append(text[i]), starts.append(i), ends.append(i + 1)
        data = bytes.fromhex(m[0].replace("%", ""))
        at = [(m.start() + 3 * k, m.start() + 3 * k + 3) for k in range(len(data))]
        try:
            t, s, e = _chars_of(data, at)
        except UnicodeDecodeError:
            t, s, e = data.decode("latin-1"), [a for a, _ in at], [b for _, b in at]
        out.append(t), starts.extend(s), ends.extend(e)
        pos = m.end()
    for i in range(pos, hi):
        out.append(text[i]), starts.append(i), ends.append(i + 1)
    return "".join(out), starts, ends


def _escape_layer(text: str):
    out, starts, ends, pos = [], [], [], 0
    for m in ESCAPE.finditer(text):
        code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        out.append(text[pos : m.start()]), starts.extend(range(pos, m.start())), ends.extend(range(pos + 1, m.start() + 1))
        out.append(chr(code)), starts.append(m.start()), ends.append(m.end())
        pos = m.end()
    if not out:
        return None
    out.append(text[pos:]), starts.extend(range(pos, len(text))), ends.extend(range(pos + 1, len(text) + 1))
    return "".join(out), starts, ends


def _unpack(data, room: int) -> tuple[bytes, int] | None:
    """Decompressed bytes and how many of data they took, None if data is not compressed; OverflowError beyond room."""
    head = bytes(data[:6])
    try:
        if head[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
        elif head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
            d = zlib.decompressobj()
        elif head[:3] == b"BZh":
            d = bz2.BZ2Decompressor()
        elif head == b"\xfd7zXZ\x00":
            d = lzma.LZMADecompressor()
        else:
            return None
        out = d.decompress(data, room + 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return None
    if len(out) > room:
        raise OverflowError
    return out, len(data) - len(d.unused_data)


def _inflated(data: bytes, room: int) -> bytes:
    """data, decompressed for as long as it is compressed."""
    while (inner := _unpack(data, room)) is not None:
        data = inner[0]
    return data


def _stretches(data: bytes):
    """(text, first byte and end of each character) of the readable stretches of bytes: UTF-8, and UTF-16 of ASCII in either order."""
    for m in UTF8_RUN.finditer(data):
        text = m[0].decode("utf-8")
        size = [1] * len(text) if text.isascii() else [len(c.encode("utf-8")) for c in text]
        ends = [*accumulate(size, initial=m.start())]
        yield text, ends[:-1], ends[1:]
    if b"\0" in data:
        for pattern, skip in ((UTF16LE_RUN, 0), (UTF16BE_RUN, 1)):
            for m in pattern.finditer(data):
                text = m[0][skip::2].decode("ascii")
                yield text, range(m.start(), m.end(), 2), range(m.start() + 2, m.end() + 2, 2)


def _unpacked(data: bytes, room: int) -> str | None:
    """Readable stretches of what compressed bytes hold, apart by newlines: all of it came from all of them."""
    return "\n".join(t for t, *_ in _stretches(_inflated(data, room))) or None


def _base64_layers(text: str, parts: list[tuple[int, int]], room: int):
    """Layers of the base64 characters of the parts, one for each line; None for oversize ones.

    What stands before base64 in its own alphabet (a path, a word) only shifts it, so each of the four alignments is
    decoded and its readable stretches and compressed streams are looked for."""
    at = [i for a, b in parts for i in range(a, b) if text[i] != "="]
    to = [i + 1 for i in at]
    to[-1] = parts[-1][1]  # with the padding
    raw = "".join(text[i] for i in at).replace("-", "+").replace("_", "/")
    starts = [0, *(m.end() for m in re.finditer("/", raw))]
    for shift in range(4):
        body = raw[shift : len(raw) - (len(raw) - shift) % 4] if (len(raw) - shift) % 4 == 1 else raw[shift:]
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        for t, lo, hi in _stretches(data):
            yield t, [at[shift + k * 8 // 6] for k in lo], [to[shift + (8 * k - 1) // 6] for k in hi]
        if MAGIC.search(data):
            yield from _streams(data, [(at[shift + k * 8 // 6], to[shift + (k * 8 + 7) // 6]) for k in range(len(data))], room)
        view = memoryview(data)
        for p in starts:  # deflate has no header, so it is tried where base64 may begin
            k = (p - shift) * 6 // 8
            if p % 4 != shift or len(data) - k < LEAST_DEFLATED:
                continue
            try:
                d = zlib.decompressobj(-15)
                out = d.decompress(view[k:], room + 1)
                if len(out) > room:
                    yield None
                elif d.eof and (t := _unpacked(out, room)):
                    end = to[shift + (8 * (len(data) - len(d.unused_data)) - 1) // 6]
                    yield t, [at[p]] * len(t), [end] * len(t)
            except (zlib.error, OverflowError):
                pass


def _base64_runs(text: str):
    """Lists of (start, end) of lines that may be one base64 text: runs that go on over line ends."""
    done = 0
    for m in BASE64_RUN.finditer(text):
        if m.start() < done:
            continue
        lines = [m.span()]
        while text[lines[-1][1] - 1] != "=" and (len(lines) == 1 or lines[-1][1] - lines[-1][0] >= 16) and (n := NEXT_LINE.match(text, lines[-1][1])):
            lines.append(n.span(1))
        done = lines[-1][1]
        yield lines


def _raw_bytes(text: str, lo: int, hi: int, pattern: re.Pattern, bytes_of):
    """Bytes that a stretch stands for, and the (start, end) of each; bytes_of a match: its bytes, of equal shares of it, or of all of it."""
    data, at, pos = bytearray(), [], lo
    for m in (*pattern.finditer(text, lo, hi), None):
        for i in range(pos, m.start() if m else hi):
            b = text[i].encode("utf-8", "surrogatepass")
            data += b
            at += [(i, i + 1)] * len(b)
        if m:
            b = bytes_of(m)
            step = (m.end() - m.start()) // len(b) if pattern is URL_BYTES else 0
            data += b
            at += [(m.start() + k * step, m.start() + (k + 1) * step) if step else m.span() for k in range(len(b))]
            pos = m.end()
    return bytes(data), at


def _escaped_byte(m: re.Match) -> bytes:
    if m[6]:
        return bytes([BYTES_OF[m[6]]])
    code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
    return bytes([code]) if code < 256 else chr(min(code, 0x10FFFF)).encode("utf-8", "surrogatepass")


ESCAPED_BYTE = re.compile(f"{ESCAPE.pattern}|{BYTE_ESCAPE.pattern}")


def _streams(data: bytes, at: list[tuple[int, int]], room: int):
    """Layers of the compressed streams in bytes that were not base64; None for oversize ones."""
    view, pos = memoryview(data), 0
    while m := MAGIC.search(data, pos):
        pos = m.start() + 1
        try:
            got = _unpack(view[m.start() :], room)
            if got and (t := _unpacked(got[0], room)):
                pos = m.start() + got[1]
                yield t, [at[m.start()][0]] * len(t), [at[pos - 1][1]] * len(t)
        except OverflowError:
            yield None


def _children(layer: Layer, room: int):
    """Decoded layers of one layer, as (text, starts, ends) in its own characters; None for oversize ones."""
    t = layer.text
    if "%" in t:
        for m in URL_RUN.finditer(t):
            yield (got := _url_layer(t, *m.span()))
            if got[0].isascii():
                continue  # no compressed bytes
            data, at = _raw_bytes(t, *m.span(), URL_BYTES, lambda x: bytes.fromhex(x[0].replace("%", "")))
            yield from _streams(data, at, room)
    if ("\\" in t or "&#" in t) and (got := _escape_layer(t)):
        yield got
        if not got[0].isascii():
            yield from _streams(*_raw_bytes(t, 0, len(t), ESCAPED_BYTE, _escaped_byte), room)
    for lines in _base64_runs(t):
        yield from _base64_layers(t, lines, room)


def scan(text: str | None) -> dict:
    """All spans of one text: base ones, then those found in decoded layers."""
    text = text or ""
    base = base_spans(text)
    spans, seen, layers, oversize = set(base), set(), 0, 0
    work = deque([Layer(text, None, None)])
    while work:
        layer = work.popleft()
        for got in _children(layer, MAX_LAYER_CHARS):
            if got is None:
                oversize += 1
                continue
            t, starts, ends = got
            if layer.starts is not None:
                starts, ends = [layer.starts[i] for i in starts], [layer.ends[i - 1] for i in ends]
            key = (sha256_hex(t), starts[0], ends[-1]) if t else None
            if key is None or key in seen:
                continue
            if len(t) > MAX_LAYER_CHARS:
                oversize += 1
                continue
            seen.add(key)
            layers += 1
            spans |= {(starts[a], max(ends[a:b]), kind) for a, b, kind in base_spans(t)}
            work.append(Layer(t, starts, ends))
    every = sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))
    return {
        "base": base, "spans": every, "layers": layers, "oversize": oversize,
    }


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with counts and digest of the base spans and all spans.

    n_layers counts decoded layers, n_decoded_spans the spans that only they
    showed, n_oversize layers past MAX_LAYER_CHARS that were not unpacked."""

    kinds = ",".join(f"{f}:{'string' if f in ('base_sha256', 'spans') else 'bigint'}" for f in FIELDS)

    @F.pandas_udf(f"struct<{kinds}>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                r = scan(text)
                n = {k: 0 for k in KINDS}
                for *_, k in r["base"]:
                    n[k] += 1
                rows.append((*n.values(), sha256_hex(joined(r["base"])), joined(r["spans"]), r["layers"], len(r["spans"]) - len(r["base"]), r["oversize"]))
            yield pd.DataFrame(rows, columns=FIELDS)

    return small_batches(docs).select("doc_id", look("text").alias("r")).select("doc_id", "r.*")
