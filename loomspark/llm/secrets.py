"""Secret scans through nested encodings.

Each whole text is a worklist of layers.  A layer is scanned, and what is encoded in
it is decoded to further layers (URL escapes, Unicode escapes, base64, compressed
bytes) until no new layer appears; layers already seen are not visited again.  Every
layer carries, per character, the span of the original text that it stands for, so
finds are reported in code points of the document.  Work is per document.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.shared import map_arrow

# Fixed values of the contract: kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
MIN_ASSIGNED = 8
# greedy runs with a least length are the same as all runs with the short ones dropped
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: The shortest find (token= and eight characters, 14 bytes) takes 19 base64 characters.
MIN_BASE64 = 19
#: Compressed bytes are inflated in pieces of this size and scanned in windows of at least WINDOW bytes, which end where no find and no encoded run can cross; windows after the first are counted in `oversized`.
PIECE = 1 << 20
#: Bytes that are looked at first, to see whether they are compressed at all.
HEAD = 4096
WINDOW = 4 << 20

_ASSIGN_HINT = re.compile("[:=]")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_BASE64},}}={{0,2}}")
# lines of a wrapped run, quoted or not; the line end may be written out, as in a text that is a JSON value
_LINE_END = re.compile(r"[\x20\t]*+(?:\r?\n|(?:\\r)?\\n)[\x20\t>]*+")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_BASE64},}}+(?:{_LINE_END.pattern}[A-Za-z0-9+/_-]++)++")
# shorter stretches of decoded bytes (14) hold no find
_ASCII = re.compile(rb"[\t-\r\x20-\x7e]{14,}")
_UTF16 = (re.compile(rb"(?:[\t-\r\x20-\x7e]\x00){14,}"), re.compile(rb"(?:\x00[\t-\r\x20-\x7e]){14,}"))
_CUT = re.compile(rb"[.,;)!?\]>]\s|\x00\x00|[.,;)!?]\x00\s\x00|\x00[.,;)!?]\x00\s")
_BZIP2 = re.compile(rb"BZh[1-9]1AY&SY")
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")


def base_finds(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return _in_order(out)


def _in_order(finds):
    return sorted(finds, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


class Layer:
    """A decoded text; starts[i] and ends[i] are the original span of its i-th character (None: the original itself)."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))


def _replaced(layer: Layer, parts: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with each region (a, b) put as characters (char, from, to), positions in the layer."""
    texts, starts, ends, at = [], [], [], 0
    n = np.arange(len(layer.text) + 1)
    for a, b, chars in [*parts, (len(layer.text), len(layer.text), [])]:
        texts.append(layer.text[at:a])
        starts.append(n[at:a])
        ends.append(n[at + 1 : a + 1])
        if chars:
            texts.append("".join(c for c, _, _ in chars))
            starts.append(np.array([f for _, f, _ in chars]))
            ends.append(np.array([t for _, _, t in chars]))
        at = b
    s, e = np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)
    if layer.starts is not None:
        s, e = layer.starts[s], layer.ends[e - 1]
    return Layer("".join(texts), s, e)


def _chars(data: bytes, where: list[tuple[int, int]]) -> list[tuple[str, int, int]] | None:
    """UTF-8 bytes as characters with the spans of their bytes; None if it isn't UTF-8."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((c, where[at][0], where[at + n - 1][1]))
        at += n
    return out


def url_layer(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    parts = []
    for m in _URL.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        chars = _chars(data, [(m.start() + 3 * i, m.start() + 3 * i + 3) for i in range(len(data))])
        if chars is None:  # not UTF-8: the bytes below 128 alone
            chars = [x for i, b in enumerate(data) for x in ([(chr(b), m.start() + 3 * i, m.start() + 3 * i + 3)] if b < 128 else [(c, m.start() + 3 * i + j, m.start() + 3 * i + j + 1) for j, c in enumerate(m[0][3 * i : 3 * i + 3])])]
        parts.append((m.start(), m.end(), chars))
    return _replaced(layer, parts) if parts else None


def unicode_layer(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    parts = []
    for m in _UNICODE.finditer(layer.text):
        code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            parts.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
    return _replaced(layer, parts) if parts else None


def _pieces(data: bytes, start: int = 0) -> Iterator[memoryview]:
    """data from start on, first a little, without copies."""
    view, size = memoryview(data), HEAD
    while start < len(view):
        yield view[start : start + size]
        start, size = start + size, PIECE


def _decoder(first: bytes | memoryview):
    """A decompressor for bytes that begin like these, or None."""
    head = bytes(first[:10])
    if head[:2] in _MAGIC:
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if _BZIP2.match(head) else None


def _members(pieces: Iterator[bytes], rest_too: bool) -> Iterator[bytes]:
    """Inflated bytes of all joined members, in pieces, and if asked what follows them; ends at damage."""
    d = None
    for rest in pieces:
        while True:
            if d is None or d.eof:
                if d is not None:
                    rest = bytes(rest).lstrip(b"\0")
                d = _decoder(rest) or (d if rest else None)
                if d is None or d.eof:
                    if rest_too and rest:
                        yield bytes(rest)
                    elif rest:
                        return
                    break
            try:
                if isinstance(d, bz2.BZ2Decompressor):
                    out = d.decompress(rest, PIECE)
                    rest = d.unused_data if d.eof else b""
                    more = not d.eof and not d.needs_input
                else:
                    out = d.decompress(rest, PIECE)
                    rest = d.unused_data if d.eof else d.unconsumed_tail
                    more = bool(out) and not d.eof
            except (zlib.error, OSError):
                return
            if out:
                yield out
            if not rest and not more:
                break


def _inflated(data: bytes, start: int = 0, rest_too: bool = True) -> Iterator[bytes]:
    """Pieces of what compressed bytes hold, through all levels of compression."""
    seen, pieces, first = set(), _pieces(data, start), memoryview(data)[start : start + HEAD]
    while _decoder(first) is not None and (key := hashlib.blake2b(first[:HEAD], digest_size=16).digest()) not in seen:
        seen.add(key)
        pieces = _members(pieces, rest_too)
        first = next(pieces, b"")
        pieces = chain((first,), pieces)
    return pieces if _decoder(first) is None else iter(())


def _raw_deflate(data: bytes) -> bytes | None:
    """The first inflated bytes of a deflate stream without a header, if they are a text's."""
    d = zlib.decompressobj(-15)
    try:
        head = d.decompress(data[:HEAD], HEAD)
    except zlib.error:
        return None
    enough = len(head) >= 14 and (d.eof or len(data) > HEAD or len(head) == HEAD)
    return head if enough and len(_ASCII.sub(b"", head)) * 4 < len(head) else None


def _raw_inflated(data: bytes) -> Iterator[bytes]:
    d, rest = zlib.decompressobj(-15), data
    while rest and not d.eof:
        try:
            out = d.decompress(rest, PIECE)
        except zlib.error:
            return
        yield out
        rest = d.unconsumed_tail
        if not out:
            return


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held = bytearray()
    looked = 0
    for piece in pieces:
        held += piece
        if len(held) < WINDOW:
            continue
        ends = [m.end() for m in _CUT.finditer(held, looked)]
        looked = max(0, len(held) - 4)
        if ends:
            yield bytes(held[: ends[-1]])
            del held[: ends[-1]]
            looked = 0
    yield bytes(held)


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and (text.isprintable() or "".join(text.split()).isprintable()) else None


def _stretches(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(offset, bytes a character, text) of the ASCII and UTF-16 stretches of bytes that aren't readable throughout."""
    for m in _ASCII.finditer(data):
        yield m.start(), 1, m[0].decode()
    if b"\0" in data:
        found = sorted(((m.start(), m.end(), m[0][order::2].decode()) for order, form in enumerate(_UTF16) for m in form.finditer(data)), key=lambda x: x[0] - x[1])
        # in one byte order text is also found in the other, less a character
        taken = bytearray(len(data))
        for a, b, text in found:
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                yield a, 2, text


def _decoded(part: str) -> bytes:
    """The bytes of base64 characters without padding; a last single character holds none."""
    part = part[:-1] if len(part) % 4 == 1 else part
    try:
        return base64.b64decode(part.translate(_STANDARD) + "=" * (-len(part) % 4))
    except (binascii.Error, ValueError):
        return b""


def _unpacked(layer: Layer, pieces: Iterator[bytes], a: int, b: int) -> Iterator[tuple[Layer, bool]]:
    """Layers of inflated bytes, all of them standing for the layer's characters a to b, and whether it is a further window."""
    a, b = layer.span(a, b)
    for i, window in enumerate(_windows(pieces)):
        whole = _readable(window)
        for text in (whole,) if whole else (x for _, _, x in _stretches(window)):
            yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text))), i > 0


def _opened(layer: Layer, data: bytes, at: np.ndarray) -> Iterator[tuple[Layer, bool]]:
    """Layers of decoded bytes, and whether it is a further window; at: positions in the layer of the base64 characters."""

    def spans(s, e):
        return (s, e) if layer.starts is None else (layer.starts[s], layer.ends[e - 1])

    if _decoder(data) is not None:
        yield from _unpacked(layer, _inflated(data), int(at[0]), int(at[-1]) + 1)
    elif text := _readable(data):
        i = np.arange(len(data))
        chars = _chars(data, list(zip(at[8 * i // 6].tolist(), (at[(8 * i + 7) // 6] + 1).tolist())))
        yield Layer(text, *spans(np.array([x[1] for x in chars]), np.array([x[2] for x in chars]))), False
    elif _raw_deflate(data) is not None:
        yield from _unpacked(layer, _raw_inflated(data), int(at[0]), int(at[-1]) + 1)
    else:
        for o, step, text in _stretches(data):
            i = o + step * np.arange(len(text))
            if step == 2 and data[o] == 0:
                i += 1
            yield Layer(text, *spans(at[8 * i // 6], at[(8 * i + 7) // 6] + 1)), False


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of the lines of a run."""
    out = []
    for m in _LINE_END.finditer(text, a, b):
        out.append((a, m.start()))
        a = m.end()
    return [*out, (a, b)]


def base64_layers(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """Layers of each base64 run, also of runs wrapped over lines, that hold readable or compressed text.

    A run can follow other characters of its alphabet, so it is decoded at its four alignments, each once.
    Compressed members can begin after / _ - + and line ends: where the bytes there look like one, it is inflated
    from there on and no further than it goes.
    """
    done: list[tuple[int, int]] = []  # by start: wrapped runs come first and in order
    runs = chain(((m, True) for m in _WRAPPED.finditer(layer.text)), ((m, False) for m in _BASE64.finditer(layer.text)))
    for m, wrapped in runs:
        before = bisect.bisect_right(done, (m.start(), len(layer.text) + 1))
        if not wrapped and before and m.start() < done[before - 1][1]:
            continue
        lines = _lines(layer.text, m.start(), m.end()) if wrapped else [(m.start(), m.start() + len(m[0].rstrip("=")))]
        core = "".join(layer.text[a:b] for a, b in lines)
        at = np.concatenate([np.arange(a, b) for a, b in lines])
        decoded: dict[int, bytes] = {}
        found = False
        for skip in range(4):
            if len(core) - skip < MIN_BASE64:
                break
            data = decoded[skip] = _decoded(core[skip:])
            whole = _decoder(data) is not None or _readable(data) is not None
            any_ = False
            for made in _opened(layer, data, at[skip:]):
                any_ = True
                yield made
            if whole and any_:
                found = True
                break
        if found:
            if wrapped:
                done.append((int(at[skip]), m.end()))
            continue
        starts = set(np.cumsum([b - a for a, b in lines])[:-1].tolist()) | {x.end() for x in re.finditer("[/_+-]", core)}
        for start in sorted(x for x in starts if x > 3 and len(core) - x >= MIN_BASE64):
            data, byte = decoded[start % 4], (start - start % 4) // 4 * 3
            if _decoder(data[byte : byte + 10]) is None:
                continue
            pieces = _inflated(data, byte, rest_too=False)
            first = next(pieces, b"")
            if first:
                yield from _unpacked(layer, chain((first,), pieces), int(at[start]), int(at[-1]) + 1)


_STANDARD = str.maketrans("-_", "+/")


def _inner(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    for decode in (url_layer, unicode_layer):
        made = decode(layer)
        if made is not None and made.text != layer.text:
            yield made, False
    yield from base64_layers(layer)


def scan(text: str) -> tuple[list, list, int]:
    """Base finds, all finds with those of decoded layers, and the number of further windows of large layers."""
    base = base_finds(text)
    found, oversized = set(base), 0
    seen = set()
    # depth first, so that only one window of a layer is held at a time
    work = [iter(((Layer(text), False),))]
    while work:
        layer, further = next(work[-1], (None, False))
        if layer is None:
            work.pop()
            continue
        oversized += further
        if layer.starts is not None:
            key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass") + layer.starts[:1].tobytes() + layer.ends[-1:].tobytes(), digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
            found.update((k, *layer.span(a, b)) for k, a, b in base_finds(layer.text))
        work.append(_inner(layer))
    return base, _in_order(found), oversized


def listed(finds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in finds)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base_spans, spans (each kind:start:end, comma-joined), n_assign, n_access, n_hex (base), oversized.

    Null and empty texts have no finds and empty strings.  Rows are scanned each for
    itself, so repeated rows repeat their result; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, over, counts = [], [], [], {k: [] for k in KINDS}
            for text in batch.column(1).to_pylist():
                b, s, o = scan(text or "")
                base.append(listed(b))
                spans.append(listed(s))
                over.append(o)
                for k in KINDS:
                    counts[k].append(sum(f[0] == k for f in b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(base), pa.array(spans), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(over, pa.int64())],
                ["doc_id", "base_spans", "spans", "n_assign", "n_access", "n_hex", "oversized"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, base_spans string, spans string, n_assign long, n_access long, n_hex long, oversized long")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "oversized")
