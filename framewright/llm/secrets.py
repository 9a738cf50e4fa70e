"""Secret scans: a worklist unwraps nested URL, Unicode, base64 and compressed layers until nothing new appears; each layer is scanned and its spans mapped back."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bound_batches
from ._text import sha256

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_KEYWORD = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
# A run that is long enough: the same as taking every run and dropping the short ones, as a run has no way to match twice.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_URL_PART = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
_UNICODE_PART = re.compile(rb"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Begins where a run begins, so that a long run is read once.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]++={0,2}")
_SEPARATOR = re.compile(r"[+/]+")
# No pattern and no run of base64 matches fewer characters, and all of them are ASCII.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")

#: Bytes that an unpacker gives at once, that are looked at to see whether they are packed again, and that make a window.
CHUNK, HEAD, WINDOW = 1 << 18, 1 << 20, 4 << 20
#: No pattern, escape or run of base64 has one of these bytes, so a window can end behind them.
_BREAKS = bytes(b for b in range(128) if chr(b) not in "\t\n\r +/_.=-\"':%\\&#;{}" and not chr(b).isalnum())
#: A run of one byte that is longer than twice this is shortened to about this length in unpacked windows (by whole groups of
#: twelve, as base64 goes by four and three); no pattern tells the two apart.
SAME = 12 << 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns on one layer, by start, then kind in the order of KINDS."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


class Layer:
    """A decoded text and, for each of its characters, the span of the outermost text that it came from.

    What is unpacked has one span for all its characters: a view of one number, not a number for each.
    """

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def outer(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a]), int(self.ends[b - 1])


def _from_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Layer:
    """Characters of UTF-8 bytes (Latin-1 where they are not UTF-8), each with the span of its bytes."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return Layer(data.decode("latin-1"), starts, ends)
    if len(text) == len(data):
        return Layer(text, starts, ends)
    first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return Layer(text, starts[first], ends[np.append(first[1:], len(data)) - 1])


def _replaced(layer: Layer, part: re.Pattern, value, each: int = 0) -> Layer | None:
    """The layer with each match of ``part`` replaced by the bytes of ``value``; None without one. A byte carries the span of
    the ``each`` characters that it was written with, or of the whole match."""
    raw = layer.text.encode("utf-8", "surrogatepass")
    out, sizes, firsts, lasts, steps, at = [], [], [], [], [], 0
    for m in part.finditer(raw):
        new = value(m[0])
        out += [raw[at : m.start()], new]
        sizes += [m.start() - at, len(new)]
        firsts += [at, m.start()]
        lasts += [0, m.end() - 1]
        steps += [1, each]
        at = m.end()
    if not out:
        return None
    out.append(raw[at:]), sizes.append(len(raw) - at), firsts.append(at), lasts.append(0), steps.append(1)
    size = np.array(sizes)
    step = np.repeat(np.array(steps), size)
    inside = np.arange(len(step)) - np.repeat(np.cumsum(size) - size, size)
    begin = np.repeat(np.array(firsts), size) + inside * step
    end = np.where(step > 0, begin + step - 1, np.repeat(np.array(lasts), size))
    starts, ends = layer.starts, layer.ends
    if len(raw) != len(layer.text):
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        begin, end = char[begin], char[end]
    return _from_bytes(b"".join(out), starts[begin], ends[end])


def _percent(part: bytes) -> bytes:
    return bytes.fromhex(part.replace(b"%", b"").decode())


def _escape(part: bytes) -> bytes:
    s = part.decode()
    if s[0] == "&":
        return html.unescape(s).encode("utf-8", "replace")
    code = int(s[2:].strip("{}"), 16)
    return (chr(code) if code < 0xD800 or 0xE000 <= code <= 0x10FFFF else "\ufffd").encode()


def _unpacker(head: bytes):
    """What unpacks data that begins so; None if it is no gzip, zlib, bz2 or xz data."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What packed data holds, member after member, CHUNK by CHUNK, up to where it ends, breaks or is something else."""
    held, engine = b"", None
    for chunk in chunks:
        held += chunk
        while True:
            if engine is None:
                if len(held) < 6:
                    break
                engine = _unpacker(held)
                if engine is None:
                    return
            try:
                out = engine.decompress(held, CHUNK)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            if out:
                yield out
            if engine.eof:  # another member may follow, behind padding
                held, engine = engine.unused_data.lstrip(b"\0"), None
                continue
            held = getattr(engine, "unconsumed_tail", b"")
            if not held and (engine.needs_input if hasattr(engine, "needs_input") else len(out) < CHUNK):
                break


def _innermost(chunks: Iterator[bytes], seen: frozenset = frozenset()) -> Iterator[bytes]:
    """What packed data holds, unpacked again while that is packed too; a beginning that was met before ends a cycle."""
    found, head = _unpacked(chunks), b""
    for chunk in found:
        head += chunk
        if len(head) >= HEAD:
            break
    if not head:
        return
    mark, whole = _digest(head), itertools.chain([head], found)
    if mark not in seen and next(_unpacked(iter([head])), None) is not None:
        yield from _innermost(whole, seen | {mark})
    else:
        yield from whole


def _shortened(data: bytearray) -> bytearray:
    """``data`` with long runs of one byte cut short."""
    ends = data[::SAME]
    for i in range(len(ends) - 1):
        if ends[i] == ends[i + 1] and data.count(ends[i], i * SAME, (i + 1) * SAME) == SAME:
            return bytearray(re.sub(rb"(?s)(.)\1{%d,}" % (2 * SAME - 1), lambda m: m[1] * (SAME + (len(m[0]) - SAME) % 12), bytes(data)))
    return data


def _cut(data: bytearray) -> int:
    """The last place where no match can cross: behind a byte that none has, or a line that does not end in a run of base64."""
    best = max(data.rfind(b) for b in _BREAKS) + 1
    at = data.rfind(b"\n", best)
    while at >= best:
        line = bytes(data[max(0, at - 4096) : at]).rstrip(b" \t\r")
        if line and not _RUN_END.search(line):
            return at + 1
        at = data.rfind(b"\n", best, at)
    return best


_RUN_END = re.compile(rb"[A-Za-z0-9+/_-]{16}\Z")


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """``chunks`` in windows that no match, escape or run of base64 crosses; only a run without any break grows a window."""
    held, enough = bytearray(), WINDOW
    for chunk in chunks:
        held += chunk
        if len(held) < enough:
            continue
        held = _shortened(held)
        if cut := _cut(held):
            yield bytes(held[:cut])
            del held[:cut]
        enough = max(WINDOW, 2 * len(held))
    if held:
        yield bytes(_shortened(held))


#: The first two bytes of gzip, zlib, bz2 and xz data.
_MAGIC = {b"\x1f\x8b", b"BZ", b"\xfd7", *[bytes([0x78, f]) for f in range(256) if (0x7800 + f) % 31 == 0]}
_TEXT_BYTE = bytes(b for b in range(256) if b in (9, 10, 13) or 32 <= b < 127)


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return b""


def _base64_layers(layer: Layer, at: np.ndarray, run: str) -> Iterator[Layer]:
    """What ``run``, the base64 characters at the positions ``at``, holds.

    A payload can begin behind other characters of the alphabet. Compressed data is looked for at the run's first four
    characters and behind each separator; readable text at all four alignments, as a whole or in its readable parts.
    """
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    for first in sorted({0, 1, 2, 3, *[m.end() for m in _SEPARATOR.finditer(run)], *[m.start() for m in _SEPARATOR.finditer(run)]}):
        if _decoded(run[first : first + 8])[:2] in _MAGIC:
            s, e = int(layer.starts[at[first]]), int(layer.ends[at[-1]])
            for window in _windows(_innermost(_decoded(run[i : i + CHUNK]) for i in range(first, len(run), CHUNK))):
                yield _from_bytes(window, np.broadcast_to(np.int64(s), len(window)), np.broadcast_to(np.int64(e), len(window)))
    for first in range(4):
        data = _decoded(run[first:])
        odd = len(data.translate(None, _TEXT_BYTE))
        if not data:
            continue
        if not odd or not first and odd * 3 <= len(data) and _is_utf8(data):
            parts = [(0, len(data))]
        else:
            parts = [m.span() for m in _READABLE.finditer(data)]
        for lo, hi in parts:
            i = np.arange(lo, hi)
            starts = layer.starts[at[first + i * 4 // 3]]
            ends = layer.ends[at[np.minimum(len(at) - 1, first + (i * 8 + 7) // 6)]]
            yield _from_bytes(data[lo:hi], starts, ends)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers that are directly inside this one."""
    text = layer.text
    if "%" in text and (inner := _replaced(layer, _URL_PART, _percent, 3)):
        yield inner
    if ("\\" in text or "&#" in text) and (inner := _replaced(layer, _UNICODE_PART, _escape)):
        yield inner
    for m in _BASE64.finditer(text):
        yield from _base64_layers(layer, np.arange(m.start(), m.end()), m[0])
    for m in _WRAPPED.finditer(text):
        run = "".join(m[0].split())
        at = m.start() + np.flatnonzero(~np.isin(np.frombuffer(m[0].encode(), np.uint8), (9, 10, 13, 32)))
        yield from _base64_layers(layer, at, run)
        kept = int(np.searchsorted(at, m.start() + max(m[0].rfind("\n"), 0)))
        if kept:
            yield from _base64_layers(layer, at[:kept], run[:kept])  # the last line can be other text


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text. All spans add those of nested layers, mapped to the text that holds them.

    The worklist starts with the text and goes depth first; each layer is scanned, and its own layers are unwrapped one by
    one, unless the same content at the same place was seen, which ends cycles. Packed layers are unpacked to their end,
    window by window, so memory follows the text and the longest unbroken run, not what a bomb unpacks to.
    """
    base = base_spans(text)
    spans, seen = set(base), {(0, len(text), _digest(text.encode("utf-8", "surrogatepass")))}
    work = [unwrap(Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1)))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        mark = (*layer.outer(0, len(layer.text)), _digest(layer.text.encode("utf-8", "surrogatepass")))
        if mark in seen:
            continue
        seen.add(mark)
        spans.update((*layer.outer(a, b), kind) for a, b, kind in base_spans(layer.text))
        work.append(unwrap(layer))
    return base, sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row; a null text is empty, repeated rows stay."""
    bound_batches(docs.sparkSession)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict = {k: [] for k in KINDS}
            digests, spans = [], []
            for t in batch.column(1):
                base, every = scan_text(t.as_py() or "")
                for k in KINDS:
                    n[k].append(sum(1 for x in base if x[2] == k))
                digests.append(sha256(_joined(base).encode()))
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return src.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in scan_text(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's span, nested ones included, replaced by ``mark``; overlapping spans become one.

    Texts without secrets, nulls and all other columns are unchanged; a column n_chars follows a changed text.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            new = [t if t is None else redacted(t, mark) for t in texts]
            columns = list(batch.columns)
            columns[text] = pa.array(new, batch.schema.field(text).type)
            if "n_chars" in names:
                at = names.index("n_chars")
                kept = columns[at].to_pylist()
                columns[at] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, texts, new, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
