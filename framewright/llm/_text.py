"""Vectorised splitting of Arrow text columns into pieces, and bounded caches for what is worked out once per distinct piece."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are split at once; longer texts are one slice of their own.
SLICE_BYTES = 4 << 20


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, n+1 byte offsets) of runs of rows of at most ``limit`` bytes, or one row. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def pieces(raw: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """Dictionary-encode the pieces of ``raw`` that begin at ``starts`` (the first is 0) and fill it."""
    offsets = np.append(starts, len(raw)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return array.dictionary_encode()


class Recent:
    """A bounded memo in two generations: what was used lately stays. It changes how often a value is worked out, never the value."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def fill(self, keys: list, work: Callable[[list], list]) -> list:
        """The values of ``keys``; ``work`` gets those that are not known, each once."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, lost = self.young, self.old, []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    lost.append(k)
                else:
                    young[k] = v
        if lost:
            young.update(zip(lost, work(lost), strict=True))
        return [young[k] for k in keys]


# Byte classes: 8 white space, 1 letter, 2 digit, 3 punctuation, 4 what may belong with either neighbour.
_CLASS = bytearray(b"\x04" * 256)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 8 if _c in " \t\n\r\x0b\x0c" else 1 if _c.isalpha() else 2 if _c.isdigit() else 4 if _c in "'<|>" else 3
_CLASS = bytes(_CLASS)
_CUT = np.zeros(256, bool)
for _a in (8, 1, 2, 3, 4):
    for _b in (1, 2, 3, 4):
        _CUT[_a << 4 | _b] = _a != _b and (_a == 8 or 4 not in (_a, _b))


def word_starts(raw: np.ndarray, doc_offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin that a word-level BPE encodes independently.

    A piece begins after ASCII white space, or where two ASCII or Latin-1 characters of different kinds (letter, digit,
    punctuation) meet; white space stays with the piece before it. Neither Unicode composition, nor a pre-token, nor a special token's
    string (``<|...|>``) crosses such a place, and an apostrophe keeps both neighbours, so that encoding the pieces one by
    one gives the ids of the whole text.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = np.frombuffer(bytearray(raw.tobytes().translate(_CLASS)), np.uint8)
    lead = np.flatnonzero(raw == 0xC3)  # the Latin-1 letters
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    cut = np.empty(len(raw), bool)
    cut[0] = True
    np.take(_CUT, (kind[:-1] << 4) | kind[1:], out=cut[1:])
    inner = doc_offsets[:-1]
    cut[inner[inner < len(raw)]] = True
    return np.flatnonzero(cut)


_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0x100))).replace("×", "").replace("÷", ""))


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: visible Latin-1 as itself, the rest from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Ids of distinct pieces by a ``tokenizers`` file, each worked out once while it stays in a bounded memo.

    Pieces of plain Latin letters, which the normaliser only lower-cases, go to the same library's model in one joined text;
    all others go through the whole library pipeline.
    """

    def __init__(self, path: str, limit: int = 250_000, counts: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.bare = None
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        if suffix and self._plain_case():
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.array([(self.whole.id_to_token(i) or "").endswith(suffix) for i in range(self.whole.get_vocab_size())])
            self.letters = _byte_letters()
        self.counts = counts
        self.memo = Recent(limit)

    def _plain_case(self) -> bool:
        """Whether the file's pipeline treats a plain word as the short way does; probed, not assumed."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(self.whole.model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        table = _byte_letters()
        probe = ["Hello", "WORLD", "straße", "ÉTÉ", "Ñandú", "a"]
        mine = [bare.encode("".join(table[b] for b in w.lower().encode()), add_special_tokens=False).ids for w in probe]
        return mine == [e.ids for e in self.whole.encode_batch_fast(probe, add_special_tokens=False)]

    def _work(self, keys: list[bytes]) -> list:
        out: list = [None] * len(keys)
        plain, rest, at, rest_at = [], [], [], []
        for i, k in enumerate(keys):
            w = k.decode().strip(" \t\n\r\x0b\x0c")
            if self.bare is not None and w and len(w) < 64 and _PLAIN.issuperset(w):
                w = w.lower()
                plain.append(w if w.isascii() else "".join([self.letters[b] for b in w.encode()]))
                at.append(i)
            else:
                rest.append(w)
                rest_at.append(i)
        for lo in range(0, len(plain), 4000):
            ids = np.array(self.bare.encode(" ".join(plain[lo : lo + 4000]), add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(plain[lo : lo + 4000]):
                raise ValueError("the vocabulary's word ends do not match its words")
            if self.counts:
                got = np.diff(cuts, prepend=0).tolist()
            else:
                flat, ends = ids.tolist(), cuts.tolist()
                got = [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            for i, v in zip(at[lo : lo + 4000], got, strict=True):
                out[i] = v
        for lo in range(0, len(rest), 2000):
            for i, e in zip(rest_at[lo : lo + 2000], self.whole.encode_batch_fast(rest[lo : lo + 2000], add_special_tokens=False), strict=True):
                out[i] = len(e) if self.counts else tuple(e.ids)
        return out

    def of(self, keys: list[bytes]) -> list:
        return self.memo.fill(keys, self._work)


_loaded: dict = {}


def once(key, make: Callable):
    """One object of this kind for a Python worker, which serves many tasks. Only the last operator's stays, to bound memory."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]


_kinds: list[np.ndarray] = []


def char_kinds() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 other, as the splitting pattern of the rank files sees it."""

    if not _kinds:
        import regex

        kinds = np.full(0x110000 + 1, 3, np.uint8)
        points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        index = np.array(points)
        for value, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                kinds[index[m.start() : m.end()]] = value
        _kinds.append(kinds)
    return _kinds[0]


def pattern_starts(raw: np.ndarray, doc_offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the matches of ``public_tokenizers.PATTERN`` begin; they fill each text without gaps."""
    if not len(raw):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    width = 1 + (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.cumsum(width, dtype=np.int64) - width  # byte position of each character
    kind = char_kinds()[cp]
    inner = doc_offsets[:-1]
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, inner[inner < len(raw)])] = True
    first[n] = True
    white = kind == 0
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = change | first[:n]
    # The last white space before a word begins a piece; a plain space takes the word with it.
    last = white & ~first[1:]
    last[:-1] &= ~white[1:]
    if n:
        last[n - 1] = False
    start |= last
    joined = np.flatnonzero(last & (cp == 0x20)) + 1
    start[joined] = False
    # Contractions, where a match begins at an apostrophe.
    q = np.flatnonzero((cp == 0x27) & start)
    q = q[(q + 1 < n) & ~first[np.minimum(q + 1, n)]]
    if len(q):
        one = cp[q + 1]
        has2 = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        two = np.where(has2, cp[np.minimum(q + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[q[short | long] + 1] = False
        after = np.concatenate([q[short] + 2, q[long] + 3])
        start[after[after < n]] = True
    return at[start]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)
