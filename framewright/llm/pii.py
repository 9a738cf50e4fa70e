"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes, trained from a small labelled table and decoded by Viterbi in batches."""

from __future__ import annotations

import bisect
import itertools
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bound_batches
from ._text import Recent, pieces, sha256, text_slices

KINDS = ("email", "ip", "card", "phone")
#: What the field tags; ``name`` has no fixed pattern.
TAGS = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone", "B-name", "I-name")
SPAN_KINDS = (*KINDS, "name")

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Each ``@`` with the run of characters before it, which no other one shares, and what follows; a text is read once."""
    done = before = 0
    while (at := text.find("@", before)) >= 0:
        run = text[max(done, before) : at]
        begin = at - len(run) + len(run.rstrip(_LOCAL))
        before = at + 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", begin, m.end()
            done = m.end()


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    """Dotted runs of digits, four parts after another; a value counts, not how many zeros it begins with."""
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            short = [p.lstrip("0") for p in four]
            if all(len(p) < 3 or len(p) == 3 and int(p) <= 255 for p in short):
                yield "ip", at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    out = [*_emails(text), *_addresses(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


#: The labelled table's sentences; braces mark what is labelled and how.
LABELLED_SENTENCES = [
    "Please contact {name} at {email} or {phone} .",
    "My name is {name} and my number is {phone}",
    "Dear {name} , your card {card} was charged .",
    "call {phone} today",
    "Mr. {name} wrote from {email} yesterday",
    "Mrs. {name} lives near the river , phone {phone}",
    "Dr. {name} will see you at noon",
    "The server at {ip} did not answer",
    "login from {ip} by user {email}",
    "pay with {card} before the end of the month",
    "Card number: {card} exp 12/27",
    "Send it to {email}",
    "tel: {phone}",
    "Regards , {name}",
    "contact: {name} , {phone} , {email}",
    "signed by {name} on Monday",
    "Ask for {name} at the desk or ring {phone} after six .",
    "Ms. {name} and Mr. {name} met in Berlin in May 2019 .",
    "Her name is {name} , born in 1984 in Lyon .",
    "This is {name} speaking , my mobile is {phone} .",
    "Hello {name} , thanks for the parcel",
    "Hi {name} , see you on Friday",
    "Author: {name}",
    "Name: {name} Phone: {phone} Email: {email}",
    "Best wishes , {name}",
    "Yours sincerely , {name}",
    "Telephone {phone} , fax {phone}",
    "You can reach me under {phone} in the evening .",
    "Frau {name} ist unter {phone} zu erreichen .",
    "Herr {name} schreibt an {email}",
    "Mme {name} habite ici depuis 2003 .",
    "Sra. {name} vive en Madrid .",
    "Reported by {name} ( {email} )",
    "blocked {ip} after 20 tries",
    "ping {ip} : 64 bytes , 12 ms",
    "The account of {name} was closed .",
    "Professor {name} teaches on Tuesday in room 204 .",
    "Charged to {card} on 03/04/2020 .",
    "Visa {card} , valid until 2026",
    "My old number , {phone} , is no longer mine .",
    "{card} was declined twice .",
    "{phone} is busy , {phone} is not .",
    "the line {phone} was dead all day",
    "{ip} is up again , {ip} was rebooted",
    "nodes {ip} and {ip} were slow",
    "They booked {card} in error",
    "used {card} at the shop and {card} at home",
    "moved from {ip} to {ip}",
    "{name} signed , {name} did not .",
    "we met {name} in the hall",
    "write to {name} , {email}",
    "the report of 2021 has 1500 pages and 20 tables",
    "In the year 1984 the city had 250000 people .",
    "The and of the to in that was for on with",
    "Version 2.0 of the license and section 4.1 apply",
    "It costs 19.99 or 5,000 in all , see page 77 .",
    "id 9f8e7d6c5b4a3210 token abcdef0123456789",
    "http://www.example.com/en/12?page=2 is a page",
    "he said that Monday and Paris and London are names of other things",
    "On Sunday the Danube rose by two metres near Vienna .",
    "The Bank of England raised rates in June .",
    "Order 55512 was shipped on 2021-04-17 with 3 items .",
    "New York and San Francisco are far from each other .",
    "The city of Ghent was calm , the port of Genoa was shut .",
    "The Museum of Graz and the Council of Bergen were open .",
    "In March , the Ministry of Health said nothing .",
    "She bought 12 apples , 30 pears and 4 melons .",
    "Chapter 7 : The Long Road Home",
    "Copyright 2019 . All rights reserved .",
    "Open from 9:00 to 17:30 , closed on Mondays .",
    "THIS IS NOT A NAME , IT IS SHOUTING !",
    "Der Zug nach Hamburg hat 20 Minuten Verspätung .",
    "Die Stadt liegt am Rhein und hat 300.000 Einwohner .",
    "Le Conseil de Paris se réunit en Juin .",
    "La Ciudad de México tiene muchos museos .",
    "Flight 1234 leaves at 10:45 from Gate 22 .",
    "The phone rang . Nobody answered .",
    "Call me when you know more .",
    "Dear all , the meeting is on Thursday .",
    "Mr. and Mrs. are forms of address .",
    "My name does not matter .",
    "it is 555 metres long and 1234 wide",
    "Section A. Introduction and B. Method follow .",
    "ISBN 978-3-16-148410-0 is a book",
    "What is it made of . Nobody knows . So . Then it was gone .",
    "No . Never . It . Was . Cold in there .",
    "Go on . Come by . Look at that . Up . Down we went .",
    "Ja . Nein . Und . Dann kam der Regen . Der . Erste Tag war kurz .",
    "Oui . Non . Le . Jour suivant fut long . Que . Faire alors ?",
    "Of . The . To . And so on . By . Then all had left .",
    "kernel 5.10.0-8 and driver 470.57.02 loaded",
]
_FIRST = "Anna John Maria Peter Lena Paul Sofia David Emma Lucas Nina Omar Rosa Ivan Clara Hugo".split()
_LAST = "Smith Miller Garcia Novak Dubois Rossi Keller Brown Silva Meyer Lopez Martin Weber Costa".split()
_NAME_PARTS = "an bel cor da el fin gar ha is jo ker lin mar nor os per qui ro sen tor ul vic win ya zo son ski berg ton ley".split()

#: Sentences, names and forms that the field is measured on and never sees: other wording, other values.
HELD_OUT_SENTENCES = [
    "Yesterday {name} called again and left {phone} as a number .",
    "Write to {email} if the parcel is late .",
    "The nurse , Mrs. {name} , has night duty .",
    "Dear {name} , we received your letter of 12 May .",
    "Traffic came from {ip} and went to {ip} for hours .",
    "We refunded {card} last week .",
    "Kind regards , {name}",
    "Dr. {name} moved to Oslo in 1998 .",
    "for help dial {phone} or mail {email}",
    "Her name is {name} .",
    "The bridge over the Elbe is 400 metres long .",
    "Rain is expected in Lisbon and Porto on Wednesday .",
    "In 2015 the firm sold 120,000 lamps at 8.50 each .",
    "The University of Oxford was closed in August .",
    "Table 3 . Results of the second run",
    "Nothing in this line is private .",
    "Please bring bread , milk and 6 eggs .",
    "Mr. {name} paid with {card} at the gate .",
    "host {ip} is down",
    "Der Hund schläft . Die Katze nicht .",
    "Il pleut . Les rues sont vides .",
    "LAST CALL FOR GATE 14 !",
    "version 3.1.4 of the tool was built on 2022-01-31",
    "Contact: {name} , {email}",
]
_HELD_FIRST = "Greta Oscar Julia Felix Marta Simon Elena Victor".split()
_HELD_LAST = "Hansen Moreau Fischer Ferrari Kowalski Bennett Torres Lindgren".split()


def labelled_table(copies: int = 5, seed: int = 11, held_out: bool = False) -> list[tuple[list[str], list[int]]]:
    """(words, tags) rows: each sentence some times, with made-up values in its places; with ``held_out`` the other part."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda x: x[rng.integers(len(x))]
    known = (_HELD_FIRST, _HELD_LAST) if held_out else (_FIRST, _LAST)

    def value(kind: str) -> str:
        # Half of the names are made up, so that the field learns their shape and what stands beside them, not a list.
        made = [["".join(pick(_NAME_PARTS) for _ in range(rng.integers(2, 4))).capitalize()] for _ in range(2)]
        firsts, lasts = known if held_out or rng.random() < 0.5 else made
        if kind == "name":
            return pick([f"{pick(firsts)} {pick(lasts)}", f"{pick(firsts)} {pick('ABCDEFG')}. {pick(lasts)}", pick(lasts)])
        if kind == "email":
            mine = f"{pick(firsts).lower()}{pick(['.', '_', ''])}{pick([pick(lasts).lower(), num(2)])}"
            return f"{pick([mine, mine, 'jürgen.' + num(2), 'andré_' + num(2), 'peña' + num(2)])}@mail{num(1)}.example.{pick(['com', 'org', 'net'])}"
        if kind == "ip":
            return ".".join(str(rng.integers(1, 256)) for _ in range(4))
        if kind == "card":
            return pick([" ".join(num(4) for _ in range(4)), "-".join(num(4) for _ in range(4)), num(16)])
        if held_out:
            return pick([f"{num(3)}.{num(3)}.{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(2)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}"])
        return pick([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(11)}", f"+{num(2)} {num(2)} {num(3)} {num(4)}"])

    rows = []
    for s in HELD_OUT_SENTENCES if held_out else LABELLED_SENTENCES:
        for _ in range(copies):
            words, tags, joined = [], [], rng.random() < 0.6
            for w in s.split():
                if joined and words and w in (".", ",", "!", "?", ":"):  # mostly signs stand at the word before
                    words[-1] += w
                elif m := re.search(r"\{(\w+)\}", w):
                    for i, v in enumerate(w.replace(m[0], value(m[1])).split()):
                        words.append(v), tags.append(TAGS.index(f"{'B' if not i else 'I'}-{m[1]}"))
                else:
                    words.append(w), tags.append(0)
            rows.append((words, tags))
    return rows if held_out else rows + plain_lines(rng, 40 * copies)


def plain_lines(rng: np.random.Generator, many: int) -> list[tuple[list[str], list[int]]]:
    """Lines of made-up words without personal data, as crawls are full of them: sentences, shouting, repeats, runs of signs."""
    parts = "ba ck do fr ga hu il jo ka lu me no op ra si tu va we yo za th er on an re ti es en é ä ñ ü è ó".split()
    word = lambda: "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 5)))
    rows = []
    for i in range(many):
        words = [word() for _ in range(rng.integers(6, 22))]
        if i % 8 == 0:
            words = words[:1] * len(words)
        elif i % 8 == 3:  # short words that are sentences of their own
            words = [w if rng.random() < 0.5 else w[:3] for w in words]
        if i % 4 == 1:
            words = [w + "$#%*&!"[rng.integers(6)] * int(rng.integers(2, 4)) for w in words]
        elif i % 8 == 2:
            words = [w.upper() + "!!" for w in words]
        often = 0.6 if i % 5 == 0 or i % 8 == 3 else 0.25
        fresh = True
        for j, w in enumerate(words):
            words[j] = w[:1].upper() + w[1:] if fresh else w
            fresh = rng.random() < often
            words[j] += ".?!"[rng.integers(3)] if fresh else "," * bool(rng.random() < 0.05)
        if i % 3 == 0:  # a heading
            words = [w[:1].upper() + w[1:] for w in words[:6]]
        rows.append((words, [0] * len(words)))
    return rows


def word_traits(word: str) -> list[str]:
    """What the field sees of a word: its shape, long and collapsed, its kind of end, and short words themselves."""
    shape = "".join("X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c for c in word[:24])
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = sum(map(str.isdigit, word[:40]))
    traits = [f"s={short}", f"l={shape}" if len(word) <= 12 else "l=long", f"d={min(digits, 20)}", f"n={min(len(word), 12)}", f"e={word[-1:] if not word[-1:].isalnum() else ''}"]
    if "@" in word:
        traits.append("@")
    if word.count(".") == 3 and digits >= 4:
        traits.append("dots")
    if len(word) <= 10:
        traits.append(f"v={word.lower()}")
        traits.append(f"w={word.lower().strip('.,:;!?')}")
    return traits


#: Letters and digits by kind; other characters stay themselves.
_SHAPES = {c: "X" if chr(c).isupper() else "x" if chr(c).islower() else "d" for c in range(0x250) if chr(c).isalnum() and (chr(c).isupper() or chr(c).islower() or chr(c).isdigit())}


#: Traits that the labelled table has less often have no weight.
LEAST_SEEN = 3


@dataclass
class Field:
    """Weights: for each trait and where it is seen (here, one before, one after) a score for each tag; and tag to tag."""

    names: dict[str, int]
    weights: np.ndarray  # (3, traits, tags)
    steps: np.ndarray  # (tags, tags)
    first: np.ndarray
    seen: dict = field(default_factory=dict)

    def of_word(self, word: str) -> np.ndarray:
        """Scores (3, tags). The key tells apart all that ``word_traits`` does, so a memo changes no score."""
        known = tuple(t for t in (f"w={word.lower().strip('.,:;!?')}", f"v={word.lower()}") if t in self.names) if len(word) <= 10 else ()
        key = (word[:40].translate(_SHAPES), min(len(word), 13), "@" in word, word.count(".") == 3, word[-1:].translate(_SHAPES), known)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            got = self.seen[key] = self._scores(word)
        return got

    def _scores(self, word: str) -> np.ndarray:
        ids = [self.names[t] for t in word_traits(word) if t in self.names]
        return self.weights[:, ids].sum(axis=1) if ids else np.zeros((3, len(TAGS)))


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 5e-4) -> Field:
    """Maximum likelihood by full gradients (forward and backward sums over padded sentences), with a step for each weight."""
    k, size, longest = len(TAGS), len(rows), max(len(w) for w, _ in rows)
    names: dict[str, int] = {}
    often = Counter(t for words, _ in rows for w in words for t in word_traits(w))
    seen = [[[names.setdefault(t, len(names)) for t in word_traits(w) if often[t] >= LEAST_SEEN] for w in words] for words, _ in rows]
    at, ids = [], []
    for s, words in enumerate(seen):
        for t, traits in enumerate(words):
            for where, u in ((0, t), (1, t + 1), (2, t - 1)):  # the word itself, the one before, the one after
                if 0 <= u < len(words):
                    at += [(s * longest + u)] * len(traits)
                    ids += [where * len(names) + i for i in traits]
    at, ids = np.array(at), np.array(ids)
    order = np.argsort(at, kind="stable")
    at, ids = at[order], ids[order]
    words_at, word_first = np.unique(at, return_index=True)
    by_id = np.argsort(ids, kind="stable")
    seen_ids, id_first = np.unique(ids[by_id], return_index=True)
    real = np.zeros((size, longest), bool)
    tag = np.zeros((size, longest), int)
    for s, (words, tags) in enumerate(rows):
        real[s, : len(words)], tag[s, : len(tags)] = True, tags
    w, steps, first = np.zeros((3 * len(names), k)), np.zeros((k, k)), np.zeros(k)
    hw, hs, hf = np.full_like(w, 1e-6), np.full_like(steps, 1e-6), np.full_like(first, 1e-6)
    gold = np.eye(k)[tag] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    gold_steps = np.einsum("sti,stj->ij", gold[:, :-1] * both[..., None], gold[:, 1:] * both[..., None])
    for _ in range(rounds):
        e = np.zeros((size * longest, k))
        e[words_at] = np.add.reduceat(w[ids], word_first)
        e = e.reshape(size, longest, k)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        step = np.exp(steps)
        # Forward and backward shares, scaled to sum to one at each word.
        a, b, scale = np.empty_like(e), np.ones_like(e), np.ones((size, longest, 1))
        a[:, 0] = np.exp(first) * e[:, 0]
        for t in range(longest):
            if t:
                a[:, t] = np.where(real[:, t, None], (a[:, t - 1] @ step) * e[:, t], a[:, t - 1])
            scale[:, t] = a[:, t].sum(axis=1, keepdims=True)
            a[:, t] /= scale[:, t]
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(real[:, t + 1, None], (e[:, t + 1] * b[:, t + 1]) @ step.T / scale[:, t + 1], b[:, t + 1])
        p = a * b * real[..., None]
        after = e[:, 1:] * b[:, 1:] / scale[:, 1:] * both[..., None]
        pairs = np.einsum("sti,stj->ij", a[:, :-1], after) * step
        off = (p - gold).reshape(-1, k)
        gw = decay * w
        gw[seen_ids] += np.add.reduceat(off[at[by_id]], id_first) / size
        gs, gf = (pairs - gold_steps) / size + decay * steps, (p[:, 0] - gold[:, 0]).sum(0) / size
        hw, hs, hf = hw + gw**2, hs + gs**2, hf + gf**2
        w, steps, first = w - rate * gw / np.sqrt(hw), steps - rate * gs / np.sqrt(hs), first - rate * gf / np.sqrt(hf)
    return Field(names, w.reshape(3, len(names), k), steps, first)


def viterbi(field: Field, scores: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The best tags of sequences that fill ``scores`` (rows: words) from their ``begin`` on; all sequences step together."""
    n, k = scores.shape
    lens = np.diff(np.append(begin, n))
    order = np.argsort(-lens, kind="stable")
    start, size = begin[order], lens[order]
    back = np.zeros((n, k), np.int8)
    now = scores[start] + field.first.astype(scores.dtype)
    steps = field.steps.astype(scores.dtype)
    for t in range(1, int(size[0]) if n else 0):
        m = int(np.searchsorted(-size, -t, side="left"))  # sequences longer than t
        at, best, arg = start[:m] + t, now[:m, 0, None] + steps[0], np.zeros((m, k), np.int8)
        for j in range(1, k):
            way = now[:m, j, None] + steps[j]
            np.copyto(arg, j, where=way > best)
            np.maximum(best, way, out=best)
        back[at] = arg
        now[:m] = best + scores[at]
    tags, cur = np.zeros(n, np.int8), now.argmax(1)
    for t in range(int(size[0]) - 1 if n else -1, -1, -1):
        m = int(np.searchsorted(-size, -t, side="left"))
        at = start[:m] + t
        tags[at] = cur[:m]
        cur[:m] = back[at, cur[:m]]
    return tags


_EDGE = " \t\n\r\x0b\x0c.,;:!?()[]<>\"'*#$%&"


class Tagger:
    """Finds the field's spans in texts, scoring each distinct word once while it stays in a bounded memo."""

    def __init__(self, field: Field):
        self.field, self.memo = field, Recent(60_000)

    def _work(self, keys: list[bytes]) -> list[bytes]:
        return [self.field.of_word(k.decode().strip(" \t\n\r\x0b\x0c")).astype(np.float32).tobytes() for k in keys]

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """(text, kind, start byte, end byte) of what the field finds in each text; a sequence is a line."""
        if not len(raw):
            return
        white = np.isin(raw, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        start = ~white
        start[1:] &= white[:-1]
        first = offsets[:-1][offsets[:-1] < len(raw)]
        start[first] = True
        starts = np.flatnonzero(start)
        coded = pieces(raw, starts)
        table = np.frombuffer(b"".join(self.memo.fill(coded.dictionary.to_pylist(), self._work)), np.float32).reshape(-1, 3, len(TAGS))
        codes = coded.indices.to_numpy()
        line = np.zeros(len(starts), bool)  # whether a word begins a line
        line[np.searchsorted(starts, first)] = True
        ends = np.append(starts[1:], len(raw))
        breaks = np.flatnonzero(raw == 10)
        after = np.searchsorted(starts, breaks, side="right")
        line[after[after < len(starts)]] = True
        scores = table[codes, 0].copy()
        scores[1:] += np.where(line[1:, None], 0, table[codes[:-1], 1])
        scores[:-1] += np.where(line[1:, None], 0, table[codes[1:], 2])
        tags = viterbi(self.field, scores, np.flatnonzero(line))
        found = np.flatnonzero(tags)
        text = np.searchsorted(offsets, starts[found], side="right") - 1
        open_: list = []
        for i, x in zip(found.tolist(), text.tolist(), strict=True):
            name = TAGS[tags[i]]
            if open_ and name[0] == "I" and name[2:] == open_[1] and open_[4] == i - 1 and open_[0] == x and not line[i]:
                open_[3], open_[4] = int(ends[i]), i
                continue
            if open_:
                yield tuple(open_[:4])
            open_ = [x, name[2:], int(starts[i]), int(ends[i]), i]
        if open_:
            yield tuple(open_[:4])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the field found can be what it is called: the checks that go with the patterns."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        return any(True for _ in _addresses(text))
    if kind == "name":
        return not digits and all(w[:1].isupper() for w in text.split()) and text.upper() != text
    return "@" in text[1:-1]


class _Overlaps:
    """Spans by start, with the greatest end so far, so that those which meet a place are found without going through all."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = sorted(spans, key=lambda s: s[1])
        self.starts = [s for _, s, _ in self.spans]
        self.reach = list(itertools.accumulate((e for _, _, e in self.spans), max))

    def of(self, at: int, end: int) -> Iterator[tuple[str, int, int]]:
        i = bisect.bisect_left(self.starts, end) - 1
        while i >= 0 and self.reach[i] > at:
            if self.spans[i][2] > at:
                yield self.spans[i]
            i -= 1


def find(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, counts and digest of the fixed patterns, and all spans, of each row of ``docs`` (doc_id, text).

    Fixed spans stay; the field adds a plausible span where it overlaps none of them, or holds one of its kind and more (the patterns
    know ASCII only, so an address with an accent is cut by them). Spans are kind:start:end in code points, by kind as in
    SPAN_KINDS, then start. Whole texts are read; null is empty; repeated rows stay; a very long line is one sequence.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(labelled_table()))
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more: list[list] = [list(b) for b in base]
            sorted_base: dict[int, _Overlaps] = {}
            for row, _, raw, offsets in text_slices(batch.column(1), 2 << 20):
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                for x, kind, a, b in tagger.spans(raw, offsets):
                    word = raw[a:b].tobytes().decode()
                    edge = _EDGE.replace("(", "") if kind == "phone" else _EDGE
                    left = len(word) - len(word.lstrip(edge))
                    word = word.strip(edge)
                    if not word or not plausible(kind, word):
                        continue
                    at = int(chars[a] - chars[offsets[x]]) + left
                    end = at + len(word)
                    if row + x not in sorted_base:
                        sorted_base[row + x] = _Overlaps(base[row + x])
                    near = sorted_base[row + x].of(at, end)
                    if all(k == kind and at <= s and e <= end and (s, e) != (at, end) for k, s, e in near):
                        more[row + x].append((kind, at, end))
            n = {k: [sum(1 for s in b if s[0] == k) for b in base] for k in KINDS}
            every = [sorted(m, key=lambda s: (SPAN_KINDS.index(s[0]), s[1], s[2])) for m in more]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(n[k], pa.int64()) for k in KINDS], pa.array([sha256(_joined(b).encode()) for b in base]), pa.array([_joined(e) for e in every], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
