"""Personal data with offset-preserving deobfuscation.

Plain identifiers (e-mail, IPv4 address, card, phone) are found in the text as it
stands.  Two transducers then rewrite a disguised text and keep, for every character
they write, the source characters it stands for: the first folds homoglyphs, foreign
digits, invisible characters and typographic spaces and dashes; the second folds
spelled digits and disguised at, dot and plus signs.  The same recognisers run over the
rewritten text, and a span that rests on at least one rewritten character is mapped
back to source offsets and added.  Plain spans always stay.

Runs of at least four spelled digits are folded first.  Then every run of numerals,
digit words and said dots that holds a digit word or a said dot is folded, however few,
and what the recognisers find in it is added where no span stands yet: an address or
number that is complete does not grow by the digit words after it.

Offsets count code points of the source, ends exclusive.  Texts are searched whole.
Spelled runs are found by one pass over their tokens and bracketed signs from their
brackets outwards, so that no run of digits, words, separators or spaces, however long,
is gone over again from each of its places.

Bounds of what counts as a disguise (plain spans have none): a said address has at most
seven parts before its at, the nearest ones; the tokens of a spelled run stand at most
three characters of space and punctuation apart.

Defined cases: null and empty texts have no spans; repeated rows are searched each;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match within a run of digits starts at the run's start
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            low = m.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def _only_digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def find(text: str) -> list[tuple[int, int, int]]:
    """Plain identifiers: (start, number of the kind, end), sorted; leftmost and not overlapping within a kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _only_digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_only_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _homoglyphs() -> dict[int, str]:
    """Characters that pass for an ASCII one, by the character they pass for; '' for invisible ones."""
    table: dict[int, str] = {}
    # fixed values: look-alikes of Latin letters among Cyrillic and Greek ones
    like = {
        "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іɩι", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "п", "o": "оοσօ", "p": "рρ", "q": "ԛ", "s": "ѕ",
        "t": "т", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уүγ", "z": "ᴢ",
        "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
        "-": "‐‑‒–—−﹣", ".": "․。｡﹒", "@": "﹫", "+": "﹢", "(": "⁽₍", ")": "⁾₎",
        " ": "               　",
        "": "­​‌‍‎‏⁠﻿",
    }
    for to, chars in like.items():
        table |= {ord(c): to for c in chars}
    table |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full width
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6, 0x2080):
        table |= {zero + i: str(i) for i in range(10)}
    table |= {0x2070: "0", 0x00B9: "1", 0x00B2: "2", 0x00B3: "3", 0x24EA: "0"} | {0x2070 + i: str(i) for i in range(4, 10)} | {0x2460 + i: str(i + 1) for i in range(9)}
    for start in range(0x1D400, 0x1D6A4, 52):  # mathematical alphabets: 26 capitals, 26 small letters
        for i in range(52):
            table[start + i] = chr(65 + i) if i < 26 else chr(97 + i - 26)
    return table


_GLYPHS = _homoglyphs()
_GLYPH_CHARS = frozenset(map(chr, _GLYPHS))
_GLYPH = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_GLYPHS)) + "]")

#: Words for the digits in the corpus's languages.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_POINT = r"(?:dot|point|punkt|punto)"
#: What may part the tokens of a spelled run, up to three of it.
_GAP = frozenset(" \t\n,;.·/_-")
_TOKEN = re.compile(rf"(?<![^\W_])(?:(?P<d>{_WORDS})|(?P<n>[0-9]+)|(?P<p>{_POINT})|(?P<plus>plus))(?![^\W_])", re.I)
#: What can stand in a spelled run; two neighbours of it make a text worth the slower search.
_SPOKEN = frozenset([*_DIGIT_WORDS, "dot", "point", "punkt", "punto", "plus"])
_SAID_POINTS = frozenset(["dot", "point", "punkt", "punto"])

_BRACKET = re.compile(r"[(\[{<]")
#: A bracketed sign from its bracket on.
_SIGN = re.compile(r"[(\[{<][ \t]*(?:(?P<at>at|@|ät|arroba|arobase)|dot|\.|punkt|point|punto)[ \t]*[)\]}>][ \t]*", re.I)
_SAID_AT = r"(?:[ \t]+(?:at|arroba|arobase)[ \t]+|_at_|-at-)"
_SAID_DOT = rf"(?:[ \t]+{_POINT}[ \t]+|_{_POINT}_|-{_POINT}-)"
_NAME = r"[A-Za-z0-9][A-Za-z0-9%+]*"
#: A said at counts only in a whole said address: name, at, name and a said dot.
_SAID = re.compile(rf"(?<![A-Za-z0-9%+])(?P<local>{_NAME}(?:(?:[._-]|{_SAID_DOT}){_NAME}){{0,6}}?)(?P<at>{_SAID_AT}|[ \t]*@[ \t]*)(?P<host>[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?:{_SAID_DOT}[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)+)", re.I)
_SAID_DOT_RE = re.compile(_SAID_DOT, re.I)
_LEET_HINT = re.compile(r"[0-9][OoIl]")
_LEET = re.compile(r"(?<=[0-9])[OoIl](?=[OoIl]?[ -]?[0-9])")


class Rewritten:
    """A text with, for each of its characters, the source range it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.changed = False

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace ranges (sorted, apart) by texts; every written character stands for the whole range."""
        if not edits:
            return self
        if not self.changed:
            at, to, new = np.arange(len(self.text)), np.arange(1, len(self.text) + 1), np.zeros(len(self.text), bool)
        else:
            at, to, new = self.at, self.to, self.new
        begin = np.array([e[0] for e in edits])
        end = np.array([e[1] for e in edits])
        size = np.array([len(e[2]) for e in edits])
        # kept stretches and written texts take turns; a written character takes its edit's ends
        bounds = np.zeros(len(self.text) + 1, np.int64)
        bounds[begin] += 1  # edits are apart
        bounds[end] -= 1
        kept = np.cumsum(bounds[:-1]) == 0
        shift = np.cumsum(size) - np.cumsum(end - begin)  # of the text after an edit
        place = np.flatnonzero(kept)
        target = place + np.concatenate([[0], shift])[np.searchsorted(end, place, "right")]
        length = len(self.text) + int(shift[-1])
        out = Rewritten("")
        out.at, out.to, out.new = np.empty(length, at.dtype), np.empty(length, to.dtype), np.ones(length, bool)
        out.at[target], out.to[target], out.new[target] = at[place], to[place], new[place]
        start = begin + np.concatenate([[0], shift[:-1]])
        written = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out.at[written], out.to[written] = np.repeat(at[begin], size), np.repeat(to[end - 1], size)
        gone = start[(size == 0) & (start > 0)]
        out.new[gone - 1] = True  # something went: the character before counts as rewritten
        text: list[str] = []
        done = 0
        for a, b, s in edits:
            text.append(self.text[done:a])
            text.append(s)
            done = b
        text.append(self.text[done:])
        out.text = "".join(text)
        out.changed = True
        return out


def signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of bracketed at and dot signs, with the spaces around them."""
    out: list[tuple[int, int, str]] = []
    done = 0
    for bracket in _BRACKET.finditer(text):
        if bracket.start() >= done and (m := _SIGN.match(text, bracket.start())):
            start = m.start()
            while start > done and text[start - 1] in " \t":
                start -= 1
            done = m.end()
            out.append((start, done, "@" if m.lastgroup == "at" else "."))
    return out


Piece = tuple[str, int, int, str]


def spoken_runs(text: str) -> Iterator[list[Piece]]:
    """Maximal runs of numerals and digit words, with said dots between them and a plus before: (kind, start, end, text) of each token."""
    run: list[Piece] = []

    def ended() -> list[Piece]:
        while run and run[-1][0] == "p":
            run.pop()
        return run if sum(p[0] in "dn" for p in run) > 1 else []

    for m in _TOKEN.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        joined = bool(run) and 0 < a - run[-1][2] <= 3 and _GAP.issuperset(text[run[-1][2] : a])
        if not joined or kind == "plus" or (kind == "p" and run[-1][0] not in "dn"):
            if found := ended():
                yield found
            run = []
        if not run:
            if kind == "p":
                continue
            plus = text.rfind("+", max(0, a - 4), a)
            if kind != "plus" and plus >= 0 and _GAP.issuperset(text[plus + 1 : a]):
                run = [("plus", plus, plus + 1, "+")]
        run.append((kind, a, b, m[0]))
    if found := ended():
        yield found


def fold(text: str, run: list[Piece], least: int) -> list[tuple[int, int, str]]:
    """Edits of a spelled run: with ``least``, up to its last digit word where it has that many; with 0, whole where it has a digit word, said dot or said plus."""
    if least:
        spelled = [i for i, p in enumerate(run) if p[0] == "d"]
        if len(spelled) < least:
            return []
        run = run[: spelled[-1] + 1]
    elif all(kind == "n" or t == "+" for kind, _, _, t in run):
        return []
    edits = []
    before = None
    for kind, a, b, t in run:
        if before is not None and before < a:
            gap = text[before:a]
            edits.append((before, a, "." if gap.strip() == "." and gap != ". " else ""))
        if kind != "n":
            edits.append((a, b, _DIGIT_WORDS[t.lower()] if kind == "d" else "." if kind == "p" else "+"))
        before = b
    return edits


def rewrite(text: str) -> list[Rewritten]:
    """The text without its disguises: with runs of four spelled digits folded, and where that differs, with all runs."""
    r = Rewritten(text)
    if not text.isascii() and not _GLYPH_CHARS.isdisjoint(text):
        r = r.replace([(m.start(), m.end(), _GLYPHS[ord(m[0])]) for m in _GLYPH.finditer(text)])
    low = r.text.lower()
    if "(" in low or "[" in low or "{" in low or "<" in low:
        r = r.replace(signs(r.text))
    for c in ",.-_;/+·":
        low = low.replace(c, " ")
    words = low.split()
    spoken = _SPOKEN.intersection(words)
    if spoken & _SAID_POINTS:
        edits = []
        for m in _SAID.finditer(r.text):
            for part in ("local", "at", "host"):
                a, b = m.span(part)
                if part != "at":
                    edits += [(x.start(), x.end(), ".") for x in _SAID_DOT_RE.finditer(r.text, a, b)]
                elif r.text[a:b] != "@":
                    edits.append((a, b, "@"))
        r = r.replace(edits)
    forms = [r]
    if spoken and b"\1\1" in bytes([w in _SPOKEN or w.isdigit() for w in words]):
        runs = list(spoken_runs(r.text))
        folds = [[e for run in runs for e in fold(r.text, run, least)] for least in (4, 0)]
        forms = [r.replace(edits) for edits in folds[: 1 + (folds[0] != folds[1])]]
    forms = [f.replace([(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LEET.finditer(f.text)]) if _LEET_HINT.search(f.text) else f for f in forms]
    return forms


def detect(text: str) -> list[tuple[int, int, int, bool]]:
    """All spans: (start, number of the kind, end, plain), sorted.  Added ones rest on a rewritten character."""
    base = find(text)
    out = [(*x, True) for x in base]
    seen = set(base)
    for n, r in enumerate(rewrite(text)):
        if not r.changed:
            continue
        taken = bytearray(len(text) if n else 0)  # where spans stand that came before the folding of all runs
        for a, _, b in seen if n else ():
            taken[a:b] = b"\1" * (b - a)
        for a, kind, b in find(r.text):
            if r.new[a:b].any():
                span = (int(r.at[a]), kind, int(r.to[b - 1]))
                if span not in seen and 1 not in taken[span[0] : span[2]]:
                    seen.add(span)
                    out.append((*span, False))
    out.sort()
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans``: an array of (kind, start, end, base) by start, then kind.  A map over the rows."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("spans", SPANS)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": plain} for a, k, b, plain in detect(t)] for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, arrow)], names=schema.names)

    return source.mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Query: counts of the plain spans, their digest, and all spans, of every document."""
    from .common import table

    out = find_personal_data(docs if docs is not None else table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
