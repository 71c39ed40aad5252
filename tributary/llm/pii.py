"""Personal data, also where it is disguised, with offsets into the source text.

Two transducers rewrite a text: the first folds look-alike characters and drops
invisible ones, the second turns spelled digits and disguised at and dot signs
into the signs themselves. Each records which source characters every piece of
its output came from. Identifiers are looked for in the rewritten text, checked
(Luhn, ISO 7064, number ranges), and their spans mapped back.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import batches, load, map_texts, release
from tributary.llm.common import quoted as _quoted

_LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅοαρνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ", "aeopcyxijshdqwABEKMHOPCTXYIJSoapvikABEZHIKMNOPTYXiag", strict=True))
_INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_DASHES = "‐‑‒–—−﹘﹣－"
DIGITS = {
    **dict.fromkeys(("zero", "null", "cero", "zéro"), "0"), **dict.fromkeys(("one", "eins", "uno", "un"), "1"), **dict.fromkeys(("two", "zwei", "dos", "deux"), "2"),
    **dict.fromkeys(("three", "drei", "tres", "trois"), "3"), **dict.fromkeys(("four", "vier", "cuatro", "quatre"), "4"), **dict.fromkeys(("five", "fünf", "cinco", "cinq"), "5"),
    **dict.fromkeys(("six", "sechs", "seis"), "6"), **dict.fromkeys(("seven", "sieben", "siete", "sept"), "7"), **dict.fromkeys(("eight", "acht", "ocho", "huit"), "8"),
    **dict.fromkeys(("nine", "neun", "nueve", "neuf"), "9"), "oh": "0",
}
_WORDS = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_WORDS})(?:[ \t\r\n,.-]{{1,3}}(?:{_WORDS}|\d)\b)+", re.I)
_FOLLOWS = re.compile(rf"[ ]{{0,2}}(?:{_WORDS}|\d)\b")
_ONE = re.compile(rf"{_WORDS}|\d", re.I)
_AT, _DOT = r"(?:at|ät|arroba|arobase|klammeraffe)", r"(?:dot|punkt|point|punto)"
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_SIGNS = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}\s{{0,3}}(?:{_AT}|@)\s{{0,3}}{_CLOSE}\s{{0,3}}|\s{{1,3}}@\s{{1,3}}(?=[\w-]+(?:\.|\s{{1,3}}{_DOT}\b|\s{{0,3}}{_OPEN}))"
    rf"|(?<=\w)(?:\s{{1,3}}|[-_]){_AT}(?:\s{{1,3}}|[-_])(?=[\w-]+(?:\s{{1,3}}{_DOT}\s|[-_]{_DOT}[-_]|\s{{0,3}}{_OPEN}\s{{0,3}}(?:{_DOT}|\.)\s{{0,3}}{_CLOSE})))"
    rf"|(?P<dot>\s{{0,3}}{_OPEN}\s{{0,3}}(?:{_DOT}|\.)\s{{0,3}}{_CLOSE}\s{{0,3}}|(?<=\w)(?:\s{{1,3}}|[-_]){_DOT}(?:\s{{1,3}}|[-_])(?=\w))",
    re.I,
)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![\w@])")
IPV4 = re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)", re.A)
CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d)", re.A)
SSN = re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}(?![\w-])", re.A)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
#: Numbers of each length, longest first, and the lengths that issuers give cards of their prefixes.
CARDS = [re.compile(rf"(?<![\w.])\d(?:[ -]?\d){{{n - 1}}}(?![\w]|\.\d)", re.A) for n in range(19, 12, -1)]
IBANS = [re.compile(rf"(?<!\w)[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}{f' ?[A-Z0-9]{{{n % 4}}}' if n % 4 else ''}(?!\w)", re.A) for n in range(34, 14, -1)]
ISSUED = re.compile(r"(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[0689]\d{12,17}|(?:35|6\d)\d{14,17}|(?:5[06-8]|6\d)\d{11,17})", re.A)
PHONE = re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w|[.-]\d)", re.A)
SPOKEN = re.compile(r"(?<!\w)\+?\d{7,15}(?!\w)", re.A)


@functools.lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """What the first transducer writes for each character it changes."""
    table = {ord(c): to for c, to in _LOOKALIKES.items()} | {ord(c): "" for c in _INVISIBLE} | {ord(c): "-" for c in _DASHES}
    for cp in range(0x80, 0x20000):
        if cp in table:
            continue
        c = chr(cp)
        if unicodedata.category(c) == "Zs":
            table[cp] = " "
        elif (digit := unicodedata.decimal(c, None)) is not None:
            table[cp] = str(digit)
        elif len(flat := unicodedata.normalize("NFKC", c)) == 1 and 0x20 < ord(flat) < 0x7F and cp not in (0xAA, 0xBA, 0xB2, 0xB3, 0xB9):
            table[cp] = flat
    return table


class Rewriting:
    """Output of a transducer: pieces of the source, each copied or replaced as a whole."""

    def __init__(self, source: str):
        self.source, self.parts, self.done = source, [], 0
        self.at, self.start, self.end, self.copied = [], [], [], []
        self.length = 0

    def _add(self, text: str, start: int, end: int, copied: bool) -> None:
        if text:
            self.at.append(self.length), self.start.append(start), self.end.append(end), self.copied.append(copied)
            self.parts.append(text)
            self.length += len(text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Copy up to ``start``, then write ``text`` for what is there until ``end``."""
        self._add(self.source[self.done : start], self.done, start, True)
        self._add(text, start, end, False)
        self.done = end

    def close(self) -> str:
        self._add(self.source[self.done :], self.done, len(self.source), True)
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a nonempty span of the output."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.start[i] + (start - self.at[i]) if self.copied[i] else self.start[i]
        b = self.start[j] + (end - self.at[j]) if self.copied[j] else self.end[j]
        return a, b


@functools.lru_cache(maxsize=1)
def folded_points() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    out[list(folding())] = True
    return out


@functools.lru_cache(maxsize=1)
def triggers() -> ahocorasick.Automaton:
    """Finds where a spelled digit or a dot sign's name may end."""
    out = ahocorasick.Automaton()
    for word in DIGITS:
        out.add_word(word + " ", (len(word), True))
    for word in ("dot", "punkt", "point", "punto"):
        for end in " _":
            out.add_word(word + end, (len(word), False))
    out.make_automaton()
    return out


def fold(text: str) -> tuple[str, Rewriting | None]:
    if text.isascii():
        return text, None
    places = np.flatnonzero(folded_points()[np.frombuffer(text.encode("utf-32-le"), np.uint32)])
    if not len(places):
        return text, None
    table, out = folding(), Rewriting(text)
    for i in places.tolist():
        out.replace(i, i + 1, table[ord(text[i])])
    return out.close(), out


def spell(text: str) -> tuple[str, Rewriting | None, list[tuple[int, int]]]:
    """The second transducer; also the output spans of digits that were spelled."""
    low = text.lower()
    for c in ",.-\n\t\r":
        low = low.replace(c, " ")
    digits, signs = False, any(c in text for c in "([{<") or " @" in low or "@ " in low
    for end, (size, digit) in triggers().iter(low):
        if end > size and low[end - size - 1].isalnum():
            continue
        if not digit:
            signs = True
        elif not digits and _FOLLOWS.match(low, end + 1):
            digits = True
    edits = []
    if digits:
        for m in _SPELLED.finditer(text):
            edits.append((m.start(), m.end(), "".join(DIGITS.get(x.lower(), x) for x in _ONE.findall(m.group())), True))
    if signs:
        for m in _SIGNS.finditer(text):
            edits.append((m.start(), m.end(), "@" if m.group("at") else ".", False))
    if not edits:
        return text, None, []
    out, spelled = Rewriting(text), []
    for start, end, to, digits in sorted(edits):
        if start >= out.done:
            out.replace(start, end, to)
            if digits:
                spelled.append((out.length - len(to), out.length))
    return out.close(), out, spelled


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0 and len(set(digits)) > 1


def iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def checked(text: str, pattern: re.Pattern, lengths: list[re.Pattern], holds: Callable[[str], bool], part: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Spans whose checksum holds: of each start the longest, then starts after it.

    A match of ``pattern`` may hold what follows or precedes the identifier, so
    shorter ones, and starts within it, are tried too; those must pass ``part``.
    """
    at = past = 0
    while m := pattern.search(text, at):
        start = m.start()
        if holds(m.group()) and (start >= past or part(m.group())):
            at = past = m.end()
            yield m.span()
            continue
        for own in lengths:
            if (short := own.match(text, start)) and short.end() < m.end() and part(short.group()) and holds(short.group()):
                at = past = short.end()
                yield short.span()
                break
        else:
            at, past = start + 1, max(past, m.end())


def _digits(text: str) -> str:
    return text.replace(" ", "").replace("-", "")


def detect(text: str, spelled: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers of a rewritten text."""
    found = []
    if "@" in text:
        found += [("email", *m.span()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in IPV4.finditer(text)]
        found += [("card", *span) for span in checked(text, CARD, CARDS, lambda x: luhn(_digits(x)), lambda x: bool(ISSUED.fullmatch(_digits(x))))]
        found += [("ssn", *m.span()) for m in SSN.finditer(text)]
        found += [("iban", *span) for span in checked(text, IBAN, IBANS, iban, lambda x: True)]
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 7 <= sum(c.isdigit() for c in m.group()) <= 15]
    for a, b in spelled:
        a, b = max(0, a - 1), min(len(text), b + 1)
        found += [("phone", *m.span()) for m in SPOKEN.finditer(text, a, b)]
    kept: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if not kept or a >= kept[-1][2]:
            kept.append((kind, a, b))
    return kept


_DIGIT = re.compile(r"\d[^A-Za-z]{0,4}\d[^A-Za-z]{0,4}\d", re.A)


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end in the source, disguised, SHA-256 of the normalised identifier), sorted."""
    folded, first = fold(text)
    plain, second, spelled = spell(folded)
    out = []
    for kind, a, b in detect(plain, spelled):
        value = plain[a:b]
        if second:
            a, b = second.back(a, b)
        if first:
            a, b = first.back(a, b)
        out.append((kind, a, b, text[a:b] != value, hashlib.sha256(value.lower().encode()).hexdigest()))
    return out


def redacted(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind, as in ``<EMAIL>``; all else as it was."""
    if not text or not (found := find(text)):
        return text
    parts, done = [], 0
    for kind, a, b, *_ in found:
        parts += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*parts, text[done:]])


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each identifier: id, kind, ``[start, end)`` in characters of the source, whether it was disguised, SHA-256 of its normal form.

    The identifier itself is not returned. Null and empty texts give no rows, a
    null id stays null, repeated rows give their findings again, an empty table gives
    an empty one. Other columns are left out; one of the result that has the id
    column's name gets a leading ``_``. Of overlapping finds the first stays, of those
    that start together the longest. Texts are searched whole.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text and (got := find(text)):
                    rows += [row] * len(got)
                    found += got
            parts = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(p, k) for p, k in zip(parts, kinds, strict=True))], names=["id", "kind", "start", "end", "disguised", "sha256"])

    return map_texts(df, run, "kind string, start int, end int, disguised boolean, sha256 string", id_column, text_column)


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` with identifiers in the text replaced by their kinds.

    Null and empty texts stay, as do all rows, repeated ones too, and other columns,
    whatever their names; an empty table gives an empty one. Of overlapping finds the
    first is replaced, of those that start together the longest. Texts are read whole.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = pa.array([redacted(t) for t in texts.to_pylist()], pa.string())
        release()
        return out

    return df.withColumn(text_column, run(F.col(_quoted(text_column)).cast("string")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return scan(load(spark, sf_dir, "documents"))
