"""Secret scans: keyword automaton, anchored patterns at its hits, checksums.

An Aho-Corasick automaton over all rules' keywords passes once over each text.
Only where a keyword begins is its rule's pattern tried, anchored at that place,
and what it matches counts only if the checksum or structure embedded in it holds.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import batches, load, map_texts

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_base62(secret: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those after the prefix."""
    body, tail = secret[:-6].partition("_")[2], secret[-6:]
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0") == tail


def base58_check(secret: str) -> bool:
    """The last four bytes are the start of the double SHA-256 of the others."""
    value = 0
    for c in secret:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def jwt_header(secret: str) -> bool:
    """The first part is JSON that names an algorithm."""
    head = secret.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def pem_body(secret: str) -> str:
    """The Base64 of a PEM block without its headers; line breaks may be escaped."""
    lines = re.split(r"[\r\n]+|(?:\\+[rn])+", secret.split("-----")[2])
    return re.sub(r"\s+", "", "".join(x for x in lines if ":" not in x))


def encrypted(secret: str) -> bool:
    """The body is Base64 of whole cipher blocks."""
    try:
        raw = base64.b64decode(pem_body(secret), validate=True)
    except binascii.Error:
        return False
    return len(raw) > 0 and len(raw) % 8 == 0


def pem_length(secret: str) -> bool:
    """The body is Base64 whose outer DER length, or OpenSSH magic, fits it."""
    body = pem_body(secret)
    try:
        raw = base64.b64decode(body, validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n], "big")


def mixed(secret: str) -> bool:
    """At least 3 bits a character, with a digit: no word or placeholder."""
    n = len(secret)
    return any(c.isdigit() for c in secret) and -sum(k / n * math.log2(k / n) for k in Counter(secret).values()) >= 3


@dataclass(frozen=True)
class Rule:
    """``pattern`` begins with one of ``keywords``; group 1, or else all of it, is the secret."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool] | None = None
    checksum: bool = False


_END = r"(?![A-Za-z0-9_])"
_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_key", "private_key", "client_secret", "secret_key")
_VALUE = r"[A-Za-z0-9+/_=.-]{16,}+(?![A-Za-z0-9+/_=-])"
_PEM, _PEM_END = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"-----END (?:[A-Z]+ )*PRIVATE KEY-----"
_CASES = tuple(dict.fromkeys(c for n in _NAMES for c in (n, n.upper(), n.capitalize(), n.replace("_", "-"), n.split("_")[0] + "".join(p.capitalize() for p in n.split("_")[1:]))))
RULES = (
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}" + _END, crc_base62, True),
    Rule("npm", ("npm_",), r"npm_[A-Za-z0-9]{36}" + _END, crc_base62, True),
    Rule("extended-private-key", ("xprv",), rf"xprv[{BASE58}]{{107}}" + _END, base58_check, True),
    Rule("private-key", ("-----BEGIN",), _PEM + r"(?:(?!-----)[\s\x20-\x7e]){40,}+" + _PEM_END, pem_length, True),
    Rule("encrypted-private-key", ("-----BEGIN",), _PEM + r"(?:\s|\\[rn])*Proc-Type: ?4,ENCRYPTED(?:(?!-----)[\s\x20-\x7e]){40,}+" + _PEM_END, encrypted),
    Rule("jwt", ("eyJ",), r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{20,}", jwt_header, True),
    Rule("aws-access-key", ("AKIA", "ASIA"), r"A[KS]IA[A-Z2-7]{16}" + _END),
    Rule("google-api-key", ("AIza",), r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    Rule("slack", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), r"xox[abprs]-[A-Za-z0-9-]{10,}" + _END),
    Rule("stripe", ("sk_live_", "rk_live_"), r"[rs]k_live_[A-Za-z0-9]{24,}" + _END),
    Rule("gitlab", ("glpat-",), r"glpat-[A-Za-z0-9_-]{20}" + _END),
    Rule(
        "assigned", _CASES, rf"(?:{'|'.join(sorted(_CASES, key=len, reverse=True))})[\"']?\s{{0,4}}(?:=>|=|:)\s{{0,4}}"
        rf"(?:\"(?=[^\"\r\n]{{8,}}\")|'(?=[^'\r\n]{{8,}}')|[\"']?(?={_VALUE}))((?<=\")[^\"\r\n]{{8,}}(?=\")|(?<=')[^'\r\n]{{8,}}(?=')|{_VALUE})", mixed,
    ),
)


@functools.lru_cache(maxsize=1)
def automaton() -> tuple[ahocorasick.Automaton, list[re.Pattern]]:
    owners: dict[str, list[int]] = {}
    for i, rule in enumerate(RULES):
        for word in rule.keywords:
            owners.setdefault(word, []).append(i)
    out = ahocorasick.Automaton()
    for word, rules in owners.items():
        out.add_word(word, (len(word), tuple(rules)))
    out.make_automaton()
    return out, [re.compile(r.pattern) for r in RULES]


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(rule, start, end, checksum held, SHA-256 of the secret), sorted by place."""
    machine, patterns = automaton()
    tries: list[tuple[int, int]] = []
    for end, (size, rules) in machine.iter(text):
        tries += [(end - size + 1, i) for i in rules]
    tries.sort()
    out, past = [], [0] * len(RULES)
    for start, i in tries:
        if start < past[i] or not (m := patterns[i].match(text, start)):
            continue
        past[i] = m.end()
        group = 1 if m.re.groups else 0
        secret, rule = m.group(group), RULES[i]
        if rule.check is None or rule.check(secret):
            out.append((rule.name, m.start(group), m.end(group), rule.checksum, hashlib.sha256(secret.encode()).hexdigest()))
    return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each secret: id, rule, ``[start, end)`` in characters, ``checksum`` (whether an embedded one was checked and held) and the secret's SHA-256.

    The secret itself is not returned. Null and empty texts give no rows, a null
    id stays null, repeated rows give their findings again, an empty table gives an
    empty one. Other columns are left out; one of the result that has the id column's
    name gets a leading ``_``. Overlapping finds of different rules are all reported;
    of one rule, the first. Every text is scanned whole.
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
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(p, k) for p, k in zip(parts, kinds, strict=True))], names=["id", "rule", "start", "end", "checksum", "sha256"])

    return map_texts(df, run, "rule string, start int, end int, checksum boolean, sha256 string", id_column, text_column)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(load(spark, sf_dir, "documents"))
