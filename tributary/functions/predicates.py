"""Text predicates with the meaning that SQLite gives them, as Spark expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.errors import UnsupportedOperation


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _folded(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def sql_like(column: Column | str, pattern: str | None, escape: str | None = None) -> Column:
    """``LIKE`` that ignores the case of A to Z and of no other letters; a null pattern matches nothing."""
    if pattern is None:
        return F.lit(None).cast("boolean")
    if escape is not None and len(escape) != 1:
        raise ValueError("ESCAPE must be one character")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape is not None and c == escape:
            i += 1
            c = pattern[i] if i < len(pattern) else ""
            out.append("\\" + c if c in ("%", "_", "\\") else c)
        else:
            out.append("\\\\" if c == "\\" else c)
        i += 1
    return F.translate(_column(column), string.ascii_uppercase, string.ascii_lowercase).like(_folded("".join(out)))


def like_to_regex(pattern: str, escape: str | None = None) -> str:
    """A ``LIKE`` pattern as a Java regular expression over the whole string, blind to the case of A to Z only."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape is not None and c == escape:
            i += 1
            c = pattern[i] if i < len(pattern) else ""
            out.append(_SPECIAL.sub(r"\\\1", c))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or _SPECIAL.sub(r"\\\1", c))
        i += 1
    return "(?is)^" + "".join(out) + r"\z"


_SPECIAL = re.compile(r"([\\.^$|()\[\]{}*+?])")


def glob_to_regex(pattern: str) -> str:
    """``* ? [..]`` as a Java regular expression over the whole string."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            negated = j < len(pattern) and pattern[j] == "^"
            j += negated
            end = pattern.find("]", j + 1 if j < len(pattern) and pattern[j] == "]" else j)
            if end < 0:
                return r"(?!)"  # a class that isn't closed matches nothing
            body = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[j:end])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(_SPECIAL.sub(r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def glob(column: Column | str, pattern: str) -> Column:
    """``GLOB``: case matters, ``*`` and ``?`` and classes, the whole string."""
    return _column(column).rlike(glob_to_regex(pattern))


def regexp(column: Column | str, pattern: str) -> Column:
    return _column(column).rlike(pattern)


def match(column: Column | str, pattern: str) -> Column:
    raise UnsupportedOperation("MATCH needs a full-text index; use regexp() or sql_like()")


def bind(text: str, values: list | tuple) -> str:
    """An expression with its ``?`` marks replaced by literals; marks in quotes stay."""
    out, quote, used = [], "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "?":
            if used >= len(values):
                raise ValueError("more marks than bound values")
            out.append(literal(values[used]))
            used += 1
            continue
        out.append(c)
    if used < len(values):
        raise ValueError("more bound values than marks")
    return "".join(out)


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


_WORD = re.compile(r"[^\W\d]\w*")
_SPACE = re.compile(r"(?:\s+|--[^\n]*|/\*.*?\*/)+", re.S)
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def _quote_end(text: str, at: int) -> int:
    """Where a quoted part that begins at ``at`` ends; a doubled quote, or in strings one after a backslash, is part of it."""
    quote, i = text[at], at + 1
    while i < len(text):
        if text[i] == "\\" and quote != "`":
            i += 2
        elif text[i] != quote:
            i += 1
        elif text[i + 1 : i + 2] == quote:
            i += 2
        else:
            return i + 1
    return len(text)


def _unquoted(part: str) -> str:
    """What a string literal stands for; ``%`` and ``_`` keep a backslash before them."""
    quote, body, out, i = part[0], part[1:-1], [], 0
    while i < len(body):
        c, after = body[i], body[i + 1 : i + 2]
        if c == "\\" and after:
            out.append("\\" + after if after in "%_" else _ESCAPES.get(after, after))
            i += 2
        else:
            out.append(c)
            i += 2 if c == quote else 1
    return "".join(out)


def translate(text: str) -> str:
    """A condition or query in which ``LIKE`` and ``GLOB`` mean what they mean to SQLite.

    ``LIKE`` ignores the case of A to Z, takes backslashes as they are and knows
    ``ESCAPE``; ``GLOB`` knows case. Both become ``RLIKE`` with an equal pattern, so
    what stands left of them needn't be understood. Quoted parts, names and comments
    stay. A ``LIKE`` whose pattern is no string literal becomes ``ILIKE`` (which also
    ignores the case of other letters); such a ``GLOB`` is an error.
    """
    out, at, operand = [], 0, False
    if (first := re.match(r"\s*(\w+)", text)) and first.group(1).upper() in ("SHOW", "DESC", "DESCRIBE"):
        return text
    while at < len(text):
        c = text[at]
        if space := _SPACE.match(text, at):
            out.append(space.group())
            at = space.end()
            continue
        if c in "'\"`":
            end = _quote_end(text, at)
            out.append(text[at:end])
            at, operand = end, True
            continue
        word = _WORD.match(text, at)
        if word is None:
            out.append(c)
            at, operand = at + 1, c in ")]" or c.isdigit()
            continue
        name, at = word.group(), word.end()
        upper = name.upper()
        if upper not in ("LIKE", "GLOB") or not operand or out[-1:] == ["."]:
            part = out[-1:] == ["."]
            out.append(name)
            operand = part or (operand if upper == "NOT" else upper not in _NO_OPERAND)
            continue
        skipped = _SPACE.match(text, at)
        start = skipped.end() if skipped else at
        if text[start : start + 1] not in ("'", '"') or not text[start:]:
            if upper == "GLOB":
                raise UnsupportedOperation("GLOB needs a string literal as its pattern")
            null = (w := _WORD.match(text, start)) and w.group().upper() == "NULL"
            out.append("LIKE" if null else "ILIKE")
            operand = False
            continue
        at = _quote_end(text, start)
        pattern, escape = _unquoted(text[start:at]), None
        if upper == "LIKE" and (given := _ESCAPE.match(text, at)):
            at = _quote_end(text, given.end())
            escape = _unquoted(text[given.end() : at])
            if len(escape) != 1:
                raise ValueError("ESCAPE must be one character")
        regex = like_to_regex(pattern, escape) if upper == "LIKE" else glob_to_regex(pattern)
        out.append("RLIKE " + literal(regex))
        operand = True
    return "".join(out)


_ESCAPE = re.compile(r"\s*ESCAPE\s*(?=['\"])", re.I)
#: Words that no operand ends with.
_NO_OPERAND = frozenset("AND OR WHERE SELECT ON WHEN THEN ELSE HAVING BY CASE IN BETWEEN IS LIKE RLIKE ILIKE REGEXP FROM AS".split())
