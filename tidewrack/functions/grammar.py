"""A recursive-descent grammar for the lines of exports: strict JSON values and quoted CSV records.

Both parsers say where and why a text leaves the grammar. ``csv_run`` reads lines whose quotes may be broken over
lines and, after a broken quote, resumes at the next line that proves to be the start of a record.
"""

from __future__ import annotations

import re

_WS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)")
_SIMPLE = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_LITERAL = {"t": ("true", "boolean"), "f": ("false", "boolean"), "n": ("null", "null")}


class SyntaxFault(Exception):
    """Where (offset) and why a text leaves the grammar."""

    def __init__(self, at: int, why: str):
        super().__init__(f"{why} at {at}")
        self.at, self.why = at, why


def unescape(body: str) -> str:
    """The text of a JSON string's body."""
    if "\\" not in body:
        return body
    text = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _SIMPLE[m[1]], body)
    if any("\ud800" <= c <= "\udfff" for c in text):  # pairs become one character, lone ones a replacement sign
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def json_record(text: str, fields: tuple[str, ...] | None = None) -> tuple[str, dict[str, tuple[str, str]]]:
    """(type of the one value in ``text``, {field: (type, text)} of an object's own fields, all of them if ``fields`` is None).

    The descent keeps its open containers on a list, so depth is bounded by memory only. Of a name that
    occurs twice the last counts. Of objects and arrays the text is their JSON. Raises SyntaxFault.
    """
    pos, end = _WS.match(text, 0).end(), len(text)
    open_, found, outer, name, began = [], {}, "", "", 0

    def key(at: int) -> tuple[str, int]:
        m = _STRING.match(text, at)
        if not m:
            raise SyntaxFault(at, "a name in double quotes expected")
        at = _WS.match(text, m.end()).end()
        if text[at : at + 1] != ":":
            raise SyntaxFault(at, "':' expected")
        return m[1], _WS.match(text, at + 1).end()

    while True:  # a value starts here
        c = text[pos : pos + 1]
        kind, start = "", pos
        if c == '"':
            m = _STRING.match(text, pos)
            if not m:
                raise SyntaxFault(pos, "a string that is not closed or holds a bad sign")
            kind, pos = "string", m.end()
        elif c in ("{", "["):
            kind = "object" if c == "{" else "array"
            if not open_:
                outer = kind
            elif len(open_) == 1:
                began = pos
            at = _WS.match(text, pos + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                pos = at + 1
            else:
                open_.append(kind)
                if kind == "object":
                    raw, pos = key(at)
                    if len(open_) == 1:
                        name = unescape(raw)
                else:
                    pos = at
                continue
        elif c in _LITERAL and text.startswith(_LITERAL[c][0], pos):
            kind, pos = _LITERAL[c][1], pos + len(_LITERAL[c][0])
        elif c and (m := _NUMBER.match(text, pos)):
            kind, pos = "number", m.end()
        else:
            raise SyntaxFault(pos, "a value expected")
        if not open_:
            outer = outer or kind
        elif len(open_) == 1 and open_[0] == "object" and (fields is None or name in fields):
            found[name] = (kind, unescape(text[start + 1 : pos - 1]) if kind == "string" else text[start:pos])
        while True:  # a value ended here
            pos = _WS.match(text, pos).end()
            if not open_:
                if pos < end:
                    raise SyntaxFault(pos, "something follows the value")
                return outer, found
            c = text[pos : pos + 1]
            if c == ",":
                pos = _WS.match(text, pos + 1).end()
                if open_[-1] == "object":
                    raw, pos = key(pos)
                    if len(open_) == 1:
                        name = unescape(raw)
                break
            if c == ("}" if open_[-1] == "object" else "]"):
                kind = open_.pop()
                pos += 1
                if len(open_) == 1 and open_[0] == "object" and (fields is None or name in fields):
                    found[name] = (kind, text[began:pos])
                continue
            raise SyntaxFault(pos, "',' or the end of the object or array expected")


NEVER_CLOSED = "a quote that is never closed"
_PLAIN = re.compile(r'[^",]*')
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')


def csv_record(line: str) -> list[str]:
    """The values of one record without line break. Raises SyntaxFault for broken quoting."""
    values, pos, end = [], 0, len(line)
    while True:
        if line[pos : pos + 1] == '"':
            m = _QUOTED.match(line, pos)
            if not m:
                raise SyntaxFault(pos, NEVER_CLOSED)
            values.append(m[1].replace('""', '"'))
            pos = m.end()
            if pos < end and line[pos] != ",":
                raise SyntaxFault(pos, "text after a closing quote")
        else:
            m = _PLAIN.match(line, pos)
            values.append(m[0])
            pos = m.end()
            if pos < end and line[pos] == '"':
                raise SyntaxFault(pos, "a quote inside an unquoted value")
        if pos >= end:
            return values
        pos += 1


_KEY_START = re.compile(r'(?:"[^"\s]*\d[^"\s]*"|[^",\s]*\d[^",\s]*),')


def whole_record(line: str, width: int) -> list[str] | None:
    """The values of a line that by itself is a record of ``width`` values; None if it isn't."""
    try:
        values = csv_record(line.rstrip("\r\n"))
    except SyntaxFault:
        return None
    return values if len(values) == width and line.strip() else None


def starts_record(line: str, width: int) -> bool:
    """Whether a line proves to be the start of a record: it is a whole one, or its first value is closed and looks like a key (a digit, no blanks)."""
    return _KEY_START.match(line) is not None or whole_record(line, width) is not None


def csv_run(lines: list[str], width: int) -> list[tuple[int, int, list[str] | None, SyntaxFault | None]]:
    """(index, number of lines, values or None, fault) of each record of some lines; blank lines between records are skipped.

    A quoted value may span lines as long as none of them starts a record and the record it closes has ``width`` values.
    Where it doesn't close, the first line is a fault and reading resumes with the next line.
    """
    out, i = [], 0
    while i < len(lines):
        n = 1
        if lines[i].strip():
            values = fault = None
            try:
                values = csv_record(lines[i].rstrip("\r\n"))
            except SyntaxFault as e:
                fault = e
                if e.why == NEVER_CLOSED:
                    joined, j = lines[i], i + 1
                    while j < len(lines) and not starts_record(lines[j], width):
                        joined, j = f"{joined}\n{lines[j]}", j + 1
                        if (v := whole_record(joined, width)) is not None:
                            values, fault, n = v, None, j - i
                            break
            out.append((i, n, values, fault))
        i += n
    return out
