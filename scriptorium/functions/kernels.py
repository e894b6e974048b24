"""The tokenisers and splitters of ``text.py`` in plain Python, for kernels over Arrow batches.

Expressions over arrays are interpreted, element by element; a kernel reads a whole text at the speed of Python's string functions. White
space, word edges and lower case are those of the checking SQL.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = " \t\n\f\r"
#: Rows of a batch that a kernel returns.
BATCH = 20_000


def _ranges() -> dict[str, str]:
    """The characters of each general category, by its first letter, as the inside of a set; the planes without any are left out."""
    out: dict[str, list[list[int]]] = {}
    for i in (*range(0x33800), *range(0xE0000, 0xE0400)):
        ranges = out.setdefault(unicodedata.category(chr(i))[0], [])
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) for k, ranges in out.items()}


_KIND = _ranges()
_L, _M, _N = (_KIND[k] for k in "LMN")
_WORD = re.compile(rf"(?:[{_L}][{_L}{_M}]*(?:['’.:·][{_L}][{_L}{_M}]*)*|[{_N}]+(?:['’.,;][{_N}]+)*|_)+")
_ASCII_WORD = re.compile(r"[A-Za-z0-9_]+(?:(?:(?<=[A-Za-z])['.:](?=[A-Za-z])|(?<=[0-9])['.,;](?=[0-9]))[A-Za-z0-9_]+)*")
#: Upper-case letters, as the inside of a set.
UPPER = "".join(c for c in map(chr, (*range(0x2000), *range(0x2100, 0x2E00), *range(0xA640, 0xA800), *range(0xFF00, 0xFFF0), *range(0x10400, 0x1F000))) if unicodedata.category(c) == "Lu")
_LETTER = re.compile(f"[{_L}]")
_SPACES, _WS = re.compile(f"[{SPACE}]+"), re.compile(f"[^{SPACE}]+")


class _Table(dict):
    """What a character becomes, found out once."""

    def __init__(self, f: Callable[[str], str | None]) -> None:
        self.f = f

    def __missing__(self, code: int) -> str | None:
        self[code] = value = self.f(chr(code))
        return value


def _shape(c: str) -> str:
    """An ASCII character that a word's pattern treats alike; a mark becomes DEL."""
    if c.isascii():
        return c if c != "\x7f" else " "
    return {"’": "'", "·": ":"}.get(c) or {"L": "a", "N": "0", "M": "\x7f"}.get(unicodedata.category(c)[0], " ")


_SHAPES = _Table(_shape)
_LETTERS = _Table(lambda c: c if unicodedata.category(c)[0] == "L" else None)
_LETTERS_AND_SPACE = _Table(lambda c: c if c in SPACE + "\x02" or unicodedata.category(c)[0] == "L" else None)
#: Characters at which str.split() cuts and the checking SQL does not.
_OTHER_SPACE = re.compile("[\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_END_A, _END_B = (re.compile(rf"[.!?](?=[{SPACE}{q}]|\Z)") for q in ("\"')", '")'))
_CLOSED = (".", "!", "?")


def lower(text: str) -> str:
    """Lower case character by character: one for each, wherever it stands."""
    return text.lower() if "İ" not in text and "Σ" not in text else text.replace("İ", "i").replace("Σ", "σ").lower()


def cased_tokens(text: str) -> list[str]:
    if text.isascii():
        found = _ASCII_WORD.findall(text)
    elif "\x7f" in (shape := text.translate(_SHAPES)):
        found = _WORD.findall(text)
    else:
        found = [text[m.start() : m.end()] for m in _ASCII_WORD.finditer(shape)]
    return [w for w in found if w.strip("_")] if "_" in text else found


def tokens(text: str) -> list[str]:
    """TOK-01."""
    return cased_tokens(lower(text))


def splitter(text: str) -> Callable[[str], list[str]]:
    """What cuts this text, or a part of it, into white-space words."""
    return _WS.findall if _OTHER_SPACE.search(text) else str.split


def sentences(text: str, ends: re.Pattern[str] = _END_A) -> list[str]:
    """TOK-03; with ``SENTENCES_B`` TOK-04."""
    at = [0, *[m.end() for m in ends.finditer(text)], len(text)]
    parts = [text[a:b] for a, b in zip(at, at[1:])]
    if "\x01" in text:
        parts = [q for p in parts for q in p.split("\x01")]
    parts = [p.strip(SPACE) for p in parts]
    return [p for p in parts if p and (p.endswith(_CLOSED) or _SPACES.search(p))]


SENTENCES_B = _END_B


def paragraphs(text: str, delimiter: str = "\n\n") -> list[str]:
    """TOK-08."""
    return [p for p in (q.strip(SPACE) for q in text.split(delimiter)) if p]


def size(word: str) -> int:
    """Bytes."""
    return len(word) if word.isascii() else len(word.encode())


def letters(word: str) -> str:
    return word if word.isascii() and word.isalpha() else word.translate(_LETTERS)


def has_letter(token: str) -> bool:
    """Of a lower-cased token."""
    return token.islower() if token.isascii() else _LETTER.search(token) is not None


def plain(parts: list[str]) -> list[str]:
    """Sentences as letters and single spaces, lower-cased, a space on both sides."""
    if not parts:
        return []
    if any("\x02" in p for p in parts):
        parts = [p.replace("\x02", "") for p in parts]
    return [f" {p} " for p in lower(_SPACES.sub(" ", "\x02".join(parts).translate(_LETTERS_AND_SPACE))).split("\x02")]


def total(values: Iterable[float]) -> float:
    """Added one after the other; ``sum`` would correct for rounding."""
    return reduce(add, values, 0.0)


def sample_variance(values: list[float]) -> float | None:
    n = len(values)
    if n < 2:
        return None
    mean = total(values) / n
    return total([(x - mean) * (x - mean) for x in values]) / n * n / (n - 1)


_KINDS = {pa.float64(): "double", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.float64()): "array<double>"}


def mapped(rows: DataFrame, keys: list[str], measure: Callable[[str], Iterable[tuple]], fields: dict[str, pa.DataType]) -> DataFrame:
    """(keys, fields): for every row what ``measure`` makes of its ``text``, a tuple for each row of the result; a null text counts as empty."""
    kinds = list(fields.values())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at: list[int] = []
            out: list[tuple] = []

            def made() -> pa.RecordBatch:
                columns = zip(*out, strict=True) if out else ([] for _ in kinds)
                return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(at, pa.int64())) for k in keys] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*keys, *fields])

            for i, text in enumerate(batch.column("text").to_pylist()):
                found = list(measure(text or ""))
                out += found
                at += [i] * len(found)
                if len(out) >= BATCH:
                    yield made()
                    at, out = [], []
            yield made()

    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], *[f"`{n}` {_KINDS[t]}" for n, t in fields.items()]])
    read = rows.select(*keys, "text") if "text" not in keys else rows.select(*keys)
    return read.mapInArrow(run, schema)
