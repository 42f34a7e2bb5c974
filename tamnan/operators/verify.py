"""Checks of what an answer claims against what it was given."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamnan.operators.text import arabic_digits

CITE = "(?:ข้อ|มาตรา) [0-9๐-๙]+(?:/[0-9๐-๙]+)?"


def numbers(c: Column) -> Column:
    """Distinct numbers of at least two characters, Thai digits read as Arabic."""
    found = F.regexp_extract_all(arabic_digits(F.coalesce(c, F.lit(""))), F.lit("([0-9][0-9.,]*[0-9])"))
    return F.array_distinct(found)


def citations(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(arabic_digits(F.coalesce(c, F.lit(""))), F.lit(f"({CITE})")))


# Thai number words.
_UNITS = {"ศูนย์": 0, "หนึ่ง": 1, "เอ็ด": 1, "สอง": 2, "ยี่": 2, "สาม": 3, "สี่": 4, "ห้า": 5, "หก": 6, "เจ็ด": 7, "แปด": 8, "เก้า": 9}
_SCALES = {"สิบ": 10, "ร้อย": 100, "พัน": 1_000, "หมื่น": 10_000, "แสน": 100_000, "ล้าน": 1_000_000}


def thai_number(words: str | None) -> int | None:
    """The value of a Thai number in words; None where a part is no number word.

    >>> thai_number("เจ็ดพันสี่ร้อยเก้า")
    7409
    """
    if not words:
        return None
    rest, total, part, digit = words.strip(), 0, 0, None
    while rest:
        word = next((w for w in sorted((*_UNITS, *_SCALES), key=len, reverse=True) if rest.startswith(w)), None)
        if word is None:
            return None
        rest = rest[len(word) :]
        if word in _UNITS:
            if digit is not None:
                return None
            digit = _UNITS[word]
        elif word == "ล้าน":
            total = (total + part + (digit or 0) or 1) * 1_000_000
            part, digit = 0, None
        else:
            part += (1 if digit is None else digit) * _SCALES[word]
            digit = None
    return total + part + (digit or 0)


def number_words(rows: DataFrame, key: str, words: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["k"], "value": pd.array([thai_number(w) for w in b["w"].tolist()], dtype="Int64")})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(words).alias("w")).mapInPandas(run, f"{key} {kind}, value bigint")


def reorder_list(lines: list[str], source: list[str]) -> list[str]:
    """Runs of three or more list lines put in the order in which ``source`` holds them; others stay.

    A run is reordered only if every line is found in ``source`` once.
    """
    out, i = list(lines), 0
    bare = lambda s: s.lstrip("-•0123456789๐๑๒๓๔๕๖๗๘๙.) ").strip()
    is_item = lambda s: bool(s.strip()) and (s.lstrip()[0] in "-•" or s.lstrip()[:1].isdigit())
    where = {bare(s): k for k, s in enumerate(source)}
    while i < len(lines):
        j = i
        while j < len(lines) and is_item(lines[j]):
            j += 1
        keys = [where.get(bare(s)) for s in lines[i:j]]
        if j - i >= 3 and None not in keys and len(set(keys)) == len(keys):
            bodies = [bare(s) for _, s in sorted(zip(keys, lines[i:j]))]
            marks = [s[: len(s) - len(bare(s))] if s.endswith(bare(s)) else "- " for s in lines[i:j]]
            out[i:j] = [m + b for m, b in zip(marks, bodies)]
        i = max(j, i + 1)
    return out


def amend(base: dict[str, str], operations: list[tuple[str, str, int | None, str]]) -> dict[str, str]:
    """Ordered amendments (kind, section, paragraph, text): set, replace (out of range: append) and append."""
    out = dict(base)
    for kind, section, paragraph, text in operations:
        parts = out[section].split("\n") if section in out else []
        if kind == "set":
            parts = [text]
        elif kind == "replace" and paragraph is not None and 1 <= paragraph <= len(parts):
            parts[paragraph - 1] = text
        else:
            parts.append(text)
        out[section] = "\n".join(parts)
    return out
