"""Sequential folds over one text: chunkers and budgeted picks, vectorised through Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_at_space(text: str, limit: int = 1800, share: float = 0.6) -> list[str]:
    """Whole if it fits; else cut at the last blank beyond ``share`` of the limit, or hard."""
    out = []
    while len(text) > limit:
        at = text.rfind(" ", 0, limit)
        at = at if at > share * limit else limit
        out.append(text[:at].strip())
        text = text[at:].lstrip()
    return [x for x in [*out, text.strip()] if x]


def chunk_at_paragraph(text: str, limit: int = 1800, share: float = 0.5) -> list[str]:
    """Cut at a blank line, else a blank, beyond ``share`` of the limit."""
    out = []
    while len(text) > limit:
        at = max(text.rfind("\n\n", 0, limit), 0)
        if at <= share * limit:
            at = text.rfind(" ", 0, limit)
        at = at if at > share * limit else limit
        out.append(text[:at].strip())
        text = text[at:].lstrip()
    return [x for x in [*out, text.strip()] if x]


def pack_paragraphs(text: str, limit: int = 1000) -> list[str]:
    """Greedy packing of paragraphs up to ``limit``; one that is too long is cut at blanks, and what is left of it is packed with what follows."""
    out: list[str] = []
    current = ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        parts = chunk_at_space(p, limit) if len(p) > limit else [p]
        for part in parts:
            if current and len(current) + 2 + len(part) <= limit:
                current += "\n\n" + part
            else:
                if current:
                    out.append(current)
                current = part
    return [*out, current] if current else out


def soft_hard(text: str, soft: int = 700, hard: int = 1400, tail: int = 200) -> list[str]:
    """Lines gathered to ``soft``; broken before a line that starts a thought, at the latest at ``hard``; a short tail joins."""
    out: list[str] = []
    current = ""
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        starts = bool(re.match(r"(?:[\d๐-๙]+(?:\.[\d๐-๙]+)*[ .)]|[^\W\d_])", line)) and not line.startswith(("- ", "• "))
        if current and (len(current) + 1 + len(line) > hard or (len(current) >= soft and starts)):
            out.append(current)
            current = line
        else:
            current = f"{current}\n{line}" if current else line
    if current:
        if out and len(current) < tail and len(out[-1]) + 1 + len(current) <= hard:
            out[-1] += "\n" + current
        else:
            out.append(current)
    return out


def chunked(rows: DataFrame, key: str, text: str, chunker: Callable[[str], list[str]]) -> DataFrame:
    """(key, part, chunk): part counts from 0."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, c) for k, t in zip(b["k"].tolist(), b["t"].tolist()) for i, c in enumerate(chunker(t))]
            yield pd.DataFrame(out, columns=[key, "part", "chunk"]).astype({"part": "int32"})

    source = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return source.mapInPandas(run, f"{key} {kind}, part int, chunk string")


def budget_pick(items: list[tuple[int, int, int]], budget: int) -> list[int]:
    """Positions picked from (position, size, priority): priority rows are always taken and charged, then rows in order while they fit."""
    left, taken = budget, []
    for pos, size, priority in items:
        if priority:
            taken.append(pos)
            left -= size
    for pos, size, priority in items:
        if not priority and size <= left:
            taken.append(pos)
            left -= size
    return sorted(taken)


def budgeted(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """Rows of (group, pos, size, priority) picked per group; one group must fit a task (one document's parts)."""
    schema = rows.select(group, "pos", "size", "priority").schema

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        keep = set(budget_pick(list(zip(g["pos"].tolist(), g["size"].tolist(), g["priority"].tolist())), budget))
        return g[g["pos"].isin(keep)]

    return rows.select(group, "pos", "size", "priority").groupBy(group).applyInPandas(run, schema)
