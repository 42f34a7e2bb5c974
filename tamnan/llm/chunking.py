"""Oversized texts cut at natural boundaries, content-defined.

A rolling hash over 16 characters marks landmarks; between the minimum and maximum size of a piece the
first landmark snaps to the best natural boundary near it (heading, blank line, line, sentence, word).
Landmarks and boundaries depend on the text around them only, so an edit alters only pieces near it.
Neighbours share exactly ``overlap`` characters.

Defined cases: a text within the limit is one piece; null and empty texts and items without a limit
(null or unknown scope) have no pieces cut - they are one whole piece, null texts none; a text without
any boundary is cut at the landmark, never before a combining mark where that can be avoided;
``overlap`` must be less than half of ``max_size``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamnan.functions.charblocks import hash_grams
from tamnan.functions.cluster import broadcast_if_small

WINDOW = 16
_BOUNDARY = re.compile(r"(?P<heading>\n+(?=(?:\d+(?:\.\d+)+ |\d+\. |หมวด |ส่วนที่ |บทที่ |(?:ข้อ|มาตรา) [\d๐-๙]|#)))|(?P<blank>\n[ \t]*\n+)|(?P<line>\n)|(?P<sentence>[.!?。！？।…]+[”»」』)\"]*(?:\s+|(?<=[。！？])))|(?P<word>[ \t ]+)")
_LEVEL = {"heading": 5, "blank": 4, "line": 3, "sentence": 2, "word": 1}


def boundaries(text: str, headings: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(positions where a piece may end, levels); a heading belongs to the piece it begins."""
    at, level = [], []
    for m in _BOUNDARY.finditer(text):
        at.append(m.end())
        level.append(_LEVEL[m.lastgroup])
    for h in headings:
        i = text.find(h) if h else -1
        while i > 0:
            if text[i - 1] == "\n" and text[i + len(h) : i + len(h) + 1] in ("", "\n"):
                at.append(i)
                level.append(5)
            i = text.find(h, i + len(h))
    order = np.argsort(np.array(at, dtype=np.int64), kind="stable")
    return np.array(at, dtype=np.int64)[order], np.array(level, dtype=np.int64)[order]


def landmarks(text: str, spacing: int) -> np.ndarray:
    """Positions whose preceding ``WINDOW`` characters hash to 0 modulo about ``spacing``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = hash_grams(codes, WINDOW)
    return np.flatnonzero((h >> np.uint64(8)) % np.uint64(max(2, spacing)) == 0) + WINDOW


def pieces(text: str, max_size: int, overlap: int = 0, headings: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """[start, end) of the pieces of ``text``: none longer than ``max_size``, each sharing ``overlap`` with the one before."""
    if max_size <= 0 or not 0 <= overlap < max(1, max_size / 2):
        raise ValueError(f"max_size {max_size}, overlap {overlap}")
    n = len(text)
    if n <= max_size:
        return [(0, n)] if n else []
    at, level = boundaries(text, headings)
    marks = landmarks(text, max(2, max_size // 4))
    out, start, cut = [], 0, 0
    while n - start > max_size:
        top = start + max_size
        low = min(top, max(cut + max(1, max_size // 3), start + overlap + 1))
        i = np.searchsorted(marks, low)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= top else None
        end = _snap(at, level, low, top, mark, max_size // 6)
        if end is None:
            end = mark if mark is not None else top
            while end > low and end < n and _combining(text[end]):
                end -= 1
        out.append((start, end))
        start, cut = end - overlap, end
    out.append((start, n))
    return out


def _snap(at: np.ndarray, level: np.ndarray, low: int, top: int, mark: int | None, radius: int) -> int | None:
    aim = mark if mark is not None else top
    for a, b in ((max(low, aim - radius), min(top, aim + radius)), (low, top)):
        i, j = np.searchsorted(at, a), np.searchsorted(at, b, side="right")
        if i < j:
            best = level[i:j].max()
            near = at[i:j][level[i:j] == best]
            return int(near[np.argmin(np.abs(near - aim))])
    return None


def _combining(c: str) -> bool:
    return "̀" <= c <= "ͯ" or c in "ัำิีึืฺุู็่้๊๋์ํ๎ๅ" or "ऺ" <= c <= "ॏ" or c in "゙゚‍️"


def split_oversized(items: DataFrame, limits: DataFrame, key: str = "passage_id", text: str = "text", scope: str = "kind", heading: str = "heading") -> DataFrame:
    """(key, piece, n_pieces, start_pos, end_pos, oversized, piece_text) for every item.

    ``limits``: scope, max_size, overlap_size (several rows of one scope: the smallest limit holds).
    Texts within their limit don't leave the JVM; the others are cut whole, each in one call.
    """
    least = limits.where("size_unit = 'characters' AND max_size > 0").groupBy("scope").agg(F.min(F.struct("max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size"))).alias("l"))
    least = broadcast_if_small(least.select(F.col("scope").alias("limit_scope"), F.col("l.max_size").alias("max_size"), F.col("l.overlap_size").alias("overlap_size")))
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(scope).alias("scope"), F.col(heading).alias("heading")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    rows = rows.join(least, F.col("scope") == F.col("limit_scope"), "left")
    big = F.coalesce(F.length("text") > F.col("max_size"), F.lit(False))

    @F.pandas_udf("array<struct<s:int,e:int,t:string>>")
    def cut(texts: pd.Series, headings: pd.Series, sizes: pd.Series, overlaps: pd.Series) -> pd.Series:
        def one(t, h, m, o):
            return None if t is None else [(s, e, t[s:e]) for s, e in pieces(t, int(m), int(o), (h,) if h else ())]

        return pd.Series([one(*x) for x in zip(texts.tolist(), headings.tolist(), sizes.tolist(), overlaps.tolist())], dtype=object)

    # one scan: texts within their limit reach the worker as nulls; marked so that the optimiser doesn't call it once for each use
    parts = rows.withColumn("parts", cut.asNondeterministic()(F.when(big, F.col("text")), F.when(big, F.col("heading")), "max_size", "overlap_size"))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length("text").alias("e"), F.col("text").alias("t")))
    pieced = parts.select("key", big.alias("oversized"), F.coalesce("parts", whole).alias("parts")).select("key", "oversized", F.size("parts").alias("n_pieces"), F.posexplode("parts").alias("piece", "p"))
    return pieced.select(F.col("key").alias(key), "piece", "n_pieces", F.col("p.s").alias("start_pos"), F.col("p.e").alias("end_pos"), "oversized", F.col("p.t").alias("piece_text"))
