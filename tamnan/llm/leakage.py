"""Evaluation texts that leaked into training documents.

Texts are folded to their letters (case, width, accents, digits, blanks and punctuation don't count).
The n-grams of all test texts are a broadcast hash set (test sets are taken in blocks of bounded
size).  One scan looks all of them up in every document; none is left out, so an edit can't hide a
stretch that has n-grams beside it.  A document and a text go on if enough n-grams of the text occur in
the document, then if enough of them lie on one band of diagonals; both numbers are bounds from below
for a stretch of ``share`` of the text with one edit for every ``1 / EDITS`` matching letters.  What is
left is verified by aligning the test text with the document around it: the best stretch must cover
``share`` of the text, in order, with few changes.

Defined cases: null and empty texts and texts of fewer than ``N`` letters leak nothing and are leaked
by nothing; a repeated document is reported under each id; an item is reported once a document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamnan.functions.charblocks import blocks, hash_grams

#: Letters of an n-gram; edits a stretch may have for each matching letter; test texts and letters of one broadcast block.
N = 6
EDITS = 0.1
BLOCK_ITEMS, BLOCK_LETTERS = 20_000, 20_000_000
#: Cells of the table (document, n-gram) that is held at a time.
CELLS = 4_000_000

_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> folded letter, 0 for what doesn't count."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x30000):
            c = chr(cp)
            if c.isalpha():
                plain = unicodedata.normalize("NFKD", c).casefold()
                table[cp] = ord(plain[0]) if plain and plain[0].isalpha() else cp
        _FOLD = table
    return _FOLD


def fold(text: str) -> np.ndarray:
    f = fold_table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    return f[f > 0]


def letter_points(text: str) -> np.ndarray:
    """The code point of ``text`` at which each of its folded letters stands."""
    return np.flatnonzero(fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)])


def _scan(texts: list, grams: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each hit, letter position of the hit in its row, index into the sorted ``grams``)."""
    bits = np.zeros(1 << 22, dtype=bool)
    bits[(grams >> np.uint64(20)).astype(np.int64) & ((1 << 22) - 1)] = True
    for a, b, codes, offsets in blocks(texts):
        f = fold_table()[codes]
        keep = f > 0
        row = np.repeat(np.arange(b - a), np.diff(offsets))[keep]
        f = f[keep]
        g = hash_grams(f, N)
        if not len(g) or not len(grams):
            continue
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b - a))))
        at = np.flatnonzero(bits[(g >> np.uint64(20)).astype(np.int64) & ((1 << 22) - 1)])
        at = at[row[at] == row[at + N - 1]]
        i = np.searchsorted(grams, g[at])
        i[i == len(grams)] = 0
        ok = grams[i] == g[at]
        at, i = at[ok], i[ok]
        yield a, row[at], at - first[row[at]], i


class ItemTexts:
    """The n-grams of all test texts, where they stand in each, and classes of n-grams that stand in the same texts."""

    def __init__(self, sides: list[np.ndarray], share: float):
        hashes = [hash_grams(x, N) for x in sides]
        length = np.array([len(x) for x in sides], dtype=np.int64)
        self.sides = sides
        self.n = np.array([len(h) for h in hashes], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.n)))[:-1]
        self.grams, at = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]), return_inverse=True)
        self.gram_at = at.astype(np.int32)
        matched = np.ceil(share * length).astype(np.int64)
        #: N-grams that are left of ``matched`` letters with so many edits, and the width that their diagonals can't exceed.
        self.need = np.maximum(1, matched - (N - 1) * (1 + (EDITS * matched).astype(np.int64)))
        self.width = max(40, int(np.ceil(matched.max(initial=0) * (1 / DENSITY - 1))))
        side = np.repeat(np.arange(len(sides)), self.n)
        mark = np.random.default_rng(0).integers(1, 1 << 63, len(sides), dtype=np.uint64)
        sign = np.zeros(len(self.grams), dtype=np.uint64)
        np.add.at(sign, at, mark[side])
        _, example, self.kind = np.unique(sign, return_index=True, return_inverse=True)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(self.grams) + 1))
        self.kind_n = np.diff(first)[example]
        self.kind_begin = np.concatenate(([0], np.cumsum(self.kind_n)))[:-1]
        self.kind_side = side[order][_ranges(first[example], self.kind_n)].astype(np.int32)


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin``, ``n`` of them."""
    out = np.repeat(begin - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, place of each one's first, how many) of sorted values."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1])))
    return values[first], first, np.diff(np.append(first, len(values)))


def candidates(own: ItemTexts, row: np.ndarray, pos: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sides, least diagonals, largest diagonals) of bands that hold enough n-grams; ``row`` is sorted."""
    size, n_sides = len(own.grams), len(own.sides)
    step = max(1, CELLS // (size + n_sides))
    table = np.zeros(min(step, int(row[-1]) + 1 if len(row) else 0) * size, dtype=np.int32)
    for low in range(0, int(row[-1]) + 1 if len(row) else 0, step):
        a, b = np.searchsorted(row, [low, low + step])
        key = (row[a:b] - low) * size + gram[a:b]
        order = np.argsort(key)
        at = pos[a:b][order]
        key, first, times = _distinct(key[order])
        kinds, _, count = _distinct(np.sort(key // size * len(own.kind_n) + own.kind[key % size]))
        r, kind = np.divmod(kinds, len(own.kind_n))
        n = own.kind_n[kind]
        cell = np.repeat(r * n_sides, n) + own.kind_side[_ranges(own.kind_begin[kind], n)]
        score = np.bincount(cell, weights=np.repeat(count, n), minlength=1).reshape(-1)
        pair = np.flatnonzero(score)
        pair = pair[score[pair] >= own.need[pair % n_sides]]
        if not len(pair):
            continue
        table[key] = np.arange(1, len(key) + 1)
        r, side = np.divmod(pair, n_sides)
        n = own.n[side]
        end = np.cumsum(n)
        hit = own.gram_at[_ranges(own.begin[side], n)]
        hit += np.repeat((r * size).astype(np.int32), n)
        hit = table[hit]
        table[key] = 0
        found = np.flatnonzero(hit)
        which = np.repeat(np.arange(len(pair), dtype=np.int32), n)[found]
        q, hit = found - (end - n)[which], hit[found] - 1
        n = times[hit]
        diagonal = at[_ranges(first[hit], n)] - np.repeat(q, n)
        shift = -int(diagonal.min(initial=0)) // own.width * own.width + own.width
        bins = (int(diagonal.max(initial=0)) + shift) // own.width + 2
        band = np.repeat(which, n).astype(np.int64) * bins + (diagonal + shift) // own.width
        order = np.argsort(band)
        band, start, n = _distinct(band[order])
        least, most = np.minimum.reduceat(diagonal[order], start), np.maximum.reduceat(diagonal[order], start)
        following = np.concatenate((band[1:] == band[:-1] + 1, [False]))
        then = np.minimum(np.arange(len(band)) + 1, len(band) - 1)
        need = own.need[side[band // bins]]
        both = n + np.where(following, n[then], 0)
        # a band whose next one suffices by itself is within reach of that one's alignment
        keep = np.flatnonzero((both >= need) & ~(following & (n[then] >= need) & (n < need)))
        pick = band[keep] // bins
        yield r[pick] + low, side[pick], least[keep], np.where(following, most[then], most)[keep]


def may_carry(item: np.ndarray, doc: np.ndarray, least: int, most: int, share: float) -> bool:
    """Whether the item's letters that match on any diagonal in reach, three or more in a row, are many and dense enough: what ``best_stretch`` finds has no others."""
    slack = max(30, len(item) // 5)
    reach = most - least + 2 * slack + 1
    low = least - slack
    window = np.zeros(len(item) + reach - 1, dtype=doc.dtype)  # no letter is 0
    part = doc[max(0, low) : max(0, low + len(window))]
    window[max(0, -low) : max(0, -low) + len(part)] = part
    same = np.lib.stride_tricks.sliding_window_view(window, reach) == item[:, None]
    return _dense_enough((same[2:] & same[1:-1] & same[:-2]).any(axis=1), share)


def _dense_enough(three: np.ndarray, share: float) -> bool:
    """Whether some part of an item, given which of its 3-grams match, has ``share`` of its letters and ``DENSITY`` of its own."""
    covered = np.zeros(len(three) + 2, dtype=bool)
    for k in range(3):
        covered[k : k + len(three)] |= three
    least = share * len(covered)
    if np.count_nonzero(covered) < least:
        return False
    total = np.concatenate(([0], np.cumsum(covered)))
    # total[y] - total[x] >= DENSITY * (y - x) for the best x that leaves enough
    lead = total - DENSITY * np.arange(len(total))
    lowest = np.minimum.accumulate(lead)
    x = np.searchsorted(total, total - least, side="right") - 1
    return bool((lead - lowest[np.maximum(x, 0)] >= -1e-9)[x >= 0].any())


def best_stretch(item: np.ndarray, doc: np.ndarray, least: int, most: int) -> tuple[float, int, int, int]:
    """(share of ``item`` carried, in order, by one stretch of ``doc``, letter of ``doc`` that faces the item's first, first and last letter + 1 of the stretch); the second is about ``least`` to ``most``."""
    slack = max(30, len(item) // 5)
    low = max(0, least - slack)
    a = "".join(map(chr, item))
    b = "".join(map(chr, doc[low : max(0, most + len(item) + slack)]))
    matched = [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= 3]
    best, start, first, last = 0, 0, 0, 0
    run: list[tuple[int, int, int]] = []
    for m in matched:
        if run:
            pa, pb, size = run[-1]
            gap = max(m[0] - pa - size, m[1] - pb - size)
            if gap > MAX_GAP:
                run = []
        run.append(m)
        for k in range(len(run)):
            covered = sum(x[2] for x in run[k:]) * _dense(run[k:])
            if covered > best:
                best, start, first, last = covered, low + run[k][1] - run[k][0], low + run[k][1], low + m[1] + m[2]
    return best / len(item), start, first, last


#: Letters that may be changed, added or missing between two matching parts, and the part of a stretch that must match.
MAX_GAP = 10
DENSITY = 0.85


def _dense(run: list[tuple[int, int, int]]) -> bool:
    span = max(run[-1][0] + run[-1][2] - run[0][0], run[-1][1] + run[-1][2] - run[0][1])
    return sum(x[2] for x in run) >= DENSITY * span


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_texts: tuple[str, ...] = ("question", "evidence"), share: float = 0.5) -> DataFrame:
    """(key, item_key, side, start, covered, span_start, span_end): documents that carry at least ``share`` of a text of an item.

    ``start`` is the letter position (in folded letters) where the item's text would begin; the span is the
    leaking stretch in code points of the document's text.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    spark = documents.sparkSession
    schema = f"{key} bigint, {item_key} bigint, side string, start int, covered double, span_start int, span_end int"
    found = None
    rows = items.select(F.col(item_key).cast("bigint").alias("item"), *item_texts).where(F.col("item").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.sum(sum(F.coalesce(F.length(t), F.lit(0)) for t in item_texts)).alias("letters")).first()
    n_blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["letters"] or 0) // BLOCK_LETTERS))
    for block in range(n_blocks):
        part = rows if n_blocks == 1 else rows.where(F.pmod(F.hash("item"), F.lit(n_blocks)) == block)
        names, sides = [], []
        for r in part.collect():  # at most about BLOCK_ITEMS test items
            for name in item_texts:
                letters = fold(r[name])
                if len(letters) >= N:
                    names.append((r["item"], name))
                    sides.append(letters)
        if not sides:
            continue
        own = spark.sparkContext.broadcast((ItemTexts(sides, share), names))

        def verify(batches: Iterator[pd.DataFrame], own=own) -> Iterator[pd.DataFrame]:
            known, who = own.value
            for batch in batches:
                texts, keys, out = batch["text"].tolist(), batch["key"].tolist(), []
                for a, row, pos, i in _scan(texts, known.grams):
                    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
                    last, doc = -1, np.zeros(0, dtype=np.uint32)
                    for found in candidates(known, row, pos, i):
                        for r, side, least, most in zip(*(x.tolist() for x in found)):
                            if r != last:
                                last, doc = r, fold(texts[a + r])
                            if not may_carry(known.sides[side], doc, least, most, share):
                                continue
                            covered, *where = best_stretch(known.sides[side], doc, least, most)
                            if covered >= share and covered > best.get((r, side), (0.0,))[0]:
                                best[r, side] = (covered, *where)
                    for (r, side), (covered, start, first, end) in best.items():
                        points = letter_points(texts[a + r])
                        out.append((keys[a + r], *who[side], start, covered, int(points[first]), int(points[end - 1]) + 1))
                yield pd.DataFrame(out, columns=[key, item_key, "side", "start", "covered", "span_start", "span_end"]).astype({"start": "int32", "covered": "float64", "span_start": "int32", "span_end": "int32"})

        hits = docs.mapInPandas(verify, schema)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], schema)


def leaked_items(hits: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row a document and item, with what leaked and how much."""
    return hits.groupBy(key, item_key).agg(F.sort_array(F.collect_set("side")).alias("sides"), F.max("covered").alias("covered"))


def clean_documents(documents: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that leak nothing."""
    return documents.join(hits.select(key).distinct(), key, "left_anti")


def without_spans(documents: DataFrame, hits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the leaking stretches cut out of ``text``; a document's spans are at most two a test item.

    Documents without a hit stay as they are; null keys too.
    """
    spans = hits.groupBy(F.col(key).alias("_of")).agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end"))).alias("_spans"))
    joined = documents.join(spans, F.col(key) == F.col("_of"), "left")
    # what lies between the ends reached so far and the next span is kept
    kept = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["span_end"]).alias("at"),
            F.concat(s["out"], F.when(x["span_start"] > s["at"], F.substring(text, s["at"] + 1, x["span_start"] - s["at"])).otherwise("")).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(kept)).select(*documents.columns)
