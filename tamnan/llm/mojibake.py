"""Text that was decoded with the wrong character encoding: find it and restore it.

1. Adjacent character pairs of the whole corpus are counted over a fixed alphabet of ``K`` character
   classes (one class per character for the scripts that single-byte encodings map into, one per
   block elsewhere), so the table has at most K*K entries whatever the corpus.  Rows that hold a
   decodable multi-byte image or a long run of high Latin letters are left out of the *counts* only:
   garbled text is consistent in itself and would otherwise look probable.
2. Each pair scores ``-PMI - BIAS``; Ruzzo-Tompa maximum-scoring segments of that score are the
   improbable runs of a text.
3. Inverse mappings are tried only inside those runs and accepted when the decoded run has the
   higher mutual information.

Defined cases: null or empty text is not affected and restored as it is; a run whose bytes were lost
(``?`` or U+FFFD in place of a byte) is affected, and U+FFFD stands for what can't be had.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamnan.functions.charblocks import blocks
from tamnan.functions.cluster import columns

K = 704
BIAS = 0.5
MIN_SEGMENT = 4.0
UNSEEN = -6.0
#: Most that a pair that never occurs can be worth.
NEVER = -2.5

_BLOCKS = [(0x370, 0x400, 640), (0x400, 0x530, 641), (0x900, 0x980, 642), (0x3040, 0x30A0, 643), (0x30A0, 0x3100, 644), (0x3400, 0xA000, 645), (0x3000, 0x3040, 646), (0xFF00, 0xFFF0, 647), (0x2500, 0x25A0, 648), (0x2200, 0x2300, 649), (0x2100, 0x2150, 650), (0x25A0, 0x2600, 651), (0x20A0, 0x20D0, 652), (0x300, 0x370, 653), (0xE000, 0xF900, 654), (0xAC00, 0xD7B0, 655), (0x590, 0x600, 656), (0x600, 0x700, 657), (0x1E00, 0x2000, 658), (0x1F000, 0x20000, 659), (0xFB00, 0xFB10, 660)]


def _class_table() -> np.ndarray:
    table = np.full(0x110000, K - 1, dtype=np.int32)
    for a, b, c in _BLOCKS:
        table[a:b] = c
    table[:0x180] = np.arange(0x180)
    table[0x30:0x3A] = 0x30
    table[0xE00:0xE80] = 0x180 + np.arange(0x80)
    table[0x2000:0x2070] = 0x200 + np.arange(0x70)
    for i, cp in enumerate([0x192, 0x2C6, 0x2DC, 0x20AC, 0x2122, 0xFFFD]):
        table[cp] = 624 + i
    return table


_CLASSES: np.ndarray | None = None


def classes(codes: np.ndarray) -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _class_table()
    return _CLASSES[codes]


def _byte_maps() -> dict[str, dict[str, int]]:
    """For each encoding a text may have been read in: character -> byte, undefined bytes as C1 controls."""
    maps = {}
    for name in ("cp1252", "latin-1", "cp874", "mac_roman", "cp437"):
        m = {}
        for b in range(0x80, 0x100):
            try:
                m[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                m[chr(b)] = b
            if name in ("cp1252", "cp874", "latin-1") and b < 0xA0:
                m.setdefault(chr(b), b)
        maps[name] = m
    return maps


BYTES = _byte_maps()
ANY_IMAGE = frozenset(c for m in BYTES.values() for c in m)
_HOLES = "?�"


def _class(chars) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def _image_regex(name: str) -> re.Pattern:
    """Sequences that are the image of one UTF-8 multi-byte character; a continuation may be a lost byte."""
    m = BYTES[name]
    of = lambda a, b: [c for c, x in m.items() if a <= x < b]
    tail = _class(of(0x80, 0xC0) + list(_HOLES))
    return re.compile(f"{_class(of(0xC2, 0xE0))}{tail}|{_class(of(0xE0, 0xF0))}(?:{tail}{{2}}|[{re.escape(_HOLES)}])|{_class(of(0xF0, 0xF5))}{tail}{{3}}")


#: (read as, true encoding) of one byte a character.
SINGLE = (("latin-1", "cp874"), ("cp1252", "cp874"), ("mac_roman", "cp874"), ("mac_roman", "cp1252"), ("cp874", "cp1252"), ("cp437", "cp1252"))
#: True encodings of two bytes a character; all are tried, as each makes characters of the others' bytes.
WIDE = ("gbk", "shift_jis", "euc_jp")
IMAGES = {name: _image_regex(name) for name in BYTES}
_IN = {name: re.compile(_class(m)) for name, m in BYTES.items()}
_ASCII_LETTER, _THAI, _THREE_THAI = re.compile("[A-Za-z]"), re.compile("[ก-๛]"), re.compile("[\u0e01-\u0e5b]{3}")


def _decoded(name: str, true: str) -> dict[int, str]:
    """What each character that ``name`` makes of a byte is in ``true``; U+FFFD where that has none."""
    return {ord(c): bytes([b]).decode(true, "replace") for c, b in BYTES[name].items()}


DECODED = {pair: _decoded(*pair) for pair in SINGLE}


def _count(name: str, s: str) -> int:
    """How many characters of ``s`` are images of a byte under ``name``."""
    return len(_IN[name].findall(s))


def _n_ascii(s: str) -> int:
    return len(s.encode("ascii", "ignore"))


_SEED = re.compile("[ÂÃâà-ïÐÑ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2}[ÂÃâà-ïÐÑ]?|[¡-ÿ]{4}|(?:เ[ธน][\u0080-\u00a0€…‘’“”•–—ก-ฟ?�]){3}|[αΓ][╕╣Ç]|[∞‡·≈∂√ƒ]{2}|[a-zß-ÿ][ก-ฺเ-๛][a-zß-ÿ]|[a-zß-ÿ][À-ÖØ-Þ‰‚¸][a-zß-ÿ]|∞|�")


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(K * K, dtype=np.int64)
    for batch in batches:
        texts = [t for t in batch["text"] if t and not _SEED.search(t)]
        for _, _, codes, offsets in blocks(texts):
            c = classes(codes)
            pair = c[:-1] * K + c[1:]
            keep = np.ones(len(pair), dtype=bool)
            inner = offsets[1:-1] - 1
            keep[inner[(inner >= 0) & (inner < len(keep))]] = False
            counts += np.bincount(pair[keep], minlength=K * K)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"pair": at.astype(np.int32), "n": counts[at]})


def pair_information(texts: DataFrame) -> np.ndarray:
    """K x K pointwise mutual information of adjacent classes over all rows of ``texts`` (column text)."""
    rows = texts.select("text").mapInPandas(_pair_counts, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    got = columns(rows)  # at most K*K rows
    n = np.zeros(K * K)
    n[got["pair"].astype(np.int64)] = got["n"].astype(float)
    n = n.reshape(K, K)
    total = max(n.sum(), 1.0)
    left, right = n.sum(1), n.sum(0)
    expected = np.outer(left, right) / total
    pmi = np.log((n + 0.05) / (expected + 0.05))
    pmi = np.where(n > 0, pmi, np.minimum(pmi, NEVER))
    rare = (left + right) < 3
    pmi[rare, :] = UNSEEN
    pmi[:, rare] = UNSEEN
    return np.clip(pmi, UNSEEN, 8.0).astype(np.float32)


def maximum_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo-Tompa: all maximal-scoring disjoint segments [a, b) of ``score``, on runs of equal sign."""
    if not len(score):
        return []
    positive = score > 0
    edges = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate(([0], edges))
    sums = np.add.reduceat(score.astype(float), starts)
    ends = np.concatenate((edges, [len(score)]))
    found: list[list[float]] = []  # [left cumulative, right cumulative, a, b]
    total = 0.0
    for a, b, s in zip(starts, ends, sums):
        before, total = total, total + s
        if s <= 0:
            continue
        cand = [before, total, a, b]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= cand[0]:
                j -= 1
            if j < 0 or found[j][1] >= cand[1]:
                found.append(cand)
                break
            cand = [found[j][0], cand[1], found[j][2], cand[3]]
            del found[j:]
    return [(int(x[2]), int(x[3]), x[1] - x[0]) for x in found]


class Restorer:
    """Tests inverse mappings inside improbable runs against the corpus's pair information."""

    def __init__(self, pmi: np.ndarray):
        self.pmi = pmi
        self.seen = pmi.max(axis=1) > NEVER
        self.images: dict[tuple[str, str], str] = {}

    def badness(self, text: str) -> tuple[float, float]:
        """(sum of the improbable part, minus the mean information): smaller is more like the corpus."""
        if len(text) < 2:
            return 0.0, 0.0
        c = classes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        p = self.pmi[c[:-1], c[1:]]
        return float(np.maximum(-p - BIAS, 0).sum()), -float(p.mean())

    def runs(self, text: str, least: float = MIN_SEGMENT) -> list[tuple[int, int]]:
        c = classes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        found = [(a, b + 1) for a, b, s in maximum_segments(-self.pmi[c[:-1], c[1:]] - BIAS) if s >= least]
        merged: list[list[int]] = []
        for a, b in sorted(found):
            for step, edge in ((-1, a - 1), (1, b)):
                thai = 0
                while 0 <= edge < len(text) and (ord(text[edge]) > 0x7F or text[edge] in _HOLES):
                    thai += "\u0e00" < text[edge] < "\u0e7f"
                    if thai > 3:
                        break
                    edge += step
                a, b = (edge + 1, b) if step < 0 else (a, edge)
            if merged and a - merged[-1][1] <= 12:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged]

    def promising(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts of a block hold a segment of ``MIN_SEGMENT`` and a character beyond ASCII (without one no mapping applies).

        The best segment of a text is the largest rise of the running sum of its scores; between texts the
        sum falls by more than it can have risen, so one running minimum serves the whole block.
        """
        n = len(offsets) - 1
        found = np.zeros(n, dtype=bool)
        if len(codes) < 2:
            return found
        c = classes(codes)
        score = (-self.pmi[c[:-1], c[1:]] - BIAS).astype(np.float64)
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(codes))] - 1
        score[inner] = 0.0
        rise = np.concatenate(([0.0], np.cumsum(np.maximum(score, 0.0))))
        edges = np.unique(inner)
        score[edges] = -np.diff(np.concatenate(([0.0], rise[edges]))) - 1.0
        total = np.concatenate(([0.0], np.cumsum(score)))
        at = np.flatnonzero(total - np.minimum.accumulate(total) >= MIN_SEGMENT - 1e-6)
        found[np.unique(np.searchsorted(offsets, at, side="right") - 1)] = True
        strange = np.concatenate(([0], np.cumsum(codes > 0x7F)))
        return found & (strange[offsets[1:]] > strange[offsets[:-1]])

    def restore(self, text: str) -> tuple[str, str, bool]:
        """(restored text, encodings as ``read>true`` joined by +, lossy)."""
        how: list[str] = []
        lossy = False
        seen = {text}
        while True:
            out, last, changed = [], 0, False
            for a, b in self.runs(text, MIN_SEGMENT / 3 if how else MIN_SEGMENT):
                if a < last:
                    continue
                got = self.invert(text, a, b)
                if got:
                    new, name, lost = got
                    out += [text[last:a], new]
                    last, changed, lossy = b, True, lossy or lost
                    how.append(name)
            if not changed:
                break
            text = "".join(out) + text[last:]
            if text in seen:  # mappings that undo each other
                break
            seen.add(text)
        return text, "+".join(dict.fromkeys(how)), lossy

    def invert(self, text: str, a: int, b: int) -> tuple[str, str, bool] | None:
        run = text[a:b]
        if run.isascii():
            return None
        around = lambda s: text[max(0, a - 1) : a] + s + text[b : b + 1]
        before = self.badness(around(run))
        best = None
        for new, name, lost in self._candidates(text, a, b):
            worth = self.badness(around(new.replace("�", "")))
            if best is None or worth < best[0]:
                best = (worth, (new, name, lost))
        if best is None:
            return None
        return best[1] if best[0][0] < before[0] - 1.0 or (best[0][0] <= before[0] and best[0][1] < before[1] - 0.3) else None

    def _candidates(self, text: str, a: int, b: int) -> Iterator[tuple[str, str, bool]]:
        """(decoded run, encodings, lossy) of the inverse mappings that fit the run at all."""
        run = text[a:b]
        for name in BYTES:
            current, lost = run, False
            while IMAGES[name].search(current) and (got := self._utf8(current, name, _count(name, current))):
                if got[0] == current:
                    break
                current, lost = got[0], lost or got[1]
                yield current, f"{name}>utf-8", lost
        for name, true in SINGLE:
            if true == "cp1252" and not self._latin(text, a, b):
                continue
            if got := self._single(run, name, true):
                yield got[0], f"{name}>{true}", got[1]
        for true in WIDE:
            if got := self._wide(run, true):
                yield got, f"latin-1>{true}", False

    @staticmethod
    def _latin(text: str, a: int, b: int) -> bool:
        """Whether the run's high characters stand singly (at most two together) in Latin text."""
        near = text[max(0, a - 60) : b + 60]
        latin, other = len(_ASCII_LETTER.findall(near)), len(_THAI.findall(near))
        return other < 0.2 * latin and not _THREE_THAI.search(text[a:b])

    @staticmethod
    def _wide(run: str, true: str) -> str | None:
        m = BYTES["latin-1"]
        high = _count("latin-1", run)
        if high < 4 or len(run) - _n_ascii(run) > high:
            return None
        out = bytes(m.get(c, ord(c)) for c in run).decode(true, "replace")
        wide = sum(ord(c) >= 0x3000 for c in out)
        return out if 2 * wide >= 0.9 * high and out.count("�") <= 1 and not re.search("[\uff61-\uff9f]", out) else None

    def _utf8(self, run: str, name: str, high: int) -> tuple[str, bool] | None:
        valid = lost = covered = longest = chain = 0
        last = -1

        def one(match: re.Match) -> str:
            nonlocal valid, lost, covered, longest, chain, last
            s = match.group(0)
            if any(c in _HOLES for c in s):
                if s[-1] == "?" and len(s) == 2 and name not in ("cp874",):
                    return s
                got = "�"
                lost += 1
            else:
                got = self.images.get((name, s))
                if got is None:
                    if len(self.images) > 100_000:
                        self.images.clear()
                    got = self.images[name, s] = self._image(name, s)
                if got == s:
                    return s
                valid += 1
            covered += len(s)
            chain = chain + 1 if match.start() == last else 1
            last = match.end()
            longest = max(longest, chain)
            return got

        out = IMAGES[name].sub(one, run)
        thai = name == "cp874"
        if not valid or (thai and (longest < 3 or valid + lost < 3 or covered < 0.5 * high)) or (covered < 0.4 * high and high - covered > 4):
            return None
        return out, bool(lost)

    def _image(self, name: str, s: str) -> str:
        """The character that ``s`` is the image of, or ``s`` where it is none or one the corpus never has."""
        try:
            got = bytes(BYTES[name][c] for c in s).decode("utf-8")
        except UnicodeDecodeError:
            return s
        if ord(got) >= 0x180 and got not in ANY_IMAGE and not self.seen[classes(np.array([ord(got)]))[0]]:
            return s
        return s if name == "cp874" and 0x180 <= ord(got) < 0xE00 else got

    @staticmethod
    def _single(run: str, name: str, true: str) -> tuple[str, bool] | None:
        out = run.translate(DECODED[name, true])
        letters = _count(name, run)
        lost = out.count("�")
        other = len(run) - _n_ascii(run) - run.count("�") - letters
        if other > letters:
            return None
        if true == "cp874":
            if letters < 3 or not _THREE_THAI.search(out) or len(_THAI.findall(out)) < 0.8 * (letters + other):
                return None
        elif not letters and not lost or name == "cp437" and lost + other:
            return None
        return out, bool(lost)


def repair_garbled(texts: DataFrame, key: str, text: str = "text", pmi: np.ndarray | None = None) -> DataFrame:
    """(key, garbled, restored, encodings, lossy) for every row of ``texts``; ``restored`` is null where nothing was garbled."""
    source = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    table = pair_information(source) if pmi is None else pmi
    kind = source.schema["key"].dataType.simpleString()

    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = Restorer(shared.value)
        for batch in batches:
            rows = batch["text"].tolist()
            hot = np.zeros(len(rows), dtype=bool)
            for a, b, codes, offsets in blocks(rows):
                hot[a:b] = worker.promising(codes, offsets)
            out = {"key": batch["key"], "garbled": hot.copy(), "restored": [None] * len(rows), "encodings": [None] * len(rows), "lossy": np.zeros(len(rows), dtype=bool)}
            for i in np.flatnonzero(hot):
                new, how, lossy = worker.restore(rows[i])
                if not how and "�" in rows[i]:
                    how, lossy = "lost", True
                out["garbled"][i], out["lossy"][i] = bool(how), lossy
                if how:
                    out["restored"][i], out["encodings"][i] = new, how
            yield pd.DataFrame(out)

    return source.mapInPandas(run, f"key {kind}, garbled boolean, restored string, encodings string, lossy boolean").withColumnRenamed("key", key)
