"""Text from scanned pages: find the traces and repair it into continuous paragraphs.

Characters: a noisy channel.  Character 4- and 5-grams of all passages are counted in hashed tables of
fixed size, each text by itself; what a cell holds by collisions alone is taken off.  A place is suspect if
replacing what was read by what it is easily confused with makes the n-grams around it more probable by a
large factor, or if a digit stands in a Latin word.  The suspects of all passages give the probability of each confusion.  The
candidate words of a line form a lattice (what was read, and the confusions at suspect places); Viterbi
finds its best path by confusion probability times n-gram likelihood, without a bound on the paths kept.  A passage has
misread characters only if that path differs from what was read.

Layout, which no channel over characters covers: lines are told apart as prose, list, table, verse,
heading, page number and running head (also by how many passages repeat a line once its digits are
masked), prose lines are joined again and words cut at line ends closed.

Defined cases: null and empty texts bear no traces and are repaired as they are; a text of one line
can only show misread characters and specks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamnan.functions.charblocks import blocks, hash_grams
from tamnan.functions.cluster import columns, cut_lineage

#: log2 of the buckets of an n-gram table; evidence and ratio that make a character suspect; passages that make a line a running head.
BITS = 22
MIN_COUNT, RATIO = 24, 40.0
HEAD_PASSAGES = 5
#: What it costs to take a digit within a Latin word for what was meant.
DIGIT_COST = 6.0
#: Running heads up to which all are broadcast.
MAX_HEADS = 200_000

# Characters that scanners take for one another.
_PAIRS = "บข กถ คด ลส มน ทห ตด ชซ ผฝ พฟ คต ฎฏ"
_LATIN = (("0", "o"), ("0", "l"), ("0", "i"), ("0", "s"), ("0", "b"), ("c", "e"), ("rn", "m"), ("li", "h"), ("ii", "u"), ("cl", "d"), ("vv", "w"))  # a digit is read as 0 here

_PAGE = re.compile(r"^\W*(?:(?:หน้า|page|seite|p\.|s\.)\s*)?[\d๐-๙]{1,4}(?:\s*(?:of|von|sur|de|/|จาก)\s*[\d๐-๙]{1,4})?\W*$", re.I)
_HEAD = re.compile(r"^\W*(?:เล่ม\s*[\d๐-๙]+\s*ตอน|บทที่\s*[\d๐-๙]+\s+\S|.{0,60}(?:ปีที่\s*[\d๐-๙]+\s*ฉบับที่|[ ,](?:vol|no|nr|issue)\. ?\d+|(?:Chapter|Kapitel|Chapitre|Part) \d+ /))", re.I)
_LIST = re.compile(r"^\s*(?:[-•*–]\s+\S|[\d๐-๙]{1,3}[.)]\s|\([\d๐-๙ก-ฮa-z]{1,3}\)\s|[\d๐-๙]+ \|)")
_SECTION = re.compile(r"^\s*(?:[\d๐-๙]+(?:\.[\d๐-๙]+)+\s|หมวด\s|ส่วนที่\s|(?:ข้อ|มาตรา)\s[\d๐-๙])")
_HYPHEN = re.compile(r"[^\W\d_][ั-๎]*[-­¬]$")
_SPECK = re.compile(r"(?<=\S) +(?:[|¦·*^~`_'‚]|[.,] ?,|, ?\.)(?: *[|¦·*^~`_'.,]{1,2})* +(?=\S)|(?<=\S)  +[.,;:'|¦·*^~`_](?= )|(?<= )[.,;:'|¦·*^~`_]  +(?=\S)|(?<=\S) +(?:[|¦*^~`_]|\.,|[.,'] ?[,'])\s*$", re.M)
_DIGIT_IN_WORD = re.compile(r"[a-zß-ÿ’][0156][a-zß-ÿ]|\b[0156][a-zß-ÿ]{2,}|[a-zß-ÿ]{2}[0156]\b(?![./:%])")
_ENDS = re.compile(r"[.!?。！？।:;…][”»」』)\"]*$")
_DIGITS = re.compile(r"[\d๐-๙]+")


def _rules() -> list[tuple[str, str, bool]]:
    """(read, meant, whether only inside a Latin word)."""
    return [x for pair in _PAIRS.split() for x in ((pair[0], pair[1], False), (pair[1], pair[0], False))] + [(r, m, True) for r, m in _LATIN]


RULES = _rules()
#: The digits that stand for a letter in a Latin word.
_DIGIT_OF = {"o": "0", "l": "1", "i": "1", "s": "5", "b": "6"}
_MASK = None


def _fold(codes: np.ndarray) -> np.ndarray:
    """Code points with all digits as one and line breaks as blanks, for the n-gram tables."""
    global _MASK
    if _MASK is None:
        _MASK = np.arange(0x110000, dtype=np.uint32)
        _MASK[0x30:0x3A] = 0x30
        _MASK[0xE50:0xE5A] = 0x30
        _MASK[0x0A] = 0x20
    return _MASK[codes]


def _framed(texts: list[str | None]) -> list[str | None]:
    """Texts between blanks, so that their first and last characters have n-grams too."""
    return [f"\n\n\n\n{t}\n\n\n\n" if t else t for t in texts]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(2 << BITS, dtype=np.int64)
    meant = np.zeros(len(RULES), dtype=np.int64)
    for b in batches:
        for first, last, codes, offsets in blocks(_framed(b["text"].tolist()), 2_000_000):
            f = _fold(codes)
            row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(offsets))
            for j, n in enumerate((4, 5)):
                h = hash_grams(f, n)[row[: max(0, len(f) - n + 1)] == row[n - 1 :]]
                np.add(counts[j << BITS : (j + 1) << BITS], np.bincount(_bucket(h), minlength=1 << BITS), out=counts[j << BITS : (j + 1) << BITS])
            for r, (_, m, _) in enumerate(RULES):
                hit = f[: max(0, len(f) - len(m) + 1)] == ord(m[0])
                for k in range(1, len(m)):
                    hit = hit & (f[k : len(f) - len(m) + 1 + k] == ord(m[k]))
                meant[r] += np.count_nonzero(hit)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"i": np.concatenate((at, (2 << BITS) + np.arange(len(RULES)))), "n": np.concatenate((counts[at], meant))})


def gram_tables(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """([4-grams, 5-grams] hashed counts, how often what each rule means occurs) over all rows of ``texts`` (column text).

    At most 2 * 2**BITS numbers.  The middle cell of a table holds nothing but what collisions bring, so it is taken off all:
    0 while the table is sparse, and the mean noise of a cell when the corpus fills it.
    """
    got = columns(texts.select("text").mapInPandas(_count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")))
    flat = np.zeros((2 << BITS) + len(RULES), dtype=np.float64)
    flat[got["i"]] = got["n"]
    tables = flat[: 2 << BITS].reshape(2, 1 << BITS)
    return np.maximum(tables - np.median(tables, axis=1, keepdims=True), 0).astype(np.float32), flat[2 << BITS :]


def line_frames(text: str) -> dict[str, bool]:
    """Short lines of a text of several lines with their digits masked (what may be a running head), and whether one is its first line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return {}
    out: dict[str, bool] = {}
    for i, line in enumerate(lines):
        s = line.strip()
        if 4 <= len(s) <= 70 and not _LIST.match(s) and not _SECTION.match(s) and not _PAGE.match(s):
            near = [x.strip() for x in (*lines[max(0, i - 1) : i], *lines[i + 1 : i + 2]) if x.strip()]
            if any(len(x) >= 30 and not _LIST.match(x) or _PAGE.match(x) for x in near):
                frame = _DIGITS.sub("0", s)
                out[frame] = out.get(frame, False) or i == 0
    return out


def running_heads(texts: DataFrame) -> DataFrame:
    """(frame, passages) of lines that at least ``HEAD_PASSAGES`` passages repeat beside prose, and a tenth of them begin with.

    The end of a broken sentence may be repeated as often, but no passage begins with it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t in b["text"].tolist():
                if t and "\n" in t:
                    for frame, first in line_frames(t).items():
                        c = counts.setdefault(frame, [0, 0])
                        c[0] += 1
                        c[1] += first
            yield pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["frame", "n", "first"]).astype({"n": "int64", "first": "int64"})

    seen = texts.select("text").where(F.col("text").contains("\n")).mapInPandas(run, "frame string, n bigint, first bigint")
    return seen.groupBy("frame").agg(F.sum("n").alias("passages"), F.sum("first").alias("first")).where((F.col("passages") >= HEAD_PASSAGES) & (F.col("first") * 10 >= F.col("passages"))).select("frame", "passages")


def line_kinds(text: str, heads: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(line, kind): blank, page, head, list, section, verse or prose."""
    lines = text.split("\n")
    kinds = []
    single = len(lines) < 2
    for line in lines:
        s = line.strip()
        if not s:
            kinds.append("blank")
        elif single:
            kinds.append("prose")
        elif _PAGE.match(s):
            kinds.append("page")
        elif _HEAD.match(s) and len(s) <= 70:
            kinds.append("head")
        elif _LIST.match(s):
            kinds.append("list")
        elif _SECTION.match(s) and len(s) <= 70:
            kinds.append("section")
        elif len(s) <= 70 and _DIGITS.sub("0", s) in heads and not _ENDS.search(s):
            kinds.append("head")
        else:
            kinds.append("prose")
    i = 0
    while i < len(lines):  # blocks of short prose lines without blanks or digits are verse
        j = i
        while j < len(lines) and kinds[j] == "prose":
            j += 1
        body = [x.strip() for x in lines[i + 1 : j]]
        if len(body) >= 3 and all(len(x) <= 24 and not re.search(r"[\s\d.,]", x) for x in body):
            kinds[i:j] = ["verse"] * (j - i)
        i = max(j, i + 1)
    return list(zip(lines, kinds))


def layout_traces(text: str, heads: frozenset[str] = frozenset()) -> set[str]:
    found: set[str] = set()
    if "\n" in text:
        rows = line_kinds(text, heads)
        kinds = [k for _, k in rows]
        if "page" in kinds and ("prose" in kinds or "head" in kinds or "list" in kinds):
            found.add("page")
        if "head" in kinds and len([k for k in kinds if k != "blank"]) > 1:
            found.add("head")
        content = [(line.strip(), k) for line, k in rows if k not in ("page", "head")]
        for (a, ka), (b, kb) in zip(content, content[1:]):
            if ka not in ("prose", "list") or kb != "prose" or not a or not b:
                continue
            if _HYPHEN.search(a) and (b[0].isalpha() or "ะ" <= b[0] <= "๎"):
                found.add("cut")
            elif ka == "prose" and not a.endswith((":", ":")) and not (_ENDS.search(a) and len(a) > 25 and (b[0].isupper() or b[0] in "“„«")):
                found.add("lines")
    if _SPECK.search(text) and not re.search(r"^\d+ \|.*\|", text, re.M):
        found.add("speck")
    return found


class Channel:
    """The noisy channel over hashed 4- and 5-gram counts; ``costs``: minus the log probability of each rule's confusion."""

    def __init__(self, tables: np.ndarray, costs: list[float] | None = None):
        self.four, self.five = tables
        self.costs = costs
        self.known: dict[str, float] = {}
        self.rare = max(2.0, float(self.five.max()) / RATIO)

    def count5(self, grams: np.ndarray) -> np.ndarray:
        """Counts of the rows of a [m, 5] array of folded code points."""
        h = np.zeros(len(grams), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(5):
                h = h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
                h ^= h >> np.uint64(29)
        return self.five[_bucket(h)]

    def suspects(self, codes: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, positions within them, rule) of a block of framed texts.

        Three 5-grams that cover what was read are held against the three that cover what may have
        been meant; two must gain by ``RATIO``.
        """
        f = _fold(codes)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        h = hash_grams(f, 5)
        out: list[tuple[np.ndarray, np.ndarray, int]] = []
        if len(h) < 5:
            return out
        c = self.five[_bucket(h)]
        lower = ((f >= 0x61) & (f <= 0x7A)) | ((f >= 0xDF) & (f <= 0xFF))
        for rule, (read, meant, latin) in enumerate(RULES):
            r, m = len(read), len(meant)
            hit = f[: len(f) - r + 1] == ord(read[0])
            for k in range(1, r):
                hit = hit & (f[k : len(f) - r + 1 + k] == ord(read[k]))
            at = np.flatnonzero(hit)
            if latin:
                at = at[lower[at - 1] | lower[at + r]]
            seen = np.stack([c[at - 4], c[at - 2], c[at + r - 1]], axis=1)
            keep = np.median(seen, axis=1) <= self.rare
            at, seen = at[keep], seen[keep]
            if not len(at):
                continue
            window = np.concatenate([f[at[:, None] + np.arange(-4, 0)], np.tile(np.array([ord(x) for x in meant], dtype=np.uint32), (len(at), 1)), f[at[:, None] + np.arange(r, r + 4)]], axis=1)
            better = np.stack([self.count5(window[:, k : k + 5]) for k in (0, 2, 3 + m)], axis=1)
            own = row[at]
            ok = ((better >= MIN_COUNT) & (better >= RATIO * (seen + 0.5))).sum(axis=1) >= 2
            if ok.any():
                out.append((own[ok], at[ok] - 4 - offsets[own[ok]], rule))
        return out

    def _probability(self, tail: str, c: str) -> float:
        """log P(c | four characters before)."""
        known = self.known.get(key := (tail + c)[-5:])
        if known is not None:
            return known
        if len(self.known) > 500_000:
            self.known.clear()
        got = self.known[key] = self._look_up(tail, c)
        return got

    def _look_up(self, tail: str, c: str) -> float:
        g = _fold(np.array([ord(x) for x in (tail + c)[-5:]], dtype=np.uint32))
        if len(g) < 5:
            return 0.0
        five = float(self.five[_bucket(hash_grams(g, 5))[0]])
        four = float(self.four[_bucket(hash_grams(g[:4], 4))[0]])
        return math.log((five + 0.1) / (four + 20.0))

    def _support(self, left: str, mid: str, right: str) -> float:
        s = _fold(np.array([ord(c) for c in left + mid + right], dtype=np.uint32))
        h = hash_grams(s, 5)
        a, b = len(left), max(len(left) + len(mid), len(left) + 1)
        c = [float(self.five[_bucket(h[i : i + 1])[0]]) for i in range(len(h)) if i < b and i + 5 > a]
        return sorted(c)[len(c) // 2] if c else 0.0

    def decode(self, text: str, sites: list[tuple[int, int]]) -> str:
        """``text`` with the best path through its lattice; ``sites``: (position, rule).

        Four characters after the last alternative all paths have one state again, so the lattice is
        decoded in stretches around its sites; the result is that of the whole text.
        """
        edges: dict[int, list[tuple[str, int, float]]] = {}
        for p, rule in sites:
            read, meant, _ = RULES[rule]
            if read == "0":
                if text[p] != _DIGIT_OF[meant]:
                    continue
            elif text[p : p + len(read)] != read:
                continue
            edges.setdefault(p, []).append((meant, len(read), self.costs[rule] if self.costs else 3.0))
        out, done = [], 0
        places = sorted(edges)
        i = 0
        while i < len(places):
            end = places[i]
            while i < len(places) and places[i] <= end + 4:
                end = max(end, places[i] + max(length for _, length, _ in edges[places[i]]))
                i += 1
            first = max(done, min(p for p in places if p >= done))
            last = min(len(text), end + 4)
            out += [text[done:first], self._stretch(text, first, last, edges)]
            done = last
        return "".join(out) + text[done:]

    def _stretch(self, text: str, first: int, last: int, edges: dict[int, list[tuple[str, int, float]]]) -> str:
        states: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(last - first + 1)]
        states[0][text[max(0, first - 4) : first]] = (0.0, None)
        for i in range(first, last):
            for tail, (score, path) in states[i - first].items():
                digit = DIGIT_COST if i in edges and text[i].isdigit() else 0.0
                for new, length, cost in ((text[i], 1, digit), *edges.get(i, ())):
                    s, t = score - cost, tail
                    for c in new:
                        s, t = s + self._probability(t, c), (t + c)[-4:]
                    into = states[i + length - first]
                    if t not in into or s > into[t][0]:
                        into[t] = (s, (path, new))
        path = max(states[-1].values(), key=lambda x: x[0])[1]
        out = []
        while path:
            path, new = path
            out.append(new)
        return "".join(reversed(out))


def repair_layout(text: str, heads: frozenset[str], channel: Channel | None = None) -> str:
    """Page numbers and running heads dropped, broken lines joined, cut words closed, specks removed."""
    out: list[str] = []
    current, last = "", "blank"
    for line, kind in line_kinds(text, heads):
        s = line.strip()
        if kind in ("page", "head") and "\n" in text:
            continue
        if kind == "blank":
            if current:
                out.append(current)
            current, last = "", "blank"
            if out and out[-1] != "":
                out.append("")
            continue
        if kind in ("list", "section", "verse") or last in ("section", "verse") or not current:
            if current:
                out.append(current)
            current, last = s, kind
            continue
        if _HYPHEN.search(current) and (s[0].isalpha() or "ะ" <= s[0] <= "๎"):
            current = current[:-1] + s
        else:
            thai = "฀" <= current[-1] <= "๿" and "฀" <= s[0] <= "๿" or (current[-1].isdigit() and s[0].isdigit())
            glue = "" if thai and not line.startswith(" ") and not text_break(current, s, channel) else " "
            current += glue + s
    if current:
        out.append(current)
    joined = "\n".join(out).strip("\n")
    if re.search(r"^\d+ \|.*\|", text, re.M):
        return joined

    def speck(m: re.Match) -> str:
        left, right = joined[max(0, m.start() - 4) : m.start()], joined[m.end() : m.end() + 4]
        if channel is None or not (left and right) or not (left[-1].isalpha() or "ะ" <= left[-1] <= "๎"):
            return " "
        return "" if channel._support(left, "", right) > channel._support(left, " ", right) else " "

    return _SPECK.sub(speck, joined)


def text_break(left: str, right: str, channel: Channel | None) -> bool:
    """Whether a blank belongs between two Thai lines: the likelier of the two n-grams."""
    if channel is None:
        return False
    with_blank = channel._support(left[-3:], " ", right[:3])
    return with_blank > channel._support(left[-3:], "", right[:3]) + 1 if with_blank else False


def repair_scans(passages: DataFrame, key: str = "passage_id", text: str = "text", with_text: bool = True, max_heads: int = MAX_HEADS) -> DataFrame:
    """(key, traces, misread[, repaired]) of every passage that bears traces of scanning; ``misread``: suspect places.

    Three scans of the passages: running heads, n-grams, traces and suspects.  Passages with either are
    written once; the confusions counted over them give the channel that decodes them.  Up to ``max_heads``
    running heads are broadcast; beyond that each passage gets its own by a join.
    """
    source = passages.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    spark = passages.sparkSession
    known = cut_lineage(running_heads(source))
    if known.limit(max_heads + 1).count() <= max_heads:
        shared = frozenset(r["frame"] for r in known.collect())
        rows = source.withColumn("heads", F.lit(None).cast("array<string>"))
    else:
        shared = frozenset()
        rows = _with_own_heads(source, known)
    heads = spark.sparkContext.broadcast(shared)
    counted, meant = gram_tables(source)
    tables = spark.sparkContext.broadcast(counted)
    first_digit = next(i for i, r in enumerate(RULES) if r[0] == "0")
    digit_rules = [i for i in range(first_digit, len(RULES)) if RULES[i][0] == "0"]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(tables.value)
        for b in batches:
            keys, texts, own, out = b["key"].tolist(), b["text"].tolist(), b["heads"].tolist(), []
            for first, last, codes, offsets in blocks(_framed(texts), 500_000):
                sites: dict[int, list[tuple[int, int]]] = {}
                for row, at, rule in channel.suspects(codes, offsets):
                    for r, p in zip(row.tolist(), at.tolist()):
                        sites.setdefault(r, []).append((p, rule))
                for r in range(last - first):
                    t = texts[first + r]
                    if not t:
                        continue
                    traces = layout_traces(t, heads.value if own[first + r] is None else frozenset(own[first + r]))
                    mine = set(sites.get(r, ()))
                    for m in _DIGIT_IN_WORD.finditer(t):
                        for p in range(m.start(), m.end()):
                            mine |= {(p, rule) for rule in digit_rules if t[p] == _DIGIT_OF[RULES[rule][1]]}
                    if traces or mine:
                        at = sorted(mine)
                        out.append((keys[first + r], t, own[first + r], sorted(traces), [p for p, _ in at], [rule for _, rule in at]))
            yield pd.DataFrame(out, columns=["key", "text", "heads", "traces", "at", "rule"])

    marked = cut_lineage(rows.mapInPandas(mark, "key bigint, text string, heads array<string>, traces array<string>, at array<int>, rule array<int>"))
    confused = {r["rule"]: r["n"] for r in marked.select(F.explode("rule").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).collect()}  # one row a rule
    costs = [-math.log((confused.get(i, 0) + 1) / (n + confused.get(i, 0) + 2)) for i, n in enumerate(meant.tolist())]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = None
        for b in batches:
            out = []
            for k, t, own, traces, at, rule in zip(*(b[c].tolist() for c in ("key", "text", "heads", "traces", "at", "rule"))):
                found, new = list(traces), t
                if len(at):
                    channel = channel or Channel(tables.value, costs)
                    new = channel.decode(t, list(zip(map(int, at), map(int, rule))))
                    if new != t:
                        found.append("misread")
                if found:
                    if with_text:
                        channel = channel or Channel(tables.value, costs)
                        mine = heads.value if own is None else frozenset(own)
                        out.append((k, sorted(found), len(set(at)), repair_layout(new, mine, channel)))
                    else:
                        out.append((k, sorted(found), len(set(at))))
            yield pd.DataFrame(out, columns=[key, "traces", "misread", *(["repaired"] if with_text else [])]).astype({"misread": "int32"})

    return marked.mapInPandas(decode, f"{key} bigint, traces array<string>, misread int" + (", repaired string" if with_text else ""))


def _with_own_heads(source: DataFrame, known: DataFrame) -> DataFrame:
    """``source`` with the running heads among each passage's own short lines, found by a join on the line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(k, _DIGITS.sub("0", s)) for k, t in zip(b["key"].tolist(), b["text"].tolist()) if "\n" in t for line in t.split("\n") if len(s := line.strip()) <= 70 and s}
            yield pd.DataFrame(sorted(rows), columns=["key", "frame"])

    lines = source.mapInPandas(run, "key bigint, frame string").join(known.select("frame"), "frame", "left_semi")
    own = lines.groupBy("key").agg(F.collect_set("frame").alias("heads"))
    return source.join(own, "key", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<string>")))
