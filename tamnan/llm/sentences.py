"""Sentence units across languages and scripts.

A pushdown automaton walks over the marks of a text (terminators, quotation marks, brackets, numbered
points, line breaks, and blanks in Thai, which has no full stop).  Its stack holds open quotations,
brackets and list levels; a terminator ends a sentence only at the bottom of the stack, unless an abbreviation trie
(walked backwards from the full stop), a decimal or a lower-case continuation says otherwise.  A numbered point within an unfinished sentence opens a
list level, which its last point closes.

A blank in Thai ends a sentence when what follows opens sentences and the clause before isn't left open
(by an abbreviation, a lone connector, a relative or an unfulfilled condition).  What opens sentences is learnt from
the corpus: how often a prefix begins a text against how often it follows a blank; a trie of
connectives stands in where a prefix is too rare for counts.

Offsets count code points; ``end`` includes closing marks and excludes following white space.

Defined cases: null and blank texts have no sentences; a text without any terminator is one sentence;
an unclosed quotation, bracket or list ends with its paragraph.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamnan.functions.cluster import columns

#: log2 of the cells of the table of prefixes, and their lengths (longest first).
BITS = 20
PREFIXES = (16, 12, 10, 8, 6, 5, 4, 3)
#: Of what opens sentences about this share of occurrences begins a text, of all else this; log odds at which one is believed.
OPENS, ELSE, ODDS = 0.12, 0.003, 7.0

# Abbreviations that don't end a sentence (case folded, without the last full stop).
_NEVER = "dr prof mr mrs ms mme mlle m st fig figs no nos nr app sec secs art arts p pp vol vols ch cf approx ca vgl bzw z.b z. b d.h d. h u.a u. a e.g i.e p.ex p. ex ex resp incl inkl abs bd hr fr jan feb febr mar apr jun jul aug sep sept oct okt nov dec dez déc janv févr avr juil al ed eds rev gen col lt sgt vs tab eq ref n° डॉ श्री प्रो".split(" ")
NEVER = frozenset([*_NEVER, "z. b", "d. h", "p. ex", "u. a"])
# Abbreviations that may end a sentence if a capital follows.
MAYBE = frozenset("etc a.m p.m usw u.s.w inc ltd co jr sr usf".split())
# Thai abbreviations after which a blank doesn't end anything.
_THAI_ABBREVIATION = re.compile(r"(?:ดร|ร\.ร|อ|ศ|รศ|ผศ|นพ|พญ|พ\.ศ|ค\.ศ|พ\.ร\.บ|ม\.ค|ก\.พ|มี\.ค|เม\.ย|พ\.ค|มิ\.ย|ก\.ค|ส\.ค|ก\.ย|ต\.ค|พ\.ย|ธ\.ค|น|เลขที่|โทร|ต|จ|ถ|นาย|นาง)\.?$")
_LONE = re.compile(r"(?:ดังนั้น|อนึ่ง|ทั้งนี้|นอกจากนี้|ต่อมา|อย่างไรก็ตาม|อย่างไรก็ดี|ตัวอย่างเช่น|ในทางปฏิบัติ|ในกรณีที่จำเป็น|เมื่อพิจารณาแล้ว|ในการนี้|เพราะฉะนั้น|กล่าวคือ|ในขณะเดียวกัน|ในที่สุด|ประการแรก|ข้อ|มาตรา|(?:ข้อ|มาตรา) [\d๐-๙/]+|[\d๐-๙]+[.)])$")
# Connectives that begin a Thai sentence after a blank.
THAI_OPENERS = "ดังนั้น อนึ่ง ทั้งนี้ นอกจากนี้ ต่อมา อย่างไรก็ตาม อย่างไรก็ดี ตัวอย่างเช่น ในทางปฏิบัติ ในกรณี ในการนี้ เมื่อ ถ้า หาก ห้าม ให้ เนื่องจาก สำหรับ ปัจจุบัน ประการแรก ขั้นแรก เธอ เขา".split()
# What goes on with a Thai sentence though an opener is a prefix of it.
THAI_CONTINUE = "ให้ดูว่า ให้ถือว่า ให้เรียก เมื่อวันที่ เมื่อพ้น หากไม่ หาก".split()

_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›", "《": "》", "（": "）", "(": ")", "[": "]", "【": "】", "‚": "‘"}
_CLOSERS = "”»」』）)]】》›\"’“"
_EVENT = re.compile(r"\((?:\d+|[๐-๙]+)\)|[.]{2,}|[.!?。！？।॥…]+|\n+|[“”„«»「」『』‹›《》（）()\[\]【】\"]|(?<=[฀-๿\d”)A-Za-z]) (?=[฀-๿])")
_LISTED = re.compile(r"\s*(?:\d+[.)]|[๐-๙]+[.)]) ")
_HEADING = re.compile(r"(?:\d+(?:\.\d+)+ |\d+\. |หมวด \d|ส่วนที่ \d|(?:ข้อ|มาตรา) [\d๐-๙])")
_START = re.compile(r"^(?:(?:ข้อ|มาตรา|หมวด|ส่วนที่|บทที่) [\d๐-๙/]+ |[-•(“\"])*+(?=[\u0e01-\u0e45])")
_ANY_DIGIT = re.compile(r"[\d๐-๙]+")
_CELL = (1 << BITS) - 1
_BLANK = re.compile(r"(?<=[\u0e00-\u0e7f\d”)A-Za-z.]) (?=[\u0e01-\u0e45])")
_UNFINISHED = re.compile(r"(?:[,;:]|ดังนี้|คือ|ได้แก่|ดังต่อไปนี้|following|folgende[ns]?|suivante?s?)$")
_STARTS_LATER = re.compile(r"[\s​﻿]*")


class _Trie:
    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = len(w)

    def longest(self, text: str, at: int) -> int:
        node, best = self.root, 0
        while True:
            best = node.get("", best)
            node = node.get(text[at]) if at < len(text) else None
            if node is None:
                return best
            at += 1


_OPENERS, _CONTINUE = _Trie(THAI_OPENERS), _Trie(THAI_CONTINUE)
#: Abbreviations from their last letter to their first.
_BACKWARDS = _Trie(w[::-1] for w in (*NEVER, *MAYBE))


def _abbreviation(text: str, start: int, a: int) -> str:
    """The longest known abbreviation that ends before ``a`` and begins a word, lower case; "" if none does."""
    node, i, best = _BACKWARDS.root, a, ""
    while i > start:
        c = text[i - 1]
        node = node.get(" " if c.isspace() else c.lower())
        if node is None:
            break
        i -= 1
        if "" in node and (i == start or not text[i - 1].isalnum()):
            best = text[i:a]
    return re.sub(r"\s", " ", best.lower())


class Openers:
    """How often prefixes (digits as one) begin texts, and how often they follow a blank within one.

    A count-min sketch: each prefix has a cell in two rows, and the smaller count holds.
    """

    def __init__(self, table: np.ndarray):
        self.starts, self.blanks = table
        self.known: dict[str, bool | None] = {}

    @staticmethod
    def cells(text: str, at: int) -> list[tuple[int, int]]:
        """Cells of the prefixes from ``at``, longest first."""
        folded = _ANY_DIGIT.sub("0", text[at : at + 2 * PREFIXES[0]])
        out = []
        for k in PREFIXES:
            h = xxhash.xxh3_64_intdigest(folded[:k].encode("utf-8", "surrogatepass"))
            out.append((h & _CELL, (h >> 32 & _CELL) + _CELL + 1))
        return out

    def opens(self, text: str, at: int) -> bool | None:
        """Whether the longest prefix with evidence opens sentences; None if none has any."""
        head = text[at : at + 2 * PREFIXES[0]]
        if head not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[head] = self._look_up(head)
        return self.known[head]

    def _look_up(self, head: str) -> bool | None:
        for i, j in self.cells(head, 0):
            starts = min(self.starts[i], self.starts[j])
            blanks = min(self.blanks[i], self.blanks[j])
            odds = starts * math.log(OPENS / ELSE) + blanks * math.log((1 - OPENS) / (1 - ELSE))
            if abs(odds) >= ODDS:
                return odds > 0
        return None

    @classmethod
    def learnt(cls, texts: DataFrame) -> Openers:
        """From all rows of ``texts`` (column text); at most 4 * 2**BITS numbers come back, and what cells hold by collisions alone is taken off."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = np.zeros(4 << BITS, dtype=np.int64)
            for b in batches:
                seen: dict[tuple[int, str], int] = {}
                for t in b["text"].tolist():
                    if t:
                        m = _START.match(t)
                        first = m.end() if m else -1
                        if m:
                            key = (0, t[first : first + 2 * PREFIXES[0]])
                            seen[key] = seen.get(key, 0) + 1
                        for m in _BLANK.finditer(t):
                            if (at := m.end()) != first:
                                key = (2 << BITS, t[at : at + 2 * PREFIXES[0]])
                                seen[key] = seen.get(key, 0) + 1
                for (base, head), n in seen.items():
                    for i, j in cls.cells(head, 0):
                        table[base + i] += n
                        table[base + j] += n
            at = np.flatnonzero(table)
            yield pd.DataFrame({"i": at, "n": table[at]})

        got = columns(texts.select("text").mapInPandas(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")))
        flat = np.zeros(4 << BITS, dtype=np.int64)
        flat[got["i"]] = got["n"]
        rows = flat.reshape(4, -1)
        return cls(np.maximum(rows - np.median(rows, axis=1, keepdims=True), 0).astype(np.int64).reshape(2, -1))


def sentence_ends(text: str | None, openers: Openers | None = None) -> list[int]:
    """End offsets (exclusive, in code points) of the sentences of ``text``."""
    if not text or not text.strip():
        return []
    ends: list[int] = []
    stack: list[str | int] = []  # closing marks, and for a list level the number of its next point
    start = 0  # where the open sentence begins
    opened = 0  # where the outermost quotation or bracket opened
    n = len(text)

    def emit(at: int) -> None:
        nonlocal start
        while at > start and text[at - 1].isspace():
            at -= 1
        if at > start and text[start:at].strip():
            ends.append(at)
            start = at

    skip = 0
    for m in _EVENT.finditer(text):
        a, b = m.span()
        if a < skip:
            continue
        mark = m.group(0)
        c = mark[0]
        if c == "\n":
            if b - a > 1:
                emit(a)
                stack.clear()
            else:
                line = text[text.rfind("\n", 0, a) + 1 : a]
                if _LISTED.match(text, b) and _UNFINISHED.search(text[max(start, a - 40) : a].rstrip()):
                    continue
                if _HEADING.match(text, b) or (_HEADING.match(line) and len(line) <= 70 and not stack and line[-1:] not in ",;"):
                    emit(a)
                    stack.clear()
            continue
        if b - a > 2 and c == "(":
            point = int(mark[1:-1])
            if stack and stack[-1] == point or point == 1 and text[start:a].strip():
                if stack and stack[-1] == point:
                    stack.pop()
                if _later_point(text, b, point + 1):
                    if not stack:
                        opened = a
                    stack.append(point + 1)
            continue
        if c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append('"')
                opened = a
            continue
        if stack and c == stack[-1]:
            stack.pop()
            if not stack and a and text[a - 1] in ".!?。！？।" and _after_quote(text, start, opened, b):
                emit(b)
            continue
        if c in _OPEN:
            if not stack:
                opened = a
            stack.append(_OPEN[c])
            continue
        if c in "”»」』）)]】》›":
            if c in stack:
                while stack.pop() != c:
                    pass
            continue
        if stack:
            continue
        if c == " ":
            if _thai_boundary(text, start, a, b, openers):
                emit(a)
            continue
        end = b
        while end < n and text[end] in _CLOSERS and not (text[end] in "“\"" ):
            end += 1
        if _ends(text, start, a, mark, end):
            emit(end)
            skip = end
    emit(n)
    return ends


def _later_point(text: str, at: int, number: int) -> bool:
    """Whether the point of that number comes later in the paragraph."""
    thai = str(number).translate(_THAI_DIGITS)
    stop = text.find("\n\n", at)
    stop = len(text) if stop < 0 else stop
    return text.find(f"({number})", at, stop) >= 0 or text.find(f"({thai})", at, stop) >= 0


_THAI_DIGITS = str.maketrans("0123456789", "๐๑๒๓๔๕๖๗๘๙")


def _after_quote(text: str, start: int, opened: int, at: int) -> bool:
    """A quotation that is a whole sentence of its own ends one; one that is part of a sentence doesn't."""
    rest = _STARTS_LATER.match(text, at).end()
    if rest >= len(text):
        return True
    return rest > at and not text[start:opened].strip() and (text[rest].isupper() or text[rest] in "“„«「")


def _ends(text: str, start: int, a: int, mark: str, end: int) -> bool:
    n = len(text)
    rest = _STARTS_LATER.match(text, end).end()
    if rest >= n:
        return True
    nxt = text[rest]
    if mark[0] in "。！？।॥":
        return True
    if mark == "…" or mark[0] == "…":
        return False
    if rest == end:  # no blank behind: decimal, address, initials, or a missing blank
        return mark[0] in "!?" and nxt.isupper() and text[a - 1].islower()
    capital = nxt.isupper() or nxt in "“„«「『‹\"'([¿¡À" or not (nxt.isascii() or nxt.islower())
    if mark != ".":
        return capital or nxt.isdigit()
    if "฀" <= text[a - 1 : a] <= "๿" or "ऀ" <= text[a - 1 : a] <= "ॿ":
        return False
    if not (capital or nxt.isdigit()):
        return False
    known = _abbreviation(text, start, a)
    if known in NEVER:
        return False
    i = a
    while i > start and text[i - 1].isalnum():
        i -= 1
    single = a - i == 1 and text[i - 1 : i] != "."
    last = text[i:a]
    if last.isdigit() and len(last) <= 2 and (nxt.islower() or _month(text, rest)):
        return False
    if single and (text[a - 1].isupper() or text[rest + 1 : rest + 2] == "."):
        return False
    if known in MAYBE:
        return nxt.isupper() or nxt in "“„«"
    return True


_MONTHS = re.compile(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")


def _month(text: str, at: int) -> bool:
    return bool(_MONTHS.match(text, at))


def _thai_boundary(text: str, start: int, a: int, b: int, openers: Openers | None) -> bool:
    if text[b] in "ๆฯ":
        return False
    learnt = openers.opens(text, b) if openers is not None else None
    listed = _OPENERS.longest(text, b)
    if not listed and not learnt or listed and _CONTINUE.longest(text, b) >= listed:
        return False
    before = text[start:a].strip()
    if not before or _LONE.search(before) and _LONE.match(before):
        return False
    last = before.rsplit(" ", 1)[-1]
    if _THAI_ABBREVIATION.fullmatch(last) or last.endswith(("ว่า", "คือ", "ได้แก่", "เช่น", "และ", "หรือ", "ของ", "ตาม", "โดย", "กับ", "ใน")):
        return False
    if not re.search("[฀-๿]", before):
        return False
    if last in ("ข้อ", "มาตรา", "หมวด", "หน้า", "พ.ศ.", "ที่", "ณ", "ถึง"):
        return False
    if re.search(r"(?:ความใน|คำว่า \S*|ลดจาก) ?[\S ]{0,12}$", before) and len(before) < 16:
        return False
    if text.startswith("ให้", b) and "ผู้ใด" in before and "ให้" not in before.split("ผู้ใด", 1)[1].replace("ผู้ให้", ""):
        return False
    return True


def sentence_units(passages: DataFrame, key: str = "passage_id", text: str = "text", with_text: bool = False, corpus: DataFrame | None = None) -> DataFrame:
    """(key, sentence, start_pos, end_pos[, sentence_text]) for every passage; what opens Thai sentences is learnt from ``corpus`` (the passages if left out)."""
    source = passages.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    fields = [key, "sentence", "start_pos", "end_pos", *(["sentence_text"] if with_text else [])]
    known = passages.sparkSession.sparkContext.broadcast(Openers.learnt((passages if corpus is None else corpus).select(F.col(text).alias("text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"].tolist(), batch["text"].tolist()):
                at = 0
                for i, e in enumerate(sentence_ends(t, known.value)):
                    s = at
                    while s < e and t[s].isspace():
                        s += 1
                    rows.append((k, i, s, e, *((t[s:e],) if with_text else ())))
                    at = e
            yield pd.DataFrame(rows, columns=fields).astype({"sentence": "int32", "start_pos": "int32", "end_pos": "int32"})

    return source.mapInPandas(run, f"{key} bigint, sentence int, start_pos int, end_pos int" + (", sentence_text string" if with_text else ""))
