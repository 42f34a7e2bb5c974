"""Defective prompt and response pairs: empty, truncated, refusal, copy, language.

* copy: a suffix automaton of the prompt is traversed with the response; what isn't covered by long
  shared substrings must be next to nothing.
* refusal: an Aho-Corasick automaton of refusal phrases, unless the pair is marked out of scope.
* truncated: a stack of open delimiters, dangling words and abbreviations, missing terminators in
  scripts that have them, and, for Thai, end statistics: over all responses it is counted how often
  the last characters of a response end a sentence and how often they go on; a response whose last
  characters nearly always go on stopped early.  The counts are kept exactly, by 64-bit hash, for the
  suffixes that responses end in; a bitmap of fixed size keeps other n-grams out of the shuffle.  A tail
  too rare for counts is held against the prompt: a name that the prompt carries on with was cut.
* language: script shares and stopword votes of prompt and response.

Defined cases: a null response is empty; a null prompt can be neither copied nor differ in language;
null in_scope counts as in scope; an empty response has no other defect; a copy isn't a refusal too, but
either, and a refusal out of scope, may be truncated or in another language (refusals are truncated by
their own signs, without the end statistics); each repeated pair is reported under its own id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamnan.functions.cluster import columns, cut_lineage
from tamnan.llm.sentences import NEVER, Openers, sentence_ends

#: log2 of the bits of the bitmap, the suffix lengths (longest first), the least evidence, the share of ends below which a text is cut.
BITS = 22
SUFFIXES = (26, 18, 12, 7)
EVIDENCE, CUT_SHARE = 6, 0.12

# Fixed values.
_EMPTY = frozenset("null none nan nil n/a na empty undefined tbd ว่าง ไม่มี [ว่าง] (ว่าง) [empty] (empty) <empty> noanswer no answer".split()) | {"no answer", "n.a."}
# what can't be done, by whom it is softened, and what is declined; every combination is a phrase of the automaton
_TH_NOT = "ขอไม่ ไม่ขอ มิอาจ ไม่อาจ ไม่สามารถ ไม่สะดวก ไม่ประสงค์จะ ปฏิเสธที่จะ".split()
_TH_VERBS = "ตอบ ให้คำตอบ ให้ข้อมูล ให้คำแนะนำ ให้ความเห็น ช่วย".split()
_TH_OBJECTS = ["", "เรื่องนี้", "ส่วนนี้", "คำถามนี้", "ประเด็นนี้"]
_EN_NOT = ["can't", "cant", "cannot", "can not", "won't", "wont", "unable to", "not able to", "not allowed to", "must decline to", "decline to"]
_EN_VERBS = "help answer assist provide discuss respond share comply".split()
_DE_NOT = [f"{verb} ich {soft}nicht" for verb in ("kann", "darf") for soft in ("", "ihnen ", "leider ", "ihnen leider ")]
_REFUSALS = [
    *(a + soft + verb for a in _TH_NOT for soft in ("", "ที่จะ", "จะ") for verb in _TH_VERBS),
    *(verb + thing + to + still + "ไม่ได้" for verb in _TH_VERBS for thing in _TH_OBJECTS for to in ("", "ให้") for still in ("", "ยัง")),
    *"ขอผ่าน ไม่อนุญาตให้ตอบ ไม่มีข้อมูลเพียงพอที่จะตอบ 无法回答 不能回答 无法提供 很抱歉 お答えでき 回答できま 申し訳ありません 申し訳ございません".split(),
    *(f"{a} {verb}" for a in _EN_NOT for verb in _EN_VERBS),
    *(f"rather not {verb}" for verb in ("answer", "say", "respond")),
    *(f"not enough information {who}to {verb}" for who in ("", "for me ") for verb in ("answer", "respond")),
    *(f"i {must}{verb}" for must in ("", "must ", "have to ") for verb in ("decline", "refuse")),
    *_DE_NOT, "leider kann ich", "nicht beantworten", "je ne peux pas", "je ne suis pas", "je regrette", "désolé, je", "désolé, mais je", "उत्तर नहीं दे सक", "क्षमा करें",
]
#: A search that found nothing, told in two parts with anything between them but a blank; what a rule about others, not a refusal, goes on with.
_SEARCHED, _NOTHING, _OF_OTHERS = "หาคำตอบ", "ไม่พบ", re.compile("แทนผู้อื่น|หากไม่พบหลักฐาน")
_INTRO = re.compile(r"^(?:ที่ถามว่า|คำถาม(?:คือ)?|ถาม|คุณถามว่า|q|question|you asked|the question is|frage|die frage lautet|la question est|问题|問題|质问|質問|प्रश्न)[\s::]*", re.I)
_PARTICLES = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า")
_PARTICLE = re.compile(r"(?:นะ)?(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า)+$")
_CITATION = re.compile(r"(?:\s*(?:\[\d+(?:[,–-]\s?\d+)*\]|[((](?:บทที่|หน้า|ข้อ|มาตรา|p\.|pp\.|ch\.|S\.)[^()()]*[))]))+$")
_DANGLING = re.compile(r"(?:และ|หรือ|รวมถึง|รวมทั้ง|หาก|ตามข้อ|ตามมาตรา|โดย|เช่น|ได้แก่|คือ|ของ|ซึ่ง|เพื่อ|แต่|เพราะ|เนื่องจาก|ดังนี้|กับ|ทั้งนี้|นอกจากนี้|ดังนั้น|อนึ่ง|พ\.ศ\.|[เแโใไ])$|[,،、，;:;:(\[“「『«„/]$|(?:^|\n)\s*(?:\d{1,2}[.)]|[-•*])$|\b(?:and|or|the|of|to|with|including|such as|und|oder|der|die|das|mit|et|ou|de|la|le|avec)$", re.I)
_CLOSERS = ")]}”»」』）】\"’'›*"
_PAIRS = {"(": ")", "[": "]", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】"}
_STOP = {
    "en": frozenset("the of and to is are was were be been being in at on for a an that this these those with by from as it its he she they we you i my your his her their our not no but or if than then so who whom whose what which why when where how does do did have has had can could will would shall should may must there here about into over under after before each every all any some such only own same both more most other".split()),
    "fr": frozenset("le la les l de du des d un une et ou à au aux que qu qui quoi dont où est sont était étaient été être a ont avait dans pour par sur avec sans sous ne n pas plus se s ce c cette ces son sa ses leur leurs mon ma mes nous vous ils elles il elle on y en je j me m te tu mais donc or ni car si comme quand comment pourquoi depuis avant après entre selon chaque tout tous toute toutes même très aussi".split()),
    "de": frozenset("der die das dem den des ein eine einen einem einer eines und oder aber denn in im an am auf aus bei mit nach von vom zu zum zur über unter vor für durch gegen ohne um seit ist sind war waren sein hat haben hatte wird werden wurde nicht kein keine es er sie wir ihr ich man sich dass daß ob wenn weil als wie wer was wo wann warum welche welcher welches auch nur noch schon sehr mehr laut darum bis so da".split()),
}
_ASKS = re.compile(r"(?:แปล|ตอบ|เขียน|สรุป|อธิบาย|ขอ)\S*(?:เป็น|ด้วย)?ภาษา|เป็นภาษา(?:อังกฤษ|จีน|ญี่ปุ่น|ฝรั่งเศส|เยอรมัน|ฮินดี|ไทย)|\btranslat\w+|\b(?:in|into|auf|en|ins) (?:english|thai|french|german|chinese|japanese|hindi|englisch|deutsch|französisch|anglais|français|allemand|thaï)\b|\bübersetz|\btraduis|\btradui[rst]|翻译|翻訳|用(?:英|中|日|法|德|泰)[语文]|(?:英|中|日本|タイ|ドイツ|フランス)語で|अनुवाद|(?:अंग्रेज़ी|हिंदी) में", re.I)
_SCRIPTS = (("th", "฀-๿"), ("kana", "぀-ヿ"), ("han", "一-鿿"), ("hi", "ऀ-ॿ"), ("latin", "A-Za-zÀ-ɏ"), ("cyrillic", "Ѐ-ӿ"), ("arabic", "؀-ۿ"), ("hangul", "가-힣"))
_SCRIPT = {name: re.compile(f"[{r}]+") for name, r in _SCRIPTS}


class SuffixAutomaton:
    """All substrings of a text in linear space; ``match_lengths`` gives, for each position of another text, the longest substring ending there."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def match_lengths(self, text: str) -> list[int]:
        state = size = 0
        out = []
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            else:
                state = size = 0
            out.append(size)
        return out


_NO_LETTER = re.compile(r"[\W_]+")


def _plain(s: str) -> str:
    return _NO_LETTER.sub("", s.casefold())


_LONGEST_EMPTY = max(map(len, _EMPTY))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if len(_plain(answer)) > _LONGEST_EMPTY:
        return False
    s = re.sub(r"[\s​-‏⁠﻿­]", "", answer).casefold()
    return not any(c.isalnum() for c in s) or s in _EMPTY or s.strip("[](){}<>\"'.*-—") in _EMPTY


def is_copy(question: str | None, answer: str) -> bool:
    if not question:
        return False
    q, a = _plain(question), _plain(_PARTICLE.sub("", _INTRO.sub("", answer.strip()).strip(" \n\"“”«»*.")))
    if len(q) < 4 or not a or len(a) < 0.6 * len(q):
        return False
    most = -(-8 * len(q) // 10)
    if q[len(q) - most : most] not in a:  # every part of the prompt that makes up 0.8 of it holds this one
        return False
    least = max(4, int(0.5 * len(q)))
    covered, lengths = 0, SuffixAutomaton(q).match_lengths(a)
    end, longest = len(a), 0
    i = len(a) - 1
    while i >= 0:
        if lengths[i] >= least or lengths[i] == len(q):
            covered += lengths[i]
            longest = max(longest, lengths[i])
            i -= lengths[i]
        else:
            i -= 1
    return longest >= 0.8 * len(q) and end - covered <= max(3, 0.06 * end)


def stops_before_its_end(question: str, answer: str) -> bool:
    """Whether a copy lacks the last letters of the question; as many letters may follow them as in ``is_copy``."""
    q, a = _plain(question), _plain(_PARTICLE.sub("", answer.strip()))
    own = _plain(_PARTICLE.sub("", question.strip())) or q
    more = max(3, int(0.06 * len(a)))
    return not any(end[-4:] in a[-4 - more :] for end in (q, own))


_AUTOMATON = None
_RUN = re.compile(r"\S*")


def is_refusal(answer: str) -> bool:
    """Whether a refusal phrase stands in the answer, Latin ones as whole words."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for phrase in (*_REFUSALS, _SEARCHED):
            _AUTOMATON.add_word(phrase, phrase)
        _AUTOMATON.make_automaton()
    s = answer.lower().replace("’", "'")
    for last, phrase in _AUTOMATON.iter(s):
        first, end = last - len(phrase) + 1, last + 1
        if phrase[0].isascii() and first and s[first - 1].isalnum() or phrase[-1].isascii() and s[end : end + 1].isalnum():
            continue
        if phrase == _SEARCHED and _NOTHING not in _RUN.match(s, end).group(0):
            continue
        if not _OF_OTHERS.search(s[first : end + 80]):
            return True
    return False


def script_shares(text: str) -> dict[str, float]:
    counts = {name: sum(map(len, rx.findall(text))) for name, rx in _SCRIPT.items()}
    total = sum(counts.values()) or 1
    return {k: v / total for k, v in counts.items()} | {"n": sum(counts.values())}


def language(text: str) -> tuple[str | None, int]:
    """(language, strength): the script where it tells, stopword votes in Latin script."""
    s = script_shares(text)
    if s["n"] < 3:
        return None, 0
    if s["th"] > 0.4:
        return "th", int(s["th"] * s["n"])
    if s["hi"] > 0.3:
        return "hi", int(s["hi"] * s["n"])
    if s["kana"] > 0.12:
        return "ja", int((s["kana"] + s["han"]) * s["n"])
    if s["han"] > 0.3:
        return "zh", int(s["han"] * s["n"])
    for other in ("cyrillic", "arabic", "hangul"):
        if s[other] > 0.4:
            return other, int(s[other] * s["n"])
    votes = _votes(text)
    best = max(votes, key=votes.get)
    return (best, votes[best]) if votes[best] > 0 else (None, 0)


def _votes(text: str) -> dict[str, int]:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return {k: sum(w in v for w in words) for k, v in _STOP.items()}


def other_language(question: str | None, answer: str) -> bool:
    if not question or _ASKS.search(question):
        return False
    q, _ = language(question)
    a, strength = language(answer)
    if q is None or a is None or q == a:
        return False
    latin = {"en", "fr", "de"}
    if q in latin and a in latin:
        mine, theirs = _votes(answer)[q], _votes(answer)[a]
        return theirs >= 2 and theirs >= 2 * mine + 1
    if a in latin:
        shares = script_shares(answer)
        own = shares["th"] if q == "th" else shares["hi"] if q == "hi" else shares["han"] + shares["kana"]
        return own < 0.1 and (strength >= 2 or (strength >= 1 and len(answer.split()) <= 6))
    return strength >= 4


def _masked(s: str) -> str:
    return re.sub(r"[\d๐-๙]+", "0", s)


def _core(answer: str) -> str:
    """The answer without trailing citations and polite particles."""
    s = answer.strip()
    while True:
        t = _CITATION.sub("", s) if s.endswith((")", "]", "）")) else s
        t = (_PARTICLE.sub("", t) if t.endswith(_PARTICLES) else t).rstrip()
        if t == s:
            return s
        s = t


class Grams:
    """64-bit hashes of the n-grams of several texts at once, of any length from running sums; equal n-grams have equal hashes wherever they stand."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, texts: list[str]):
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        power = np.full(len(codes) + 1, self.BASE, dtype=np.uint64)
        self.inverse = np.full(len(codes) + 1, self.INVERSE, dtype=np.uint64)
        power[0] = self.inverse[0] = 1
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((codes + np.uint64(0x632BE59B)) * np.cumprod(power)[:-1], dtype=np.uint64)))
            self.inverse = np.cumprod(self.inverse)

    def at(self, start: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the ``k`` characters from each ``start``."""
        with np.errstate(over="ignore"):
            h = (self.total[start + k] - self.total[start]) * self.inverse[start] + np.uint64(k)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(29))


def tail_hashes(answers: list[str]) -> list[list[int]]:
    """For each answer one hash for each suffix length of its end, digits as 0; none where the end is too short."""
    masked = [_masked(_core(a)) for a in answers]
    grams = Grams(masked)
    out: list[list[int]] = [[] for _ in answers]
    length, end = np.diff(grams.offsets), grams.offsets[1:]
    for k in SUFFIXES:
        enough = np.flatnonzero(length >= k + 3)
        for i, h in zip(enough.tolist(), grams.at(end[enough] - k, k).astype(np.int64).tolist()):
            out[i].append(h)
    return out


def breaks_off_a_name(question: str | None, answer: str) -> bool:
    """Whether the answer ends in a part of a Thai word that the question carries on with."""
    if not question:
        return False
    core = _core(answer)
    for size in range(min(14, len(core)), 2, -1):
        at = question.find(core[-size:])
        if at >= 0:
            after = question[at + size : at + size + 1]
            return "\u0e01" <= after <= "\u0e4e"
    return False


def end_counts(answers: list[str], wanted: np.ndarray | None = None, openers: Openers | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether a sentence ends there) of all n-grams inside the answers but for their very ends.

    ``wanted``: bitmap of the hashes that matter; ``openers``: what begins Thai sentences.
    """
    masked = [_masked(a.strip()) for a in answers]
    grams = Grams(masked)
    final = np.zeros(int(grams.offsets[-1]) + 1, dtype=bool)
    limit = np.zeros(len(masked), dtype=np.int64)  # where the last n-gram may end
    for i, (m, first) in enumerate(zip(masked, grams.offsets.tolist())):
        ends, core = sentence_ends(m, openers), len(_core(m))
        limit[i] = first + core - (core == len(m))
        final[[first + e for e in ends[:-1]]] = True
        if core < len(m):
            final[first + core] = True
    limit = np.repeat(limit, np.diff(grams.offsets))
    hashes, stops = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=bool)]
    for k in SUFFIXES:
        start = np.flatnonzero(np.arange(k, k + len(limit)) <= limit)
        h = grams.at(start, k)
        if wanted is not None:
            keep = wanted[(h >> np.uint64(64 - BITS)).astype(np.int64)]
            start, h = start[keep], h[keep]
        hashes.append(h)
        stops.append(final[start + k])
    return np.concatenate(hashes), np.concatenate(stops)


def suffix_evidence(pairs: DataFrame, tails: DataFrame) -> DataFrame:
    """(h, goes, ends) over all responses (column a) for the hashes in ``tails`` (column h)."""
    bits = tails.select(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("i")).distinct()  # at most 2**BITS rows
    bitmap = np.zeros(1 << BITS, dtype=bool)
    bitmap[columns(bits)["i"].astype(np.int64)] = True
    openers = pairs.sparkSession.sparkContext.broadcast(Openers.learnt(pairs.select(F.col("a").alias("text"))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, e = end_counts([t for t in b["a"].tolist() if t and _THAI_RUN.search(t)], bitmap, openers.value)
            u, place = np.unique(h, return_inverse=True)
            total, ended = np.bincount(place, minlength=len(u)), np.bincount(place, weights=e, minlength=len(u)).astype(np.int64)
            yield pd.DataFrame({"h": u.astype(np.int64), "goes": total - ended, "ends": ended})

    return pairs.select("a").mapInPandas(count, "h bigint, goes bigint, ends bigint").groupBy("h").agg(F.sum("goes").alias("goes"), F.sum("ends").alias("ends"))


def is_truncated(answer: str) -> bool | None:
    """Whether the answer stops early; None where only the end statistics can tell."""
    s = answer.strip()
    stack: list[str] = []
    for c in s:
        if stack and c == stack[-1]:
            stack.pop()
        elif c in _PAIRS:
            stack.append(_PAIRS[c])
    if stack:
        return True
    core = _core(s)
    cited = len(core) < len(s)
    bare = core.rstrip(_CLOSERS).rstrip()
    if not bare or (not cited and _DANGLING.search(s)):
        return bool(bare)
    if cited:
        return False
    last = bare[-1]
    if last == ".":
        token = re.search(r"(?:[^\W\d_]\.)*[^\W\d_]+\.?$", bare[:-1] + ".")
        word = token.group(0).rstrip(".").lower() if token else ""
        if "฀" <= bare[-2:-1] <= "๿":
            return True if re.search(r"(?:ดร|ร\.ร|อ|พ\.ศ|[กมพสตธ][ิี]?\.?[คยพ])\.$", bare) else None
        return word in NEVER and len(bare) > 20
    if last in "!?…。！？।":
        return False
    if re.search("[฀-๿]", core):
        return None
    if last.isascii() or last.isalpha() and last.isupper() or re.match("[À-ɏ]", last):
        return len(bare.split()) >= 5
    return len(bare) >= 12


def defects(question: str | None, answer: str | None, in_scope: bool | None) -> tuple[list[str], bool]:
    """(defects, whether the end statistics must still tell if the answer is truncated)."""
    if is_empty(answer):
        return ["empty"], False
    found, declined = [], False
    if copied := is_copy(question, answer):
        found.append("copy")
    elif (declined := is_refusal(answer)) and in_scope is not False:
        found.append("refusal")
    # the question shows where a copy ends; other answers' ends don't, as they go on after it and after the usual refusals
    cut = stops_before_its_end(question, answer) if copied else is_truncated(answer)
    if cut:
        found.append("truncated")
    if other_language(question, answer):
        found.append("language")
    return found, cut is None and not declined


_THAI_RUN = re.compile("[\u0e00-\u0e7f]{6}")


def pair_defects(pairs: DataFrame, key: str = "answer_id", question: str = "question", answer: str = "answer", in_scope: str = "in_scope") -> DataFrame:
    """(key, defect): one row for each defect of each pair."""
    source = pairs.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(in_scope).alias("s")).where(F.col("key").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, open_ends = [], []
            for k, q, a, s in zip(b["key"].tolist(), b["q"].tolist(), b["a"].tolist(), b["s"].tolist()):
                found, open_end = defects(q, a, None if s is None else bool(s))
                if open_end:
                    open_ends.append((len(rows), a))
                rows.append((k, found, [], open_end and breaks_off_a_name(q, a)))
            for (i, _), tails in zip(open_ends, tail_hashes([a for _, a in open_ends])):
                rows[i][2].extend(tails)
            yield pd.DataFrame([r for r in rows if r[1] or r[2] or r[3]], columns=["key", "found", "tails", "name"])

    judged = cut_lineage(source.mapInPandas(run, "key bigint, found array<string>, tails array<bigint>, name boolean"))
    tails = judged.select("key", F.posexplode("tails").alias("rank", "h"))
    evidence = suffix_evidence(source, tails)
    weighed = tails.join(evidence, "h").where(F.col("goes") + F.col("ends") >= EVIDENCE)
    longest = weighed.groupBy("key").agg(F.min_by(F.struct("goes", "ends"), "rank").alias("e"))
    cut = longest.where(F.col("e.ends") < CUT_SHARE * (F.col("e.goes") + F.col("e.ends"))).select("key")
    unheard = judged.where("name").select("key").join(longest.select("key"), "key", "left_anti")  # names are too rare for counts
    truncated = cut.unionByName(unheard).select(F.col("key").alias(key), F.lit("truncated").alias("defect"))
    return judged.select(F.col("key").alias(key), F.explode("found").alias("defect")).unionByName(truncated)
