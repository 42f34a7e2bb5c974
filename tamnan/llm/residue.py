"""Template residue, filler and error pages left in documents instead of content.

A document is cut into units (lines, sentences, parts between wide blanks).  A unit is reduced to its
*frame*: what fills a slot becomes ``⟨⟩``, digits become 0, addresses and paths become ``⟨u⟩``.  Equal
frames of different texts align records of one template; what varies between them is the slot.  A
unit is residue if

* ``slot``: placeholder syntax fills the slot of a short frame, or of a frame that several texts share
  with different placeholders; or nothing aligns with the unit and its words don't speak of templates
  (a text *about* placeholders carries words of the subject, its placeholder never varies, or it shows
  several kinds of syntax side by side);
* ``slot`` of no known syntax: a bracketed filler in a slot that other records of the same frame leave
  unfilled, if the filler retains one of the variable names that placeholders of the corpus carry
  (where no label stands beside it, if fillers of the same wording hold several such names);
* ``page``: it speaks of a failing server or of scripts and its frame is a known notice, or recurs in
  at least ``MIN_TEXTS`` different texts, or makes up several whole documents (copies count here);
* ``filler``: nearly all its letters are filler words.

Units, frames and placeholders of any length are looked at.  Blanks of a printed form (dots, underscores)
are no slots.

Defined cases: null and empty documents hold no residue; repeated documents count once for a frame
and are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamnan.functions.cluster import broadcast_if_small, cut_lineage

MIN_TEXTS = 3
#: Letters beside the slots up to which a frame is a label that needs no second witness.
SHORT_FRAME = 26

PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|[$#]\{[^{}\n]*\}|<%[^%\n]*%>|<<[^<>\n\d]+>>|\[\[[^\[\]\n\d]+\]\]|@@[^@\n]+@@|%%[^%\s]{2,}%%|%\([\w.]+\)[sd]|%[sd]\b|__[^\W_](?:(?!__)[\w.ऀ-ॿั-๎])*__(?!\.)"
    r"|«[^«»\n ]+»|(?<![\w{$#])\{[^\W\d][\w.ऀ-ॿั-๎]*\}|\[(?:insert|your|enter|add|name of|ใส่|กรอก|ระบุ|พิมพ์|insérer|votre|hier|ihr|bitte|请输入|填写|ここに|यहाँ)[^\[\]\n]*\]|<(?!/?(?:html|head|title|body|hr|p|br|div|noscript|script|a|b|i|h\d)\b)[^\W\d][\w. ऀ-ॿั-๎-]+>|\bX{4,}\b|\b(?:TBD|TODO|FIXME)\b",
    re.I,
)
#: Words of filler text.
FILLER = re.compile(
    r"\b(?:lorem|ipsum|dolor|dolore|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum)\b"
    r"|placeholder text|sample text|dummy text|text goes here|your text here|asdf(?: ?jkl)?|qwerty|texte factice|faux texte|texte d.exemple|blindtext|platzhaltertext|beispieltext|mustertext|ทดสอบ|ข้อความตัวอย่าง|ตัวหนังสือสมมติ|ใส่เนื้อหาตรงนี้|เนื้อหาจำลองสำหรับจัดหน้า|รอเพิ่มเนื้อหา|พิมพ์รายละเอียดของท่าน|กขคงจฉชซ|ใส่ข้อความที่นี่|示例文本|占位文字|占位符|测试|ダミーテキスト|サンプルテキスト|テスト|यहाँ पाठ लिखें|नमूना पाठ",
    re.I,
)
_OWN_FILLER = re.compile(r"(?:blind|platzhalter|beispiel|muster)text|\b(?:asdf|qwerty|lorem|ipsum|dolor|dolore|amet|consectetur|adipiscing|eiusmod|incididunt|labore|aliqua|veniam|nostrud|ullamco)\b", re.I)
#: Words of error pages and script notices.
NOTICE = re.compile(
    r"javascript|จาวาสคริปต์|สคริปต์|脚本|スクリプト|स्क्रिप्ट|noscript|scripts? and cookies|requires scripts|enable cookies|in your browser settings|คุกกี้|\berror\b|erreur|fehler \d|ข้อผิดพลาด|ไม่พบหน้า|ไม่พร้อมให้บริการ|ปิดปรับปรุง|错误|页面不存在|エラー|ページが見つかり|त्रुटि|not found|nicht gefunden|introuvable|forbidden|access denied|permission to view|unavailable|bad gateway|timed? ?out|traceback|keyerror|exception|warning: |fatal error|parse error|too many connections|connection refused|out of memory|stack trace|reference #\d|request id|maintenance mode|under construction|internal server|service is|file \".*\", line|</?(?:html|head|title|body)>|retour à l.accueil|กลับหน้าหลัก|หน้านี้ถูก(?:ย้าย|ลบ)|page has been (?:moved|removed|deleted)|返回首页|เบราว์เซอร์",
    re.I,
)
#: Notices that need no second witness.
KNOWN = re.compile(
    r"(?:please |you need to )?enable javascript (?:to|in order)|bitte aktivieren sie javascript|veuillez activer javascript|เปิดใช้งานจาวาสคริปต์เพื่อ|เว็บไซต์นี้ต้องใช้ javascript|ของท่านไม่รองรับสคริปต์|本页面需要启用脚本|ต้องเปิดใช้สคริปต์และคุกกี้|<noscript>|this site requires scripts|checking your browser before|http error \d|^\d{3} (?:not found|forbidden|bad gateway|service unavailable|internal server error)|was not found on this server|^bad gateway|the service is unavailable|<title>\d{3}|too many connections|connection refused|out of memory|^erreur \d+ ?:|^fehler \d+:|^access denied|don.t have permission to view|^traceback \(most recent|^(?:warning|fatal error|parse error|uncaught \w+): |^ข้อผิดพลาด \d+ |ไม่พบหน้าที่ท่านต้องการ|ระบบปิดปรับปรุงชั่วคราว|^页面不存在|ページが見つかりません|javascriptを有効に",
    re.I,
)
#: A unit without these holds no placeholder; what is left of one without them is its syntax.
_SIGIL = re.compile(r"[{%<\[«@]|__|XXXX|TBD|TODO|FIXME", re.I)
_SYNTAX = re.compile(r"[\w.\s]+")
#: Words of which every notice holds one (lower case) and of which every run of filler words does; both are looked for in one pass.
_NOTICE_WORDS = (
    "script จาวาสคริปต์ สคริปต์ 脚本 スクリプト स्क्रिप्ट cookies browser คุกกี้ error erreur fehler ข้อผิดพลาด ไม่พบหน้า ไม่พร้อมให้ ปิดปรับปรุง ถูกย้าย ถูกลบ 错误 页面 エラー ページ त्रुटि introuvable forbidden unavailable "
    "traceback exception timeout maintenance construction warning: connection uncaught <html <head <title <body </ retour กลับหน้า 返回首页 เบราว์เซอร์"
).split() + ["not found", "nicht gefunden", "access denied", "permission to", "bad gateway", "timed out", "time out", "timedout", "stack trace", "reference #", "request id", "internal server", "service is", "file \"", "out of memory", "page has been"]
_FILLER_WORDS = (
    "lorem ipsum dolor dolore amet consectetur adipiscing eiusmod incididunt labore aliqua veniam nostrud ullamco asdf qwerty blindtext platzhaltertext beispieltext mustertext ทดสอบ ข้อความตัวอย่าง ตัวหนังสือสมมติ ใส่เนื้อหาตรงนี้ "
    "เนื้อหาจำลองสำหรับจัดหน้า รอเพิ่มเนื้อหา พิมพ์รายละเอียดของท่าน กขคงจฉชซ ใส่ข้อความที่นี่ 示例文本 占位文字 占位符 测试 ダミーテキスト サンプルテキスト テスト"
).split() + ["placeholder text", "sample text", "dummy text", "text goes here", "your text here", "texte factice", "faux texte", "texte d", "यहाँ पाठ लिखें", "नमूना पाठ"]
#: One word over and over.
_REPEATED = re.compile(r"\b(\w{2,})\b(?:[\W_]{1,4}\1\b){4}")
_AUTOMATON = None


def _speaks_of(text: str) -> set[str]:
    """Which of ``notice`` and ``filler`` the words of a text hint at."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for kind, words in (("notice", _NOTICE_WORDS), ("filler", _FILLER_WORDS)):
            for word in words:
                _AUTOMATON.add_word(word, kind)
        _AUTOMATON.make_automaton()
    found: set[str] = set()
    for _, kind in _AUTOMATON.iter(text.lower()):
        found.add(kind)
        if len(found) == 2:
            break
    return found


_CUT = re.compile(r"\n+|(?<=[.!?。！？।])[  ]|[  ]{2,}")
_DIGITS = re.compile(r"\d+")
_ADDRESS = re.compile(r"https?://[^\s)\]>\"']+|(?<![\w.])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w.])|(?<![\w/])/[\w.-]+(?:/[\w.-]*)*|\b[0-9a-f]{8,}\b")
#: A bracketed filler of no known syntax, and the longest part of it that is compared with variable names.
_BRACKETED = re.compile(r"[((\[【<{«「][^()()\[\]【】<>{}«»「」\n]+[))\]】>}»」]")
_NAME = re.compile(r"[^\W\d][\w.ัิ-ฺ็-๎]*")
#: Words of texts that write about templates, scripts and servers.
_ABOUT = re.compile(
    r"template|placeholder|style guide|variable|syntax|\bcode\b|\bscript|\bdraft may|mustache|jinja|render|escap|แม่แบบ|ตัวแปร|โปรแกรม|โค้ด|สคริปต์|ไวยากรณ์|วงเล็บ|แบบฝึกหัด|บทเรียน|vorlage|platzhalter|variablen?|quelltext|skript|gabarit|modèle|balise|模板|变量|占位|代码|テンプレート|変数|コード|टेम्पलेट|चर ",
    re.I,
)


def _letters(s: str) -> int:
    return sum(c.isalpha() for c in s)


def units(text: str) -> list[str]:
    return [u for part in _CUT.split(text) if (u := part.strip())]


def _frame(unit: str) -> str:
    return _DIGITS.sub("0", _ADDRESS.sub("⟨u⟩", unit))


def suspects(text: str) -> list[tuple[str, str, str]]:
    """(kind, frame, what fills the slot) of the suspect units of one text; kind ``open``: a bracketed filler of no known syntax."""
    out: list[tuple[str, str, str]] = []
    hints = _speaks_of(text)
    repeated = _REPEATED.search(text) is not None
    for u in units(text):
        own = _speaks_of(u) if hints else hints
        if "filler" in own and _filler_run(u) or repeated and _REPEATED.search(u):
            out.append(("filler", "filler", u[:40]))
            continue
        slots = [m for m in PLACEHOLDER.finditer(u)] if _SIGIL.search(u) else []
        if slots:
            m = slots[0]
            if _letters(u[: m.start()]) <= 12:
                out.append(("slot", _frame(u[: m.start()]) + "⟨⟩", m.group(0)))
            else:
                lone = len({_SYNTAX.sub("", x.group(0)) for x in slots}) == 1 and not _ABOUT.search(u)
                out.append(("alone" if lone else "slot", _frame(PLACEHOLDER.sub("⟨⟩", u)), m.group(0)))
        elif (m := _BRACKETED.search(u)) and _NAME.search(m.group(0)):
            out.append(("open", _frame(u[: m.start()]) + "⟨⟩", m.group(0)))
        if "notice" not in own:
            continue
        if (m := KNOWN.search(u)) and _letters(u[: m.start()]) <= 20:
            out.append(("page", _frame(u[: m.end()]), u[: m.end()]))
        elif NOTICE.search(u):
            out.append(("page", _frame(u), u))
    return out


def _filler_run(u: str) -> bool:
    """Whether filler words follow one another: one long enough, or the whole unit."""
    run = best = count = 0
    last = None
    latin = False
    for m in FILLER.finditer(u):
        if last is None or re.search(r"\w", u[last : m.start()]):
            run = count = 0
            latin = False
        run, count, last = run + _letters(m.group(0)), count + 1, m.end()
        latin = latin or bool(_OWN_FILLER.search(m.group(0))) or not m.group(0).isascii() or " " in m.group(0)
        if latin and count >= 2 and (not m.group(0).isascii() or count >= 4 or " " in m.group(0)):
            best = max(best, run)
    return best >= 14 or (last is not None and latin and run >= 0.9 * _letters(u) and count >= 1 and u[:1].isupper() is False and run > 4) or (latin and run >= 0.95 * _letters(u) and run >= 14)


def residue_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, frame, filler, text_hash, whole, known, size) of all suspect units; ``whole``: the text has no other units."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).where(F.col("key").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, h in zip(b["key"].tolist(), b["text"].tolist(), b["text_hash"].tolist()):
                found = suspects(t)
                if found:
                    whole = len(found) >= len(units(t))
                    out += [(k, kind, frame, filler, h, whole, kind == "page" and bool(KNOWN.search(filler)), _letters(frame)) for kind, frame, filler in found]
            yield pd.DataFrame(out, columns=["key", "kind", "frame", "filler", "text_hash", "whole", "known", "size"]).astype({"size": "int32"})

    return source.mapInPandas(run, "key bigint, kind string, frame string, filler string, text_hash bigint, whole boolean, known boolean, size int")


def _names(fillers: DataFrame) -> DataFrame:
    """(name) of the variables that placeholders carry, each in at least ``MIN_TEXTS`` different fillers."""
    name = F.explode(F.array_distinct(F.regexp_extract_all("filler", F.lit("[\\p{L}\\p{M}][\\p{L}\\p{M}\\p{N}_.]*"), F.lit(0))))
    return fillers.select("filler").distinct().select("filler", name.alias("name")).where(F.length("name") >= 3).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS).select("name")


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, frame, filler): the residue units of all documents."""
    found = cut_lineage(residue_units(documents, key, text))
    sure = found.where("kind != 'open'").dropDuplicates(["key", "kind", "frame"]).withColumn("lone", F.col("kind") == "alone").withColumn("kind", F.when(F.col("kind") == "alone", "slot").otherwise(F.col("kind")))
    by_text = sure.groupBy("kind", "frame", "text_hash").agg(F.min("filler").alias("lo"), F.max("filler").alias("hi"), F.sum(F.col("whole").cast("int")).alias("whole"), F.max(F.col("known").cast("int")).alias("known"), F.max(F.col("lone").cast("int")).alias("lone"), F.first("size").alias("size"))
    frames = by_text.groupBy("kind", "frame").agg(F.count("*").alias("texts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("whole").alias("wholes"), F.max("known").alias("known"), F.max("lone").alias("lone"), F.first("size").alias("size"))
    shared = (F.col("texts") >= MIN_TEXTS) & (F.col("lo") != F.col("hi"))
    kept = frames.where(
        (F.col("kind") == "filler")
        | ((F.col("kind") == "slot") & ((F.col("size") <= SHORT_FRAME) | shared | ((F.col("lone") == 1) & (F.col("texts") < MIN_TEXTS))))
        | ((F.col("kind") == "page") & ((F.col("known") == 1) | (F.col("texts") >= MIN_TEXTS) | (F.col("wholes") >= 2)))
    ).select("kind", "frame")
    residue = cut_lineage(sure.join(broadcast_if_small(kept), ["kind", "frame"], "left_semi").select("key", "kind", "frame", "filler"))
    slots = residue.where("kind = 'slot'")
    # records of the same templates whose slots hold a filler of no known syntax: it is residue if it retains a variable's name
    aligned = found.where("kind = 'open'").join(slots.select("frame").distinct(), "frame", "left_semi").select("key", F.lit("slot").alias("kind"), "frame", "filler")
    names = cut_lineage(_names(slots))
    lengths = sorted(r["n"] for r in names.select(F.length("name").alias("n")).distinct().collect())  # no more than the longest name has characters
    places = F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")
    starts = F.explode(F.when(F.length("filler") >= F.col("n"), F.sequence(F.lit(1), F.length("filler") - F.col("n") + 1))).alias("at")
    parts = aligned.select("filler").distinct().select("filler", places).select("filler", "n", starts).select("filler", F.substring("filler", F.col("at"), F.col("n")).alias("name"))
    named = cut_lineage(parts.join(names, "name", "left_semi").distinct().withColumn("wrapper", F.replace("filler", F.col("name"), F.lit("⟨⟩"))))
    # without a label beside it a bracketed remark may hold such a word too: there its wrapper must hold several names
    several = named.groupBy("wrapper").agg(F.count_distinct("name").alias("n")).where("n > 1").select("wrapper")
    bare = F.col("frame") == "⟨⟩"
    labelled = aligned.where(~bare).join(named.select("filler").distinct(), "filler", "left_semi")
    unlabelled = aligned.where(bare).join(named.join(several, "wrapper", "left_semi").select("filler").distinct(), "filler", "left_semi")
    unnamed = labelled.unionByName(unlabelled).select("key", "kind", "frame", "filler")
    return residue.unionByName(unnamed).withColumnRenamed("key", key)


def without_residue(documents: DataFrame, residue: DataFrame, key: str = "doc_id") -> DataFrame:
    return documents.join(residue.select(key).distinct(), key, "left_anti")
