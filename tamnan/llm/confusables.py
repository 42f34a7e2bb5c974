"""One form for strings that look alike but are made of different characters.

Skeleton: decompose (NFD), drop what isn't drawn, put Thai marks in one order, replace every character
by its prototype, decompose again.  Two values are confusable if their skeletons are equal.  What a
reader can tell apart stays apart: digits of another script, superscripts, letter case, blank against
no blank.

Defined cases: the skeleton of null is null, of "" is "" (neither is ever paired); repeated rows with
the same characters are no pair.  Groups are compared through (skeleton, value) classes, so copies
are never paired with each other, and joins run on the 128-bit hash of the skeleton and then on the
skeleton itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamnan.functions.cluster import cut_lineage

# Letters drawn like a Latin letter (from the public Unicode confusables data).
_LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "т": "t", "ь": "b", "п": "n", "г": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "γ": "y", "κ": "k", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ſ": "f", "Ꭺ": "A", "Ꮃ": "W",
    "‐": "-", "‑": "-", "‒": "-", "–": "–", "−": "-", "﹣": "-", "˗": "-", "’": "'", "‘": "'", "ʼ": "'", "ʹ": "'", "′": "'", "`": "'", "´": "'",
    "Å": "A\u030a", "K": "K", "Ω": "Ω", "µ": "μ", "∕": "/", "⁄": "/", "ː": ":", "꞉": ":", "∶": ":", "׃": ":", "․": ".", "‚": ",", "٫": ",", "ǃ": "!", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X",
    "…": "...", "ŉ": "'n", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "˳": "°", "˚": "°",
}
_LOOKALIKE.pop("˳")
#: Only near-look-alikes: a reader tells them apart in running text.
_NEAR = frozenset("пгктαγκυσ")
for _c in _NEAR:
    _LOOKALIKE.pop(_c, None)


#: Letters beyond ASCII that the Unicode confusables data (16.0, ICU 77.1) draw like one ASCII letter, by their code points: what ``prototypes`` reads,
#: stored so that no result depends on the driver's class path.
_DRAWN = {
    "A": "15C5 102A0 16F40",
    "B": "13F4 15F7 10282 102A1 10301",
    "C": "13DF 2CA4 102A2 10302 10415 1051C",
    "D": "13A0 15DE 15EA",
    "E": "13AC 2D39 10286 118A6 118AE",
    "F": "3DC 15B4 10287 102A5 10525 118A2 118C2",
    "G": "50C 13C0 13F3",
    "H": "13BB 157C 2C8E 102CF",
    "I": "196 2C92",
    "J": "37F 13AB 148D",
    "K": "13E6 16D5 212A 2C94 10518",
    "L": "13DE 14AA 2CD0 1041B 10526 118A3 118B2 16F16",
    "M": "3FA 13B7 15F0 16D6 2C98 102B0 10311",
    "N": "2C9A 10513",
    "O": "555 B20 12D0 2C9E 2D54 10292 102AB 10404 104C2 10516 118B5",
    "P": "13E2 146D 2CA2 10295",
    "Q": "2D55",
    "R": "1A6 13A1 13D2 1587 104B4 16F35",
    "S": "54F 13D5 13DA 10296 10420 16F3A",
    "T": "13A2 2CA6 10297 102B1 10315 118BC 16F0A",
    "U": "54D 1200 144C 104CE 118B8 16F42",
    "V": "474 13D9 142F 2D38 1051D 118A0 16F08",
    "W": "13D4",
    "X": "16B7 2CAC 2D5D 10290 102B4 10317 10527",
    "Y": "3D2 4AE 13A9 13BD 2CA8 102B2 118A4 16F43",
    "Z": "13C3 118A9",
    "b": "184 42C 13CF 1472 15AF",
    "c": "1D04 2CA5 1043D",
    "d": "13E7 146F",
    "e": "4BD",
    "f": "584 1E9D",
    "g": "18D 581 1D83",
    "h": "570 13C2",
    "i": "269 26A 13A5 1FBE 118C3",
    "l": "1C0 5D5 5DF 627 7CA 16C1 2D4F FE8D FE8E 1028A 10309 16F28",
    "n": "578 57C",
    "o": "585 5E1 647 6BE 6C1 6D5 D20 101D 10FF 1D0F 1D11 2C9F FBA6 FBA7 FBA8 FBA9 FBAA FBAB FBAC FBAD FEE9 FEEA FEEB FEEC 1042C 104EA 118C8 118D7",
    "p": "3F1 2CA3",
    "q": "563 566",
    "r": "1D26 2C85",
    "s": "1BD 10448 118C1",
    "u": "28B 57D 1D1C 104F6 118D8",
    "v": "5D8 1D20 11706 118C0",
    "w": "26F 461 561 1D21 1170A 1170E 1170F",
    "x": "1541 157D",
    "y": "263 28F 4AF 10E7 1D8C 1EFF 118DC",
    "z": "1D22 118C4",
}


def _prototypes() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in _LOOKALIKE.items()}
    for cp in range(0xFF01, 0xFF5F):
        table[cp] = chr(cp - 0xFEE0)
    for cp in (*range(0xFF61, 0xFFA0), 0xFFE0, 0xFFE1, 0xFFE5):
        table[cp] = unicodedata.normalize("NFKD", chr(cp))
    for cp in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        table[cp] = " "
    for cp in (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, 0x115F, 0x1160, 0x3164, 0xFFA0):
        table[cp] = None
    for cp in (*range(0x2100, 0x2190), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1FBF0, 0x1FBFA)):
        if unicodedata.decomposition(chr(cp)).startswith("<font>") or 0x2160 <= cp < 0x2180:  # letters and digits of another typeface, Roman numerals
            table[cp] = unicodedata.normalize("NFKD", chr(cp))
    table[0xE33] = "\u0e4d\u0e32"
    table[0xEB3] = "\u0ecd\u0eb2"
    return table


_FIXED = _prototypes()
PROTOTYPES = _FIXED | {int(x, 16): like for like, points in _DRAWN.items() for x in points.split()}


def prototypes(spark: SparkSession) -> dict[int, str | None]:
    """``PROTOTYPES`` read anew from the Unicode confusables data of Spark's ICU: what ``_DRAWN`` is written from and tested against.

    Letters are those up to U+1FFFF without Thai, Lao and U+3040 to U+D7AF.  No query calls it; it raises where the driver's class path has no ICU.
    """
    letters = [chr(cp) for cp in range(0x80, 0x20000) if cp not in _FIXED and unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lt", "Lo") and not 0x0E00 <= cp < 0x0F00 and not 0x3040 <= cp < 0xD7B0]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError as e:  # no such class
        raise RuntimeError("the driver's class path has no ICU to read the Unicode confusables data from") from e
    table = dict(_FIXED)
    for c, like in zip(letters, checker.getSkeleton(1, "\n".join(letters)).split("\n"), strict=True):
        if len(like) == 1 and like.isascii() and like.isalpha() and c not in _NEAR and len(unicodedata.normalize("NFD", c)) == 1:
            # the data have one prototype for capital i and small l
            table[ord(c)] = "I" if like == "l" and unicodedata.category(c) == "Lu" else like
    return table


_UNDRAWN = re.compile("[" + "".join(re.escape(chr(cp)) for cp, v in PROTOTYPES.items() if v is None) + "]")
_TONE_FIRST = re.compile("([\u0e48-\u0e4c]+)([\u0e31\u0e34-\u0e3a\u0e47\u0e4d]+)")
_PLAIN = re.compile("^[\t\n !-&(-_a-~]*$")


def skeleton(value: str | None, table: dict[int, str | None] = PROTOTYPES) -> str | None:
    """The common form of all strings that look like ``value``."""
    if value is None:
        return None
    if _PLAIN.match(value):
        return value
    s = unicodedata.normalize("NFD", value).translate(table)
    if "\u0e40\u0e40" in s:
        s = s.replace("\u0e40\u0e40", "\u0e41")
    if "\u0e4d" in s or _TONE_FIRST.search(s):
        s = _TONE_FIRST.sub(r"\2\1", s)
    return unicodedata.normalize("NFD", s)


def normal_form(value: str | None, table: dict[int, str | None] = PROTOTYPES) -> str | None:
    """The skeleton composed again (NFC, Thai sara am restored): what is stored for comparison."""
    s = skeleton(value, table)
    if s is None or s.isascii():
        return s
    s = re.sub("\u0e4d([\u0e48-\u0e4b]?)\u0e32", "\\1\u0e33", s)
    return unicodedata.normalize("NFC", s)


def normalised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``<column>_norm`` and ``<column>_skeleton`` beside each of ``columns`` (replacing columns of those names)."""
    rows = rows.drop(*[f"{c}_{end}" for c in columns for end in ("norm", "skeleton")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    extra = ", ".join(f"`{c}_norm` string, `{c}_skeleton` string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in columns:
                b[f"{c}_norm"] = [normal_form(x) for x in b[c].tolist()]
                b[f"{c}_skeleton"] = [skeleton(x) for x in b[c].tolist()]
            yield b

    return rows.mapInPandas(run, f"{schema}, {extra}")


def _keys(rows: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(field, id, s, v): 128-bit hashes of the skeleton and of the value; texts don't go into the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            vals = b["value"].tolist()
            yield pd.DataFrame(
                {
                    "id": b["id"],
                    "s": [xxhash.xxh3_128_digest((skeleton(x) or "").encode("utf-8", "surrogatepass")) for x in vals],
                    "v": [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in vals],
                }
            )

    source = rows.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("value")).where(F.col("id").isNotNull() & F.col("value").isNotNull() & (F.col("value") != ""))
    return source.mapInPandas(run, "id bigint, s binary, v binary").select(F.lit(field).alias("field"), "id", "s", "v")


def lookalike_groups(sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(field, s, v, id) of the rows whose skeleton occurs with at least two different values.

    ``sources``: (rows, key column, text column, field name).  Equal values are reduced to classes
    map-side before skeletons are compared, so a value that fills a third of the rows is one class.
    """
    keys = None
    for rows, key, text, field in sources:
        part = _keys(rows, key, text, field)
        keys = part if keys is None else keys.unionByName(part)
    keys = cut_lineage(keys)
    mixed = keys.groupBy("field", "s").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo != hi").select("field", "s")
    return cut_lineage(keys.join(mixed, ["field", "s"], "left_semi"))


def lookalike_classes(groups: DataFrame) -> DataFrame:
    """(field, id, class_id, links): each row of a mixed group once, the least id of its group, and how many rows look like it but differ from it."""
    size = groups.groupBy("field", "s").agg(F.count("*").alias("rows"), F.min("id").alias("class_id"))
    same = groups.groupBy("field", "s", "v").agg(F.count("*").alias("copies"))
    counted = same.join(size, ["field", "s"]).select("field", "s", "v", "class_id", (F.col("rows") - F.col("copies")).alias("links"))
    return groups.join(counted, ["field", "s", "v"]).select("field", "id", "class_id", "links")


def lookalike_pairs(groups: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: rows of one group with different values.  ``groups`` holds only mixed groups.

    Values are paired as classes; rows are joined to the pairs of their class, so copies of one value,
    however many, are never held against each other nor gathered in a row.
    """
    classes = groups.select("field", "s", "v").distinct()
    pairs = classes.withColumnRenamed("v", "va").join(classes.withColumnRenamed("v", "vb"), ["field", "s"]).where("va < vb")
    left = groups.select("field", "s", F.col("v").alias("va"), F.col("id").alias("x"))
    right = groups.select("field", "s", F.col("v").alias("vb"), F.col("id").alias("y"))
    both = pairs.join(left, ["field", "s", "va"]).join(right, ["field", "s", "vb"])
    return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
