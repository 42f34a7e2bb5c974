"""Text expressions: all built-in, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI_DIGITS, DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
TOKEN_GAP = r"[^\p{L}\p{M}\p{N}]+"


def arabic_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, DIGITS)


def thai_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, THAI_DIGITS)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, marks and digits, in order and with repeats."""
    return F.filter(F.split(F.lower(c), TOKEN_GAP), lambda t: t != "")


#: Scripts written without blanks, and the length of the overlapping pieces their runs are indexed by.
UNSPACED, GRAM = "[฀-๿぀-ヿ一-鿿]", 4


def search_tokens(c: Column) -> Column:
    """``tokens``, with runs of scripts that have no blanks between words as all their pieces of ``GRAM`` characters.

    Needs no dictionary, so names and new words are found like any other.
    """
    pieces = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - GRAM + 1), lambda i: F.substring(t, i, F.lit(GRAM)))
    return F.flatten(F.transform(tokens(c), lambda t: F.when(t.rlike(UNSPACED) & (F.length(t) > GRAM), pieces(t)).otherwise(F.array(t))))


def tidy(c: Column) -> Column:
    """No-break spaces and tabs to blanks, three or more line breaks to two, blanks collapsed and trimmed."""
    c = F.translate(c, " \t", "  ")
    c = F.regexp_replace(c, r" +", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def cut_at_edge(c: Column, limit: int, share: float = 0.6) -> Column:
    """At most ``limit`` characters, cut at the last paragraph or else word edge beyond ``share`` of it."""
    head = F.substring(c, 1, limit)
    rfind = lambda mark: F.lit(limit) - F.instr(F.reverse(head), mark) + 1
    edge = lambda mark: (F.instr(head, mark) > 0) & (rfind(mark) > F.lit(limit * share))
    cut = F.when(edge("\n"), F.substring(head, F.lit(1), rfind("\n") - 1)).when(edge(" "), F.substring(head, F.lit(1), rfind(" ") - 1)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def redact_emails(c: Column) -> Column:
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[e-mail]")


def strip_tags(c: Column) -> Column:
    """Markup without scripts, styles and tags; the five XML entities decoded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def short_hash(c: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def major(section: Column) -> Column:
    return F.try_element_at(F.split(section, "/"), F.lit(1)).try_cast("int")


def minor(section: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(section, "/"), F.lit(2)).try_cast("int"), F.lit(0))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def compose_thai(c: Column) -> Column:
    """Nikhahit and sara aa as the one sign they make."""
    return F.replace(c, F.lit("\u0e4d\u0e32"), F.lit("\u0e33"))


def mac_roman_tables() -> tuple[str, str]:
    """Characters that Mac Roman makes of the bytes of Thai letters, and those letters; built from the two codecs."""
    pairs = []
    for b in range(0xA1, 0xFC):
        try:
            pairs.append((bytes([b]).decode("mac_roman"), bytes([b]).decode("cp874")))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def recode_mac_roman(c: Column) -> Column:
    """Thai that was read as Mac Roman; other characters stay."""
    return F.translate(c, *mac_roman_tables())
