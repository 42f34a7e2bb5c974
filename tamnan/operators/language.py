"""Dictionary segmentation, pluggable models, and rewriting of text that built-ins can't express."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEADING = "เแโใไ"
_FOLLOWING = "ะัาำิีึืฺุูๅ็่้๊๋์ํ๎"


def clusters(text: str) -> list[int]:
    """Offsets at which a Thai word may begin: never before a mark or following vowel, nor after a leading vowel."""
    return [i for i, c in enumerate(text) if not i or c not in _FOLLOWING and text[i - 1] not in _LEADING] + [len(text)]


def segment(text: str, words: frozenset[str], longest: int | None = None) -> list[str]:
    """Fewest-words segmentation over a dictionary; what isn't in it is kept as unknown runs; numbers and Latin words stay whole.

    A shortest path over cluster offsets: a dictionary word costs 1, an unknown cluster 3, so known words
    win and unknown neighbours are joined afterwards.
    """
    longest = longest or max(map(len, words), default=1)
    out: list[str] = []
    for part in re.findall(r"[฀-๿]+|[^\W฀-๿]+(?:[.,:]\d+)*|\s+|[^\w\s]+", text):
        if not "฀" <= part[0] <= "๿":
            out.append(part)
            continue
        at = clusters(part)
        best: dict[int, tuple[int, int, bool]] = {0: (0, -1, True)}
        for k, i in enumerate(at[:-1]):
            if i not in best:
                continue
            cost = best[i][0]
            for j in at[k + 1 :]:
                if j - i > longest:
                    break
                if part[i:j] in words and (j not in best or cost + 1 < best[j][0]):
                    best[j] = (cost + 1, i, True)
            j = at[k + 1]
            if j not in best or cost + 3 < best[j][0]:
                best[j] = (cost + 3, i, False)
        pieces, j = [], len(part)
        while j > 0:
            _, i, known = best[j]
            pieces.append((part[i:j], known))
            j = i
        run = ""
        for piece, known in reversed(pieces):
            if known:
                out += [run, piece] if run else [piece]
                run = ""
            else:
                run += piece
        if run:
            out.append(run)
    return out


def segmented(rows: DataFrame, key: str, text: str, words: frozenset[str], blanks: bool = False) -> DataFrame:
    """(key, words) by :func:`segment`; the dictionary is shipped once to each worker."""
    own = rows.sparkSession.sparkContext.broadcast((words, max(map(len, words), default=1)))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, n = own.value
        for b in batches:
            cut = [None if t is None else [w for w in segment(t, d, n) if blanks or w.strip()] for t in b["t"].tolist()]
            yield pd.DataFrame({key: b["k"], "words": cut})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, words array<string>")


def rewritten(rows: DataFrame, key: str, text: str, f: Callable[[str], str]) -> DataFrame:
    """(key, text) with ``f`` applied in Arrow batches; null stays null."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["k"], text: [None if t is None else f(t) for t in b["t"].tolist()]})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, {text} string")


def embedded(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], size: int) -> DataFrame:
    """(key, embedding) from any batch encoder, normalised to unit length; an empty vector stays null."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in encode([t or "" for t in b["t"].tolist()]):
                norm = sum(x * x for x in v) ** 0.5
                out.append([x / norm for x in v] if norm and len(v) == size else None)
            yield pd.DataFrame({key: b["k"], "embedding": out})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def hashed_encoder(size: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model: signed hashing of character trigrams."""

    def encode(texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * size
            for i in range(max(0, len(t) - 2)):
                h = zlib.crc32(t[i : i + 3].encode())
                v[h % size] += 1.0 if h & (1 << 31) else -1.0
            out.append(v)
        return out

    return encode


def reranked(hits: DataFrame, score: Callable[[list[str], list[str]], list[float]], keep: int = 12, cut: int = 900) -> DataFrame:
    """Hits (qid, doc_id, pos, question, text) ordered anew by a pluggable scorer: the first ``keep`` are scored on
    texts cut at ``cut`` characters, the rest and those without a score keep their order behind them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = score(b["question"].tolist(), [(t or "")[:cut] for t in b["text"].tolist()])
            yield pd.DataFrame({"qid": b["qid"], "doc_id": b["doc_id"], "rr": pd.array(scores, dtype="Float64")})

    from pyspark.sql import Window

    scored = hits.where(F.col("pos") <= keep).select("qid", "doc_id", "question", "text").mapInPandas(run, "qid bigint, doc_id bigint, rr double")
    w = Window.partitionBy("qid").orderBy(F.col("rr").desc_nulls_last(), "pos", "doc_id")
    return hits.join(scored, ["qid", "doc_id"], "left").withColumn("reranked", F.row_number().over(w)).select("qid", "doc_id", "pos", "reranked")


def resolve_pointers(text: str, sources: list[str]) -> str:
    """``[n]`` becomes the n-th source, once in a row; a pointer out of range is deleted."""

    def one(m: re.Match) -> str:
        found = dict.fromkeys(sources[int(n) - 1] for n in re.findall(r"\d+", m.group(0)) if 0 < int(n) <= len(sources))
        return f" ({'; '.join(found)})" if found else ""

    return re.sub(r"[ ]+([.,;])", r"\1", re.sub(r"\s*(?:\[\d+\]\s*)+", lambda m: one(m) + (" " if m.group(0)[-1:] == " " else ""), text)).strip()


def tidy_markdown(text: str) -> str:
    """Headings and emphasis to plain text, bullets to one sign, blank lines to one."""
    text = re.sub(r"^#{1,6}\s*", "", text, flags=re.M)
    text = re.sub(r"(\*\*|__)(.+?)\1", r"\2", text)
    text = re.sub(r"^\s*[*+]\s+", "- ", text, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def unglue(line: str, headings: list[str]) -> tuple[str, str | None]:
    """(paragraph, heading) of a line that ends in a heading stuck to it; the longest heading wins."""
    for h in sorted(headings, key=len, reverse=True):
        if line.endswith(h) and len(line) > len(h):
            return line[: -len(h)].rstrip(), h
    return line, None


def soft_breaks(text: str, words: frozenset[str]) -> str:
    """Zero-width breaks between the Thai words of a text."""
    out = segment(text, words)
    return "".join(w + ("​" if i + 1 < len(out) and "฀" <= w[-1] <= "๿" <= "๿" and "฀" <= out[i + 1][0] <= "๿" else "") for i, w in enumerate(out))


def merge_runs(pages: list[int]) -> str:
    """Page numbers as runs: 1-3, 7."""
    out: list[list[int]] = []
    for p in sorted(set(pages)):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return ", ".join(f"{a}" if a == b else f"{a}-{b}" for a, b in out)


def modal_mismatches(claim: str, rule: str) -> bool:
    """Whether a claim says must where the rule says should, or the reverse."""
    must, should = re.compile("ต้อง|must", re.I), re.compile("ควร|พึง|should", re.I)
    return bool(must.search(claim) and should.search(rule) and not must.search(rule) or should.search(claim) and must.search(rule) and not should.search(rule))


def corrected_modal(claim: str, rule: str) -> str:
    """The claim with its modal word taken from the rule, changed from right to left."""
    if not modal_mismatches(claim, rule):
        return claim
    to_should = bool(re.search("ควร|พึง|should", rule, re.I))
    pairs = [("ต้อง", "พึง"), ("must", "should")] if to_should else [("พึง", "ต้อง"), ("ควร", "ต้อง"), ("should", "must")]
    for a, b in pairs:
        for m in reversed(list(re.finditer(a, claim))):
            claim = claim[: m.start()] + b + claim[m.end() :]
    return claim


def added_negations(claim: str, source: str, stem: int = 10) -> list[str]:
    """What a claim negates though its source has it without a negation."""
    out = []
    for m in re.finditer(r"(?:ไม่|มิ|ห้าม)(?!ว่า)([ก-๎]{4,})", claim):
        key = m.group(1)[:stem]
        if key in source and not re.search(r"(?:ไม่|มิ|ห้าม)[ก-๎]{0,3}" + re.escape(key), source):
            out.append(key)
    return out


def applied(rows: DataFrame, key: str, columns: list[str], f: Callable, kind: str, name: str) -> DataFrame:
    """(key, ``name``) with ``f`` of several columns, in Arrow batches; a row with a null among them gives null."""
    key_kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [None if any(x is None for x in row) else f(*row) for row in zip(*(b[c].tolist() for c in columns))]
            yield pd.DataFrame({key: b[key], name: pd.Series(out, dtype=object)})

    return rows.select(key, *columns).mapInPandas(run, f"{key} {key_kind}, {name} {kind}")
