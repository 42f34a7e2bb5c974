"""One label per item from several annotators who disagree.

Dawid-Skene: per-annotator confusion matrices and item posteriors by expectation-maximisation with
Dirichlet smoothing; Krippendorff's alpha for nominal data is computed separately from the labels.

Defined cases: null item, annotator or time and codes outside ``codes`` are no codings; repeated
codings count once, the latest (then the highest ``order_id``) stands; an item with one coding gets a
posterior but has no agreement; a tie of posteriors goes to the smaller code; an empty table gives
empty results and a null alpha.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamnan.functions.cluster import BROADCAST_ROWS, columns, cut_lineage

THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
FULLWIDTH = "０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
HALFWIDTH = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def id_key(col):
    """An id as typed, reduced to its letters and digits: width, case, blanks and hyphens don't count."""
    plain = F.translate(F.translate(col, THAI_DIGITS, "0123456789"), FULLWIDTH, HALFWIDTH)
    return F.lower(F.regexp_replace(plain, "[^0-9A-Za-z]", ""))


def standing_codes(codings: DataFrame, codes: list[int]) -> DataFrame:
    """(item, annotator, code): the latest valid coding of each annotator.  Input: item, annotator, code, coded_at, order_id."""
    valid = codings.where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("coded_at").isNotNull() & F.col("code").isin(codes))
    latest = F.max(F.struct("coded_at", "order_id", "code"))
    return valid.groupBy("item", "annotator").agg(latest.alias("m")).select("item", "annotator", F.col("m.code").alias("code"))


def consensus(labels: DataFrame, codes: list[int], groups: DataFrame | None = None, rounds: int = 200, tolerance: float = 1e-7, smoothing: float = 0.3, diagonal: float = 1.0, bound: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """EM over ``labels`` (item, annotator, code); ``groups`` (item, grp) gives items their own class prior.

    Returns posteriors (item, grp, posterior array in the order of ``codes``, n_labels, n_codes) and
    confusions (annotator, truth, code, p).  Rounds end when the log-likelihood gains less than ``tolerance`` of
    itself (``rounds`` is only a guard).

    Items are laid out once, one row each with its (annotator, code) counts, and every round is one scan
    of them against the broadcast confusion matrices and priors.  That holds while annotators and
    groups number at most ``bound`` (counted), which also bounds an item's row; beyond it the same steps are
    joins, where AQE splits a hot annotator.
    """
    index = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("code")).cast("int") - 1
    x = labels.withColumn("c", index)
    x = x.join(groups, "item", "left") if groups is not None else x.withColumn("grp", F.lit(None).cast("string"))
    x = cut_lineage(x.groupBy("item", "annotator", "c").agg(F.count("*").alias("n"), F.first(F.coalesce("grp", F.lit(""))).alias("grp")))
    names = x.select("annotator").distinct().limit(bound + 1).toArrow()["annotator"].to_pylist()
    grps = x.select("grp").distinct().limit(bound + 1).toArrow()["grp"].to_pylist()
    run = _by_scans if len(names) <= bound and len(grps) <= bound else _by_joins
    return run(x, codes, sorted(names), sorted(grps), rounds, tolerance, smoothing, diagonal)


def _log_confusion(counts: np.ndarray, smoothing: float, diagonal: float) -> np.ndarray:
    """log p(code | truth) of [annotator, truth, code] counts."""
    k = counts.shape[1]
    n = counts + smoothing + diagonal * np.eye(k)
    return np.log(n / n.sum(axis=2, keepdims=True))


def _by_scans(x: DataFrame, codes: list[int], names: list, grps: list[str], rounds: int, tolerance: float, smoothing: float, diagonal: float) -> tuple[DataFrame, DataFrame]:
    spark, k = x.sparkSession, len(codes)
    who = spark.createDataFrame(pd.DataFrame({"annotator": names, "a": np.arange(len(names), dtype=np.int32)}), f"annotator {x.schema['annotator'].dataType.simpleString()}, a int")
    items = cut_lineage(
        x.join(F.broadcast(who), "annotator")
        .groupBy("item")
        .agg(F.first("grp").alias("grp"), F.sum("n").alias("n_labels"), F.count_distinct("c").alias("n_codes"), F.collect_list("a").alias("a"), F.collect_list("c").alias("c"), F.collect_list("n").alias("n"))
    )
    place = {g: i for i, g in enumerate(grps)}
    fields = items.select("grp", "a", "c", "n")

    def spread_out(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
        size = b["a"].map(len).to_numpy()
        return np.repeat(np.arange(len(b)), size), *(np.concatenate(b[f].tolist()) if len(b) else np.zeros(0, dtype=np.int64) for f in ("a", "c", "n")), b["grp"].map(place).to_numpy(dtype=np.int64)

    def posterior(row: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray, g: np.ndarray, model) -> tuple[np.ndarray, float]:
        if model is None:  # the first round: shares of the votes
            votes = np.zeros((len(g), k))
            np.add.at(votes, (row, c), n)
            return (votes + 0.1 / k) / (votes.sum(axis=1, keepdims=True) + 0.1), -np.inf
        loglik, prior = model
        score = prior[g].copy()
        np.add.at(score, row, loglik[a, :, c] * n[:, None])
        top = score.max(axis=1, keepdims=True)
        weight = np.exp(score - top)
        total = weight.sum(axis=1, keepdims=True)
        return weight / total, float((top + np.log(total)).sum())

    def statistics(shared):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, sizes, loglik = np.zeros((len(names), k, k)), np.zeros((len(grps), k)), 0.0
            for b in batches:
                if not len(b):
                    continue
                row, a, c, n, g = spread_out(b)
                p, gain = posterior(row, a, c, n, g, shared.value)
                for t in range(k):
                    np.add.at(counts, (a, t, c), p[row, t] * n)
                np.add.at(sizes, g, p)
                loglik += gain
            flat = np.concatenate((counts.reshape(-1), sizes.reshape(-1)))
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"i": np.append(at, -1), "v": np.append(flat[at], loglik)})

        return step

    model, before = None, None
    for _ in range(rounds):
        got = columns(fields.mapInPandas(statistics(spark.sparkContext.broadcast(model)), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")))
        flat, inner = np.zeros(len(names) * k * k + len(grps) * k), got["i"] >= 0
        flat[got["i"][inner]] = got["v"][inner]
        counts, sizes = flat[: len(names) * k * k].reshape(-1, k, k), flat[len(names) * k * k :].reshape(-1, k)
        now = float(got["v"][~inner].sum())
        model = _log_confusion(counts, smoothing, diagonal), np.log((sizes + smoothing) / (sizes.sum(axis=1, keepdims=True) + k * smoothing))
        if before is not None and np.isfinite(before) and abs(now - before) <= tolerance * max(abs(now), 1.0):
            break
        before = now
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, a, c, n, g = spread_out(b)
                yield pd.DataFrame({"item": b["item"], "grp": b["grp"], "n_labels": b["n_labels"], "n_codes": b["n_codes"], "posterior": list(posterior(row, a, c, n, g, shared.value)[0])})

    kind = x.schema["item"].dataType.simpleString()
    post = items.mapInPandas(label, f"item {kind}, grp string, n_labels bigint, n_codes bigint, posterior array<double>")
    rows = [(names[i], codes[t], codes[c], float(p)) for i, by in enumerate(np.exp(model[0])) for t, row in enumerate(by) for c, p in enumerate(row)]
    confusions = spark.createDataFrame(rows, f"annotator {x.schema['annotator'].dataType.simpleString()}, truth int, code int, p double")
    return post, confusions


def _by_joins(x: DataFrame, codes: list[int], names: list, grps: list[str], rounds: int, tolerance: float, smoothing: float, diagonal: float) -> tuple[DataFrame, DataFrame]:
    """The same EM where a table of annotators or groups is too large to broadcast."""
    k = len(codes)
    per_item = x.groupBy("item").agg(F.sum("n").alias("n_labels"), F.count_distinct("c").alias("n_codes"), F.first("grp").alias("grp"), *[F.sum(F.when(F.col("c") == i, F.col("n")).otherwise(0).cast("double")).alias(f"v{i}") for i in range(k)])
    votes = F.array(*[F.col(f"v{i}") for i in range(k)])
    post = cut_lineage(per_item.select("item", "grp", "n_labels", "n_codes", F.transform(votes, lambda v: (v + 0.1 / k) / (F.col("n_labels") + 0.1)).alias("posterior")))
    before = None
    while True:
        soft = x.select("item", "annotator", "c", "n").join(post.select("item", "posterior"), "item")
        counts = soft.groupBy("annotator", "c").agg(*[F.sum(F.col("posterior")[t] * F.col("n")).alias(f"s{t}") for t in range(k)])
        wide = counts.groupBy("annotator").agg(*[F.sum(F.when(F.col("c") == i, F.col(f"s{t}")).otherwise(0.0)).alias(f"n_{t}_{i}") for t in range(k) for i in range(k)])
        pseudo = lambda t, i: smoothing + (diagonal if t == i else 0.0)
        rows = [
            F.array(*[F.log((F.col(f"n_{t}_{i}") + pseudo(t, i)) / (sum(F.col(f"n_{t}_{j}") for j in range(k)) + sum(pseudo(t, j) for j in range(k)))) for t in range(k)]).alias(f"l{i}")
            for i in range(k)
        ]
        confusion = cut_lineage(wide.select("annotator", F.array(*rows).alias("loglik")))
        prior = post.groupBy("grp").agg(F.array(*[F.log((F.sum(F.col("posterior")[t]) + smoothing) / (F.count("*") + k * smoothing)) for t in range(k)]).alias("logprior"))
        lik = x.join(confusion, "annotator").select("item", F.transform(F.col("loglik")[F.col("c")], lambda v: v * F.col("n")).alias("l"))
        summed = lik.groupBy("item").agg(*[F.sum(F.col("l")[t]).alias(f"s{t}") for t in range(k)])
        joined = post.select("item", "grp", "n_labels", "n_codes").join(summed, "item").join(prior, "grp")
        score = F.array(*[F.col(f"s{t}") + F.col("logprior")[t] for t in range(k)])
        shifted = F.transform(score, lambda s: F.exp(s - F.array_max(score)))
        total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
        scored = cut_lineage(joined.select("item", "grp", "n_labels", "n_codes", F.transform(shifted, lambda s: s / total).alias("posterior"), (F.array_max(score) + F.log(total)).alias("gain")))
        post = scored.drop("gain")
        now = scored.agg(F.sum("gain")).first()[0] or 0.0
        rounds -= 1
        if rounds <= 0 or before is not None and abs(now - before) <= tolerance * max(abs(now), 1.0):
            break
        before = now
    flat = confusion.select("annotator", F.posexplode("loglik").alias("i", "by_truth")).select("annotator", "i", F.posexplode("by_truth").alias("t", "l"))
    lookup = F.array(*[F.lit(c) for c in codes])
    return post, flat.select("annotator", lookup[F.col("t")].alias("truth"), lookup[F.col("i")].alias("code"), F.exp("l").alias("p"))


def best_code(posterior, codes: list[int]):
    lookup = F.array(*[F.lit(c) for c in codes])
    return lookup[F.array_position(posterior, F.array_max(posterior)).cast("int") - 1]


def krippendorff_alpha(labels: DataFrame) -> DataFrame:
    """One row (n_items, n_labels, observed, expected, alpha) for nominal codes; items with one label don't count."""
    per = labels.groupBy("item", "code").agg(F.count("*").alias("n"))
    item = per.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m > 1")
    total = item.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_labels"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("disagree"))
    marginal = per.join(item.select("item"), "item", "left_semi").groupBy("code").agg(F.sum("n").alias("nc")).agg(F.sum(F.col("nc") * F.col("nc")).alias("sq"))
    observed = F.col("disagree") / F.col("n_labels")
    expected = (F.col("n_labels") * F.col("n_labels") - F.col("sq")) / (F.col("n_labels") * (F.col("n_labels") - 1))
    one = F.lit(1).alias("one")
    return total.select("*", one).join(marginal.select("*", one), "one").select("n_items", "n_labels", observed.alias("observed"), expected.alias("expected"), (1 - F.try_divide(observed, expected)).alias("alpha"))


def reliability(confusions: DataFrame, labels: DataFrame, posteriors: DataFrame, codes: list[int]) -> DataFrame:
    """(annotator, n_labels, accuracy, information): expected accuracy against the posteriors, and the
    mutual information in bits between truth and code under a uniform truth (0 for a constant coder)."""
    k = len(codes)
    position = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("code")).cast("int") - 1
    hits = labels.join(posteriors.select("item", "posterior"), "item").groupBy("annotator").agg(F.count("*").alias("n_labels"), F.avg(F.col("posterior")[position]).alias("accuracy"))
    w = Window.partitionBy("annotator", "code")
    info = confusions.withColumn("m", F.sum("p").over(w) / k).groupBy("annotator").agg((F.sum(F.col("p") / k * F.log(F.col("p") / F.col("m"))) / math.log(2)).alias("information"))
    return hits.join(info, "annotator")
