"""Quality classifier: document evidence and site posteriors, in two heads.

*Document evidence.*  Two logistic models, for low quality and for toxicity, over
measures of a text's form and over how many words of a learned list it holds.
They are fitted on at most ``SAMPLE`` labelled rows (those of least hash).  Words and
their beginnings are listed if they speak for a class; for the weights, each half of
the sample is measured with the list that the other half gives.

*Sites.*  Every document counts for its host and, below that, its path, with its
label where it has one and its document evidence elsewhere.  Rates are shrunk in
two steps: a path toward its host, a host toward all documents, by a strength that
the method of moments takes from how much sites differ beyond chance.  So sparse
sites keep the prior and rich ones their own rate.  The posterior log odds of a
document are its own, moved by how far its path's rate is from the overall one.

Defined results: null and empty texts have the evidence of the empty text; null
hosts and paths are a site of their own; without labels, or with labels of one kind,
a head's evidence is that share for all; labels given twice count as their maximum.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import saved

#: Labelled rows that the document models are fitted on, at most.
SAMPLE = 16_000
#: A listed word is in this many sampled texts of the class, at least, and this
#: many times as likely there as elsewhere; so many words are listed, at most.
IN_TEXTS, TIMES, LISTED = 3, 16.0, 4_000
#: Letters of a word's beginning, which is listed like a word.
START = 4
HEADS = ("low", "toxic")
LIMIT = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_EVIDENCE = "low double, toxic double"


def form(text: str | None, lists: list[frozenset[str]]) -> list[float]:
    """Measures of a text: its length, letters, marks, repetition, listed words."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = text.split()
    n, size = max(1, len(words)), max(1, int(raw.sum()))
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum() + raw[192:].sum()))
    lines = [x for x in text.split("\n") if x]
    found = set(_WORD.findall(text.lower()))
    found |= {w[:START] + "*" for w in found}
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    return [
        np.log1p(len(words)), raw[65:91].sum() / letters, marks / size, raw[48:58].sum() / size,
        raw[ord("|")] / n, raw[ord("!")] / n, (raw[ord("#")] + raw[ord("$")] + raw[ord("%")] + raw[ord("&")]
                                               + raw[ord("*")]) / n,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(text) / n / 10,
        len(set(lines)) / max(1, len(lines)), float(not words),
        *(min(4.0, float(len(found & listed))) for listed in lists)]


class Head:
    """A logistic model over standardised measures; a constant without both classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.share = float(y.mean()) if len(y) else 0.0
        self.weights = None
        if 0 < self.share < 1:
            self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
            z = self._scaled(x)
            w = np.zeros(z.shape[1])
            keep = np.full(z.shape[1], ridge)
            keep[-1] = 1e-3
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(keep), z.T @ (y - p) - keep * w)
                w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
                if np.abs(step).max() < 1e-6:
                    break
            self.weights = w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._scaled(x) @ self.weights, -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, low, toxic, half) of the sample."""
    chosen = _per_document(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", *HEADS, F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))


def _per_document(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("double"))).alias("low"),
        F.max(F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1).cast("double"))).alias("toxic")
    ).na.fill(0.0, list(HEADS))


def _spoken(sample: DataFrame) -> DataFrame:
    """(word, and for each half the texts and the texts of each class with it)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    both = F.array_union(words, F.transform(words, lambda w: F.concat(F.substr(w, F.lit(1), F.lit(START)), F.lit("*"))))
    rows = sample.select(*HEADS, "half", F.explode(both).alias("word"))
    sums = [F.sum(F.when(F.col("half") == i, what).otherwise(0.0)).alias(f"{name}{i}")
            for i in (0, 1) for name, what in (("n", F.lit(1.0)), *((h, F.col(h)) for h in HEADS))]
    return rows.groupBy("word").agg(*sums).where(F.col("n0") + F.col("n1") >= IN_TEXTS)


def _listed(spoken: DataFrame, totals: dict, head: str, halves: tuple[int, ...]) -> frozenset[str]:
    """Words that speak for the class in the given halves of the sample."""
    p = sum(F.col(f"{head}{i}") for i in halves)
    q = sum(F.col(f"n{i}") for i in halves) - p
    of_p = sum(totals[f"{head}{i}"] for i in halves)
    of_q = sum(totals[f"n{i}"] for i in halves) - of_p
    if not of_p or not of_q:
        return frozenset()
    odds = (p / of_p) / ((q + 0.5) / of_q)
    top = spoken.where((p >= IN_TEXTS) & (odds >= TIMES)).orderBy(odds.desc(), "word").limit(LISTED)
    return frozenset(r["word"] for r in top.select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Callable[[list], np.ndarray]:
    """The document models, as a function from texts to a column for each head."""
    rows = saved(_labelled(docs, labels, sample))
    spoken = saved(_spoken(rows))
    totals = {k: float(v or 0) for k, v in rows.agg(*[
        F.sum(F.when(F.col("half") == i, what).otherwise(0.0)).alias(f"{name}{i}")
        for i in (0, 1) for name, what in (("n", F.lit(1.0)), *((h, F.col(h)) for h in HEADS))]).first().asDict().items()}
    other, lists = {}, [_listed(spoken, totals, h, (0, 1)) for h in HEADS]
    for half in (0, 1):
        other[half] = [_listed(spoken, totals, h, (1 - half,)) for h in HEADS]
    width = len(form("", lists))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series, halves: pd.Series) -> pd.Series:
        return pd.Series([form(t, other[int(h)]) for t, h in zip(texts, halves, strict=True)])

    seen = rows.select(measured("text", "half").alias("x"), *HEADS).toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(-1, width)
    heads = [Head(x, seen[h].to_numpy(float)) for h in HEADS]

    def score(texts: list) -> np.ndarray:
        x = np.array([form(t, lists) for t in texts], float).reshape(-1, width)
        return np.stack([h(x) for h in heads], axis=1)

    return score


def document_evidence(docs: DataFrame, labels: DataFrame, host: Column, path: Column,
                      sample: int = SAMPLE) -> DataFrame:
    """(doc_id, copy, host, path, low, toxic): one pass over the texts."""
    score = fit(docs, labels, sample)

    @F.pandas_udf(_EVIDENCE)
    def evidence(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(score(list(texts)), columns=list(HEADS))

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), F.coalesce(host, F.lit("")).alias("host"),
                       F.coalesce(path, F.lit("")).alias("path"), evidence("text").alias("e")).select(
        "doc_id", "copy", "host", "path", "e.low", "e.toxic")


def _strength(sites: DataFrame, rate: Column, prior: Column) -> Column:
    """Prior documents a site's rate is worth: by the method of moments, from the
    sites' spread about their prior beyond binomial chance."""
    noise = F.sum(prior * (1 - prior))
    spread = F.sum(F.col("n") * (rate - prior) ** 2) - noise
    between = spread / F.sum("n")
    within = F.sum(F.col("n") * prior * (1 - prior)) / F.sum("n")
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.when(between > 0, within / between).otherwise(1e6)))


def site_posteriors(scored: DataFrame, head: str) -> DataFrame:
    """(host, path, site_<head>, all_<head>): the shrunk rate of every path."""
    value = F.coalesce(F.col(f"label_{head}"), F.col(head))
    paths = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(value).alias("bad")))
    total = paths.agg((F.sum("bad") / F.sum("n")).alias("r")).first()["r"]
    overall = F.lit(min(1 - 1e-6, max(1e-6, float(total or 0.0))))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate = F.col("bad") / F.col("n")
    k = float(hosts.agg(_strength(hosts, rate, overall).alias("k")).first()["k"] or 1.0)
    hosts = hosts.select("host", ((F.col("bad") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    both = saved(paths.join(hosts, "host"))
    k = float(both.agg(_strength(both, rate, F.col("host_rate")).alias("k")).first()["k"] or 1.0)
    return both.select("host", "path", ((F.col("bad") + k * F.col("host_rate")) / (F.col("n") + k)).alias(f"site_{head}"),
                       overall.alias(f"all_{head}"))


def _log_odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
             sample: int = SAMPLE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, copy, host, path, evidence_<head>, site_<head>, p_<head>, keep)
    for every row of ``docs``; ``copy`` hashes the text.  ``host`` and ``path`` name
    columns; the defaults stand in where there is no URL (languages of a source)."""
    scored = saved(document_evidence(docs, labels, F.col(host).cast("string"), F.col(path).cast("string"), sample))
    given = _per_document(labels).select("doc_id", *[F.col(h).alias(f"label_{h}") for h in HEADS])
    scored = saved(scored.join(given, "doc_id", "left"))
    out = scored
    for head in HEADS:
        out = out.join(site_posteriors(scored, head), ["host", "path"])
        moved = _log_odds(F.col(head)) + _log_odds(F.col(f"site_{head}")) - _log_odds(F.col(f"all_{head}"))
        out = out.withColumn(f"p_{head}", 1 / (1 + F.exp(-moved)))
    keep = (F.col("p_low") < limit) & (F.col("p_toxic") < limit)
    return out.select("doc_id", "copy", "host", "path", F.col("low").alias("evidence_low"),
                      F.col("toxic").alias("evidence_toxic"), "site_low", "site_toxic", "p_low", "p_toxic",
                      keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    bad = classify(docs, labels).where("not keep").select(
        F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["_copy"])
    return docs.join(bad, same, "left_anti")
