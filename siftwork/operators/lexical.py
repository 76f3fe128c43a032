"""Keyword retrieval: conjunctive phrases, BM25 over captions, term figures.

Every function takes many queries at once: ``queries`` is ``(query_id, text)``.
The unit that is matched and scored is the caption; a sample takes its best
caption.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.functions.porter import stem_column
from siftwork.functions.porter import stemmed as stem_tokens
from siftwork.operators import phrase_index as px
from siftwork.session import reliable_checkpoint, spread

# BM25 parameters, the floor of a term weight, and the share of
# samples from which a term counts as common.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
COMMON_FRACTION = 0.20

# Query tokens are broadcast to the captions up to this many bytes.  Larger sets of queries
# take several passes over the captions; beyond ``PASSES``, both sides are shuffled by token.
HELD_BYTES = 32 << 20
PASSES = 64
# What a task holds of a query's term: numbers only, the phrases themselves once.
_TERM_BYTES = 32
# At most so many words count as common, whose figures every task holds.
COMMON_WORDS = 100_000
# What a broadcast row takes beside its strings.
_ROW_BYTES = 64


def query_phrases(queries: DataFrame, stem: bool = False) -> DataFrame:
    """``query_id, phrase, times``: the phrases each query insists on.

    A phrase is the token list of one query word; a word the tokenizer splits
    must match as adjacent tokens.
    """
    words = queries.select(
        "query_id", F.posexplode(tx.match_terms(F.col("text"))).alias("term_no", "word"))
    parts = words.select(
        "query_id", "term_no", F.posexplode(tx.index_tokens(F.col("word"))).alias("off", "token"))
    if stem:
        parts = stem_tokens(parts)
    phrases = parts.groupBy("query_id", "term_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("off", "token"))),
                    lambda s: s["token"]).alias("tokens"))
    return phrases.groupBy("query_id", F.array_join("tokens", " ").alias("phrase")).agg(
        F.count(F.lit(1)).alias("times"))


def surface_forms(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with each stem replaced by the corpus words that have it.

    Only distinct words are shuffled and stemmed, and only those asked for stay,
    so the postings are filtered by surface form, before any of them moves."""
    vocabulary = tokens.select(F.explode("tokens").alias("form")).distinct()
    forms = vocabulary.withColumn("token", stem_column("form")).join(
        wanted.select("token").distinct(), "token")
    return wanted.join(forms, "token").select("phrase", "width", "off", F.col("form").alias("token"))


def phrase_hits(captions: DataFrame, phrases: DataFrame, stem: bool = False) -> DataFrame:
    """``phrase, caption_id, sample_id, length, tf`` for each distinct phrase.

    The captions stream past the phrase tokens once; only matching positions
    move, partitioned by caption, and both counts then run without another
    exchange.
    """
    distinct = phrases.select("phrase").distinct()
    wanted = distinct.select(
        "phrase", F.size(F.split("phrase", " ")).alias("width"),
        F.posexplode(F.split("phrase", " ")).alias("off", "token"))
    tokens = spread(captions.select("id", "sample_id", "text")).select(
        F.col("id").alias("caption_id"), "sample_id",
        tx.index_tokens(F.col("text")).alias("tokens"))
    if stem:
        wanted = reliable_checkpoint(surface_forms(tokens, wanted))
    postings = tokens.select(
        "caption_id", "sample_id", F.size("tokens").alias("length"),
        F.posexplode("tokens").alias("pos", "token"))
    held = wanted.agg(F.sum(F.octet_length("phrase") + F.octet_length("token") + _ROW_BYTES)).first()[0] or 0
    if held <= HELD_BYTES:
        wanted = F.broadcast(wanted)
    # A one-token phrase needs no start: its rows are its occurrences.
    start = F.when(F.col("width") > 1, F.col("pos") - F.col("off")).otherwise(F.lit(-1))
    found = (
        postings.join(wanted, "token")
        .select("phrase", "caption_id", "sample_id", "length", "width", start.alias("start"))
        .repartition("caption_id"))
    starts = found.groupBy("caption_id", "phrase", "sample_id", "length", "start").agg(
        F.count(F.lit(1)).alias("k"), F.max("width").alias("width"))
    times = F.when(F.col("width") > 1, F.lit(1)).otherwise(F.col("k"))
    return (
        starts.where((F.col("width") == 1) | (F.col("k") == F.col("width")))
        .groupBy("caption_id", "phrase", "sample_id", "length")
        .agg(F.sum(times).alias("tf")))


def conjunctive_matches(
    queries: DataFrame, phrases: DataFrame, hits: DataFrame, exclude: DataFrame | None = None
) -> DataFrame:
    """Captions holding every phrase of a query, one row per phrase.

    Each query starts from its rarest phrase and looks the others up only in
    the captions that one named, so a common word never multiplies by the
    number of queries that use it.  ``exclude`` is ``(query_id, caption_id)``:
    rows a query may not retrieve, such as the caption it was taken from.
    """
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    terms = phrases.join(df, "phrase", "left")
    per_query = terms.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.count("df").alias("n_known"),
        F.min_by("phrase", F.struct("df", "phrase")).alias("anchor"))
    per_query = per_query.where(F.col("n_terms") == F.col("n_known")).select(
        "query_id", "n_terms", F.col("anchor").alias("phrase"))
    candidates = per_query.join(hits.select("phrase", "caption_id"), "phrase").select(
        "query_id", "caption_id", "n_terms")
    if exclude is not None:
        candidates = candidates.join(exclude, ["query_id", "caption_id"], "left_anti")
    asked = candidates.join(terms.select("query_id", "phrase", "times", "df"), "query_id")
    return asked.join(hits, ["phrase", "caption_id"])


def bm25_captions(
    captions: DataFrame, queries: DataFrame, *, stem: bool = False,
    exclude: DataFrame | None = None, allowed: DataFrame | None = None,
) -> DataFrame:
    """``query_id, caption_id, sample_id, score``: captions matching the whole
    conjunction, higher is better.  ``allowed`` (sample ids) restricts the
    candidates inside the ranking; weights stay those of the whole corpus.

    Queries of the same phrases are one.  While their phrases can be held, captions
    stream past them and nothing but matches leaves a task; beyond, the hits are
    shuffled and written out once."""
    phrases = reliable_checkpoint(query_phrases(queries, stem))
    asked = _asked(captions, phrases, stem)
    if asked is None:
        return _bm25_by_hits(captions, queries, phrases, stem, exclude, allowed)
    got = asked.to_queries(asked.matches(allowed=allowed), "caption_id", "sample_id", "score")
    return got if exclude is None else got.join(exclude, ["query_id", "caption_id"], "left_anti")


def _small(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """Broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() * row_bytes <= HELD_BYTES else df


def _bm25_by_hits(captions, queries, phrases, stem, exclude, allowed) -> DataFrame:
    hits = reliable_checkpoint(phrase_hits(captions, phrases, stem))
    lengths = spread(captions.select("text")).agg(
        F.struct(F.count(F.lit(1)).alias("n"),
                 F.avg(F.size(tx.index_tokens(F.col("text")))).alias("mean")).alias("s"))
    matched = conjunctive_matches(queries, phrases, hits, exclude).withColumn("_s", lengths.scalar())
    return scored(matched, F.col("_s.n"), F.col("_s.mean"), allowed)


@dataclass(frozen=True)
class _Asked:
    """Distinct conjunctions: ``members`` (query_id, query); ``terms`` (query, phrase, df, gain), dealt over
    ``passes`` by their query; ``forms``, the words of each stem; the captions as token lists."""

    members: DataFrame
    terms: DataFrame
    passes: int
    forms: list | None
    tokens: DataFrame
    mean: float

    def matches(self, depth: int | None = None, allowed: DataFrame | None = None, named: bool = False) -> DataFrame:
        """``query, caption_id, sample_id, score``, of allowed samples.  With ``depth``, captions that
        cannot bring their sample among the first ``depth`` of a query may be left out; so may, if only
        samples are to be ``named``, further captions of a sample."""
        out, tokens = None, self.tokens
        if allowed is not None:
            tokens = tokens.join(_small(allowed.select(F.col("id").alias("sample_id"))), "sample_id", "left_semi")
            tokens = tokens.select("caption_id", "sample_id", "tokens")
        for k in range(self.passes):
            part = self.terms.where(F.pmod(F.xxhash64("query"), F.lit(self.passes)) == k)
            asked = px.Asked.of(part.select("query", "phrase", "df", "gain").toArrow(), self.forms)
            rows = _streamed(tokens, asked, self.mean, depth, named)
            out = rows if out is None else out.unionByName(rows)
        return out

    def to_queries(self, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(_small(self.members), "query").select("query_id", *columns)


def _token_lists(captions: DataFrame) -> DataFrame:
    return spread(captions.select("id", "sample_id", "text")).select(
        F.col("id").alias("caption_id"), "sample_id", tx.index_tokens(F.col("text")).alias("tokens"))


def _held_bytes(phrases: DataFrame) -> int:
    return phrases.agg(F.sum(F.octet_length("phrase") + _ROW_BYTES)).first()[0] or 0


def _passes(terms: DataFrame, phrases: DataFrame) -> int:
    """Passes over the captions for these terms, whose distinct phrases a pass holds once at most."""
    return max(1, -(-(_held_bytes(phrases) + _TERM_BYTES * terms.count()) // HELD_BYTES))


def _stem_forms(tokens: DataFrame, phrases: DataFrame) -> list | None:
    """(word, stem) of the corpus words that have an asked stem; None if they are too many to hold."""
    wanted = phrases.select(F.explode(F.split("phrase", " ")).alias("token")).distinct()
    words = tokens.select(F.explode("tokens").alias("form")).distinct()
    forms = reliable_checkpoint(words.withColumn("token", stem_column("form")).join(wanted, "token"))
    size = forms.agg(F.sum(F.octet_length("form") + F.octet_length("token") + _ROW_BYTES)).first()[0] or 0
    if size > HELD_BYTES:
        return None
    return [(r["form"], r["token"]) for r in forms.collect()]  # bounded just above


def _asked(captions: DataFrame, phrases: DataFrame, stem: bool) -> _Asked | None:
    """None if the phrases would take too many passes."""
    listed = phrases.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("phrase", "times"))).alias("terms"))
    listed = reliable_checkpoint(listed)
    whole = reliable_checkpoint(listed.groupBy("terms").agg(F.min("query_id").alias("query")))
    terms = reliable_checkpoint(whole.select("query", F.explode("terms").alias("t")).select("query", "t.*"))
    distinct = terms.select("phrase").distinct()
    passes = _passes(terms, distinct)
    tokens = _token_lists(captions)
    if passes > PASSES:
        return None
    forms = _stem_forms(tokens, distinct) if stem else None
    if stem and forms is None:
        return None
    counts = phrase_counts(tokens, distinct, forms)
    figures = counts.where("phrase IS NULL").first()
    df = counts.where("phrase IS NOT NULL").select("phrase", F.col("n").alias("df"))
    known = terms.join(df, "phrase", "left").withColumn(
        "all", F.min(F.col("df").isNotNull()).over(Window.partitionBy("query"))).where("all")
    known = reliable_checkpoint(known.select("query", "phrase", "df", (
        F.col("times") * weight(F.lit(figures["n"]), F.col("df"))).alias("gain")))
    members = reliable_checkpoint(listed.join(whole, "terms").join(known.select("query").distinct(), "query", "left_semi")
                                  .select("query_id", "query"))
    mean = figures["tokens"] / figures["known"] if figures["known"] else 0.0
    return _Asked(members, known, passes, forms, tokens, mean)


def phrase_counts(tokens: DataFrame, phrases: DataFrame, forms: list | None = None) -> DataFrame:
    """``phrase, n, known, tokens``, written: captions that hold each phrase; and a row without phrase for
    all captions, those with a text, and their tokens.  A task adds up what it has seen."""
    passes = max(1, -(-_held_bytes(phrases) // HELD_BYTES))
    schema, out = "phrase string, n long, known long, tokens long", None
    for k in range(passes):
        part = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k)
        names = part.select("phrase").toArrow()["phrase"].combine_chunks()
        handle = tokens.sparkSession.sparkContext.broadcast((px.Trie.of(names.to_pylist(), forms), names))

        def count(batches: Iterator[pa.RecordBatch], handle=handle, first=k == 0) -> Iterator[pa.RecordBatch]:
            trie, names = handle.value
            seen, all_ = np.zeros(trie.phrases, np.int64), np.zeros(3, np.int64)
            for batch in batches:
                for piece, lengths in px.slices(batch):
                    _, phrase, _ = trie.found(piece["tokens"], lengths)
                    seen += np.bincount(phrase, minlength=trie.phrases)
                    all_ += len(piece), len(piece) - piece["tokens"].null_count, lengths.sum()
            at = np.flatnonzero(seen)
            none = np.zeros(len(at), np.int64)
            yield pa.record_batch({"phrase": names.take(pa.array(at)), "n": seen[at], "known": none, "tokens": none})
            if first:
                yield pa.record_batch({"phrase": pa.nulls(1, pa.string()), **dict(zip(
                    ("n", "known", "tokens"), all_.reshape(3, 1), strict=True))})

        rows = tokens.select("tokens").mapInArrow(count, schema)
        out = rows if out is None else out.unionByName(rows)
    return reliable_checkpoint(out.groupBy("phrase").agg(*[F.sum(c).alias(c) for c in ("n", "known", "tokens")]))


def holders(captions: DataFrame, asked: DataFrame, stem: bool = False) -> DataFrame:
    """``phrase, sample_id`` of the samples that hold each phrase, with repeats: a task names a pair once a batch.
    No posting moves, only such pairs; phrases that would take too many passes go by ``phrase_hits``."""
    distinct = reliable_checkpoint(asked.where(F.col("phrase") != "").select("phrase").distinct())
    passes, tokens = max(1, -(-_held_bytes(distinct) // HELD_BYTES)), _token_lists(captions)
    forms = _stem_forms(tokens, distinct) if stem and passes <= PASSES else None
    if passes > PASSES or stem and forms is None:
        return phrase_hits(captions, asked, stem).select("phrase", "sample_id")
    out, sample = None, tokens.schema["sample_id"].dataType.simpleString()
    for k in range(passes):
        part = distinct.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k)
        names = part.toArrow()["phrase"].combine_chunks()
        handle = tokens.sparkSession.sparkContext.broadcast((px.Trie.of(names.to_pylist(), forms), names))

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            trie, names = handle.value
            for batch in batches:
                for piece, lengths in px.slices(batch):
                    row, phrase, _ = trie.found(piece["tokens"], lengths)
                    code = piece["sample_id"].dictionary_encode(null_encoding="encode")
                    at = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    pairs = np.unique(at[row] * max(1, trie.phrases) + phrase)
                    yield pa.record_batch({"phrase": names.take(pa.array(pairs % max(1, trie.phrases))),
                                           "sample_id": code.dictionary.take(pa.array(pairs // max(1, trie.phrases)))})

        rows = tokens.select("sample_id", "tokens").mapInArrow(run, f"phrase string, sample_id {sample}")
        out = rows if out is None else out.unionByName(rows)
    return out


def _streamed(tokens: DataFrame, asked: px.Asked, mean: float, depth: int | None, named: bool = False) -> DataFrame:
    handle = tokens.sparkSession.sparkContext.broadcast(asked)
    caption, sample = (tokens.schema[c].dataType.simpleString() for c in ("caption_id", "sample_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = handle.value
        best = px.Best(depth) if depth is not None else None

        def rows(kept: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for query, s, c, score in kept:
                yield pa.record_batch({"query": a.queries[query], "caption_id": c, "sample_id": s, "score": score})

        for batch in batches:
            for piece, lengths in px.slices(batch):
                ids, samples = piece["caption_id"], piece["sample_id"]
                cut = best is not None and not ids.null_count and not samples.null_count
                for row, query, score in a.met(piece["tokens"], lengths, lambda tf, n: saturation(tf, n, mean)):
                    if named:  # sorted by query and sample, the first of each
                        code = samples.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                        first = np.unique(query * len(samples) + code[row], return_index=True)[1]
                        row, query, score = row[first], query[first], score[first]
                    c, s = ids.take(pa.array(row)), samples.take(pa.array(row))
                    yield from rows(best.add(query, s.to_numpy(), c.to_numpy(), score) if cut
                                    else [(query, s, c, score)])
        if best is not None:
            yield from rows(best.rest())

    return tokens.mapInArrow(run, f"query long, caption_id {caption}, sample_id {sample}, score double")


def scored(matched: DataFrame, n: Column, mean: Column, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, caption_id, sample_id, score`` of captions matched by all of a query's phrases: one row
    for each with ``times, df, tf, length, n_terms``; ``n`` captions of ``mean`` length in the corpus."""
    if allowed is not None:
        matched = matched.join(allowed.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    parts = matched.withColumn("part", F.col("times") * weight(n, F.col("df"))
                               * saturation(F.col("tf"), F.col("length"), mean))
    # Rounded, so that copies of one text tie whatever the order of the sum.
    return (
        parts.groupBy("query_id", "caption_id", "sample_id")
        .agg(F.round(F.sum("part"), 9).alias("score"), F.count(F.lit(1)).alias("k"),
             F.first("n_terms").alias("n_terms"))
        .where(F.col("k") == F.col("n_terms"))
        .select("query_id", "caption_id", "sample_id", "score"))


def weight(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def saturation(tf, length, mean):
    """Of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def best_caption_per_sample(scored: DataFrame) -> DataFrame:
    """``query_id, id, score, caption_id``; equal captions go to the first."""
    best = F.max(F.struct("score", (-F.col("caption_id")).alias("neg"))).alias("b")
    return scored.groupBy("query_id", F.col("sample_id").alias("id")).agg(best).select(
        "query_id", "id", F.col("b.score").alias("score"),
        (-F.col("b.neg")).alias("caption_id"))


def keyword_ranking(
    captions: DataFrame, queries: DataFrame, depth: int, *, stem: bool = False,
    exclude: DataFrame | None = None, allowed: DataFrame | None = None,
    vlm_tags: DataFrame | None = None, scored: DataFrame | None = None,
) -> DataFrame:
    """``query_id, id, rank, caption_id`` to ``depth``.

    Samples found only through a model tag follow the caption hits, without
    repeats, while the list is shorter than ``depth``.  ``scored`` passes in
    captions already scored.
    """
    best = None
    if scored is None and exclude is None:
        phrases = reliable_checkpoint(query_phrases(queries, stem))
        asked = _asked(captions, phrases, stem)
        if asked is None:
            scored = _bm25_by_hits(captions, queries, phrases, stem, exclude, allowed)
        else:
            # Queries of the same phrases are ranked once, to the depth.
            found = asked.matches(depth, allowed)
            ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
            once = best_caption_per_sample(found.withColumnRenamed("query", "query_id")).withColumn(
                "rank", F.row_number().over(ranks)).where(F.col("rank") <= depth)
            best = asked.to_queries(once.withColumnRenamed("query_id", "query"), "id", "score", "caption_id", "rank")
            if vlm_tags is None:
                return best.select("query_id", "id", "rank", "caption_id", F.lit(0).alias("source"))
    if best is None:
        if scored is None:
            scored = bm25_captions(captions, queries, stem=stem, exclude=exclude, allowed=allowed)
        best = best_caption_per_sample(scored)
    lane = best.select("query_id", "id", "caption_id", F.lit(0).alias("source"), "score")
    if vlm_tags is not None:
        lane = _with_tag_hits(lane, queries, vlm_tags, allowed, depth)
    order = Window.partitionBy("query_id").orderBy("source", F.col("score").desc(), "id")
    return lane.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= depth).select("query_id", "id", "rank", "caption_id", "source")


def _with_tag_hits(lane, queries, vlm_tags, allowed, depth):
    words = queries.select(
        "query_id", F.explode(tx.split_words(F.lower("text"))).alias("tag")).distinct()
    tags = vlm_tags.select("tag", F.col("sample_id").alias("id")).distinct()
    if allowed is not None:
        tags = tags.join(_small(allowed.select("id")), "id", "left_semi")
    # Of a tag's samples only the first can come to stand above the depth: those that caption hits
    # repeat leave as many places less to fill.
    first = Window.partitionBy("tag").orderBy("id")
    tags = tags.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= depth).drop("_at")
    tagged = tags.join(words, "tag").select("query_id", "id").distinct()
    tagged = tagged.select(
        "query_id", "id", F.lit(None).cast("long").alias("caption_id"),
        F.lit(1).alias("source"), F.lit(0.0).alias("score"))
    # The caption hit wins: keep the smaller source per (query, sample).
    kept = F.min(F.struct("source", "score", "caption_id")).alias("m")
    return lane.unionByName(tagged).groupBy("query_id", "id").agg(kept).select(
        "query_id", "id", "m.caption_id", "m.source", "m.score")


def pool_sizes(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, pool``: distinct samples matched, before any cut; 0 if none."""
    pool = scored.groupBy("query_id").agg(F.count_distinct("sample_id").alias("pool"))
    return queries.select("query_id").join(pool, "query_id", "left").fillna(0, ["pool"])


def caption_pools(captions: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """``pool_sizes`` of ``bm25_captions``: queries of the same phrases are counted once, and a task names a
    sample once for all captions of it in a batch."""
    phrases = reliable_checkpoint(query_phrases(queries, stem))
    asked = _asked(captions, phrases, stem)
    if asked is None:
        return pool_sizes(_bm25_by_hits(captions, queries, phrases, stem, None, None), queries)
    once = asked.matches(named=True).groupBy("query").agg(F.count_distinct("sample_id").alias("pool"))
    return queries.select("query_id").join(
        asked.to_queries(once, "pool"), "query_id", "left").fillna(0, ["pool"])


def term_stats(
    captions: DataFrame, queries: DataFrame, n_samples: DataFrame, *, stem: bool = False
) -> DataFrame:
    """Per query and content word: samples holding it, their share, and
    whether it is too common to rank on.  ``n_samples`` is a one-row count."""
    words = queries.select(
        "query_id", F.explode(tx.split_words(F.lower("text"))).alias("term")).distinct()
    words = words.where(~F.col("term").isin(tx.STOPWORDS))
    asked = words.select("query_id", "term",
                         F.array_join(tx.index_tokens(F.col("term")), " ").alias("phrase"))
    if stem:
        parts = asked.select("query_id", "term", F.posexplode(F.split("phrase", " ")).alias(
            "off", "token"))
        asked = stem_tokens(parts).groupBy("query_id", "term").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "token"))),
                                     lambda s: s["token"]), " ").alias("phrase"))
    seen = holders(captions, asked, stem).groupBy("phrase").agg(F.count_distinct("sample_id").alias("samples"))
    total = F.greatest(n_samples.scalar(), F.lit(1))
    return (
        asked.where(F.col("phrase") != "").join(seen, "phrase", "left")
        .select("query_id", "term", F.coalesce("samples", F.lit(0)).alias("samples"))
        .withColumn("share", F.col("samples") / total)
        .select("query_id", "term", "samples", F.bround("share", 4).alias("fraction"),
                (F.col("share") >= COMMON_FRACTION).alias("common")))


def vocabulary_signals(captions: DataFrame) -> DataFrame:
    """Caption-text signals per sample: rarity, vocabulary, length spread.

    A word's weight counts captions against the number of *samples*; that
    mismatch is part of the measure.  ``word_rarity`` is the mean of the three
    rarest words and NULL for a sample without any.
    """
    texts = spread(captions.select("sample_id", "text"))
    words = texts.select("sample_id", tx.vocabulary(F.col("text")).alias("words"))
    n_samples = captions.agg(F.count_distinct("sample_id").alias("n"))
    # The texts move, not their words: a sample's words are counted where it lies, without another exchange.
    tokens = texts.repartition("sample_id").select(
        "sample_id", F.explode(tx.distinct_vocabulary(F.col("text"))).alias("word"))
    # Weights, top words and counts all read this table.
    per_sample_word = reliable_checkpoint(
        tokens.groupBy("sample_id", "word").agg(F.count(F.lit(1)).alias("k")))
    df = reliable_checkpoint(per_sample_word.groupBy("word").agg(F.sum("k").alias("df")))
    # Few words can be in more captions than this; only pairs of the others are joined by a shuffle.
    total = df.agg(F.sum("df")).first()[0] or 0
    common = df.where(F.col("df") > max(1, total // COMMON_WORDS))
    seen = per_sample_word.join(F.broadcast(common), "word", "left")
    rare = seen.where("df IS NULL").select("sample_id", "word").join(df, "word").select("sample_id", "df")
    weighted = seen.where("df IS NOT NULL").select("sample_id", "df").unionByName(rare)
    named = per_sample_word.groupBy("sample_id").agg(F.count(F.lit(1)).alias("vocab"))
    # A word's weight falls with its captions: the rarest three have the least.
    order = Window.partitionBy("sample_id").orderBy("df")
    top = weighted.withColumn("pos", F.row_number().over(order)).where("pos <= 3").select("sample_id", F.log(
        F.greatest(n_samples.scalar(), F.lit(1)) / (1 + F.col("df"))).alias("idf"))
    rarity = top.groupBy("sample_id").agg(F.avg("idf").alias("word_rarity"))
    lengths = words.groupBy("sample_id").agg(
        F.coalesce(F.stddev_pop(F.size("words")), F.lit(0.0)).alias("length_sd"))
    return (
        lengths.join(named, "sample_id", "left").join(rarity, "sample_id", "left")
        .select("sample_id", "word_rarity",
                F.coalesce("vocab", F.lit(0)).cast("double").alias("vocab"), "length_sd"))
