"""Curation as table-to-table steps: tags, albums, labels, views, activity.

Each step returns the next snapshot, or the rows to add to it; nothing is
updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators.order_stats import positions

# Verdict prefix and values, activity kinds a client may write,
# and the longest payload.
VERDICT_PREFIX = "verdict:"
VERDICTS = ("ok", "caption-error", "scorer-error", "ambiguous", "duplicate")
CLIENT_KINDS = ("search_snapshot", "image_search", "composed_search", "tag_approval")
MAX_PAYLOAD = 4000


# --------------------------------------------------------------------------- tags

def tags_to_add(samples: DataFrame, existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sample_id, tag`` rows a bulk tag adds: known samples, normal form,
    nothing already there.  The row count is the answer of the step."""
    asked = wanted.select("sample_id", tx.tag_name(F.col("tag")).alias("tag")).where(
        F.col("tag").isNotNull()).distinct()
    known = asked.join(samples.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    return known.join(existing, ["sample_id", "tag"], "left_anti")


def bulk_tag(samples: DataFrame, existing: DataFrame, wanted: DataFrame) -> DataFrame:
    added = tags_to_add(samples, existing, wanted)
    return existing.select("sample_id", "tag").unionByName(added)


def remove_tags(existing: DataFrame, removed: DataFrame) -> DataFrame:
    return existing.join(removed, ["sample_id", "tag"], "left_anti")


def orphan_tags(tags: DataFrame, sample_tags: DataFrame) -> DataFrame:
    """Tags nobody carries any more."""
    return tags.select("tag").distinct().join(
        sample_tags.select("tag").where(F.col("tag").isNotNull()), "tag", "left_anti")


def latest_verdicts(tag_events: DataFrame) -> DataFrame:
    """One verdict per sample, the last recorded: ``sample_id, tag``."""
    calls = tag_events.where(F.col("tag").startswith(VERDICT_PREFIX))
    return calls.groupBy("sample_id").agg(F.max_by("tag", F.struct("ts", "tag")).alias("tag"))


# ------------------------------------------------------------------------- albums

def album_from_tag(sample_tags: DataFrame, tag: str, album_id: int) -> DataFrame:
    """Items of a new album: the tag's samples by id."""
    members = sample_tags.where(F.col("tag") == tag).select(
        F.lit(album_id).cast("long").alias("album_id"), "sample_id").distinct()
    return positions(members, ["album_id"], ["sample_id"])


def albums_from_tags(sample_tags: DataFrame) -> DataFrame:
    """The same for every tag at once: ``tag, sample_id, position``."""
    return positions(sample_tags.select("tag", "sample_id").distinct(), ["tag"], ["sample_id"])


def items_to_add(items: DataFrame, samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows an add brings to albums.  ``wanted`` is ``(album_id, sample_id,
    i)``; each keeps its list place past the album's end, existing members
    keep theirs, so gaps may remain."""
    ends = items.groupBy("album_id").agg(F.max("position").alias("last"))
    first = wanted.groupBy("album_id", "sample_id").agg(F.min("i").alias("i"))
    known = first.join(samples.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    new = known.join(items.select("album_id", "sample_id"), ["album_id", "sample_id"], "left_anti")
    return new.join(ends, "album_id", "left").select(
        "album_id", "sample_id",
        (F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("i")).alias("position"))


def next_positions(items: DataFrame, albums: DataFrame) -> DataFrame:
    ends = items.groupBy("album_id").agg(F.max("position").alias("last"))
    return albums.select(F.col("id").alias("album_id")).join(ends, "album_id", "left").select(
        "album_id", F.coalesce(F.col("last") + 1, F.lit(0)).alias("next_position"))


def compact(items: DataFrame) -> DataFrame:
    """Positions 0..n-1 again, by (position, sample id)."""
    moved = items.select("album_id", "sample_id", F.col("position").alias("_old"))
    return positions(moved, ["album_id"], ["_old", "sample_id"]).select(
        "album_id", "sample_id", "position")


def remove_items(albums: DataFrame, items: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and items after a removal; a removed cover is cleared."""
    gone = removed.select(F.col("album_id").alias("id"), F.col("sample_id").alias("cover_sample_id"),
                          F.lit(True).alias("_gone")).distinct()
    kept = albums.join(gone, ["id", "cover_sample_id"], "left").withColumn(
        "cover_sample_id", F.when(F.col("_gone").isNull(), F.col("cover_sample_id"))).drop("_gone")
    left = items.join(removed.select("album_id", "sample_id"), ["album_id", "sample_id"], "left_anti")
    return kept.select(albums.columns), compact(left)


def order_problems(items: DataFrame, order: DataFrame, shown: int = 10) -> DataFrame:
    """What keeps an order from being exactly the album's membership.

    ``order`` is ``(album_id, sample_id, i)``.  Per album: duplicates, missing
    and unknown counts, with the first ids of each; an album without a row is
    in order.  Shown ids come from a rank-limited window, never a full list."""
    given = order.groupBy("album_id", "sample_id").agg(F.count(F.lit(1)).alias("times"))
    have = items.select("album_id", "sample_id", F.lit(True).alias("member"))
    both = given.join(have, ["album_id", "sample_id"], "full_outer")
    kind = (F.when(F.col("times").isNull(), "missing").when(F.col("member").isNull(), "unknown")
            .when(F.col("times") > 1, "duplicate"))
    # One id can be both unknown and repeated.
    kinds = F.filter(F.array(kind, F.when((F.col("times") > 1) & F.col("member").isNull(),
                                          "duplicate")), lambda k: k.isNotNull())
    bad = both.select("album_id", "sample_id", F.explode(kinds).alias("kind"))
    counts = bad.groupBy("album_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("album_id", "kind").orderBy("sample_id")
    first = bad.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= shown).groupBy(
        "album_id", "kind").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))
    return counts.join(first, ["album_id", "kind"])


def reorder(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items with positions from ``order``; albums whose order is not an exact
    membership are left as they were."""
    bad = order_problems(items, order).select("album_id").distinct()
    ok = order.select("album_id", "sample_id", F.col("i").cast("long").alias("_new")).join(
        bad, "album_id", "left_anti")
    return items.join(ok, ["album_id", "sample_id"], "left").withColumn(
        "position", F.coalesce("_new", "position")).drop("_new")


def album_summaries(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Albums with their size and cover: the chosen one, else the first item."""
    facts = items.groupBy(F.col("album_id").alias("id")).agg(
        F.count(F.lit(1)).alias("items"),
        F.min_by("sample_id", F.struct("position", "sample_id")).alias("_first"))
    return albums.join(facts, "id", "left").withColumn(
        "items", F.coalesce("items", F.lit(0))).withColumn(
        "cover", F.coalesce("cover_sample_id", "_first")).drop("_first")


def missing_ids(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids that name no sample; the strict form refuses a set with any."""
    return wanted.select("id").distinct().join(samples.select("id"), "id", "left_anti")


def existing_or_nothing(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ids if all exist, otherwise no row."""
    absent = missing_ids(samples, wanted).agg(F.count(F.lit(1)).alias("n"))
    return wanted.select("id").distinct().where(absent.scalar() == 0)


# ------------------------------------------------------------------------- labels

def resolve_labels(labels: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """Resolve or create label edges ``(label_name, parent_name)``.

    Returns ``resolved`` (id, name), ``conflicts`` (an existing label asserted
    under another parent, or a label under itself) and ``new`` edges."""
    edges = asked.select(
        tx.canonical_name(F.col("label_name")).alias("name"),
        tx.canonical_name(F.col("parent_name")).alias("parent")).where(
        F.col("name") != "").withColumn("parent", F.when(F.col("parent") != "", F.col("parent"))
                                        ).distinct()
    named = labels.select(F.col("id"), F.lower("name").alias("name"), "parent_id")
    parents = labels.select(F.col("id").alias("parent_id"), F.lower("name").alias("has_parent"))
    known = named.join(parents, "parent_id", "left").select(
        "id", "name", "has_parent", F.lit(True).alias("exists"))
    seen = edges.join(known, "name", "left")
    clash = (F.col("parent") == F.col("name")) | (
        F.col("exists") & F.col("parent").isNotNull()
        & ~F.col("parent").eqNullSafe(F.col("has_parent")))
    marked = seen.withColumn("clash", F.coalesce(clash, F.lit(False)))
    # Among new labels, a name asked for under two parents conflicts as well.
    several = edges.groupBy("name").agg(F.count_distinct("parent").alias("p")).where("p > 1")
    fresh = marked.where(F.col("exists").isNull() & ~F.col("clash"))
    return {
        "resolved": marked.where(F.col("exists") & ~F.col("clash")).select("id", "name"),
        "conflicts": marked.where("clash").select("name", "parent").union(
            fresh.join(several, "name", "left_semi").select("name", "parent")),
        "new": fresh.join(several, "name", "left_anti").groupBy("name").agg(
            F.max("parent").alias("parent")),
    }


# --------------------------------------------------------------- views and activity

def stale_views(views: DataFrame, current: DataFrame) -> DataFrame:
    """Saved views with ``stale``: a stored model or corpus mark that differs
    from the current one.  A view without marks is not stale.

    ``views`` carries the query string; ``current`` is one row of
    ``(embed_model, corpus)``."""
    pairs = F.split("query", "&")

    def mark(name: str):
        hit = F.filter(pairs, lambda p: p.startswith(f"{name}="))
        return F.when(F.size(hit) > 0, F.regexp_replace(hit[0], f"^{name}=", ""))

    now = current.select(F.struct("embed_model", "corpus").alias("s")).scalar()
    own = F.array_join(F.filter(pairs, lambda p: (p != "") & ~p.startswith("_embed_model=")
                                & ~p.startswith("_corpus=")), "&")
    differs = [F.coalesce(mark("_embed_model") != F.col("_now.embed_model"), F.lit(False)),
               F.coalesce(mark("_corpus") != F.col("_now.corpus"), F.lit(False))]
    return views.withColumn("_now", now).withColumn("stale", differs[0] | differs[1]).withColumn(
        "query", own).drop("_now")


def judged_activity(events: DataFrame, client: bool = True, longest: int = MAX_PAYLOAD) -> DataFrame:
    """Events with ``refused``: why one is not fit to append, NULL if it is."""
    why = F.when(F.try_parse_json("payload").isNull(), "payload is not JSON").when(
        F.length("payload") > longest, f"payload over {longest} characters")
    if client:
        why = why.when(~F.col("kind").isin(*CLIENT_KINDS), "kind is not a client's")
    return events.withColumn("refused", why)


def valid_activity(events: DataFrame, client: bool = True, longest: int = MAX_PAYLOAD) -> DataFrame:
    """Events fit to append; :func:`judged_activity` also keeps the others."""
    return judged_activity(events, client, longest).where(F.col("refused").isNull()).drop("refused")
