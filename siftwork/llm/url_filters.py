"""URL filters: prefix rules first, then a list of canonical URLs.

The list is held as a blocked Bloom filter: a canonical URL hashes to one block
of 512 bits and sets one bit in each of its eight words.  A page whose eight
bits are all set *may* be listed; only those pages go on to an exact hash join
with the list, which removes the false positives.  No Python runs on the rows.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is never listed (verdict ``allow``).  Repeated URLs and pages
each keep their row.  An empty list allows whatever no rule blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import ascii_lower, saved, small_enough

WORDS = 8
BITS_PER_URL = 16
#: Query parameters that name a campaign or a feed, not a page.
TRACKING = r"(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?(?=&|$)"

Rule = tuple[str, str, str]  # verdict, host, path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without a last slash, query without tracking;
    null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"^&", "")
    full = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", full)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); the first listed of
    equally long ones; null if none fits."""
    fits = []
    for verdict, on, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        within = (host == on) | host.endswith("." + on)
        fits.append(F.when(within & path.startswith(prefix), F.struct(
            F.lit(on + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: str) -> list[Column]:
    """One bit of 64 in each word, six bits of a second hash for each."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * i}) & 63 as int))")
            for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the blocked filter over column ``canonical``."""
    bits = listed.select(_block(F.col("canonical"), blocks).alias("block"),
                         *[m.alias(f"m{i}") for i, m in enumerate(_masks("canonical"))])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (),
                id_col: str = "page_id") -> DataFrame:
    """A verdict for every page: (id, host, path, rule, verdict, listed).

    ``listed`` has a column ``canonical`` (see :func:`canonical_url`); repeats
    and nulls in it don't matter.  The filter is broadcast while it is small,
    else joined by block; the exact join is left to the planner either way, so a
    hot URL is split by the skew join.
    """
    listed = saved(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct())
    size = listed.count()
    blocks = max(1, -(-size * BITS_PER_URL // (64 * WORDS)))
    bloom = bloom_blocks(listed, blocks)
    if small_enough(blocks, 8 * (WORDS + 1)):
        bloom = F.broadcast(bloom)
    judged = pages.select(
        F.col(id_col), "url").select(
        F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        canonical_url(F.col("url")).alias("canonical"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    probe = judged.withColumn("block", _block(F.col("canonical"), blocks))
    bits_set = None
    for i, mask in enumerate(_masks("canonical")):
        one = F.col(f"w{i}").bitwiseAND(mask) == mask
        bits_set = one if bits_set is None else bits_set & one
    probe = probe.join(bloom, "block", "left").withColumn(
        "maybe", F.coalesce(bits_set, F.lit(False)) & F.col("canonical").isNotNull()
    ).select(id_col, "host", "path", "canonical", "fit", "maybe")
    hits = probe.where("maybe").join(
        listed.withColumn("listed", F.lit(True)), "canonical", "left")
    misses = probe.where("not maybe").withColumn("listed", F.lit(False))
    both = hits.unionByName(misses.select(*hits.columns))
    listed_ = F.coalesce("listed", F.lit(False))
    return both.select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(listed_, "block").otherwise("allow")).alias("verdict"),
        listed_.alias("listed"))
