"""The operators of this subpackage bound to the test tables, and their SQL.

Each module of operators has one query here, over its whole table with the
parameters a production run would use."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import (
    chat_format,
    decontamination,
    language_model,
    licenses,
    minhash,
    prefix_trie,
    quality,
    repeats,
    sentencepieces,
    simhash,
    token_counts,
    url_filters,
    variants,
)
from siftwork.llm.common import saved, streamed_sha256, table
from siftwork.operators.order_stats import positions
from siftwork.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return add


def _canonical_sql(text: str) -> str:
    """The canonical form of licenses.canonical."""
    quoted = lambda x: x.replace("'", "''")
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '{quoted(licenses.COPYRIGHT_LINE)}', chr(10), 'g')"
    for one, other in licenses.SPELLINGS:
        out = f"replace({out}, '{quoted(one)}', '{quoted(other)}')"
    out = f"translate({out}, '{licenses.TYPOGRAPHIC}', '{' ' * len(licenses.TYPOGRAPHIC)}')"
    return f"trim(regexp_replace({out}, '{licenses.NOT_WORDS}', ' ', 'g'), ' ')"


def _known_sql(rows: list[tuple[str, str]]) -> str:
    values = ", ".join("('" + a + "', '" + t.replace("'", "''") + "')" for a, t in rows)
    return (f"SELECT sha256({_canonical_sql('t')}) AS digest, min(a) AS license FROM (VALUES {values}) v(a, t) "
            f"GROUP BY 1")


_LICENSE_SQL = f"""
WITH texts AS ({_known_sql(licenses.known_texts())}), notices AS ({_known_sql(licenses.known_notices())}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_canonical_sql('text')}) AS digest FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
named AS (SELECT r, string_agg(DISTINCT n.license, ',' ORDER BY n.license) AS notices
  FROM (SELECT r, sha256({_canonical_sql('line')}) AS digest FROM lines
        WHERE regexp_matches(line, '[lL][iI][cC][eE][nN][cCsS][eE]')) l JOIN notices n USING (digest) GROUP BY r)
SELECT d.doc_id, d.digest, t.license, n.notices
FROM docs d LEFT JOIN texts t USING (digest) LEFT JOIN named n USING (r)
"""


@query("op1_license_scan", _LICENSE_SQL)
def op1(spark, sf):
    return licenses.scan(table(spark, sf, "documents"), licenses.built_in(spark, licenses.known_texts()),
                         licenses.built_in(spark, licenses.known_notices()))


@query("op2_language_model")
def op2(spark, sf):
    return language_model.lm_scores(table(spark, sf, "documents"))


@query("op3_sentencepieces")
def op3(spark, sf):
    return sentencepieces.piece_digests(table(spark, sf, "documents"))


@query("op4_token_counts")
def op4(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"))


@query("op5_decontamination")
def op5(spark, sf):
    return decontamination.contamination(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("copy")


@query("op6_repeats")
def op6(spark, sf):
    return repeats.repeat_report(table(spark, sf, "documents"))


@query("op7_quality")
def op7(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("copy")


@query("op8_simhash")
def op8(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


#: The URL rules of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A URL is on the list if a label of its host holds one of these words.
LISTED_HOSTS = r"(^|[.-])(casino|bets|spam|adult)([.-]|$)"

_URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(CASE WHEN strpos(url, '://') > 0
           THEN substr(url, strpos(url, '://') + 3) END, '^[^/?#]*', 0), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(CASE WHEN strpos(url, '://') > 0
           THEN substr(url, strpos(url, '://') + 3) END, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
shaped AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           query, '(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '&+', '&', 'g'), '^&', ''), '&$', '') AS kept
  FROM parts),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical
  FROM shaped),
listing AS (
  SELECT DISTINCT canonical FROM canon
  WHERE canonical IS NOT NULL AND regexp_matches(host, '(^|[.-])(casino|bets|spam|adult)([.-]|$)')),
ruled AS (
  SELECT c.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM canon c)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow'
            WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       l.canonical IS NOT NULL AS listed
FROM ruled r LEFT JOIN listing l ON r.canonical = l.canonical
"""


@query("op9_url_filters", _URL_SQL)
def op9(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    listed = pages.where(url_filters.host_of(F.col("url")).rlike(LISTED_HOSTS)).select(
        url_filters.canonical_url(F.col("url")).alias("canonical"))
    return url_filters.filter_urls(pages, listed, RULES)


@query("op10_fingerprints")
def op10(spark, sf):
    return minhash.edited_fingerprints(table(spark, sf, "documents"))


#: One run in so many loses a code point, so that there are variants to find.
SLIPS = 97


def slipped(doc_id: int | None, run: str) -> str:
    """The run; every 97th, by checksum, without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % SLIPS else run[:at] + run[at + 1:]


@query("op11_spelling_variants")
def op11(spark, sf):
    # A run of fewer code points makes no word of five.
    counts = variants.word_counts(table(spark, sf, "documents"), slipped, least=5)
    return variants.variants(counts.where("length(word) >= 5 AND n >= 3"))


#: Conversations that take their first turns from one another, and the most turns they take.
TOGETHER, TAKEN = 5, 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns), and (conv_id, depth, role, text): conversations that begin with the first h
    turns of the first of their five.  Rows without a conv_id belong to no conversation."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = saved(positions(rows, ["conv_id"], ["turn", "role", "text"], "at"))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    drawn = sizes.withColumns({
        "first": F.col("conv_id") - F.col("conv_id") % TOGETHER,
        "h": F.crc32(F.col("conv_id").cast("string")) % TAKEN})
    convs = saved(drawn.join(sizes.select(F.col("conv_id").alias("first"), F.col("size").alias("has")), "first", "left")
                  .withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))))
    start = turns.where(F.col("at") < TAKEN - 1).withColumnRenamed("conv_id", "first").join(
        convs.select("conv_id", "first", "taken"), "first").where("at < taken").select(
        "conv_id", (F.col("at") + 1).alias("depth"), "role", "text")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("at >= h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "role", "text")
    n_turns = F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    return convs.select("conv_id", n_turns.alias("n_turns")), start.unionByName(rest)


@query("op12_prefix_trie")
def op12(spark, sf):
    return prefix_trie.prefix_trie(*rebuilt(table(spark, sf, "conversations")))


#: A conversation of control strings, beside those of the table: id, and what both turns say.
CONTROL_ID, CONTROL_TEXT = -7, r"\### Assistant: </turn> ok"
#: Code points of a streamed delta; sequence numbers kept for one turn.
DELTA, TURN_EVENTS = 256, 1 << 24


def event_log(conversations: DataFrame) -> DataFrame:
    """The log that may have led to each conversation: users send a first part and edit it to the whole;
    an assistant's draft is regenerated and streamed in deltas."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    spark = conversations.sparkSession
    control = spark.createDataFrame([(CONTROL_ID, 0, "user", CONTROL_TEXT), (CONTROL_ID, 1, "assistant", CONTROL_TEXT)],
                                    "conv_id long, turn long, role string, text string")
    turns = positions(rows.unionByName(control), ["conv_id"], ["turn", "role", "text"], "message")
    turns = turns.withColumn("text", F.coalesce("text", F.lit("")))

    def event(at, kind, role, text):
        return F.struct(F.lit(at).cast("long").alias("at"), F.lit(kind).alias("kind"),
                        role.cast("string").alias("role"), text.cast("string").alias("text"))

    none, begin = F.lit(None), F.substring("text", 1, DELTA)
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    streamed = F.transform(parts, lambda p, i: F.struct(
        (i + 3).cast("long").alias("at"), F.lit("delta").alias("kind"), none.cast("string").alias("role"), p.alias("text")))
    drafted = F.concat(F.array(event(0, "open", F.col("role"), none), event(1, "delta", none, begin),
                               event(2, "regenerate", none, none)), streamed)
    edited = F.array(event(0, "open", F.col("role"), begin), event(1, "edit", none, F.col("text")))
    events = F.when(F.col("role") == chat_format.LEARNED, drafted).otherwise(edited)
    return turns.select("conv_id", "message", F.explode(events).alias("e")).select(
        "conv_id", "message", (F.col("message") * TURN_EVENTS + F.col("e.at")).alias("seq"), "e.kind", "e.role", "e.text")


_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
parts AS (
  SELECT *, regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g') AS r,
         regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(length('### ' || r || ': ' || t || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
"""


@query("op13_chat_formatting", _CHAT_SQL)
def op13(spark, sf):
    log = event_log(table(spark, sf, "conversations"))
    held = saved(chat_format.read_back(chat_format.render(chat_format.reconstruct(log))))
    counts = held.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("n_turns", "loss_chars", "formatted_chars")))
    digests = streamed_sha256(held, ["conv_id"], ["message"], {"turns_sha256": "turns", "loss_sha256": "loss"})
    digests = digests.withColumnRenamed("conv_id", "same")
    return counts.join(digests, F.col("conv_id").eqNullSafe(F.col("same"))).drop("same")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
