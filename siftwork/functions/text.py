"""Text columns: tokenizers, query clean-up, tag and label normal forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The function words left out of vocabulary counts and of the
# keyword conjunction.
STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was "
    "were will with his her their this there two three while over under near up "
    "down out off no not they them then than into onto"
).split()


def _accent_pairs() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bare letters, by rule."""
    marked, bare = [], []
    for code in range(0xC0, 0x250):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            marked.append(ch)
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _accent_pairs()


def fold(text: Column) -> Column:
    """Case and diacritics removed, as the keyword index sees a text."""
    return F.translate(F.lower(text), _MARKED, _BARE)


def index_tokens(text: Column) -> Column:
    """Runs of letters or digits of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def plain_words(text: Column) -> Column:
    """Lower-case ``[a-z']+`` runs: the unit of caption length."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1))


def vocabulary(text: Column) -> Column:
    """Words that carry meaning: longer than two letters, no function words."""
    return F.filter(plain_words(text), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def distinct_vocabulary(text: Column) -> Column:
    """The words of :func:`vocabulary`, each once."""
    long = F.regexp_extract_all(F.lower(text), F.lit("([a-z']{3,})"), F.lit(1))
    return F.array_except(long, F.array(*[F.lit(w) for w in STOPWORDS]))


def space_word_count(text: Column, trim: bool = False) -> Column:
    """Spaces plus one.  The corpus average leaves the ends untrimmed, the
    exact distribution trims first; the two differ on padded captions."""
    t = F.trim(text) if trim else text
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("int")


def normalize_query(q: Column) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed; never empty."""
    flat = F.regexp_replace(F.lower(q), r"(?U)[^\w\s]", " ")
    clean = F.trim(F.regexp_replace(flat, r"(?U)\s+", " "))
    return F.when(clean == "", q).otherwise(clean)


def bare_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def split_words(q: Column) -> Column:
    return F.filter(F.split(q, r"(?U)\s+"), lambda w: w != "")


def match_terms(q: Column) -> Column:
    """The words a keyword query insists on; a query of function words keeps
    them all, so that it still searches for something."""
    words = split_words(q)
    content = F.filter(
        words, lambda w: (bare_word(w) != "") & ~bare_word(w).isin(STOPWORDS))
    return F.when(F.size(content) == 0, words).otherwise(content)


def canonical_name(name: Column) -> Column:
    """Label key: trimmed, lower, single spaces, no leading article."""
    flat = F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "))
    return F.regexp_replace(flat, "^(?:a|an) (?=.)", "")


def detector_phrases(queries: Column, default: str | None = None) -> Column:
    """Period-separated phrases; a blank query takes the default phrase."""
    parts = F.filter(
        F.transform(
            F.split(queries, r"\."),
            lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))),
        lambda p: p != "")
    if default is None:
        return parts
    return F.when(F.size(parts) == 0, F.array(F.lit(default))).otherwise(parts)


def tag_name(tag: Column) -> Column:
    """Trimmed lower-case tag; NULL where nothing is left."""
    clean = F.lower(F.trim(tag))
    return F.when(clean != "", clean)


def facet_stem(value: Column) -> Column:
    """First three letters or digits, lower case."""
    return F.substring(bare_word(value), 1, 3)


def parse_id_entries(text: Column) -> Column:
    """Entries of a pasted list: commas or line ends, trimmed, first kept."""
    parts = F.transform(F.split(text, r"[,\r\n]"), lambda e: F.trim(e))
    return F.array_distinct(F.filter(parts, lambda e: e != ""))


def is_id_entry(entry: Column) -> Column:
    """ASCII digits with an optional leading minus; all else is a file name."""
    return entry.rlike("^-?[0-9]+$")


def seeded(seed: int, column: str = "id") -> Column:
    """Order of a draw that every run and every engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(seed), column))
