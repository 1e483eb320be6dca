"""Scalar functions as Column expressions; all stay in the JVM unless said otherwise."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stems_of

# A small English stop list.
STOPWORDS = "a an and are as at be by for from has in is it its of on or that the to was were with".split()


WORD = r"[\p{L}\p{M}\p{N}]+"  # runs of letters, their marks, and digits of any script


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words of any script; both small sigmas are one letter. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.translate(F.lower(text), "ς", "σ"), F.lit(f"({pattern})")), F.array().cast("array<string>"))


def tokens_sql(text: str) -> str:
    """The same in the SQL of the comparison."""
    return f"regexp_extract_all(translate(lower({text}), 'ς', 'σ'), '{WORD}')"


def content_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def stems(text: Column) -> Column:
    """The stems of the content words; a word in another script is its own stem."""
    return stems_of(content_tokens(text))


def text_or_punctuation(text: Column) -> Column:
    """Array of (token, stem): words and signs in order; the stem is null for signs, stop words and stems of under three letters."""
    all_ = F.coalesce(F.regexp_extract_all(F.translate(F.lower(text), "ς", "σ"), F.lit(f"({WORD}|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}])")), F.array().cast("array<string>"))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])

    def pair(token: Column, stem: Column) -> Column:
        return F.struct(token.alias("token"), F.when(token.rlike(f"^{WORD}$") & (F.length(stem) >= 3) & ~F.array_contains(stop, token), stem).alias("stem"))

    return F.element_at(F.transform(F.array(all_), lambda w: F.zip_with(w, stems_of(w), pair)), 1)


def latin_tokens(text: Column) -> Column:
    """Content words of Latin letters for query languages: apostrophes go, other signs part words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z\u00df-\u00f6\u00f8-\u00ff]+", " ")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.split(plain, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def adjacent_pairs(words: Column) -> Column:
    """Neighbouring pairs as "a b"; fewer than two words give none."""
    # binding the words once: an expression inside a lambda would be evaluated for every pair
    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))

    return F.element_at(F.transform(F.array(words), pairs), 1)


def bigram_set(text: Column) -> Column:
    return F.array_distinct(adjacent_pairs(tokens(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets held in arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def page_name(name: Column) -> Column:
    """First letter in upper case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1_000_000))


def escape_id(name: Column) -> Column:
    """Percent escapes with %20 for a blank."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))


def unescape_id(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def path_text(path: Column) -> Column:
    return F.array_join(path, "/")


def parent_path(path: Column) -> Column:
    """The path without its last step; null at the root."""
    return F.when(F.size(path) > 1, F.slice(path, 1, F.size(path) - 1))


def path_prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))


def passage_and_entity(value: Column) -> tuple[Column, Column]:
    """``hex/entity`` split into both parts; anything else is an entity without passage."""
    hit = value.rlike("^[0-9a-f]+/")
    return F.when(hit, F.regexp_extract(value, "^([0-9a-f]+)/(.*)$", 1)).otherwise(F.lit("")), F.when(hit, F.regexp_extract(value, "^([0-9a-f]+)/(.*)$", 2)).otherwise(value)


def item_number(value: Column) -> Column:
    """``Q123...`` to 123."""
    return F.regexp_extract(value, "^Q([0-9]+)", 1).try_cast("bigint")


def entity_name(value: Column) -> Column:
    """The page name in ``<dbpedia:Name_x>`` or a wiki address; null if neither."""
    name = F.regexp_extract(value, r"^(?:<dbpedia:|https?://[a-z]+\.wikipedia\.org/wiki/)([^>]+)>?$", 1)
    return F.when(name != "", F.translate(name, "_", " "))


def category_key(value: Column) -> Column:
    return F.translate(F.regexp_replace(value, "^Category:", ""), " ", "_")


def title_of_id(page_id: Column) -> Column:
    """The decoded title behind the site prefix."""
    return unescape_id(F.regexp_replace(page_id, "^[^:]*:", ""))


def wrap_lines(text: Column, width: int = 200) -> Column:
    return F.regexp_replace(text, "(.{%d})" % width, "$1\n")


def overlapping_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (offset, chunk): chunks begin every ``size`` characters and reach ``overlap`` beyond."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(text, s + 1, F.lit(size + overlap)).alias("chunk")))


def stable_bucket(value: Column, n: int, salt: str = "") -> Column:
    """A bucket of 0..n-1 from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value)), 1, 8), 16, 10).cast("bigint") % n


def content_id(text: Column) -> Column:
    return F.sha1(text)


def escape_latex(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\textbackslash "), r"([#$%&_{}])", r"\\$1")


def entity_decoder():
    """A vectorised function that resolves named and numeric character references."""

    @F.pandas_udf(T.StringType())
    def decode(s):  # noqa: ANN001, ANN202
        return s.map(html.unescape, na_action="ignore")

    return decode
