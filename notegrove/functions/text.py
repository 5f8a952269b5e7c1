"""Tokenisers, query builders, keywords, entities and snippets as column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegrove.functions.stopwords import RERANK_STOP_WORDS, STOP_WORDS

WORD = r"[\p{L}\p{N}_]+"
#: The words, phrases, numbers and offsets below are data that the specification fixes.
PREFERENCE_WORDS = (
    "advice", "enjoy", "enjoyed", "enjoying", "favorite", "favorites", "favourite", "favourites", "interest", "interested", "prefer",
    "preference", "preferred", "prefers", "recommend", "recommendation", "recommendations", "suggest", "suggestion", "suggestions", "tips",
)
PREFERENCE_PHRASES = ("what are my", "what do i", "what is my", "what kind", "what sort", "what type")
#: (spelling, number), longest spelling first.
NUMBER_WORDS = (
    ("a couple of", 2), ("a couple", 2), ("couple of", 2), ("couple", 2), ("eleven", 11), ("twelve", 12), ("a few", 3), ("eight", 8), ("seven", 7),
    ("three", 3), ("five", 5), ("four", 4), ("nine", 9), ("few", 3), ("one", 1), ("six", 6), ("ten", 10), ("two", 2),
)
#: (pattern, days for each unit of the number in its group or none, tolerance or days and tolerance). The first that matches counts.
OFFSETS = (
    (r"(\d+)\s+days?\s+ago", 1, 2),
    (r"yesterday", None, (1, 1)),
    (r"(\d+)\s+weeks?\s+ago", 7, 5),
    (r"a\s+week\s+ago", None, (7, 3)),
    (r"last\s+week", None, (7, 3)),
    (r"(\d+)\s+months?\s+ago", 30, 10),
    (r"a\s+month\s+ago", None, (30, 7)),
    (r"last\s+month", None, (30, 7)),
    (r"a\s+year\s+ago", None, (365, 30)),
    (r"last\s+year", None, (365, 30)),
    (r"recently", None, (14, 14)),
)


@functools.lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Latin letters that are a base letter with one mark, and those base letters."""
    found = {}
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(point).lower()
        parts = unicodedata.normalize("NFD", letter)
        if len(letter) == 1 and len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            found[letter] = parts[0]
    return "".join(found), "".join(found.values())


def every_match(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def fold(text: Column) -> Column:
    """Lower case without single accents on Latin letters, as the index and its queries are folded."""
    return F.translate(F.lower(text), *_accents())


def index_tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters; the underscore parts words."""
    return every_match(fold(text), r"[\p{L}\p{N}\p{Co}]+")


def query_words(query: Column) -> Column:
    """Words of a query, underscores included."""
    return every_match(query, WORD)


def match_expression(query: Column) -> Column:
    """Every word in quotes, joined by AND; null when there is none."""
    words = query_words(query)
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " AND "))


def query_phrases(query: Column) -> Column:
    """One array of index tokens for each word of the query: several where an underscore parts it, none where nothing is left."""
    return F.transform(query_words(query), index_tokens)


def bm25_to_score(rank: Column) -> Column:
    """A BM25 rank (the lower the better) as a score in (0, 1]."""
    finite = rank.isNotNull() & ~F.isnan(rank) & (F.abs(rank) != float("inf"))
    return F.when(~finite, 0.001).when(rank < 0, -rank / (1 - rank)).otherwise(1 / (1 + rank))


def is_stop_word(token: Column) -> Column:
    """Whether a token stands in any of the seven lists; case matters."""
    return token.isin(*STOP_WORDS)


#: A word that is not one or two ASCII letters and not digits only. Words start where no word goes on.
KEYWORD = r"(?<![\p{L}\p{N}_])(?!(?:[a-zA-Z]{1,2}|\p{Nd}++)(?![\p{L}\p{N}_]))[\p{L}\p{N}_]++"


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _first_spellings(order: Column) -> Column:
    """Of words (low, at, own), sorted, the first of each lower case, in order of place: each is compared with its neighbour alone."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(order, lambda x: x["low"]))
    pairs = F.filter(F.zip_with(order, F.slice(before, F.lit(1), F.size(order)), lambda x, y: F.struct(x["at"].alias("at"), x["own"].alias("own"), (y.isNull() | (x["low"] != y)).alias("first"))), lambda x: x["first"])
    return F.transform(F.sort_array(pairs), lambda x: x["own"])


def keywords(query: Column) -> Column:
    """Words that say what a query is about, without repeats in another case."""
    words = F.transform(F.array_distinct(every_match(query, KEYWORD)), lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("at"), t.alias("own")))
    return _bound(F.sort_array(F.filter(words, lambda t: ~is_stop_word(t["low"]) & ~is_stop_word(t["own"]))), _first_spellings)


def expanded_query(query: Column) -> Column:
    """struct(original, keywords, expanded): the query OR its keywords; null for a query without a word."""
    found = keywords(query)
    whole = F.trim(query)
    return F.when(F.size(query_words(query)) > 0, F.struct(whole.alias("original"), found.alias("keywords"), F.array_join(F.concat(F.array(whole), found), " OR ").alias("expanded")))


def diversity_tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores in lower case."""
    return F.array_distinct(every_match(F.lower(text), r"[a-z0-9_]+"))


def jaccard(left: Column, right: Column) -> Column:
    """Of two token sets: 1 when both are empty, 0 when one is."""
    shared = F.size(F.array_intersect(left, right))
    both = F.size(left) + F.size(right) - shared
    return F.when(both == 0, 1.0).otherwise(shared / F.greatest(both, F.lit(1)))


def snippet(text: Column, most: int) -> Column:
    """Text of at most `most` characters and an ellipsis, cut at the last space when that lies beyond the middle."""
    cut = F.substring(text, 1, most)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # index of the last space from 0; the length when there is none
    shorter = F.when((F.instr(cut, " ") > 0) & (space > most // 2), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(shorter, F.lit("…")))


def _bounded(pattern: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def asks_for_preference(query: Column) -> Column:
    """Whether a query asks what someone likes, so that entity matches would mislead."""
    lowered = F.lower(query)
    words = every_match(lowered, _bounded("[a-z]+"))
    by_phrase = functools.reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p)) for p in PREFERENCE_PHRASES))
    return F.arrays_overlap(words, F.array(*map(F.lit, PREFERENCE_WORDS))) | by_phrase


def entities(query: Column) -> Column:
    """Quoted phrases, runs of capitalised words, acronyms and hyphenated words, lower-case, in that order, without repeats."""
    parts = (
        every_match(query, r'"([^"]+)"', 1),
        every_match(query, _bounded(r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)+")),
        every_match(query, _bounded(r"[A-Z]{2,}")),
        every_match(query, _bounded(r"[A-Za-z]{2,}(?:-[A-Za-z]{2,})+")),
    )
    return F.array_distinct(F.transform(F.concat(*parts), F.lower))


def topic_words(text: Column) -> Column:
    """Whole words of three or more ASCII letters, lower-case, without the re-rankers' stop words, repeats included."""
    return F.filter(every_match(F.lower(text), _bounded(r"[a-z]{3,}")), lambda t: ~t.isin(*RERANK_STOP_WORDS))


def topic_pairs(text: Column) -> Column:
    """Neighbours among the topic words, joined by a space."""
    words = topic_words(text)
    left = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(left, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def share_found(wanted: Column, lowered: Column) -> Column:
    """Share of the wanted strings that occur in a lower-cased text; 0 when none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda e: F.contains(lowered, e))) / F.size(wanted)).otherwise(0.0)


def with_digits(text: Column) -> Column:
    """Written numbers up to twelve as digits, the longest spelling first."""
    for words, number in NUMBER_WORDS:
        text = F.regexp_replace(text, "(?i)" + _bounded(words.replace(" ", r"\ ")), str(number))
    return text


def time_offset(query: Column) -> Column:
    """struct(days, tolerance) that a query reaches back; null when it names none."""
    return digit_offset(with_digits(query))


def digit_offset(plain: Column) -> Column:
    """time_offset of a text whose numbers are digits already."""
    out = None
    for pattern, unit, rest in OFFSETS:
        if unit is None:
            value = F.struct(F.lit(rest[0]).cast("long").alias("days"), F.lit(rest[1]).cast("int").alias("tolerance"))
        else:
            value = F.struct((F.regexp_extract(plain, "(?i)" + pattern, 1).try_cast("long") * unit).alias("days"), F.lit(rest).cast("int").alias("tolerance"))
        hit = plain.rlike("(?i)" + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out
