"""Text functions as Spark Column expressions (JVM-side, no Python UDF)."""

from __future__ import annotations

import string
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal what the original analysis used):
#   * English stop words: Spark ML's default list, StopWordsRemover.loadDefaultStopWords("english"),
#     181 words in that list's own order (tests check equality with the running Spark).
#   * Cleaning pattern: keep ASCII letters, digits, '-' and space; drop everything else.
#   * Label truncation: 20 characters, then "...".
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't",
    "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's",
    "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)
CLEAN_PATTERN = r"[^a-zA-Z0-9\- ]"
LABEL_CHARS = 20
LABEL_ELLIPSIS = "..."
# ---------------------------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: ``CLEAN_PATTERN`` with each character named: Java then tests a bit table. A class of several ranges is a
#: chain of lambdas, whose type checks tasks of one JVM make each other wait for (twenty times slower).
CLEAN_SINGLES = "[^" + string.ascii_letters + string.digits + r"\- ]"


def clean_text(text: Column | str) -> Column:
    """Drop every character except ASCII letters, digits, '-' and space (newlines glue words)."""
    return F.regexp_replace(_c(text), CLEAN_SINGLES, "")


def tokenize(text: Column | str, keep_empty: bool = False) -> Column:
    """Lower-case and split on single whitespace characters.

    Default drops empty tokens. ``keep_empty=True`` reproduces the ML ``Tokenizer`` exactly:
    leading and inner empties kept, trailing ones dropped, ``''`` -> ``['']``, blank -> ``[]``.
    """
    low = F.lower(_c(text))
    if not keep_empty:
        return F.filter(F.split(low, r"\s"), lambda t: t != "")
    stripped = F.regexp_replace(low, r"\s+$", "")
    return (
        F.when(F.length(low) == 0, F.array(F.lit("")))
        .when(F.length(stripped) == 0, F.array().cast("array<string>"))
        .otherwise(F.split(stripped, r"\s"))
    )


def remove_stopwords(tokens: Column | str, stop_words=ENGLISH_STOP_WORDS, case_sensitive: bool = False) -> Column:
    """Drop stop words from a token array, keeping order and duplicates."""
    words = list(stop_words) if case_sensitive else sorted({w.lower() for w in stop_words})
    if case_sensitive:
        return F.filter(_c(tokens), lambda t: ~t.isin(*words))
    return F.filter(_c(tokens), lambda t: ~F.lower(t).isin(*words))


def analyze(text: Column | str) -> Column:
    """The one analyzer used for indexing and querying: clean -> tokenize -> stop words."""
    return remove_stopwords(tokenize(clean_text(text)))


def analyzed_text(text: Column | str) -> Column:
    """The analyzed words as one string, for sinks that have no arrays (CSV, text)."""
    return F.array_join(analyze(text), " ")


def word_or_filter(df: DataFrame, text_col: str, text_filter: str) -> DataFrame:
    """Keep rows whose text contains any of the whitespace-separated words (case-sensitive)."""
    words = text_filter.split()
    if not words:
        raise ValueError("text_filter must contain at least one word")
    return df.where(reduce(or_, [F.col(text_col).contains(w) for w in words]))


def shared_words(text: Column | str, phrase: str) -> Column:
    """How many different words of ``phrase`` the text has, letter case aside: a flag for each word,
    added up (0 for a phrase without words, null for a null text)."""
    tokens = tokenize(text)
    flags = [F.array_contains(tokens, w).cast("long") for w in sorted(set(phrase.lower().split()))]
    return reduce(add, flags, F.when(tokens.isNotNull(), F.lit(0).cast("long")))


def truncate_label(text: Column | str, n_chars: int = LABEL_CHARS) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n_chars, F.concat(F.substring(t, 1, n_chars), F.lit(LABEL_ELLIPSIS))).otherwise(t)


def md5_key(seed: str | int, *parts: Column | str) -> Column:
    """Repeatable pseudo-random sort key: md5 of seed and parts joined by '|'."""
    cols = [F.lit(str(seed))] + [_c(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def seeded_shuffle(arr: Column | str, seed: str | int, *key: Column | str) -> Column:
    """Shuffle an array repeatably: sort elements by md5(seed|key|position)."""
    tagged = F.transform(
        _c(arr), lambda w, i: F.struct(md5_key(seed, *key, i).alias("k"), w.alias("w"))
    )
    return F.transform(F.array_sort(tagged), lambda s: s["w"])
