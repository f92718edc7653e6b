"""Column helpers for words, tokens and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces with these prefixes belong to the word before them.
GLUE_PREFIXES = ("-", ".", "%")

#: A turn of these words alone is a backchannel.
BACKCHANNELS = ("yeah", "yes", "yep", "yup", "right", "okay", "ok", "sure", "mm", "mhm", "mm-hmm", "hmm", "uh-huh", "uh", "um", "oh", "wow")


def tokens(text: Column) -> Column:
    """White-space separated tokens; none for an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def non_space_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def normalize(token: Column) -> Column:
    """Lower case; word characters and hyphens only."""
    return F.regexp_replace(F.lower(token), r"(?U)[^\w-]", "")


#: Fixed value: a word that ends a sentence.
SENTENCE_END = r"""[.?!]["')\]]*$"""


def ends_sentence(word: Column) -> Column:
    return word.rlike(SENTENCE_END)


def last_words(text: Column, n: int) -> Column:
    """The last ``n`` tokens with single spaces."""
    t = tokens(text)
    return F.array_join(F.slice(t, F.greatest(F.size(t) - n + 1, F.lit(1)), F.lit(n)), " ")


def is_backchannel(text: Column, vocabulary: tuple[str, ...] = BACKCHANNELS) -> Column:
    """One token at least, and every token with a word character is in the vocabulary."""
    t = F.filter(F.transform(tokens(text), normalize), lambda x: x != "")
    return (F.size(t) > 0) & F.forall(t, lambda x: x.isin(*vocabulary))


def glues(word: Column, prefixes: tuple[str, ...] = GLUE_PREFIXES) -> Column:
    return F.substring(word, 1, 1).isin(*prefixes)


def to_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("int")


def clock(ms: Column) -> Column:
    """Minutes and seconds; minutes may exceed 59."""
    minutes, seconds = F.floor(ms / 60000), F.floor(ms / 1000) % 60
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat(two(minutes), F.lit(":"), two(seconds))


def rank_or_dash(rank: Column) -> Column:
    return F.coalesce(rank.cast("string"), F.lit("-"))


def snippet(text: Column, n: int = 140) -> Column:
    return F.substring(text, 1, n)
