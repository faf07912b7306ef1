"""Text helpers of the feature layer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
INTERROGATIVE, DECLARATIVE = "疑问句", "陈述句"
STRUCTURE_WORDS = ("who", "what", "when", "which", "how", "where", "whose")
WORD, TAIL = r"[\p{L}\p{N}]+", r"\p{Punct}$"


def stripped(text: Column) -> Column:
    """White space cut off at both ends, then one trailing ASCII punctuation mark."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), TAIL, "")


def sentence_pattern(text: Column) -> Column:
    """By the last character of the text as it stands, trailing blanks included."""
    return F.when(text.endswith("?"), INTERROGATIVE).otherwise(DECLARATIVE)


def contains_word(text: Column, word: Column) -> Column:
    """Whether a word occurs between word bounds, in any case."""
    literal = F.regexp_replace(word, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.rlike(text, F.concat(F.lit(r"(?iU)\b"), literal, F.lit(r"\b")))


def relation_name(rel: Column) -> Column:
    return F.replace(F.upper(rel), F.lit(":"), F.lit("_"))


def is_lower(word: Column) -> Column:
    """Whether a word has letters and none of them is a capital."""
    return (word == F.lower(word)) & (word != F.upper(word))
