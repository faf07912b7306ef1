"""Items: (name, value) pairs of strings, their class, and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of decision items besides those that contain ``QUESTION``.
DECISION_NAMES = ("SAME_QS_WORD", "SAME_DEPENDENCY", "DEPENDENCY_PATH")
ITEM = "struct<name:string,value:string>"


def item(name: Column | str, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value"))


def is_decision(name: Column) -> Column:
    """Whether an item of this name is about the answer (D) and not about the sentence (C)."""
    return name.contains("QUESTION") | name.isin(*DECISION_NAMES)


def kind(name: Column) -> Column:
    return F.when(is_decision(name), "D").otherwise("C")


def quoted(text: Column) -> Column:
    """A string as a Python literal: single quotes, or double ones where only single quotes occur inside."""
    body = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single, double = text.contains("'"), text.contains('"')
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .when(single, F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), body, F.lit("'")))
    )


def item_text(x: Column) -> Column:
    """The tuple form of an item: ``('NAME', 'value')``."""
    return F.concat(F.lit("("), quoted(x["name"]), F.lit(", "), quoted(x["value"]), F.lit(")"))


_LITERAL = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""


def parse_item(text: Column) -> Column:
    """The inverse of ``item_text``; null for other text."""
    pattern = rf"^\({_LITERAL}, {_LITERAL}\)$"

    def literal(group: int) -> Column:
        body = F.regexp_extract(text, pattern, group)
        body = F.substring(body, F.lit(2), F.length(body) - 2)
        for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')):
            body = F.regexp_replace(body, rf"(?<!\\)((?:\\\\)*)\{code}", "$1" + char)
        return F.replace(body, F.lit("\\\\"), F.lit("\\"))

    return F.when(text.rlike(pattern), F.struct(literal(1).alias("name"), literal(2).alias("value")))


def label(items: Column) -> Column:
    """Items as one sorted string, ``name=value|name=value``."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws("=", x["name"], x["value"])), "|")


def rounded(x: Column) -> Column:
    """A ratio as it is exported: ten decimals, half to even."""
    return F.bround(x.cast("decimal(38,30)"), 10)
