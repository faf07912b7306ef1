"""From raw questions to a training table and to cleaned query sentences, and one experiment over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import item_text, parse_item
from ..functions.text import stripped
from ..operators import evaluate, features, lookup, mining, paths, reshape
from ..sources import writers

POSITION = r"^(SENTENCE|QUESTION)_.*_\d+$"


def _sentences(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("id").alias("sent_id"), F.col("sentence").alias("text"))


def _parsed(sentences: DataFrame, parser) -> DataFrame:
    """Parsers get the sentence without its last punctuation mark; patterns are read off the whole one."""
    clean = sentences.select("sent_id", stripped(F.col("text")).alias("text"))
    return features.rule_tokens(clean) if parser is None else features.parse_with(clean, parser)


def training_long(questions: DataFrame, parser=None, float_positions: bool = False) -> DataFrame:
    """sent_id, name, value of questions (id, sentence, question_word).

    ``float_positions`` writes positions as ``1.0``, as a spreadsheet with empty cells gives them
    back: such items never meet those of query sentences.
    """
    sentences = _sentences(questions)
    tokens = _parsed(sentences, parser)
    gold = questions.select(F.col("id").alias("sent_id"), F.col("question_word").alias("word"))
    long = features.training_table(sentences, tokens, gold, paths.from_structure_word(sentences, tokens, gold))
    if float_positions:
        long = long.withColumn("value", F.when(F.col("name").rlike(POSITION), F.concat("value", F.lit(".0"))).otherwise(F.col("value")))
    return long


def training_wide(questions: DataFrame, parser=None) -> DataFrame:
    """One row a question, one column a feature; of several values of a feature the last in text order."""
    return reshape.pivot_last_wins(training_long(questions, parser).withColumn("ord", F.lit(0)), "sent_id")


def cleaned_queries(questions: DataFrame, parser=None, nested_keys: bool = False) -> DataFrame:
    """id, items, words: condition items of each sentence, and the words to which each decision item leads.

    ``nested_keys`` writes SAME_DEPENDENCY items as a tuple in a tuple, which no rule ever matches.
    """
    sentences = _sentences(questions)
    tokens = _parsed(sentences, parser)
    c, candidates = features.query_table(sentences, tokens, paths.from_structure_word(sentences, tokens))
    text = item_text(F.col("item"))
    if nested_keys:
        text = F.when(F.col("item.name") == "SAME_DEPENDENCY", F.concat(F.lit("("), text, F.lit(",)"))).otherwise(text)
    words = candidates.groupBy("sent_id", text.alias("key")).agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    words = words.groupBy("sent_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "words")))).alias("words"))
    return c.join(words, "sent_id", "left").select(F.col("sent_id").alias("id"), F.transform("c", item_text).alias("items"), "words")


def write_cleaned(cleaned: DataFrame, path: str) -> None:
    """Cleaned sentences as JSON lines."""
    cleaned.select(writers.cleaned_json(F.col("items"), F.col("words"), F.col("id")).alias("value")).write.mode("overwrite").text(path)


class Cleaner:
    """Turns raw questions into what mining or lookup reads. Subclasses give ``clean``; instances fit ``DataFrame.transform``."""

    def clean(self, questions: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, questions: DataFrame) -> DataFrame:
        return self.clean(questions)


class TrainCleaner(Cleaner):
    """Questions with their gold words to the wide training table; with ``strict`` a gold word outside its sentence fails the run."""

    def __init__(self, parser=None, strict: bool = False):
        self.parser, self.strict = parser, strict

    def clean(self, questions: DataFrame) -> DataFrame:
        if self.strict:
            gold = questions.select(F.col("id").alias("sent_id"), F.col("question_word").alias("word"))
            ok = features.validated_gold(_sentences(questions), gold, strict=True).filter("ok").select(F.col("sent_id").alias("id"))
            questions = questions.join(ok, "id", "left_semi")
        return training_wide(questions, self.parser)


class QueryCleaner(Cleaner):
    """Questions to cleaned query sentences."""

    def __init__(self, parser=None, nested_keys: bool = False):
        self.parser, self.nested_keys = parser, nested_keys

    def clean(self, questions: DataFrame) -> DataFrame:
        return cleaned_queries(questions, self.parser, self.nested_keys)


def query_frames(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences and candidates, as lookup takes them, from cleaned sentences; text that is no item is left out."""
    parsed = F.filter(F.transform("items", parse_item), lambda x: x.isNotNull())
    sentences = cleaned.select(F.col("id").alias("sent_id"), parsed.alias("c"))
    rows = cleaned.select(F.col("id").alias("sent_id"), F.explode("words").alias("key", "list")).select("sent_id", parse_item(F.col("key")).alias("item"), F.posexplode("list").alias("pos", "word"))
    return sentences, rows.filter("item is not null").select("sent_id", "item", "word", "pos")


def experiment(training: DataFrame, cleaned: DataFrame, gold: DataFrame, min_support: int, min_confidence: float, k: int) -> DataFrame:
    """k, total, correct, accuracy of rules mined from a long training table on cleaned sentences. ``gold``: sent_id, word."""
    transactions = reshape.from_long(training, "sent_id").filter((F.size("c") > 0) & (F.size("d") > 0))
    sentences, candidates = query_frames(cleaned)
    rules = mining.mine_rules(transactions, min_support, min_confidence)
    words = lookup.top_words(lookup.match_by_counting(sentences, rules), candidates, k)
    return evaluate.cumulative_accuracy(words, gold, k)


def tree_text(counts: DataFrame, limit: int = 1000) -> str:
    """Counted rules as an indented list by decision, for display; the first ``limit`` in order."""
    rows = counts.orderBy("decision", F.size("antecedent"), "antecedent").limit(limit).collect()
    lines, last = [], None
    for r in rows:
        if r.decision != last:
            last = r.decision
            lines.append(f"{last.name}={last.value}")
        lines.append("  " + ", ".join(f"{x.name}={x.value}" for x in r.antecedent) + f": {r.n_ad}")
    return "\n".join(lines)
