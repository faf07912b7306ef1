"""Features of sentences from their tokens.

``tokens`` is the boundary to any parser: sent_id, sub_sent, idx (from 1 in its sub-sentence),
text, lemma, xpos, head (0: root), deprel. Everything after it is made of Spark's own expressions.
``edges`` are sent_id, ord, rel (label and its occurrence), head, dep, the latter two as words.

What takes ``tokens`` also takes gathered ones: a row for each sentence with ``tokens`` as an array,
and the sentence's ``texts`` where they are needed. All features of a sentence follow from its row, so
rows of tokens are shuffled once, to be gathered, and ``rule_sentences`` gathers without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STRUCTURE_WORDS, WORD, contains_word, is_lower, relation_name, sentence_pattern

HOW_MANY, VERB = "How many", "VB"
TOKENS = "sent_id bigint, sub_sent int, idx int, text string, lemma string, xpos string, head int, deprel string"


def parse_with(sentences: DataFrame, parser: Callable) -> DataFrame:
    """Tokens by a parser of one's own: a function of an iterator of pandas frames (sent_id, text) to frames of TOKENS."""
    return sentences.select("sent_id", "text").mapInPandas(parser, TOKENS)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _rule_token(text: Column, i: Column) -> Column:
    low = F.lower(text)
    xpos = (
        F.when(low.isin("what", "who"), "WP").when(low == "whose", "WP$").when(low == "which", "WDT").when(low.isin("when", "how", "where"), "WRB")
        .when(low.endswith("ed"), "VBD").when(low.endswith("ing"), "VBG").when(text.rlike(r"^\p{N}+$"), "CD").when(text != low, "NNP").otherwise("NN")
    )
    rel = F.when(i == 0, "root").when(low.isin("the", "a", "an"), "det").when(F.length(text) % 3 == 0, "nsubj").when(F.length(text) % 3 == 1, "obl:npmod").otherwise("amod")
    return F.struct(F.lit(1).alias("sub_sent"), (i + 1).alias("idx"), text.alias("text"), low.alias("lemma"), xpos.alias("xpos"), i.alias("head"), rel.alias("deprel"))


def rule_tokens(sentences: DataFrame) -> DataFrame:
    """Tokens by fixed rules, a stand-in where no parser is at hand: words are runs of letters and digits, each hangs on the one before.

    Tags follow from spelling alone; this is no linguistic analysis.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return sentences.select("sent_id", F.posexplode(words).alias("i", "text")).select("sent_id", _rule_token(F.col("text"), F.col("i")).alias("t")).select("sent_id", "t.*")


def rule_sentences(sentences: DataFrame, repeated: bool) -> DataFrame:
    """sent_id, texts, tokens: those of ``rule_tokens``, gathered. Only where ids are ``repeated`` is there anything to shuffle."""
    rows = sentences.groupBy("sent_id").agg(F.sort_array(F.collect_list("text")).alias("texts")) if repeated else sentences.select("sent_id", F.array("text").alias("texts"))
    cut = lambda text: F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _rule_token)
    found = F.sort_array(F.flatten(F.transform("texts", cut))) if repeated else cut(F.col("texts")[0])
    return rows.withColumn("tokens", found)


def gathered(tokens: DataFrame, sentences: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    """sent_id, tokens (in order) and, of ``sentences`` and ``gold`` (sent_id, word), ``texts`` and ``gold`` as arrays; gathered rows stay as they are."""
    if "tokens" in tokens.columns:
        return tokens
    names = [c.split()[0] for c in TOKENS.split(", ")[1:]]
    rows = tokens.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("tokens"))
    for more, column, name in ((sentences, "text", "texts"), (gold, "word", "gold")):
        if more is not None:
            rows = rows.join(more.groupBy("sent_id").agg(F.sort_array(F.collect_list(column)).alias(name)), "sent_id", "left")
            rows = rows.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return rows


def edges_of(tokens: Column) -> Column:
    """The edges of a sentence's tokens in order: ord, rel, head, dep."""

    def numbered(ts: Column) -> Column:
        labels = F.array_distinct(F.transform(ts, lambda t: t["deprel"]))
        placed = F.transform(ts, lambda t, i: F.struct((i + 1).alias("ord"), t.alias("t")))
        one = lambda xs: F.transform(xs, lambda x, k: F.struct(x["ord"].alias("ord"), F.concat(x["t"]["deprel"], F.lit("_"), k.cast("string")).alias("rel"), x["t"].alias("t")))
        return _let(placed, lambda ps: F.sort_array(F.flatten(F.transform(labels, lambda d: one(F.filter(ps, lambda x: x["t"]["deprel"].eqNullSafe(d)))))))

    def edge(x: Column, head: Column) -> Column:
        t = x["t"]
        return F.struct(x["ord"].alias("ord"), x["rel"].alias("rel"), F.coalesce(head, t["text"]).alias("head"), t["text"].alias("dep"))

    def follows(t: Column, last: Column) -> Column:
        return F.coalesce(t["idx"] == F.when(t["sub_sent"] == last["sub_sent"], last["idx"] + 1).otherwise(1), F.lit(False))

    def linked(ts: Column) -> Column:
        # where words are numbered without gaps the head lies that many places away; else it is looked for, as often as it comes
        even = ~F.array_contains(F.transform(ts, lambda t, i: follows(t, F.get(ts, i - 1))), False)
        near = lambda x, i: F.get(ts, i - x["t"]["idx"] + x["t"]["head"])
        is_head = lambda x, u: (u["sub_sent"] == x["t"]["sub_sent"]) & (u["idx"] == x["t"]["head"])
        direct = lambda xs: F.transform(xs, lambda x, i: edge(x, _let(near(x, i), lambda u: F.when(is_head(x, u), u["text"]))))
        found = lambda x: _let(F.filter(ts, lambda u: is_head(x, u)), lambda us: F.when(F.size(us) > 0, F.transform(us, lambda u: edge(x, u["text"]))).otherwise(F.array(edge(x, F.lit(None)))))
        return _let(numbered(ts), lambda xs: F.when(even, direct(xs)).otherwise(F.flatten(F.transform(xs, found))))

    return _let(tokens, linked)


def structure_of(tokens: Column) -> Column:
    """word, pos, rule of a sentence's tokens, see ``structure_word``; null where no rule hits."""
    shape = lambda word, pos, rule: F.struct(word.alias("word"), pos.alias("pos"), F.lit(rule).alias("rule"))

    def choice(ts: Column) -> Column:
        def first(rule: int, condition: Callable[[Column], Column]) -> Column:
            return _let(F.get(F.filter(ts, condition), F.lit(0)), lambda t: F.when(t.isNotNull(), shape(t["text"], t["xpos"], rule)))

        said = lambda i, word: F.exists(ts, lambda t: (t["idx"] == i) & (F.lower(t["text"]) == word))
        start = F.get(F.filter(ts, lambda t: t["idx"] == 1), F.lit(0))["xpos"]
        return F.coalesce(
            first(1, lambda t: (t["idx"] == 1) & t["xpos"].startswith("VB")),
            F.when(said(1, "how") & said(2, "many"), shape(F.lit(HOW_MANY), start, 2)),
            first(3, lambda t: F.lower(t["text"]).isin(*STRUCTURE_WORDS)),
            first(4, lambda t: t["xpos"].startswith("V")),
            first(5, lambda t: is_lower(t["text"])),
        )

    def chosen(ts: Column) -> Column:
        parts = F.array_distinct(F.transform(ts, lambda t: t["sub_sent"]))
        each = F.transform(parts, lambda p: _let(F.filter(ts, lambda t: t["sub_sent"] == p), choice))
        return F.get(F.filter(each, lambda c: c.isNotNull()), F.lit(0))

    return _let(tokens, chosen)


def edges(tokens: DataFrame) -> DataFrame:
    """sent_id, ord, rel, head, dep: labels numbered from 0 in word order over the whole text; a root is its own head."""
    ts = F.when(F.col("sent_id").isNotNull(), F.col("tokens")).otherwise(F.transform("tokens", lambda t: t.withField("head", F.lit(None).cast("int"))))  # without an id no token has a head
    return gathered(tokens).select("sent_id", F.inline(edges_of(ts)))


def structure_word(tokens: DataFrame, strict: bool = False) -> DataFrame:
    """sent_id, word, pos, rule: the first rule that hits, over all rules of one sub-sentence before the next.

    1 the first token is a verb; 2 ``how many``; 3 the first interrogative; 4 the first verb; 5 the
    first word in small letters. Where none hits, word is null, or the run fails if ``strict``.
    """
    out = gathered(tokens).filter(F.size("tokens") > 0).select("sent_id", structure_of(F.col("tokens")).alias("c"))
    word = F.col("c.word")
    if strict:
        word = F.when(word.isNotNull(), word).otherwise(F.raise_error(F.lit("a sentence has no structure word")).cast("string"))
    return out.select("sent_id", word.alias("word"), "c.pos", "c.rule")


def answer_of(tokens: Column, gold: Column) -> Column:
    """word, pos of the first token that is one of the gold words, see ``question_word``; null if there is none."""

    def found(ts: Column, low: Column) -> Column:
        hit = F.get(F.filter(ts, lambda t: F.array_contains(low, F.lower(t["text"])) | F.array_contains(low, t["lemma"])), F.lit(0))
        return _let(hit, lambda t: F.when(t.isNotNull(), F.struct(F.when(F.array_contains(low, F.lower(t["text"])), t["text"]).otherwise(t["lemma"]).alias("word"), t["xpos"].alias("pos"))))

    return _let(tokens, lambda ts: _let(F.transform(gold, F.lower), lambda low: found(ts, low)))


def question_word(tokens: DataFrame, gold: DataFrame, strict: bool = False) -> DataFrame:
    """sent_id, word, pos: the first token whose text or lemma is the gold word, ignoring case; null if there is none.

    With ``strict`` the run fails on a sentence that has no such token.
    """
    asked = gold.groupBy("sent_id").agg(F.collect_list("word").alias("gold"), F.count("*").alias("_n"))
    found = asked.join(gathered(tokens).select("sent_id", "tokens"), "sent_id", "left").select("sent_id", answer_of(F.col("tokens"), F.col("gold")).alias("q"), "_n")
    word = F.col("q.word")
    if strict:
        word = F.when(word.isNotNull(), word).otherwise(F.raise_error(F.lit("a gold word is no token of its sentence")).cast("string"))
    return found.select("sent_id", word.alias("word"), "q.pos", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_n")).drop("_n")


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` (text, word) and ok: whether the word occurs in the text as a word."""
    return rows.withColumn("ok", contains_word(F.col("text"), F.col("word")))


def validated_gold(sentences: DataFrame, gold: DataFrame, strict: bool = False) -> DataFrame:
    """sent_id, text, word, ok: whether the gold word occurs in its sentence as a word.

    With ``strict`` the run fails on a sentence without a gold word, a gold word without its
    sentence, and one that does not occur in it.
    """
    if not strict:
        return checked(sentences.join(gold, "sent_id"))
    both = sentences.join(gold, "sent_id", "full")
    ok = F.coalesce(contains_word(F.col("text"), F.col("word")), F.lit(False))
    return both.withColumn("ok", F.when(ok, ok).otherwise(F.raise_error(F.concat(F.lit("no gold word in sentence "), F.col("sent_id").cast("string"))).cast("boolean")))


def words_pos(tokens: DataFrame) -> DataFrame:
    """sent_id, words: the tokens of each sentence in order, as (word, pos)."""
    return gathered(tokens).select("sent_id", F.transform("tokens", lambda t: F.struct(t["text"].alias("word"), t["xpos"].alias("pos"))).alias("words"))


def dependencies(edges_: DataFrame) -> DataFrame:
    """sent_id, edges: the edges of each sentence in order, as (rel, head, dep)."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "rel", "head", "dep")))
    return edges_.groupBy("sent_id").agg(F.transform(ordered, lambda e: F.struct(e["rel"].alias("rel"), e["head"].alias("head"), e["dep"].alias("dep"))).alias("edges"))


def edge_positions(edges_: DataFrame, words: DataFrame, prefix: str) -> DataFrame:
    """sent_id, ord, name, value: for each edge that has the sentence's word, prefix + label, and ``1`` if the word is the head, else ``2``."""
    hit = edges_.join(words.select("sent_id", F.col("word").alias("_w")), "sent_id").filter((F.col("head") == F.col("_w")) | (F.col("dep") == F.col("_w")))
    return hit.select("sent_id", "ord", F.concat(F.lit(prefix), relation_name(F.col("rel"))).alias("name"), F.when(F.col("head") == F.col("_w"), "1").otherwise("2").alias("value"))


def direct_dependency(edges_: DataFrame, pairs: DataFrame) -> DataFrame:
    """sent_id, q, ord, value for edges between structure word s and question word q (``pairs``: sent_id, s, q).

    ``REL_n_1`` if q is the head, ``REL_n_2`` if it is the dependent; an edge of q with itself gives both if q = s.
    """
    hit = edges_.join(pairs, "sent_id")
    heads, deps = (F.col("q") == F.col("head")) & (F.col("s") == F.col("dep")), (F.col("q") == F.col("dep")) & (F.col("s") == F.col("head"))
    values = F.filter(F.array(F.when(heads, F.concat(relation_name(F.col("rel")), F.lit("_1"))), F.when(deps, F.concat(relation_name(F.col("rel")), F.lit("_2")))), lambda x: x.isNotNull())
    return hit.filter(heads | deps).select("sent_id", "q", "ord", F.explode(values).alias("value"))


def located(word: Column) -> Column:
    """The word as it stands in the edges: ``How many`` is looked up as ``How``."""
    return F.when(word == HOW_MANY, "How").otherwise(word)


def shown(word: Column, pos: Column, text: Column) -> Column:
    """The structure word as a feature: ``VB`` for verbs of declarative sentences and for base forms."""
    plain = ~F.lower(word).isin(*STRUCTURE_WORDS, HOW_MANY.lower())
    return F.when((pos == VERB) | (pos.contains("V") & plain & ~text.endswith("?")), VERB).otherwise(word)


def positions_of(edges_: Column, word: Column, prefix: str) -> Column:
    """ord, name, value of ``edge_positions`` in a sentence's edges."""
    shape = lambda e, w: F.struct(e["ord"].alias("ord"), F.concat(F.lit(prefix), relation_name(e["rel"])).alias("name"), F.when(e["head"] == w, "1").otherwise("2").alias("value"))
    return _let(word, lambda w: F.transform(F.filter(edges_, lambda e: (e["head"] == w) | (e["dep"] == w)), lambda e: shape(e, w)))


def directs_of(edges_: Column, s: Column) -> Column:
    """q, ord, value of ``direct_dependency`` in a sentence's edges, for all words q."""
    one = lambda e, q, other, end, s: F.when(e[other] == s, F.struct(e[q].alias("q"), e["ord"].alias("ord"), F.concat(relation_name(e["rel"]), F.lit(end)).alias("value")))
    both = lambda s: F.transform(F.filter(edges_, lambda e: (e["head"] == s) | (e["dep"] == s)), lambda e: F.array(one(e, "head", "dep", "_1", s), one(e, "dep", "head", "_2", s)))
    return F.filter(F.flatten(_let(s, both)), lambda x: x.isNotNull())


def _cell(name: Column | str, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.alias("value"))


def _once(xs: Column) -> Column:
    """Structs in order, each once."""
    return _let(F.sort_array(xs), lambda ys: F.filter(ys, lambda y, i: (i == 0) | ~y.eqNullSafe(F.get(ys, i - 1))))


def conditions_of(texts: Column, edges_: Column, structure: Column) -> Column:
    """name, value of ``condition_features`` of a sentence."""

    def cells(st: Column) -> Column:
        word, pos = st["word"], st["pos"]
        own = F.transform(texts, lambda text: F.array(_cell("SENTENCE_PATTERN", sentence_pattern(text)), _cell("SENTENCE_STRUCTURE_WORD", shown(word, pos, text)), _cell("SENTENCE_STRUCTURE_WORD_POS", pos)))
        places = F.transform(positions_of(edges_, located(word), "SENTENCE_"), lambda x: _cell(x["name"], x["value"]))
        # without a text there is no sentence; its edges count all the same, as in a table of edges
        return F.when(word.isNotNull(), F.concat(F.flatten(own), places)).otherwise(F.array().cast("array<struct<name:string,value:string>>"))

    return _let(structure, cells)


def decisions_of(edges_: Column, s: Column, words: Column, every: bool) -> Column:
    """word, name, value, each once, of ``decision_features`` of a sentence without paths. ``words``: (word, pos); ``every``: all of the sentence."""
    row = lambda word, name, value: F.struct(word.alias("word"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.alias("value"))
    asked = (lambda q: q.isNotNull()) if every else (lambda q: F.exists(words, lambda w: w["word"] == q))
    same = F.transform(F.filter(words, lambda w: w["word"] == s), lambda w: row(w["word"], "SAME_QS_WORD", F.lit("True")))
    direct = F.transform(F.filter(directs_of(edges_, s), lambda x: asked(x["q"])), lambda x: row(x["q"], "SAME_DEPENDENCY", x["value"]))
    own = F.flatten(F.transform(words, lambda w: F.array(row(w["word"], "QUESTION_WORD", w["word"]), row(w["word"], "QUESTION_WORD_POS", w["pos"]))))
    name = lambda e: F.concat(F.lit("QUESTION_"), relation_name(e["rel"]))
    ends = lambda e: F.array(F.when(asked(e["head"]), row(e["head"], name(e), F.lit("1"))), F.when((e["dep"] != e["head"]) & asked(e["dep"]), row(e["dep"], name(e), F.lit("2"))))
    places = F.flatten(F.transform(edges_, ends))
    return _once(F.filter(F.concat(same, direct, own, places), lambda x: x["word"].isNotNull() & x["value"].isNotNull()))


def condition_features(rows: DataFrame) -> DataFrame:
    """sent_id, name, value of gathered sentences: what is known of each without its question word; nothing where it has no structure word."""
    cells = _let(F.col("tokens"), lambda ts: conditions_of(F.col("texts"), edges_of(ts), structure_of(ts)))
    return rows.select("sent_id", F.inline(cells))


def training_table(sentences: DataFrame | None, tokens: DataFrame, gold: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """sent_id, name, value: all features of sentences whose gold word is known. ``paths``: sent_id, word, path.

    Gathered tokens bring ``texts`` and ``gold`` with them.
    """
    rows = gathered(tokens, sentences, gold)

    def cells(ts: Column, es: Column, st: Column) -> Column:
        words = F.filter(F.array(answer_of(ts, F.col("gold"))), lambda w: w["word"].isNotNull())
        decisions = _let(words, lambda ws: decisions_of(es, st["word"], ws, every=False))
        return F.concat(conditions_of(F.col("texts"), es, st), F.transform(decisions, lambda x: _cell(x["name"], x["value"])))

    out = rows.select("sent_id", F.inline(_let(F.col("tokens"), lambda ts: _let(edges_of(ts), lambda es: _let(structure_of(ts), lambda st: cells(ts, es, st))))))
    if paths is not None:  # each path comes once as it is, and is long: it need not be shuffled to see that
        out = out.unionByName(paths.filter("path is not null").select("sent_id", F.lit("DEPENDENCY_PATH").alias("name"), F.col("path").alias("value")))
    return out


def query_table(sentences: DataFrame | None, tokens: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sentences (sent_id, c) and candidates (sent_id, item, word, pos) in which every token may be the answer.

    ``paths``: sent_id, word, pos, path. Gathered tokens bring ``texts`` with them.
    """
    rows = gathered(tokens, sentences)
    c = _let(F.col("tokens"), lambda ts: _once(conditions_of(F.col("texts"), edges_of(ts), structure_of(ts))))
    known = rows.select("sent_id", c.alias("c")).filter(F.size("c") > 0)

    def cells(ts: Column) -> Column:
        # a repeated word keeps each of its tags
        tagged = F.transform(ts, lambda t: F.struct(t["text"].alias("word"), t["xpos"].alias("pos")))
        found = _let(edges_of(ts), lambda es: _let(structure_of(ts), lambda st: _let(tagged, lambda ws: decisions_of(es, st["word"], ws, every=True))))
        at = lambda texts, word: _let(F.get(ts, (F.array_position(texts, word) - 1).cast("int")), lambda t: F.struct(t["sub_sent"].alias("sub_sent"), t["idx"].alias("idx")))
        return _let(F.transform(ts, lambda t: t["text"]), lambda texts: F.transform(found, lambda x: F.struct(_cell(x["name"], x["value"]).alias("item"), x["word"].alias("word"), at(texts, x["word"]).alias("pos"))))

    out = rows.select("sent_id", F.inline(_let(F.col("tokens"), cells)))
    if paths is not None:
        out = out.unionByName(paths.filter("path is not null").select("sent_id", _cell("DEPENDENCY_PATH", F.col("path")).alias("item"), "word", "pos"))
    return known, out
