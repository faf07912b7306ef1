"""All shortest simple paths between words of a dependency graph.

Nodes are word texts, so repeated words are one node; every edge can be walked both ways. The
edges of one sentence lie in one row (a sentence is small) and are searched breadth first,
a batch of sentences at a time. There may be very many paths between two words (each of several
parallel edges gives its own): they are walked one by one and handed on in batches, and
``path_graph`` gives, instead of the paths, the edges that they are made of and their number.

Nulls: an edge without a head or dependent, and a pair without a source, are left out. Repeated
edges are edges of their own; repeated pairs count once; sentences without edges have no paths.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features

#: Fixed format: a step is the relation, a full-width colon and the direction.
JOINT, FORTH, BACK = " --> ", "-->", "<--"
#: Paths of a batch that are handed on at once.
BATCH = 10_000


def _layers(edges: list[tuple[str, str, str]], source: str, target: str | None) -> tuple[dict[str, int], dict[str, list[tuple[str, str, str]]]]:
    """Distances from the source (up to the target's), in the order in which nodes are met, and the steps of each node, there and back."""
    graph: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
    for rel, head, dep in edges:
        if head is not None and dep is not None:
            forth, back = f"[{rel}：{FORTH}]", f"[{rel}：{BACK}]"
            graph[head].append((dep, forth, back))
            graph[dep].append((head, back, forth))
    far, layer = {source: 0}, [source]
    while layer and target not in far:
        later = []
        for node in layer:
            for other, _, _ in graph.get(node, ()):
                if other not in far:
                    far[other] = far[node] + 1
                    later.append(other)
        layer = later
    return far, graph


def _walks(far: dict[str, int], graph: dict[str, list[tuple[str, str, str]]], source: str, target: str) -> Iterator[str]:
    """The shortest paths to one node as text, one after the other; memory is bounded by the graph."""
    leads, todo = {target}, [target]  # nodes on the way
    while todo:
        node = todo.pop()
        for other, _, _ in graph.get(node, ()):
            if far.get(other, -2) == far[node] - 1 and other not in leads:
                leads.add(other)
                todo.append(other)
    path: list[str] = []
    at = [iter(graph.get(source, ()))]
    node_far = [0]
    while at:
        for other, step, _ in at[-1]:
            if other in leads and far[other] == node_far[-1] + 1:
                if other == target:
                    yield JOINT.join([*path, step])
                    continue
                path.append(step)
                at.append(iter(graph[other]))
                node_far.append(far[other])
                break
        else:
            at.pop()
            node_far.pop()
            if path:
                path.pop()


def walked(edges: list[tuple[str, str, str]], source: str, target: str | None = None) -> Iterator[tuple[str, str]]:
    """(node, path) of all shortest paths from ``source``, to ``target`` or to each other node that can be reached."""
    far, graph = _layers(edges, source, target)
    for node in far if target is None else (n for n in far if n == target):
        if node != source:
            for path in _walks(far, graph, source, node):
                yield node, path


def shortest(edges: list[tuple[str, str, str]], source: str, target: str | None = None) -> dict[str, list[str]]:
    """The same, gathered by node."""
    out: dict[str, list[str]] = {}
    for node, path in walked(edges, source, target):
        out.setdefault(node, []).append(path)
    return out


def graph_of(edges: list[tuple[str, str, str]], source: str) -> Iterator[tuple[str, str, str, int, float]]:
    """(node, before, step, steps from the source, number of shortest paths to the node) for each edge that ends a shortest path."""
    far, graph = _layers(edges, source, None)
    number = {source: 1.0}
    for node in far:  # by distance
        if node != source:
            steps = far[node]
            before = [(other, step) for other, _, step in graph[node] if far[other] == steps - 1]
            number[node] = n = sum(number[other] for other, _ in before)
            for other, step in before:
                yield node, other, step, steps, n


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """sent_id, source, target, ord, path for ``pairs`` (sent_id, source, target; a null target: all other words).

    A target equal to the source has no rows; nor has one that cannot be reached.
    """
    return paths_in(_packed(edges, pairs)).drop("pos")


def paths_in(ready: DataFrame) -> DataFrame:
    """The same and pos (sub_sent, idx), where the target comes first, of gathered sentences: sent_id, tokens, pairs. Nothing is shuffled."""

    def rows(triples: list, places: dict, source: str, target: str | None) -> Iterator[tuple]:
        last, i = None, 0
        for node, path in walked(triples, source, target):
            i = i + 1 if node == last else 0
            last = node
            yield source, node, i, path, *places.get(node, (None, None))

    found = _searched(ready, rows, "source string, target string, ord long, path string, sub_sent int, idx int")
    return found.select("sent_id", "source", "target", "ord", "path", F.struct("sub_sent", "idx").alias("pos"))


def path_graph(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """sent_id, source, node, before, step, steps, n_paths: the last edges of all shortest paths from each source.

    Following ``before`` back to the source lists the paths; there are ``n_paths`` (as a double) to
    a node. As many rows as edges at most, however many paths they make. ``pairs``: sent_id, source.
    """
    return graph_in(_packed(edges, pairs.select("sent_id", "source", F.lit(None).cast("string").alias("target"))))


def graph_in(ready: DataFrame) -> DataFrame:
    """The same of gathered sentences: sent_id, tokens, pairs, with null targets."""

    def rows(triples: list, places: dict, source: str, target: str | None) -> Iterator[tuple]:
        for row in graph_of(triples, source):
            yield source, *row

    return _searched(ready, rows, "source string, node string, before string, step string, steps long, n_paths double")


def _packed(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """sent_id, edges, pairs of tables of them; the places of words are not known."""
    packed = edges.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rel", "head", "dep"))).alias("edges"))
    wanted = pairs.filter("source is not null").groupBy("sent_id").agg(F.collect_set(F.struct("source", "target")).alias("pairs"))
    return wanted.join(packed, "sent_id").select("sent_id", "edges", "pairs")


def linked(tokens: list[tuple]) -> tuple[list[tuple[str, str, str]], dict[str, tuple[int, int]]]:
    """(rel, head, dep) as ``features.edges`` has them, of (sub_sent, idx, text, head, deprel) in order, and where each word comes first."""
    at: dict[tuple, list[str]] = defaultdict(list)
    places: dict[str, tuple[int, int]] = {}
    for sub, idx, text, _, _ in tokens:
        at[sub, idx].append(text)
        places.setdefault(text, (sub, idx))
    seen: dict[str, int] = defaultdict(int)
    triples = []
    for sub, _, text, head, label in tokens:
        rel = None if label is None else f"{label}_{seen[label]}"
        seen[label] += 1
        for other in (sub is not None and head is not None and at.get((sub, head))) or (text,):
            triples.append((rel, text if other is None else other, text))
    return triples, places


def _lists(column: pa.ListArray, names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The structs of each row as tuples of some of their fields, field by field, which costs a fraction of dicts."""
    held = column.flatten()
    values, at = list(zip(*(held.field(n).to_pylist() for n in names))), 0
    for n in pc.list_value_length(column).to_pylist():
        yield values[at : at + (n or 0)]
        at += n or 0


def _searched(ready: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """sent_id and the columns that ``rows`` gives for each pair of a sentence, whose edges are given or follow from its tokens."""
    names = ["sent_id", *(c.split()[0] for c in schema.split(", "))]
    given = "edges" in ready.columns
    fields = ("rel", "head", "dep") if given else ("sub_sent", "idx", "text", "head", "deprel")
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [pa.int64(), *(arrow[c.split()[1]] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        for batch in batches:
            sents, found, asked = batch.columns
            for sent, ts, ps in zip(sents.to_pylist(), _lists(found, fields), _lists(asked, ("source", "target"))):
                triples, places = (ts, {}) if given else linked(ts)
                for source, target in ps:
                    for row in rows(triples, places, source, target):
                        out.append((sent, *row))
                        if len(out) >= BATCH:
                            yield taken()
        if out:
            yield taken()

    return ready.select("sent_id", "edges" if given else "tokens", "pairs").mapInArrow(run, f"sent_id long, {schema}")


def by_sentence(found: DataFrame) -> DataFrame:
    """sent_id, paths: the paths of each sentence in one array, in text order."""
    return found.groupBy("sent_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def start_of(word: Column, text: Column) -> Column:
    """Where the paths of a sentence start: its structure word; ``How many`` at ``How``, or at ``how`` where the text has no ``How``."""
    return F.when((word == features.HOW_MANY) & ~text.contains("How"), "how").otherwise(features.located(word))


def starts(rows: DataFrame, to: Column | None = None) -> DataFrame:
    """sent_id, tokens, pairs of gathered sentences: from the structure word to each word of the array ``to``, or to all if there is none; without a structure word no pairs."""
    targets = F.array(F.lit(None).cast("string")) if to is None else to
    ready = rows.select("sent_id", "texts", "tokens", features.structure_of(F.col("tokens"))["word"].alias("word"), targets.alias("targets"))
    pairs = F.transform("texts", lambda text: F.transform("targets", lambda t: F.struct(start_of(F.col("word"), text).alias("source"), t.alias("target"))))
    return ready.filter("word is not null").select("sent_id", "tokens", F.array_distinct(F.filter(F.flatten(pairs), lambda p: p["source"].isNotNull())).alias("pairs"))


def from_structure_word(sentences: DataFrame | None, tokens: DataFrame, gold: DataFrame | None = None, to: Column | None = None) -> DataFrame:
    """sent_id, word, pos, path: the paths from the structure word to the gold word, or to every other word if there is no ``gold``.

    Of gathered tokens, which bring ``texts``, to each word of the array ``to``.
    """
    rows = features.gathered(tokens, sentences, gold)
    found = paths_in(starts(rows, F.col("gold") if gold is not None else to))
    return found.select("sent_id", F.col("target").alias("word"), "pos", "path")
