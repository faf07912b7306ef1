"""Self-join of documents on the Jaccard similarity of their word shingles, by chosen paths (operator 4).

A document is the set of its runs of five words (a shorter text: the run of all its words).
Equal sets are one *class representative* from the start. For each of several runs, a set follows
a path: at every node a hash function given by the path so far samples one shingle, the one with
the least value, and sets that sample the same shingle go on together. Two sets of similarity s
stay together with probability s at each step. A node of at most ``LEAF`` sets is a leaf; larger
ones split again, down to ``DEPTH`` steps, where whatever is left is a leaf too. Leaves are brute
forced, large ones as pairs of blocks bounded in sets and shingles. Runs are repeated until a pair at the
threshold shares a leaf with probability ``recall`` even at the greatest depth.

A pair is counted in one leaf only, the least that both sets are in, so links are exact counts
although pairs are never listed: each block reports, for each set, the number of documents linked
to it and the least set that it is connected with. Those connections are contracted to connected
components. Leaves with the same members are brute forced once.

Result: one row a document with ``class_id``, the least document id of its connected component,
and ``n_links``, the number of other documents at the threshold or above, copies included.

How many documents are linked to each of n different near copies takes n**2 / 2 comparisons, which
are shared out as pairs of blocks; a set goes to as many tasks as its leaf has blocks.

Defined results: a null text or one without words has no links and is its own class; a null
document id gets a large stand-in number made of its text, used for ``class_id`` where no member
has an id, and comes back as null; ids may be any 64-bit number; repeated rows are documents with
equal sets, of which ``keep_one`` keeps one; of equal ids the one whose text has the least hash
stands for its class; texts of any length are read whole; no rows give no rows. Columns other than
text and id are carried along by ``keep_one``, whatever their names, and not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import discard
from .shared import unused, written
from .words import mix, shingles, slices, words

SHINGLE = 5
DEPTH = 3
LEAF = 64
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20  # of a block, on average, at most
SMALL_BLOCK, FEW = 512, 16  # of the blocks of a leaf that has few of them, so that it is still shared out
TILE, CELLS = 512, 4 << 20  # sets compared with a block at once; places of a dense matrix
SPREAD = 16
SIMILARITY, RECALL = 0.8, 0.999


def runs_for(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """So many runs that a pair of this similarity shares a leaf with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row in ascending order, and n + 1 offsets of the rows."""
    every, at = shingles(*words(column), SHINGLE)
    parts = [np.unique(every[p:q]) for p, q in zip(at[:-1], at[1:])]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else every), np.concatenate(([0], np.cumsum(sizes)))


def paths_of(flat: np.ndarray, at: np.ndarray, runs: int) -> np.ndarray:
    """For each non-empty row and run, the nodes of its path: rows x runs x DEPTH."""
    rows = np.flatnonzero(np.diff(at) > 0)
    start, size = at[rows], np.diff(at)[rows]
    out = np.empty((len(rows), runs, DEPTH), np.uint64)
    if not len(rows):
        return out
    salt = mix(np.arange(1, runs + 1, dtype=np.uint64))
    for r in range(runs):
        # a function of its own for each node, and thus for each run: misses of runs are independent
        node = np.full(len(rows), salt[r])
        for d in range(DEPTH):
            least = np.minimum.reduceat((flat ^ np.repeat(node, size)) * np.repeat(mix(node) | np.uint64(1), size), start)
            node = mix(node ^ mix(least))
            out[:, r, d] = node
    return out


def _signatures(docs: DataFrame, runs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, at = sets_of(part.column(2))
                size, rows = np.diff(at), np.flatnonzero(np.diff(at) > 0)
                key = np.zeros((part.num_rows, 2), np.uint64)
                if len(rows):
                    key[rows, 0] = np.add.reduceat(mix(flat), at[rows])
                    key[rows, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x5BD1E995)), at[rows])
                raw, none = key.tobytes(), size == 0
                offsets = np.concatenate(([0], np.cumsum(np.where(none, 0, runs * DEPTH)))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "rid": part.column(0),
                    "th": part.column(1),
                    "known": part.column(3),
                    "n": pa.array(size, pa.int64()),
                    "key": pa.array([None if e else raw[16 * i : 16 * i + 16] for i, e in enumerate(none)], pa.binary()),
                    "paths": pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths_of(flat, at, runs).ravel().view(np.int64))),
                })

    return docs.mapInArrow(run, "rid long, th long, known boolean, n long, key binary, paths array<long>")


def _names(text: str, key: str) -> tuple[Column, Column]:
    """A number for each document id and a hash of each text; together they name a row up to repeats."""
    th = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(2**62) + F.shiftrightunsigned(th, 2)), th


def _identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    rid, th = _names(text, key)
    return docs.select(rid.alias("rid"), th.alias("th"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").isNotNull().alias("known"))


def _leaves(sets: DataFrame, runs: int, made: list[DataFrame]) -> DataFrame:
    """key, leaf, blocks: the leaves of two sets or more, one for each distinct group of members, and how many blocks they have."""

    def kept(df: DataFrame, what: str) -> DataFrame:
        made.append(written(df, what))
        return made[-1]

    node = F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(*(F.get("paths", r * DEPTH + d).alias(f"p{d}") for d in range(DEPTH)))))
    left = sets.select("key", "n", node.alias("x")).select("key", "n", *(f"x.p{d}" for d in range(DEPTH)))
    leaves = None
    for d in range(DEPTH):
        shared = left.groupBy(f"p{d}").agg(F.count("*").alias("size"), F.sum("n").alias("total")).filter("size > 1")
        # written, so that the join stands alone and Spark can split the sets of a node that very many share
        rows = kept(left.join(kept(shared, "node-sizes"), f"p{d}"), "join-nodes")
        own = rows if d == DEPTH - 1 else rows.filter(F.col("size") <= LEAF)
        shared_out = F.least(F.col("size") / SMALL_BLOCK, F.lit(float(FEW)))
        blocks = F.ceil(F.greatest(shared_out, F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
        own = own.select("key", F.col(f"p{d}").alias("leaf"), F.greatest(blocks, F.lit(1)).alias("blocks"))
        leaves = own if leaves is None else leaves.unionByName(own)
        left = rows.filter(F.col("size") > LEAF).drop("size", "total")
    members = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    once = members.groupBy("n", "a", "b").agg(F.min("leaf").alias("leaf")).select("leaf")
    return kept(leaves.join(kept(once, "leaves-once"), "leaf"), "join-members")


def _at_least(shared: np.ndarray, union: np.ndarray, similarity: float) -> np.ndarray:
    """shared / union >= similarity in whole numbers."""
    return shared * 1_000_000 >= union * round(similarity * 1_000_000)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of a with all of b."""
    if len(a) * len(b) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.int64)
    flat = np.concatenate((*a, *b))
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    use = n[place] > 1
    row, place = row[use], np.unique(place[use], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(a), len(b)), np.float64)
    step = max(64, CELLS // (len(a) + len(b)))
    last = int(place[-1]) + 1 if len(place) else 0
    for low in range(0, last, step):
        p, q = np.searchsorted(place, (low, low + step))
        dense = np.zeros((len(a) + len(b), step), np.float32)
        dense[row[p:q], place[p:q] - low] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return out.astype(np.int64)


class _Side:
    """Distinct members of a block."""

    def __init__(self, rows: list[tuple]):
        seen: dict[bytes, tuple] = {}
        for r in rows:
            seen.setdefault(r[0], r)
        self.rows = sorted(seen.values())
        self.keys = [r[0] for r in self.rows]
        self.sets = [np.frombuffer(r[3], np.uint64) for r in self.rows]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.weights = np.array([r[1] for r in self.rows], np.int64)
        most = max((len(r[2]) for r in self.rows), default=0)
        self.leaves = np.zeros((len(self.rows), most), np.int64)
        self.some = np.zeros((len(self.rows), most), bool)
        for i, r in enumerate(self.rows):
            self.leaves[i, : len(r[2])], self.some[i, : len(r[2])] = r[2], True


def _owned(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Of pairs, those whose least common leaf is this one."""
    out = np.ones(len(i), bool)
    for k in range(a.leaves.shape[1]):
        mine, known = a.leaves[i, k], a.some[i, k] & (a.leaves[i, k] < leaf)
        for m in range(b.leaves.shape[1]):
            out &= ~(known & b.some[j, m] & (b.leaves[j, m] == mine))
    return out


def links_in(leaf: int, left: list[tuple], right: list[tuple] | None, similarity: float) -> list[tuple[bytes, int, bytes]]:
    """For each set of a block pair (or of one block) with links: its linked documents, and the least set connected with it."""
    a = _Side(left)
    b = a if right is None else _Side(right)
    if not len(a.rows) or not len(b.rows):
        return []
    pairs = []
    for low in range(0, len(a.rows), TILE):
        shared = _overlaps(a.sets[low : low + TILE], b.sets)
        ok = _at_least(shared, a.sizes[low : low + TILE, None] + b.sizes[None, :] - shared, similarity)
        if right is None:
            ok = np.triu(ok, low + 1)
        i, j = np.nonzero(ok)
        i += low
        mine = _owned(a, b, i, j, leaf)
        pairs.append((i[mine].astype(np.int32), j[mine].astype(np.int32)))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    if not len(i):
        return []
    shift = 0 if right is None else len(a.rows)
    keys = a.keys if right is None else a.keys + b.keys
    links, label = np.zeros(len(keys), np.int64), np.array(sorted(range(len(keys)), key=keys.__getitem__))
    rank = np.empty(len(keys), np.int64)
    rank[label] = np.arange(len(keys))
    for low in range(0, len(i), CELLS):
        p, q = i[low : low + CELLS], j[low : low + CELLS]
        links += np.bincount(p, b.weights[q], len(keys)).astype(np.int64) + np.bincount(q + shift, a.weights[p], len(keys)).astype(np.int64)
    low = rank.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j + shift])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j + shift, least)
        if (before == low).all():
            break
    return [(keys[x], int(links[x]), keys[label[low[x]]]) for x in np.flatnonzero(links)]


def _verified(active: DataFrame, similarity: float) -> DataFrame:
    """key, links, root from all leaves; ``active``: key, w, leaves (leaf, blocks), shingles."""
    own = F.pmod(F.xxhash64("key"), F.col("g")).cast("int")
    rows = active.select("key", "w", F.transform("leaves", lambda x: x["leaf"]).alias("leaves"), "shingles", F.explode("leaves").alias("l"))
    rows = rows.select("key", "w", "leaves", "shingles", F.col("l.leaf").alias("leaf"), F.col("l.blocks").alias("g")).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("leaf", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "w", "leaves", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, out = None, [], []

        def flush() -> None:
            if len(rows) > 1:
                leaf, i, j = place
                if i == j:
                    out.extend(links_in(leaf, [r[1:] for r in rows], None, similarity))
                else:
                    out.extend(links_in(leaf, [r[1:] for r in rows if r[0] == i], [r[1:] for r in rows if r[0] == j], similarity))

        def taken() -> pa.RecordBatch:
            k, n, r = zip(*out)
            out.clear()
            return pa.RecordBatch.from_pydict({"key": pa.array(k, pa.binary()), "links": pa.array(n, pa.int64()), "root": pa.array(r, pa.binary())})

        for batch in batches:
            for part in slices(batch, "shingles"):
                for leaf, i, j, *rest in zip(*(c.to_pylist() for c in part.columns)):
                    if (leaf, i, j) != place:
                        flush()
                        place, rows = (leaf, i, j), []
                        if len(out) > 10_000:
                            yield taken()
                    rows.append(rest)
        flush()
        if out:
            yield taken()

    # the pairs of blocks of a leaf go to partitions side by side, so none gets many of one leaf before all have some
    n = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = F.col("i") * F.col("g") - F.floor(F.col("i") * (F.col("i") + 1) / 2) + F.col("j")
    dealt = rows.withColumn("part", F.pmod(F.pmod(F.xxhash64("leaf"), F.lit(n)) + pair, F.lit(n)).cast("int")).repartitionById(n, "part")
    dealt = dealt.select("leaf", "i", "j", "own", "key", "w", "leaves", "shingles")
    return dealt.sortWithinPartitions("leaf", "i", "j").mapInArrow(run, "key binary, links long, root binary")


def components(edges: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """u, p: for each node of ``edges`` (u, v) the least node of its connected component.

    Each round points every node at its least neighbour and contracts the graph along those
    pointers. Node names are hashes, so a constant share of nodes goes in each round; rounds are
    written, and read back in reverse to resolve the pointers.
    """
    spark = edges.sparkSession
    rounds: list[DataFrame] = []
    made = [] if made is None else made  # tables that can go once the result has been written
    left = written(edges.filter("u <> v").distinct(), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "pointers")
        rounds.append(point)
        made += [left, point]
        a, b = point.select("u", F.col("p").alias("pu")), point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = written(left.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).filter("u <> v").distinct(), "edges")
    made.append(left)
    if not rounds:
        return spark.createDataFrame([], "u binary, p binary")
    out = rounds[-1]
    for point in reversed(rounds[:-1]):
        later = out.select(F.col("u").alias("p"), F.col("p").alias("q"))
        out = point.join(later, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    return out


def _joined(docs: DataFrame, similarity: float, recall: float, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, th, known, key) of all documents, and key, class_rid, class_th, n_links of all sets."""
    runs, made = runs_for(similarity, recall), []
    rows = written(_signatures(_identified(docs, text, key), runs), "signatures")
    sets = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("rid", "th")).alias("rep"), F.count("*").alias("w"), F.any_value("n").alias("n"), F.any_value("paths").alias("paths"))
    sets = written(sets.select("key", "rep.rid", "rep.th", "w", "n", "paths"), "sets")
    made.append(sets)
    leaves = _leaves(sets, runs, made).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("leaf", "blocks"))).alias("leaves"))
    wanted = leaves.join(sets.select("key", "rid", "th", "w"), "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, at = sets_of(part.column(3))
                data = flat.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([data[8 * p : 8 * q] for p, q in zip(at, at[1:])], pa.binary())], names=["key", "w", "leaves", "shingles"])

    texts = _identified(docs, text, key).join(wanted.hint("shuffle_hash"), ["rid", "th"]).dropDuplicates(["rid", "th"]).select("key", "w", "leaves", "text")
    active = texts.mapInArrow(cut, "key binary, w long, leaves array<struct<leaf:long,blocks:int>>, shingles binary")
    found = written(_verified(active, similarity), "links")
    total = found.groupBy("key").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")), made).select(F.col("u").alias("key"), "p")
    # only linked sets need the least of their component; a component may be large, so its members are spread
    linked = written(sets.select("key", "rid", "th").join(root, "key"), "join-classes")
    # written, as else the rows of a component would stay together for the join, whatever their salt
    least = written(linked.groupBy("p").agg(F.min(F.struct("rid", "th")).alias("rep")), "component-least")
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int")).join(salted.hint("merge"), ["p", "salt"]).select("key", "rep")
    links = F.coalesce("links", F.lit(0)) + F.col("w") - 1
    classes = sets.select("key", "rid", "th", "w").join(named, "key", "left").join(total, "key", "left")
    classes = classes.select("key", F.coalesce("rep.rid", "rid").alias("class_rid"), F.coalesce("rep.th", "th").alias("class_th"), links.alias("n_links"))
    # written, so that the join with all rows stands alone and Spark can split the key of a large group of copies
    classes = written(classes, "set-classes")
    discard(*made, found, linked, least)
    return rows.select("rid", "th", "known", "key"), classes


def join_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    rows, classes = _joined(docs, similarity, recall, text, key)
    return rows.join(classes, "key", "left").select(
        F.when(F.col("known"), F.col("rid")).alias("doc_id"), F.coalesce("class_rid", "rid").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class, that of the least id; documents without words stay."""
    rows, classes = _joined(docs, similarity, recall, text, key)
    r, t, once = (unused(n, docs.columns) for n in ("_rid", "_th", "_once"))
    kept = classes.select(F.col("class_rid").alias(r), F.col("class_th").alias(t), F.lit(True).alias(once))
    kept = kept.unionByName(rows.filter("key is null").select(F.col("rid").alias(r), F.col("th").alias(t), F.lit(False).alias(once)))
    kept = written(kept.distinct(), "kept")
    rid, th = _names(text, key)
    left = docs.withColumns({r: rid, t: th}).join(kept.hint("shuffle_hash"), [r, t])
    own = [F.col(f"`{c}`") for c in docs.columns]
    once_each = rows.filter("key is not null").groupBy("rid", "th").count().filter("count > 1").isEmpty()
    discard(rows, classes)
    if once_each:
        return left.select(*own)
    return left.filter(F.col(once)).dropDuplicates([r, t]).unionByName(left.filter(~F.col(once))).select(*own)
