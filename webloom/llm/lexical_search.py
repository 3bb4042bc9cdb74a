"""Ranked lexical search: the best documents of each item by a weighted score
of shared terms, found by branch and bound over document FP-trees.

1. Every text becomes its term count n and its vector (term, tf), restricted to
   the terms of the items: one pass, written once.  N, L and the document
   frequencies are Spark aggregates over that table.
2. A task reads vectors in blocks of at most BLOCK_ENTRIES entries.  Within a
   block, vectors ordered by frequency (most frequent term first) are sorted, so
   that equal beginnings lie together: the branching nodes of their trie.  A
   node knows, for each term below it, the largest tf, and the smallest m.
3. For each item the tree is searched depth first.  The score that the maxima
   would give at the smallest m bounds every document below a node, since a
   score grows with tf and falls with m; nodes below the item's k-th best score
   so far are left.  Items walk together: a node is visited with those items
   that still need it, and with those of their terms that occur below it.
   Documents reached are scored exactly.  The k best of a task go on, and Spark
   merges them in two levels.

Nothing is dropped: a bound equal to the k-th score is followed (ties go to the
smaller id).  Items are taken in blocks of about ITEM_TERMS terms (each block a
pass over the texts), so what is broadcast is bounded.

Defined results: a null or empty text has no term and is no document (N, L);
an item without terms, or whose terms no document holds, has no rows; rows that
repeat an item (same id and text) are one item, items that share an id and
differ in text are ranked apart under that id; repeated document rows are
documents each; a null doc_id comes after all others in a tie.  Empty tables
give an empty result.  Only the named columns are read, whatever the others are
called.  Texts are cut into terms in parts of 4 MB at a border of terms.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import Scratch, lean

#: Terms (with repeats) of the items that are searched in one pass.
ITEM_TERMS = 1_000_000
#: Entries of vectors in one tree, and documents below which a node is not split.
BLOCK_ENTRIES, LEAF = 1_500_000, 12
PART_BYTES = 4 << 20
SALTS = 256

#: Maps every byte that is part of no term to a space, and A-Z to a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, part by part."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PART_BYTES else text.find(b" ", at + PART_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + 75 * n * n_docs // n_terms


def gain(tf: np.ndarray, m) -> np.ndarray:
    """What one occurrence of a term in an item brings, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def vectors(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, tids, tfs of every text with a term; ``vocabulary``: a
    broadcast dict from term to number."""
    def run(batches):
        known = vocabulary.value.get
        for batch in batches:
            rows = ([], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n = Counter(), 0
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    found.update(map(known, part))
                found.pop(None, None)
                if n:
                    for to, value in zip(rows, (doc_id, n, list(found), list(found.values())), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int32())),
                 pa.array(rows[3], pa.list_(pa.int64()))], names=["doc_id", "n", "tids", "tfs"])

    return (docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary"))
            .mapInArrow(lean(run), "doc_id long, n long, tids array<int>, tfs array<long>"))


class Items:
    """Term lists of items, flat: positions (0: the most frequent term), how
    often the item has the term, and where each item begins."""

    def __init__(self, numbers: np.ndarray, places: np.ndarray, times: np.ndarray, starts: np.ndarray) -> None:
        self.numbers, self.places, self.times, self.starts = numbers, places, times, starts

    def sums(self, value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(value[self.places] * self.times, self.starts)

    def where(self, keep: np.ndarray, present: np.ndarray) -> Items:
        """The items of ``keep``, without terms that are not ``present``."""
        counts = np.diff(np.append(self.starts, len(self.places)))
        entries = np.repeat(keep, counts) & present[self.places]
        owner = np.repeat(np.arange(len(counts)), counts)[entries]
        left = np.bincount(owner, minlength=len(counts))
        left = left[left > 0]
        return Items(self.numbers[np.unique(owner)], self.places[entries], self.times[entries],
                     np.concatenate(([0], np.cumsum(left)[:-1])).astype(np.int64))


class Tree:
    """Branching nodes of the trie of one block of vectors."""

    def __init__(self, rows: list[tuple]) -> None:
        """``rows``: (key, doc id, m, places ascending, tfs) per document; the
        key is the places as big-endian bytes."""
        rows.sort(key=lambda r: r[0])
        self.rows, n = rows, len(rows)
        shared = [0] + [self._shared(rows[i - 1][3], rows[i][3]) for i in range(1, n)] + [-1]
        # A node is a run of documents [lo, hi) that share more than their surroundings.
        self.children: dict[tuple[int, int], list[tuple[int, int]]] = {}
        open_: list[tuple[int, int, list]] = []                 # (depth, lo, children) from the root down
        for i in range(n):
            done, into = (i, i + 1), shared[i + 1]
            while open_ and open_[-1][0] > into:                # the next one shares less: these nodes end here
                _, lo, kids = open_.pop()
                kids.append(done)
                done = (lo, i + 1)
                self.children[done] = kids
            if open_ and open_[-1][0] == into:
                open_[-1][2].append(done)
            elif into >= 0:
                open_.append((into, done[0], [done]))
        self.root = (0, n)
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        self._summarise()

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def kids(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        """Parts to visit next; a node of few documents falls into these."""
        if node[1] - node[0] <= LEAF:
            return [(i, i + 1) for i in range(*node)]
        return self.children[node]

    def _summarise(self) -> None:
        """Terms below each node with their largest tf, and its smallest m; a
        node is made from its children, so from the smallest node up."""
        for node in sorted([*self.children, self.root], key=lambda x: x[1] - x[0]):
            if node in self.best or node[1] - node[0] == 1:
                continue
            parts = [self.summary(x) for x in self.kids(node)]
            places = np.concatenate([p[0] for p in parts])
            order = np.argsort(places, kind="stable")
            places, tfs = places[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.diff(places, prepend=-1))
            most = np.maximum.reduceat(tfs, first) if len(first) else tfs
            self.best[node] = places[first], most, min(p[2] for p in parts)

    def summary(self, node: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
        if node[1] - node[0] == 1:
            _, _, m, places, tfs = self.rows[node[0]]
            return places, tfs, m
        return self.best[node]


class Search:
    """The k best documents of every item over the trees of one task."""

    def __init__(self, items: Items, weights: np.ndarray, k: int) -> None:
        self.items, self.weights, self.k = items, weights, k
        self.heaps: list[list] = [[] for _ in items.numbers]
        self.least = np.ones(len(items.numbers), dtype=np.int64)   # a score must reach this
        self.value = np.zeros(len(weights), dtype=np.int64)

    def bounds(self, items: Items, part: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
        """Per item the bound of a part, and which terms count in it."""
        places, tfs, m = part
        self.value[places] = self.weights[places] * gain(tfs, m)
        sums, present = items.sums(self.value), self.value > 0
        self.value[places] = 0
        return sums, present

    def tree(self, tree: Tree) -> None:
        """Depth first, the child with the largest bounds first."""
        if not len(self.items.numbers):
            return
        sums, present = self.bounds(self.items, tree.summary(tree.root))
        todo = [(tree.root, self.items, sums, present)]
        while todo:
            node, items, sums, present = todo.pop()
            keep = sums >= self.least[items.numbers]              # thresholds have risen since
            if not keep.any():
                continue
            if node[1] - node[0] == 1:
                self.offer(tree.rows[node[0]][1], items.numbers[keep], sums[keep])
                continue
            below = items.where(keep, present)
            found = [(kid, below, *self.bounds(below, tree.summary(kid))) for kid in tree.kids(node)]
            found.sort(key=lambda x: int(x[2].max()))
            todo.extend(found)

    def offer(self, doc_id, numbers: np.ndarray, scores: np.ndarray) -> None:
        tie = -doc_id if doc_id is not None else -(1 << 63)
        for i, score in zip(numbers.tolist(), scores.tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, tie))
            elif (score, tie) > heap[0]:
                heapq.heapreplace(heap, (score, tie))
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def _blocks(batches: Iterator[pa.RecordBatch], order: np.ndarray, n_docs: int, n_terms: int) -> Iterator[list[tuple]]:
    rows, entries = [], 0
    for batch in batches:
        doc_ids, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        tids, tfs = batch.column(2), batch.column(3)
        begin, tid, tf = tids.offsets.to_numpy(), tids.values.to_numpy(), tfs.values.to_numpy()
        for i, doc_id in enumerate(doc_ids):
            at = slice(begin[i], begin[i + 1])
            places = order[tid[at]]
            by = np.argsort(places)
            places = places[by]
            rows.append((places.astype(">u4").tobytes(), doc_id, length_part(ns[i], n_docs, n_terms), places, tf[at][by]))
            entries += len(places)
            if entries >= BLOCK_ENTRIES:
                yield rows
                rows, entries = [], 0
    if rows:
        yield rows


def best_of_tasks(table: DataFrame, shared, k: int) -> DataFrame:
    """number, score, doc_id: the k best documents of each item in each task."""
    def run(batches):
        order, weights, flat, n_docs, n_terms = shared.value
        search = Search(Items(*flat), weights, k)
        for rows in _blocks(batches, order, n_docs, n_terms):
            search.tree(Tree(rows))
        out = [(i, score, -tie if tie > -(1 << 63) else None) for i, heap in enumerate(search.heaps) for score, tie in heap]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.int64())], names=["number", "score", "doc_id"])

    return (table.filter("size(tids) > 0").select("doc_id", "n", "tids", "tfs")
            .mapInArrow(lean(run), "number int, score long, doc_id long"))


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each number with their rank; first the k best of each
    of SALTS parts, so that no task gathers what all tasks found for an item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= k).drop("rank", "salt")
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order)))
            .filter(F.col("rank") <= k))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents per item."""
    spark = docs.sparkSession
    scratch, results = Scratch(spark), Scratch(spark)
    asked = scratch.written(items.select(F.col(f"`{item_id_col}`").alias("item_id"),
                                         F.col(f"`{item_text_col}`").cast("binary").alias("text"))
                            .filter("length(text) > 0").distinct(), "search-items")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * item_terms)))                # about six bytes a term
    out = None
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        part = results.written(_block(docs, mine, k, id_col, text_col, scratch), "search-best")
        out = part if out is None else out.union(part)
    kind = asked.schema["item_id"].dataType
    scratch.drop()
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _block(docs: DataFrame, asked: list, k: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    bags = [Counter(t for part in terms(bytes(r["text"])) for t in part) for r in asked]
    names = sorted(set().union(*bags))
    vocabulary = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    table = scratch.written(vectors(docs, vocabulary, id_col, text_col), "search-vectors")
    n_docs, n_terms = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), dtype=np.int64)
    for tid, count in table.select(F.explode("tids").alias("tid")).groupBy("tid").count().collect():
        df[tid] = count
    frequent = np.argsort(-df, kind="stable")
    order = np.empty(len(names), dtype=np.int64)
    order[frequent] = np.arange(len(names))
    weights = np.array([weight(int(df[t]), n_docs) for t in frequent], dtype=np.int64)
    full = [i for i, bag in enumerate(bags) if bag]
    counts = [len(bags[i]) for i in full]
    tid_of = vocabulary.value
    flat = (np.arange(len(full)), np.array([order[tid_of[t]] for i in full for t in bags[i]], dtype=np.int64),
            np.array([c for i in full for c in bags[i].values()], dtype=np.int64),
            np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if full else np.empty(0, dtype=np.int64))
    shared = spark.sparkContext.broadcast((order, weights, flat, n_docs, n_terms))
    found = scratch.written(top(best_of_tasks(table, shared, k), k), "search-top")
    shared.destroy()
    vocabulary.destroy()
    ids = spark.createDataFrame([(n, str(asked[i]["item_id"]) if asked[i]["item_id"] is not None else None)
                                 for n, i in enumerate(full)], "number int, item_id string")
    return found.join(F.broadcast(ids), "number").select("item_id", "rank", "doc_id", "score")
