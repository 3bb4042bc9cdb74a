"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word n-grams; two documents link when
``100 * intersection >= threshold * union``.

1. *Order.*  All n-grams of all documents are counted in a sketch of fixed size
   (2^24 counters); n-grams are ordered by the level of their counter, rare ones
   first, then by their hash.  Any total order gives right results; this one
   keeps passages that many documents share out of the prefixes.
2. *Group.*  Equal sets are one member.  Members with the same size and the same
   prefix (the first ``n - ceil(t n) + 1`` n-grams) are one group; only groups
   meet in the inverted index of prefix n-grams.
3. *Star round.*  In each posting list, every group is paired with the list's
   most connected group, and every member with the first member of its group.
   The pairs are verified on the full sets and give first components.
4. *Rest.*  In every list that still holds two components, all pairs of groups
   of different components are filtered on size and on the overlap of their
   prefixes; survivors are expanded to member pairs and verified.  So no pair
   within a known component is made, and no link between components is missed.
   Long lists are cut into blocks for this, whatever their length.

Pairs carry ids; full sets are recomputed for the documents that some pair
names.  N-grams are 64-bit hashes, sets and prefixes are named by 128 bits.

Defined results: null or empty text, or text without words, has n_shingles 0
and links with nothing (component_id is its own id); fewer than n words are one
n-gram; equal rows are members of one set; a null id takes part but is never a
component's id (unless all are null).  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Scratch, lean, release, written

SKETCH_BITS, CHUNK_BITS, FILTER_BITS = 24, 18, 26
#: Partial sketches summed by one task of the first merge.
FAN_IN = 256
#: Posting lists are joined in blocks of about so many groups; in lists of more
#: than WIDE groups the prefixes are compared in the join itself.
BLOCK, WIDE = 256, 64
#: Named documents are filtered by a broadcast up to so many ids, else by a join.
BROADCAST_IDS = 500_000

#: Words whose hashes a Python worker keeps.
WORDS_KEPT = 1 << 17

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    """Hashes of the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingles(text: bytes, width: int, distinct: bool = True) -> np.ndarray:
    """64-bit hashes, sorted and distinct unless they are only to be counted,
    of the n-grams of a text (A-Z lower-cased, words are cut at ASCII white
    space); fewer words make one n-gram."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes() + b"short")], np.uint64)
    out = h[:len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * _M[k % 3] + h[k:len(h) - width + 1 + k]
        out ^= out >> np.uint64(32)
    out *= _M[3]
    out ^= out >> np.uint64(29)
    return np.unique(out) if distinct else out


def _name(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def prefix_length(n: int, threshold: int) -> int:
    return n - (threshold * n + 99) // 100 + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))


def _chunks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counters or bits as packed chunks; chunks of zeros are left out."""
    from pyspark import TaskContext

    parts = values.reshape(-1, 1 << CHUNK_BITS)
    rows = [k for k in range(len(parts)) if parts[k].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int32()), pa.array([TaskContext.get().partitionId() // FAN_IN] * len(rows), pa.int32()),
         pa.array([zlib.compress(parts[k].tobytes(), 1) for k in rows], pa.binary())], names=["chunk", "part", "data"])


def _merged(parts: DataFrame, kind, size: int, last=None) -> np.ndarray:
    """All tasks' chunks combined as fits ``kind`` (counters add up to
    2^32 - 1, bits are or-ed), FAN_IN tasks at a time, then mapped to bytes by
    ``last``; ``size`` bytes in all reach the driver."""
    def combine(group: pa.Table, end=None) -> pa.Table:
        total = np.zeros(1 << CHUNK_BITS, np.uint64 if kind is np.uint32 else kind)
        for x in group.column("data"):
            values = np.frombuffer(zlib.decompress(x.as_py()), kind)
            total = total + values if kind is np.uint32 else total | values
        total = np.minimum(total, np.iinfo(kind).max).astype(kind)
        total = total if end is None else end(total)
        return group.slice(0, 1).set_column(2, "data", pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))

    schema = "chunk int, part int, data binary"
    rows = (parts.groupBy("chunk", "part").applyInArrow(lambda g: combine(g), schema)
            .groupBy("chunk").applyInArrow(lambda g: combine(g, last), schema).collect())
    out = np.zeros(size, np.uint8)
    for r in rows:
        at = r.chunk << CHUNK_BITS
        out[at:at + (1 << CHUNK_BITS)] = np.frombuffer(zlib.decompress(bytes(r.data)), np.uint8)
    return out


def sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Level (quarters of the binary logarithm) of every counter over the
    n-grams of all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for t in batch.column(1):
                np.add.at(total, (shingles(t.as_py(), width, distinct=False) >> shift).astype(np.int64), np.uint32(1))
        yield from _chunks(total)

    level = lambda counts: np.minimum(127, np.floor(4 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)
    return _merged(texts.mapInArrow(lean(count), "chunk int, part int, data binary"), np.uint32, 1 << SKETCH_BITS, level)


def _filter_places(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tokens.view(np.uint64)
    low = np.uint64((1 << FILTER_BITS) - 1)
    return (t & low).astype(np.int64), ((t >> np.uint64(64 - FILTER_BITS)) & low).astype(np.int64)


def token_filter(tokens: DataFrame) -> np.ndarray:
    """Bits of a filter of fixed size that lets all these tokens pass."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for places in _filter_places(batch.column(0).to_numpy()):
                bits[places] = True
        yield from _chunks(np.packbits(bits))

    packed = _merged(tokens.mapInArrow(lean(mark), "chunk int, part int, data binary"), np.uint8, 1 << (FILTER_BITS - 3))
    return packed


def _passing(packed):
    """(key, n, token) for the tokens of each prefix that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = packed.value
        has = lambda at: bits[at >> 3] >> (7 - (at & 7)) & 1
        for batch in batches:
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            x, y = _filter_places(tokens)
            good = (has(x) & has(y)).astype(bool)
            at = pa.array(owner[good])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(tokens[good])],
                                             names=["key", "n", "token"])
    return run


def _prefixes(levels, width: int, threshold: int):
    """doc_id, n, key (name of the set), pkey (name of the prefix), prefix, and
    the place of the prefix's last n-gram in the order; columns after the text
    are passed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shift = levels.value, np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for t in part.column(1):
                    s = shingles(t.as_py(), width)
                    if len(s):
                        level = rank[(s >> shift).astype(np.int64)]
                        order = np.lexsort((s, level))[:prefix_length(len(s), threshold)]
                        first = s[order]
                        place = (int(level[order[-1]]) << 56) | (int(first[-1]) >> 8)
                        out.append((len(s), _name(s), _name(first), first.view(np.int64), place))
                    else:
                        out.append((0, None, None, None, None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()),
                     pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.list_(pa.int64())),
                     pa.array([o[4] for o in out], pa.int64()), *part.columns[2:]],
                    names=["doc_id", "n", "key", "pkey", "prefix", "place", *part.schema.names[2:]])
    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py(), width) for t in batch.slice(at, 256).column(1)]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["key", "s"])
    return run


def _linked(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def verify(pairs: DataFrame, members: DataFrame, texts: DataFrame, width: int, threshold: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b: names of sets) that link, checked on the full sets."""
    pairs = scratch.written(pairs, "jaccard-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = scratch.written(named.join(members.select("key", "doc_id"), "key").select("doc_id"), "jaccard-named")
    small = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if small else ids
    sets = (texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
            .mapInArrow(lean(_full_sets(width)), "key binary, s binary").dropDuplicates(["key"]))
    sets = scratch.written(sets, "jaccard-sets")
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b"))
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(_linked(threshold)), "a binary, b binary")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """key, component (the smallest key) of every node of the edges (a, b):
    smallest label of the neighbours, then of the label's node, to a fixpoint."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = written(both.toDF("key", "other"), f"{name}-edges")
    labels = written(both.groupBy("key").agg(F.least("key", F.min("other")).alias("component")), name)
    while True:
        near = (both.join(labels.toDF("other", "theirs"), "other").groupBy("key").agg(F.min("theirs").alias("theirs")))
        step = labels.join(near, "key").select("key", F.least("component", "theirs").alias("next"), "component")
        jump = labels.toDF("next", "beyond")
        step = step.join(jump, "next").select("key", F.least("next", "beyond").alias("next"), "component")
        step = written(step, name)
        labels = step.select("key", F.col("next").alias("component"))
        if step.filter("next <> component").isEmpty():
            return labels


def text_key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def jaccard_join(docs: DataFrame, width: int = 4, threshold: int = 85, id_col: str = "doc_id",
                 text_col: str = "text", by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id per row; ``threshold`` in hundredths.
    ``by_row`` adds text_key, which tells rows of one id apart, and component,
    which names the component whatever ids its rows have (null without words)."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    levels = spark.sparkContext.broadcast(sketch(texts, width))     # 16 MB, whatever the input
    extra = ["text_key"] if by_row else []
    rows = texts.select("*", *[text_key(F.col("text")).alias(c) for c in extra]).mapInArrow(
        lean(_prefixes(levels, width, threshold)), "doc_id long, n long, key binary, pkey binary, prefix array<long>, place long"
        + "".join(f", {c} binary" for c in extra))
    first, scratch = Scratch(spark), Scratch(spark)
    rows = first.written(rows, "jaccard-rows")
    levels.destroy()
    # Equal sets are one member; equal size and prefix are one group, named by its first member.
    worded = rows.filter("n > 0")
    members = written(worded.groupBy("key", "n", "pkey").agg(F.min("doc_id").alias("doc_id")), "jaccard-members")
    groups = scratch.written(worded.groupBy("n", "pkey").agg(F.min("key").alias("first"), F.any_value("prefix").alias("prefix"),
                                                      F.min("place").alias("place")), "jaccard-groups")
    rows = written(rows.select("doc_id", "n", "key", *extra), "jaccard-docs")
    first.drop()
    counts = scratch.written(groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
                     .filter("c > 1"), "jaccard-counts")
    # Most tokens are in one prefix only: a filter of fixed size keeps them from the shuffle.
    packed = spark.sparkContext.broadcast(token_filter(counts.select("token")))
    postings = groups.select("first", "n", "prefix").mapInArrow(lean(_passing(packed)), "key binary, n long, token long")
    # Sizes that can link lie in the same band or the next.
    band = F.floor(F.log(F.col("n")) / (1.0001 * math.log(100 / threshold))).cast("int")
    near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band")
    live = scratch.written(postings.join(counts, "token"), "jaccard-postings")
    packed.destroy()
    release()
    # Per group: what of its prefix another group has, and how connected that makes it.
    known = live.groupBy("key").agg(F.collect_list("token").alias("shared"), F.sum("c").alias("w"))
    # ``most``: n-grams that can be common with a group whose prefix ends later;
    # those of the own prefix that no such group has in its prefix are not.
    length = f"(n - ({threshold} * n + 99) DIV 100 + 1)"
    known = known.join(groups.select(F.col("first").alias("key"), "n", "place"), "key").select(
        "key", "shared", "w", "place", F.expr(f"n - ({length} - size(shared))").alias("most"))
    known = scratch.written(known, "jaccard-known")
    posts = live.join(known.select("key", "w", "place", "most"), "key")
    close = f"100 * least(na, nb) >= {threshold} * greatest(na, nb)"
    # Beyond the prefixes at most the longer rest can be common.
    rest = f"{{0}} - ({{0}} - ({threshold} * {{0}} + 99) DIV 100 + 1)"
    common = f"ceil({threshold} * (na + nb) / {100 + threshold}D - 1e-9D)"
    may = (f"CASE WHEN xa < xb THEN ma WHEN xb < xa THEN mb ELSE greatest(ma, mb) END >= {common}")
    enough = (f"size(array_intersect(sa, sb)) + greatest({rest.format('na')}, {rest.format('nb')}) "
              f">= {common}")
    arrays = lambda side: known.select(F.col("key").alias(side), F.col("shared").alias(f"s{side}"))

    # Star round.
    pivots = (posts.groupBy("token").agg(F.max(F.struct("w", "key", "n", "place", "most")).alias("p"))
              .select("token", F.col("p.key").alias("b"), F.col("p.n").alias("nb"), F.col("p.place").alias("xb"), F.col("p.most").alias("mb")))
    stars = (posts.select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("xa"), F.col("most").alias("ma"))
             .join(pivots, "token").filter("a <> b").filter(close).filter(may).select("a", "na", "b", "nb").distinct()
             .join(arrays("a"), "a").join(arrays("b"), "b").filter(enough).select(F.col("a").alias("first"), "b"))
    stars = scratch.written(stars, "jaccard-stars")
    by_group = members.join(groups.select("n", "pkey", "first"), ["n", "pkey"]).select("key", "first")
    many = by_group.filter(F.col("key") != F.col("first"))
    pairs = (stars.select(F.col("first").alias("a"), "b")
             .union(many.join(stars, "first").select(F.col("key").alias("a"), "b"))
             .union(many.select(F.col("key").alias("a"), F.col("first").alias("b")))).distinct()
    checked = Scratch(spark)
    links = written(verify(pairs, members, texts, width, threshold, checked), "jaccard-links")
    checked.drop()                                                  # full sets: not kept beside those of the second round
    labels = components(links)

    # Lists that still hold two components: pairs of groups across them.
    own = by_group.join(labels, "key", "left").select("key", "first", F.coalesce("component", "key").alias("component"))
    own = scratch.written(own, "jaccard-own")
    spread = scratch.written(own.groupBy("first").agg(F.min("component").alias("lo"), F.max("component").alias("hi")), "jaccard-spread")
    placed = posts.join(spread.withColumnRenamed("first", "key"), "key").withColumn("band", band)
    mixed = (placed.groupBy("token", "band").agg(F.min("lo").alias("x"), F.max("hi").alias("y"))
             .select("token", near, "x", "y").groupBy("token", "band").agg(F.min("x").alias("x"), F.max("y").alias("y"))
             .filter("x <> y").select("token", "band"))
    lists = placed.join(mixed, ["token", "band"]).drop("band").join(known.select("key", "shared"), "key") \
        .withColumn("shared", F.when(F.col("c") > WIDE, F.col("shared")))
    lists = scratch.written(lists.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")), "jaccard-lists")
    left = lists.select("token", F.expr("CAST(pmod(xxhash64(key), blocks) AS INT)").alias("block"), F.col("key").alias("a"),
                        F.col("n").alias("na"), F.col("place").alias("xa"), F.col("most").alias("ma"), F.col("lo").alias("loa"),
                        F.col("hi").alias("hia"), F.col("shared").alias("sa"))
    right = lists.select("token", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("key").alias("b"),
                         F.col("n").alias("nb"), F.col("place").alias("xb"), F.col("most").alias("mb"), F.col("lo").alias("lob"),
                         F.col("hi").alias("hib"), F.col("shared").alias("sb"))
    # A pair meets in every list that both are in; a long list passes it on only
    # where it is the first of them (all of them still hold both components).
    once = "array_min(array_intersect(sa, sb)) = l.token"
    across = F.expr(f"a < b AND NOT (loa = hia AND lob = hib AND loa = lob) AND {close} AND {may} "
                    f"AND (sa IS NULL OR sb IS NULL OR ({enough} AND {once}))")
    group_pairs = (left.alias("l").join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.block") == F.col("r.block")) & across)
                   .select("a", "na", "b", "nb").distinct().join(arrays("a"), "a").join(arrays("b"), "b").filter(enough)
                   .select("a", "b"))
    inside = spread.filter("lo <> hi").select(F.col("first").alias("a"), F.col("first").alias("b"))
    expanded = (group_pairs.union(inside)
                .join(own.select(F.col("first").alias("a"), F.col("key").alias("ka"), F.col("component").alias("ca")), "a")
                .join(own.select(F.col("first").alias("b"), F.col("key").alias("kb"), F.col("component").alias("cb")), "b")
                .filter("ca <> cb AND (a <> b OR ka < kb)").select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    more = written(verify(expanded.distinct(), members, texts, width, threshold, scratch), "jaccard-more")
    scratch.drop()
    if not more.isEmpty():
        labels = components(links.union(more), "components-2")

    smallest = (members.join(labels, "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component")))
    ids = smallest.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    keyed = smallest.join(ids, "component").select("key", "component_id", "component")
    return (rows.select("doc_id", F.col("n").alias("n_shingles"), "key", *extra).join(keyed, "key", "left")
            .select("doc_id", "n_shingles", F.expr("IF(n_shingles = 0, doc_id, component_id)").alias("component_id"),
                    *extra, *(["component"] if by_row else [])))
