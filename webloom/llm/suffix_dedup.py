"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte of a text goes if a string of ``LENGTH`` bytes that covers it also starts
anywhere else, in the same or another text.

1. *Anchors.*  In every window of ``LENGTH`` bytes the smallest hash of its
   ``GRAM``-byte strings is its anchor (the leftmost, if equal).  Equal windows
   have equal anchors at equal offsets, so a window can only repeat among the
   windows of its anchor's hash.  Consecutive windows of one anchor make one
   *stretch* (at most 2 LENGTH bytes).  Equal stretches are one class, counted
   by Spark: a class at two places repeats whole.
2. *Slices.*  Where one anchor hash has several classes, one stretch of each is
   cut into slices of ``SLICE`` windows by their offset to the anchor, whose
   common bytes are the slice's core.  Equal slices are counted like stretches;
   cores with several classes of slices remain.
3. *Transforms.*  One slice of each remaining class goes, by its core, to a
   bucket of bounded size.  A bucket is cut into shards; each shard sorts its
   own rotations once and keeps their Burrows-Wheeler transform: the 8 bytes
   before each rotation, as one symbol.
4. *Merge.*  The shards' transforms are merged by iterative interleave
   refinement: starting from one shard after the other, each round spreads the
   current interleave stably by the symbols, which makes it right for 8 bytes
   more; rotations are never compared or sorted again.  Places where the order
   first parts give the common prefixes in steps of 8 bytes; what is still
   together after LENGTH bytes is a repeated interval.
5. A core with more slices than a bucket may hold (a passage that very many
   documents share) is done by Spark on the hashes of its windows, exactly.

The covered intervals come back to each text, which is cut in one pass.
Stretches, slices and windows are named by 64-bit hashes within their anchor or
core, texts by hash and length.

Defined results: null counts as empty; texts shorter than LENGTH lose nothing;
equal texts of LENGTH bytes or more lose everything; an empty table gives an
empty result.  Only the id, the text and the columns named in ``keep`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import Scratch, lean, written

LENGTH, GRAM, STEP, SLICE = 200, 32, 8, 22
#: Slices that one bucket holds on average, and of one core at most.
BUCKET_SLICES, CORE_SLICES = 512, 1024
SHARD_BYTES = 1 << 15
#: Texts longer than this are scanned in overlapping parts.
PART_BYTES = 1 << 22
#: Ranges of texts are matched to them by a broadcast up to so many texts and ranges, else by a join.
BROADCAST_TEXTS, BROADCAST_RANGES = 300_000, 1_500_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position: strings of 1, 2, 4, ... bytes
    are joined pairwise."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    width = 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(29))) * _B + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _A
    return h ^ (h >> np.uint64(29))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, from block-wise running minima."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def stretches(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, its position, first and last window start) of every stretch."""
    found = []
    for start in range(0, max(len(text) - LENGTH + 1, 0), PART_BYTES):
        part = np.frombuffer(text, np.uint8)[start:start + PART_BYTES + LENGTH - 1]
        if len(part) < LENGTH:
            break
        h = _gram_hashes(part)
        low = np.uint64((1 << 24) - 1)
        best = _window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        at = (best & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        found.append((h[at[first]], at[first] + start, first + start, last + start))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _pack(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A stretch in one number: first window, windows after it, anchor after the last."""
    return (lo << 18) | ((hi - lo) << 9) | (at - hi)


def _unpack(span: int) -> tuple[int, int, int]:
    """Anchor position, first and last window start."""
    lo = span >> 18
    hi = lo + ((span >> 9) & 511)
    return hi + (span & 511), lo, hi


def _repeat(array: pa.Array, row: int, n: int) -> pa.Array:
    return array.take(pa.array(np.full(n, row, np.int64)))


def _hashes(strings) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in strings], np.uint64).view(np.int64))


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(2)[row].as_py()
            anchors, at, lo, hi = stretches(text)
            n = len(anchors)
            if n:
                names = _hashes(text[a:b + LENGTH] for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), names, _repeat(batch.column(0), row, n),
                     _repeat(batch.column(1), row, n), pa.array(_pack(at, lo, hi))],
                    names=["anchor", "stretch", "tid", "n", "span"])


def _slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the wanted stretches of each text: the core is what all
    windows of the slice share, were they all there."""
    for batch in batches:
        for row in range(batch.num_rows):
            text, out = batch.column(2)[row].as_py(), []
            for span in batch.column(3)[row].as_py():
                at, lo, hi = _unpack(span)
                for k in range((at - hi) // SLICE, (at - lo) // SLICE + 1):
                    first, last = max(lo, at - (k + 1) * SLICE + 1), min(hi, at - k * SLICE)
                    core = text[at - k * SLICE:at - (k + 1) * SLICE + 1 + LENGTH]
                    out.append((core + bytes((k,)), text[first:last + LENGTH], first, last))
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [_hashes(o[0] for o in out), _hashes(o[1] for o in out), _repeat(batch.column(0), row, n),
                 _repeat(batch.column(1), row, n), pa.array([o[2] for o in out], pa.int64()),
                 pa.array([o[3] for o in out], pa.int64())], names=["core", "slice", "tid", "n", "lo", "hi"])


class _Shard:
    """Rotations of some strings in sorted order, and the symbol before each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        n = int(lengths.sum())
        begin = np.repeat(starts, lengths)
        offset = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        size = np.repeat(lengths, lengths)
        self.position = begin + offset                  # in the bucket's bytes
        step = lambda d: begin + (offset + d) % size
        gram = np.zeros(n, np.uint64)
        for k in range(STEP):
            gram = (gram << np.uint64(8)) | data[step(k)]
        local = lambda d: np.arange(n) - offset + (offset + d) % size
        rank = np.unique(gram, return_inverse=True)[1]
        width = STEP
        while width < LENGTH:
            rank = np.unique(rank * np.int64(n) + rank[local(width)], return_inverse=True)[1]
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.position = self.position[order]
        self.before = gram[local(-STEP)][order]


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers, by 16-bit counting passes."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and int(keys.max()) > 0xFFFF:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge(shards: list[_Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all rotations by their first LENGTH bytes: positions,
    and the number of the interval of equal prefixes that each lies in."""
    symbols = np.unique(np.concatenate([s.before for s in shards]), return_inverse=True)[1]
    z = np.repeat(np.arange(len(shards)), [len(s.before) for s in shards])
    interval = np.zeros(len(z), np.int64)
    for _ in range(-(-LENGTH // STEP)):
        merged = np.empty(len(z), np.int64)
        merged[_stable(z)] = symbols                     # each shard's transform in its own order
        order = _stable(merged)
        z, merged, interval = z[order], merged[order], interval[order]
        new = np.concatenate(([False], (merged[1:] != merged[:-1]) | (interval[1:] != interval[:-1])))
        interval = np.cumsum(new)
    position = np.empty(len(z), np.int64)
    position[_stable(z)] = np.concatenate([s.position for s in shards])
    return position, interval


def repeated_windows(strings: list[bytes]) -> list[np.ndarray]:
    """For each string the sorted starts of its LENGTH-byte windows that occur
    at another place of these strings."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(strings), np.uint8)
    cut = np.searchsorted(starts, np.arange(0, len(data), SHARD_BYTES))
    bounds = np.unique(np.append(cut, len(strings)))
    shards = [_Shard(data, starts[a:b], lengths[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    position, interval = merge(shards)
    owner = np.searchsorted(starts, position, side="right") - 1
    real = position - starts[owner] <= lengths[owner] - LENGTH      # no rotation past the end
    counts = np.bincount(interval[real], minlength=int(interval[-1]) + 1)
    hit = np.sort(position[real][counts[interval[real]] > 1])
    own = np.searchsorted(starts, hit, side="right") - 1
    return [hit[a:b] - s for s, a, b in zip(starts, np.searchsorted(own, np.arange(len(strings))),
                                            np.searchsorted(own, np.arange(len(strings)), side="right"), strict=True)]


def _spans(windows: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes covered by windows at these sorted starts."""
    if not len(windows):
        return [], []
    part = np.flatnonzero(np.diff(windows) > LENGTH)
    return windows[np.append(0, part + 1)].tolist(), (windows[np.append(part, len(windows) - 1)] + LENGTH).tolist()


_COVERED = "tid long, n long, begin long, end long"


def _covered(rows: list[tuple], windows: list[np.ndarray]) -> pa.Table:
    out = []
    for (tid, n, lo), own in zip(rows, windows, strict=True):
        out.extend((tid, n, lo + a, lo + b) for a, b in zip(*_spans(own), strict=True))
    return pa.Table.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)],
                                names=["tid", "n", "begin", "end"])


def _merge_bucket(bucket: pa.Table) -> pa.Table:
    rows = list(zip(*(bucket.column(c).to_pylist() for c in ("tid", "n", "lo", "text")), strict=True))
    rows.sort(key=lambda r: r[3])
    return _covered([r[:3] for r in rows], repeated_windows([r[3] for r in rows]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted slices of each text."""
    for batch in batches:
        for row in range(batch.num_rows):
            text, wanted = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
            n = len(wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["core"] for w in wanted], pa.int64()), pa.array([w["bucket"] for w in wanted], pa.int64()),
                 _repeat(batch.column(0), row, n), _repeat(batch.column(1), row, n),
                 pa.array([w["lo"] for w in wanted], pa.int64()),
                 pa.array([text[w["lo"]:w["hi"] + LENGTH] for w in wanted], pa.binary())],
                names=["core", "bucket", "tid", "n", "lo", "text"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of every window of each slice."""
    for batch in batches:
        for row in range(batch.num_rows):
            text, lo = batch.column(3)[row].as_py(), batch.column(4)[row].as_py()
            n = len(text) - LENGTH + 1
            yield pa.RecordBatch.from_arrays(
                [_repeat(batch.column(0), row, n), _hashes(text[s:s + LENGTH] for s in range(n)),
                 _repeat(batch.column(1), row, n), _repeat(batch.column(2), row, n), pa.array(np.arange(n) + lo)],
                names=["core", "window", "tid", "n", "lo"])


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of each text's ranges."""
    for batch in batches:
        begins, ends = [], []
        for ranges in batch.column(2):
            b, e = [], []
            for r in sorted((x["begin"], x["end"]) for x in ranges.as_py()):
                if e and r[0] <= e[-1]:
                    e[-1] = max(e[-1], r[1])
                else:
                    b.append(r[0])
                    e.append(r[1])
            begins.append(b)
            ends.append(e)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(begins, pa.list_(pa.int64())),
             pa.array(ends, pa.list_(pa.int64()))], names=["tid", "n", "begins", "ends"])


def _matched(texts: DataFrame, keyed: DataFrame, listed: str, how: str = "inner") -> DataFrame:
    """Texts joined to ``keyed``, a written table of one row per text whose
    column ``listed`` is an array: broadcast if both counts are small."""
    texts_n, items = keyed.agg(F.count(F.lit(1)), F.sum(F.size(listed))).first()
    small = texts_n <= BROADCAST_TEXTS and (items or 0) <= BROADCAST_RANGES
    return texts.join(F.broadcast(keyed) if small else keyed, ["tid", "n"], how)


def _classes(rows: DataFrame, outer: str, inner: str, kept: list[str]) -> DataFrame:
    """One row per (outer, inner): whether all its rows are one place (equal
    texts are one), and the columns of its first place."""
    place = F.xxhash64("tid", "n", kept[0])
    return rows.groupBy(outer, inner).agg(
        (F.min(place) == F.max(place)).alias("single"),
        *[F.min_by(c, place).alias(c) for c in ("tid", "n", *kept)])


def covered(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """tid, n, begins, ends: the maximal byte ranges to remove, one row for
    each text (tid, n, text) that has any.  ``scratch`` may be dropped once
    the result is written."""
    texts = texts.select("tid", "n", "text").filter(F.col("n") >= LENGTH)
    copies = (texts.groupBy("tid", "n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
              .select("tid", "n", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))
    copies = scratch.written(copies, "suffix-copies")

    # Stretches.
    rows = texts.mapInArrow(lean(_stretch_rows), "anchor long, stretch long, tid long, n long, span long")
    rows = scratch.written(rows, "suffix-stretches")
    classes = scratch.written(_classes(rows, "anchor", "stretch", ["span"]), "suffix-classes")
    lo, hi = F.shiftright("span", 18), F.shiftright("span", 18) + F.shiftright("span", 9).bitwiseAND(511)
    whole = (rows.join(classes.filter("NOT single").select("anchor", "stretch"), ["anchor", "stretch"])
             .select("tid", "n", lo.alias("begin"), (hi + LENGTH).alias("end"))
             .join(copies.select("tid", "n"), ["tid", "n"], "left_anti"))

    # Slices of one stretch of each class, where an anchor has several.
    mixed = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    wanted = (classes.join(mixed, "anchor").groupBy("tid", "n").agg(F.collect_list("span").alias("spans")))
    wanted = scratch.written(wanted, "suffix-wanted")
    slices = (_matched(texts, wanted, "spans").select("tid", "n", "text", "spans")
              .mapInArrow(lean(_slice_rows), "core long, slice long, tid long, n long, lo long, hi long"))
    slices = scratch.written(slices, "suffix-slices")
    parts = scratch.written(_classes(slices, "core", "slice", ["lo", "hi"]), "suffix-parts")
    whole_slices = (slices.join(parts.filter("NOT single").select("core", "slice"), ["core", "slice"])
                    .select("tid", "n", F.col("lo").alias("begin"), (F.col("hi") + LENGTH).alias("end"))
                    .join(copies.select("tid", "n"), ["tid", "n"], "left_anti"))

    # Windows of one slice of each class, where a core has several.
    sizes = parts.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    sizes = scratch.written(sizes, "suffix-cores")
    total = sizes.agg(F.sum("c")).first()[0] or 0
    buckets = max(1, total // BUCKET_SLICES)
    bucket = F.when(F.col("c") > CORE_SLICES, F.lit(-1)).otherwise(F.pmod(F.xxhash64("core"), F.lit(buckets)))
    wanted = (parts.join(sizes.withColumn("bucket", bucket), "core").groupBy("tid", "n")
              .agg(F.collect_list(F.struct("core", "bucket", "lo", "hi")).alias("parts")))
    wanted = scratch.written(wanted, "suffix-wanted-parts")
    cut = (_matched(texts, wanted, "parts").select("tid", "n", "text", "parts")
           .mapInArrow(lean(_cut), "core long, bucket long, tid long, n long, lo long, text binary"))
    cut = scratch.written(cut.dropDuplicates(["core", "bucket", "tid", "n", "lo"]), "suffix-cut")
    merged = (cut.filter("bucket >= 0").groupBy("bucket").applyInArrow(_merge_bucket, _COVERED))
    windows = (cut.filter("bucket < 0").select("core", "tid", "n", "text", "lo")
               .mapInArrow(lean(_window_rows), "core long, window long, tid long, n long, lo long"))
    windows = scratch.written(windows, "suffix-windows")
    twice = windows.groupBy("core", "window").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    hot = (windows.join(twice.select("core", "window"), ["core", "window"])
           .select("tid", "n", F.col("lo").alias("begin"), (F.col("lo") + LENGTH).alias("end")))

    ranges = whole.union(whole_slices).union(merged).union(hot).union(copies)
    return (ranges.groupBy("tid", "n").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
            .mapInArrow(lean(_maximal), "tid long, n long, begins array<bigint>, ends array<bigint>"))


def _strip(as_text: bool):
    """Texts without their ranges; as text, characters cut by a range go whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, begins, ends in zip(*(batch.column(k) for k in range(3)), strict=True):
                text, begins, ends = text.as_py(), begins.as_py() or [], ends.as_py() or []
                parts = [text[a:b] for a, b in zip([0, *ends], [*begins, len(text)], strict=True)]
                kept.append("".join(x.decode(errors="ignore") for x in parts) if as_text else b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string() if as_text else pa.binary()), *batch.columns[1:]],
                                             names=["kept", *batch.schema.names[1:]])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is ``kept`` of every row
    (bytes, or text), then the columns named in ``keep``."""
    extra = [F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"), *extra)
    rows = rows.withColumns({"tid": F.xxhash64("text"), "n": F.octet_length("text").cast("long")})
    scratch = Scratch(docs.sparkSession)
    ranges = written(covered(rows, scratch), "suffix-ranges")
    scratch.drop()
    found = _matched(rows, ranges, "begins", "left")
    types = "".join(f", keep_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    removed = F.aggregate(F.arrays_zip("begins", "ends"), F.lit(0).cast("long"),
                          lambda total, r: total + r["ends"] - r["begins"])
    out = (found.withColumn("n_removed", F.coalesce(removed, F.lit(0)).cast("long"))
           .select("text", "begins", "ends", "doc_id", F.col("n").alias("n_bytes"), "n_removed",
                   *[f"keep_{k}" for k in range(len(keep))])
           .mapInArrow(lean(_strip(as_text)), f"kept {'string' if as_text else 'binary'}, begins array<bigint>, "
                                        "ends array<bigint>, doc_id long, n_bytes long, n_removed long" + types))
    return out.select("doc_id", "n_bytes", "n_removed", F.greatest(F.size("begins"), F.lit(0)).cast("long").alias("n_spans"),
                      "kept", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])
