"""Sharding by sampled splitters (law ``bytes``).

Records are ordered by the key (crc32 of the text, id, size), so equal texts
are neighbours.  Size-weighted key samples give the splitters of many fine
ranges; the exact bytes and rows of every range are then summed, ranges that
turned out overfull are subdivided by a second, denser draw, and prefix sums
over the ranges place each record at its exact byte offset in the whole.  A
shard is an equal stretch of those offsets, so shard sizes differ by at most
one record, however the keys are spread.

Only narrow rows (key, size, number of equal rows) are shuffled.  Rows that
are equal in id, size and checksum are one weighted row until the end, so a key
that holds a third of all rows meets no single task; a hot text is split
between its ids.

Defined results: null text has size ``overhead`` and a null checksum (it sorts
first); null ids are kept and sort first; repeated rows each get their own
slot; with no rows the result is empty; fewer bytes than shards leave shards
empty.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webloom.llm.common import written

#: Bounds of the number of fine ranges, whose splitters are plan literals.
MIN_RANGES, MAX_RANGES, ROWS_PER_RANGE = 640, 8192, 100_000
#: Sample points drawn for each range; the driver sees only these keys.
SAMPLES_PER_RANGE = 8


def _units(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    """One row for each distinct (id, checksum, size) with its multiplicity."""
    text = F.col(f"`{text_col}`").cast("binary")
    one = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(text).alias("text_crc32"))
    units = one.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    fixed = "lpad(hex(coalesce({0}, 0)), 16, '0')"
    return units.withColumn("key", F.expr(
        "concat(IF(text_crc32 IS NULL, '0', '1'), lpad(hex(coalesce(text_crc32, 0)), 8, '0'), "
        f"IF(doc_id IS NULL, '0', '1'), {fixed.format('doc_id')}, {fixed.format('size')})"))


def _splitters(units: DataFrame, total: int, ranges: int) -> list[str]:
    """Quantile keys of a size-weighted sample: each unit is drawn
    ``floor(weight * draws / total + u)`` times, ``u`` a hash of its key."""
    if not total or ranges < 2:
        return []
    draws = ranges * SAMPLES_PER_RANGE
    u = F.expr("pmod(xxhash64(key, 17), 1048576) / 1048576D")
    picked = (units.select("key", F.floor(F.col("size") * F.col("n") * F.lit(draws / total) + u).alias("w"))
              .filter("w > 0").collect())   # about ``draws`` rows at most, whatever the input
    picked.sort(key=lambda r: r.key)
    want = sum(r.w for r in picked) / ranges
    splits, seen, quantile = [], 0, 1
    for r in picked:
        seen += r.w
        if seen >= want * quantile:   # a heavy key may pass several quantiles at once
            splits.append(r.key)
            quantile = int(seen / want) + 1
    return splits


def _range_sql(splits: list[str]) -> str:
    """Number of splitters <= key, by binary search over an array literal."""
    if not splits:
        return "0"
    steps, step = [], 1
    while step <= len(splits):
        steps.append(step)
        step *= 2
    array = "array(" + ", ".join(f"'{s}'" for s in splits) + ")"
    jumps = ", ".join(str(s) for s in reversed(steps))
    return (f"aggregate(array({jumps}), 0, (at, step) -> "
            f"IF(at + step <= {len(splits)} AND element_at({array}, at + step) <= key, at + step, at))")


def range_partition(units: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add ``range``: the fine range of each unit, none overfull unless it is
    one single unit.  ``units`` has key, size, n and should be a written table."""
    rows, total = units.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.col("n"))).first()
    if ranges is None:
        ranges = min(MAX_RANGES, max(MIN_RANGES, rows // ROWS_PER_RANGE))
    splits = _splitters(units, total or 0, ranges)
    if splits:
        full = 2 * total / ranges
        at = units.withColumn("range", F.expr(_range_sql(splits)))
        over = (at.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.count(F.lit(1)).alias("k"))
                .filter((F.col("b") > full) & (F.col("k") > 1)).select("range", "b"))
        listed = [r.range for r in over.collect()]   # at most one of each fine range
        if listed:
            inside = at.filter(F.col("range").isin(listed))
            share = inside.agg(F.sum(F.col("size") * F.col("n"))).first()[0]
            more = _splitters(inside, share, max(2, 4 * round(share / total * ranges)))
            splits = sorted({*splits, *more})
    return units.withColumn("range", F.expr(_range_sql(splits)))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          overhead: int = 16, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0) per input row."""
    units = written(_units(docs, id_col, text_col, overhead), "shard-units")
    placed = range_partition(units, ranges)
    weight = F.col("size") * F.col("n")
    # Prefix sums over the fine ranges (one row each), then within a range.
    starts = (placed.groupBy("range").agg(F.sum(weight).alias("b"), F.sum("n").alias("k"))
              .withColumn("one", F.lit(0)))
    before = W.partitionBy("one").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("one")
    starts = starts.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                           F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"),
                           F.sum("b").over(whole).alias("total"))
    # No more rows than fine ranges (MAX_RANGES and their subdivisions).
    starts = F.broadcast(starts)
    within = W.partitionBy("range").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    at = placed.withColumns({"b1": F.coalesce(F.sum(weight).over(within), F.lit(0)),
                             "k1": F.coalesce(F.sum("n").over(within), F.lit(0))}).join(starts, "range")
    each = at.select("doc_id", "size", "text_crc32", "total", (F.col("b0") + F.col("b1")).alias("b"),
                     (F.col("k0") + F.col("k1")).alias("k"), F.explode(F.expr("sequence(0L, n - 1)")).alias("i"))
    # A record lies in the shard that holds its middle byte.
    middle = (F.col("b").cast("decimal(38,0)") + F.col("i") * F.col("size")) * 2 + F.col("size")
    each = each.select("doc_id", "size", "text_crc32", (F.col("k") + F.col("i")).alias("k"),
                       F.expr("i").alias("i"),
                       F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total"))).cast("int")).alias("shard"))
    each = written(each.select("doc_id", "size", "text_crc32", "k", "shard"), "shard-rows")
    firsts = F.broadcast(each.groupBy("shard").agg(F.min("k").alias("k0")))   # one row for each shard
    return each.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard",
                                             (F.col("k") - F.col("k0")).alias("slot"))
