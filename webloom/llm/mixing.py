"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight; targets share the whole size by weight, none above
``max_epochs`` times its source's size (the excess goes to the others by
weight, in closed form: sources ordered by cap over weight, one prefix sum).
Within a source, complete epochs take every document; the rest of the target
takes documents in the order of the keys ``-ln(u) / quality`` (``u`` a uniform
hash of the document, so reruns agree), prefix-summed up to the budget.  The
document that crosses the budget is taken in part (``split``) or, if at least
half of it fits, whole (``whole``).

A source may hold any share of the rows: its keys are cut into buckets of about
``ROWS_PER_BUCKET`` rows by a monotone function of the key, prefix sums run over
bucket totals and then inside each bucket.  Rows equal in id, size and source
are one weighted row.

Defined results: null text has size 0 and takes 0; a null source is a source of
its own, last in order; null ids are kept; an empty table gives an empty
result; when all sizes are 0 every target is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webloom.llm.common import SPACE, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 2_000


def size_sql(text: str = "text") -> str:
    """Number of words of a text (null: 0): fields of a split, less the empty
    ones at either end."""
    space = SPACE.replace("\\", "\\\\")
    parts = f"split({text}, '{space}')"
    return (f"coalesce(element_at(transform(array({parts}), p -> CAST(size(p) "
            "- IF(p[0] = '', 1, 0) - IF(size(p) > 1 AND element_at(p, -1) = '', 1, 0) AS BIGINT)), 1), 0L)")


#: Quality weight of a document (SQL over ``text``): 1 less four times the share
#: of its characters that are symbols of markup or tables, 0.25 at least.
QUALITY_SQL = ("greatest(0.25D, 1D - 4D * (length(text) - length(translate(text, '#*$%&|<>', ''))) "
               "/ greatest(length(text), 1))")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row per source (source, source_size).  Adds ``target``."""
    one = sizes.withColumn("one", F.lit(0))
    order = W.partitionBy("one").orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    one = one.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by = W.partitionBy("one").orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("one")
    # With the sources before this one capped, the others share what is left.
    one = one.withColumn("level", (F.sum("source_size").over(whole).cast("double")
                                   - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
                         / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # The first source whose cap is above its level ends the capping.
    one = one.withColumn("rank", F.row_number().over(by))
    open_rank = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("rank"))
    one = one.withColumn("share", F.min_by("level", open_rank).over(whole))
    return one.select("source", "source_size", F.least("cap", F.col("share") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, boundary: str = "split",
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{source_col}`").cast("string").alias("source"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "source", F.expr(size_sql()).alias("size"), F.expr(QUALITY_SQL).alias("quality"))
    units = written(rows.groupBy("doc_id", "source", "size", "quality").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    stats = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                        F.count(F.lit(1)).alias("units"))
    targets = source_targets(stats.select("source", "source_size"), weights, max_epochs)
    plan = (targets.join(stats.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s")))
            .select(F.col("source").alias("s"), "source_size", "target",
                    F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
                    .alias("epochs"),
                    F.greatest(F.lit(1), F.ceil(F.col("units") / rows_per_bucket)).alias("buckets")))
    plan = plan.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    u = F.expr("(CAST(conv(substr(md5(concat(coalesce(CAST(doc_id AS STRING), '-'), ':', CAST(size AS STRING))), 1, 13), "
               "16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D")
    keyed = (units.withColumn("key", -F.log(u) / F.col("quality"))
             .join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    keyed = keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")))
    weight = F.col("size") * F.col("n")
    over = keyed.groupBy("source", "bucket").agg(F.sum(weight).alias("b"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    over = over.select(F.col("source").alias("s"), F.col("bucket").alias("t"),
                       F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    within = (W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "quality")
              .rowsBetween(W.unboundedPreceding, -1))
    placed = (keyed.withColumn("b1", F.coalesce(F.sum(weight).over(within), F.lit(0)))
              .join(over, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("t"))))
    each = placed.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    left = F.col("budget") - (F.col("b0") + F.col("b1") + F.col("i") * F.col("size"))
    part = F.greatest(F.lit(0), F.least(left, F.col("size")))
    if boundary == "whole":
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
