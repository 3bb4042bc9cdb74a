"""From raw documents to token ids in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs.  All but the last return the
columns of ``documents``; other columns of their input, whatever their names,
are left at the door.  Ids are expected to be unique; what happens to rows
that repeat one is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import jaccard_join, language_id, mixing, sentencepiece_codec, suffix_dedup
from webloom.llm.common import WORD, joined, prepare, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is accepted from this calibrated probability on.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters go."""
    prepare(spark)
    found = language_id.identify(docs, language_id.fit(docs), keep=COLUMNS[1:])
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(F.col("doc_id"), *[F.col(c) for c in COLUMNS[1:]])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, five words and a similarity
    of 0.8: the smallest id, null last, and of several texts with that id the
    one whose key is smallest.  Of equal rows one stays; documents without words
    all stay."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    found = written(jaccard_join.jaccard_join(docs, width=5, threshold=80, by_row=True).filter("n_shingles > 0")
                    .select("doc_id", "text_key", "component"), "pipeline-links")
    groups = (found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"),
                                             F.count(F.lit(1)).alias("c")).filter("c > 1")
              .select("component", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("k")))
    groups = written(groups, "pipeline-groups")
    losers = written(joined(found, groups, "component", "inner").filter("NOT (doc_id <=> id AND text_key = k)")
                     .select(F.col("doc_id").alias("id"), F.col("text_key").alias("k")).distinct(), "pipeline-losers")
    twice = written(found.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("k")).agg(F.count(F.lit(1)).alias("c"))
                    .filter("c > 1").select("id", "k"), "pipeline-twice")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (jaccard_join.text_key(F.col("text")) == F.col("k"))
    kept = joined(docs, losers, same, "left_anti").select(*COLUMNS)
    if twice.isEmpty():
        return kept
    return (joined(kept, twice, same, "left_anti")
            .union(joined(kept, twice, same, "left_semi").dropDuplicates(["doc_id", "text"])))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 200-byte strings; a text of which nothing
    is left goes, and n_chars counts what is left."""
    prepare(spark)
    out = suffix_dedup.remove_repeats(docs, keep=("lang", "source", "n_chars"), as_text=True)
    changed = F.col("n_removed") > 0
    return (out.filter(~changed | F.col("kept").rlike(WORD))
            .select("doc_id", F.col("kept").alias("text"), "lang", "source",
                    F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of its source takes it, whole.
    Rows that repeat an id get the most copies that one of them gets."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs, boundary="whole").filter("taken > 0")
    copies = (mixed.groupBy("doc_id", "source", "size")
              .agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("copies"))
              .select(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("size").alias("words"), "copies"))
    copies = written(copies, "pipeline-copies")
    same = (F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s"))
            & (F.expr(mixing.size_sql()) == F.col("words")))
    return (joined(docs, copies, same, "inner").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, its length, and whether they decode to the text."""
    import public_tokenizers

    prepare(spark)
    out = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_strings),
          ("mixing", mixture), ("sentencepiece", tokens)]

#: Models, components and a tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
