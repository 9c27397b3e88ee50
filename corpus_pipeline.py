"""A training corpus from documents: toxic ones go, of near-duplicates one stays, repeated passages go, sources are mixed, texts are encoded.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns the next documents; each
result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm import curriculum, ngram_join, sentencepiece_bpe, suffix_dedup, toxicity
from siteglass.llm.common import aside, checked_broadcast, drop, table, written

#: Words of a shingle and per cent of similarity from which documents are near-duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Bytes from which a repeated string is removed; passages of 50 words are longer.
REPEATED_BYTES = 200


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose likeliest grade of toxicity is 0; all others go. Null and empty texts stay, repeated rows are judged alike."""
    plain, back = aside(docs, ("doc_id", "text"))
    model = toxicity.train(plain, table(spark, sf_dir, "labels"))
    return back(toxicity.severity(plain, model).where(~F.col("toxic")).select(plain.columns))


def _hash_of_row(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields])


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (ids that are null come last, ties go by a hash of the row).

    Rows that are equal in all columns are one document. Texts that are null, empty or blank are like no other and stay.
    """
    plain, back = aside(docs, ("doc_id", "text"))
    keyed = plain.withColumn("_row", _hash_of_row(plain))
    classes = written(ngram_join.similarity_classes(keyed, SHINGLE_WORDS, SIMILAR_PERCENT, id="_row", carry={"own": "doc_id"}), "classes")
    several = classes.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", F.col("doc_id").alias("_row"))).alias("best"), F.count("*").alias("n")).where("n > 1")
    several = written(several.select("component_id", F.col("best._row").alias("stays")), "several")
    of = classes.join(checked_broadcast(several), "component_id")
    gone = written(of.where("doc_id <> stays").select(F.col("doc_id").alias("_row")).distinct(), "gone")
    again = written(of.where("doc_id = stays").groupBy(F.col("stays").alias("_row")).count().where("count > 1").select("_row"), "again")
    kept = keyed.join(checked_broadcast(gone), "_row", "left_anti")
    if again.limit(1).count():
        again = checked_broadcast(again)
        kept = kept.join(again, "_row", "left_anti").unionByName(keyed.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return back(kept.select(plain.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their bytes that repeat; n_chars, where there is one, follows. A character that loses a part becomes U+FFFD.

    Null texts stay null, texts that lose nothing stay as they are; no row goes.
    """
    plain, back = aside(docs, ("doc_id", "text", "n_chars"))
    cut = F.col("n_removed") > 0
    kept = suffix_dedup.remove_repeats(plain, REPEATED_BYTES)
    kept = kept.withColumn("text", F.when(cut, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(kept.select(plain.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each pass that takes it, in training order. Texts without words are in no pass; a table without words is empty.

    Ids can be null or repeat, so rows are told apart by numbers of their own, which stay once they are written.
    """
    plain, back = aside(docs, ("doc_id", "text", "source"))
    numbered = written(plain.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    taken = written(curriculum.curriculum(numbered, keep=("_row",)).where(F.size("positions") > 0).select("_row", "positions"), "taken")
    rows = numbered.join(checked_broadcast(taken), "_row").withColumn("_position", F.explode("positions"))
    order = ["_position", "doc_id", "_row"]
    return back(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(plain.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each row; null and empty texts have no tokens."""
    return sentencepiece_bpe.encode_decode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", one_of_each_class),
    ("suffix_dedup", without_repeats),
    ("curriculum", mixed),
    ("sentencepiece", encoded),
]
#: Several stages cannot be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for documents. A stage's table goes when the next one's is written; an empty table gives no rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
