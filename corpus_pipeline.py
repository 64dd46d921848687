"""A training corpus from documents: identify languages, drop exact and near copies, mix sources, tokenise.

Every stage is one of the operators, takes all rows that the stage before it kept, and decides for whole documents.
Nulls in any column, empty and very long texts, repeated rows and empty tables are input like any other; what becomes of
them is stated with each stage. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm import bpe, exact_dedup, langid, mixing, near_dedup
from tabulon.llm.common import content_key, stored, without, work_dir
from tabulon.llm.queries import held_out, vocabulary

KEY = "__content"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns as one, ``row``, beside those that an operator needs: none of their names can clash with its own."""
    return docs.select(F.struct("*").alias("row"), *needed)


def keep_one(docs: DataFrame, gone: DataFrame, several: DataFrame) -> DataFrame:
    """``docs`` without the rows of the contents ``gone``, and with one row of each content in ``several``, that which
    is first by its other columns. Both are small or joined by shuffle, as their counts say."""
    keyed = docs.withColumn(KEY, content_key("doc_id", "text"))
    left = without(keyed, gone, KEY, gone.count())
    n = several.count()
    if not n:
        return left.drop(KEY)
    first = Window.partitionBy(KEY).orderBy(*[F.col(c) for c in docs.columns if docs.schema[c].dataType.typeName() != "map"])
    twice = left.join(F.broadcast(several) if n <= 100_000 else several, KEY, "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return without(left, several, KEY, n).unionByName(twice).drop(KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: those with a null text or no letter. A null label becomes the
    language found; repeated rows all stay.

    Where no row teaches a language, documents without a letter go and labels stay as they are.
    """
    labelled = docs.where(~F.coalesce(held_out(), F.lit(False)))
    if labelled.where("text IS NOT NULL AND lang IS NOT NULL").isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    model = langid.train(labelled)
    found = langid.identify(packed(docs, "text"), model, keep=("row",)).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the longest as written, then the smallest doc_id, then the first by the other
    columns. A null text equals an empty one."""
    path = work_dir(spark, "pipeline-exact")
    found = stored(exact_dedup.exact_dedup(docs).groupBy(F.col("content").alias(KEY)).agg(F.count("*").alias("n"), F.max("kept").alias("kept")), f"{path}/found")
    return keep_one(docs, found.where("NOT kept").select(KEY), found.where("kept AND n > 1").select(KEY))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, that with the smallest doc_id stays, a null one being the largest, then the
    first by text key and other columns. A document may go that is linked to the one that stays by others only. Rows are
    told apart by doc_id and text. Texts without a word are linked to none and stay, repeated rows of them too."""
    path = work_dir(spark, "pipeline-near")
    groups = near_dedup.near_groups(docs).where(F.col("group").isNotNull()).groupBy("group", "doc_id", "content").agg(F.count("*").alias("n"))
    groups = stored(groups, f"{path}/groups")
    several = groups.groupBy("group").agg(F.count("*").alias("rows"), F.max("n").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("stays")).where("rows > 1 OR copies > 1")
    several = stored(several.select("group", F.col("stays.content").alias("stays")), f"{path}/several")
    of = groups.join(several, "group")
    gone = stored(of.where("content <> stays").select(F.col("content").alias(KEY)), f"{path}/gone")
    return keep_one(docs, gone, stored(of.where("content = stays AND n > 1").select(F.col("content").alias(KEY)), f"{path}/copies"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, with sources at their target weights; what is repeated is there several times. A null
    source is one of its own; texts without a token are emitted as ``mixing.mix`` says."""
    return mixing.mix(packed(docs, "doc_id", "text", "source")).select("row.*").select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, ids, and round_trip: whether these decode to the text, a null one to an empty one.
    Columns of documents with one of these names give way."""
    found = bpe.encode_decode(packed(docs, "text"), vocabulary(), keep=("row",))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_tokens", "ids", "round_trip")]
    return found.select(*kept, F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("round_trip"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokenise", tokenise)]
#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{i}-{name}")
    return docs
