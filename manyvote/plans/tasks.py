"""Learning tasks on the test tables; every task reads its tables whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_key() -> Column:
    """Order and line number repeat, so quantity and price are part of the key."""
    return F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("int").cast("string"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string"),
    )


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a document good? From its length, letters, digits, vocabulary, lines, language, source.

    Features are computed before the join, so that texts are read where they lie and only numbers
    can be shuffled, and only for documents that may have a label.
    """
    text = F.col("text")
    length = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, "[ \n\t\r]+"), lambda w: w != "")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality"))
    docs = labelled_only(table(spark, sf_dir, "documents"), labels)
    features = docs.select(
        "doc_id",
        "n_chars",
        (F.lit(1.0) - F.length(F.regexp_replace(text, r"\P{L}+", "")) / length).alias("nonletter_ratio"),
        ((F.length(text) - F.length(F.regexp_replace(text, "[0-9]+", ""))) / length).alias("digit_ratio"),
        F.transform(F.array(words), lambda w: F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))[0].alias(
            "distinct_word_ratio"
        ),
        F.size(F.split(text, "\n")).alias("n_lines"),
        "lang",
        "source",
    )
    return features.join(labels, "doc_id")


# Slots of the bitmap of labelled ids, 32 to a row of the broadcast: at most 262,144 rows, however many labels.
SLOTS = 1 << 23


def labelled_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose id shares its slot of a bitmap with a labelled one; the join that follows decides."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 32).cast("int"))
    words = labels.groupBy(F.floor(slot / 32).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    near = docs.join(F.broadcast(words), F.floor(slot / 32) == F.col("_word"))
    return near.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def part_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of a part; its number is the first feature and its key."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), "p_partkey", "p_size", "p_brand", "p_type", "p_retailprice"
    )


def cust_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a customer's balance below zero? Classes -1, 0 and 1."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.signum("c_acctbal").cast("int").alias("balance_sign")
    )


def cust_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's balance; the nation is the first feature."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust_id"), "c_nationkey", "c_custkey", "c_acctbal"
    )


def emb_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of an embedding from all its values."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("class"))


def flag_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flag of a line; noise, for volume."""
    return table(spark, sf_dir, "lineitem").select(
        line_key().alias("line_id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )


def line_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of a line from three features of few values each."""
    return table(spark, sf_dir, "lineitem").select(
        line_key().alias("line_id"), "l_discount", "l_tax", "l_linenumber", "l_linestatus"
    )


def line_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity of a line, a whole number, from the same features."""
    return table(spark, sf_dir, "lineitem").select(
        line_key().alias("line_id"), "l_discount", "l_tax", "l_linenumber", "l_quantity"
    )


def line_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of a line from three features, each of which leaves a wide gap between the two classes."""
    late, open_ = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").select(
        line_key().alias("line_id"),
        (F.when(late, 100.0).otherwise(0.0) + F.col("l_linenumber")).alias("near_number"),
        (F.when(open_, 10.0).otherwise(0.0) + F.col("l_discount")).alias("near_discount"),
        (F.when(late, 10.0).otherwise(0.0) + F.col("l_tax")).alias("near_tax"),
        "l_linestatus",
    )


def line_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number that is constant on either side of the same gaps."""
    level = F.when(F.col("l_linestatus") == "F", 20.0).otherwise(10.0)
    return line_gap(spark, sf_dir).withColumn("level", level).drop("l_linestatus")


def flag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, label, preds``: the return flag as 0, 1, 2 and what five fixed rules say."""
    rules = [
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0),
        F.when(F.col("l_discount") > 0.05, 2.0).when(F.col("l_discount") > 0.02, 1.0).otherwise(0.0),
        F.when(F.col("l_tax") > 0.04, 2.0).otherwise(1.0),
        F.when(F.col("l_extendedprice") > 50000, 2.0).otherwise(0.0),
        (F.col("l_linenumber") % 3).cast("double"),
    ]
    label = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    return table(spark, sf_dir, "lineitem").select(
        line_key().alias("row_id"), label.alias("label"), F.array(*rules).alias("preds")
    )


def price_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, label, preds``: the price of a part and what four fixed rules say."""
    rules = [
        F.lit(1000.0),
        900 + F.col("p_partkey") * 0.1,
        900 + F.col("p_size") * 4.0,
        950 + (F.col("p_partkey") % 1000) * 0.1,
    ]
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("label"), F.array(*rules).alias("preds")
    )
