"""Registration of queries and the databases they run over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.digest import text_digest
from hashloom.functions.text import Contexts
from hashloom.plans.namespace import Database, Namespace, Values
from hashloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONTEXTS = Contexts({"ord": ".ord", "prt": ".prt", "doc": ".txt", "web": ".html"}, default="ord")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(frame: DataFrame, key: str, *columns: str) -> DataFrame:
    return frame.select(F.col(key).alias("hash"), *columns)


def orders_database(spark: SparkSession, sf_dir: str) -> Database:
    """Context ord: orders with their lines as multi-valued features and the link to the parts."""
    entities = hashed(
        table(spark, sf_dir, "orders"),
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        "o_orderdate",
        "o_custkey",
    )
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "hash")
    many = {
        "returnflag": Values(lines, "l_returnflag"),
        "linestatus": Values(lines, "l_linestatus"),
        "linenumber": Values(lines, "l_linenumber"),
        "quantity": Values(lines, "l_quantity"),
        "suppkey": Values(lines, "l_suppkey"),
        "to_prt": Values(lines, "l_partkey"),
    }
    return Database.of("ord_base", entities, many, contexts=CONTEXTS)


def parts_database(spark: SparkSession, sf_dir: str) -> Database:
    columns = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    entities = hashed(table(spark, sf_dir, "part"), "p_partkey", *columns)
    return Database.of("prt_base", entities, contexts=CONTEXTS)


def documents_database(spark: SparkSession, sf_dir: str) -> Database:
    documents = table(spark, sf_dir, "documents").withColumn("digest", text_digest(F.col("text")))
    entities = hashed(documents, "doc_id", "lang", "source", "n_chars", "digest")
    return Database.of("doc_base", entities, contexts=CONTEXTS)


def labels_database(spark: SparkSession, sf_dir: str) -> Database:
    entities = hashed(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")
    return Database.of("doc_labels", entities, contexts=CONTEXTS)


def reviews_database(spark: SparkSession, sf_dir: str) -> Database:
    """Context doc, known to the labelled documents only: the grade as text, a tag per verdict."""
    labels = table(spark, sf_dir, "labels")
    verdicts = F.array(
        F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))
    )
    tags = labels.select(F.col("doc_id").alias("hash"), F.explode(verdicts).alias("value"))
    entities = labels.select(
        F.col("doc_id").alias("hash"),
        F.lit("reviewed").alias("source"),
        F.when(F.col("quality") == 1, F.lit("A")).alias("grade"),
    )
    return Database.of("doc_reviews", entities, {"tag": tags}, {"grade": "empty"}, contexts=CONTEXTS)


def pages_database(spark: SparkSession, sf_dir: str) -> Database:
    """Context web: pages with their address and the last part of it as path features."""
    pages = hashed(table(spark, sf_dir, "pages"), "page_id", "url")
    pages = pages.withColumn("file", F.element_at(F.split("url", "/"), -1))
    many = {"local": Values(pages, "url"), "filename": Values(pages, "file")}
    return Database.of("web_pages", pages.select("hash"), many, contexts=CONTEXTS)


def orders(spark: SparkSession, sf_dir: str) -> Namespace:
    return Namespace([orders_database(spark, sf_dir)])


def orders_and_parts(spark: SparkSession, sf_dir: str) -> Namespace:
    return Namespace([orders_database(spark, sf_dir), parts_database(spark, sf_dir)])


def parts(spark: SparkSession, sf_dir: str) -> Namespace:
    return Namespace([parts_database(spark, sf_dir)])


def documents(spark: SparkSession, sf_dir: str) -> Namespace:
    return Namespace(
        [documents_database(spark, sf_dir), labels_database(spark, sf_dir), reviews_database(spark, sf_dir)]
    )
