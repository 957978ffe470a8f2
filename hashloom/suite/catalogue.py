"""Queries of the profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.operators import profile
from hashloom.plans.namespace import Namespace
from hashloom.session import working_folder
from hashloom.sources import sketches, tables
from hashloom.suite.registry import documents, documents_database, labels_database, orders, orders_database, parts, query


@query(
    "SELECT 'lang' AS feature, CAST(NULL AS VARCHAR) AS \"default\", CAST(count(*) AS BIGINT) AS n, min(lang) AS lo,"
    " max(lang) AS hi, CAST(count(DISTINCT lang) AS BIGINT) AS n_strings,"
    " string_agg(DISTINCT lang, ' ' ORDER BY lang) AS strings FROM documents"
)
def feature_profile(spark, sf_dir):
    return profile.feature_profile(documents(spark, sf_dir), "lang", joined_strings=True)


@query(
    "SELECT 'grade' AS feature, 'empty' AS \"default\", CAST(count(*) AS BIGINT) AS n,"
    " min(g) AS lo, max(g) AS hi, CAST(count(DISTINCT g) AS BIGINT) AS n_strings"
    " FROM (SELECT CASE WHEN quality = 1 THEN 'A' ELSE 'empty' END AS g FROM labels)"
)
def feature_profile_default(spark, sf_dir):
    reviews = documents(spark, sf_dir)["doc_reviews"]
    return profile.feature_profile(Namespace([reviews]), "grade")


@query(
    "SELECT 'quantity' AS feature, CAST(NULL AS VARCHAR) AS \"default\", CAST(count(*) AS BIGINT) AS n, min(v) AS lo,"
    " max(v) AS hi, CAST(0 AS BIGINT) AS n_strings FROM (SELECT DISTINCT o_orderkey, l_quantity AS v FROM orders"
    " LEFT JOIN lineitem ON l_orderkey = o_orderkey)"
)
def feature_profile_many(spark, sf_dir):
    """A typed multi-valued feature: smallest and largest compare as numbers."""
    return profile.feature_profile(orders(spark, sf_dir), "quantity")


@query("SELECT DISTINCT p_name AS value FROM part")
def feature_strings(spark, sf_dir):
    return profile.feature_strings(parts(spark, sf_dir), "p_name")


def _single(database, context, feature, source, total, default="CAST(NULL AS VARCHAR)"):
    return (
        f"SELECT '{database}' AS database, '{context}' AS context, '{feature}' AS feature, 'features' AS \"table\","
        f" '1:1' AS cardinality, {default} AS \"default\", CAST(count({source[1]}) AS BIGINT) AS n_set,"
        f" CAST(count(DISTINCT {source[1]}) AS BIGINT) AS n_distinct, 1 - count({source[1]}) / {total} AS unset_share"
        f" FROM {source[0]}"
    )


def _many(feature, column):
    return (
        f"SELECT 'ord_base', 'ord', '{feature}', '{feature}', '1:n', CAST(NULL AS VARCHAR),"
        f" CAST(count(DISTINCT l_orderkey) AS BIGINT), CAST(count(DISTINCT {column}) AS BIGINT),"
        f" 1 - count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders) FROM lineitem"
    )


_NORMAL = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"
_CATALOGUE = " UNION ALL ".join(
    [_single("ord_base", "ord", c, ("orders", c), "count(*)") for c in
     ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", "o_custkey")]
    + [_many(f, c) for f, c in (("returnflag", "l_returnflag"), ("linestatus", "l_linestatus"),
                                ("linenumber", "l_linenumber"), ("quantity", "l_quantity"),
                                ("suppkey", "l_suppkey"), ("to_prt", "l_partkey"))]
    + [_single("doc_base", "doc", c, ("documents", c), "count(*)") for c in ("lang", "source", "n_chars")]
    + [_single("doc_base", "doc", "digest", ("documents", _NORMAL), "count(*)")]
    + [_single("doc_labels", "doc", c, ("labels", c), "count(*)") for c in ("quality", "toxic")]
)


@query(_CATALOGUE)
def catalogue_profile(spark, sf_dir):
    namespace = Namespace(
        [orders(spark, sf_dir).first, documents_database(spark, sf_dir), labels_database(spark, sf_dir)]
    )
    return profile.catalogue_profile(namespace, exact=True)


_SKETCHED = ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", "o_custkey")


@query(
    " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, '1:1' AS cardinality, CAST(count({c}) AS BIGINT) AS n_values, TRUE AS near FROM orders"
         for c in _SKETCHED]
        + [f"SELECT '{f}', '1:n', CAST(count(DISTINCT (l_orderkey, {c})) AS BIGINT), TRUE FROM lineitem"
           for f, c in (("quantity", "l_quantity"), ("to_prt", "l_partkey"))]
    )
)
def catalogue_sketches(spark, sf_dir):
    """The profile from sketches kept per stored part: exact numbers of values, and whether the estimates of distinct
    values and entities lie within four standard errors of the exact ones."""
    database = orders_database(spark, sf_dir)
    database = database.with_parts(many={name: database.many[name] for name in ("quantity", "to_prt")})
    saved = tables.save_database(database, working_folder(spark, "sketched"))
    exact = profile.catalogue_profile(Namespace([saved])).select(
        "feature", F.col("n_set").alias("entities"), F.col("n_distinct").alias("values")
    )
    error = 4 * 1.04 / 2 ** (sketches.BITS / 2)
    found = sketches.sketch_profile(saved).join(exact, "feature")
    near = (F.abs(F.col("n_distinct") - F.col("values")) <= error * F.col("values")) & (
        F.abs(F.col("n_set") - F.col("entities")) <= error * F.col("entities")
    )
    return found.select("feature", "cardinality", "n_values", near.alias("near"))
