"""Queries of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.plans.filters import feature, number, term
from hashloom.plans.query import entity_hashes, select
from hashloom.suite.registry import documents, hashed, orders, parts, query, table


@query("SELECT o_orderkey AS hash FROM orders")
def pred_all(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir))


@query("SELECT o_orderkey AS hash FROM orders WHERE o_orderpriority = '1-URGENT'")
def pred_one_eq(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("o_orderpriority") == "1-URGENT")


@query("SELECT o_orderkey AS hash FROM orders WHERE o_orderpriority <> '1-URGENT'")
def pred_one_neq(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("o_orderpriority") != "1-URGENT")


@query("SELECT p_partkey AS hash FROM part WHERE p_brand < 'Brand#2' AND p_name >= 'green'")
def pred_one_order(spark, sf_dir):
    return entity_hashes(parts(spark, sf_dir), (feature("p_brand") < "Brand#2") & (feature("p_name") >= "green"))


@query("SELECT o_orderkey AS hash FROM orders WHERE o_totalprice > 100000")
def pred_one_compare_num(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("o_totalprice") > 100000)


@query(
    "SELECT o_orderkey AS hash FROM orders"
    " WHERE coalesce(try_cast(regexp_extract(o_orderpriority, '^[0-9]+') AS DOUBLE), 0) >= 3"
)
def pred_one_compare_text_as_num(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("o_orderpriority") >= 3)


@query("SELECT doc_id AS hash FROM documents WHERE source ILIKE 'SRC1%'")
def pred_one_like(spark, sf_dir):
    return entity_hashes(documents(spark, sf_dir), feature("source").like("SRC1%"))


@query("SELECT doc_id AS hash FROM documents WHERE source NOT ILIKE '%c1_'")
def pred_one_unlike(spark, sf_dir):
    return entity_hashes(documents(spark, sf_dir), feature("source").unlike("%C1_"))


_SOME = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"


@query("SELECT o_orderkey AS hash FROM orders WHERE " + _SOME.format("l_returnflag = 'R'"))
def pred_many_eq(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("returnflag") == "R")


@query("SELECT o_orderkey AS hash FROM orders WHERE NOT " + _SOME.format("l_returnflag = 'R'"))
def pred_many_neq(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("returnflag") != "R")


@query(
    "SELECT o_orderkey AS hash FROM orders WHERE "
    + _SOME.format("l_returnflag < 'R'")
    + " OR NOT "
    + _SOME.format("true")
)
def pred_many_order(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("returnflag") < "R")


@query("SELECT o_orderkey AS hash FROM orders WHERE " + _SOME.format("l_quantity > 45"))
def pred_many_compare_num(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("quantity") > 45)


@query("SELECT o_orderkey AS hash FROM orders WHERE " + _SOME.format("l_linenumber <> 1"))
def pred_many_other(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("linenumber") != 1)


@query("SELECT o_orderkey AS hash FROM orders WHERE " + _SOME.format("l_linestatus ILIKE 'o%'"))
def pred_many_like(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("linestatus").like("o%"))


@query("SELECT o_orderkey AS hash FROM orders WHERE NOT " + _SOME.format("l_linestatus ILIKE 'o%'"))
def pred_many_unlike(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("linestatus").unlike("o%"))


@query("SELECT o_orderkey AS hash FROM orders WHERE NOT " + _SOME.format("true"))
def pred_many_unset(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("returnflag").is_unset())


@query("SELECT p_partkey AS hash FROM part WHERE p_retailprice > (p_size * 30.0 + 600)")
def pred_term_one(spark, sf_dir):
    return entity_hashes(parts(spark, sf_dir), feature("p_retailprice") > term("p_size") * 30.0 + 600)


@query("SELECT o_orderkey AS hash FROM orders WHERE NOT " + _SOME.format("l_quantity = (o_custkey / 10)"))
def pred_term_neq_many(spark, sf_dir):
    return entity_hashes(orders(spark, sf_dir), feature("quantity") != term("o_custkey") / 10)


@query(
    "SELECT DISTINCT o_orderkey AS hash, l_quantity AS quantity FROM orders JOIN lineitem"
    " ON l_orderkey = o_orderkey WHERE l_quantity > (o_totalprice / 10000)"
)
def pred_term_rows(spark, sf_dir):
    where = feature("quantity") > term("o_totalprice") / 10000
    return select(orders(spark, sf_dir), where, ["quantity"], collapse=None)


@query(
    "SELECT o_orderkey AS hash FROM orders WHERE (o_orderstatus = 'F' OR "
    + _SOME.format("l_returnflag = 'R'")
    + ") AND NOT "
    + _SOME.format("l_linenumber = 7")
)
def pred_bool_tree(spark, sf_dir):
    where = ((feature("o_orderstatus") == "F") | (feature("returnflag") == "R")) & ~(feature("linenumber") == 7)
    return entity_hashes(orders(spark, sf_dir), where)


@query(
    "SELECT o_orderkey AS hash FROM orders WHERE NOT ("
    + _SOME.format("l_quantity >= 49 AND l_quantity IS NOT NULL")
    + " OR (o_totalprice < 50000 AND NOT "
    + _SOME.format("l_linestatus = 'F'")
    + ")) AND ("
    + _SOME.format("l_returnflag = 'A'")
    + " OR "
    + _SOME.format("l_suppkey < 20")
    + ")"
)
def pred_bool_tree_one_scan(spark, sf_dir):
    dear = feature("quantity") >= 49
    small = (feature("o_totalprice") < 50000) & (feature("linestatus") != "F")
    where = ~(dear | small) & ((feature("returnflag") == "A") | (feature("suppkey") < 20))
    return entity_hashes(orders(spark, sf_dir), where)


@query(
    "SELECT doc_id AS hash FROM documents JOIN labels USING (doc_id)"
    " WHERE NOT (quality = 1 AND toxic = 0) AND (quality <> 1 OR lang = 'en')"
)
def pred_three_valued(spark, sf_dir):
    """Documents without labels satisfy neither a condition on a label nor its negation."""
    good = (feature("quality") == 1) & (feature("toxic") == 0)
    where = ~good & ((feature("quality") != 1) | (feature("lang") == "en"))
    return entity_hashes(documents(spark, sf_dir), where & ((feature("quality") != 1) | (feature("quality") == 1)))


@query(
    "SELECT doc_id AS hash FROM documents JOIN labels USING (doc_id)"
    " WHERE NOT (quality = 1) AND (toxic <> 1 OR lang = 'fr')"
)
def pred_three_valued_many(spark, sf_dir):
    """The same for a multi-valued feature: unset tags satisfy a negation, unknown documents do not."""
    where = (feature("tag") != "good") & ((feature("tag") != "toxic") | (feature("lang") == "fr"))
    return entity_hashes(documents(spark, sf_dir), where)


@query("SELECT doc_id AS hash FROM documents SEMI JOIN labels USING (doc_id) WHERE n_chars > 1000")
def id_list_filter(spark, sf_dir):
    listed = hashed(table(spark, sf_dir, "labels"), "doc_id")
    return entity_hashes(documents(spark, sf_dir), feature("n_chars") > 1000, listed)


@query(
    "SELECT l_returnflag AS returnflag, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS o_orderstatus"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IS NOT NULL GROUP BY 1"
)
def drop_null_key(spark, sf_dir):
    """Orders without lines have no key when a feature of the lines is the key."""
    return select(orders(spark, sf_dir), resolve=["o_orderstatus"], collapse="count", group_by="returnflag")


@query(
    "SELECT p_partkey AS hash, (p_retailprice - 900) * 2 + 7 // 2 AS a,"
    " p_retailprice / nullif(p_size - 11, 0) AS b FROM part"
)
def arith(spark, sf_dir):
    """Arithmetic of terms: whole constants divide without a fraction, division by zero is null."""

    def of(address):
        return F.col(address).cast("double")

    doubled = (term("p_retailprice") - 900) * 2 + number(7) / number(2)
    ratio = term("p_retailprice") / (term("p_size") - 11)
    part = hashed(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", "p_size")
    return part.select("hash", doubled.build(of).alias("a"), ratio.build(of).alias("b"))
