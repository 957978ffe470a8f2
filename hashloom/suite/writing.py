"""Queries of the writes on feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.operators import writes
from hashloom.plans.filters import feature
from hashloom.plans.namespace import Database, Namespace
from hashloom.plans.query import select
from hashloom.session import working_folder
from hashloom.sources import tables
from hashloom.suite.registry import (
    CONTEXTS,
    documents,
    documents_database,
    hashed,
    labels_database,
    orders,
    orders_database,
    query,
    table,
)

_FLAGS = "SELECT DISTINCT l_orderkey AS hash, l_returnflag AS value FROM lineitem"


def _flagged(spark, sf_dir) -> Database:
    """Documents with a text feature ``flag``: the quality of the labelled ones, else the default."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    entities = rows.select(F.col("doc_id").alias("hash"), "lang", F.col("quality").cast("string").alias("flag"))
    return Database.of("doc_flags", entities, defaults={"flag": "empty"}, contexts=CONTEXTS)


def _pairs(database: Database, name: str):
    return database.many[name].pairs()


@query("SELECT doc_id AS hash, lang, 'empty' AS flag FROM documents")
def add_feature(spark, sf_dir):
    changed = writes.add_feature(documents_database(spark, sf_dir), "flag", "empty")
    return changed.entities.select("hash", "lang", "flag")


@query("SELECT o_orderkey AS hash, 'open' AS state FROM orders UNION SELECT l_partkey + 100000000, 'open' FROM lineitem")
def init_entities(spark, sf_dir):
    """Hashes that only a multi-valued feature mentions become entities with the defaults."""
    entities = hashed(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("state", F.lit("open"))
    lines = table(spark, sf_dir, "lineitem")
    shipped = lines.select((F.col("l_partkey") + 100000000).alias("hash"), F.col("l_linenumber").alias("value"))
    database = Database.of("ord_new", entities, {"line": shipped}, {"state": "open"}, contexts=CONTEXTS)
    return writes.init_entities(database).entities


@query(
    "SELECT doc_id AS hash, CASE WHEN lang = 'en' THEN 'yes' ELSE coalesce(CAST(quality AS VARCHAR), 'empty') END AS flag"
    " FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT item_id + 100000000, 'yes' FROM benchmark"
)
def set_values_one(spark, sf_dir):
    database = _flagged(spark, sf_dir)
    english = database.entities.where(F.col("lang") == "en").select("hash")
    unknown = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100000000).alias("hash"))
    updates = english.union(unknown).withColumn("value", F.lit("yes"))
    changed = writes.set_values(database, "flag", updates)
    return changed.entities.select("hash", changed.single("flag").alias("flag"))


_RANGES = 64


@query(
    "SELECT doc_id AS hash, CASE WHEN doc_id IN (SELECT arg_max(doc_id, (length(text), doc_id)) FROM documents"
    " GROUP BY lang) THEN 'longest' ELSE coalesce(CAST(quality AS VARCHAR), 'empty') END AS flag"
    " FROM documents LEFT JOIN labels USING (doc_id)"
)
def set_values_in_ranges(spark, sf_dir):
    """A database stored in ranges, with a new flag for the longest document of each language: only the ranges of these are
    written again."""
    path = working_folder(spark, "ranges")
    stored = tables.save_database(_flagged(spark, sf_dir), path, ranges=_RANGES)
    texts = table(spark, sf_dir, "documents")
    longest = texts.groupBy("lang").agg(F.max_by("doc_id", F.struct(F.length("text"), "doc_id")).alias("hash"))
    updates = longest.select("hash", F.lit("longest").alias("value"))
    changed = tables.save_database(writes.set_values(stored, "flag", updates), path)
    return changed.entities.select("hash", changed.single("flag").alias("flag"))


@query(f"{_FLAGS} UNION SELECT o_orderkey, 'R' FROM orders WHERE o_orderstatus = 'F'")
def set_values_many(spark, sf_dir):
    finished = hashed(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey")
    changed = writes.set_values(orders_database(spark, sf_dir), "returnflag", finished.withColumn("value", F.lit("R")))
    return _pairs(changed, "returnflag")


_LAST = (
    "(SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)"
)


@query(
    "SELECT coalesce(o.o_custkey, e.user_id) AS hash, coalesce(e.click, -1.0) AS click, e.n_values FROM"
    " (SELECT DISTINCT o_custkey FROM orders) o FULL JOIN (SELECT user_id,"
    " arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click,"
    " CAST(count(DISTINCT value) FILTER (event_type = 'purchase') AS BIGINT) AS n_values FROM events GROUP BY 1) e"
    " ON o.o_custkey = e.user_id WHERE o.o_custkey IS NOT NULL OR e.click IS NOT NULL OR e.n_values > 0"
)
def set_values_batch(spark, sf_dir):
    """One batch of triples: the last click per customer, all purchases as a multi-valued feature."""
    customers = hashed(table(spark, sf_dir, "orders"), "o_custkey").distinct()
    database = Database.of("ord_customers", customers, contexts=CONTEXTS)
    database = writes.add_feature(database, "click", -1.0, "double")
    database = writes.add_feature(database, "purchase", data_type="double")
    triples = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("hash"), F.col("event_type").alias("feature"), "value", "ts", "event_id"
    )
    changed = writes.set_values_batch(database, triples, ["click", "purchase"], order=["ts", "event_id"])
    counts = _pairs(changed, "purchase").groupBy("hash").agg(F.count(F.lit(1)).alias("n_values"))
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("hash")).distinct()
    counts = users.join(counts, "hash", "left").na.fill(0, ["n_values"])
    return changed.entities.select("hash", "click").join(counts, "hash", "left")


@query(
    "SELECT doc_id AS hash, CASE WHEN lang = 'de' THEN 'german' ELSE coalesce(CAST(quality AS VARCHAR), 'empty') END AS flag"
    " FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT item_id + 100000000, 'german' FROM benchmark"
)
def set_by_query(spark, sf_dir):
    namespace = Namespace([_flagged(spark, sf_dir)])
    unknown = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100000000).alias("hash"))
    changed = writes.set_by_query(namespace, "flag", "german", feature("lang") == "de", create=unknown)
    return changed.entities.select("hash", changed.single("flag").alias("flag"))


@query(
    "SELECT doc_id AS hash, CASE WHEN quality = 1 THEN 'empty' ELSE coalesce(CAST(quality AS VARCHAR), 'empty') END AS flag"
    " FROM documents LEFT JOIN labels USING (doc_id)"
)
def reset_one(spark, sf_dir):
    changed = writes.reset_values(_flagged(spark, sf_dir), "flag", values=["1"])
    return changed.entities.select("hash", changed.single("flag").alias("flag"))


@query(
    "SELECT doc_id AS hash, CASE WHEN quality = 0 AND toxic = 1 THEN 'empty'"
    " ELSE coalesce(CAST(quality AS VARCHAR), 'empty') END AS flag FROM documents LEFT JOIN labels USING (doc_id)"
)
def reset_one_by_frames(spark, sf_dir):
    toxic = hashed(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    values = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("quality").cast("string").alias("value"))
    changed = writes.reset_values(_flagged(spark, sf_dir), "flag", values=values, hashes=toxic)
    return changed.entities.select("hash", changed.single("flag").alias("flag"))


@query(
    f"{_FLAGS} WHERE NOT (l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))"
)
def reset_many(spark, sf_dir):
    finished = hashed(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey")
    changed = writes.reset_values(orders_database(spark, sf_dir), "returnflag", ["R"], finished)
    return _pairs(changed, "returnflag")


@query(
    "SELECT o_orderkey AS hash, CASE WHEN bool_or(l_returnflag <> 'R') THEN"
    " string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_returnflag <> 'R') ELSE 'None' END AS returnflag"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def reset_many_leaves_unset(spark, sf_dir):
    """Entities whose values are all removed show None."""
    changed = writes.reset_values(orders_database(spark, sf_dir), "returnflag", ["R"])
    return select(Namespace([changed]), resolve=["returnflag"])


@query(
    "SELECT o_orderkey AS hash, o_orderstatus FROM orders"
    " WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
)
def delete_entities(spark, sf_dir):
    returned = hashed(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")
    changed = writes.delete_entities(orders_database(spark, sf_dir), returned)
    return changed.entities.select("hash", "o_orderstatus")


@query(
    "SELECT o_orderkey AS hash, o_orderstatus AS state,"
    " coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), 'None') AS returned"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"
)
def rename_feature(spark, sf_dir):
    changed = writes.rename_feature(orders_database(spark, sf_dir), "o_orderstatus", "state")
    changed = writes.rename_feature(changed, "returnflag", "returned")
    return select(Namespace([changed]), resolve=["state", "returned"])


@query("SELECT doc_id AS hash, toxic FROM labels")
def delete_feature(spark, sf_dir):
    return writes.delete_feature(labels_database(spark, sf_dir), "quality").entities


@query(f"{_FLAGS} UNION SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def copy_feature(spark, sf_dir):
    where = feature("o_totalprice") > 100000
    changed = writes.copy_feature(orders(spark, sf_dir), "o_orderstatus", "returnflag", "ord_base", where)
    return _pairs(changed, "returnflag")


@query("SELECT doc_id AS hash, CAST(quality AS INT) AS value FROM labels JOIN documents USING (doc_id) WHERE lang = 'en'")
def copy_feature_to_new(spark, sf_dir):
    """Across databases into a new feature, for the result of a query."""
    changed = writes.copy_feature(
        documents(spark, sf_dir), "quality", "grade_copy", "doc_base", feature("lang") == "en"
    )
    return _pairs(changed, "grade_copy")


@query(
    "SELECT user_id AS hash, max(CASE WHEN event_type = 'click' THEN value END) AS click,"
    " max(CASE WHEN event_type = 'error' THEN value END) AS error,"
    " max(CASE WHEN event_type = 'view' THEN value END) AS view,"
    " max(CASE WHEN event_type = 'signup' THEN value END) AS signup,"
    f" max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM {_LAST} GROUP BY 1"
)
def pivot_triples(spark, sf_dir):
    triples = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("hash"), F.col("event_type").alias("feature"), "value", "ts", "event_id"
    )
    return writes.pivot_triples(triples, ["click", "error", "view", "signup", "purchase"], ["ts", "event_id"])
