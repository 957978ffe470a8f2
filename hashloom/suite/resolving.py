"""Queries of feature resolution, joins, collapse and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.operators import identity, paging
from hashloom.plans.filters import feature, term
from hashloom.plans.namespace import Database, Namespace, Values
from hashloom.plans.query import select
from hashloom.session import working_folder, written
from hashloom.suite.registry import (
    documents,
    documents_database,
    hashed,
    orders,
    orders_and_parts,
    pages_database,
    parts,
    query,
    table,
)


@query(
    "SELECT o_orderkey AS hash, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS returnflag"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'"
    " GROUP BY 1 HAVING bool_or(l_returnflag = 'R')"
)
def urgent_returned_orders(spark, sf_dir):
    """Urgent orders with a returned line, resolved to their return flags, in key order."""
    where = (feature("o_orderpriority") == "1-URGENT") & (feature("returnflag") == "R")
    return select(orders(spark, sf_dir), where, ["returnflag"], ordered=True)


# ---- resolution ----------------------------------------------------------------------------


@query(
    "SELECT doc_id AS hash, source, CASE WHEN l.doc_id IS NOT NULL THEN 'reviewed' END AS doc_reviews__source"
    " FROM documents LEFT JOIN labels l USING (doc_id)"
)
def resolve_by_precedence(spark, sf_dir):
    """The first database with the feature wins; the prefix reaches the other copy."""
    return select(documents(spark, sf_dir), resolve=["source", "doc_reviews:source"], collapse=None)


@query("SELECT p_partkey AS hash, p_brand, p_size FROM part WHERE p_type = 'ECONOMY'")
def resolve(spark, sf_dir):
    where = feature("p_type") == "ECONOMY"
    return select(parts(spark, sf_dir), where, ["prt:p_brand", "prt_base:p_size"], collapse=None)


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, sf_dir):
    return select(documents(spark, sf_dir), resolve=["source"], collapse=None, group_by="lang")


@query("SELECT doc_id AS hash, CASE WHEN quality = 1 THEN 'A' ELSE 'empty' END AS grade FROM labels")
def default_fill(spark, sf_dir):
    namespace = documents(spark, sf_dir)
    return select(Namespace([namespace["doc_reviews"]]), resolve=["grade"], collapse=None)


@query(
    "SELECT doc_id AS hash, CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 AND toxic = 1 THEN 'good,toxic'"
    " WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'toxic' ELSE 'None' END AS tag"
    " FROM documents LEFT JOIN labels l USING (doc_id)"
)
def unset_fill(spark, sf_dir):
    """A known document without tags shows None, an unknown one nothing."""
    return select(documents(spark, sf_dir), resolve=["tag"], group_by="doc:hash")


# ---- joins ---------------------------------------------------------------------------------


@query(
    "SELECT doc_id AS hash, lang, CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'A'"
    " ELSE 'empty' END AS grade FROM documents LEFT JOIN labels l USING (doc_id)"
)
def join_same_context_one(spark, sf_dir):
    return select(documents(spark, sf_dir), resolve=["lang", "grade"], collapse=None)


_TAGS = (
    "SELECT doc_id, 'good' AS tag FROM labels WHERE quality = 1 UNION ALL"
    " SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL"
    " SELECT doc_id, 'None' FROM labels WHERE quality = 0 AND toxic = 0"
)


@query(f"SELECT doc_id AS hash, lang, tag FROM documents LEFT JOIN ({_TAGS}) USING (doc_id)")
def join_same_context_many(spark, sf_dir):
    return select(documents(spark, sf_dir), resolve=["lang", "tag"], collapse=None)


@query("SELECT d.doc_id AS hash, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def resolve_left(spark, sf_dir):
    return select(documents(spark, sf_dir), resolve=["lang", "quality"], collapse=None)


@query("SELECT d.doc_id AS hash, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def resolve_inner(spark, sf_dir):
    return select(documents(spark, sf_dir), resolve=["lang", "quality"], collapse=None, how="inner")


@query(
    "SELECT coalesce(l.doc_id, d.doc_id) AS hash, l.quality, d.lang"
    " FROM labels l FULL JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)"
)
def resolve_full(spark, sf_dir):
    """Entities that only a later database knows are kept by a full join."""
    namespace = documents(spark, sf_dir)
    base = namespace["doc_base"]
    english = base.with_parts(entities=base.entities.where(F.col("lang") == "en"))
    merged = Namespace([namespace["doc_labels"], english])
    return select(merged, resolve=["quality", "lang"], collapse=None, how="full")


@query(
    "SELECT doc_id AS hash, quality, toxic, lang FROM documents JOIN labels USING (doc_id)"
    " WHERE quality = 1 OR (toxic = 1 AND lang = 'en')"
)
def join_once(spark, sf_dir):
    """Two features of one table in the filter and the result: one join."""
    where = (feature("quality") == 1) | ((feature("toxic") == 1) & (feature("lang") == "en"))
    return select(documents(spark, sf_dir), where, ["quality", "toxic", "lang"], collapse=None, group_by="doc:hash")


@query(
    "SELECT DISTINCT o_orderkey AS hash, coalesce(l_returnflag, 'None') AS returnflag"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"
)
def resolve_multi_rows(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["returnflag"], collapse=None)


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def collapse_none(spark, sf_dir):
    """Without collapse every combination of values is a row."""
    columns = ["o_orderstatus", "o_orderpriority"]
    return select(orders(spark, sf_dir), resolve=columns, collapse="none", group_by="o_custkey")


@query(
    "SELECT DISTINCT o_orderkey AS hash, coalesce(a.l_returnflag, 'None') AS returnflag, b.l_linenumber AS linenumber"
    " FROM orders LEFT JOIN lineitem a ON a.l_orderkey = o_orderkey LEFT JOIN lineitem b ON b.l_orderkey = o_orderkey"
)
def resolve_two_multi_rows(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["returnflag", "linenumber"], collapse=None, how="inner")


@query(
    "SELECT o_orderkey AS hash,"
    " coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), 'None') AS returnflag,"
    " coalesce(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus), 'None') AS linestatus"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def resolve_two_multi_collapsed(spark, sf_dir):
    """Several multi-valued features collapse one by one: they never multiply."""
    return select(orders(spark, sf_dir), resolve=["returnflag", "linestatus"])


@query(
    "SELECT DISTINCT o_orderkey AS hash, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
    " JOIN part ON p_partkey = l_partkey"
)
def resolve_cross_context(spark, sf_dir):
    namespace = orders_and_parts(spark, sf_dir)
    return select(namespace, resolve=["p_brand"], collapse=None, group_by="ord:hash")


@query(
    "SELECT p_partkey AS hash, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS o_orderstatus"
    " FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey"
    " WHERE p_size > 25 AND o_totalprice > 200000 GROUP BY 1"
)
def resolve_cross_context_backwards(spark, sf_dir):
    """The translator read from its values to its hashes, with a filter on both sides."""
    where = (feature("p_size") > 25) & (feature("o_totalprice") > 200000)
    return select(orders_and_parts(spark, sf_dir), where, ["o_orderstatus"], group_by="prt:hash")


@query(
    "SELECT DISTINCT o_orderkey AS hash FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
    " JOIN part ON p_partkey = l_partkey WHERE p_size > 45 OR o_orderstatus = 'P'"
)
def filter_cross_context(spark, sf_dir):
    """A filter across contexts: some linked part satisfies it."""
    where = (feature("p_size") > 45) | (feature("o_orderstatus") == "P")
    return select(orders_and_parts(spark, sf_dir), where, collapse=None, group_by="ord:hash")


@query(
    "SELECT DISTINCT p_partkey AS hash FROM part JOIN lineitem ON l_partkey = p_partkey"
    " WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
)
def filter_cross_context_many(spark, sf_dir):
    """A condition on a multi-valued feature of the other context."""
    where = feature("returnflag") == "R"
    return select(orders_and_parts(spark, sf_dir), where, collapse=None, group_by="prt:hash")


@query("SELECT o_orderkey AS hash FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def semi_join(spark, sf_dir):
    return select(orders(spark, sf_dir), feature("quantity") > 48, collapse=None)


@query(
    "SELECT o_orderkey AS hash FROM orders"
    " WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')"
)
def anti_join(spark, sf_dir):
    return select(orders(spark, sf_dir), feature("linestatus") != "O", collapse=None)


@query(
    "SELECT DISTINCT l_suppkey AS suppkey, o_orderstatus FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"
)
def join_on_many_key(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["o_orderstatus"], collapse=None, group_by="suppkey")


# ---- collapse ------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey AS hash, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), 'None')"
    " AS returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def collapse_concat(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["returnflag"])


@query(
    "SELECT o_orderkey AS hash, coalesce(min(l_returnflag), 'None') AS returnflag, min(l_linenumber) AS linenumber"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def collapse_min(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["returnflag", "linenumber"], collapse="min")


@query(
    "SELECT o_orderkey AS hash, coalesce(max(l_returnflag), 'None') AS returnflag, max(l_linenumber) AS linenumber"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def collapse_max(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["returnflag", "linenumber"], collapse="max")


@query(
    "SELECT o_custkey, min(o_orderpriority) AS low, min(o_totalprice) AS cheap, max(o_orderpriority) AS high,"
    " max(o_totalprice) AS dear FROM orders GROUP BY 1"
)
def collapse_min_max(spark, sf_dir):
    namespace, columns = orders(spark, sf_dir), ["o_orderpriority", "o_totalprice"]
    low = select(namespace, resolve=columns, collapse="min", group_by="o_custkey").toDF("o_custkey", "low", "cheap")
    high = select(namespace, resolve=columns, collapse="max", group_by="o_custkey").toDF("o_custkey", "high", "dear")
    return low.join(high, "o_custkey")


@query(
    "SELECT l_orderkey AS hash, min(CAST(l_linenumber * 5 AS VARCHAR)) AS lo, max(CAST(l_linenumber * 5 AS VARCHAR)) AS hi"
    " FROM lineitem GROUP BY 1"
)
def collapse_min_max_text(spark, sf_dir):
    """Text compares as text: 10 before 5."""
    lines = table(spark, sf_dir, "lineitem")
    text = (F.col("l_linenumber") * 5).cast("string")
    values = lines.select(F.col("l_orderkey").alias("hash"), text.alias("value"))
    namespace = Namespace([Database.of("ord_text", many={"five": values}, context="ord")])
    low = select(namespace, resolve=["five"], collapse="min").withColumnRenamed("five", "lo")
    high = select(namespace, resolve=["five"], collapse="max").withColumnRenamed("five", "hi")
    return low.join(high, "hash")


@query(
    "SELECT o_orderkey AS hash, CAST(sum(DISTINCT l_quantity) AS BIGINT) AS quantity"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def collapse_sum(spark, sf_dir):
    result = select(orders(spark, sf_dir), resolve=["quantity"], collapse="sum")
    return result.withColumn("quantity", F.col("quantity").cast("bigint"))


@query(
    "SELECT o_orderkey AS hash, CAST(round(avg(DISTINCT l_quantity) * 1000) AS BIGINT) AS quantity"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def collapse_avg(spark, sf_dir):
    result = select(orders(spark, sf_dir), resolve=["quantity"], collapse="avg")
    return result.withColumn("quantity", F.round(F.col("quantity") * 1000).cast("bigint"))


@query(
    "SELECT o_orderkey AS hash, CAST(count(DISTINCT l_quantity) AS BIGINT) AS quantity,"
    " greatest(1, CAST(count(DISTINCT l_returnflag) AS BIGINT)) AS returnflag"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def collapse_count(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["quantity", "returnflag"], collapse="count")


@query(
    "SELECT l_orderkey AS hash, CAST(count(DISTINCT l_quantity) AS BIGINT) AS n,"
    " sum(DISTINCT l_quantity) AS s, avg(DISTINCT l_quantity) AS a FROM lineitem GROUP BY 1"
)
def collapse_num(spark, sf_dir):
    namespace = orders(spark, sf_dir)
    lines = namespace["ord_base"].many["quantity"]
    only = Namespace([Database.of("ord_lines", many={"quantity": lines}, context="ord")])
    counted = select(only, resolve=["quantity"], collapse="count").withColumnRenamed("quantity", "n")
    summed = select(only, resolve=["quantity"], collapse="sum").withColumnRenamed("quantity", "s")
    averaged = select(only, resolve=["quantity"], collapse="avg").withColumnRenamed("quantity", "a")
    return counted.join(summed, "hash").join(averaged, "hash")


@query(
    "SELECT o_orderstatus, CAST(sum(v) AS BIGINT) AS o_orderpriority FROM (SELECT DISTINCT o_orderstatus,"
    " o_orderpriority, CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS INT) AS v FROM orders) GROUP BY 1"
)
def collapse_sum_text(spark, sf_dir):
    """Distinct texts are read as numbers and added."""
    result = select(orders(spark, sf_dir), resolve=["o_orderpriority"], collapse="sum", group_by="o_orderstatus")
    return result.withColumn("o_orderpriority", F.col("o_orderpriority").cast("bigint"))


@query("SELECT lang, CAST(count(DISTINCT source) AS BIGINT) AS source FROM documents GROUP BY 1")
def group_by_feature(spark, sf_dir):
    return select(documents(spark, sf_dir), resolve=["source"], collapse="count", group_by="lang")


@query(
    "SELECT l_returnflag AS returnflag, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS o_orderpriority"
    " FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"
)
def group_by_many(spark, sf_dir):
    return select(orders(spark, sf_dir), resolve=["o_orderpriority"], collapse="count", group_by="returnflag")


@query(
    "SELECT o_orderpriority, string_agg(DISTINCT coalesce(l_returnflag, 'None'), ',' ORDER BY coalesce(l_returnflag, 'None'))"
    " AS returnflag, string_agg(DISTINCT coalesce(l_linestatus, 'None'), ',' ORDER BY coalesce(l_linestatus, 'None')) AS linestatus"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
)
def group_by_feature_many_values(spark, sf_dir):
    namespace = orders(spark, sf_dir)
    return select(namespace, resolve=["returnflag", "linestatus"], group_by="o_orderpriority")


@query(
    "SELECT p_brand, min(p_name) AS p_name, min(p_type) AS p_type, min(p_size) AS p_size,"
    " min(p_retailprice) AS p_retailprice FROM part GROUP BY 1"
)
def collapse_all(spark, sf_dir):
    columns = ["p_name", "p_type", "p_size", "p_retailprice"]
    return select(parts(spark, sf_dir), resolve=columns, collapse="min", group_by="p_brand")


@query(
    "SELECT o_orderkey AS hash, string_agg(DISTINCT CAST(CAST(l_quantity AS INT) AS VARCHAR), ','"
    " ORDER BY CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS quantity"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > (o_totalprice / 10000) GROUP BY 1"
)
def collapse_term_rows(spark, sf_dir):
    """A term comparison keeps rows, so a collapsed copy of the feature shows only those."""
    namespace = orders(spark, sf_dir)
    base = namespace["ord_base"]
    text = base.many["quantity"].frame.withColumn("l_quantity", F.col("l_quantity").cast("int").cast("string"))
    changed = Namespace([base.with_parts(many=base.many | {"quantity": Values(text, "l_quantity")})])
    return select(changed, feature("quantity") > term("o_totalprice") / 10000, ["quantity"])


_DIGEST = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query(
    f"SELECT {_DIGEST} AS digest, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS representative FROM documents GROUP BY 1"
)
def equivalence_classes(spark, sf_dir):
    return identity.equivalence_classes(documents_database(spark, sf_dir).entities)


@query(
    f"SELECT doc_id AS hash, digest, CAST(count(*) OVER (PARTITION BY digest) AS BIGINT) AS n,"
    f" min(doc_id) OVER (PARTITION BY digest) AS representative FROM (SELECT doc_id, {_DIGEST} AS digest FROM documents)"
)
def equivalence_class_members(spark, sf_dir):
    digests = documents_database(spark, sf_dir).entities.select("hash", "digest")
    return identity.class_members(written(digests, "digests"))


_ENDS = "(SELECT doc_id, left(t, 40) AS opening, right(t, 40) AS ending FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents))"
_STARS = " UNION ALL ".join(
    f"SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY {c}) AS b FROM ends WHERE {c} IS NOT NULL" for c in ("opening", "ending")
)


@query(
    f"WITH RECURSIVE ends AS MATERIALIZED {_ENDS}, stars AS MATERIALIZED ({_STARS}),"
    " links AS MATERIALIZED (SELECT a, b FROM stars UNION SELECT b, a FROM stars),"
    " reached(hash, label) AS (SELECT doc_id, doc_id FROM ends UNION"
    " SELECT b, label FROM reached JOIN links ON a = hash WHERE label < b),"
    " classes AS (SELECT hash, min(label) AS representative FROM reached GROUP BY 1)"
    " SELECT hash, representative, CAST(count(*) OVER (PARTITION BY representative) AS BIGINT) AS n FROM classes"
)
def equivalence_classes_of_two_digests(spark, sf_dir):
    """Documents that begin or end alike, through others too: classes over two digest features."""
    normal = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\f\r]+", " "))
    ends = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("hash"),
        F.md5(F.left(normal, F.lit(40))).alias("opening"),
        F.md5(F.right(normal, F.lit(40))).alias("ending"),
    )
    return identity.connected_classes(written(ends, "ends"), ["opening", "ending"])


@query(f"SELECT {_DIGEST} AS digest, CAST(min(doc_id) AS BIGINT) AS hash FROM documents GROUP BY 1")
def group_by_digest(spark, sf_dir):
    """The digest is a feature, so grouping by it gives the classes."""
    return select(documents(spark, sf_dir), resolve=["hash"], collapse="min", group_by="digest")


# ---- order and pages -----------------------------------------------------------------------


@query("SELECT o_orderkey AS hash, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY 1")
def order_by_key(spark, sf_dir):
    namespace = orders(spark, sf_dir)
    return select(namespace, feature("o_orderstatus") == "P", ["o_orderpriority"], ordered=True)


@query("SELECT o_orderkey AS hash, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 1000")
def page(spark, sf_dir):
    return paging.page(select(orders(spark, sf_dir), resolve=["o_orderstatus"]), "hash", 1)


@query(
    f"SELECT doc_id AS hash, lang, source, CAST(n_chars AS VARCHAR) AS n_chars, {_DIGEST} AS digest FROM documents"
    " WHERE n_chars > 200 ORDER BY 1 LIMIT 1000"
)
def page_all_features(spark, sf_dir):
    """The first page of a filter with all features of one database."""
    namespace = documents(spark, sf_dir)
    features = [f"doc_base:{name}" for name in namespace.feature_names("doc_base")]
    return paging.page(select(namespace, feature("n_chars") > 200, features), "hash", 0)


@query("SELECT o_orderkey AS hash, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 11000")
def page_deep(spark, sf_dir):
    """The same far from the start, found through the sizes of key ranges."""
    return paging.page(select(orders(spark, sf_dir), resolve=["o_orderstatus"]), "hash", 11, top_rows=2000)


@query("SELECT doc_id AS hash, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100")
def page_stored(spark, sf_dir):
    """A page of a result that was stored in ranges with fences."""
    path = working_folder(spark, "pages")
    paging.store_pages(select(documents(spark, sf_dir), resolve=["lang"]), "hash", path, range_rows=2000)
    return paging.stored_page(spark, path, "hash", 1, 100)


@query("SELECT o_orderkey AS hash, o_orderstatus FROM orders WHERE o_orderkey > 777 ORDER BY 1 LIMIT 1000")
def page_following(spark, sf_dir):
    return paging.page_after(select(orders(spark, sf_dir), resolve=["o_orderstatus"]), "hash", 777)


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS pages FROM orders")
def page_count(spark, sf_dir):
    return paging.page_count(select(orders(spark, sf_dir), collapse=None))


@query(
    "SELECT page_id AS hash, min(url) AS local, min(list_extract(string_split(url, '/'), -1)) AS filename"
    " FROM pages SEMI JOIN benchmark ON page_id = item_id GROUP BY 1"
)
def lookup_entity(spark, sf_dir):
    wanted = hashed(table(spark, sf_dir, "benchmark"), "item_id")
    return paging.lookup_entity(Namespace([pages_database(spark, sf_dir)]), wanted)
