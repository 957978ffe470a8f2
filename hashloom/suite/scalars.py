"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import digest, numbers, text
from hashloom.sources.files import keep_suffixes
from hashloom.suite.registry import query, table

#: Texts of many shapes made from the tables, the same in SQL below.
_TEXTS = """(
    SELECT 'order ' || o_orderkey AS id, o_orderpriority AS value FROM orders
    UNION ALL SELECT 'part ' || p_partkey, p_brand FROM part
    UNION ALL SELECT 'size ' || p_partkey, '00' || p_size FROM part
    UNION ALL SELECT 'whole ' || p_partkey, '+' || p_size || '.0' FROM part
    UNION ALL SELECT 'price ' || o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) FROM orders
    UNION ALL SELECT 'mixed ' || p_partkey, ' ' || p_size || 'e2x' FROM part
    UNION ALL SELECT 'power ' || p_partkey, p_size || 'e2' FROM part
    UNION ALL SELECT 'small ' || p_partkey, '0.0000' || (p_size + 1) FROM part
    UNION ALL SELECT 'page ' || page_id, url FROM pages
    UNION ALL SELECT 'label ' || doc_id, CASE WHEN toxic = 1 THEN 'nan' WHEN quality = 1 THEN 'inf' ELSE '.' END FROM labels
)"""


def _texts(spark, sf_dir):
    def rows(name, prefix, key, value):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix + " "), F.col(key).cast("string")).alias("id"), value.alias("value")
        )

    size = F.col("p_size").cast("string")
    verdict = F.when(F.col("toxic") == 1, "nan").when(F.col("quality") == 1, "inf").otherwise(".")
    parts = [
        rows("orders", "order", "o_orderkey", F.col("o_orderpriority")),
        rows("part", "part", "p_partkey", F.col("p_brand")),
        rows("part", "size", "p_partkey", F.concat(F.lit("00"), size)),
        rows("part", "whole", "p_partkey", F.concat(F.lit("+"), size, F.lit(".0"))),
        rows("orders", "price", "o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").cast("string")),
        rows("part", "mixed", "p_partkey", F.concat(F.lit(" "), size, F.lit("e2x"))),
        rows("part", "power", "p_partkey", F.concat(size, F.lit("e2"))),
        rows("part", "small", "p_partkey", F.concat(F.lit("0.0000"), (F.col("p_size") + 1).cast("string"))),
        rows("pages", "page", "page_id", F.col("url")),
        rows("labels", "label", "doc_id", verdict),
    ]
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.union(part)
    return frame


_PREFIX = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


@query(f"SELECT id, coalesce(try_cast(regexp_extract(value, '{_PREFIX}', 1) AS DOUBLE), 0.0) AS number FROM {_TEXTS}")
def num_prefix(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", numbers.num_prefix(F.col("value")).alias("number"))


@query(
    r"SELECT id, CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN CAST(CAST(value AS BIGINT) AS VARCHAR)"
    r" WHEN regexp_full_match(value, '[+-]?[0-9]+(\.0|e2)') THEN CAST(CAST(CAST(value AS DOUBLE) AS BIGINT) AS VARCHAR)"
    r" WHEN id LIKE 'price %' THEN rtrim(rtrim(value, '0'), '.')"
    r" WHEN id LIKE 'small %' THEN CASE WHEN length(rtrim(substr(value, 7), '0')) = 1 THEN rtrim(substr(value, 7), '0')"
    r" ELSE substr(value, 7, 1) || '.' || rtrim(substr(value, 8), '0') END || 'e-05'"
    f" ELSE value END AS value FROM {_TEXTS}"
)
def convert_value(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", numbers.convert_value(F.col("value")).alias("value"))


@query(
    r"SELECT id, regexp_full_match(value, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[0-9]+)?') OR value IN ('inf', 'nan')"
    f" AS holds FROM {_TEXTS}"
)
def is_number(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", numbers.is_number(F.col("value")).alias("holds"))


@query(
    r"SELECT id, CASE WHEN starts_with(value, 'http') THEN 'link' WHEN regexp_full_match(value, '[0-9]+') THEN 'integer'"
    r" WHEN regexp_full_match(value, '[+-]?[0-9]+(\.[0-9]+)?') THEN 'decimal' ELSE 'text' END AS kind,"
    r" CASE WHEN regexp_full_match(value, '[+-]?[0-9]+\.[0-9]+')"
    f" THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) ELSE value END AS shown FROM {_TEXTS}"
)
def display_kind(spark, sf_dir):
    value = F.col("value")
    shown = numbers.display_value(value).alias("shown")
    return _texts(spark, sf_dir).select("id", numbers.display_kind(value).alias("kind"), shown)


_FORMS = {
    "int": r"[+-]?[0-9]+",
    "real": r"[+-]?[0-9]+(\.[0-9]+)?",
    "bool": r"(?i:true|false|yes|no)",
    "url": r"https?://.*",
}
_INFERRED = (
    "CASE WHEN bool_and(regexp_full_match(value, '[0-9a-f]{32}')) THEN 'hash' "
    + " ".join(f"WHEN bool_and(regexp_full_match(value, '{form}')) THEN '{name}'" for name, form in _FORMS.items())
    + " ELSE 'text' END"
)


@query(
    f"SELECT feature, {_INFERRED} AS type FROM ("
    " SELECT 'p_size' AS feature, CAST(p_size AS VARCHAR) AS value FROM part"
    " UNION ALL SELECT 'p_retailprice', CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS VARCHAR) FROM part"
    " UNION ALL SELECT 'p_name', p_name FROM part"
    " UNION ALL SELECT 'url', url FROM pages"
    " UNION ALL SELECT 'digest', md5(text) FROM documents"
    " UNION ALL SELECT 'good', CASE WHEN quality = 1 THEN 'yes' ELSE 'No' END FROM labels) GROUP BY 1"
)
def infer_type(spark, sf_dir):
    def inferred(name, feature, value):
        rows = table(spark, sf_dir, name).select(value.alias("value"))
        return rows.agg(numbers.infer_type(F.col("value")).alias("type")).select(F.lit(feature).alias("feature"), "type")

    good = F.when(F.col("quality") == 1, "yes").otherwise("No")
    return (
        inferred("part", "p_size", F.col("p_size"))
        .union(inferred("part", "p_retailprice", F.col("p_retailprice").cast("decimal(15,2)")))
        .union(inferred("part", "p_name", F.col("p_name")))
        .union(inferred("pages", "url", F.col("url")))
        .union(inferred("documents", "digest", F.md5("text")))
        .union(inferred("labels", "good", good))
    )


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS file FROM pages")
def base_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(F.col("url")).alias("file"))


_PATHS = """(
    SELECT o_orderkey AS id, '/data/' || replace(lower(o_orderpriority), ' ', '_')
        || CASE o_orderstatus WHEN 'F' THEN '.cnf' WHEN 'O' THEN '.sanitized.cnf.xz' ELSE '.wcnf.gz' END AS path
    FROM orders UNION ALL SELECT -page_id - 1, url FROM pages)"""


def _paths(spark, sf_dir):
    ending = F.when(F.col("o_orderstatus") == "F", ".cnf").when(F.col("o_orderstatus") == "O", ".sanitized.cnf.xz")
    stem = F.translate(F.lower("o_orderpriority"), " ", "_")
    path = F.concat(F.lit("/data/"), stem, ending.otherwise(".wcnf.gz"))
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"))
    return named.union(table(spark, sf_dir, "pages").select(-F.col("page_id") - 1, "url"))


_STRIPPED = r"regexp_replace(path, '\.cnf(|\.gz|\.lzma|\.xz|\.bz2)$', '')"


@query(f"SELECT id, {_STRIPPED} AS stem FROM {_PATHS}")
def strip_suffix(spark, sf_dir):
    stem = text.strip_suffix(F.col("path"), text.Contexts().suffixes("cnf"))
    return _paths(spark, sf_dir).select("id", stem.alias("stem"))


@query(f"SELECT id, {_STRIPPED} || '.kis.xz' AS target FROM {_PATHS}")
def target_path(spark, sf_dir):
    target = text.target_path(F.col("path"), text.Contexts().suffixes("cnf"), ".kis", "xz")
    return _paths(spark, sf_dir).select("id", target.alias("target"))


@query(
    "SELECT id, CASE WHEN path LIKE '%.cnf' OR path LIKE '%.cnf.xz' THEN 'cnf' WHEN path LIKE '%.wcnf.gz' THEN 'wcnf' END"
    f" AS context FROM {_PATHS}"
)
def context_by_suffix(spark, sf_dir):
    context = text.context_by_suffix(F.col("path"), text.Contexts())
    return _paths(spark, sf_dir).select("id", context.alias("context"))


@query(f"SELECT id, path FROM {_PATHS} WHERE path LIKE '%.wcnf.gz'")
def files_of_context(spark, sf_dir):
    return keep_suffixes(_paths(spark, sf_dir), F.col("path"), text.Contexts().suffixes("wcnf"))


_STEM = r"regexp_replace(list_extract(string_split(path, '/'), -1), '^(\.*[^.].*)\.[^.]*$', '\1')"
_NAME = f"regexp_replace(CASE WHEN regexp_matches({_STEM}, '^[0-9]') THEN 'cnf_' ELSE '' END || {_STEM}, '[^a-zA-Z0-9]', '_', 'g')"


@query(f"SELECT id, {_NAME} AS name FROM {_PATHS}")
def database_name(spark, sf_dir):
    name = text.database_name(F.col("path"), text.Contexts())
    return _paths(spark, sf_dir).select("id", name.alias("name"))


_NAMES = """(
    SELECT doc_id, CASE lang WHEN 'en' THEN 'wcnf_' WHEN 'de' THEN 'kis_' WHEN 'fr' THEN 'kis' ELSE lang || '_' END || source
    AS name FROM documents)"""


@query(
    "SELECT doc_id, CASE WHEN name LIKE 'wcnf\\_%' ESCAPE '\\' THEN 'wcnf' WHEN name LIKE 'kis\\_%' ESCAPE '\\' THEN 'kis'"
    f" ELSE 'cnf' END AS context FROM {_NAMES}"
)
def context_of(spark, sf_dir):
    lang = F.col("lang")
    head = F.when(lang == "en", "wcnf_").when(lang == "de", "kis_").when(lang == "fr", "kis")
    name = F.concat(head.otherwise(F.concat(lang, F.lit("_"))), F.col("source"))
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.context_of(name, text.Contexts()).alias("context"))


_SPACED = (
    r"trim(regexp_replace(regexp_replace(text, '[^0-9\-\x00-\x20][^\r\n]*', '', 'g'), '[\x00-\x20]+', ' ', 'g'))"
)
TOKENS_SQL = (
    "(SELECT *, CASE WHEN spaced IN ('', '0') OR spaced LIKE '% 0' THEN spaced ELSE spaced || ' 0' END AS tokens"
    f" FROM (SELECT doc_id, {_SPACED} AS spaced FROM documents))"
)


@query(f"SELECT doc_id, md5(tokens) AS digest FROM {TOKENS_SQL}")
def content_digest(spark, sf_dir):
    content = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", digest.content_digest(content).alias("digest"))
