"""Queries of the sources and sinks.  Files are written from the tables into the shared working
folder, then read by the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.operators import writes
from hashloom.plans.filters import feature
from hashloom.plans.namespace import Namespace
from hashloom.plans.query import entity_hashes, select
from hashloom.session import working_folder
from hashloom.sources import delimited, files, sinks, tables
from hashloom.suite.registry import (
    CONTEXTS,
    documents,
    documents_database,
    hashed,
    labels_database,
    orders_database,
    query,
    table,
)
from hashloom.suite.scalars import TOKENS_SQL


def _flags(spark, sf_dir):
    """The orders with the two flags of their lines."""
    database = orders_database(spark, sf_dir)
    return database.with_parts(many={name: database.many[name] for name in ("returnflag", "linestatus")})


@query("SELECT d.doc_id AS hash, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def open_databases(spark, sf_dir):
    """Two saved databases opened as one namespace, read through Spark SQL views."""
    folder = working_folder(spark, "databases")
    paths = [f"{folder}/base", f"{folder}/labels"]
    tables.save_database(documents_database(spark, sf_dir), paths[0])
    tables.save_database(labels_database(spark, sf_dir), paths[1])
    tables.create_views(tables.open_databases(spark, paths))
    return spark.sql(
        "SELECT b.hash, b.lang, l.quality FROM doc_base__features b LEFT JOIN doc_labels__features l ON l.hash = b.hash"
    )


@query(
    "SELECT o_orderkey AS hash, o_orderstatus, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), 'None')"
    " AS returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"
)
def scan_feature_tables(spark, sf_dir):
    """Plain Parquet folders as a database: entity table, one multi-valued feature, a mirror column."""
    folder = working_folder(spark, "ord_plain")
    entities = hashed(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")
    entities.withColumn("returnflag", F.lit("None")).write.parquet(f"{folder}/features")
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(F.col("l_orderkey").alias("hash"), F.col("l_returnflag").alias("value"))
    pairs.write.parquet(f"{folder}/returnflag")
    pairs.limit(0).write.parquet(f"{folder}/_hidden")
    database = tables.scan_feature_tables(spark, folder, contexts=CONTEXTS)
    return select(Namespace([database]), resolve=["o_orderstatus", "returnflag"])


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS hash, o_orderstatus, o_orderpriority AS order_priority FROM orders"
    " WHERE o_orderpriority = '1-URGENT' OR o_custkey < 300"
)
def scan_csv(spark, sf_dir):
    folder = f"{working_folder(spark, 'csv')}/ord_csv.csv"
    rows = hashed(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    rows = rows.withColumnRenamed("o_orderpriority", "order - priority").withColumnRenamed("o_custkey", "customer")
    rows.write.option("sep", ";").option("header", True).csv(folder)
    namespace = Namespace(delimited.open_csv(spark, [folder], contexts=CONTEXTS))
    where = (feature("order_priority") == "1-URGENT") | (feature("customer") < 300)
    return select(namespace, where, ["o_orderstatus", "order_priority"])


@query(
    "SELECT CAST(coalesce(d.doc_id, l.doc_id) AS VARCHAR) AS hash, d.lang, CAST(l.quality AS VARCHAR) AS quality"
    " FROM documents d FULL JOIN labels l USING (doc_id)"
)
def merge_csv(spark, sf_dir):
    """Files of one name with different columns become one database."""
    folder = working_folder(spark, "csv")
    paths = [f"{folder}/{part}/doc_csv.csv" for part in ("a", "b")]
    hashed(table(spark, sf_dir, "documents"), "doc_id", "lang").write.option("header", True).csv(paths[0])
    hashed(table(spark, sf_dir, "labels"), "doc_id", "quality").write.option("header", True).csv(paths[1])
    databases = delimited.open_csv(spark, paths, contexts=CONTEXTS)
    return select(Namespace(databases), resolve=["lang", "quality"])


@query("SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def scan_instances(spark, sf_dir):
    """All texts as plain and compressed files of a folder tree, read back and unpacked.

    A file holds a thousand texts at most.  Spark's writer has no xz: tasks write these files, a retried
    one the same bytes under the same name.
    """
    folder = working_folder(spark, "instances")
    rows = table(spark, sf_dir, "documents").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("kind"))
    for kind, codec in enumerate(("none", "gzip", "bzip2")):
        part = rows.where(F.col("kind") == kind).drop("kind").write.partitionBy("lang")
        part.option("compression", codec).option("maxRecordsPerFile", 1000).text(f"{folder}/{codec}")
    rows.where("kind = 3").select("lang", "text").mapInArrow(_xz_files(f"{folder}/xz"), "path string").count()
    found = files.scan_instances(spark, folder, "doc", CONTEXTS)
    lang = F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang")
    return found.select(lang, F.length("content").alias("n")).groupBy("lang").agg(F.sum("n").alias("bytes"))


_PARTS = 500

#: Some letters are digits and q begins a comment, so that texts read as clauses.
_LETTERS, _DIGITS = "etaoin", "012345"
_AS_CLAUSES = f"translate(regexp_replace(text, '[^{_LETTERS}q\\n]', ' ', 'g'), '{_LETTERS}', '{_DIGITS}')"
_JOINED_SQL = f"(SELECT doc_id // {_PARTS} AS part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1)"


def _document_files(spark, sf_dir, folder: str, suffixes: list[str], text) -> None:
    """All texts, one after the other, in files of 500 documents, by turns plain and packed.  Tasks write text by text."""
    part = F.floor(F.coalesce("doc_id", F.lit(0)) / _PARTS).cast("bigint").alias("part")
    rows = table(spark, sf_dir, "documents").select(part, "doc_id", F.encode(text, "UTF-8").alias("text"))
    ordered = rows.repartition("part").sortWithinPartitions("part", "doc_id")
    ordered.mapInArrow(_part_files(folder, suffixes), "path string").count()


def _part_files(folder: str, suffixes: list[str]):
    """Write consecutive rows (part, text) of a part into its file; a retried task writes the same bytes."""

    def write(batches):
        import lzma

        import pyarrow as pa

        from hashloom.sources.streamed import store

        codecs = {"gz": "gzip", "bz2": "bz2"}
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        current, raw, out = None, None, None

        def close():
            if out is not None and out is not raw:
                out.close()
            if raw is not None:
                raw.close()

        for batch in batches:
            names = []
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                if part != current:
                    close()
                    current, suffix = part, suffixes[part % len(suffixes)]
                    names.append(f"{root}/{part}{suffix}")
                    ending = suffix.rsplit(".", 1)[-1]
                    raw = system.open_output_stream(names[-1], compression=codecs.get(ending))
                    out = lzma.LZMAFile(raw, "wb", preset=0) if ending == "xz" else raw
                out.write((text or b"") + b"\n")
            yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})
        close()

    return write


@query(
    "SELECT part, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, md5(tokens) AS hash,"
    " CAST(len([t for t in string_split(tokens, ' ') if t = '0']) AS BIGINT) AS clauses,"
    " CAST(coalesce(list_max([abs(try_cast(t AS BIGINT)) for t in string_split(tokens, ' ')]), 0) AS BIGINT) AS variables"
    " FROM " + TOKENS_SQL.replace("documents", _JOINED_SQL.replace("string_agg(text", f"string_agg({_AS_CLAUSES}")).replace("doc_id, ", "part, text, ", 1)
)
def instance_digests(spark, sf_dir):
    """Plain and packed files of 500 documents, digested in blocks of 64 KiB: no file is held as a whole."""
    folder = working_folder(spark, "digests")
    text = F.translate(F.regexp_replace("text", f"[^{_LETTERS}q\\n]", " "), _LETTERS, _DIGITS)
    _document_files(spark, sf_dir, folder, [".txt", ".txt.gz", ".txt.bz2", ".txt.xz"], text)
    found = files.instance_digests(spark, folder, "doc", CONTEXTS, block=1 << 16, task=4 << 20)
    part = F.regexp_extract("path", r"([0-9]+)\.txt", 1).cast("bigint").alias("part")
    return found.select(part, "bytes", "hash", "clauses", "variables")


def _xz_files(folder: str):
    """Write the texts of each batch, a line each, as one xz file a language."""

    def write(batches):
        import lzma
        import re

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        root = re.sub(r"^file:/+", "/", folder)
        system, root = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                lines: dict = {}
                for row in batch.slice(low, 1000).to_pylist():
                    lines.setdefault(row["lang"], []).append((row["text"] or "").encode() + b"\n")
                for lang, listed in lines.items():
                    path = f"{root}/lang={lang}/{task}-{number}.txt.xz"
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(path) as out:
                        out.write(lzma.compress(b"".join(listed), preset=1))
                    yield pa.RecordBatch.from_pydict({"path": [path]})
                number += 1

    return write


@query("SELECT doc_id AS hash, lang FROM documents SEMI JOIN labels USING (doc_id) WHERE lang <> 'en'")
def read_id_list(spark, sf_dir):
    folder = working_folder(spark, "ids")
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("value"))
    ids.write.text(folder, lineSep="  ")
    listed = delimited.read_id_list(spark, folder).select(F.col("hash").cast("bigint").alias("hash"))
    return select(documents(spark, sf_dir), feature("lang") != "en", ["lang"], hashes=listed)


@query(
    "SELECT doc_id, feature, arg_max(value, line) AS value FROM (SELECT doc_id, line,"
    " regexp_extract(text, '^([^ \\t]+)', 1) AS feature, regexp_replace(text, '^[^ \\t]+[ \\t]*', '') AS value"
    " FROM (SELECT doc_id, generate_subscripts(lines, 1) AS line, trim(unnest(lines), ' \t\r') AS text"
    " FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c]') AS lines FROM documents))"
    " WHERE text <> '') GROUP BY 1, 2"
)
def read_tool_lines(spark, sf_dir):
    """Every text read as a tool's output: first word and rest of each line, last line wins."""
    return delimited.tool_values(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(
    "SELECT part, feature, arg_max(value, line) AS value FROM (SELECT part, line,"
    " regexp_extract(text, '^([^ \\t]+)', 1) AS feature, regexp_replace(text, '^[^ \\t]+[ \\t]*', '') AS value"
    " FROM (SELECT part, generate_subscripts(lines, 1) AS line, trim(unnest(lines), ' \t\r') AS text"
    f" FROM (SELECT part, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c]') AS lines FROM {_JOINED_SQL}))"
    " WHERE text <> '') GROUP BY 1, 2"
)
def read_tool_files(spark, sf_dir):
    """Files of 500 texts read as a tool's output, in splits of 256 KiB that different tasks read."""
    folder = working_folder(spark, "tool")
    _document_files(spark, sf_dir, folder, [".txt"], F.col("text"))
    found = delimited.read_tool_lines(spark, folder, split=1 << 18, block=1 << 16)
    part = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint").alias("part")
    return found.select(part, "feature", "value")


@query(
    "SELECT doc_id || ' ' || lang || ' ' || coalesce(CAST(quality AS VARCHAR), '[None]') AS value"
    " FROM documents LEFT JOIN labels USING (doc_id)"
)
def export_delimited(spark, sf_dir):
    folder = working_folder(spark, "export")
    sinks.export_delimited(select(documents(spark, sf_dir), resolve=["lang", "quality"]), folder)
    return spark.read.text(folder)


@query("SELECT 'https://example.org/file/' || doc_id || '?context=doc' AS value FROM documents WHERE lang = 'es'")
def export_links(spark, sf_dir):
    folder = working_folder(spark, "links")
    hits = entity_hashes(documents(spark, sf_dir), feature("lang") == "es")
    sinks.export_links(hits, folder, "https://example.org/file", "doc", CONTEXTS.default)
    return spark.read.text(folder)


@query(
    "SELECT l_orderkey AS hash, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS returnflag"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IS NOT NULL GROUP BY 1"
    " HAVING bool_or(l_returnflag = 'A')"
)
def export_database(spark, sf_dir):
    folder = working_folder(spark, "exported")
    copied = tables.export_database(_flags(spark, sf_dir), f"{folder}/ord_base")
    return select(Namespace([copied]), feature("returnflag") == "A", ["returnflag"])


@query(
    "SELECT o_orderkey AS hash, o_orderstatus, string_agg(DISTINCT value, ',' ORDER BY value) AS returnflag FROM orders JOIN"
    " (SELECT l_orderkey, l_returnflag AS value FROM lineitem UNION ALL SELECT o_orderkey, 'X' FROM orders"
    " WHERE o_orderstatus = 'P') ON l_orderkey = o_orderkey GROUP BY 1, 2"
)
def save_database(spark, sf_dir):
    """Saved, changed and saved again: the second version adds files to one table."""
    path = f"{working_folder(spark, 'saved')}/ord_base"
    first = tables.save_database(_flags(spark, sf_dir), path)
    partial = entity_hashes(Namespace([first]), feature("o_orderstatus") == "P")
    changed = writes.set_values(first, "returnflag", partial.withColumn("value", F.lit("X")))
    second = tables.save_database(changed, path)
    where = ~feature("returnflag").is_unset()
    return select(Namespace([second]), where, ["o_orderstatus", "returnflag"])


@query(
    "SELECT o_orderkey AS hash, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), 'None') AS returnflag"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"
    " WHERE o_totalprice > 100000 GROUP BY 1"
)
def save_database_bucketed(spark, sf_dir):
    """Tables bucketed by hash: the query joins and aggregates them without a shuffle."""
    path = f"{working_folder(spark, 'bucketed')}/ord_base"
    saved = tables.save_database(_flags(spark, sf_dir), path, buckets=8)
    return select(Namespace([saved]), feature("o_totalprice") > 100000, ["returnflag"])
