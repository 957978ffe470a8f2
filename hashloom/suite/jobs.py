"""Queries of the registration, extraction and derivation jobs and of the stream."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from hashloom.functions.digest import content_digest, text_digest
from hashloom.operators import jobs
from hashloom.plans.namespace import Database, Namespace
from hashloom.plans.query import select
from hashloom.session import working_folder, written
from hashloom.streaming import latest, upsert
from hashloom.suite.registry import CONTEXTS, pages_database, query, table
from hashloom.suite.scalars import TOKENS_SQL


def _instances(spark, sf_dir):
    """Documents as registered instances."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("hash"),
        F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


def _files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))


_PAGE_TOKENS = TOKENS_SQL.replace("doc_id, ", "url, ").replace("(text", "(html").replace("documents", "pages")


@query(
    f"SELECT hash, feature, value FROM (SELECT md5(tokens) AS hash, url FROM {_PAGE_TOKENS}) CROSS JOIN LATERAL"
    " (SELECT 'local' AS feature, url AS value UNION ALL SELECT 'filename', list_extract(string_split(url, '/'), -1))"
    " GROUP BY ALL"
)
def register_files(spark, sf_dir):
    empty = Database.empty(spark, "web_new", contexts=CONTEXTS)
    database = jobs.register_files(empty, _files(spark, sf_dir), content_digest(F.col("content")))
    parts = [
        database.many[name].pairs().select("hash", F.lit(name).alias("feature"), "value")
        for name in ("local", "filename")
    ]
    return parts[0].union(parts[1])


@query("SELECT DISTINCT url AS path FROM pages WHERE url NOT LIKE 'https:%'")
def new_paths(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    registered = pages_database(spark, sf_dir).many["local"].pairs()
    secure = registered.where(F.col("value").startswith("https:"))
    return jobs.new_paths(listing, secure)


@query("SELECT page_id AS hash, url AS value FROM pages WHERE url NOT LIKE '%.org/%'")
def stale_paths(spark, sf_dir):
    present = table(spark, sf_dir, "pages").where(F.col("url").contains(".org/"))
    registered = pages_database(spark, sf_dir).many["local"].pairs()
    return jobs.stale_paths(registered, present.select(F.col("url").alias("path")))


@query(
    "SELECT page_id AS hash, CASE WHEN url LIKE '%.org/%' THEN url ELSE 'None' END AS local,"
    " list_extract(string_split(url, '/'), -1) AS filename FROM pages"
)
def remove_stale(spark, sf_dir):
    present = table(spark, sf_dir, "pages").where(F.col("url").contains(".org/"))
    database = jobs.remove_stale(pages_database(spark, sf_dir), present.select(F.col("url").alias("path")))
    return select(Namespace([database]), resolve=["local", "filename"])


_WORD = re.compile(rb"[^ \t\n\r\f]+")


def count_words(path: str, content: bytes) -> list[tuple[str, object]]:
    """Extractor: number of words and length of the longest one, in bytes; texts below twenty
    words are refused."""
    words = _WORD.findall(content)
    if len(words) < 20:
        raise ValueError("too short")
    return [("words", len(words)), ("longest", max(map(len, words)))]


_WORDS = "(SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS words FROM documents)"


@query(
    "SELECT doc_id AS hash, CASE WHEN len(words) >= 20 THEN len(words) ELSE 0 END AS words,"
    " CASE WHEN len(words) >= 20 THEN list_max([octet_length(encode(w)) for w in words]) ELSE 0 END AS longest"
    f" FROM {_WORDS}"
)
def extract_features(spark, sf_dir):
    instances = _instances(spark, sf_dir)
    database = Database.of("doc_words", instances.select("hash"), contexts=CONTEXTS)
    extracted = written(jobs.extract_features(instances, count_words), "extracted")
    declared = [("words", "0"), ("longest", "0")]
    stored = jobs.store_features(database, jobs.extracted_triples(extracted), declared, ["doc"])
    return stored.entities.select("hash", *[F.col(c).cast("bigint").alias(c) for c in ("words", "longest")])


COUNT_WORDS = jobs.Extractor("words", count_words, (("words", "bigint", 0), ("longest", "bigint", 0)))


def line_starts(path: str, blocks) -> list[tuple[str, object]]:
    """Extractor over blocks: how many line feeds there are, and the first letters of all lines, in lower case."""
    lines, starts, at_start = 0, set(), True
    for block in blocks:
        lines += block.count(b"\n")
        starts |= set(re.findall(rb"\n([A-Za-z])", block))
        if at_start and re.match(rb"[A-Za-z]", block):
            starts.add(block[:1])
        at_start = block.endswith(b"\n")
    return [("lines", lines), *(("start", letter) for letter in sorted({s.lower().decode() for s in starts}))]


LINE_STARTS = jobs.Extractor("line_starts", line_starts, (("lines", "bigint", 0), ("start", "string", None)), streams=True)


@query(
    "SELECT doc_id AS hash, CASE WHEN len(words) >= 20 THEN 'success' ELSE 'failure' END AS status,"
    " CASE WHEN len(words) >= 20 THEN len(words) END AS words,"
    " CASE WHEN len(words) >= 20 THEN list_max([octet_length(encode(w)) for w in words]) END AS longest"
    f" FROM {_WORDS}"
)
def extract_features_lateral(spark, sf_dir):
    """The extractor as a table function of SQL; its columns are the features it declares."""
    jobs.register_extractors(spark, [COUNT_WORDS, LINE_STARTS])
    _instances(spark, sf_dir).createOrReplaceTempView("document_instances")
    return spark.sql(
        "SELECT i.hash, x.* FROM document_instances i, LATERAL extract_features('words', i.path, i.content) x"
    )


@query(
    "SELECT doc_id AS hash, CAST(len(regexp_extract_all(text, '\n')) AS VARCHAR) AS lines,"
    " coalesce(array_to_string(list_sort(list_distinct([lower(s) for s in regexp_extract_all(text, '(?:^|\n)([A-Za-z])', 1)])),"
    " ','), '') AS start FROM documents"
)
def store_extracted(spark, sf_dir):
    """A single-valued and a multi-valued feature, declared by the extractor, stored and resolved."""
    jobs.register_extractors(spark, [COUNT_WORDS, LINE_STARTS])
    _instances(spark, sf_dir).createOrReplaceTempView("document_instances")
    rows = spark.sql(
        "SELECT i.hash, x.* FROM document_instances i, LATERAL extract_features('line_starts', i.path, i.content) x"
    )
    database = Database.of("doc_lines", _instances(spark, sf_dir).select("hash"), contexts=CONTEXTS)
    stored = jobs.store_extracted(database, rows, LINE_STARTS, ["doc"])
    found = select(Namespace([stored]), resolve=["lines", "start"])
    return found.withColumn("start", F.when(F.col("start") != "None", F.col("start")).otherwise(""))


@query(
    "SELECT CASE WHEN len(words) >= 20 THEN 'success' ELSE 'failure' END AS status, CAST(count(*) AS BIGINT) AS n"
    f" FROM {_WORDS} GROUP BY 1"
)
def run_status(spark, sf_dir):
    return jobs.run_status(jobs.extract_features(_instances(spark, sf_dir), count_words))


@query(
    "SELECT doc_id AS hash, CAST(len([t for t in parts if t = '0']) AS BIGINT) AS clauses,"
    " CAST(coalesce(list_max([abs(try_cast(t AS BIGINT)) for t in parts]), 0) AS BIGINT) AS variables"
    f" FROM (SELECT doc_id, string_split(tokens, ' ') AS parts FROM {TOKENS_SQL})"
)
def base_features(spark, sf_dir):
    instances = _instances(spark, sf_dir)
    database = Database.of("doc_counts", instances.select("hash"), contexts=CONTEXTS)
    declared = [("clauses", "0"), ("variables", "0")]
    stored = jobs.store_features(database, jobs.base_triples(instances), declared, ["doc"])
    return stored.entities.select("hash", *[F.col(c).cast("bigint").alias(c) for c in ("clauses", "variables")])


_NORMAL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(
    f"SELECT md5({_NORMAL}) AS hash, CAST(min(length({_NORMAL})) AS VARCHAR) AS n_chars,"
    " string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS to_doc"
    " FROM documents GROUP BY 1"
)
def derive_entities(spark, sf_dir):
    """Normalised texts as entities of their own context, linked back to their sources."""
    normal = F.trim(F.regexp_replace(F.lower(F.decode("content", "UTF-8")), r"[ \t\n\f\r]+", " "))
    derived = _instances(spark, sf_dir).withColumn("derived", F.encode(normal, "UTF-8"))
    text = F.decode("derived", "UTF-8")
    database = jobs.derive_entities(
        Database.empty(spark, "web_normal", contexts=CONTEXTS),
        derived,
        source="doc",
        sources=["doc"],
        targets=["web"],
        features={"n_chars": F.length(text)},
        declared=[("n_chars", "0")],
        digest=F.md5("derived"),
    )
    return select(Namespace([database]), resolve=["n_chars", "to_doc"])


def drop_digits(path: str, content: bytes) -> bytes:
    return re.sub(rb"[0-9]", b"", content)


@query(
    "SELECT CASE WHEN regexp_matches(text, '[0-9]') THEN 'changed' ELSE 'same' END AS kind, CAST(count(*) AS BIGINT) AS n,"
    " CAST(sum(octet_length(encode(regexp_replace(text, '[0-9]', '', 'g')))) AS BIGINT) AS bytes FROM documents GROUP BY 1"
)
def transform_content(spark, sf_dir):
    """A caller's function from content to new content, over Arrow batches."""
    instances = _instances(spark, sf_dir)
    derived = jobs.transform_content(instances, drop_digits).select("hash", "derived")
    joined = instances.join(derived, "hash")
    kind = F.when(F.col("content") == F.col("derived"), "same").otherwise("changed").alias("kind")
    return joined.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("derived")).alias("bytes"))


@query(
    "SELECT doc_id AS hash, '/data/' || source || '/' || doc_id || '.norm.gz' AS target FROM documents"
    " WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
)
def pending_derivations(spark, sf_dir):
    instances = _instances(spark, sf_dir)
    done = instances.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("hash")), "hash", "left_semi")
    listing = done.select(F.regexp_replace("path", r"\.txt$", ".norm.gz").alias("path"))
    pending = jobs.pending_derivations(instances.drop("content"), listing, CONTEXTS, "doc", ".norm", "gz")
    return pending.select("hash", "target")


@query(
    "SELECT user_id AS hash, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click,"
    " arg_max(value, (ts, event_id)) FILTER (event_type = 'error') AS error,"
    " CAST(count(DISTINCT value) FILTER (event_type = 'purchase') AS BIGINT) AS purchase"
    " FROM events GROUP BY 1"
)
def stream_upsert(spark, sf_dir):
    """The events as a stream of triples, landed batch by batch and merged into a database."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    triples = stream.select(
        F.col("user_id").alias("hash"),
        F.col("event_type").alias("feature"),
        "value",
        F.col("ts").alias("time"),
        F.col("event_id").alias("tie"),
    )
    folder = working_folder(spark, "stream")
    upsert.land_triples(triples, f"{folder}/landed", f"{folder}/state", many=["purchase"]).awaitTermination()
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("hash")).distinct()
    database = Database.of("ord_users", users, contexts=CONTEXTS)
    entities = database.entities.withColumn("click", F.lit(None).cast("double"))
    database = database.with_parts(entities=entities.withColumn("error", F.lit(None).cast("double")))
    database = jobs.add_feature(database, "purchase", data_type="double")
    rows = upsert.landed(spark, f"{folder}/landed")
    merged = upsert.apply_landed(database, rows, ["click", "error", "purchase"])
    return select(Namespace([merged]), resolve=["click", "error", "purchase"], collapse="count").select(
        "hash", "purchase"
    ).join(merged.entities, "hash")


@query(
    "SELECT user_id AS hash, event_type AS feature, arg_max(value, (ts, event_id)) AS value, max(ts) AS time"
    " FROM events GROUP BY 1, 2"
)
def stream_latest(spark, sf_dir):
    """The events in two deliveries, the stream stopped between them: the second goes on with the state of the
    first, and brings events earlier than those already seen."""
    folder = working_folder(spark, "latest")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("hash"),
        F.col("event_type").alias("feature"),
        "value",
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("tie"),
    )
    for delivery in range(2):
        part = events.where(F.pmod(F.xxhash64("tie"), F.lit(2)) == delivery)
        part.write.parquet(f"{folder}/in/{delivery}")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
        query = latest.land_latest(stream, f"{folder}/landed", f"{folder}/state", "3650 days", pd.Timedelta(days=3650))
        query.awaitTermination()
    last = upsert.landed(spark, f"{folder}/landed").groupBy("hash", "feature")
    return last.agg(F.max_by("value", F.struct("time", "tie")).alias("value"), F.max("time").alias("time"))


@query(f"SELECT md5({_NORMAL}) AS digest, CAST(doc_id AS BIGINT) AS hash FROM documents")
def text_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select(text_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("hash"))
