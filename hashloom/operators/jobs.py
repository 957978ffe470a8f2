"""Jobs over instances: registration, extraction and derivation.

An instance frame has ``path`` and ``content`` (bytes), plus ``hash`` once it is registered.  The
functions return frames or changed databases; Python runs only where a caller's function needs it,
over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from hashloom.functions.digest import base_features, content_digest
from hashloom.functions.text import Contexts, base_name, target_path
from hashloom.operators.writes import add_feature, reset_values, set_values_batch
from hashloom.plans.namespace import Database, FeatureError
from hashloom.session import written
from hashloom.sources.streamed import blocks, store

SUCCESS = "success"
FAILURE = "failure"
TIMEOUT = "timeout"
MEMOUT = "memout"
FILEOUT = "fileout"


class OutputLimitError(Exception):
    """A caller's function wrote more than it may."""


#: What an exception of a caller's function says about the run; any other is a failure.
_STATUS_OF = ((TimeoutError, TIMEOUT), (MemoryError, MEMOUT), (OutputLimitError, FILEOUT))

#: Contexts whose files hold clauses.
CLAUSE_CONTEXTS = ["cnf", "sancnf"]


def check_context(database: Database, contexts: list[str]) -> None:
    """Refuse a database of another context than the job is made for."""
    if database.context not in contexts:
        raise FeatureError(f"database {database.name!r} has context {database.context!r}, not one of {contexts}")


# ---- registration --------------------------------------------------------------------------


def new_paths(listing: DataFrame, registered: DataFrame, path: str = "path") -> DataFrame:
    """Listed files whose path is not a registered value yet."""
    known = registered.select(F.col("value").alias(path)).distinct()
    return listing.join(known, path, "left_anti")


def stale_paths(registered: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Registered (hash, value) pairs whose path is not listed any more."""
    listed = listing.select(F.col(path).alias("value")).distinct()
    return registered.join(listed, "value", "left_anti").select("hash", "value")


def path_triples(files: DataFrame, digest: Column | None = None) -> DataFrame:
    """Triples of the path features of files: ``local`` and ``filename`` under the digest."""
    digest = content_digest(F.col("content")) if digest is None else digest
    named = files.select(digest.alias("hash"), F.col("path"))
    pairs = F.array(
        F.struct(F.lit("local").alias("feature"), F.col("path").alias("value")),
        F.struct(F.lit("filename").alias("feature"), base_name(F.col("path")).alias("value")),
    )
    return named.select("hash", F.explode(pairs).alias("pair")).select("hash", "pair.feature", "pair.value")


def register_files(database: Database, files: DataFrame, digest: Column | None = None) -> Database:
    """Add the files not registered yet: digest, path and file name.

    The digest of a file depends on its context.  Without one given, only contexts of clause files are accepted,
    whose identity is the digest of their canonical tokens.  Files with a digest already (``F.col("hash")``, as of
    ``instance_digests``) need no content; those without one are left out.
    """
    if digest is None:
        check_context(database, CLAUSE_CONTEXTS)
        digest = content_digest(F.col("content"))
    for name in ("local", "filename"):
        database = add_feature(database, name, permissive=True)
    # contents are digested where they are read; only paths and digests are shuffled
    digests = written(files.select("path", digest.alias("hash")).where("hash IS NOT NULL"), "digests")
    fresh = new_paths(digests, database.many["local"].pairs())
    triples = path_triples(fresh, F.col("hash"))
    return set_values_batch(database, triples, ["local", "filename"])


def remove_stale(database: Database, listing: DataFrame) -> Database:
    """Forget registered paths that are not listed any more."""
    gone = stale_paths(database.many["local"].pairs(), listing)
    return reset_values(database, "local", values=gone.select("value"))


# ---- extraction ----------------------------------------------------------------------------


def extract_features(
    instances: DataFrame, extractor: Callable[[str, bytes], list[tuple[str, object]]]
) -> DataFrame:
    """Apply a function to every instance: rows (hash, feature, value, status, position).

    The function takes path and content and returns (feature, value) pairs.  Every instance gives
    one row without a feature that carries its status, an instance that succeeds one more per
    pair, with the pair's position; one that fails gives no values.
    """
    hash_type = instances.schema["hash"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, path, content in zip(batch["hash"], batch["path"], batch["content"]):
                values, status = _attempt(extractor, path, content)
                rows.append((key, None, None, status, 0))
                rows.extend((key, name, str(value), status, at) for at, (name, value) in enumerate(values, 1))
            yield pd.DataFrame(rows, columns=["hash", "feature", "value", "status", "position"])

    schema = f"hash {hash_type}, feature string, value string, status string, position int"
    return instances.select("hash", "path", "content").mapInPandas(run, schema)


def _attempt(function: Callable, path: str, content: bytes) -> tuple[list, str]:
    try:
        return list(function(path, content)), SUCCESS
    except Exception as error:  # noqa: BLE001 - any failure of a caller's function is a status
        return [], next((status for kind, status in _STATUS_OF if isinstance(error, kind)), FAILURE)


@dataclass(frozen=True)
class Extractor:
    """A function over instances that declares its features itself.

    ``function`` takes path and content and returns (feature, value) pairs.  ``declared`` lists its features as (name, type,
    default): one with a default is single-valued, the last value counts; one without (None) has all its values.  With ``streams`` the
    function gets an iterator over blocks of the unpacked content instead, so a file of any size can be read.
    """

    name: str
    function: Callable[[str, bytes], list[tuple[str, object]]]
    declared: tuple[tuple[str, str, object], ...]
    streams: bool = False

    def schema(self) -> T.StructType:
        """The status of a run, then a column per declared feature: its type, or a list of it."""
        types = [(name, kind if default is not None else f"array<{kind}>") for name, kind, default in self.declared]
        fields = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in types]
        return T.StructType([T.StructField("status", T.StringType()), *fields])

    def row(self, path: str, content: bytes | None) -> tuple:
        """Status and features of one instance; features of a run that failed, or that it doesn't give, are null."""
        values, status = _attempt(self.function, path, self._content(path, content))
        found: dict[str, list] = {}
        for name, value in values:
            found.setdefault(name, []).append(value)
        try:
            features = [self._value(kind, default, found.get(name)) for name, kind, default in self.declared]
        except (TypeError, ValueError):  # a value that is not of the declared type
            return (FAILURE, *(None for _ in self.declared))
        return (status, *features)

    def _content(self, path: str, content: bytes | None):
        if not self.streams:
            return content
        if content is not None:
            return iter([bytes(content)])
        system, inside = store(path)
        return blocks(system, inside)

    @staticmethod
    def _value(kind: str, default, values: list | None):
        if values is None:
            return None
        made = [_CASTS.get(kind, str)(value) for value in values]
        return made if default is None else made[-1]


_CASTS = {"bigint": int, "int": int, "double": float, "boolean": bool}

#: Name of the table function under which extractors are called from SQL.
EXTRACT = "extract_features"


def register_extractors(spark: SparkSession, extractors: list[Extractor], name: str = EXTRACT) -> None:
    """Make extractors a table function of SQL: ``FROM instances, LATERAL extract_features('words', path, content)``.

    The columns follow from the extractor that the first argument names: Spark asks ``analyze`` for them
    while it plans.  An instance gives one row, whatever its run came to.  Instances pass one by one; no session
    setting is needed.  An extractor that streams opens the file of the path itself if content is null.
    """
    known = {extractor.name: extractor for extractor in extractors}
    schemas = {extractor.name: extractor.schema() for extractor in extractors}

    class Extract:
        @staticmethod
        def analyze(extractor: AnalyzeArgument, path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            if not extractor.isConstantExpression or extractor.value not in known:
                raise ValueError(f"the first argument must name an extractor, one of {sorted(known)}")
            return AnalyzeResult(schema=schemas[extractor.value])

        def eval(self, extractor: str, path: str, content: bytes | None):
            yield known[extractor].row(path, content)

    spark.udtf.register(name, F.udtf(Extract))


def store_extracted(
    database: Database, rows: DataFrame, extractor: Extractor, contexts: list[str]
) -> Database:
    """Write rows (hash, features) of an extractor; the features it declares are created as needed."""
    pairs = [
        _pairs(name, F.array(name) if default is not None else F.col(name)) for name, _, default in extractor.declared
    ]
    exploded = rows.select("hash", F.explode(F.flatten(F.array(*pairs))).alias("pair"))
    triples = exploded.select("hash", "pair.feature", "pair.value").where("value IS NOT NULL")
    return store_features(database, triples, [(name, default) for name, _, default in extractor.declared], contexts)


def _pairs(name: str, values: Column) -> Column:
    """(feature, value) of every value of a list; none of a null."""
    none = F.array().cast("array<struct<feature:string,value:string>>")
    named = F.transform(
        values, lambda value: F.struct(F.lit(name).alias("feature"), value.cast("string").alias("value"))
    )
    return F.coalesce(named, none)


def extracted_triples(extracted: DataFrame) -> DataFrame:
    """The values with their position: the last one of a single-valued feature is stored."""
    return extracted.where(F.col("feature").isNotNull()).select("hash", "feature", "value", "position")


def run_status(extracted: DataFrame) -> DataFrame:
    """How many instances ended with each status."""
    outcome = extracted.where(F.col("feature").isNull())
    return outcome.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def expression_triples(instances: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Triples of an extractor written as expressions, one row per instance and feature."""
    pairs = [
        F.struct(F.lit(name).alias("feature"), column.cast("string").alias("value"))
        for name, column in features.items()
    ]
    exploded = instances.select("hash", F.explode(F.array(*pairs)).alias("pair"))
    return exploded.select("hash", "pair.feature", "pair.value")


def base_triples(instances: DataFrame) -> DataFrame:
    """The base extractor: counts of clauses and variables."""
    return expression_triples(instances, base_features(F.col("content")))


def store_features(
    database: Database, triples: DataFrame, declared: list[tuple[str, object]], contexts: list[str]
) -> Database:
    """Write extractor triples; the declared features, (name, default), are created as needed:
    single-valued with a default, multi-valued without one."""
    check_context(database, contexts)
    for name, default in declared:
        database = add_feature(database, name, default, permissive=True)
    # the extractor runs once, whatever the number of tables that take its triples
    triples = written(triples, "triples")
    order = ["position"] if "position" in triples.columns else None
    return set_values_batch(database, triples, [name for name, _ in declared], order)


# ---- derivation ----------------------------------------------------------------------------


def transform_content(instances: DataFrame, transformer: Callable[[str, bytes], bytes]) -> DataFrame:
    """Apply a function from path and content to new content: columns ``derived`` and ``status``."""
    hash_type = instances.schema["hash"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, path, content in zip(batch["hash"], batch["path"], batch["content"]):
                made, status = _attempt(lambda p, c: [transformer(p, c)], path, content)
                rows.append((key, path, made[0] if made else None, status))
            yield pd.DataFrame(rows, columns=["hash", "path", "derived", "status"])

    schema = f"hash {hash_type}, path string, derived binary, status string"
    return instances.select("hash", "path", "content").mapInPandas(run, schema)


def pending_derivations(
    instances: DataFrame,
    listing: DataFrame,
    contexts: Contexts,
    source: str,
    output_suffix: str,
    compress: str = "none",
) -> DataFrame:
    """Instances whose derived file is not listed yet, with its ``target`` path."""
    target = target_path(F.col("path"), contexts.suffixes(source), output_suffix, compress)
    listed = listing.select(F.col("path").alias("target")).distinct()
    return instances.withColumn("target", target).join(listed, "target", "left_anti")


def derivation_triples(
    derived: DataFrame, source: str, features: dict[str, Column], digest: Column | None = None
) -> DataFrame:
    """Triples of derived instances: their features and the link ``to_<source>`` back, under the
    digest of the derived content.  ``derived`` has ``hash`` (of the source) and ``derived``."""
    digest = content_digest(F.col("derived")) if digest is None else digest
    made = derived.where(F.col("derived").isNotNull())
    linked = features | {f"to_{source}": F.col("hash")}
    pairs = [
        F.struct(F.lit(name).alias("feature"), column.cast("string").alias("value"))
        for name, column in linked.items()
    ]
    exploded = made.select(digest.alias("hash"), F.explode(F.array(*pairs)).alias("pair"))
    return exploded.select("hash", "pair.feature", "pair.value")


def derive_entities(
    database: Database,
    derived: DataFrame,
    source: str,
    sources: list[str],
    targets: list[str],
    features: dict[str, Column],
    declared: list[tuple[str, object]],
    digest: Column | None = None,
) -> Database:
    """Write derived instances into a database of a target context."""
    if source not in sources:
        raise FeatureError(f"source context {source!r} is not one of {sources}")
    triples = derivation_triples(derived, source, features, digest)
    return store_features(database, triples, declared + [(f"to_{source}", None)], targets)
