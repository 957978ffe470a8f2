"""Databases, features and the namespace that resolves feature addresses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.functions.text import Contexts
from hashloom.operators.skew import hot_keys, listed_keys

#: What an entity without a value of a text feature shows.
UNSET = "None"

#: Name of the entity table among the tables of a database.
ENTITIES = "features"
#: Under this name the files of a database say which version of which folder it was read from.
BASE = ""

# Names a feature cannot have.
RESERVED = ("hash", "value", "features")


class FeatureError(ValueError):
    """Unknown, ambiguous or ill-named features, databases and contexts."""


@dataclass(frozen=True)
class Feature:
    """One feature of one database."""

    name: str
    database: str
    many: bool
    data_type: T.DataType
    default: object = None

    @property
    def is_hash(self) -> bool:
        return self.name == "hash"

    @property
    def is_text(self) -> bool:
        return isinstance(self.data_type, T.StringType)

    @property
    def label(self) -> str:
        """Column name inside a plan, unique over all databases."""
        return f"{self.database}__{self.name}"


@dataclass(frozen=True)
class Values:
    """Where a multi-valued feature lives: rows of (hash, column).  Several features may share one
    frame; a null means no value.  ``unique`` says that no (hash, column) pair occurs twice.
    ``hot`` lists the (key, rows) of hashes and values with very many rows, where that is known."""

    frame: DataFrame
    column: str = "value"
    unique: bool = False
    hot: dict | None = None

    def pairs(self) -> DataFrame:
        """The distinct (hash, value) pairs."""
        rows = self.rows()
        return rows if self.unique else rows.distinct()

    def rows(self) -> DataFrame:
        value = F.col(self.column)
        return self.frame.where(value.isNotNull()).select("hash", value.alias("value"))

    def hot_keys(self, side: str) -> DataFrame | None:
        """Hot keys of the pairs by ``hash`` or ``value``."""
        rows = self.rows()
        return hot_keys(rows, side) if self.hot is None else listed_keys(rows, side, self.hot[side])

    @property
    def data_type(self) -> T.DataType:
        return self.frame.schema[self.column].dataType


def check_feature_name(name: str) -> None:
    if not re.fullmatch("[a-zA-Z][a-zA-Z0-9_]*", name):
        raise FeatureError(f"feature name {name!r} must start with a letter, then letters, digits, _")
    if name in RESERVED:
        raise FeatureError(f"feature name {name!r} is reserved")


@dataclass(frozen=True)
class Edit:
    """One change of an entity table: the hashes whose rows it may change, and the change itself, which is right
    for any part of the table that has all stored rows of these hashes."""

    hashes: DataFrame
    apply: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Database:
    """One source of features: the entity table (``hash`` and the single-valued features) and the
    multi-valued features.  A default is shown wherever a single-valued feature is null.  ``files``
    says which tables are stored where, ``added`` holds rows of stored tables not written yet.  ``edits`` are the
    changes of the entity table since it was read from a store; None says that its columns changed, or that
    it was not read from one."""

    name: str
    context: str
    entities: DataFrame
    many: dict
    defaults: dict
    files: dict
    added: dict
    edits: tuple[Edit, ...] | None = None

    @staticmethod
    def of(name, entities=None, many=None, defaults=None, context=None, contexts=None) -> Database:
        """Build a database from frames.  Without an entity table the entities are all hashes of
        the multi-valued features."""
        context = context or (contexts or Contexts()).of_database(name)
        values = {
            feature: source if isinstance(source, Values) else Values(source)
            for feature, source in (many or {}).items()
        }
        if entities is None:
            entities = known_entities(values)
        if "hash" not in entities.columns:
            raise FeatureError(f"database {name!r} has no hash column")
        return Database(name, context, entities, values, dict(defaults or {}), {}, {})

    @staticmethod
    def empty(spark, name, hash_type="string", context=None, contexts=None) -> Database:
        """A database without entities and features."""
        entities = spark.createDataFrame([], f"hash {hash_type}")
        return Database.of(name, entities, context=context, contexts=contexts)

    @cached_property
    def features(self) -> dict[str, Feature]:
        single = {
            column.name: Feature(column.name, self.name, False, column.dataType, self.defaults.get(column.name))
            for column in self.entities.schema
        }
        multiple = {
            name: Feature(name, self.name, True, source.data_type) for name, source in self.many.items()
        }
        return single | multiple

    def single(self, name: str) -> Column:
        """The column of a single-valued feature with its default filled in."""
        default = self.defaults.get(name)
        column = F.col(name)
        return column if default is None else F.coalesce(column, F.lit(default))

    def with_parts(self, **parts) -> Database:
        return replace(self, **parts)


def known_entities(many: dict) -> DataFrame:
    """The entity table that follows from the multi-valued features: all hashes they mention."""
    if not many:
        raise FeatureError("a database needs an entity table or a multi-valued feature")
    hashes = [source.rows().select("hash") for source in many.values()]
    return reduce(DataFrame.union, hashes).distinct()


class Namespace:
    """An ordered list of databases queried as one.  The first database that has a feature wins;
    ``database:feature`` and ``context:feature`` name another copy."""

    def __init__(self, databases: list[Database]):
        self.databases = {}
        for database in databases:
            if database.name in self.databases:
                raise FeatureError(f"two databases are named {database.name!r}")
            self.databases[database.name] = database
        if not self.databases:
            raise FeatureError("a namespace needs a database")

    def __getitem__(self, name: str) -> Database:
        return self.databases[name]

    @property
    def first(self) -> Database:
        return next(iter(self.databases.values()))

    def contexts(self) -> list[str]:
        return list(dict.fromkeys(d.context for d in self.databases.values()))

    def of_context(self, context: str) -> list[Database]:
        return [d for d in self.databases.values() if d.context == context]

    def position(self, database: str) -> int:
        return list(self.databases).index(database)

    def feature_names(self, database: str | None = None) -> list[str]:
        """Names of the features of one or all databases, without the hash."""
        chosen = [self.databases[database]] if database else list(self.databases.values())
        return list(dict.fromkeys(n for d in chosen for n in d.features if n != "hash"))

    def registry(self, spark: SparkSession) -> DataFrame:
        """The features of all databases as a frame, in order of precedence."""
        rows = [
            (d.name, d.context, f.name, "1:n" if f.many else "1:1", f.data_type.simpleString(),
             None if f.default is None else str(f.default), position)
            for position, d in enumerate(self.databases.values())
            for f in d.features.values()
            if not f.is_hash
        ]
        columns = "database string, context string, feature string, cardinality string, type string"
        return spark.createDataFrame(rows, f"{columns}, default string, position int")

    def find(self, address: str, database: str | None = None) -> Feature:
        """The feature an address stands for."""
        scope, _, name = address.rpartition(":")
        if database is not None:
            if scope and scope != database:
                raise FeatureError(f"{address!r} does not lie in database {database!r}")
            scope = database
        if not scope:
            candidates = list(self.databases.values())
        elif scope in self.databases:
            candidates = [self.databases[scope]]
        elif scope in self.contexts():
            candidates = self.of_context(scope)[:1]
        else:
            raise FeatureError(f"no database or context {scope!r}")
        for candidate in candidates:
            if name in candidate.features:
                return candidate.features[name]
        raise FeatureError(f"feature {address!r} does not exist")

    def key_of(self, resolve) -> Feature:
        """The default key: the hash of the context of the first resolved feature."""
        first = self.find(resolve[0]) if resolve else self.first.features["hash"]
        home = self.of_context(self.databases[first.database].context)[0]
        return home.features["hash"]

    def values(self, feature: Feature) -> Values:
        return self.databases[feature.database].many[feature.name]

    def translator(self, source: str, target: str) -> tuple[Feature, bool]:
        """The feature that links two contexts and whether it has to be read backwards."""
        for context, name, backwards in ((source, f"to_{target}", False), (target, f"to_{source}", True)):
            for database in self.of_context(context):
                if name in database.many:
                    return database.features[name], backwards
        raise FeatureError(f"no translator between {source!r} and {target!r}")
