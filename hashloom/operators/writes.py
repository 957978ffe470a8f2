"""Writes on a database.  Each takes a Database and returns the changed one; nothing is stored
before ``hashloom.sources.tables.save_database``.

Single-valued writes never shuffle the wide entity table unless the update itself is too large to
broadcast: updates are left-joined to the entities and unknown hashes are found on the hash column
alone.  Multi-valued inserts are kept apart from the stored pairs, so saving appends them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.operators.skew import hot_keys, spread_join
from hashloom.plans.filters import Predicate
from hashloom.plans.namespace import (
    BASE,
    ENTITIES,
    Database,
    Edit,
    Feature,
    FeatureError,
    Namespace,
    Values,
    check_feature_name,
    known_entities,
)
from hashloom.plans.query import entity_hashes, restrict, short_list_or_frame


def _feature(database: Database, name: str) -> Feature:
    if name not in database.features or name == "hash":
        raise FeatureError(f"feature {name!r} does not exist in database {database.name!r}")
    return database.features[name]


def _absent(database: Database, name: str) -> None:
    if name in database.features:
        raise FeatureError(f"feature {name!r} exists already in database {database.name!r}")


def _without(mapping: dict, *names: str) -> dict:
    return {k: v for k, v in mapping.items() if k not in names}


def _entities_changed(database: Database, entities: DataFrame, edits=None, **parts) -> Database:
    """Replace the entity table; it is no longer what the files hold."""
    files, added = _without(database.files, ENTITIES), _without(database.added, ENTITIES)
    return database.with_parts(entities=entities, files=files, added=added, edits=edits, **parts)


def _edits(database: Database, hashes: DataFrame, apply) -> tuple[Edit, ...] | None:
    return None if database.edits is None else (*database.edits, Edit(hashes, apply))


def _entities_edited(database: Database, hashes: DataFrame, apply) -> Database:
    """Change the rows of some hashes; a table stored in ranges keeps the files of all others."""
    return _entities_changed(database, apply(database.entities), _edits(database, hashes, apply))


def _entities_added(database: Database, rows: DataFrame) -> Database:
    """Append rows to the entity table; saving writes only them."""
    before = database.added.get(ENTITIES)
    added = rows if before is None else before.unionByName(rows)
    return database.with_parts(
        entities=database.entities.unionByName(rows),
        added=database.added | {ENTITIES: added},
        edits=_edits(database, rows.select("hash"), lambda entities: entities.unionByName(rows)),
    )


# ---- features ------------------------------------------------------------------------------


def add_feature(
    database: Database, name: str, default=None, data_type: str = "string", permissive: bool = False
) -> Database:
    """A new feature: single-valued with a default, multi-valued without one."""
    if permissive and name in database.features:
        return database
    check_feature_name(name)
    _absent(database, name)
    if default is None:
        schema = T.StructType(
            [database.entities.schema["hash"], T.StructField("value", T.DataType.fromDDL(data_type))]
        )
        empty = database.entities.sparkSession.createDataFrame([], schema)
        return database.with_parts(many=database.many | {name: Values(empty, unique=True)})
    entities = database.entities.withColumn(name, F.lit(default).cast(data_type))
    return _entities_changed(database, entities, defaults=database.defaults | {name: default})


def init_entities(database: Database) -> Database:
    """Add the hashes that only multi-valued features mention to the entity table."""
    if not database.many:
        return database
    return _add_entities(database, known_entities(database.many))


def _add_entities(database: Database, hashes: DataFrame) -> Database:
    """Add unknown hashes; their single-valued features get the defaults."""
    hashes = hashes.select(F.col("hash").cast(database.entities.schema["hash"].dataType))
    unknown = _unknown(hashes, database.entities).distinct()
    columns = [
        F.lit(database.defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in database.entities.schema
        if f.name != "hash"
    ]
    rows = unknown.select("hash", *columns).select(*database.entities.columns)
    return _entities_added(database, rows)


def _unknown(rows: DataFrame, stored: DataFrame, on: tuple[str, ...] = ("hash",), hot: DataFrame | None = None) -> DataFrame:
    """The rows that are not stored yet.  The stored side is first reduced to the hashes of the rows: these are
    the small side, so Spark can broadcast them and the stored side is read without a shuffle."""
    near = spread_join(stored.select(*on), rows.select("hash").distinct(), "hash", "left_semi", hot)
    return rows.join(near, list(on), "left_anti")


def rename_feature(database: Database, name: str, new_name: str) -> Database:
    feature = _feature(database, name)
    check_feature_name(new_name)
    _absent(database, new_name)
    if feature.many:
        files = {new_name if k == name else k: v for k, v in database.files.items()}
        added = {new_name if k == name else k: v for k, v in database.added.items()}
        many = {new_name if k == name else k: v for k, v in database.many.items()}
        return database.with_parts(many=many, files=files, added=added)
    defaults = {new_name if k == name else k: v for k, v in database.defaults.items()}
    return _entities_changed(database, database.entities.withColumnRenamed(name, new_name), defaults=defaults)


def delete_feature(database: Database, name: str) -> Database:
    if _feature(database, name).many:
        return database.with_parts(
            many=_without(database.many, name),
            files=_without(database.files, name),
            added=_without(database.added, name),
        )
    return _entities_changed(
        database, database.entities.drop(name), defaults=_without(database.defaults, name)
    )


# ---- values --------------------------------------------------------------------------------


def pivot_triples(triples: DataFrame, features: list[str], order: list[str]) -> DataFrame:
    """Triples (hash, feature, value) to one row per hash with a column per feature; the last
    value of each wins.  The features are named, so no job has to look for them; ``max_by`` keeps
    one candidate per task and group, so a hot entity costs no more than any other."""
    wanted = triples.where(F.col("feature").isin(features))
    if order:
        columns = [
            F.max_by("value", F.when(F.col("feature") == name, F.struct(*order))).alias(name) for name in features
        ]
    else:
        columns = [F.max(F.when(F.col("feature") == name, F.col("value"))).alias(name) for name in features]
    return wanted.groupBy("hash").agg(*columns)


def set_values(database: Database, name: str, updates: DataFrame, order: list[str] | None = None) -> Database:
    """Set values from rows (hash, value); unknown hashes become entities."""
    triples = updates.withColumn("feature", F.lit(name))
    return set_values_batch(database, triples, [name], order)


def set_values_batch(
    database: Database, triples: DataFrame, names: list[str], order: list[str] | None = None
) -> Database:
    """Write several features from triples (hash, feature, value) in one pass per table.

    Single-valued features take the last value by the ``order`` columns (the greatest value
    without them); multi-valued ones take every pair that is not there yet.
    """
    features = [_feature(database, name) for name in names]
    single = [f for f in features if not f.many]
    for feature in [f for f in features if f.many]:
        rows = triples.where(F.col("feature") == feature.name).select("hash", "value")
        database = _insert_pairs(database, feature, rows)
    if single:
        wide = pivot_triples(triples, [f.name for f in single], list(order or []))
        database = _upsert(database, single, wide)
    if any(f.many for f in features):
        many_names = [f.name for f in features if f.many]
        mentioned = triples.where(F.col("feature").isin(many_names) & F.col("value").isNotNull())
        database = _add_entities(database, mentioned.select("hash"))
    return database


def _upsert(database: Database, features: list[Feature], wide: DataFrame) -> Database:
    """Update known entities, insert unknown ones with the defaults of the other features."""
    schema = database.entities.schema
    new = {f.name: f"__new_{f.name}" for f in features}
    columns = [F.col(n).cast(schema[n].dataType).alias(alias) for n, alias in new.items()]
    updates = wide.select(F.col("hash").cast(schema["hash"].dataType), *columns)
    merged = [
        F.coalesce(F.col(new[c]), database.single(c)).alias(c) if c in new else F.col(c)
        for c in database.entities.columns
    ]
    inserted = [
        F.col("hash")
        if f.name == "hash"
        else F.coalesce(
            F.col(new[f.name]) if f.name in new else F.lit(None), F.lit(database.defaults.get(f.name))
        )
        .cast(f.dataType)
        .alias(f.name)
        for f in schema
    ]

    def apply(entities: DataFrame) -> DataFrame:
        known = entities.join(updates, "hash", "left").select(*merged)
        return known.unionByName(_unknown(updates, entities).select(*inserted))

    return _entities_edited(database, updates.select("hash"), apply)


def _insert_pairs(database: Database, feature: Feature, rows: DataFrame) -> Database:
    """Add (hash, value) pairs that are not stored yet."""
    source = database.many[feature.name]
    hash_type = database.entities.schema["hash"].dataType
    rows = rows.select(F.col("hash").cast(hash_type), F.col("value").cast(feature.data_type))
    rows = rows.where(F.col("value").isNotNull()).distinct()
    stored = source.pairs()
    # hot hashes are known of saved tables; looking for them elsewhere would cost what this saves
    hot = None if source.hot is None else source.hot_keys("hash")
    fresh = _unknown(rows, source.rows(), ("hash", "value"), hot)
    added = database.added.get(feature.name)
    added = fresh if added is None else added.unionByName(fresh)
    frame = stored.unionByName(fresh)
    return database.with_parts(
        many=database.many | {feature.name: Values(frame, unique=True)},
        added=database.added | {feature.name: added},
    )


def set_by_query(
    namespace: Namespace,
    name: str,
    value,
    where: Predicate | None = None,
    target: str | None = None,
    hashes=None,
    create: DataFrame | None = None,
) -> Database:
    """Set one value for the result of a query; ``create`` adds hashes, known or not."""
    database = namespace[target or namespace.find(name).database]
    selected = entity_hashes(namespace, where, hashes)
    if create is not None:
        selected = selected.union(create.select("hash")).distinct()
    return set_values(database, name, selected.withColumn("value", F.lit(value)))


def reset_values(database: Database, name: str, values=None, hashes=None) -> Database:
    """Single-valued: back to the default.  Multi-valued: remove the pairs; entities left without
    any are unset.  ``values`` and ``hashes``, lists or frames, both restrict; an empty list does
    not, and nothing happens without either."""
    values, hashes = (None if isinstance(w, (list, tuple)) and not w else w for w in (values, hashes))
    if values is None and hashes is None:
        _feature(database, name)
        return database
    if _feature(database, name).many:
        return _remove_pairs(database, name, values, hashes)
    entities = database.entities
    column = database.single(name)
    values = None if values is None else short_list_or_frame(entities, values, name, "value")
    hashes = None if hashes is None else short_list_or_frame(entities, hashes, "hash", "hash")

    def marked(entities: DataFrame) -> tuple[DataFrame, Column]:
        hit = F.lit(True)
        if values is not None:
            if isinstance(values, DataFrame):
                some = values.select(F.col("value").alias("__value"), F.lit(True).alias("__in_values")).distinct()
                keyed = entities.withColumn("__value", column)
                entities = spread_join(keyed, some, "__value", "left", hot_keys(keyed, "__value")).drop("__value")
                hit = hit & F.coalesce(F.col("__in_values"), F.lit(False))
            else:
                hit = hit & F.coalesce(column.isin(values), F.lit(False))
        if hashes is not None:
            if isinstance(hashes, DataFrame):
                some = hashes.select("hash", F.lit(True).alias("__in_hashes")).distinct()
                entities = entities.join(some, "hash", "left")
                hit = hit & F.coalesce(F.col("__in_hashes"), F.lit(False))
            else:
                hit = hit & F.coalesce(F.col("hash").isin(hashes), F.lit(False))
        return entities, hit

    default = F.lit(database.defaults.get(name)).cast(database.entities.schema[name].dataType)

    def apply(entities: DataFrame) -> DataFrame:
        rows, hit = marked(entities)
        merged = [
            F.when(hit, default).otherwise(column).alias(name) if c == name else F.col(c) for c in entities.columns
        ]
        return rows.select(*merged)

    rows, hit = marked(entities)
    return _entities_edited(database, rows.where(hit).select("hash"), apply)


def _remove_pairs(database: Database, name: str, values, hashes) -> Database:
    source = database.many[name]
    stored = source.pairs()
    wanted = {
        c: short_list_or_frame(stored, w, c, c) for c, w in (("hash", hashes), ("value", values)) if w is not None
    }
    if any(isinstance(w, DataFrame) for w in wanted.values()):
        doomed = stored
        for column, some in wanted.items():
            is_frame = isinstance(some, DataFrame)
            if is_frame:
                doomed = restrict(doomed, some.select(F.col(column).alias("hash")), column, source.hot_keys(column))
            else:
                doomed = doomed.where(F.col(column).isin(some))
        kept = stored.join(doomed, ["hash", "value"], "left_anti")
    else:
        hits = [F.col(column).isin(some) for column, some in wanted.items()]
        kept = stored.where(~reduce(Column.__and__, hits))
    return database.with_parts(
        many=database.many | {name: Values(kept, unique=True)},
        files=_without(database.files, name),
        added=_without(database.added, name),
    )


def delete_entities(database: Database, hashes: DataFrame) -> Database:
    """Remove hashes from every table of a database."""
    doomed = hashes.select("hash").distinct()
    many = _delete_from_values(database, doomed)
    base = {name: stored for name, stored in database.files.items() if name == BASE}
    edited = _entities_edited(database, doomed, lambda entities: entities.join(doomed, "hash", "left_anti"))
    return edited.with_parts(many=many, files=base, added={})


def _delete_from_values(database: Database, doomed: DataFrame) -> dict:
    """Anti join per source frame, once for features that share one."""
    kept: dict[int, DataFrame] = {}
    many = {}
    for name, source in database.many.items():
        if id(source.frame) not in kept:
            hot = source.hot_keys("hash")
            kept[id(source.frame)] = spread_join(source.frame, doomed, "hash", "left_anti", hot)
        many[name] = Values(kept[id(source.frame)], source.column, source.unique)
    return many


def copy_feature(
    namespace: Namespace,
    source: str,
    new_name: str,
    target: str | None = None,
    where: Predicate | None = None,
    hashes=None,
) -> Database:
    """Copy the values of a feature into another one for the result of a query; a new target
    feature is multi-valued."""
    origin = namespace.find(source)
    database = namespace[target] if target else namespace.first
    if new_name not in database.features:
        database = add_feature(database, new_name, data_type=origin.data_type.simpleString())
    selected = entity_hashes(namespace, where, hashes)
    home = namespace[origin.database]
    if origin.many:
        source = home.many[origin.name]
        rows = spread_join(source.pairs(), selected, "hash", "left_semi", source.hot_keys("hash"))
    else:
        rows = home.entities.select("hash", home.single(origin.name).alias("value"))
        rows = rows.join(selected, "hash", "left_semi")
    return set_values(database, new_name, rows)
