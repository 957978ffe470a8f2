"""Queries over a namespace: filter entities, resolve features, collapse several values.

Shape of the plans:

* the tables of used features only, each joined once, in the order of the databases;
* conditions on multi-valued features become one boolean per entity and condition, computed with
  one aggregation per source frame whatever the number of conditions, so they can stand below
  ``|`` and ``~``; single conditions at the top of the filter become semi and anti joins;
* multi-valued features are collapsed to one row per entity before they are joined, unless the
  rows themselves are asked for;
* rows that may pile up on one key are spread by ``spread_join``; there are no joins but
  equi-joins, and no broadcasts but of hot keys and those Spark derives from sizes it knows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.numbers import as_number
from hashloom.operators.collapse import collapse_rows, collapse_single, check_collapse, unset_result
from hashloom.operators.skew import grid_join, hot_keys, spread_join
from hashloom.plans.filters import Condition, Predicate
from hashloom.plans.namespace import UNSET, Database, Feature, FeatureError, Namespace

_KEY = "__key"
_MAX_LITERALS = 1000


def select(
    namespace: Namespace,
    where: Predicate | None = None,
    resolve: Iterable[str] = (),
    collapse: str | None = "concat",
    group_by: str | None = None,
    how: str = "left",
    hashes=None,
    cross: str = "inner",
    ordered: bool = False,
) -> DataFrame:
    """Run a query; the result has the key first, then the resolved features.

    ``collapse`` is concat, min, max, avg, sum, count or None (one row per combination of values).
    ``group_by`` replaces the entity hash as the key.  ``how`` (left, inner, full) joins further
    databases of the key's context, ``cross`` (inner, left) joins other contexts.  ``hashes``, a
    list or a frame with a ``hash`` column, restricts the entities.  ``ordered`` sorts by the key.
    """
    resolve = list(resolve)
    check_collapse(collapse)
    for option, value, allowed in (("how", how, ("left", "inner", "full")), ("cross", cross, ("inner", "left"))):
        if value not in allowed:
            raise FeatureError(f"{option} must be one of {allowed}, not {value!r}")
    query = _Query(namespace, where, resolve, group_by, how, cross, hashes)
    result = query.rows() if collapse in (None, "none") else query.collapsed(collapse)
    return result.orderBy(result.columns[0]) if ordered else result


def entity_hashes(namespace: Namespace, where: Predicate | None = None, hashes=None) -> DataFrame:
    """The hashes a filter selects."""
    return select(namespace, where, collapse=None, hashes=hashes)


def restrict(frame: DataFrame, hashes, column: str = "hash", hot: DataFrame | None = None) -> DataFrame:
    """Keep the rows of given hashes: a short list is a literal filter, a frame a semi join."""
    if hashes is None:
        return frame
    hashes = short_list_or_frame(frame, hashes, column, "hash")
    if not isinstance(hashes, DataFrame):
        return frame.where(F.col(column).isin(hashes))
    wanted = hashes.select(F.col("hash").alias(column)).distinct()
    return spread_join(frame, wanted, column, "left_semi", hot)


def short_list_or_frame(frame: DataFrame, values, column: str, name: str) -> list[Column] | DataFrame:
    """Values to look for in a column: a short list as literals of its type, a long one as a frame with the
    column ``name``, cast in the same way; a frame stays."""
    if isinstance(values, DataFrame):
        return values
    values = list(values)
    field = frame.schema[column].dataType
    if len(values) <= _MAX_LITERALS:
        return [F.lit(v).cast(field) for v in values]
    listed = [(None if v is None else str(v),) for v in values]
    return frame.sparkSession.createDataFrame(listed, f"`{name}` string").select(F.col(name).cast(field))


def _renamed(hot: DataFrame | None, old: str, new: str) -> DataFrame | None:
    return None if hot is None else hot.withColumnRenamed(old, new)


class _Query:
    """One query: the joined frame with a column per used feature, and what is known about it."""

    def __init__(self, namespace, where, resolve, group_by, how, cross, hashes):
        self.namespace = namespace
        self.key = namespace.find(group_by) if group_by else namespace.key_of(resolve)
        self.home = namespace[self.key.database]
        self.context = self.home.context
        self.how = how
        self.cross = cross
        self.resolved = [namespace.find(address) for address in resolve]
        self.conditions = list({id(c): c for c in where.conditions()}.values()) if where is not None else []
        self.features = {a: namespace.find(a) for c in self.conditions for a in c.addresses()}
        #: rows per entity: whether the frame may hold several rows of one hash
        self.fans_out = self.key.many
        #: multi-valued features present as one row per value
        self.unfolded = {self.key} if self.key.many else set()
        self.truth: dict[int, Column] = {}

        conjuncts = where.conjuncts() if where is not None else []
        direct = [c for c in conjuncts if self._is_membership(c)]
        remaining = [c for c in conjuncts if not any(c is d for d in direct)]
        elsewhere = {id(c) for r in remaining for c in r.conditions()}
        direct = list({id(c): c for c in direct if id(c) not in elsewhere}.values())
        self.membership = {id(c) for c in direct}
        remaining = [c for c in conjuncts if id(c) not in self.membership]

        #: hot entities of the frame, while it holds the rows of a multi-valued key
        self.hot = namespace.values(self.key).hot_keys("hash") if self.key.many else None
        self.frame = self._base(hashes, remaining)
        self._join_same_context()
        for condition in direct:
            self._membership_join(condition)
        self._flag_conditions(self._same_context_conditions())
        for feature in self._row_features():
            self._unfold(feature)
        self._join_other_contexts()
        if remaining:
            filters = [c.column(self._truth_of) for c in remaining]
            self.frame = self.frame.where(reduce(Column.__and__, filters))
        self._name_key()

    # ---- what is used ---------------------------------------------------------------------

    def _in_context(self, feature: Feature) -> bool:
        return self.namespace[feature.database].context == self.context

    def _used(self) -> list[Feature]:
        """Features that need a column: not those a semi or anti join has answered."""
        pending = [c for c in self.conditions if id(c) not in self.membership]
        every = [self.features[a] for c in pending for a in c.addresses()] + self.resolved + [self.key]
        return [f for f in dict.fromkeys(every) if not f.is_hash or f.database != self.home.name]

    def _feature_of(self, condition: Condition) -> Feature:
        return self.features[condition.address]

    def _is_membership(self, condition) -> bool:
        """A condition at the top of the filter that a semi or anti join answers: unset entities
        must fail the semi join's condition and pass the anti join's."""
        if not isinstance(condition, Condition) or condition.kind == "term":
            return False
        feature = self._feature_of(condition)
        if not feature.many or not self._in_context(feature):
            return False
        if condition.kind == "unset":
            return feature.database == self.home.name and not self.key.many
        if condition.unset_passes(feature.data_type):
            return False
        return not condition.about_no_value or (feature.database == self.home.name and not self.key.many)

    def _same_context_conditions(self) -> list[Condition]:
        return [
            c
            for c in self.conditions
            if id(c) not in self.membership
            and not c.keeps_rows
            and self._feature_of(c).many
            and self._in_context(self._feature_of(c))
        ]

    def _row_features(self) -> list[Feature]:
        """Multi-valued features of the key's context that a term comparison needs as rows."""
        found = {}
        for condition in self.conditions:
            own = self._feature_of(condition)
            inside = [self.features[a] for a in condition.addresses()[1:]]
            if condition.kind == "term" and condition.about_no_value and own.many:
                if any(f.many for f in inside):
                    raise FeatureError("a != term on a multi-valued feature takes single-valued features only")
                continue
            for feature in [own] if condition.keeps_rows else []:
                found[feature] = None
            for feature in inside:
                found[feature] = None
        return [f for f in found if f.many and self._in_context(f)]

    def _columns_of(self, database: Database) -> list[Feature]:
        return [f for f in self._used() if f.database == database.name and not f.many]

    def _known(self, database: str) -> Column:
        return F.col(f"__known_{database}")

    # ---- joins ----------------------------------------------------------------------------

    def _scanned(self, database: Database, conjuncts: list[Predicate]) -> Database:
        """The database behind the conditions that Catalyst doesn't get to its scan: those on features with a
        default.  They are tried on the stored column and on the default apart, so that the second folds to a
        constant; the whole filter is applied later again.  A full join keeps all rows until then."""

        def stored(condition: Condition) -> Column:
            feature = self._feature_of(condition)
            column, default = F.col(feature.name), database.defaults.get(feature.name)
            passes = condition.test(column, feature.data_type)
            if default is None:
                return passes
            # of the type that the filled column has
            filled = F.coalesce(F.lit(None).cast(feature.data_type), F.lit(default))
            filled = condition.test(filled, feature.data_type)
            return (column.isNotNull() & passes) | (column.isNull() & filled)

        def reads_stored(condition: Condition) -> bool:
            feature = self._feature_of(condition)
            alone = len(condition.addresses()) == 1 and condition.kind != "term"
            return alone and feature.database == database.name and not feature.many and not feature.is_hash

        def has_default(condition: Condition) -> bool:
            return database.defaults.get(self._feature_of(condition).name) is not None

        wanted = [
            c.column(stored)
            for c in conjuncts
            if all(map(reads_stored, c.conditions())) and any(map(has_default, c.conditions()))
        ]
        if not wanted or self.how == "full":
            return database
        return database.with_parts(entities=database.entities.where(reduce(Column.__and__, wanted)))

    def _entities(self, database: Database, known: bool = True) -> DataFrame:
        columns = [database.single(f.name).alias(f.label) for f in self._columns_of(database)]
        marks = [F.lit(True).alias(f"__known_{database.name}")] if known else []
        return database.entities.select("hash", *columns, *marks)

    def _base(self, hashes, conjuncts: list[Predicate]) -> DataFrame:
        if not self.key.many:
            frame = self._entities(self._scanned(self.home, conjuncts))
            return restrict(frame, hashes)
        pairs = self.namespace.values(self.key).pairs()
        return restrict(pairs.withColumnRenamed("value", self.key.label), hashes, hot=self.hot)

    def _join(self, single: DataFrame, how: str) -> None:
        """Join a side with one row per hash."""
        self.frame = spread_join(self.frame, single, "hash", how, self.hot)

    def _join_same_context(self) -> None:
        used = {f.database for f in self._used() if self._in_context(f)}
        if self.key.many and not self._needs_home():
            used.discard(self.home.name)
        for name in sorted(used, key=self.namespace.position):
            if f"__known_{name}" not in self.frame.columns:
                self._join(self._entities(self.namespace[name]), self.how)

    def _needs_home(self) -> bool:
        return any(f.database == self.home.name and f != self.key for f in self._used())

    def _membership_join(self, condition: Condition) -> None:
        feature = self._feature_of(condition)
        rows = self.namespace.values(feature).rows()
        if condition.kind == "unset":
            found = rows.where(F.col("value").cast("string") != UNSET)
        else:
            found = rows.where(condition.any_test(F.col("value"), feature.data_type))
        absent = condition.about_no_value or condition.kind == "unset"
        found = found.select("hash").distinct()
        self._join(found, "left_anti" if absent else "left_semi")

    def _flag_conditions(self, conditions: list[Condition]) -> None:
        """One boolean per entity and condition, by one aggregation per source frame."""
        by_frame: dict[int, list[Condition]] = {}
        for condition in conditions:
            source = self.namespace.values(self._feature_of(condition)).frame
            by_frame.setdefault(id(source), []).append(condition)
        for group in by_frame.values():
            plain = [c for c in group if not (c.kind == "term" and c.value.addresses)]
            if plain:
                self._join(self._flags(plain), "left")
                for condition in plain:
                    self._set_truth(condition, self._right_of(condition))
            for condition in group:
                if condition not in plain:
                    self._flag_against_entity(condition)

    def _flags(self, conditions: list[Condition]) -> DataFrame:
        source = self.namespace.values(self._feature_of(conditions[0])).frame
        marks = []
        for condition in conditions:
            feature = self._feature_of(condition)
            value = F.col(self.namespace.values(feature).column)
            test = condition.any_test(value, feature.data_type, self._right_of(condition))
            passed = F.when(value.isNotNull(), F.coalesce(test, F.lit(False)))
            marks.append(F.bool_or(passed).alias(self._flag_name(condition)))
        return source.groupBy("hash").agg(*marks)

    def _flag_against_entity(self, condition: Condition) -> None:
        """The same for a term over single-valued features of the entity."""
        feature = self._feature_of(condition)
        right = self.frame.select("hash", self._right_of(condition).alias("__right"))
        right = right.dropDuplicates(["hash"]) if self.fans_out else right
        values = self.namespace.values(feature)
        rows = spread_join(values.pairs(), right, "hash", "inner", values.hot_keys("hash"))
        test = condition.any_test(F.col("value"), feature.data_type, F.col("__right"))
        flag = F.bool_or(F.coalesce(test, F.lit(False))).alias(self._flag_name(condition))
        self._join(rows.groupBy("hash").agg(flag), "left")
        self._set_truth(condition, self._right_of(condition))

    def _flag_name(self, condition: Condition) -> str:
        return f"__flag_{self.conditions.index(condition)}"

    def _set_truth(self, condition: Condition, right: Column | None, known: Column | None = None) -> None:
        feature = self._feature_of(condition)
        unset = condition.unset_passes(feature.data_type, right)
        unset = F.lit(unset) if isinstance(unset, bool) else F.coalesce(unset, F.lit(False))
        known = self._known(feature.database) if known is None else known
        passed = F.when(known, F.coalesce(F.col(self._flag_name(condition)), unset))
        self.truth[id(condition)] = ~passed if condition.about_no_value else passed

    def _right_of(self, condition: Condition) -> Column | None:
        if condition.kind != "term":
            return None
        return condition.value.build(self._number_of)

    def _number_of(self, address: str) -> Column:
        feature = self.features[address]
        return as_number(self._value_of(feature), feature.data_type).cast("double")

    def _value_of(self, feature: Feature) -> Column:
        if feature.is_hash and feature.database == self.home.name:
            return F.col("hash")
        return F.col(feature.label)

    def _unfold(self, feature: Feature) -> None:
        """Join a multi-valued feature as one row per value; unset text features show None."""
        if feature in self.unfolded:
            return
        source = self.namespace.values(feature)
        pairs = source.pairs().withColumnRenamed("value", feature.label)
        if self.unfolded or self.key.many:  # the frame has several rows of a hash by now
            frame_hot = hot_keys(self.frame, "hash")
            self.frame = grid_join(pairs, self.frame, "hash", "right", source.hot_keys("hash"), frame_hot)
        else:
            self.frame = spread_join(pairs, self.frame, "hash", "right", source.hot_keys("hash"))
        self._fill(feature)
        self.unfolded.add(feature)

    def _fill(self, feature: Feature) -> None:
        if feature.is_text:
            value = F.col(feature.label)
            known = self._known(feature.database) if f"__known_{feature.database}" in self.frame.columns else F.lit(True)
            self.frame = self.frame.withColumn(feature.label, F.when(value.isNull() & known, UNSET).otherwise(value))

    def _join_other_contexts(self) -> None:
        used = [f for f in self._used() if not self._in_context(f)]
        contexts = dict.fromkeys(
            self.namespace[f.database].context for f in sorted(used, key=lambda f: self.namespace.position(f.database))
        )
        for context in contexts:
            self._join_context(context, [f for f in used if self.namespace[f.database].context == context])

    def _join_context(self, context: str, used: list[Feature]) -> None:
        """Entities of another context through the translator: link rows joined with the features
        of their targets, then with the entities."""
        link, backwards = self.namespace.translator(self.context, context)
        values = self.namespace.values(link)
        pairs = values.pairs()
        source, target = ("value", "hash") if backwards else ("hash", "value")
        links = pairs.select(F.col(source).alias("__source"), F.col(target).alias("hash"))
        parts = []
        for database in self.namespace.of_context(context):
            single = [f for f in used if f.database == database.name and not f.many]
            if single:
                parts.append(self._entities(database, known=False))
            for feature in [f for f in used if f.database == database.name and f.many]:
                parts.extend(self._target_values(feature, link))
        targets = reduce(lambda a, b: a.join(b, "hash"), parts) if parts else None
        reached = links
        if targets is not None:
            hot = _renamed(values.hot_keys(target), target, "hash")
            reached = spread_join(links, targets, "hash", "inner", hot)
        if link in used:
            reached = reached.withColumn(link.label, F.col("__source"))
        reached = reached.drop("hash").withColumnRenamed("__source", "hash")
        if self.cross == "inner":
            hot = _renamed(values.hot_keys(source), source, "hash")
            self.frame = spread_join(reached, self.frame, "hash", "inner", hot)
        else:
            self.frame = spread_join(reached, self.frame, "hash", "right", hot_keys(reached, "hash"))
        self.fans_out = True
        for condition in self.conditions:
            if f"__flag_{self.conditions.index(condition)}" in reached.columns:
                self._set_truth(condition, None, F.col(self._flag_name(condition)).isNotNull())
        self.unfolded |= {f for f in used if f.many and f.label in self.frame.columns}

    def _target_values(self, feature: Feature, link: Feature) -> list[DataFrame]:
        """A multi-valued feature of the other side: the flags of its conditions, its rows if a
        result or a term needs them.  Targets without a value are not reached."""
        conditions = [
            c for c in self.conditions if self._feature_of(c) == feature and not c.keeps_rows and feature != link
        ]
        if any(c.kind == "term" and c.value.addresses for c in conditions):
            raise FeatureError("a != term on a feature of another context takes constants only")
        parts = [self._flags(conditions)] if conditions else []
        inside_terms = [self.features[a] for c in self.conditions for a in c.addresses()[1:]]
        as_rows = feature in self.resolved or feature in inside_terms
        as_rows = as_rows or any(c.keeps_rows and self._feature_of(c) == feature for c in self.conditions)
        if as_rows and feature != link:
            parts.append(self.namespace.values(feature).pairs().withColumnRenamed("value", feature.label))
        return parts

    # ---- filter and result ----------------------------------------------------------------

    def _truth_of(self, condition: Condition) -> Column:
        if id(condition) in self.truth:
            return self.truth[id(condition)]
        feature = self._feature_of(condition)
        return condition.test(self._value_of(feature), feature.data_type, self._right_of(condition))

    def _name_key(self) -> None:
        """Name the key and drop rows without one."""
        key = F.col("hash") if self.key.is_hash else F.col(self.key.label)
        self.frame = self.frame.withColumn(_KEY, key)
        if not self.key.is_hash or self.how == "full":
            self.frame = self.frame.where(F.col(_KEY).isNotNull())
        if self.key.is_text:
            self.frame = self.frame.where(F.col(_KEY) != UNSET)

    def _names(self) -> list[str]:
        """Output names: prefixes dropped, a second feature of one name keeps its database."""
        names = [self.key.name]
        for feature in self.resolved:
            names.append(feature.label if feature.name in names else feature.name)
        if len(set(names)) < len(names):
            raise FeatureError(f"a feature is resolved twice: {names}")
        return names

    def rows(self) -> DataFrame:
        """No collapse: one row per combination of values, each once."""
        pending = [f for f in self.resolved if f.many and f not in self.unfolded]
        unique = not self.fans_out and not self.unfolded and self.key.is_hash
        for feature in pending:
            self._unfold(feature)
        columns = [F.col(_KEY)] + [self._value_of(f) for f in self.resolved]
        result = self.frame.select(*[c.alias(n) for c, n in zip(columns, self._names())])
        return result if unique else result.distinct()

    def collapsed(self, collapse: str) -> DataFrame:
        """One row per key."""
        pending = [f for f in self.resolved if f.many and f not in self.unfolded]
        present = [f for f in self.resolved if f not in pending]
        if not self.key.is_hash and not present and pending:
            result = None
        elif self.key.is_hash and not self.fans_out and not self.unfolded:
            columns = [collapse_single(self._value_of(f), f.data_type, collapse).alias(f.label) for f in present]
            marks = [c for c in self.frame.columns if c.startswith("__known_")]
            result = self.frame.select(_KEY, *columns, *marks)
        else:
            result = self._collapse_present(present, pending, collapse)
        if self.key.is_hash:
            result = self._attach_per_entity(result, pending, collapse)
        else:
            result = self._attach_per_key(result, pending, collapse)
        labels = [_KEY] + [f.label for f in self.resolved]
        return result.select(*[F.col(c).alias(n) for c, n in zip(labels, self._names())])

    def _collapse_present(self, present, pending, collapse) -> DataFrame:
        marks = {f"__known_{f.database}" for f in pending} & set(self.frame.columns)
        known = [F.bool_or(m).alias(m) for m in sorted(marks)] if self.key.is_hash else []
        named = [(self._value_of(f).alias(f.label), f.label, f.data_type) for f in present]
        return collapse_rows(self.frame, _KEY, named, collapse, known)

    def _attach_per_entity(self, result: DataFrame, pending: list[Feature], collapse: str) -> DataFrame:
        """Collapse multi-valued features per entity, one aggregation per source frame."""
        by_frame: dict[tuple, list[Feature]] = {}
        for feature in pending:
            source = self.namespace.values(feature)
            by_frame.setdefault((id(source.frame), source.unique), []).append(feature)
        for group in by_frame.values():
            source = self.namespace.values(group[0])
            named = [(F.col(self.namespace.values(f).column).alias(f.label), f.label, f.data_type) for f in group]
            values = collapse_rows(source.frame, "hash", named, collapse, distinct=not source.unique)
            result = result.join(values.withColumnRenamed("hash", _KEY), _KEY, "left")
        for feature in pending:
            mark = f"__known_{feature.database}"
            known = F.col(mark) if mark in result.columns else F.lit(True)
            filled = unset_result(F.col(feature.label), feature.data_type, collapse)
            result = result.withColumn(feature.label, F.when(known, filled))
        return result

    def _attach_per_key(self, result: DataFrame | None, pending: list[Feature], collapse: str) -> DataFrame:
        """Collapse multi-valued features per key: each feature on its own, so that several of
        them never multiply."""
        for feature in pending:
            mark = f"__known_{feature.database}"
            members = self.frame.select(_KEY, "hash", mark).distinct()
            source = self.namespace.values(feature)
            pairs = source.pairs().withColumnRenamed("value", feature.label)
            joined = spread_join(pairs, members, "hash", "right", source.hot_keys("hash"))
            value = F.col(feature.label)
            if feature.is_text:
                value = F.when(value.isNull() & F.col(mark), UNSET).otherwise(value)
            named = [(value.alias(feature.label), feature.label, feature.data_type)]
            values = collapse_rows(joined, _KEY, named, collapse)
            result = values if result is None else result.join(values, _KEY, "left")
        return result
