"""Extraction, derivation and streams."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import hashes_of, rows_of
from pyspark.sql import functions as F

from hashloom import Database, Namespace, feature, select
from hashloom.functions.text import Contexts
from hashloom.operators import jobs, writes
from hashloom.operators.identity import class_members, equivalence_classes
from hashloom.operators.paging import lookup_entity, page, page_after, page_count
from hashloom.operators.profile import catalogue_profile, feature_profile, feature_strings
from hashloom.plans.namespace import FeatureError
from hashloom.streaming import latest, upsert


@pytest.fixture
def instances(spark):
    rows = [(f"h{i}", f"/data/{i}.cnf", b" ".join(b"%d" % n for n in range(i)) + b" 0") for i in range(6)]
    return spark.createDataFrame(rows, "hash string, path string, content binary")


@pytest.fixture
def extractor():
    def extractor(path, content):
        numbers = [int(t) for t in content.split()]
        if len(numbers) == 2:
            raise TimeoutError
        if len(numbers) == 3:
            raise MemoryError
        if len(numbers) == 4:
            raise ValueError("odd")
        return [("size", len(numbers)), ("largest", max(numbers)), ("token", numbers[0])]

    return extractor


def test_extraction(spark, instances, extractor):
    extracted = jobs.extract_features(instances, extractor)
    status = {row.status: row.n for row in jobs.run_status(extracted).collect()}
    assert status == {"success": 3, "timeout": 1, "memout": 1, "failure": 1}
    database = Database.of("cnf_db", instances.select("hash"))
    declared = [("size", "0"), ("largest", "0"), ("token", None)]
    stored = jobs.store_features(database, jobs.extracted_triples(extracted), declared, ["cnf"])
    assert rows_of(select(Namespace([stored]), resolve=["size", "largest", "token"])) == [
        ("h0", "1", "0", "0"),
        ("h1", "0", "0", "None"),
        ("h2", "0", "0", "None"),
        ("h3", "0", "0", "None"),
        ("h4", "5", "3", "0"),
        ("h5", "6", "4", "0"),
    ]
    with pytest.raises(FeatureError):
        jobs.store_features(database, jobs.extracted_triples(extracted), declared, ["kis"])


def test_last_value_wins_and_named_statuses(spark):
    def extractor(path, content):
        raised = {b"1": jobs.OutputLimitError, b"2": FileNotFoundError}.get(bytes(content))
        if raised:
            raise raised(path)
        return [("f", 9), ("f", 1)]

    rows = [(f"h{i}", f"/d/{i}", b"%d" % i) for i in range(3)]
    extracted = jobs.extract_features(spark.createDataFrame(rows, "hash string, path string, content binary"), extractor)
    assert {row.status: row.n for row in jobs.run_status(extracted).collect()} == {"success": 1, "fileout": 1, "failure": 1}
    database = Database.of("cnf_db", spark.createDataFrame([("h0",)], "hash string"))
    stored = jobs.store_features(database, jobs.extracted_triples(extracted), [("f", "0")], ["cnf"])
    assert rows_of(stored.entities) == [("h0", "1")]


def test_hundred_instances(spark):
    """A callback feature for a hundred entities, as one write."""
    rows = [(str(i), f"/d/{i}", b"%d" % i) for i in range(100)]
    frame = spark.createDataFrame(rows, "hash string, path string, content binary")
    extracted = jobs.extract_features(frame, lambda path, content: [("random", int(content) * 7 % 11)])
    database = Database.of("cnf_db", frame.select("hash"))
    stored = jobs.store_features(database, jobs.extracted_triples(extracted), [("random", "0")], ["cnf"])
    assert rows_of(stored.entities) == sorted(((str(i), str(i * 7 % 11)) for i in range(100)), key=str)


def test_derivation(spark, instances):
    contexts = Contexts()
    listing = spark.createDataFrame([("/data/1.kis",), ("/data/5.kis",)], "path string")
    todo = jobs.pending_derivations(instances, listing, contexts, "cnf", ".kis")
    assert hashes_of(todo) == ["h0", "h2", "h3", "h4"]
    derived = jobs.transform_content(todo, lambda path, content: b"7 " + content)
    database = jobs.derive_entities(
        Database.empty(spark, "kis_db"),
        derived,
        source="cnf",
        sources=["cnf"],
        targets=["kis"],
        features={"k": F.size(F.split(F.decode("derived", "UTF-8"), " "))},
        declared=[("k", "0")],
    )
    result = select(Namespace([database]), resolve=["k", "to_cnf"]).collect()
    assert sorted((r.k, r.to_cnf) for r in result) == [("3", "h0"), ("4", "h2"), ("5", "h3"), ("6", "h4")]
    assert all(len(r.hash) == 32 for r in result)
    both = Namespace([database, Database.of("cnf_db", instances.select("hash", "path"))])
    where = feature("cnf:path").like("%/3.cnf") | (feature("k") > 5)
    linked = select(both, where, ["k", "cnf_db:path"], collapse=None)
    assert sorted((r.k, r.path) for r in linked.collect()) == [("5", "/data/3.cnf"), ("6", "/data/4.cnf")]
    back = select(both, feature("kis:k") < 5, ["path"], collapse=None, group_by="cnf:hash")
    assert rows_of(back) == [("h0", "/data/0.cnf"), ("h2", "/data/2.cnf")]
    all_of = select(both, resolve=["path", "kis:k"], group_by="cnf:hash", cross="left")
    assert len(rows_of(all_of)) == 6
    with pytest.raises(FeatureError):
        jobs.derive_entities(database, derived, "opb", ["cnf"], ["kis"], {}, [])


def test_stream(spark, tmp_path):
    """Late and repeated triples: the latest event time wins, a second merge changes nothing."""
    schema = "hash string, feature string, value string, time timestamp, tie bigint"
    rows = [
        [("a", "one", "new", "2024-01-01 10:00:00", 1), ("a", "many", "x", "2024-01-01 10:00:00", 1)],
        [("a", "one", "late", "2024-01-01 09:00:00", 2), ("a", "many", "y", "2024-01-01 09:00:00", 2)],
        [("b", "one", "only", "2024-01-01 11:00:00", 3), ("a", "many", "x", "2024-01-01 11:00:00", 3)],
    ]
    source, target, state = (str(tmp_path / n) for n in ("source", "target", "state"))
    base = writes.add_feature(writes.add_feature(Database.empty(spark, "db"), "one", "none"), "many")
    for batch in rows:
        frame = spark.createDataFrame(batch, schema.replace("timestamp", "string"))
        frame.withColumn("time", F.to_timestamp("time")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert.land_triples(stream, target, state, many=["many"]).awaitTermination()
    landed = upsert.landed(spark, target)
    merged = upsert.apply_landed(base, landed, ["one", "many"])
    for _ in range(2):
        assert rows_of(merged.entities) == [("a", "new"), ("b", "only")]
        assert rows_of(merged.many["many"].pairs()) == [("a", "x"), ("a", "y")]
        merged = upsert.apply_landed(merged, landed, ["one", "many"])
    compacted = upsert.compact(spark, target, str(tmp_path / "compact"), many=["many"])
    again = upsert.apply_landed(base, compacted, ["one", "many"])
    assert rows_of(again.entities) == [("a", "new"), ("b", "only")]
    assert rows_of(again.many["many"].pairs()) == [("a", "x"), ("a", "y")]


def test_stream_without_repetitions(spark, tmp_path):
    schema = "hash string, feature string, value string, time timestamp, tie bigint"
    rows = [("a", "f", "x", "2024-01-01 10:00:00", 1), ("a", "f", "x", "2024-01-01 10:05:00", 2), ("a", "f", "y", "2024-01-01 10:06:00", 3)]
    rows += [("a", "one", value, f"2024-01-01 10:0{at}:00", at) for at, value in enumerate("ABA")] + [("a", "one", "B", "2024-01-01 10:01:00", 1)]
    frame = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
    frame.withColumn("time", F.to_timestamp("time")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    writer = upsert.deduplicated(stream, "1 hour", ["f"]).writeStream.format("parquet").trigger(availableNow=True)
    writer.option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.value for r in found.where("feature = 'f'").collect()) == ["x", "y"]
    assert [r.value for r in found.where("feature = 'one'").orderBy("time").collect()] == ["A", "B", "A"]
    base = writes.add_feature(Database.empty(spark, "db"), "one", "none")
    assert rows_of(upsert.apply_landed(base, found, ["one"]).entities) == [("a", "A")]


def test_page_of_the_first_range_is_bounded(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") > 2, F.col("id")).alias("k"))
    found = page(frame, "k", 2, 100, top_rows=100)
    assert [r.k for r in found.collect()] == list(range(200, 300))
    assert "k#" in found._jdf.queryExecution().optimizedPlan().toString() and "<" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.k for r in page(frame, "k", 0, 5, top_rows=1).collect()] == [None, None, None, 3, 4]


def test_pages(spark):
    for rows, kind in (([(i * 3, i) for i in range(5000)], "bigint"), ([(f"k{i:05d}", i) for i in range(5000)], "string")):
        frame = spark.createDataFrame(rows, f"hash {kind}, n int")
        for number in (0, 7, 33, 49, 50):
            expected = rows[number * 100 : number * 100 + 100]
            assert [tuple(r) for r in page(frame, "hash", number, 100).collect()] == expected
            assert [tuple(r) for r in page(frame, "hash", number, 100, top_rows=150).collect()] == expected
        assert [r.n for r in page_after(frame, "hash", rows[41][0], 3).collect()] == [42, 43, 44]
        assert tuple(page_count(frame, 300).head()) == (5000, 17)


def test_classes(spark):
    frame = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "hash string, digest string")
    assert rows_of(equivalence_classes(frame)) == [("x", 2, "a"), ("y", 1, "c")]
    members = class_members(frame).select("hash", "digest", "n", "representative")
    assert rows_of(members) == [("a", "x", 2, "a"), ("b", "x", 2, "a"), ("c", "y", 1, "c")]


def test_profiles(spark, frame):
    entities = frame([("a", "5"), ("b", "zz"), ("c", None)], "hash string, s string")
    tags = frame([("a", "1"), ("a", "x"), ("b", "y")])
    namespace = Namespace([Database.of("cnf_p", entities, {"tag": tags}, {"s": "empty"})])
    assert rows_of(feature_profile(namespace, "s", joined_strings=True)) == [("s", "empty", 3, "5", "zz", 2, "empty zz")]
    assert rows_of(feature_profile(namespace, "tag")) == [("tag", None, 4, "1", "y", 3)]
    assert [r.value for r in feature_strings(namespace, "tag").collect()] == ["None", "x", "y"]
    exact = {r.feature: (r.table, r.cardinality, r.n_set, r.n_distinct) for r in catalogue_profile(namespace, True).collect()}
    assert exact == {"s": ("features", "1:1", 3, 3), "tag": ("tag", "1:n", 2, 3)}
    shares = {r.feature: round(r.unset_share, 3) for r in catalogue_profile(namespace).collect()}
    assert shares == {"s": 0.0, "tag": 0.333}


def test_lookup(spark, frame):
    pairs = {"local": frame([("a", "/2"), ("a", "/1")]), "filename": frame([("a", "2"), ("a", "1"), ("b", "3")])}
    found = lookup_entity(Namespace([Database.of("cnf_f", None, pairs)]), ["a"])
    assert rows_of(found) == [("a", "/1", "1")]


def test_extractors_declare_their_features(spark, frame, tmp_path):
    """The table function's columns follow from the extractor named; no session setting changes."""
    import gzip

    def sizes(path, content):
        if path == "/late":
            raise TimeoutError
        if path == "/odd":
            return [("size", "no number")]
        return [("size", 1), ("size", len(content)), ("part", "x"), ("part", "y"), ("other", 5)]

    def longest_block(path, blocks):
        return [("blocks", sum(1 for _ in blocks))]

    before = {row.key: row.value for row in spark.sql("SET").collect()}
    one = jobs.Extractor("sizes", sizes, (("size", "bigint", 0), ("part", "string", None), ("unset", "double", 1.5)))
    two = jobs.Extractor("blocks", longest_block, (("blocks", "int", 0),), streams=True)
    jobs.register_extractors(spark, [one, two])
    rows = [("a", "/a", bytearray(b"abc")), ("b", "/late", bytearray(b"")), ("c", "/odd", bytearray(b""))]
    frame(rows, "hash string, path string, content binary").createOrReplaceTempView("instances")
    made = spark.sql("SELECT i.hash, x.* FROM instances i, LATERAL extract_features('sizes', path, content) x")
    assert made.dtypes == [("hash", "string"), ("status", "string"), ("size", "bigint"), ("part", "array<string>"), ("unset", "double")]
    assert rows_of(made) == [("a", "success", 3, ["x", "y"], None), ("b", "timeout", None, None, None), ("c", "failure", None, None, None)]
    stored = jobs.store_extracted(Database.of("cnf_x", frame([("a",), ("b",)], "hash string")), made, one, ["cnf"])
    found = rows_of(select(Namespace([stored]), resolve=["size", "part", "unset"]))
    assert found == [("a", "3", "x,y", "1.5"), ("b", "0", "None", "1.5")]
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"1" * (20 << 20)))
    frame([("a", str(tmp_path / "x.gz"))], "hash string, path string").createOrReplaceTempView("paths")
    made = spark.sql("SELECT x.* FROM paths, LATERAL extract_features('blocks', path, NULL) x")
    assert rows_of(made) == [("success", 3)]
    with pytest.raises(Exception, match="must name an extractor"):
        spark.sql("SELECT x.* FROM paths, LATERAL extract_features('unknown', path, NULL) x").collect()
    after = {row.key: row.value for row in spark.sql("SET").collect()}
    assert {k: v for k, v in after.items() if "checkpoint" not in k} == {k: v for k, v in before.items() if "checkpoint" not in k}


def test_latest_values_survive_a_restart(spark, tmp_path):
    """Late triples are held against the state of the run before; idle keys are forgotten by a timer of event time."""
    schema = "hash string, feature string, value string, time timestamp, tie long"
    seen = []

    def deliver(number, rows):
        made = [(h, f, v, datetime(2024, 1, 1) + timedelta(minutes=m), t) for h, f, v, m, t in rows]
        frame = spark.createDataFrame(made, schema).coalesce(1)
        frame.write.parquet(str(tmp_path / "in" / str(number)))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        query = latest.land_latest(
            stream, str(tmp_path / "landed"), str(tmp_path / "state"), "30 minutes", pd.Timedelta(minutes=60), many=["tag"]
        )
        query.awaitTermination()
        landed = [tuple(r)[:3] for r in upsert.landed(spark, str(tmp_path / "landed")).collect()]
        new = sorted(set(landed) - set(seen))
        seen.extend(new)
        return new

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    first = deliver(0, [("a", "s", "2", 20, 1), ("a", "s", "1", 10, 9), ("b", "s", "x", 25, 1), ("a", "tag", "p", 5, 1)])
    assert first == [("a", "s", "2"), ("a", "tag", "p"), ("b", "s", "x")]
    # earlier than what the first run saw: a and the pair p; b's same time goes by the tie
    second = deliver(1, [("a", "s", "0", 15, 1), ("b", "s", "y", 25, 2), ("a", "tag", "p", 4, 1), ("a", "tag", "q", 4, 1)])
    assert second == [("a", "tag", "q"), ("b", "s", "y")]
    # the watermark goes far on: keys idle for an hour are forgotten in the batch after
    assert deliver(2, [("c", "s", "z", 500, 1)]) == [("c", "s", "z")]
    deliver(3, [("c", "s", "w", 510, 1)])
    assert deliver(4, [("a", "s", "new", 490, 0)]) == [("a", "s", "new")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    last = upsert.landed(spark, str(tmp_path / "landed")).groupBy("hash", "feature")
    rows = rows_of(last.agg(F.max_by("value", F.struct("time", "tie")).alias("v")).where("feature = 's'"))
    assert rows == [("a", "s", "new"), ("b", "s", "y"), ("c", "s", "w")]


def test_latest_values_of_many_keys_share_calls_into_the_state(spark, tmp_path):
    """Keys are dealt to shards; null hashes and values, missing ties and large numbers come through as they are."""
    big = (1 << 53) + 1
    at = [datetime(2024, 1, 1) + timedelta(minutes=m) for m in range(3)]
    rows = [(big + i, "s", big + i, at[1], big + i) for i in range(300)] + [(big + i, "s", -1, at[0], big) for i in range(300)]
    rows += [(None, "s", big, at[1], 1), (None, "s", 5, at[1], None), (7, "s", 6, at[0], 9), (7, "s", None, at[2], 0)]
    schema = "hash long, feature string, value long, time timestamp, tie long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    places = (str(tmp_path / "landed"), str(tmp_path / "state"))
    query = latest.land_latest(stream, *places, "1 hour", pd.Timedelta(days=1), shards=4)
    query.awaitTermination()
    held = [operator["numRowsTotal"] for progress in query.recentProgress for operator in progress["stateOperators"]]
    assert 0 < max(held) <= 8 * 4
    found = {(r["hash"], r["value"], r["tie"]) for r in upsert.landed(spark, places[0]).collect()}
    assert found == {(big + i, big + i, big + i) for i in range(300)} | {(None, big, 1), (7, None, 0)}
