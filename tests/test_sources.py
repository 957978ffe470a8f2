"""Sources, sinks and saved databases."""

import bz2
import gzip
import lzma

import pytest
from conftest import hashes_of, rows_of
from pyspark.sql import functions as F

from hashloom import Database, Namespace, feature, select
from hashloom.functions.text import Contexts
from hashloom.operators import jobs, paging, skew, writes
from hashloom.plans.namespace import FeatureError
from hashloom.sources import delimited, files, sinks, sketches, tables


@pytest.fixture
def database(frame):
    entities = frame([("a", "x", 1), ("b", None, 2), ("c", "y", None)], "hash string, s string, n int")
    pairs = frame([("a", "1"), ("a", "2"), ("b", "1")])
    return Database.of("test", entities, {"tag": pairs}, {"s": "empty", "n": 0})


def test_save_and_open(spark, database, tmp_path):
    path = str(tmp_path / "db")
    saved = tables.save_database(database, path)
    again = tables.open_database(spark, path)
    assert rows_of(select(Namespace([again]), resolve=["s", "n", "tag"])) == [
        ("a", "x", "1", "1,2"),
        ("b", "empty", "2", "1"),
        ("c", "y", "0", "None"),
    ]
    assert again.defaults == {"s": "empty", "n": 0}
    assert saved.files == again.files


def test_versions(spark, database, frame, tmp_path):
    """Unchanged tables keep their files, inserted pairs are added next to the stored ones, and an
    older version can still be read by those who opened it."""
    path = str(tmp_path / "db")
    first = tables.save_database(database, path)
    changed = writes.set_values(first, "tag", frame([("a", "2"), ("c", "3"), ("d", "4")]))
    second = tables.save_database(changed, path)
    (_, old), (_, new) = first.files["tag"], second.files["tag"]
    assert new[: len(old)] == old and len(new) == len(old) + 1
    assert rows_of(spark.read.parquet(f"{path}/{new[-1]}")) == [("c", "3"), ("d", "4")]
    assert rows_of(second.many["tag"].pairs()) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "3"), ("d", "4")]
    (_, old), (_, new) = first.files["features"], second.files["features"]
    assert new[: len(old)] == old and hashes_of(spark.read.parquet(f"{path}/{new[-1]}")) == ["d"]
    assert hashes_of(second.entities) == ["a", "b", "c", "d"]
    third = tables.save_database(writes.reset_values(second, "s", ["x"]), path)
    assert third.files["tag"] == second.files["tag"] and third.files["features"] != second.files["features"]
    assert rows_of(first.many["tag"].pairs()) == [("a", "1"), ("a", "2"), ("b", "1")]
    fourth = tables.save_database(writes.reset_values(third, "tag", ["1"]), path)
    assert rows_of(fourth.many["tag"].pairs()) == [("a", "2"), ("c", "3"), ("d", "4")]
    assert tables.read_log(spark, path).agg(F.max("version")).head()[0] == 4


def test_plain_then_bucketed(spark, database, frame, tmp_path):
    """No row is lost when a table of several parts is bucketed, or bucketed anew."""
    path = str(tmp_path / "db")
    first = tables.save_database(database, path)
    second = tables.save_database(writes.set_values(first, "tag", frame([("c", "3")])), path)
    expected = rows_of(second.many["tag"].pairs())
    assert len(expected) == 4
    for buckets in (4, 8, 0):
        second = tables.save_database(second, path, buckets=buckets)
        assert rows_of(second.many["tag"].pairs()) == expected and hashes_of(second.entities) == ["a", "b", "c"]
        rows = rows_of(select(Namespace([second]), resolve=["n", "tag"]))
        assert rows == [("a", "1", "1,2"), ("b", "2", "1"), ("c", "0", "3")]


def test_stale_and_concurrent_writers(spark, database, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    tables.save_database(database, path)
    one, two = tables.open_database(spark, path), tables.open_database(spark, path)
    tables.save_database(writes.set_values(one, "tag", frame([("c", "3")])), path)
    with pytest.raises(tables.StaleHandleError):
        tables.save_database(writes.set_values(two, "tag", frame([("c", "4")])), path)
    with pytest.raises(tables.StaleHandleError):  # deleting entities keeps the base version, too
        tables.save_database(writes.delete_entities(two, two.entities.where("hash = 'a'")), path)
    # both writers see the same newest version: the second finds the file of the next one taken
    late = tables.open_database(spark, path)
    seen = tables._newest(spark, path)
    tables.save_database(writes.set_values(late, "tag", frame([("a", "5")])), path)
    monkeypatch.setattr(tables, "_newest", lambda *_: seen)
    with pytest.raises(tables.StaleHandleError):
        tables.save_database(writes.set_values(late, "tag", frame([("a", "6")])), path)
    monkeypatch.undo()
    pairs = rows_of(tables.open_database(spark, path).many["tag"].pairs())
    assert pairs == [("a", "1"), ("a", "2"), ("a", "5"), ("b", "1"), ("c", "3")]


def test_a_dead_writer_does_not_lock_the_database(spark, database, frame, tmp_path, monkeypatch):
    """Commit files that were created and never finished are passed over; the next version is saved and found."""
    monkeypatch.setattr(tables, "WAIT_SECONDS", 0.2)
    path = str(tmp_path / "db")
    first = tables.save_database(database, path)
    for number, line in ((2, ""), (3, "log/v00000003-cut off")):
        (tmp_path / "db" / "commits" / f"{number:010d}").write_text(line)
    fresh = tables.open_database(spark, path)
    assert rows_of(fresh.entities) == rows_of(first.entities)
    second = tables.save_database(writes.set_values(fresh, "tag", frame([("c", "3")])), path)
    assert second.files[""] == (path, 4) and len(rows_of(second.many["tag"].pairs())) == 4
    with pytest.raises(tables.StaleHandleError):
        tables.save_database(writes.set_values(first, "tag", frame([("c", "4")])), path)
    for number in range(5, 20):  # more dead writers than are looked at first
        (tmp_path / "db" / "commits" / f"{number:010d}").write_text("")
    third = tables.save_database(writes.set_values(second, "tag", frame([("c", "5")])), path)
    assert third.files[""] == (path, 20) and tables.read_log(spark, path).select("version").distinct().count() == 3


def test_a_late_writer_and_the_one_that_passed_it_over(spark, database, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "WAIT_SECONDS", 0.2)
    path = str(tmp_path / "db")
    tables.save_database(database, path)
    # the writer of version 2 finishes before version 3 writes its line: version 3 is refused
    late = tmp_path / "db" / "commits" / f"{2:010d}"
    late.write_text("")
    assert tables._next_version(spark, path, 1) == (3, (2,))
    late.write_text("log/late\n")
    with pytest.raises(tables.StaleHandleError, match="came in before"):
        tables._commit(spark, path, 3, "log/three", (2,))
    # the unfinished file that this left doesn't refuse the late one, a finished version 4 does
    assert not tables._settled(spark, path, [3])
    tables._commit(spark, path, 4, "log/four", (3,))
    assert tables._settled(spark, path, [3, 4])
    with pytest.raises(tables.StaleHandleError, match="another writer"):
        tables._commit(spark, path, 4, "log/again")
    (tmp_path / "db" / "commits" / f"{6:010d}").write_text("log/six\n")
    with pytest.raises(tables.StaleHandleError, match="too late"):
        tables._commit(spark, path, 5, "log/five")


def test_other_errors_are_not_called_stale(spark, tmp_path):
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception) as caught:
        tables._commit(spark, str(tmp_path / "file"), 1, "log/x")
    assert not isinstance(caught.value, tables.StaleHandleError)


def test_same_write_twice(spark, database, frame, tmp_path):
    path = str(tmp_path / "db")
    current = tables.save_database(database, path)
    states = []
    for _ in range(2):
        current = writes.set_values(current, "tag", frame([("c", "9")]))
        current = writes.set_values(current, "s", frame([("c", "z"), ("e", "new")]))
        current = tables.save_database(current, path)
        states.append((rows_of(current.entities), rows_of(current.many["tag"].pairs())))
    assert states[0] == states[1]


def _in_ranges(spark, path):
    entities = spark.range(2000).select(F.col("id").cast("string").alias("hash"), F.lit("x").alias("s"), F.lit(1).alias("n"))
    database = Database.of("test", entities, {"tag": spark.createDataFrame([("1", "v")], "hash string, value string")}, {"s": "empty", "n": 0})
    return tables.save_database(database, path, ranges=100)


def test_a_small_update_leaves_the_files_of_other_ranges(spark, frame, tmp_path):
    path = str(tmp_path / "db")
    first = _in_ranges(spark, path)
    assert len(first.files["features"][1]) == 100 and first.entities.count() == 2000
    assert "__range" not in first.entities.columns
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "db" / "data").rglob("*.parquet")}
    changed = writes.set_values(first, "s", frame([(str(h), "new") for h in (*range(9), "unknown")]))
    second = tables.save_database(changed, path)
    kept = set(first.files["features"][1]) & set(second.files["features"][1])
    assert 90 <= len(kept) < 100 and len(second.files["features"][1]) == 100
    assert all(f.stat().st_mtime_ns == time for f, time in before.items())
    written = spark.read.parquet(*[f"{path}/{part}" for part in set(second.files["features"][1]) - kept])
    assert written.count() < 400
    assert rows_of(second.entities.where("s = 'new'")) == sorted([(str(h), "new", 1) for h in range(9)] + [("unknown", "new", 0)])
    assert second.entities.count() == 2001 and second.entities.where("s = 'x'").count() == 1991
    assert rows_of(first.entities.where("s = 'new'")) == []


def test_writes_on_ranges_equal_writes_on_frames(spark, frame, tmp_path):
    """Several kinds of writes between two saves; ranges get new entities, lose all, and the table loses all."""
    path = str(tmp_path / "db")
    stored = _in_ranges(spark, path)
    plain = Database.of("test", stored.entities, {k: v.pairs() for k, v in stored.many.items()}, stored.defaults)

    def change(database):
        database = writes.set_values(database, "s", frame([("5", "five"), ("new", "n"), ("6", "six")]))
        database = writes.set_values(database, "tag", frame([("7", "v"), ("other", "w")]))
        database = writes.reset_values(database, "s", ["six"])
        database = writes.reset_values(database, "n", None, ["5", "8"])
        return writes.delete_entities(database, frame([("9", ""), ("other", "")]))

    second = tables.save_database(change(stored), path)
    want = change(plain)
    assert rows_of(second.entities) == rows_of(want.entities)
    assert rows_of(second.many["tag"].pairs()) == rows_of(want.many["tag"].pairs())
    assert len(set(stored.files["features"][1]) & set(second.files["features"][1])) > 85
    unchanged = tables.save_database(second, path)
    assert unchanged.files["features"] == second.files["features"]
    second = unchanged
    with_column = tables.save_database(writes.add_feature(second, "extra", "e"), path)
    assert with_column.entities.where("extra = 'e'").count() == second.entities.count()
    empty = tables.save_database(writes.delete_entities(with_column, with_column.entities.select("hash")), path)
    assert rows_of(empty.entities) == [] and empty.entities.columns == with_column.entities.columns
    again = tables.save_database(writes.set_values(empty, "s", frame([("5", "back")])), path)
    assert rows_of(again.entities) == [("5", "back", 0, "e")]
    unranged = tables.save_database(again, path, ranges=0)
    assert rows_of(unranged.entities) == rows_of(again.entities) and len(unranged.files["features"][1]) == 1
    with pytest.raises(FeatureError):
        tables.save_database(unranged, path, buckets=2, ranges=2)


def test_stored_pages_read_one_range_and_write_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "db")
    keys = [f"{k:05d}" for k in range(5000)]
    entities = spark.createDataFrame([(k, None if k < "02500" else "x") for k in reversed(keys)], "hash string, s string")
    saved = tables.save_database(Database.of("test", entities, defaults={"s": "empty"}), path)
    with pytest.raises(FeatureError):
        tables.entity_page(saved, 0)
    tables.store_entity_pages(saved, range_rows=500)
    fences = spark.read.parquet(f"{path}/pages/v00000001/fences").orderBy("before").collect()
    assert 5 <= len(fences) <= 10 and sum(f.rows for f in fences) == 5000
    assert all(a.high < b.low and a.before + a.rows == b.before for a, b in zip(fences, fences[1:]))
    before = sorted(tmp_path.rglob("*"))
    for number in (0, 1, 137, 249):
        page = tables.entity_page(saved, number, 20)
        wanted = keys[number * 20 : number * 20 + 20]
        assert [tuple(r) for r in page.collect()] == [(k, "empty" if k < "02500" else "x") for k in wanted]
        assert len(page.inputFiles()) <= 2
    assert tables.entity_page(saved, 250, 20).collect() == []
    assert sorted(tmp_path.rglob("*")) == before
    # pages belong to a version, and to what was saved
    changed = writes.set_values(saved, "s", frame([("00000", "y")]))
    for other in (changed, tables.save_database(changed, path)):
        with pytest.raises(FeatureError):
            tables.entity_page(other, 0)


def test_stored_pages_of_few_rows_and_null_keys(spark, frame, tmp_path):
    for name, rows in (("none", []), ("some", [("b", "2"), (None, "0"), ("a", "1")])):
        paging.store_pages(frame(rows), "hash", str(tmp_path / name), range_rows=2)
        found = paging.stored_page(spark, str(tmp_path / name), "hash", 0, 10)
        assert [r["value"] for r in found.collect()] == sorted(v for _, v in rows)


@pytest.mark.parametrize("ranges", [0, 8])
def test_sketches_of_new_parts_only(spark, frame, tmp_path, monkeypatch, ranges):
    path = str(tmp_path / "db")
    entities = spark.range(20000).select(
        F.col("id").cast("string").alias("hash"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), F.col("id") % 5000)).alias("s"),
        F.col("id").cast("double").alias("x"),
        F.lit(None).cast("string").alias("never"),
    )
    pairs = spark.range(30000).select((F.col("id") % 3000).cast("string").alias("hash"), (F.col("id") % 700).alias("value"))
    database = Database.of("test", entities, {"tag": pairs.distinct()}, {"x": 0.0})
    saved = tables.save_database(database, path, ranges=ranges)
    read, summarise = [], sketches.summarise
    monkeypatch.setattr(sketches, "summarise", lambda d, t, parts: read.extend(parts) or summarise(d, t, parts))

    def profile(database):
        return {r.feature: r for r in sketches.sketch_profile(database).collect()}

    def near(found, exact):
        # four standard errors, and small counts are exact
        return abs(found - exact) <= 4 * 1.04 / 2**7 * exact

    def check(found, n_tags, n_tag_values, n_owners):
        assert set(found) == {"s", "x", "tag"}
        assert found["s"].n_values == found["s"].n_set == 10000 and near(found["s"].n_distinct, 2500)
        assert found["tag"].n_values == n_tags
        assert near(found["tag"].n_distinct, n_tag_values) and near(found["tag"].n_set, n_owners)
        assert found["s"].quantiles is None
        assert all(abs(a - b) < 800 for a, b in zip(found["x"].quantiles, (5000, 10000, 15000)))

    n_tags = saved.many["tag"].pairs().count()
    check(profile(saved), n_tags, 700, 3000)
    assert sorted(read) == sorted([*saved.files["features"][1], *saved.files["tag"][1]])
    read.clear()
    check(profile(saved), n_tags, 700, 3000)
    assert read == []
    new = spark.range(3000, 4000).select(F.col("id").cast("string").alias("hash"), (F.col("id") + 10000).alias("value"))
    second = tables.save_database(writes.set_values(saved, "tag", new), path)
    check(profile(second), n_tags + 1000, 1700, 4000)
    new_parts = [part for t in ("tag", "features") for part in second.files[t][1] if part not in saved.files[t][1]]
    assert sorted(read) == sorted(new_parts) and second.files["tag"][1][-1] in read and len(second.files["tag"][1]) == 2
    with pytest.raises(FeatureError):
        sketches.sketch_profile(writes.set_values(second, "tag", new.withColumn("value", F.lit(1))))


def test_buckets_need_no_shuffle(spark, database, frame, tmp_path):
    path = str(tmp_path / "db")
    saved = tables.save_database(database, path, buckets=4)
    spark.sql(f"DROP TABLE hashloom_{saved.files['tag'][1][0].replace('/', '_').replace('-', '_')}")
    opened = Namespace([tables.open_database(spark, path)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = select(opened, feature("tag") != "9", ["tag", "s"])
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert rows_of(result) == [("a", "1,2", "x"), ("b", "1", "empty"), ("c", "None", "y")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    changed = writes.set_values(opened.first, "tag", frame([("c", "3")]))
    again = tables.save_database(changed, path, buckets=4)
    assert rows_of(again.many["tag"].pairs()) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "3")]


def test_hot_keys_are_recorded(spark, database, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    saved = tables.save_database(database, str(tmp_path / "db"))
    assert saved.many["tag"].hot == {"hash": [["a", 2]], "value": [["1", 2]]}
    assert rows_of(saved.many["tag"].hot_keys("hash")) == [("a", 2)]
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    assert saved.many["tag"].hot_keys("hash") is None


def test_an_append_counts_hot_keys_of_the_new_part_only(spark, database, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    path, counted = str(tmp_path / "db"), []
    count = skew.key_counts

    def noted(rows, keys, least):
        counted.append(sorted({f.rsplit("/", 2)[1] + f.rsplit("/", 3)[1] for f in rows.inputFiles()}))
        return count(rows, keys, least)

    monkeypatch.setattr(skew, "key_counts", noted)
    first = tables.save_database(database, path)
    assert first.many["tag"].hot == {"hash": [], "value": []} and len(counted) == 1
    second = tables.save_database(writes.set_values(first, "tag", frame([("a", "3"), ("d", "1"), ("e", "1")])), path)
    assert len(counted) == 2 and not set(counted[0]) & set(counted[1])
    # two rows in each part are not hot, three or four of both together are
    hot = {side: sorted(keys) for side, keys in second.many["tag"].hot.items()}
    assert hot == {"hash": [["a", 3]], "value": [["1", 4]]}
    plain = second.many["tag"].pairs().groupBy("value").count().where("count > 2")
    assert rows_of(plain) == [("1", 4)]


def test_export_and_views(spark, database, tmp_path):
    saved = tables.save_database(database, str(tmp_path / "db"))
    copy = tables.export_database(saved, str(tmp_path / "copy"))
    assert rows_of(copy.entities) == rows_of(database.entities)
    names = tables.create_views(tables.open_databases(spark, [str(tmp_path / "copy")]))
    assert names == ["test__features", "test__tag"]
    assert spark.sql("SELECT count(*) AS n FROM test__tag").head().n == 3
    with pytest.raises(FeatureError):
        tables.open_database(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("delimiter", delimited.DELIMITERS)
def test_csv(spark, tmp_path, delimiter):
    path = tmp_path / "cnf_table.csv"
    lines = [["hash", "a-b", "n"], ["x", "one", "1"], ["y", "two", "22"]]
    path.write_text("".join(delimiter.join(line) + "\n" for line in lines))
    assert delimited.sniff_delimiter(spark, str(path)) == delimiter
    (database,) = delimited.open_csv(spark, [str(path)])
    assert (database.name, database.context) == ("cnf_table", "cnf")
    namespace = Namespace([database])
    assert rows_of(select(namespace, feature("n") > 3, ["a_b"])) == [("y", "two")]


def test_csv_merge(spark, tmp_path):
    for folder, body in (("1", "hash,a\nx,1\ny,2\n"), ("2", "hash,b,a\ny,3,9\nz,4,8\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text(body)
    paths = [str(tmp_path / f / "t.csv") for f in "12"]
    (single,) = delimited.open_csv(spark, paths)
    merged = select(Namespace([single]), resolve=["a", "b"])
    assert rows_of(merged) == [("x", "1", None), ("y", "2", "3"), ("z", "8", "4")]
    (many,) = delimited.open_csv(spark, paths, many=True)
    values = select(Namespace([many]), resolve=["a", "b"])
    assert rows_of(values) == [("x", "1", "None"), ("y", "2,9", "3"), ("z", "8", "4")]
    (tmp_path / "bad.csv").write_text("id,a\n1,2\n")
    with pytest.raises(FeatureError):
        delimited.open_csv(spark, [str(tmp_path / "bad.csv")])


def test_lines(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a b\n\n c\td \n")
    assert hashes_of(delimited.read_id_list(spark, str(tmp_path / "ids.txt"))) == ["a", "b", "c", "d"]
    (tmp_path / "tool.txt").write_text("alpha 42\r\nbeta 7 and more \n\n  gamma\nalpha 43\n")
    found = delimited.read_tool_lines(spark, str(tmp_path / "tool.txt")).select("feature", "value")
    assert rows_of(found) == [("alpha", "43"), ("beta", "7 and more"), ("gamma", "")]


def test_instances(spark, tmp_path):
    content = b"p cnf 2 1\n1 -2 0\n"
    (tmp_path / "deep").mkdir()
    writers = {"x.cnf": content, "deep/y.cnf.gz": gzip.compress(content), "z.cnf.bz2": bz2.compress(content)}
    writers |= {"w.cnf.xz": lzma.compress(content), "other.txt": b"1 0"}
    for name, data in writers.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan_instances(spark, str(tmp_path), "cnf")
    database = jobs.register_files(Database.empty(spark, "cnf_local"), found)
    namespace = Namespace([database])
    (row,) = select(namespace, resolve=["filename", "local"]).collect()
    assert row.filename == "w.cnf.xz,x.cnf,y.cnf.gz,z.cnf.bz2"
    assert len(row.hash) == 32 and f"{tmp_path}/x.cnf" in row.local.split(",")
    # registered again: nothing new; files gone: only their paths go
    assert jobs.new_paths(found, database.many["local"].pairs()).count() == 0
    left = jobs.remove_stale(database, found.where(F.col("path").endswith(".cnf")))
    assert [r.value for r in left.many["local"].pairs().collect()] == [f"{tmp_path}/x.cnf"]


def test_long_files_are_listed_apart(spark, tmp_path, monkeypatch):
    for name, size in (("a.cnf", 3), ("b.cnf", 30), ("c.cnf.gz", 40), ("d.txt", 50)):
        (tmp_path / name).write_bytes(b"1" * size)
    monkeypatch.setattr(files, "LONGEST", 10)
    names = [[r.path.rsplit("/", 1)[1] for r in scan(spark, str(tmp_path), "cnf").select("path").collect()]
             for scan in (files.scan_instances, files.oversized_instances)]
    assert names[0] == ["a.cnf"] and sorted(names[1]) == ["b.cnf", "c.cnf.gz"]


def test_packed_files_that_unpack_too_long_are_listed(spark, tmp_path, monkeypatch):
    """An expanding file has no content and is in the list of long ones; the others are read."""
    (tmp_path / "small.cnf.gz").write_bytes(gzip.compress(b"1 0"))
    (tmp_path / "large.cnf.xz").write_bytes(lzma.compress(b"1 0 " * 100_000))
    monkeypatch.setattr(files, "LONGEST", 1_000)
    found = {r.path.rsplit("/", 1)[1]: r.content for r in files.scan_instances(spark, str(tmp_path), "cnf").collect()}
    assert found == {"small.cnf.gz": b"1 0", "large.cnf.xz": None}
    (long,) = files.oversized_instances(spark, str(tmp_path), "cnf").collect()
    assert long.path.endswith("large.cnf.xz")
    digests = files.instance_digests(spark, str(tmp_path), "cnf", block=999)
    rows = {r.path.rsplit("/", 1)[1]: (r.bytes, r.clauses, r.variables, r.error) for r in digests.collect()}
    assert rows == {"small.cnf.gz": (3, 1, 1, None), "large.cnf.xz": (400_000, 100_000, 1, None)}


def test_digests_of_blocks_equal_those_of_contents(spark, frame, tmp_path):
    """Files of all kinds in blocks of all sizes have the digest and counts of the expressions."""
    import random

    from hashloom.functions.digest import base_features, content_digest

    rng = random.Random(7)
    bodies = [bytes(rng.choices(b"0012-9 \t\n\r\x00cp\xc3.", k=size)) for size in (0, 1, 2, 50, 300, 5_000)]
    bodies += [b"c only a comment", b"1 2 0", b"-" + b"0" * 200_000 + b"42 7", b"5" * 200_000 + b" 0"]
    pack = {"": bytes, ".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress}
    for k, body in enumerate(bodies):
        for ending, function in pack.items():
            (tmp_path / f"{k}.cnf{ending}").write_bytes(function(body))
    (tmp_path / "broken.cnf.gz").write_bytes(b"no gzip")
    (tmp_path / ".hidden.cnf").write_bytes(b"1 0")
    content = frame([(str(k), bytearray(body)) for k, body in enumerate(bodies)], "k string, content binary")
    counts = base_features(F.col("content"))
    wanted = content.select("k", content_digest(F.col("content")).alias("hash"), counts["clauses"].alias("c"), counts["variables"].alias("v"))
    want = {r.k: (r.hash, r.c, r.v) for r in wanted.collect()}
    for block in (1, 7, 1 << 20):
        rows = files.instance_digests(spark, str(tmp_path), "cnf", block=block, task=2_000).collect()
        bad = [r for r in rows if r.error]
        assert len(rows) == 4 * len(bodies) + 1 and [r.path.rsplit("/", 1)[1] for r in bad] == ["broken.cnf.gz"]
        for r in rows:
            name = r.path.rsplit("/", 1)[1].split(".")[0]
            assert r in bad or (r.hash, r.clauses, r.variables) == want[name] and r.bytes == len(bodies[int(name)])
    database = jobs.register_files(Database.empty(spark, "cnf_local"), rows_frame(spark, rows), F.col("hash"))
    assert len(rows_of(database.many["local"].pairs())) == 4 * len(bodies)


def rows_frame(spark, rows):
    return spark.createDataFrame([(r.path, r.hash) for r in rows], "path string, hash string")


def test_blocks_bound_the_memory_of_a_digest(tmp_path):
    """A packed file of 64 MB is digested within a few blocks of memory."""
    import tracemalloc

    from hashloom.functions.tokens import TokenDigest
    from hashloom.sources import streamed

    (tmp_path / "x.cnf.xz").write_bytes(lzma.compress(b"1 -2 3 0\nc comment\n" * 3_400_000, preset=0))
    system, path = streamed.store(str(tmp_path / "x.cnf.xz"))
    digest = TokenDigest()
    tracemalloc.start()
    for block in streamed.blocks(system, path, 1 << 16):
        digest.update(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert digest.bytes > 60 << 20 and digest.clauses == 3_400_000 and peak < 4 << 20


def test_one_split_and_many_read_the_same_lines(spark, tmp_path):
    import random

    rng = random.Random(2)
    ends = ["\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\n\n"]
    text = "".join(f"f{rng.randrange(9)} {'v€' * rng.randrange(9)}{rng.choice(ends)}" for _ in range(800)) + "last line"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(text.encode())
    (tmp_path / "a" / "y.txt").write_bytes(b"\xff\xfe broken\n")
    (tmp_path / "a" / "empty.txt").write_bytes(b"")
    found = [
        rows_of(delimited.read_tool_lines(spark, str(tmp_path / "a"), split=split, block=block))
        for split, block in ((1 << 20, 1 << 20), (64, 1 << 20), (501, 7))
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 11
    assert dict((f, v) for p, f, v in found[0] if p.endswith("x.txt"))["last"] == "line"


def test_tables_are_found(spark, frame, tmp_path):
    frame([("a", "1")]).write.parquet(str(tmp_path / "db" / "tag"))
    frame([("a", "1")]).write.parquet(str(tmp_path / "db" / "_hidden"))
    frame([("a", "x")], "hash string, s string").write.parquet(str(tmp_path / "db" / "features"))
    found = tables.scan_feature_tables(spark, str(tmp_path / "db"))
    assert sorted(found.features) == ["hash", "s", "tag"]


def test_identity_depends_on_context(spark, frame):
    listed = frame([("/x/a.opb", bytearray(b"x"))], "path string, content binary")
    empty = Database.empty(spark, "opb_local")
    with pytest.raises(FeatureError):
        jobs.register_files(empty, listed)
    stored = jobs.register_files(empty, listed, F.md5("content"))
    assert rows_of(stored.many["local"].pairs()) == [("9dd4e461268c8034f5c8564e155c67a6", "/x/a.opb")]


def test_insert_reads_stored_pairs_without_shuffle(spark, frame, tmp_path):
    """The stored side meets the broadcast hashes of the new rows before anything else."""
    pairs = spark.range(100_000).select(F.col("id").cast("string").alias("hash"), F.lit("1").alias("value"))
    saved = tables.save_database(Database.of("test", many={"tag": pairs}), str(tmp_path / "db"))
    frame([("5", "1"), ("5", "2"), ("new", "3")]).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        changed = writes.set_values(saved, "tag", spark.read.parquet(str(tmp_path / "rows")))
        for added in (changed.added["tag"], changed.added["features"]):
            plan = added._jdf.queryExecution().executedPlan().toString().splitlines()
            at = next(i for i, line in enumerate(plan) if "BroadcastHashJoin" in line and "LeftSemi" in line)
            scan = next(i for i, line in enumerate(plan) if i > at and "FileScan" in line)
            assert not any("Exchange" in line for line in plan[at:scan])
        assert rows_of(changed.added["tag"]) == [("5", "2"), ("new", "3")]
        assert hashes_of(changed.added["features"]) == ["new"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_of_any_length(frame):
    """A list of 1,001 texts for a number feature selects as one of 1,000 does."""
    entities = frame([(1, 1), (2, 2)], "hash bigint, n int")
    database = Database.of("test", entities, {"tag": frame([(1, 1), (2, 2)], "hash bigint, value int")}, {"n": 0})
    for size in (1_000, 1_001):
        listed = ["2", *map(str, range(10_000, 10_000 + size - 1))]
        assert rows_of(writes.reset_values(database, "n", listed).entities) == [(1, 1), (2, 0)]
        assert rows_of(writes.reset_values(database, "n", hashes=listed).entities) == [(1, 1), (2, 0)]
        assert rows_of(writes.reset_values(database, "tag", listed, listed).many["tag"].pairs()) == [(1, 1)]
        assert hashes_of(select(Namespace([database]), hashes=listed)) == [2]


def test_exports(spark, database, tmp_path):
    result = select(Namespace([database]), resolve=["n", "tag"], collapse=None).withColumn("gone", F.lit(None).cast("string"))
    sinks.export_delimited(result, str(tmp_path / "out"), ";", header=True)
    lines = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert lines == {"hash;n;tag;gone", "a;1;1;[None]", "a;1;2;[None]", "b;2;1;[None]", "c;0;None;[None]"}
    raw = result.where("hash = 'a'").select(F.lit(' "x y" ').alias("quoted"), "gone")
    for header in (False, True):
        sinks.export_delimited(raw, str(tmp_path / f"raw{header}"), header=header)
        written = {r.value for r in spark.read.text(str(tmp_path / f"raw{header}")).collect()}
        assert written == {' "x y"  [None]'} | ({"quoted gone"} if header else set())
    joined = result.select(sinks.delimited_line(result, ";").alias("line"))
    assert {r.line for r in joined.collect()} == lines - {"hash;n;tag;gone"}
    sinks.export_links(result, str(tmp_path / "links"), "http://h/file/", "kis", "cnf")
    links = {r.value for r in spark.read.text(str(tmp_path / "links")).collect()}
    assert links == {f"http://h/file/{h}?context=kis" for h in "abc"}


def test_contexts():
    contexts = Contexts()
    assert contexts.suffixes("kis") == [".kis", ".kis.gz", ".kis.lzma", ".kis.xz", ".kis.bz2"]


def test_scanned_instances_are_read_from_files_of_all_kinds(spark, tmp_path, monkeypatch):
    from collections import Counter

    from hashloom.suite import sources

    folder = str(tmp_path / "instances")
    monkeypatch.setattr(sources, "working_folder", lambda *_: folder)
    listed = sources.scan_instances(spark, "/root/testdata/sf0.001").collect()
    found = files.scan_instances(spark, folder, "doc", sources.CONTEXTS).select("path", "content").collect()
    assert {r.path.partition(".txt")[2] for r in found} == {"", ".gz", ".bz2", ".xz"}
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    lines = Counter(line for r in found for line in bytes(r.content).split(b"\n")[:-1])
    assert lines == Counter(line for text in texts for line in text.encode().split(b"\n"))
    assert sum(r.bytes for r in listed) == sum(len(r.content) for r in found)


def test_hot_keys_of_a_saved_table_are_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    """Only what is left of the counts goes through one task."""
    counts = tables.skew.key_counts
    monkeypatch.setattr(tables.skew, "key_counts", lambda *a: counts(*a).withColumn("task", F.spark_partition_id()))
    monkeypatch.setattr(tables.skew, "HOT_ROWS", 64)
    pairs = spark.createDataFrame([(str(i % 40), str(i)) for i in range(400)], "hash string, value string")
    pairs.write.parquet(str(tmp_path / "data" / "pairs"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        tables._hot(spark, str(tmp_path), ("data/pairs",))
    finally:
        spark.conf.set(name, before)
    summary = spark.read.parquet(tables._summary(str(tmp_path), "data/pairs"))
    assert summary.count() == 40 and summary.select("task").distinct().count() > 1
    assert len(summary.inputFiles()) == 1
