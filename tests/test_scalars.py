"""Scalar functions against plain models."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hashloom.functions import digest, numbers, text

TEXTS = [
    "1", " 12", "\t7x", "12abc", "-3.5e2z", "+4.", ".5", "-.5", "e5", "1e", "1e+", "None", "", "0x10", "1_000", "007",
    "-0", "4.0", "1e3", "0.00012", "5e-05", "1.5e-07", "0.1", "-0.0005", "123456.789", "inf", "-Infinity", "nan", "12d",
    "1e400", "+5", " 8 ", "1__0", "_1", "1_", "9026252821384e97", "value", "3.25", "-2.50", "1,5", "1e-3", "0.001",
]


def column_of(spark, values, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row.r for row in frame.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def prefix(value):
    found = re.match(r"[ \t\n\v\f\r]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", value)
    return float(found.group(1)) if found else 0.0


def test_num_prefix(spark):
    assert column_of(spark, TEXTS, numbers.num_prefix) == [prefix(t) for t in TEXTS]
    assert column_of(spark, [None], numbers.num_prefix) == [None]


def python_number(value):
    try:
        return float(value)
    except ValueError:
        return None


def test_is_number(spark):
    assert column_of(spark, TEXTS, numbers.is_number) == [python_number(t) is not None for t in TEXTS]
    assert column_of(spark, [None], numbers.is_number) == [False]


def converted(value):
    try:
        return str(int(value))
    except ValueError:
        found = python_number(value)
        if found is None:
            return value
        if found.is_integer():
            return str(int(found)) if abs(found) < 9.2e18 else value
        return str(found)


def test_convert_value(spark):
    texts = [t for t in TEXTS if t != "1e400"] + [f"{random.Random(i).uniform(-2, 2) / 10**i:.{i + 3}f}" for i in range(9)]
    assert column_of(spark, texts, numbers.convert_value) == [converted(t) for t in texts]


def test_display(spark):
    values = ["http://x.org", "12", "+12", "-1.005", "1234567.891", "9026252821384e97", "abc", "", None]
    kinds = column_of(spark, values, numbers.display_kind)
    assert kinds == ["link", "integer", "decimal", "decimal", "decimal", "text", "text", "text", "text"]
    shown = column_of(spark, ["-1.25", "1234567.891", "7", "x"], numbers.display_value)
    assert shown == ["-1.25", "1234567.89", "7", "x"]


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", "-2"], "int"),
        (["1", "2.5"], "real"),
        (["yes", "No"], "bool"),
        ([hashlib.md5(b"x").hexdigest()] * 2, "hash"),
        (["https://a.org", "http://b.org"], "url"),
        (["1", "x"], "text"),
        ([], "text"),
    ],
)
def test_infer_type(spark, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert frame.agg(numbers.infer_type(F.col("v")).alias("t")).head().t == kind


def test_paths(spark):
    contexts = text.Contexts()
    paths = ["/path/to/cnf_sc2021.db", "/path/my-db.db", "a/my.bench.db", "/data/2021data.db", ".hidden", "a..b", "plain"]
    names = ["cnf_sc2021", "my_db", "my_bench", "cnf_2021data", "_hidden", "a_", "plain"]
    assert column_of(spark, paths, lambda c: text.database_name(c, contexts)) == names
    assert [text.database_name_of(p, contexts) for p in paths] == names
    databases = ["cnf_sc2021", "kis_benchmark", "wcnf_maxsat", "sancnf_2022", "testdb", "unknown_prefix", "kis"]
    found = ["cnf", "kis", "wcnf", "sancnf", "cnf", "cnf", "cnf"]
    assert column_of(spark, databases, lambda c: text.context_of(c, contexts)) == found
    assert [contexts.of_database(d) for d in databases] == found
    files = ["/a/x.cnf", "/a/x.sanitized.cnf.xz", "/a/x.kis.gz", "/a/x.wcnf", "/a/x.txt"]
    assert column_of(spark, files, lambda c: text.context_by_suffix(c, contexts)) == ["cnf", "cnf", "kis", "wcnf", None]
    stems = column_of(spark, files, lambda c: text.strip_suffix(c, contexts.suffixes("cnf")))
    assert stems == ["/a/x", "/a/x.sanitized", "/a/x.kis.gz", "/a/x.wcnf", "/a/x.txt"]
    made = column_of(spark, files[:1], lambda c: text.target_path(c, contexts.suffixes("cnf"), ".kis", "gz"))
    assert made == ["/a/x.kis.gz"]
    assert column_of(spark, ["/a/b.cnf", "b"], text.base_name) == ["b.cnf", "b"]


# ---- digests -------------------------------------------------------------------------------


def canonical(content):
    """Byte by byte: digits and minus signs outside comments, single blanks between."""
    out, blank, comment = [], False, False
    for byte in content:
        if byte <= 32:
            blank = bool(out)
            comment = comment and byte not in b"\r\n"
        elif comment or chr(byte) not in "0123456789-":
            comment = True
        else:
            out.append(" " * blank + chr(byte))
            blank = False
    tokens = "".join(out)
    closed = tokens in ("", "0") or tokens.endswith(" 0")
    return tokens if closed else tokens + " 0"


def digests_of(spark, contents):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, content binary")
    column = digest.content_digest(F.col("content")).alias("d")
    return [row.d for row in frame.select("i", column).orderBy("i").collect()]


def test_content_digest_of_random_bytes(spark):
    rng = random.Random(7)
    alphabet = b"0012-9 \n\r\tcp\x00\x85\xe9"
    contents = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert digests_of(spark, contents) == [hashlib.md5(canonical(c).encode()).hexdigest() for c in contents]


def test_variants_share_a_digest(spark):
    """White space, comments and headers do not change the digest."""
    rng = random.Random(3)
    clauses = [[rng.randint(-30, 30) or 1 for _ in range(rng.randint(0, 10))] for _ in range(40)]
    reference = "".join(" ".join(map(str, c + [0])) + "\n" for c in clauses)

    def blanks():
        return "".join(rng.choice(" \t\n") for _ in range(rng.randint(0, 3)))

    variants = []
    for _ in range(100):
        head = blanks() + rng.choice(["", "c some 12 comment\n"]) + rng.choice(["", "p cnf 30 40\n"]) + blanks()
        body = "".join(blanks() + c + blanks() if c.isspace() else c for c in reference)
        variants.append((head + body + blanks()).encode())
    assert set(digests_of(spark, variants)) == set(digests_of(spark, [reference.encode()]))


def test_base_features(spark):
    content = b"c comment 99\np cnf 5 3\n1 -5 0\n2 3 0\n-4"
    frame = spark.createDataFrame([(content,), (b"",)], "content binary")
    columns = [c.alias(n) for n, c in digest.base_features(F.col("content")).items()]
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == [(0, 0), (3, 5)]
