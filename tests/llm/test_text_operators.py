"""Periodic runs, chat formatting and fill-in-the-middle against plain versions, round trips and edge cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from check_queries import entry_module
from hashloom.llm import chat, fill_middle, periodic
from hashloom.llm.common import prepared
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- periodic runs ---------------------------------------------------------------------------------


def plain_runs(words):
    """Every period in ascending order; a repetition already seen with a smaller one is left out."""
    names = {word: k for k, word in enumerate(dict.fromkeys(words))}
    own = np.array([names[word] for word in words], dtype=np.int64)
    seen, runs = set(), []
    for period in range(1, len(own) // 4 + 1):
        equal = np.concatenate([[0], (own[period:] == own[:-period]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(equal))
        for start, end in zip(edges[::2].tolist(), (edges[1::2] + period).tolist()):
            if end - start >= 4 * period and (start, end) not in seen:
                seen.add((start, end))
                if end - start >= 6:
                    runs.append((start, end - start, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def generated(rng, kind):
    letters = [f"w{k}".encode() for k in range(rng.choice([1, 2, 3, 40]))]
    own = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(0, 5)):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 40 if kind else 6))]
        if rng.random() < 0.4:  # the unit is nearly periodic itself
            unit = unit[:3] * rng.randrange(2, 9) + unit[3:]
        copies = unit * rng.randrange(2, 9)
        own += copies[: len(copies) - rng.randrange(0, len(unit))] + [rng.choice(letters) for _ in range(rng.randrange(0, 9))]
    return own


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_plain_search(seed):
    rng = random.Random(seed)
    listed = [generated(rng, k % 2) for k in range(250)]
    for own, runs in zip(listed, periodic.runs_of(listed)):
        assert runs == plain_runs(own)


def test_runs_of_fibonacci_and_square_free_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 3000:
        a, b = b, b + a
    thue, text = {b"0": [b"0", b"1", b"2"], b"1": [b"0", b"2"], b"2": [b"1"]}, [b"0"]
    while len(text) < 2000:
        text = [letter for old in text for letter in thue[old]]
    units = [word for word in text[:300] for _ in range(1)] * 5
    listed = [b, text, units, [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 3, [b"a", b"b"] * 4]
    found = periodic.runs_of(listed)
    assert found == [plain_runs(own) for own in listed]
    assert found[1] == [] and found[2] == [(0, 1500, 300)] and found[3:] == [[], [(0, 6, 1)], [], [(0, 8, 2)]]


def test_collapse_keeps_the_first_period():
    own = b"x a b a b a b a b y".split()
    (runs,) = periodic.runs_of([own])
    assert runs == [(1, 8, 2)] and periodic.without_repeats(own, runs) == b"x a b y".split()


def test_periodic_query_equals_the_plain_search(spark):
    rows = {r.doc_id: r for r in entry_module.queries()["op11_periodic_runs"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(rows) == len(docs)
    planted = 0
    for doc in docs:
        words, h = (doc.text or "").encode().split(), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        runs, row = plain_runs(words), rows[doc.doc_id]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
        kept = b" ".join(word for i, word in enumerate(words) if i not in dropped)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{s},{length},{p}\n" for s, length, p in runs))
        assert row.collapsed_sha256 == sha(kept)
    assert planted > 5


EDGES = "doc_id long, text string, runs int, draw1 string, units string, start long"


def edge_rows():
    long = "a b c " * 40_000
    rows = [(1, "a " * 9), (2, None), (3, ""), (4, " \n\t"), (5, long), (None, "a b " * 5), (1, "a " * 9), (6, "é😀\x00<P>" * 3)]
    return [(i, t, 1, "x", "y", 2) for i, t in rows]


def test_periodic_edges(spark):
    prepared(spark)
    rows = periodic.collapse_runs(spark.createDataFrame(edge_rows(), EDGES)).collect()
    found = sorted(((r.doc_id, [tuple(run) for run in r.runs], r.text) for r in rows), key=str)
    assert found == sorted(
        [(1, [(0, 9, 1)], "a")] * 2
        + [(2, [], ""), (3, [], ""), (4, [], ""), (5, [(0, 120_000, 3)], "a b c"), (None, [(0, 10, 2)], "a b")]
        + [(6, [], "é😀\x00<P>" * 3)],
        key=str,
    )
    assert periodic.collapse_runs(spark.createDataFrame([], EDGES)).collect() == []


def test_texts_beyond_a_group_are_searched_alone(spark, monkeypatch):
    monkeypatch.setattr(periodic, "GROUP_WORDS", 10)
    monkeypatch.setattr(periodic, "REMEMBERED", 5)
    prepared(spark)
    frame = spark.createDataFrame([(i, f"x{i} a b " + f"c{i} d " * 6) for i in range(30)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in periodic.collapse_runs(frame).collect()}
    assert {i: [tuple(run) for run in r.runs] for i, r in rows.items()} == {i: [(3, 12, 2)] for i in range(30)}
    assert all(r.text == f"x{i} a b c{i} d" for i, r in rows.items())


# -- chat formatting -------------------------------------------------------------------------------

RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 7},
    "message parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
    "conversations": {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
    "dialogue": {"dialogue": {"turns": [{"speaker": {"role": "user"}, "utterance": {"text": "a"}}]}},
    "prompt": {"prompt": "a", "response": "b", "system": "s"},
    "completion": {"completion": "b", "prompt": "a"},
    "instruction": {"instruction": "a", "input": "", "output": "b"},
    "question": {"question": "a", "answer": 5},
}
TURNS = {
    "messages": [("user", "a"), ("assistant", "")],
    "message parts": [("user", "ab")],
    "conversations": [("user", "a"), ("assistant", "b")],
    "dialogue": [("user", "a")],
    "prompt": [("system", "s"), ("user", "a"), ("assistant", "b")],
    "completion": [("user", "a"), ("assistant", "b")],
    "instruction": [("user", "a"), ("assistant", "b")],
    "question": [("user", "a"), ("assistant", "5")],
}


def test_every_layout_gives_its_turns(spark):
    rows = [(name, json.dumps(record), "x") for name, record in RECORDS.items()]
    rows += [("broken", "{", "x"), ("null", None, "x"), ("unknown", '{"text": "a"}', "x"), ("list", "[1]", "x"), ("deep", "[" * 100_000, "x")]
    frame = spark.createDataFrame(rows + rows[:1], "id string, record string, turns string")
    found = chat.canonical_turns(frame).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert r.layout == (r.id if r.id in RECORDS else None)
        assert (r.turns and [tuple(t) for t in r.turns]) == TURNS.get(r.id)
    assert len({r.fingerprint for r in found if r.id in RECORDS}) == len(RECORDS)
    assert chat.canonical_turns(frame.limit(0)).collect() == []


def test_fingerprints_know_paths_only():
    one = chat.field_paths({"b": [{"x": 1}, {"y": 2}], "a": {"c": None}})
    assert one == {"b/*/x", "b/*/y", "a/c"} and chat.field_paths({"a/b": {"*": 1}}) == {"a~1b/~2"}
    assert chat.fingerprint(one) == chat.fingerprint(chat.field_paths({"a": {"c": 5}, "b": [{"y": 0, "x": "t"}]}))
    assert chat.fingerprint(one) != chat.fingerprint(one | {"d"})


def test_escapes_leave_no_control_string_and_come_back():
    rng, parts = random.Random(3), ["<", "|", ">", "s", "/", "[", "INST", "]", "\\", "-", "SYS>>", "<<", "é😀", chat.START, chat.BODY, chat.END]
    controls = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"]
    for _ in range(5000):
        turns = [{"role": "".join(rng.choices(parts, k=rng.randrange(4))), "text": "".join(rng.choices(parts, k=9))} for _ in range(3)]
        turns.append({"role": "assistant", "text": "".join(rng.choices(parts, k=6))})
        for turn in turns:
            assert not any(c in chat.escaped(turn["text"]) for c in controls)
        text, spans = chat.rendered(turns)
        assert chat.parsed(text) == [(t["role"], t["text"]) for t in turns]
        assert "".join(chat.unescaped(text[a:b]) for a, b in spans) == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_conversations_with_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", None, "a"), (1, 1, None, "x", "a"), (1, 1, None, "x", "b"), (None, 0, "user", "q", "a"), (None, 1, "assistant", "r", "a")]
    rows += [(2, None, "assistant", "</s>", "a"), (2, 0, "user", "u" * 200_000, "a"), (3, 0, "system", "s", "a"), (3, 1, "user", "u", "a"), (3, 2, "assistant", "", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")
    chats = chat.read_back(chat.formatted(chat.canonical_turns(chat.conversation_records(frame)))).collect()
    found = {r.id: ([tuple(t) for t in r.turns], r.learnt) for r in chats}
    assert found == {
        1: ([("user", ""), ("", "x"), ("", "x")], ""),
        None: ([("user", "q"), ("assistant", "r")], "r"),
        2: ([("assistant", "</s>"), ("user", "u" * 200_000)], "</s>"),
        3: ([("system", "s"), ("user", "u"), ("assistant", "")], ""),
    }
    assert chat.conversation_records(frame.limit(0)).collect() == []


def test_rows_without_turns_stay_null(spark):
    frame = spark.createDataFrame([(1, None)], f"id long, turns {chat.TURNS}")
    made = chat.formatted(frame)
    assert [tuple(r) for r in made.collect()] == [(1, None, None)]
    assert [tuple(r) for r in chat.read_back(made).collect()] == [(1, None, None, None)]


# -- fill in the middle ----------------------------------------------------------------------------


def test_ranks_equal_counts():
    rng = np.random.default_rng(1)
    for length in (0, 1, 7, 8, 9, 1000):
        codes = rng.integers(0, 5, length).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(codes)
        at = np.arange(length + 1)
        for code in range(8):
            assert matrix.rank(code, at).tolist() == [int((codes[:i] == code).sum()) for i in at]


def test_cuts_fall_between_characters_or_lines():
    rng = random.Random(5)
    listed = ["".join(rng.choices("ab é😀\ń中", k=rng.randrange(30))) for _ in range(300)]
    draws = np.array([[rng.randrange(2**32), rng.randrange(2**32)] for _ in listed])
    units, cuts, places = fill_middle.cut_places([t.encode() for t in listed], draws)
    for text, n, (a, b), (p, q) in zip(listed, units, cuts, places):
        assert n == len(text) and text.encode()[:p].decode() == text[:a] and text.encode()[:q].decode() == text[:b]
    units, cuts, places = fill_middle.cut_places([t.encode() for t in listed], draws, "line")
    for text, n, (a, b), (p, q) in zip(listed, units, cuts, places):
        lines = text.encode().split(b"\n")
        lines = [line + b"\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        assert n == len(lines) and text.encode()[:p] == b"".join(lines[:a]) and text.encode()[:q] == b"".join(lines[:b])


def test_fill_in_middle_edges(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "GROUP_BYTES", 64)
    prepared(spark)
    rows = fill_middle.fill_in_middle(spark.createDataFrame(edge_rows(), EDGES))
    found = rows.withColumn("back", fill_middle.restored()).collect()
    want = sorted(((i, t or "") for i, t, *_ in edge_rows()), key=str)
    assert sorted(((r.doc_id, r.back) for r in found), key=str) == want
    assert {r.form for r in found if r.doc_id in (2, 3, 6)} == {"plain"}
    for r in found:
        assert r.units == len(r.back) and (r.form == "plain") == (r.prefix_units is None)
    assert fill_middle.fill_in_middle(spark.createDataFrame([], EDGES)).collect() == []


@pytest.mark.parametrize("unit", ["character", "line"])
def test_all_forms_come_back(spark, unit):
    prepared(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = fill_middle.fill_in_middle(docs, seed=4, unit=unit, cut_percent=80, suffix_first_percent=50)
    rows = made.withColumn("back", fill_middle.restored()).join(docs.withColumnRenamed("text", "was"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.back == (r.was or "") for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_hot_forms_need_no_shuffle(spark):
    made = fill_middle.fill_in_middle(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.groupBy("form").agg(F.count("*")).count() == 3
