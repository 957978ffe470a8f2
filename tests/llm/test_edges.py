"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hashloom.llm import contamination, elias_fano, exact, html_text, language_model, near, packing, pii, quality
from hashloom.llm import sharding, substring
from hashloom.llm.common import WordHashes, prepared
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank long, key string, n long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def row(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, 7, 7, "k", 7)


ROWS = [
    row(1, "one two three four five six seven"),
    row(2, "one two three four five six seven"),
    row(2, "one two three four five six seven"),
    row(3, None, None),
    row(4, ""),
    row(5, " \n\t "),
    row(6, LONG),
    row(7, LONG + " tail", None),
    row(None, "one two three four five six seven"),
    row(8, "Ünïcode \U0001f600 words\x00 and more"),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    prepared(spark)
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, "three four five"), (10, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10"), (2, None), (3, "!")]
    return spark.createDataFrame(items, "item_id long, text string")


def count(docs):
    return docs.count()


def test_exact(docs):
    rows = exact.duplicate_groups(docs).collect()
    assert len(rows) == count(docs)
    if rows:
        by = {r.doc_id: r for r in rows}
        assert by[1].keep_id == 2 and by[1].group_size == 4 and not by[1].kept and by[2].kept and not by[None].kept
        assert by[3].keep_id == 4 and by[3].group_size == 2


@pytest.mark.parametrize("bits", [1, 3])
def test_exact_with_colliding_keys(spark, bits):
    """Few bits of hash put all texts into a few chains; buckets of one key split as far as bits go."""
    frame = spark.createDataFrame([(i, f"t{i % 20}") for i in range(60)], "doc_id long, text string")
    rows = exact.duplicate_groups(frame, bucket_keys=1, hash_bits=bits).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(i, 40 + i % 20, 3) for i in range(60)}


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    cells, depth = exact.directory(keys, bucket_keys=16)
    found = cells.collect()
    assert 2**depth >= 1000 / 16 and len({r.bucket for r in found}) < len(found) or depth == 6
    counted = keys.select(F.shiftrightunsigned("key", 64 - depth).alias("cell")).join(cells, "cell")
    assert counted.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 16


def test_near(docs):
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == count(docs)
    if rows:
        by = {r.doc_id: r for r in rows}
        assert by[2].component_id == 1 and by[7].component_id == 6 and by[3].n_shingles == 0 and by[3].kept
        assert by[None].component_id is None and by[None].kept


def test_near_pairs_are_due_in_few_keys(spark):
    """Two signatures agree in a key exactly where a chunk has at most one error, and are due in one key of an
    equal chunk; a spare names its symbol one-to-one."""
    one = np.arange(near.CHUNKS * near.SYMBOLS, dtype="<u2")
    two = one.copy()
    two[near.SYMBOLS : near.SYMBOLS + 2] += 1  # two errors in the second chunk, one in the third
    two[2 * near.SYMBOLS + 3] += 256
    two[3 * near.SYMBOLS] += 1  # and one in the first symbol of the fourth
    rows = spark.createDataFrame([(7, bytearray(one.tobytes())), (9, bytearray(two.tobytes()))], "rep long, signature binary")
    keyed = rows.coalesce(1).mapInArrow(near._index, "key long, rep long, spare long").groupBy("key")
    counts = keyed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("spare").alias("spares")).where("n = 2").collect()
    assert len(counts) == (near.CHUNKS - 3) * near.SYMBOLS + 2
    assert sum(row.spares == 2 for row in counts) == near.CHUNKS - 1
    totals = rows.mapInArrow(near._key_counts, "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows"))
    assert {r.key for r in totals.where("rows > 1").collect()} == {r.key for r in counts}


def test_thinned_rows_hold_all_that_are_wanted(spark, monkeypatch):
    from hashloom.llm import common

    monkeypatch.setattr(common, "THIN_WORDS", 6)
    frame = spark.range(50_000).withColumnRenamed("id", "k").withColumn("other", F.col("k") * 2)
    wanted = spark.range(0, 50_000, 1_000).withColumnRenamed("id", "k")
    rows = common.thinned(frame, "k", wanted)
    assert rows.columns == frame.columns and rows.join(wanted, "k").count() == 50 <= rows.count() < 5_000
    assert common.thinned(frame, "k", wanted.limit(0)).isEmpty()


def test_components_of_random_links(spark):
    rng = random.Random(4)
    for size, count in ((60, 40), (60, 200), (300, 299)):
        links = [(rng.randrange(size), rng.randrange(size)) for _ in range(count)]
        if count == 299:  # a path in random order, and a hub between
            order = rng.sample(range(size), size)
            links = list(zip(order, order[1:])) + [(order[7], other) for other in order[100:200]]
        links = [(a, b) for a, b in links if a != b]
        least = {v: v for link in links for v in link}
        changed = True
        while changed:
            changed = False
            for a, b in links:
                low = min(least[a], least[b])
                changed |= least[a] != low or least[b] != low
                least[a] = least[b] = low
        found = near.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == len(least) and {r.rep: r.component for r in found} == least


def test_near_ranks_no_whole_bucket(spark, monkeypatch):
    """Texts with a common passage share buckets over several rounds; every ranking is limited per task first."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(20)) for i in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans = []

    def noted(write):
        def noting(frame, purpose, **sums):
            plans.append((purpose, frame._jdf.queryExecution().executedPlan().toString()))
            return write(frame, purpose, **sums)

        return noting

    for name in ("written", "counted"):
        monkeypatch.setattr(near, name, noted(getattr(near, name)))
    assert {r.component_id for r in near.near_duplicates(frame).collect()} == set(range(120))
    assert sum(purpose == "near-buckets" for purpose, _ in plans) > 3
    for _, plan in plans:
        assert len(re.findall(r"\bWindow \[", plan)) * 2 == len(re.findall(r"\bWindowGroupLimit \[", plan))


def test_centres_are_the_first_of_every_bucket(spark):
    rows = [(k, r, r * k % 5, r * k % 7 + 1) for k in range(5) for r in range(1, 1500 if k == 1 else 30)]
    active = spark.createDataFrame(rows, "key long, rep long, spare long, size long").repartition(5)
    for centres in (1, 8, 1200):
        want = {row for k in range(5) for row in sorted((x for x in rows if x[0] == k), key=lambda x: (x[3], x[1]))[:centres]}
        assert {tuple(r) for r in near._centres(active, centres).collect()} == want


def test_near_carries_no_large_component_on(spark):
    """Where one component is half of a bucket, all rows outside of it are centres at once, elsewhere the first are; none
    of the component is one, also where its rows come first in order or other components are larger elsewhere."""
    rows = [(1, rep, rep, 500, 0, 1) for rep in range(1, 101)] + [(1, rep, rep, 1, 0, rep) for rep in range(101, 141)]
    rows += [(2, rep, rep, 1, 0, rep) for rep in range(101, 141)] + [(2, 1, 1, 500, 0, 1), (2, 2, 2, 500, 0, 1)]
    rows += [(3, rep, rep, 2, 0, 900) for rep in range(900, 960)] + [(3, 1, 1, 500, 0, 1)]
    columns = ["key", "rep", "spare", "size", "weight", "component"]
    active = spark.createDataFrame(rows, ", ".join(f"{name} long" for name in columns)).repartition(5)
    found = near._outside(active, 32).collect()
    reps = {key: sorted(r.rep for r in found if r.key == key) for key in (1, 2, 3)}
    assert reps == {1: list(range(101, 141)), 2: list(range(101, 133)), 3: [1]}
    assert {(r.key, r["_big"]) for r in found} == {(1, 1), (2, 1), (3, 900)}


def test_near_equals_all_pairs(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        texts.append(base)
        for _ in range(6):
            texts.append([w if rng.random() > 0.04 else rng.choice(words) for w in base])
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(frame).collect()}
    assert got == {i: root(i) for i in range(len(sets))}


def test_substring(docs):
    rows = substring.without_repeats(docs).collect()
    assert len(rows) == count(docs)
    if rows:
        by = {r.doc_id: r for r in rows}
        assert by[6].n_removed == 59_800 or by[6].n_removed == 0
        assert by[7].n_removed >= 60_000 and bytes(by[7].kept) == b"tail" and by[3].n_words == 0 and by[1].n_removed == 0


def test_contamination(docs, bench):
    rows = contamination.contamination(docs, bench, span=8).collect()
    by = {r.doc_id: r for r in rows}
    if rows:
        assert len(by) == 9 and by[1].n_hit == 3 and by[1]["items"] == ["1"] and by[1].contaminated
        assert by[6]["items"] == [] or by[6]["items"] == ["10"]
        assert not by[3].contaminated and by[1].near_items == ["1"]


def test_contamination_by_items_without_id(spark, tmp_path):
    import duckdb

    texts = ["x a b c d e f g h i j y", "x", "k l m", "k l m a b c d e f g h i j"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(None, "a b c d e f g h i j"), (None, "k l m"), (5, "k l m")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination.contamination(frame, bench, span=4).collect()
    got = {r.doc_id: (r.n_hit, r["items"], r.n_items, r.contaminated, r.near_items) for r in rows}
    assert got == {
        0: (10, [None], 1, True, []),
        1: (0, [], 0, False, []),
        2: (3, [None, "5"], 2, True, [None, "5"]),
        3: (13, [None, "5"], 2, True, [None, "5"]),
    }
    for name, table in (("documents", frame), ("benchmark", bench)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = contamination.op3_decontamination(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(duckdb.sql(contamination.SQL).fetchall())


@pytest.mark.parametrize("block_words", [1, 40, 500_000])
def test_contamination_keeps_the_benchmark_off_the_driver(spark, monkeypatch, block_words):
    """Long items, windows of several items and repeated ones, in blocks of any size, against plain search."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    items = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 3, 4, 5, 9, 200)] + ["a b c a", "c a b c a"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    with monkeypatch.context() as patched:
        for name in ("toLocalIterator", "collect", "toPandas", "toArrow", "take"):
            patched.setattr(type(frame), name, lambda *_, **__: pytest.fail("rows on the driver"))
        found = contamination.contamination(frame, bench, width=4, block_words=block_words)
    want = {}
    for i, words in enumerate(map(str.split, texts)):
        hit, names = set(), set()
        for item, listed in enumerate(map(str.split, items)):
            for at in range(max(1, len(listed) - 3) if listed else 0):
                part = listed[at : at + 4]
                starts = [s for s in range(len(words) - len(part) + 1) if words[s : s + len(part)] == part]
                hit.update(s + k for s in starts for k in range(len(part)))
                names.update([str(item)] if starts else [])
        want[i] = (len(words), len(hit), sorted(names))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()} == want


def test_sharding(docs):
    rows = sharding.shard(docs, shards=3).collect()
    assert len(rows) == count(docs)
    sizes = [sum(r.shard == s for r in rows) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_mirror_any_number_of_sources_and_null_ids_spread(spark):
    """Sources of one row, of fewer and of more rows than there are cells; a third of all rows has no id."""
    rng = random.Random(5)
    sizes = [1] * 150 + [2] * 20 + [rng.randint(3, 40) for _ in range(12)] + [700, 1500]
    rows = [(None if rng.random() < 1 / 3 else rng.randrange(10**6), f"s{k}", f"text {k} {i}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    placed = sharding.shard(docs, shards=7).collect()
    assert len(placed) == len(rows)
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r.shard, []).append(r)
    counts = [len(group) for group in by_shard.values()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1
    for group in by_shard.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    # the order is that of the fractions of ranks within sources
    ordered = sorted(placed, key=lambda r: (r.shard, r.slot))
    seen, last = {}, 0.0
    for r in ordered:
        rank = seen[r.source] = seen.get(r.source, -1) + 1
        fraction = (2 * rank + 1) / (2 * sizes[int(r.source[1:])])
        assert fraction >= last
        last = fraction
    # rows without id have different keys, so no cell holds many of them
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs.repartition(5), shards=7).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in placed}


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert len({r.doc_id for r in rows}) == (9 if rows else 0)
    if rows:
        assert sum(r.doc_id == 2 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 3] == [1]


def test_best_fit_is_as_tight_as_one_by_one():
    import bisect
    from collections import Counter

    rng = random.Random(2)
    for capacity in (10, 100, 2048):
        lengths = [min(capacity, int(rng.lognormvariate(np.log(capacity / 6), 1)) + 1) for _ in range(3_000)]
        gaps, bins = [], 0
        for length in sorted(lengths, reverse=True):
            at = bisect.bisect_left(gaps, length)
            bins += at == len(gaps)
            left = (gaps.pop(at) if at < len(gaps) else capacity) - length
            bisect.insort(gaps, left)
        used, placed = {}, Counter()
        for length, _, n, first, offset in packing.plan_runs(Counter(lengths), capacity):
            placed[length] += n
            for one in range(first, first + n):
                assert used.get(one, 0) == offset
                used[one] = offset + length
        assert placed == Counter(lengths) and max(used.values()) <= capacity and len(used) <= bins * 1.01 + 1


def test_language_model(docs):
    rows = language_model.language_model_scores(docs).collect()
    assert len(rows) == count(docs) and all(np.isfinite(r.score) and r.score <= 0 for r in rows)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (1000, 1000), (20_000, 1 << 64), (50_000, 1 << 37)):
        values = np.unique(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
        data = elias_fano.to_bytes({}, {}, {"s": elias_fano.encode(values, universe)})
        found = elias_fano.from_bytes(np.frombuffer(data, np.uint8))[2]["s"]
        assert (found.values(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True)])
        at, equal = found.successors(asked)
        if len(values):
            assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_elias_fano_reads_words():
    """Set bits are found and lower bits read a word at a time, also where a value's bits lie in two words."""
    rng = np.random.default_rng(2)
    held = np.concatenate([rng.integers(1, 1 << 64, 500, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    held = np.concatenate([held, np.array([(1 << 64) - 1], dtype=np.uint64)])
    for at in range(64):
        places = [[bit for bit in range(64) if word >> bit & 1] for word in held.tolist()]
        some = [k for k, found in enumerate(places) if len(found) > at]
        found = elias_fano._place_in_word(held[some], np.full(len(some), at))
        assert found.tolist() == [places[k][at] for k in some]
    for bits in range(1, 58):
        values = np.sort(rng.integers(0, 1 << bits, 3, dtype=np.uint64)) + np.uint64(1 << bits) * np.arange(3, dtype=np.uint64)
        data = elias_fano.to_bytes({}, {}, {"s": elias_fano.encode(values, 3 << bits)})
        found = elias_fano.from_bytes(np.frombuffer(data, np.uint8))[2]["s"]
        assert found._lower.dtype == np.uint64 and (found.values(np.arange(3)) == values).all()


def test_tokens_of_the_model():
    """Texts side by side: lower-cased words and an end each, hashed as they come, none remembered."""
    found, lengths = language_model._tokens([b"", b" Aa\x0bB\xc3\x89 aa\n", b"aa"])
    end = WordHashes().of([b""]).tolist()
    a, b = WordHashes().of([b"aa", b"b\xc3\x89"]).tolist()
    assert lengths.tolist() == [1, 4, 2] and found.tolist() == [*end, a, b, a, *end, a, *end]


def test_quality(docs, labels):
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == count(docs) and all(0 <= r.score <= 1 for r in rows)


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    pages = [(1, "u", None, "x", 1), (None, None, "", "x", 1), (3, "u", "<div>" * 2000 + "plain text of a page.", "x", 1)]
    pages.append((4, "u", "<main><p>A &amp; B\n c.<p>Two<aside>no</aside></main><div class='comments'><p>Nice, thanks a lot!</div>", "", 0))
    rows = html_text.main_texts(spark.createDataFrame(pages, schema)).collect()
    assert [r.text for r in rows if r.page_id == 4] == ["A & B c.\n\nTwo"]
    assert [r.text for r in rows if r.page_id in (1, None)] == ["", ""]
    assert html_text.main_texts(spark.createDataFrame([], schema)).count() == 0


HEAD = "<title>Title</title><meta charset=utf-8><script>var a = '<p>';</script>"
ARTICLE = "<article><h1>Heading</h1><p>A sentence of the article.</p><p>And one more of it.</p></article>"
ASIDE = "<nav><a href=/>Home</a></nav>{}<div class='sidebar'><p>Nice, thanks a lot!</p></div>"


@pytest.mark.parametrize("article", [ARTICLE, ARTICLE.replace("article>", "main>"), f"<div>{ARTICLE}</div>"])
@pytest.mark.parametrize(
    "page",
    [
        "<html><head>{head}</head><body>{body}</body></html>",
        "<html><head>{head}<body>{body}</body></html>",
        "<html><head>{head}{body}</html>",
        "<head>{head}<noscript><p>Silent.</p><body>{body}",
        "<html><head>{head}</head><body class='home has-sidebar'>{body}</body></html>",
        "<html class='cookie-banner'><head>{head}<body id=navigation class='site-header' role=search>{body}",
    ],
)
def test_heads_without_end_and_words_of_the_whole_page(page, article):
    html = page.format(head=HEAD, body=ASIDE.format(article))
    assert html_text.extract(html) == "Heading\n\nA sentence of the article.\n\nAnd one more of it."


def test_text_ends_a_head():
    plain = "Some plain sentence of many words in the page itself, right here."
    assert html_text.extract(f"<html><head> {HEAD}\n{plain}</html>") == plain
    assert html_text.extract(f"<html><head> {HEAD}\n</html>") == ""
    # words of the body don't make its blocks a site header
    assert html_text.extract(f"<body class='sticky-header'><div>{plain}</div>") == plain


TEXT = "<h1>Heading</h1><p>A sentence of the article.</p><p>And one more of it.</p>"
REPLIES = "<div>User42 said: nice one, thanks a lot.</div><div>ann_b wrote: no, not at all.</div>"


@pytest.mark.parametrize(
    "page",
    [
        "<div>Heading</div><div>A sentence of the article.</div><div>And one more of it.</div><div>User42 said: nice one, thanks.</div>",
        f'<article class="post share">{TEXT}</article>',
        f'<div class="widget"><article>{TEXT}</article></div>',
        f'<form id="aspnetForm"><main>{TEXT}</main><input name="q"></form>',
        f"<article>{TEXT}<div>{REPLIES}</div></article>",
        f"<div>{TEXT}</div><div>{REPLIES}<div>So do I, every day.</div></div><div>© 2024 The site. All rights reserved.</div>",
        f'<main>{TEXT}</main><div class="related"><article><p>Some other article of the site.</p></article></div>',
        f'<main>{TEXT}</main><section id="comments"><article class="comment"><p>No, I do not think so.</p></article></section>',
        f'<main>{TEXT}</main><div id="cookie-banner"><p>We use cookies to make all of this better.</p></div>',
        f'<main>{TEXT}</main><aside><article><p>An article of the sidebar, of some length.</p></article></aside>',
    ],
)
def test_articles_and_comments_that_words_mislead_about(page):
    assert html_text.extract(page) == "Heading\n\nA sentence of the article.\n\nAnd one more of it."


def test_text_of_anchors_formulas_and_quotes_stays():
    page = f'<article>{TEXT}<section id="related-work"><p>Others said: it works.</p></section><p>As <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> holds.</p></article>'
    assert html_text.extract(page).split("\n\n")[3:] == ["Others said: it works.", "As x=1 holds."]


def test_labels_come_from_repetition_within_a_host():
    def page(host, number, copies=""):
        return host, f"<div>Read more from our partners today.</div><p>Text number {number} of its own, and of no other page.</p>{copies}"

    quoted = "<p>A passage that several hosts quote from somewhere.</p>"
    pages = [page("a", n, quoted if n < 2 else "") for n in range(4)] + [("b", quoted + "<p>Also a long text of its own.</p>")]
    blocks = [html_text.blocks_of(html) for _, html in pages]
    labels = html_text.repetition(blocks, [host for host, _ in pages])
    assert [row.tolist() for row in labels[:3]] == [[-1, -1, -1], [-1, -1, -1], [0, 1]]
    # the weights move towards the labels, by no more than the prior lets them
    before = html_text.PRIOR
    after = html_text.train([page("a", n) for n in range(100)])
    site, own = html_text.features(html_text.blocks_of(page("a", 1)[1]))
    assert (own - site) @ after > (own - site) @ before
    assert (html_text.train([]) == before).all() and np.isfinite(after).all() and abs(after - before).max() < 10


def test_minimum_cut():
    rng = random.Random(3)
    for _ in range(100):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, 2 * rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            cut = sum(c for a, b, c in edges if side[a] != side[b])
            return cut + sum(abs(g) for g, s in zip(gain, side) if (g > 0) != s)

        sides = [[bool(k >> i & 1) for i in range(n)] for k in range(1 << n)]
        assert abs(cost(html_text.minimum_cut(gain, edges)) - min(map(cost, sides))) < 1e-6


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)

    def plain(text):
        found = []
        for kind, pattern in enumerate(PATTERNS):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                good = (
                    True,
                    kind != 1 or all(int(part) <= 255 for part in m[0].split(".")),
                    14 <= len(digits) <= 19 and pii._luhn(digits),
                    10 <= len(digits) <= 15,
                )[kind]
                if good:
                    found.append((m.start(), kind, m.end()))
        return sorted(found)

    texts = ["".join(rng.choice("a@.1+ -9(") for _ in range(120)) for _ in range(2_000)]
    texts += ["".join(rng.choice("12.") for _ in range(80)) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(500)]
    for text in texts:
        assert pii.base_spans(text) == plain(text)


def test_network_learns_and_windows_agree(spark, docs):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(60)]
        words[rng.randrange(60)] = pii._example(rng, rng.randrange(4))
        texts.append(" ".join(words))
    net = pii.train(texts, steps=120)
    ids, labels = pii.training_windows(texts, windows=300, seed=99)
    found = net.decode(ids)
    assert (found == labels)[labels > 0].mean() > 0.85
    # a long text is labelled window by window as if it were one
    long = " ".join(texts * 4)
    whole = pii.label_texts(net, [long])[0]
    assert len(whole) == len(long) and whole.any()
    assert len(pii.personal_data(docs, net).collect()) == count(docs)


def test_counts_in_parts_never_hide_common_shingles():
    rng = np.random.default_rng(5)
    for size, common in ((1, 0), (1, 1), (150, 120), (3_000, 2_500), (40_000, 30_000)):
        both = rng.integers(0, 1 << 63, common, dtype=np.uint64)
        sets = [np.concatenate([both, rng.integers(0, 1 << 63, size - common, dtype=np.uint64)]) for _ in range(2)]
        (one, beyond), (other, more) = map(near.counts_in_parts, sets)
        most = sum(int(x).bit_count() for x in (one & other).view(np.uint64)) + min(beyond, more)
        assert common <= most <= size


def test_near_asks_few_of_the_pairs_of_a_group_that_are_not_linked(spark, monkeypatch):
    """Copies of one text, each changed so much that few are linked: their sets are not compared pair by pair."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = [[w if rng.random() > 0.028 else f"u{rng.random()}" for w in base] for _ in range(150)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = list(range(len(texts)))
    for i, own in enumerate(sets):
        for j in range(i):
            if 7 * len(own & sets[j]) >= 3 * (len(own) + len(sets[j])):
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    asked, count = [], near.counted

    def noting(frame, purpose, **sums):
        frame, found = count(frame, purpose, **sums)
        asked.append(found["rows"] if purpose == "near-pairs" else 0)
        return frame, found

    monkeypatch.setattr(near, "counted", noting)
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.near_duplicates(frame).collect()}
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) > 20
    assert sum(asked) < 10 * len(texts)
