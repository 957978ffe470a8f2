"""The numbered queries equal their SQL, or a plain version, on the smallest tables."""

import re
import zlib

import numpy as np
import pytest
from check_queries import compare, connect, entry_module

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def query(spark, number):
    name = next(n for n in entry_module.queries() if n.startswith(f"op{number}_"))
    return name, entry_module.queries()[name](spark, SF_DIR)


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_every_number_is_registered():
    names = {int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in entry_module.queries()) if m}
    assert names == set(range(1, 14)) and "pipeline" in entry_module.queries()


@pytest.mark.parametrize("number", [2, 3, 6, 7, 12, 13])
def test_equals_sql(spark, connection, number):
    name, _ = query(spark, number)
    assert compare(spark, connection, SF_DIR, name) is None


def test_shards_hold_equal_rows_and_the_mixture(spark):
    rows = query(spark, 4)[1].collect()
    docs = documents(spark)
    assert len(rows) == len(docs)
    shards: dict = {}
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text) and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r)
    counts = [len(shards[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total = {s: sum(r.source == s for r in rows) for s in {r.source for r in rows}}
    for own in shards.values():
        for source, n in total.items():
            assert abs(sum(r.source == source for r in own) - n * len(own) / len(rows)) <= 2


def test_pieces_are_the_tokenizer_s_and_fill_sequences(spark):
    from hashloom.llm.packing import tokenizer_path
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(tokenizer_path()), {}
    for doc_id, row in documents(spark).items():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[doc_id, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    rows = query(spark, 5)[1].collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def test_language_model_base_scores(spark):
    docs = documents(spark)
    tokens = {i: [*(r.text or "").encode().lower().split(), b""] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts: dict = {}
    for i, listed in tokens.items():
        for token in listed if not held[i] else []:
            counts[token] = counts.get(token, 0) + 1
    total, size = sum(counts.values()), len(counts)
    rows = query(spark, 8)[1].collect()
    assert len(rows) == len(docs)
    for r in rows:
        listed = tokens[r.doc_id]
        base = sum(np.log10((counts.get(t, 0) + 0.5) / (total + 0.5 * (size + 1))) for t in listed)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(listed), total)
        assert r.n_known == sum(t in counts for t in listed) and abs(r.base_score - base) < 1e-6 * abs(base)
    # the bigrams explain held-out text better than single words
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_quality_of_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = query(spark, 9)[1].collect()
    assert len(rows) == len(documents(spark)) and all(0 <= r.score <= 1 for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) >= 0.9


def test_articles_of_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = query(spark, 10)[1].collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|$)", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"<[^>]*>", "", part) for part in re.split(r"</?(?:p|h1|br)\b[^>]*>", article))
        want = "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r.text == want and r.n_chars == len(want)


def test_pipeline_stages_keep_what_they_decide(spark, connection):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = pipeline.quality(spark, docs, SF_DIR)
    good = {r.doc_id for r in query(spark, 9)[1].collect() if r.predicted == 1}
    assert {r.doc_id for r in first.collect()} == good and first.columns == docs.columns
    second = pipeline.exact_dedup(spark, docs, SF_DIR)
    texts = [r.text for r in second.collect()]
    assert len(texts) == len(set(texts)) == docs.select("text").distinct().count()
    third = {r.doc_id for r in pipeline.near_dedup(spark, docs, SF_DIR).collect()}
    assert third == {r.doc_id for r in query(spark, 7)[1].collect() if r.kept}
    fourth = {r.doc_id for r in pipeline.decontaminate(spark, docs, SF_DIR).collect()}
    assert fourth == {r.doc_id for r in query(spark, 3)[1].collect() if not r.contaminated}
    packed = pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} <= good


def one_of_each_text(texts):
    return {max(i for i in texts if texts[i] == text): text for text in set(texts.values())}


def one_of_each_component(texts):
    sets, first = {}, {i: i for i in texts}
    for i, text in texts.items():
        words = re.sub(r"[A-Z]", lambda m: m[0].lower(), text).encode().split()
        sets[i] = {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if first[a] < first[b] and union and 100 * common >= 75 * union:
                    first[b], changed = first[a], True
    return {i: text for i, text in texts.items() if first[i] == i}


def without_windows(texts, items, width=10):
    def folded(text):
        return f" {' '.join(re.sub(rb'[^a-z0-9\x80-\xff]+', b' ', text.encode().lower()).decode().split(' '))} "

    windows = set()
    for words in (folded(item).split(" ")[1:-1] for item in items):
        words = [word for word in words if word]
        windows |= {" ".join(words[at : at + width]) for at in range(max(1, len(words) - width + 1))} if words else set()
    return {i: text for i, text in texts.items() if not any(f" {w} " in folded(text).replace("  ", " ") for w in windows)}


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as pipeline
    from hashloom.llm.packing import tokenizer_path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [r.text or "" for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text or "" for r in pipeline.quality(spark, docs, SF_DIR).collect()}
    left = [texts, one_of_each_text(texts)]
    left.append(one_of_each_component(left[-1]))
    left.append(without_windows(left[-1], items))
    assert docs.count() > len(left[0]) and len(left[-1]) > 0
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), {}
    for doc_id, text in left[-1].items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[doc_id, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    rows = pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want), [
        len(stage) for stage in left
    ]
