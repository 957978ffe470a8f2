"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.llm.common import WordHashes, counted, lowered, mixed, rolling, table, texts, thinned, words, written
from hashloom.llm.registry import query

#: Words of a shingle, and the share of common shingles in percent from which two documents are linked.
SHINGLE, SIMILARITY = 5, 75
#: A signature has CHUNKS x SYMBOLS symbols of BITS bits.  A chunk may have ERRORS differing symbols.
CHUNKS, SYMBOLS, BITS, ERRORS = 16, 6, 16, 1
#: Pairs of signatures that differ in at most this many of the 96 symbols are certain to meet in the
#: index: spread over 16 chunks, more than one error in every chunk takes 32.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Pairs that meet are asked for the distance of 4 more bits of each symbol, and go beyond this one.  Two sets
#: with just three quarters of their shingles in common differ in 22 of these on average and in more than 42
#: twice in a million pairs; they fail to meet in the index five times in a million.  Closer sets fail more seldom.
MOST_DIFFERENT, SKETCH_BITS = 42, 4
SKETCH = [f"s{i}" for i in range(CHUNKS * SYMBOLS * SKETCH_BITS // 64)]
#: The shingles of a set are counted in PARTS parts of their hashes, in unary up to LEVELS.  Bits that two sets have
#: in common, and the lesser number of the shingles beyond, are no fewer than their common shingles.
PARTS, LEVELS = 512, 4

_POLYNOMIAL = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20_240_229)
_FACTORS = _random.integers(0, 1 << 63, CHUNKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, CHUNKS * SYMBOLS, dtype=np.uint64)


def shingles(text: bytes, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """64-bit values of the distinct shingles of a text; fewer words than a shingle are one."""
    listed = words(lowered(text))
    if not listed:
        return np.zeros(0, dtype=np.uint64)
    wide = min(width, len(listed))
    return np.unique(rolling(hashes.of(listed), wide, _POLYNOMIAL) ^ np.uint64(width - wide))


def signature(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """16 bits of the minimum of every hash function over a set of shingles, and 4 others as 64-bit words."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 2_048):
        block = values[at : at + 2_048, None] * _FACTORS + _OFFSETS
        np.minimum(least, block.min(axis=0), out=least)
    least = mixed(least)
    four = (least >> np.uint64(60)).reshape(-1, 64 // SKETCH_BITS) << (np.arange(0, 64, SKETCH_BITS, dtype=np.uint64))
    return least.astype("<u2").tobytes(), np.bitwise_or.reduce(four, axis=1).view(np.int64)


def counts_in_parts(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The counts of a set's shingles in all parts, as bits in 64-bit words, and the number of shingles beyond LEVELS."""
    counts = np.minimum(np.bincount((values >> np.uint64(32)) % np.uint64(PARTS), minlength=PARTS), LEVELS)
    bits = np.packbits(np.arange(LEVELS)[:, None] < counts)
    return bits.view(np.int64), len(values) - int(counts.sum())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        counts, first, second, signatures, sketches = [], [], [], [], []
        for text in texts(batch):
            values = shingles(text, hashes)
            counts.append(len(values))
            first.append(int(mixed(values).sum(dtype=np.uint64).astype(np.int64)))
            second.append(int(mixed(values ^ np.uint64(_POLYNOMIAL)).sum(dtype=np.uint64).astype(np.int64)))
            own, sketch = signature(values)
            signatures.append(own)
            sketches.append(sketch)
        columns = [
            batch.column("doc_id"),
            pa.array(counts, pa.int64()),
            pa.array(first, pa.int64()),
            pa.array(second, pa.int64()),
            pa.array(signatures, pa.binary()),
            *(pa.array([sketch[i] for sketch in sketches], pa.int64()) for i in range(len(SKETCH))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "signature", *SKETCH])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for row, text in enumerate(texts(batch)):
            values = shingles(text, hashes)
            doc_id, asked = (batch.column(name).slice(row, 1) for name in ("doc_id", "asked"))
            members = pa.array([values.view(np.int64)], pa.list_(pa.int64()))
            bits, beyond = counts_in_parts(values)
            columns = [doc_id, asked, members, pa.array([bits], pa.list_(pa.int64())), pa.array([beyond], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "asked", "members", "bits", "beyond"])


def index_keys(signatures: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index keys of rows of symbols: (left out, keys, symbols left out) for every symbol of every chunk.

    Two chunks with at most one differing symbol agree in the key that leaves it out, so these keys
    enumerate all errors that a chunk is allowed.
    """
    symbols = signatures.astype(np.uint64)
    for chunk in range(CHUNKS):
        own = symbols[:, chunk * SYMBOLS : (chunk + 1) * SYMBOLS]
        for skipped in range(SYMBOLS):
            key = np.full(len(own), chunk * SYMBOLS + skipped + 1, dtype=np.uint64)
            for symbol in range(SYMBOLS):
                if symbol != skipped:
                    key = mixed(key * np.uint64(_POLYNOMIAL) + own[:, symbol])
            yield skipped, key.view(np.int64), own[:, skipped].astype(np.int64)


def _symbols(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u2")
    return rows.reshape(batch.num_rows, -1)


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rows): the keys of a batch, each once."""
    for batch in batches:
        every = [keys for _, keys, _ in index_keys(_symbols(batch))]
        keys, counts = np.unique(np.concatenate(every), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "rows"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index of representatives: (key, rep, spare).

    Equal chunks agree in all their keys, and are to be compared in the first one only: ``spare`` stands for
    the symbol left out, and for the representative itself in the first key of a chunk, so a pair is due in
    just those of its keys where spares differ.
    """

    for batch in batches:
        reps = batch.column("rep")
        for skipped, keys, spares in index_keys(_symbols(batch)):
            columns = [pa.array(keys), reps, pa.array(spares) if skipped else reps]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rep", "spare"])


def _split_by_size(smaller: str, larger: str):
    """Whether the sizes of two sets allow the similarity: it is at most the ratio of the sizes."""
    return 100 * F.least(smaller, larger) >= SIMILARITY * F.greatest(smaller, larger)


def _alike(other: str):
    """Whether the sketches of a row and of the row with the prefix ``other`` are near enough."""
    differing = F.lit(0)
    for name in SKETCH:
        bits = F.col(name).bitwiseXOR(F.col(other + name))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differing = differing + F.bit_count(bits)
    return differing <= MOST_DIFFERENT


def _may_share():
    """Whether a row and the row with the prefix ``_`` may have enough shingles in common, by their counts in parts."""
    both = F.zip_with("bits", "_bits", lambda own, other: F.bit_count(own.bitwiseAND(other)))
    most = F.aggregate(both, F.lit(0), lambda total, bits: total + bits) + F.least("beyond", "_beyond")
    return (100 + SIMILARITY) * most >= SIMILARITY * (F.col("n") + F.col("_n"))


def _roots(parents: DataFrame) -> DataFrame:
    """(u, v): the root v above every u of a forest of parents, by pointer doubling.

    A round is one join and one written table, and halves the depth; the last one finds nothing to change.
    """
    changed = 1
    while changed:
        above = parents.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
        joined = parents.join(above, F.col("v") == F.col("_u"), "left")
        moved = joined.select("u", F.coalesce("_v", "v").alias("v"), F.col("_v").isNotNull().alias("moved"))
        parents, sums = counted(moved, "near-roots", moves=F.col("moved"))
        changed, parents = sums["moves"], parents.select("u", "v")
    return parents


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of all ends of the links (a, b): the smallest end that links reach.

    Every end hangs on its smallest smaller neighbour; the roots of this forest take the place of its ends in the links, and
    links within a tree are done.  Levels go on until no link is left.  All steps are written tables, so a lost
    executor costs one step, and an end with many links is pre-aggregated and split by adaptive execution.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    hung, left = None, 1
    while left:
        roots = _roots(edges.groupBy("u").agg(F.min("v").alias("v")))
        if hung is None:
            hung = roots.select(F.col("u").alias("rep"), F.col("v").alias("component"))
        else:  # roots of the level before are no ends of it, so they come as new rows
            hung = _labelled(hung.withColumnRenamed("component", "_was"), _as_labels(roots), "_was", "component")
            hung = hung.select("rep", "component").unionByName(_as_labels(roots))
        ends = _labelled(_labelled(edges, _as_labels(roots), "u", "_a"), _as_labels(roots), "v", "_b")
        between = ends.where("_a <> _b").select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v"))
        edges, sums = counted(between.distinct(), "near-edges")
        left = sums["rows"]
    return hung.unionByName(hung.select(F.col("component").alias("rep"), "component").distinct())


def _as_labels(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("u").alias("rep"), F.col("v").alias("component"))


def _joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (rep, component, size) after more links (a, b): only those between components are followed."""
    if labels is None:
        labels = components(links)
    else:
        own = labels.select("rep", "component")
        ends = _labelled(_labelled(links, own, "a", "_ca"), own, "b", "_cb")
        between = ends.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")).where("a <> b")
        moved = written(components(between), "near-joined")
        before = _labelled(own.withColumnRenamed("component", "_was"), moved, "_was", "component")
        new = moved.join(own.select("rep"), "rep", "left_anti")
        labels = before.select("rep", "component").unionByName(new)
    labels = written(labels, "near-components")
    sizes = labels.groupBy(F.col("component").alias("_whole")).agg(F.count(F.lit(1)).alias("size"))
    sized = labels.join(sizes, labels["component"] == sizes["_whole"]).drop("_whole")
    return written(sized, "near-sizes")


def _verified(asking: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """Links (a, b): the rows (rep, members, asked) whose set and that of ``asked`` are similar enough, written, and
    their number.  Only sets that are asked are shuffled to meet them."""
    wanted = asking.select(F.col("asked").alias("rep")).distinct()
    centres = thinned(sets.select("rep", "members"), "rep", wanted)
    centres = centres.select(F.col("rep").alias("asked"), F.col("members").alias("_members"))
    common = F.size(F.array_intersect("members", "_members"))
    union = F.size("members") + F.size("_members") - F.col("_common")
    checked = asking.join(centres, "asked").withColumn("_common", common)
    alike = checked.where(100 * F.col("_common") >= SIMILARITY * union)
    links, sums = counted(alike.select(F.least("rep", "asked").alias("a"), F.greatest("rep", "asked").alias("b")), "near-links")
    return links, sums["rows"]


def _labelled(frame: DataFrame, labels: DataFrame | None, rep: str, name: str) -> DataFrame:
    """Add the component of ``rep``: itself as long as it has no links."""
    if labels is None:
        return frame.withColumn(name, F.col(rep))
    side = labels.select(F.col("rep").alias("_end"), F.col("component").alias("_label"))
    joined = frame.join(side, frame[rep] == side["_end"], "left")
    return joined.withColumn(name, F.coalesce("_label", rep)).drop("_end", "_label")


#: Centres of a bucket in the first round, and how many times as many each later round has.
FIRST_CENTRES, MORE_CENTRES = 1, 32


def _centres(active: DataFrame, centres: int) -> DataFrame:
    """The first rows of every bucket, ``centres`` at most: each task passes on that many of its own rows of a key."""
    order = [name for name in _ORDER if name in active.columns]
    if centres == 1:
        others = [name for name in active.columns if name not in ("key", *order)]
        least = active.groupBy("key").agg(F.min(F.struct(*order, *others)).alias("_least"))
        return least.select("key", "_least.*").select(*active.columns)
    window = Window.partitionBy("key").orderBy(*order)
    return active.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= centres).drop("_rank")


#: Centres of a bucket in a later round, at most, where rows of its largest component are half of it or more.
MOST_CENTRES = 1_024


def _outside(active: DataFrame, centres: int) -> DataFrame:
    """The centres of later rounds, with the largest component of their bucket (``_big``), which has none of them.

    Pairs within that component are known, so the rows outside of it meet all others.  Where it is half of a bucket or
    more, its rows would only be carried on from round to round to meet the few outside: those, MOST_CENTRES at most, are
    centres at once.  Elsewhere the first ``centres`` of them are, as links among them may save the others.
    """
    parts = active.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_part"))
    whole = parts.groupBy("key").agg(F.sum("_part").alias("_rows"), F.max(F.struct("_part", "component")).alias("_largest"))
    ruled = (2 * F.col("_largest._part") >= F.col("_rows")).alias("_ruled")
    outside = active.join(whole.select("key", F.col("_largest.component").alias("_big"), ruled), "key")
    outside = outside.where(F.col("component") != F.col("_big"))
    ranked = outside.withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy(*_ORDER)))
    ranked = ranked.where(F.col("_rank") <= max(centres, MOST_CENTRES))
    return ranked.where(F.col("_ruled") | (F.col("_rank") <= centres)).drop("_rank", "_ruled")


#: The order of a bucket: members of small components first, then those that meet the most rows in all their buckets
#: (``weight`` is minus their number): what copies were made from meets more of them than they do of each
#: other.  It is total and the same in all buckets, so every plan that asks has the same centres.
_ORDER = ("size", "weight", "rep", "spare")
_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


@contextmanager
def _limited_windows(spark: SparkSession):
    """While this lasts, tasks pick the first rows of windows for any number of them before rows are shuffled."""
    before = spark.conf.get(_LIMIT, None)
    spark.conf.set(_LIMIT, str((1 << 31) - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LIMIT)
        else:
            spark.conf.set(_LIMIT, before)


def _linked(documents: DataFrame, representatives: DataFrame) -> DataFrame | None:
    """Components of the representatives (rep, component, size), or None if there are no links.

    The buckets are the groups of representatives with one index key; one whose members share the spare
    symbol holds no pair that is due there and is left out.  A bucket is never expanded into
    all its pairs at once: a round compares its first members (the centres) with all its others that are not known to be
    in the same component, then retires the centres and all buckets whose members are in one component.
    Members of small components are centres first, and from the second round on none of the largest component of a bucket
    is: once all others are retired, the bucket is done.
    Rounds go on, with MORE_CENTRES times as many centres each, until no bucket is left: all pairs of a bucket have then
    been compared, or are in one component anyway, so no link that could join two components is missed.
    No task holds a bucket to rank it: the centres are picked per task first, the others are what comes behind them.
    In the first round each member asks its smallest centre first, and the others only if still apart.
    Later rounds have many centres, so their pairs are tried by the counts of their shingles in parts, where the buckets
    meet: most pairs that the sketches cannot tell from linked ones end there, and no linked pair does.
    """
    # Only keys are shuffled to find those that several have; of the rows, only those that may have one of them.
    keys = representatives.select("signature").mapInArrow(_key_counts, "key long, rows long").repartition("key")
    several = keys.groupBy("key").agg(F.sum("rows").alias("rows")).where("rows > 1").select("key")
    several, found = counted(several, "near-keys")
    if not found["rows"]:
        return None
    spares = F.min("spare").alias("_least"), F.max("spare").alias("_most")
    keyed = representatives.select("rep", "signature").mapInArrow(_index, "key long, rep long, spare long")
    meeting = thinned(keyed, "key", several)
    shared = meeting.groupBy("key").agg(*spares, F.count(F.lit(1)).alias("_rows")).where("_least <> _most")
    meeting = written(meeting.join(shared.select("key", "_rows"), "key"), "near-meeting")
    weights = meeting.groupBy("rep").agg((-F.sum("_rows")).alias("weight"))
    described = representatives.select("rep", "n", *SKETCH).join(weights, "rep")
    meeting = meeting.drop("_rows").join(described, "rep").withColumn("size", F.lit(1).cast("long"))
    active, found = counted(meeting.withColumn("component", F.col("rep")), "near-buckets")
    sets = None
    labels, centres, first_round = None, FIRST_CENTRES, True
    while found["rows"]:
        if first_round:
            first = _centres(active, centres).withColumn("_big", F.lit(None).cast("long"))
        else:
            first = _outside(active, centres)
        behind = first.groupBy("key").agg(F.max(F.struct(*_ORDER)).alias("_last"), F.max("_big").alias("_big"))
        first = first.select("key", *(F.col(name).alias(f"_{name}") for name in first.columns if name not in ("key", "_big")))
        apart = (F.col("component") != F.col("_component")) & (F.col("spare") != F.col("_spare"))
        apart = apart & _split_by_size("n", "_n") & _alike("_")
        apart = apart if first_round else apart & _may_share()
        meeting = active.join(first, "key").where(apart)
        pairs = meeting.select("rep", F.col("_rep").alias("asked"), F.col("_weight").alias("weight")).distinct()
        pairs, met = counted(pairs, "near-pairs")
        if first_round:
            asked = pairs.groupBy("rep").agg(F.min(F.struct("weight", "asked"))["asked"].alias("asked"))
            sets = _set_table(documents, active, asked)
            links, more = _verified(sets.select("rep", "members", "asked").where("asked IS NOT NULL"), sets)
            labels = _joined_components(None, links) if more else None
            apart = _labelled(_labelled(pairs, labels, "rep", "_ca"), labels, "asked", "_cb").where("_ca <> _cb")
            pairs, met = counted(apart.select("rep", "asked").join(asked, ["rep", "asked"], "left_anti"), "near-pairs")
        if met["rows"]:
            asking = thinned(sets.select("rep", "members"), "rep", pairs.select("rep").distinct())
            links, more = _verified(asking.join(pairs.select("rep", "asked"), "rep"), sets)
            labels = _joined_components(labels, links) if more else labels
        stays = (F.struct(*_ORDER) > F.col("_last")) | F.col("component").eqNullSafe(F.col("_big"))
        rest = active.join(behind, "key").where(stays).drop("_last", "_big")
        if labels is not None:
            side = labels.select(F.col("rep").alias("_end"), F.col("component").alias("_label"), F.col("size").alias("_size"))
            rest = rest.join(side, rest["rep"] == side["_end"], "left")
            rest = rest.withColumns({"component": F.coalesce("_label", "rep"), "size": F.coalesce("_size", "size")})
            rest = rest.drop("_end", "_label", "_size")
        apart = rest.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), *spares)
        apart = apart.where("_low <> _high AND _least <> _most").select("key")
        rest = rest.join(apart, "key", "left_semi")
        if first_round:
            shares = sets.select(F.col("rep").alias("_end"), "bits", "beyond").distinct()
            rest = rest.join(shares, rest["rep"] == shares["_end"]).drop("_end")
        active, found = counted(rest, "near-buckets")
        centres, first_round = centres * MORE_CENTRES, False
    return labels


_SETS = "rep long, asked long, members array<long>, bits array<long>, beyond long"


def _set_table(documents: DataFrame, active: DataFrame, asked: DataFrame) -> DataFrame:
    """(rep, asked, members, bits, beyond) of all representatives in buckets: the set of each, the centre it asks
    first, and the counts of the set in parts."""
    wanted = active.select("rep").distinct().join(asked, "rep", "left").withColumnRenamed("rep", "doc_id")
    sources = thinned(documents, "doc_id", wanted).join(wanted, "doc_id")
    return written(sources.mapInArrow(_sets, _SETS), "near-sets")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of 5-word shingles (words between ASCII white space, A-Z as
    a-z) have 100 * common >= 75 * union; component_id is the smallest doc_id that links reach, kept
    says that it is the document's own.  Fewer words than five are one shingle; a null, empty or blank
    text has no shingles and no links, and stays.  A null doc_id has a null component and stays, without
    links.  Repeated rows share a component, hence stay or go together; rows of one doc_id with different
    texts are linked through it.  An empty table gives no rows.

    Documents with equal sets are one representative from the start, so groups of copies of any size
    cost one row per task.  Candidates come from the index, links from the full sets.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n long, d1 long, d2 long, signature binary, " + ", ".join(f"{name} long" for name in SKETCH)
    signed = written(rows.mapInArrow(_signed, schema), "near-signatures")
    digest = ["n", "d1", "d2"]
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    same_set = [F.first(name).alias(name) for name in ("signature", *SKETCH)]
    classes = named.groupBy(*digest).agg(F.min("doc_id").alias("rep"), *same_set)
    representatives = written(classes, "near-representatives")
    with _limited_windows(documents.sparkSession):
        labels = _linked(rows, representatives)
    classes = _labelled(representatives.select(*digest, "rep"), labels, "rep", "component")
    classes = classes.select(*(F.col(name).alias(f"_{name}") for name in digest), "component")
    same = (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    found = signed.join(classes, same & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


@query(SQL)
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
