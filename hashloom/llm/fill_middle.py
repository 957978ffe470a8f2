"""Fill-in-the-middle transformation: a wavelet matrix over character classes locates both cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import table, texts
from hashloom.llm.registry import query

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut, and percent of those whose suffix comes first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Bytes of text under one matrix; a longer text has one of its own.
GROUP_BYTES = 8 << 20

#: Classes of bytes: inside a character, letters and digits (with the first bytes of all longer
#: characters), white space, line feed, other.
INSIDE, WORD, SPACE, LINE, OTHER = range(5)
CLASS_BITS = 3
#: The classes whose bytes mark a unit, and whether the marking byte is the first or the last of it.
UNITS = {"character": ((WORD, SPACE, LINE, OTHER), "first"), "line": ((LINE,), "last")}


def _classes() -> np.ndarray:
    codes = np.full(256, OTHER, dtype=np.uint8)
    codes[0x80:0xC0] = INSIDE
    codes[0xC0:] = WORD
    codes[[c for c in range(128) if chr(c).isalnum()]] = WORD
    codes[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    codes[0x0A] = LINE
    return codes


CLASS_OF = _classes()


class WaveletMatrix:
    """Ranks of small codes: one bit vector per level, zeros of a level before its ones on the next.

    A bit vector holds packed bits and the number of ones before each of its bytes, so a rank is two
    look-ups and a count of bits; all methods take arrays of positions.
    """

    def __init__(self, codes: np.ndarray, bits: int = CLASS_BITS):
        self.length, self.levels = len(codes), []
        for level in reversed(range(bits)):
            ones = (codes >> level) & 1
            bits_ = np.append(np.packbits(ones), np.uint8(0))
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits_), dtype=np.int64)])
            self.levels.append((level, bits_, before, self.length - int(before[-1])))
            codes = np.concatenate([codes[ones == 0], codes[ones == 1]])

    def rank(self, code: int, end: np.ndarray) -> np.ndarray:
        """How often the code occurs before each position."""
        start, end = np.zeros(1, dtype=np.int64), np.asarray(end, dtype=np.int64)
        for level, bits, before, zeros in self.levels:
            ones = [before[at >> 3] + np.bitwise_count(bits[at >> 3] >> (8 - (at & 7)).astype(np.uint8)) for at in (start, end)]
            if code >> level & 1:
                start, end = zeros + ones[0], zeros + ones[1]
            else:
                start, end = start - ones[0], end - ones[1]
        return end - start


def _units_before(matrix: WaveletMatrix, classes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    return sum(matrix.rank(code, at) for code in classes)


def _located(matrix: WaveletMatrix, unit: str, low: np.ndarray, high: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Positions between ``low`` and ``high`` with the given number of units between low and them.

    A bisection on ranks.  Units marked by their first byte end where the next one is marked, which is
    the last position with so many marks; units marked by their last byte end at the first such position.
    """
    classes, mark = UNITS[unit]
    wanted = _units_before(matrix, classes, low) + units
    first, last = low.copy(), high.copy()
    while (first < last).any():
        if mark == "first":
            middle = (first + last + 1) >> 1
            good = _units_before(matrix, classes, middle) <= wanted
            first, last = np.where(good, middle, first), np.where(good, last, middle - 1)
        else:
            middle = (first + last) >> 1
            good = _units_before(matrix, classes, middle) >= wanted
            first, last = np.where(good, first, middle + 1), np.where(good, middle, last)
    return first


def cut_places(listed: list[bytes], draws: np.ndarray, unit: str = "character") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, the two cuts in units, and the cuts in bytes; draws are taken modulo units + 1."""
    joined = b"".join(listed)
    matrix = WaveletMatrix(CLASS_OF[np.frombuffer(joined, dtype=np.uint8)])
    ends = np.cumsum([len(text) for text in listed], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    classes, mark = UNITS[unit]
    units = _units_before(matrix, classes, ends) - _units_before(matrix, classes, starts)
    if mark == "last":  # what follows the last mark is a unit too
        units += [bool(text) and CLASS_OF[text[-1]] not in classes for text in listed]
    cuts = np.sort(draws % (units + 1)[:, None], axis=1)
    places = np.column_stack([_located(matrix, unit, starts, ends, cuts[:, k]) for k in range(2)])
    return units, cuts, places - starts[:, None]


def _groups(listed: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for at, text in enumerate(listed):
        if at > start and size + len(text) > GROUP_BYTES:
            yield slice(start, at)
            start, size = at, 0
        size += len(text)
    if start < len(listed):
        yield slice(start, len(listed))


def split_in_three(frame: DataFrame, unit: str = "character") -> DataFrame:
    """Cut ``text`` at the units that the columns ``draw1`` and ``draw2`` name modulo units + 1.

    Gives the other columns with ``units``, ``prefix_units``, ``middle_units``, ``prefix``, ``middle``, ``suffix``.
    """
    kept = [name for name in frame.columns if name not in ("text", "draw1", "draw2")]
    added = ["units", "prefix_units", "middle_units", "prefix", "middle", "suffix"]
    fields = [f"`{name}` {frame.schema[name].dataType.simpleString()}" for name in kept]
    fields += [f"{name} {'long' if name.endswith('units') else 'binary'}" for name in added]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = texts(batch)
            draws = np.column_stack([batch.column(name).to_numpy() for name in ("draw1", "draw2")])
            for part in _groups(listed):
                own = listed[part]
                units, cuts, places = cut_places(own, draws[part], unit)
                pieces = [(t[:a], t[a:b], t[b:]) for t, (a, b) in zip(own, places.tolist())]
                columns = [batch.column(name).slice(part.start, len(own)) for name in kept]
                columns += [pa.array(v, pa.int64()) for v in (units, cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
                columns += [pa.array(list(piece), pa.binary()) for piece in zip(*pieces)]
                yield pa.RecordBatch.from_arrays(columns, names=kept + added)

    found = frame.select(*kept, "text", "draw1", "draw2").mapInArrow(cut, ", ".join(fields))
    return found.withColumns({name: F.col(name).cast("string") for name in added[3:]})


def _drawn(seed: int, doc_id: str, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    documents: DataFrame,
    seed: int = 1,
    unit: str = "character",
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """One row per row of documents: doc_id, units, form, prefix_units, middle_units, text.

    The text of form ``psm`` is prefix, suffix, middle, that of ``spm`` suffix, prefix, middle, each part
    behind its mark; a ``plain`` text is as it was.  Cuts and form follow from a hash of seed and
    doc_id alone, so repeated rows get the same form and a recomputed task the same output.  Plain
    are empty texts, texts that contain a mark, and those that the hash leaves out.  A null text is the
    empty text, a null doc_id is hashed as no digits.  Texts are cut whole whatever their length:
    one under GROUP_BYTES shares a matrix with others, a longer one takes about 5 bytes of memory a
    byte.  Other columns are not read.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (_drawn(seed, "doc_id", 2) % 100 >= cut_percent)
    form = (
        F.when(plain, "plain").when(_drawn(seed, "doc_id", 3) % 100 < suffix_first_percent, "spm").otherwise("psm")
    )
    drawn = documents.select(
        "doc_id", text.alias("text"), form.alias("form"), _drawn(seed, "doc_id", 0).alias("draw1"), _drawn(seed, "doc_id", 1).alias("draw2")
    )
    parts = split_in_three(drawn, unit)
    prefix, middle, suffix = F.col("prefix"), F.col("middle"), F.col("suffix")
    is_cut = F.col("form") != "plain"
    return parts.select(
        "doc_id",
        "units",
        "form",
        F.when(is_cut, F.col("prefix_units")).alias("prefix_units"),
        F.when(is_cut, F.col("middle_units")).alias("middle_units"),
        F.when(F.col("form") == "plain", F.concat(prefix, middle, suffix))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .alias("text"),
    )


def restored(text: str = "text", form: str = "form") -> Column:
    """The text that a transformed text was made of.

    No part of a cut text holds a mark, and marks begin with the only ``<`` in them, so the first
    occurrence of each mark is the one that was put there.
    """
    psm = F.regexp_replace(F.col(text), f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(F.col(text), f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$", "$2$3$1")
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(text))


@query(
    """
    WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), drawn AS (
        SELECT doc_id, t, length(t) AS n,
               ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
               ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
        FROM hashed
    ), cut AS (
        SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                    THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), parts AS (
        SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut
    )
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.col("units").alias("n"),
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("text", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
