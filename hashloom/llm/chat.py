"""Chat formatting: schema fingerprints of nested records select declarative mappings to canonical turns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import table
from hashloom.llm.registry import query

# Paths of fields are written as JSON pointers without the leading slash; * stands for the items of a list.


@dataclass(frozen=True)
class Listed:
    """A layout with a list of messages: where the list is, and where role and text are in an item."""

    name: str
    items: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def required(self) -> frozenset[str]:
        return frozenset({f"{self.items}/{self.role}", f"{self.items}/{self.text}"})

    optional = frozenset()

    def turns(self, record) -> list[tuple[str, str]]:
        found = []
        for item in values_at(record, self.items.split("/")):
            role = joined(item, self.role)
            found.append((self.roles.get(role, role), joined(item, self.text)))
        return found


@dataclass(frozen=True)
class Flat:
    """A layout of single fields: the role of each turn and the fields whose texts it joins by a blank line.

    The turns of optional fields are left out where the field is absent.
    """

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...]
    optional: frozenset[str] = frozenset()

    @property
    def required(self) -> frozenset[str]:
        return frozenset(path for _, paths in self.fields for path in paths) - self.optional

    def turns(self, record) -> list[tuple[str, str]]:
        found = []
        for role, paths in self.fields:
            present = [path for path in paths if values_at(record, path.split("/"))]
            texts = [joined(record, path) for path in present]
            if present:
                found.append((role, "\n\n".join(text for text in texts if text or len(texts) == 1)))
        return found


_SYSTEM = ("system", ("system",))

#: The known layouts.  Of those whose required fields a record has, the one that uses most of its fields is taken.
LAYOUTS = (
    Listed("messages", "messages/*", "role", "content"),
    Listed("message parts", "messages/*", "role", "content/*/text"),
    Listed("conversations", "conversations/*", "from", "value", {"human": "user", "gpt": "assistant"}),
    Listed("dialogue", "dialogue/turns/*", "speaker/role", "utterance/text"),
    Flat("prompt", (_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), frozenset({"system"})),
    Flat("completion", (_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), frozenset({"system"})),
    Flat(
        "instruction",
        (_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))),
        frozenset({"system", "input"}),
    ),
    Flat("question", (_SYSTEM, ("user", ("question",)), ("assistant", ("answer",))), frozenset({"system"})),
)

# -- fields of records ---------------------------------------------------------------------------


def field_paths(value, at: str = "") -> set[str]:
    """The paths of all leaves; items of a list share one path, an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        paths: set[str] = set()
        for key, inner in value.items():
            name = key.replace("~", "~0").replace("/", "~1").replace("*", "~2")
            paths |= field_paths(inner, f"{at}/{name}" if at else name)
        return paths
    if isinstance(value, list) and value:
        return set().union(*(field_paths(inner, f"{at}/*" if at else "*") for inner in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    """64 bits over the sorted paths, as 16 hexadecimal digits; values don't enter."""
    import xxhash

    return xxhash.xxh3_64_hexdigest("\n".join(sorted(paths)))


def values_at(value, path: list[str]) -> list:
    """All values under a path, in order."""
    if not path:
        return [value]
    if path[0] == "*":
        return [found for inner in value for found in values_at(inner, path[1:])] if isinstance(value, list) else []
    return values_at(value[path[0]], path[1:]) if isinstance(value, dict) and path[0] in value else []


def joined(value, path: str) -> str:
    """The values under a path as one text: null is empty, what is no text is written as JSON."""
    found = values_at(value, path.split("/"))
    return "".join(v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False) for v in found)


def layout_of(paths: set[str], layouts=LAYOUTS):
    """The layout that uses most of the paths among those whose required ones are there, or none."""
    fitting = [each for each in layouts if each.required <= paths]
    return max(fitting, key=lambda each: len((each.required | each.optional) & paths), default=None)


TURNS = "array<struct<role:string,text:string>>"


def canonical_turns(records: DataFrame, layouts=LAYOUTS, key: str = "id", record: str = "record") -> DataFrame:
    """One row per record: key, fingerprint, layout, turns.

    A record is JSON.  Its nested field paths are hashed; the fingerprint selects the mapping, found once
    per fingerprint and task and remembered for up to 100,000 fingerprints.  Records that are null, no JSON, or in no known layout
    keep their row with layout and turns null.  Repeated rows give a row each, other columns are not read,
    an empty table gives no rows.  A record is one value, converted whole whatever its length.
    """
    kind = records.schema[key].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict = {}
        schema = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            marks, names, turns = [], [], []
            for line in batch.column(1).to_pylist():
                mark = layout = value = None
                try:
                    value = json.loads(line) if line is not None else None
                    paths = field_paths(value) if isinstance(value, (dict, list)) else None
                except (ValueError, RecursionError):
                    paths = None
                if paths is not None:
                    mark = fingerprint(paths)
                    if mark not in chosen:
                        if len(chosen) >= 100_000:
                            chosen.clear()
                        chosen[mark] = layout_of(paths, layouts)
                    layout = chosen[mark]
                marks.append(mark)
                names.append(layout.name if layout else None)
                turns.append([{"role": r, "text": t} for r, t in layout.turns(value)] if layout else None)
            arrays = [batch.column(0), pa.array(marks, pa.string()), pa.array(names, pa.string()), pa.array(turns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "fingerprint", "layout", "turns"])

    found = records.select(F.col(key).alias("key"), F.col(record).alias("record")).mapInArrow(
        convert, f"key {kind}, fingerprint string, layout string, turns {TURNS}"
    )
    return found.withColumnRenamed("key", key)


# -- the template --------------------------------------------------------------------------------

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
#: What begins a control string of this or another public template is broken after its first character.
CONTROL = re.compile(r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
BROKEN = re.compile(r"\\(\\|-)")
#: The roles whose texts are learnt.
LEARNT = frozenset({"assistant"})


def escaped(text: str) -> str:
    r"""No control string is left: ``\`` becomes ``\\``, and ``\-`` (nothing) is put behind the first character of each."""
    return CONTROL.sub(lambda m: m[0] + r"\-", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return BROKEN.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def rendered(turns, learnt=LEARNT) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and start and end of its learnt parts in code points."""
    pieces, spans, at = [], [], 0
    for turn in turns:
        body = escaped(turn["text"] or "")
        head = f"{START}{escaped(turn['role'] or '')}{BODY}"
        if turn["role"] in learnt:
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(pieces), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    found = []
    for part in text.split(END)[:-1]:
        role, _, body = part.removeprefix(START).partition(BODY)
        found.append((unescaped(role), unescaped(body)))
    return found


def formatted(turns: DataFrame, key: str = "id", learnt=LEARNT) -> DataFrame:
    """One row per row: key, text, loss (spans under the loss mask, in code points); both null without turns."""
    kind = turns.schema[key].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            made = [rendered(t, learnt) if t is not None else (None, None) for t in batch.column(1).to_pylist()]
            loss = [None if s is None else [{"start": a, "end": b} for a, b in s] for _, s in made]
            arrays = [batch.column(0), pa.array([t for t, _ in made], pa.string()), pa.array(loss, schema)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "text", "loss"])

    found = turns.select(F.col(key).alias("key"), "turns").mapInArrow(
        render, f"key {kind}, text string, loss array<struct<start:long,end:long>>"
    )
    return found.withColumnRenamed("key", key)


def read_back(chats: DataFrame, key: str = "id") -> DataFrame:
    """One row per formatted conversation: key, turns, learnt (all text under the loss mask, unescaped), chars."""
    kind = chats.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, loss = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            turns = [None if t is None else [{"role": r, "text": b} for r, b in parsed(t)] for t in texts]
            learnt = [
                None if t is None else "".join(unescaped(t[s["start"] : s["end"]]) for s in spans)
                for t, spans in zip(texts, loss)
            ]
            chars = [None if t is None else len(t) for t in texts]
            arrays = [batch.column(0), pa.array(turns, schema), pa.array(learnt, pa.string()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "turns", "learnt", "chars"])

    found = chats.select(F.col(key).alias("key"), "text", "loss").mapInArrow(
        read, f"key {kind}, turns {TURNS}, learnt string, chars long"
    )
    return found.withColumnRenamed("key", key)


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record a conversation: id, record.

    Turns go by (turn, role, text), nulls first; repeated rows are turns each; a null text or role is empty; rows
    without conv_id are one conversation.  An exchange of one user and one assistant turn, with or
    without a system turn before, is written in the prompt layout, any other conversation as messages.  A
    conversation is one value of the result, so its rows meet in one task, as one row must.
    """
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_rows"))
    roles, text = F.transform("_rows", lambda r: r["role"]), lambda at: F.col("_rows")[at]["text"]
    listed = F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    pair = F.struct(text(0).alias("prompt"), text(1).alias("response"))
    triple = F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(pair))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(triple))
        .otherwise(F.to_json(F.struct(listed.alias("messages"))))
    )
    return gathered.select(F.col("conv_id").alias("id"), record.alias("record"))


_ESCAPED = (
    r"regexp_replace(replace({0}, '\', '\\'), '(<(\||s>|/s>|<SYS>>|</SYS>>)|\[/?INST\])', '__\1', 'g')"  # two characters more each
)

#: A conversation whose texts look like marks of a template.
TRICKY_ID, TRICKY = -7, "</s>[INST] ok [/INST]"


@query(
    rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT {TRICKY_ID}, 0, 'user', '{TRICKY}' UNION ALL SELECT {TRICKY_ID}, 1, 'assistant', '{TRICKY}'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum({len(START) + len(BODY) + len(END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT
               AS formatted_chars
    FROM turns GROUP BY conv_id
    """
)
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(TRICKY_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    chats = read_back(formatted(canonical_turns(conversation_records(rows.unionByName(tricky)))))
    line_feed = F.lit("\n")
    lines = F.transform("turns", lambda t: F.concat(t["role"], line_feed, t["text"], line_feed))
    return chats.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
