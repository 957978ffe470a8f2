"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds spans."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.common import table
from hashloom.llm.registry import query

KINDS = ("email", "ip", "card", "phone")

# -- patterns ------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only: if that start fails, so do all later ones.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain, found from each @: a long run without @ costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        else:
            free = at + 1  # no local part reaches over an @
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, by start, then kind."""
    found = [(start, 0, end) for start, end in _emails(text)] if "@" in text else []
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append((match.start(), 1, match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match[0]) if match.end() - match.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_digits(match[0])) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


# -- the network ---------------------------------------------------------------------------------

#: Cells of each direction, characters of a window, characters that neighbouring windows share.
CELLS, WINDOW, OVERLAP = 6, 512, 64
#: Windows that a task runs at once.
AT_ONCE = 1_024
#: Labels: none and the kinds.  A kind is never followed by another kind.
LABELS = 1 + len(KINDS)
#: Classes of characters: 0 padding, 1 to 127 ASCII, 128 other letters' range, 129 beyond.
CLASSES = 130

#: Training: documents that are read, windows that are taken from them, window length, steps, rows a step.
TRAINING_DOCUMENTS, TRAINING_WINDOWS, TRAINING_LENGTH, TRAINING_STEPS, TRAINING_ROWS = 400, 1_500, 80, 200, 128


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, np.maximum(points, 1), np.where(points < 0x2000, 128, 129)).astype(np.uint8)


def _squash(x: np.ndarray) -> None:
    """x / (1 + |x|) in place.  It stands for tanh, whose evaluation would take most of the time."""
    x /= np.abs(x) + 1


def _slope(y: np.ndarray) -> np.ndarray:
    """The slope of the squashing function by its value."""
    return np.square(1 - np.abs(y))


@dataclass
class Network:
    """Weights.  Arrays of gates have 4 x CELLS rows: input, forget, output, candidate.

    The squashing function is s(x) = x / (1 + |x|); the three sigmoid gates are (s(x) + 1) / 2.  ``inputs`` is the
    input projection with its bias per class of character.
    """

    inputs: np.ndarray  # [2, 4C, CLASSES]
    recurrent: np.ndarray  # [2, 4C, C]
    emit: np.ndarray  # [2, LABELS, C]
    bias: np.ndarray  # [LABELS]
    enter: np.ndarray  # [KINDS] from none to a kind
    stay: np.ndarray  # [KINDS]
    leave: np.ndarray  # [LABELS] to none, from each label

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng, c = np.random.default_rng(seed), CELLS
        inputs = rng.normal(0, 0.3, (2, 4 * c, CLASSES))
        inputs[:, c : 2 * c] += 1.0  # remember at first
        arrays = (
            inputs,
            rng.normal(0, 0.25, (2, 4 * c, c)),
            rng.normal(0, 0.3, (2, LABELS, c)),
            np.array([1.0, 0, 0, 0, 0]),
            np.full(len(KINDS), -1.0),
            np.full(len(KINDS), 1.0),
            np.array([0.5, -1, -1, -1, -1]),
        )
        return Network(*(array.astype(np.float32) for array in arrays))

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.emit, self.bias, self.enter, self.stay, self.leave]

    def step(self, direction: int, ids: np.ndarray, h: np.ndarray, c: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """One character of every window: changes h and c, leaves the gates in ``gates``, returns the squashed c."""
        size = CELLS
        np.take(self.inputs[direction], ids, axis=1, out=gates, mode="clip")
        gates += self.recurrent[direction] @ h
        _squash(gates)
        sigmoids = gates[: 3 * size]
        sigmoids += 1
        sigmoids *= 0.5
        c *= gates[size : 2 * size]
        c += gates[:size] * gates[3 * size :]
        squashed = c.copy()
        _squash(squashed)
        np.multiply(gates[2 * size : 3 * size], squashed, out=h)
        return squashed

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """[length, LABELS, windows] for ids [length, windows]."""
        length, width = ids.shape
        out = np.empty((length, LABELS, width), dtype=np.float32)
        gates = np.empty((4 * CELLS, width), dtype=np.float32)
        for direction, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
            h, c = np.zeros((CELLS, width), np.float32), np.zeros((CELLS, width), np.float32)
            for t in order:
                self.step(direction, ids[t], h, c, gates)
                if direction:
                    out[t] += self.emit[1] @ h
                else:
                    np.matmul(self.emit[0], h, out=out[t])
        out += self.bias[:, None]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best labels of each window [length, windows] by Viterbi's algorithm."""
        scores = self.emissions(ids)
        length, _, width = scores.shape
        stayed = np.empty((length, len(KINDS), width), dtype=bool)
        came = np.zeros((length, width), dtype=np.uint8)
        best = scores[0].copy()
        enter, stay, leave = self.enter[:, None], self.stay[:, None], self.leave[:, None]
        for t in range(1, length):
            none = best + leave
            inside, outside = best[1:] + stay, best[0] + enter
            np.greater(inside, outside, out=stayed[t])
            top = none[0].copy()
            for label in range(1, LABELS):
                better = none[label] > top
                if better.any():
                    came[t][better] = label
                    np.maximum(top, none[label], out=top)
            best[1:] = np.maximum(inside, outside)
            best[0] = top
            best += scores[t]
        labels = np.empty((length, width), dtype=np.uint8)
        now = best.argmax(axis=0)
        columns = np.arange(width)
        for t in range(length - 1, -1, -1):
            labels[t] = now
            if t:
                inside = now > 0
                kept = stayed[t, np.maximum(now, 1) - 1, columns]
                now = np.where(inside, np.where(kept, now, 0), came[t])
        return labels


# -- training ------------------------------------------------------------------------------------


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(values - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf_gradients(scores: np.ndarray, labels: np.ndarray, net: Network):
    """Gradients of the negative log-likelihood per character: of the emissions, and of the transitions."""
    length, _, width = scores.shape
    matrix = np.full((LABELS, LABELS), -1e4)  # [from, to]
    matrix[0, 1:], matrix[:, 0] = net.enter, net.leave
    matrix[np.arange(1, LABELS), np.arange(1, LABELS)] = net.stay
    forth = np.empty(scores.shape)
    forth[0] = scores[0]
    for t in range(1, length):
        forth[t] = scores[t] + _log_sum(forth[t - 1][:, None] + matrix[:, :, None], 0)
    back = np.zeros(scores.shape)
    for t in range(length - 2, -1, -1):
        back[t] = _log_sum(matrix[:, :, None] + (scores[t + 1] + back[t + 1])[None], 1)
    total = _log_sum(forth[-1], 0)
    d_scores = np.exp(forth + back - total)
    columns = np.arange(width)
    for t in range(length):
        d_scores[t, labels[t], columns] -= 1
    pairs = forth[:-1, :, None] + matrix[None, :, :, None] + (scores[1:] + back[1:])[:, None] - total
    d_matrix = np.exp(pairs).sum(axis=(0, 3))
    np.subtract.at(d_matrix, (labels[:-1].ravel(), labels[1:].ravel()), 1)
    scale = 1 / (width * length)
    own = np.arange(1, LABELS)
    transitions = [d_matrix[0, 1:], d_matrix[own, own], d_matrix[:, 0]]
    return (d_scores * scale).astype(np.float32), [(one * scale).astype(np.float32) for one in transitions]


def _gradients(net: Network, ids: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of all arrays by back-propagation through time."""
    length, width = ids.shape
    size = CELLS
    states = []
    scores = np.zeros((length, LABELS, width), dtype=np.float32)
    for direction, order in ((0, list(range(length))), (1, list(range(length - 1, -1, -1)))):
        h, c = np.zeros((size, width), np.float32), np.zeros((size, width), np.float32)
        kept = []
        for t in order:
            before, gates = (h.copy(), c.copy()), np.empty((4 * size, width), dtype=np.float32)
            squashed = net.step(direction, ids[t], h, c, gates)
            kept.append((t, before, gates, squashed, h.copy()))
            scores[t] += net.emit[direction] @ h
        states.append(kept)
    scores += net.bias[:, None]
    d_scores, transitions = _crf_gradients(scores, labels, net)
    d_inputs, d_recurrent, d_emit = np.zeros_like(net.inputs), np.zeros_like(net.recurrent), np.zeros_like(net.emit)
    one_hot = np.zeros((CLASSES, width), dtype=np.float32)
    columns = np.arange(width)
    for direction in (0, 1):
        d_h, d_c = np.zeros((size, width), np.float32), np.zeros((size, width), np.float32)
        for t, (h_before, c_before), gates, squashed, h in reversed(states[direction]):
            d_emit[direction] += d_scores[t] @ h.T
            d_h += net.emit[direction].T @ d_scores[t]
            i, f, o, g = gates[:size], gates[size : 2 * size], gates[2 * size : 3 * size], gates[3 * size :]
            d_c += d_h * o * _slope(squashed)
            d_gates = np.concatenate(
                [
                    d_c * g * _slope(2 * i - 1) / 2,
                    d_c * c_before * _slope(2 * f - 1) / 2,
                    d_h * squashed * _slope(2 * o - 1) / 2,
                    d_c * i * _slope(g),
                ]
            )
            one_hot[:] = 0
            one_hot[ids[t], columns] = 1
            d_inputs[direction] += d_gates @ one_hot.T
            d_recurrent[direction] += d_gates @ h_before.T
            d_h = net.recurrent[direction].T @ d_gates
            d_c = d_c * f
    return [d_inputs, d_recurrent, d_emit, d_scores.sum(axis=(0, 2)), *transitions]


def _example(rng: random.Random, kind: int) -> str:
    """A made-up span of a kind, in the patterns' form or in forms they leave out."""
    word = lambda low, high: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        at = rng.choice(["@", "@", "@", " [at] ", "(at)", " @ "])
        return f"{word(2, 9)}{rng.choice(['.', '_', '', '-'])}{word(1, 8)}{at}{word(3, 9)}.{rng.choice(['com', 'org', 'net', 'example', 'de'])}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        mark = rng.choice(["", " ", "-"])
        return mark.join(digits(4) for _ in range(4))
    form = rng.choice(["+{} {} {} {}", "+{}-{}-{}-{}", "({1}) {2}-{3}", "{1}-{2}-{3}", "+{}{}{}{}"])
    return form.format(rng.randint(1, 99), digits(3), digits(3), digits(4))


def training_windows(texts: list[str], windows: int = TRAINING_WINDOWS, seed: int = 11):
    """ids and labels [length, windows] cut around labelled spans of real and made-up text.

    The labels of real text are the pattern matches.  In a third of the windows a made-up span is put
    between two words, a third are cut around a match, and the others anywhere.
    """
    rng, length = random.Random(seed), TRAINING_LENGTH
    spans = [(text, base_spans(text)) for text in texts]
    having = [pair for pair in spans if pair[1]]
    ids = np.zeros((length, windows), dtype=np.uint8)
    labels = np.zeros((length, windows), dtype=np.int64)
    for column in range(windows):
        text, found = rng.choice(having if having and column % 3 == 1 else spans) if spans else ("", [])
        centre = rng.choice(found)[0] if found and column % 3 == 1 else rng.randint(0, max(0, len(text) - 1))
        start = max(0, centre - rng.randint(0, length - 20))
        part = text[start : start + length]
        own = [(s - start, k, e - start) for s, k, e in found if s < start + length and e > start]
        if column % 3 == 0:
            kind = rng.randrange(len(KINDS))
            made = _example(rng, kind)
            at = part.rfind(" ", 0, rng.randint(1, max(2, len(part)))) + 1
            own = [(s, k, e) for s, k, e in own if e <= at] + [
                (s + len(made) + 1, k, e + len(made) + 1) for s, k, e in own if s >= at
            ]
            if not any(s < at < e for s, _, e in own):
                part = f"{part[:at]}{made} {part[at:]}"
                own.append((at, kind, at + len(made)))
        part = part[:length]
        ids[: len(part), column] = classes_of(part)
        for s, k, e in own:
            labels[max(0, s) : max(0, min(e, len(part))), column] = k + 1
    return ids, labels


def train(texts: list[str], steps: int = TRAINING_STEPS, seed: int = 3) -> Network:
    """Train on a bounded number of windows with Adam; the same texts give the same network."""
    ids, labels = training_windows(texts)
    net, rng = Network.fresh(), np.random.default_rng(seed)
    means = [np.zeros_like(array) for array in net.arrays()]
    squares = [np.zeros_like(array) for array in net.arrays()]
    for step in range(1, steps + 1):
        some = rng.choice(ids.shape[1], min(TRAINING_ROWS, ids.shape[1]), replace=False)
        rate = 0.03 * min(1.0, 2 * (1 - (step - 1) / steps))
        for array, gradient, mean, square in zip(
            net.arrays(), _gradients(net, ids[:, some], labels[:, some]), means, squares
        ):
            gradient = np.clip(gradient, -0.1, 0.1)
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            array -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return net


# -- whole texts ----------------------------------------------------------------------------------


def label_texts(net: Network, texts: list[str]) -> list[np.ndarray]:
    """A label for each character of each text.

    Texts are cut into windows that overlap; windows of like length run together.  Each window is decoded
    alone, then the text takes each character's label from the window in which it lies farther from
    the edge: windows meet in the middle of what they share, and spans are read from the whole text.
    """
    stride, margin = WINDOW - OVERLAP, OVERLAP // 2
    codes = [classes_of(text) for text in texts]
    labels = [np.zeros(len(code), dtype=np.uint8) for code in codes]
    places = []
    for number, code in enumerate(codes):
        if len(code):
            places.extend((number, at) for at in range(0, max(1, len(code) - OVERLAP), stride))
    sizes = np.array([min(WINDOW, len(codes[number]) - at) for number, at in places], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    for low in range(0, len(order), AT_ONCE):
        chosen = order[low : low + AT_ONCE]
        ids = np.zeros((len(chosen), int(sizes[chosen[0]])), dtype=np.uint8)
        for row, place in enumerate(chosen.tolist()):
            number, at = places[place]
            part = codes[number][at : at + WINDOW]
            ids[row, : len(part)] = part
        found = net.decode(np.ascontiguousarray(ids.T)).T
        for row, place in enumerate(chosen.tolist()):
            number, at = places[place]
            size = int(sizes[place])
            first = margin if at else 0
            last = size if at + size == len(codes[number]) else size - margin
            labels[number][at + first : at + last] = found[row, first:last]
    return labels


_LEAST_DIGITS = (0, 4, 12, 7)


def _plausible(kind: int, part: str) -> bool:
    """Whether an added span can be one of its kind: an at sign of some form, or enough digits and no letters."""
    if kind == 0:
        return len(part) >= 6 and "." in part and ("@" in part or "(at)" in part or "[at]" in part)
    return sum("0" <= c <= "9" for c in part) >= _LEAST_DIGITS[kind] and not any(c.isalpha() for c in part)


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the labels that touch no pattern match, without outer white space and closing marks."""
    if not labels.any():
        return []
    edges = np.flatnonzero(np.diff(labels)) + 1
    found = []
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(labels)]):
        kind = int(labels[start]) - 1
        if kind < 0:
            continue
        part = text[start:end]
        start += len(part) - len(part.lstrip())
        part = part.strip().rstrip(".,;:!?")
        end = start + len(part)
        if _plausible(kind, part) and not any(s < end and start < e for s, _, e in base):
            found.append((start, kind, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"


def _find(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, list[str]]] = []
        size = 0

        def give() -> pa.RecordBatch:
            listed = [text for _, part in held for text in part]
            labels = label_texts(net, listed)
            counts: list[list[int]] = [[] for _ in KINDS]
            base_out, spans_out, added_out = [], [], []
            for text, own in zip(listed, labels):
                base = base_spans(text)
                for kind, column in enumerate(counts):
                    column.append(sum(span[1] == kind for span in base))
                more = added_spans(text, own, base)
                base_out.append(joined(base))
                spans_out.append(joined(sorted(base + more)))
                added_out.append(len(more))
            columns = [
                pa.concat_arrays([ids for ids, _ in held]),
                *(pa.array(column, pa.int64()) for column in counts),
                pa.array(base_out, pa.string()),
                pa.array(spans_out, pa.string()),
                pa.array(added_out, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[name.split()[0] for name in _FOUND.split(", ")])

        for batch in batches:
            part = [text or "" for text in batch.column("text").to_pylist()]
            held.append((batch.column("doc_id"), part))
            size += sum(map(len, part))
            if size >= 4 * AT_ONCE * WINDOW:
                yield give()
                held, size = [], 0
        if held:
            yield give()

    return run


def training_texts(documents: DataFrame, limit: int = TRAINING_DOCUMENTS) -> list[str]:
    """Texts to train on: at most ``limit``, half of them with an @ or digits, by the hash of doc_id.

    Long texts are cut to the part that windows are taken from: 20,000 characters around their middle.
    """
    marked = F.contains(F.col("text"), F.lit("@")) | F.col("text").rlike("[0-9]{3}")
    part = F.expr("substring(text, greatest(1, cast(length(text) / 2 as int) - 10000), 20000)")
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    narrow, chosen = rows.select("doc_id", marked.alias("marked")), []
    for wanted in (True, False):
        # Ids first: every task would send its first texts to the driver otherwise.
        first = narrow.where(F.col("marked") == wanted).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2)
        ids = [row["doc_id"] for row in first.collect()]
        texts = rows.where(F.col("doc_id").isin(ids)).select(part.alias("text")).limit(limit // 2)
        chosen.extend(row["text"] for row in texts.collect())
    return chosen


def personal_data(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added.

    ``base`` lists the pattern matches as kind:start:end in code points, ``spans`` those and the spans that the
    network adds.  The counts are of pattern matches.  A null text is the empty text, which has no
    spans; null ids are kept; repeated rows are searched each; an empty table gives no rows.  A text of
    any length is searched whole, window by window.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_find(net or train(training_texts(rows))), _FOUND)


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
        "n_added",
    )
