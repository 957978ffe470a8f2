"""Elias-Fano sequences over memory-mapped bytes, asked for many values at once."""

from __future__ import annotations

import json

import numpy as np

#: Lower bits are fewer than the bits of a word, so two words next to each other hold those of any value.
_MOST_LOW = 57


def _place_of_bit() -> np.ndarray:
    """[byte, j]: the place of the j-th set bit of a byte."""
    places = np.zeros((256, 8), dtype=np.uint8)
    for byte in range(256):
        found = [bit for bit in range(8) if byte >> bit & 1]
        places[byte, : len(found)] = found
    return places


_PLACE = _place_of_bit()
#: Every byte of a word: its lowest bit, its highest one, and every other, second or fourth bit of the word.
_LOWEST, _HIGHEST = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_ONE, _TWO, _FOUR = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _place_in_word(words: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the which-th (from 0) set bits of words of 64 bits, which have that many."""
    which = which.astype(np.uint64)
    sums = words - ((words >> np.uint64(1)) & _ONE)
    sums = (sums & _TWO) + ((sums >> np.uint64(2)) & _TWO)
    # Each byte gets the number of bits set in it and in the bytes below.
    sums = ((sums + (sums >> np.uint64(4))) & _FOUR) * _LOWEST
    # The bit is in the first byte whose number is greater: the others keep their highest bit in this difference.
    byte = ((((which * _LOWEST) | _HIGHEST) - sums) & _HIGHEST) >> np.uint64(7)
    at = ((byte * _LOWEST) >> np.uint64(56)) << np.uint64(3)
    left = which - (((sums << np.uint64(8)) >> at) & np.uint64(255))
    return at.astype(np.int64) + _PLACE[(words >> at) & np.uint64(255), left]


def encode(values: np.ndarray, universe: int) -> tuple[dict, list[np.ndarray]]:
    """An ascending sequence of integers below ``universe``: its header and arrays of bytes.

    The lower bits of each value are packed one after the other; the upper parts are written in unary:
    bit (upper part + index) is set for each value.  Every 64 bits the number of set bits so far is noted.
    """
    n = len(values)
    values = values.astype(np.uint64, copy=False)
    low_bits = min(_MOST_LOW, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
    upper = (values >> np.uint64(low_bits)).astype(np.int64)
    size = n + (int(universe) >> low_bits) + 2
    flags = np.zeros(-(-size // 64) * 64, dtype=bool)
    flags[upper + np.arange(n)] = True
    unary = np.packbits(flags, bitorder="little")
    ranks = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(axis=1))]).astype("<u4")
    lower = np.zeros(0, dtype=np.uint8)
    if low_bits and n:
        bits = np.empty((n, low_bits), dtype=bool)
        for bit in range(low_bits):
            bits[:, bit] = (values >> np.uint64(bit)) & np.uint64(1)
        lower = np.packbits(bits.reshape(-1), bitorder="little")
    lower = np.concatenate([lower, np.zeros(8 + -len(lower) % 8, dtype=np.uint8)])
    return {"n": n, "low_bits": low_bits, "universe": int(universe)}, [unary, ranks.view(np.uint8), lower]


class EliasFano:
    """A sequence read in place: nothing is unpacked but what a question needs."""

    def __init__(self, header: dict, arrays: list[np.ndarray]):
        self.n, self._low_bits, self.universe = header["n"], header["low_bits"], header["universe"]
        unary, ranks, lower = arrays
        self._words, self._lower = unary.view("<u8"), lower.view("<u8")
        self._ones = ranks.view("<u4").astype(np.int64)
        self._zeros = np.arange(len(self._ones), dtype=np.int64) * 64 - self._ones

    def _select(self, which: np.ndarray, ones: bool) -> np.ndarray:
        """Bit positions of the which-th (from 0) set or clear bits."""
        counts = self._ones if ones else self._zeros
        word = np.searchsorted(counts, which, side="right") - 1
        left = which - counts[word]
        held = self._words[word]
        if not ones:
            held = ~held
        return word * 64 + _place_in_word(held, left)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self._low_bits:
            return np.zeros(len(index), dtype=np.uint64)
        bit = index * self._low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        mask = np.uint64((1 << self._low_bits) - 1)
        # Shifted by one bit first, as a shift by 64 is none.
        above = (self._lower[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return ((self._lower[word] >> shift) | above) & mask

    def values(self, index: np.ndarray) -> np.ndarray:
        """The values at some indices."""
        if not len(index):
            return np.zeros(0, dtype=np.uint64)
        upper = self._select(index, True) - index
        return (upper.astype(np.uint64) << np.uint64(self._low_bits)) | self._low(index)

    def successors(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value asked for: the index of the first value not below it, and whether they are equal."""
        if not len(asked) or not self.n:
            return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
        asked = asked.astype(np.uint64, copy=False)
        beyond = asked > np.uint64(self.universe - 1)
        upper = (np.where(beyond, np.uint64(0), asked) >> np.uint64(self._low_bits)).astype(np.int64)
        low = asked & np.uint64((1 << self._low_bits) - 1)
        # Values with this upper part lie between two clear bits of the unary part.
        end = self._select(upper, False) - upper
        start = np.zeros(len(asked), dtype=np.int64)
        inner = upper > 0
        start[inner] = self._select(upper[inner] - 1, False) - (upper[inner] - 1)
        high = end.copy()
        active = np.flatnonzero(start < high)
        while len(active):
            middle = (start[active] + high[active]) >> 1
            below = self._low(middle) < low[active]
            start[active] = np.where(below, middle + 1, start[active])
            high[active] = np.where(below, high[active], middle)
            active = active[start[active] < high[active]]
        equal = (start < end) & ~beyond
        some = np.flatnonzero(equal)
        equal[some] = self._low(start[some]) == low[some]
        return np.where(beyond, self.n, start), equal


# -- several arrays in one file ------------------------------------------------------------------


def to_bytes(header: dict, arrays: dict[str, np.ndarray], sequences: dict[str, tuple[dict, list[np.ndarray]]]) -> bytes:
    """A file of named arrays and sequences: length of the index, the index as JSON, the arrays, 8-aligned."""
    index, chunks, at = {"header": header, "arrays": {}, "sequences": {}}, [], 0

    def add(array: np.ndarray) -> list[int]:
        nonlocal at
        data = np.ascontiguousarray(array).view(np.uint8).reshape(-1)
        place = [at, len(data)]
        padding = -len(data) % 8
        chunks.extend([data.tobytes(), b"\0" * padding])
        at += len(data) + padding
        return place

    for name, array in arrays.items():
        index["arrays"][name] = [array.dtype.str, *add(array)]
    for name, (inner, parts) in sequences.items():
        index["sequences"][name] = [inner, [add(part) for part in parts]]
    text = json.dumps(index).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *chunks])


def from_bytes(data: np.ndarray) -> tuple[dict, dict[str, np.ndarray], dict[str, EliasFano]]:
    data = data.view(np.ndarray)  # parts of a mapped file are plain arrays
    size = int.from_bytes(bytes(data[:8]), "little")
    index, base = json.loads(bytes(data[8 : 8 + size])), 8 + size

    def part(at: int, length: int) -> np.ndarray:
        return data[base + at : base + at + length]

    arrays = {name: part(at, length).view(kind) for name, (kind, at, length) in index["arrays"].items()}
    sequences = {
        name: EliasFano(inner, [part(*place) for place in places]) for name, (inner, places) in index["sequences"].items()
    }
    return index["header"], arrays, sequences
