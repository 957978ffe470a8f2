"""Digest and counts of an instance that comes block by block.

The same results as the expressions of ``digest``, for contents of any size: what one block
leaves open, a comment or a token, is finished by the next.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

_COMMENT = re.compile(rb"[^0-9\-\x00-\x20][^\r\n]*")
_LINE_END = re.compile(rb"[\r\n]")
_NUMBER = re.compile(rb"-?([0-9]+)\Z")
#: Control characters and blanks are one blank.
_BLANKS = bytes(32 if code <= 32 else code for code in range(256))
#: Bytes of a token that is still open that are held; the rest goes into the digest as it comes.
_HELD = 1 << 16
_LARGEST = (1 << 63) - 1


class TokenDigest:
    """MD5 of the canonical tokens, number of clauses, largest variable; ``update`` takes blocks in order."""

    def __init__(self):
        self._md5, self._first, self._last = hashlib.md5(), True, None
        self._comment, self._open = False, b""
        self._long, self._digits = False, None  # an open token that was partly passed on; its significant digits
        self.bytes = self.clauses = self.variables = 0

    def update(self, block: bytes) -> None:
        self.bytes += len(block)
        if self._comment:
            end = _LINE_END.search(block)
            if end is None:
                return
            block, self._comment = block[end.start() :], False
        tail = block[max(block.rfind(b"\n"), block.rfind(b"\r")) + 1 :]
        self._comment = _COMMENT.search(tail) is not None
        text = _COMMENT.sub(b"", block).translate(_BLANKS)
        if not text:
            return
        tokens = text.split()
        if text[0] == 32:
            self._close()
        else:
            tokens[0] = self._open + tokens[0]
            self._open = b""
            if self._long and (len(tokens) > 1 or text[-1] == 32):
                self._open = tokens.pop(0)
                self._close()
        if tokens and text[-1] != 32:
            self._open = tokens.pop()
        self._take(tokens)
        if len(self._open) > _HELD:
            self._pass_on()

    def _start(self) -> None:
        if not self._first:
            self._md5.update(b" ")
        self._first = False

    def _pass_on(self) -> None:
        """Put what is held of an open token into the digest and keep what it says as a number."""
        first = not self._long
        if first:
            self._start()
        self._md5.update(self._open)
        self._digits = _digits(b"" if first else self._digits, self._open, first)
        self._long, self._open = True, b""

    def _take(self, tokens: list[bytes]) -> None:
        if tokens:
            self._start()
            self._md5.update(b" ".join(tokens))
            self._last = tokens[-1]
            self.clauses += tokens.count(b"0")
            self.variables = max(self.variables, _largest(tokens))

    def _close(self) -> None:
        if self._long:
            self._md5.update(self._open)
            digits = _digits(self._digits, self._open)
            if digits is not None and len(digits) <= 19 and int(digits or b"0") <= _LARGEST:
                self.variables = max(self.variables, int(digits or b"0"))
            self._last, self._long, self._open = b"", False, b""
        elif self._open:
            token, self._open = self._open, b""
            self._take([token])

    def finish(self) -> str:
        """The digest; without it the last clause would stay open."""
        self._close()
        if self._last is not None and self._last != b"0":
            self._take([b"0"])
        return self._md5.hexdigest()


def _digits(known: bytes | None, part: bytes, first: bool = False) -> bytes | None:
    """The significant digits of a number that goes on with a part, 20 at most; None if it is no number."""
    if first and part[:1] == b"-":
        part = part[1:]
    if known is None or not (part.isdigit() or not part):
        return None
    return (known + part)[:20] if known else part.lstrip(b"0")[:20]


def _largest(tokens: list[bytes]) -> int:
    """The largest absolute value of the tokens that are 64-bit numbers."""
    if max(map(len, tokens)) <= 18:
        try:
            return int(np.abs(np.array(tokens).astype(np.int64)).max())
        except ValueError:
            pass
    digits = (found[1].lstrip(b"0") for token in tokens if (found := _NUMBER.match(token)))
    sizes = (int(each or b"0") for each in digits if len(each) <= 19)
    return max((size for size in sizes if size <= _LARGEST), default=0)
