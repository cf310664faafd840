"""Texts in chunks that byte-level BPE encodes one by one, with a bounded memory of them.

A chunk starts at every space that a character other than white space follows. No match of
the pre-tokenizer's pattern crosses such a place, so the code of a text is the codes of its
chunks in order; natural text has few different chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_START = re.compile(r"(?= \S)")


# Characters of a chunk that is remembered; longer ones hardly come back.
LONGEST = 64


class _WhiteSpace(Exception):
    """A space that white space follows, which starts no chunk."""


class _Codes(dict):
    """Chunk without its leading space -> code."""

    def __init__(self, encode: Callable[[str], bytes], room: int):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _WhiteSpace
        code = self.encode(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.room:
                self.clear()
            self[chunk] = code
        return code


class ChunkMemory:
    """The code of a text from a function that encodes a chunk; emptied beyond ``room`` chunks.

    Chunks beyond LONGEST are encoded each time, so ``room`` bounds the bytes held, too.
    """

    def __init__(self, encode: Callable[[str], bytes], room: int = 700_000):
        self.encode, self.codes = encode, _Codes(encode, room)

    def code(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            found = b"".join(map(self.codes.__getitem__, rest))
        except _WhiteSpace:
            first, *rest = _START.split(text)
            found = b"".join([self.codes[part[1:]] for part in rest])
        return self.encode(first) + found
