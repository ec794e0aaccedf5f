"""Token ids of many texts by a byte-level BPE of the tokenizers library; parts met again aren't encoded again.

Defined results: a null or empty text has no ids. A text of any length is encoded whole; what is remembered is bounded by
bytes, and parts of more than 64 characters are not.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from sufloom.llm.common import Remembered, held

# The parts that a byte-level BPE of this kind encodes one by one, over the characters that _OTHER leaves.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PARTS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
# Texts with other characters than ASCII, Latin letters and common marks are left to the library, as are numerals that
# are no digits, and separators that languages' regular expressions count differently.
_OTHER = re.compile("[\x1c-\x1f\x80-\xa0²³¹¼½¾]|[^\x00-ɏ‐-‧‰-⁞€]")
_PROBE = "It's 3 words,  well -- 'll über\n\n\tœuvre: x_1 I've…\n"


class SegmentEncoder:
    """Encodes texts as tokenizers.Tokenizer.encode(text, add_special_tokens=False) does.

    A byte-level BPE splits a text into parts (words with the space before them, numbers, marks, white space) and encodes
    each apart. The parts' ids come from the library's own pre-tokenizer and model and are remembered, up to `most` bytes.
    Texts in which an added token's string or an unusual character occurs are encoded whole by the library, and so are
    all if its parts are others than expected here.
    """

    def __init__(self, path: str, most: int = 60 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._added = [str(t.content) for t in self._own.get_added_tokens_decoder().values()]
        self._split, self._model = self._own.pre_tokenizer.pre_tokenize_str, self._own.model.tokenize
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are written as this machine's unsigned integers, which must be little-endian with 32 bits")
        self._usual = [_PROBE[a:b] for _, (a, b) in self._split(_PROBE)] == _PARTS.findall(_PROBE) and self._own.normalizer is None
        # How the pre-tokenizer writes the bytes of a letter, as seen on one letter with each byte; other parts are left to it.
        self._spelt = {}
        for c in map(chr, [*range(32, 127), *range(0xC0, 0x250)]) if self._usual else ():
            written = "".join([x for x, _ in self._split(c)])
            self._spelt |= dict(zip(c.encode(), written)) if len(written) == len(c.encode()) else {}
        self._parts = Remembered(self._part, most)

    def _part(self, part: str) -> bytes:
        known = self._spelt
        try:
            spelt = ["".join([known[b] for b in part.encode()])]
        except KeyError:
            spelt = [x for x, _ in self._split(part)]
        return b"".join([array("I", [t.id for t in self._model(x)]).tobytes() for x in spelt])

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for a null or empty text."""
        if not text:
            return b""
        if self._usual and not any(a in text for a in self._added) and not _OTHER.search(text):
            return b"".join(map(self._parts.__getitem__, _PARTS.findall(text)))
        return np.array(self._own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each Python process, so that later tasks find the words of earlier ones."""
    return held(("encoder", path), lambda: SegmentEncoder(path))
