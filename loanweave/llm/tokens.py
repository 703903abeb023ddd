"""Token ids of whole texts, from a tokenizer file that the `tokenizers` library reads.

The tokenizer is asked once for each distinct piece that a worker meets; pieces are cut where
the tokenizer's own first step always cuts, so the ids are those of the whole text:

* `spaced` (byte-level BPE whose pieces start with their space): before a single space;
* `dropped` (white space never reaches the model): at ASCII white space.

Texts in which such a cut could fall inside a run of white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

SPACED, DROPPED = "spaced", "dropped"
# Fixed value: white space in Unicode beyond ASCII.
OTHER_SPACE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# A run of white space in which a space has white space on both sides, or ends the text.
_RUN = re.compile("[\t-\r ] [\t-\r ]|  $")
_RUN_MAY_BE = tuple(" " + c for c in " \t\n\x0b\x0c\r")
END = None
MAX_PIECES = 1_200_000
MAX_CHARS = 24 << 20


class _Index(dict):
    """Piece to its number; a piece not met before is noted for encoding."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class Encoder:
    """Encodes texts; keeps the ids of at most about MAX_PIECES pieces between calls."""

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.style = style
        self._forget()

    def _forget(self) -> None:
        # Number 0 is the end of a text.
        self.index = _Index()
        self.index[END] = 0
        self.chars = 0
        self.start = np.zeros(1, np.int32)
        self.length = np.ones(1, np.int32)
        self.pool = np.zeros(1, np.uint32)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        if self.style == SPACED:
            new = [" " + w if type(w) is str else w[0] for w in new]
        self.chars += sum(map(len, new))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int32, len(found))
        total = int(length.sum())
        start = (np.cumsum(length) - length + len(self.pool)).astype(np.int32)
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32, total)])
        self.start = np.concatenate([self.start, start])
        self.length = np.concatenate([self.length, length])

    def _pieces(self, text: str) -> list:
        """Keys of the pieces; in spaced style a plain word stands for itself with a space
        before it, a tuple for its text alone."""
        if self.style == DROPPED:
            for c in "\t\n\x0b\x0c\r":
                if c in text:
                    text = text.replace(c, " ")
            return text.split(" ")
        if any(map(text.__contains__, _RUN_MAY_BE)) and _RUN.search(text):
            return [(text,)]
        if not text.isascii() and any(map(text.__contains__, OTHER_SPACE)):
            return [(text,)]
        pieces = text.split(" ")
        pieces[0] = (pieces[0],)
        return pieces

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids before each text."""
        if len(self.index) > MAX_PIECES or self.chars > MAX_CHARS:
            self._forget()
        found, counts = [], np.zeros(len(texts) + 1, np.int64)
        get = self.index.__getitem__
        for i, text in enumerate(texts):
            pieces = self._pieces(text)
            pieces.append(END)
            counts[i + 1] = len(pieces)
            found.append(np.fromiter(map(get, pieces), np.int32, len(pieces)))
        self._learn()
        at = np.concatenate(found) if found else np.zeros(0, np.int32)
        self.length[0] = end_id is not None
        self.pool[0] = end_id or 0
        length = self.length[at]
        done = np.concatenate([[0], np.cumsum(length)])
        if done[-1] < 2**31:
            done = done.astype(np.int32)
        take = np.repeat(self.start[at] - done[:-1], length)
        take += np.arange(done[-1], dtype=done.dtype)
        return self.pool[take], done[np.cumsum(counts)].astype(np.int64)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """The encoder of this worker process."""
    if (path, style) not in _encoders:
        _encoders[path, style] = Encoder(path, style)
    return _encoders[path, style]
