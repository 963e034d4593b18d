"""Token ids of many texts with a public tokenizer, each distinct piece encoded once.

Both vocabularies split a text into pieces before they merge, and never across the start of a run of white space
that follows something else. So a batch of texts is cut there into chunks, and a chunk is cut further, where that is safe
(plain Latin letters, digits and punctuation without an apostrophe, and no special token's string), wherever the kind of its
characters changes. The distinct pieces of a batch are encoded by the tokenizers library once and then looked up. What
can't be cut safely is encoded whole. Results equal encoding the whole text; the tests check this against the library.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import SPACE, buffers, ragged

KEPT = 250_000  # pieces remembered by a worker; others are encoded again when they come up
CHUNK = 4 << 20  # bytes of text looked at together
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
# what is one piece to the vocabulary itself
_ONE = {
    # byte-level vocabulary: a leading space belongs to the piece
    "byte": re.compile(f" ?[{_LETTER}]+| ?[0-9]+| ?[!-&(-/:-@\\[-`{{-~]+|[ \n]"),
    # vocabulary with word ends: white space is dropped, digits are single, letters are lower case
    "word": re.compile(f"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{{-~]+"),
}
# kinds of bytes: 0 not safe, 1 letters, 2 digits, 3 punctuation, 4 space, 5 line feed
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[39] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[32], _KIND[10] = 4, 5


_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def white_tails(data: np.ndarray) -> np.ndarray:
    """True at the last byte of white space beyond ASCII."""
    out = np.zeros(len(data), bool)
    lead = np.flatnonzero(_LEAD[data])
    if not len(lead):
        return out
    pad = np.concatenate((data, np.zeros(2, np.uint8)))
    a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    out[lead[two] + 1] = True
    out[lead[three] + 2] = True
    return out


class Encoder:
    """One tokenizer file in one worker, with the ids of the pieces seen so far."""

    def __init__(self, path: str, kind: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.one, self.word = Tokenizer.from_file(path), _ONE[kind].fullmatch, kind == "word"
        # strings of special tokens in a text: ordinary text, or the special ids, as the library gives them by default
        self.tok.encode_special_tokens = plain_specials
        self.special = [] if plain_specials else [re.compile(re.escape(t.content.encode())) for t in self.tok.get_added_tokens_decoder().values()]
        self.tok.no_padding()
        self.tok.no_truncation()
        self.letters = dict(enumerate(_byte_letters()))
        self.piece: dict[bytes, int] = {}  # number of a piece
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = array("q"), array("q")  # where the ids of a piece are, by number

    def _store(self, flat: np.ndarray, n: np.ndarray) -> int:
        """Keeps new lists of ids; the number of the first."""
        k = len(self.at)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used:self.used + len(flat)] = flat
        self.at.frombytes((self.used + np.cumsum(n) - n).tobytes())
        self.size.frombytes(n.astype(np.int64).tobytes())
        self.used += len(flat)
        return k

    def _merged(self, piece: bytes) -> list[int]:
        """Ids of a piece; what is one piece to the vocabulary too needs its merges alone."""
        p = piece.decode()
        if self.one(p):
            return [t.id for t in self.tok.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        return self.tok.encode(p, add_special_tokens=False).ids

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece, new ones encoded."""
        if len(self.piece) > KEPT:  # start anew: bounded memory, same ids
            self.piece.clear()
            self.at, self.size, self.used = array("q"), array("q"), 0
        new = [p for p in pieces if p not in self.piece]
        if new:
            lists = list(map(self._merged, new))
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            k = self._store(np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n)
            self.piece.update(zip(new, range(k, k + len(new))))
        return np.fromiter(map(self.piece.__getitem__, pieces), np.int64, len(pieces))

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin; and the bytes, in lower case where the vocabulary has no other and chunks are safe."""
        kind, space = _KIND[data], SPACE[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1] & ~white_tails(data)[:-1]
        cut[off[:-1][off[:-1] < len(data)]] = True
        chunk = np.flatnonzero(cut)
        unsafe = (kind == 0) | (space & ~cut)
        raw = data.tobytes() if self.special else b""
        for s in self.special:
            unsafe[[m.start() for m in s.finditer(raw)]] = True
        safe = np.repeat(~np.logical_or.reduceat(unsafe, chunk), np.diff(np.append(chunk, len(data))))
        change = kind[1:] != kind[:-1]
        if not self.word:
            cut[1:] |= change & (data[:-1] != 32) & safe[1:]
            return np.flatnonzero(cut), data
        cut[1:] |= (change | (kind[1:] == 2)) & safe[1:]
        upper = safe & (data >= 65) & (data <= 90)
        upper[lead + 1] |= safe[lead + 1] & (data[lead + 1] <= 0x9E)
        return np.flatnonzero(cut), data + (upper.view(np.uint8) << np.uint8(5))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts among them; null reads as empty."""
        data, off = buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        begin, data = self._cuts(data, off)
        at = np.searchsorted(begin, off)  # pieces of each text
        begin = np.append(begin, len(data))
        coded = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        raw = buffers(coded.dictionary)
        text, edge = raw[0].tobytes(), raw[1].tolist()
        number = self._numbers([text[x:y] for x, y in zip(edge, edge[1:])])
        index = coded.indices.to_numpy()
        size = np.frombuffer(self.size, np.int64)[number][index]
        out = self.ids[ragged(np.frombuffer(self.at, np.int64)[number][index], size)]
        return out, np.concatenate(([0], np.cumsum(size)))[at]


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the byte-level vocabulary: itself where it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


@lru_cache(maxsize=1)
def encoder(path: str, kind: str, plain_specials: bool = False) -> Encoder:
    return Encoder(path, kind, plain_specials)


def sliced(texts: pa.Array, limit: int = CHUNK):
    """Stretches (from, to) of an array of texts with about ``limit`` bytes each, or one text."""
    size = np.diff(buffers(texts)[1])
    part = np.cumsum(size) // limit
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(size)])) if len(size) else [0]
    return list(zip(cut[:-1], cut[1:]))


def regrouped(batches, column: str, limit: int = CHUNK):
    """Record batches joined into ones with about ``limit`` bytes of text, so that distinct pieces are met once."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        for x, y in sliced(b.column(column), limit):
            held.append(b.slice(x, y - x))
            size += int(buffers(held[-1].column(column))[1][-1])
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
