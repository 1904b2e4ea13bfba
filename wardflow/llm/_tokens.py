"""Token ids of whole texts by a public word-BPE tokenizer.

The tokenizer drops white space and never joins what white space parts, so
the ids of a text are the ids of its chunks one after another. Chunks repeat:
each distinct chunk of a batch (by a 64-bit hash) is encoded once, and a
bounded table in the Python worker remembers chunks between batches. ASCII
letters are lower-cased first, as the tokenizer does itself. A chunk is also
cut between an ASCII letter and a punctuation mark, where the tokenizer always
cuts. A chunk that holds the literal of an added token (``<|endoftext|>``) is
neither cut nor put in small letters: the tokenizer gets it as it stands, and
decides. Tests hold the ids against the tokenizer on whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from wardflow.llm import _arrays as A

EOS = 1
_BLANK = np.ones(256, dtype=bool)
_BLANK[[32, 9, 10, 13]] = False  # true where a chunk goes on
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,!?;:|%#*$&"]] = True
_RAW = A.U64(0x5851F42D4C957F2D)  # parts the hashes of raw chunks from those of others
#: Letters that are their own normal form and one character in either case,
#: then marks that no contraction starts with.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([.,!?;:|%#*$&]*)")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks:
    """The chunks that a worker remembers: an open-addressed table from hashes
    to runs of a pool of ids. When it is 60 % full, it starts anew, so its
    size is bounded."""

    SLOTS = 1 << 21

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, A.U64)
        self.heads = np.zeros(self.SLOTS, np.int32)
        self.counts = np.zeros(self.SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, self.dtype)
        self.used = self.full = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> A.U64(64 - 21)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        slot = self._slot(h)
        out = np.full(len(h), -1, np.int64)
        live = np.arange(len(h))
        while len(live):
            key = self.keys[slot]
            here = key == h[live]
            out[live[here]] = slot[here]
            on = ~here & (key != 0)
            live, slot = live[on], (slot[on] + 1) % self.SLOTS
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct hashes that are not here yet, with their runs of ids."""
        if self.full + len(h) > 0.6 * self.SLOTS or self.used + len(ids) > 1 << 24:
            self.clear()
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        heads = self.used + np.cumsum(counts) - counts
        self.pool[self.used: self.used + len(ids)] = ids
        self.used += len(ids)
        self.full += len(h)
        slot, live = self._slot(h), np.arange(len(h))
        while len(live):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[live[free]]
            won = self.keys[slot] == h[live]
            self.heads[slot[won]], self.counts[slot[won]] = heads[live[won]], counts[live[won]]
            live, slot = live[~won], (slot[~won] + 1) % self.SLOTS


class Encoder:
    """One tokenizer in a Python worker, with the chunks it remembers."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.chunks = Chunks(self.dtype)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _spell(self, text: str) -> str:
        return text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))

    def _encode(self, chunks: list[str], raw: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and the count of each. Plain
        words go straight to the BPE model, but for ``raw`` chunks."""
        out: list = [()] * len(chunks)
        hard, tokenize, plain, spell = [], self.model.tokenize, _PLAIN.fullmatch, self._spell
        for i, c in enumerate(chunks):
            if raw[i]:
                hard.append(i)
            elif c.isalpha() and c.isascii():
                out[i] = [t.id for t in tokenize(c)]
            elif (m := plain(c)) is None or "÷" in c:
                hard.append(i)
            else:
                out[i] = [t.id for part in m.groups() if part for t in tokenize(spell(part))]
        if hard:
            for i, e in zip(hard, self.tokenizer.encode_batch(
                    [chunks[i] for i in hard], add_special_tokens=False), strict=True):
                out[i] = e.ids
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), self.dtype, int(counts.sum())), counts

    def texts(self, column: pa.Array, end: int | None = EOS) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by ``end``, and
        their offsets."""
        buf, offsets = A.utf8(column)
        low, starts, ends, raw = _cut(buf, offsets, self.literals)
        first = np.searchsorted(starts, offsets)
        h = A.hash_words(low, starts, ends)
        h[raw] = A.mix(A.hash_words(buf, starts[raw], ends[raw]) ^ _RAW)
        h = np.maximum(h, A.U64(1))
        table = self.chunks
        slot = table.find(h)
        lost = np.flatnonzero(slot < 0)
        fresh = flat = counts = heads = None
        if len(lost):
            keys, at, back = np.unique(h[lost], return_index=True, return_inverse=True)
            s, e, r = starts[lost[at]].tolist(), ends[lost[at]].tolist(), raw[lost[at]].tolist()
            small = low.tobytes()
            flat, counts = self._encode([(buf[a:b].tobytes() if x else small[a:b]).decode()
                                         for a, b, x in zip(s, e, r, strict=True)], r)
            heads, fresh = np.cumsum(counts) - counts, back
        size, head = table.counts[slot].astype(np.int64), table.heads[slot].astype(np.int64)
        pool = table.pool
        if fresh is not None:  # ids of new chunks follow the pool's
            size[lost], head[lost] = counts[fresh], heads[fresh] + len(pool)
            pool = np.concatenate([pool, flat])
            table.add(keys, flat, counts)
        # Each id of the result: its place in the pool.
        before = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(head - before[:-1], size) + np.arange(before[-1])
        tokens = pool[place]
        before = before[first]
        if end is None:
            return tokens, before
        return np.insert(tokens, before[1:], self.dtype.type(end)), before + np.arange(len(before))


def _cut(buf: np.ndarray, offsets: np.ndarray, literals: list[bytes]
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in small letters, the starts and ends of all chunks, and
    whether a chunk holds a literal (in letters of either case)."""
    low = A.LOWER[buf]
    if len(low) < 2:
        starts, ends, _ = A.runs(_BLANK[low], offsets)
        return low, starts, ends, _holding(low, starts, ends, literals)
    lead = low[:-1] == 0xC3
    tail = low[1:]
    latin = lead & (tail != 0x97) & (tail != 0xB7)  # letters from U+00C0 to U+00FF
    low[1:][latin & (tail <= 0x9E)] += 32
    starts, ends, _ = A.runs(_BLANK[low], offsets)
    held = _holding(low, starts, ends, literals)
    letter = _ALPHA[low[:-1]]
    letter[1:] |= latin[:-1]
    cut = np.flatnonzero(letter & _MARK[low[1:]]) + 1
    inside = np.ones(len(low) + 1, bool)
    inside[offsets] = False
    cut = cut[inside[cut]]
    whole = starts[held]
    if len(whole):
        cut = cut[~held[np.searchsorted(starts, cut, "right") - 1]]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return low, starts, ends, np.isin(starts, whole)


def _holding(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, literals: list[bytes]) -> np.ndarray:
    held, text = np.zeros(len(starts), bool), low.tobytes()
    for literal in map(bytes.lower, literals):
        at = text.find(literal)
        while at >= 0:
            i = np.searchsorted(starts, at, "right") - 1
            held[i] |= at + len(literal) <= ends[i]
            at = text.find(literal, at + 1)
    return held


def binary_rows(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value of little-endian ids for each text."""
    size = ids.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
