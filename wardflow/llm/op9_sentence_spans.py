"""Substring deduplication by sliding runs of consecutive sentences.

A text is cut into sentences: after a full stop, exclamation or question mark
with white space behind it, after those of scripts that write no blank behind
them (U+3002 and the like), and at line ends. A sentence of more than
``LONG_SENTENCE`` words is cut further after each word whose hash is the
smallest of some ``ANCHOR_WINDOW`` consecutive words of it, so that every so
many shared words hold a cut, at the same place in every copy. In scripts
without blanks every character is a word to cut at, and two count as one word
in lengths. From every sentence, a run goes on until it has at least two
sentences and ``RUN_WORDS`` words, and one such run goes back from every
sentence at which none ends; runs are hashed by their words (in small letters,
without punctuation). Where a single line break parts words without a stop,
runs are also taken as if it were a blank, so that copies wrapped at other
places agree; what is counted and removed are then the pieces between all
cuts. A run whose words are seen again is a repetition, and sentences that a
non-first repetition covers are removed: of a shared passage of 37 words or
more, all but up to ``ANCHOR_WINDOW`` words at either end. First is the
smallest document id (see below for equal ones), and within a document the first
place.

How it is spread: repetitions inside one text are found where the text is.
Across texts, runs are counted by hash, with a partial count in every task, so
a passage that a third of all documents share is a few rows after the first
step. Runs seen in several texts are joined back on the hash; that join has
one row a hash on its small side, so a hot hash can be split. What is left of
each text is cut where the text is, from its list of covered sentences.

Defined results: a null text stays null, an empty text empty. A text whose
every sentence is covered becomes empty. Texts without such runs come back
unchanged, byte for byte; other texts lose whole sentences. Rows without an id
come first; those without one, or with the same one, go by 62 bits of a hash of
their text, so that of any passage one place is left. Rows that agree in id and
text count as one document, so repeated rows are treated alike. Columns other
than the id, the text and ``keep`` are not read; a kept column that is named
like a result comes back as ``<name>_in``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.llm import _arrays as A
from wardflow.llm._columns import Carried

RUN_WORDS = 16
LONG_SENTENCE = 16
ANCHOR_WINDOW = 11
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def _codes(text: str) -> np.ndarray:
    """The bytes of each character as one number."""
    return np.array([int.from_bytes(c.encode(), "big") for c in text], np.int64)


_WIDE_STOPS = _codes("\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u06d4\u061f")
_CLOSERS = _codes("\u300d\u300f\uff09\u300b\u3009\u3011\u3015\uff63\u201d\u2019")
_MARKS = np.union1d(_WIDE_STOPS, _codes("".join(map(chr, [
    *range(0x3000, 0x3005), *range(0x3008, 0x3021), 0x3030, *range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21),
    *range(0xFF61, 0xFF66)]))))
#: First two bytes of the characters of scripts without blanks: Thai, Lao,
#: Tibetan, Burmese, Khmer, kana, bopomofo, Han, Yi.
_ALONE = np.zeros(1 << 16, bool)
for _lo, _hi in ((0x0E00, 0x1080), (0x1780, 0x1800), (0x3040, 0x3130), (0x31C0, 0x3200), (0x3400, 0xA4C0),
                 (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000)):
    for _c in range(_lo, _hi, 16):
        _ALONE[int.from_bytes(chr(_c).encode()[:2], "big")] = True


class _Wide:
    """Characters beyond Latin: ``alone`` are the bytes where those of scripts
    without blanks begin, ``alone_end`` where they end; ``mark`` are the bytes
    of their punctuation, ``stop`` those of stops, ``glue`` what may stand
    between a stop and the next sentence."""

    def __init__(self, buf: np.ndarray, lead: np.ndarray):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
        size = np.where(padded[lead] >= 0xF0, 4, np.where(padded[lead] >= 0xE0, 3, 2))
        pair = padded[lead] << 8 | padded[lead + 1]
        code = np.where(size == 3, pair << 8 | padded[lead + 2], np.where(size == 2, pair, -1))
        marks = np.isin(code, _MARKS)
        alone = _ALONE[pair] & ~marks & (size > 2)
        self.alone, self.alone_end = lead[alone], (lead + size)[alone]
        self.mark = self._bytes(len(buf), lead, size, marks)
        stops = np.isin(code, _WIDE_STOPS)
        self.stop = self._bytes(len(buf), lead, size, stops)
        self.glue = A.SPACE[buf] | self._bytes(len(buf), lead, size, stops | np.isin(code, _CLOSERS))

    @staticmethod
    def _bytes(n: int, lead: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        for k in range(4):
            out[lead[which & (size > k)] + k] = True
        return out


#: An odd multiplier and its inverse, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    out = np.full(n, base, A.U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Units:
    """The pieces between the cuts ``at``: the offsets of each text's
    (``first``), their hashes ``h`` and lengths in words."""

    def __init__(self, at, offsets, starts, words, alone):
        self.at, self.first = at, np.searchsorted(at, offsets)
        self.word = np.searchsorted(starts, at)              # the first word of each
        count = np.diff(np.append(self.word, len(starts)))
        self.words = count
        if alone is not None:
            lone = np.concatenate([[0], np.cumsum(alone)])
            lone = np.diff(lone[np.append(self.word, len(starts))])
            self.words = count - lone + (lone + 1) // 2
        self.h = np.zeros(len(at), A.U64)
        if len(starts):
            place = np.arange(len(starts)) - np.repeat(self.word, count)
            mixed = A.mix(words ^ A.mix(place.astype(A.U64) + A.U64(1)))
            full = np.flatnonzero(count)
            self.h[full] = np.add.reduceat(mixed, self.word[full])

    def runs(self, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last unit, and hash, of every run."""
        n = len(self.at)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, A.U64)
        total = np.concatenate([[0], np.cumsum(self.words)])
        i = np.arange(n)
        text_end = np.repeat(self.first[1:], np.diff(self.first))
        last = np.maximum(np.searchsorted(total, total[:-1] + least_words) - 1, i + 1)
        ok = (last < text_end) & (total[np.minimum(last + 1, n)] - total[i] >= least_words) & (self.words > 0)
        # Runs backwards from sentences at which no such run ends: so the last
        # sentences of a shared passage are covered as well.
        no_end = np.ones(n, bool)
        no_end[last[ok]] = False
        text_start = np.repeat(self.first[:-1], np.diff(self.first))
        back = np.minimum(np.searchsorted(total, total[1:] - least_words, "right") - 1, np.arange(n) - 1)
        no_end &= (back >= text_start) & (self.words > 0)
        ends = np.flatnonzero(no_end)
        i, last = np.concatenate([i[ok], back[ends]]), np.concatenate([last[ok], ends])
        order = np.argsort(i, kind="stable")
        i, last = i[order], last[order]
        # The hash of a run is a polynomial over its sentences, taken from sums
        # over all sentences before its ends: a run costs the same at any length.
        before = np.concatenate([np.zeros(1, A.U64), np.cumsum(self.h * _powers(_BASE, n), dtype=A.U64)])
        h = (before[last + 1] - before[i]) * _powers(_BASE_INVERSE, n)[i]
        h = A.mix(h ^ A.mix((last - i).astype(A.U64)))
        return i, last, h


def _anchored(at: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``at`` with cuts before the words that follow an anchor, in pieces of
    more than ``LONG_SENTENCE`` words. Of equal hashes the last is the anchor."""
    n, size = len(starts), ANCHOR_WINDOW
    if n < size:
        return at
    of = np.searchsorted(at, starts, "right") - 1
    long = np.bincount(of, minlength=len(at))[of] > LONG_SENTENCE
    k = np.flatnonzero(long[: n - size + 1] & (of[: n - size + 1] == of[size - 1:]))
    least, which = words[k], k.copy()
    for d in range(1, size):
        value = words[k + d]
        less = value <= least
        least = np.where(less, value, least)
        which[less] = k[less] + d
    after = np.unique(which) + 1
    after = after[after < n]
    return np.union1d(at, starts[after[of[after] == of[after - 1]]])


class Sentences:
    """Sentences of a batch of texts: ``at`` are the bytes where they begin,
    ``first`` the offsets of each text's sentences, ``words`` their lengths."""

    def __init__(self, column: pa.Array):
        buf, offsets = A.utf8(column)
        self.buf, self.offsets = buf, offsets
        low = A.LOWER[buf]
        word = A.WORD[low]
        lead = np.flatnonzero(buf >= 0xD8)
        wide = _Wide(buf, lead) if len(lead) else None
        if wide:
            word &= ~wide.mark
        starts, ends, _ = A.runs(word, offsets)
        alone = None
        if wide and len(wide.alone):
            cuts = np.union1d(wide.alone, wide.alone_end)
            cuts = cuts[cuts < len(buf)]
            cuts = np.setdiff1d(cuts[word[cuts]], starts)
            starts, ends = np.union1d(starts, cuts), np.union1d(ends, cuts)
            alone = np.isin(starts, wide.alone)
        words = A.hash_words(low, starts, ends)
        begins = np.zeros(len(buf) + 1, bool)
        single = np.zeros(0, np.int64)
        if len(buf) > 1:
            space = A.SPACE[buf]
            # A byte that is not white space, after white space that follows
            # a stop or holds a line end.
            gap_start, gap_end, _ = A.runs(space, offsets)
            line = (buf == 10) | (buf == 13)
            line[:-1] &= ~((buf[:-1] == 13) & (buf[1:] == 10))
            lines = np.concatenate([[0], np.cumsum(line)])
            lines = lines[gap_end] - lines[gap_start]
            stop = np.zeros(len(gap_start), bool)
            inner = ~np.isin(gap_start, offsets)  # what is before belongs to the same text
            stop[inner] = _STOP[buf[gap_start[inner] - 1]]
            begins[gap_end[stop | (lines > 1)]] = True
            single = gap_end[~stop & (lines == 1)]
        if wide and wide.stop.any():
            glue_start, glue_end, _ = A.runs(wide.glue, offsets)
            stops = np.concatenate([[0], np.cumsum(wide.stop)])
            begins[glue_end[stops[glue_end] > stops[glue_start]]] = True
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        begins[len(buf)] = False
        single = single[single < len(buf)]
        single = single[~begins[single]]
        at = np.flatnonzero(begins)
        lined = _anchored(np.union1d(at, single), starts, words)
        self.units = [_Units(lined, offsets, starts, words, alone)]
        if len(single):
            self.units.append(_Units(_anchored(at, starts, words), offsets, starts, words, alone))
            lined = np.union1d(lined, self.units[1].at)
        self.at, self.first = lined, np.searchsorted(lined, offsets)
        self.words = np.diff(np.append(np.searchsorted(starts, lined), len(starts)))

    def runs(self, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last sentence, and hash, of every run."""
        found = []
        for u in self.units:
            i, last, h = u.runs(least_words)
            place = np.append(np.searchsorted(self.at, u.at), len(self.at))
            found.append((place[i], place[last + 1] - 1, h, u.word[i]))
        if len(found) == 1:
            return found[0][:3]
        # A run of both kinds of units is one run: same words at the same place.
        keys = [A.mix(h ^ A.mix(w.astype(A.U64))) for _, _, h, w in found]
        new = ~np.isin(keys[1], keys[0])
        i, last, h = (np.concatenate([x, y[new]]) for x, y in zip(found[0][:3], found[1][:3], strict=True))
        order = np.argsort(i, kind="stable")
        return i[order], last[order], h[order]


#: A document's rank: its id (none: the least), then 62 bits of its text, so
#: that rows are one document only if they agree in both.
_RANK = "decimal(38,0)"
_RUN = f"rank {_RANK}, h long, a int, b int"
_NO_ID = -1 << 63


def _rank(ident: Column, text: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(text), 2).cast("decimal(19,0)")
    return (F.coalesce(ident, F.lit(_NO_ID)).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)")
            + bits).cast(_RANK)


def _runs(least_words: int):
    """Runs at their first place in their text."""
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                s = Sentences(part.column("text"))
                i, last, h = s.runs(least_words)
                text = np.searchsorted(s.first, i, "right") - 1
                new = _first_in_text(text, h)
                i, last, h, text = i[new], last[new], h[new], text[new]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rank").take(pa.array(text)),
                     pa.array(h.astype(np.int64)), pa.array((i - s.first[text]).astype(np.int32)),
                     pa.array((last - s.first[text]).astype(np.int32))],
                    names=["rank", "h", "a", "b"])
    return run


def _first_in_text(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True at the first of the equal hashes of a text (texts ascending)."""
    key = A.mix(h ^ A.mix(text.astype(A.U64)))
    new = np.zeros(len(h), bool)
    new[np.unique(key, return_index=True)[1]] = True
    return new


def _cut(least_words: int, keep: list[str]):
    def run(batches):
        for batch in batches:
            for part in A.slices(batch, "_text"):
                column = part.column("_text")
                s = Sentences(column)
                i, last, h = s.runs(least_words)
                text = np.searchsorted(s.first, i, "right") - 1
                again = ~_first_in_text(text, h)
                change = np.zeros(len(s.at) + 1, np.int64)
                np.add.at(change, i[again], 1)
                np.add.at(change, last[again] + 1, -1)
                covered = part.column("_covered")
                lists = covered.fill_null([]) if covered.null_count else covered
                flat = lists.flatten()
                row = A.expand(lists.value_lengths().to_numpy(zero_copy_only=False))[0]
                if len(flat):
                    np.add.at(change, flat.field(0).to_numpy() + s.first[row], 1)
                    np.add.at(change, flat.field(1).to_numpy() + s.first[row] + 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                lost = np.add.reduceat(np.append(gone, False).astype(np.int64), s.first[:-1]) \
                    if len(gone) else np.zeros(part.num_rows, np.int64)
                lost = np.where(np.diff(s.first) > 0, lost, 0)
                out = column.to_pylist()
                ends = np.append(s.at[1:], len(s.buf))
                for d in np.flatnonzero(lost).tolist():
                    stay = [s.buf[s.at[k]: min(ends[k], s.offsets[d + 1])].tobytes()
                            for k in range(s.first[d], s.first[d + 1]) if not gone[k]]
                    head = s.buf[s.offsets[d]: s.at[s.first[d]]].tobytes()
                    out[d] = (head + b"".join(stay)).decode() if stay else ""
                cols = {c: part.column(c) for c in keep}
                cols["_new"] = pa.array(out, pa.string())
                cols["_n"] = pa.array(np.diff(s.first))
                cols["_lost"] = pa.array(lost)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def remove_repeated_spans(docs: DataFrame, least_words: int = RUN_WORDS, id_col: str = "doc_id",
                          text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row, with the new ``text``,
    ``n_sentences`` and ``n_removed``."""
    keep = [id_col] if keep is None else [c for c in keep if c != text_col]
    ident = F.col(f"`{id_col}`").cast("long")
    rank = _rank(ident, F.col(f"`{text_col}`"))
    runs = docs.select(rank.alias("rank"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_runs(least_words), _RUN)
    repeated = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("rank").alias("first")).filter("n > 1")
    covered = (runs.join(repeated.select("h", "first"), "h").filter("rank <> first")
               .groupBy("rank").agg(F.collect_set(F.struct("a", "b")).alias("_covered")))
    own = Carried(docs, keep, text_col, ["text", "n_sentences", "n_removed"])
    joined = docs.select(*own.columns, rank.alias("rank")).join(covered, "rank", "left")
    out = joined.select(*own.keep, "_text", "_covered").mapInArrow(_cut(least_words, own.keep), ", ".join(
        [own.schema] * bool(keep) + ["_new string", "_n long", "_lost long"]))
    return out.select(*own.back(out), F.col("_new").alias("text"), F.col("_n").alias("n_sentences"),
                      F.col("_lost").alias("n_removed"))


def op9_sentence_spans(docs: DataFrame) -> DataFrame:
    """Every document's text without repeated spans."""
    return remove_repeated_spans(docs).select(
        "doc_id", "text", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("changed"))
