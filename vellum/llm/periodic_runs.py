"""Periodic runs of words, found online by dyadic square catchers.

A square is a word sequence said twice in a row; a run is a maximal stretch whose words repeat at a distance q, the
smallest such. Words are appended, and level k keeps a catcher on every completed block of L = 2^k words that begins at
a multiple of L. A block's catcher waits for the block to come again at a distance q with 2 L - 1 <= q < 4 L - 1: a
period in this range covers a whole block, so each square of it runs into a catcher, and each appended word meets just
two catchers a level, one of them for each half of the range. A catcher compares its block with the suffix of L words
by their hashes, and where enough blocks in a row have come again, squares are reported and merge into a run, which is
then compared word by word: to the left once, to the right as long as further words keep it going. A run of a multiple
of a known run's period within that run is no run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .sentencepiece_codec import slices

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are appended together; more or fewer change memory, never the runs.
APPENDED = 1 << 18

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _LEFT + (right ^ _RIGHT)
    x ^= x >> np.uint64(31)
    return x * _LEFT


class Level:
    """Hashes of the windows of ``width`` words, those that catchers can still ask for."""

    def __init__(self, width: int, periods: int, least: int):
        self.width = width
        span = range(2 * width - 1, min(4 * width - 1, 2 * width + least))
        #: words x with words[x] == words[x + q] that the shortest run of this level has
        stretch = min(max((periods - 1) * q, least - q) for q in span)
        #: whole blocks that such a stretch holds, wherever it begins
        self.blocks = max(1, (stretch - width + 1) // width)
        self.first, self.hash = 0, np.empty(0, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Takes the hashes of the next windows, after what lies too far behind has been let go."""
        behind = (self.blocks + 6) * self.width
        if len(self.hash) > 2 * behind:
            self.first, self.hash = self.first + len(self.hash) - behind, self.hash[-behind:]
        self.hash = np.concatenate([self.hash, hashes])

    @property
    def end(self) -> int:
        return self.first + len(self.hash)


class SquareCatcher:
    """Takes numbered words as they come and knows the runs of all words so far."""

    def __init__(self, periods: int = LEAST_PERIODS, least: int = LEAST_WORDS):
        self.periods, self.least = periods, least
        self.words, self.n = np.empty(64, np.int64), 0
        self.levels: list[Level] = []
        #: start, end and period of each run, and by word the longest run that holds it
        self.found: list[list[int]] = []
        self.open: list[int] = []
        self.cover = np.full(64, -1, np.int64)

    def append(self, words: np.ndarray) -> None:
        """Adds words; all at once or one by one makes no difference."""
        if not len(words):
            return
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            size = max(self.n, 2 * len(self.words))
            self.words = np.concatenate([self.words[:before], np.empty(size - before, np.int64)])
            self.cover = np.concatenate([self.cover[:before], np.full(size - before, -1, np.int64)])
        self.words[before : self.n] = words
        grown, self.open = self.open, []
        for k in grown:
            self._grow(k)
        width = 1
        while (2 * width - 1) * self.periods <= self.n:
            k = width.bit_length() - 1
            if k == len(self.levels):
                self.levels.append(Level(width, self.periods, self.least))
                fresh = self._hashes(k, 0)
            else:
                fresh = self._hashes(k, self.levels[k].end)
            begin = self.levels[k].end
            self.levels[k].add(fresh)
            self._catch(self.levels[k], begin)
            width *= 2

    def _hashes(self, k: int, begin: int) -> np.ndarray:
        """Hashes of the windows of level ``k`` from ``begin`` to the last complete one."""
        if k == 0:
            x = self.words[begin : self.n].astype(np.uint64)
            return _mixed(x, x)
        width, half = 1 << k, self.levels[k - 1]
        if begin < half.first:  # a level that opens late: what its half has let go is hashed anew
            return self._direct(k, begin)
        stop = self.n - width + 1
        if stop <= begin:
            return np.empty(0, np.uint64)
        at = begin - half.first
        return _mixed(half.hash[at : at + stop - begin], half.hash[at + width // 2 : at + width // 2 + stop - begin])

    def _direct(self, k: int, begin: int) -> np.ndarray:
        x = self.words[begin : self.n].astype(np.uint64)
        x = _mixed(x, x)
        for j in range(k):
            half = 1 << j
            x = _mixed(x[:-half], x[half:]) if len(x) > half else x[:0]
        return x

    def _catch(self, level: Level, begin: int) -> None:
        """Compares the windows from ``begin`` with the two blocks whose catchers wait for them."""
        width, blocks = level.width, level.blocks
        # the windows before, of which the same catchers' neighbours knew: a row of blocks may have begun there
        low = max(level.first, begin - blocks * width)
        t = np.arange(low, level.end)
        hashes = level.hash[low - level.first :]
        nearer = (t - 2 * width + 1) // width * width
        for block in (nearer, nearer - width):
            there = block - level.first
            same = (block >= 0) & (there >= 0)
            same[same] = level.hash[there[same]] == hashes[same]
            if not same.any():
                continue
            row = same.copy()
            for j in range(1, blocks):
                row[j * width :] &= same[: -j * width]
                row[: j * width] = False
            fresh = row.copy()
            fresh[width:] &= ~row[:-width]
            fresh[: max(0, begin - low)] = False
            at = np.flatnonzero(fresh)
            if len(at):
                self._report(t[at], block[at], width, blocks)

    def _report(self, t: np.ndarray, block: np.ndarray, width: int, blocks: int) -> None:
        """Merges squares into runs: of ``blocks`` blocks in a row, ``block`` is the last, which comes again at ``t``."""
        q, start, stop = t - block, block - (blocks - 1) * width, t + width
        if self.found:
            known = np.array(self.found)[self.cover[t]]
            inside = (self.cover[t] >= 0) & (known[:, 0] <= start) & (known[:, 1] >= stop) & (q % known[:, 2] == 0)
            q, start = q[~inside], start[~inside]
        for i in np.lexsort((start, q)).tolist():
            self._begin(int(q[i]), int(start[i]), blocks * width)

    def _begin(self, q: int, start: int, known: int) -> None:
        """A run of period ``q``, whose words from ``start`` are the same as those q later for ``known`` words at least."""
        cover = self.cover[start]
        if cover >= 0:
            a, e, p = self.found[cover]
            if q % p == 0 and a <= start and e >= start + known + q:
                return
        first = self._leftwards(start, q)
        end = self._rightwards(start + known, q) + q
        if end - first >= 2 * q and self._multiple(first, q):
            return
        self.found.append([first, end, q])
        self._note(len(self.found) - 1)

    def _grow(self, k: int) -> None:
        _, end, q = self.found[k]
        self.found[k][1] = self._rightwards(end - q, q) + q
        self._note(k)

    def _note(self, k: int) -> None:
        """Marks the words of a run that no longer run holds, and keeps it open if it reaches the last word."""
        first, end, _ = self.found[k]
        held = self.cover[first:end]
        others = np.unique(held[held >= 0])
        if len(others):
            longer = [x for x in others.tolist() if self.found[x][1] - self.found[x][0] >= end - first]
            held[~np.isin(held, longer)] = k
        else:
            held[:] = k
        if end == self.n:
            self.open.append(k)

    def _leftwards(self, at: int, q: int) -> int:
        """The first x of the stretch up to ``at`` in which words[x] == words[x + q]."""
        step = 32
        while at > 0:
            low = max(0, at - step)
            other = np.flatnonzero(self.words[low:at] != self.words[low + q : at + q])
            if len(other):
                return low + int(other[-1]) + 1
            at, step = low, step * 2
        return 0

    def _rightwards(self, at: int, q: int) -> int:
        """The first x from ``at`` with another word than words[x + q], or where no word x + q has come yet."""
        step, stop = 32, self.n - q
        while at < stop:
            high = min(stop, at + step)
            other = np.flatnonzero(self.words[at:high] != self.words[at + q : high + q])
            if len(other):
                return at + int(other[0])
            at, step = high, step * 2
        return stop

    def _multiple(self, first: int, q: int) -> bool:
        """Whether a proper part of ``q`` is a period of the words from ``first``, of which two periods are there."""
        rest, f = q, 2
        while rest > 1:
            if f * f > rest:
                f = rest
            if rest % f == 0:
                while rest % f == 0:
                    rest //= f
                d = q // f
                if np.array_equal(self.words[first : first + q], self.words[first + d : first + d + q]):
                    return True
            f += 1
        return False

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run that is long enough by now, by start, then period."""
        long = ((a, e - a, q) for a, e, q in self.found if e - a >= max(self.least, self.periods * q))
        return sorted(x for x in long if not self._multiple(x[0], x[2]))  # a run may begin before it is two periods long


def runs_of(words: list, periods: int = LEAST_PERIODS, least: int = LEAST_WORDS, appended: int = APPENDED) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words of any hashable kind."""
    number: dict = {}
    catcher = SquareCatcher(periods, least)
    for i in range(0, len(words), appended):
        part = words[i : i + appended]
        catcher.append(np.fromiter((number.setdefault(w, len(number)) for w in part), np.int64, len(part)))
    return catcher.runs()


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", periods: int = LEAST_PERIODS, least: int = LEAST_WORDS) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of ``docs``.

    Words are runs of anything but space and the ASCII controls 9 to 13, numbered from 0. ``runs`` are structs of start,
    length and period, by start, then period: maximal stretches of consecutive words with smallest period q and at least
    ``least`` words and ``periods`` times q. ``collapsed`` is the text with only the first period of each run, words
    joined by one space.

    Null and empty texts have no words, no runs and an empty collapsed text. Texts of any length are taken whole, in one
    row each; repeated rows and null ids stay, each judged by its text. Ties don't occur: all runs are given. An empty
    table gives no rows; other columns are left out, whatever their names.
    """
    run_type = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])
    arrow_runs = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                n, runs, collapsed = [], [], []
                for text in part.column(1).to_pylist():
                    words = (text or "").encode().split()  # bytes: split at the six ASCII spaces only
                    found = runs_of(words, periods, least)
                    n.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in found])
                    collapsed.append(_collapsed(words, found).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, arrow_runs), pa.array(collapsed, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(search, schema)
