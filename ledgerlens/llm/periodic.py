"""Periodic runs of words: stretches that repeat a short piece four times or more.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at
least ``max(6, 4 q)`` words. All runs are found, by internal pattern matching:

* Suffixes are sorted by doubling, so for every length 2^k all equal factors of that length are
  neighbours in the suffix array.
* For a run of period q take the length L = 2^k with L <= q < 2 L. Blocks of L words at
  multiples of L lie so close that one lies in the first 2 q words of the run, and it occurs again q
  words later. So each block asks for its occurrences that begin L to 2 L - 1 words after it: a
  range successor query (the smallest position from x on in an interval of the suffix array) on a
  wavelet matrix over the suffix array.
* Up to two such occurrences give a candidate period each. Three or more form a progression
  whose step p is the period of the block, and the block and its occurrences lie in
  stretches of period p; then q is the distance between the ends of the stretches.
* Candidates are extended to both sides by equal factors of lengths 2^k.

The texts of a batch are searched together, parted by words of their own, so no run crosses them. Work is
n log n for n words, whatever the text holds.

Defined results: a NULL text has no words and gives no run and the empty text. Empty tables give
an empty result; repeated rows and equal ids are rows of their own. Other columns do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MIN_LENGTH = 6
MIN_PERIODS = 4
# Texts are searched together up to so many words; a longer text is searched alone.
BATCH_WORDS = 1 << 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class SuffixRanks:
    """Suffix array of a sequence, and for each length 2^k the interval of every factor.

    ``ranks[k][i]`` is the place in the suffix array where the factors equal to that of length
    2^k at i begin, ``ends[k]`` (by that place) where they end.
    """

    def __init__(self, codes: np.ndarray, longest: int):
        self.ranks: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        order = self._sort(codes)
        length, n = 1, len(codes)
        while 2 * length <= longest and (self.ends[-1] - np.arange(n) > 1).any():
            rank = self.ranks[-1]
            behind = np.zeros(n, np.int64)
            behind[:n - length] = rank[length:] + 1
            order = self._sort(rank * (n + 1) + behind)
            length *= 2
        self.order = order

    def _sort(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.empty(len(keys), bool)
        first[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
        places = np.flatnonzero(first)
        sizes = np.diff(np.append(places, len(keys)))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.repeat(places, sizes)
        end = np.zeros(len(keys), np.int64)
        end[places] = places + sizes
        self.ranks.append(rank)
        self.ends.append(end)
        return order

    def equal_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal from ``a`` and from ``b`` on; ``a`` < ``b``."""
        return self._equal(a, b, forward=True)

    def equal_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal before ``a`` and before ``b``."""
        return self._equal(a, b, forward=False)

    def _equal(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        n, total = len(self.order), np.zeros(len(a), np.int64)
        top = len(self.ranks) - 1
        for k in range(top, -1, -1):
            rank, length = self.ranks[k], 1 << k
            going = np.arange(len(a))
            while len(going):
                x, y = (a[going] + total[going], b[going] + total[going]) if forward else (
                    a[going] - total[going] - length, b[going] - total[going] - length)
                inside = (y + length <= n) if forward else (x >= 0)
                going = going[inside]
                going = going[rank[x[inside]] == rank[y[inside]]]
                total[going] += length
                if k < top:
                    break
        return total


class WaveletMatrix:
    """The bits of a permutation, level by level, for counting and selecting in intervals."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros_before: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit & 1) == 0
            before = np.zeros(len(values) + 1, np.int64)
            np.cumsum(zero, out=before[1:])
            self.zeros_before.append(before)
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value from ``least`` on in each interval, -1 without one."""
        lower = self._below(begin, end, least)
        found = np.full(len(begin), -1, np.int64)
        some = np.flatnonzero(lower < end - begin)
        found[some] = self._smallest(begin[some], end[some], lower[some])
        return found

    def _levels(self) -> Iterator[tuple[int, np.ndarray, int]]:
        for level, before in enumerate(self.zeros_before):
            yield self.bits - 1 - level, before, before[-1]

    def _below(self, begin: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        count = np.zeros(len(begin), np.int64)
        for bit, before, zeros in self._levels():
            one = (limit >> bit & 1) == 1
            z_begin, z_end = before[begin], before[end]
            count += np.where(one, z_end - z_begin, 0)
            begin = np.where(one, zeros + begin - z_begin, z_begin)
            end = np.where(one, zeros + end - z_end, z_end)
        return count

    def _smallest(self, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        value = np.zeros(len(begin), np.int64)
        for bit, before, zeros in self._levels():
            z_begin, z_end = before[begin], before[end]
            one = place >= z_end - z_begin
            place = np.where(one, place - (z_end - z_begin), place)
            value |= np.where(one, 1 << bit, 0)
            begin = np.where(one, zeros + begin - z_begin, z_begin)
            end = np.where(one, zeros + end - z_end, z_end)
        return value


def _candidates(index: SuffixRanks, places: WaveletMatrix, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block begins and periods to try, from 2^k to 2^(k+1) - 1."""
    size, n = 1 << k, len(index.order)
    block = np.arange(0, n - size + 1, size)
    begin = index.ranks[k][block]
    end = index.ends[k][begin]
    some = end - begin > 1
    block, begin, end = block[some], begin[some], end[some]
    # The first three occurrences in the window; n + size means none.
    found, least = [], block + size
    for _ in range(3):
        at = np.full(len(block), n + size, np.int64)
        asked = np.flatnonzero(least < np.minimum(block + 2 * size, n))
        at[asked] = places.successor(begin[asked], end[asked], least[asked])
        at[(at < 0) | (at >= block + 2 * size)] = n + size
        found.append(at)
        least = at + 1
    first, second, third = found
    many = third <= n
    few_first, few_second = (first <= n) & ~many, (second <= n) & ~many
    step = second[many] - first[many]
    from_, to = block[many], first[many]
    apart = (to + index.equal_after(to, to + step)) - (from_ + index.equal_after(from_, from_ + step))
    fitting = (apart >= size) & (apart < 2 * size)
    return (np.concatenate([block[few_first], block[few_second], from_[fitting]]),
            np.concatenate([(first - block)[few_first], (second - block)[few_second], apart[fitting]]))


def find_runs(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and smallest period of all runs of a sequence of numbers, by begin and period.

    ``longest`` bounds the length of a run; shorter bounds save work.
    """
    index = SuffixRanks(codes, longest // MIN_PERIODS)
    places = WaveletMatrix(index.order)
    parts = []
    for k in range(len(index.ranks)):
        at, period = _candidates(index, places, k)
        begin = at - index.equal_before(at, at + period)
        end = at + period + index.equal_after(at, at + period)
        enough = end - begin >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
        parts.append(np.stack([begin, end, period])[:, enough])
    begin, end, period = np.concatenate(parts, axis=1)
    # A stretch found with a multiple of its period, too, is one run.
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[new], end[new], period[new]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    codes: defaultdict = defaultdict()
    codes.default_factory = codes.__len__
    row: list[int] = []
    starts = []
    for number, words in enumerate(texts):
        starts.append(len(row))
        row.extend([codes[w] for w in words])
        row.append(-1 - number)
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if row:
        numbers = np.array(row, np.int64)
        begin, end, period = find_runs(numbers, max(map(len, texts)))
        owner = np.searchsorted(starts, begin, side="right") - 1
        for text, b, e, q in zip(owner.tolist(), begin.tolist(), end.tolist(), period.tolist()):
            result[text].append((b - starts[text], e - b, q))
    return result


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that any run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = [w for w, keep in zip(words, kept.tolist()) if keep]
    return b" ".join(words).decode()


def _rows_of(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    found = runs_of(texts)
    rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
    return pa.RecordBatch.from_arrays([
        ids,
        pa.array([len(words) for words in texts], pa.int64()),
        pa.array(rows, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
        pa.array([collapsed(words, runs) for words, runs in zip(texts, found)], pa.string()),
    ], ["id", "n_words", "runs", "collapsed"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the texts of each batch; only the words of texts searched together are held."""
    for batch in batches:
        begin, texts, held = 0, [], 0
        for at, text in enumerate(batch.column(1)):
            words = (text.as_py() or "").encode().split()
            if texts and held + len(words) > BATCH_WORDS:
                yield _rows_of(batch.column(0).slice(begin, len(texts)), texts)
                begin, texts, held = at, [], 0
            texts.append(words)
            held += len(words)
        if texts:
            yield _rows_of(batch.column(0).slice(begin, len(texts)), texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` text.

    Words are parted by ASCII white space; ``text`` is by default the column of that name.
    """
    key = F.col("`" + id_col.replace("`", "``") + "`")
    rows = docs.select(key.alias("id"), (F.col("text") if text is None else text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_search, f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def strongest_run(runs: Column) -> Column:
    """The run of the greatest exact length / period, the first of them; NULL without runs."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
