"""Runs of repeated words, found by internal pattern matching.

A run of period q is a stretch in which words q apart are equal; it is wanted if it is at
least three periods long.  Take k with 2^k <= q < 2^(k+1): the run holds a whole block of
2^k words that starts at a multiple of 2^k (a dyadic block), and that block occurs again q
words later, so within the next 2^k starting places.

1. The words of a batch of documents are numbered, every document with an alphabet of its
   own, and suffixes are sorted by prefix doubling.  Equal blocks are neighbours in the suffix
   array.  Suffixes whose first eight words are unique in their document leave it.
2. A wavelet matrix over the starting places in the suffix array answers, for all blocks
   of a level at once, which is the first occurrence at or behind a place (range successor).
3. Occurrences within 2^k starting places are one progression.  A single one gives its
   distance as candidate period.  Two give both distances.  More mean that the block itself
   has the small period d of the progression; then the stretches of period d around
   the block and around the progression are one period of the run apart at their left or
   at their right ends, unless a run's end cuts them, and not both are cut.
4. Candidates are extended to maximal stretches.  The period of a stretch is the smallest
   with which it was found.

Periods below eight are found by blocks of eight words and occurrences less than eight words
on, as the shortest run wanted has 24 words.  Work and memory follow the words of a batch
times the logarithm of the longest document; a batch ends after about ``BATCH_BYTES`` bytes,
and a longer document is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import let

BATCH_BYTES = 4_000_000
#: Shortest run, and how many periods it must hold at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
BASE = 3
#: Elements compared at once when stretches are extended.
COMPARED = 2_000_000
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class WaveletMatrix:
    """Counts and successors of values within ranges of an array, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        now = values
        for bit in range(self.bits - 1, -1, -1):
            high = (now >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(high, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[~high], now[high]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in ``[low, high)`` are less than ``bound``."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            ones_low, ones_high = ones[low], ones[high]
            up = (bound >> bit & 1).astype(bool)
            count += np.where(up, (high - low) - (ones_high - ones_low), 0)
            low, high = np.where(up, zeros + ones_low, low - ones_low), np.where(up, zeros + ones_high, high - ones_high)
        return np.where(bound >> self.bits > 0, -1, count)

    def nth(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank (from 0) in ``[low, high)``."""
        low, high, rank, value = low.copy(), high.copy(), rank.copy(), np.zeros(len(low), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            ones_low, ones_high = ones[low], ones[high]
            few = (high - low) - (ones_high - ones_low)
            up = rank >= few
            value |= up.astype(np.int64) << bit
            rank = np.where(up, rank - few, rank)
            low, high = np.where(up, zeros + ones_low, low - ones_low), np.where(up, zeros + ones_high, high - ones_high)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value in ``[low, high)`` that is at least ``bound``, -1 if there is none."""
        out = np.full(len(low), -1, np.int64)
        count = self.below(low, high, bound)
        some = np.flatnonzero((count >= 0) & (count < high - low))
        out[some] = self.nth(low[some], high[some], count[some])
        return out


@dataclass(frozen=True)
class Level:
    """Dyadic blocks of one length that occur more than once in their document.

    ``place`` is where a block begins, ``low`` and ``high`` bound the suffixes that begin with it.
    """

    length: int
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _grouped(begin: np.ndarray) -> np.ndarray:
    """Which places of a sorted array share their group's begin with a neighbour."""
    if not len(begin):
        return np.zeros(0, bool)
    same = begin[1:] == begin[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def suffix_array(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The suffixes whose first words repeat in their document, sorted, and the blocks of every level.

    ``begin`` and ``end`` bound the document of every word; documents share no word.
    Prefix doubling: a round sorts the suffixes that still share their prefix by what
    follows it.  A later round only moves suffixes within their group, so the groups of
    every level are ranges of the final order.
    """
    n, length, levels = len(words), 1, []
    order = np.argsort(words, kind="stable")
    now = words[order]
    first = np.arange(n)
    first[1:][now[1:] == now[:-1]] = 0
    group = np.maximum.accumulate(first) if n else first
    rank = np.empty(n, np.int64)
    rank[order] = group
    active = np.flatnonzero(_grouped(group))
    kept = active
    while True:
        at = order[active]
        if length >= 1 << BASE:
            long_enough = end[at] - begin[at] >= LEAST_PERIODS * length
            active, at = active[long_enough], at[long_enough]
            if length == 1 << BASE:
                kept = active
            group = rank[at]
            chosen = np.flatnonzero((at - begin[at]) % length == 0)
            low = np.searchsorted(kept, group[chosen])
            levels.append(Level(length, at[chosen], low, low + np.searchsorted(group, group[chosen], "right") - np.searchsorted(group, group[chosen])))
        if not len(active):
            return order[kept], levels
        following = np.where(at + length < end[at], rank[np.minimum(at + length, n - 1)] + 1, 0)
        group = rank[at]
        new = np.lexsort((following, group))
        order[active] = at = at[new]
        group, following = group[new], following[new]
        apart = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        group = active[np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))]
        rank[at] = group
        active = active[_grouped(group)]
        length *= 2


def _match(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on in direction ``step``, at most ``most``."""
    done = np.zeros(len(a), np.int64)
    active = np.flatnonzero(most > 0)
    chunk = 16
    while len(active):
        late = []
        size = max(1, COMPARED // chunk)
        for at in range(0, len(active), size):
            part = active[at : at + size]
            left = most[part] - done[part]
            reach = np.arange(chunk)
            inside = reach < left[:, None]
            offset = np.where(inside, done[part][:, None] + reach, 0) * step
            equal = (words[a[part][:, None] + offset] == words[b[part][:, None] + offset]) & inside
            run = np.where(equal.all(axis=1), chunk, equal.argmin(axis=1))
            done[part] += run
            late.append(part[(run == chunk) & (left > chunk)])
        active = np.concatenate(late)
        chunk = min(chunk * 4, COMPARED)
    return done


def _stretches(words: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Maximal ``[start, stop)`` of a period around places known to have it (``words[t] == words[t + period]`` on ``[low, high)``).

    ``begin`` and ``end`` bound the document.  Places of one period are extended only
    as far as the next one, so the words compared for a period are those of the document at most.
    """
    if not len(low):
        return low, high
    order = np.lexsort((low, period, begin))
    b, e, p, lo, hi = begin[order], end[order], period[order], low[order], high[order]
    other = np.concatenate([[True], (b[1:] != b[:-1]) | (p[1:] != p[:-1])])
    # The farthest end so far, within a document and period: groups are set apart by their number.
    span = int(hi.max()) + 1
    number = np.cumsum(other) - 1
    reach = np.maximum.accumulate(hi + number * span) - number * span
    new = other | np.concatenate([[True], lo[1:] > reach[:-1]])
    chain = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    lo, hi = lo[at], reach[np.concatenate([at[1:] - 1, [len(reach) - 1]])]
    b, e, p, other = b[at], e[at], p[at], other[at]
    # To the right at most up to the next place; stretches that get there are one with the next.
    gap = np.where(np.concatenate([other[1:], [True]]), e - hi - p, np.concatenate([lo[1:], [0]]) - hi)
    run = _match(words, hi, np.minimum(hi + p, len(words) - 1), gap, 1)
    apart = np.concatenate([[True], other[1:] | (run[:-1] < gap[:-1])])
    whole = np.cumsum(apart) - 1
    head, tail = np.flatnonzero(apart), np.concatenate([np.flatnonzero(apart)[1:] - 1, [len(lo) - 1]])
    start = lo[head] - _match(words, lo[head] - 1, lo[head] - 1 + p[head], lo[head] - b[head], -1)
    stop = (hi + run + p)[tail]
    start, stop = start[whole], stop[whole]
    out_start, out_stop = np.empty_like(low), np.empty_like(high)
    out_start[order], out_stop[order] = start[chain], stop[chain]
    return out_start, out_stop


def _candidates(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, length, period)``: the ``length`` words at ``place`` occur again a candidate period later."""
    order, levels = suffix_array(words, begin, end)
    tree = WaveletMatrix(order - begin[order])
    found = [(np.zeros(0, np.int64),) * 3]

    def add(place: np.ndarray, length: int, period: np.ndarray) -> None:
        found.append((place, np.full(len(place), length, np.int64), period))

    for level in levels:
        place, low, high, length = level.place, level.low, level.high, level.length
        own = place - begin[place]
        if length == 1 << BASE:
            near = tree.successor(low, high, own + 1)
            some = (near > 0) & (near < own + length)
            add(place[some], length, (near - own)[some])
        one = tree.successor(low, high, own + length)
        some = np.flatnonzero((one > 0) & (one < own + 2 * length))
        place, low, high, own, one = place[some], low[some], high[some], own[some], one[some]
        add(place, length, one - own)
        two = tree.successor(low, high, one + 1)
        some = np.flatnonzero((two > 0) & (two < own + 2 * length))
        place, own, one, two = place[some], own[some], one[some], two[some]
        add(place, length, two - own)
        step = two - one
        some = np.flatnonzero(2 * step <= length)
        place, own, one, step = place[some], own[some], one[some], step[some]
        there = place + one - own
        b, e = begin[place], end[place]
        x, y = _stretches(words, b, e, step, place, place + length - step)
        x_there, y_there = _stretches(words, b, e, step, there, there + length - step)
        for period in (x_there - x, y_there - y):
            fits = (period >= length) & (period < 2 * length) & ((period - one + own) % step == 0)
            fits &= (place + period >= x_there) & (place + period + length <= y_there)
            add(place[fits], length, period[fits])
    return tuple(np.concatenate(c) for c in zip(*found))


def runs_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length, period)`` of all runs, in order, of documents laid end to end.

    ``words`` numbers the words; only equality within a document counts.
    """
    ends = np.cumsum(lengths)
    document = np.repeat(np.arange(len(lengths)), lengths)
    begin, end = (ends - lengths)[document], ends[document]
    words = words.astype(np.int64) + document * (int(words.max(initial=0)) + 1)
    place, block, period = _candidates(words, begin, end)
    start, stop = _stretches(words, begin[place], end[place], period, place, place + block)
    fits = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, stop, period = start[fits], stop[fits], period[fits]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    return document[start], start - begin[start], stop - start, period


def _marked(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change[:-1]) > 0


def _analyse(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(texts)
    # An empty text is split into one empty word.
    lengths = np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    large = lengths >= LEAST_WORDS
    chosen = np.repeat(large, lengths)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
    document, start, length, period = runs_of(codes[chosen], lengths[large])
    document = np.flatnonzero(large)[document]
    at = (np.cumsum(lengths) - lengths)[document] + start
    kept = ~_marked(len(words), at + period, at + length)
    left = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
    collapsed = pc.binary_join(_list(left, words.filter(pa.array(kept))), " ")
    found = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"])
    counts = np.bincount(document, minlength=len(lengths))
    return pa.RecordBatch.from_arrays([keys, pa.array(lengths, pa.int64()), _list(counts, found), collapsed], ["key", "n_words", "runs", "collapsed"])


def _list(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.columns
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(keys):
            before = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + BATCH_BYTES, "right")))
            yield _analyse(keys.slice(at, stop - at), texts.slice(at, stop - at))
            at = stop


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, runs, collapsed)`` for every row.

    Words are what ASCII white space parts.  ``runs`` lists every maximal stretch of at
    least 24 words and three periods as ``(start, length, period)``, by start and period; the
    period is the smallest one.  ``collapsed`` are the words that no run repeats, joined by
    one space: of every run its first period stays, unless another run drops it.  Null and
    empty texts have no words, no runs and an empty text; repeated rows and null keys are
    rows of their own; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_finder, f"key {kind}, n_words bigint, runs {RUN}, collapsed string").withColumnRenamed("key", key)


def with_planted_run(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows' keys and texts; in every tenth text, by a checksum of the key, the end repeats a period.

    With ``h = crc32(key)`` and ``g = h div 10``, if ``h mod 10`` is 0, word ``i >= a`` becomes word
    ``a + (i - a) mod p``, for ``a = g mod n`` and ``p = 1 + (n - a) div (3 + g mod 8)``.  Texts
    without words, and rows without a key, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")

        def at(i: Column, a: Column) -> Column:
            period = 1 + F.floor((n - a) / (3 + g % 8))
            return F.when(i < a, i).otherwise(a + (i - a) % period).cast("int")

        spelled = let(g % n, lambda a: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, at(i, a))))
        return F.when(n > 0, F.array_join(spelled, " ")).otherwise(F.col(text))

    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    edited = F.when((h % 10 == 0) & F.col(text).isNotNull(), let(words, repeated)).otherwise(F.col(text))
    return docs.select(F.col(key), edited.alias(text))


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the one with most periods, and digests of all runs and of the collapsed text.

    Two quotients of different small integers never round to the same double, and equal
    quotients always do, so comparing doubles compares exactly.
    """
    strongest = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")
    )))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("*", strongest.alias("_strongest")).select(
        key, F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_strongest.start")).alias("start"), F.col("_strongest.length").alias("length"),
        (-F.col("_strongest.period")).alias("period"),
        F.floor(1000 * F.col("_strongest.length") / -F.col("_strongest.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
