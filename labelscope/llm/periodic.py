"""Runs of repeating words in a text, and the text with each run cut to its first period.

A run is a stretch of consecutive words with least period q that no neighbouring word extends.
Every run [s, e) shows in the suffixes at s and s + q: they share e - s - q words, and no suffix
between them shares as many. So the suffixes of a document are sorted, and classes of suffixes
are united by falling length of their common prefix (Kruskal over neighbours in suffix order),
each class keeping its positions in order. When a union at length l makes two positions
neighbours, at a distance p that fits l, the run of period p from the first of them is l + p
words long; it is reported by its leftmost pair.

Suffixes of many documents are sorted at once by doubling (numpy), and positions drop out as
soon as nothing in their document equals them. A document is handled by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import by_slices

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _first_of_class(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _alone(new: np.ndarray) -> np.ndarray:
    return new & np.append(new[1:], True)


def rank_levels(symbols: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ranks of windows of 1, 2, 4, ... symbols, and which positions share theirs.

    ``ends`` has the end of each position's document, whose symbols occur in no other. Two
    positions have one rank if their windows are equal; the last ranks are those of suffixes.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order][1:] != symbols[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = _first_of_class(new)
    live = order[~_alone(new)]
    levels, shared, width = [rank], [live], 1
    while len(live):
        then = live + width
        second = np.where(then < ends[live], rank[np.minimum(then, n - 1)], -1)
        order = np.argsort(rank[live] * (n + 1) + second + 1, kind="stable")
        live, second = live[order], second[order]
        first, new, outer = rank[live], np.ones(len(live), bool), np.ones(len(live), bool)
        outer[1:] = first[1:] != first[:-1]
        new[1:] = outer[1:] | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[live] = first + _first_of_class(new) - _first_of_class(outer)
        live = live[~_alone(new)]
        levels.append(rank)
        shared.append(live)
        width *= 2
    return levels, shared


def common_prefix(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Symbols the suffixes at i and at j share; i and j differ."""
    n, length = len(levels[0]), np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i + length, j + length
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        length += (inside & (levels[k][a] == levels[k][b])).astype(np.int64) << k
    return length


def _united(small: list[int], big: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions that are neighbours in the union, but were in neither set."""
    places = [bisect_left(big, x) for x in small]
    pairs, last = [], len(small) - 1
    for k, (x, at) in enumerate(zip(small, places, strict=True)):
        if at and (k == 0 or places[k - 1] != at):
            pairs.append((big[at - 1], x))
        if at < len(big) and (k == last or places[k + 1] != at):
            pairs.append((x, big[at]))
    return pairs


def seeds(positions: list[int], lcp: list[int], least_length: int, exponent: int):
    """(start, length, period) of every seed in a class of suffixes, given in suffix order.

    ``lcp[k]`` belongs to positions k and k + 1.
    """
    parent, sets = list(range(len(positions))), [[p] for p in positions]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for edge in sorted(range(len(lcp)), key=lcp.__getitem__, reverse=True):
        shared, a, b = lcp[edge], root(edge), root(edge + 1)
        if len(sets[a]) > len(sets[b]):
            a, b = b, a
        small, big = sets[a], sets[b]
        for x, y in _united(small, big):
            period = y - x
            if shared >= (exponent - 1) * period and shared + period >= least_length:
                yield x, shared + period, period
        if len(small) < 8:
            for x in small:
                insort(big, x)
        else:
            big += small
            big.sort()
        parent[a], sets[a] = b, []


def find_runs(symbols: np.ndarray, ends: np.ndarray, least_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    # The shortest common prefix that any run can show.
    floor = min(max((exponent - 1) * q, least_length - q) for q in range(1, least_length + 1))
    if not len(symbols):
        return []
    levels, shared = rank_levels(symbols, ends)
    level = max(floor, 1).bit_length() - 1
    if level >= len(shared) or not len(shared[level]):
        return []
    order = shared[level][np.argsort(levels[-1][shared[level]], kind="stable")]
    lcp = common_prefix(levels, order[:-1], order[1:])
    chain = np.zeros(len(order), np.int64)
    chain[1:] = np.cumsum(lcp < floor)
    # A class whose nearest positions are too far apart for its longest prefix has no run.
    by_place = np.lexsort((order, chain))
    gap = np.full(len(order), len(symbols), np.int64)
    near = chain[by_place][1:] == chain[by_place][:-1]
    gap[1:][near] = np.diff(order[by_place])[near]
    starts = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    longest = np.maximum.reduceat(np.append(0, np.where(lcp < floor, 0, lcp)), starts)
    fits = (exponent - 1) * np.minimum.reduceat(gap, starts) <= longest
    found, words = [], levels[0]
    stops = np.append(starts[1:], len(order))
    for a, b in zip(starts[fits].tolist(), stops[fits].tolist(), strict=True):
        for start, length, period in seeds(order[a:b].tolist(), lcp[a:b - 1].tolist(), least_length, exponent):
            if not start or words[start - 1] != words[start + period - 1]:
                found.append((start, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def repetitions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, exponent: int = 4
) -> DataFrame:
    """``id_col``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Runs of at least ``least_length`` words and ``exponent`` periods count. ``collapsed`` has the
    words, joined by one space, but those that a run holds after its first period. Null, empty and
    blank texts have no runs and collapse to the empty text; texts count whole, however long;
    repeated rows and null ids stay; other columns are left behind; an empty table gives none.
    """

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [(data or b"").split() for data in batch.column(1).to_pylist()]  # at ASCII white space
        sizes = np.array([len(words) for words in split], np.int64)
        stops = np.cumsum(sizes)
        words = pa.array([w for part in split for w in part], pa.binary()).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = codes + np.repeat(np.arange(len(split)) * max(1, len(words.dictionary)), sizes)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for start, length, period in find_runs(symbols, np.repeat(stops, sizes), least_length, exponent):
            of = int(np.searchsorted(stops, start, "right"))
            runs[of].append((start - int(stops[of] - sizes[of]), length, period))
        texts = []
        for part, mine in zip(split, runs, strict=True):
            if mine:
                cover = np.zeros(len(part) + 1, np.int64)
                for start, length, period in mine:
                    cover[start + period] += 1
                    cover[start + length] -= 1
                part = [part[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            texts.append(b" ".join(part).decode())
        named = [[dict(zip(("start", "length", "period"), run, strict=True)) for run in mine] for mine in runs]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(named, pa.list_(_ARROW_RUN)), pa.array(texts, pa.string())], ["id", "runs", "collapsed"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(by_slices(convert, "text", 4 << 20), f"id {kind}, runs array<{RUN}>, collapsed string")
    return found.withColumnRenamed("id", id_col)
