"""Removing byte strings that occur more than once, by a distributed difference-cover sort.

What the sort works on. A string of ``length`` bytes that occurs twice has in both places the same
least hash among its windows of half that length. Windows that are least somewhere (about one in
85 bytes) are counted over all texts; the text around those met again is cut into pieces, equal texts
being one with a count, and pieces of alike windows are put together into blocks of bounded size.
Nothing outside the pieces can be part of a repeated string.

The sort. Text is read in letters of a tenth of ``length`` bytes, at every offset, and places whose
letter number is 1 or 2 modulo 3 are the sample. Sampled triples of letters are sorted and named by
their ranks; the names make a string of their own, whose triples are sorted and named in turn. By
then a name spans nine letters of ten, and the recursion ends. Then the remaining suffixes are merged
in: for any two places there is a shift of 0, 1 or 2 letters after which both are sampled (the cover's
property), so prefixes are compared as the letters before the shift, the names from there on and the
letters left over, and stand next to each other where they are equal.

How it is spread. A block sends each distinct key once, with a mark if it has it twice, to the bucket
of the key's range; the bucket sorts, and answers every block in the order it was asked: which keys
are repeated, and while naming their ranks. Triples that are not are asked about no further. So a string in a third of all texts is one key a block, however
many texts there are. Keys are 64-bit fingerprints of letters and names, so their order is not that of
the bytes; only equality counts here, and texts that differ would have to collide in one name and agree
in all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import Batches, by_slices, dropped, stored

LENGTH = 400
BLOCK_BYTES = 1 << 20
BUCKET_KEYS = 1 << 20
_MOST_STARTS = 1 << 20  # of a piece
_LETTERS = 10  # in LENGTH; what is left over goes with the last
_RANK_BITS = 40

SPANS = "array<struct<start:int,stop:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key for several, in order."""
    key = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for part in parts:
        key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(32)
    return key


class Windows:
    """Fingerprints of the windows of a byte array, equal for equal windows of any array."""

    base = 0x2545F4914F6CDD1D
    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        cls = type(self)
        while (known := len(cls.powers)) < len(data):
            more = min(known, len(data) - known)
            step = pow(cls.base, known, 1 << 64)
            back = pow(step, -1, 1 << 64)
            cls.powers = np.append(cls.powers, cls.powers[:more] * np.uint64(step))
            cls.inverses = np.append(cls.inverses, cls.inverses[:more] * np.uint64(back))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        np.cumsum(values * cls.powers[: len(data)], out=self.sums[1:])

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        if not size:
            return np.zeros(len(at), np.uint64)
        return mixed((self.sums[at + size] - self.sums[at]) * self.inverses[at])


def sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """The best of each ``width`` neighbouring values."""
    padded = np.append(values, np.full(-len(values) % width, worst, values.dtype)).reshape(-1, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return best(behind[:count], ahead[width - 1: width - 1 + count])


def anchors(data: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints of the half-length windows that are least in some string of ``length``.

    ``left`` has the number of bytes from each place to the end of its text.
    """
    gram = length // 2
    width = length - gram + 1
    places = np.flatnonzero(left >= gram)
    starts = np.flatnonzero(left >= length)
    if not len(starts):
        return starts, starts.astype(np.uint64)
    worst = np.uint64(2**64 - 1)
    keys = np.full(len(data), worst, np.uint64)
    keys[places] = Windows(data).prints(places, gram) >> np.uint64(1)
    least = np.zeros(len(data), np.uint64)
    least[starts] = sliding(keys, width, np.minimum, 2**64 - 1)[starts]
    # A window is least somewhere if it equals one of the least values at or before it.
    reach = sliding(np.append(np.zeros(width - 1, np.uint64), least), width, np.maximum, 0)
    found = np.flatnonzero(reach == keys)
    return found, keys[found]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the end of each text, and the bytes left at each place."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return data, ends, np.repeat(ends, sizes) - np.arange(len(data))


def _anchor_rows(length: int):
    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ends, left = _joined(batch.column(1).to_pylist())
        at, keys = anchors(data, left, length)
        of = np.searchsorted(ends, at, "right")
        starts = np.append(0, ends[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(of)), pa.array((at - starts[of]).astype(np.int32))],
            ["h", "k", "at"],
        )

    return by_slices(convert, "data", 1 << 20)


# --- pieces and blocks -----------------------------------------------------------------------


def _pieces(length: int, most: int):
    """mapInArrow: texts with their repeated windows to the pieces that may hold repeated strings."""
    before = length - length // 2

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, data, marks, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marks = sorted((m["at"], m["h"]) for m in marks)
            at = np.array([m[0] for m in marks], np.int64)
            of = np.array([m[1] for m in marks], np.int64)
            low, high = np.maximum(at - before, 0), np.minimum(at, len(data) - length)
            low, high, of = low[low <= high], high[low <= high], of[low <= high]
            if not len(low):
                continue
            first = np.flatnonzero(np.append(True, low[1:] > high[:-1] + 1))
            alike = np.minimum.reduceat(of, first)
            stops = np.append(first[1:], len(low)) - 1
            for a, b, like in zip(low[first].tolist(), high[stops].tolist(), alike.tolist(), strict=True):
                for start in range(a, b + 1, most):
                    stop = min(start + most, b + 1)  # of the starts
                    rows.append((key, start, copies, like, data[start: stop - 1 + length]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "at", "copies", "alike", "data"]
        )

    return by_slices(convert, "data", 4 << 20)


def _blocks(most: int):
    """mapInArrow: pieces to blocks of ``most`` bytes, or one piece more."""

    def block(rows: list) -> pa.RecordBatch:
        keys, at, copies, _, data = zip(*rows, strict=True)
        sizes = [len(d) for d in data]
        columns = [
            pa.array([list(keys)], pa.list_(pa.binary())), pa.array([list(at)], pa.list_(pa.int32())),
            pa.array([list(copies)], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())),
            pa.array([b"".join(data)], pa.binary()), pa.array([sum(sizes)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["keys", "at", "copies", "sizes", "data", "n"])

    def run(batches: Batches) -> Batches:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                rows.append([x.as_py() for x in row])
                size += len(rows[-1][4])
                if size >= most:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    return run


class Block:
    """The places of one block, and their keys at each step of the sort."""

    def __init__(self, data: bytes, sizes: list[int], copies: list[int], length: int) -> None:
        self.length, self.letter = length, length // _LETTERS
        self.data = np.frombuffer(data, np.uint8)
        sizes = np.array(sizes, np.int32)
        ends, n = np.cumsum(sizes, dtype=np.int32), np.arange(len(data), dtype=np.int32)
        self.left = np.repeat(ends, sizes) - n
        self.many = np.repeat(np.array(copies) > 1, sizes)
        self.residue = ((n - np.repeat(ends - sizes, sizes)) // np.int32(self.letter) % np.int32(3)).astype(np.int8)
        self.windows = Windows(self.data)
        self.names = []

    def sampled(self, letters: int) -> np.ndarray:
        return np.flatnonzero((self.residue > 0) & (self.left >= letters * self.letter))

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sample and their triples, of letters or of names."""
        if not self.names:
            at = self.sampled(3)
            return at, self.windows.prints(at, 3 * self.letter)
        at, names, step = self.sampled(9), self.names[-1], 3 * self.letter
        at = at[(names[at] > 0) & (names[at + step] > 0) & (names[at + 2 * step] > 0)]
        return at, mixed(names[at], names[at + step], names[at + 2 * step])

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Every place with ``length`` bytes ahead, twice: once for each shift that can meet others."""
        short, long = self.names
        one, prints = self.letter, self.windows.prints
        rest = self.length - _LETTERS * one
        starts = self.left >= self.length

        def places(residues: tuple[int, int]) -> np.ndarray:
            return np.flatnonzero(starts & ((self.residue == residues[0]) | (self.residue == residues[1])))

        at, both, last = (places(r) for r in ((1, 2), (0, 1), (0, 2)))
        # A prefix with a name that only it has is not repeated.
        at, both = at[long[at] > 0], both[long[both + one] > 0]
        last = last[(short[last + 2 * one] > 0) & (short[last + 5 * one] > 0)]
        by_none = mixed(np.zeros(len(at), np.uint64), long[at], prints(at + 9 * one, one + rest))
        by_one = mixed(np.full(len(both), 1, np.uint64), prints(both, one), long[both + one], prints(both + 10 * one, rest))
        by_two = mixed(
            np.full(len(last), 2, np.uint64), prints(last, 2 * one), short[last + 2 * one], short[last + 5 * one],
            prints(last + 8 * one, 2 * one + rest),
        )
        return np.concatenate([at, both, last]), np.concatenate([by_none, by_one, by_two])

    def take(self, at: np.ndarray, names: np.ndarray) -> None:
        every = np.zeros(len(self.data), np.uint64)
        every[at] = names
        self.names.append(every)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range a key lies in, of as many even ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _distinct(keys: np.ndarray, buckets: int):
    """Sorted keys, where each key is among them, and the places where a new bucket begins."""
    sorted_keys, inverse = np.unique(keys, return_inverse=True)
    of = bucket_of(sorted_keys, buckets)
    cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
    return sorted_keys, inverse, of, cuts


def _named(block: Block, replies: list[list[dict]], buckets: int) -> None:
    """Go through the steps of the sort that are answered; a triple that occurs once is named 0."""
    for reply in replies:
        at, keys = block.triples()
        asked, inverse, of, cuts = _distinct(keys, buckets)
        names = np.zeros(len(asked), np.uint64)
        for r, a, b in zip(reply or [], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            bits = (b - a + 7) // 8
            again = np.unpackbits(np.frombuffer(r["reply"], np.uint8, bits), count=b - a).astype(bool)
            ranks = np.cumsum(np.frombuffer(r["reply"], np.uint32, offset=bits), dtype=np.uint64)
            names[a:b][again] = ((of[a:b][again] << np.uint64(_RANK_BITS)) | ranks) + np.uint64(1)
        block.take(at, names[inverse])


def _ask(step: int, buckets: int, length: int):
    """mapInArrow: blocks and the answers so far to what each block asks the buckets."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for bid, data, sizes, copies, *replies in zip(*batch.columns, strict=True):
                block = Block(data.as_py(), sizes.as_py(), copies.as_py(), length)
                _named(block, [r.as_py() for r in replies], buckets)
                at, keys = block.triples() if step < 2 else block.prefixes()
                asked, inverse, of, cuts = _distinct(keys, buckets)
                many = np.bincount(inverse, 1 + block.many[at], len(asked)) > 1
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bid.as_py()] * len(parts), pa.int64()), pa.array(of[cuts[:-1]].astype(np.int32)),
                        pa.array([asked[a:b].tobytes() for a, b in parts], pa.binary()),
                        pa.array([np.packbits(many[a:b]).tobytes() for a, b in parts], pa.binary()),
                    ],
                    ["bid", "bucket", "asked", "many"],
                )

    return run


def _answer(step: int):
    """applyInArrow: all that is asked of one bucket to the answers, in the order of the questions."""

    def run(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x, np.uint64) for x in table["asked"].to_pylist()]
        keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        stops = np.cumsum([len(x) for x in asked]).tolist()
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(table["many"].to_pylist(), asked, strict=True)]
        again = np.bincount(inverse, 1 + np.concatenate(many), len(keys)) > 1
        replies = []
        for x, stop in zip(asked, stops, strict=True):
            ranks = inverse[stop - len(x):stop]
            told = np.packbits(again[ranks]).tobytes()
            if step < 2:  # ranks rise with the keys: their steps take little room
                told += np.diff(ranks[again[ranks]], prepend=0).astype(np.uint32).tobytes()
            replies.append(told)
        return pa.Table.from_arrays(
            [table["bid"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(replies, pa.binary())],
            ["bid", "bucket", "reply"],
        )

    return run


def _found(buckets: int, length: int):
    """mapInArrow: blocks and all answers to the repeated stretches of each text's piece."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for keys, starts, data, sizes, copies, *replies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(data, sizes, copies, length)
                _named(block, replies[:2], buckets)
                at, prefixes = block.prefixes()
                _, inverse, _, cuts = _distinct(prefixes, buckets)
                counts = np.diff(cuts).tolist()
                bits = [
                    np.unpackbits(np.frombuffer(r["reply"], np.uint8), count=c) for r, c in zip(replies[2], counts, strict=True)
                ]
                again = np.zeros(len(block.data) + 1, bool)
                again[at[np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)[inverse]]] = True
                rows, begin = [], 0
                for key, start, size in zip(keys, starts, sizes, strict=True):
                    edges = np.flatnonzero(np.diff(again[begin:begin + size].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    if len(edges):
                        spans = (edges + [start, start + length - 1]).tolist()
                        rows.append((key, [{"start": a, "stop": b} for a, b in spans]))
                    begin += size
                of, spans = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(spans, _ARROW_SPANS)], ["key", "spans"])

    return run


def text_key(data: str) -> Column:
    return F.unhex(F.sha2(data, 256))


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS
) -> DataFrame:
    """``key`` (SHA-256) and ``spans`` of every distinct text in the binary column ``data`` that has any.

    Spans are the bytes covered by strings of ``length`` bytes that start somewhere else too; those of
    one text may overlap and come in any order. The table is stored; shorter texts and nulls have none.
    """
    if length < 2 * _LETTERS:
        raise ValueError(f"strings must have {2 * _LETTERS} bytes at least")
    keyed = texts.where(F.octet_length("data") >= length).select(F.xxhash64("data").alias("k"), "data")
    marks = stored(keyed.mapInArrow(_anchor_rows(length), "h bigint, k bigint, at int"), "anchors")
    again = stored(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "windows")
    # k only says where to look: texts that share it by chance are both looked at.
    around = stored(marks.join(again, "h").groupBy("k").agg(F.collect_set(F.struct("at", "h")).alias("marks")), "marks")
    distinct = (
        keyed.join(around, "k").groupBy(text_key("data").alias("key"))
        .agg(F.first("data").alias("data"), F.first("marks").alias("marks"), F.count("*").alias("n"))
        .select("key", "data", "marks", F.least("n", F.lit(2)).cast("int").alias("copies"))
    )
    pieces = distinct.mapInArrow(
        _pieces(length, _MOST_STARTS), "key binary, at int, copies int, alike bigint, data binary"
    )
    blocks = pieces.hint("rebalance", "alike").sortWithinPartitions("alike").mapInArrow(
        _blocks(block_bytes),
        "keys array<binary>, at array<int>, copies array<int>, sizes array<int>, data binary, n bigint",
    )
    blocks = stored(blocks.withColumn("bid", F.monotonically_increasing_id()), "blocks")
    for table in (marks, again, around):
        dropped(blocks.sparkSession, table.stored_at)
    buckets = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // bucket_keys))
    known, answers = blocks, []
    for step in range(3):
        asked = known.select("bid", "data", "sizes", "copies", *[f"step{s}" for s in range(step)]).mapInArrow(
            _ask(step, buckets, length), "bid bigint, bucket int, asked binary, many binary"
        )
        replies = asked.groupBy("bucket").applyInArrow(_answer(step), "bid bigint, bucket int, reply binary")
        by_block = replies.groupBy("bid").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias(f"step{step}"))
        answers.append(stored(by_block, "answers"))
        known = known.join(answers[-1], "bid", "left")
    rows = known.select("keys", "at", "data", "sizes", "copies", *[F.coalesce(f"step{s}", F.array()).alias(f"step{s}") for s in range(3)])
    found = rows.mapInArrow(_found(buckets, length), f"key binary, spans {SPANS}")
    spans = stored(found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for table in (blocks, *answers):
        dropped(blocks.sparkSession, table.stored_at)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal stretches the spans cover."""
    done: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if done and start <= done[-1][1]:
            done[-1] = (done[-1][0], max(stop, done[-1][1]))
        else:
            done.append((start, stop))
    return done


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept, told = [], []
    for data, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
        runs = merged(spans)
        told.append([{"start": a, "stop": b} for a, b in runs])
        data = data.as_py()
        edges = [0, *[x for run in runs for x in run], len(data)]
        kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else data)
    sizes = pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), sizes, pa.array(told, _ARROW_SPANS), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"]
    )


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    block_bytes: int = BLOCK_BYTES,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``spans`` (maximal, in order) and ``kept`` bytes of every row.

    Bytes covered by any string of ``length`` bytes that starts anywhere else, in the same or another
    row, are left out; strings do not cross rows, and all are judged on the input. So of exact copies
    of ``length`` bytes or more nothing stays, in any of them. A null text is empty; shorter texts stay
    whole; ``kept`` is binary, as a cut may fall inside a character. Repeated rows and null ids stay;
    other columns are left behind; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data")
    rows = docs.select(F.col(id_col).alias("id"), data)
    spans = repeated_spans(rows.select("data"), length, block_bytes, bucket_keys)
    joined = rows.withColumn("key", text_key("data")).join(spans, "key", "left").select("id", "data", "spans")
    cut = joined.mapInArrow(by_slices(_cut, "data", 4 << 20), f"id {kind}, n_bytes bigint, spans {SPANS}, kept binary")
    return cut.withColumnRenamed("id", id_col)
