"""Near-duplicates by 64-bit SimHash fingerprints, pivot distance tables and components.

1. ``fingerprints``: one per text, in one pass over the texts, no shuffle.
2. Equal fingerprints are one node, so copies never meet each other.
3. ``links``: distinct fingerprints within ``radius`` bits. Splitting 64 bits into
   ``radius + 3`` blocks, two such fingerprints agree in three blocks at least, so they
   share one of the C(blocks, 3) cells named by three blocks' bits. Inside a cell the
   method proper runs: the Hamming distances to ``PIVOTS`` reference fingerprints are
   computed once per fingerprint; a pair whose largest difference of coordinates exceeds
   the radius cannot be that close (triangle inequality) and is discarded; survivors are
   verified by their own distance. A cell of over ``CELL`` fingerprints is cut into slices and
   every pair of slices is its own piece of work, spread over tasks.
4. ``components``: large-star and small-star contraction on tables in the shared folder.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import Batches, by_slices, dropped, stored
from labelscope.operators.joins import hot_hashes, lookup_join

RADIUS = 3
PIVOTS = 24
CELL = 2048
_SMALL = 16  # runs up to this size are compared by offsets, all runs of a batch at once


# --- fingerprints -------------------------------------------------------------


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of one UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(line, 42)
    counts, m = np.zeros(64, np.int64), n - width + 1
    for at in range(0, m, 1 << 16):  # bounded memory for very long texts
        part = range(at, min(m, at + (1 << 16)))
        hashes = np.array(
            [digest(line[a:b - 1], 42) for a, b in zip(starts[part.start:part.stop], starts[part.start + width:], strict=False)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, ``fp`` (signed 64 bits) and the columns in ``keep`` of every row.

    Null, empty and blank texts get 0; a text of fewer words than a shingle is one
    shingle; texts of any length count whole. Rows are kept as they are, repeated ones
    and null ids too; other columns are left behind.
    """

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]]
        )

    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *kept)
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    fields = [f"id {kinds[0]}", "fp bigint", *[f"_keep{i} {kind}" for i, kind in enumerate(kinds[2:])]]
    return rows.mapInArrow(by_slices(convert, "text"), ", ".join(fields)).toDF(id_col, "fp", *keep)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- pairs by pivots ------------------------------------------------------------


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, spread like hashes."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(count)], np.uint64)


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (rows) to every reference (columns)."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def verified(fps, table, i, j, radius: int):
    """Those of the pairs (i, j) that are links: coordinates first, then the distance."""
    for k in range(table.shape[1]):
        near = np.abs(table[i, k] - table[j, k]) <= radius
        i, j = i[near], j[near]
    close = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[close], j[close]


def _forest(fps: np.ndarray, table: np.ndarray, radius: int, rows: int = 256):
    """Links that join what a large run joins, at most one per fingerprint."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    root, n = np.arange(len(fps)), len(fps)
    for a in range(0, n, rows):
        b = min(n, a + rows)
        # Sorted by the first coordinate: only a window of rows can be near.
        stop = int(np.searchsorted(table[:, 0], table[b - 1, 0] + radius, "right"))
        near = np.abs(table[a:b, None, 0] - table[None, a:stop, 0]) <= radius
        for k in (1, 2, 3):
            near &= np.abs(table[a:b, None, k] - table[None, a:stop, k]) <= radius
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        i, j = i[i < j], j[i < j]
        i, j = verified(fps, table[:, 4:], i, j, radius)
        while True:
            x, y = root[i], root[j]
            if not (apart := x != y).any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
    moved = root != np.arange(n)
    return fps[moved], fps[root[moved]]


def _runs_to_links(radius: int, count: int):
    """mapInArrow: rows sorted by cell and piece (all columns but the last) to links."""

    def links_of(keys: np.ndarray, fps: np.ndarray, references: np.ndarray):
        table = distance_table(fps, references)
        new = np.ones(len(fps), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        run = np.cumsum(new) - 1
        sizes = np.bincount(run)
        small = sizes[run] <= _SMALL
        found = []
        for d in range(1, _SMALL):
            i = np.nonzero(small[:-d] & (run[:-d] == run[d:]))[0] if d < len(run) else np.array([], int)
            if not len(i):
                break
            i, j = verified(fps, table, i, i + d, radius)
            found.append((fps[i], fps[j]))
        starts = np.nonzero(new)[0]
        for r in np.nonzero(sizes > _SMALL)[0]:
            part = slice(starts[r], starts[r] + sizes[r])
            found.append(_forest(fps[part], table[part], radius))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (fps[:0], fps[:0])
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["src", "dst"])

    def run(batches: Batches) -> Batches:
        references = pivots(count)
        keys, fps = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(columns[:4], axis=1)])
            fps = np.concatenate([fps, columns[4].view(np.uint64)])
            # The last run may go on in the next batch. It has about 2 * CELL rows at most.
            last = int(np.argmax((keys == keys[-1]).all(axis=1))) if len(keys) else 0
            if last:
                yield links_of(keys[:last], fps[:last], references)
                keys, fps = keys[last:], fps[last:]
        if len(fps):
            yield links_of(keys, fps, references)

    return run


def _masks(radius: int) -> list[int]:
    blocks = radius + 3
    edges = [64 * i // blocks for i in range(blocks + 1)]
    of = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(of[i] for i in chosen) for chosen in combinations(range(blocks), 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = RADIUS, cell: int = CELL, count: int = PIVOTS) -> DataFrame:
    """Links between the distinct fingerprints in ``fp``: ``src`` > ``dst``, within ``radius`` bits.

    Enough of them to join all that is linked: in cells of many fingerprints a spanning
    forest of each piece instead of all its pairs. No pair is left out for a cell's size.
    """
    cells = nodes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(radius)])).alias("mask", "key")
    )
    sizes = cells.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cells.join(sizes.hint("merge"), ["mask", "key"])
    slices = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), slices).cast("int")
    pieces = (
        shared.select("mask", "key", "fp", slices.alias("slices"), mine.alias("mine"))
        .select("mask", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
        .select("mask", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")
    )
    order = ["mask", "key", "a", "b"]
    return (
        pieces.repartition(*order).sortWithinPartitions(*order)
        .mapInArrow(_runs_to_links(radius, count), "src bigint, dst bigint")
        .distinct()
    )


# --- components -------------------------------------------------------------------


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("least"))
    # The centre of a star has as many links as its group has members: it is sliced.
    moved = lookup_join(both.where("dst > src"), least.hint("merge"), ["src"], "inner", hot_hashes(both, ["src"]), spread=("dst",))
    return moved.select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least.hint("merge"), "src").where("dst > least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``src`` and its component's least node ``dst``, for every node with a link but that one.

    ``edges`` have src > dst. Each round replaces links by links to smaller neighbours,
    with combinable minima only, and stores them; it ends when nothing changes.
    """
    spark, edges, seen = edges.sparkSession, stored(edges, "links"), None
    while True:
        mark = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()
        if mark == seen or not mark[0]:
            return edges
        seen, old = mark, edges.stored_at
        edges = stored(_small_star(_large_star(edges)), "links")
        dropped(spark, old)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """``id_col``, ``fp``, ``component_id`` (least id reachable) and ``component_fp`` of every row.

    ``component_fp`` is a fingerprint of the component, the same for all its rows and for no other;
    the least id is not, where rows of one id lie in several.
    Rows with fingerprints at most ``radius`` bits apart are linked, and links of links
    count; equal fingerprints, those of empty texts too, are linked like any other.
    Repeated rows are repeated in the result; a null id counts as larger than any, and a
    component of null ids only has a null component_id; an empty table gives none.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints").withColumnRenamed(id_col, "id")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    joined = components(links(nodes.select("fp"), radius))
    members = nodes.join(joined.select(F.col("src").alias("fp"), F.col("dst").alias("root")).hint("merge"), "fp", "left")
    members = members.withColumn("root", F.coalesce("root", "fp"))
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    # Most roots have one member; the others' members are looked up by root.
    answer = members.join(roots.hint("merge"), "root").select("fp", "component_id", F.col("root").alias("component_fp"))
    answer = stored(answer, "members")
    result = lookup_join(prints, answer.hint("merge"), ["fp"], "inner", hot_hashes(prints, ["fp"]), spread=("id",))
    return result.select(F.col("id").alias(id_col), "fp", "component_id", "component_fp")


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS
) -> DataFrame:
    """One row of every component of ``near_duplicates``, columns unchanged.

    It has the least id, of several fingerprints of that id the least, and of several rows of that
    fingerprint the least by all columns in turn (those that can be ordered). So rows of one id with
    different texts are judged apart: in different components each stays. Rows without an id stay,
    as no result can name them. An empty table gives none.
    """
    found = near_duplicates(docs, id_col, text_col, width, radius).withColumnRenamed(id_col, "id").where("id IS NOT NULL")
    first = found.where(F.col("id") == F.col("component_id")).groupBy("component_fp", "id").agg(F.min("fp").alias("fp"))
    rows_of = found.groupBy("id").agg(F.count("*").alias("n"))
    chosen = stored(first.join(rows_of.hint("merge"), "id").select("id", "fp", "n"), "chosen")
    # Rows are packed, so that their columns may have any names.
    packed = docs.select(F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row"))
    # Most ids have one row, which is found by the id alone.
    single = packed.join(chosen.where("n = 1").select("id").hint("merge"), "id", "left_semi").select("row")
    again = chosen.where("n > 1").select("id", "fp")
    unnamed = packed.where("id IS NULL").select("row")
    if again.isEmpty():  # no id repeats: texts are shuffled once
        return single.unionByName(unnamed).select("row.*")
    several = packed.join(again.select("id").distinct().hint("merge"), "id", "left_semi")
    several = several.select("id", F.col("row")[text_col].alias("text"), "row")
    least = fingerprints(several, "id", "text", width, ("row",)).groupBy("id", "fp").agg(F.min("row").alias("row"))
    rows = least.join(again.hint("merge"), ["id", "fp"], "left_semi").select("row")
    return single.unionByName(rows).unionByName(unnamed).select("row.*")
