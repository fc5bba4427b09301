"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents belong to one source or several. They are aggregated to one row per
membership pattern (the set of sources), and only these sums reach the driver, at most
``MAX_PATTERNS``. There a flow sends words from patterns to the quotas of sources: the
first use of a word costs nothing, each further use one more (convex, so nothing is
repeated while something unused fits), up to ``repeats`` uses. Each pattern's flow is
then drawn as whole documents in a seeded order: all of them as many times as the flow
covers the pattern fully, and one time more those that fit into the remaining words, one
after the other in that order (first fit): a document that does not fit is passed over. A
pattern of few documents, where that could miss much, is filled by the sum nearest to its words,
which may be a little more than them.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.llm.common import stored, word_count

MAX_PATTERNS = 100_000
WEIGHTS = (5, 2, 1)
_BITS = 8  # of the seeded order that a level of bins tells apart
_BINS = 1 << _BITS
FEW_PLACES = 128  # patterns of up to so many places are filled exactly
FILLED_PLACES = 200_000  # of all such patterns
_END = 1 << 60


def targets(sizes: dict, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> dict:
    """Words each source should give: ``share`` of all sizes by weight, at most ``repeats`` times its size.

    Sources are taken by code point, null last, and weigh ``weights`` in turn. What a capped
    source leaves goes to the others by weight until none is above its cap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, given, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        rest, whole = total - sum(given.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / whole > repeats * sizes[s]]
        if not over:
            given |= {s: rest * weight[s] / whole for s in open_}
            break
        given |= {s: float(repeats * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in given]
    return {s: given[s] for s in order}


# --- flow ---------------------------------------------------------------------------


@dataclass
class Flow:
    """Words sent from each pattern to each source."""

    sent: dict[tuple[int, int], int]

    def of_pattern(self, p: int) -> int:
        return sum(w for (q, _), w in self.sent.items() if q == p)


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], repeats: int = 2) -> Flow:
    """The largest flow of least cost: pattern ``p`` holds ``capacity[p]`` words, used up to ``repeats`` times.

    Successive shortest paths with potentials on the graph start -> patterns (one arc per
    use, of cost 0, 1, ...) -> sources -> end (quota).
    """
    n_p, n_s = len(capacity), len(quota)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # to, free, cost, reverse index

    def arc(a: int, b: int, free: int, cost: int) -> None:
        graph[a].append([b, free, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, words in enumerate(capacity):
        for use in range(repeats):
            arc(start, p, words, use)
        for s in members[p]:
            arc(p, n_p + s, repeats * words, 0)
    for s, words in enumerate(quota):
        arc(n_p + s, end, words, 0)
    height = [0] * (end + 1)
    while True:
        far, via = {start: 0}, {}
        heap = [(0, start)]
        done: set[int] = set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for i, (b, free, cost, _) in enumerate(graph[a]):
                new = d + cost + height[a] - height[b]
                if free > 0 and new < far.get(b, 1 << 62):
                    far[b], via[b] = new, (a, i)
                    heapq.heappush(heap, (new, b))
        if end not in far:
            break
        most = max(far.values())
        height = [h + far.get(v, most) for v, h in enumerate(height)]
        path, b = [], end
        while b != start:
            a, i = via[b]
            path.append((a, i))
            b = a
        push = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= push
            graph[graph[a][i][0]][graph[a][i][3]][1] += push
    sent = {}
    for p in range(n_p):
        for b, _, _, back in graph[p]:
            if n_p <= b < start and graph[b][back][1]:
                sent[p, b - n_p] = graph[b][back][1]
    return Flow(sent)


# --- documents ------------------------------------------------------------------------


def _draw(id_col: Column, seed: int) -> Column:
    """Place in the seeded order: 60 bits, so that they stay positive."""
    digest = F.md5(F.concat(F.lit(f"{int(seed)}_"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _members(sources: Column) -> Column:
    """Sorted distinct sources; none at all is the null source."""
    none = F.array(F.lit(None).cast("string"))
    listed = F.coalesce(sources, none)
    return F.sort_array(F.array_distinct(F.when(F.size(listed) == 0, none).otherwise(listed)))


def _round(places: DataFrame, open_: DataFrame) -> DataFrame:
    """Per pattern the first place behind ``after`` that does not fit, and the words missing there.

    ``open_``: pattern, after, gap. Only places of at most ``gap`` words count, as larger ones
    fit nowhere behind ``after``. Prefix sums run over ``_BINS`` bins of the order, then over as many
    parts of the one bin where the gap runs out, then over the places of that part. A pattern
    whose places all fit has no row.
    """
    fit = places.join(F.broadcast(open_), "pattern").where("draw > after AND size <= gap")
    edges = _edge(fit.withColumn("bin", F.shiftright("draw", 60 - _BITS)), F.col("gap"))
    for level in (2, 3):
        inside = fit.drop("gap").join(F.broadcast(edges.withColumnRenamed("bin", "_bin")), "pattern")
        inside = inside.where(F.shiftright("draw", 60 - _BITS * (level - 1)) == F.col("_bin"))
        if level == 2:
            edges = _edge(inside.withColumn("bin", F.shiftright("draw", 60 - _BITS * level)), F.col("left"))
    order = Window.partitionBy("pattern").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = inside.withColumn("upto", F.sum("size").over(order))
    over = F.col("upto") > F.col("left")
    return summed.groupBy("pattern", "left").agg(
        F.min(F.when(over, F.col("draw"))).alias("after"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("upto"),
    ).select("pattern", "after", (F.col("left") - F.col("upto")).alias("gap"))


def _edge(binned: DataFrame, room: Column) -> DataFrame:
    """Per pattern the first bin that exceeds ``room`` words, and the words left in front of it."""
    sums = binned.groupBy("pattern", "bin", room.alias("room")).agg(F.sum("size").alias("words"))
    until = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sums.withColumn("upto", F.sum("words").over(until)).where("upto > room").groupBy("pattern")
        .agg(F.min_by(F.struct("bin", (F.col("room") - F.col("upto") + F.col("words")).alias("left")), "bin").alias("edge"))
        .select("pattern", F.col("edge.bin").alias("bin"), F.col("edge.left").alias("left"))
    )


def exact_fill(sizes: Sequence[int], room: int) -> list[bool]:
    """Which of the places, given in order, come nearest to ``room`` words, of two as near below it.

    Of equal sums, the one that takes a place early in the order if it can.
    """
    reach = [1]  # reach[i]: sums that the last i places can make, as bits
    mask = (1 << (2 * room + 1)) - 1  # beyond, nothing is nearer than no words
    for size in reversed(sizes):
        reach.append((reach[-1] | reach[-1] << size) & mask)
    below = (reach[-1] & ((1 << (room + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> (room + 1)
    next_above = room + (above & -above).bit_length() if above else None  # the lowest bit set
    left = next_above if next_above is not None and next_above - room < room - below else below
    taken = []
    for i, size in enumerate(sizes):
        rest = reach[len(sizes) - 1 - i]
        take = size <= left and bool(rest >> (left - size) & 1)
        taken.append(take)
        left -= size * take
    return taken


def _filled(places: DataFrame, rests: dict[int, int]) -> tuple[list[tuple[int, int, bool]], set[int]]:
    """(pattern, draw, taken) of patterns of few places, filled exactly, and which these are.

    There first fit can leave a large part of the words out. Patterns are taken by their number of
    places as long as no more than ``FEW_PLACES`` each and ``FILLED_PLACES`` in all reach the driver.
    """
    spark = places.sparkSession
    counted = places.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") <= FEW_PLACES).collect()
    chosen, total = [], 0
    for r in sorted(counted, key=lambda r: (r["n"], r["pattern"])):
        if rests.get(r["pattern"], 0) > 0 and total + r["n"] <= FILLED_PLACES:
            chosen.append(r["pattern"])
            total += r["n"]
    if not chosen:
        return [], set()
    table = spark.createDataFrame([(p,) for p in chosen], "pattern int")
    by_pattern: dict[int, list] = {}
    for r in sorted(places.join(F.broadcast(table), "pattern").select("pattern", "draw", "size").collect()):
        by_pattern.setdefault(r["pattern"], []).append((r["draw"], r["size"]))
    out = []
    for p, of in by_pattern.items():
        out += [(p, draw, take) for (draw, _), take in zip(of, exact_fill([n for _, n in of], rests[p]), strict=True)]
    return out, set(chosen)


def _spans(places: DataFrame, rests: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """First fit: (pattern, after, until, most), places of which are used once more.

    A place between ``after`` and ``until``, both not included, is, if it has at most ``most`` words.
    Each round takes one place at least of any pattern that has one that fits, and leaves a
    gap smaller than the place it stops at; rounds end when no pattern has one.
    """
    spark, spans = places.sparkSession, []
    gaps = {p: (-1, w) for p, w in rests.items() if w > 0}
    while gaps:
        open_ = spark.createDataFrame([(p, *g) for p, g in gaps.items()], "pattern int, after bigint, gap bigint")
        found = {r.pattern: (r.after, r.gap) for r in _round(places, open_).collect()}  # MAX_PATTERNS at most
        spans += [(p, after, found.get(p, (_END, 0))[0], gap) for p, (after, gap) in gaps.items()]
        gaps = {p: g for p, g in found.items() if g[1] > 0}
    return spans


@dataclass
class Mixture:
    """``patterns``: members, full, spans (a row for each, MAX_PATTERNS at most); ``decided``:
    members, draw and more, for places that the spans do not decide; ``sources``: source,
    source_size, target, sent."""

    patterns: DataFrame
    decided: DataFrame
    sources: DataFrame
    seed: int

    def uses(self, rows: DataFrame, members: Column, id_col: Column, size: Column) -> DataFrame:
        """``rows`` with ``uses``, how often each is taken.

        Most rows are decided by their place and size; the exceptions are looked up by pattern and
        place, sent out or shuffled as their number asks for.
        """
        limits = self.patterns.select(F.col("members").alias("_members"), F.struct("full", "spans").alias("_limits"))
        placed = rows.withColumns({"_draw": _draw(id_col, self.seed), "_size": size})
        placed = placed.join(F.broadcast(limits), members == F.col("_members"), "left")
        decided = self.decided.select(F.col("members").alias("_of"), F.col("draw").alias("_at"), F.col("more").alias("_more"))
        placed = placed.join(decided, (F.col("_members") == F.col("_of")) & (F.col("_draw") == F.col("_at")), "left")
        inside = lambda s: (F.col("_draw") > s["after"]) & (F.col("_draw") < s["until"]) & (F.col("_size") <= s["most"])
        more = F.coalesce("_more", F.exists("_limits.spans", inside)).cast("int")
        uses = F.when(F.col("_size") > 0, F.col("_limits.full") + more).otherwise(0)
        return placed.withColumn("uses", uses).drop("_members", "_limits", "_draw", "_size", "_of", "_at", "_more")


def mixture(sized: DataFrame, seed: int, weights: Sequence[float], share: float, repeats: int) -> Mixture:
    """Decide the mix from a stored table of id, members and size."""
    spark = sized.sparkSession
    sums = sized.groupBy("members").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sums.sort(key=lambda r: [(s is not None, s or "") for s in r["members"]])
    sizes: dict = {}
    for r in sums:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    wanted = targets(sizes, weights, share, repeats)
    order = {s: i for i, s in enumerate(wanted)}
    members = [[order[s] for s in r["members"]] for r in sums]
    flow = min_cost_flow([r["words"] for r in sums], members, [round(wanted[s]) for s in order], repeats)
    flows, sent = [0] * len(sums), [0] * len(order)
    for (p, s), w in flow.sent.items():
        flows[p] += w
        sent[s] += w
    rows = []
    for p, r in enumerate(sums):
        full = min(repeats, flows[p] // r["words"]) if r["words"] else 0
        rows.append((p, r["members"], full, flows[p] - full * r["words"]))
    patterns = spark.createDataFrame(rows, "pattern int, members array<string>, full int, rest bigint")
    placed = sized.join(F.broadcast(patterns.select("pattern", "members")), "members").withColumn("draw", _draw(F.col("id"), seed))
    places = stored(placed.where("size > 0").groupBy("pattern", "draw").agg(
        F.sum("size").alias("size"), F.min("size").alias("least")), "mix-places")
    filled, exact = _filled(places, {r[0]: r[3] for r in rows})
    spans = _spans(places, {r[0]: r[3] for r in rows if r[0] not in exact})
    spans = spark.createDataFrame(spans, "pattern int, after bigint, until bigint, most bigint")
    # Rows of one id that would fit one by one but do not fit together.
    apart = (
        places.where("least < size").join(F.broadcast(spans), "pattern")
        .where("draw > after AND draw < until AND size > most AND least <= most")
        .select("pattern", "draw", F.lit(False).alias("more")).distinct()
    )
    decided = apart.unionByName(spark.createDataFrame(filled, "pattern int, draw bigint, more boolean"))
    decided = decided.join(F.broadcast(patterns.select("pattern", "members")), "pattern").select("members", "draw", "more")
    spans = spans.groupBy("pattern").agg(F.collect_list(F.struct("after", "until", "most")).alias("spans"))
    none = F.array().cast("array<struct<after:bigint,until:bigint,most:bigint>>")
    limits = patterns.join(spans, "pattern", "left").select("members", "full", F.coalesce("spans", none).alias("spans"))
    table = [(s, sizes[s], float(wanted[s]), sent[i]) for s, i in order.items()]
    return Mixture(
        stored(limits, "mix-limits"),
        stored(decided, "mix-decided"),
        spark.createDataFrame(table, "source string, source_size bigint, target double, sent bigint"), seed,
    )


def sizes_of(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored: id, members (sorted distinct sources) and size in words of every row."""
    size = word_count(F.col(text_col).cast("string")).alias("size")
    return stored(docs.select(F.col(id_col).alias("id"), _members(sources).alias("members"), size), "sizes")


def mix(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 17,
    weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2,
) -> tuple[DataFrame, Mixture]:
    """(id, members, size, uses) of every row, and the mixture that decided it.

    ``sources`` is a column of array<string>: the sources a document belongs to, which may
    overlap; a null element, a null or an empty array is the null source. Null and empty
    texts have size 0 and are never used; no row is used more than ``repeats`` times; rows
    of equal id share a place in the seeded order, so they are used alike, null ids too.
    An empty table gives empty results. Reruns agree, whatever the partitioning. Other
    columns of ``docs`` are left behind.
    """
    sized = sizes_of(docs, sources, id_col, text_col)
    plan = mixture(sized, seed, weights, share, repeats)
    return plan.uses(sized, F.col("members"), F.col("id"), F.col("size")), plan


def repeated(
    docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 17,
    weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2,
) -> DataFrame:
    """The mixed documents themselves: every row as often as it is used, columns unchanged."""
    plan = mixture(sizes_of(docs, sources, id_col, text_col), seed, weights, share, repeats)
    row = docs.select(
        F.struct(*docs.columns).alias("row"), _members(sources).alias("members"), F.col(id_col).alias("id"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    )
    used = plan.uses(row, F.col("members"), F.col("id"), F.col("size")).where("uses > 0")
    return used.select("row", F.explode(F.sequence(F.lit(1), "uses"))).select("row.*")
