"""Exact top-k search among binary codes by incremental multi-index hashing.

A 64-bit code is cut into ``segments`` of equal width. Rows of one code are one entry of the
index, with the k + 1 smallest ids that have it. The index has a row per entry and segment.
Queries probe it in rounds: round r looks up every value that differs from the query's
segment in exactly r bits. After round r every code within ``segments * (r + 1) - 1`` bits
has been found, since a code further off in each segment is further off in all. A query
leaves as soon as its k-th verified distance is within that bound; the others go on, at
the latest until r is the width of a segment, when everything has been seen.

A pair is found through each of its nearest segments; only the first of these counts, so
no pair has to be made distinct. Rounds end in tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import stored
from labelscope.operators.joins import hot_hashes, lookup_join

BITS = 64


def sign_code(vector: Column) -> Column:
    """64 bits: bit i is set if element i is above 0; missing and null elements are not."""
    bits = [F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return F.when(vector.isNotNull(), code)


def _segment(code: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _probes(queries: DataFrame, r: int, segments: int, width: int) -> DataFrame:
    """(segment, value, query): every value exactly r bits from the query's segments.

    The masks of r bits are made once, by a job of their own, and are a constant for the rows.
    """
    every = queries.sparkSession.range(1 << width).select(F.col("id").cast("int").alias("mask"))
    masks = every.where(F.bit_count("mask") == r).agg(F.collect_list("mask")).scalar()  # 2**width at most
    own = F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("query"), s, width).alias("own")) for s in range(segments)])
    spread = queries.select("query", F.inline(own))
    probes = spread.select("query", "segment", "own", F.explode(masks).alias("mask"))
    return probes.select("query", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def _found(probes: DataFrame, index: DataFrame, r: int, segments: int, width: int) -> DataFrame:
    """(query, code, ids, distance) of the entries met for the first time in round r."""
    met = probes.join(index.hint("merge"), ["segment", "value"])
    apart = F.col("query").bitwiseXOR(F.col("code"))
    near = [F.bit_count(_segment(apart, s, width)) for s in range(segments)]
    first = None
    for s in reversed(range(segments)):
        first = F.when(near[s] == r, F.lit(s)).otherwise(first if first is not None else F.lit(-1))
    least = F.least(*near) if segments > 1 else near[0]
    return met.where((least == r) & (F.col("segment") == first)).select("query", "code", "ids", F.bit_count(apart).cast("int").alias("distance"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest rows of every query code: query, distance, id."""
    return _nearest(found.select("query", "distance", F.explode("ids").alias("id")), k)


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).drop("rank")


def top_k(
    codes: DataFrame, wanted: Column, k: int = 10, id_col: str = "id", code_col: str = "code", segments: int = 4,
) -> DataFrame:
    """The ``k`` rows nearest to every query row: query_id, rank, neighbour_id, distance.

    Queries are the rows of ``codes`` where ``wanted`` holds; all rows are searched, and a row
    is not its own neighbour. Ties go to the smaller id. Rows with a null code or a null id
    are neither found nor asked for. Rows that repeat an id and its code count once. With
    fewer than ``k`` other rows a query gets all of them; an empty table gives none. Other
    columns are left behind. ``segments`` must divide 64 and be 4 at least; more of them suit fewer rows.
    """
    if BITS % segments or segments < 4:
        raise ValueError("segments must divide 64 and be at least 4")
    width = BITS // segments
    rows = stored(
        codes.select(F.col(id_col).alias("id"), F.col(code_col).cast("bigint").alias("code"), F.coalesce(wanted, F.lit(False)).alias("wanted"))
        .where("id IS NOT NULL AND code IS NOT NULL"), "codes",
    )
    # Equal codes are one entry. Ids are ranked first, so no more than k + 2 are gathered.
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = rows.groupBy("code", "id").agg(F.max("wanted").alias("wanted")).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    own = F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), s, width).alias("value")) for s in range(segments)])
    index = stored(entries.select("code", "ids", F.inline(own)), "index")
    asked = rows.where("wanted").select("id", "code").distinct()
    active, best, nearest = asked.select(F.col("code").alias("query")).distinct(), None, None
    for r in range(width + 1):
        # A query makes many probes: queries are dealt over tasks before they do.
        dealt = active.repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query")
        found = _found(_probes(dealt, r, segments, width), index, r, segments, width)
        rows_found = _best(found, k)
        if best is not None:
            rows_found = _nearest(best.where(~F.col("settled")).drop("settled").unionByName(rows_found), k)
        # The k + 1 nearest, the query itself among them, must lie within what is covered.
        covered, all_of = segments * (r + 1) - 1, Window.partitionBy("query")
        enough = (F.count("*").over(all_of) > k) & (F.max("distance").over(all_of) <= covered)
        best = stored(rows_found.withColumn("settled", enough | F.lit(r == width)), "best")
        done = best.where("settled").drop("settled")
        nearest = done if nearest is None else nearest.unionByName(done)
        # Every query meets its own code in round 0, so it is in ``best`` until it is settled.
        active = best.where(~F.col("settled")).select("query").distinct()
        if active.isEmpty():
            break
    lists = nearest.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k + 1 at most
    lists = lists.withColumnRenamed("query", "code")
    hot = hot_hashes(rows.where("wanted"), ["code"])
    joined = lookup_join(asked, lists.hint("merge"), ["code"], "inner", hot, spread=("id",))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return joined.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.distance").alias("distance")
    )
