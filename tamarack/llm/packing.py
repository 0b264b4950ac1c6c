"""Filling fixed-capacity containers: the plan is made on the histogram of lengths, rows then take planned slots.

A histogram has at most capacity + 1 rows whatever the input, so best-fit over
counts runs on the driver: classes of equally full containers move together.
Every row gets its rank within its length, by blocks of a hash and their
offsets, and joins the slots planned for that length and range of ranks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import load

CHARS_PER_TOKEN = 4
#: Rows of one length that are ranked in one task, about, and the fewest blocks of a length.
BLOCK_ROWS, LEAST_BLOCKS = 250_000, 32
#: Ranks of one length that meet their steps in one group where the steps are not broadcast.
BUCKET_RANKS = 1_000_000
#: Plans of at most this many steps are broadcast; one step holds five integers.
BROADCAST_STEPS = 100_000


@dataclass(frozen=True)
class Step:
    """Items of one length with ranks from first on: count items, each to a container each holding, from container on."""

    length: int
    first: int
    count: int
    container: int
    each: int


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[Step], int]:
    """Best fit, longest first, over counts: (steps, number of containers).

    A length goes to the containers with the least space that still holds it; as
    many as fit go into each. Items of length 0 are spread over the containers.
    """
    if any(not 0 <= length <= capacity for length in histogram):
        raise ValueError("lengths must be between 0 and the capacity")
    steps: list[Step] = []
    spaces: list[int] = []  # sorted, one entry per space that some container has
    with_space: dict[int, list[tuple[int, int]]] = {}  # space -> ranges (first container, how many)
    containers = 0

    def put(space: int, first: int, many: int) -> None:
        if many:
            if space not in with_space:
                with_space[space] = []
                insort(spaces, space)
            with_space[space].append((first, many))

    for length in sorted((x for x in histogram if x), reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                each = capacity // length
                many = max(1, left // each)
                first, space = containers, capacity
                containers += many
            else:
                space = spaces[i]
                first, many = with_space[space].pop()
                if not with_space[space]:
                    del with_space[space], spaces[i]
            each = min(space // length, left)
            used = min(many, left // each)
            steps.append(Step(length, rank, used * each, first, each))
            put(space - each * length, first, used)
            put(space, first + used, many - used)
            left -= used * each
            rank += used * each
    if zero := histogram.get(0):
        containers = max(containers, 1)
        steps.append(Step(0, 0, zero, 0, -(-zero // containers)))
    return steps, containers


def to_items(units: DataFrame, capacity: int) -> DataFrame:
    """unit_id, piece, start, chars, tokens: one row per unit, or per piece of a unit larger than the capacity.

    Null texts are empty. Pieces are as long as the capacity allows.
    """
    most = capacity * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    size = units.select("unit_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    pieces = size.select("unit_id", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / most).cast("int") - 1, F.lit(0)))).alias("piece"))
    start = (F.col("piece") * most).cast("int")
    chars = F.least(F.lit(most), F.col("size") - start)
    return pieces.select("unit_id", "piece", start.alias("start"), chars.alias("chars"), F.floor(chars / CHARS_PER_TOKEN).cast("int").alias("tokens"))


def ranked(items: DataFrame, length: str, *order: str, blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Adds rank: the row's place, from 0, among the rows of its length.

    Rows are ranked within blocks of a hash, so a length that a third of all
    rows have is spread over so many tasks.
    """
    blocked = items.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    offsets = blocked.groupBy(length, "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(length, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(length, "block").orderBy(*order)
    return blocked.withColumn("n", F.row_number().over(within)).join(offsets, [length, "block"]).withColumn("rank", F.col("offset") + F.col("n") - 1).drop("block", "offset", "n")


def pack(units: DataFrame, capacity: int = 3000) -> tuple[DataFrame, dict[str, float]]:
    """(request_id, unit_id, piece, start, chars, tokens; totals) of as few requests as best fit finds.

    units: unit_id, text. Totals: requests, tokens, least (the fewest that could
    hold the tokens) and unused_share. No unit is divided unless it alone is
    larger than the capacity. Empty units take no space and are spread over the
    requests; no units give no requests.
    """
    items = to_items(units, capacity)
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    steps, requests = plan_slots(histogram, capacity)
    tokens = sum(length * n for length, n in histogram.items())
    totals = {"requests": requests, "tokens": tokens, "least": -(-tokens // capacity), "unused_share": 1 - tokens / (requests * capacity) if requests else 0.0}
    spark = units.sparkSession
    slots = spark.createDataFrame([(s.length, s.first, s.first + s.count, s.container, s.each) for s in steps], "tokens int, first long, last long, container long, each long")
    # As many blocks as the commonest length needs.
    blocks = max(LEAST_BLOCKS, max(histogram.values(), default=0) // BLOCK_ROWS)
    rows = ranked(items, "tokens", "unit_id", "piece", blocks=blocks)
    if len(steps) <= BROADCAST_STEPS:
        met = rows.join(F.broadcast(slots), "tokens")
    else:
        bucket = lambda c: F.floor(c / BUCKET_RANKS).cast("bigint")
        spread_out = slots.withColumn("bucket", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("last") - 1))))
        met = rows.withColumn("bucket", bucket(F.col("rank"))).join(spread_out, ["tokens", "bucket"])
    placed = met.where("rank >= first and rank < last")
    request = (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("bigint")
    return placed.select(request.alias("request_id"), "unit_id", "piece", "start", "chars", "tokens"), totals


def requests_of(spark, sf_dir: str) -> DataFrame:
    placed, totals = pack(load(spark, sf_dir, "paragraph_unit"))
    return placed.withColumn("unused_share", F.lit(totals["unused_share"]))


def summary_of(spark, sf_dir: str) -> DataFrame:
    """Requests, tokens and the share left unused, counted from the placed rows."""
    placed, totals = pack(load(spark, sf_dir, "paragraph_unit"))
    used = placed.groupBy("request_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("units"))
    return used.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("units").alias("units"), (1 - F.sum("tokens") / (F.count("*") * 3000)).alias("unused_share")).withColumn("least_requests", F.lit(totals["least"]))
