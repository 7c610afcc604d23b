"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is cut into cells. A shard stands on it with many virtual nodes; a row's key hashes to a cell and belongs to
the next virtual node clockwise. Shards have capacities; what a full shard cannot take goes on clockwise to the next
shard with room. Only the rows of each cell are counted to decide that (`cells` numbers, whatever the input), so the
walk round the ring is made on that small table, and rows are then told their shard by their rank in their cell.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window, functions as F

from dossierlake.llm.store import stored

# The ring's cells are the values of so many hex digits.
CELL_DIGITS = 3
# Ranks are counted in pieces of a cell of about so many rows, so a key that fills a third of all rows is spread.
RANK_ROWS = 100_000


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    marks = sorted((hashlib.md5(f"{s}#{v}".encode()).hexdigest(), s) for s in range(shards) for v in range(virtual_nodes))
    return [(int(mark[:CELL_DIGITS], 16), s) for mark, s in marks]


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take: as even as whole numbers allow, and `slack` (a share of the mean) above that."""
    extra = int(slack * n / shards)
    return [n // shards + (s < n % shards) + extra for s in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, from_rank, to_rank, shard, first_slot): who takes which rows of each cell.

    First every cell goes to its own shard as far as that has room, cell by cell; then the rest of each cell goes on
    clockwise.
    """
    room, filled, out, places = list(room), [0] * len(room), [], [c for c, _ in nodes]

    def take(cell: int, start: int, shard: int) -> int:
        n = min(counts[cell] - start, room[shard])
        if n:
            out.append((cell, start, start + n, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return start + n

    rest = []
    for cell in sorted(counts):
        own = bisect_left(places, cell) % len(nodes)
        start = take(cell, 0, nodes[own][1])
        if start < counts[cell]:
            rest.append((cell, own, start))
    for cell, at, start in rest:
        while start < counts[cell]:
            at = (at + 1) % len(nodes)
            start = take(cell, start, nodes[at][1])
    return out


def place(docs: DataFrame, shards: int = 16, virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """(row, shard, slot) for every row of docs(doc_id, ...): `row` is the row as a struct.

    The key is doc_id (null counts as an empty key). With no slack the numbers of rows of two shards differ by one at most;
    with slack they stay under (1 + slack) times the mean and fewer rows leave their own shard. Slots count the rows of
    a shard from 0 without gaps. Rows with the same key may part where a shard is full, so no key can overfill a shard.
    """
    spark = docs.sparkSession
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = stored(docs.select(
        F.struct("*").alias("row"), F.conv(F.substring(mark, 1, CELL_DIGITS), 16, 10).cast("int").alias("cell"),
        F.substring(mark, CELL_DIGITS + 1, 16).alias("mark"), F.monotonically_increasing_id().alias("row_no")), "ring")
    counts = {r["cell"]: r["n"] for r in base.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator()}
    room = capacities(sum(counts.values()), shards, slack)
    cells = [(c, -(-n // RANK_ROWS)) for c, n in counts.items()]
    taken = walk(counts, ring(shards, virtual_nodes), room)
    split = F.broadcast(spark.createDataFrame(cells, "cell int, pieces int"))
    plan = F.broadcast(spark.createDataFrame(taken, "cell int, from_rank long, to_rank long, shard int, first_slot long"))

    placed = base.join(split, "cell").withColumn("piece", F.pmod(F.xxhash64("row_no"), "pieces").cast("int"))
    in_piece = Window.partitionBy("cell", "piece").orderBy("mark", "row_no")
    before = Window.partitionBy("cell").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("cell", "piece").agg(F.count("*").alias("n"))
               .select("cell", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    ranked = (placed.withColumn("number", F.row_number().over(in_piece) - 1).join(offsets, ["cell", "piece"])
              .withColumn("rank", F.col("ahead") + F.col("number")))
    return (ranked.join(plan, "cell").filter("rank >= from_rank AND rank < to_rank")
            .select("row", "shard", (F.col("first_slot") + F.col("rank") - F.col("from_rank")).alias("slot")))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) of docs(doc_id, text): UTF-8 bytes plus 1, and the unsigned CRC-32; null texts have no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
