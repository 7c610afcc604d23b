"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm.store import stored

# Edges that a task merges at a time.
CHUNK = 1 << 20
# Edges of a task that contracts what it is given: the more there are, the fewer stars are left of the same nodes.
CONTRACTED = 1 << 17
# Larger neighbours of a node beyond which they are dealt to several tasks, so many to each.
HOT = 1 << 16


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label`, the smallest member of every member's group, after the groups of a[i] and b[i] became one for every i."""
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node that these edges reach) that connect what the edges a[i], b[i] connect."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merged(np.arange(len(nodes)), place[: len(a)], place[len(a):])
    more = label != np.arange(len(nodes))
    return nodes[more], nodes[label[more]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """edges(key, a, b) in the order of key and b as stars; `moved` says that they differ from those given.

    A node with more edges than a chunk holds takes its smallest neighbour along, so every chunk knows it.
    """
    held, n, carry = [], 0, None

    def flush() -> pa.RecordBatch:
        key, a, b = (np.concatenate(x) for x in zip(*held))
        if carry is not None:
            a, b = np.concatenate([[carry[1]], a]), np.concatenate([[carry[2]], b])
        high, low = stars(a, b)
        given = np.unique(np.stack([a, b]), axis=1)  # in the order of a, as the stars are
        moved = not (given.shape[1] == len(high) and (given[0] == high).all() and (given[1] == low).all())
        return pa.record_batch([pa.array(high), pa.array(low), pa.array(np.full(len(high), moved))], ["a", "b", "moved"])

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("key", "a", "b")]
        for at in range(0, batch.num_rows, CHUNK):
            held.append([x[at: at + CHUNK] for x in rows])
            n += len(held[-1][0])
            if n >= CHUNK:
                yield flush()
                last = held[-1][0][-1]
                if carry is None or carry[0] != last:
                    carry = next((last, part[1][own[0]], part[2][own[0]]) for part in held if len(own := np.flatnonzero(part[0] == last)))
                held, n = [], 0
    if held:
        yield flush()


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """(key, salt, a, b): every edge once for each of its ends, so that a task sees all edges of its nodes.

    The larger neighbours of a hot node are dealt to several salts; its edge to a smaller one goes to all of them.
    """
    if n <= HOT:
        ends = F.array(F.struct(F.col("a").alias("key"), F.lit(0).alias("salt")), F.struct(F.col("b").alias("key"), F.lit(0).alias("salt")))
        return edges.select(F.explode(ends).alias("end"), "a", "b").select("end.key", "end.salt", "a", "b")
    # At most one row for HOT edges.
    hot = F.broadcast(edges.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
                      .select(F.col("b").alias("node"), F.ceil(F.col("n") / HOT).cast("int").alias("salts")))
    one = lambda c: F.coalesce(c, F.lit(1))
    at_a = edges.join(hot, F.col("a") == F.col("node"), "left").select(
        F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), one(F.col("salts")) - 1)).alias("salt"), "a", "b")
    at_b = edges.join(hot, F.col("b") == F.col("node"), "left").select(
        F.col("b").alias("key"), F.pmod(F.xxhash64("a"), one(F.col("salts"))).cast("int").alias("salt"), "a", "b")
    return at_a.union(at_b)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), a stored table: root is the smallest node that can be reached.

    Every task first turns the edges it has into stars. Then each round brings the edges of a node together and turns
    them into stars again, with one exchange, until no task changes its edges; the edges are then stars
    around the roots. The number of rounds grows with the logarithm of the longest path. Null ends and self links are ignored.
    """
    shape = "a long, b long, moved boolean"
    edges = links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    tasks = max(1, -(-edges.count() // CONTRACTED))
    edges = stored(edges.select(F.col("a").alias("key"), "a", "b").coalesce(tasks).mapInArrow(_contract, shape), "edges")
    while True:
        n = edges.count()
        dealt = _dealt(edges, n).repartition("key", "salt").sortWithinPartitions("key", "b").select("key", "a", "b")
        edges = stored(dealt.mapInArrow(_contract, shape), "edges", n)
        if not n or edges.filter("moved").isEmpty():
            break
    found = edges.select("a", "b").distinct()
    return stored(found.select(F.col("a").alias("node"), F.col("b").alias("root"))
                  .union(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))), "roots", n)
