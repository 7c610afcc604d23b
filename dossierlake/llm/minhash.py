"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct n-word shingles. Two small collections of half keys are made per document,
each half key from two minhashes; a table key is one half key of either collection. `halves` half keys a side thus
give halves**2 tables of four minhashes each from only 4 * halves minhashes, where independent tables would need
4 * halves**2. Documents that share a table key are candidates; every accepted link is confirmed on the full sets.

With 10 halves a pair at a similarity of 0.8 is missed with a probability of 2 * (1 - 0.8**2)**10 = 7e-5, at 0.85 of 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.llm import words as W
from dossierlake.llm.components import components, merged
from dossierlake.llm.store import stored
from dossierlake.session import broadcast_if_small

# Classes and shingles of a block; a cell compares two blocks, so it holds twice that.
BLOCK = 256
BLOCK_SHINGLES = 500_000
# Sketches of a block of a table bucket.
SKETCHES = 2048


def _set_key(shingle_set: np.ndarray) -> int:
    """64-bit value of a whole set, whatever its order."""
    return int(W.mix(np.array([W.mix(shingle_set).sum(dtype=np.uint64) ^ np.uint64(len(shingle_set))]))[0])


def _lists(flat: np.ndarray, each: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, each, dtype=np.int32)), pa.array(flat.ravel()))


def sketches(docs: DataFrame, shingle_words: int = 5, halves: int = 10) -> DataFrame:
    """(doc_id, n_shingles, set_key, left_keys, right_keys, mins) of every row of docs(doc_id, text).

    Equal sets have equal set keys and keys. Null or wordless texts have 0 shingles; their keys mean nothing.
    """
    functions = 4 * halves

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7919)
        factors = rng.integers(1, 2**63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 2**63, functions, dtype=np.uint64)
        for batch in W.pieces(batches):
            sets = list(W.shingles(*W.words(batch.column("text"), W.SPACED), shingle_words))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            keys = np.fromiter(map(_set_key, sets), np.uint64, len(sets))
            filled = np.flatnonzero(sizes)
            mins = np.zeros((len(sets), functions), np.uint32)
            if len(filled):
                every, starts = np.concatenate(sets), np.cumsum(sizes[filled]) - sizes[filled]
                for f in range(functions):
                    mins[filled, f] = np.minimum.reduceat(((every * factors[f] + shifts[f]) >> np.uint64(32)).astype(np.uint32), starts)
            half = (mins[:, 0::2].astype(np.uint64) << np.uint64(32) | mins[:, 1::2]).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes), pa.array(keys.view(np.int64)),
                                   _lists(np.ascontiguousarray(half[:, :halves]), halves),
                                   _lists(np.ascontiguousarray(half[:, halves:]), halves), _lists(mins.view(np.int32), functions)],
                                  ["doc_id", "n_shingles", "set_key", "left_keys", "right_keys", "mins"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        make, f"doc_id {kind}, n_shingles long, set_key long, left_keys array<long>, right_keys array<long>, mins array<int>")


def _table_keys(classes: DataFrame, halves: int, *more: str) -> DataFrame:
    """(node, bucket): the halves**2 table keys of every class; `more` columns are kept."""
    h = F.lit(halves)
    return classes.select("node", *more, F.explode(F.transform(F.sequence(F.lit(0), F.lit(halves * halves - 1)), lambda p: F.xxhash64(
        p, F.get("left_keys", (p / h).cast("int")), F.get("right_keys", p % h)))).alias("bucket"))


def _neighbours(classes: DataFrame, halves: int, n_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct pairs(a, b) that tie every member of a bucket to the bucket's first member and to the one before it,
    the buckets(bucket, n, members) of more than three members, of those with the same members one, and the rows(bucket, node) of
    all buckets of more than three.

    Buckets are read in sorted order and never held, so a bucket of any size takes one pass and gives two pairs and one row a member.
    """

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = first = last = None
        n, members = 0, np.uint64(0)
        # Members of a bucket that goes on and has no more than three so far.
        waiting = np.zeros(0, np.int64)

        def rows(a, b, size) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(size, np.int64))], ["a", "b", "n"])

        for batch in batches:
            keys, nodes = (batch.column(c).to_numpy() for c in ("bucket", "node"))
            if not len(keys):
                continue
            new = np.concatenate(([bucket is None or keys[0] != bucket], keys[1:] != keys[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            center = np.where(start >= 0, nodes[start], first if first is not None else 0)
            before = np.concatenate(([last if last is not None else 0], nodes[:-1]))
            old = ~new
            a = np.concatenate((center[old], before[old]))
            b = np.concatenate((nodes[old], nodes[old]))
            pairs = np.unique(np.stack([a, b])[:, a != b], axis=1)
            yield rows(pairs[0], pairs[1], np.zeros(pairs.shape[1]))
            # Sizes and members of the buckets that end here; the last one may go on.
            edges = np.unique(np.concatenate(([0], np.flatnonzero(new))))
            size, mark = np.diff(np.append(edges, len(keys))), np.bitwise_xor.reduceat(W.mix(nodes.view(np.uint64)), edges)
            if new[0]:
                size, mark, names = np.concatenate(([n], size)), np.concatenate(([members], mark)), np.concatenate(([0 if bucket is None else bucket], keys[edges]))
            else:
                names = keys[edges].copy()
                size[0] += n
                mark[0] ^= members
            wide = np.flatnonzero(size[:-1] > 3)
            yield rows(names[wide], mark[wide].view(np.int64), size[wide])
            # Members of the buckets that are known to be wide; of the last one they follow batch by batch.
            runs = np.diff(np.append(edges, len(keys)))
            own = size[-len(runs):]
            if not new[0] and own[0] > 3:
                yield rows(np.full(len(waiting), bucket), waiting, np.full(len(waiting), -1))
            inside = np.repeat(own > 3, runs)
            yield rows(keys[inside], nodes[inside], np.full(np.count_nonzero(inside), -1))
            rest = nodes[edges[-1]:] if own[-1] <= 3 else nodes[:0]
            waiting = np.concatenate((waiting, rest)) if len(runs) == 1 and not new[0] and own[-1] <= 3 else rest
            n, members = int(size[-1]), mark[-1]
            bucket, first, last = keys[-1], center[-1] if old[-1] else nodes[-1], nodes[-1]
        if n > 3:
            yield rows([bucket], np.array([members]).view(np.int64), [n])

    keyed = _table_keys(classes, halves).repartition("bucket").sortWithinPartitions("bucket", "node")
    found = stored(keyed.mapInArrow(tie, "a long, b long, n long"), "buckets", n_rows)
    wide = found.filter("n > 0").groupBy("n", F.col("b").alias("members")).agg(F.min("a").alias("bucket"))
    return found.filter("n = 0").select("a", "b").distinct(), wide, found.filter("n < 0").select(F.col("a").alias("bucket"), F.col("b").alias("node"))


def _agreement(functions: int, percent: int) -> int:
    """Equal minhashes that a pair at the threshold has but for a probability under 1e-5."""
    p, term, total, k = percent / 100, (1 - percent / 100) ** functions, 0.0, 0
    while p < 1 and total + term < 1e-5:
        total += term
        term *= (functions - k) / (k + 1) * p / (1 - p)
        k += 1
    return k if p < 1 else functions


def _promising(pairs: DataFrame, classes: DataFrame, halves: int, percent: int) -> DataFrame:
    """The pairs(a, b) whose set sizes allow the threshold and whose sketches agree well enough to be worth confirming."""
    light = classes.select("node", "n_shingles", "mins")
    a = light.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("mins").alias("ma"))
    b = light.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("mins").alias("mb"))
    agreed = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda same: same))
    return (pairs.join(b, "b").join(a, "a")
            .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .filter(agreed >= _agreement(4 * halves, percent)).select("a", "b"))


def _cells(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of one group at a time, from rows sorted by the columns `by`."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(c).to_numpy() for c in by]
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            now = tuple(int(x[i]) for x in at)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            key = now
    if held:
        yield pa.Table.from_batches(held)


def _missed(classes: DataFrame, groups: DataFrame, wide: DataFrame, held: DataFrame, halves: int, percent: int, n_rows: int) -> DataFrame:
    """pairs(a, b) of candidate clusters that a bucket joins by a promising pair which `_neighbours` did not tie.

    groups(node, root) are the clusters so far, wide(bucket, ...) the larger buckets, held(bucket, node) their members. Up to three members of a bucket are
    all tied. In larger buckets of several clusters, the members outside the one with most members are compared with all others, in cells of two blocks of
    sketches; only as many pairs come out as connect the clusters of a cell. Buckets with the same members count once.
    """
    members = stored(held.join(groups, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "members", n_rows)
    # Clusters are counted from the members alone, so only buckets of several clusters are joined, and once.
    parted = members.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.ceil(F.max("n") / SKETCHES).alias("blocks"),
        F.ceil((F.sum("n") - F.max("n")) / SKETCHES).alias("outer")).filter("outer > 0")
    main = stored(parted.join(wide.select("bucket"), "bucket"), "parted", n_rows)
    dealt = members.join(broadcast_if_small(main), "bucket").withColumn("outside", F.col("root") != F.col("main")).withColumn("own", F.when(
        F.col("outside"), F.col("blocks") + F.pmod(F.xxhash64("node", F.lit(5)), "outer")).otherwise(F.pmod(F.xxhash64("node", F.lit(3)), "blocks")))
    last = F.col("blocks") + F.col("outer") - 1
    others = F.when(F.col("outside"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.sequence(F.col("blocks"), last))
    cells = (dealt.withColumn("other", F.explode(others)).select(
        "bucket", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "own", "node", "root")
        .join(classes.select("node", "n_shingles", "mins"), "node"))
    least = _agreement(4 * halves, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, ["bucket", "c1", "c2"]):
            own, c1, c2, size, root = (cell.column(c).to_numpy() for c in ("own", "c1", "c2", "n_shingles", "root"))
            mins = np.concatenate([c.flatten().to_numpy() for c in cell.column("mins").chunks]).reshape(len(own), -1)
            order = np.argsort(size, kind="stable")
            rows, columns = order[own[order] == c2[0]], order[own[order] == c1[0]]
            roots, group = np.unique(root, return_inverse=True)
            label, across, wide = np.arange(len(roots)), np.ascontiguousarray(mins[columns].T), size[columns]
            for start in range(0, len(rows), 256):
                some = rows[start: start + 256]
                # Sizes are sorted: only a range of the columns can reach the threshold.
                lo = np.searchsorted(wide, -(-size[some[0]] * percent // 100))
                hi = np.searchsorted(wide, size[some[-1]] * 100 // percent, side="right")
                agreed = np.zeros((len(some), max(0, hi - lo)), np.int16)
                for f in range(mins.shape[1]):
                    agreed += mins[some, f][:, None] == across[f, lo:hi]
                small, large = np.minimum(size[some][:, None], wide[lo:hi]), np.maximum(size[some][:, None], wide[lo:hi])
                i, j = np.nonzero((agreed >= least) & (small * 100 >= large * percent))
                label = merged(label, group[some[i]], group[columns[lo + j]])
            more = np.flatnonzero(label != np.arange(len(label)))
            yield pa.record_batch([pa.array(roots[label[more]]), pa.array(roots[more])], ["a", "b"])

    return (cells.repartition("bucket", "c1", "c2").sortWithinPartitions("bucket", "c1", "c2")
            .mapInArrow(compare, "a long, b long").distinct())


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two of the sets share: products of membership columns, a few thousand shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    number = np.cumsum(np.concatenate(([0], every[1:] != every[:-1])))
    common = np.bincount(number) > 1
    owner, number = owner[common[number]], (np.cumsum(common) - 1)[number[common[number]]]
    total, step = np.zeros((len(sets), len(sets)), np.float32), 4096
    for start in range(0, int(common.sum()), step):
        i, j = np.searchsorted(number, [start, start + step])
        has = np.zeros((len(sets), step), np.float32)
        has[owner[i:j], number[i:j] - start] = 1
        total += has @ has.T
    return total.astype(np.int64)


def _linked(cells: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """links(a, b, blocks) of cells(cluster, c1, c2, node, blocks, text): all pairs of a cell are compared on their full sets.

    Only as many links come out as connect what is linked in the cell.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, ["cluster", "c1", "c2"]):
            sets, nodes = [], []
            for batch in cell.to_batches():
                for node, own in zip(batch.column("node").to_pylist(), W.shingles(*W.words(batch.column("text"), W.SPACED), shingle_words)):
                    # Rows that repeat a doc_id with another text are not the class that was meant.
                    if len(own) and _set_key(own) == node % 2**64:
                        sets.append(own)
                        nodes.append(node)
            if len(sets) < 2:
                continue
            size, shared = np.array([len(x) for x in sets]), _shared(sets)
            link = 100 * shared >= percent * (size[:, None] + size - shared)
            np.fill_diagonal(link, True)
            label = np.arange(len(sets))
            while True:
                least = np.where(link, label, len(sets)).min(axis=1)
                if (least == label).all():
                    break
                label = np.minimum(least, label)
            nodes = np.array(nodes, np.int64)
            more = np.flatnonzero(nodes[label] != nodes)
            yield pa.record_batch([pa.array(nodes[label[more]]), pa.array(nodes[more]), cell.column("blocks").combine_chunks().slice(0, len(more))], ["a", "b", "blocks"])

    return (cells.repartition("cluster", "c1", "c2").sortWithinPartitions("cluster", "c1", "c2")
            .mapInArrow(compare, "a long, b long, blocks int"))


def _roots(groups: DataFrame, classes: DataFrame, docs: DataFrame, shingle_words: int, percent: int, n_rows: int) -> DataFrame:
    """(node, root) of the classes that are linked to others, from candidate groups(node, root).

    What candidates tie together, directly or over others, is a cluster. Clusters are compared in cells of two blocks of
    bounded size. Those of one block are done at once. Larger ones first compare each block with itself and with the first
    one; where that leaves a cluster in several components, classes outside its main component are compared with all others.
    """
    groups = groups.select("node", F.col("root").alias("cluster")).join(classes.select("node", "rep", "n_shingles"), "node")
    sizes = groups.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = stored(groups.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), "blocks").cast("int")), "clusters", n_rows)
    # Asked for as a merge join, so the plan is the same whatever the share of clustered documents.
    texts = stored(docs.select(F.col("doc_id").alias("rep"), "text").join(dealt.select("node", "rep").hint("merge"), "rep").select("node", "text"), "texts", n_rows)

    def cells(placed: DataFrame, others: Column) -> DataFrame:
        return (placed.withColumn("other", F.explode(others)).select(
            "cluster", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "node", "blocks").hint("merge").join(texts, "node"))

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = F.when(F.col("own") == 0, every).otherwise(F.array(F.lit(0), "own"))
    links = stored(_linked(cells(dealt, first), shingle_words, percent), "links", n_rows)
    # The links of a cell are stars, so in a cluster of one block they name its components already.
    small = links.filter("blocks = 1")
    roots = small.select(F.col("b").alias("node"), F.col("a").alias("root")).union(small.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return roots
    inner = components(links.filter("blocks > 1"))
    rooted = large.join(inner, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    parted = rooted.join(main, "cluster").withColumn("outside", F.col("root") != F.col("main"))
    # Blocks of the main component keep their numbers; the others get numbers of their own after them.
    apart = parted.groupBy("cluster").agg(F.greatest(F.ceil(F.count_if("outside") / BLOCK), F.ceil(
        F.coalesce(F.sum(F.when(F.col("outside"), F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("outer"))
    numbered = parted.join(apart, "cluster").withColumn("own", F.when(F.col("outside"), F.col("blocks") + F.pmod(
        F.xxhash64("node", F.lit(5)), "outer").cast("int")).otherwise(F.col("own")))
    outer = F.sequence(F.col("blocks"), F.col("blocks") + F.col("outer") - 1)
    more = F.when(F.col("outside"), F.concat(every, outer)).otherwise(outer)
    rest = stored(_linked(cells(numbered, more), shingle_words, percent).select("a", "b"), "rest", n_rows)
    return roots.union(components(inner.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest)))


def near_duplicate_classes(docs: DataFrame, shingle_words: int = 5, percent: int = 80, halves: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    Documents are linked where 100 * shared shingles >= percent * all shingles of the two; component_id is the smallest
    doc_id that links reach. Rows with equal sets are one class from the start, so thousands of copies cost one row.

    Rows without words, with a null text or a null doc_id are linked with nothing (component_id = doc_id, null for null).
    Repeated rows come out as often as they came in. Other columns are ignored.
    """
    made = stored(sketches(docs, shingle_words, halves), "sketches")
    n = made.count()
    usable = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy(F.col("set_key").alias("node")).agg(
        F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "left_keys", "right_keys", "mins"))), "classes", n)
    ties, wide, held = _neighbours(classes, halves, n)
    candidates = stored(_promising(ties, classes, halves, percent), "candidates", n)
    groups = components(candidates)
    missed = stored(_missed(classes, groups, stored(wide, "wide", n), held, halves, percent, n), "missed", n)
    if not missed.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(missed))
    roots = _roots(groups, classes, docs, shingle_words, percent, n)
    named = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = named.join(smallest, "root").select(F.col("node").alias("set_key"), "component_id")
    return (made.withColumn("set_key", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")))
            .join(final, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, halves: int = 10) -> DataFrame:
    """docs with one document of each near-duplicate class: the one with the smallest doc_id.

    Rows with a null doc_id stay. Of rows that repeat a doc_id one stays. All columns are kept.
    """
    kept = (near_duplicate_classes(docs, shingle_words, percent, halves).filter("doc_id = component_id")
            .select("doc_id").distinct())
    rows = docs.select("doc_id", F.struct("*").alias("row"))
    known = rows.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.union(rows.filter("doc_id IS NULL")).select("row.*")
