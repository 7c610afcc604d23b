"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised. The exponent is
bisected until the weights reach a target entropy or until no source is repeated more often than a limit allows. Then a
token budget is dealt by these weights: each source's documents lie in blocks; an epoch of a source is a permutation of
its blocks; a source's schedule is its epochs one after the other, cut where its share of the budget is used up.

Sources, blocks and weights are small tables; documents are only joined with them, so no source is gathered in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.llm.store import stored

BLOCK_TOKENS = 50_000
_STEPS = 60


def weights_at(shares: list[float], exponent: float) -> list[float]:
    powers = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(powers)
    return [p / total for p in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _bisected(fits) -> float:
    """The smallest exponent in [0, 1] for which `fits` holds, given that it holds at 1 and from some point on."""
    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(_STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def exponent_for_repetition(shares: list[float], most_repeats: float) -> float:
    """The smallest exponent at which the source that is repeated most is repeated at most `most_repeats` times as often
    as the one that is repeated least; 1 where the limit is 1."""
    filled = [s for s in shares if s > 0]

    def fits(exponent: float) -> bool:
        repeats = [w / s for w, s in zip(weights_at(filled, exponent), filled)]
        return max(repeats) <= most_repeats * min(repeats) * (1 + 1e-12)

    return _bisected(fits) if filled else 1.0


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The largest exponent whose weights have at least the target entropy (nats); 0 if even equal weights have less, 1 if
    the shares already reach it."""
    filled = [s for s in shares if s > 0]
    if not filled or entropy(weights_at(filled, 1.0)) >= target:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(_STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(weights_at(filled, middle)) >= target else (low, middle)
    return low


def n_tokens(text: Column) -> Column:
    """Tokens of a text: runs of anything but white space, and at least 1, so that empty texts count too."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def mixture(docs: DataFrame, source: Column, most_repeats: float | None = None, target_entropy: float | None = None,
            budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = "0") -> DataFrame:
    """(row, source, n_tokens, epoch, place, weight) for every scheduled use of a row of docs(doc_id, text, ...).

    `row` is the row as a struct; `epoch` counts the passes over its source from 0; `place` orders the blocks of a source
    (within a block, order by a hash). Give `most_repeats` or `target_entropy`. Without a `budget` in tokens it is set so
    that the source with the lowest ratio of weight to share is used exactly once: nothing is lost, smaller sources repeat.
    A null source is a source of its own; null texts count one token. Of the block that reaches over a source's quota,
    documents are taken while they fit. Empty input gives no rows.
    """
    spark = docs.sparkSession
    # Rows are told apart by number, so repeated rows lie in different blocks and may part.
    base = stored(docs.select(F.struct("*").alias("row"), F.coalesce(source.cast("string"), F.lit("\x00")).alias("source"),
                              n_tokens(F.col("text")).alias("n_tokens"), F.monotonically_increasing_id().alias("row_no")), "mixture")
    # One row per source; the number of sources is bounded by how many can be told apart in a mixture.
    sources = {r["source"]: r["tokens"] for r in base.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).toLocalIterator()}
    names = sorted(sources)
    total = sum(sources.values())
    shares = [sources[n] / total for n in names]
    if target_entropy is not None:
        exponent = exponent_for_entropy(shares, target_entropy)
    else:
        exponent = exponent_for_repetition(shares, most_repeats if most_repeats is not None else 1.0)
    weights = weights_at(shares, exponent) if names else []
    if budget is None:
        quotas = [sources[n] * (w / s) / min(v / t for v, t in zip(weights, shares)) for n, w, s in zip(names, weights, shares)]
        # The least repeated source takes all its tokens once, whatever rounding says.
        quotas = [max(round(q), sources[n]) for q, n in zip(quotas, names)]
    else:
        quotas = [round(budget * w) for w in weights]
    plan = F.broadcast(spark.createDataFrame(
        [(n, w, q, q // sources[n], q % sources[n], max(1, sources[n] // block_tokens)) for n, w, q in zip(names, weights, quotas)],
        "source string, weight double, quota long, epochs long, rest long, blocks long"))

    blocked = base.join(plan, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row_no"), "blocks"))
    blocks = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    # Whole epochs use every block; the last, partial epoch uses blocks in its own order while they fit.
    in_order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "epochs", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    partial = (blocks.filter("rest > 0").withColumn("before", F.coalesce(F.sum("tokens").over(in_order), F.lit(0)))
               .filter("before < rest").select("source", "block", F.col("epochs").alias("epoch"), (F.col("rest") - F.col("before")).alias("room"), "tokens"))
    whole = (blocks.filter("epochs > 0").select("source", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"),
                                                F.col("tokens").alias("room"), "tokens"))
    uses = stored(whole.union(partial), "uses")
    # Within a block that is cut, documents come in the order of a hash.
    within = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "row_no"), "row_no").rowsBetween(Window.unboundedPreceding, 0)
    light = blocked.select("source", "block", "row_no", "n_tokens")
    cut = (light.join(uses.filter("room < tokens"), ["source", "block"]).withColumn("upto", F.sum("n_tokens").over(within))
           .filter("upto <= room").select("row_no", "epoch"))
    full = light.join(uses.filter("room >= tokens"), ["source", "block"]).select("row_no", "epoch")
    epochs = full.union(cut).groupBy("row_no").agg(F.collect_set("epoch").alias("epochs"))
    return (blocked.drop("epochs").join(epochs, "row_no").withColumn("epoch", F.explode("epochs"))
            .select("row", "source", "n_tokens", "epoch", F.xxhash64(F.lit(seed), "epoch", "block").alias("place"), "weight"))


def mix(docs: DataFrame, source: Column, most_repeats: float) -> DataFrame:
    """docs with rows of smaller sources repeated, up to `most_repeats` times, so that sources meet their weights."""
    return mixture(docs, source, most_repeats=most_repeats).select("row.*")
