"""How filters interact: what each of them removes, in every order in which they can be applied.

Documents are streamed. A document fails each filter or not (a mask of bits), and all that the report needs is how many
documents of a part have each mask. Four filters look at the text alone. The fifth fails a document whose text a smaller
doc_id has too, so a document that is first of its text today may be a copy once a smaller id arrives: keyed state
remembers the smallest id of each text with its mask, and when a smaller one comes, the counters of its part are
corrected by a retraction of the old mask and an addition of the new one.

Each micro-batch writes its counted rows and what it changes in the state to folders of its own, reads only the folders of
the batches before, and overwrites its own, so a batch that is run again after a failure counts once. Counters are the
sums of these additions and retractions, joined with the labels of their documents once, at the end.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake.session import scratch_folder

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
# Micro-batches that a set of files is dealt to. Each reads the state once, which is some tens of bytes a text.
BATCHES = 8
_WORD = r"[^\x20\x09-\x0D]+"
_PARTS = "array<struct<part: string, n: bigint>>"
_ROWS = "text_key binary, doc_id {kind}, part string, mask int, n long"
_CHANGES = f"text_key binary, mask int, doc_id {{kind}}, parts {_PARTS}, old {{kind}}, old_parts {_PARTS}"


def stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files of a table as a stream of about `batches` micro-batches."""
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    # A pattern that matches this path alone: a stream takes a plain path to be a folder, but a table may be a single file.
    path = path.rstrip("/")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{path[:-1]}[{path[-1]}]")


def text_mask() -> Column:
    """Bits of the filters A to D that `text` and its list of `words` fail."""
    fails = [F.size("words") < 100,
             F.size(F.array_distinct("words")) * 100 < F.size("words") * 80,
             F.length(F.regexp_replace("text", "[^A-Z]+", "")) * 100 > F.length("text") * 10,
             F.col("text").rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def _read(spark: SparkSession, folder: str, before: int, schema: str) -> DataFrame:
    """The rows of the batches before this one."""
    if not before:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/batch={k}" for k in range(before)))


def _batch(folder: str, kind: str):
    changes = _CHANGES.format(kind=kind)

    def process(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        text = rows.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
        masked = (text.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
                  .select("doc_id", "part", text_mask().alias("mask"), F.unhex(F.sha2("text", 256)).alias("text_key")))
        # Repeated rows are one row from here on.
        path = f"{folder}/rows/batch={batch}"
        masked.groupBy("text_key", "doc_id", "part", "mask").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(path)
        # A null id is neither smaller nor larger than another: such rows are never copies and have no state.
        new = spark.read.schema(_ROWS.format(kind=kind)).parquet(path).filter("doc_id IS NOT NULL")
        # The state is every smallest id there ever was; of those of a text the smallest counts.
        state = _read(spark, f"{folder}/changes", batch, changes).select("text_key", "mask", "doc_id", F.lit(None).cast(_PARTS).alias("added"), F.col("parts").alias("held"))
        both = state.unionByName(new.select("text_key", "mask", "doc_id", F.array(F.struct("part", "n")).alias("added"), F.lit(None).cast(_PARTS).alias("held")))
        # Lists hold the parts that one id with one text occurs in. Both groupings combine before their exchange, the second to one row a text.
        ids = both.groupBy("text_key", "mask", "doc_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("added", "held")))
        known = F.when(F.size("held") > 0, F.struct("doc_id", "held"))
        texts = ids.groupBy("text_key", "mask").agg(F.min(F.struct("doc_id", "added")).alias("least"), F.min(known).alias("old"))
        moved = F.col("old").isNotNull() & (F.col("least.doc_id") < F.col("old.doc_id"))
        texts.filter(F.size("least.added") > 0).select(
            "text_key", "mask", F.col("least.doc_id").alias("doc_id"), F.col("least.added").alias("parts"), F.when(moved, F.col("old.doc_id")).alias("old"),
            F.when(moved, F.col("old.held")).alias("old_parts")).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    return process


def _masks(spark: SparkSession, folder: str, batches: int, kind: str) -> DataFrame:
    """(doc_id, part, mask, n): what the batches added to and took back from the counters."""
    rows = _read(spark, f"{folder}/rows", batches, _ROWS.format(kind=kind))
    changes = _read(spark, f"{folder}/changes", batches, _CHANGES.format(kind=kind))
    copy = F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask")
    # Every row with an id first counts as a copy; what is first of its text counts without that bit, until it is no more.
    whole = rows.select("doc_id", "part", F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(copy).alias("mask"), "n")
    for key, parts, sign in (("doc_id", "parts", 1), ("old", "old_parts", -1)):
        one = changes.select(F.col(key).alias("doc_id"), "mask", F.explode(parts).alias("p")).select("doc_id", F.col("p.part").alias("part"), "mask", (F.col("p.n") * sign).alias("n"))
        whole = whole.union(one).union(one.select("doc_id", "part", copy, -F.col("n")))
    return whole


def counters(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """(part, mask, n, good, toxic) of a finite stream docs(doc_id, text, lang, ...): documents of a part that fail exactly the filters of the mask.

    `folder` holds the checkpoint and what each batch wrote; the same folder goes on where an earlier run ended. A document with
    several labels counts as good or toxic if one of them says so. Texts are compared by their SHA-256.
    """
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "interaction")
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    labels = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    kind = dict(docs.dtypes)["doc_id"]
    query = (docs.select("doc_id", "text", "lang").writeStream.foreachBatch(_batch(folder, kind))
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    found = _masks(spark, folder, _finished(spark, folder), kind).join(labels, "doc_id", "left")
    flags = [(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return (found.select("part", "mask", "n", *flags).groupBy("part", "mask")
            .agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic"))).filter("n <> 0"))


def _finished(spark: SparkSession, folder: str) -> int:
    """Batches that are done: those with whole changes, which a batch writes last. An empty table has none."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    files = named(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = 0
    while files.exists(named(f"{folder}/changes/batch={done}/_SUCCESS")):
        done += 1
    return done


def effects() -> list[tuple]:
    """(filter_order, step, bit, mask, kept, removed, redundant) for all orders, steps and masks: what happens to a document of the mask."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out += [(order, step, bit, mask, int(not mask & (before | bit)), int(bool(mask & bit and not mask & before)), int(bool(mask & bit and mask & before)))
                    for mask in range(1 << len(FILTERS))]
            before |= bit
    return out


def report(counted: DataFrame) -> DataFrame:
    """Kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for every part, order and step, from counters."""
    spark = counted.sparkSession
    table = spark.createDataFrame(effects(), "filter_order string, step int, bit int, mask int, kept int, removed int, redundant int")
    by = lambda flag, n="n": F.sum(F.col(flag) * F.col(n)).cast("long")
    alone = F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).cast("long")
    # 19,200 rows, whatever the data, against at most 32 counters a part.
    steps = counted.join(F.broadcast(table), "mask").groupBy("part", "filter_order", "step", "bit").agg(
        by("kept").alias("kept"), by("removed").alias("removed"), by("redundant").alias("redundant"), alone.alias("unique_fails"),
        by("removed", "good").alias("good_lost"), by("removed", "toxic").alias("toxic_lost"))
    # Of the orders of a mask's filters, each of them is first equally often.
    orders = F.expr("CAST(120 / bit_count(mask) AS BIGINT)")
    shares = (counted.filter("mask > 0").select("part", F.explode(F.array(*(F.lit(1 << k) for k in range(len(FILTERS))))).alias("bit"), "mask", "n")
              .filter("mask & bit <> 0").groupBy("part", "bit").agg(F.sum(F.col("n") * orders).cast("long").alias("shapley")))
    return steps.join(shares, ["part", "bit"], "left").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.coalesce("shapley", F.lit(0)).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """The report on a finite stream docs(doc_id, text, lang, ...) and labels(doc_id, quality, toxic).

    A null text is empty, a null lang is the part ''. Rows that repeat count as often; rows with a null doc_id are never
    copies and make no other row one. Other columns are ignored. An empty table has no parts.
    """
    return report(counters(docs, labels, folder))
