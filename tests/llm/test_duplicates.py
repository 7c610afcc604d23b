"""MinHash classes, exact groups and repeated passages against brute force."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import components, exact, minhash, repeats


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_classes(rows, n, percent):
    sets, root = defaultdict(list), {i: i for i, _ in rows if i is not None}
    for i, text in rows:
        if i is not None:
            sets[i].append(shingle_set(text, n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("n", [2, 5])
def test_classes(spark, odd, n):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = minhash.near_duplicate_classes(odd, shingle_words=n).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows, n, 80)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingle_set(t, n)) if True else 0) for i, t in rows)


def test_a_family_over_many_blocks(spark, monkeypatch):
    """Variants of one text, in chains and with strangers among them, that fill several blocks of a cluster."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(int(rng.integers(0, 16))):
            text[int(rng.integers(0, 120))] = f"c{int(rng.integers(0, 900))}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows, 2, 80)
    assert 1 < len(set(want.values())) < 150
    for block in (16, 256):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicate_classes(docs, shingle_words=2).collect()} == want


@pytest.mark.parametrize("sketches", [64, 2048])
def test_near_copies_among_strangers_of_one_passage(spark, monkeypatch, sketches):
    """Longer texts that hold the passage of two near copies stand between them in every bucket."""
    passage = [f"p{i}" for i in range(101)]
    rows = [(i, " ".join(passage + [f"o{i}x{k}" for k in range(5 if i < 2 else 35)])) for i in range(602)]
    want = {i: max(0, i - 1) and i for i, _ in rows}
    sets = [shingle_set(t, 2) for _, t in rows[:3]]
    assert 100 * len(sets[0] & sets[1]) > 90 * len(sets[0] | sets[1]) and 100 * len(sets[0]) < 80 * len(sets[2])
    monkeypatch.setattr(minhash, "SKETCHES", sketches, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicate_classes(docs, shingle_words=2).collect()} == want


@pytest.mark.parametrize("at_a_time", [1, 2, 5, 10_000])
def test_members_of_wide_buckets_need_no_join(spark, at_a_time):
    """The pass over the buckets gives the members of those of more than three, also where a bucket goes on over several batches."""
    sizes = {1: 4, 2: 3, 3: 1, 4: 9, 5: 2, 6: 40, 7: 3, 8: 5}
    rows = [(100 * left + i, [left]) for left, n in sizes.items() for i in range(n)]
    classes = spark.createDataFrame(rows, "node long, left_keys array<long>").withColumn("right_keys", F.array(F.lit(1).cast("long")))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(at_a_time))
    try:
        ties, wide, held = minhash._neighbours(classes, 1, len(rows))
        members = defaultdict(list)
        for r in held.collect():
            members[r.bucket].append(r.node)
        assert sorted(map(sorted, members.values())) == [[100 * k + i for i in range(n)] for k, n in sizes.items() if n > 3]
        assert {r.bucket: r.n for r in wide.collect()} == {k: len(v) for k, v in members.items()}
        assert {(r.a // 100, r.b // 100) for r in ties.collect()} == {(k, k) for k, n in sizes.items() if n > 1}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_drop_near_duplicates(odd, none):
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 3 and ids.count(7) == 1 and 8 not in ids and 9 in ids and 10 not in ids and {1, 2, 3, 4, 6} <= set(ids)
    assert minhash.drop_near_duplicates(none).count() == 0 and minhash.near_duplicate_classes(none).count() == 0


def test_half_keys_make_the_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    a, b = minhash.sketches(docs, 2, 4).collect()
    assert len(a.mins) == 16 and len(a.left_keys) == len(a.right_keys) == 4 and a[2:] == b[2:]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 199)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for bare, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        sha, left = hashlib.sha256(bare.encode()).hexdigest(), 1
        for i, t in own:
            kept = left and (i, len(t)) == (best[0], len(best[1]))
            left -= bool(kept)
            out.append((str(i), str(best[0]), len(own), bool(kept), sha))
    return sorted(out)


@pytest.mark.parametrize("table_bytes, bucket_bytes", [(32 << 20, 64 << 20), (200, 2_000)])
def test_exact_groups(odd, table_bytes, bucket_bytes):
    got = exact.exact_groups(odd, table_bytes, bucket_bytes).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == brute_exact([(r.doc_id, r.text) for r in odd.collect()])


def test_exact_groups_of_nothing(none):
    assert exact.exact_groups(none).count() == 0


def test_content_table_compares_contents():
    table = exact.ContentTable()
    assert [table.index(5, c) for c in (b"a", b"b", b"a")] == [0, 1, 0]
    assert [table.index(i, b"%d" % i) for i in range(3000)] == list(range(2, 3002)) and table.index(1029, b"1029") == 1031


def brute_passages(rows, least):
    where, n = defaultdict(set), {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for s in range(len(w) - least + 1):
            where[" ".join(w[s: s + least])].add((i, s))
    again = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                again[i].update(range(s, s + least))
    return {i: len(s) for i, s in again.items()}


def test_repeated_passages(spark, odd, none):
    rows = sorted({(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None and r.doc_id != 7}, key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least, head in ((50, 20), (25, 8), (8, 8)):
        got = {r.doc_id: sum(s.n_words for s in r.spans) for r in repeats.repeated(docs, least, head).collect()}
        assert got == brute_passages(rows, least)
    found = {r.doc_id: r for r in repeats.repeated(odd).collect()}
    assert [tuple(s) for s in found[12].spans] == [(80, 60)] and found[11].copies == [] and [tuple(s) for s in found[12].copies] == [(80, 60)]
    assert repeats.repeated(none).count() == 0


def test_cutting_copies(odd, none):
    done = repeats.without_copies(odd)
    assert done.columns == odd.columns and done.count() == odd.count()
    texts = {r.doc_id: r.text for r in done.filter(F.col("doc_id") != 7).collect()}
    before = {r.doc_id: r.text for r in odd.filter(F.col("doc_id") != 7).collect()}
    assert texts[11] == before[11] and "P0Q0" not in texts[12] and len(texts[12].split()) == 160 and texts[1] is None and texts[9] == before[9] and texts[10] == "end"
    assert repeats.without_copies(none).count() == 0
