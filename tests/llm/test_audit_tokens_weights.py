"""Filter interaction, byte-pair encoding and importance resampling against plain accounts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import bpe, importance, interaction

LABELS = "doc_id long, quality int, toxic int"


def masks(rows):
    """(part, mask, good?) accounts of rows(doc_id, text, lang) in plain Python."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        yield i, lang or "", "".join(x for x, f in zip("ABCDE", fails) if f)


def plain_report(rows, labels):
    out = Counter()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = list(masks(rows))
    orders = ["".join(o) for o in permutations("ABCDE")]
    result = {(p, o, s): dict.fromkeys(names, 0) for p in {p for _, p, _ in found} for o in orders for s in range(1, 6)}
    for i, p, fails in found:
        good, toxic = labels.get(i, (0, 0))
        for o in orders:
            hit = min((o.index(x) + 1 for x in fails), default=9)
            if hit < 9:
                out[p, o[hit - 1]] += 1
            for s, x in enumerate(o, 1):
                r = result[p, o, s]
                r["kept"] += hit > s
                r["removed"] += hit == s
                r["redundant"] += x in fails and hit < s
                r["unique_fails"] += fails == x
                r["good_lost"] += good * (hit == s)
                r["toxic_lost"] += toxic * (hit == s)
    for (p, o, s), r in result.items():
        r["shapley"] = out[p, o[s - 1]]
    return sorted((*k, *r.values()) for k, r in result.items())


def reported(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_smaller_ids_that_come_later_take_masks_back(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Short ONE", "a b c " * 60, " ".join(f"w{i}" for i in range(120)), "x # y", "", None]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None])) for i in range(60)]
    rows += [(7, rows[7][1], "de"), (7, rows[7][1], rows[7][2]), (None, "Short ONE", "en"), (None, None, None)]
    labels = {i: (i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)}
    for k in range(6):  # ids fall from file to file, so every file takes masks back
        part = [r for r in rows if r[0] is None and k == 3 or r[0] is not None and r[0] // 10 == 5 - k]
        spark.createDataFrame(part, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    given = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(0, 0, 0), (None, 1, 1), (3, None, None)], LABELS)
    folder = str(tmp_path / "run")
    docs = interaction.stream(spark, str(tmp_path / "docs"), batches=6)
    counted = interaction.counters(docs, given, folder)
    changes = spark.read.parquet(f"{folder}/changes")
    assert spark.read.parquet(f"{folder}/rows").select("batch").distinct().count() == 6 and changes.filter("old IS NOT NULL").count() > 5
    assert reported(interaction.report(counted)) == plain_report(rows, labels)
    # The same folder goes on with new files only, and counts no batch twice.
    spark.createDataFrame([(-1, "Short ONE", "en")], "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    again = interaction.audit(interaction.stream(spark, str(tmp_path / "docs"), batches=6), given, folder)
    assert reported(again) == plain_report([*rows, (-1, "Short ONE", "en")], labels)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([(2, "a", "en"), (1, "a", "en"), (1, "a", "en")], "doc_id long, text string, lang string")
    run = interaction._batch(str(tmp_path), "bigint")
    for batch in (0, 0, 1, 1):
        run(docs if batch else docs.filter("doc_id = 2"), batch)
    assert interaction._finished(spark, str(tmp_path)) == 2
    rows = interaction._masks(spark, str(tmp_path), 2, "bigint").groupBy("mask").agg(F.sum("n").alias("n")).filter("n <> 0").collect()
    fails = 1 | (0 if 100 * 1 >= 80 else 2)
    assert {r["mask"]: r["n"] for r in rows} == {fails: 2, fails | 16: 2}


def test_interaction_of_odd_tables(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name))
    labels = spark.createDataFrame([], LABELS)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert reported(interaction.audit(interaction.stream(spark, str(tmp_path / "odd")), labels)) == plain_report(rows, {})
    assert interaction.audit(interaction.stream(spark, str(tmp_path / "none")), labels).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    return bpe.load(path), Tokenizer.from_file(path)


def test_tokens_of_odd_texts(tokenizer):
    v, library = tokenizer
    rng = random.Random(3)
    parts = [*"aàbcΣσς'sSTRE ̧́\x1c\x85 İſß12½٣中文한글🙂", "ﬃ", "<|startoftext|>", "<|endoftext|>", "'ll", "'RE", "q" * 90, "zq" * 700]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + ["", " \t", None]
    texts += [p + chr(c) + q for c in range(1, 0x3200) for p, q in (("", ""), ("a", "b1"))]
    found = bpe.encode_texts(texts, bpe._Packed(v))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_both_trees_merge_like_a_scan(tokenizer):
    v, _ = tokenizer

    def scan(ids):
        ids, width = list(ids), len(v.tokens)
        while len(ids) > 1:
            rank, i = min((v.ranks.get(a * width + b, len(v.merged)), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if rank == len(v.merged):
                break
            ids[i: i + 2] = [v.merged[rank]]
        return ids

    rng = random.Random(8)
    words = ["".join(rng.choices("aaabinotherés", k=k)) for k in [*range(1, 80), *range(1, 80), 200]]
    packed = bpe._Packed(v).packed(words)
    for w, p in zip(words, packed):
        data = w.encode()
        ids = [*(v.inner[b] for b in data[:-1]), v.last[data[-1]]]
        assert bpe.merge(ids, v) == scan(ids) == np.frombuffer(p, "<u4").tolist()


def test_encoding_of_odd_tables(spark, odd, none, tokenizer):
    v, library = tokenizer
    both = bpe.decode(bpe.encode(odd, v), v)
    got = sorted((str(r["row"]["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"], r["row"]["row"] == "clash" or r["row"]["row"] is None) for r in both.collect())
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False), True))
    assert got == sorted(want)
    assert bpe.decode(bpe.encode(none, v), v).count() == 0
    strange = spark.createDataFrame([(bytearray(np.array([5, 2**31, 49407], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r["decoded"] for r in bpe.decode(strange, v).collect()] == ["& <|endoftext|>", ""]


def test_other_kinds_of_files_are_refused():
    P = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        bpe.load(P.path("byte_bpe_50k.json"))


def plain_features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [zlib.crc32(b" ".join(w[i: i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def plain_resample(rows, target, percent=5):
    found = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in plain_features(x)[0])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in range(10000)]
    out = []
    for i, f, n in found:
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    able = sorted((r for r in out if r[3] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(df):
    return sorted((tuple(r) for r in df.select("row.doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_against_a_plain_account(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert drawn(importance.resample(docs, target)) == want
    assert sum(r[4] is not None for r in want) > 5


def test_the_head_changes_no_bucket(spark, odd):
    rng = random.Random(1)
    words = ["a", "bb", "Zu", "été", "x" * 70, "q" * 300, "1", "w" * 64, "w" * 63]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) + rng.choice(["", " .", "!"]) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    head = importance.head_vocabulary(docs, 10000, head_words=6, pair_words=4, head_pairs=5)
    assert len(head.words) == 6 and (head.pairs >= 0).sum() == 5
    want = Counter(b for t in texts for b in plain_features(t)[0])
    for h in (head, importance.EMPTY):
        total = importance.bucket_totals(docs, h, 10000)
        assert {int(b): int(total[b]) for b in np.flatnonzero(total)} == want
    batch = importance._read(pa.array(texts), head)
    assert sorted(np.concatenate([b for _, b in importance._buckets(batch, head, 10000)]).tolist()) == sorted(want.elements())


def test_summaries_keep_what_is_frequent(monkeypatch):
    monkeypatch.setattr(importance, "SUMMARY", 10)
    s = importance._Summary(1)
    for start in range(0, 1000, 50):
        s.add(np.concatenate([np.arange(start, start + 50), [-1]])[:, None], np.array([1] * 50 + [9]))
    keys, counts = s.top()
    assert len(s.keys) <= 40 and (keys[0, 0], counts[0]) == (-1, 180)


def test_resampling_of_odd_tables(spark, odd, none):
    target = spark.createDataFrame([("one two three four",), (None,), ("",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert drawn(importance.resample(odd, target, percent=50)) == plain_resample(rows, ["one two three four"], 50)
    assert drawn(importance.resample(odd, none, percent=100)) == plain_resample(rows, [], 100)
    assert importance.resample(none, target).count() == 0
