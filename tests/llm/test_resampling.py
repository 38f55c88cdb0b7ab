import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from granary.llm import resampling as R
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s, t = (Counter(bucket(x) for text in texts for x in features(text)[1]) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[bucket(x)] + 1) * (S + 10000) / ((s[bucket(x)] + 1) * (T + 10000)))) for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for i, r in enumerate(able):
        r[4] = i + 1 if i < 5 * len(able) // 100 else None
        r.append(True)
    for r in rows:
        if len(r) == 5:
            r[4] = None
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé日ÀZ09") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", "-", ". ", "\n", "\x00"]) for _ in range(rng.choice([0, 3, 19, 20, 40, 90]))) for _ in range(n)]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_checksums_of_words_and_runs():
    rng = random.Random(1)
    a = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 5, 63, 64, 65, 200, 5000]))) for _ in range(200)]
    size = np.array([len(x) for x in a])
    crc = R.checksums(np.frombuffer(b"".join(a), np.uint8), np.cumsum(size) - size, size)
    assert crc.tolist() == [zlib.crc32(x) for x in a]
    assert (R.shifted(crc, size[::-1]) ^ crc[::-1]).tolist() == [zlib.crc32(x + y) for x, y in zip(a, a[::-1])]


def test_planes_give_exact_sums():
    rng = np.random.default_rng(2)
    counts = rng.choice([0, 0, 1, 2, 3, 900, 1 << 20], (5, R.BUCKETS))
    for gains in (rng.integers(-9000, 9000, R.BUCKETS), np.zeros(R.BUCKETS, int), np.full(R.BUCKETS, -4), np.full(R.BUCKETS, 4)):
        assert (R.weights(counts, R.gain_planes(gains)) == counts @ gains).all()


def test_against_brute_force(spark, table, monkeypatch):
    docs = list(enumerate(texts(3, 300)))
    docs += [(7, docs[7][1]), (None, docs[4][1] * 3), (301, None), (302, ""), (303, "... !"), (304, "word " * 3000), (305, "x" * 100_000 + " y"), (7, None)]
    target = texts(3, 40)[:20] + [None, ""]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    want = brute(docs, target)
    assert collected(R.resample(table(docs, extra=True).withColumn("rank", F.lit("x")), goal)) == want
    monkeypatch.setattr(R, "WORDS", 50)
    monkeypatch.setattr(R, "TOGETHER", 3)
    assert sum(len(b) for _, b in R.feature_buckets(*R.words_of(table(docs).select("text").toArrow().column(0)))) == sum(r[1] for r in want)


def test_share_is_drawn_whatever_the_ranges(spark, table):
    docs = [(i, " ".join(f"w{i % 7}" for _ in range(25))) for i in range(1000)]
    goal = spark.createDataFrame([("w3 w3 w3",)], "text string")
    got = {r.doc_id: r for r in R.resample(table(docs, parts=9), goal).collect()}
    drawn = sorted((r for r in got.values() if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 51))
    assert [(r.score, -r.doc_id) for r in drawn] == sorted(((r.score, -r.doc_id) for r in got.values()), reverse=True)[:50]
    assert sum(r.doc_id % 7 == 3 for r in drawn) == 50


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "text string")
    assert R.resample(table([(1, "a b")]).limit(0), none).collect() == []
    assert collected(R.resample(table([(1, "a b")]), none)) == brute([(1, "a b")], [])
