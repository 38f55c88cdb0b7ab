import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from granary.llm.knn_join import top_k
from granary.llm.quality_rules import judge_quality, keep_good
from granary.llm.sharding import quotas, shard_documents
from granary.llm.url_rules import judge_urls
from pyspark.sql import functions as F

PROSE = "The quick brown fox walks to the river and rests in the shade of an old tree while birds sing for the morning sun near. "


def test_quality_rules(table):
    docs = [
        (1, PROSE), (2, None), (3, "  \n\t"), (4, "too short"), (5, ("same words over and over again now " * 30)), (6, " ".join(w + "###" for w in PROSE.split())), (7, PROSE), (7, PROSE),
        (8, " ".join(f"w{i} the" for i in range(60000))), (9, "line of the text here\n" * 10 + PROSE), (None, PROSE),
    ]
    df = table(docs, extra=True)
    rows = {r.doc_id: r for r in judge_quality(df).collect()}
    assert judge_quality(df).count() == len(docs)
    assert (rows[1].n_words, rows[1].n_repeat_words, rows[1].kept) == (25, 0, True)
    assert rows[1].word_chars == sum(map(len, PROSE.split()))
    assert (rows[2].n_words, rows[2].base_failed, rows[2].kept) == (0, True, False)
    assert rows[5].n_repeat_words == rows[5].n_words == 210 and rows[5].base_failed
    assert rows[6].n_symbols == 25 * 3 and not rows[6].base_failed and not rows[6].kept
    assert rows[8].n_words == 120000 and rows[8].n_repeat_words == 0
    assert rows[9].n_dup_lines == 9
    good = keep_good(df)
    assert good.columns == df.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == ["1", "7", "7", "8", "None"]
    assert keep_good(table([])).count() == 0


def brute_top(vectors, k, every):
    data = [(i, [max(-(1 << 53), min(1 << 53, math.floor(1024 * float(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in data)
    data = [(i, np.array(v + [0] * (width - len(v)), object)) for i, v in data]
    out = []
    for n, (q, x) in enumerate(data):
        if q % every == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, int(x @ v))), i) for m, (i, v) in enumerate(data) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("n,pivots", [(3, 4), (900, 16)])
def test_top_k_is_exact(spark, n, pivots):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 8))
    vectors = [(i, (centres[i % 5] + 0.05 * rng.normal(size=8)).tolist()) for i in range(n)]
    vectors += [(n + i, vectors[1][1]) for i in range(30)]  # ties
    vectors += [(5000, None), (5100, [1.0, None]), (5200, [float("nan")] * 8), (5300, [0.5, 0.5]), (None, [1.0] * 8), (5400, [float("inf")] * 8), (5500, [0.0] * 8), (5600, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("id", "v", "rid", "g", "rank", "cell")})
    assert sorted(map(tuple, top_k(df, 10, 100, pivots=pivots).collect())) == brute_top(vectors, 10, 100)


def test_top_k_of_repeated_ids_and_large_components(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (100, [0.5, 1.0]), (100, [0.5, 1.0]), (100, [-2.0, 3.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 3, 100).collect())) == brute_top(vectors, 3, 100)
    large = [(i, [s * 4e6, s * 3e12, float(i)]) for i, s in enumerate((1, -1, 0.5, 2))] + [(200, [1e300, -1e300, 1.0]), (4, [3e38, 0.0, 0.0]), (3, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 3, 100).collect())) == brute_top(large, 3, 100)


def test_top_k_prunes_clustered_data(spark):
    """Each row goes to few of the groups: those of its own cluster and of clusters nearby."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = [(i, (centres[i % 40] + 0.01 * rng.normal(size=16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    report = {}
    got = sorted(map(tuple, top_k(df, 10, 7, group_queries=32, report=report).collect()))
    assert report["groups"] > 8 and report["copies"] < 0.4 * report["groups"] * report["rows"]
    scaled = np.array([np.floor(1024 * np.array(v)) for _, v in vectors]).astype(np.int64)
    want = []
    for q in range(0, 6000, 7):
        s = scaled @ scaled[q]
        order = [i for i in np.lexsort((np.arange(6000), -s))[:11].tolist() if i != q][:10]
        want += [(q, n, i, int(s[i])) for n, i in enumerate(order, 1)]
    assert got == sorted(want)


def test_top_k_of_more_queries_than_are_held_at_once(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.integers(-4, 4, 6).astype(float).tolist()) for i in range(600)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in top_k(df, 3, 1, pivots=16).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    scaled = np.array([v for _, v in vectors]).astype(np.int64) * 1024
    scores = scaled @ scaled.T
    for q in range(600):
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[q, i], i))[:3]
        assert sorted(got[q]) == [(n, i, int(scores[q, i])) for n, i in enumerate(want, 1)]


def test_top_k_without_queries(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quotas_never_overfill():
    rng = np.random.default_rng(0)
    for _ in range(30):
        wish = rng.integers(0, 20, (6, 6))
        np.fill_diagonal(wish, 0)
        free = rng.integers(0, 10, 6)
        take = quotas(wish.copy(), free)
        assert (take <= wish).all() and (take >= 0).all() and (take.sum(0) - take.sum(1) <= free).all()


def test_sharding(table):
    docs = [(i, f"text {i}") for i in range(150)] + [(1000 + i, "hot") for i in range(90)] + [(2000 + i, f"pair {i // 2}") for i in range(60)] + [(3000, None), (3001, ""), (5, "text 5")]
    rows = shard_documents(table(docs, extra=True), shards=7).collect()
    assert len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = dict(docs)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows)
    # cut edges of the groups' stars: first as dealt in hash order, then at the end
    def cut(shard_of):
        groups = defaultdict(Counter)
        for r in rows:
            groups[text[r.doc_id] or ""][shard_of(r)] += 1
        return sum(sum(c.values()) - max(c.values()) for t, c in groups.items() if t != "hot")  # a shard has no room for all of `hot`

    placed = cut(lambda r: r.shard)
    assert placed < 0.5 * cut(lambda r: zlib.crc32(str(r.doc_id).encode()) % 7)
    pairs = defaultdict(set)
    for r in rows:
        if 2000 <= r.doc_id < 2060:
            pairs[text[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in pairs.values()) <= 3  # random shards would split about 26 of 30
    assert len({r.shard for r in rows if 1000 <= r.doc_id < 1090}) < 7 and {r.law for r in rows} == {"rows"}
    assert shard_documents(table([]), shards=4).count() == 0
    assert sorted(r.shard for r in shard_documents(table([(1, "a"), (2, "a")]), shards=4).collect()) == [0, 1]


def test_hot_texts_are_split_into_parts(spark):
    """A third of all rows have one text: parts of it lie together, no shard gets more rows than others."""
    docs = [(i, ("hot", f"t{i // 12}", f"own {i}")[i % 3]) for i in range(6000)]
    rows = shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shards=10).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [600] * 10
    groups = defaultdict(set)
    for r in rows:
        if r.doc_id % 3 == 1:
            groups[r.doc_id // 12].add(r.shard)
    assert sum(len(v) > 1 for v in groups.values()) < 0.1 * len(groups)


def test_url_rules_edges(spark):
    rules = spark.createDataFrame([("ÉX.org", "/", "allow"), ("ÉX.org", "/", "block"), ("a.b", None, "block"), (None, "/", "block")], "host string, path string, action string")
    pages = [(1, "http://Éx.ORG/a"), (2, "http://éx.org/a"), (3, "http://x.A.b?q"), (4, "http://a.b/" + "p" * 100_000), (5, "http://" + "h." * 3000 + "a.b/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "path", "rule", "verdict", "_key", "_part", "short", "action")})
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    assert got == {1: ("Éx.org/", "block"), 2: (None, "allow"), 3: ("a.b", "block"), 4: ("a.b", "block"), 5: ("a.b", "block")}
    assert judge_urls(df.limit(0), rules).count() == 0 and judge_urls(df, rules.limit(0)).filter("verdict = 'block'").count() == 0


def test_quality_rules_of_lines_and_clashing_names(spark):
    lines = {1: "\n".join(f"- {PROSE} {i}" for i in range(5)), 2: "\n".join(f"{PROSE} {i}..." for i in range(5)), 3: " ".join(str(i) for i in range(40)) + " the of", 4: PROSE + "\n" + PROSE.upper()}
    df = spark.createDataFrame(list(lines.items()), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_words", "_lines", "_windows", "one", "_document", "_text", "kept")})
    rows = {r.doc_id: r for r in judge_quality(df).collect()}
    assert {i: (r.n_lines, r.n_bullet_lines, r.n_ellipsis_lines) for i, r in rows.items()} == {1: (5, 5, 0), 2: (5, 0, 5), 3: (1, 0, 0), 4: (2, 0, 0)}
    assert {i: r.kept for i, r in rows.items()} == {1: False, 2: False, 3: False, 4: True}
    assert all(r[c] == "mine" for r in rows.values() for c in ("_words", "_lines", "_windows", "_document", "_text"))
    good = keep_good(df)
    assert good.columns == df.columns and [(r.doc_id, r.kept, r._words) for r in good.collect()] == [(4, "mine", "mine")]


def test_url_rules(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")], "host string, path string, action string")
    pages = [
        (1, "https://a.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"), (4, "http://xexample.org/es/1"), (5, "http://b.com/de/#x"), (6, "http://b.com/fr"), (7, None), (8, "no url"), (9, "http://x.org"),
        (10, "http://x.org?/es/"), (3, "http://example.org/en/2"), (None, "http://b.com/de/"), (11, "://example.org/es/"),
    ]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()), key=str)
    want = [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "example.org", "/en/2", "org/", "allow"), (3, "example.org", "/en/2", "org/", "allow"),
        (4, "xexample.org", "/es/1", "org/", "allow"), (5, "b.com", "/de/", "com/de/", "block"), (6, "b.com", "/fr", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "x.org", "", None, "allow"),
        (10, "x.org", "", None, "allow"), (None, "b.com", "/de/", "com/de/", "block"), (11, "example.org", "/es/", "example.org/es/", "block"),
    ]
    assert got == sorted(want, key=str)
