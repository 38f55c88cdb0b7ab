import numpy as np
import xxhash
from granary.llm.simhash import chain_budgets, components, keep_one, key_masks, links, near_duplicates


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))


def roots(values, radius):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(values, np.int64).view(np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= radius):
            x, y = find(values[i]), find(values[i + 1 + int(j)])
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_chain_budgets():
    assert chain_budgets(16, 2) == (7, [(15, 1), (16, 2)])


def test_links_with_and_without_crowds(spark):
    rng = np.random.default_rng(1)
    values = []
    for base in rng.integers(-(1 << 63), 1 << 63, 4).tolist():
        values.append(base)
        for _ in range(120):
            v = base
            for bit in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                v ^= (1 << bit) if bit < 63 else -(1 << 63)
            values.append(v)
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, fp long")
    want = roots(values, 2)
    assert links(df.limit(0)).count() == 0 and components(links(df.limit(0))).count() == 0
    for crowd in (1, 4, 1000):
        got = {r.node: r.root for r in components(links(df, 2, crowd=crowd)).collect()}
        assert all(got.get(v, v) == want[v] for v in want)


def test_near_duplicates(table):
    long = " ".join(f"word{i % 97} and{i % 31}" for i in range(4000))
    docs = [(4, "One two three four"), (2, "one TWO three four"), (9, None), (8, " \n"), (7, "é ñ"), (1, long), (3, long + " x"), (5, long), (5, long), (None, long), (6, "short")]
    rows = near_duplicates(table(docs, extra=True)).collect()
    assert len(rows) == len(docs)
    prints = {}
    for i, t in docs:
        v = brute_fingerprint(t)
        prints.setdefault(i, v - (1 << 64) if v >> 63 else v)
    assert all(r.fp == prints[r.doc_id] for r in rows)
    want = roots(prints.values(), 2)
    for r in rows:
        assert r.component_id == min(i for i, v in prints.items() if i is not None and want[v] == want[r.fp])
    kept = keep_one(table(docs, extra=True))
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(["1", "2", "6", "7", "8", "None"])
    assert near_duplicates(table([])).count() == 0
    assert sorted(r.doc_id for r in keep_one(table([(5, long), (5, long), (6, long), (7, "other text here now")])).collect()) == [5, 7]
    # texts of one doc_id are judged one by one
    rows = [(5, long), (5, "quite another text of its own"), (1, long + " y"), (6, "quite another text of its own"), (8, None), (8, "")]
    kept = sorted((r.doc_id, r.text or "") for r in keep_one(table(rows, extra=True)).collect())
    assert kept in ([(1, long + " y"), (5, "quite another text of its own"), (8, "")],)


def test_key_masks():
    first, second, third = key_masks(16, 2)
    assert [bin(m).count("1") for m in first] == [28] and {bin(c).count("1") for cs in first.values() for c in cs} == {40}
    assert {bin(c).count("1") for cs in second.values() for c in cs} == {48} and min(bin(c).count("1") for cs in third.values() for c in cs) >= 52
