from collections import Counter, defaultdict

import numpy as np
import pytest
from granary.llm.packing import QUANTUM, SEQUENCE, Plan, chunk_places, pack


def test_each_of_many_sources_is_a_queue(table):
    docs = [(i, "word", f"site-{i}") for i in range(1100)] + [(2000 + i, "alpha beta " * 300, "ab"[i % 2]) for i in range(40)]
    rows = pack(table(docs), weights={"a": 3, "b": 1}).collect()
    assert {r.queue for r in rows} == {f"={s}" for _, _, s in docs}
    total, seen = sum(r.length for r in rows), defaultdict(int)
    for r in rows:
        if r.sequence_id < 6:
            seen[r.queue] += r.length
    named = seen["=a"] + seen["=b"]
    assert sum(seen.values()) == 6 * SEQUENCE < total and abs(seen["=a"] - 0.75 * named) <= QUANTUM


def test_weights_hold_over_thousands_of_sources_through_the_last_window():
    """Every prefix of the packed order has each source's share to within four chunks, the end included."""
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(1, 400, 1500), rng.integers(400, 3000, 1450), rng.integers(10**4, 10**5, 50)])
    plan = Plan([(f"q{i:05}", int(n)) for i, n in enumerate(tokens)])
    q = np.arange(len(tokens))
    row, at, size, sequence, offset = plan.pieces(q, np.zeros(len(q), np.int64), tokens)
    order = np.lexsort((offset, sequence))
    place = np.append(0, np.cumsum(size[order]))
    full = sequence[order] < plan.total // SEQUENCE
    assert (place[:-1][full] == (sequence[order] * SEQUENCE + offset[order])[full]).all() and place[-1] == plan.total == size.sum()
    worst = 0.0
    for i in np.concatenate([q[:20], q[1500:1520], q[-50:]]):
        got = np.append(0, np.cumsum(np.where(row[order] == i, size[order], 0)))
        worst = max(worst, np.abs(got - place * (tokens[i] / plan.total)).max())
    assert worst < 4 * QUANTUM
    # target weights of named sources hold until one of them has no more tokens
    plan = Plan([(f"q{i}", 10**6) for i in range(3)], {"q0": 5, "q1": 3, "q2": 2})
    row, _, size, sequence, _ = plan.pieces(np.arange(3), np.zeros(3, np.int64), plan.tokens)
    for windows in (10, 100, 900):
        got = np.bincount(row[sequence < windows], size[sequence < windows], 3)
        assert np.abs(got - windows * SEQUENCE * np.array([0.5, 0.3, 0.2])).max() < 2 * QUANTUM


@pytest.mark.parametrize("weights", [None, {"big": 3, "site-7": 2}])
def test_more_sources_than_a_task_may_hold_pack_the_same(table, weights):
    """Chunks placed by Spark are where the closed form puts them: many sources, a hot one, a null one, long and empty texts."""
    docs = [(i, "word " * (i % 7), f"site-{i % 60}") for i in range(300)] + [(1000 + i, f"alpha {i} beta " * 200, "big") for i in range(30)]
    docs += [(2000, "gamma " * 9000, "long"), (2001, None, None), (2002, "", None), (2003, "x", "null"), (2003, "x", "null"), (None, "y", "big")]
    rows = table(docs)
    few, many = (sorted(map(str, pack(rows, weights=weights, most_sources=n).collect())) for n in (4096, 5))
    assert few == many and len(few) >= len(docs)


def test_chunk_places_over_many_blocks_and_ranges(spark):
    rng = np.random.default_rng(5)
    totals = [(f"={i:04}", int(n)) for i, n in enumerate(np.concatenate([rng.integers(1, 3000, 300), [10**6, 400_000]]))]
    for weights in ({}, {"=0001": 4, "=0300": 1}):
        plan = Plan(totals, weights)
        found = chunk_places(spark.createDataFrame(totals, "queue string, tokens long"), weights, block=100, span=500).collect()
        q, k, first = (np.array(x) for x in zip(*((plan.index[r.queue], r.k, r.first) for r in found)))
        assert len(found) == plan.chunks.sum() and (plan.place(k, q) == first).all()


@pytest.mark.parametrize("most", [4096, 1])
@pytest.mark.parametrize("weights", [{"a": 3, "z": 1}, {"a": 0.5}, {"a": 0}])
def test_weights_that_cannot_hold_are_refused(table, weights, most):
    with pytest.raises(ValueError):
        pack(table([(1, "x", "a"), (2, "y", "b")]), weights=weights, most_sources=most)


def test_every_window_has_the_mixture(table):
    """Twenty sources, one with a third of all tokens: a window lacks no source whose share has room for a chunk."""
    docs = [(i, f"w{i} alpha beta gamma " * 40, f"s{i % 20}") for i in range(800)] + [(5000 + i, "delta epsilon zeta " * 60, "s0") for i in range(260)]
    rows = pack(table(docs)).collect()
    total, windows = Counter(), defaultdict(Counter)
    for r in rows:
        total[r.queue] += r.length
        windows[r.sequence_id][r.queue] += r.length
    n = sum(total.values())
    full = [w for s, w in windows.items() if s < n // SEQUENCE]
    assert len(full) > 50 and total["=s0"] > n / 3
    for w in full:
        assert sum(w.values()) == SEQUENCE
        assert all(abs(w[q] - SEQUENCE * total[q] / n) <= 2 * QUANTUM for q in total)
    kinds = sorted(len(w) for w in full)
    assert kinds[len(kinds) // 2] >= 15
