import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from granary.llm import markov_model as M
from pyspark.sql import functions as F


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), ""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base(docs):
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return c, n, v, [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in docs]


def languages(n, seed=5):
    """Texts in two invented languages, which a model of one distribution can't tell apart."""
    rng = random.Random(seed)
    words = [[f"{p}{i}{e}" for i in range(60)] for p, e in (("ka", "en"), ("lu", "ós"))]
    return [(i, " ".join(rng.choice(words[i % 2]) if rng.random() < 0.97 else f"zz{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 60])))) for i in range(n)]


def plain(model, x):
    """Forward and backward without scaling or blocks: log-likelihood and expected counts."""
    forward = [model.begin * model.emit[x[0]]]
    for s in x[1:]:
        forward.append(forward[-1] @ model.move * model.emit[s])
    back = [np.ones(len(model.begin))]
    for s in x[:0:-1]:
        back.insert(0, model.move @ (model.emit[s] * back[0]))
    total = forward[-1].sum()
    emit, moves = np.zeros_like(model.emit), np.zeros_like(model.move)
    for t, s in enumerate(x):
        emit[s] += forward[t] * back[t] / total
        if t + 1 < len(x):
            moves += np.outer(forward[t], model.emit[x[t + 1]] * back[t + 1]) * model.move / total
    return math.log(total), forward[0] * back[0] / total, moves, emit


@pytest.mark.parametrize("step", [3, 4, 512])
def test_blocks_give_the_plain_recursion(step, monkeypatch):
    monkeypatch.setattr(M, "STEP", step)
    monkeypatch.setattr(M, "TOGETHER", 10)
    rng = np.random.default_rng(1)
    model = M.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T.copy())
    ends = np.append(0, np.cumsum([1, 3, 4, 5, 9, 13, 8, 1, 12, 16]))
    x = rng.integers(0, 7, ends[-1])
    want = [plain(model, x[a:b]) for a, b in zip(ends, ends[1:])]
    assert np.allclose(M.run_texts(model, x, ends), [w[0] for w in want])
    got = model.start_from()
    assert M.run_texts(model, x, ends, got) is None
    for mine, i in ((got.log, 0), (got.begin, 1), (got.moves, 2), (got.emit, 3)):
        assert np.allclose(mine, sum(w[i] for w in want))


def test_a_text_of_many_blocks_does_not_underflow():
    rng = np.random.default_rng(3)
    model = M.Model(np.array([0.5, 0.5]), np.array([[0.999, 0.001], [0.001, 0.999]]), rng.dirichlet(np.ones(5000), 2).T.copy())
    x = rng.integers(0, 5000, 20_000)
    alpha, log = model.begin.copy(), 0.0
    for t, s in enumerate(x):
        alpha = (alpha @ model.move if t else alpha) * model.emit[s]
        log += math.log(alpha.sum())
        alpha /= alpha.sum()
    assert np.isclose(M.run_texts(model, x, np.array([0, len(x)]))[0], log)


def test_base_and_one_state(table):
    docs = [*languages(60), (60, None), (61, ""), (62, " \t"), (None, "KA1EN new"), (3, "ka1en ka1en"), (63, "w" * 5000), (64, "ÉTÉ Été x")]
    c, n, v, want = base(docs)
    fitted = M.fit(table(docs, extra=True).withColumn("score", F.lit("x")), states=1, rounds=2)
    got = sorted((tuple(r) for r in M.score(fitted).collect()), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    # one state: the base with an unseen word for each class
    size = {i: len(tokens(t)) for i, t in docs if i != 3}
    for g, w in zip(got, want):
        if g[0] in size:
            assert math.isclose(g[6], w[5] + w[2] * math.log10((n + v + 1) / (n + v + M.CLASSES)), rel_tol=1e-9)


def test_learning(table, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT_WORDS", 300)  # some words share a class
    docs = languages(280)
    fitted = M.fit(table(docs), states=2, rounds=8)
    assert 0 < len(fitted.symbols.words) < 121

    def posterior(model):  # what the rounds raise: likelihood and pseudo-counts
        emit = model.emit * fitted.symbols.shares[:, None]
        return (fitted.symbols.slots[:, None] / 2 * np.log(emit)).sum() + np.log(model.begin).sum() + np.log(model.move).sum()

    kind, model, values = np.uint16, M.first_model(fitted.symbols, 2), []
    training = fitted.rows.filter("_symbols is not null and not held_out").select("_symbols")
    for i in range(4):
        found = M.expected_counts(training, model, kind)
        assert math.isclose(found.log, fitted.logs[i], rel_tol=1e-9)
        values.append(found.log + posterior(model))
        model = found.model(fitted.symbols)
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:]))
    rows = [r for r in M.score(fitted).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.92
    assert sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


def test_scores_are_the_likelihoods_of_whole_texts(table, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT_WORDS", 100)
    docs = [*languages(80, 6), (80, "ka1en lu2ós never seen ka1en")]
    fitted = M.fit(table(docs), states=3, rounds=2)
    c = base(docs)[0]
    at = {w: i + 1 for i, w in enumerate(fitted.symbols.words)} | {"": 0}
    by_class = lambda w: len(at) + int(M.classes_of(pa.array([w]))[0])
    texts = dict(docs)
    for r in M.score(fitted).collect():
        words = tokens(texts[r.doc_id])
        log = plain(fitted.model, [at[w] if w in at else by_class(w) for w in words])[0] / math.log(10)
        assert math.isclose(r.score, log + sum(math.log10(c[w] + 1) for w in words if w not in at), rel_tol=1e-9)


def test_profiles_are_distributions(table):
    fitted = M.fit(table(languages(40)), rounds=1)
    s, m = fitted.symbols, fitted.model
    tokens_of = np.concatenate([np.ones(1 + len(s.words)), s.shares[1 + len(s.words) :]])
    assert np.allclose((m.emit * tokens_of[:, None]).sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and np.isclose(m.begin.sum(), 1)


def test_nothing_to_learn_from(table):
    assert M.markov_scores(table([(1, "a")]).limit(0)).collect() == []
    only_held = next(i for i in range(50) if held(i))
    (r,) = M.markov_scores(table([(only_held, "a b")]), rounds=1).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0
