import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from granary.llm.suffix_dedup import BYTE_WINDOWS, byte_digests, sorted_suffixes
from granary.llm.word_dedup import WORD_WINDOWS, drop_repeated_words, word_digests


def brute_words(docs):
    first, out = {}, []
    for i, t in docs:
        w = (t or "").encode().split()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if i is not None:
                first[k] = min(first.get(k, (i, p)), (i, p))
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if i is not None and first[tuple(w[p : p + 20])] < (i, p):
                gone[p : p + 20] = [True] * 20
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(docs):
    c = Counter(t.encode()[p : p + 200] for i, t in docs if t and i is not None for p in range(len(t.encode()) - 199))
    out = []
    for i, t in docs:
        r = (t or "").encode()
        m = np.zeros(len(r), bool)
        for p in range(len(r) - 199):
            if i is not None and c[r[p : p + 200]] > 1:
                m[p : p + 200] = True
        spans = int((np.diff(m.astype(int), prepend=0) == 1).sum())
        out.append((i, len(r), int(m.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abc ") for _ in range(rng.randint(190, 500))) for _ in range(12)]
    docs = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2) if rng.random() < 0.5 else 0
            t += p[a : a + rng.randint(150, 500)] if rng.random() < 0.6 else "".join(rng.choice("abcdefgé \n") for _ in range(rng.randint(0, 300)))
        docs.append((i * 7 - 50, t))
    docs += [(900, None), (901, ""), (902, " \n "), (903, "a " * 300), (904, "x" * 700), (905, docs[3][1]), (906, docs[3][1])]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_words_and_bytes_against_brute_force(table, seed):
    docs = corpus(seed)
    df = table(docs, parts=5)
    assert sorted(map(tuple, word_digests(df).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, byte_digests(df).collect()), key=str) == brute_bytes(docs)


LIMITS = {"fan": 2, "hot": 2, "bucket_bytes": 1 << 10, "flush_bytes": 4 << 10, "merge_bytes": 8 << 10}


def test_two_deals_and_hot_anchors_change_nothing(table):
    rng = random.Random(9)
    phrase = " ".join(f"common{i}" for i in range(9)) + " "  # an anchor of words and of bytes with other surroundings each time
    docs = corpus(3) + [(2000 + i, " ".join(f"l{rng.randrange(3)}" for _ in range(20)) + " " + phrase + " ".join(f"r{rng.randrange(2)}" for _ in range(40))) for i in range(60)]
    df = table(docs, parts=4)
    assert sorted(map(tuple, word_digests(df, windows=replace(WORD_WINDOWS, **LIMITS)).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, byte_digests(df, windows=replace(BYTE_WINDOWS, **LIMITS)).collect()), key=str) == brute_bytes(docs)


def test_words_whose_polynomials_collide_modulo_powers_of_two(table):
    """A Thue-Morse word and its complement have equal polynomials modulo 2**64 for every odd base."""
    words = []
    for n in (1024, 2048, 4096, 8192):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        words += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    sides = [f"s{i}" for i in range(30)]
    docs = [(i, " ".join(sides[:15] + [w] + sides[15:])) for i, w in enumerate(words)] + [(100 + i, w) for i, w in enumerate(words)]
    got = sorted(map(tuple, word_digests(table(docs)).collect()), key=str)
    assert got == brute_words(docs) and all(r[2] == 0 for r in got)
    assert sorted(map(tuple, byte_digests(table(docs)).collect()), key=str) == brute_bytes(docs)


def test_very_long_texts(table):
    rng = random.Random(4)
    words = [f"w{rng.randrange(1 << 30)}" for _ in range(200_000)]
    head, tail = " ".join(words[:300]), " ".join(words[-500:])
    docs = [(1, " ".join(words)), (2, "x" * 3_000_000), (3, tail + " end"), (4, head)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in word_digests(table(docs)).collect()}
    assert got == {1: (200_000, 0), 2: (1, 0), 3: (501, 500), 4: (300, 300)}
    removed = {r.doc_id: r.n_removed for r in byte_digests(table(docs)).collect()}
    assert removed == {1: len(head) + len(tail), 2: 3_000_000, 3: len(tail), 4: len(head)}


def test_runs_find_what_sorting_every_suffix_finds(table):
    docs = [(i, t) for i, t in corpus(5)[:40] if t] + [(None, "q" * 300), (500, "q" * 300), (501, "é" * 150)]
    df = table(docs)
    covered = {}
    for r in sorted_suffixes(df, digit=40).collect():
        covered.setdefault((r.row, r.doc_id), set()).update(range(r.at, r.at + 200))
    got = {r.doc_id: r.n_removed for r in byte_digests(df).collect() if r.n_removed}
    assert got == {k: len(v) for (_, k), v in covered.items()} and got[500] == 300
    assert sorted_suffixes(df.limit(0), digit=100).count() == 0


def test_edges(table):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(5, passage), (5, passage), (None, passage), (2, "head " + passage), (9, passage + " tail"), (7, None)]
    df = table(docs, extra=True)
    assert sorted(map(tuple, word_digests(df).collect()), key=str) == brute_words(docs)
    assert sorted(map(tuple, byte_digests(df).collect()), key=str) == brute_bytes(docs)
    out = drop_repeated_words(df)
    assert out.columns == df.columns
    texts = sorted(map(str, (r.text for r in out.collect())))
    assert texts == sorted(map(str, ["", "", passage, "head " + passage, "tail", None]))
    assert word_digests(table([])).count() == 0 and byte_digests(table([])).count() == 0
