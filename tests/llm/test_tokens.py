import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from granary.llm import bpe
from granary.llm.bpe import Bpe, default_path, digests, token_ids
from granary.llm.packing import SEQUENCE, pack
from granary.llm.token_histogram import at_limits, length_histogram, quantile
from tokenizers import Tokenizer

TRICKY = [
    "", " ", "  ", "a  b", "a \n b", "it's", "it''s", "x 's", "'re'lly", "we'll they've I'm he'd'", "\n's", "hello<|endoftext|>world", "<|endoftext|><|endoftext|> a", "a\t\tb  c", "a" * 30,
    "a　b", "été naïve \U0001f600\U0001f600 x", "  \n", "a\r\n\r\nb", "\x1c\x1d a", "a\x85b", "'", " '", "'l", "' s", "²½ 12٣", "ab" * 4000,
]


@pytest.fixture(scope="module")
def models():
    with open(default_path(), encoding="utf-8") as f:
        return Bpe(f.read()), Tokenizer.from_file(default_path())


def test_encode_and_decode_as_the_library(models):
    ours, theirs = models
    rng = random.Random(3)
    bits = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "1", "!", "é", "ß", "　", "<|endoftext|>", "<|", "\U0001f600", "٣", "​"]
    texts = TRICKY + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    ids, ends = ours.encode(pa.array(texts))
    back, upto = ours.decode(ids, ends)
    back = back.tobytes()
    for i, (text, want) in enumerate(zip(texts, theirs.encode_batch(texts, add_special_tokens=False))):
        assert ids[ends[i] : ends[i + 1]].tolist() == want.ids, text
        assert back[upto[i] : upto[i + 1]].decode() == theirs.decode(want.ids, skip_special_tokens=False)


def test_words_of_equal_hashes(models, monkeypatch):
    """Ids are right for words whose polynomials agree modulo 2**64, and even if all words had one of few hashes."""
    ours, theirs = models
    texts = []
    for n in (1024, 2048, 4096, 8192):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    want = [t.ids for t in theirs.encode_batch(texts, add_special_tokens=False)]
    for t, ids in zip(texts, want):
        assert ours.encode(pa.array([t]))[0].tolist() == ids
    ids, ends = ours.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    monkeypatch.setattr(bpe, "word_keys", lambda body, begin, size: (size % 3).astype(np.uint64))
    monkeypatch.setattr(bpe, "ONE_TO_ONE", 0)
    ours.forget()
    for _ in range(2):
        ids, ends = ours.encode(pa.array(TRICKY))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.ids for t in theirs.encode_batch(TRICKY, add_special_tokens=False)]
    ours.forget()


def test_very_long_texts(table, models):
    docs = [(1, "é" * 200_000), (2, "ab cd " * 400_000), (3, " " * 100_000)]
    got = {r.doc_id: r for r in digests(table(docs)).collect()}
    for i, t in docs:
        ids = models[1].encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    h = {r.length: r.n_docs for r in length_histogram(table(docs)).collect()}
    assert sum(h.values()) == 3 and max(h) == max(r.n_tokens for r in got.values())


def test_digests_and_ids(table, models):
    docs = [(i, t) for i, t in enumerate(TRICKY)] + [(100, None), (None, "x y"), (103, "again"), (103, "again")]
    got = digests(table(docs, extra=True)).collect()
    assert len(got) == len(docs)
    want = {}
    for i, t in docs:
        ids = models[1].encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)
    assert digests(table([])).count() == 0
    assert {len(bytes(r.ids)) // 2 for r in token_ids(table([(1, "a b c")]), end_id=1).collect()} == {4}


def test_histogram(table, models):
    docs = [(i, "word " * (i % 7)) for i in range(60)] + [(90, None), (91, "tail " * 900)]
    sizes = np.array([len(models[1].encode(t or "", add_special_tokens=False).ids) for _, t in docs])
    h = length_histogram(table(docs))
    rows = h.collect()
    assert sum(r.n_docs for r in rows) == len(docs)
    for r in rows:
        assert r.docs_from == (sizes >= r.length).sum() and r.tokens_from == sizes[sizes >= r.length].sum()
        assert r.tokens_cut_here == np.minimum(sizes, r.length).sum() and r.docs_cut_here == (sizes > r.length).sum()
    for r in at_limits(h, [0, 3, 500, 5000]).collect():
        assert r.tokens_cut == np.minimum(sizes, r.context).sum() and r.docs_cut == (sizes > r.context).sum()
    assert quantile(h, 0.5).first()[0] == np.sort(sizes)[(len(sizes) - 1) // 2]
    assert length_histogram(table([])).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1}])
def test_packing(table, models, weights):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.randint(0, 900))), rng.choice(["a", "a", "a", "b", None])) for i in range(80)] + [(200, None, "b"), (201, "", "c"), (202, "word " * 30_000, "b")]
    ids = {i: models[1].encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in docs}
    rows = pack(table(docs, extra=True), weights=weights).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(s == SEQUENCE or s & (s - 1) == 0 for s in sizes)
    if weights is None:  # every prefix of windows holds the sources' shares
        total = defaultdict(int)
        source = {i: s for i, _, s in docs}
        for i, x in ids.items():
            total[source[i]] += len(x)
        seen, n = defaultdict(int), sum(total.values())
        for k in range(len(by_sequence)):
            for r in by_sequence[k]:
                seen[source[r.doc_id]] += r.length
            assert max(abs(seen[s] - sum(seen.values()) * total[s] / n) for s in total) < 2 * 512
    assert pack(table([])).count() == 0
