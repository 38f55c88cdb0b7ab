import hashlib
import itertools
from collections import Counter

import pytest
from granary.llm import alignment as A
from granary.llm.bpe import _byte_alphabet, default_path

TEXTS = [
    None, "", "a", " ", "Hello  world", "▁x", "a ▁", "éa\n\n b <0x0A></s> <|endoftext|>", "  日本語 \U0001f600 été", "x" * 3000, "a\x00b", "The quick brown fox, the quick brown fox. " * 20, "The quick brown fox",
    "Grüße aus Köln und Straßburg.", "\t tabs\r\nand lines\n", "1234567890 12:30", "  ﻿ end ",
]


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    ours, theirs = Tokenizer.from_file(default_path()), sentencepiece.SentencePieceProcessor(model_file=A.default_piece_path())
    ours.encode_special_tokens = True
    alphabet = _byte_alphabet()

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(alphabet[c] for c in ours.id_to_token(i))) for i in ours.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(theirs.id_to_piece(i)[3:5], 16)]) if theirs.is_byte(i) else theirs.id_to_piece(i).replace("▁", " ").encode()) for i in theirs.encode(text)]
        same = all(b"".join(x for _, x in side) == b" " + text.encode() for side in (a, b))
        return (a, b) if same else ([], [])

    def spans(side):
        ends = list(itertools.accumulate(len(x) for _, x in side))
        return [(i, s, e) for (i, _), s, e in zip(side, [0, *ends], ends)]

    def run(docs):
        parts, total = [], Counter()
        for doc_id, text in docs:
            a, b = map(spans, tokens(text))
            linked = Counter((x, y) for x, s, e in a for y, u, v in b if s < v and u < e)
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            groups = [tuple([str(i) for i, s, e in side if low <= s and e <= high] for side in (a, b)) for low, high in zip([0, *cuts], cuts)]
            parts.append((doc_id, a, b, groups, linked))
            total += linked
        most = {}
        for (_, y), n in total.items():
            most[y] = max(most.get(y, 0), n)
        return sorted(
            (
                (
                    doc_id, len(a), len(b), len(groups), sum(linked.values()), sum(n for p, n in linked.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in linked.items()),
                    hashlib.sha256(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups).encode()).hexdigest() if groups else "",
                )
                for doc_id, a, b, groups, linked in parts
            ),
            key=str,
        )

    return run


def test_against_brute_force(table, brute, monkeypatch):
    docs = [*enumerate(TEXTS), (4, TEXTS[4]), (None, "Hello world"), (99, "The quick brown fox")]
    got = lambda: sorted((tuple(r) for r in A.align(table(docs, extra=True)).collect()), key=str)
    want = brute(docs)
    assert got() == want
    # all pairs but the most frequent are joined by Spark
    monkeypatch.setattr(A, "FREQUENT_PAIRS", 20)
    assert got() == want
    monkeypatch.setattr(A, "HELD", 5)
    assert got() == want


def test_texts_without_tokens(table, brute):
    rows = {r.doc_id: r for r in A.align(table(list(enumerate(TEXTS)))).collect()}
    for i in (0, 1, 5, 6):  # null, empty, and texts whose pieces spell something else
        assert tuple(rows[i])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert rows[8].n_a and rows[8].n_links == rows[8].n_a + rows[8].n_b - rows[8].n_groups


def test_empty_table(table):
    assert A.align(table([(1, "a")]).limit(0)).collect() == []
