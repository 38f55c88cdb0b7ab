import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from granary.llm._shared import stored
from granary.llm.quality_rules import judge_quality

from .test_repeats import brute_words
from .test_simhash import brute_fingerprint, roots
from .test_tokens import Bpe, default_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = stored(C.quality_rules(spark, docs, SF), "t")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in judge_quality(docs).filter("kept").collect()} and good.columns == columns
    once = stored(C.simhash_near_dedup(spark, good, SF), "t")
    prints = {r.doc_id: brute_fingerprint(r.text) for r in good.collect()}
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in prints.items()}
    root = roots(signed.values(), 2)
    assert {r.doc_id for r in once.collect()} == {min(i for i, v in signed.items() if root[v] == x) for x in set(root.values())} and once.columns == columns
    short = stored(C.substring_dedup(spark, once, SF), "t")
    want = {i: n - gone for i, n, gone, _ in brute_words([(r.doc_id, r.text) for r in once.collect()])}
    assert {r.doc_id: len(r.text.split()) for r in short.collect()} == want and short.columns == columns
    assert short.filter(F.length("text") != F.col("n_chars")).count() == 0
    packed = C.packing(spark, short, SF)
    with open(default_path(), encoding="utf-8") as f:
        bpe = Bpe(f.read())
    import pyarrow as pa

    rows = short.collect()
    _, ends = bpe.encode(pa.array([r.text for r in rows]))
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {r.doc_id: int(b - a) + 1 for r, a, b in zip(rows, ends, ends[1:])}


def test_stage_list():
    assert [n for n, _ in C.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "packing"]


def test_stages_with_odd_rows(spark):
    prose = " ".join(f"the w{i} of" for i in range(40))
    other = " ".join(f"and x{i} is" for i in range(40))
    rows = [(1, prose), (2, prose), (2, prose), (3, other + " " + prose), (4, None), (5, ""), (6, " \n"), (None, prose), (7, other.upper()), (8, "short text")]
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit("mine") for c in ("_row", "kept", "fp", "_text_hash", "_g", "queue", "n_words", "start")})
    good = stored(C.quality_rules(spark, docs, SF), "t")
    assert sorted(str(r.doc_id) for r in good.collect()) == ["1", "2", "2", "3", "7", "None"] and good.columns == docs.columns
    once = stored(C.simhash_near_dedup(spark, good, SF), "t")
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "3", "7", "None"] and once.columns == docs.columns and {r.kept for r in once.collect()} == {"mine"}
    short = stored(C.substring_dedup(spark, once, SF), "t")
    assert {str(r.doc_id): (r.text, r.n_chars) for r in short.collect()} == {str(i): (t, len(t)) for i, t in ((1, prose), (3, other), (7, other.upper()), (None, prose))} and short.columns == docs.columns
    packed = C.packing(spark, short, SF).collect()
    assert sorted({str(r.doc_id) for r in packed}) == ["1", "3", "7", "None"] and all(r.queue == "=s" for r in packed)
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0
