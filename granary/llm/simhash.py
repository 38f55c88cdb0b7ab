"""SimHash near-duplicates: fingerprints of word shingles, linked with pigeonring filtering.

Two fingerprints link when they differ in at most `radius` of 64 bits. The bits form a ring of equal
segments. If two fingerprints are within the radius, some segment starts a chain in which the first
l segments together differ in at most l * radius / segments bits, for every l. The chain's opening
segments must then agree exactly: they are the key of an equi-join; the rest of the chain is checked
before the full distance.

Copies share a fingerprint, so only distinct fingerprints are linked. A key that more than CROWD of
them share (many near copies of one text) does not form its pairs: the chain goes on. Of the segments
behind the opening, cut into radius + 1 blocks, one block must agree as well, and joins the key; a
crowd that is left is cut again, until a key holds all but a few bits and its group is bounded by what
those can say. Components come from alternating large-star and small-star rounds; every table that is
used twice is written to the shared folder. Keys and fingerprints that very many rows have learn their
counts and classes by a broadcast of bounded size.

Defined results: a null or blank text has fingerprint zero, which links like any other. Fewer words
than a shingle make one shingle. A text of any length is read whole. A null doc_id gets the smallest
doc_id of its component (null if there is none). Repeated rows come back repeated. Other columns of the
input take no part, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ._bytes import pieces
from ._shared import free_name, stored, with_value

SEGMENTS, CROWD, CUTS = 16, 32, 3


def fingerprint(text: str, shingle: int = 3) -> int:
    """A bit is 1 if over half of the shingles' hashes have it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    many = len(words) - width + 1
    xx = xxhash.xxh64_intdigest
    h = np.fromiter((xx(joined[a:b], 42) for a, b in zip(starts[:many].tolist(), ends[width - 1 :].tolist())), np.uint64, many)
    counts = np.zeros(64, np.int64)
    for i in range(0, many, 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > many, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """key, fp (the 64 bits as a signed long) and the columns `more` of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType()), *(docs.schema[c] for c in more)])

    def work(batches):
        for part in pieces(batches, text):
            bits = np.array([fingerprint(t or "", shingle) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64)), *part.columns[2:]], names=[key, "fp", *more])

    return docs.select(key, text, *more).mapInArrow(work, schema)


def _rotated(fp, by: int):
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def chain_budgets(segments: int, radius: int) -> tuple[int, list[tuple[int, int]]]:
    """Opening segments that must agree, and (segments, most differing bits) of each later step of a chain."""
    longest = [max(n for n in range(segments + 1) if n * radius // segments <= b) for b in range(radius + 1)]
    return longest[0], [(n, b) for b, n in enumerate(longest) if b]


def key_masks(segments: int, radius: int, cuts: int = CUTS) -> list[dict[int, list[int]]]:
    """For each cut, the bits (from the chain's start) that a key holds and those of the keys it is cut into."""
    width, known = 64 // segments, chain_budgets(segments, radius)[0]
    bits = lambda some: sum(((1 << width) - 1) << (64 - width * (i + 1)) for i in some)
    out, level = [], [tuple(range(known))]
    for _ in range(cuts):
        step, after = {}, []
        for own in level:
            free = [i for i in range(segments) if i not in own]
            blocks = [free[len(free) * j // (radius + 1) : len(free) * (j + 1) // (radius + 1)] for j in range(radius + 1)]
            children = [tuple(sorted((*own, *b))) for b in blocks if b]
            step[bits(own)] = [bits(c) for c in children]
            after += children
        out.append(step)
        level = after
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 2, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b): all pairs of distinct fp within the radius."""
    spark = prints.sparkSession
    opening, budgets = chain_budgets(segments, radius)
    width = 64 // segments
    masks = key_masks(segments, radius)
    turned = F.array(*(_rotated(F.col("fp"), i * width) for i in range(segments)))
    starts = prints.select("fp").distinct().select("fp", F.posexplode(turned).alias("start", "turned"))
    keyed = starts.withColumn("mask", F.lit(_signed(next(iter(masks[0])))).cast("long"))
    found = None
    for depth in range(len(masks) + 1):
        keyed = keyed.select("fp", "turned", F.struct("start", "mask", F.col("turned").bitwiseAND(F.col("mask")).alias("value")).alias("key"))
        shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-shared")
        total = shared.agg(F.sum("n")).first()[0]
        if not total:
            break
        live = stored(with_value(keyed, shared, "key", "n", total, "inner"), "simhash-keys")
        last = depth == len(masks)
        few = live if last else live.filter(F.col("n") <= crowd)
        pairs = few.alias("x").join(few.select("key", F.col("fp").alias("b"), F.col("turned").alias("other")).alias("y"), "key").filter(F.col("fp") < F.col("b"))
        differ = F.col("turned").bitwiseXOR(F.col("other"))
        for n, budget in budgets:
            pairs = pairs.filter(F.bit_count(F.shiftrightunsigned(differ, 64 - n * width) if n < segments else differ) <= budget)
        near = pairs.select(F.col("fp").alias("a"), "b")
        found = near if found is None else found.unionByName(near)
        crowded = live.filter(F.col("n") > crowd)
        if last or crowded.isEmpty():
            break
        table = spark.createDataFrame([(_signed(m), [_signed(c) for c in cs]) for m, cs in masks[depth].items()], "mask long, cut array<long>")
        keyed = crowded.select("fp", "turned", "key.start", "key.mask").join(F.broadcast(table), "mask").select("fp", "start", "turned", F.explode("cut").alias("mask"))
    return found.distinct() if found is not None else spark.createDataFrame([], "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node that has an edge."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "simhash-edges")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
            "simhash-edges",
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(now)
    raise RuntimeError("components did not settle")


def _classes(prints: DataFrame, radius: int, key: str) -> DataFrame:
    """prints (key, fp and more) with root (the least fp of the class) and component_id."""
    roots = components(links(prints, radius))
    least = prints.groupBy("fp").agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "_least", "_rows", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = stored(rooted.join(of_root, "root").select("fp", "root", "component_id", "_rows"), "simhash-classes")
    total = named.agg(F.sum("_rows")).first()[0] or 0
    return with_value(prints, named, "fp", "_rows", total, "inner").drop("_rows")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id of every row."""
    prints = stored(fingerprints(docs, shingle, key, text), "simhash-prints")
    return _classes(prints, radius, key).select(key, "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without all but one row of each component: of the least key, then of the least text hash.

    Rows of one key are judged by their own texts. Of rows with one key and text, the least by all
    columns (as JSON) stays. Rows without a key stay.
    """
    digest, n = free_name(docs, "_text_hash"), free_name(docs, "_turn")
    marked = docs.withColumn(digest, F.xxhash64(text))
    prints = fingerprints(marked.filter(F.col(key).isNotNull()), shingle, key, text, digest)
    judged = _classes(stored(prints, "simhash-prints"), radius, key)
    # a component's rows beyond its least key go; those of the least key are few
    least = judged.filter(F.col(key) == F.col("component_id")).groupBy(key, "root").agg(F.min(digest).alias("_best"))
    best = least.select(key, F.col("_best").alias(digest))
    rows = stored(judged.groupBy(key, digest).agg(F.count(F.lit(1)).alias("_rows")), "simhash-fate")
    first = best.withColumn("_first", F.lit(True))
    fate = stored(rows.join(first, [key, digest], "left"), "simhash-fate")
    # both tables grow with the documents: neither is broadcast, and the documents are shuffled once
    leave = fate.filter("_first is null or _rows > 1").select(key, digest).hint("shuffle_hash")
    kept = marked.join(leave, [key, digest], "left_anti").select(docs.columns)
    again = fate.filter("_first and _rows > 1").select(key, digest)
    if again.isEmpty():
        return kept
    several = marked.join(again.hint("shuffle_hash"), [key, digest], "left_semi")
    turn = F.row_number().over(W.partitionBy(key, digest).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
    return kept.unionByName(several.withColumn(n, turn).filter(F.col(n) == 1).select(docs.columns))
