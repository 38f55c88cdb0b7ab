"""Gradient-boosted trees of four leaves: each level of a tree is one pass over the rows, whose tasks return sums by bin.

Features are cut once into at most 32 bins, three of them to a number of 15 bits, and rows lie in blocks of arrays, so a task adds up
a block in a few calls. A row is in the sample of an iteration by a hash of its key. Models for different folds grow together, so
that a pass serves all of them; of a node's two children only the smaller is added up, the other is the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from granary.functions.exprs import clean

#: Bins of a feature, rows of a block, places of its values that a task keeps, and iterations after which their trees are taken off the blocks' rests.
BINS, BLOCK, POINTS, ADDED = 32, 1 << 17, 1024, 10
_CELLS = BINS**3
_BLOCKS = "fold int, codes binary, draw binary, rest binary"


def cuts(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Where features are cut, missing ones being 0: between all values if these are few, else at quantiles. A row lies below a cut that it equals.

    Tasks sort blocks of rows and keep POINTS places of each feature, so a quantile's place is within a thousandth of all rows.
    """
    names = [f"_x{i}" for i in range(len(features))]

    def thinned(values, weights):
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, (np.arange(POINTS) + 0.5) * upto[-1] / POINTS, "left")
        return values[order[np.minimum(at, len(order) - 1)]], np.full(POINTS, upto[-1] / POINTS)

    def work(batches):
        held = [[] for _ in names]
        few: list = [np.zeros(0) for _ in names]  # all values of a feature, None if there are more than BINS
        for x in _in_blocks(batches, names):
            for i, v in enumerate(x):
                v = np.sort(v)
                own = v[np.append(True, v[1:] != v[:-1])]
                if few[i] is not None:
                    few[i] = np.union1d(few[i], own) if len(own) <= BINS else None
                    few[i] = few[i] if few[i] is not None and len(few[i]) <= BINS else None
                held[i].append(thinned(v, np.ones(len(v))))
        if held and held[0]:
            points = [thinned(*(np.concatenate(a) for a in zip(*h))) for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array([None if f is None else f.tolist() for f in few], pa.list_(pa.float64())), pa.array([v.tolist() for v, _ in points]), pa.array([w.sum() for _, w in points])], names=["i", "few", "points", "n"])

    rows = df.select(*(F.coalesce(clean(f), F.lit(0.0)).alias(n) for f, n in zip(features, names)))
    found = rows.mapInArrow(work, "i int, few array<double>, points array<double>, n double").collect()  # POINTS numbers for each task and feature
    out = []
    for i in range(len(features)):
        own = [r for r in found if r.i == i]
        values = np.unique(np.concatenate([r.few for r in own])) if own and all(r.few is not None for r in own) else None
        if values is not None and len(values) <= BINS:
            out.append((values[1:] + values[:-1]) / 2)
        elif own:
            v, w = np.concatenate([r.points for r in own]), np.concatenate([np.full(POINTS, r.n / POINTS) for r in own])
            order = np.argsort(v, kind="stable")
            upto = np.cumsum(w[order])
            out.append(np.unique(v[order[np.searchsorted(upto, np.arange(1, BINS) * upto[-1] / BINS, "left")]]))
        else:
            out.append(np.zeros(0))
    return out


def _in_blocks(batches, names: list[str]):
    """The named columns of about BLOCK rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append(_columns(b, names))
        n += b.num_rows
        if n >= BLOCK:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _coded(x: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
    """The bins of each three features as one number."""
    out = np.zeros((-(-len(x) // 3), len(x[0])), np.uint16)
    for i, (v, c) in enumerate(zip(x, at)):
        out[i // 3] |= np.searchsorted(c, v, "left").astype(np.uint16) << np.uint16(5 * (i % 3))
    return out


def _low(codes: np.ndarray, feature: int, cut: int) -> np.ndarray:
    return (codes[feature // 3] >> np.uint16(5 * (feature % 3))) & np.uint16(BINS - 1) <= cut


def _tree(codes: np.ndarray, tree: tuple) -> np.ndarray:
    root, left, right, v = tree
    return np.where(_low(codes, *root), np.where(_low(codes, *left), v[0], v[1]), np.where(_low(codes, *right), v[2], v[3]))


def _drawn(draw: np.ndarray, iteration: int, seed: int, share: float) -> np.ndarray:
    """Whether rows are in the sample of an iteration, by a mix of their keys' hash with its number."""
    h = draw ^ np.uint32((0x9E3779B9 * (iteration + 1) + 0x85EBCA6B * seed) & 0xFFFFFFFF)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))) < share * 2.0**32


def _split(n: np.ndarray, s: np.ndarray, at: list[np.ndarray], least: int) -> tuple[int, int] | None:
    """The feature and bin whose cut takes most off the squared error, the first of equals; None if nothing does."""
    nl, sl = np.cumsum(n, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
    nr, sr = n[0].sum() - nl, s[0].sum() - sl
    ok = (nl >= max(least, 1)) & (nr >= max(least, 1)) & (np.arange(BINS - 1)[None, :] < np.array([len(c) for c in at])[:, None])
    gain = np.where(ok, sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1) - s[0].sum() ** 2 / max(n[0].sum(), 1), 0.0)
    best = int(gain.argmax())
    return divmod(best, BINS - 1) if gain.flat[best] > 0 else None


class _Models:
    """`count` models that grow together: number k learns from the rows of all folds but k, a single one from all rows."""

    def __init__(self, df: DataFrame, count: int, fold: str | None, features: list[str], y: str, key: str, step: float, share: float, least: int, seed: int):
        self.count, self.p, self.step, self.share, self.least, self.seed = count, len(features), step, share, least, seed
        self.at = cuts(df, features)
        self.trees: list[list[tuple]] = [[] for _ in range(count)]
        self.added = 0  # trees that the blocks' rests lack
        x = [F.coalesce(clean(f), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)]
        number = F.col(fold).cast("int") if fold else F.lit(-1)
        rows = df.select(number.alias("_fold"), clean(y).alias("_y"), F.hash(key).alias("_draw"), *x).filter("_fold is not null and _y is not null")
        tasks = df.sparkSession.sparkContext.defaultParallelism  # a pass is short, so one task for each core
        self.blocks = rows.coalesce(tasks).mapInArrow(_to_blocks(self.at, count), _BLOCKS).persist()

    def _pass(self, iteration: int, roots: list | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts and sums of the residuals by feature and bin for each model: of its sample, or of the part of it that `roots` names: (feature, bin, below)."""
        count, p, share, seed, groups = self.count, self.p, self.share, self.seed, -(-self.p // 3)
        pending = [t[self.added :] for t in self.trees]

        def work(batches):
            held = np.zeros((count, 2, groups, _CELLS))
            for fold, codes, draw, rest in _opened(batches, groups, count):
                drawn = _drawn(draw, iteration, seed, share)
                for k in range(count):
                    if fold == k and count > 1 or roots is not None and roots[k] is None:
                        continue
                    mine = drawn if roots is None else drawn & (_low(codes, *roots[k][:2]) == roots[k][2])
                    rows = np.flatnonzero(mine)
                    some, residual = codes[:, rows], rest[k][rows]
                    for t in pending[k]:
                        residual = residual - _tree(some, t)
                    if iteration:
                        residual = 2 * residual
                    for j in range(groups):
                        code = some[j].astype(np.intp)
                        held[k, 0, j] += np.bincount(code, minlength=_CELLS)
                        held[k, 1, j] += np.bincount(code, residual, _CELLS)
            cube = held.reshape(count, 2, groups, BINS, BINS, BINS)
            by_feature = np.stack([cube.sum(axis=(3, 4)), cube.sum(axis=(3, 5)), cube.sum(axis=(4, 5))], axis=3)  # the first feature has the lowest bits
            sums = by_feature.reshape(count, 2, 3 * groups, BINS)[:, :, :p]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(sums).tobytes()], pa.binary())], names=["g"])

        total = np.zeros((count, 2, p, BINS))
        for r in self.blocks.mapInArrow(work, "g binary").collect():  # a row for each task
            total += np.frombuffer(r[0]).reshape(total.shape)
        return [(g[0], g[1]) for g in total]

    def grow(self, iteration: int) -> None:
        whole = self._pass(iteration, None)
        roots = [_split(n, s, self.at, self.least) for n, s in whole]
        below = [r is not None and 2 * n[r[0], : r[1] + 1].sum() <= n[r[0]].sum() for r, (n, _) in zip(roots, whole)]
        part = self._pass(iteration, [None if r is None else (*r, b) for r, b in zip(roots, below)]) if any(roots) else whole
        for k, ((n, s), root) in enumerate(zip(whole, roots)):
            weight = self.step if iteration else 1.0  # the first tree is not scaled
            none, mean = (0, BINS), lambda a, b: float(b.sum() / a.sum() * weight) if a.sum() else 0.0  # noqa: E731, B023
            if root is None:
                self.trees[k].append((none, none, none, (mean(n[0], s[0]),) * 4))
                continue
            other = (n - part[k][0], s - part[k][1])
            children, values = [], []
            for a, b in (part[k], other) if below[k] else (other, part[k]):
                cut = _split(a, b, self.at, self.least)
                children.append(cut or none)
                f, c = cut or (0, BINS - 1)
                values += [mean(a[f, : c + 1], b[f, : c + 1]), mean(a[f, c + 1 :], b[f, c + 1 :])]
            self.trees[k].append((root, *children, tuple(values)))
        if iteration - self.added + 1 >= ADDED:
            self._add()

    def _add(self) -> None:
        count, groups, pending, before = self.count, -(-self.p // 3), [t[self.added :] for t in self.trees], self.blocks

        def work(batches):
            for fold, codes, draw, rest in _opened(batches, groups, count):
                for k in range(count):
                    if fold != k or count == 1:
                        for t in pending[k]:
                            rest[k] -= _tree(codes, t)
                yield _block(fold, codes, draw, rest)

        self.blocks, self.added = before.mapInArrow(work, _BLOCKS).persist(), len(self.trees[0])
        self.blocks.count()
        before.unpersist()

    def predicted(self, df: DataFrame, fold: str | None, features: list[str], keep: list[str]) -> DataFrame:
        """`keep` of df and pred, by the model that did not learn from the row's fold, or by the only one."""
        at, trees, names = self.at, self.trees, [f"_x{i}" for i in range(self.p)]

        def work(batches):
            for b in batches:
                pred = np.full(b.num_rows, np.nan)
                if b.num_rows:
                    codes = _coded(_columns(b, names), at)
                    which = b.column("_fold").to_numpy(zero_copy_only=False)
                    for k, own in enumerate(trees):
                        rows = np.flatnonzero(which == k)
                        some = codes[:, rows]
                        pred[rows] = sum((_tree(some, t) for t in own), np.zeros(len(rows)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(pred)], names=[*keep, "pred"])

        number = F.col(fold).cast("int") if fold else F.lit(0)
        rows = df.select(*keep, number.alias("_fold"), *(F.coalesce(clean(f), F.lit(0.0)).alias(n) for f, n in zip(features, names)))
        return rows.mapInArrow(work, StructType([*(df.schema[c] for c in keep), StructField("pred", DoubleType())]))


def _block(fold, codes, draw, rest) -> pa.RecordBatch:
    data = [pa.array([int(fold)], pa.int32()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (codes, draw, rest))]
    return pa.RecordBatch.from_arrays(data, names=["fold", "codes", "draw", "rest"])


def _to_blocks(at: list[np.ndarray], count: int):
    names = [f"_x{i}" for i in range(len(at))]

    def work(batches):
        for which, y, draw, *x in _in_blocks(batches, ["_fold", "_y", "_draw", *names]):
            codes = _coded(x, at)
            for fold in np.unique(which).tolist():
                rows = np.flatnonzero(which == fold)
                yield _block(fold, codes[:, rows], draw[rows].astype(np.int32).view(np.uint32), np.tile(y[rows].astype(float), (count, 1)))

    return work


def _opened(batches, groups: int, count: int):
    """fold, codes, draw and rest, the target less the trees so far, of each block; rest may be written to."""
    for b in batches:
        for i in range(b.num_rows):
            codes, draw, rest = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("codes", np.uint16), ("draw", np.uint32), ("rest", float)))
            yield b.column("fold")[i].as_py(), codes.reshape(groups, -1), draw, rest.reshape(count, -1).copy()


def _boosted(df, count, fold, features, y, iterations, key, keep, step, share, least, seed) -> DataFrame:
    models = _Models(df, count, fold, features, y, key, step, share, least, seed)
    for i in range(iterations):
        models.grow(i)
    models.blocks.unpersist()
    return models.predicted(df, fold, features, keep or df.columns)


def boosted_trees(
    df: DataFrame, features: list[str], y: str, iterations: int = 140, key: str = "row_id", keep: list[str] | None = None, step: float = 0.05, share: float = 0.6, least: int = 5, seed: int = 7
) -> DataFrame:
    """`keep` of `df` (all columns) and pred, by trees of four leaves on a `share` of the rows each. No monotone constraints: see sign_audit.

    As Spark's GBTRegressor, trees after the first fit twice the residual and count `step`; leaves have `least` rows or more.
    """
    return _boosted(df, 1, None, features, y, iterations, key, keep, step, share, least, seed)


def boosted_oof(
    df: DataFrame, fold: str, folds: int, features: list[str], y: str, iterations: int = 140, key: str = "row_id", keep: list[str] | None = None, step: float = 0.05, share: float = 0.6, least: int = 5, seed: int = 7
) -> DataFrame:
    """`keep` of `df` and pred, each of the folds 0, 1, ... predicted by trees trained on all others; all models grow in the same passes."""
    df = df.filter(F.col(fold).cast("int").between(0, folds - 1))
    return _boosted(df, folds, fold, features, y, iterations, key, keep, step, share, least, seed)
