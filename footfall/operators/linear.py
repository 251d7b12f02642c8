"""Penalised logistic models, all at once: every persona, parameter set, fold and resample.

A pass over the rows works out, inside the tasks and for all models together, the loss, its
gradient and its matrix of second derivatives; the sums of the tasks are added up in a tree and
each model takes a proximal Newton step (coordinate descent on the summed matrix), halved where
the objective would grow. So a search of hundreds of fits is a few dozen Spark jobs, and the
driver sees coefficients only. The optimum is that of

    mean log loss + alpha * (l1_ratio * |w|_1 + (1 - l1_ratio) / 2 * |w|_2^2)

with a free intercept, whatever the number of passes: fits end when the optimality conditions hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.columns import hash_key, hash_number
from footfall.operators.sampling import POISSON_TERMS, stratified_folds
from footfall.sources.staging import materialize

TARGET = "target_shopped_ind"
#: Models whose sums travel in one row, and rows of sums that one task adds up.
BLOCK, FANIN = 32, 32
#: Rows to fit on that are stored in one file.
FILE_ROWS = 4096
#: Sweeps of coordinate descent between two solves.
EVERY = 5
#: Largest violation of the optimality conditions of a finished fit.
TOLERANCE = 1e-7

FeatureLists = dict[int, list[str]]


@dataclass(frozen=True)
class Fit:
    """One model: its penalty on the mean loss (`alpha`) or on the summed one (`c`), and the rows it is fitted on."""

    persona: int
    alpha: float | None = None
    l1_ratio: float = 1.0
    c: float | None = None
    fold: int | None = None  # held out
    replicate: int | None = None  # weights of this resample


@dataclass
class Fitted:
    """coefs: a row per model, the intercept last; with the worst violation and the passes taken."""

    fits: list[Fit]
    coefs: list[np.ndarray]
    violations: np.ndarray
    passes: int


def fit_rows(df: DataFrame, features: FeatureLists, replicates: int = 0, seed: int = 4040, key: str = "cust_key") -> DataFrame:
    """(persona, y, fold, x, u) of the personas that have features, stored by persona in files of FILE_ROWS rows.

    So a pass over them is spread over all cores, whatever files `df` lies in. x has the persona's features in their order, u a number in [0, 1) per resample, from the row's
    digest; fold is -1 where the rows have none.
    """
    x = F.lit(None).cast("array<double>")
    for persona, names in features.items():
        x = F.when(F.col("persona") == persona, F.array(*[F.col(c).cast("double") for c in names])).otherwise(x)
    u = F.array().cast("array<double>")
    if replicates:
        places = F.sequence(F.lit(0), F.lit(replicates - 1))
        u = F.transform(places, lambda r: hash_number(hash_key(seed, r, key)) / F.lit(float(16**13)))
    fold = F.col("fold") if "fold" in df.columns else F.lit(-1)
    rows = df.where(F.col("persona").isin(list(features)))
    rows = rows.repartitionByRange(max(1, -(-rows.count() // FILE_ROWS)), "persona", F.xxhash64(key))
    return materialize(rows.select("persona", F.col(TARGET).cast("double").alias("y"), fold.cast("int").alias("fold"), x.alias("x"), u.alias("u")), "fit-rows")


def poisson_counts(u: np.ndarray) -> np.ndarray:
    """How often each row is drawn: Poisson(1) at the quantile u, as `sampling.poisson_weight` has it."""
    below, term, edges = 0.0, 0.36787944117144233, []
    for k in range(POISSON_TERMS):
        below += term
        edges.append(below)
        term /= k + 1
    return np.searchsorted(np.array(edges), u, side="right").astype(float)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a feature to be fitted on has nulls")
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _weights(fits: list[Fit], fold: np.ndarray, u: np.ndarray) -> np.ndarray:
    """(rows, models): the weight of each row in each model."""
    out = np.empty((len(fold), len(fits)))
    drawn = poisson_counts(u) if u.size else None
    for j, fit in enumerate(fits):
        out[:, j] = 1.0 if fit.replicate is None else drawn[:, fit.replicate]
        if fit.fold is not None:
            out[:, j] *= fold != fit.fold
    return out


def _log_loss(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - y[:, None] * margin


def _by_persona(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        personas = batch.column("persona").to_numpy()
        for persona in np.unique(personas).tolist():
            part = batch.filter(pa.array(personas == persona))
            n = part.num_rows
            x = np.column_stack([_matrix(part.column("x"), n), np.ones(n)])
            yield persona, x, part.column("y").to_numpy(), part.column("fold").to_numpy(), _matrix(part.column("u"), n)


def _sums(rows: DataFrame, blocks: dict[int, list[list[Fit]]], coefs: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(persona, block, part, sums): per model weight, loss, gradient and second derivatives, of each task."""
    shared = rows.sparkSession.sparkContext.broadcast(coefs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made: dict[tuple[int, int], np.ndarray] = {}
        for persona, x, y, fold, u in _by_persona(batches):
            q = x.shape[1]
            for b, fits in enumerate(blocks[persona]):
                w = shared.value.get((persona, b))
                if w is None:  # all of them are done
                    continue
                out = made.setdefault((persona, b), np.zeros((len(fits), 2 + q + q * q)))
                weight, margin = _weights(fits, fold, u), x @ w.T
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                out[:, 0] += weight.sum(0)
                out[:, 1] += (weight * _log_loss(margin, y)).sum(0)
                out[:, 2 : 2 + q] += (weight * (p - y[:, None])).T @ x
                for j, s in enumerate((weight * p * (1 - p)).T):
                    out[j, 2 + q :] += ((x * s[:, None]).T @ x).ravel()
        part = TaskContext.get().partitionId()
        for (persona, b), out in made.items():
            yield pa.RecordBatch.from_pylist([{"persona": persona, "block": b, "part": part, "sums": out.tobytes()}], _SUMS)

    return rows.mapInArrow(run, "persona int, block int, part int, sums binary")


_SUMS = pa.schema([("persona", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])


def _added(table: pa.Table) -> np.ndarray:
    total = None
    for piece in table.column("sums"):
        values = np.frombuffer(piece.as_buffer())
        total = values.copy() if total is None else total + values
    return total


def _tree(sums: DataFrame, parts: int) -> DataFrame:
    """Rows of sums, added up until at most FANIN are left per block."""

    def add(key, table):
        persona, block, part = (k.as_py() for k in key)
        return pa.Table.from_pylist([{"persona": persona, "block": block, "part": part, "sums": _added(table).tobytes()}], _SUMS)

    while parts > FANIN:
        parts = -(-parts // FANIN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FANIN).cast("int")).groupBy("persona", "block", "part").applyInArrow(add, sums.schema)
    return sums


def _on_support(w: np.ndarray, slope: np.ndarray, second: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """One model's w moved, among weights that keep their sign or become 0, to the least quadratic plus penalty.

    Columns that nearly repeat each other take coordinate descent thousands of sweeps; here they take one solve.
    """
    w = w.copy()
    penalty = np.append(np.full(len(w) - 1, l2), 0.0)
    moved = np.zeros(len(w))
    for _ in range(len(w)):
        on = np.append(np.flatnonzero(w[:-1]), len(w) - 1)
        sign = np.append(l1 * np.sign(w[on[:-1]]), 0.0)
        curve = second[np.ix_(on, on)] + np.diag(penalty[on] + 1e-12)
        step = np.linalg.lstsq(curve, -(slope[on] + second[on] @ moved + penalty[on] * w[on] + sign), rcond=1e-14)[0]
        share = np.full(len(on), np.inf)
        crosses = (w[on] * (w[on] + step) < 0) & (np.arange(len(on)) < len(on) - 1)
        share[crosses] = -w[on[crosses]] / step[crosses]
        first = min(1.0, share.min())
        moved[on] += first * step
        w[on] += first * step
        gone = on[share <= first]
        moved[gone] -= w[gone]
        w[gone] = 0
        if not len(gone):
            break
    return w


def newton_steps(w: np.ndarray, gradient: np.ndarray, second: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """The minimum of each model's quadratic approximation at w plus its penalty.

    Coordinate descent on all models finds the weights that are not 0; every EVERY sweeps each model is solved on its own.
    """
    q = w.shape[1]
    at, slope = w.copy(), gradient.copy()  # slope: gradient of the quadratic at `at`
    curve = np.einsum("mjj->mj", second) + 1e-12
    first = None
    for sweep in range(sweeps):
        moved = np.zeros(len(w))
        for j in range(q):
            if j < q - 1:
                h = curve[:, j] + l2
                z = curve[:, j] * at[:, j] - slope[:, j]
                new = np.sign(z) * np.maximum(np.abs(z) - l1, 0) / h
            else:
                new = at[:, j] - slope[:, j] / curve[:, j]
            step = new - at[:, j]
            at[:, j] = new
            slope += step[:, None] * second[:, j, :]
            moved = np.maximum(moved, np.abs(step) * np.sqrt(curve[:, j]))
        first = np.maximum(moved, 1e-300) if first is None else first
        if (moved <= 1e-4 * first).all() and sweep > EVERY:
            break
        if sweep % EVERY == EVERY - 1:
            for m in range(len(w)):
                at[m] = _on_support(at[m], slope[m], second[m], l1[m], l2[m])
            slope = gradient + np.einsum("mij,mj->mi", second, at - w)
    return at


def violations(w: np.ndarray, gradient: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """By how much each model misses its optimality conditions (subgradient of the penalty included)."""
    g = gradient[:, :-1] + l2[:, None] * w[:, :-1]
    off = np.where(w[:, :-1] != 0, np.abs(g + l1[:, None] * np.sign(w[:, :-1])), np.maximum(np.abs(g) - l1[:, None], 0))
    return np.maximum(off.max(1, initial=0), np.abs(gradient[:, -1]))


def fit_many(rows: DataFrame, features: FeatureLists, fits: list[Fit], max_passes: int = 1000, tolerance: float = TOLERANCE) -> Fitted:
    """All models over `fit_rows`.  A persona without rows keeps zeros."""
    order: dict[int, list[int]] = {}
    for i, fit in enumerate(fits):
        order.setdefault(fit.persona, []).append(i)
    members = {(p, b): own[at : at + BLOCK] for p, own in order.items() for b, at in enumerate(range(0, len(own), BLOCK))}
    blocks = {p: [[fits[i] for i in members[p, b]] for b in range(-(-len(own) // BLOCK))] for p, own in order.items()}
    sizes = {p: len(features[p]) + 1 for p in order}
    penalties = [(f.alpha, f.l1_ratio, f.c) for f in fits]

    best = [np.zeros(sizes[f.persona]) for f in fits]
    tried, towards, scale = [w.copy() for w in best], [w.copy() for w in best], np.ones(len(fits))
    least, off, open_ = np.full(len(fits), np.inf), np.full(len(fits), np.inf), set(range(len(fits)))
    schema = "persona int, block int, objective array<double>, off array<double>, next binary"
    passes = 0
    while open_ and passes < max_passes:
        passes += 1
        now = {k: np.stack([tried[i] for i in own]) for k, own in members.items() if open_.intersection(own)}
        shared = rows.sparkSession.sparkContext.broadcast(now)

        def step(key, table):
            persona, block = (k.as_py() for k in key)
            w = shared.value[persona, block]
            m, q = w.shape
            sums = _added(table).reshape(m, -1)
            own = [penalties[i] for i in members[persona, block]]
            total = np.maximum(sums[:, 0], 1e-300)
            alpha = np.array([a if c is None else 1 / (c * t) for (a, _, c), t in zip(own, total, strict=True)])
            ratio = np.array([r for _, r, _ in own])
            l1, l2 = alpha * ratio, alpha * (1 - ratio)
            gradient, second = sums[:, 2 : 2 + q] / total[:, None], sums[:, 2 + q :].reshape(m, q, q) / total[:, None, None]
            objective = sums[:, 1] / total + l1 * np.abs(w[:, :-1]).sum(1) + l2 / 2 * (w[:, :-1] ** 2).sum(1)
            after = newton_steps(w, gradient, second, l1, l2)
            row = {"persona": persona, "block": block, "objective": objective.tolist(), "off": violations(w, gradient, l1, l2).tolist(), "next": after.tobytes()}
            return pa.Table.from_pylist([row], pa.schema([("persona", pa.int32()), ("block", pa.int32()), ("objective", pa.list_(pa.float64())), ("off", pa.list_(pa.float64())), ("next", pa.binary())]))

        summed = _tree(_sums(rows, blocks, now), rows.rdd.getNumPartitions())
        answers = summed.groupBy("persona", "block").applyInArrow(step, schema).collect()  # coefficients and a few numbers per model
        seen = set()
        for row in answers:
            own = members[row.persona, row.block]
            after = np.frombuffer(row.next).reshape(len(own), -1)
            for i, objective, missed, w in zip(own, row.objective, row.off, after, strict=True):
                seen.add(i)
                if i not in open_:
                    continue
                if objective <= least[i] + 1e-14 * (1 + abs(objective)):
                    best[i], least[i], off[i], scale[i], towards[i] = tried[i], objective, missed, 1.0, w
                    tried[i] = w
                else:
                    scale[i] /= 2
                    tried[i] = best[i] + scale[i] * (towards[i] - best[i])
                if off[i] <= tolerance or scale[i] < 1e-9:
                    open_.discard(i)
        open_ &= seen
    return Fitted(fits, best, off, passes)


def held_out_loss(rows: DataFrame, fitted: Fitted) -> np.ndarray:
    """Mean log loss of each model over its held-out fold, probabilities kept 1e-15 away from 0 and 1; all models in one job."""
    order: dict[int, list[int]] = {}
    for i, fit in enumerate(fitted.fits):
        order.setdefault(fit.persona, []).append(i)
    shared = rows.sparkSession.sparkContext.broadcast({p: np.stack([fitted.coefs[i] for i in own]) for p, own in order.items()})
    folds = {p: np.array([-1 if fitted.fits[i].fold is None else fitted.fits[i].fold for i in own]) for p, own in order.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for persona, x, y, fold, _ in _by_persona(batches):
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ shared.value[persona].T, -700, 700))), 1e-15, 1 - 1e-15)
            loss = -np.where(y[:, None] > 0.5, np.log(p), np.log(1 - p))
            held = fold[:, None] == folds[persona][None, :]
            own = pa.array(order[persona], pa.int32())
            yield pa.RecordBatch.from_arrays([own, pa.array((loss * held).sum(0)), pa.array(held.sum(0), pa.int64())], ["model", "loss", "n"])

    sums = rows.mapInArrow(run, "model int, loss double, n long").groupBy("model").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    out = np.full(len(fitted.fits), np.nan)
    for row in sums.collect():
        out[row.model] = row.loss / row.n if row.n else np.nan
    return out


def grid_search(df: DataFrame, features: FeatureLists, grid: list[dict[str, float]], n_folds: int = 5, seed: int = S.SPLIT_SEED, max_passes: int = 1000) -> DataFrame:
    """(persona, params, mean_test_score, std_test_score, rank_test_score) of all points: negative log loss over stratified folds.

    Points have alpha and l1_ratio, or C (a penalty on summed losses, absolute values only). All
    fits of all personas run together; folds without rows of a persona are left out of its mean.
    """
    rows = fit_rows(stratified_folds(df, n_folds, seed), features)
    fits = [Fit(p, x.get("alpha"), x.get("l1_ratio", 1.0), x.get("C"), fold=k) for p in features for x in grid for k in range(n_folds)]
    losses = -held_out_loss(rows, fit_many(rows, features, fits, max_passes)).reshape(len(features), len(grid), n_folds)
    results = []
    for p, of_persona in zip(features, losses, strict=True):
        for x, scores in zip(grid, of_persona, strict=True):
            scores = scores[~np.isnan(scores)]
            if len(scores):
                results.append((p, {k: float(v) for k, v in x.items()}, float(scores.mean()), float(scores.std())))
    schema = "persona int, params map<string,double>, mean_test_score double, std_test_score double"
    order = Window.partitionBy("persona").orderBy(F.col("mean_test_score").desc())
    return df.sparkSession.createDataFrame(results, schema).withColumn("rank_test_score", F.rank().over(order))


def bootstrap_coefs(df: DataFrame, features: FeatureLists, n_resample: int = 100, alpha: float = 0.001, l1_ratio: float = 0.4, seed: int = 4040, max_passes: int = 1000) -> DataFrame:
    """(persona, replicate, feature, coef): elastic-net fits on resampled rows, all resamples of all personas together."""
    rows = fit_rows(df, features, n_resample, seed)
    fitted = fit_many(rows, features, [Fit(p, alpha, l1_ratio, replicate=r) for p in features for r in range(n_resample)], max_passes)
    found = [(f.persona, f.replicate, name, float(c)) for f, w in zip(fitted.fits, fitted.coefs, strict=True) for name, c in zip(features[f.persona], w, strict=False)]
    return df.sparkSession.createDataFrame(found, "persona int, replicate int, feature string, coef double")


def fit_each(df: DataFrame, features: FeatureLists, alpha: float | None = None, l1_ratio: float = 1.0, c: float | None = None, max_passes: int = 1000) -> dict[int, np.ndarray]:
    """One model per persona, with its intercept last."""
    rows = fit_rows(df, features)
    fitted = fit_many(rows, features, [Fit(p, alpha, l1_ratio, c) for p in features], max_passes)
    return dict(zip(features, fitted.coefs, strict=True))


def score(df: DataFrame, features: FeatureLists, coefs: dict[int, np.ndarray]) -> DataFrame:
    """(cust_key, persona, y, pred, prob) from one scan: the models are a column expression by persona."""
    margin: Column = F.lit(None).cast("double")
    for persona, w in coefs.items():
        terms = [F.col(name).cast("double") * F.lit(float(v)) for name, v in zip(features[persona], w, strict=False) if v != 0]
        margin = F.when(F.col("persona") == persona, sum(terms, F.lit(float(w[-1])))).otherwise(margin)
    prob = (1 / (1 + F.exp(-margin))).alias("prob")
    rows = df.where(F.col("persona").isin(list(coefs))).select("cust_key", "persona", F.col(TARGET).cast("int").alias("y"), prob)
    return rows.select("cust_key", "persona", "y", (F.col("prob") > 0.5).cast("int").alias("pred"), "prob")
