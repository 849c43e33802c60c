"""Fits: distribution families by group, thinned sets by expectation maximisation, raking.

Spark reduces rows to a few sums and a histogram for each group; only these reach the small solvers, one group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the histogram that a mixture is fitted to, and bounds in units of the support.
CELLS, LEAST_STD, MOST_STD, LEAST_SHARE = 256, 0.02, 3.0, 0.05

#: Where the descent of two normals starts: weight, mean and spread of each; None is the sample's own mean or spread. Fixed values.
STARTS = ((0.5, 0.25, 0.2, 0.75, 0.2), (0.3, None, None, 0.75, 0.1), (0.7, 0.25, 0.1, None, None))


def descend(f: Callable[[np.ndarray], float], start: Sequence[float], bounds: Sequence[tuple[float, float]], rounds: int = 400) -> tuple[np.ndarray, float]:
    """A minimum within bounds by steps along each coordinate, which double on success and halve on failure."""
    low, high = np.array(bounds, float).T
    x = np.clip(np.array(start, float), low, high)
    best, step = f(x), (high - low) / 8
    for _ in range(rounds):
        moved = False
        for k in range(len(x)):
            for way in (1, -1):
                y = x.copy()
                y[k] = min(max(y[k] + way * step[k], low[k]), high[k])
                value = f(y)
                if value < best - 1e-15:
                    x, best, moved = y, value, True
                    step[k] *= 2
                    break
            else:
                step[k] /= 2
        if not moved and (step < 1e-10 * (high - low)).all():
            break
    return x, best


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_nll(mean: float, std: float, m1: float, m2: float) -> float:
    """Mean negative log likelihood of a normal truncated to [0, 1], from the first two moments."""
    inside = _phi((1 - mean) / std) - _phi(-mean / std)
    return math.inf if inside <= 0 else (m2 - 2 * mean * m1 + mean * mean) / (2 * std * std) + math.log(std) + 0.5 * math.log(2 * math.pi) + math.log(inside)


def _mixture(x: np.ndarray, w: np.ndarray, start: Sequence[float]) -> tuple[np.ndarray, float]:
    def density(mean, std):
        inside = max(_phi((1 - mean) / std) - _phi(-mean / std), 1e-300)
        return np.exp(-((x - mean) ** 2) / (2 * std * std)) / (std * math.sqrt(2 * math.pi) * inside)

    def nll(t):
        return -float(w @ np.log(np.maximum(t[0] * density(t[1], t[2]) + (1 - t[0]) * density(t[3], t[4]), 1e-300)))

    spread = (LEAST_STD, MOST_STD)
    return descend(nll, start, [(LEAST_SHARE, 1 - LEAST_SHARE), (0, 1), spread, (0, 1), spread], 80)


def fit_families(rows: DataFrame, keys: Sequence[str], value: str, weight: str, record: str, cluster: str, low: float, high: float, log: bool = False, min_records: int = 30, min_clusters: int = 3) -> DataFrame:
    """keys, status, family, params (map), score, effective, n, outside: the family of the least 2 * effective * nll + k * ln effective
    among uniform, truncated normal, beta (no value on the boundary), power law (on a log scale) and a mixture of two normals."""
    kind = "log_uniform" if log else "uniform"
    u = (F.ln(value) - math.log(low)) / (math.log(high) - math.log(low)) if log else (F.col(value) - low) / (high - low)
    marked = rows.withColumn("_in", F.coalesce(F.col(value).between(low, high), F.lit(False))).withColumn("_u", F.when(F.col("_in"), u)).withColumn("_w", F.when(F.col("_in"), F.col(weight)))
    w, x = F.col("_w"), F.col("_u")
    sums = marked.groupBy(*keys).agg(
        F.count("_w").alias("n"), F.count_if(~F.col("_in")).alias("outside"), F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"),
        F.sum(F.when((x > 0) & (x < 1), w * F.ln(x))).alias("l1"), F.sum(F.when((x > 0) & (x < 1), w * F.ln(1 - x))).alias("l2"), F.max(((x <= 0) | (x >= 1)).cast("int")).alias("edge"),
        F.countDistinct(F.when(F.col("_in"), F.col(record))).alias("records"), F.countDistinct(F.when(F.col("_in"), F.col(cluster))).alias("clusters"),
    )
    masses = marked.where("_in").groupBy(*keys, cluster).agg(F.sum("_w").alias("_m")).groupBy(*keys).agg((F.sum("_m") * F.sum("_m") / F.sum(F.col("_m") * F.col("_m"))).alias("effective"))
    cells = marked.where("_in").groupBy(*keys, F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int").alias("_c")).agg(F.sum("_w").alias("_m")).groupBy(*keys).agg(F.collect_list(F.struct("_c", "_m")).alias("cells"))
    joined = sums.join(masses, list(keys), "left").join(cells, list(keys), "left")
    names = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                base = [r[k] for k in keys]
                if r["records"] < min_records or r["clusters"] < min_clusters:
                    out.append((*base, "insufficient_support", None, None, None, r["effective"], r["n"], r["outside"]))
                    continue
                m1, m2 = r["s1"] / r["s0"], r["s2"] / r["s0"]
                std = min(max(math.sqrt(max(m2 - m1 * m1, 0.0)), LEAST_STD), MOST_STD)
                found = [(kind, {}, 0.0)]
                t, nll = min((descend(lambda t: normal_nll(t[0], t[1], m1, m2), s, [(0, 1), (LEAST_STD, MOST_STD)]) for s in ((m1, std), (0.5, 0.5))), key=lambda f: f[1])
                found.append(("normal", {"mean": t[0], "std": t[1]}, nll))
                if not r["edge"]:
                    l1, l2 = r["l1"] / r["s0"], r["l2"] / r["s0"]
                    t, nll = descend(lambda t: math.lgamma(t[0]) + math.lgamma(t[1]) - math.lgamma(t[0] + t[1]) - (t[0] - 1) * l1 - (t[1] - 1) * l2, (2, 2), [(0.1, 100), (0.1, 100)])
                    found.append(("beta", {"alpha": t[0], "beta": t[1]}, nll))
                if log:
                    norm = lambda q: q / 2 + q * q / 24 if abs(q) < 1e-5 else math.log(math.expm1(q) / q)
                    t, nll = descend(lambda t: norm(t[0]) - t[0] * m1, (0.0,), [(-50, 50)])
                    found.append(("power_law", {"rate": t[0]}, nll))
                x = np.array([(c["_c"] + 0.5) / CELLS for c in r["cells"]])
                share = np.array([c["_m"] for c in r["cells"]]) / r["s0"]
                starts = [tuple(own if v is None else v for v, own in zip(s, (None, m1, std, m1, std))) for s in STARTS]
                t, nll = min((_mixture(x, share, s) for s in starts), key=lambda f: f[1])
                found.append(("gaussian_mixture", dict(zip(("weight", "mean_a", "std_a", "mean_b", "std_b"), t)), nll))
                n = r["effective"]
                score, _, family, params = min(((2 * n * nll + len(p) * math.log(n), len(p), f, p) for f, p, nll in found), key=lambda c: c[:2])
                out.append((*base, "fitted", family, {k: float(v) for k, v in params.items()}, float(score), n, r["n"], r["outside"]))
            yield pd.DataFrame(out, columns=[*keys, "status", "family", "params", "score", "effective", "n", "outside"])

    return joined.mapInPandas(solve, f"{names}, status string, family string, params map<string,double>, score double, effective double, n long, outside long")


def unthinned(counts: DataFrame, keys: Sequence[str], sensitivity: Sequence[float], alpha: float = 20.0, rounds: int = 1500) -> DataFrame:
    """keys, mask, p: the distribution over sets of len(sensitivity) names from which counts (keys, mask, n) arose when each name was
    seen with its sensitivity only. Every cell is smoothed by alpha in every step. A segment has 2 ** names cells."""
    names = len(sensitivity)
    cells = np.arange(1 << names)
    missed = np.zeros((len(cells), len(cells)))
    for seen in cells:
        for true in cells:
            if seen & true == seen:
                missed[seen, true] = math.prod(1 - s for k, s in enumerate(sensitivity) if true >> k & 1 and not seen >> k & 1)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        observed = np.zeros(len(cells))
        np.add.at(observed, frame["mask"].to_numpy(), frame["n"].to_numpy(float))
        p = np.full(len(cells), 1 / len(cells))
        for _ in range(rounds):
            joint = missed * p
            total = joint.sum(axis=1)
            p = alpha + (joint * np.divide(observed, total, out=np.zeros_like(total), where=total > 0)[:, None]).sum(axis=0)
            p /= p.sum()
        head = {k: frame[k].iloc[0] for k in keys}
        return pd.DataFrame({**{k: [v] * len(cells) for k, v in head.items()}, "mask": cells, "p": p})

    schema = ", ".join([*(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys), "mask int", "p double"])
    return counts.groupBy(*keys).applyInPandas(solve, schema)


def thinned(joint: DataFrame, keys: Sequence[str], sensitivity: Sequence[float]) -> DataFrame:
    """keys, mask, p of what is seen of a joint (keys, mask, p)."""
    names = len(sensitivity)
    subsets = F.filter(F.sequence(F.lit(0), F.lit((1 << names) - 1)), lambda s: s.bitwiseAND(F.col("mask")) == s)
    rows = joint.select(*keys, "mask", "p", F.explode(subsets).alias("seen"))
    part = F.col("p")
    for k, s in enumerate(sensitivity):
        true, seen = F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("seen").bitwiseAND(F.lit(1 << k)) != 0
        part = part * F.when(true & seen, s).when(true, 1 - s).otherwise(1.0)
    return rows.groupBy(*keys, F.col("seen").alias("mask")).agg(F.sum(part).alias("p"))


def cardinality_residuals(counts: DataFrame, predicted: DataFrame, keys: Sequence[str], names: int) -> DataFrame:
    """keys, residuals (array of size, observed, predicted, residual), worst_size, worst_residual, worst_relative, direction,
    overstated: how the sizes of the sets seen (keys, mask, n) differ from those of what a thinned joint (keys, mask, p) predicts.

    The worst is the largest residual on either side, at ties the smaller size. More large or small sets than predicted means that
    independence understates them, and the joint overstates dense or sparse combinations; else nothing is overstated.
    """
    size = F.bit_count("mask").alias("size")
    seen = counts.groupBy(*keys, size).agg(F.sum("n").cast("double").alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("n").cast("double").alias("_all"))
    expected = predicted.groupBy(*keys, size).agg(F.sum("p").alias("predicted"))
    every = total.withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(names))))
    joined = every.join(seen, [*keys, "size"], "left").join(expected, [*keys, "size"], "left")
    observed = F.coalesce(F.try_divide("_n", "_all"), F.lit(0.0))
    rows = joined.select(*keys, "size", observed.alias("observed"), F.coalesce("predicted", F.lit(0.0)).alias("predicted")).withColumn("residual", F.col("observed") - F.col("predicted"))
    found = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("size", "observed", "predicted", "residual"))).alias("residuals"), F.max_by(F.struct("size", "predicted", "residual"), F.struct(F.abs("residual"), -F.col("size"))).alias("_w")
    )
    at, off = F.col("_w.size"), F.col("_w.residual")
    overstated = F.when((off > 0) & (at >= names - 1), "dense").when((off > 0) & (at <= 1), "sparse")
    relative = F.coalesce(F.when(F.col("_w.predicted") > 0, F.abs(off) / F.col("_w.predicted")), F.lit(0.0))
    return found.select(*keys, "residuals", at.alias("worst_size"), off.alias("worst_residual"), relative.alias("worst_relative"), F.when(overstated.isNotNull(), "understates").otherwise("overstates").alias("direction"), overstated.alias("overstated"))


def raked(joint: DataFrame, keys: Sequence[str], targets: Mapping[int, float], rounds: int = 500) -> DataFrame:
    """keys, mask, p: a joint moved to the target rates of its bits by proportional fitting; rates of 0 or 1 stay."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        mask, p = frame["mask"].to_numpy(), frame["p"].to_numpy(float) / frame["p"].sum()
        for _ in range(rounds):
            before = p
            for k, target in targets.items():
                on = (mask >> k & 1).astype(bool)
                rate = p[on].sum()
                if 0 < rate < 1:
                    p = np.where(on, p * target / rate, p * (1 - target) / (1 - rate))
                    p = p / p.sum()
            if np.abs(p - before).max() < 1e-15:
                break
        return frame[[*keys, "mask"]].assign(p=p)

    schema = ", ".join([*(f"{k} {joint.schema[k].dataType.simpleString()}" for k in keys), f"mask {joint.schema['mask'].dataType.simpleString()}", "p double"])
    return joint.groupBy(*keys).applyInPandas(solve, schema)
