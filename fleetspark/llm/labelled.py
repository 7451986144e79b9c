"""Bounded samples of labelled documents, and a logistic regression, for the classifiers of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.shared import hash_sample, written


def fold(modulus: int) -> Column:
    """The remainder that says whether a row is held out; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold, half of each label as far as
    there are; and how many labelled documents each sampled one stands for, by label, so that weighted losses see the
    labels' true rate at every size.

    Rows are taken in the order of a hash of doc_id. A doc_id with several labels counts with the largest, one with
    several texts with the one of the least hash; null labels and ids are left out, a null text counts as empty.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(modulus) != held_out)).groupBy("doc_id").agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("y"))
    true = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit(label))
    most = {1: rows // 2, 0: rows - rows // 2}
    picked = hash_sample(known.where("y = 1"), order, most[1]).unionByName(hash_sample(known.where("y = 0"), order, most[0]))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # at most ``rows`` rows, whatever the size of labels
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return written(found, f"labelled-{label}").select("doc_id", "text", "y"), {y: n / min(n, most[y]) for y, n in true.items()}


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def minimise(f, x: np.ndarray, steps: int = 200, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f returns the value and the gradient."""
    value, g = f(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            alphas.append(s @ q / (y @ s))
            q -= alphas[-1] * y
        if s_list:
            q *= s_list[-1] @ y_list[-1] / (y_list[-1] @ y_list[-1])
        for s, y, a in zip(s_list, y_list, reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        slope = -(g @ q)
        if slope >= -1e-12:
            break
        step = 1.0 if s_list else 1 / max(1.0, float(np.linalg.norm(g)))
        while True:
            new = x - step * q
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new - x, new_g - g
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, g = new, new_value, new_g
        if y @ s > 1e-12:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        if done:
            break
    return x


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps of the best rising fit to y: the weighted mean of x, that of y, and the weight of each. x is sorted."""
    steps: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        steps.append([a * w, b * w, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last, strict=True)]
    a, b, w = np.array(steps).T
    return a / w, b / w, w
