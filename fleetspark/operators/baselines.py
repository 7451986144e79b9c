"""Scorers to compare the detector with: chance, z-score, reconstruction error, isolation forest."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetspark.functions.draws import uniform
from fleetspark.operators.detect import UNITS, ingest, pivoted
from fleetspark.operators.evaluate import stratified_sample

#: Trees of a forest and rows that each is grown from.
TREES, TREE_ROWS = 50, 256


def random_scores(df: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    return df.withColumn("score", uniform(seed, "random", *keys))


def zscores(df: DataFrame, value: str = "TmpRet", by: tuple[str, ...] = ("container_id", "unit"), threshold: float = 3.0) -> DataFrame:
    """df with score (distance from the group's mean in standard deviations) and flagged; a constant group scores null and isn't flagged."""
    own = Window.partitionBy(*by)
    score = F.try_divide(F.abs(F.col(value) - F.avg(value).over(own)), F.stddev(value).over(own))
    return df.withColumn("score", score).withColumn("flagged", F.coalesce(F.col("score") > threshold, F.lit(False)))


def temperature_matrix(df: DataFrame, units=UNITS) -> DataFrame:
    """container_id, timestamp_et, u<unit>: times at which all units have a reading."""
    return pivoted(ingest(df), "TmpRet", units).dropna(subset=[f"u{u}" for u in units])


def pca_errors(df: DataFrame, components: int = 1, units=UNITS) -> DataFrame:
    """container_id, timestamp_et, score: the squared distance of a time's temperatures from the first principal components of all."""
    from pyspark.ml.feature import PCA, VectorAssembler

    names = [f"u{u}" for u in units]
    m = temperature_matrix(df, units)
    means = m.agg(*(F.avg(c).alias(c) for c in names)).first()
    if means[names[0]] is None:
        return m.select("container_id", "timestamp_et", F.lit(None).cast("double").alias("score"))
    pc = PCA(k=components, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=names, outputCol="v").transform(m)).pc.toArray()
    centred = [F.col(c) - F.lit(float(means[c])) for c in names]
    error = sum((x * x for x in centred), F.lit(0.0))
    for k in range(components):
        along = sum((x * F.lit(float(w)) for x, w in zip(centred, pc[:, k], strict=True)), F.lit(0.0))
        error = error - along * along
    return m.select("container_id", "timestamp_et", F.greatest(error, F.lit(0.0)).alias("score"))


def _path_length(n):
    """The mean depth of an unsuccessful search in a tree of n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _depths(x: np.ndarray, sample: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """The depth at which each row of x ends in a random tree grown from sample."""
    out = np.zeros(len(x))
    stack = [(np.arange(len(x)), sample, 0)]
    while stack:
        rows, own, depth = stack.pop()
        low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        wide = np.flatnonzero(high > low)
        if depth >= most or len(own) <= 1 or not len(wide):
            out[rows] = depth + _path_length(len(own))
            continue
        f = rng.choice(wide)
        cut = rng.uniform(low[f], high[f])
        left = x[rows, f] < cut
        stack += [(rows[left], own[own[:, f] < cut], depth + 1), (rows[~left], own[own[:, f] >= cut], depth + 1)]
    return out


def isolation_scores(x: np.ndarray, seed: int, trees: int = TREES, rows: int = TREE_ROWS, pool: np.ndarray | None = None) -> np.ndarray:
    """2 ** (-mean depth / expected depth) of each row; near 1 for rows that few cuts isolate. Trees grow from the pool, the rows themselves unless given; the same pool and seed give the same trees."""
    pool = x if pool is None else pool
    if len(pool) < 2:
        return np.full(len(x), 0.5)
    rng, size = np.random.default_rng(seed), min(rows, len(pool))
    most = int(np.ceil(np.log2(size)))
    total = sum(_depths(x, pool[rng.choice(len(pool), size, replace=False)], rng, most) for _ in range(trees))
    return 2.0 ** (-(total / trees) / _path_length(size))


#: Times of a container that its trees are drawn from, and tasks that one container's scoring is spread over.
POOL, SPREAD = 4096, 8


def isolation_forest(df: DataFrame, units=UNITS, trees: int = TREES, seed: int = 42) -> DataFrame:
    """container_id, timestamp_et, score: a forest per container over its temperatures, grown with a seed of its own.

    Trees are drawn from a container's pool, POOL of its times in the order of a hash; scoring streams all its times past
    that pool, in several tasks. Without a container_id there is no score.
    """
    names = [f"u{u}" for u in units]
    matrix = temperature_matrix(df, units).where("container_id IS NOT NULL").select("container_id", "timestamp_et", *names)
    picked = stratified_sample(matrix, ("container_id",), POOL, ("container_id", "timestamp_et"), seed)
    pools = picked.groupBy("container_id").agg(F.sort_array(F.collect_list(F.struct("timestamp_et", F.array(*names).alias("x")))).alias("p")).select("container_id", F.transform("p", lambda r: r["x"]).alias("pool"))
    empty = [F.lit(None).cast("double").alias(u) for u in names]
    first = pools.select("container_id", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("timestamp_et"), *empty, "pool")
    rest = matrix.select("container_id", F.pmod(F.xxhash64("timestamp_et"), F.lit(SPREAD)).cast("int").alias("salt"), F.lit(1).alias("kind"), "timestamp_et", *names, F.lit(None).cast("array<array<double>>").alias("pool"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(rest).repartition(n, "container_id", "salt").sortWithinPartitions("container_id", "salt", "kind")

    def score(batches):
        pool, of = None, None
        for pdf in batches:
            for container, own in pdf.groupby("container_id", sort=False):
                if (head := own[own["kind"] == 0]).size:
                    pool, of = np.array([list(r) for r in head["pool"].iloc[0]], float), container
                own = own[own["kind"] == 1]
                if len(own) and of == container:
                    scores = isolation_scores(own[names].to_numpy(float), zlib.crc32(f"{seed}-{container}".encode()), trees, pool=pool)
                    yield own[["container_id", "timestamp_et"]].assign(score=scores)

    return dealt.mapInPandas(score, "container_id long, timestamp_et timestamp_ntz, score double")
