"""Toxicity: a logistic classifier on the words of whole texts, regularised by counterfactuals.

A text's features are which words it holds, which of their beginnings, and which beginnings several of its words share,
hashed into FEATURES places; those are used that go with a label more than chance would. Besides the usual loss, training penalises the change of the score when the identity terms of a labelled sentence are swapped for others of
their kind ("women" for "men" or "people"): COUNTERFACTUAL * mean (z(sentence) - z(swapped))^2, with z the score before
the logistic function. A neutral mention of a group then weighs what any other group's mention or a neutral word weighs.
Terms that no labelled sentence has are swapped on their own, so that they weigh alike too.

The sample of labelled rows is bounded, and each row stands for its label's true share, so that a score is the
probability of label 1 at every size of labels. The ridge is chosen by folds of the sample. The weights, one per feature,
go to the executors, which score whole texts in one pass.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.labelled import fold, minimise, sample, sigmoid
from fleetspark.llm.shared import lean, small_batches, table

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Labelled texts to learn from.
SAMPLE_ROWS = 8000
FEATURES = 1 << 18
#: Lengths of the beginnings of words that are features too, and how many words that share one make another feature.
BEGINNINGS, SHARED = (3, 4, 5, 6, 7), 3
#: Texts of the sample that a feature must occur in, and the standard deviations by which its label must stray.
LEAST_TEXTS, LEAST_SIGMAS = 3, 2.5
#: Ridges to choose from, by so many folds, and the strength of the counterfactual penalty.
RIDGES, FOLDS, COUNTERFACTUAL = (1e-2, 2e-3, 4e-4, 8e-5, 1.6e-5), 2, 1.0
#: Sentences of a labelled text whose identity terms are swapped.
SENTENCES = 16
#: Words whose features a task remembers: speed only.
REMEMBERED = 100_000

# Identity terms by kind, the last of a line a neutral word; those of one line are swapped for each other.
IDENTITIES = [
    "women men girls boys people",
    "woman man girl boy person",
    "muslims christians jews hindus buddhists atheists people",
    "muslim christian jewish hindu buddhist atheist catholic human",
    "gay lesbian straight bisexual transgender human",
    "black white asian latino arab african european human",
    "immigrants refugees foreigners natives people",
    "disabled deaf blind elderly young human",
    "frauen männer mädchen jungen leute",
    "muslime christen juden atheisten leute",
    "ausländer flüchtlinge einwanderer leute",
    "femmes hommes filles garçons gens",
    "musulmans chrétiens juifs athées gens",
    "étrangers réfugiés immigrés gens",
    "mujeres hombres niñas niños gente",
    "musulmanes cristianos judíos ateos gente",
    "extranjeros refugiados inmigrantes gente",
]
_KIND = {w: line.split() for line in IDENTITIES for w in line.split()[:-1]}
WORD, SENTENCE_END = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped(words: set[str], seed: int) -> set[str] | None:
    """words with each identity term replaced by another of its kind; None without such terms."""
    terms = words & _KIND.keys()
    if not terms:
        return None
    other = {w: [x for x in _KIND[w] if x != w] for w in terms}
    return (words - terms) | {other[w][(seed + zlib.crc32(w.encode())) % len(other[w])] for w in terms}


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """The words of sentences with identity terms, SENTENCES at most, and the same with the terms swapped."""
    out = []
    for i, sentence in enumerate(SENTENCE_END.split(text)):
        words = words_of(sentence)
        if (other := swapped(words, i)) is not None:
            out.append((words, other))
            if len(out) == SENTENCES:
                break
    return out


def features(words, memory: dict[str, tuple] | None = None) -> np.ndarray:
    """The sorted feature places of a set of words."""
    memory = {} if memory is None else memory
    out: set[int] = set()
    begun: dict[int, int] = {}
    for w in words:
        own = memory.get(w)
        if own is None:
            places = [zlib.crc32(x.encode()) for x in (f"={w}", *(f"{w[:n]}*" for n in BEGINNINGS if len(w) > n))]
            own = memory[w] = places[0] % FEATURES, tuple(x % FEATURES for x in places[1:])
        out.add(own[0])
        for x in own[1]:
            begun[x] = begun.get(x, 0) + 1
    out.update(begun)
    out.update([(x * 31 + 7) % FEATURES for x, n in begun.items() if n >= SHARED])
    return np.fromiter(sorted(out), np.int64, len(out))


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.at = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.columns = np.concatenate([np.empty(0, np.int64), *rows])

    def times(self, w):
        return np.bincount(self.at, w[self.columns], self.n)

    def transposed_times(self, v, width: int):
        return np.bincount(self.columns, v[self.at], width)


def train(rows: list[tuple[np.ndarray, int, float]], pairs: list[tuple[np.ndarray, np.ndarray]], ridge: float, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights: one per feature, then the intercept. rows: features, label and weight; pairs: features of a sentence and of its swapped copy."""
    w = np.zeros(FEATURES + 1)
    y, weight = np.array([label for _, label, _ in rows], float), np.array([x for *_, x in rows], float)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        w[-1] = -4.0 if not len(y) or not y[0] else 4.0
        return w
    weight /= weight.sum()
    seen = np.bincount(np.concatenate([f for f, *_ in rows]), minlength=FEATURES)
    toxic = np.bincount(np.concatenate([np.empty(0, np.int64), *(f for f, label, _ in rows if label)]), minlength=FEATURES)
    share = y.mean()
    strays = np.abs(toxic - seen * share) >= LEAST_SIGMAS * np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    use = np.flatnonzero((seen >= min(LEAST_TEXTS, max(1, len(rows) // 50))) & strays)
    place = np.full(FEATURES, -1)
    place[use] = np.arange(len(use))
    local = lambda f: place[f][place[f] >= 0]
    x, a, b = _Rows([local(f) for f, *_ in rows]), _Rows([local(p) for p, _ in pairs]), _Rows([local(q) for _, q in pairs])

    def loss(v):
        z = x.times(v[:-1]) + v[-1]
        p = sigmoid(z)
        value = float(weight @ (np.logaddexp(0, z) - y * z)) + ridge * float(v[:-1] @ v[:-1]) / 2
        r = weight * (p - y)
        g = np.append(x.transposed_times(r, len(use)) + ridge * v[:-1], r.sum())
        if pairs:
            d = a.times(v[:-1]) - b.times(v[:-1])
            value += counterfactual * float(np.mean(d * d))
            g[:-1] += (a.transposed_times(d, len(use)) - b.transposed_times(d, len(use))) * (2 * counterfactual / len(pairs))
        return value, g

    rate = float(weight @ y)
    v = minimise(loss, np.append(np.zeros(len(use)), np.log(rate / (1 - rate))))
    w[use], w[-1] = v[:-1], v[-1]
    return w


def chosen_ridge(rows: list[tuple[np.ndarray, int, float]], pairs: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Of RIDGES the one with the least weighted loss on folds of the sample that it wasn't trained on."""
    parts = [[r for r in rows if zlib.crc32(r[0].tobytes()) % FOLDS == k] for k in range(FOLDS)]
    if any(len({y for _, y, _ in p}) < 2 for p in parts):
        return RIDGES[1]
    losses = []
    for ridge in RIDGES:
        total = 0.0
        for k in range(FOLDS):
            w = train([r for i, p in enumerate(parts) for r in p if i != k], pairs, ridge)
            for f, y, weight in parts[k]:
                z = float(w[f].sum() + w[-1])
                total += weight * (np.logaddexp(0, z) - y * z)
        losses.append(total)
    return RIDGES[int(np.argmin(losses))]


def term_pairs() -> list[tuple[np.ndarray, np.ndarray]]:
    """Every two terms of a kind, each as a text of its own, so that terms that no labelled sentence has weigh alike too."""
    return [(features({w}), features({x})) for line in IDENTITIES for w in line.split() for x in line.split() if w < x]


def _feature_rows(batches):
    """y, features, and those of sentences with identity terms and of their swapped copies, as 32-bit integers: the driver holds them all."""
    memory: dict[str, tuple[int, ...]] = {}
    packed = lambda words: features(words, memory).astype("<i4").tobytes()
    for batch in small_batches(batches):
        text, y = (batch.column(c).to_pylist() for c in ("text", "y"))
        if len(memory) > REMEMBERED:
            memory.clear()
        swaps = [counterfactuals(t) for t in text]
        columns = [pa.array(y, pa.int32()), pa.array([packed(words_of(t)) for t in text], pa.binary())]
        columns += [pa.array([[packed(pair[k]) for pair in own] for own in swaps], pa.list_(pa.binary())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["y", "features", "sentences", "others"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents outside the held-out fold; without labels, a low constant score."""
    picked, stands_for = sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows)
    found = lean(picked, _feature_rows, "y int, features binary, sentences array<binary>, others array<binary>").collect()
    found.sort(key=lambda r: (r["y"], r["features"]))
    unpacked = lambda x: np.frombuffer(x, "<i4")
    learnt = [(unpacked(r["features"]), r["y"], stands_for[r["y"]]) for r in found]
    pairs = [(unpacked(p), unpacked(q)) for r in found for p, q in zip(r["sentences"], r["others"], strict=True)] + term_pairs()
    return train(learnt, pairs, chosen_ridge(learnt, pairs), counterfactual)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted: a row per row of docs.

    A null text counts as empty and gets the intercept's score. Rows that repeat are scored each, a null doc_id stays
    null, an empty table gives an empty result; other columns than doc_id and text are not read.
    """
    used = np.flatnonzero(weights[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used].astype(np.float32), float(weights[-1])))  # FEATURES weights at most

    def run(batches):
        places, values, intercept = sent.value
        w = np.zeros(FEATURES, np.float32)
        w[places] = values
        memory: dict[str, tuple[int, ...]] = {}
        for batch in small_batches(batches):
            if len(memory) > REMEMBERED:
                memory.clear()
            z = [float(w[features(words_of(t or ""), memory)].sum(dtype=np.float64)) + intercept for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(np.array(z)))], ["doc_id", "score"])

    out = lean(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES, ORACLES = {"op2_toxicity": op2_toxicity}, {}
