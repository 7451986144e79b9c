"""Quality: a compression classifier.

Two Zstandard dictionaries hold labelled text, one good and one bad. A text is cut into blocks, and every block is
compressed with either dictionary: whichever knows the text's kind needs fewer bytes. The difference of the two sums,
divided by the text's length, is the score's only input: a logistic curve of it is fitted to labelled texts that the
dictionaries haven't seen, each label weighted to its true rate, and an isotonic curve corrects what the logistic one
misses, so that the score is the share of good texts among those with such a difference.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.labelled import fold, isotonic, minimise, sample, sigmoid
from fleetspark.llm.shared import lean, small_batches, table

MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.5
#: Labelled texts: half make the dictionaries, half calibrate.
SAMPLE_ROWS = 8000
#: Bytes of a block and of a dictionary; a text gives a dictionary at most SHARES times its even share.
BLOCK_BYTES, DICTIONARY_BYTES, SHARES = 1024, 1 << 20, 4
LEVEL, RIDGE = 9, 1e-4
#: Texts that the logistic curve counts for beside an isotonic step's own.
PRIOR = 2.0

#: Of a model: the dictionaries, good and bad, and the knots of the curve: differences and scores.
Model = tuple[bytes, bytes, list[float], list[float]]


def share_of(text: bytes, most: int) -> bytes:
    """A stretch of at most that many bytes of a text, from anywhere in it, as a hash of the text names."""
    at = zlib.crc32(text) % max(1, len(text) - most + 1)
    return text[at : at + most]


def dictionary(parts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Plain dictionary content of at most that size: of every part the same number of bytes, as far as it has them."""
    parts = [p for p in parts if p]
    room, share, left = size - len(parts), 0, sorted(map(len, parts))
    while left:  # the largest share that fits: short parts leave their room to the others
        share = max(1, room // len(left))
        short = [n for n in left if n <= share]
        if not short:
            break
        room -= sum(short)
        left = left[len(short) :]
        share = max(share, short[-1])
    return b"\n".join(p[:share] for p in parts)[:size]


class Measure:
    """A text's normalised compressed-size difference: bytes under bad less bytes under good, per byte of text."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.packers = []
        for d in (good, bad):
            own = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False))

    def __call__(self, text: bytes) -> float:
        sizes = [0, 0]
        for at in range(0, len(text), BLOCK_BYTES):
            block = text[at : at + BLOCK_BYTES]
            for k in (0, 1):
                sizes[k] += len(self.packers[k].compress(block))
        return (sizes[1] - sizes[0]) / max(1, len(text))


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of a rising curve from differences to scores."""
    mean, spread = float(x.mean()), float(x.std()) + 1e-9
    z, weight = (x - mean) / spread, weight / weight.sum()

    def loss(w):
        t = w[0] * z + w[1]
        g = weight * (sigmoid(t) - y)
        return float(weight @ (np.logaddexp(0, t) - y * t)) + RIDGE * float(w[0] ** 2) / 2, np.array([z @ g + RIDGE * w[0], g.sum()])

    slope, intercept = minimise(loss, np.zeros(2))
    plain = lambda at: sigmoid(max(slope, 1e-3) * (at - mean) / spread + intercept)
    at, rate, size = isotonic(x, y, weight * len(x))
    # an isotonic step of few texts leans on the logistic curve, which has the weight of PRIOR texts
    score = np.maximum.accumulate((rate * size + plain(at) * PRIOR) / (size + PRIOR))
    reach = np.array([x.min() - 4 * spread, *at, x.max() + 4 * spread])
    return reach.tolist(), [float(min(plain(reach[0]), score[0])), *score.tolist(), float(max(plain(reach[-1]), score[-1]))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model from at most ``rows`` labelled texts, all of them whole. With labels of one kind or none, a constant score.

    Executors cut the dictionaries' shares and measure the texts; the driver gets a bounded stretch of each text of one
    half and a number for each text of the other.
    """
    found, stands_for = sample(docs, labels, "quality", MODULUS, HELD_OUT, rows)
    found = found.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    counts = {(r["y"], r["half"]): r["count"] for r in found.groupBy("y", "half").count().collect()}  # four rows
    if len({y for y, _ in counts}) < 2 or any((y, 0) not in counts for y in (0, 1)):
        one = [y for y, _ in counts]
        return b"", b"", [0.0], [(0.88 if one and min(one) else 0.12) if one else 0.5]

    def shares(batches):
        for batch in small_batches(batches):
            y = batch.column("y").to_pylist()
            own = [share_of(t.encode(), SHARES * (DICTIONARY_BYTES // counts[k, 0] + 1)) for t, k in zip(batch.column("text").to_pylist(), y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(own, pa.binary())], ["y", "share"])

    parts = sorted((r["y"], zlib.crc32(r["share"]), bytes(r["share"])) for r in lean(found.where("half = 0"), shares, "y int, share binary").collect())
    bad, good = (dictionary([p for k, _, p in parts if k == y]) for y in (0, 1))

    def measured(batches):
        measure = Measure(good, bad)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array([measure(t.encode()) for t in batch.column("text").to_pylist()], pa.float64())], ["y", "x"])

    check = found.where("half = 1") if all((y, 1) in counts for y in (0, 1)) else found  # a handful of labels
    points = sorted((r["x"], r["y"]) for r in lean(check, measured, "y int, x double").collect())
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    return good, bad, *curve(x, y, np.where(y > 0, stands_for[1], stands_for[0]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher: better text), predicted, and the normalised compressed-size difference: a row per row of docs.

    Whole texts are compressed; a null text counts as empty, and an empty one has no difference. Rows that repeat are
    scored each, a null doc_id stays null, an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES, two numbers a calibrating text at most

    def run(batches):
        good, bad, at, rate = sent.value
        measure = Measure(good, bad) if good else lambda t: 0.0
        for batch in small_batches(batches):
            x = np.array([measure(t.encode() if t else b"") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(x, at, rate)), pa.array(x)], ["doc_id", "score", "difference"])

    out = lean(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, difference double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES, ORACLES = {"op7_quality": op7_quality}, {}
