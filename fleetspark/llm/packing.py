"""Packing: concatenate all documents' tokens into one stream and cut it into fixed windows.

Method: *concatenate and cut* in two passes without a shuffle of tokens.

1. Every input partition tokenizes its rows once and writes (partition, place in the partition's token stream, ids).
   The table in the shared folder fixes the order, so that a task that runs again in pass 2 sees the same stream.
2. The partitions' token totals (a row each) are prefix-summed by a window function; base + place is a document's place
   in the global stream, and each document is cut where it crosses a multiple of the window: those pieces are the boundary
   records. Only the last sequence of all can be shorter than the window.
"""

from __future__ import annotations

import functools
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetspark.llm.shared import broadcast_if_small, lean, small_batches, table, written

SEQUENCE_LENGTH, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Words whose ids a task remembers, and pieces of words whose ids a worker remembers; beyond that the older half stays. Speed only.
REMEMBERED = 300_000
#: Input partitions whose places in the stream are broadcast, 12 bytes each.
BROADCAST_PARTS = 1_000_000

#: Characters whose lower-casing, normalisation and class are beyond doubt in every Unicode version; words with others go through the whole tokenizer.
PLAIN = re.compile("[\\x21-\\x7e\\u00a1-\\u012f\\u0131-\\u017f]*")

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids", T.BinaryType(), False),
        T.StructField("doc_tokens", T.LongType(), False),
        T.StructField("sequence_id", T.LongType(), False),
        T.StructField("offset", T.LongType(), False),
    ]
)


class Memory(dict):
    """What ``make`` gives for a key, made when the key is first looked up."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Encoder:
    """A text's ids as little-endian 16- or 32-bit integers, equal to those of the tokenizer file.

    The tokenizer drops white space and splits lower-cased text by the pattern in its own file before it merges, so
    that the ids of a word between white space don't depend on its neighbours: words are tokenized once and remembered.
    A file of another kind gets whole texts.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        spec = json.loads(open(path, encoding="utf-8").read())
        splits = [x["pattern"]["Regex"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split" and x.get("invert") and x["behavior"] == "Removed"]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.split = regex.compile(splits[0]) if len(splits) == 1 and kinds == ["NFC", "Replace", "Lowercase"] else None
        self.level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = Memory(lambda c: "".join(p for p, _ in self.level.pre_tokenize_str(chr(c))))
        self.words: dict[bytes, bytes] = Memory(self.word)
        self.pieces: dict[str, bytes] = Memory(self.piece)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: bytes) -> bytes:
        if not self.split:
            return self.whole(text.decode())
        ids = b"".join(map(self.words.__getitem__, text.split()))
        for memory in (self.words, self.pieces):
            if len(memory) > REMEMBERED:
                for _ in range(len(memory) - REMEMBERED // 2):
                    memory.popitem()  # the newest; frequent ones came early
        return ids

    def word(self, spelt: bytes) -> bytes:
        word, pieces = spelt.decode(), self.pieces
        if not (word.isprintable() if word.isascii() else PLAIN.fullmatch(word)):
            return self.whole(word)
        word = word.lower()
        if word.isalpha():
            return pieces[word]
        if word[:-1].isalpha():  # most others: a word and a mark
            return pieces[word[:-1]] + pieces[word[-1]]
        return b"".join([pieces[x] for x in self.split.findall(word)])

    def piece(self, piece: str) -> bytes:
        """Of a piece as the tokenizer's byte level spells it: the visible ASCII characters are themselves."""
        spelt = piece if piece.isascii() else piece.translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One a Python worker, which Spark uses for task after task; tasks forget whole words when they end."""
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(part, place, doc_id, tokens, ids): ids end with end_id; place counts the tokens before in the partition."""

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, place, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        end = array(encode.code, [end_id]).tobytes()
        for batch in small_batches(batches):
            ids = [encode(text or b"") + end for text in batch.column(1).to_pylist()]
            n = np.array([len(x) // len(end) for x in ids], np.int64)
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(places), batch.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "place", "doc_id", "tokens", "ids"])
        encode.words.clear()

    return lean(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")), run, "part int, place long, doc_id long, tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = SEQUENCE_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    Every row of docs is one document, also rows that repeat or have a null doc_id; a null or empty text is the end id
    alone. An empty table has no pieces. Columns besides doc_id and text are not read.
    """
    parts = written(tokenized(docs, tokenizer_path, end_id), "packing-ids")
    totals = parts.groupBy("part").agg(F.sum("tokens").alias("total"))  # one row per input partition
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = written(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "packing-bases")
    placed = parts.join(broadcast_if_small(base, BROADCAST_PARTS), "part")

    def cut(batches):
        import numpy as np

        for batch in small_batches(batches):
            at, n = (batch.column(i).to_numpy() for i in (1, 2))
            ids = batch.column(3)
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            data = np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            wide = data.view("<u2" if len(data) == 2 * n.sum() else "<u4").astype("<u4")
            first = at // sequence_length
            count = (at + n - 1) // sequence_length - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
            start = np.maximum(at[row], sequence * sequence_length)
            length = np.minimum((at + n)[row], (sequence + 1) * sequence_length) - start
            # a document's pieces follow one another, and so do the documents' ids
            cuts = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(wide)])
            numbers = (start - at[row], length, n[row], sequence, start - sequence * sequence_length)
            start, length, tokens, sequence, offset = (pa.array(x) for x in numbers)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), start, length, pieces, tokens, sequence, offset], PIECES.names)

    return lean(placed.select("doc_id", (F.col("base") + F.col("place")).alias("at"), "tokens", "ids"), cut, PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES, ORACLES = {"op10_packing": op10_packing}, {}
