"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts somewhere else are removed.

A suffix array over all positions of a large corpus isn't sorted here; a sparse one is, which gives the same answer:

1. Every string of LENGTH bytes names its anchor, the GRAM bytes in it with the least hash (leftmost of equals), which
   depends on the string alone. Equal strings have equal anchors at the same distance, so a string can only repeat if
   its anchor does. Strings of a text with one anchor are a run, and a run is one row: about one in a hundred bytes.
2. Anchors that occur once leave. Of the rest, runs with equal bytes are a class; the strings of a class of two or more
   all repeat.
3. Where an anchor has several classes, the suffixes at it are sorted, and so are the texts before it read backwards.
   The sort is a mergesort that compares two suffixes by the length of their common extension: a binary search over
   prefix polynomial hashes, and then the first byte that differs. Common extensions of neighbours are verified byte by
   byte; if hashes ever collide, the bytes are sorted instead. A string that begins o bytes before the anchor repeats if
   another has a common extension of o bytes to the left and LENGTH - o to the right: groups in the two sorted orders.
   Anchors with more than GROUP classes compare digests of their strings instead, spread over all tasks.
4. The strings that repeat are merged to spans, and cut out.

Hashes of anchors only choose candidates. A class agrees in two independent 64-bit hashes and its length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.shared import lean, small_batches, table, written

LENGTH = 400
#: Strings that start in a slice of a text are handled at a time.
SLICE = 1 << 17
#: Classes of an anchor that are compared in one task; anchors with more compare digests.
GROUP = 4096
#: Segments that are sorted together; whole anchors.
BATCH = 4096
#: Texts whose keys are broadcast to select them, 16 bytes each.
BROADCAST_KEYS = 1_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_FIRST_32 = _U(0xFFFFFFFF00000000)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the 0..n modulo 2^64, and the inverses."""
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks from both ends."""
    n = len(x)
    y = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, width)
    ahead, back = np.minimum.accumulate(y, 1).ravel(), np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor's hash, the run's hash, first and last start, the anchor's place) of every run of strings with one anchor."""
    import xxhash

    gram, out = length // 2, []
    for begin in range(0, len(text) - length + 1, SLICE):
        part = text[begin : begin + SLICE + length - 1]
        n = len(part)
        powers, inverses = _powers(SLICE + length)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(part, np.uint8).astype(np.uint64) + _U(1)) * powers[:n], out=h[1:])
        g = _mixed((h[gram:] - h[:-gram]) * inverses[: n - gram + 1])
        at = _sliding_least((g & _FIRST_32) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & ~_FIRST_32
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        place = at[first].astype(np.int64)
        anchors = g[place].view(np.int64).tolist()
        for a, lo, hi, p in zip(anchors, first.tolist(), last.tolist(), place.tolist(), strict=True):
            own = xxhash.xxh3_64_intdigest(part[lo : hi + length])
            out.append((a, own - (1 << 64) if own >> 63 else own, begin + lo, begin + hi, begin + p))
    return out


def _merge_sorted(group: np.ndarray, prefix: np.ndarray, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and then by bytes, and each row's common extension with the row before in that order (-1: another group).

    prefix holds the rows' prefix polynomial hashes, data the bytes plus one (0 past the end), size the lengths. A
    mergesort from below, all merges of a level at once: a row's place is its rank in its own run plus that in its
    sibling, found by binary search; each comparison is a binary search for the common extension.
    """
    n, longest = len(group), prefix.shape[1] - 1

    def extension(x, y):
        most, l = np.minimum(size[x], size[y]), np.zeros(len(x), np.int64)
        step = 1 << max(0, longest.bit_length() - 1)
        while step:
            ahead = l + step
            ok = ahead <= most
            ok &= prefix[x, np.minimum(ahead, longest)] == prefix[y, np.minimum(ahead, longest)]
            l = np.where(ok, ahead, l)
            step >>= 1
        return l

    def less(x, y, ties):
        """Whether x comes before y; for equal rows, ties."""
        l = extension(x, y)
        a, b = data[x, l].astype(np.int16), data[y, l].astype(np.int16)
        return np.where(group[x] != group[y], group[x] < group[y], np.where(a != b, a < b, ties))

    order, width = np.arange(n), 1
    while width < n:
        index = np.arange(n)
        run = index // width
        other = run ^ 1
        lo, hi = np.minimum(other * width, n), np.minimum((other + 1) * width, n)
        start = lo.copy()
        left = run % 2 == 0  # of equal rows, those of the left run come first
        busy = lo < hi
        while busy.any():
            at = np.flatnonzero(busy)
            mid = (lo[at] + hi[at]) // 2
            before = less(order[mid], order[at], ~left[at])
            lo[at] = np.where(before, mid + 1, lo[at])
            hi[at] = np.where(before, hi[at], mid)
            busy = lo < hi
        place = np.minimum(run * width, other * width) + (index - run * width) + (lo - start)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    common = np.full(n, -1, np.int64)
    if n > 1:
        x, y = order[:-1], order[1:]
        common[1:] = np.where(group[x] == group[y], extension(x, y), -1)
        # collision verification: the bytes of the extension agree, and no more do
        differ = data[x] != data[y]
        true = np.where(differ.any(1), differ.argmax(1), np.minimum(size[x], size[y]))
        true = np.minimum(true, np.minimum(size[x], size[y]))
        wrong = (group[x] == group[y]) & (common[1:] != true)
        if wrong.any():
            order = np.array(sorted(range(n), key=lambda i: (group[i], data[i, : size[i]].tobytes())))
            x, y = order[:-1], order[1:]
            differ = data[x] != data[y]
            true = np.where(differ.any(1), differ.argmax(1), data.shape[1])
            common[1:] = np.where(group[x] == group[y], np.minimum(true, np.minimum(size[x], size[y])), -1)
    return order, common


def _rows_of(parts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, bytes plus one and sizes of byte strings, cut at most."""
    size = np.array([min(len(p), most) for p in parts], np.int64)
    data = np.zeros((len(parts), most + 1), np.uint16)
    for i, p in enumerate(parts):
        data[i, : size[i]] = np.frombuffer(p, np.uint8, size[i])
        data[i, : size[i]] += 1
    prefix = np.zeros((len(parts), most + 1), np.uint64)
    np.cumsum(data[:, :most] * _powers(SLICE + LENGTH)[0][:most], axis=1, out=prefix[:, 1:])
    return prefix, data, size


def repeats(group: list[int], segments: list[bytes], anchor: list[int], least: list[int], length: int) -> list[np.ndarray]:
    """For each segment the starts of its strings, as offsets in it, that occur in another segment of its group at the same anchor.

    anchor: the anchor's offset; its strings start 0..len(segment) - length; least: the start nearest the anchor, as its
    distance to it.
    """
    n = len(segments)
    g, a, nearest = np.array(group), np.array(anchor), np.array(least)
    gram = length // 2
    left_order, left_common = _merge_sorted(g, *_rows_of([s[:x][::-1] for s, x in zip(segments, anchor, strict=True)], length - gram))
    right_order, right_common = _merge_sorted(g, *_rows_of([s[x:] for s, x in zip(segments, anchor, strict=True)], length))
    found: list[list[int]] = [[] for _ in range(n)]
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(length - gram + 1):
        use = np.flatnonzero((nearest <= o) & (o <= a))
        if len(use) < 2:
            continue
        left[left_order] = np.cumsum(left_common < o)
        right[right_order] = np.cumsum(right_common < length - o)
        both = left[use] * (n + 1) + right[use]
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        for i in use[count[which] > 1].tolist():
            found[i].append(int(a[i]) - o)
    return [np.array(sorted(x), np.int64) for x in found]


def _stretches(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that strings at these sorted starts cover, as (start, end)."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
    end = np.append(new[1:], len(starts)) - 1
    return [(int(starts[i]), int(starts[j]) + length) for i, j in zip(new, end, strict=True)]


def _keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2")]


def _selected(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return docs.join(F.broadcast(keys), ["k1", "k2"], how)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, start, end): stretches of bytes of texts, by the keys of their rows, that repeated strings cover; they may overlap."""
    text = docs.select(F.col("text").cast("binary").alias("text"), "k1", "k2")

    def anchored(batches):
        for batch in small_batches(batches):
            columns: list[list] = [[] for _ in range(7)]
            for t, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True):
                own = runs(t, length)
                for column, values in zip(columns, zip(*own, strict=True) if own else [()] * 5, strict=False):
                    column.extend(values)
                columns[5].extend([k1] * len(own))
                columns[6].extend([k2] * len(own))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "own", "lo", "hi", "place", "k1", "k2"])

    all_runs = written(lean(text.where(F.octet_length("text") >= length), anchored, "anchor long, own long, lo int, hi int, place int, k1 long, k2 long"), "suffix-runs")
    # a table, so that both sides of the join are plain exchanges, whose skewed partitions Spark can split
    twice = written(all_runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-twice")
    found = written(all_runs.join(twice, "anchor"), "suffix-candidates")  # an anchor that many texts share is a skewed key, which Spark splits at run time
    span, shift = F.col("hi") - F.col("lo"), F.col("place") - F.col("lo")
    classes = found.groupBy("anchor", "own", span.alias("span"), shift.alias("shift")).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo")).alias("one"))
    classes = written(classes, "suffix-classes")
    # a class of one names its run; all others are taken by leaving these out, so that a class with many copies is no hot key
    alone = classes.where("n = 1").select("one.k1", "one.k2", "one.lo")
    whole = found.join(alone, ["k1", "k2", "lo"], "left_anti").select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("fewest")).where("classes > 1 AND fewest = 1").select("anchor", "classes")
    wanted = classes.join(mixed, "anchor").select("one.k1", "one.k2", F.struct("anchor", "classes", "n", F.col("one.lo").alias("lo"), "span", "shift").alias("segment"))
    wanted = written(wanted.groupBy("k1", "k2").agg(F.collect_list("segment").alias("segments")), "suffix-wanted")  # a text's own segments
    keys = wanted.select("k1", "k2")
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        text = _selected(text, keys, "left_semi")
    # rows that repeat have no segments here, as their runs are classes of two; a text is met once
    holders = text.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "segments")

    def cut(batches):
        for batch in small_batches(batches):
            out = []
            for k1, k2, t, segments in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "segments")), strict=True):
                for s in segments:
                    out.append((s["anchor"], s["classes"], s["n"], s["lo"], s["span"], s["shift"], k1, k2, t[s["lo"] : s["lo"] + s["span"] + length]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "classes", "n", "lo", "span", "shift", "k1", "k2", "bytes"])

    segments = written(lean(holders, cut, "anchor long, classes long, n long, lo int, span int, shift int, k1 long, k2 long, bytes binary"), "suffix-segments")

    def sorted_groups(batches):
        rows: list[tuple] = []

        def done(rows):
            found = repeats([r[0] for r in rows], [r[6] for r in rows], [r[3] for r in rows], [r[3] - r[2] for r in rows], length)
            out = [(r[4], r[5], r[1] + start, r[1] + end) for r, starts in zip(rows, found, strict=True) if r[7] == 1 for start, end in _stretches(starts, length)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k1", "k2", "start", "end"])

        for batch in small_batches(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "lo", "span", "shift", "k1", "k2", "bytes", "n")), strict=True):
                if len(rows) >= BATCH and rows[-1][0] != row[0]:
                    yield done(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield done(rows)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = segments.where(F.col("classes") <= GROUP).repartition(parts, "anchor").sortWithinPartitions("anchor")
    few = lean(few.select("anchor", "lo", "span", "shift", "k1", "k2", "bytes", "n"), sorted_groups, "k1 long, k2 long, start int, end int")

    def digests(batches):
        import xxhash

        for batch in small_batches(batches, 1 << 20):
            out = []
            for anchor, lo, span, k1, k2, b, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "lo", "span", "k1", "k2", "bytes", "n")), strict=True):
                for p in range(span + 1):
                    d = xxhash.xxh3_128_digest(b[p : p + length])
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), k1, k2, lo + p, n))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["d1", "d2", "k1", "k2", "start", "n"])

    strings = lean(segments.where(F.col("classes") > GROUP), digests, "d1 long, d2 long, k1 long, k2 long, start int, n long")
    again = strings.groupBy("d1", "d2").agg(F.count("*").alias("m")).where("m > 1").select("d1", "d2")
    many = strings.where("n = 1").join(again, ["d1", "d2"], "left_semi").select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(few).unionByName(many)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (array of start and end of the maximal removed runs of bytes) and kept (the other bytes).

    Null texts count as empty; texts shorter than length keep all. Rows that repeat, also those without a doc_id, are
    texts like others, so that a text of length or more that occurs in two rows is removed from both. An empty table
    gives an empty result. Only doc_id and text are read.
    """
    if length < 2 or length > LENGTH * 8:
        raise ValueError(f"length must be 2 to {LENGTH * 8}")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", *_keys())
    spans = written(repeated_spans(docs, length).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "suffix-spans")  # a text's own spans

    def cut(batches):
        for batch in small_batches(batches):
            n, found, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in spans or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                edges = [0, *(x for m in merged for x in m), len(text)]
                n.append(len(text))
                found.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    result = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    texts = docs.withColumn("text", F.col("text").cast("binary"))
    keys = spans.select("k1", "k2")
    if keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        joined = texts.join(spans, ["k1", "k2"], "left")
    else:  # texts without spans need not move
        without = _selected(texts, keys, "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
        joined = _selected(texts, keys, "left_semi").join(spans, ["k1", "k2"]).unionByName(without)
    return lean(joined.select("doc_id", "text", "spans"), cut, result)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES, ORACLES = {"op9_substrings": op9_substrings}, {}
