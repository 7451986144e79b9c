"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A text's signature is K symbols of b bits, the low bits of K minimum hashes of its shingle set; two texts differ in a
symbol with probability 1 - similarity. The join finds every pair of signatures that differ in at most MOST_DIFFERENT
symbols: the symbols are split into chunks, and by the pigeonhole principle such a pair has a chunk with at most
MOST_DIFFERENT // chunks errors. Each text is indexed under every chunk with every allowed set of wrong symbols left
out, so that the pair meets under a key. (At similarity 0.8, chance exceeds 23 of 48 with probability 3e-6.)

Only classes of texts take part: texts with the same set are collapsed first, by their sets' 128-bit digests. Pairs are
not enumerated within a key's texts:

1. Under the first key of each chunk, every text meets one text, drawn anew for each key, and the pairs that the
   signatures and sizes allow are confirmed on the full sets. Large groups of copies are joined by these links already.
2. Links are contracted to components by large-star and small-star steps. Keys whose texts are all in one component
   are done.
3. In the keys that are left, pairs across components are compared in blocks of bounded size, so that no task holds a
   whole key: by signature, and then by the sets themselves where they are small, or by a finer signature where they are
   large. Of the links that the sets show, a block gives a spanning forest, fewer than its texts. Where only the finer
   signature speaks, a block first gives each text's best pair with each other component; these are confirmed on the
   full sets and contracted, and only components that are still apart give all the pairs that may be similar enough.

Sets hold 64-bit hashes of the shingles' words. Everything that is kept between steps is a table in the shared folder.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import shared
from fleetspark.llm.shared import LOWER_BYTES, broadcast_if_small, fresh, lean, small_batches, table

#: Words of a shingle and the similarity in percent that links two texts, unless a caller says otherwise.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SYMBOLS, CHUNK, MOST_DIFFERENT = 48, 4, 23
#: Symbols (of 8 bits) of the finer signature, and the standard deviations that a pair at the limit may stray.
FINE_SYMBOLS, FINE_SIGMAS = 1536, 5.0
#: Shingles of a set that goes into the blocks itself; sets near or above it go there as a finer signature.
WHOLE_SETS = 384
#: Texts of a key that a block holds.
BLOCK = 1024
#: Texts of a block that are compared with the others at a time.
COMPARED = 16
#: Ids that are broadcast to select texts, eight bytes each; beyond that the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a task remembers, and the cells of a block of hash values: speed and memory only.
REMEMBERED_WORDS, CELLS = 100_000, 1 << 18

_U = np.uint64
_MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def written(df: DataFrame, name: str) -> DataFrame:
    """Hashes don't compress, and many small files each with a compressor's buffers cost memory."""
    return shared.written(df, name, "uncompressed")


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(text: bytes, size: int, memory: dict[bytes, int]) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text; of the whole word sequence if it is shorter; empty without words."""
    import xxhash

    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    try:
        h = np.array([memory[w] for w in words], np.uint64)
    except KeyError:
        if len(memory) > REMEMBERED_WORDS:
            memory.clear()
        for w in words:
            if w not in memory:
                memory[w] = xxhash.xxh64_intdigest(w)
        h = np.array([memory[w] for w in words], np.uint64)
    n = len(h) - size + 1
    s = h[:n].copy()
    for k in range(1, size):
        s = (s ^ (s >> _U(29))) * _MIX1 + h[k : n + k]
    s = (s ^ (s >> _U(32))) * _MIX2
    return np.unique(s ^ (s >> _U(29)))


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions a x + b over a set, which is not empty; CELLS hash values at a time."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    wide = min(len(s), 2048)
    tall = max(1, CELLS // wide)
    for top in range(0, len(a), tall):
        own = slice(top, top + tall)
        for at in range(0, len(s), wide):
            h = a[own, None] * s[at : at + wide]
            h += b[own, None]
            np.minimum(out[own], h.min(1), out=out[own])
    return out


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, d1 and d2 (digest of the set; null for empty sets), signature."""

    def run(batches):
        import xxhash

        a, b = _multipliers(SYMBOLS, 1)
        memory: dict[bytes, int] = {}
        for batch in small_batches(batches):
            n, d1, d2, signatures = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text or b"", size, memory)
                n.append(len(s))
                if len(s):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                    signatures.append(minima(s, a, b).astype(np.uint16).tobytes())
                else:
                    for x in (d1, d2, signatures):
                        x.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "text_key", "n_shingles", "d1", "d2", "signature"])

    return lean(docs.select(F.col("doc_id").cast("long"), text_key(), F.col("text").cast("string").cast("binary")), run, "doc_id long, text_key long, n_shingles long, d1 long, d2 long, signature binary")


def _variants() -> list[tuple[int, ...]]:
    """The symbols that make each key: of each chunk, those left when as many errors as are allowed are taken out."""
    chunks = [range(at, at + CHUNK) for at in range(0, SYMBOLS, CHUNK)]
    errors = MOST_DIFFERENT // len(chunks)
    return [tuple(x for x in c if x not in out) for c in chunks for out in itertools.combinations(c, errors)]


#: A key's draw: h = rep * ODD + key * OTHER, reversible, so that the least h of a key names a text at random.
_ODD, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BACK = pow(_ODD, -1, 1 << 64)


def _indexed(classes: DataFrame) -> DataFrame:
    """(key, h) for every class and key; h holds the class's rep."""
    variants = _variants()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
                rep = part.column("rep").to_numpy().astype(np.uint64) * _U(_ODD)
                keys = []
                for k, own in enumerate(variants):
                    key = np.full(len(s), k, np.uint64)
                    for x in own:
                        key = (key << _U(16)) | s[:, x]
                    keys.append(key)
                key = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array((np.tile(rep, len(variants)) + key * _U(_OTHER)).view(np.int64))], ["key", "h"])

    return lean(classes.select("rep", "signature"), run, "key long, h long")


def _members(classes: DataFrame) -> DataFrame:
    """(key, rep, drawn) for every key of two or more classes."""
    indexed = _indexed(classes)
    # a table, so that both sides of the join are plain exchanges, whose skewed partitions Spark can split
    shared = written(indexed.groupBy("key").agg(F.min("h").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "near-shared")

    def run(batches):
        for batch in batches:
            key, h, least = (batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("key", "h", "least"))
            back = lambda x: ((x - key * _U(_OTHER)) * _U(_BACK)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(back(h)), pa.array(back(least))], ["key", "rep", "drawn"])

    return lean(indexed.join(shared, "key").select("key", "h", "least"), run, "key long, rep long, drawn long")


def _different(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y).sum(-1)


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes and signatures allow the similarity."""
    own = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))

    def run(batches):
        for batch in small_batches(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(_different(x, y) <= MOST_DIFFERENT))

    joined = pairs.join(own("a"), "a").join(own("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return lean(joined.select("a", "b", "sa", "sb"), run, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows of docs with these ids."""
    ids = broadcast_if_small(ids, BROADCAST_IDS)
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text")).join(ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Of the pairs (a, b) of doc_ids, those with 100 * intersection >= percent * union of their full sets; a table."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")

    def sets(batches):
        memory: dict[bytes, int] = {}
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t or b"", size, memory).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "own"])

    own = written(lean(_texts(docs, ids), sets, "id long, own binary"), f"{name}-sets")

    def compare(batches):
        for batch in small_batches(batches, 16 << 20):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    return written(lean(joined.select("a", "b", "x", "y"), compare, "a long, b long"), f"{name}-links")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of the links (a, b): the least node reachable. Large-star and small-star steps until nothing changes.

    A step never has more edges than the links. While these are few, nodes' least neighbours, which are aggregated before
    they are shuffled, are broadcast to the edges, so that a node with most of them is no hot key.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), f"{name}-edges")
    before = None
    few = edges.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
    sent = F.broadcast if few else lambda df: df  # two nodes an edge at most; else Spark splits skewed partitions
    while True:
        # large star: a node's larger neighbours go to its least neighbour or itself
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(sent(least), "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(sent(least), "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        edges = written(small.where("u <> v").distinct(), f"{name}-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = now


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _common(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of pairs (x, y) of sets; pairs are sorted by x."""
    used = np.unique(pairs)
    _, places = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    begin = np.cumsum([0, *(len(sets[i]) for i in used)])
    of = {int(i): places[begin[k] : begin[k + 1]] for k, i in enumerate(used)}
    out, own = np.empty(len(pairs), np.int64), np.zeros(int(places.max()) + 1, bool)
    edges = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0], [True]]))
    for begin_of, end_of in zip(edges[:-1], edges[1:], strict=True):
        own[of[int(pairs[begin_of, 0])]] = True
        out[begin_of:end_of] = [own[of[int(y)]].sum() for y in pairs[begin_of:end_of, 1]]
        own[of[int(pairs[begin_of, 0])]] = False
    return out


def _forest(links: list[tuple[int, int]], component: np.ndarray) -> list[tuple[int, int]]:
    """Of links between places, those that join components that the links before leave apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for x, y in links:
        p, q = find(int(component[x])), find(int(component[y]))
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def _across(members: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, everything: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may be similar enough, and whether their block kept pairs back.

    Keeps none back with ``everything``: then pairs of large sets come out all, else the best of each text and other component.
    """
    labelled = written(_labelled(members.select("key", "rep"), comps), "near-labelled")
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    left = written(labelled.join(open_keys, "key"), "near-open")
    ids = written(left.select(F.col("rep").alias("id")).distinct(), "near-open-ids")
    similar = percent / 100
    differ = (1 - similar) * 255 / 256 * FINE_SYMBOLS
    most_fine = math.ceil(differ + FINE_SIGMAS * math.sqrt(differ * (1 - differ / FINE_SYMBOLS)))

    def described(batches):
        a, b = _multipliers(FINE_SYMBOLS, 2)
        memory: dict[bytes, int] = {}
        for batch in small_batches(batches):
            own, fine = [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t or b"", size, memory)
                own.append(s.tobytes() if len(s) <= WHOLE_SETS else None)
                # a set that may be linked with one that doesn't go whole
                fine.append(minima(s, a, b).astype(np.uint8).tobytes() if 100 * len(s) >= percent * WHOLE_SETS else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(fine, pa.binary())], ["rep", "own", "fine"])

    known = written(lean(_texts(docs, ids), described, "rep long, own binary, fine binary").dropDuplicates(["rep"]), "near-fine")
    known = known.join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")), "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = left.withColumns({"block": F.pmod(F.xxhash64("rep", "key"), blocks.cast("long")).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = dealt.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rep", "component").join(known, "rep")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "rep")
    variants = np.array([v + (-1,) * (CHUNK - len(v)) for v in _variants()])
    per_chunk = len(variants) // (SYMBOLS // CHUNK)
    key_bits = 16 * len(_variants()[0])

    def pairs_of(key: int, b1: int, b2: int, rows: list[tuple]) -> list[tuple[int, int, bool]]:
        block, rep, component, size_of = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        s = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, SYMBOLS)
        sets = [None if r[5] is None else np.frombuffer(r[5], np.uint64) for r in rows]
        small = np.array([x is not None for x in sets])
        number = (key & (1 << 64) - 1) >> key_bits
        earlier = number // per_chunk
        links: list[tuple[int, int]] = []
        maybe: list[tuple[int, int, int]] = []
        for begin in range(0, len(rows) - 1, COMPARED):
            i, j = np.arange(begin, min(begin + COMPARED, len(rows)))[:, None], np.arange(begin + 1, len(rows))
            ok = (j > i) & (component[j] != component[i]) & (100 * np.minimum(size_of[j], size_of[i]) >= percent * np.maximum(size_of[j], size_of[i]))
            if b1 != b2:
                ok &= block[j] != block[i]
            if not ok.any():
                continue
            wrong = s[i] != s[j]
            ok &= wrong.sum(2, dtype=np.uint8) <= MOST_DIFFERENT
            x, y = np.nonzero(ok)
            wrong, x, y = wrong[x, y], x + begin, y + begin + 1
            # a pair counts under the first of its keys
            by_chunk = wrong.reshape(len(x), SYMBOLS // CHUNK, CHUNK).sum(2, dtype=np.uint8)
            ok = ~(by_chunk[:, :earlier] <= MOST_DIFFERENT // (SYMBOLS // CHUNK)).any(1)
            for v in variants[earlier * per_chunk : number]:
                ok &= wrong[:, v[v >= 0]].any(1)
            x, y = x[ok], y[ok]
            whole = small[x] & small[y]
            if whole.any():
                both = np.stack([x[whole], y[whole]], 1)
                common = _common(sets, both)
                links += map(tuple, both[100 * common >= percent * (size_of[both].sum(1) - common)].tolist())
            if not whole.all():
                x, y = x[~whole], y[~whole]
                used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                fine = np.frombuffer(b"".join(rows[k][6] for k in used), np.uint8).reshape(-1, FINE_SYMBOLS)
                far = (fine[at[: len(x)]] != fine[at[len(x) :]]).sum(1)
                ok = far <= most_fine
                maybe += zip(far[ok].tolist(), x[ok].tolist(), y[ok].tolist(), strict=True)
        found, held = _forest(links, component), False
        if maybe and not everything:
            best: set[tuple[int, int]] = set()
            chosen = []
            for _, x, y in sorted(maybe):
                ways = {(x, int(component[y])), (y, int(component[x]))}
                if not ways <= best:
                    best |= ways
                    chosen.append((x, y))
            held, found = len(chosen) < len(maybe), found + chosen
        else:
            found += [(x, y) for _, x, y in maybe]
        return [(min(rep[x], rep[y]), max(rep[x], rep[y]), held) for x, y in found]

    def rows_of(out: list[tuple[int, int, bool]]):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "held"])

    def run(batches):
        at, rows = None, []
        for batch in small_batches(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("key", "b1", "b2", "block", "rep", "component", "n_shingles", "signature", "own", "fine"))
            for key, b1, b2, *row in zip(*columns, strict=True):
                if (key, b1, b2) != at:
                    if len(rows) > 1:
                        out += pairs_of(*at, rows)
                    at, rows = (key, b1, b2), []
                rows.append(row)
            yield rows_of(out)
        if len(rows) > 1:
            yield rows_of(pairs_of(*at, rows))

    found = lean(dealt.select("key", "b1", "b2", "block", "rep", "component", "n_shingles", "signature", "own", "fine"), run, "a long, b long, held boolean")
    return written(found.groupBy("a", "b").agg(F.max("held").alias("held")), "near-across")


def _grouped(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, d1 (null for empty sets) and component (null without a doc_id) of each row of docs."""
    signed = written(_signed(docs, shingle_words), "near-signed")
    classes = signed.where("d1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
    classes = written(classes, "near-classes")
    members = written(_members(classes), "near-members")
    first = F.shiftrightunsigned("key", 16 * len(_variants()[0])) % (len(_variants()) * CHUNK // SYMBOLS) == 0
    star = members.where(first & (F.col("rep") != F.col("drawn"))).select(F.least("rep", "drawn").alias("a"), F.greatest("rep", "drawn").alias("b")).distinct()
    links = _confirmed(written(_allowed(star, classes, percent), "near-star"), docs, shingle_words, percent, "near-star")
    comps = components(links, "near-first")
    for everything in (False, True):
        pairs = _across(members, comps, classes, docs, shingle_words, percent, everything)
        more = _confirmed(pairs.select("a", "b"), docs, shingle_words, percent, "near-more")
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "near-more")
        if not everything and pairs.where("held").isEmpty():
            break
    of_class = written(_labelled(classes.select("d1", "d2", "rep"), comps).select("d1", "d2", "component"), "near-of-class")
    out = signed.join(of_class, ["d1", "d2"], "left")  # a class with many copies is a skewed key, which Spark splits at run time
    return out.select("doc_id", "text_key", "n_shingles", "d1", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id that links lead to), kept (doc_id = component_id).

    Two rows are linked if 100 * intersection >= percent * union of their shingle sets. Null texts and texts without
    words have an empty set and are linked with nothing. Rows that repeat are linked by their texts; doc_ids are taken
    to be unique, and rows that share one are judged by their texts each. A row without a doc_id takes no part: its
    component is null and it is kept. An empty table gives an empty result. Only doc_id and text are read.
    """
    out = _grouped(docs, shingle_words, percent)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


#: Rows without a doc_id get one from here on while near copies are dropped, by their texts.
STAND_INS = 1 << 62


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """docs' rows and columns with one row of each group of near copies: the one with the least doc_id.

    Of rows that share this doc_id, the text with the least hash stays; of rows that repeat (doc_id and text), one. Rows
    without a doc_id are members of groups like others, and stay where no row of their group has one. Null texts and
    texts without words are in no group; of those that repeat, with the same doc_id, one row stays. An empty table gives
    an empty result; further columns stay as they are, whatever their names.
    """
    own, key = fresh(docs, "_own", "_key")
    stand_in = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(STAND_INS - 1).bitwiseOR(F.lit(STAND_INS))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), "text")
    rows = _grouped(named, shingle_words, percent).withColumn("lone", F.when(F.col("d1").isNull(), F.struct("doc_id", "text_key")))
    rows = written(rows.groupBy("doc_id", "text_key", "component", "lone").agg(F.count("*").alias("n")), "near-rows")
    stays = rows.groupBy("component", "lone").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select(F.col("one.doc_id").alias("doc_id"), F.col("one.text_key").alias("text_key"), F.lit(True).alias("stays"))
    rows = written(rows.join(stays, ["doc_id", "text_key"], "left"), "near-judged")
    names = lambda df: broadcast_if_small(df.select(F.col("doc_id").alias(own), F.col("text_key").alias(key)), BROADCAST_IDS)
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), stand_in), key: text_key()})
    kept = keyed.join(names(rows.where("stays IS NULL")), [own, key], "left_anti")
    again = written(rows.where("stays AND n > 1"), "near-again")
    if not again.isEmpty():
        kept = kept.join(names(again), [own, key], "left_anti").unionByName(kept.join(names(again), [own, key], "left_semi").dropDuplicates([own, key]))
    return kept.select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


QUERIES, ORACLES = {"op1_minhash": op1_minhash}, {}
