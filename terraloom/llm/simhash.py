"""Operator 8, SimHash near-duplicates with BK-trees.

A fingerprint has bit i set if more than half of the XXH64 values of a text's word shingles have it. Two fingerprints link at RADIUS or fewer
differing bits; classes are the connected components of the links.

The trees (children keyed by their integer Hamming distance to the parent; a search follows only the edges within the radius) are sharded.
Six blocks of the 64 bits: of two fingerprints with at most two differing bits, at least four blocks are alike. So each distinct fingerprint
goes to fifteen shards, one for each choice of four blocks with their values, and any link is found inside one. A shard has its own tree, in
the task that holds it, in place of trees broadcast to all tasks: these would grow with the corpus. A shard's fingerprints have 42 bits or more
in common, so it can't have over 2**22 (32 MB), whatever the data. Trees give a spanning forest, not all pairs. Copies, and texts with equal
fingerprints, are one node. Large-star and small-star rounds join the forests; each round is written to the shared folder.

`near_duplicates` is the general operator (five words, similarity 0.8 or more): see there.

Cases: a null or wordless text has fingerprint 0, which links like any other; identifiers may be repeated; one that is null counts as no
candidate for the smallest; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import attach, col, discard, materialise, release, ship

RADIUS, SEED, BLOCK = 2, 42, 1 << 15
SPACES = re.compile(rb"[ \t-\r]+")
_EDGES = [0, 11, 22, 33, 43, 54, 64]
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:])]
#: Masks of the shards: four of the six blocks each.
MASKS = [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in combinations(_BLOCKS, 4)]


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in blocks."""
    flat = SPACES.sub(b" ", text.lower()).strip(b" ")
    if not flat:
        return
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(flat))
    if len(starts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        yield np.array([digest(flat[a:b], seed) for a, b in zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist())], np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` and the fingerprint (`fp`, long) of each row."""
    ship(docs.sparkSession)
    chosen = docs.select(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("__text"), *keep)
    names = [*chosen.columns[1:], "fp"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names)

    return chosen.mapInArrow(run, "".join(f"`{n}` {t}, " for n, t in chosen.dtypes[1:]) + "fp long")


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        k = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while k:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = k
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most `radius` bits away."""
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                out.append(at)
            below = self.children[at]
            if len(below) <= 2 * radius + 1:
                todo.extend(k for e, k in below.items() if d - radius <= e <= d + radius)
            else:
                todo.extend(below[e] for e in range(d - radius, d + radius + 1) if e in below)
        return out


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct values, by their places."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            if (a := root(i)) != (b := root(j)):
                parent[a] = b
                links.append((i, j))
        tree.add(value)
    return links


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span the classes inside each shard; `distinct` has the distinct fingerprints `fp`."""
    if radius > 2:
        raise ValueError("the shards are exact for a radius up to 2")
    masks = F.array(*(F.struct(F.lit(i).alias("choice"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(MASKS)))
    shards = distinct.select("fp", F.explode(masks).alias("m")).select(F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("shared"), "fp")
    shards = shards.repartition("choice", "shared").sortWithinPartitions("choice", "shared")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_runs(batches, 2):
            a, b = [], []
            for start, end in runs(held, 2):
                values = held[2, start:end].tolist()
                for x, y in shard_links([v & 0xFFFFFFFFFFFFFFFF for v in values], radius):
                    a.append(values[x])
                    b.append(values[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return shards.mapInArrow(run, "a long, b long")


def whole_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """The columns of sorted batches (all whole numbers) as rows of an array, so that rows of one key, the first `keys` columns, stay together.
    Of a run that goes on, the batches are held as they came and put together once."""
    open_: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        cuts = np.flatnonzero((now[:keys, 1:] != now[:keys, :-1]).any(axis=0)) + 1
        if open_ and (open_[-1][:keys, -1] != now[:keys, 0]).any():
            cuts = np.append(0, cuts)
        if len(cuts):
            whole = np.concatenate([*open_, now[:, : cuts[-1]]], axis=1)
            open_, now = [], now[:, cuts[-1] :]
            if whole.shape[1]:
                yield whole
        open_.append(now)
    if open_:
        yield np.concatenate(open_, axis=1)


def runs(held: np.ndarray, keys: int) -> Iterator[tuple[int, int]]:
    """Start and end of each run of two or more rows of one key."""
    starts = np.flatnonzero(np.concatenate([[True], (held[:keys, 1:] != held[:keys, :-1]).any(axis=0)]))
    ends = np.append(starts[1:], held.shape[1])
    for i in np.flatnonzero(ends - starts > 1):
        yield int(starts[i]), int(ends[i])


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of (a, b), a written table; label is the least node; only nodes with edges. Alternating
    large-star and small-star; hot nodes are salted."""
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = attach(both, least, ["u"], F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, least, ["u"], F.col("v")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).collect()[0]
        if state == seen:
            break
        seen = state
    out = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components")
    discard(now)
    return out


def classes(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id of each row."""
    rows = materialise(fingerprints(docs, words, [F.col(id_col).alias("id")], text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("first"))
    labels = components(links(distinct.select("fp")))
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = materialise(labelled, "labels")
    discard(labels)
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return attach(rows, attach(labelled, least, ["label"], F.col("fp")).select("fp", "component_id"), ["fp"], F.col("id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near duplicates by similarity: MinHash rows of a band, bands; the radius inside a band's tree; the most rows that one tree takes; the most
#: rows of a bucket whose pairs are all counted at once; shingles of a part of a bucket, two of which are held against each other.
ROWS, BANDS, REACH, TREE, SMALL, PART = 5, 25, 20, 4096, 3, 500_000
_RNG = np.random.default_rng(8)
_A, _B = _RNG.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def signature(text: bytes, words: int) -> tuple[int, list[int]]:
    """SimHash fingerprint and the bands' values."""
    total, n, least = np.zeros(64, np.int64), 0, np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for hashes in shingle_hashes(text, words):
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        for i in range(0, len(hashes), 2048):
            least = np.minimum(least, (hashes[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    fp = int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0]) if n else 0
    return fp, [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, ROWS * BANDS, ROWS)]


def shard_pairs(values: list[int], reach: int = REACH) -> list[tuple[int, int]]:
    """Pairs of places to count first: all of a small shard; else each value with its nearest before it within reach. Only a start: what they
    leave unlinked is counted by `block_links`."""
    if len(values) <= SMALL:
        return list(combinations(range(len(values)), 2))
    tree, pairs = BKTree(), []
    for i, value in enumerate(values):
        near = tree.within(value, reach)
        if near:
            pairs.append((i, min(near, key=lambda j: ((values[j] ^ value).bit_count(), j))))
        tree.add(value)
    return pairs


def block_links(labels: np.ndarray, parts: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links, by exact count, that span the classes of one block: texts with their labels so far, parts, sizes of their shingle sets and these
    sets, one after the other. Pairs of one label are linked already; in a block of two parts those of one part are counted elsewhere."""
    _, group, counts = np.unique(labels, return_inverse=True, return_counts=True)
    parent, links = list(range(len(counts))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(shingles, kind="stable")
    values, owner = shingles[order], owner[order]
    starts = np.cumsum(sizes) - sizes
    two = parts.min() != parts.max()
    # a pair of two labels has a text outside the commonest label
    for i in np.flatnonzero(group != counts.argmax()).tolist():
        own = shingles[starts[i] : starts[i] + sizes[i]]
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = high - low
        common = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sizes))
        for j in np.flatnonzero((common > 0) & (common >= similarity * (sizes + sizes[i] - common)) & ((parts != parts[i]) if two else True)).tolist():
            if (x := root(group[i])) != (y := root(group[j])):
                parent[x] = y
                links.append((i, j))
    return links


def signatures(docs: DataFrame, words: int, row: str, text_col: str) -> DataFrame:
    """row, number (a whole number of its own, fixed by being written), fp, bands of each row."""
    ship(docs.sparkSession)
    chosen = docs.select(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"), F.col(row).alias("row"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f for f, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.int64()))], ["row", "fp", "bands"])

    return materialise(chosen.mapInArrow(sign, "row string, fp long, bands array<long>").withColumn("number", F.monotonically_increasing_id()), "bands")


def bucket_rows(signed: DataFrame) -> DataFrame:
    """value (a band's, of its own seed, so the band is in it), n, first, fp, number of the rows of buckets of two or more.

    Most values occur once, so they are counted first, by partial sums, and only values of several rows are joined back; the row side of that
    join is split by adaptive execution where one value holds a large share, the other has one row a value."""
    rows = signed.select("number", F.explode("bands").alias("value"))
    buckets = materialise(rows.groupBy("value").agg(F.count("*").alias("n"), F.min("number").alias("first")).where("n > 1"), "values")
    mates = rows.join(buckets.hint("merge"), "value")
    out = materialise(mates.join(signed.select("number", "fp").hint("merge"), "number").select("value", "n", "first", "fp", "number"), "buckets")
    discard(buckets)
    return out


def near_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of numbers of rows to count first: each in one tree of a bucket, or a hot bucket's row and its first."""
    hot = rows.where((F.col("n") > TREE) & (F.col("number") != F.col("first"))).select(F.col("number").alias("a"), F.col("first").alias("b"))
    shards = rows.withColumn("part", F.when(F.col("n") > TREE, F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / TREE))).otherwise(F.lit(0)).cast("long"))
    shards = shards.select("value", "part", "fp", "number").repartition("value", "part").sortWithinPartitions("value", "part", "number")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_runs(batches, 2):
            a, b = [], []
            for start, end in runs(held, 2):
                numbers = held[3, start:end].tolist()
                for x, y in shard_pairs([v & 0xFFFFFFFFFFFFFFFF for v in held[2, start:end].tolist()]):
                    a.append(numbers[x])
                    b.append(numbers[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = shards.mapInArrow(search, "a long, b long").unionByName(hot)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """number and its distinct shingle hashes, of texts (number, text)."""
    chosen = texts.select(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"), "number")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(t.as_py(), words)])).view(np.int64) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["number", "shingles"])

    return chosen.mapInArrow(run, "number long, shingles array<long>")


def further_links(rows: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among the bucket mates that aren't linked yet, so that no pair of a bucket is left out.

    In each bucket of several labels the texts of the label with the most shingles are its core, all others its rest. Core and rest are divided
    into parts of about PART shingles; a block is two parts of the rest (or one and itself), or a part of the rest and one of the core, and is
    counted exactly in one task. So a text of the core goes to as many tasks as the rest has parts, one mostly, however large the core is."""
    sizes = sets.select("number", F.size("shingles").cast("long").alias("size")).where("size > 0")
    # all pairs of a small bucket are counted already
    mates = rows.where((F.col("n") > SMALL) | (F.col("n") > TREE)).select("value", "number").join(sizes, "number")
    mates = mates.join(labels.withColumnRenamed("node", "number"), "number", "left").withColumn("label", F.coalesce("label", "number"))
    held = mates.groupBy("value", "label").agg(F.sum("size").alias("size"))
    open_ = held.groupBy("value").agg(F.max(F.struct("size", "label")).alias("core"), F.sum("size").alias("total"), F.count("*").alias("labels")).where("labels > 1")
    open_ = open_.select("value", F.col("core.label").alias("core"), F.ceil(F.col("core.size") / PART).alias("cores"), F.ceil((F.col("total") - F.col("core.size")) / PART).alias("rests"))
    mates = attach(mates, open_, ["value"], F.col("number")).where(F.col("core").isNotNull())
    apart = F.col("label") != F.col("core")
    # parts of the rest are 0, 1, ..., those of the core -1, -2, ...
    mates = mates.withColumn("part", F.when(apart, F.pmod(F.xxhash64("number"), F.col("rests"))).otherwise(-1 - F.pmod(F.xxhash64("number"), F.col("cores"))))
    rests, cores = (F.sequence(F.lit(0).cast("long"), F.col(k) - 1) for k in ("rests", "cores"))
    block = lambda i, j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    own = F.col("part")
    both = F.when(apart, F.concat(F.transform(rests, lambda k: block(own, k)), F.transform(cores, lambda k: block(own, -1 - k)))).otherwise(F.transform(rests, lambda k: block(own, k)))
    blocks = mates.select("value", "number", "label", "part", F.explode(both).alias("block")).select("value", "block.i", "block.j", "number", "label", "part")
    blocks = blocks.join(sets, "number").select("value", "i", "j", "number", "label", "part", "shingles").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in _with_end(batches):
            if batch is None:
                parted = [(None, None)]
            elif not batch.num_rows:
                continue
            else:
                keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]])
                new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])).tolist()
                parted = [(tuple(keys[:, a].tolist()), batch.slice(a, b - a)) for a, b in zip(new, [*new[1:], batch.num_rows])]
            for now, part in parted:
                if now != key and held:
                    block = pa.Table.from_batches(held).combine_chunks()
                    numbers, marks, parts = (block.column(k).to_numpy() for k in ("number", "label", "part"))
                    lists = block.column("shingles").combine_chunks()
                    found = block_links(marks, parts, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), similarity) if key[1] == key[2] or parts.min() != parts.max() else []
                    held = []
                    if found:
                        a, b = np.array(found).T
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[a], pa.int64()), pa.array(numbers[b], pa.int64())], ["a", "b"])
                key = now
                if part is not None:
                    held.append(part)

    return blocks.mapInArrow(count, "a long, b long")


def near_duplicates(docs: DataFrame, row: str, words: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """(node, label) of the rows (key `row`, a string) that are linked to others: Jaccard similarity of the word shingles at or above
    `similarity`, counted exactly.

    At a similarity of 0.8 two 64-bit fingerprints differ in about ten bits (more, where shingles are repeated), which no sharding by equal
    blocks of bits can follow; so here the shards are buckets of MinHash bands (25 of 5 rows: a pair at 0.8 shares none in 1 of 20,000 cases).
    In each a tree of the fingerprints gives the pairs that are counted first; then all pairs of a bucket that these haven't linked are counted
    too. Texts without a word are never linked."""
    signed = signatures(docs, words, row, text_col)
    rows = bucket_rows(signed)
    pairs = materialise(near_pairs(rows), "pairs")
    named = materialise(signed.select("number", "row").join(rows.select("number").distinct(), "number", "left_semi"), "named")
    discard(signed)
    # whole texts move once, at any size of the other side; what a task holds of that is locators
    texts = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text")).join(named.hint("shuffle_hash"), "row").select("number", "text")
    sets = materialise(shingle_sets(texts, words), "shingles")
    # a text that many are compared with is spread over salts
    both = attach(pairs, sets.select(F.col("number").alias("b"), F.col("shingles").alias("y")), ["b"], F.col("a")).join(sets.select(F.col("number").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    alike = both.where((common > 0) & (common >= F.lit(similarity) * (F.size("x") + F.size("y") - common))).select("a", "b")
    first = labels = components(alike)
    further = materialise(further_links(rows, labels, sets, similarity), "further")
    for table in (rows, pairs, sets):
        discard(table)
    if not further.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(further))
    out = materialise(labels.join(named.withColumnRenamed("number", "node"), "node").select(F.col("row").alias("node"), "label"), "near")
    for table in (first, labels, further, named):
        discard(table)
    release(docs.sparkSession)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each class of near duplicates: that of the smallest identifier (null last)."""
    from .exact_dedup import LOCATOR, with_locator

    located = with_locator(docs)
    labels = near_duplicates(located.select(LOCATOR, text_col), LOCATOR, text_col=text_col).select(F.col("node").alias(LOCATOR), "label")
    members = located.select(LOCATOR, F.col(id_col).alias("__id")).join(labels, LOCATOR)
    order = F.struct(F.col("__id").isNull(), F.col("__id"), F.col(LOCATOR))
    first = members.groupBy("label").agg(F.min(order).alias("first"))
    gone = attach(members, first, ["label"], F.col(LOCATOR)).where(F.col(f"first.{LOCATOR}") != F.col(LOCATOR)).select(LOCATOR)
    gone = materialise(gone, "near-copies")
    release(docs.sparkSession)
    return located.join(gone.hint("shuffle_hash"), LOCATOR, "left_anti").select(*map(col, docs.columns))
