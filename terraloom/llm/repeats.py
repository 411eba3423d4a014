"""Operator 4, removal of repeated byte strings by prefix doubling over a sparse set of positions.

Prefix doubling names the string of length 2L at a position by the pair of names of its two halves of length L. Here names are 64-bit
fingerprints, so a task can double up to 256 bytes without a sort, and two overlapping names give any length up to 512; the tables that Spark
groups hold (position, name) pairs at growing lengths, and positions whose name is unique leave at each step:

1. Anchors: positions whose 16-byte name is the least within REACH on either side, which only the bytes around decide. A window of LENGTH bytes
   is known by its first anchor and the distance to it; the windows of an anchor are taken in classes of WIDTH distances. All windows of a class
   share a core (LENGTH - WIDTH + 1 bytes). A class whose core occurs once has no repeated window, and goes.
2. If all the bytes of a class (its span) occur again, all its windows do: done. What is left is the rims of repeated passages.
3. There, names of LENGTH bytes are compared window by window, with one copy of each different span of the same core; the names of a class travel
   as one row.

Each step is one shuffle by the core, after which a task has all rows of its cores and tells with NumPy what is repeated (`settled`).
Windows without an anchor (periodic text, mostly) are named one by one from the start, but of equal ones in a piece only two are sent. A
suffix array of all positions would sort some 24 bytes for each byte of text in each round; the anchors are about one position in 75.

A further column, n_shared_words, counts the words in passages of 50 words or more that another document has too (`passages`): such passages
are mostly under LENGTH bytes.

Equal fingerprints are taken as equal strings: within one core (or pair of names) the chance of a false pair is 2**-64 each.

Cases: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows remove each other; texts of any length are worked on in
pieces of PIECE bytes that overlap by a window; rows of one identifier with different texts are kept apart by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import DONE, OPEN, RIM, discard, is_open, lists, materialise, release, settled, ship

LENGTH, REACH, WIDTH, GRAM, PIECE = 400, 48, 96, 16, 1 << 20
#: Bytes of text that a task names at once: its names stay in the cache of a core.
BLOCK = 1 << 17
#: Bytes of classes, and of names of windows, that a task decides on at once; more is left to Spark's groupings.
MOST_CLASSES, MOST_NAMES = 1 << 27, 1 << 25
#: Item codes: 1 to WIDTH windows in a row; a window without an anchor; one that has equal ones in its piece.
BARE, MANY, CODES = 126, 127, 128
_TABLE = np.random.default_rng(4).integers(0, 1 << 64, 256, dtype=np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
S29, S32 = np.uint64(29), np.uint64(32)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * _K1 + b
    x ^= x >> S29
    x *= _K2
    x ^= x >> S32
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i."""
    n, length, y = len(x) - width + 1, 1, x
    while 2 * length <= width:
        y = np.minimum(y[:-length], y[length:])
        length *= 2
    return np.minimum(y[:n], y[width - length : width - length + n])


class Windows:
    """Names of a buffer of pieces, and the classes of their windows."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        name = _TABLE[np.frombuffer(b"".join(pieces) + bytes(2 * LENGTH), np.uint8)]
        length = 1
        while length < 256:
            name = pair(name[:-length], name[length:])
            length *= 2
            if length == GRAM:
                gram = name
        self.name = name
        low = _least(gram, REACH)
        middle = gram[REACH : len(gram) - REACH]
        anchor = REACH + np.flatnonzero((middle < low[: len(middle)]) & (middle <= low[REACH + 1 : REACH + 1 + len(middle)]))
        piece = np.minimum(np.searchsorted(self.ends, anchor, "right"), len(pieces) - 1)
        inside = (anchor - REACH >= self.starts[piece]) & (anchor + REACH + GRAM <= self.ends[piece])
        anchor, piece = anchor[inside], piece[inside]
        gap = np.full(len(anchor), 1 << 40)
        gap[1:] = np.where(piece[1:] == piece[:-1], anchor[1:] - anchor[:-1], gap[1:])
        last = np.minimum(np.minimum(REACH + gap - 1, anchor - self.starts[piece]), LENGTH - REACH - GRAM)
        first = np.maximum(REACH, anchor + LENGTH - self.ends[piece])
        parts = []
        for c in range((LENGTH - 2 * REACH - GRAM) // WIDTH + 1):
            lo, hi = np.maximum(first, REACH + c * WIDTH), np.minimum(last, REACH + c * WIDTH + WIDTH - 1)
            k = np.flatnonzero(hi >= lo)
            parts.append((anchor[k], piece[k], np.full(len(k), c), lo[k], hi[k]))
        self.anchor, self.piece, self.code, self.lo, self.hi = (np.concatenate(x) for x in zip(*parts))

    def named(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return pair(self.name[at], self.name[at + length - 256])

    def cores(self) -> np.ndarray:
        return pair(self.named(self.anchor - REACH - self.code * WIDTH, LENGTH - WIDTH + 1), self.code.astype(np.uint64))

    def spans(self) -> np.ndarray:
        return pair(self.named(self.anchor - self.hi, self.hi - self.lo + LENGTH), (self.hi * LENGTH + self.lo).astype(np.uint64))

    def items(self) -> np.ndarray:
        """Code of each class: where its first window is in its piece, and how many it has."""
        return (self.anchor - self.hi - self.starts[self.piece]) * CODES + self.hi - self.lo + 1

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows without an anchor, and their pieces."""
        free = np.zeros(len(self.name) + 1, np.int32)
        whole = np.flatnonzero(self.sizes >= LENGTH)
        np.add.at(free, self.starts[whole], 1)
        np.add.at(free, self.ends[whole] - LENGTH + 1, -1)
        np.add.at(free, self.anchor - self.hi, -1)
        np.add.at(free, self.anchor - self.lo + 1, 1)
        at = np.flatnonzero(np.cumsum(free) > 0)
        return at, np.searchsorted(self.ends, at, "right")


def cut(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces of the texts, which text each is of, and which number it has in it. All windows of a text start in exactly one piece."""
    pieces, owner, number = [], [], []
    for i, t in enumerate(texts):
        for k, a in enumerate(range(0, max(len(t) - LENGTH + 1, 1), PIECE)):
            pieces.append(t[a : a + PIECE + LENGTH - 1])
            owner.append(i)
            number.append(k)
    return pieces, np.array(owner, np.int64), np.array(number, np.int64)


#: Items of a text's pieces follow each other.
STEP = 2 * PIECE * CODES


def _slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    held, size, start = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py()
        if held and size + len(t) > limit:
            yield start, held
            held, size, start = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def class_records(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Core, span, text number and item of each class and of windows without an anchor."""
    pieces, owner, number = cut(texts)
    w = Windows(pieces)
    at, piece = w.bare()
    first, second = w.name[at], w.name[at + LENGTH - 256]
    order = np.lexsort((at, second, first, piece))
    at, piece, first, second = at[order], piece[order], first[order], second[order]
    same = np.zeros(len(at), bool)
    same[1:] = (piece[1:] == piece[:-1]) & (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    third = same.copy()
    third[1:] &= same[:-1]
    kind = np.where(same | np.append(same[1:], False), MANY, BARE)
    keep = ~third  # two of a piece show that they are repeated
    at, piece, first, second, kind = at[keep], piece[keep], first[keep], second[keep], kind[keep]
    return (
        np.concatenate([w.cores(), pair(first, np.full(len(first), BARE, np.uint64))]),
        np.concatenate([w.spans(), second]),
        owner[np.concatenate([w.piece, piece])],
        np.concatenate([w.items() + number[w.piece] * STEP, (at - w.starts[piece]) * CODES + kind + number[piece] * STEP]),
    )


def window_records(texts: list[bytes], wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Core, name, text number and item of each single window of the wanted classes."""
    pieces, owner, number = cut(texts)
    w = Windows(pieces)
    items = w.items() + number[w.piece] * STEP
    mine = owner[w.piece]
    pick = np.zeros(len(items), bool)
    order = np.argsort(mine, kind="stable")
    bounds = np.searchsorted(mine[order], np.arange(len(texts) + 1))
    for i, want in enumerate(wanted):
        own = order[bounds[i] : bounds[i + 1]]
        pick[own] = np.isin(items[own], want)
    k = np.flatnonzero(pick)
    sizes = w.hi[k] - w.lo[k] + 1
    which = np.repeat(k, sizes)
    at = np.repeat(w.anchor[k] - w.hi[k], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    piece = w.piece[which]
    return w.cores()[which], w.named(at, LENGTH), owner[piece], (at - w.starts[piece]) * CODES + 1 + number[piece] * STEP


def remove(texts: list[bytes], repeated: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, the mask of its bytes that repeated windows cover, by the items that were found repeated."""
    cover = [np.zeros(len(t) + 1, np.int32) for t in texts]
    for delta, found in zip(cover, repeated):
        place, kind = found // STEP * PIECE + found % STEP // CODES, found % CODES
        np.add.at(delta, place, 1)
        np.add.at(delta, place + np.where(kind < BARE, kind, 1) + (LENGTH - 1), -1)
    # of windows that have equal ones in their piece, one or two are given: only their texts are named again
    for delta, text, found in zip(cover, texts, repeated):
        if len(many := found[found % CODES == MANY]):
            pieces, _, number = cut([text])
            w = Windows(pieces)
            at, piece = w.bare()
            key = lambda x, p: pair(pair(w.name[x], w.name[x + LENGTH - 256]), p.astype(np.uint64))
            hit = np.isin(key(at, piece), key(w.starts[many // STEP] + many % STEP // CODES, many // STEP))
            place = at[hit] - w.starts[piece[hit]] + number[piece[hit]] * PIECE
            np.add.at(delta, place, 1)
            np.add.at(delta, place + LENGTH, -1)
    return [np.cumsum(d[:-1]) > 0 for d in cover]


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def come_twice(key: np.ndarray) -> np.ndarray:
    """The rows whose key another row has too."""
    order = np.argsort(key, kind="stable")
    new = changes(key[order])
    return order[~(new & np.append(new[1:], True)[: len(new)])]


def decide_classes(table: pa.Table) -> pa.Table:
    """Of the classes whose core comes twice, those whose span does too (DONE) and one of each different span of a core (RIM)."""
    core, span = (table[c].to_numpy() for c in ("core", "span"))
    order = come_twice(core)
    order = order[np.lexsort((span[order], core[order]))]
    core, span = core[order], span[order]
    new_core, new = changes(core), changes(core, span)
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(core)))
    group = np.cumsum(new_core) - 1
    kinds = np.bincount(group[start])[group]
    with_anchor = table["item"].to_numpy()[order] % CODES < BARE
    state = np.where(np.repeat(sizes, sizes) > 1, DONE, 0) + np.where(new & (kinds > 1) & with_anchor, RIM, 0)
    keep = state > 0
    return table.take(order[keep]).append_column("state", pa.array(state[keep].astype(np.int32)))


#: Rows of windows that follow each other, with their names: any two rows of one core may share windows, if `low` and `high` (documents) say so.
NAMED = "core long, low long, high long, doc long, rk long, item long, names binary"


def packed(core: np.ndarray, name: np.ndarray, new: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
    """A row of each run of windows, whose beginnings are `new`; the columns are low, high, doc, rk, item of all windows."""
    start = np.flatnonzero(new)
    offsets = np.append(start, len(name)).astype(np.int32) * 8
    names = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(name))])
    return pa.RecordBatch.from_arrays([_signed(core[start]), *(c.take(pa.array(start)) for c in columns), names], [f.split()[0] for f in NAMED.split(", ")])


def unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, row and place in its row of each window of packed rows."""
    names = table["names"]
    sizes = np.asarray(pc.binary_length(names)).astype(np.int64) // 8
    name = np.frombuffer(b"".join(names.to_pylist()), np.uint64)
    return name, np.repeat(np.arange(len(sizes)), sizes), np.arange(len(name)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def decide_windows(table: pa.Table, step: int, documents: bool) -> pa.Table:
    """Runs of the windows that come twice in a core (in two documents, if so asked), as items; `step` is between items of following windows."""
    name, row, nth = unpacked(table)
    core = table["core"].to_numpy().view(np.uint64)[row]
    order = np.argsort(pair(core, name), kind="stable")
    start = np.flatnonzero(changes(core[order], name[order]))
    sizes = np.diff(np.append(start, len(name)))
    if documents and len(start):
        low, high = (table[c].to_numpy()[row][order] for c in ("low", "high"))
        twice = np.minimum.reduceat(low, start) != np.maximum.reduceat(high, start)
    else:
        twice = sizes > 1
    hit = np.zeros(len(name), bool)
    hit[order] = np.repeat(twice, sizes)
    begin = np.flatnonzero(hit & (np.append(True, ~hit[:-1])[: len(hit)] | (nth == 0)))
    length = np.add.reduceat(hit, begin, dtype=np.int64) if len(begin) else begin
    out = table.take(row[begin])
    item = out["item"].to_numpy() + nth[begin] * step + length - 1
    out = out.set_column(5, "item", pa.array(item)).set_column(6, "names", pa.array([b""] * len(begin), pa.binary()))
    return out.append_column("state", pa.array(np.full(len(begin), DONE, np.int32)))


def repeated_windows(windows: DataFrame, step: int, documents: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """doc, rk, item of the repeated windows of packed rows, and the table that they are read from."""
    table = materialise(settled(windows, "core", lambda t: decide_windows(t, step, documents), MOST_NAMES), name)
    out = table.where(F.col("state") == DONE).select("doc", "rk", "item")
    if is_open(table):

        def apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, row, nth = unpacked(batch)
                columns = [batch.column(k).take(pa.array(row)) for k in range(5)]
                items = batch.column(5).to_numpy()[row] + nth * step
                yield pa.RecordBatch.from_arrays([_signed(names), *columns, pa.array(items)], ["span", "core", "low", "high", "doc", "rk", "item"])

        single = table.where(F.col("state") == OPEN).drop("state").mapInArrow(apart, "span long, core long, low long, high long, doc long, rk long, item long")
        count = single.groupBy("core", "span").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        again = count.where("low != high" if documents else "n > 1").select("core", "span")
        out = out.unionByName(single.join(again, ["core", "span"], "left_semi").select("doc", "rk", "item"))
    return out, table


def repeated_items(held: DataFrame) -> DataFrame:
    """doc, rk, item of what is repeated; held has doc, rk (long) and raw (binary)."""
    ship(held.sparkSession)
    fields = "core long, span long, doc long, rk long, item long"
    names = [f.split()[0] for f in fields.split(", ")]

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch, 2, BLOCK):
                core, span, owner, item = class_records(texts)
                rows = pa.array(owner + start)
                yield pa.RecordBatch.from_arrays([_signed(core), _signed(span), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(item)], names)

    records = held.where(F.length("raw") >= LENGTH).mapInArrow(first, fields)
    classes = materialise(settled(records, "core", decide_classes, MOST_CLASSES), "classes")
    tables = [classes]
    done, rims = (classes.where(F.col("state").bitwiseAND(bit) > 0).select("doc", "rk", "item") for bit in (DONE, RIM))
    if is_open(classes):
        some = classes.where(F.col("state") == OPEN)
        cores = some.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        left = materialise(some.join(cores, "core", "left_semi"), "repeated-cores")
        # one row for each span of a core: all that is kept of a group, however large
        kinds = materialise(left.groupBy("core", "span").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "rk", "item"))), "spans")
        tables += [left, kinds]
        done = done.unionByName(left.join(kinds.where("n > 1").select("core", "span"), ["core", "span"], "left_semi").select("doc", "rk", "item"))
        several = kinds.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
        rims = rims.unionByName(kinds.join(several, "core", "left_semi").select("doc", "rk", "item").where(F.col("item") % CODES < BARE))
    wanted = rims.groupBy("doc", "rk").agg(F.collect_list("item").alias("items"))

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch, 2, BLOCK):
                core, name, owner, item = window_records(texts, lists(batch.column(3).slice(start, len(texts))))
                new = changes(core, owner) | np.append(True, np.diff(item) != CODES)[: len(item)]
                run = np.flatnonzero(new)
                new |= (np.arange(len(item)) - np.repeat(run, np.diff(np.append(run, len(item))))) % WIDTH == 0
                rows, none = pa.array(owner + start), pa.array(np.zeros(len(item), np.int64))
                yield packed(core, name, new, none, none, batch.column(0).take(rows), batch.column(1).take(rows), pa.array(item))

    windows = held.join(wanted.hint("shuffle_hash"), ["doc", "rk"]).select("doc", "rk", "raw", "items").mapInArrow(second, NAMED)
    singles, table = repeated_windows(windows, CODES, False, "windows")
    found = materialise(done.unionByName(singles).groupBy("doc", "rk").agg(F.collect_list("item").alias("items")), "repeated")
    for t in (*tables, table):
        discard(t)
    release(held.sparkSession)
    return found


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words of each row and, if asked for, the bytes that are left (`kept`, binary)."""
    from .passages import AGAIN, Passages, shared_items, words_under

    key: Column = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63) + 1))
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    held = docs.select(key.alias("doc"), F.xxhash64(raw).alias("rk"), raw.alias("raw"), F.col(id_col).cast("long").alias("id"))
    found = repeated_items(held.select("doc", "rk", "raw")).join(shared_items(held.select("doc", "rk", "raw")), ["doc", "rk"], "full")
    joined = held.join(found.hint("shuffle_hash"), ["doc", "rk"], "left").select("id", "raw", "items", "shared")

    def third(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raws in _slices(batch, 1, PIECE):
                items, shared = (lists(batch.column(k).slice(start, len(raws))) for k in (2, 3))
                some = [i for i, x in enumerate(items) if len(x)]
                masks = [np.zeros(len(t), bool) for t in raws]
                if some:
                    for i, m in zip(some, remove([raws[i] for i in some], [items[i] for i in some])):
                        masks[i] = m
                words = words_under(shared)
                if some := [i for i, x in enumerate(shared) if (x & AGAIN).any()]:
                    words[some] = Passages([raws[i] for i in some]).covered([shared[i] for i in some])
                kept = [np.frombuffer(t, np.uint8)[~m].tobytes() if m.any() else t for t, m in zip(raws, masks)]
                columns = [
                    batch.column(0).slice(start, len(raws)),
                    pa.array([len(t) for t in raws], pa.int64()),
                    pa.array([int(m.sum()) for m in masks], pa.int64()),
                    pa.array([int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) for m in masks], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array(words),
                ]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if texts else columns, out)

    out = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", *(["kept"] if texts else [])]
    return joined.mapInArrow(third, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long" + (", kept binary" if texts else ""))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
