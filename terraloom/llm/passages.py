"""Word passages that documents share, a further column of operator 4.

A passage is WORDS words in a row, words being runs of bytes other than white space, whatever white space is between them. Each window of WORDS
words has a mark, the least of the names of its GRAM-word strings; equal windows have equal marks wherever they are. A class is a run of windows
of one mark, at most MOST of them; its span is all the words that they cover.

1. Classes whose mark is in one document alone are gone: nothing in them is shared.
2. Classes whose whole span is in two documents are shared, window by window.
3. Of what is left, the rims of shared passages, the windows are named one by one, with the documents of their class: a window is shared if its
   name has two documents. A document takes each (mark, span) once, however often it repeats it.

Names are 64-bit fingerprints; words that are repeated inside one document alone aren't shared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import DONE, OPEN, RIM, discard, is_open, materialise, release, settled, ship
from .repeats import MOST_CLASSES, NAMED, _least, _signed, _slices, changes, come_twice, packed, pair, repeated_windows

WORDS, GRAM = 50, 4
WIDE = WORDS - GRAM + 1
#: Windows of a class: a span has at most 96 words, which two names of 64 cover.
MOST = 47
#: Bytes of text that a task works on at once; items of a document are place * SPREAD + windows, and AGAIN where the text has equal classes.
SLICE, SPREAD, AGAIN = 1 << 17, 128, 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(40)
_BYTES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def names_of_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of a buffer and where they begin."""
    flat = np.frombuffer(text, np.uint8)
    space = np.ones(len(flat) + 2, bool)
    space[1:-1] = _SPACE[flat]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    letters = np.flatnonzero(~space[1:-1])
    first = np.cumsum(sizes) - sizes
    place = letters - np.repeat(starts, sizes)
    return pair(np.add.reduceat(_BYTES[flat[letters]] * _PLACES[place & 4095], first), sizes.astype(np.uint64)), starts


class Passages:
    """Windows of the words of several texts."""

    def __init__(self, texts: list[bytes]):
        name, at = names_of_words(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.last = np.searchsorted(at, ends)  # the number of the first word after each text
        self.first = np.append(0, self.last[:-1])
        padded = np.append(name, np.zeros(128, np.uint64))
        length, self.name = 1, {}
        while length < 64:
            padded = pair(padded[:-length], padded[length:])
            length *= 2
            self.name[length] = padded
        self.marks = _least(self.name[GRAM][: len(name) + WIDE - 1], WIDE) if len(name) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), self.last - self.first)
        whole = np.arange(len(name)) + WORDS <= self.last[owner]
        self.place = np.flatnonzero(whole)
        self.owner = owner[self.place]

    def named(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Names of `length` words, 50 to 96, from each place."""
        far, near = self.name[64], self.name[32]
        long = length >= 64
        a = np.where(long, far[at], near[at])
        b = np.where(long, far[at + np.maximum(length - 64, 0)], near[at + np.minimum(length, 64) - 32])
        return pair(pair(a, b), length.astype(np.uint64))

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mark, span, text and item of each class; equal ones of a text once."""
        place, owner = self.place, self.owner
        if not len(place):
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
        marks = self.marks[place]
        new = np.append(True, (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1]))
        run = np.flatnonzero(new)
        nth = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
        start = np.flatnonzero(nth % MOST == 0)
        windows = np.diff(np.append(start, len(place)))
        mark, at, whose = marks[start], place[start], owner[start]
        span = self.named(at, windows + WORDS - 1)
        item = (at - self.first[whose]) * SPREAD + windows
        order = np.lexsort((item, span, mark, whose))
        mark, span, whose, item = mark[order], span[order], whose[order], item[order]
        keep = np.append(True, (mark[1:] != mark[:-1]) | (span[1:] != span[:-1]) | (whose[1:] != whose[:-1]))
        return mark[keep], span[keep], whose[keep], np.where(np.append(keep[1:], True), item, item | AGAIN)[keep]

    def windows(self, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mark, name, text and item of each window of the items of each text, and the number of its item among all."""
        whose = np.repeat(np.arange(len(items)), [len(x) for x in items])
        flat = np.concatenate([np.empty(0, np.int64), *items])
        n, again = flat % AGAIN, flat & AGAIN
        which = np.repeat(np.arange(len(flat)), n)
        at = np.repeat(flat // SPREAD, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[whose[which]]
        return self.marks[at], self.named(at, np.full(len(at), WORDS)), whose[which], (at - self.first[whose[which]]) * SPREAD + 1 + again[which], which

    def covered(self, items: list[np.ndarray]) -> np.ndarray:
        """Words of each text that its windows equal to those of the items cover."""
        _, wanted, whose, _, _ = self.windows(items)
        names = self.named(self.place, np.full(len(self.place), WORDS))
        hit = np.zeros(len(names), bool)
        order = np.argsort(whose, kind="stable")
        bounds, own = np.searchsorted(whose[order], np.arange(len(items) + 1)), np.searchsorted(self.owner, np.arange(len(items) + 1))
        for i in np.unique(whose):
            hit[own[i] : own[i + 1]] = np.isin(names[own[i] : own[i + 1]], wanted[order[bounds[i] : bounds[i + 1]]])
        delta = np.zeros(len(self.marks) + WORDS + 1, np.int64)
        np.add.at(delta, self.place[hit], 1)
        np.add.at(delta, self.place[hit] + WORDS, -1)
        under = np.append(0, np.cumsum(np.cumsum(delta) > 0))
        return under[self.last] - under[self.first]


def words_under(items: list[np.ndarray]) -> np.ndarray:
    """Words that the items of each text cover."""
    whose = np.repeat(np.arange(len(items)), [len(x) for x in items])
    flat = np.concatenate([np.empty(0, np.int64), *items])
    start = (whose << 40) + flat // SPREAD  # texts apart from each other
    order = np.argsort(start)
    start, end = start[order], (start + flat % AGAIN + WORDS - 1)[order]
    reached = np.maximum.accumulate(end)
    fresh = end - np.maximum(start, np.append(0, reached[:-1])[: len(end)])
    return np.bincount(whose[order], np.maximum(fresh, 0), len(items)).astype(np.int64)


def decide_passages(table: pa.Table) -> pa.Table:
    """Of the classes whose mark two documents have, those whose span two have too (DONE) and one of each different span of a mark (RIM), with the
    least and greatest document (low, high) that has it."""
    mark, span, doc, rk = (table[c].to_numpy() for c in ("mark", "span", "doc", "rk"))
    order = come_twice(mark)
    who = pair(doc[order].view(np.uint64), rk[order].view(np.uint64)).view(np.int64)
    by = np.lexsort((who, span[order], mark[order]))
    order, who = order[by], who[by]
    if not len(order):
        return table.slice(0, 0).append_column("state", pa.array([], pa.int32()))
    mark, span = mark[order], span[order]
    new = changes(mark, span)
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(mark)))
    low, high = who[start], who[start + sizes - 1]
    first = np.flatnonzero(changes(mark[start]))
    kinds = np.diff(np.append(first, len(start)))
    several = np.repeat((kinds > 1) & (np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)), kinds)
    state = np.where(np.repeat(low != high, sizes), DONE, 0) + np.where(new & np.repeat(several, sizes), RIM, 0)
    keep = state > 0
    out = table.take(order[keep])
    for k, c in ((5, low), (6, high)):
        out = out.set_column(k, out.column_names[k], pa.array(np.repeat(c, sizes)[keep]))
    return out.append_column("state", pa.array(state[keep].astype(np.int32)))


def shared_items(held: DataFrame) -> DataFrame:
    """doc, rk and shared (array of items) of the documents that share passages; held has doc, rk (long) and raw (binary). Two rows of equal
    doc and rk count as one document."""
    ship(held.sparkSession)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch, 2, SLICE):
                mark, span, owner, item = Passages(texts).classes()
                rows, none = pa.array(owner + start), pa.array(np.zeros(len(item), np.int64))
                yield pa.RecordBatch.from_arrays([_signed(mark), _signed(span), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(item), none, none], ["mark", "span", "doc", "rk", "item", "low", "high"])

    # 50 words have 99 bytes at least
    records = held.where(F.length("raw") >= 2 * WORDS - 1).mapInArrow(first, "mark long, span long, doc long, rk long, item long, low long, high long")
    classes = materialise(settled(records, "mark", decide_passages, MOST_CLASSES), "passages")
    tables = [classes]
    done = classes.where(F.col("state").bitwiseAND(DONE) > 0).select("doc", "rk", "item")
    rims = classes.where(F.col("state").bitwiseAND(RIM) > 0).select("doc", "rk", "item", "low", "high")
    if is_open(classes):
        some = classes.where(F.col("state") == OPEN).drop("low", "high", "state")
        # a document as one number: sums of whole numbers are hashed where structs would be sorted
        who = F.xxhash64("doc", "rk")
        marks = some.groupBy("mark").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low != high").select("mark")
        left = materialise(some.join(marks, "mark", "left_semi"), "shared-marks")
        kinds = left.groupBy("mark", "span").agg(F.min(who).alias("low"), F.max(who).alias("high"), *(F.first(c).alias(c) for c in ("doc", "rk", "item")))
        kinds = materialise(kinds, "passage-kinds")
        tables += [left, kinds]
        done = done.unionByName(left.join(kinds.where("low != high").select("mark", "span"), ["mark", "span"], "left_semi").select("doc", "rk", "item"))
        several = kinds.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
        rims = rims.unionByName(kinds.join(several, "mark", "left_semi").select("doc", "rk", "item", "low", "high"))
    wanted = rims.groupBy("doc", "rk").agg(F.collect_list(F.struct("item", "low", "high")).alias("items"))

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch, 2, SLICE):
                lists = batch.column(3).slice(start, len(texts))
                sizes = pc.list_value_length(lists).to_numpy()
                item, low, high = (c.to_numpy() for c in lists.flatten().flatten())
                mark, name, owner, place, which = Passages(texts).windows(np.split(item, np.cumsum(sizes)[:-1]))
                rows = pa.array(owner + start)
                yield packed(mark, name, changes(which), pa.array(low[which]), pa.array(high[which]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place))

    windows = held.join(wanted.hint("shuffle_hash"), ["doc", "rk"]).select("doc", "rk", "raw", "items").mapInArrow(second, NAMED)
    singles, table = repeated_windows(windows, SPREAD, True, "passage-windows")
    found = materialise(done.unionByName(singles).groupBy("doc", "rk").agg(F.collect_list("item").alias("shared")), "shared")
    for t in (*tables, table):
        discard(t)
    release(held.sparkSession)
    return found
