"""Operator 5, document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (at line ends and sentence ends, and after UNIT words, so that a long line is several) and each gets a 64-bit
digest; of the n-th copy of a paragraph the digest takes in n. A sketch has cells of (count, xor of digests, xor of check sums); each digest
is in three of them. The sketch of one version minus that of another has only what differs; peeling (take a cell of one digest, take that
digest out of its other cells, go on) recovers the digests on either side. If cells are left over, the difference was too large, and both
versions are sketched again with four times the cells, up to what surely suffices. Likeness is 1 - differing / (one side + other side).

The fingerprint is the sketch of CELLS cells, in base64, after the number of paragraphs: equal texts have equal fingerprints.

The query also needs each document's successor by descending identifier. Rows go to ranges of the identifier and, where many rows have one,
of the hash of the text, bounded by quantiles; the first row of a range is sent to the range before as well, so a range's task sees each of its
rows' successors: one shuffle of the texts and no global window. The bounds of the ranges and their first keys go to the driver: RANGES of them
at most, however many rows there are (a range then has more than RANGE rows, which its task sorts with spilling and goes through in slices).

Cases: a null text is empty, has no paragraphs and the likeness 1 to another empty one; rows of equal identifiers follow each other in the
order of their texts' hashes; null identifiers come last; a single row is its own successor; extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ship

#: Cells and hashes of a fingerprint, words of a paragraph, rows of a range, most ranges, keys sampled for each, characters compared at once.
CELLS, HASHES, UNIT, RANGE, RANGES, SAMPLE, SLICE = 24, 3, 8, 1024, 1 << 14, 20, 1 << 20
PARAGRAPHS = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def paragraphs(text: str) -> list[str]:
    out = []
    for p in PARAGRAPHS.findall(text):
        words = p.split()
        out.extend(" ".join(words[i : i + UNIT]) for i in range(0, len(words), UNIT))
    return out


def digests(text: str) -> np.ndarray:
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, 0) + 1
        out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), n))
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _K[k]
    return x ^ (x >> np.uint64(32))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest, one in each third of the sketch."""
    third = np.uint64(cells // HASHES)
    return np.stack([_mix(keys, k) % third + np.uint64(k) * third for k in range(HASHES)]).astype(np.int64)


class Sketches:
    """Sketches of several documents at once, of `cells` cells each, in flat arrays."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, documents: int, cells: int):
        self.documents, self.cells = documents, cells
        self.count = np.zeros(documents * cells, np.int64)
        self.keys = np.zeros(documents * cells, np.uint64)
        self.checks = np.zeros(documents * cells, np.uint64)
        self.add(keys, owner, np.ones(len(keys), np.int64))

    def add(self, keys: np.ndarray, owner: np.ndarray, times: np.ndarray) -> None:
        checks = _mix(keys, 3)
        for at in _places(keys, self.cells) + owner * self.cells:
            self.count += np.bincount(at, times, len(self.count)).astype(np.int64)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.documents, out.cells = self.documents, self.cells
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests that differ, the document and side (1 or -1) of each, and which documents failed."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(4 * self.cells + 8):
            at = np.flatnonzero((np.abs(self.count) == 1) & (_mix(self.keys, 3) == self.checks))
            if not len(at):
                break
            owner, keys = at // self.cells, self.keys[at]
            first = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1, return_index=True)[1]
            owner, keys, side = owner[first], keys[first], self.count[at[first]]
            found.append((keys, owner, side))
            self.add(keys, owner, -side)
        left = (self.count != 0) | (self.keys != 0)
        parts = list(zip(*found)) or [[np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        keys, owner, side = (np.concatenate(p) for p in parts)
        return keys, owner, side, left.reshape(self.documents, self.cells).any(axis=1)

    def text(self, i: int, n: int) -> str:
        part = slice(i * self.cells, (i + 1) * self.cells)
        raw = self.count[part].astype("<u2").tobytes() + self.keys[part].astype("<u8").tobytes() + self.checks[part].astype("<u4").tobytes()
        return f"{n:x}:{base64.b64encode(raw).decode()}"


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest arrays, the digests that only the left and only the right one has; larger sketches for pairs that fail."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.uint64))] * len(left)
    todo = np.arange(len(left))
    while len(todo):
        a, b = [left[i] for i in todo], [right[i] for i in todo]
        keys, owner, side, failed = Sketches(*_flat(a), len(todo), cells).minus(Sketches(*_flat(b), len(todo), cells)).peel()
        order = np.argsort(owner, kind="stable")
        keys, owner, side = keys[order], owner[order], side[order]
        bounds = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k in np.flatnonzero(~failed).tolist():
            own, way = keys[bounds[k] : bounds[k + 1]], side[bounds[k] : bounds[k + 1]]
            out[todo[k]] = np.sort(own[way > 0]), np.sort(own[way < 0])
        todo, cells = todo[failed], cells * 4
        if cells > 1 << 26:  # two digests that share all cells at every size: never met
            for i in todo:
                out[i] = np.setdiff1d(left[i], right[i]), np.setdiff1d(right[i], left[i])
            break
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    return [1.0 - (len(x) + len(y)) / n if (n := len(a) + len(b)) else 1.0 for a, b, (x, y) in zip(left, right, differences(left, right))]


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _results(ids: list, texts: list[str], following: list[str], keys: list[np.ndarray], after: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    new = [edited(t, f) for t, f in zip(texts, following)]
    changed = [digests(t) for t in new]
    n = len(texts)
    sketch, other = Sketches(*_flat(keys), n, CELLS), Sketches(*_flat(changed), n, CELLS)
    columns = [
        pa.array(ids, schema.field(0).type),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
        pa.array([sketch.text(i, len(keys[i])) for i in range(n)]),
        pa.array([other.text(i, len(changed[i])) for i in range(n)]),
        pa.array(likeness(keys, changed), pa.float64()),
        pa.array(likeness(keys, after), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def below(cuts: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many of the sorted pairs `cuts` (two rows) are less than each pair of keys and marks."""
    low, high = np.searchsorted(cuts[0], keys, "left"), np.searchsorted(cuts[0], keys, "right")
    out = low.copy()
    several = np.flatnonzero(high > low)
    for start in np.unique(low[several]):  # a key that has bounds inside
        at = several[low[several] == start]
        out[at] += np.searchsorted(cuts[1, start : high[at[0]]], marks[at], "left")
    return out


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = RANGE) -> DataFrame:
    """part, extra, id, text, in order inside each part: the rows of a range by descending identifier (equal ones by the text's hash), then, with
    extra 1, the rows of the first key of the range after it. The last range is followed by the first."""
    ship(docs.sparkSession)
    held = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = held.select("id", "text", F.coalesce(F.col("id"), F.lit(-(1 << 63) + 1)).alias("key"), F.xxhash64("text").alias("mark"))
    ids = held.select("key", "mark")
    total = docs.select(F.lit(1)).count()
    parts = min(RANGES, max(1, -(-total // rows)))
    # SAMPLE keys for each range place the bounds; they decide how even the ranges are, and nothing else
    drawn = np.array([tuple(r) for r in ids.sample(min(1.0, SAMPLE * parts / max(total, 1)), seed=5).collect()] if parts > 1 else [], np.int64).reshape(-1, 2)
    drawn = drawn[np.lexsort((drawn[:, 1], drawn[:, 0]))][SAMPLE - 1 :: SAMPLE]
    cuts = np.unique(drawn, axis=0).T.copy().reshape(2, -1)

    def parts_of(keys: pd.Series, marks: pd.Series) -> np.ndarray:
        return cuts.shape[1] - below(cuts, keys.to_numpy(), marks.to_numpy())

    part_of = F.pandas_udf(lambda k, m: pd.Series(parts_of(k, m)), "long")
    tops = ids.groupBy(part_of("key", "mark").alias("part")).agg(F.max(F.struct("key", "mark")).alias("top")).orderBy("part").collect()
    there = [r.part for r in tops]
    heads, before = np.zeros((2, cuts.shape[1] + 1), np.int64), np.zeros(cuts.shape[1] + 1, np.int64)
    for r, previous in zip(tops, there[-1:] + there[:-1]):
        heads[:, r.part], before[r.part] = tuple(r.top), previous

    def targets(keys: pd.Series, marks: pd.Series) -> pd.Series:
        """The part of a row and, for the first of a range, the part before, as -1 less it."""
        own = parts_of(keys, marks)
        first = (heads[0, own] == keys.to_numpy()) & (heads[1, own] == marks.to_numpy())
        return pd.Series([[p, -1 - i] if h else [p] for p, i, h in zip(own.tolist(), before[own].tolist(), first.tolist())])

    sent = held.select(F.explode(F.pandas_udf(targets, "array<long>")("key", "mark")).alias("to"), "id", "mark", "text")
    sent = sent.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).cast("int").alias("extra"), "id", "mark", "text")
    return sent.repartition("part").sortWithinPartitions("part", "extra", F.desc_nulls_last("id"), F.desc("mark"), "text").select("part", "extra", "id", "text")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (f.split() for f in fields.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int | None, str]] = []
        known: list[np.ndarray] = []  # digests of the first rows
        size = 0

        def flush() -> pa.RecordBatch | None:
            keys = [*known, *(digests(r[3]) for r in rows[len(known) :])]
            at = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
            out = _results([rows[i][2] for i in at], [rows[i][3] for i in at], [rows[i + 1][3] for i in at], [keys[i] for i in at], [keys[i + 1] for i in at], schema) if at else None
            rows[:], known[:] = rows[-1:], keys[-1:]
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2))), batch.column(3)):
                rows.append((*row[:3], row[3].as_py()))
                size += len(rows[-1][3])
                if size >= SLICE and len(rows) > 1:
                    if out := flush():
                        yield out
                    size = 0
        if len(rows) > 1 and (out := flush()):
            yield out

    return successors(docs, id_col, text_col).mapInArrow(run, fields)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
