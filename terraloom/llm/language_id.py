"""Operator 10, language identification by cross-parsing entropy.

For each language a suffix automaton is built of a sample of labelled text. A text is cross-parsed against it: each phrase is the longest match
that the automaton has from where the last phrase ended (a character that the sample lacks is a phrase of its own). The number of phrases,
times the bits that a pointer into the sample takes, by character, estimates the cross entropy; the language with the least wins.

Automata become dense tables (state x symbol -> next state, and whether a phrase ends), so all texts of a slice take a step at once in
numpy. Letters are lower-cased and mapped to the alphabet of the language's own sample, its LETTERS most frequent; what the sample lacks is a
symbol that no phrase goes on with; a run of anything but letters is one symbol. A text of over PIECE symbols is parsed in pieces at the same
time, each as if a phrase began there; then each piece is parsed again from the state in which the one before it truly ended, until the two
parses are in one state, so the number of phrases is that of the whole text parsed from its start.

Training reads labelled rows outside the held-out fold only, and every label that occurs: of each language ROWS rows, those with the least
hashes of their identifiers, and of these CHARS characters, or an equal share of TOTAL where there are more than TOTAL / CHARS languages. That
bound makes the model small at any size of the table; it goes to the workers with the task. A worker holds tables of TABLES bytes and makes
those of further languages anew for each slice.

Cases: a null text, or one without a letter, is `und` with score 0; no labelled rows at all: `und` everywhere; ties of two languages go to the
alphabetically first; identifiers may be null or repeated (a null one is not held out); over LABELS different labels are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import col, ship, slices

#: Bounds of the sample: rows and characters of a language, characters of all; letters of a language's alphabet; symbols of a piece; bytes of
#: the tables that a worker keeps; the most labels (more can't be languages, and are refused).
ROWS, CHARS, TOTAL, LETTERS, PIECE, TABLES, LABELS = 200, 20_000, 8_000_000, 250, 2048, 512 << 20, 10_000
FOLDS, HELD_OUT = 4, 2
SPACE, LETTER, FIRST = range(3)  # not a letter, a letter that the sample lacks or its alphabet leaves out, the alphabet


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, text) of the bounded sample. Identifiers are chosen first, from narrow columns; then a scan takes their texts. Rows are ranked
    and their characters added up in Spark, by partial ranks, so an identifier that many rows have brings no more than the bound here."""
    labels = docs.select(F.col(label_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    narrow = labels.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    if narrow.select("lang").distinct().limit(LABELS + 1).count() > LABELS:
        raise ValueError(f"over {LABELS} different labels in {label_col}")
    chosen = narrow.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("n") <= ROWS)
    ids = chosen.select("lang", "id").distinct()
    rows = docs.select(F.col(label_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.substring(F.col(text_col).cast("string"), 1, CHARS).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    ranked = rows.where(F.length("text") > 0).join(F.broadcast(ids), ["lang", "id"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= ROWS)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held: dict[str, list[str]] = {}
    for r in ranked.withColumn("before", before).where(F.col("before") < CHARS).select("lang", "n", F.substr("text", F.lit(1), (CHARS - F.col("before")).cast("int")).alias("text")).orderBy("lang", "n").toLocalIterator():
        held.setdefault(r.lang, []).append(r.text)
    share = min(CHARS, max(1, TOTAL // max(len(held), 1)))
    return tuple((lang, "\n".join(held[lang])[: share + len(held[lang]) - 1]) for lang in sorted(held))


def _automaton(symbols: list[int], width: int) -> np.ndarray:
    """Dense table of the cross-parsing transducer: 4 * next state + the number of phrases that end with the step."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    # where there is no way on, a phrase ends and the next begins with this symbol; one that the sample lacks is a phrase of its own
    table = np.tile(np.array([4 * nexts[0][c] + 1 if c in nexts[0] else 2 for c in range(width)], np.int32), (len(nexts), 1))
    table[0] = 1
    for state, moves in enumerate(nexts):
        table[state, list(moves)] = [4 * t for t in moves.values()]
    return table


def _letter_table() -> np.ndarray:
    """Each code point's lower-cased first letter, 0 for all that are no letters."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


class LanguageModel:
    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.lower = _letter_table()
        self.languages = [lang for lang, _ in texts]
        self.symbol: list[np.ndarray] = []
        self.coded: list[np.ndarray] = []
        self.width: list[int] = []
        for _, text in texts:
            flat = self._letters([text])[0]
            letters, counts = np.unique(flat[flat > 0], return_counts=True)
            alphabet = letters[np.lexsort((letters, -counts))][:LETTERS]
            symbol = np.full(0x110000, LETTER, np.uint8)
            symbol[0] = SPACE
            symbol[alphabet] = FIRST + np.arange(len(alphabet))
            self.symbol.append(symbol)
            self.coded.append(symbol[flat])
            self.width.append(FIRST + len(alphabet))
        self.bits = [math.log2(max(len(c), 2)) for c in self.coded]
        self.kept: dict[int, np.ndarray] = {}

    def table(self, k: int) -> np.ndarray:
        """The automaton of a language; as many as TABLES bytes hold are kept."""
        found = self.kept.get(k)
        if found is None:
            found = _automaton(self.coded[k].tolist(), self.width[k]).ravel()
            if sum(t.nbytes for t in self.kept.values()) + found.nbytes <= TABLES:
                self.kept[k] = found
        return found

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the texts, one text after the other, with 0 for a run of anything else, and how many of these each text has."""
        flat = np.append(self.lower[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)], np.uint32(0))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        keep = flat != 0
        keep[1:] |= keep[:-1]
        keep[starts] = True
        keep[-1] = False
        return flat[keep], np.add.reduceat(keep, starts, dtype=np.int64) * (lengths > 0)

    def phrases(self, k: int, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each text by the automaton of language k."""
        table, width = self.table(k), self.width[k]
        wide = self.symbol[k][flat].astype(np.int64)
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = (np.cumsum(lengths) - lengths)[owner] + nth * PIECE
        size = np.minimum(lengths[owner] - nth * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")
        count, end = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        state, found, place = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), at[order]
        active = np.searchsorted(-size[order], -np.arange(PIECE), "left")  # how many pieces are longer than each step
        for step in range(int(size.max()) if len(size) else 0):
            n = active[step]
            move = table.take(state[:n] * width + wide.take(place[:n] + step))
            found[:n] += move & 3
            state[:n] = move >> 2
        count[order], end[order] = found, state
        # each piece but the first begins in the state in which the one before it ended
        more, ends = np.zeros(len(owner), np.int64), end.copy()
        todo = np.flatnonzero(nth > 0)
        todo = todo[end[todo - 1] != 0]
        while len(todo):
            true, guess, extra, step = ends[todo - 1], np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64), 0
            new_end = end[todo].copy()
            live = np.arange(len(todo))
            while len(live):
                over = size[todo[live]] <= step
                if over.any():
                    new_end[live[over]] = true[live[over]]
                    live = live[~over]
                c = wide.take(at[todo[live]] + step)
                a, b = table.take(true[live] * width + c), table.take(guess[live] * width + c)
                extra[live] += (a & 3) - (b & 3)
                true[live], guess[live] = a >> 2, b >> 2
                live = live[true[live] != guess[live]]
                step += 1
            more[todo] = extra
            changed = todo[new_end != ends[todo]]
            ends[todo] = new_end
            todo = changed + 1
            todo = todo[todo < len(owner)]
            todo = todo[nth[todo] > 0]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.empty(0, bool)
        return np.bincount(owner, count + more + (last & (ends > 0)), len(lengths))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        flat, lengths = self._letters(texts)
        starts = np.cumsum(lengths) - lengths
        letters = np.add.reduceat(np.append(flat > 0, False), starts, dtype=np.int64) * (lengths > 0)
        best, least, second = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf), np.full(len(texts), np.inf)
        for k, bits in enumerate(self.bits):
            rate = self.phrases(k, flat, lengths) * bits / np.maximum(lengths, 1)
            less = rate < least
            second = np.where(less, least, np.minimum(second, rate))
            best, least = np.where(less, k, best), np.where(less, rate, least)
        score = np.where(np.isfinite(second), 1 - least / np.maximum(second, 1e-12), 1.0)
        return [(self.languages[b], float(min(1.0, max(0.0, s)))) if n else ("und", 0.0) for b, s, n in zip(best.tolist(), score.tolist(), letters.tolist())]


@lru_cache(2)
def trained(texts: tuple[tuple[str, str], ...]) -> LanguageModel:
    return LanguageModel(texts)


def identify(docs: DataFrame, model: tuple[tuple[str, str], ...], keep: list[str], text_col: str = "text", mark: str = "") -> DataFrame:
    """The columns `keep`, then lang_pred and score (with `mark` before their names) of each row, by a sample's model. One narrow pass."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(text_col).cast("string").alias("__text"), *(col(k).alias(f"__{i}") for i, k in enumerate(keep)))
    names = [*(f"__{i}" for i in range(len(keep))), "__lang_pred", "__score"]

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(0), 4 << 20):
                found = trained(model).predict(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, len(texts)) for i in range(1, batch.num_columns)), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names)

    kept = "".join(f"`__{i}` {t}, " for i, (_, t) in enumerate(chosen.dtypes[1:]))
    out = chosen.mapInArrow(predict, f"{kept}__lang_pred string, __score double")
    return out.select(*(F.col(f"__{i}").alias(k) for i, k in enumerate(keep)), F.col("__lang_pred").alias(f"{mark}lang_pred"), F.col("__score").alias(f"{mark}score"))


def keep_known(docs: DataFrame) -> DataFrame:
    """docs, all columns, without those that are null or have no letter. Where there is nothing to learn from, that is told from the text."""
    model = sample(docs)
    if not model:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    verdicts = identify(docs, model, docs.columns, mark="__identified_")
    return verdicts.where(F.col("__identified_lang_pred") != "und").select(*map(col, docs.columns))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, sample(docs), ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
