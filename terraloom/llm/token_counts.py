"""Operator 3, token counts by compiled finite-state transducers.

Two deterministic transducers, composed. The first splits text into words as the tokenizer's pattern does: thirteen states over twelve
classes of characters, each transition annotated with the word starts that it settles (here, or one character back: that is all the look-ahead
the pattern needs). A slice of text is cut into chunks; for each chunk the map from entry state to exit state is made for all states at once,
the maps are composed by a parallel prefix scan, and a second pass from the now known entry states reads the annotations off.

The second reads the bytes of a word and has on each transition the number of tokens that it adds (which may be negative). Byte-pair merges
have the prefix property: the tokens of a prefix are fixed but for the last, and a sequence is the encoding exactly if each adjacent pair is.
So a state is the longest suffix that a token could go on from, with the last token and the count at each place where that token may begin. It is compiled lazily:
states and transitions are made when first met and kept up to a bound, as are the totals of whole words.

Cases: a null text is empty (0 bytes, 0 tokens); the special string inside a text is one token, as the library has it; any length of text
works, in pieces that end where a word starts.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ship, slices

EOT, SPACE, WS, LETTER, NUMBER, OTHER, APOS, STMD, R, V, L, E = range(12)
START, LET, NUM, OTH, WFS, WFO, WMS, WMO, A, AR, AV, AL, C = range(13)
STATES, CLASSES = 13, 12
#: Characters of a chunk; of a piece of a long text; and how many words, or transducer states, a worker keeps.
CHUNK, PIECE, KEPT_WORDS, KEPT_STATES = 256, 1 << 20, 300_000, 200_000
LETTERS = {LETTER, STMD, R, V, L, E}


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    new = {SPACE: WFS, WS: WFO, NUMBER: NUM, OTHER: OTH, APOS: A} | dict.fromkeys(LETTERS, LET)
    joined = {NUMBER: NUM, OTHER: OTH, APOS: OTH} | dict.fromkeys(LETTERS, LET)  # after the space that a word begins with
    more = {SPACE: WMS, WS: WMO}

    def step(q: int, c: int) -> tuple[int, int]:
        if c == EOT:
            return START, 1 | 2 * (q in (AR, AV, AL))
        if q == START or q == C:
            return new[c], 1
        if q in (LET, NUM, OTH):
            goes_on = c in {LET: LETTERS, NUM: {NUMBER}, OTH: {OTHER, APOS}}[q]
            return (q, 0) if goes_on else (new[c], 1)
        if q in (WFS, WFO, WMS, WMO):
            if c in more:
                return more[c], 0
            return {WFS: (joined[c], 0), WFO: (new[c], 1), WMS: (joined[c], 2), WMO: (new[c], 3)}[q]
        if q == A:
            if c in (STMD, R, V, L):
                return {STMD: C, R: AR, V: AV, L: AL}[c], 0
            return (OTH, 0) if c in (OTHER, APOS) else (new[c], 1)
        if c == (L if q == AL else E):
            return C, 0
        return (LET, 2) if c in LETTERS else (new[c], 3)

    table = [[step(q, c) for q in range(STATES)] for c in range(CLASSES)]
    return np.array([[q for q, _ in row] for row in table], np.uint8).ravel(), np.array([[b for _, b in row] for row in table], np.uint8).ravel()


#: Letters and numbers of Unicode 16, which the tokenizer's library knows and Python's tables may not: first and last of each range.
LATER_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
LATER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            out[i] = LETTER
        elif k == "N":
            out[i] = NUMBER
    for ranges, k in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for a, b in (x.split("-") for x in ranges.split()):
            out[int(a, 16) : int(b, 16) + 1] = k
    for i in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[i] = WS
    for chars, k in ((" ", SPACE), ("'", APOS), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in chars:
            out[ord(x)] = k
    return out


NEXT, STARTS = _transitions()


def word_starts(classes: np.ndarray) -> np.ndarray:
    """True where a word starts, and at each EOT."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, EOT, np.uint16)
    padded[:n] = classes
    at = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) * np.uint16(STATES)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for row in at:
        maps = NEXT.take(row[:, None] + maps)
    reach = 1
    while reach < chunks:  # maps[i] becomes the composition of all chunks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.empty(chunks, np.uint8)
    state[0], state[1:] = START, maps[:-1, START]
    marks = np.empty((CHUNK, chunks), np.uint8)
    for i, row in enumerate(at):
        k = row + state
        marks[i] = STARTS.take(k)
        state = NEXT.take(k)
    marks = marks.T.ravel()[:n]
    out = (marks & 1).astype(bool)
    out[:-1] |= marks[1:] >= 2
    return out


class WordTransducer:
    """Lazily compiled transducer from the bytes of a word to its number of tokens."""

    def __init__(self, merges: list[tuple[bytes, bytes]], kept: int = KEPT_STATES):
        """merges: the pairs that merge, best first; all single bytes are tokens."""
        self.kept = kept
        self.ids_of = {bytes((i,)): i for i in range(256)}
        self.halves = [(i, i) for i in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = self.ids_of[left], self.ids_of[right]
            k = self.ids_of.setdefault(left + right, len(self.halves))
            if k == len(self.halves):
                self.halves.append(pair)
            self.joined.setdefault(pair, k)
        self.prefixes = {t[:i] for t in self.ids_of for i in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._id((b"", ((0, None, 0),)))

    def _id(self, state: tuple) -> int:
        k = self.ids.setdefault(state, len(self.states))
        if k == len(self.states):
            self.states.append(state)
            self.moves.append({})
        return k

    def follows(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, stay two tokens: going down both sides of the border in the order in which they were merged,
        no pair across it merges before its parts are merged away. Ids are in the order of the merges."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before, stays = left, right, 1 << 60, True
        while True:
            if self.joined.get((a, b), 1 << 60) < before:
                stays = False
                break
            if a < 256 and b < 256:
                break
            # undo the later of the two merges; of equal ones the right one, as merging goes from the left
            if a > b:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]
        if len(self.pairs) > 4 * self.kept:
            self.pairs.clear()
        self.pairs[left, right] = stays
        return stays

    def step(self, k: int, byte: int) -> tuple[int, int]:
        seen, past = self.states[k]
        seen += bytes((byte,))
        for length, last, before in past:  # the last token begins at one place only
            token = seen[len(seen) - 1 - length :]
            own = self.ids_of.get(token)
            if own is not None and (last is None or self.follows(last, own)):
                break
        else:
            raise ValueError(f"no token ends {seen!r}")
        added = before + 1
        # of the places in the state's suffix, only those from which a token may go on matter
        past = (*((n + 1, t, c - added) for n, t, c in past if seen[len(seen) - 1 - n :] in self.prefixes), (0, own, 0))
        move = self._id((seen[len(seen) - past[0][0] :], past)), added
        self.moves[k][byte] = move
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > self.kept:
            self._clear()
        k = total = 0
        for byte in word:
            k, added = self.moves[k].get(byte) or self.step(k, byte)
            total += added
        return total


class _Words(dict):
    """Counts of words; of two generations, so that words in use stay when it's full."""

    def __init__(self, transducer: WordTransducer):
        self.transducer, self.old = transducer, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.transducer.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    def __init__(self, path: str):
        spec = json.load(open(path))
        model = spec["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(map(chr, [*plain, *(256 + i for i in range(256 - len(plain)))]), [*plain, *sorted(set(range(256)) - set(plain))]))
        raw = lambda token: bytes(map(shown.__getitem__, token))
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = _Words(WordTransducer([(raw(a), raw(b)) for a, b in merges]))

    def _pieces(self, text: str) -> tuple[list[str], int]:
        pieces = [text]
        for s in self.special:
            pieces = [x for p in pieces for x in p.split(s)]
        return pieces, len(pieces) - 1

    def _long(self, text: str) -> int:
        total, at, width = 0, 0, PIECE
        while at < len(text):
            part, last = text[at : at + width], at + width >= len(text)
            starts = self._starts([part])
            if not last:
                starts = starts[starts <= len(part) - 3]
                if len(starts) < 2:
                    width *= 2
                    continue
                ends, end = starts[1:], int(starts[-1])
                starts = starts[:-1]
            else:
                ends, starts, end = starts[1:], starts[:-1], len(part)
            total += sum(map(self.words.__getitem__, [part[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))
            at, width = at + end, PIECE
        return total

    @staticmethod
    def _starts(pieces: list[str]) -> np.ndarray:
        """Places where words start in the pieces joined by one character each, and the places of these and of the end."""
        codes = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = char_classes()[codes]
        classes[np.cumsum([len(p) + 1 for p in pieces]) - 1] = EOT
        return np.flatnonzero(word_starts(classes))

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        pieces: list[str] = []
        owner: list[int] = []
        out = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own, specials = self._pieces(text)
            out[i] += specials
            for p in own:
                if len(p) > PIECE:
                    out[i] += self._long(p)
                elif p:
                    pieces.append(p)
                    owner.append(i)
        if pieces:
            joined, starts = "\n".join([*pieces, ""]), self._starts(pieces)
            stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
            is_word = np.ones(len(starts), bool)
            is_word[np.searchsorted(starts, stops)] = False
            a, b = starts[is_word], starts[np.flatnonzero(is_word) + 1]
            counts = np.fromiter(map(self.words.__getitem__, [joined[i:j] for i, j in zip(a.tolist(), b.tolist())]), np.int64, len(a))
            np.add.at(out, owner, np.add.reduceat(counts, np.searchsorted(a, np.concatenate([[0], stops[:-1] + 1]))))
        return out.tolist()


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """id, n_bytes, n_tokens of each row, by the tokenizer file at `path` (there on each executor). One narrow pass, no shuffle."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(sizes, pa.int64()), pa.array(counter(path).count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
