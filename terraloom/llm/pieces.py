"""Operator 9, encoding and decoding with a piece vocabulary (byte-pair merges by score, byte fallback) in vectorised merge rounds.

Text is cut before each run of the space mark and between letters and others: no piece goes over such a place, so words are encoded one by one, and the words of a slice
that aren't known yet all at once: their symbols lie in one flat numpy array, each round finds for each word the best-scored pair there is,
merges it wherever it stands (leftmost first, not overlapping) and compacts the arrays, until no pair is left in any word. A pair whose piece
could at once go into a better or equally scored piece is merged only at its leftmost place in a round, so the result is that of merging one
pair at a time. Words longer than LONG symbols take such merges from a heap instead, which keeps them at n log n.

Cases: a null text is empty (begin and end ids only); long texts are encoded in blocks cut between words; any characters work, those not in
the vocabulary as bytes; repeated rows are repeated results; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, ship, slices

MARK = "▁"
WORDS = re.compile(rf"{MARK}*(?:[^\W\d_²]+|(?:(?![^\W\d_²])[^{MARK}])+)|{MARK}+")
CUT = re.compile(f"(?<!{MARK}){MARK}")
#: Words kept by a worker, characters of a block, symbols from which on a word's one-at-a-time merges go by heap.
KEPT_WORDS, BLOCK, LONG = 300_000, 1 << 20, 512
NONE = np.iinfo(np.int64).max


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = library.vocab_size()
        texts = [library.id_to_piece(i) for i in range(n)]
        kinds = ["byte" if library.is_byte(i) else "control" if library.is_control(i) or library.is_unknown(i) else "piece" for i in range(n)]
        if any(len(WORDS.findall(t)) > 1 for t, k in zip(texts, kinds) if k == "piece"):
            raise ValueError("a piece goes over the border of two words: words can't be encoded one by one")
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.bytes_id = [library.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == "piece"}
        order = {s: r for r, s in enumerate(sorted({library.get_score(i) for i in self.ids.values()}, reverse=True))}
        rank = {t: order[library.get_score(i)] for t, i in self.ids.items()}
        pairs, unsafe = [], set()
        for t, i in self.ids.items():
            for at in range(1, len(t)):
                if (left := self.ids.get(t[:at])) is not None and (right := self.ids.get(t[at:])) is not None:
                    pairs.append((left * n + right, rank[t], i))
                    unsafe.update(x for x, part in ((left, t[:at]), (right, t[at:])) if rank[part] >= rank[t])
        pairs.sort()
        self.pair_keys, self.pair_rank, self.pair_id = (np.array(x, np.int64) for x in zip(*pairs))
        self.pair_of = {k: (r, i) for k, r, i in pairs}
        self.unsafe = np.zeros(n, bool)
        self.unsafe[list(unsafe)] = True
        self.of_char = -1 - np.arange(0x110000)  # of characters that aren't pieces: minus the code point, less one
        for t, i in self.ids.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i
        # what an id decodes to, and whether it is text of its own
        self.raw = [bytes((int(t[3:5], 16),)) if k == "byte" else b"" if k == "control" else t.replace(MARK, " ").encode() for t, k in zip(texts, kinds)]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _heap(self, symbols: list[int]) -> list[int]:
        """One pair at a time, best score first, leftmost of equals."""
        n, size = len(symbols), self.size
        after, before, pairs = [*range(1, n), -1], [-1, *range(n - 1)], []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (p := self.pair_of.get(symbols[i] * size + symbols[j])):
                heapq.heappush(pairs, (p[0], i, j, symbols[i], symbols[j], p[1]))

        alive = [True] * n
        for i in range(n - 1):
            push(i)
        while pairs:
            _, i, j, a, b, merged = heapq.heappop(pairs)
            if not (alive[i] and alive[j] and after[i] == j and symbols[i] == a and symbols[j] == b):
                continue
            symbols[i], alive[j], after[i] = merged, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s, a in zip(symbols, alive) if a]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that begin at the places `at`; rank NONE where there is none."""
        left, right = symbols[at], symbols[np.minimum(at + 1, len(symbols) - 1)]
        good = (at + 1 < len(symbols)) & (left >= 0) & (right >= 0) & (word[at] == word[np.minimum(at + 1, len(symbols) - 1)])
        key = np.where(good, left * self.size + right, -1)
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_rank[k], NONE), self.pair_id[k]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank, merged = self._pairs(symbols, word, np.arange(len(symbols)))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():  # words with no pair left go out of the arrays
                out = np.repeat(over, sizes)
                ended.append((word[out], symbols[out]))
                word, symbols, rank, merged = word[~out], symbols[~out], rank[~out], merged[~out]
                best, sizes = best[~over], sizes[~over]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = word[places]
            leading = np.concatenate([[True], owner[1:] != owner[:-1]])
            heads = np.flatnonzero(leading)
            # in a word whose best pair isn't safe, the leftmost place only; else, of a run of overlapping places, each second one
            careful = np.repeat(np.maximum.reduceat(self.unsafe[merged[places]], heads), np.diff(np.append(heads, len(places))))
            start = np.concatenate([[True], places[1:] != places[:-1] + 1]) | leading
            offset = np.arange(len(places)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            slow = owner[careful & leading]
            if len(slow) and (sizes > LONG).any() and len(long := slow[np.isin(slow, word[np.cumsum(sizes)[sizes > LONG] - 1])]):
                for w in long.tolist():
                    whole = np.array(self._heap(symbols[word == w].tolist()), np.int64)
                    ended.append((np.full(len(whole), w), whole))
                rest = ~np.isin(word, long)
                word, symbols, rank, merged = word[rest], symbols[rest], rank[rest], merged[rest]
                continue
            places = places[np.where(careful, leading, offset % 2 == 0)]
            symbols[places] = merged[places]
            rest = np.ones(len(symbols), bool)
            rest[places + 1] = False
            changed = places - np.arange(len(places))  # where they are after compaction
            word, symbols, rank, merged = word[rest], symbols[rest], rank[rest], merged[rest]
            changed = np.unique(np.concatenate([changed, np.maximum(changed - 1, 0)]))
            rank[changed], merged[changed] = self._pairs(symbols, word, changed)
        word, symbols = np.concatenate([w for w, _ in ended]), np.concatenate([x for _, x in ended])
        order = np.argsort(word, kind="stable")
        word, symbols = word[order], symbols[order]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        flat = symbols.astype("<u4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        for w in np.unique(word[symbols < 0]).tolist():
            out[w] = self._ids(symbols[ends[w - 1] if w else 0 : ends[w]].tolist())
        return out

    def _ids(self, symbols: list[int]) -> bytes:
        ids: list[int] = []
        for s in symbols:
            ids.extend([s] if s >= 0 else [self.bytes_id[x] for x in chr(-1 - s).encode("utf-8", "surrogatepass")])
        return np.array(ids, "<u4").tobytes()

    def _block(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            pass
        kept = self.words
        if len(kept) >= KEPT_WORDS:
            self.old, self.words = kept, (kept := {})
        missing = set(words).difference(kept)
        kept.update((w, self.old[w]) for w in missing.intersection(self.old))
        new = list(missing.difference(kept))
        fresh = dict(zip(new, self.encode_words(new)))
        kept.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
        return b"".join([kept.get(w) or fresh[w] for w in words])

    def _blocks(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + BLOCK) if at + BLOCK < len(text) else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def learn(self, texts: list[str]) -> None:
        """Encode the words of all texts that aren't known, at once."""
        for t in texts:
            if len(t) > BLOCK:
                return
        self._block([w for t in texts if t for w in WORDS.findall(MARK + t.replace(" ", MARK))])

    def encode(self, text: str) -> bytes:
        """Ids of text with begin and end, as little-endian unsigned 32-bit integers."""
        body = MARK + text.replace(" ", MARK) if text else ""
        return b"".join([np.array([self.begin], "<u4").tobytes(), *(self._block(WORDS.findall(b)) for b in self._blocks(body)), np.array([self.end], "<u4").tobytes()])

    def decode(self, ids: bytes) -> str:
        """Text of ids: bytes that aren't UTF-8 become one replacement character each, the first mark's space goes."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "surrogatepass") if self._valid(raw) else self._repair(raw)
        return text[1:] if text.startswith(" ") else text

    @staticmethod
    def _valid(raw: bytes) -> bool:
        try:
            raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return False
        return True

    @staticmethod
    def _repair(raw: bytes) -> str:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(df: DataFrame, text_col: str, path: str, keep: list[str], ids: bool = False) -> DataFrame:
    """The columns `keep`, then n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded text. One narrow pass."""
    ship(df.sparkSession)
    columns = [F.col(text_col).cast("string").alias("__text"), *(col(k).alias(f"__{i}") for i, k in enumerate(keep))]
    chosen = df.select(*columns)
    more = ", __ids binary, __decoded string" if ids else ""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for start, texts in slices(batch.column(0)):
                m.learn(texts)
                coded = [m.encode(t) for t in texts]
                decoded = [m.decode(c) for c in coded]
                columns = [batch.column(i).slice(start, len(texts)) for i in range(1, batch.num_columns)]
                columns += [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded])]
                if ids:
                    columns += [pa.array(coded, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = "".join(f"`__{i}` {t}, " for i, (_, t) in enumerate(chosen.dtypes[1:]))
    schema = f"{kept}__n_tokens long, __ids_sha256 string, __decoded_sha256 string{more}"
    names = [*(f"__{i}" for i in range(len(keep))), "__n_tokens", "__ids_sha256", "__decoded_sha256", *(["__ids", "__decoded"] if ids else [])]
    out = chosen.mapInArrow(encode, schema)
    return out.select(*(F.col(f"__{i}").alias(k) for i, k in enumerate(keep)), *(F.col(n).alias(n[2:]) for n in names[len(keep) :]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
