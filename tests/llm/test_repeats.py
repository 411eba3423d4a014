"""Repeated byte strings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terraloom.llm import passages, repeats

from .conftest import ROWS


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    words = ["ba", "du", "ki", "lo", "me", "é", "中"]
    prose = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    shared = [prose(rng.randrange(30, 200)) for _ in range(5)]
    texts = [prose(rng.randrange(0, 120)) + rng.choice(["", *shared]) + prose(rng.randrange(0, 120)) + rng.choice(["", "", *shared]) for _ in range(60)]
    line = prose(20)
    texts += [texts[0], texts[1], texts[1][3:], texts[2][:-5] + "!", "ab" * 900, "x" * 399, "x" * 400, "x" * 3000, (line + "\n") * 30, (line + "\n") * 12 + "end", "abc" * 200 + prose(150) + "abc" * 200, "", None]
    for n in (398, 399, 400, 401, 402, 450, 500):  # passages about the length itself, between different texts
        common = prose(300)[:n]
        texts += [prose(90) + common + prose(90), prose(90) + common + prose(90)]
    return texts


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_repeats(spark, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "STEP", 2 * piece * repeats.CODES)
    texts = corpus()
    # functions that a worker imports by name would not see the changed bounds: run the steps here
    raw = [(t or "").encode() for t in texts]
    core, span, owner, item = repeats.class_records(raw)
    by_core, by_span = Counter(core.tolist()), Counter(zip(core.tolist(), span.tolist()))
    kinds = Counter(c for c, _ in by_span)
    found = [[] for _ in raw]
    wanted = [[] for _ in raw]
    seen = set()
    for c, s, o, i in zip(core.tolist(), span.tolist(), owner.tolist(), item.tolist()):
        if by_core[c] > 1 and by_span[c, s] > 1:
            found[o].append(i)
        if kinds[c] > 1 and (c, s) not in seen and i % repeats.CODES != repeats.BARE:
            wanted[o].append(i)
            seen.add((c, s))
    import numpy as np

    core, name, owner, item = repeats.window_records(raw, [np.array(x, np.int64) for x in wanted])
    again = Counter(zip(core.tolist(), name.tolist()))
    for c, n, o, i in zip(core.tolist(), name.tolist(), owner.tolist(), item.tolist()):
        if again[c, n] > 1:
            found[o].append(i)
    masks = repeats.remove(raw, [np.array(x, np.int64) for x in found])
    got = [(len(t), int(m.sum()), int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()) for t, m in zip(raw, masks)]
    assert got == brute(raw, repeats.LENGTH)


def test_repeats_in_spark(spark, docs):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item", F.lit(1)).repartition(3)
    out = {r.id: tuple(r[1:5]) for r in repeats.dedup_bytes(df).collect()}
    assert [out[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], repeats.LENGTH)
    got = Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup_bytes(docs, texts=True).collect())
    assert got == Counter((i, *b) for (i, *_), b in zip(ROWS, brute([(t or "").encode() for _, t, *_ in ROWS], repeats.LENGTH)))


def brute_shared(rows, words=50):
    """Words in windows of `words` words that a row of another (id, text) has too."""
    split = [(k, re.findall(rb"[^ \t-\r]+", k[1])) for k in rows]
    where = defaultdict(set)
    for k, w in split:
        for i in range(len(w) - words + 1):
            where[tuple(w[i : i + words])].add(k)
    out = []
    for k, w in split:
        hit = [False] * len(w)
        for i in range(len(w) - words + 1):
            if len(where[tuple(w[i : i + words])]) > 1:
                hit[i : i + words] = [True] * words
        out.append(sum(hit))
    return out


def test_shared_passages(spark):
    rng = random.Random(41)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(prose(rng.randrange(200))) for _ in range(30)]
    for n in (48, 49, 50, 51, 52, 97, 160):  # passages about the length, with other white space and other neighbours
        common = prose(n)
        texts += [" ".join(prose(70) + common + prose(60)), "  ".join(prose(5) + common) + "\n" + "\t".join(prose(80))]
        if n > 50:
            texts += [" ".join(common[: n // 2] + ["other"] + common[n // 2 :]), " ".join(common[1:])]
    line = prose(30)
    own = " ".join(line * 8)  # repeated inside one document alone
    texts += [own, texts[0], texts[1] + " end", " ".join(["same"] * 400), " ".join(["same"] * 60 + prose(10)), " ".join(line * 2 + prose(90)), "x " * 49, "x " * 50, "", None]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[3]), (None, texts[4] + " more")]
    want = Counter(zip((i for i, _ in rows), brute_shared([(i, (t or "").encode()) for i, t in rows])))
    assert sum(n > 0 for _, n in want) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shared", F.lit(1)).repartition(3)
    assert Counter((r.id, r.n_shared_words) for r in repeats.dedup_bytes(df).collect()) == want


def boilerplate(rng, n):
    """Texts of one long license line each, most of them under LENGTH bytes: their cores are repeated, few of their windows are."""
    prose = lambda k: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    lines = [prose(80)[:size] for size in (345, 370, 395, 420)]
    return [prose(60) + " " + rng.choice(lines) + " " + prose(60) for _ in range(n)]


def test_rows_of_steps(spark, monkeypatch):
    """A step writes a row for each class or run of windows; a row for each window took most of the time of large tables."""
    texts = boilerplate(random.Random(43), 120)
    written = {}

    def counted(df, name, keep=repeats.materialise):
        out = keep(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "materialise", counted)
    monkeypatch.setattr(passages, "materialise", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.id: tuple(r[1:5]) for r in repeats.dedup_bytes(df).collect()}
    assert [out[i] for i in range(len(texts))] == brute([t.encode() for t in texts], repeats.LENGTH)
    assert sum(written.values()) < sum(map(len, texts)) / 10, written


def test_remove_names_nothing_again(monkeypatch):
    """Items are places, so what is found is removed without the names of the texts (periodic windows aside)."""
    raw = [t.encode() for t in boilerplate(random.Random(44), 2)] * 2
    core, span, owner, item = repeats.class_records(raw)
    import numpy as np

    monkeypatch.setattr(repeats, "Windows", None)
    masks = repeats.remove(raw, [item[owner == i].astype(np.int64) for i in range(len(raw))])
    assert all(m.all() for m in masks)


@pytest.mark.parametrize("most", [1, 1 << 12])
def test_frequent_values(spark, monkeypatch, most):
    """Tasks that get more than they may hold leave their rows to Spark's groupings; so do some of them, at 4 kB."""
    for module in (repeats, passages):
        monkeypatch.setattr(module, "MOST_CLASSES", most)
    monkeypatch.setattr(repeats, "MOST_NAMES", most)
    texts = corpus() + boilerplate(random.Random(45), 20)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.id: tuple(r[1:]) for r in repeats.dedup_bytes(df).collect()}
    want = brute([(t or "").encode() for t in texts], repeats.LENGTH)
    shared = brute_shared([(i, (t or "").encode()) for i, t in rows])
    assert [out[i] for i in range(len(texts))] == [(*w, s) for w, s in zip(want, shared)]
    assert sum(s > 0 for s in shared) > 20


def test_shared_passages_repeated_inside(spark):
    """A passage that a text has twice, and another text in part: all its copies count."""
    rng = random.Random(46)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    common, whole = prose(70), prose(55)
    texts = [" ".join(prose(20) + common + prose(30) + common + prose(9) + common), " ".join(common[8:] + prose(40)), " ".join((whole + prose(3)) * 3), " ".join(prose(4) + whole)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.n_shared_words for r in repeats.dedup_bytes(df).collect()} == dict(enumerate(brute_shared([(i, t.encode()) for i, t in rows])))
