"""The pipeline's stages one after the other against brute force on a small table."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraloom.llm import mixing

WORDS = {"en": "the and of to in that was for with this have from they been were", "de": "der die und das nicht ist ein zu den mit auf eine sich auch", "fr": "le la les des une est dans pour que pas sur avec plus sont"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, base = [], []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        base.append((" ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(rng.randrange(20, 150))), lang))
    for t, lang in base:
        rows.append((len(rows), t, lang, rng.choice(["src0", "src1", None])))
        if rng.random() < 0.2:
            rows.append((len(rows), t, lang, "src0"))
        if rng.random() < 0.3:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w), lang, "src2"))
    rows += [(len(rows), None, "en", "src0"), (len(rows) + 1, "", None, None), (len(rows) + 2, "123 %%", "en", "src1")]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def after_dedup(rows):
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    largest = {}
    for r in lettered:
        largest[r[1]] = max(largest.get(r[1], r), r, key=lambda x: x[0])
    left = sorted(largest.values(), key=lambda r: r[0])
    sets, label = [shingles(r[1]) for r in left], list(range(len(left)))
    changed = True
    while changed:
        changed = False
        for i in range(len(left)):
            for j in range(i):
                if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    groups = defaultdict(list)
    for r, k in zip(left, label):
        groups[k].append(r)
    return sorted((min(g, key=lambda r: r[0]) for g in groups.values()), key=lambda r: r[0])


def test_stages(spark, tables, tmp_path):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = after_dedup(rows)
    assert sorted(r.doc_id for r in docs.collect()) == [r[0] for r in want]
    # the fourth: shares of tokens among cells, and the hash of each row
    cells = defaultdict(float)
    cell = lambda r: (r[3] if r[3] in mixing.TARGETS["source"] else "*", r[2] or "*", "prose")
    for r in want:
        cells[cell(r)] += len(r[1].split(" "))
    full = {n: t if "*" in t else t | {"*": 0.0} for n, t in mixing.TARGETS.items()}
    chance = mixing.calibrate(dict(cells), mixing.rake(dict(cells), full), mixing.BUDGET)
    draws = {r[0]: r[1] for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), 11) / float(1 << 53)).collect()}
    kept = {r[0] for r in want if draws[r[0]] < chance[cell(r)] - 1e-9}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, path)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == kept


def test_run(spark, tables):
    import public_tokenizers
    import sentencepiece

    path, rows = tables
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, path).collect()
    texts = {r[0]: r[1] for r in rows}
    assert out and {r.doc_id for r in out} <= {r[0] for r in after_dedup(rows)}
    for r in out:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
