"""The corpus operators against brute force, the tokenizers' own libraries, exact round trips and held-out accuracy."""

import bisect
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terraloom.llm import exact_dedup, fingerprints, language_id, mixing, pieces, pii, queries, simhash, token_counts, url_filter

from .conftest import DDL, ROWS

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_their_sql(spark, name):
    """Registered queries with SQL, on the smallest given tables."""
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(cursor.fetchall())


def test_registered_queries_on_rows(spark, folder):
    """The queries of tokenizers and of equal texts, as registered, on rows with nulls, repeats and long texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [(i, t or "") for i, t, *_ in ROWS]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = [len(e.ids) for e in library.encode_batch([t for _, t in texts], add_special_tokens=False)]
    out = queries.QUERIES["op3_token_counts"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == Counter((i, len(t.encode()), n, n > 512) for (i, t), n in zip(texts, sizes))
    pieces_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = pieces_of.encode([t for _, t in texts], add_bos=True, add_eos=True)
    out = queries.QUERIES["op9_sentencepiece"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), sha(pieces_of.decode(x))) for (i, _), x in zip(texts, ids))
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    top = lambda t: max((i for i in groups[t] if i is not None), default=None)
    out = queries.QUERIES["op2_exact_dedup"](spark, folder).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == Counter((i, top(t), len(groups[t]), sha(t)) for i, t in texts)
    assert sum(r.kept for r in out) == len(groups)
    out = queries.QUERIES["op5_fingerprints"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((i, len(t)) for i, t in texts)
    out = queries.QUERIES["op4_repeats"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((i, len(t.encode())) for i, t in texts)


# 1


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def test_url_rules(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    rng = random.Random(1)
    hosts = ["com", "example.com", "WWW.Example.COM", "aexample.com", "example.net", "b.net", "x.org", "com.org", "a.com:80", "", "spam-farm.example.org", "é.net"]
    urls = [f"{rng.choice(['http://', 'https://', '', 'x://y://'])}{rng.choice(hosts)}{rng.choice(['/', '', '?', '#', '/x'])}{rng.choice(['en/7', 'en/', 'de/8', 'de/', 'es/', 'a.com/en/7'])}{rng.choice(['', '1', '?q=/en/7', '#x', '/' * 300])}" for _ in range(600)]
    urls += [None, "", "://", "http://", "http://a.com/en/" + "z" * 20000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    for r in url_filter.judge(df, "url", url_filter.RULES, ["page_id"]).collect():
        url = urls[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule = brute_rule(host, path, rules)
        verdict = rule[2] if rule else "block" if ".spam-farm." in f".{host}{path}" else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[0] + rule[1], verdict)


def test_globs_over_several_words():
    rules = tuple(url_filter.Rule(f"*{i}?/a{'b' * (i % 7)}**c{i}", "block", i, str(i)) for i in range(40))
    urls = [f".host{i}x/a{'b' * (i % 7)}/zz/c{i}" for i in range(40)] + ["", "x" * 500]
    auto = url_filter.GlobAutomaton(rules)
    assert auto.words > 3
    patterns = [re.compile("".join({"*": "[^/]*", "**": ".*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", r.glob)) + r"\Z") for r in rules]
    want = [max((i for i, p in enumerate(patterns) if p.match(u)), default=-1) for u in urls]
    assert auto.match(urls).tolist() == want


# 2


def test_exact_dedup(spark, docs):
    located, result = exact_dedup.dedup(docs)
    out = result.collect()
    assert len(out) == len(ROWS)
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(i)
    for r in out:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).digest() == bytes(r.digest))
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    assert sum(r.kept for r in out) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_compares_bytes(spark, docs):
    """With a digest of four bits, classes are still those of equal texts."""
    located = exact_dedup.with_locator(docs)
    state = exact_dedup.ExactDedupState(spark, exact_dedup.work_path(spark, "weak"), digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1)))
    state.process_batch(located, 0)
    got = Counter((r.group_size, r.keep_id) for r in state.result().collect())
    state = exact_dedup.ExactDedupState(spark, exact_dedup.work_path(spark, "strong"))
    state.process_batch(located, 0)
    assert got == Counter((r.group_size, r.keep_id) for r in state.result().collect())


def test_exact_dedup_streams(spark, tmp_path):
    """Several micro-batches, then more files, and a repeated batch, give what one batch does."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None, "", f"t{i}"])) for i in range(60)]
    source, path = str(tmp_path / "in.parquet"), str(tmp_path / "state")
    spark.createDataFrame(rows[:40], "doc_id long, text string").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    exact_dedup.stream_dedup(spark, source, schema, path, files_per_batch=1)
    spark.createDataFrame(rows[40:], "doc_id long, text string").repartition(2).write.mode("append").parquet(source)
    state = exact_dedup.stream_dedup(spark, source, schema, path, files_per_batch=1)
    batch = exact_dedup.with_locator(spark.read.schema(schema).parquet(source)).where(F.col(exact_dedup.LOCATOR).contains("part-00000"))
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows)
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in state.result().collect()) == want
    assert batch.count() > 0


def test_exact_dedup_needs_earlier_texts(spark, tmp_path):
    """A second batch without the texts of the first, or with a locator that can't be found, is an error, not a wrong class."""
    frames = []
    for k in (1, 3):
        spark.createDataFrame([(k, "a"), (k + 1, f"b{k}")], "doc_id long, text string").write.parquet(f"{tmp_path}/{k}")
        frames.append(exact_dedup.with_locator(spark.read.parquet(f"{tmp_path}/{k}")))
    state = exact_dedup.ExactDedupState(spark, f"{tmp_path}/none")
    state.process_batch(frames[0], 0)
    with pytest.raises(ValueError):
        state.process_batch(frames[1], 1)
    state = exact_dedup.ExactDedupState(spark, f"{tmp_path}/some", content=frames[0].unionByName(frames[1]))
    for k, frame in enumerate(frames):
        state.process_batch(frame, k)
    assert sorted((r.id, r.keep_id, r.group_size) for r in state.result().collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]
    state = exact_dedup.ExactDedupState(spark, f"{tmp_path}/lost", content=frames[1])
    state.process_batch(frames[0], 0)
    with pytest.raises(Exception, match="no text at the locator"):
        state.process_batch(frames[1], 1)


# 3 and 9


def texts_for_tokenizers():
    rng = random.Random(3)
    alphabet = "ab 'rlevstmd\n\t1é, \u3000.\u2581中<"
    return [t or "" for _, t, *_ in ROWS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["<|endoftext|>a<|endoftext|>", " " * 700, "ab" * 900, "the in er on" * 300]


def test_token_counts(spark, docs, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = texts_for_tokenizers()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.TokenCounter(path)
    assert counter.count(texts) == want
    monkeypatch.setattr(token_counts, "PIECE", 40)
    assert [counter.count([t])[0] for t in texts[:200]] == want[:200]
    got = Counter((r.id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, "doc_id", "text", path).collect())
    assert got == Counter((i, len((t or "").encode()), n) for (i, t, *_), n in zip(ROWS, want))


def test_character_classes():
    """Letters and numbers are those of the library, over all code points."""
    import public_tokenizers
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    classes = token_counts.char_classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 10]
    for prefix, wanted in (("a", token_counts.LETTERS), ("1", {token_counts.NUMBER})):
        for k in range(0, len(points), 20000):
            part = points[k : k + 20000]
            starts = {x[1][0] for x in split.pre_tokenize_str("".join(f"{prefix}{chr(c)}\n" for c in part))}
            assert [c for i, c in enumerate(part) if (3 * i + 1 not in starts) != (int(classes[c]) in wanted)] == []


def test_small_transducer_cache(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "KEPT_WORDS", 5)
    counter = token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    counter.words.transducer.kept = 10
    texts = texts_for_tokenizers()[:60]
    assert counter.count(texts) == token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json")).count(texts)


def test_pieces(spark, docs, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = texts_for_tokenizers()
    want = library.encode(texts, add_bos=True, add_eos=True)
    model = pieces.PieceModel(path)
    for long in (pieces.LONG, 3):
        monkeypatch.setattr(pieces, "LONG", long)
        model.words.clear()
        assert [np.frombuffer(model.encode(t), "<u4").tolist() for t in texts] == want
    monkeypatch.setattr(pieces, "BLOCK", 7)
    assert [np.frombuffer(model.encode(t), "<u4").tolist() for t in texts[:300]] == want[:300]
    assert [model.decode(np.array(w, "<u4").tobytes()) for w in want] == library.decode(want)
    out = pieces.encode_texts(docs, "text", path, ["doc_id", "digest", "id"], ids=True).collect()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in out)
    assert got == Counter((i, len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(), sha(library.decode(w)), library.decode(w)) for (i, *_), w in zip(ROWS, want))


# 5


def test_fingerprints(spark, docs):
    rows = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for (i, t, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (Counter(fingerprints.digests(x).tolist()) for x in (t, new, after))
        alike = lambda x, y: 1 - sum(((x - y) + (y - x)).values()) / n if (n := x.total() + y.total()) else 1.0
        want[i, len(t), sha(new), round(alike(a, b), 9), round(alike(a, c), 9)] += 1
    for size in (4096, 3):
        df = fingerprints.successors(docs, rows=size)
        assert df.where("extra = 0").count() == len(ROWS)
    out = fingerprints.compare_versions(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == want
    same = defaultdict(set)
    text_of = {i: t or "" for i, t, *_ in ROWS}
    for r in out:
        same[text_of[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_in_ranges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for _ in range(300)]
    monkeypatch.setattr(fingerprints.successors, "__defaults__", ("doc_id", "text", 16))
    out = fingerprints.compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    want = Counter((i, sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2])) for (i, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == want


def test_fingerprints_of_one_hot_identifier(spark, monkeypatch):
    """Rows of one identifier, and of none, are divided among ranges too."""
    rows = [(7 if i % 3 else None, f"text {i}") for i in range(400)] + [(9, "last"), (1, "first")]
    monkeypatch.setattr(fingerprints.successors, "__defaults__", ("doc_id", "text", 16))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = fingerprints.successors(df).where("extra = 0").groupBy("part").count().collect()
    assert len(ranges) > 8 and max(r["count"] for r in ranges) < 100
    out = fingerprints.compare_versions(df).collect()
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1])))
    want = Counter((i, sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2])) for (i, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == want


def test_peeling_retries():
    rng = np.random.default_rng(5)
    left = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 3, 40, 2000)]
    right = [np.concatenate([x[: len(x) // 2], rng.integers(0, 1 << 63, 7, dtype=np.uint64)]) for x in left]
    for (a, b), x, y in zip(fingerprints.differences(left, right), left, right):
        assert a.tolist() == np.setdiff1d(x, y).tolist() and b.tolist() == np.setdiff1d(y, x).tolist()


# 6


def test_mixing(spark, docs):
    out = mixing.weighted(docs).select("doc_id", "__mix.*").collect()
    assert len(out) == len(ROWS)
    assert [r.tokens for r in out] == [len(re.split("[ \n\t]", t)) if t else 0 for _, t, *_ in ROWS]
    assert all(0 <= r.probability <= 1 for r in out)
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(r.sampled for r in out)


def test_mixing_query_on_documents(spark):
    """The registered query on the smallest given table, all columns by brute force: topics, tokens, marginals, probabilities and draws."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    targets = mixing.TARGETS

    def topic(t):
        n = max(len(t.encode()), 1)
        return next((k for k, chars, most in (("table", "|", 0.05), ("symbols", "%*&#$", 0.05), ("lists", "\n", 0.03)) if sum(map(t.count, chars)) > most * n), "prose")

    cells, sums = {}, Counter()
    for d in docs:
        t = d.text or ""
        cells[d.doc_id] = (d.source if d.source in targets["source"] else "*", d.lang if d.lang in targets["lang"] else "*", topic(t), len(re.split("[ \n\t]", t)) if t else 0)
        sums[cells[d.doc_id][:3]] += cells[d.doc_id][3]
    out = {r.doc_id: r for r in mixing.op6_mixing(spark, folder).collect()}
    assert {i: (r.source, r.lang, r.topic, r.n_tokens) for i, r in out.items()} == cells
    total = sum(sums.values())
    weight, chance = ({cells[i][:3]: r[k] for i, r in out.items()} for k in ("weight", "probability"))
    assert all(r.weight == weight[cells[i][:3]] and r.probability == chance[cells[i][:3]] for i, r in out.items())
    for axis, name in enumerate(targets):  # weights meet the targets of the levels that occur
        there = {v: s for v, s in targets[name].items() if any(c[axis] == v for c in sums)}
        for v, share in there.items():
            assert sum(n * weight[c] for c, n in sums.items() if c[axis] == v) / total == pytest.approx(share / sum(there.values()), abs=1e-3)
    # as many tokens as wanted are kept on average; a level below its share is kept whole, the others keep the shares that are left
    assert sum(n * chance[c] for c, n in sums.items()) / total == pytest.approx(mixing.BUDGET, abs=1e-6)
    for d in docs:
        h = xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest((d.text or "").encode(), xxhash.xxh64_intdigest(d.doc_id.to_bytes(8, "little", signed=True), h))
        assert out[d.doc_id].sampled == ((h >> 11) / float(1 << 53) < out[d.doc_id].probability)


def test_mixing_with_a_column_of_its_name(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "src0", i) for i in range(50)], "doc_id long, text string, lang string, source string, __mix long")
    out = mixing.draw(df)
    assert out.columns == df.columns and all(r.doc_id == r["__mix"] for r in out.collect())


def test_keep_columns_with_dots(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "http://a.com/en/", "x y")], "`doc.id` long, url string, text string")
    assert url_filter.judge(df, "url", url_filter.RULES, ["doc.id"]).collect()[0][0] == 1
    assert pieces.encode_texts(df, "text", public_tokenizers.path("piece_bpe_32k.model"), ["doc.id"]).collect()[0][0] == 1


def test_raking_fits_marginals():
    rng = random.Random(6)
    targets = {"source": {"a": 0.5, "b": 0.3, "*": 0.2}, "lang": {"en": 0.7, "*": 0.3}, "topic": {"x": 0.4, "y": 0.6}}
    cells = {(s, l, t): rng.randrange(1, 1000) for s in targets["source"] for l in targets["lang"] for t in targets["topic"]}
    factors = mixing.rake(cells, targets)
    total = sum(cells.values())
    for i, goal in enumerate(targets.values()):
        for level, share in goal.items():
            assert sum(n * factors[c] for c, n in cells.items() if c[i] == level) / total == pytest.approx(share, abs=1e-6)
    chance = mixing.calibrate(cells, factors, 0.3)
    assert sum(n * chance[c] for c, n in cells.items()) / total == pytest.approx(0.3, abs=1e-6)
    assert mixing.rake({}, targets) == {} and mixing.rake({("a", "en", "x"): 0}, targets) == {("a", "en", "x"): 1.0}


def test_calibration_rakes_again_under_the_cap():
    targets = {"source": {"a": 0.2, "*": 0.8}, "lang": {"en": 0.55, "de": 0.4, "*": 0.05}}
    cells = {("a", "en"): 100.0, ("a", "de"): 5.0, ("a", "*"): 5.0, ("*", "en"): 500.0, ("*", "de"): 300.0, ("*", "*"): 90.0}
    chance = mixing.calibrate(cells, mixing.rake(cells, targets), 0.6)
    kept = {c: n * chance[c] for c, n in cells.items()}
    assert all(0 <= p <= 1 for p in chance.values()) and sum(kept.values()) == pytest.approx(600, abs=1e-4)
    # source a has 110 tokens where 120 are wanted: all are kept, and the languages still have their shares
    assert sum(n for c, n in kept.items() if c[0] == "a") == pytest.approx(110, abs=1e-3)
    for lang, share in targets["lang"].items():
        assert sum(n for c, n in kept.items() if c[1] == lang) / 600 == pytest.approx(share, abs=1e-5)


# 7

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def passes(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if passes(k, m[0])] for k, p in BASE.items()}


def test_pii(spark, docs):
    rng = random.Random(7)
    parts = ["a.b@c.de", "@x", "1.2.3.4", "256.1.1.1", "4111111111111111", " 4111-1111-1111-1111", "+1 (23) 456-7890", "+", ".", "0", "é", " ", "card ", "x@y", "..z", "9" * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + [t for _, t, *_ in ROWS] + ["a" * 50000, "1" * 50000, "a." * 20000 + "@b.c", "+1 " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("email", F.lit(1))
    for r in pii.find(df).collect():
        want = brute_spans(texts[r.id] or "")
        assert {k: [(s.start, s.end) for s in r[k]] for k in BASE} == want
    found = {r.id: r for r in pii.find(docs).collect()}
    assert [s.end - s.start for s in found[9].iban] == [27, 22] and len(found[9].ssn) == 1
    assert [s.score for s in found[5].email] == [0.5] and found[9].iban[0].score == 1.0
    clean = {r.id: r.text for r in pii.redact(docs).collect()}
    assert "[email]" in clean[5] and "4111" not in clean[5] and clean[1] == ROWS[0][1]


def test_pii_of_many_matches(spark):
    """Over several chunks: places, and scores by the characters before, in close and far matches."""
    rng = random.Random(14)
    many = "".join(rng.choice(["a@b.co ", "contact x@y.de, ", "email ", "e" * 60 + " ", "-"]) for _ in range(4000))
    texts = [many, "q@w.e " * 20000]
    out = {r.id: r.email for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = [(m.start(), m.end(), 0.6 if re.search(r"\b(?:e-?mail|contact|write to)\b", text[max(0, m.start() - 48) : m.start()]) else 0.5) for m in re.finditer(BASE["email"], text)]
        assert [(s.start, s.end, s.score) for s in out[i]] == want
    clean = pii.redact(spark.createDataFrame([(1, many)], "doc_id long, text string"), kinds=("email",)).collect()[0].text
    assert clean == re.sub(BASE["email"], "[email]", many)


def test_pii_query(spark, folder):
    want = Counter()
    for i, t, *_ in ROWS:
        s = brute_spans(t or "")
        want[(i, *(len(s[k]) for k in BASE), sha(",".join(f"{k}:{a}:{b}" for k in BASE for a, b in s[k])))] += 1
    assert Counter(tuple(r[:6]) for r in pii.op7_pii(spark, folder).collect()) == want


# 8


def brute_fingerprint(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def test_simhash(spark, folder):
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in ROWS]
    roots = brute_components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min((i for i, f in fps if roots[f] == r and i is not None), default=None) for r in roots.values()}
    want = Counter((i, f"{f:016x}", least[roots[f]]) for i, f in fps)
    assert Counter(tuple(r) for r in simhash.op8_simhash(spark, folder).collect()) == want


def test_links_lose_nothing(spark):
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values):
        for _ in range(rng.randrange(4)):
            values.add(v := v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [v - (1 << 64 if v >> 63 else 0) for v in values]
    labels = {r.node & (1 << 64) - 1: r.label for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    roots = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    mine, theirs = defaultdict(set), defaultdict(set)
    for v in values:
        mine[labels.get(v, v)].add(v)
        theirs[roots[v]].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_bk_tree():
    rng = random.Random(9)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for r in (0, 2, 5):
        for q in values[:50]:
            assert sorted(tree.within(q, r)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= r]


def test_near_duplicates(spark, docs, monkeypatch):
    rng = random.Random(10)
    rows, base = [], [" ".join(rng.choice(["ba", "du", "ki", "lo", "me"]) + str(rng.randrange(500)) for _ in range(200)) for _ in range(40)]
    for i, t in enumerate(base):
        rows.append((10 * i, t))
        for k in range(rng.randrange(4)):
            w = t.split()
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = "new"
            rows.append((10 * i + k + 1, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one two"), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as node")

    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    roots = brute_components(range(len(rows)), lambda a, b: bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    groups = defaultdict(list)
    for k, r in roots.items():
        groups[r].append(rows[k][0])
    want = sorted(min((i is None, i or 0) for i in g) for g in groups.values())
    for tree in (simhash.TREE, 3):
        monkeypatch.setattr(simhash, "TREE", tree)
        out = simhash.keep_one(df)
        assert out.columns == df.columns
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        assert got == want
    assert simhash.keep_one(docs).count() == len({re.sub(r"\s+", " ", (t or "").lower()).strip() or i for i, t, *_ in ROWS})


def kept_by_brute_force(rows, similarity=0.8):
    def grams(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for _, t in rows]
    roots = brute_components(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))
    first = {}
    for k, r in roots.items():
        first[r] = min(first.get(r, rows[k][0]), rows[k][0])
    return sorted(first.values())


def repeated_line_rows():
    rng, rows = random.Random(21), []
    for i in range(12):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
        rows += [(2 * i, text), (2 * i + 1, text + "\n" + " ".join([" ".join(f"r{rng.randrange(10**6)}" for _ in range(10))] * 100))]
    return rows


def test_near_duplicates_of_far_fingerprints(spark, monkeypatch):
    rows = repeated_line_rows()
    far = [(simhash.signature(a.encode(), 5)[0] ^ simhash.signature(b.encode(), 5)[0]) & (1 << 64) - 1 for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert max(v.bit_count() for v in far) > simhash.REACH
    want = kept_by_brute_force(rows)
    assert want == list(range(0, 24, 2))
    for small in (simhash.SMALL, 1):  # pairs of small buckets; blocks
        monkeypatch.setattr(simhash, "SMALL", small)
        assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def light_and_heavy_edits(seed, words=800, variants=20, edits=2):
    """A base, variants of light edits, and one text just over the threshold to the base alone."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]

    def edit(places):
        w = list(base)
        for p in places:
            w[p] = f"e{rng.randrange(10**6)}"
        return " ".join(w)

    n, heavy = words - 4, 0
    while (n - 5 * (heavy + 1)) / (n + 5 * (heavy + 1)) >= 0.8:
        heavy += 1
    out = [" ".join(base)] + [edit(rng.sample(range(5, words - 5), edits)) for _ in range(variants)]
    heavy_text = edit(rng.sample(range(5, words - 5, 6), heavy))
    out.insert(rng.randrange(len(out) + 1), heavy_text)
    return out


def test_near_duplicates_beyond_the_nearest(spark):
    # in these families the nearest by fingerprint is under the threshold, and another member over it
    rows = list(enumerate(t for seed in (2, 3, 5, 15) for t in light_and_heavy_edits(seed)))
    want = kept_by_brute_force(rows)
    assert len(want) == 4
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    rows = list(enumerate(t for seed in (2, 3) for t in light_and_heavy_edits(seed)))
    want = kept_by_brute_force(rows)
    monkeypatch.setattr(simhash, "TREE", 3)
    monkeypatch.setattr(simhash, "PART", 4000)
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


# 10


def test_language_id(spark, docs):
    words = {"en": "the and of to in that was for with this", "de": "der die und das nicht ist ein zu den mit", "fr": "le la les des une est dans pour que pas"}
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(5, 80))).title(), lang) for i in range(300) for lang in [rng.choice(list(words))]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, "the and of", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = language_id.sample(df)
    assert [m[0] for m in model] == ["de", "en", "fr"]
    out = {r.doc_id: r for r in language_id.identify(df, model, ["doc_id", "lang"]).collect()}
    held = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == out[i].lang for i in held) >= 0.98 * len(held)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language_id.identify(df, (), ["doc_id"]).collect()} == {"und"}
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def brute_phrases(source, coded):
    """Greedy longest matches, by binary search among the sorted suffixes of the sample."""
    suffixes = sorted(source[i:] for i in range(len(source)))
    phrases = i = 0
    while i < len(coded):
        rest, n = coded[i : i + 4000], 0
        at = bisect.bisect_left(suffixes, rest)
        for s in suffixes[max(at - 1, 0) : at + 1]:
            n = max(n, len(os.path.commonprefix([s, rest])))
        phrases, i = phrases + 1, i + max(n, 1)
    return phrases


def coded(model, k, text):
    return "".join(map(chr, model.symbol[k][model._letters([text])[0]].tolist()))


@pytest.mark.parametrize("piece", [2048, 5, 1])
def test_cross_parsing_counts_longest_matches(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    sample = "abracadabra abra cadabra"
    model = language_id.LanguageModel((("x", sample),))
    rng = random.Random(13)
    texts = ["abrab cadax zzabra", "", "a", "zz", "abracadabra abra cadabra" * 3, *("".join(rng.choice("abrcd z") for _ in range(rng.randrange(300))) for _ in range(40))]
    flat, lengths = model._letters(texts)
    assert model.phrases(0, flat, lengths).tolist() == [brute_phrases(coded(model, 0, sample), coded(model, 0, t)) for t in texts]


def test_language_id_query_on_documents(spark):
    """The registered query on the smallest given table: phrases of whole texts, labels and scores by brute force."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sample = language_id.sample(docs)
    model = language_id.LanguageModel(sample)
    sources = [coded(model, k, t) for k, (_, t) in enumerate(sample)]
    suffixes = [sorted(s[i : i + 4000] for i in range(len(s))) for s in sources]
    out = language_id.op10_language_id(spark, folder).collect()
    assert len(out) == docs.count() and {r.doc_id for r in out} == set(texts)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in out if r.held_out and r.lang_pred != "und" and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in sorted(out, key=lambda r: len(texts[r.doc_id] or ""))[::5]:
        text = texts[r.doc_id] or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        rates = []
        for k, bits in enumerate(model.bits):
            symbols, phrases, i = coded(model, k, text), 0, 0
            while i < len(symbols):
                rest = symbols[i : i + 4000]
                at = bisect.bisect_left(suffixes[k], rest)
                n = max((len(os.path.commonprefix([s, rest])) for s in suffixes[k][max(at - 1, 0) : at + 1]), default=0)
                phrases, i = phrases + 1, i + max(n, 1)
            rates.append(phrases * bits / len(symbols))
        first, second = sorted(rates)[:2]
        assert r.lang_pred == model.languages[rates.index(first)] and r.score == pytest.approx(1 - first / second)


def test_language_sample_is_bounded(spark, monkeypatch):
    """Rows of one repeated identifier, and more languages than any fixed number, stay within the bound; no label is left out."""
    monkeypatch.setattr(language_id, "CHARS", 50)
    rows = [(1, f"abc {i} def", "en") for i in range(600)] + [(i, f"wort {i}", f"l{i % 90:02}") for i in range(2000, 2400)] + [(7, "x" * 500, "en"), (8, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = dict(language_id.sample(df))
    assert set(sample) == {lang for i, t, lang in rows if t and zlib.crc32(str(i).encode()) % 4 != 2} and len(sample) > 64
    assert all(sum(c != "\n" for c in t) <= 50 for t in sample.values())


def test_keep_known_without_labels(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "12 - 3", None), (4, "été", None), (5, "", None)]
    out = language_id.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert out.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in out.collect()) == [1, 4]
