"""Every operator and pipeline stage on nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import decontamination, embedding_dedup, jaccard_join, language_id, mixing, personal_data, quality, secret_scan, token_tables, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "size", "n", "tokens", "order", "bucket", "hits", "items", "cid", "rid", "set", "token", "comp", "key", "copies", "position", "label", "v", "h", "score_", "found", "run", "w"]
LONG = "Lorem ipsum dolor sit amet " * 4000


def rows():
    rng = random.Random(8)
    words = lambda k: " ".join(rng.choice("river stone window garden letter number seven market".split()) + str(rng.randint(0, 50)) for _ in range(k))
    some = [(i, words(rng.randint(5, 60)), "en", f"s{i % 3}", 1) for i in range(40)]
    odd = [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \n\t ", "en", "s1", 1), (103, LONG, "en", "s1", 1), (103, LONG, "en", "s1", 1), (None, "no id here at all", None, None, None), (None, None, None, None, None), (104, some[0][1], "en", None, 3)]
    return [*some, *odd]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    clashing = docs.withColumns({c: F.lit(None).cast("string") if k % 2 else F.lit(k) for k, c in enumerate(CLASH)})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, None), (4, 7, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, rows()[1][1]), (0, rows()[1][1]), (1, None), (None, "one two three"), (2, ""), (3, "alpha beta")], "item_id long, text string")
    return docs, clashing, labels, bench


def operators(labels, bench):
    return {
        "mix": lambda d: mixing.ordered(mixing.mix(d)), "apply_mix": mixing.apply_mix, "quality": lambda d: quality.score(d, quality.fit(d, labels)), "secrets": secret_scan.scan_secrets,
        "personal": personal_data.scan_personal_data, "redact": personal_data.redact, "language": lambda d: language_id.label(d, language_id.fit(d)), "decontaminate": lambda d: decontamination.judged(decontamination.scan(d, bench)),
        "jaccard": jaccard_join.similar, "tables": token_tables.written, "keep_one": jaccard_join.keep_one, "keep_good": lambda d: quality.keep_good(d, labels), "clean": lambda d: decontamination.decontaminate(d, bench),
    }


NAMES = ["mix", "apply_mix", "quality", "secrets", "personal", "redact", "language", "decontaminate", "jaccard", "tables", "keep_one", "keep_good", "clean"]
WHOLE = ["mix", "quality", "secrets", "personal", "redact", "language", "decontaminate", "jaccard", "tables"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, tables, name):
    docs, clashing, labels, bench = tables
    f = operators(labels, bench)[name]
    plain, extra = f(docs).collect(), f(clashing).collect()
    own = [c for c in f(docs).columns if c not in ("position", "positions", "order")]
    view = lambda got: sorted(repr([r[c] for c in own]) for r in got)
    assert view(plain) == view(extra)
    if name in WHOLE:
        assert len(plain) == len(rows())
    assert f(docs.where("false")).count() == 0


def test_values_of_odd_texts(tables):
    docs, _, labels, bench = tables
    found = operators(labels, bench)
    pick = lambda name, *c: {r["doc_id"]: tuple(r[x] for x in c) for r in found[name](docs).collect()}
    assert pick("mix", "size", "taken")[100] == (0, 0) and pick("mix", "size")[103] == (20_000,)
    scores = pick("quality", "score")
    assert scores[100] == scores[101] and 0 <= scores[100][0] <= 1
    assert pick("language", "lang_pred", "score")[100] == ("und", 0.0) and pick("language", "lang_pred")[103] == ("en",)
    hits = pick("decontaminate", "n_words", "n_hit", "contaminated")
    assert hits[100] == (0, 0, False) and hits[1][2] and hits[103][0] == 20_000
    near = pick("jaccard", "n_shingles", "component_id")
    assert near[100] == (0, 100) and near[101] == (0, 101) and near[104][1] == 0 and near[103] == (5, 103)
    tokens = pick("tables", "n_tokens")
    assert tokens[100] == (1,) and tokens[101] == (1,) and tokens[103][0] > 20_000


def test_scores_without_labels(tables):
    docs, _, labels, _ = tables
    for some in (labels.where("false"), labels.where("quality = 1")):
        assert {r["score"] for r in quality.score(docs, quality.fit(docs, some)).collect()} == {0.5}
        assert quality.keep_good(docs, some).count() == len(rows())


def test_quality_against_a_plain_version(tables):
    """The score from features that a loop counts, and a gradient that has vanished."""
    docs, _, labels, _ = tables
    texts = ["A b, c!\nA b, c!", "", "x" * 70, LONG[:500]]
    for t in texts:
        got = quality.features(t.encode())
        n, w, lines = len(t.encode()), t.split(), t.split("\n")
        if not t:
            assert not got.any()
            continue
        assert got[0] == sum(c.isdigit() for c in t) / n and got[1] == sum("A" <= c <= "Z" for c in t) / n
        k = (quality.N_FEATURES - 12) // 2
        assert np.allclose(got[2 * k : 2 * k + 5], [np.log1p(len(w)), np.log1p(len(lines)), sum(map(len, w)) / len(w) / 10, len(set(w)) / len(w), len(set(lines)) / len(lines)])
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 4)), (rng.random(200) < 0.5).astype(int)
    x[:, 0] += 2 * y
    m = quality.Ranking.fit(x, y, pairs=4000)
    z = np.clip((x - m.mean) / m.scale, -6, 6)
    draw = np.random.default_rng(5)
    d = z[draw.choice(np.flatnonzero(y == 1), 4000)] - z[draw.choice(np.flatnonzero(y == 0), 4000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    assert all(loss(m.weights) <= loss(m.weights + 1e-3 * e) + 1e-12 for e in (*np.eye(4), *-np.eye(4)))
    s = m.scores(x, 0.3)
    assert np.isclose((s >= 0.3).mean(), (y == 1).mean(), atol=0.02) and s[y == 1].mean() > s[y == 0].mean()


def test_languages_that_no_script_fits(spark):
    docs = spark.createDataFrame([(k, t, lang, "s", 0) for k, (t, lang) in enumerate([("the cat sat there", "en"), ("der Hund lief dort", "de")] * 5 + [("\u4f60\u597d \u4e16\u754c", None), ("the \u4f60 cat", None)])], DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.label(docs, language_id.fit(docs)).collect()}
    assert got[10] == ("de", 0.0) and got[11][0] == "en" and got[11][1] == pytest.approx(6 / 7)


def test_context_is_whole_words():
    assert personal_data.score("the hotel +49 30 1234567", "phone", 10, 24) < personal_data.score("the tel +49 30 1234567", "phone", 8, 22)
    assert personal_data.score("recipe 10.0.0.1", "ip", 7, 15) < personal_data.score("IP: 10.0.0.1", "ip", 4, 12)


def test_personal_data_against_plain_regexes():
    """The base kinds by the contract's patterns, on random strings of their alphabets."""
    import re

    rng = random.Random(5)
    card = lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and personal_data.luhn(re.sub("[^0-9]", "", m))
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", card), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    }
    for _ in range(3000):
        text = "".join(rng.choice("0123456789 .-+@()ab") for _ in range(rng.randint(0, 60))) + rng.choice(["", " 4111 1111 1111 1111", " a@b.co", "1.2.3.4.5", "+49 (30) 123-45"])
        got = [(k, a, b) for k, a, b, _ in personal_data.find(text) if k in kinds]
        assert got == [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_secrets_of_long_documents_take_linear_time(spark):
    import time

    scanner = secret_scan.Scanner()
    took = []
    for k in (200, 1600):
        text = ("filler words go on and on. " * 40 + "token=abcdefgh1 \n") * k
        t = time.process_time()
        assert len(scanner.scan([text.encode()])[0]) == k
        took.append(time.process_time() - t)
    assert took[1] < 24 * max(took[0], 0.05)


def test_vectors_odd(spark):
    v = [1.0, 0.0, 0.0]
    rows_ = [(1, v, 0), (1, v, 0), (2, v, 0), (3, [2.0, 0.0, 0.0], 0), (None, v, 0), (4, v, None), (5, None, 0), (6, [0.0] * 3, 0), (7, [float("nan")] + [0.0] * 2, 0), (8, [None, 1.0, 1.0], 0), (9, [1.0, 0.0], 0), (10, [], 0), (11, v, 1)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int").withColumns({"cid": F.lit(1), "mark": F.lit("x"), "id": F.lit(2), "dim": F.lit(0)})
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows_)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, False), *((k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11))}
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicates(df.withColumn("vec_id", df.vec_id.cast("string")))


def test_pages_odd(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x://a.net/", ""), (2, "", "<title>a"), (3, "://", None)], "page_id long, url string, html string").withColumns({c: F.lit("c") for c in ("run", "gain", "host_", "w", "n")})
    got = url_filter.judge(pages).collect()
    assert sorted((r.page_id or 0, r.host, r.rule or "", r.verdict) for r in got) == [(0, "a.net", "net/", "block"), (1, "", "", "allow"), (1, "", "", "allow"), (2, "", "", "allow"), (3, "", "", "allow")]


def test_stages_one_by_one(spark, tables, tmp_path):
    """Each stage against what a plain version makes of its input; nulls, repeats and extra columns go through."""
    docs, _, labels, bench = tables
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf, columns = str(tmp_path), docs.columns
    stage = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    scores = quality.score(docs, quality.fit(docs, labels)).collect()
    good = stage["quality_classifier"](spark, docs, sf)
    assert good.columns == columns and key(good) == sorted(repr(tuple(r)[:5]) for r in scores if r["score"] >= 0.3)

    sets = {}
    for r in docs.collect():
        w = (r.text or "").lower().split()
        sets.setdefault(r.doc_id, set()).update(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w)
    known = [i for i in sets if i is not None]
    root = {i: i for i in known}
    for a in known:
        for b in known:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = {k: min(root[a], root[b]) if r in (root[a], root[b]) else r for k, r in root.items()}
    one = stage["near_duplicates"](spark, docs, sf)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted({root[i] for i in known}) and one.where("doc_id is null").count() == 2

    clean = stage["benchmark_decontamination"](spark, docs, sf)
    dirty = rows()[1][1]
    assert clean.columns == columns and key(clean) == sorted(repr(tuple(r)) for r in docs.collect() if r.text != dirty)

    mixed = stage["source_mix"](spark, docs, sf)
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.size] = copies.get((r.doc_id, r.size), 0) + r.copies
    got = {}
    for r in mixed.collect():
        k = (r.doc_id, len((r.text or "").split()))
        got[k] = got.get(k, 0) + 1
    assert mixed.columns == columns and got == {k: c for k, c in copies.items() if c}

    out = stage["token_output"](spark, docs, sf).collect()
    t = token_tables.encoder(token_tables.default_tokenizer()).tokenizer
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    want = sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in out) == want
    assert corpus_pipeline.run(spark, sf).count() > 0
