"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on nulls, empty tables, ties,
long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import components, decontamination, embedding_dedup, jaccard_join, language_id, mixing, personal_data, quality, secret_scan, token_tables, url_filter

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None)], DOCS)


ODD = [None, "", "   \n", "one two", "x" * 50_000, "a b c d e f g h", "a b c d e f g h", "é ü ß 中文 \U0001f600 end"]


def test_mix_against_brute_force(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "w " * rng.randint(0, 30), None, rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(600)], DOCS)
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([sizes[s] for s in order], [1, 2, 3, 1], sum(sizes.values()), 3)
    for s, t in zip(order, targets, strict=True):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - t) <= 1 and own[0].target == pytest.approx(t) and own[0].source_size == sizes[s]
    assert all(r.taken <= 3 * r.size for r in rows) and len(rows) == 600
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    # Inside a source the training time follows the source's order.
    a = sorted((r.bucket, r.order, r.position) for r in rows if r.source == "a" and r.position is not None)
    assert [x[2] for x in a] == sorted(x[2] for x in a)
    copies = {r.doc_id: r.copies for r in rows}
    out = mixing.apply_mix(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {k: v for k, v in copies.items() if v}
    assert mixing.water_fill([10, 100], [9, 1], 110, 3) == [30.0, 80.0]
    assert mixing.mix(docs.where("false")).count() == 0


def test_mix_schedule_moves_a_source_in_time(spark):
    docs = spark.createDataFrame([(i, "w w w", None, "ab"[i % 2], 0) for i in range(200)], DOCS)
    rows = mixing.mix(docs, schedules={"a": (1.0, 0.0), "b": (0.0, 1.0)}).collect()
    mean = {s: np.mean([r.position for r in rows if r.source == s and r.position is not None]) for s in "ab"}
    assert mean["a"] < 0.45 < 0.55 < mean["b"]


def test_every_reading_has_its_training_position(spark):
    docs = spark.createDataFrame([(i, "w w w", None, "a" if i < 20 else "b", 0) for i in range(200)], DOCS)
    rows = mixing.readings(mixing.mix(docs, schedules={"a": (1.0,), "b": (1.0,)})).collect()
    a = [r for r in rows if r.source == "a"]
    assert len(a) == 60 and sum(r.words for r in a) == 180 and sum(r.words for r in rows) == 600
    for k in range(3):  # both sources are read at an even pace, so each reading of a takes a third of the time
        own = [r.position for r in a if r.reading == k]
        assert len(own) == 20 and k / 3 - 0.01 <= min(own) and max(own) < (k + 1) / 3 + 0.01
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_quality_held_out(spark):
    rows = quality.op2(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95
    docs, none = docs_of(spark, ODD), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == len(ODD) + 1 and quality.keep_good(docs, none).columns == docs.columns


def test_quality_learns_from_every_label(spark, monkeypatch):
    """Labels beyond any sample move the model, and it is that of all pairs of each block."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["abc", "Abc", "12", "!", "x."]) for _ in range(rng.randint(1, 30))) + ("!?" * rng.randint(0, 3) if i % 3 == 0 else "") for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(1500)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    x = np.array([quality.features(t.encode()) for t in texts])
    y = np.arange(1500) % 3 != 0
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, np.where(x.std(0) < 1e-9, 1, x.std(0)))
    s = np.clip((x - m.mean) / m.scale, -6, 6) @ m.weights
    assert np.isclose(m.cut, np.quantile(s, 1 / 3)) and np.isclose(m.spread, s.std())
    monkeypatch.setattr(quality, "MOST_SORTED", 5)
    assert np.isclose(quality.fit(docs, labels).cut, m.cut, rtol=0, atol=1e-12)
    monkeypatch.setattr(quality, "BLOCK", 5000)
    whole = quality.fit(docs, labels)
    z = np.clip((x - whole.mean) / whole.scale, -6, 6)
    good, bad = z[y] @ whole.weights, z[~y] @ whole.weights
    p = 1 / (1 + np.exp(good[:, None] - bad[None]))
    slope = (p.sum(0) @ z[~y] - p.sum(1) @ z[y]) / p.size + 1e-3 * whole.weights
    assert np.abs(slope).max() < 1e-6


def test_quality_of_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 16)
    docs = spark.createDataFrame([(i, "!!! ??? " * 3 if i < 3 else f"some words {i} and more") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 3)) for i in range(400)], "doc_id long, quality int")
    rows = quality.described(quality.training_rows(docs, labels, None, id_col="doc_id", text_col="text", label_col="quality"))
    blocks = quality.in_blocks(rows, 400, 0, 3).collect()
    assert all(b["y"].count(0) == 3 for b in blocks) and sum(sum(b["own"]) for b in blocks) == 400
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert max(got[i] for i in range(3)) < min(got[i] for i in range(3, 400))


def test_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "HTTP://Sub.Example.NET/en/x?q#f", "http://example.net", "http://a.net/", "x://b.example.com/de/1", "http://org/fr/", "http://cheappills.example.org/en", "http://news.example.org/en/2#t", "http://notnet/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r, _ in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert rule is None or got[i].verdict == dict(url_filter.RULES)[rule]
    assert got[8].verdict == "block" and got[9].verdict == "allow" and got[0].verdict == "allow"


def test_urls_with_long_runs_and_without_a_host(spark):
    urls = ["http://" + "cheappills" * 40 + ".example.org/x", "file:///cheappills", "file:///news", "x://"]
    title = "<title>" + "cheap pills other " * 300 + "</title>"
    pages = spark.createDataFrame([(i, u, title) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert url_filter.judge(pages.where("false")).count() == 0 and url_filter.judge(pages.union(pages)).count() == 8
    assert [got[i].verdict for i in range(4)] == ["block", "block", "allow", "allow"] and got[3].url_score is None


def test_url_words_are_all_counted(spark):
    title = "filler " * 400 + "zorb lamp u"
    pages = [(0, "http://zorblamp.example.org/q", f"<title>{title}</title><Title lang=en>zorb</Title>")]
    counts = url_filter.word_counts(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.w: r.n for r in counts.collect()} == {"filler": 400, "zorb": 2, "lamp": 1, "u": 1, "q": 1}


def test_urls_against_a_plain_version(spark, monkeypatch):
    """Every split by trying all of them, every score from plain dictionaries; hot runs and others."""
    monkeypatch.setattr(url_filter, "SHARE", 2)
    urls = ["http://cheappills.a.org/x", "http://cheapnews.a.org/x", "http://xxcasinowin.example.org/science", "http://qqq.org/", "http://ab.cd.org/ab/ab", None] * 3 + ["http://spamspam.org/news"]
    pages = spark.createDataFrame([(i, u, "<title>ab cd news casino zz</title>" if i % 2 else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    counts = {}
    for i, u in enumerate(urls):
        path = "/" + u.split("/", 3)[3] if u else ""
        for w in re.findall("[a-z]+", path) + (["ab", "cd", "news", "casino", "zz"] if i % 2 else []):
            counts[w] = counts.get(w, 0) + 1
    model = url_filter.UrlModel()
    seg = model.segmenter(counts, sum(counts.values()), sum(n for w, n in counts.items() if url_filter.is_word(w)))

    def best(name):
        splits = [[name[a:b] for a, b in zip((0, *cut), (*cut, len(name)), strict=True)] for k in range(len(name)) for cut in combinations(range(1, len(name)), k)]
        return max(splits, key=lambda x: (sum(seg.logs.get(w, seg.unknown(len(w))) for w in x)))

    for r in url_filter.judge(pages).collect():
        u = urls[r.page_id]
        if not u:
            assert r.verdict == "allow" and r.url_score is None
            continue
        runs = [x for label in u.split("/")[2].split(".")[:-1] for x in re.findall("[a-z]+", label)] + re.findall("[a-z]+", u.split("/", 3)[3])
        want = model.bayes.score([w for x in runs for w in (best(x) if len(x) < 13 else seg.split(x))])
        assert r.url_score == pytest.approx(want) and r.verdict == ("block" if want > 0 else "allow")


def test_token_tables_round_trip(spark, tmp_path):
    texts = [*ODD, "Don't STOP, <|endoftext|> \u0130\u0301 (ok)"] + [f"word{i} Again, and again!" for i in range(300)]
    docs = docs_of(spark, texts)
    shards = token_tables.write(docs, f"file://{tmp_path}/t")
    t = token_tables.encoder(token_tables.default_tokenizer()).tokenizer
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    rows = token_tables.read(spark, shards).collect()
    assert {r.id: list(r.ids) for r in rows if r.id is not None} == want
    at = 0
    for r in sorted(rows, key=lambda r: (r.id is not None, r.id or 0)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert [x.tolist() for x in token_tables.lookup(shards, 7)] == [want[7]] and token_tables.lookup(shards, 10**9) == []
    assert token_tables.write(docs.where("false"), f"file://{tmp_path}/e") == [] == token_tables.manifest(f"file://{tmp_path}/e")
    assert token_tables.manifest(f"file://{tmp_path}/t") == shards


def test_token_caches_are_as_small_as_asked_for(spark, monkeypatch):
    import corpus_pipeline

    e = token_tables.WordEncoder(token_tables.default_tokenizer(), 1 << 20)
    texts = [" ".join(f"w{k}x{i}" for k in range(200)).encode() for i in range(60)]
    whole = token_tables.WordEncoder(token_tables.default_tokenizer()).encode(texts)
    got = []
    for t in texts:
        got += e.encode([t])
        assert e.words.size + e.pieces.size <= 1 << 19
    assert got == whole
    asked = {}
    monkeypatch.setattr(token_tables, "write", lambda docs, path, **options: asked.update(options) or [])
    monkeypatch.setattr(token_tables, "read", lambda spark, shards, **_: docs_of(spark, ["a"]).withColumnRenamed("doc_id", "id"))
    corpus_pipeline.token_output(spark, docs_of(spark, ["a"]), "")
    assert asked["cache_bytes"] < token_tables.CACHE_BYTES


def test_secrets_against_regexes(spark):
    texts = [*ODD, "é PassWord = 'abcdef1' secret=token: abcdefgh", "token=abc", "AKIA" + "Z9" * 20, "f" * 30 + "\n" + "a" * 23, "key ghp_" + "a1B2" * 9]
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in secret_scan.scan_secrets(docs_of(spark, texts)).collect()}
    for i, x in enumerate(texts):
        x = x or ""
        want = [("assign", *m.span()) for m in assign.finditer(x) if len(m[1]) >= 6] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        assert sorted(s for s in got[i] if s[0] in ("assign", "access", "hex")) == sorted(want)
    assert ("github", 4, 44) in got[len(texts) - 1]


def test_automaton_is_minimal():
    a = secret_scan.Automaton(["(a|b)*abb"], search=False)
    assert len(a.accepts) == 5  # the textbook's four, and the dead state
    assert a.longest(b"aababb".translate(a.class_of), 0, 6) == 6 and a.longest(b"ba".translate(a.class_of), 0, 2) == -1


def test_personal_data_against_regexes(spark):
    x = "mail a@b@c.d. 1.2.3.4.5.6.7.8 999.1.1.1 call +1 (222) 333-4444 card 4111 1111 1111 1111 iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789"
    found = personal_data.find(x)
    assert [(k, x[a:b]) for k, a, b, _ in found] == [("email", "b@c.d"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (222) 333-4444"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]
    assert not [s for s in personal_data.find("number 123-45-6789") if s[0] == "ssn"]
    r = personal_data.redact(docs_of(spark, [*ODD, x])).where("doc_id = 8").first()
    assert "<card>" in r.text and "4111" not in r.text
    assert personal_data.scan_personal_data(docs_of(spark, ODD)).count() == len(ODD) + 1


def test_ibans_among_capitals_and_overlapping_spans():
    iban = "DE89 3704 0044 0532 0130 00"
    for x in (f"{iban} BIC COBADEFF", f"{iban} 2024", f"NR12 {iban}", f"ORDER AB12 CDEF {iban} GB82 WEST 1234 5698 7654 32 EUR"):
        spans = [x[a:b] for k, a, b, _ in personal_data.find(x) if k == "iban"]
        assert spans == [iban, "GB82 WEST 1234 5698 7654 32"][: 1 + ("GB82" in x)], x
        assert "3704" not in personal_data.masked(x)
    find, personal_data.find = personal_data.find, lambda t: [("ip", 2, 5, 1.0), ("card", 4, 8, 1.0)]
    try:
        assert personal_data.masked("0123456789") == "01<ip>89"
    finally:
        personal_data.find = find


def test_language_held_out_and_mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language_id.op7(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    model = language_id.fit(docs)
    mixed = docs_of(spark, ["the other thing and that was there with them " * 4 + "nicht der keit und schen ung ver heit " * 4, None, "12 ... 34"])
    rows = {r.doc_id: r for r in language_id.label(mixed, model, spans=True).collect()}
    assert {s.lang for s in rows[0].lang_spans} >= {"en", "de"} and rows[1].lang_pred == rows[2].lang_pred == "und" and rows[2].score == 0


def test_rare_languages_are_learned(spark):
    rare = {"qa": ["vrizoq plumqat ojibwek", "quuzat miqloj"], "qb": ["hxubi wfolka"]}
    rows = [(f"the other thing was there with them {i}", "en") for i in range(3000)] + [("", "qc"), ("12 --", "qc"), ("no label", None)]
    rows += [(t, k) for k, x in rare.items() for t in x]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["en", "qa", "qb"] and "hxu" in model.gram
    got = {r.doc_id: r.lang_pred for r in language_id.label(docs.where("doc_id >= 2998 and lang is not null"), model).collect()}
    assert got == {2998: "en", 2999: "en", 3000: "und", 3001: "und", 3003: "qa", 3004: "qa", 3005: "qb"}
    same = docs.where("lang = 'qb'").withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("doc_id", F.lit(7))
    assert language_id.fit(same, per_language=1).languages == ["qb"]
    none = language_id.fit(docs.where("lang = 'qc'"))
    assert {r.lang_pred for r in language_id.label(docs.limit(5), none).collect()} == {"und"}


def test_viterbi_forms_agree_with_brute_force():
    rng = np.random.default_rng(0)
    lab = language_id.Labeller(language_id.Model({}, {}), 2.0)
    for _ in range(200):
        s = rng.normal(size=(6, 3)) * 2
        best = max(sum(s[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(*(3,) * 6))
        for path in (language_id.viterbi(s, 2.0), language_id.viterbi_of_few(s, 2.0), lab.path(s)):
            assert s[np.arange(6), path].sum() - 2.0 * (np.diff(path) != 0).sum() == pytest.approx(best)


def test_short_cut_of_the_recurrence_is_exact():
    lab = language_id.Labeller(language_id.Model({}, {}), 12.0)
    assert lab.path(np.array([[0.0, 10.0, -20.0], [0.0, -20.0, 10.0]])).tolist() == [1, 2]
    rng = np.random.default_rng(1)
    for k in range(600):
        s = rng.normal(size=(5, 3)) * (3, 5, 8)[k % 3]
        value = lambda p: s[np.arange(5), p].sum() - 12.0 * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert value(lab.path(s)) == pytest.approx(max(value(np.array(p)) for p in np.ndindex(*(3,) * 5)))


@pytest.mark.parametrize("block", [8 << 20, 400])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd ef gh ij".split())
    items = [("i1", " ".join(word() for _ in range(20))), ("i2", "Zq, zq! short"), ("i3", None), (None, "x y z"), ("i4", " ".join(word() for _ in range(30)))]
    texts = [*ODD, items[0][1].upper() + " tail", "zq zq short", "pre " + items[4][1][6:60] + " post", " ".join(word() for _ in range(400)), "pre x y z, then"]
    docs = docs_of(spark, texts).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    got = {r.doc_id: r for r in decontamination.judged(decontamination.scan(docs.drop("n_words"), bench, block_bytes=block)).collect()}
    clean = set()
    for i, t in enumerate(texts):
        w, hit, own = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(13, len(v))
            for g in {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else ():
                for a in range(len(w) - n + 1):
                    if tuple(w[a : a + n]) == g:
                        hit |= set(range(a, a + n))
                        own |= {k} - {None}
        assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == (len(w), len(hit), sorted(own))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    kept = decontamination.decontaminate(docs, bench, block_bytes=block)
    assert {r.doc_id for r in kept.collect()} - {None} == clean and kept.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[8].strip() == "tail" and cut[5] == ODD[5]
    assert decontamination.scan(docs, bench.where("false")).count() == len(texts) + 1


def word_sets(text):
    """The shingles as tuples of words, by the contract's own rules."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \\t-\\r]+", lower) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_components(texts):
    """{id: (size, component)} of (id, text) with unique ids, by comparing all pairs."""
    sets = {i: word_sets(t) for i, t in texts}
    root = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    texts = list(ODD)
    for _ in range(150):  # a hot group around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"m{rng.randint(0, 10**6)}"
        texts.append(" ".join(w[: rng.randint(66, 80)]))
    for _ in range(60):  # documents that share a passage only
        texts.append(" ".join(base[:20] + [f"p{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 80))]))
    docs = docs_of(spark, texts)
    want = jaccard_components(list(enumerate(texts)))
    for frequent in (3, 40, 10**6):
        rows = jaccard_join.similar(docs, frequent=frequent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want and len(rows) == len(texts) + 1
    kept = jaccard_join.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == {None} | {c for _, c in want.values()} and kept.columns == docs.columns
    assert jaccard_join.similar(docs.where("false")).count() == 0


@pytest.mark.parametrize("block", [4, 12])
def test_jaccard_join_by_combinations(spark, monkeypatch, block):
    """Lists of frequent tokens that are longer than a block: combinations of tokens, then blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    texts = []
    for _ in range(3):  # families around the threshold, which share most of their text
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(70)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(70)] = f"m{rng.randint(0, 10**6)}"
            at = rng.randint(0, 12)
            texts.append(" ".join(w[at : at + rng.randint(50, 70)]))
    want = jaccard_components(list(enumerate(texts)))
    assert len({c for _, c in want.values()}) > 6
    for frequent in (2, 10):
        got = jaccard_join.similar(docs_of(spark, texts).where("doc_id is not null"), frequent=frequent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_join_uses_combinations_where_they_are_fewer(spark, monkeypatch):
    """Sets of single words from a pool: every word is frequent, pairs of words aren't."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    lengths, plain = [], jaccard_join.combined
    monkeypatch.setattr(jaccard_join, "combined", lambda *a: (lambda out: lengths.extend(r["k"] for r in out.select(F.size("key").alias("k")).distinct().collect()) or out)(plain(*a)))
    rng = random.Random(12)
    sets = []
    for _ in range(1200):
        s = set(rng.sample(range(400), 30))
        sets.append(s)
        if rng.random() < 0.2:
            sets.append(set(rng.sample(sorted(s), rng.randint(24, 29))) | {rng.randrange(400)})
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in s), "en", "s", 0) for i, s in enumerate(sets)], DOCS)
    root = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    got = jaccard_join.similar(docs, shingle=1, frequent=10).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root)) and max(lengths) >= 2


def test_jaccard_join_keeps_one_row_of_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text, "en", "s", 0), (5, text, "de", "s", 0), (9, text, "en", "s", 0), (9, text, "en", "s", 0), (None, text, "en", "s", 0), (None, text, "en", "s", 0), (7, None, None, None, None)], DOCS)
    assert sorted((r.doc_id or 0) for r in jaccard_join.keep_one(docs).collect()) == [0, 0, 5, 7]
    with pytest.raises(ValueError):
        jaccard_join.similar(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_components_of_a_star(spark, monkeypatch):
    monkeypatch.setattr(components, "SHARE", 5)
    links = [(0, k) for k in range(1, 40)] + [(50, k) for k in range(30, 45)] + [(60, 61)]
    got = components.components(spark.createDataFrame(links, "src long, dst long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {**dict.fromkeys([*range(45), 50], 0), 60: 60, 61: 60}


def test_jaccard_join_where_rows_share_an_id(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    near = lambda w: " ".join([*w[:-1], word()])
    rows, e = [], [word() for _ in range(60)]
    for k in range(10, 400, 10):  # three texts of an id, each with a near copy elsewhere
        for j in range(3):
            w = [word() for _ in range(60)]
            rows += [(k, " ".join(w)), (k + 1 + j, near(w))]
    rows += [(1000, " ".join(e)), (1001, near(e)), (1001, ""), (1002, None), (1002, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    want = {k: k // 10 * 10 for k, _ in rows} | {1001: 1000, 1002: 1002}
    for frequent in (1, 40):
        got = jaccard_join.similar(docs, frequent=frequent).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == set(want.values())


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60) if i % 7] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)] + [(500, k) for k in range(501, 560)] + [(None, 1), (9, 9)]
    root = {x: x for l in links for x in l if x is not None}
    for _ in range(200):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert all(root[n] == r for n, r in got.items()) and {a for a, b in links if a is not None and a != b} <= set(got)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 16))
    x = [(centre[k % 4] + rng.normal(size=16) * 0.12).tolist() for k in range(300)] + [[0.0] * 16, None, [float("nan")] * 16, [1.0] * 3]
    x += [x[0]] * 5
    label = [k % 2 if k % 50 else None for k in range(len(x))]
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v, l) for k, (v, l) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")).collect()
    ok = [k for k in range(len(x)) if label[k] is not None and x[k] is not None and len(x[k]) == 16 and np.isfinite(x[k]).all() and any(x[k])]
    u = {k: np.array(x[k]) / np.linalg.norm(x[k]) for k in ok}
    links = [(a, b) for a, b in combinations(ok, 2) if label[a] == label[b] and u[a] @ u[b] >= 0.98]
    root, count = {k: k for k in range(len(x))}, dict.fromkeys(range(len(x)), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for _ in range(len(x)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert len(links) > 100
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {k: (count[k], root[k], root[k] == k) for k in range(len(x))}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = jaccard_components([(r.doc_id, r.text) for r in docs.where("doc_id < 250").collect()])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 250"), SF).collect()} == {c for _, c in want.values()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), SF).columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert kept.count() <= docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert decontamination.items_digest([]) == empty
