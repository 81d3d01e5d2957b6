"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty
labels the spans of mixed-language text.

A word's score for a language is the log-likelihood of its character trigrams, learned from labelled documents. The document's
language is the one whose spans hold most letters, its score their share. Where no span of another language gains more than
one switch costs, nor the best first and last spans together, the best path is one language throughout, and the recurrence is
not run.

Training reads about ``per_language`` labelled documents of each language, drawn by hash from those with a letter; a language
with fewer is learned from all of them. Every language with a labelled letter is learned, and every trigram drawn counts. What
the model takes of the driver and the workers grows with the pairs of language and trigram that occur. Every document is
labelled over its whole text.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0, and so is everything if no language
was learned; words in scripts that no language has count for none, so a text of such words only gets the first language with score 0; ties go to the first language by code point; repeated
documents are labelled row by row; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import chunks, crc_mod, map_arrow

PER_LANGUAGE = 2500
PENALTY = 12.0
FOREIGN = -18.0
#: Counted for every trigram in every language.
SMOOTH = 0.3
MIN_SCRIPT = 0.02
#: First code points of the script ranges, in order.
_SCRIPTS = (
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"),
    (0x980, "bengali"), (0xA00, "other"), (0xB80, "tamil"), (0xC00, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_STARTS = [a for a, _ in _SCRIPTS]


def script(word: str) -> str:
    return _SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def letters(token: str) -> str:
    """The token's letters in lower case."""
    return (token if token.isalpha() else "".join(filter(str.isalpha, token))).lower()


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """Log-probabilities of trigrams by language, and the scripts each language is written in."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        self.gram: dict[str, int] = {}
        number = self.gram.setdefault
        places, columns, gains = [], [], []
        for k, lang in enumerate(self.languages):
            found = np.fromiter(counts[lang].values(), np.float64, len(counts[lang]))
            places.append(np.fromiter((number(g, len(self.gram)) for g in counts[lang]), np.int64, len(found)))
            columns.append(np.full(len(found), k, np.int64))
            gains.append(np.log1p(found / SMOOTH))
        # Of trigram g, the languages that have it and what it gains over an unseen one are at starts[g] to starts[g + 1].
        place = np.concatenate([np.zeros(0, np.int64), *places])
        order = np.argsort(place, kind="stable")
        self.columns, self.gains = np.concatenate([np.zeros(0, np.int64), *columns])[order], np.concatenate([np.zeros(0), *gains])[order]
        self.starts = np.searchsorted(place[order], np.arange(len(self.gram) + 2))
        self.unseen = -np.log(np.array([sum(counts[x].values()) for x in self.languages]) / SMOOTH + len(self.gram) + 1)
        self.allowed = {}
        for s in {s for c in scripts.values() for s in c}:
            ok = [scripts[x].get(s, 0) >= MIN_SCRIPT * sum(scripts[x].values()) for x in self.languages]
            self.allowed[s] = np.where(ok, 0.0, FOREIGN) if any(ok) else np.zeros(len(ok))

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log-likelihoods for each word; zeros for scripts that no language has."""
        get, unknown = self.gram.get, len(self.gram)
        grams, lengths, narrowed = [], [], []
        none = np.full(len(self.languages), np.nan)
        for w in words:
            padded = f"^{w}$"
            grams += [get(padded[i : i + 3], unknown) for i in range(len(w))]
            lengths.append(len(w))
            narrowed.append(self.allowed.get("latin" if w.isascii() else script(w), none))
        if not words:
            return np.zeros((0, len(self.languages)))
        grams, n = np.array(grams), len(self.languages)
        begin, found = self.starts[grams], self.starts[grams + 1] - self.starts[grams]
        at = np.repeat(begin + found - np.cumsum(found), found) + np.arange(found.sum())
        cell = np.repeat(np.repeat(np.arange(len(words)) * n, lengths), found) + self.columns[at]
        out = np.bincount(cell, self.gains[at], len(words) * n).reshape(len(words), n) + np.outer(lengths, self.unseen) + np.array(narrowed)
        out[np.isnan(out).any(1)] = 0.0
        return out


class Labeller:
    """Scores each distinct token once; a bounded cache keeps them."""

    #: Numbers in the cache: tokens times languages and one.
    MOST = 2_000_000

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        #: Scores, letters in a script of some language, letters.
        self.rows = np.zeros((1 << 12, len(self.model.languages) + 2))

    def numbers(self, tokens: list[str]) -> np.ndarray:
        new = list(set(tokens).difference(self.number))
        at = len(self.number)
        self.number.update(zip(new, range(at, at + len(new)), strict=True))
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        words = [letters(t) for t in new]
        self.rows[at : at + len(new), -1] = [len(w) for w in words]
        real = [k for k, w in enumerate(words) if w]
        places, scores = at + np.array(real, np.int64), self.model.scores([words[k] for k in real])
        self.rows[places, :-2] = scores
        # Every known script gives negative scores.
        self.rows[places, -2] = np.where((scores < 0).any(1), self.rows[places, -1], 0) if scores.shape[1] else 0
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))

    def paths(self, texts: list[str | None]):
        """For each text (letters by token, those that some language can claim, language number by token)."""
        if len(self.number) * (len(self.model.languages) + 2) > self.MOST:
            self.reset()
        lists = [t.split() if t else [] for t in texts]
        numbers = self.numbers(list(chain.from_iterable(lists)))
        rows = self.rows[numbers]
        at = 0
        for x in lists:
            own = rows[at : at + len(x)]
            at += len(x)
            yield own[:, -1], own[:, -2], self.path(own[:, :-2])

    def path(self, s: np.ndarray) -> np.ndarray:
        if not s.size:
            return np.zeros(len(s), np.int64)
        best = int(s.sum(0).argmax())
        run = np.cumsum(s - s[:, best, None], axis=0)
        low = np.minimum(0.0, np.minimum.accumulate(np.concatenate([np.zeros((1, run.shape[1])), run[:-1]]), axis=0))
        # A path off the best language gains in its first span, its last one and those between, and pays for each but the first.
        ends = max(0.0, run.max()) + (run[-1] - low[-1]).max()
        if (run - low).max() <= self.penalty and ends <= self.penalty:
            return np.full(len(s), best)
        return viterbi_of_few(s, self.penalty) if s.shape[1] <= 12 else viterbi(s, self.penalty)

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for size, claimed, path in self.paths(texts):
            total = size.sum()
            if not total or not self.model.languages:
                out.append(("und", 0.0))
                continue
            share = np.bincount(path, claimed, len(self.model.languages))
            k = int(share.argmax())
            out.append((self.model.languages[k], float(share[k] / total)))
        return out


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The best path when each change of state costs penalty; staying wins ties."""
    n, back, v = s.shape[1], np.empty(s.shape, np.int64), s[0].copy()
    own = np.arange(n)
    for t in range(1, len(s)):
        top = int(v.argmax())
        change = v[top] - penalty > v
        back[t] = np.where(change, top, own)
        v = np.where(change, v[top] - penalty, v) + s[t]
    out = np.empty(len(s), np.int64)
    out[-1] = k = int(v.argmax())
    for t in range(len(s) - 1, 0, -1):
        out[t - 1] = k = back[t, k]
    return out


def viterbi_of_few(s: np.ndarray, penalty: float) -> np.ndarray:
    """The same for few states, on plain numbers."""
    rows = s.tolist()
    v, back = rows[0], []
    for row in rows[1:]:
        top = max(v)
        cut = top - penalty
        if min(v) >= cut:
            back.append(None)
            v = [a + b for a, b in zip(v, row, strict=False)]
        else:
            k = v.index(top)
            back.append([k if a < cut else i for i, a in enumerate(v)])
            v = [(cut if a < cut else a) + b for a, b in zip(v, row, strict=False)]
    k = v.index(max(v))
    out = [k]
    for from_ in reversed(back):
        if from_ is not None:
            k = from_[k]
        out.append(k)
    return np.array(out[::-1])


def fit(docs: DataFrame, *, learn_from: Column | None = None, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where("_lang is not null")
    rows = (rows.where(learn_from) if learn_from is not None else rows).where(F.col("_text").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.lit(29), "_id", "_text"), F.lit(1 << 30)) / float(1 << 30)
    # Repeated rows are drawn together, so the first by hash is drawn in any case.
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("n"), F.min(draw).alias("low"))
    share = {r["_lang"]: max(min(1.0, per_language / r["n"]), r["low"]) for r in sizes.collect()}
    if not share:
        return Model({}, {})
    limits = docs.sparkSession.createDataFrame(list(share.items()), "_lang string, _share double")
    drawn = rows.join(F.broadcast(limits), "_lang").where(draw <= F.col("_share")).select("_lang", "_text")

    def count(batches):
        import pyarrow as pa

        words: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words[lang].update(filter(None, map(letters, (text or "").split())))
        out: Counter = Counter()
        for lang, found in words.items():
            for w, n in found.items():
                out[lang, "script", script(w)] += n * len(w)
                for g in trigrams(w):
                    out[lang, "gram", g] += n
        keys = list(out)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(out.values()), pa.int64())], names=["lang", "kind", "value", "n"])

    found = map_arrow(drawn, count, "lang string, kind string, value string, n long").groupBy("lang", "kind", "value").agg(F.sum("n").alias("n"))
    counts: dict = {x: {} for x in share}
    scripts: dict = {x: {} for x in share}
    for r in found.toLocalIterator():
        (scripts if r["kind"] == "script" else counts)[r["lang"]][r["value"]] = r["n"]
    known = [x for x in share if scripts[x]]
    return Model({x: counts[x] for x in known}, {x: scripts[x] for x in known})


def label(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """keep's columns, lang_pred and score; with spans also an array of (lang, first word, last word + 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(*keep, F.col(text_col).alias("_text_to_label"))
    out = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0))
    if spans:
        out = out.withColumn("lang_spans", F.lit(None).cast("array<struct<lang:string,first:long,last:long>>"))
    schema = out.schema

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        labeller = Labeller(shared.value)
        # A word takes a number for each language.
        most = min(2 << 20, (24 << 20) // (len(labeller.model.languages) + 8))
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            done, ranges = [], []
            for i, j in chunks([len(t or "") for t in texts], most):
                done += labeller.label(texts[i:j])
                if spans:
                    ranges += [runs(p, labeller.model.languages) if len(labeller.model.languages) else [] for *_, p in labeller.paths(texts[i:j])]
            arrays = [*b.columns[:-1], pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.float64())]
            if spans:
                arrays.append(pa.array(ranges, to_arrow_type(schema["lang_spans"].dataType)))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_arrow(columns, work, schema)


def runs(path: np.ndarray, languages: list[str]) -> list[dict]:
    if not len(path):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"lang": languages[path[a]], "first": a, "last": b} for a, b in zip(cuts, cuts[1:], strict=False)]


def op7(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, learn_from=crc_mod(F.col("_id"), 4) != 2)
    out = label(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
