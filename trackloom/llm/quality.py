"""Quality classifier by Bradley-Terry pairwise ranking.

Documents are described by counts over their whole text. Preference pairs (a document labelled 1 over one labelled 0) train
a linear score by the logistic loss on feature differences; the score is then cut at a quantile of the training scores: the
share of training documents labelled 0. Scores are mapped to (0, 1) with the cut at ``threshold``.

The model is fitted on all labelled documents. They are dealt to blocks by hash, and within a block each good one is paired with each bad one, so
work grows with the labels and not with their square; mean, scale, loss, cut and spread are over all of them. Every document is scored.

Defined results: a null or empty text has all-zero counts and gets the score of such a text; labels that are null, not 0 or
1, or of a document that is absent are skipped; of several labels for one id the mean decides, a tie is skipped; repeated
documents are scored row by row, a null id as any other (it is not held out); texts of any length are read whole; without labels of both kinds every document scores 0.5 and is kept; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import crc_mod, discard, map_arrow, materialize, texts_of

PAIRS = 60_000
#: Labelled documents of a block, and documents of the rarer label that each block has at least, if there are so many.
BLOCK, LEAST = 512, 64
#: So many labels are broadcast at most, to fetch their texts; more are joined by a shuffle.
MOST_IDS = 2_000_000
#: So many scores are sorted on the driver at most.
MOST_SORTED = 100_000
THRESHOLD = 0.3
_CLASSES = (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"*#$%&@^~=+_<>{}[]", b"!", b"?", b"|", b".", b",", b"\n", b" \t", b":;", b"()", b"\"'`", b"/\\")
_ONE_HOT = np.zeros((256, len(_CLASSES) + 2))
for _k, _chars in enumerate(_CLASSES):
    _ONE_HOT[list(_chars), _k] = 1
_ONE_HOT[0xC0:, len(_CLASSES)] = 1
_ONE_HOT[:, len(_CLASSES) + 1] = 1
N_FEATURES = 2 * (len(_CLASSES) + 1) + 12


def features(text: bytes | None) -> np.ndarray:
    """Counts over the whole text, as shares and logarithms."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _ONE_HOT
    n = counts[-1]
    shares = counts[:-1] / n
    k = len(shares)
    out[:k] = shares
    out[k : 2 * k] = np.sqrt(shares)
    words = text.split()
    lines = text.split(b"\n")
    m = max(1, len(words))
    distinct = len(set(words))
    out[2 * k :] = [
        np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / m / 10, distinct / m, len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)), np.log1p(m / distinct if distinct else 0), len(words) < 5, len(words) < 20,
        sum(w.isalpha() for w in words) / m, sum(w.isupper() for w in words) / m, max(map(len, words), default=0) > 60,
    ]
    return out


class Ranking:
    """A linear score, its cut and its scale."""

    def __init__(self, mean, scale, weights, cut, spread):
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5) -> Ranking:
        """From arrays that the caller holds, on pairs drawn from them; fit() below takes tables whole."""
        d = x.shape[1]
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return cls(np.zeros(d), np.ones(d), np.zeros(d), -0.0, 0.0)
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        z = np.clip((x - mean) / scale, -6, 6)
        draw = np.random.default_rng(seed)
        diff = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
        w = np.zeros(d)
        for _ in range(40):  # Newton steps on the mean logistic loss of "good beats bad"
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff.T @ p) / pairs + ridge * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d)
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        s = z @ w
        return cls(mean, scale, w, float(np.quantile(s, len(bad) / len(y))), max(float(np.std(s)), 1e-9))

    def scores(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """In (0, 1), increasing in the linear score, ``threshold`` at the cut; 0.5 for all without a model."""
        if not self.spread:
            return np.full(len(x), 0.5)
        s = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        u = 3 * (s - self.cut) / self.spread + np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(u, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, learn_from: Column | None, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_id, _h, _text, _y) of all labelled documents, _h a hash of the id; of a repeated id the smallest text."""
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y")).where("_y <> 0.5")
    y = y.where(learn_from) if learn_from is not None else y
    few = y.count() <= MOST_IDS
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(y) if few else y, "_id")
    return own.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_id", F.xxhash64(F.lit(11), "_id").alias("_h"), "_text", F.round("_y").cast("int").alias("_y"))


def described(rows: DataFrame) -> DataFrame:
    """(_id, _h, x, _y): the features of each row's text as bytes."""

    def describe(batches):
        import pyarrow as pa

        for b in batches:
            x = [features(t).tobytes() for t in texts_of(b, "_text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary()), b.column(3)], names=["_id", "_h", "x", "_y"])

    return map_arrow(rows, describe, rows.select("_id", "_h", F.lit(None).cast("binary").alias("x"), "_y").schema)


def in_blocks(rows: DataFrame, n: int, rare: int, m: int) -> DataFrame:
    """(block, x, y, own) as bytes, of n described rows dealt to blocks by hash; the m ones of the rarer label go to so many that each block gets LEAST or all of them.

    own: whether the block is the row's first one.
    """
    count = -(-n // BLOCK)
    copies = min(count, max(1, -(-LEAST * count // m)))
    j = F.explode(F.when(F.col("_y") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))
    dealt = rows.withColumn("j", j).withColumn("block", F.pmod(F.pmod("_h", F.lit(count).cast("long")) + F.col("j"), F.lit(count)).cast("long"))

    def work(key, pdf):
        import pandas as pd

        p = pdf.sort_values(["_h", "_id"])
        cells = b"".join(p["x"]), p["_y"].to_numpy(np.int8).tobytes(), (p["j"].to_numpy() == 0).tobytes()
        return pd.DataFrame([(key[0], *cells)], columns=["block", "x", "y", "own"])

    return dealt.groupBy("block").applyInPandas(work, "block long, x binary, y binary, own binary")


def over(blocks: DataFrame, kernel, keep: bool = False) -> np.ndarray:
    """The sum of kernel(x, y, own) over the blocks, or with keep all of them in a row, in the order of the blocks; a task sends one array."""

    def work(batches):
        import pyarrow as pa

        first, found = None, []
        for b in batches:
            for block, x, y, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = kernel(np.frombuffer(x).reshape(-1, N_FEATURES), np.frombuffer(y, np.int8), np.frombuffer(own, bool))
                first = block if first is None else min(first, block)
                if keep or not found:
                    found.append(part)
                else:
                    found[0] = found[0] + part
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([np.concatenate(found).astype(float).tobytes()], pa.binary())], names=["block", "v"])

    parts = [np.frombuffer(r["v"]) for r in sorted(map_arrow(blocks.coalesce(1024), work, "block long, v binary").collect())]
    return np.concatenate(parts) if keep else np.sum(parts, 0)


def quantile(blocks: DataFrame, of, q: float, n: int, most: float) -> float:
    """The quantile, between neighbours in proportion, of the n numbers of(x)[own], none of which is beyond most; exact, by counts in ever narrower ranges."""
    at = q * (n - 1)
    k = int(at)
    ranks = k, min(k + 1, n - 1)
    low, high, below, inside = -most, float(np.nextafter(most, np.inf)), 0, n
    while inside > MOST_SORTED:
        edges = np.unique(np.linspace(low, high, 4097))
        if len(edges) < 3:  # neighbouring numbers: all inside are equal
            return low

        def count(x, y, own, edges=edges):
            s = of(x[own])
            s = s[(s >= edges[0]) & (s < edges[-1])]
            return np.bincount(np.searchsorted(edges, s, "right") - 1, minlength=len(edges) - 1)

        counts = over(blocks, count)
        ends = below + np.cumsum(counts)
        i, j = (int(np.searchsorted(ends, r, "right")) for r in ranks)
        low, high, below, before = float(edges[i]), float(edges[j + 1]), int(ends[i] - counts[i]), inside
        inside = int(ends[j]) - below
        if i == 0 and j == len(counts) - 1 and inside == before:
            break

    def values(x, y, own):
        s = of(x[own])
        return s[(s >= low) & (s < high)]

    s = np.sort(over(blocks, values, keep=True))
    a, b = (float(s[r - below]) for r in ranks)
    return a + (b - a) * (at - k)


def fit(docs: DataFrame, labels: DataFrame, *, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", ridge: float = 1e-3) -> Ranking:
    """learn_from: a condition on ``_id``, the label's id. The order of sums is that of the blocks, so that each run gives equal results."""
    rows = materialize(described(training_rows(docs, labels, learn_from, id_col=id_col, text_col=text_col, label_col=label_col)), "labelled")
    counts = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    d, n = N_FEATURES, sum(counts.values())
    if len(counts) < 2:
        discard(rows)
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), -0.0, 0.0)
    rare = min(counts, key=lambda k: (counts[k], k))
    blocks = materialize(in_blocks(rows, n, rare, counts[rare]), "blocks")
    mean = over(blocks, lambda x, y, own: x[own].sum(0)) / n
    scale = np.sqrt(over(blocks, lambda x, y, own: ((x[own] - mean) ** 2).sum(0)) / n)
    scale[scale < 1e-9] = 1.0
    w = np.zeros(d)
    for _ in range(40):  # Newton steps on the mean logistic loss of "good beats bad"

        def slopes(x, y, own, w=w):
            z = np.clip((x - mean) / scale, -6, 6)
            good, bad = z[y == 1], z[y == 0]
            p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None], -30, 30)))
            v = p * (1 - p)
            mixed = good.T @ v @ bad
            hess = (good * v.sum(1)[:, None]).T @ good + (bad * v.sum(0)[:, None]).T @ bad - mixed - mixed.T
            return np.concatenate([[p.size], p.sum(0) @ bad - p.sum(1) @ good, hess.ravel()])

        found = over(blocks, slopes)
        grad, hess = found[1 : d + 1] / found[0] + ridge * w, found[d + 1 :].reshape(d, d) / found[0] + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break

    def linear(x):
        return np.clip((x - mean) / scale, -6, 6) @ w

    middle = over(blocks, lambda x, y, own: linear(x[own]).sum(keepdims=True))[0] / n
    spread = float(np.sqrt(over(blocks, lambda x, y, own: ((linear(x[own]) - middle) ** 2).sum(keepdims=True))[0] / n))
    cut = quantile(blocks, linear, counts[0] / n, n, 6.001 * float(np.abs(w).sum()) + 1e-300)
    discard(rows, blocks)
    return Ranking(mean, scale, w, cut, max(spread, 1e-9))


def score(docs: DataFrame, model: Ranking, *, text_col: str = "text", score_col: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the score in a further column. Narrow, no shuffle."""
    if score_col in docs.columns:
        raise ValueError(f"the column name {score_col} is taken")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(score_col, F.lit(0.0)).schema

    def work(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([features(t) for t in texts_of(b, text_col)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(x, threshold), pa.float64())], names=schema.names)

    return map_arrow(docs, work, schema)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, text_col: str = "text", **options) -> DataFrame:
    """docs without those that score under the threshold; same columns."""
    name = "_trackloom_quality"
    scored = score(docs, fit(docs, labels, text_col=text_col, **options), text_col=text_col, score_col=name, threshold=threshold)
    return scored.where(F.col(name) >= threshold).drop(name)


def op2(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), learn_from=crc_mod(F.col("_id"), 5) != 0)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
