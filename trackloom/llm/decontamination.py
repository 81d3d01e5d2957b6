"""Benchmark decontamination.

A hash set of the benchmark's normalised word windows is broadcast in blocks of a checked size; each document's windows
are rolled over in one pass, hash hits are verified word by word, and documents or spans are removed.

Words: A-Z lower-cased, then runs of ``[0-9a-z]`` and non-ASCII characters. A window is ``n`` consecutive words of an
item; an item of fewer words, but not none, is one window.

Defined results: a null or empty text has no words and is never contaminated; benchmark rows without words are skipped, the
windows of rows with a null id hit words but count for no item; equal item ids count once; texts of any length are scanned whole; repeated documents are judged row by row; an empty benchmark hits nothing;
other columns of the documents are carried along untouched and never read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm._common import chunks, map_arrow, materialize, texts_of

#: Bytes to words: word bytes map to themselves in lower case, all others to a space.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCAN = "_trackloom_scan"
_SCAN_TYPE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class WindowSet:
    """The windows of some benchmark items: a vocabulary, and for each window length sorted hashes with a place to verify against."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int = 13):
        self.vocab: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        # Items without an id hit words, but are named nowhere.
        number = {x: k for k, x in enumerate(self.ids)} | {None: -1}
        flat: list[int] = []
        starts: dict[int, list[tuple[int, int]]] = {}
        for item, text in items:
            words = words_of(text)
            at = len(flat)
            flat.extend(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words)
            k = min(n, len(words))
            if k:
                starts.setdefault(k, []).extend((at + i, number[item]) for i in range(len(words) - k + 1))
        self.flat = np.array(flat, np.int64)
        #: length -> hashes in order, start of one window for each, owner lists as (offsets, item numbers)
        self.by_length = {k: self._index(k, np.array(v, np.int64)) for k, v in sorted(starts.items())}

    def _index(self, k: int, starts: np.ndarray):
        rows = self.flat[starts[:, 0, None] + np.arange(k)]
        # Windows are told apart by their words, not by their hash: equal rows share one entry.
        uniq, inverse = np.unique(rows, axis=0, return_inverse=True)
        h = roll(uniq)
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[inverse.ravel()], starts[:, 1]], 1), axis=0)
        return h[order], uniq[order], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1]

    def hits(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and the item numbers by document; ids are the words' numbers (0: not in the vocabulary)."""
        mark = np.zeros(len(ids) + 1, np.int64)
        found: dict[int, set[int]] = {}
        run = np.concatenate([[0], np.cumsum(ids > 0)])
        for k, (hashes, rows, offsets, owners) in self.by_length.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(run[k:] - run[:-k] == k)
            at = at[doc[at] == doc[at + k - 1]]
            if not len(at):
                continue
            windows = ids[at[:, None] + np.arange(k)]
            h = roll(windows)
            pos, end = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            maybe = np.flatnonzero(pos < end)
            for i in maybe:
                for p in range(pos[i], end[i]):
                    if np.array_equal(rows[p], windows[i]):
                        mark[at[i]] += 1
                        mark[at[i] + k] -= 1
                        found.setdefault(int(doc[at[i]]), set()).update(x for x in owners[offsets[p] : offsets[p + 1]].tolist() if x >= 0)
        return np.cumsum(mark[:-1]) > 0, found


def roll(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j].astype(np.uint64)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def window_blocks(benchmark: DataFrame, n: int, id_col: str, text_col: str, block_bytes: int):
    """WindowSets of about block_bytes of text each, so that what is broadcast at once has a size bound."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        yield WindowSet([(r.i, bytes(r.t)) for r in part.toLocalIterator()], n)


def scan(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, id_col: str = "item_id", bench_text: str = "text", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """docs with a struct column ``SCAN`` (n_words, hits: [first, last) word ranges, items: ids).

    A benchmark of one block takes one narrow pass. Of a larger one each block takes a pass over the texts alone, which writes the few texts
    that are hit; these are joined to the documents by the text's fingerprint at the end, so no document is written or shuffled for a block.
    """
    if SCAN in docs.columns:
        raise ValueError(f"the column name {SCAN} is taken")
    empty = docs.withColumn(SCAN, F.lit(None).cast(_SCAN_TYPE))
    blocks = window_blocks(benchmark, n, id_col, bench_text, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _pass(empty, first or WindowSet([], n), text_col)
    texts = docs.select(F.col(f"`{text_col}`").alias("_text")).withColumn(SCAN, F.lit(None).cast(_SCAN_TYPE))
    mark = F.struct(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(43), "_text").alias("b"), F.length("_text").alias("c"))
    found = None
    for windows in chain([first, second], blocks):
        hit = _pass(texts, windows, "_text").where(F.size(f"{SCAN}.hits") > 0)
        hit = materialize(hit.select(mark.alias("_mark"), F.col(f"{SCAN}.hits").alias("h"), F.col(f"{SCAN}.items").alias("i")).distinct(), "hits")
        found = hit if found is None else found.unionByName(hit)
    found = found.groupBy("_mark").agg(F.flatten(F.collect_list("h")).alias("h"), F.flatten(F.collect_list("i")).alias("i"))
    found = materialize(found.select("_mark", F.struct(F.lit(0).cast("long").alias("n_words"), F.col("h").alias("hits"), F.col("i").alias("items")).cast(_SCAN_TYPE).alias("_found")), "hits")
    small = found.count() <= MOST_HITS
    own = F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(43), text_col).alias("b"), F.length(text_col).alias("c"))
    joined = docs.withColumn("_own_mark", own).join(F.broadcast(found) if small else found, F.col("_own_mark") == F.col("_mark"), "left").drop("_own_mark", "_mark")
    # A pass without windows counts the words and puts the ranges of all blocks in order.
    return _pass(joined.withColumnRenamed("_found", SCAN), WindowSet([], n), text_col)


#: So many hit texts are broadcast at most; more are joined by a shuffle.
MOST_HITS = 20_000


def _pass(docs: DataFrame, windows: WindowSet, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    schema = docs.schema

    def work(batches):
        import pyarrow as pa

        w = shared.value
        for batch in batches:
            texts, k = texts_of(batch, text_col), batch.schema.get_field_index(SCAN)
            before, out = batch.column(k).to_pylist(), []
            for a, b in chunks([len(t or b"") for t in texts], 4 << 20):
                lists = [words_of(t) for t in texts[a:b]]
                sizes = np.array([len(x) for x in lists], np.int64)
                ids = np.fromiter(map(w.vocab.get, chain.from_iterable(lists), repeat(0)), np.int64, int(sizes.sum()))
                doc = np.repeat(np.arange(len(lists)), sizes)
                hit, found = w.hits(ids, doc)
                first = np.concatenate([[0], np.cumsum(sizes)])
                for i in range(len(lists)):
                    old = before[a + i] or {"hits": [], "items": []}
                    spans, items = old["hits"], sorted(set(old["items"]))
                    if i in found or len(spans) > 1:
                        own = set(np.flatnonzero(hit[first[i] : first[i + 1]]).tolist()).union(*(range(x, y) for x, y in spans))
                        spans, items = ranges(sorted(own)), sorted({w.ids[x] for x in found.get(i, ())} | set(items))
                    out.append({"n_words": int(sizes[i]), "hits": spans, "items": items})
            columns = list(batch.columns)
            columns[k] = pa.array(out, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, work, schema)


def ranges(numbers: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for x in numbers:
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return out


def judged(scanned: DataFrame) -> DataFrame:
    """Turns ``SCAN`` into n_words, n_hit, items and contaminated: some word is hit, and at least a twentieth of all words."""
    n_hit = F.aggregate(f"{SCAN}.hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    out = scanned.withColumns({"n_words": F.col(f"{SCAN}.n_words"), "n_hit": n_hit, "items": F.col(f"{SCAN}.items")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **options) -> DataFrame:
    """docs without the contaminated documents, or (remove="spans") with their hit words cut out; same columns."""
    text_col, columns = options.get("text_col", "text"), docs.columns
    scanned = scan(docs, benchmark, **options)
    n_hit = F.aggregate(f"{SCAN}.hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    bad = (n_hit > 0) & (20 * n_hit >= F.col(f"{SCAN}.n_words"))
    if remove == "documents":
        return scanned.where(~bad).select(*[F.col(f"`{c}`") for c in columns])
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove}")

    @F.pandas_udf("string")
    def cut(text, hits):
        import pandas as pd

        return pd.Series([without(t, h) if h is not None and len(h) else t for t, h in zip(text, hits, strict=True)], dtype=object)

    return scanned.withColumn(text_col, F.when(n_hit > 0, cut(F.col(text_col), F.col(f"{SCAN}.hits"))).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in columns])


def without(text: str, hits) -> str:
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_WORD_BYTES))]
    out, at = [], 0
    for first, last in hits:
        out.append(raw[at : spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op8(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judged(scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP8_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, lengths WHERE len(w) >= k)),
hits AS (SELECT r, i, dw.k AS k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
marked AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
owned AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(marked.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(owned.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(marked.n, 0) > 0 AND 20 * coalesce(marked.n, 0) >= len(w) AS contaminated
FROM low LEFT JOIN marked USING (r) LEFT JOIN owned USING (r)
"""
