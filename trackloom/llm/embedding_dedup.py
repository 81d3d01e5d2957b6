"""Embedding near-duplicates by product quantisation.

Vectors of one label are compared. Equal vectors are one class from the start. A coarse quantiser deals unit vectors into
inverted lists; the rest after the list's centre is cut into subspaces, each coded by its nearest of up to 256 centres.
A query is sent to every list that can hold a vector within the threshold of it: those whose bisecting plane with its own
list's centre is no farther than the greatest distance of a linked pair. There, distances to the coded members come from lookup
tables; a member is dropped only if its table distance exceeds that greatest distance by more than the error its own code makes,
which is kept with it; the others are ranked again by exact cosine. So neither the probes nor the codes lose a link.

Quantisers are fitted on at most ``SAMPLE`` vectors, those of the smallest hash; every vector is indexed. Each unordered pair of
lists is visited once. Lists and their queries are cut into blocks of bounded size, and a block returns its vectors' link
counts and a spanning forest of the links, never the pairs.

Defined results: vectors without a label, null, empty or zero vectors, and such with null or non-finite components link with
nothing; vectors of different length never link; rows that share an id are one vector, which counts once among equal ones, and the links of
its different values add up; ties in distance change no result; ids that aren't integers are refused; a row without
an id has no component and isn't linked; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import map_arrow, materialize
from trackloom.llm.components import components

COSINE = 0.98
SAMPLE = 16_384
SUBSPACES = 8
BLOCK = 768


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Quantiser:
    """Coarse centres and, for what is left, a codebook for each subspace."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float = COSINE):
        s = unit(sample)
        #: The greatest distance of a linked pair, with room for rounding.
        self.reach = float(np.sqrt(2 - 2 * cosine)) + 1e-7
        self.centres = kmeans(s, int(min(max(1, round(vectors**0.5 / 8)), 4096, max(1, len(s) // 8))))
        rest = s - self.centres[self.nearest(s)[0]]
        self.cuts = np.array_split(np.arange(s.shape[1]), min(SUBSPACES, s.shape[1]))
        self.books = [kmeans(rest[:, c], int(min(256, max(1, len(s) // 16)))) for c in self.cuts]
        size = (self.centres**2).sum(1)
        # A little more than the distances, so that rounding loses no list.
        self.apart = np.sqrt(np.maximum(size[:, None] + size[None] - 2 * self.centres @ self.centres.T, 0) + 1e-12)

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = (u * u).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * u @ self.centres.T
        return d.argmin(1), d

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, the codes' errors and which lists to probe; of two lists the one of the higher number is probed."""
        own, d = self.nearest(u)
        rest = u - self.centres[own]
        codes = np.stack([((b**2).sum(1)[None] - 2 * rest[:, c] @ b.T).argmin(1) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        coded = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        error = np.sqrt(((rest - coded) ** 2).sum(1))
        probe = d - d[np.arange(len(u)), own][:, None] <= 2 * self.reach * self.apart[own] + 1e-9
        return own, codes.astype(np.uint8), error, probe & (np.arange(len(self.centres))[None] >= own[:, None])

    def table_distances(self, u: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to coded members of a list."""
        rest = u - self.centres[cell]
        out = np.zeros((len(u), len(codes)), np.float32)
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, c]
            table = (part**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * part @ b.T
            out += table.astype(np.float32)[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))


def linked(q: Quantiser, cosine: float, cell: int, x: np.ndarray, y: np.ndarray, codes: np.ndarray, error: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which queries x link with which members y; open_: the pairs that are asked for."""
    ux, uy = unit(x), unit(y)
    near = q.table_distances(ux, cell, codes) <= (q.reach + error + 1e-4)[None]
    i, j = np.nonzero(near & open_)
    out = np.zeros(near.shape, bool)
    for a in range(0, len(i), 200_000):
        p, r = i[a : a + 200_000], j[a : a + 200_000]
        out[p, r] = np.einsum("ij,ij->i", ux[p], uy[r]) >= cosine
    return out


def roots(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between a and b, each node with the smallest id that links reach."""
    ra, rb = a.copy(), b.copy()
    i, j = np.nonzero(links)
    if not len(i):
        return []
    while True:
        low = np.minimum(ra[i], rb[j])
        na, nb = ra.copy(), rb.copy()
        np.minimum.at(na, i, low)
        np.minimum.at(nb, j, low)
        if (na == ra).all() and (nb == rb).all():
            break
        ra, rb = na, nb
    own = np.concatenate([a, b])
    root = np.concatenate([ra, rb])
    return sorted({(int(x), int(y)) for x, y in zip(own, root, strict=True) if x != y})


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id and kept."""
    if dict(vectors.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError("ids must be integers")
    v = F.transform(vector_col, lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ok, F.lit(False))
    # 0.0 and -0.0 are equal numbers.
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, F.col(label_col).cast("string")).alias("label"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    rows = materialize(rows.withColumn("mark", F.xxhash64("v")), "vectors")
    classes = rows.where("v is not null").groupBy("label", "mark", "v").agg(F.min("id").alias("cid"), F.countDistinct("id").alias("copies"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "vector-classes")
    parts = [searched(classes.where(F.col("dim") == r["dim"]), r["n"], cosine) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "a long, b long, links long")
    for p in parts:
        found = found.unionByName(p)
    found = materialize(found, "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    counts = classes.groupBy("cid").agg(F.sum(F.col("copies") - 1).alias("own")).join(counts, "cid", "left").select("cid", (F.col("own") + F.coalesce("links", F.lit(0))).alias("n"))
    own = rows.where("v is not null").join(classes.select("label", "mark", "v", "cid"), ["label", "mark", "v"]).select("id", "cid").distinct()
    own = materialize(own, "vector-ids")
    tied = own.groupBy("id").agg(F.min("cid").alias("src"), F.max("cid").alias("dst")).where("src <> dst").select("src", "dst")
    ends = components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(tied)).withColumnRenamed("node", "cid")
    of = own.join(counts, "cid").join(ends, "cid", "left").groupBy("id").agg(F.sum("n").alias("n"), F.min(F.coalesce("root", "cid")).alias("root"))
    out = rows.select("id").join(of, "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def searched(classes: DataFrame, count: int, cosine: float) -> DataFrame:
    """(a, null, n): a links with n further vectors; (a, b, null): a link of a spanning forest."""
    sample = classes.select("v", F.xxhash64(F.lit(7), "mark", "label").alias("h")).orderBy("h", "v").limit(SAMPLE)
    fitted = Quantiser(np.array([r["v"] for r in sample.toLocalIterator()]), count, cosine)
    q = classes.sparkSession.sparkContext.broadcast(fitted)

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            x = np.array(c["v"].to_pylist())
            if not len(x):
                continue
            cell, codes, error, probe = q.value.encode(unit(x))
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [c["label"], c["cid"], c["copies"], pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error), pa.array(raw, pa.binary()), pa.array([np.flatnonzero(p).tolist() for p in probe], pa.list_(pa.int32()))],
                names=["label", "cid", "copies", "cell", "codes", "error", "raw", "probes"],
            )

    coded = map_arrow(classes.select("label", "cid", "copies", "v"), encode, "label string, cid long, copies long, cell int, codes binary, error double, raw binary, probes array<int>")
    coded = materialize(coded, "coded-vectors")
    asked = coded.select("label", "cid", "copies", "raw", (F.col("cell")).alias("home"), F.explode("probes").alias("cell"))
    blocks = lambda d, name: d.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    plan = materialize(blocks(coded, "mb").join(blocks(asked, "qb"), ["label", "cell"]), "list-blocks")
    place = lambda n: F.pmod(F.xxhash64(F.lit(41), "cid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["label", "cell", "m", "k"]
    members = coded.join(plan, ["label", "cell"]).withColumn("m", place("mb")).withColumn("k", each("qb")).select(*keys, "cid", "copies", "codes", "error", "raw")
    queries = asked.join(plan, ["label", "cell"]).withColumn("k", place("qb")).withColumn("m", each("mb")).select(*keys, "cid", "copies", "raw", "home")
    queries = queries.toDF(*(f"q_{c}" for c in queries.columns))

    def block(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="Int64")
        x, y = (np.array([np.frombuffer(r) for r in d]) for d in (left["q_raw"], right["raw"]))
        a, b = left["q_cid"].to_numpy(), right["cid"].to_numpy()
        # Inside one list both of a pair are asked: the smaller id's question counts.
        open_ = (left["q_home"].to_numpy() != key[1])[:, None] | (a[:, None] < b[None])
        codes = np.array([np.frombuffer(r, np.uint8) for r in right["codes"]])
        links = linked(q.value, cosine, int(key[1]), x, y, codes, right["error"].to_numpy(), open_)
        na, nb = links @ right["copies"].to_numpy(), links.T @ left["q_copies"].to_numpy()
        out = [(int(i), None, int(n)) for i, n in (*zip(a, na, strict=True), *zip(b, nb, strict=True)) if n] + [(i, j, None) for i, j in roots(links, a, b)]
        return pd.DataFrame(out, columns=["a", "b", "links"], dtype="Int64")

    return queries.groupBy(*(f"q_{c}" for c in keys)).cogroup(members.groupBy(*keys)).applyInPandas(block, "a long, b long, links long")


def op10(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
