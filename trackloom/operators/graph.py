"""Similarity graphs between the frames of a track of vectors (track_id, i, v).

Neighbours are searched in blocks: each block of queries meets blocks of many more members, products choose who can be among a frame's
best k, and only those k leave the pair of blocks, ranked by similarities that don't depend on the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.vectors import distance

BLOCK, MEMBERS = 1024, 16384


def nearest(frames: DataFrame, k: int, apart: int, measure: str = "cosine") -> DataFrame:
    """(track_id, src, dst, sim, rank): of each frame (track_id, i, v) the k best of its track more than apart away; on ties the lower number.

    measure: cosine, or euclid (sim is minus the distance). Frames are numbered within the track and packed into blocks, so sparse numbers
    cost nothing; a track of n frames sends each frame to n / BLOCK blocks of queries, and only the best k of MEMBERS frames leave a pair.
    """
    o = Window.partitionBy("track_id").orderBy("i")
    v = frames.select("track_id", "i", F.transform("v", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("p", F.row_number().over(o) - 1).withColumn("top", F.count("*").over(Window.partitionBy("track_id")) - 1)
    pairs = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / size)))
    queries = v.select("track_id", F.floor(F.col("p") / BLOCK).alias("b"), pairs(MEMBERS).alias("o"), "i", "v")
    members = v.select(F.col("track_id").alias("mt"), pairs(BLOCK).alias("qb"), F.floor(F.col("p") / MEMBERS).alias("mb"), F.col("i").alias("j"), F.col("v").alias("w"))
    kind = dict(v.dtypes)["track_id"]

    def best(key, left, right):
        import numpy as np
        import pandas as pd

        right = right.sort_values("j")
        x, y, i, j = np.array(left["v"].tolist()), np.array(right["w"].tolist()), left["i"].to_numpy(), right["j"].to_numpy()
        parts = []
        if len(x) and len(y):
            for a in range(0, len(x), 128):
                q, m, s = best_of(x[a : a + 128], y, i[a : a + 128], j, k, apart, measure)
                parts.append(pd.DataFrame({"track_id": key[0], "src": i[a + q], "dst": j[m], "sim": s}))
        return pd.concat(parts) if parts else pd.DataFrame({"track_id": [], "src": [], "dst": [], "sim": []})

    found = queries.groupBy("track_id", "b", "o").cogroup(members.groupBy("mt", "qb", "mb")).applyInPandas(best, f"track_id {kind}, src long, dst long, sim double")
    w = Window.partitionBy("track_id", "src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of(x, y, i, j, k: int, apart: int, measure: str):
    """(row, member, similarity) of the k best members y of each row x, numbered i and, rising, j; those that have none are left out.

    Products say which members can be among the best, up to their rounding; those are compared pair by pair.
    """
    import numpy as np

    with np.errstate(all="ignore"):
        size, other = (x * x).sum(1), (y * y).sum(1)
        if measure == "cosine":
            n = np.sqrt(size)[:, None] * np.sqrt(other)[None]
            s = np.divide(x @ y.T, n, out=np.zeros_like(n), where=n > 0)
            slack = np.full((len(x), 1), 1e-11)
        else:
            s = 2 * (x @ y.T) - size[:, None] - other[None]
            slack = 1e-15 * (x.shape[1] + 8) * (size + other[np.isfinite(other)].max(initial=0))[:, None]
        s[np.abs(i[:, None] - j[None]) <= apart] = -np.inf
        whole = np.isfinite(size).all() and np.isfinite(other).all()
        s[np.isnan(s)] = -np.inf
        limit = np.partition(s, len(y) - k, axis=1)[:, len(y) - k, None] if whole and k < len(y) else np.full((len(x), 1), -np.inf)
        q, m = np.nonzero((s >= limit - slack) & (s > -np.inf)) if whole else np.nonzero(np.abs(i[:, None] - j[None]) > apart)
        near = np.empty(len(q))
        for a in range(0, len(q), 1 << 15):
            u, v = q[a : a + (1 << 15)], m[a : a + (1 << 15)]
            if measure == "cosine":
                near[a : a + len(u)] = np.divide((x[u] * y[v]).sum(1), n[u, v], out=np.zeros(len(u)), where=n[u, v] > 0)
            else:
                near[a : a + len(u)] = -np.sqrt(((y[v] - x[u]) ** 2).sum(1))
    kept = np.isfinite(near)
    q, m, near = q[kept], m[kept], near[kept]
    order = np.lexsort((m, -near, q))
    q, m, near = q[order], m[order], near[order]
    first = np.searchsorted(q, q)
    kept = np.arange(len(q)) - first < k
    return q[kept], m[kept], near[kept]


def jump_graph(frames: DataFrame, k: int = 10, apart: int = 4, cut: float = 0.25) -> DataFrame:
    """The k best neighbours, cut in each track at the similarity that stands at a quarter of all, from the top."""
    e = nearest(frames, k, apart)
    # Ascending place ceil((1 - cut) m) is descending place floor(cut m), counted from 0.
    limit = e.groupBy("track_id").agg(F.expr(f"percentile_disc({1 - cut}) within group (order by sim)").alias("limit"))
    return e.join(limit, "track_id").where("sim >= limit").select("track_id", "src", "dst", "sim", "rank")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that exist both ways."""
    back = edges.select("track_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["track_id", "src", "dst"], "left_semi")


def recurrence(frames: DataFrame, k: int | None = None, apart: int = 3, n: int | None = None) -> DataFrame:
    """Mutual Euclidean neighbours (track_id, src, dst); k is 2 ceil(sqrt(n)) of each track's length by default."""
    if k is not None:
        return mutual(nearest(frames, k, apart, "euclid")).select("track_id", "src", "dst")
    size = frames.groupBy("track_id").agg((2 * F.ceil(F.sqrt(F.count("*")))).alias("_k"))
    top = n if n is not None else size.agg(F.max("_k")).first()[0] or 1
    e = nearest(frames, int(top), apart, "euclid").join(size, "track_id").where("rank <= _k")
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    way = F.when(F.col("src") < F.col("dst"), 1).otherwise(2)
    both = e.groupBy("track_id", low.alias("_a"), high.alias("_b")).agg(F.bit_or(way).alias("_w")).where("_w = 3")
    return both.select("track_id", F.explode(F.array(F.struct(F.col("_a").alias("src"), F.col("_b").alias("dst")), F.struct(F.col("_b").alias("src"), F.col("_a").alias("dst")))).alias("_e")).select("track_id", "_e.*")


def path_weights(frames: DataFrame) -> DataFrame:
    """Distance of each frame to the next of its track."""
    nxt = F.lead("v").over(Window.partitionBy("track_id").orderBy("i"))
    return frames.withColumn("_w", nxt).where("_w is not null").select("track_id", "i", distance("v", "_w").alias("d"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Frames with an edge by number of candidates: 1, 2-5, 6-10, more."""
    n = edges.groupBy("track_id", "src").agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 10, "6-10").otherwise(">10")
    return n.groupBy("track_id", kind.alias("candidates")).agg(F.count("*").alias("frames"), F.sum("n").alias("edges"))
