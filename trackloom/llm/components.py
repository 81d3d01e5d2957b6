"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import discard, materialize


#: Links of one node that a single task may get in any case.
SHARE = 1000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the links (src, dst): root is the smallest node that links reach.

    Alternates large-star and small-star steps: each node's larger neighbours are linked to its smallest one, then each node and
    its smaller neighbours are. Every step is a minimum per key, which is combined before the shuffle, and a join back. Rounds are cut off
    from each other by tables in the shared folder.

    Nodes with more than a thousandth of all links (and SHARE of them) are at most two thousand; their minimum is broadcast, so their links need no
    shuffle and no task gets all the links of one node.

    Null ends are skipped, loops and repeated links change nothing, and no links give an empty table.
    """
    e = links.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = written = materialize(e, "links")
    before = fingerprint(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = with_minimum(both, before[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        star = materialize(star, "links")
        small = with_minimum(star, before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = materialize(small.where("u <> v").distinct(), "links")
        discard(written, star)
        written = e
        now = fingerprint(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_minimum(e: DataFrame, links: int) -> DataFrame:
    """e with m, the smallest v of each u."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    most = max(SHARE, links // 1000)
    hot = [(r["u"], r["m"]) for r in low.where(F.col("c") > most).collect()]
    if not hot:
        return e.join(low.drop("c"), "u")
    h = F.broadcast(e.sparkSession.createDataFrame(hot, "u long, m long"))
    return e.join(h, "u").unionByName(e.join(h, "u", "left_anti").join(low.drop("c"), "u"))


def fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
