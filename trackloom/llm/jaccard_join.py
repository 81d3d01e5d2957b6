"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds the 62-bit hashes of its distinct word shingles. Rows with equal sets are one class from the start; classes
are numbered, in the order of their smallest ids, so an id of several texts has several classes, each with its own set.

Prefixes. Tokens are put in one global order, rare ones by hash and after them the frequent ones, which a first pass has counted.
Two sets of similarity t share their first common token within the first ``n - ceil(t n) + 1`` tokens of each, and their first k common
tokens within k - 1 more, so nothing else is indexed.

Rare tokens are indexed singly. Pairs of a list are counted over all their shared prefix tokens: overlap can be no more than the
shared prefix tokens plus what lies behind both prefixes, so nearly all pairs that share a token or two go at once.

A frequent token's list is first joined to its smallest class; a list that this makes one component is settled. The lists left open are
compared in one block each if they are small. A larger one is indexed by combinations instead: prefixes are extended by a token, and
each member stands under every pair of the token and one behind it; lists of pairs that are still large are extended to triples and so on, as long
as this makes fewer comparisons and pairs of different sets must share that many tokens. What is left is compared in blocks of bounded
size, whose tasks return a spanning forest of the links they find, never the pairs. No pair that may link is left out.

Defined results: null texts and texts without words have empty sets, link with nothing and are components of their own; texts of
fewer words than a shingle are one shingle; texts of any length are taken whole; rows that share an id are one document, which links by each
of its texts; rows without an id are never linked and have no component; ids that aren't integers are refused; of equal ids, sizes or
hashes the order changes no result; an empty table gives an empty result; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import chunks, discard, map_arrow, materialize, texts_of, worker_cache
from trackloom.llm.components import components

SHINGLE = 5
THRESHOLD = (80, 100)
#: A token in the prefixes of more documents than this is frequent.
FREQUENT = 40
#: Share of a set, in the order of the hashes, over which tokens are counted to find the frequent ones.
COUNTED = 0.25
#: So many frequent tokens are broadcast at most; the bound on FREQUENT is doubled until they are fewer.
MOST_FREQUENT = 1_000_000
#: So many ids are broadcast at most, to fetch the sets of candidates; more are fetched by a shuffled join.
MOST_IDS = 4_000_000
BLOCK = 384
STEPS = 16
#: Tokens of the longest combinations of frequent tokens.
MOST_COMBINED = 3
_FLAG = np.int64(1 << 62)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words; emptied when large, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The set: sorted distinct 62-bit hashes of runs of k words, A-Z lower-cased; of all words if there are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(worker_cache("shingles", WordHashes).__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * _MUL
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique((h >> np.uint64(2)).astype(np.int64))


def prefix_length(n: int, t: tuple[int, int] = THRESHOLD) -> int:
    return n + (-t[0] * n // t[1]) + 1 if n else 0


def mapped(docs: DataFrame, work, schema: str, k: int) -> DataFrame:
    """work(id list, sets of k words a shingle) -> arrow columns, over batches of bounded size."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch)
            for a, b in chunks([len(t or b"") for t in texts], 4 << 20):
                yield pa.RecordBatch.from_arrays(work(batch.column(0).slice(a, b - a), [shingles(t, k) for t in texts[a:b]]), names=names)

    return map_arrow(docs, run, schema, "shingles")


def listed(arrays: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def frequent_tokens(docs: DataFrame, most: int, k: int = SHINGLE) -> np.ndarray:
    """Tokens that more than ``most`` documents have among the first quarter of their set by hash; ``most`` doubles until they are few."""

    def work(ids, sets):
        return [listed([s[: max(prefix_length(len(s)), int(COUNTED * len(s)))] for s in sets])]

    counts = mapped(docs, work, "tokens array<long>", k).select(F.explode("tokens").alias("k")).groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > most)
    counts = materialize(counts, "frequent")
    while counts.where(F.col("c") > most).count() > MOST_FREQUENT:
        most *= 2
    return np.sort(np.fromiter((r["k"] for r in counts.where(F.col("c") > most).toLocalIterator()), np.int64))


def indexed(docs: DataFrame, frequent: np.ndarray, k: int = SHINGLE) -> DataFrame:
    """id, n, a fingerprint of the set, the length p of its prefix, the tokens of the extended prefix in the global order and STEPS of the prefix as a sketch of it."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(ids, sets):
        import pyarrow as pa

        known = shared.value
        keys, lengths, sketches = [], [], []
        for s in sets:
            p, order = prefix_length(len(s)), s
            if len(known) and len(s):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                usual = known[at] == s
                if usual.any():
                    order = np.concatenate([s[~usual], s[usual] + _FLAG])
            own = order[:p]
            keys.append(order[: p + MOST_COMBINED - 1])
            lengths.append(p)
            sketches.append(own[-(-p * np.arange(1, STEPS + 1) // STEPS) - 1] if p else own)
        low, high = marks_of(sets)
        return [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), pa.array(lengths, pa.int32()), listed(keys), listed(sketches)]

    return mapped(docs, work, "id long, n long, f1 long, f2 long, p int, tokens array<long>, sketch array<long>", k)


def pack(s: np.ndarray) -> bytes:
    return s.astype("<i8").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i8")


def marks_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of each set's 128-bit fingerprint; 0 for the empty set."""
    import xxhash

    marks = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
    low, high = (np.array([(m >> q & 0xFFFFFFFFFFFFFFFF) for m in marks], np.uint64).astype(np.int64) for q in (0, 64))
    return low, high


def sets_of(docs: DataFrame, classes: DataFrame, repeated: bool, k: int = SHINGLE) -> DataFrame:
    """(id, set) of these classes (cid, rid, f1, f2, n), where id is cid. repeated: whether a text may stand twice under one id."""

    def work(found, sets):
        import pyarrow as pa

        low, high = marks_of(sets)
        return [pa.array(low), pa.array(high), pa.array([len(s) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())]

    ids = classes.select(F.col("rid").alias("id")).distinct()
    found = mapped(only(docs, ids, "id"), work, "f1 long, f2 long, n long, set binary", k)
    if repeated:
        found = found.groupBy("f1", "f2", "n").agg(F.min("set").alias("set"))
    # An id's other texts have other fingerprints.
    return found.join(classes, ["f1", "f2", "n"]).select(F.col("cid").alias("id"), "set")


def only(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """df's rows whose key is among the distinct keys, which are broadcast if they are few enough."""
    return df.join(F.broadcast(keys) if keys.count() <= MOST_IDS else keys, name, "left_semi")


def classes_of(linkable: DataFrame) -> DataFrame:
    """A row for each set: f1, f2, n, p, tokens, sketch, its smallest id rid, and a number cid that grows with rid."""
    found = linkable.groupBy("f1", "f2", "n").agg(F.min("id").alias("rid"), F.first("p").alias("p"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    found = materialize(found, "classes")
    if found.groupBy("rid").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return found.withColumn("cid", F.col("rid"))
    return materialize(found.repartitionByRange("rid").sortWithinPartitions("rid", "f1", "f2", "n").withColumn("cid", F.monotonically_increasing_id()), "classes")


def overlaps(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Of (x, y, nx, ny), those whose sets are similar, as (src, dst)."""
    sized = pairs.join(sets.select(F.col("id").alias("x"), F.col("set").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("set").alias("sy")), "y")

    def work(batches):
        import pyarrow as pa

        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            x, y, nx, ny = (c[n].to_numpy(zero_copy_only=False) for n in ("x", "y", "nx", "ny"))
            both = np.array([overlaps(unpack(p), unpack(q)) for p, q in zip(c["sx"].to_pylist(), c["sy"].to_pylist(), strict=True)], np.int64)
            ok = t[1] * both >= t[0] * (nx + ny - both)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], names=["src", "dst"])

    return map_arrow(sized.select("x", "y", "nx", "ny", "sx", "sy"), work, "src long, dst long")


def forest(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, t: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among the block's documents; pairs of one group are linked already."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, token, seen = np.unique(flat, return_inverse=True, return_counts=True)
    keep = seen[token] > 1
    token, row = np.unique(token[keep], return_inverse=True)[1], row[keep]
    width = int(token.max()) + 1 if len(token) else 0
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    for a in range(0, width, 2048):
        i, j = np.searchsorted(token, (a, a + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[i:j], token[i:j] - a] = 1
        both += part @ part.T
    # t1 both >= t0 (na + nb - both); all numbers are whole and far below the limits of float32
    both *= t[0] + t[1]
    sizes = (t[0] * sizes).astype(np.float32)
    linked = both >= sizes[:, None] + sizes[None, :]
    del both
    linked |= groups[:, None] == groups[None, :]
    i, j = np.nonzero(linked)
    del linked
    root = np.arange(len(ids))
    while True:  # the smallest place that links reach
        new = root.copy()
        np.minimum.at(new, i, root[j])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(ids[k]), int(ids[r])) for k, r in enumerate(root) if k != r]


def in_blocks(members: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Links (src, dst) among the members (key, c, cid, comp, n) of each list of c, by pairs of blocks."""
    count = F.ceil(F.col("c") / BLOCK).cast("int")
    placed = members.withColumn("nb", count).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    own = only(sets.withColumnRenamed("id", "cid"), members.select("cid").distinct(), "cid")
    placed = placed.join(own, "cid").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = placed.select("key", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "cid", "comp", "n", "set")

    def work(keys, pdf):
        import pandas as pd

        found = forest(pdf["cid"].to_numpy(), pdf["comp"].to_numpy(), [unpack(s) for s in pdf["set"]], pdf["n"].to_numpy(), t)
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return placed.groupBy("key", "b1", "b2").applyInPandas(work, "src long, dst long")


def open_lists(members: DataFrame) -> DataFrame:
    """(key, c) of the lists that aren't one component yet; of lists of equal members the one of the smallest key.

    A pair's key is made of its first common tokens. Where another list has the same members, its key is made of common tokens too, so none
    that is smaller can exist: the smallest key is the one under which all pairs of these members are met.
    """
    mark = [F.sum(F.xxhash64(F.lit(k), "cid").cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2)]
    lists = members.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *mark).where("lo <> hi")
    return lists.groupBy("c", "m1", "m2").agg(F.min("key").alias("key")).select("key", "c")


def combined(members: DataFrame, classes: DataFrame, longest: int) -> DataFrame:
    """(key, c, cid, comp, n): lists of open keys, in which every pair of different components that may link is met.

    members: (key, cid, comp, n) of single tokens, the key an array. Lists of more than BLOCK members are split by one token more, behind
    the last one in the extended prefix, if the lists of the longer keys make less than half as many pairs.
    """
    done = []
    for k in range(1, longest + 1):
        lists = open_lists(members)
        members = materialize(members.join(lists, "key").select("key", "c", "cid", "comp", "n"), "lists")
        large = members.where(F.col("c") > BLOCK)
        if k == longest or large.isEmpty():
            return union([*done, members])
        tokens = large.join(only(classes.select("cid", "p", "tokens"), large.select("cid").distinct(), "cid"), "cid")
        at = F.array_position("tokens", F.element_at("key", -1)).cast("int")
        behind = F.slice("tokens", at + 1, F.greatest(F.col("p") + k - at, F.lit(0)))
        longer = tokens.withColumn("u", F.explode(behind)).select("key", F.concat("key", F.array("u")).alias("longer"), "c", "cid", "comp", "n")
        longer = materialize(longer, "combinations")
        cost = longer.groupBy("key", "c", "longer").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        pairs = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.col("m") * (F.col("m") - 1))
        cost = cost.groupBy("key", "c").agg(F.sum(pairs).alias("pairs"))
        split = materialize(cost.where(2 * F.col("pairs") < F.col("c") * (F.col("c") - 1)).select("key"), "split")
        done.append(members.join(split, "key", "left_anti"))
        members = longer.join(split, "key", "left_semi").select(F.col("longer").alias("key"), "cid", "comp", "n")
    return union(done)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bound(s: Column, x: str, y: str) -> Column:
    """The most that two sets can overlap: shared prefix tokens, and what lies behind the end of the shorter prefix in either."""
    end = F.least(F.element_at(f"{x}.sketch", -1), F.element_at(f"{y}.sketch", -1))
    behind = []
    for a in (x, y):
        seen = F.size(F.filter(f"{a}.sketch", lambda k: k <= end))
        behind.append(F.col(f"{a}.n") - F.ceil(F.col(f"{a}.p") * seen / STEPS))
    return s + F.least(*behind)


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: its id, n_shingles and component_id, the smallest id that links reach."""
    t = threshold
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError("ids must be integers")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    usual = frequent_tokens(docs, frequent, shingle)
    rows = materialize(indexed(docs, usual, shingle), "prefixes")
    linkable = rows.where("n > 0 and id is not null")
    classes = classes_of(linkable)
    entries = classes.select("cid", "n", F.explode(F.slice("tokens", F.lit(1), F.col("p"))).alias("token"))
    lists = entries.groupBy("token").agg(F.count("*").alias("c"), F.min("cid").alias("first")).where("c > 1")
    shared = materialize(entries.join(lists, "token"), "shared")
    small, large = shared.where(F.col("c") <= frequent), shared.where(F.col("c") > frequent)

    near = lambda a, b: (t[1] * F.least(a, b) >= t[0] * F.greatest(a, b))
    # At most FREQUENT members a list, so pairs stay within FREQUENT / 2 times the entries.
    groups = small.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("cid", "n"))).alias("m"))
    pairs = groups.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    pairs = pairs.where((F.col("x.cid") < F.col("y.cid")) & near(F.col("x.n"), F.col("y.n"))).groupBy("x.cid", "y.cid").agg(F.count("*").alias("s")).toDF("x", "y", "s")
    hidden = large.groupBy("cid").agg(F.count("*").alias("u"))
    about = classes.select("cid", F.struct("n", "p", "sketch").alias("a"))
    about = about.join(hidden, "cid", "left").select("cid", "a", F.coalesce("u", F.lit(0)).alias("u"))
    both = pairs.join(about.select(F.col("cid").alias("x"), F.col("a").alias("ax"), F.col("u").alias("ux")), "x").join(about.select(F.col("cid").alias("y"), F.col("a").alias("ay"), F.col("u").alias("uy")), "y")
    most = bound(F.col("s") + F.least("ux", "uy"), "ax", "ay")
    likely = both.where(t[1] * most >= t[0] * (F.col("ax.n") + F.col("ay.n") - most)).select("x", "y", F.col("ax.n").alias("nx"), F.col("ay.n").alias("ny"))
    # A frequent token's members against the smallest of them.
    sizes = classes.select(F.col("cid").alias("first"), F.col("n").alias("nf"))
    star = large.where("cid <> first").select("first", "cid", "n").distinct().join(sizes, "first").where(near(F.col("n"), F.col("nf")))
    star = star.select(F.col("first").alias("x"), F.col("cid").alias("y"), F.col("nf").alias("nx"), F.col("n").alias("ny"))
    tried = materialize(likely.unionByName(star).distinct(), "pairs")

    needed = tried.select("x").union(tried.select("y")).union(large.select("cid")).distinct().toDF("cid")
    ids = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    repeated = materialize(ids, "repeated")
    sets = materialize(sets_of(docs, classes.select("cid", "rid", "f1", "f2", "n").join(needed, "cid", "left_semi"), not repeated.isEmpty(), shingle), "sets")
    links = materialize(verified(tried, sets, t), "verified")
    part = components(links)
    # Sets of t0 / t1 that differ share t0 / (t1 - t0) tokens at least, so combinations of no more tokens lose nothing.
    longest = max(1, min(MOST_COMBINED, t[0] // max(1, t[1] - t[0])))
    grouped = large.join(part.select(F.col("node").alias("cid"), F.col("root").alias("r")), "cid", "left")
    grouped = grouped.select(F.array("token").alias("key"), "cid", F.coalesce("r", "cid").alias("comp"), "n")
    more = materialize(in_blocks(combined(grouped, classes, longest), sets, t), "blocks")
    discard(sets, tried, shared)
    # Rows that share an id tie their classes together.
    narrow = classes.select("f1", "f2", "n", "cid", "rid")
    own = linkable.select("id", "f1", "f2", "n").join(repeated, "id", "left_semi").join(narrow, ["f1", "f2", "n"]).select("id", "cid").distinct()
    own = materialize(own, "own")
    least = own.groupBy("id").agg(F.min("cid").alias("a"))
    tied = own.join(least, "id").where("cid <> a").select(F.col("a").alias("src"), F.col("cid").alias("dst"))
    roots = components(links.unionByName(more).unionByName(tied))
    # The smallest number of a component belongs to the class with its smallest id.
    named = roots.join(narrow.select(F.col("cid").alias("root"), F.col("rid").alias("named")), "root").select(F.col("node").alias("cid"), "named")
    rooted = narrow.join(named, "cid", "left").withColumn("root", F.coalesce("named", "rid"))
    # A repeated id's texts without words go with its others.
    also = least.join(rooted.select(F.col("cid").alias("a"), F.col("root").alias("also")), "a").select("id", "also")
    out = rows.select("id", "n", "f1", "f2").join(rooted.select("f1", "f2", "n", "root"), ["f1", "f2", "n"], "left")
    out = out.join(also, "id", "left").select("id", "n", F.coalesce("root", "also").alias("root"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, the smallest id; same columns. Of rows that share that id one stays; rows without an id all stay."""
    found = similar(docs, id_col=id_col, text_col=text_col, **options)
    found = materialize(found.select(F.col(id_col).alias("_id"), "component_id").where("_id is not null"), "components")
    gone = found.where("_id <> component_id").select("_id").distinct()
    few = gone.count() <= MOST_IDS
    own = docs[id_col]
    out = docs.join(F.broadcast(gone) if few else gone, own == F.col("_id"), "left_anti")
    twice = materialize(found.groupBy("_id").agg(F.count("*").alias("c")).where("c > 1 and _id is not null").select("_id"), "twice")
    if twice.isEmpty():
        return out
    # Rows of an id that stands more than once are few next to the others, which need no shuffle.
    twice = F.broadcast(twice) if twice.count() <= MOST_IDS else twice
    once, again = out.join(twice, own == F.col("_id"), "left_anti"), out.join(twice, own == F.col("_id"), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col]))


def op9(spark, sf_dir) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
