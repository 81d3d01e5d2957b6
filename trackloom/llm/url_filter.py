"""URL filters: host word segmentation, then naive Bayes over host and path tokens.

Rules of a host and a path prefix come first: a rule fits its host and all subdomains if the url's path begins with its path,
and the longest one wins. Where no rule fits, the host's labels are split into words by a unigram Viterbi (concatenated names:
``cheappills`` is ``cheap pills``), and a multinomial naive Bayes scores the words of host and path.

The unigram counts come from all pages: the words of all titles, the words of paths and the hyphenated parts of hosts. They are a table:
each distinct run of letters is joined to the counts of its substrings of up to 24 letters, and split with those alone, so the driver
and the workers hold no vocabulary. Runs are scored once each, and pages add up the scores of their runs. The classifier is trained on the
labelled names below; the verdicts of the rules aren't used for training, as they tell a domain's policy and not what a name means.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; the scheme may be anything; with an
empty host the path is scored; tokens unknown to the classifier say nothing; an even score allows; of equally likely splits the one
with the shortest last word wins; urls of any length are read whole; repeated pages are judged row by row; an empty table gives an empty
result; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import ascii_lower, map_arrow, materialize

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PRIOR_BLOCK = 0.3
#: Runs that stand in more than a thousandth of all places, and so often, are at most a thousand; their scores are broadcast.
SHARE = 1000
#: Labelled names for training: what is sold or offered by hosts to block, and what ordinary hosts are about.
BLOCK_NAMES = (
    "cheap pills", "spam farm", "casino win", "free bets", "ads track", "adult x", "online casino", "poker bonus", "viagra pills", "cheap meds", "payday loan", "fast loans",
    "xxx video", "adult dating", "sex cam", "porn tube", "lottery prize", "win prize", "free money", "replica watches", "crack keygen", "warez torrent", "click ads", "ad tracker",
    "bet win", "betting odds", "slots jackpot", "seo links", "link farm", "spam mail", "buy followers", "weight loss pills", "crypto doubler", "hot singles", "escort adult", "pharma cheap",
)
ALLOW_NAMES = (
    "city news", "daily weather", "science journal", "public library", "university press", "history museum", "health clinic", "school lessons", "music archive", "open source docs",
    "travel guide", "food recipes", "garden club", "film review", "book store", "local sport", "tech blog", "math forum", "art gallery", "law review", "family stories", "home page",
    "encyclopedia wiki", "nature photos", "language course", "national parks", "train times", "bank services", "market report", "research paper", "theatre", "there and then", "the other", "that one",
)


class Segmenter:
    """The most likely split of a name into words by unigram counts; an unknown word costs more the longer it is."""

    LONGEST = 24

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) or 1
        self.logs = {w: math.log(n / self.total) for w, n in counts.items()}

    def unknown(self, length: int) -> float:
        return math.log(10 / self.total) - length * math.log(10)

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        strange = [self.unknown(k) for k in range(self.LONGEST + 1)]
        for end in range(1, len(name) + 1):
            options = ((best[at] + self.logs.get(name[at:end], strange[end - at]), -at) for at in range(max(0, end - self.LONGEST), end))
            value, at = max(options)
            best.append(value)
            back.append(-at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


class NaiveBayes:
    """Multinomial, with add-one smoothing over the tokens seen in training."""

    def __init__(self, blocked: list[list[str]], allowed: list[list[str]], prior: float = PRIOR_BLOCK):
        a, b = Counter(t for x in blocked for t in x), Counter(t for x in allowed for t in x)
        known = set(a) | set(b)
        na, nb = sum(a.values()) + len(known), sum(b.values()) + len(known)
        self.gain = {t: math.log((a[t] + 1) / na) - math.log((b[t] + 1) / nb) for t in known}
        self.base = math.log(prior / (1 - prior))

    def score(self, tokens: list[str]) -> float:
        """The log-odds of block."""
        return self.base + sum(self.gain.get(t, 0.0) for t in tokens)


def is_word(w: str) -> bool:
    """Single letters are no words, but for two."""
    return len(w) > 1 or w in ("a", "x")


class UrlModel:
    """The classifier, and the unigram model of the trained words, which belong to the vocabulary even where no page has them yet."""

    def __init__(self, blocked: tuple[str, ...] = BLOCK_NAMES, allowed: tuple[str, ...] = ALLOW_NAMES):
        self.seeds = Counter(w for x in (*blocked, *allowed) for w in x.split())
        self.bayes = NaiveBayes([x.split() for x in blocked], [x.split() for x in allowed])

    def segmenter(self, counts: dict[str, int], everything: int, words: int) -> Segmenter:
        """counts: of the words that matter; everything, words: the counts of all words, and of those that is_word() holds for."""
        floor = max(2, everything // 10_000)
        merged = {w: n for w, n in counts.items() if is_word(w)}
        for w, n in self.seeds.items():
            if is_word(w):
                merged[w] = merged.get(w, 0) + floor * n
        return Segmenter(merged, words + floor * sum(n for w, n in self.seeds.items() if is_word(w)))

    def gain(self, words: list[str]) -> float:
        return self.bayes.score(words) - self.bayes.base


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; null if none."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def letters(c: Column) -> Column:
    """Its runs of a-z after lower-casing."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def word_counts(pages: DataFrame, *, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(w, n): how often each word of up to 24 letters stands in titles, paths and hyphenated parts of hosts."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parts = F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-"))), lambda x: F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0))))
    lists = [parts, letters(path)]
    if html_col:
        titles = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)<title[^>]*>([^<]*)"), F.lit(1))
        lists.append(letters(F.array_join(titles, " ")))
    return pages.select(F.explode(F.concat(*lists)).alias("w")).where(f"length(w) <= {Segmenter.LONGEST}").groupBy("w").agg(F.count("*").alias("n"))


def runs_of(host: Column, path: Column) -> Column:
    """The runs of letters of the host's labels but for the last, and of the path."""
    labels = F.when(F.contains(host, F.lit(".")), F.regexp_replace(host, r"\.[^.]*$", "")).otherwise(host)
    return F.concat(letters(labels), letters(path))


def segmented(runs: DataFrame, counts: DataFrame, model: UrlModel) -> DataFrame:
    """(run, words, gain) of distinct runs: each is split with the counts of its own substrings only."""
    word = (F.length("w") > 1) | F.col("w").isin("a", "x")
    everything, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0))).first()
    tails = F.expr(f"transform(sequence(1, length(run)), i -> substring(run, i, {Segmenter.LONGEST}))")
    parts = runs.select("run", F.explode(F.array_distinct(tails)).alias("tail"))
    parts = parts.select("run", F.explode(F.expr("transform(sequence(1, length(tail)), j -> substring(tail, 1, j))")).alias("w")).distinct()
    known = parts.join(counts, "w").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("known"))
    both = runs.join(known, "run", "left").select("run", F.map_keys("known").alias("ws"), F.map_values("known").alias("ns"))

    def work(batches):
        import pyarrow as pa

        for b in batches:
            names, splits = b.column(0).to_pylist(), []
            for run, ws, ns in zip(names, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                splits.append(model.segmenter(dict(zip(ws or [], ns or [], strict=True)), everything, words).split(run))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(splits, pa.list_(pa.string())), pa.array(map(model.gain, splits), pa.float64())], names=["run", "words", "gain"])

    return map_arrow(both, work, "run string, words array<string>, gain double")


def judge(pages: DataFrame, model: UrlModel | None = None, *, url_col: str = "url", html_col: str | None = "html", keep: tuple[str, ...] = ("page_id",), rules=RULES) -> DataFrame:
    """keep's columns, host, path, rule, verdict and url_score (the log-odds of block; null where a rule decides or the url is empty)."""
    model = model or UrlModel()
    ruled = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    # Numbered and written once, so that the numbers stand.
    ruled = materialize(ruled.withColumn("_row", F.monotonically_increasing_id()), "pages")
    open_ = ruled.where("rule is null and (host <> '' or path <> '')")
    placed = open_.select("_row", F.explode(runs_of(F.col("host"), F.col("path"))).alias("run"))
    stats = materialize(placed.groupBy("run").agg(F.count("*").alias("places")), "runs")
    counts = materialize(word_counts(pages, url_col=url_col, html_col=html_col), "words")
    # Runs that say nothing need not be looked up.
    scored = materialize(segmented(stats.select("run"), counts, model).where("gain <> 0").select("run", "gain"), "run-scores")
    most = max(SHARE, (stats.agg(F.sum("places")).first()[0] or 0) // 1000)
    usual = [(r["run"], r["gain"]) for r in scored.join(stats.where(F.col("places") > most), "run").collect()]
    frequent = F.broadcast(pages.sparkSession.createDataFrame(usual, "run string, gain double"))
    rest = placed.join(F.broadcast(frequent.select("run")), "run", "left_anti").join(scored, "run")
    gains = placed.join(frequent, "run").select("_row", "gain").unionByName(rest.select("_row", "gain")).groupBy("_row").agg(F.sum("gain").alias("gain"))
    out = ruled.join(gains, "_row", "left")
    asked = F.col("rule").isNull() & ((F.col("host") != "") | (F.col("path") != ""))
    out = out.withColumn("url_score", F.when(asked, F.lit(model.bayes.base) + F.coalesce("gain", F.lit(0.0))))
    verdict = F.when(F.col("url_score") > 0, "block").otherwise("allow")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, what).otherwise(verdict)
    return out.withColumn("verdict", verdict).select(*keep, "host", "path", "rule", "verdict", "url_score")


def op3(spark, sf_dir) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
