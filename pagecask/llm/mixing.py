"""Mixing sources to target weights (problem 7).

Poisson replication: each distinct text of a source has a uniform number from a
seeded hash; inverting the Poisson distribution at it gives how often the text
is used.  A source's mean is set so that its share of all tokens is the target;
counts stop at the source's cap, which the mean allows for.  Since the same
uniforms serve every mean, the realised size rises steadily with the mean, and
a few aggregations over grids of means set it by what is really drawn.

Defined results
    rows without a source, of a source without a target, or without tokens are
    not drawn; exact copies of a text in a source are one text, so together
    they are used at most max_repeats times; the total is the largest for which
    every source can reach its share, unless a smaller one is asked for; a
    source that must be used up is used max_repeats times throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecask.llm.tokens import VOCABULARY, count_tokens, vocabulary
from pagecask.sources.scratch import written

SEED = 1729
#: Means tried in each aggregation, per source, and how far they reach around the best so far.
GRID = 13
SPREADS = (0.25, 0.04, 0.007)
_TWO_53 = float(1 << 53)


def poisson_cdf(mean: float, k: int) -> float:
    """P(X <= k); 0 for an infinite mean."""
    if math.isinf(mean):
        return 0.0
    term = total = math.exp(-mean)
    for j in range(1, k + 1):
        term *= mean / j
        total += term
    return total


def capped_mean(mean: float, cap: int) -> float:
    """Expected count of a Poisson number that stops at ``cap``."""
    return sum(1 - poisson_cdf(mean, j) for j in range(cap))


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose capped mean is ``rate``."""
    if rate >= cap:
        return math.inf
    low, high = 0.0, max(1.0, rate)
    while capped_mean(high, cap) < rate and high < 600:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < rate else (low, mid)
    return (low + high) / 2


def thresholds(mean: float, cap: int) -> list[float]:
    """A text with uniform u is used once for each threshold that is <= u."""
    return [poisson_cdf(mean, j) for j in range(cap)]


def _with_uses(texts: DataFrame, means: list[tuple[str, int, float, int]]) -> DataFrame:
    """``texts`` with ``trial`` and how often each is used in it; ``means``: source, trial, mean, cap.

    The thresholds are a small table (a row a source and trial), so the plan
    does not grow with the sources, trials or repeats.
    """
    rows = [(s, g, thresholds(mean, cap)) for s, g, mean, cap in means]
    table = texts.sparkSession.createDataFrame(rows, "source string, trial int, _at array<double>")
    return texts.join(F.broadcast(table), "source").withColumn("_uses", F.size(F.filter("_at", lambda t: F.col("u") >= t))).drop("_at")


def distinct_texts(documents: DataFrame, sources: list[str], ranks: bytes, seed: int = SEED) -> DataFrame:
    """(source, doc_id, tokens, u): one row a distinct text of a source, its smallest doc_id, its tokens and uniform.

    Tokens are counted before the grouping, so texts are hashed where they are
    read and only hashes are shuffled; copies collapse map-side.
    """
    rows = documents.where(F.col("source").isin(sources)).select("source", "doc_id", F.xxhash64("text").alias("h1"), F.md5("text").alias("h2"), "text")
    counted = count_tokens(rows, "text", "tokens", ranks).where("tokens > 0")
    texts = counted.groupBy("source", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "h1", "h2"), 11) / F.lit(_TWO_53)
    return texts.select("source", "doc_id", "tokens", u.alias("u"))


def fit_means(texts: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """The Poisson mean of each source; a few aggregations of one row each over the texts' sizes."""
    have = {r.source: r.n for r in texts.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row a target source
    wanted = [(s, share, cap) for s, share, cap in targets if have.get(s) and share > 0 and cap > 0]
    if not wanted:
        return {}
    reach = min(cap * have[s] / share for s, share, cap in wanted)
    total = min(reach, total) if total else reach
    goal = {s: share * total for s, share, _ in wanted}
    means = {s: mean_for(goal[s] / have[s] * (1 - 1e-12) if goal[s] < cap * have[s] * (1 - 1e-9) else cap, cap) for s, _, cap in wanted}
    for spread in SPREADS:
        steps = [1 + spread * (g / (GRID // 2) - 1) for g in range(GRID)]
        open_ = [(s, cap) for s, _, cap in wanted if not math.isinf(means[s])]
        if not open_:
            break
        trials = [(s, g, means[s] * x, cap) for s, cap in open_ for g, x in enumerate(steps)]
        drawn = _with_uses(texts, trials).groupBy("source", "trial").agg(F.sum(F.col("tokens") * F.col("_uses")).alias("n"))
        got = {(r.source, r.trial): r.n for r in drawn.collect()}  # a row a source and trial
        for s, _ in open_:
            best = min(range(GRID), key=lambda g: (abs((got.get((s, g)) or 0) - goal[s]), abs(g - GRID // 2)))  # noqa: B023
            means[s] *= steps[best]
    return means


def mix(texts: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, seed: int = SEED) -> DataFrame:
    """(position, source, doc_id, repeat, tokens): every use of every text, in a global random order by ``position``."""
    means = fit_means(texts, targets, total)
    caps = {s: cap for s, _, cap in targets}
    drawn = _with_uses(texts, [(s, 0, m, caps[s]) for s, m in means.items()]).where("_uses > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("_uses"))))
    position = F.xxhash64(F.lit(seed + 1), "source", "doc_id", "repeat")
    return drawn.select(position.alias("position"), "source", "doc_id", "repeat", "tokens").orderBy("position", "source", "doc_id", "repeat")


def _inputs(spark: SparkSession, sf_dir: str, path: str) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    rows = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").orderBy("source").collect()  # settings, six rows
    targets = [(r.source, r.target_share, r.max_repeats) for r in rows if r.source is not None]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return written(distinct_texts(documents, [s for s, _, _ in targets], vocabulary(path)), "mix-texts"), targets


def p7_mixed(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    texts, targets = _inputs(spark, sf_dir, path)
    return mix(texts, targets)


def p7_shares(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """Target and reached share of each source."""
    texts, targets = _inputs(spark, sf_dir, path)
    drawn = mix(texts, targets).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("repeat").alias("most_repeats"))
    want = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out = F.broadcast(want).join(drawn, "source", "left").fillna(0, ["tokens", "uses", "most_repeats"])
    reached = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())  # a row a source
    return out.select("source", "target_share", F.round(reached, 6).alias("reached_share"), "tokens", "uses", "most_repeats", "max_repeats")
