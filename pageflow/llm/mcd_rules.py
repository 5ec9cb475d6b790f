"""Quality rules by robust multivariate outliers, in DataFrame and SQL functions only.

Each text gives five statistics. Per language and source, the minimum-covariance-determinant estimate of their centre
and scatter is found by concentration steps from two starts (medians and interquartile ranges; mean and covariance): take
the `share` of documents nearest by Mahalanobis distance and estimate again from these, until no group's determinant
falls any more or `steps` are over. Of the two the one with the smaller determinant counts. Documents whose squared
distance lies beyond the chi-square quantile that `alarm` of all clean documents exceed are rejected: with the default, one
in 10^11, so that even a very large corpus keeps its clean documents. Groups under `least` documents are pooled; a pool
that small gives no verdict.

Rows never move to a model: models, one row for each group and start, are broadcast while there are at most `most_models`
of them, else joined over `salts` parts of each group. All sums and quantiles are combined within tasks first.

Statistics of a text are made within its row, without a shuffle, however long it is: three-word windows are compared
by 64-bit hashes, and only texts that have a repeated window sort theirs with positions. Null and empty texts have no
words and fail the base rule. Null language or source is a value of its own. Rows are judged one by one, so repeated rows
and ids, ties and null ids are separate rows with equal verdicts. An empty table gives an empty result; only doc_id, text,
lang and source are read, so other columns may have any names. Repeated windows are told by 64-bit hashes: among n windows
of one text a false match has a chance of about n^2 / 2^65, below 10^-9 for texts of 100,000 words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch

#: Transformed statistics, and the least spread that is taken as real in each.
FLOORS = {"log_words": 0.35, "log_length": 0.05, "log_symbols": 0.25, "log_dup_lines": 0.35, "repeats": 0.06}


def windows_of(words: Column) -> Column:
    """Hashes of the three-word windows, in text order; null where no two can be equal."""
    return F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("windows", windows_of(F.col("words")))
    # Windows in hash order; those beside an equal one are repeated; their positions again in text order.
    at = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    some = d.withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.array_sort(at)))
    equal = lambda x, k: F.coalesce(F.get(F.col("sorted"), k)["w"] == x["w"], F.lit(False))
    hits = F.array_sort(F.transform(F.filter("sorted", lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"]))
    some = some.withColumn("hits", hits)
    covered = F.expr("aggregate(hits, named_struct('n', 0L, 'last', -9), (acc, i) -> named_struct('n', acc.n + least(3, i - acc.last), 'last', i), acc -> acc.n)")
    return some.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _group(*names: str) -> Column:
    return F.concat(*(F.when(F.col(n).isNull(), "-").otherwise(F.concat(F.length(n).cast("string"), F.lit(":"), F.col(n))) for n in names))


def _estimate(rows: DataFrame, names: list[str], scale: float) -> DataFrame:
    """Centre m_i, inverse Cholesky factor k_ij and half the log determinant of each group and start, from the rows' x_i.

    Spreads have a floor.
    """
    d = len(names)
    sums = rows.groupBy("group", "start").agg(
        F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(d)), *(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(d) for j in range(i + 1))
    )
    for i in range(d):
        for j in range(i + 1):
            c = F.lit(scale) * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
            c = F.greatest(c, F.lit(0.0)) + F.lit(FLOORS[names[i]] ** 2) if i == j else c
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    for i in range(d):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                value = sum((-F.col(f"l{i}{k}") * F.col(f"k{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
            sums = sums.withColumn(f"k{i}{j}", value)
    volume = sum((F.log(F.col(f"l{i}{i}")) for i in range(d)), F.lit(0.0)).alias("volume")
    return sums.select("group", "start", "n", volume, *(f"m{i}" for i in range(d)), *(f"k{i}{j}" for i in range(d) for j in range(i + 1)))


def _distance(d: int) -> Column:
    total = F.lit(0.0)
    for i in range(d):
        y = sum((F.col(f"k{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def quantile(alarm: float) -> float:
    """What a chi-square variable with five degrees of freedom exceeds with probability `alarm`, by bisection."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        x = (low + high) / 2
        beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if beyond > alarm else (low, x)
    return low


def _attach(rows: DataFrame, models: DataFrame, on: list[str], how: str, broadcast: bool, salts: int) -> DataFrame:
    """rows (with a salt) joined with small rows per group: broadcast, or over the salted parts of each group."""
    if broadcast:
        return rows.join(F.broadcast(models), on, how)
    every = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(every, [*on, "salt"], how)


def judge(docs: DataFrame, *, share: float = 0.75, steps: int = 12, alarm: float = 1e-11, least: int = 40, consistency: float = 1.413, most_models: int = 20_000, salts: int = 32) -> DataFrame:
    """statistics() with base_failed, distance (null: no verdict) and kept. One row per document."""
    scratch = Scratch(docs.sparkSession)
    names = list(FLOORS)
    d = len(names)
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / n),
        F.log1p(F.lit(100.0) * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p("n_dup_lines"),
        F.col("n_repeat_words") / n,
    ]
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    stats = statistics(docs).withColumns({f"x{i}": e.cast("double") for i, e in enumerate(x)})
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")
    stats = scratch.save(stats.withColumns({"base_failed": failed, "own": _group("lang", "source"), "salt": salt}), "stats")
    groups = scratch.save(stats.groupBy("own").agg(F.count_if(~F.col("base_failed")).alias("in_group")), "groups")
    small = groups.count() <= most_models
    pooled = F.when(F.col("in_group") >= least, F.col("own")).otherwise("")
    grouped = _attach(stats, groups, ["own"], "inner", small, salts).withColumn("group", pooled).drop("own", "in_group")
    xs = [f"x{i}" for i in range(d)]
    fit = grouped.filter("not base_failed").select("group", "salt", *xs)

    middle = fit.groupBy("group").agg(F.count("*").alias("n"), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, c in enumerate(xs)))
    first = {f"m{i}": F.col(f"q{i}")[1] for i in range(d)}
    for i, name in enumerate(names):
        for j in range(i + 1):
            first[f"k{i}{j}"] = 1 / F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[name])) if i == j else F.lit(0.0)
    robust = middle.withColumns(first).withColumns({"start": F.lit(0), "volume": F.lit(float("inf"))})
    plain = _estimate(fit.withColumn("start", F.lit(1)), names, 1.0).withColumn("volume", F.lit(float("inf")))
    model = scratch.save(robust.select(plain.columns).unionByName(plain), "model0")
    for k in range(1, steps + 1):
        near = _attach(fit, model.drop("n", "volume"), ["group"], "inner", small, salts).withColumn("d2", _distance(d)).select("group", "start", "salt", "d2", *xs)
        limits = scratch.save(near.groupBy("group", "start").agg(F.percentile_approx("d2", share, 2000).alias("most")), f"limit{k}")
        inner = _attach(near, limits, ["group", "start"], "inner", small, salts).filter("d2 <= most")
        new = scratch.save(_estimate(inner, names, 1.0), f"model{k}")
        old, model = model, new
        falls = new.join(old.select("group", "start", F.col("volume").alias("before")), ["group", "start"]).filter("volume < before - 1e-6")
        if not falls.take(1):
            break
    best = model.filter(F.col("n") >= least * share / 2).groupBy("group").agg(F.min_by(F.struct(*(c for c in model.columns if c != "group")), F.struct("volume", "start")).alias("m")).select("group", "m.*")
    # The inner share understates the scatter by a known factor.
    judged = _attach(grouped, best.drop("n", "volume", "start"), ["group"], "left", small, salts).withColumn("distance", _distance(d) / consistency)
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= quantile(alarm)))
    return judged.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
