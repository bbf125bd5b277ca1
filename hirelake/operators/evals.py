"""Evaluation figures of predictions against gold labels; one row or one row per class. No pairs: null."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def errors(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    """mae and bias (predicted less true)."""
    d = F.col(predicted) - F.col(true)
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.avg(d), 6).alias("bias"))


def confusion(pairs: DataFrame, classes: DataFrame, true: str, predicted: str) -> DataFrame:
    """n of each pair of listed classes; labels that aren't listed don't count."""
    cells = classes.select(F.col("class").alias("y_true")).join(classes.select(F.col("class").alias("y_pred")), F.lit(True))  # a fixed list of classes
    counts = pairs.groupBy(F.col(true).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("k"))
    return cells.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def by_class(pairs: DataFrame, classes: DataFrame, true: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each class; 0 where there is nothing to divide."""
    c = confusion(pairs, classes, true, predicted)
    long = c.select(F.explode(F.array(F.struct(F.col("y_true").alias("class"), F.lit("t").alias("side"), "n", (F.col("y_true") == F.col("y_pred")).alias("hit")), F.struct(F.col("y_pred").alias("class"), F.lit("p").alias("side"), "n", (F.col("y_true") == F.col("y_pred")).alias("hit")))).alias("x")).select("x.*")
    sums = long.groupBy("class").agg(
        F.sum(F.when((F.col("side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("named"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.try_divide("tp", "named")), zero(F.try_divide("tp", "support"))
    f1 = zero(F.try_divide(2 * p * r, p + r))
    return sums.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def weighted_kappa(pairs: DataFrame, true: str, predicted: str, least: int = 1, most: int = 5) -> DataFrame:
    """Cohen's kappa with quadratic weights on whole ratings; ratings out of range don't count."""
    a, b = F.col(true).cast("double"), F.col(predicted).cast("double")
    ok = pairs.where(F.col(true).between(least, most) & F.col(predicted).between(least, most))
    # sum of (i - j)^2 over the pairs, and over all combinations of the two margins
    sums = ok.agg(F.count("*").alias("n"), F.sum(F.pow(a - b, 2)).alias("seen"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("maa"), F.avg(b * b).alias("mbb"))
    expected = F.col("n") * (F.col("maa") + F.col("mbb") - 2 * F.col("ma") * F.col("mb"))
    return sums.select("n", F.round(F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(F.col("seen"), expected)), 6).alias("kappa"))


def icc(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """ICC(2,1), absolute agreement, of two raters, from sums."""
    x, y = F.col(first).cast("double"), F.col(second).cast("double")
    s = pairs.agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x + y * y).alias("sq"), F.sum(F.pow((x + y) / 2, 2)).alias("sm"))
    n, grand = F.col("n"), (F.col("sx") + F.col("sy")) / (2 * F.col("n"))
    rows = 2 * (F.col("sm") - n * grand * grand)
    cols = n * (F.pow(F.col("sx") / n - grand, 2) + F.pow(F.col("sy") / n - grand, 2))
    rest = (F.col("sq") - 2 * n * grand * grand) - rows - cols
    msr, msc, mse = F.try_divide(rows, n - 1), cols, F.try_divide(rest, n - 1)
    return s.select("n", F.round(F.try_divide(msr - mse, msr + mse + 2 * (msc - mse) / n), 6).alias("icc"))


def false_apply_rate(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    """Of what was called apply, the part that wasn't."""
    return pairs.agg(F.round(F.avg(F.when(F.col(predicted) == "apply", (F.col(true) != "apply").cast("double"))), 6).alias("rate"))


def retry_gate(retries: Column, n: Column, threshold: float = 0.2, least: int = 20) -> Column:
    return F.when(n < least, "SUPPRESSED").when(F.try_divide(retries, n) > threshold, "WARN").otherwise("PASS")


def is_degenerate(axes: list[Column], rationale: Column) -> Column:
    """All axes alike and nothing said about any."""
    return (F.size(F.array_distinct(F.array(*axes))) == 1) & F.forall(F.map_values(rationale), lambda v: F.size(v) == 0)


def bootstrap_mean(rows: DataFrame, key: str, value: str, group: str, resamples: int = 200, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """mean, low and high of each group by a Poisson bootstrap: a row's weight in a resample comes from a hash of its key.

    One pass with map-side sums; no group is gathered. The weights differ from those of resampling
    with a random generator, so the ends agree with such an interval only up to chance.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "_b", key), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    ends, weight, p, acc = [], F.lit(7), 0.36787944117144233, 0.0
    for k in range(7):
        acc += p
        ends.append(acc)
        p /= k + 1
    for k in reversed(range(7)):
        weight = F.when(u < ends[k], k).otherwise(weight)
    own = rows.where(F.col(value).isNotNull())
    drawn = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_w", weight)
    means = drawn.groupBy(group, "_b").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("m"))
    tail = (1 - ci) / 2
    ends_of = means.groupBy(group).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return rows.groupBy(group).agg(F.avg(value).alias("mean")).join(ends_of, group, "left")


#: Chances of 0, 1, ... draws of a row in a resample of a large table (Poisson with mean 1), added up.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def draws(hashes: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """How often each row is in each resample: a function of the row's hash alone, so that lost tasks draw again what they drew."""
    x = hashes.astype(np.uint64)[:, None] + (np.arange(resamples, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= _MIXERS[0]
    x ^= x >> np.uint64(27)
    x *= _MIXERS[1]
    x ^= x >> np.uint64(31)
    return np.searchsorted(_DRAWS, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right")


def resampled_sums(rows: DataFrame, key: str, value: str, group: str, resamples: int, seed: int) -> DataFrame:
    """group, b, w and wx: the sums of draws and of draws times value of each resample.

    A task keeps one array of sums a group and sends it once, so rows are never copied; at most 64 groups are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (w, wx) in held.items():
                columns = {group: pa.array([name] * resamples, kind), "b": pa.array(np.arange(resamples, dtype=np.int32)), "w": pa.array(w), "wx": pa.array(wx)}
                yield pa.RecordBatch.from_pydict(columns)
            held.clear()

        for batch in batches:
            kind = batch.schema.types[0]
            names, hashes, values = batch.column(0).dictionary_encode(), np.array(batch.column(1)), np.array(batch.column(2), dtype=np.float64)
            code = np.array(names.indices.fill_null(-1))
            for c in np.unique(code).tolist():
                name = names.dictionary[c].as_py() if c >= 0 else None
                w, wx = held.setdefault(name, (np.zeros(resamples), np.zeros(resamples)))
                at = np.flatnonzero(code == c)
                for a in range(0, len(at), 256):
                    own = at[a : a + 256]
                    n = draws(hashes[own], resamples, seed)
                    w += n.sum(axis=0)
                    wx += values[own] @ n
            if len(held) > 64:
                yield from out()
        yield from out()

    own = rows.where(F.col(value).isNotNull()).select(group, F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("x"))
    kind = T.StructType([rows.schema[group], *T.StructType.fromDDL("b int, w double, wx double").fields])
    return own.mapInArrow(run, kind).groupBy(group, "b").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))


def bca_ends(estimates: np.ndarray, value: float, acceleration: float, ci: float = 0.95) -> tuple[float, float]:
    """The ends of a bias-corrected and accelerated interval, of the resamples' estimates."""
    normal, n = NormalDist(), len(estimates)
    below = ((estimates < value).sum() + (estimates <= value).sum()) / (2 * n)
    if not 0 < below < 1:
        return float("nan"), float("nan")
    bias, out = normal.inv_cdf(below), []
    for tail in ((1 - ci) / 2, (1 + ci) / 2):
        z = bias + normal.inv_cdf(tail)
        out.append(float(np.quantile(estimates, normal.cdf(bias + z / (1 - acceleration * z)))))
    return out[0], out[1]


def bca_mean(rows: DataFrame, key: str, value: str, group: str, resamples: int = 10_000, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """n, mean, low and high of each group: the BCa bootstrap interval of the mean.

    Bias comes from the share of resamples below the mean, acceleration from the leave-one-out means,
    which need no second pass over pairs of rows: for a mean it is the third central moment over six
    times the second to the power of 1.5. Draws are Poisson and come from the rows' hashes, so the
    ends agree with those of another generator up to chance. One row has no ends (null), equal rows
    have their value at both. A group's resamples (a parameter) are gathered, never its rows.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), F.skewness(F.col(value).cast("double")).alias("skew"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most")
    )
    sums = resampled_sums(rows, key, value, group, resamples, seed).where("w > 0")
    lists = sums.groupBy(group).agg(F.collect_list(F.col("wx") / F.col("w")).alias("m"))
    same = counted[group].eqNullSafe(lists[group])
    ready = counted.join(lists, same, "left").drop(lists[group])

    @F.pandas_udf("struct<low:double,high:double>")
    def ends(n: pd.Series, mean: pd.Series, skew: pd.Series, least: pd.Series, most: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for count, value_, s, a, b, found in zip(n, mean, skew, least, most, m, strict=True):
            flat = a == b
            out.append((None, None) if count < 2 else (value_, value_) if flat else bca_ends(np.asarray(found), value_, s / (6 * math.sqrt(count)), ci))
        return pd.DataFrame(out, columns=["low", "high"], dtype="float64")

    found = ready.withColumn("e", ends("n", "mean", "skew", "least", "most", "m"))
    return found.select(group, "n", "mean", F.nanvl("e.low", F.lit(None)).alias("low"), F.nanvl("e.high", F.lit(None)).alias("high"))


def per_job(runs: DataFrame, job: str, predicted: str) -> DataFrame:
    """The mean of each job's runs, to a whole number by halves to even."""
    return runs.groupBy(job).agg(F.bround(F.avg(predicted)).alias("mean"), F.count(predicted).alias("runs"))


def coherence(text: Column, scores: dict[str, Column], words: dict[str, tuple[str, ...]], least: int = 4) -> Column:
    """The first axis whose words are in a text about gaps though its score is high."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for axis in reversed(list(words)):
        hit = F.lit(False)
        for w in words[axis]:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit & (scores[axis] >= least), axis).otherwise(out)
    return out


def keyword_coverage(rows: DataFrame, wanted: DataFrame, row: str, item: str, word: str, salts: int = 8) -> DataFrame:
    """Of each row and item that share words: how many, and which part of the item's words.

    Both sides hold distinct words. The words that items ask for are few against the rows', so they
    are copied to each salt and a common word's rows are dealt over the salts.
    """
    total = wanted.groupBy(item).agg(F.count("*").alias("words"))
    each = wanted.join(total, item).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    shared = dealt.join(each, [word, "salt"]).groupBy(row, item).agg(F.count("*").alias("shared"), F.first("words").alias("words"))
    return shared.select(row, item, "shared", F.round(F.col("shared") / F.col("words"), 6).alias("coverage"))


def position_swap(first: DataFrame, second: DataFrame, pair: str) -> DataFrame:
    """pair, winner and agreed of pairs judged in both orders: what both say, else a tie. A pair judged once isn't agreed on."""
    both = first.select(pair, F.col("winner").alias("_a")).join(second.select(pair, F.col("winner").alias("_b")), pair, "full_outer")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return both.select(pair, F.when(same, F.col("_a")).otherwise("tie").alias("winner"), same.alias("agreed"))


def recommended(results: DataFrame, single: bool = True) -> DataFrame:
    """site and model. results: model, site, verdict, secondary, and uniformity, retry, latency, memory of the model.

    The model that passes every site wins all of them (of several the least figures in that order);
    where none does, or where single is off, each site has its own, by verdict and the secondary figure. Ties go to the least name.
    """
    ranks = F.coalesce(*[F.when(F.col("verdict") == v, k) for k, v in enumerate(("PASS", "WARN", "FAIL", "SKIP"))], F.lit(99))
    best = F.min_by("model", F.struct(ranks.alias("r"), F.coalesce("secondary", F.lit(999.0)).alias("s"), "model"))
    per_site = results.groupBy("site").agg(best.alias("_own"))
    if not single:
        return per_site.select("site", F.col("_own").alias("model"), F.lit("per_site").alias("mode"))
    sites = results.agg(F.count_distinct("site").alias("sites"))
    swept = results.where("verdict = 'PASS'").groupBy("model").agg(F.count_distinct("site").alias("n"), F.min(F.struct("uniformity", "retry", "latency", "memory")).alias("figures"))
    sweeper = swept.join(F.broadcast(sites), F.col("n") == F.col("sites")).agg(F.min_by("model", F.struct("figures", "model")).alias("_all"))  # one row each
    return per_site.join(F.broadcast(sweeper), F.lit(True)).select("site", F.coalesce("_all", "_own").alias("model"), F.when(F.col("_all").isNotNull(), "single").otherwise("per_site").alias("mode"))


def baseline_sample(rows: DataFrame, key: str, bucket: str, per_bucket: int = 25, holdout: float = 0.2, seed: int = 42) -> DataFrame:
    """So many rows of each bucket by a hash of key and seed, with part: of all that were drawn, the last share by another hash is held out."""
    draw = F.conv(F.substr(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.lit(1), F.lit(15)), 16, 10).cast("long")
    split = F.conv(F.substr(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:split"))), F.lit(1), F.lit(15)), 16, 10).cast("long")
    drawn = rows.withColumn("_d", F.row_number().over(Window.partitionBy(bucket).orderBy(draw, key))).where(F.col("_d") <= per_bucket)
    place = F.percent_rank().over(Window.orderBy(split, key))  # the sample only: buckets times per_bucket rows
    return drawn.withColumn("part", F.when(place >= 1 - holdout, "holdout").otherwise("dev")).drop("_d")


def ungrounded(facts: DataFrame, profile: DataFrame, key: str, fact: str) -> DataFrame:
    """Facts (key, fact) that aren't among the profile's, without regard to case and spaces around; each once. Blank facts don't count."""
    plain = lambda df: df.select(key, F.lower(F.trim(fact)).alias("_f")).where(F.coalesce("_f", F.lit("")) != "")
    return plain(facts).distinct().join(plain(profile).distinct(), [key, "_f"], "left_anti").withColumnRenamed("_f", fact)


def assessed(payload: Column, axes: tuple[str, ...]) -> Column:
    """The scores of a model's JSON as an array of int in the order of the axes, or null where one is missing or no number. A score may stand alone or in an object as score."""
    one = lambda a: F.coalesce(F.get_json_object(payload, f"$.{a}.score"), F.get_json_object(payload, f"$.{a}"))
    every = F.array(*[one(a).try_cast("double").cast("int") for a in axes])
    return F.when(~F.exists(every, lambda x: x.isNull()), every)
