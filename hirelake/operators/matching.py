"""Matching of names, mail and postings: fuzzy ratios, blocked joins, clusters, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hirelake.functions import mail as M
from hirelake.functions.ratios import fuzzy


def _keys(names: DataFrame, least: int) -> DataFrame:
    """name, part (gram or word), of the name's keys, and whether it is in its prefix.

    A ratio of at least `least` bounds what two names can lack of each other, so only a prefix of
    the rarest keys need meet. Keys are the letter pairs in words, numbered where they repeat, and
    the words. With d the share that may differ, a name of n letters and w words has at least
    t = (1 - 2d)n - 1 - 2(w - 1) pairs in common with a partner: all but t - 1 of its pairs make
    the prefix. Where the shared words alone make the ratio, they hold all but a part m of one
    name, whose rarest words up to that part are its prefix. Names too short for a bound (t < 1)
    bring all their keys.
    """
    part = (least - 0.5) / 100
    d, missing = 2 * (1 - part), 1 - part / (2 - part)
    once = names.select("name", F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""))).alias("words"))
    once = once.withColumns({"n": F.length(F.array_join("words", " ")), "w": F.size("words")}).where("w > 0")
    pairs = F.flatten(F.transform("words", lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.array(x))))
    once = once.withColumn("pairs", pairs)
    turn = lambda x, i: F.size(F.filter(F.slice(F.col("pairs"), F.lit(1), i + 1), lambda y: y == x)).cast("string")
    grams = F.transform("pairs", lambda x, i: F.struct(F.concat(F.lit("g"), turn(x, i), F.lit(":"), x).alias("key"), F.lit(1).alias("size")))
    own_words = F.transform("words", lambda x: F.struct(F.concat(F.lit("w:"), x).alias("key"), F.length(x).alias("size")))
    every = once.select("name", "n", "w", F.explode(F.concat(grams, own_words)).alias("k")).select("name", "n", "w", "k.*")
    counted = every.join(every.groupBy("key").agg(F.count("*").alias("df")), "key")
    lists = counted.groupBy("name", "n", "w").agg(F.array_sort(F.collect_list(F.struct("df", "key", "size"))).alias("all"))
    is_word = lambda x: F.startswith(x["key"], F.lit("w:"))
    lists = lists.withColumns({"g": F.filter("all", lambda x: ~is_word(x)), "v": F.filter("all", is_word)})
    lists = lists.withColumn("t", F.ceil((1 - 2 * d) * F.col("n") - 1 - 2 * (F.col("w") - 1)))
    short = F.col("t") < 1
    of_grams = F.transform("g", lambda x, i: F.struct(x["key"].alias("key"), (short | (i < F.size("g") - F.col("t") + 1)).alias("prefix")))
    before = lambda i: F.aggregate(F.slice(F.col("v"), F.lit(1), i), F.lit(0), lambda a, y: a + y["size"])
    of_words = F.transform("v", lambda x, i: F.struct(x["key"].alias("key"), (short | (before(i) <= missing * F.col("n"))).alias("prefix")))
    return lists.select("name", F.explode(F.concat(of_grams, of_words)).alias("k")).select("name", "k.*")


def fuzzy_candidates(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """a and b of the pairs of names that may reach the ratio, each once."""
    tagged = left.select("name", F.lit(0).alias("side")).unionByName(right.select("name", F.lit(1).alias("side"))).distinct()
    keys = _keys(tagged.select("name").distinct(), least).join(tagged, "name")
    a, b = keys.where("side = 0").alias("a"), keys.where("side = 1").alias("b")
    is_word = F.startswith("a.key", F.lit("w:"))
    # pairs of letters meet prefix with prefix, words prefix with all
    meets = (F.col("a.key") == F.col("b.key")) & F.when(is_word, F.col("a.prefix") | F.col("b.prefix")).otherwise(F.col("a.prefix") & F.col("b.prefix"))
    return a.join(b, meets).select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()


def fuzzy_pairs(names: DataFrame, name: str, least: int = 85, kind: str = "token_set") -> DataFrame:
    """Pairs of different names (a < b) of at least that ratio. Names are made distinct first, so copies of a name never meet."""
    once = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    pairs = fuzzy_candidates(once, once, least).where("a < b")
    return pairs.withColumn("ratio", fuzzy(F.col("a"), F.col("b"), kind)).where(F.col("ratio") >= least)


def best_fuzzy(left: DataFrame, right: DataFrame, name: str, least: int = 90) -> DataFrame:
    """The best right name for each left name; ties go to the greater name."""
    a, b = (x.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct() for x in (left, right))
    scored = fuzzy_candidates(a, b, least).withColumn("ratio", fuzzy(F.col("a"), F.col("b"), "token_set")).where(F.col("ratio") >= least)
    best = scored.groupBy(F.col("a").alias("l_name")).agg(F.max_by(F.struct(F.col("b").alias("r_name"), "ratio"), F.struct("ratio", F.col("b"))).alias("x"))
    return best.select("l_name", "x.*")


def votes(rows: DataFrame, group: str, candidate: str, voter: str, weight: str) -> DataFrame:
    """The candidate of each group by distinct voters, then summed best weight; none where the first two tie."""
    best = rows.groupBy(group, candidate, voter).agg(F.max(weight).alias("w"))
    sums = best.groupBy(group, candidate).agg(F.count("*").alias("voters"), F.sum("w").alias("weight"))
    w = Window.partitionBy(group).orderBy(F.desc("voters"), F.desc("weight"), candidate)
    ranked = sums.withColumn("rn", F.row_number().over(w)).withColumn("nv", F.lead("voters").over(w)).withColumn("nw", F.lead("weight").over(w))
    clear = F.col("nv").isNull() | (F.col("nv") != F.col("voters")) | (F.col("nw") != F.col("weight"))
    return ranked.where((F.col("rn") == 1) & clear).select(group, candidate, "voters", "weight")


def mail_matches(mail: DataFrame, jobs: DataFrame, key: str, days: int = 60) -> DataFrame:
    """The best job of each message among those of its key, by five signals in order: company, title, timing, ats_domain, sender_company.

    mail: message_id, key, subject, body, sender, sent. jobs: dedup_key, key, company, title, status,
    first_seen. Messages and jobs meet on the key (a company's name or domain), never all with all.
    The company must be named in subject or sender; four signals match at once, three do if one is of the sender's
    domain, fewer wait for a look. The domain counts in classified mail only.
    """
    # what a message tells by itself is worked out once a message, before it meets the jobs
    own = mail.withColumns({"_text": F.lower(F.concat_ws(" ", "subject", "body")), "_classified": M.email_class("subject", "body").isNotNull(), "_system": M.from_applicant_system(F.col("sender"))})
    both = own.drop("body").join(jobs, key)
    text, sender, company, classified = F.col("_text"), F.col("sender"), F.col("company"), F.col("_classified")
    signals = F.array_compact(
        F.array(
            F.when(M.names_company(company, F.col("subject"), sender), "company"),
            F.when(M.names_title(F.col("title"), text), "title"),
            F.when(M.within_days(F.col("sent"), F.col("first_seen"), days), "timing"),
            F.when(classified & F.col("_system"), "ats_domain"),
            F.when(classified & M.from_company(sender, company), "sender_company"),
        )
    )
    scored = both.withColumn("signals", signals).withColumn("score", F.size("signals")).where(F.array_contains("signals", "company"))
    order = F.struct("score", (F.col("status") == "applied").cast("int"), -F.col("dedup_key"))
    best = scored.groupBy("message_id").agg(F.max_by(F.struct("dedup_key", "score", "signals"), order).alias("x"))
    sure = F.arrays_overlap("x.signals", F.array(F.lit("ats_domain"), F.lit("sender_company")))
    action = F.when((F.col("x.score") >= 4) | ((F.col("x.score") >= 3) & sure), "auto").otherwise("pending")
    return best.select("message_id", "x.dedup_key", "x.score", F.array_join("x.signals", ",").alias("signals"), action.alias("action"))
