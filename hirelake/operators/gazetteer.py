"""Names of a dictionary in texts: the longest run of words from the left, each word in one name at most.

The dictionary is a table of any size with one row for each thing: its name, the land it is in and
how many live there. Names are cut into words like the texts. Of the things of one name each land
keeps its largest, so a name is one row with at most as many choices as there are lands.

A text's words first meet the words that names begin with, which tell what lengths are worth
trying, and only those runs meet the names: a word that begins no name sends nothing on. Both
joins are equi-joins; the dictionary is broadcast if its bytes, counted first, are below a bound,
else both sides are shuffled and adaptive execution splits a common word. Overlaps are settled
inside groups of matches that touch, so a long text is never gathered whole.

Defined results: names with no word or more than MOST_WORDS words are left out. Null texts have no
words. A null land or population counts as "" or -1. Ties of population go to the smaller thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_WORDS = 4
#: A dictionary up to so many bytes is sent to every task.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Runs of letters and digits, in small letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def dictionary(entries: DataFrame, name: str = "name", land: str = "land", population: str = "population", most_words: int = MOST_WORDS) -> DataFrame:
    """run, n_words and choices (an array of land, population and thing; largest first) of each name. thing: all columns of entries."""
    own = entries.select(
        words(F.col(name)).alias("w"), F.coalesce(F.col(land).cast("string"), F.lit("")).alias("land"),
        F.coalesce(F.col(population).cast("double"), F.lit(-1.0)).alias("population"), F.struct(*entries.columns).alias("thing"),
    )
    own = own.where(F.size("w").between(1, most_words)).withColumn("run", F.array_join("w", " ")).withColumn("n_words", F.size("w"))
    largest = own.groupBy("run", "n_words", "land").agg(F.min(F.struct((-F.col("population")).alias("less"), "thing")).alias("best"))
    choice = F.struct("best.less", F.col("best.thing").alias("thing"), "land")
    lists = largest.groupBy("run", "n_words").agg(F.array_sort(F.collect_list(choice)).alias("c"))
    told = F.transform("c", lambda x: F.struct(x["land"].alias("land"), (-x["less"]).alias("population"), x["thing"].alias("thing")))
    return lists.select("run", "n_words", told.alias("choices"))


def chosen(choices: Column, land: Column | None = None, home: str | None = None) -> Column:
    """The thing meant: the largest of the land if one is given; else that of the home land if there are others too; else the largest."""
    if land is not None:
        inside = F.filter(choices, lambda x: x["land"] == land)
        return F.when(land.isNotNull(), F.get(inside, F.lit(0))).otherwise(chosen(choices, home=home))
    first = F.get(choices, F.lit(0))
    return first if home is None else F.coalesce(F.get(F.filter(choices, lambda x: x["land"] == home), F.lit(0)), first)


def _joined(rows: DataFrame, names: DataFrame, on: str, small: bool) -> DataFrame:
    # rows cut out of texts look smaller to the planner than they are, so it isn't left to choose
    return rows.join(F.broadcast(names) if small else names.hint("merge"), on)


def _small(names: DataFrame, told: str, broadcast_bytes: int) -> bool:
    return (names.agg(F.sum(F.octet_length("run") + 64 + F.octet_length(F.to_json(told)))).first()[0] or 0) <= broadcast_bytes


def _longest_from_left(found: DataFrame, key: str) -> DataFrame:
    """Of matches (key, at, n_words, ...), those that remain when each text is read from the left, the longest first."""
    by_start = found.groupBy(key, "at").agg(F.max_by(F.struct(*found.columns), "n_words").alias("m"))
    end = F.col("at") + F.col("m.n_words")
    order = Window.partitionBy(key).orderBy("at")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    touching = by_start.withColumn("new", (F.col("at") >= F.coalesce(reach, F.lit(0))).cast("int")).withColumn("knot", F.sum("new").over(order))
    knots = touching.groupBy(key, "knot").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("all"))
    state = F.struct(F.lit(0).alias("end"), F.slice("all", 1, 0).alias("kept"))

    def read(have: Column, x: Column) -> Column:
        taken = F.struct((x["at"] + x["m"]["n_words"]).alias("end"), F.concat(have["kept"], F.array(x)).alias("kept"))
        return F.when(x["at"] >= have["end"], taken).otherwise(have)

    return knots.select(F.explode(F.aggregate("all", state, read)["kept"]).alias("x")).select("x.m.*")


def mentions(texts: DataFrame, key: str, text: Column, names: DataFrame, most_words: int = MOST_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key, at (the first word's number, from 0), n_words, run and choices of each name in each text. key tells the texts apart; names: of `dictionary`."""
    small = _small(names, "choices", broadcast_bytes)
    first = F.split("run", " ", 2)[0]
    begins = names.groupBy(first.alias("word")).agg(F.collect_set("n_words").alias("lengths"))
    own = texts.select(F.col(key), words(text).alias("w"))
    beginnings = F.transform("w", lambda x, i: F.slice(F.col("w"), i + 1, F.lit(most_words)))
    at = own.select(key, F.posexplode(beginnings).alias("at", "next"))
    tried = _joined(at.withColumn("word", F.get("next", F.lit(0))), begins, "word", small).select(key, "at", "next", F.explode("lengths").alias("n"))
    runs = tried.where(F.col("n") <= F.size("next")).select(key, "at", F.array_join(F.slice("next", F.lit(1), F.col("n")), " ").alias("run"))
    found = _joined(runs, names, "run", small).select(key, "at", "n_words", "run", "choices")
    return _longest_from_left(found, key)


def hinted(urls: DataFrame, key: str, url: Column, names: DataFrame, home: str | None = None, most_words: int = MOST_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key and hint of each address: the longest beginning of its last path part that is a name, as the thing meant; no row without one.

    The part is cut at hyphens and underscores; words with anything but letters are passed over. What a name means is settled
    once a name, so an address carries one thing and never all choices.
    """
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    part = F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1))
    own = F.filter(F.split(F.lower(part), r"[-_]+"), lambda x: F.regexp_like(x, F.lit(r"^\p{L}+$")))
    starts = F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.when(n <= F.size(own), F.array_join(F.slice(own, F.lit(1), n), " ")))
    tried = urls.select(F.col(key), F.explode(starts).alias("run")).where(F.col("run").isNotNull())
    meant = names.select("run", "n_words", chosen(F.col("choices"), home=home)["thing"].alias("hint"))
    found = _joined(tried, meant, "run", _small(meant, "hint", broadcast_bytes))
    return found.groupBy(key).agg(F.max_by(F.struct("run", "hint"), "n_words").alias("m")).select(key, "m.run", "m.hint")
