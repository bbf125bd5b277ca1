"""N-gram Jaccard join by T-occurrence search (DivideSkip) over inverted lists of word shingles.

1. Every text becomes its set of distinct shingles; equal sets are one class from here on.
2. A similar pair shares at least `percent` of the larger set, so a class stays only if so many of
   its shingles occur elsewhere. That count is made by shuffling 4 bytes a shingle to buckets; what
   repeats within one batch is known there and sends one mark, so no frequent shingle fills a bucket.
3. Classes with the same least hash of their shingles are compared with one of them; what links
   becomes one cluster. Shingles that occur in one cluster only can't link two, and go; so do
   classes with too few others. Large groups of copies end here, without their pairs.
4. The rest meets on its rarest shingles (the prefix that every link must touch). In each shard an
   inverted index answers the T-occurrence query of each class: short lists are merged (counted as
   arrays), long ones probed by binary search for what the merge leaves. Where more than `block`
   classes meet through each other, they are searched part by part, or, if they are very many, by
   shingles and size, so no shard grows with them and none is cut off.

Words and shingles are compared by 64-bit hashes, shared shingles by 32 bits of them and their
bucket: a false link needs two texts one shingle short of it that collide (about 1e-7 for a pair).

Defined cases: null, empty and wordless texts have an empty set, link with nothing, and are their
own component. Fewer words than a shingle: the whole sequence is the one shingle. Rows that repeat
a key and text are one node; of one key with several texts, each text is a node, and each row gets
its own result. A null key is never a component's name unless all are null. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hirelake.llm import repeats, text as tx
from hirelake.llm.components import components
from hirelake.llm.shared import discard, written

SIZE = 5
PERCENT = 75
#: Shingles of a shard, about.
SHARD = 300_000
#: Classes of a block that meet in one shard; more are searched in pairs of parts.
BLOCK = 2000
#: Parts of a block at most; the classes of a larger one meet by each prefix shingle and size.
PARTS = 16
#: Prefix shingles that classes of a chained block share at most before they meet.
DEPTH = 3
#: Rounds of clustering by a least hash.
ROUNDS = 2
#: A list with over so many ids a candidate is probed, not merged: a probe takes about as long as so many ids of the merge.
PROBE = 20


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The shingles two sets of a and b must share: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, rows, the shingle hashes (distinct and sorted in each row), where each row begins."""
    raw, offsets = tx.buffers(column)
    for first, last in tx.slices(offsets):
        part = tx.LOWER[raw[offsets[first] : offsets[last]]]
        start, end, row = tx.words(part, offsets[first : last + 1] - offsets[first], tx.SPACE_WORDS)
        hashes = tx.word_hashes(part, start, end)
        n = last - first
        if len(hashes) >= size:
            own = tx.windows(hashes, size)
            inside = row[: len(own)] == row[size - 1 :]
            own, rows = own[inside], row[: len(own)][inside]
        else:
            own, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        bounds = np.searchsorted(row, np.arange(n + 1))
        many = np.diff(bounds)
        short = np.flatnonzero((many > 0) & (many < size))
        if len(short):
            own = np.append(own, np.array([tx.sequence_hash(hashes[bounds[k] : bounds[k + 1]]) for k in short], np.uint64))
            rows = np.append(rows, short)
        order = np.argsort(own)
        order = order[np.argsort(rows[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
        own, rows = own[order], rows[order]
        if len(own):
            new = np.append(True, (own[1:] != own[:-1]) | (rows[1:] != rows[:-1]))
            own, rows = own[new], rows[new]
        yield first, n, own, np.searchsorted(rows, np.arange(n + 1))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def digests(own: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    one = tx.mix(own ^ np.uint64(0x5851F42D4C957F2D))
    two = tx.mix(own + np.uint64(0x14057B7EF767814F))
    both = np.stack([_sums(one, bounds), _sums(two, bounds)], axis=1).astype(">u8")
    data = both.tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def measured(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, n and the set's digest of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, own, bounds in sets_of(batch.column(1), size):
                columns = [batch.column(0).slice(first, n), pa.array(np.diff(bounds), pa.int64()), pa.array(digests(own, bounds), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "set"])

    return documents.select(key, text).mapInArrow(measure, f"`{key}` {kind}, n long, `set` binary")


def _parts(size: int):
    def parts(batch: pa.RecordBatch) -> Iterator[repeats.Parts]:
        for first, n, own, bounds in sets_of(batch.column(1), size):
            yield first, n, own, np.repeat(np.arange(n), np.diff(bounds)), None, digests(own, bounds)

    return parts


def _head_of(set_digest: str) -> Column:
    """The first 64 bits of a set's digest, as `repeats.heads` takes them."""
    return F.conv(F.hex(F.substring(set_digest, 1, 8)), 16, -10).cast("long")


def _number_of(set_digest: str) -> Column:
    """64 bits for a set's digest: the class's number in the joins that follow."""
    return F.xxhash64(set_digest)


def survivors(documents: DataFrame, sets: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """number, n and the repeated shingles (tokens) of each class that may have a partner."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reps = sets.where(F.col("n") > 0).groupBy("set").agg(F.min(F.struct(F.xxhash64(key).bitwiseXOR(_head_of("set")).alias("id"), "n")).alias("r"))
    reps = reps.select("set", F.col("r.id").alias("id"), F.col("r.n").alias("n"))
    # ids of key and set: the texts of one key, or of no key, are apart
    found = repeats.repeated(documents.select(F.xxhash64(key).alias("id"), text), _parts(size), total, by_digest=True)
    kept = found.join(reps, "id").select(_number_of("set").alias("number"), "n", F.col("places").alias("tokens"))
    return kept.where(100 * F.size("tokens") >= percent * F.col("n"))


def _with_least(rounds: int):
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values, at = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            columns = [batch.column(n) for n in ("number", "n", "tokens")]
            for r in range(rounds):
                h = tx.mix(values ^ np.uint64(0xA0761D6478BD642F * (r + 1) % (1 << 64)))
                columns.append(pa.array(np.minimum.reduceat(h, at[:-1]).view(np.int64) if len(h) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["number", "n", "tokens", *(f"k{r}" for r in range(rounds))])

    return least


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            cols = (batch.column(n) for n in ("number", "n", "tokens", "c_number", "c_n", "c_tokens"))
            for x, n, t, y, m, u in zip(*cols, strict=True):
                both = np.intersect1d(np.asarray(t.values), np.asarray(u.values), assume_unique=True)
                if len(both) >= least_overlap(n.as_py(), m.as_py(), percent):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return linked


def clustered(classes: DataFrame, percent: int, rounds: int) -> DataFrame:
    """Links (a, b) between each class and the first one with the same least hash, where they are similar."""
    links = None
    for r in range(rounds):
        first = classes.groupBy(f"k{r}").agg(F.min("number").alias("c_number"))
        centres = first.join(classes.select(F.col("number").alias("c_number"), F.col("n").alias("c_n"), F.col("tokens").alias("c_tokens")), "c_number")
        pairs = classes.join(centres, f"k{r}").where(F.col("number") != F.col("c_number"))
        found = pairs.select("number", "n", "tokens", "c_number", "c_n", "c_tokens").mapInArrow(_linked(percent), "a long, b long")
        links = found if links is None else links.unionByName(found)
    return links


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _counted(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of x, all under n, in order, and how often each occurs."""
    if 8 * len(x) < n:
        return np.unique(x, return_counts=True)
    counts = np.bincount(x, minlength=n)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _divide_skip(rows: np.ndarray, keys: np.ndarray, first: np.ndarray, size: np.ndarray, least: int, allowed: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed ids in at least `least` of the lists (places first and on of rows, none empty), with their counts.

    keys: of each place its list's number times len(allowed), and its id. An id must be in one of the
    shortest lists, all but least - 1. Of the others those over `probe` ids a candidate are long.
    """
    none, n = np.zeros(0, np.int64), len(allowed)
    if len(size) < least:
        return none, none
    order = np.argsort(size, kind="stable")
    first, size = first[order], size[order]
    n_short = len(size) - least + 1
    found = rows[_spans(first[:n_short], size[:n_short])]
    ids, total = _counted(found[allowed[found]], n)
    if not len(ids):
        return none, none
    split = n_short + int(np.searchsorted(size[n_short:], probe * len(ids), side="right"))
    if split > n_short:
        more, counts = _counted(rows[_spans(first[n_short:split], size[n_short:split])], n)
        at = np.minimum(np.searchsorted(more, ids), len(more) - 1)
        total = total + np.where(more[at] == ids, counts[at], 0)
        hope = total + (len(size) - split) >= least
        ids, total = ids[hope], total[hope]
    if split < len(size) and len(ids):
        wanted = (keys[first[split:]] // n * n)[:, None] + ids
        total = total + (keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted).sum(axis=0)
    return ids[total >= least], total[total >= least]


def divide_skip(lists: list[np.ndarray], least: int, probe: int = PROBE) -> dict[int, int]:
    """Ids in at least `least` of the sorted lists, with their counts: short lists are merged, long ones are probed for the ids that the merge leaves."""
    lists = [x for x in lists if len(x)]
    rows = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    size = np.array([len(x) for x in lists], np.int64)
    allowed = np.ones(int(rows.max(initial=-1)) + 1, bool)
    keys = np.repeat(np.arange(len(lists)), size) * len(allowed) + rows
    ids, total = _divide_skip(rows, keys, np.cumsum(size) - size, size, least, allowed, probe)
    return dict(zip(ids.tolist(), total.tolist(), strict=True))


def search(tokens: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int = PERCENT, probe: int = PROBE) -> list[tuple[int, int]]:
    """Pairs of places whose sets overlap enough; of places already joined through others, none need be given."""
    many = np.array([len(t) for t in tokens], np.int64)
    rows = np.repeat(np.arange(len(tokens)), many)
    every = np.concatenate(tokens) if len(tokens) else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    every, rows = every[order], rows[order]
    last = np.searchsorted(every, every, side="right")  # where the list of each place ends
    keys = np.cumsum(np.append(False, every[1:] != every[:-1])[: len(every)]) * len(tokens) + rows
    place = np.empty(len(order), np.int64)  # of each class's tokens, as given
    place[order] = np.arange(len(order))
    ends = np.cumsum(many)
    sizes = np.asarray(sizes).astype(np.int64)
    group = np.array(labels)
    pairs = []
    for i in range(len(tokens)):
        n, own = int(sizes[i]), place[ends[i] - many[i] : ends[i]]
        own = own[last[own] > own + 1]  # places behind a class's own are those of later classes
        ids, total = _divide_skip(rows, keys, own + 1, last[own] - own - 1, max(1, -(-percent * n // 100)), group != group[i], probe)
        for j in ids[(100 + percent) * total >= percent * (n + sizes[ids])].tolist():
            if group[i] != group[j]:
                group[group == max(group[i], group[j])] = min(group[i], group[j])
                pairs.append((i, j))
    return pairs


def _search_shard(percent: int):
    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("number")
        number = np.asarray(table.column("number"))
        tokens = [np.asarray(t.values) for t in table.column("tokens")]
        pairs = search(tokens, np.asarray(table.column("n")), np.asarray(table.column("label")), percent)
        a, b = ([number[p[k]] for p in pairs] for k in range(2))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return shard


def _gathered(percent: int, most: int = 200_000):
    """number, n, label and tokens (rarest first) of rows (number, n, label, df, token) that lie together by number, if the tokens are enough for a link."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def classes(number: np.ndarray, n: np.ndarray, label: np.ndarray, df: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
            many = np.diff(np.append(new, len(number)))
            keep = 100 * many >= percent * n[new]
            order = np.lexsort((token, df, np.repeat(np.arange(len(new)), many)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(number)), pa.int32()), pa.array(token[order], pa.int64()))
            columns = [*(pa.array(x[new], pa.int64()) for x in (number, n, label)), lists]
            return pa.RecordBatch.from_arrays(columns, names=["number", "n", "label", "tokens"]).filter(pa.array(keep))

        held, rows, enough = [], 0, most
        for batch in batches:
            held.append([np.asarray(x) for x in batch.columns])
            rows += batch.num_rows
            if rows >= enough:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                done = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
                yield classes(*(x[:done] for x in columns))
                held, rows = [[x[done:] for x in columns]], rows - done  # the last class may go on
                enough = max(most, 2 * rows)
        if held:
            yield classes(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return gathered


def contested(classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """number, label, n and tokens (rarest first) of the classes that may link to another cluster."""
    marked = classes.join(labels, classes["number"] == labels["node"], "left").select(
        "number", "n", F.coalesce("root", "number").alias("label"), F.explode("tokens").alias("token")
    )
    stats = marked.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high"))
    between = stats.where(F.col("low") != F.col("high")).select("token", "df")
    back = marked.join(between, "token").select("number", "n", "label", "df", "token").repartition("number").sortWithinPartitions("number")
    return back.mapInArrow(_gathered(percent), "number long, n long, label long, tokens array<long>")


def _bands(n: Column, percent: int) -> Column:
    """The bands of sizes that a set of n enters: its own and the next, so any two that may link share one."""
    own = F.floor(F.log(n.cast("double")) / math.log(100 / percent))
    return F.array(own, own + 1)


def _in_pairs(groups: DataFrame, block: int, shards: int) -> DataFrame:
    """number and shard of the classes of groups (number, key, m): a group of up to `block` in one shard, of more in pairs of parts, each pair a shard of its own (below zero)."""
    parts = F.ceil(F.col("m") / block)
    own = F.pmod(F.xxhash64("number"), parts)
    dealt = groups.select("number", "m", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    pair = -1 - F.shiftrightunsigned(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")), 1)
    where = F.when(F.col("m") > block, pair).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.select("number", where.alias("shard"))


def _narrowed(rest: DataFrame, percent: int, most: int) -> DataFrame:
    """number, key and m (classes of the key) of classes that meet by prefix shingle and band of size.

    Where more than `most` classes share a key, they meet by that and one more shingle: two sets that
    must share so many share k shingles among as many first ones as share one, and k - 1 more.
    Keys with the same classes are one.
    """
    smallest = F.ceil(F.lit(percent) * F.col("n") / 100)
    first = (F.size("tokens") - smallest + 1).cast("int").alias("first")
    base = written(rest.select("number", "tokens", first, F.explode(_bands(F.col("n"), percent)).alias("band")), "banded")
    meet = base.select("number", "band", F.explode(F.slice("tokens", F.lit(1), F.col("first"))).alias("t")).select("number", "band", F.array("t").alias("keys"))
    out = []
    for depth in range(1, DEPTH + 1):
        meet = written(meet, "narrowed")
        sums = meet.groupBy("keys", "band").agg(F.count("*").alias("m"), F.sum(F.xxhash64("number").cast("decimal(20,0)")).alias("sum")).where(F.col("m") > 1)
        sums = sums.select("keys", "band", "m", F.xxhash64("sum", "m").alias("key"))
        done = sums if depth == DEPTH else sums.where(F.col("m") <= most)
        out.append(meet.join(done, ["keys", "band"]).select("number", "key", "m").distinct())
        many = sums.where(F.col("m") > most).select("keys", "band")
        if depth == DEPTH or many.isEmpty():
            break
        again = meet.join(many, ["keys", "band"]).join(base, ["number", "band"])
        more = again.select("number", "band", "keys", F.explode(F.slice("tokens", F.lit(1), F.col("first") + depth)).alias("t"))
        meet = more.where(~F.array_contains("keys", F.col("t"))).select("number", "band", F.array_sort(F.array_append("keys", F.col("t"))).alias("keys")).distinct()
    return functools.reduce(DataFrame.unionByName, out)


def dealt_classes(rest: DataFrame, percent: int, block: int, most_parts: int = PARTS) -> DataFrame:
    """shard (and the columns of rest) of the classes that may link to others.

    Classes that share prefix shingles, directly or through others, form a block; blocks go to shards,
    and one larger than `block` in pairs of parts. Unlike classes may chain into a block of more than
    `most_parts` parts; those classes are dealt by prefix shingle and band of size instead: two that
    link share a shingle and a band. A shingle with more classes than that is narrowed by a second
    and third one (see _narrowed), so it is only what shares three prefix shingles and a size in such
    numbers that is still searched in more parts.
    """
    smallest = F.ceil(F.lit(percent) * F.col("n") / 100)
    prefix = F.slice("tokens", 1, (F.size("tokens") - smallest + 1).cast("int"))
    meet = written(rest.select("number", "n", F.explode(prefix).alias("token")), "prefixes")
    first = meet.groupBy("token").agg(F.min("number").alias("b"), F.count("*").alias("m")).where(F.col("m") > 1).select("token", "b")
    roots = written(components(meet.join(first, "token").select(F.col("number").alias("a"), "b")), "blocks")
    size = roots.groupBy("root").agg(F.count("*").alias("m"))
    sized = roots.join(size, "root").select(F.col("node").alias("number"), F.col("root").alias("key"), "m")
    total = rest.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    shards = max(2 * int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    dealt = _in_pairs(sized.where(F.col("m") <= block * most_parts), block, shards)
    chained = sized.where(F.col("m") > block * most_parts).select("number")
    if not chained.isEmpty():
        dealt = dealt.unionByName(_in_pairs(_narrowed(rest.join(chained, "number", "left_semi"), percent, block * most_parts), block, 1 << 62))
    return dealt.distinct().join(rest, "number").repartition(shards, "shard")  # by number of shards: small in bytes, they would be put into few tasks


def searched(rest: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes of different clusters, by T-occurrence search in shards."""
    members = dealt_classes(rest, percent, block)
    return members.groupBy("shard").applyInArrow(_search_shard(percent), "a long, b long")


def join(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """key, n_shingles, set (digest of the class) and component_id (least key that links reach) of each row."""
    sets = written(measured(documents, key, text, size), "sets")
    classes = survivors(documents, sets, key, text, size, percent)
    kinds = "number long, n long, tokens array<long>" + "".join(f", k{r} long" for r in range(rounds))
    classes = written(classes.mapInArrow(_with_least(rounds), kinds), "classes")
    links = written(clustered(classes, percent, rounds), "links")
    labels = written(components(links), "labels")
    rest = written(contested(classes, labels, percent), "contested")
    discard(classes, labels)
    found = written(searched(rest, percent), "found")
    discard(rest)
    roots = written(components(links.unionByName(found)), "roots")
    discard(links, found)
    least = sets.where(F.col("n") > 0).groupBy("set").agg(F.min(key).alias("least")).withColumn("number", _number_of("set"))
    named = least.join(roots, least["number"] == roots["node"], "left").select("set", "least", F.coalesce("root", "number").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(names, "root").select("set", "component_id")
    return sets.join(linked, "set", "left").select(
        F.col(key), F.col("n").alias("n_shingles"), "set", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id")
    )


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose key names their component: one document of each group. Rows that repeat a key stay or go together."""
    found = join(documents, key, text, **options)
    stay = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__stay")).distinct()
    return documents.join(stay, F.col(key).eqNullSafe(F.col("__stay")), "left_semi")
