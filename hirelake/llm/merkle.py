"""A manifest of a dataset: a tree of hashes over the rows of each source, one tree over the sources, and a proof for each row.

Rows of a source stand in order of their key; while more than one node remains, every three
consecutive ones (the last run may be shorter) become the SHA-256 of their hex digests. What
remains is the source's subroot. Subroots in order of the source (null first, by bytes) become the
root in the same way. A row's path lists what stands before and after its node at each level, so
`folded(leaf, path)` gives the root back, and only if nothing has changed.

How it runs. Spark makes the leaves and keeps nothing else of a row. Leaves are dealt into ranges
of source and key, numbered inside each range, and moved on by the counts of the ranges before, so
a source that holds a third of all rows is in no task by itself. Blocks of 3**LEVELS nodes that
begin at multiples of that size are whole subtrees: tasks take some blocks at a time as an Arrow
table, and DuckDB climbs them with one ordered string_agg and sha256 a level. The roots of blocks
are the nodes of the next round (a 6,561th of the rows), until each source has one. On the way
back each block gets the path of its own root beside its rows, and its rows put theirs before it.

Defined results: a null in a column is `-` in the leaf, so it differs from an empty text. Rows
without a key come first. Rows that repeat a key stand in order of their leaves; equal rows get
places of their own. An empty table gives no rows. Columns that the leaf doesn't name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.llm.shared import written

#: Nodes that become one.
FAN = 3
#: Levels that a block climbs in one round.
LEVELS = 8
#: Rows that DuckDB gets at once, besides the rest of the last block.
CHUNK = 8000

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"
NODE = "tree string, place long, total long, digest string"


def leaf(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the values, each as its length in bytes, a colon and itself; null: a dash."""

    def field(c: str | Column) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf has by its path."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Gives the rows (with a `tree`) their place in it and the tree's total; as ranges, so that no task needs a whole tree."""
    turn = rows.withColumn("turn", F.monotonically_increasing_id())
    keys = [F.col("tree").asc(), *(F.col(c).asc_nulls_first() for c in order), F.col("turn").asc()]
    ranges = written(turn.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*keys[1:])) - 1
    counts = ranges.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy("tree")).alias("total")
    )
    numbered = ranges.withColumn("inside", inside).join(offsets, ["tree", "part"])
    return numbered.withColumn("place", F.col("begin") + F.col("inside")).drop("begin", "inside", "part", "turn")


def _levels(total: Column, most: int) -> Column:
    """Levels that a block climbs: all where its tree goes on above it, else until one node is left."""
    return sum((total > FAN**j).cast("int") for j in range(most))


def _blocks(nodes: DataFrame, most: int) -> DataFrame:
    size = FAN**most
    return nodes.withColumns({"block": F.floor(F.col("place") / size), "inside": (F.col("place") % size).cast("int"), "levels": _levels(F.col("total"), most)})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of tree and block, some whole blocks at a time, with the number of their block in the chunk."""
    held: list[pa.RecordBatch] = []

    def flush(last: bool) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        tree, block = table["tree"].combine_chunks().dictionary_encode().indices.to_numpy(), table["block"].to_numpy()
        new = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
        cut = len(table) if last else int(new[-1]) if len(new) else 0
        held[:] = table.slice(cut).to_batches()
        if cut:
            number = np.zeros(cut, np.int64)
            number[new[new < cut]] = 1
            yield table.slice(0, cut).append_column("b", pa.array(np.cumsum(number)))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield from flush(False)
    if held:
        yield from flush(True)


def _climb(con, most: int, paths: bool) -> None:
    """Level queries over the table `chunk` of blocks. Leaves `root` (b, digest) and, if asked for, `own` (row, b, path)."""
    con.sql("CREATE OR REPLACE TEMP TABLE node AS SELECT b, inside AS i, digest, levels FROM chunk WHERE inside >= 0")
    con.sql("CREATE OR REPLACE TEMP TABLE root AS SELECT b, digest FROM node WHERE levels = 0")
    if paths:
        con.sql("CREATE OR REPLACE TEMP TABLE own AS SELECT row, b, inside AS i, []::STRUCT(before VARCHAR, after VARCHAR)[] AS path FROM chunk WHERE inside >= 0")
    for level in range(most):
        con.sql(f"""CREATE OR REPLACE TEMP TABLE run AS
            SELECT b, i // {FAN} AS i, string_agg(digest, '' ORDER BY i) AS digests, any_value(levels) AS levels
            FROM node WHERE levels > {level} GROUP BY b, i // {FAN}""")
        if paths:
            at = f"64 * (own.i // {FAN**level} % {FAN})"
            con.sql(f"""CREATE OR REPLACE TEMP TABLE own AS
                SELECT row, own.b, own.i, CASE WHEN digests IS NULL THEN path
                       ELSE list_append(path, {{before: left(digests, {at}), after: substr(digests, {at} + 65)}}) END AS path
                FROM own LEFT JOIN run ON run.b = own.b AND run.i = own.i // {FAN ** (level + 1)}""")
        con.sql("CREATE OR REPLACE TEMP TABLE node AS SELECT b, i, sha256(digests) AS digest, levels FROM run")
        con.sql(f"INSERT INTO root SELECT b, digest FROM node WHERE levels = {level + 1}")


def _connect():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def _arrow(con, query: str) -> list[pa.RecordBatch]:
    found = con.sql(query).to_arrow_table()
    return found.cast(pa.schema([(f.name, _plain(f.type)) for f in found.schema])).to_batches(max_chunksize=1000)


def _plain(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pa.list_(_plain(kind.value_type))
    return pa.string() if pa.types.is_large_string(kind) else kind


def _roots(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for chunk in _chunks(batches):
            con.register("chunk", chunk)
            _climb(con, most, paths=False)
            yield from _arrow(
                con, f"""SELECT tree, block AS place, (total + {FAN**most - 1}) // {FAN**most} AS total, root.digest
                         FROM chunk JOIN root USING (b) WHERE inside = 0"""
            )
            con.unregister("chunk")

    return run


def _paths(most: int, carried: Sequence[str]):
    names = ", ".join(f'chunk."{c}"' for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for chunk in _chunks(batches):
            con.register("chunk", chunk.append_column("row", pa.array(np.arange(len(chunk)))))
            _climb(con, most, paths=True)
            yield from _arrow(
                con, f"""SELECT {names}, list_concat(own.path, above.rest) AS path, above.subroot, above.root
                         FROM chunk JOIN own USING (row) JOIN (SELECT b, rest, subroot, root FROM chunk WHERE inside < 0) above ON above.b = own.b"""
            )
            con.unregister("chunk")

    return run


def _up(nodes: DataFrame, most: int) -> DataFrame:
    """The roots of the blocks of nodes, as nodes of the next round."""
    blocks = _blocks(nodes.select("tree", "place", "total", "digest"), most)
    dealt = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "inside")
    return dealt.mapInArrow(_roots(most), NODE)


def _down(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """The nodes with their paths. above: each block's path (rest), subroot and root, by tree and block."""
    kept = [c for c in nodes.columns if c != "total"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in kept), f"path array<{STEP}>", "subroot string", "root string"])
    heads = above.withColumns({"inside": F.lit(-1), "levels": F.lit(0)})
    both = _blocks(nodes, most).unionByName(heads, allowMissingColumns=True)
    dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "inside")
    return dealt.mapInArrow(_paths(most, kept), schema)


def _rounds(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of each round above the leaves; those of the last are the roots of the trees."""
    total, rounds = leaves.agg(F.max("total")).first()[0] or 1, []
    while not rounds or total > 1:
        rounds.append(written(_up(rounds[-1] if rounds else leaves, most), "nodes"))
        total = -(-total // FAN**most)
    return rounds


def _back(rounds: list[DataFrame], above: DataFrame, most: int) -> DataFrame:
    """Paths of the first round's nodes, as heads of the blocks below. above: path, subroot and root of each tree's last node."""
    heads = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds[:-1]):
        heads = _down(nodes, heads, most).select("tree", F.col("place").alias("block"), F.col("path").alias("rest"), "subroot", "root")
    return heads


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", source: str = "source", carry: Mapping[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Each row's key and source, leaf, place among the source's rows, subroot, root and path (an array of what stands before and after).

    carry: more columns, made of docs. levels: what a block climbs at once; results are the same at any.
    """
    if clash := {"key", "tree", "digest", "turn", "part", "place", "total", "block", "inside", "levels", "rest", "row", "b", "path", "subroot", "root", "leaf", key, source} & set(carry or ()):
        raise ValueError(f"names that are used here: {sorted(clash)}")
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))  # null first, else by bytes
    named = {"key": F.col(key), "source": F.col(source), "tree": tree, "digest": leaf(columns)} | dict(carry or {})
    leaves = written(placed(written(docs.select(*(c.alias(n) for n, c in named.items())), "leaves"), ["key", "digest"]), "placed")
    rounds = _rounds(leaves, levels)
    sources = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = written(placed(sources, ["name"]), "sources")
    above = _rounds(sources, levels)
    top = above[-1].select("tree", F.expr(f"CAST(array() AS array<{STEP}>)").alias("rest"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    whole = _down(sources, _back(above, top, levels), levels)
    trees = whole.select(F.col("name").alias("tree"), F.col("path").alias("rest"), F.col("digest").alias("subroot"), "root")
    paths = _down(leaves, _back(rounds, written(trees, "trees"), levels), levels)
    return paths.select(F.col("key").alias(key), F.col("source").alias(source), *(carry or {}), F.col("digest").alias("leaf"), "place", "subroot", "root", "path")
