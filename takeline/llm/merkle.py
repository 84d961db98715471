"""Merkle manifest of a dataset: a digest for each row, for each source and for all, and a proof for each row.

A row's leaf is the SHA-256 (``H``, lower-case hex; inputs are concatenated, digests as hex text) of its ``doc_id,
source, lang, n_chars, text``, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.  The leaves of a source
ascend by ``doc_id``; while several nodes remain, every 16 consecutive ones become their ``H`` (the last run may be
shorter, even one node).  What remains is the source's root; the sources' roots, by source (null first, then bytewise),
make the dataset's root the same way.

Rows are numbered within their source from a range partitioning, so no source is one task.  A block is an aligned run of
``16 ** DEPTH`` nodes, and one task walks it in postorder: ``traverse`` returns the digest of a subtree and appends the
siblings to the paths of the leaves below while it unwinds.  The first walk hands up each block's root only; the roots
are nodes of the next distributed walk, until each source is one node, and the sources' roots go the same way.  On the
way down a block is walked again with the path of its root, so the siblings of a level are not stored once for each leaf
below them.

Defined cases: a null source is a source of its own; null ids come first, rows with equal ids are ordered by leaf, and
equal rows, which are interchangeable, by their place in the input; one row alone is its source's root, one source alone
is the root; columns other than the five are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeline.llm.common import scratch_table

FAN = 16
#: Levels that one block spans: 4,096 nodes.
DEPTH = 3
#: Rows of paths that are handed on together; a path has about 1 kB for each level.
PATH_ROWS = 512

PATH = "array<struct<place: int, siblings: string>>"


def counted(value: Column) -> Column:
    """``-`` for null, else the value's bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """A document's leaf, as hex; ``text`` stands in for the column of that name."""
    return F.sha2(F.concat(*(counted(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), counted(F.col("text") if text is None else text)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(node: Column, level: Column) -> Column:
        at = F.lit(64) * level["place"]
        return F.sha2(F.concat(F.substring(level["siblings"], F.lit(1), at), node, F.substring(level["siblings"], at + 1, F.length(level["siblings"]))), 256)

    return F.aggregate(path, leaf, up)


def path_digest(path: Column) -> Column:
    """``H`` of a path's siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: level["siblings"]), ""), 256)


def traverse(nodes: list[str], start: int, end: int, height: int, paths: list[list] | None) -> str:
    """Digest of ``nodes[start:end]``, a subtree of ``height`` levels; the paths of its leaves get the siblings met going up."""
    if not height:
        return nodes[start]
    width = FAN ** (height - 1)
    children = [(s, min(s + width, end)) for s in range(start, end, width)]
    joined = "".join([traverse(nodes, a, b, height - 1, paths) for a, b in children])
    if paths is not None:
        for k, (a, b) in enumerate(children):
            level = {"place": k, "siblings": joined[: 64 * k] + joined[64 * k + 64 :]}
            for path in paths[a:b]:
                path.append(level)
    return sha256(joined.encode()).hexdigest()


def block_height(block: int, nodes: int, depth: int) -> int:
    """Levels above the nodes of a block: all, unless it is the only one of its tree, for then one node is to remain."""
    if block:
        return depth
    height = 0
    while FAN**height < nodes:
        height += 1
    return height


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place``, a row's number in its ``tree`` in the given order; written to the shared folder."""
    spark = rows.sparkSession
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, at, place = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            places = []
            for t in batch.column("tree").to_pylist():
                place = 0 if t != tree else place + 1
                tree = t
                places.append(place)
            ats = range(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(ats, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "at", "in_part"])

    path = scratch_table(spark, "merkle-places")
    rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInArrow(count, f"{schema}, part int, at long, in_part long").write.parquet(path)
    known = spark.read.parquet(path)
    tree = F.sha2("tree", 256)
    ends = known.groupBy("part").agg(F.min_by(tree, "at").alias("first"), F.max_by(F.struct(tree.alias("tree"), "in_part"), "at").alias("last"))
    offsets, before, open_tree = [], 0, None  # a row for each partition
    for part, first, last in sorted(tuple(r) for r in ends.collect()):
        offsets.append((part, before if first == open_tree else 0))
        before = last["in_part"] + 1 + (offsets[-1][1] if last["tree"] == first else 0)
        open_tree = last["tree"]
    begins = spark.createDataFrame(offsets, "part int, begin long")
    place = F.col("in_part") + F.when(F.col("at") == F.col("in_part"), F.col("begin")).otherwise(0)
    return known.join(F.broadcast(begins), "part").select(*rows.columns, place.alias("place"))


def in_blocks(nodes: DataFrame, depth: int) -> DataFrame:
    size = FAN**depth
    return nodes.withColumns({"block": F.floor(F.col("place") / size), "at": (F.col("place") % size).cast("int")})


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple]]]:
    """``tree, block`` and the rows of each block; the first columns are ``tree, block, at``."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for (tree, block), run in groupby(rows, key=itemgetter(0, 1)):
        yield tree, block, list(run)


def block_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """``tree, place, node`` of the blocks of ``tree, place, node``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows in block_rows(batches):
            digests = [row[3].hex() for row in rows]
            root = traverse(digests, 0, len(digests), block_height(block, len(digests), depth), None)
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([block], pa.int64()), pa.array([bytes.fromhex(root)], pa.binary())], names=["tree", "place", "node"])

    dealt = in_blocks(nodes, depth).select("tree", "block", "at", "node").repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return dealt.mapInArrow(walk, "tree string, place long, node binary")


def block_paths(nodes: DataFrame, above: DataFrame, depth: int, carry: list[str]) -> DataFrame:
    """``tree, place, node, *carry, path, root`` of nodes, given ``tree, place, path, root`` of their blocks."""
    kinds = dict(nodes.dtypes)
    size, names = FAN**depth, ["tree", "place", "node", *carry, "path", "root"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {"place": pa.int64()}

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types.update((f.name, f.type) for f in batch.schema)
                yield batch

        for tree, block, (top, *rows) in block_rows(seen()):  # the block's own row is sorted before those in it
            paths: list[list] = [[] for _ in rows]
            traverse([row[5].hex() for row in rows], 0, len(rows), block_height(block, len(rows), depth), paths)
            for s in range(0, len(rows), PATH_ROWS):
                some = rows[s : s + PATH_ROWS]
                columns = [[tree] * len(some), [block * size + row[2] for row in some], *map(list, zip(*(row[5:] for row in some), strict=True)), [path + top[3] for path in paths[s : s + PATH_ROWS]], [top[4]] * len(some)]
                yield pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, columns, strict=True)], names=names)

    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    given = above.select("tree", F.col("place").alias("block"), F.lit(-1).alias("at"), "path", "root", *(none(c, kinds[c]) for c in ("node", *carry)))
    below = in_blocks(nodes, depth).select("tree", "block", "at", none("path", PATH), none("root", "binary"), "node", *carry)
    dealt = given.unionByName(below).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return dealt.mapInArrow(walk, "tree string, place long, node binary, " + "".join(f"`{c}` {kinds[c]}, " for c in carry) + f"path {PATH}, root binary")


def climb(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The tiers of walks over ``nodes`` and the roots of their blocks, up to one node for each tree; written, but for the first."""
    tiers = [nodes]
    while True:
        path = scratch_table(nodes.sparkSession, "merkle-roots")
        block_roots(tiers[-1], depth).write.parquet(path)
        tiers.append(nodes.sparkSession.read.parquet(path))
        if not tiers[-1].agg(F.max("place")).first()[0]:
            return tiers


def descend(tiers: list[DataFrame], paths: DataFrame, depth: int, carry: list[str]) -> DataFrame:
    """The first tier's nodes with their paths, given the trees' roots with theirs."""
    for k in range(len(tiers) - 2, -1, -1):
        paths = block_paths(tiers[k], paths, depth, [] if k else carry)
    return paths


def proofs(documents: DataFrame, also: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """``doc_id, source`` (as text), ``leaf, subroot, root, path`` for each row; ``also`` names more columns of a row to carry.

    ``path`` has a level for each step to the root: a node's place in its run and the siblings, joined.
    """
    spark = documents.sparkSession
    also = also or {}
    own = {f"own_{k}": column for k, column in enumerate(also.values())}
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # sorts as asked, a null first
    path = scratch_table(spark, "merkle-leaves")
    leaves = documents.select(tree.alias("tree"), "doc_id", F.unhex(leaf_digest()).alias("node"), *(c.alias(n) for n, c in own.items()), F.monotonically_increasing_id().alias("row"))
    leaves.write.parquet(path)
    carry = ["doc_id", *own]
    tiers = climb(numbered(spark.read.parquet(path), ["doc_id", "node", "row"]).select("tree", "place", "node", *carry), depth)

    sources = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    upper = climb(numbered(sources, ["source"]), depth)
    top = upper[-1].select("tree", "place", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    known = descend(upper, top, depth, ["source"])
    ends = known.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("root"))
    found = descend(tiers, ends, depth, carry).crossJoin(F.broadcast(top.select(F.col("root").alias("whole"))))  # one row
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))
    text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", source.alias("source"), text("node").alias("leaf"), *(F.col(n).alias(c) for n, c in zip(own, also, strict=True)), text("root").alias("subroot"), text("whole").alias("root"), "path")
