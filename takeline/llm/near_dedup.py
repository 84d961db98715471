"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

*Sketch.* In round ``i < t`` each element of a set falls into one random bin of ``t`` and leaves there a value that
begins with ``i``; in round ``t + b`` every element falls into bin ``b``.  A bin keeps its least value, and rounds end
when all bins are full: after about ``t ln t`` placements, and certainly after ``2 t`` rounds.  Two sets agree in a
coordinate with the probability of their similarity, with the concentration of independent coordinates.

*Candidates.* Texts with the same shingle set are one node.  Nodes that share the key of a band of coordinates are
joined to the least node of that bucket (a bucket of ``n`` gives ``n - 1`` edges); components of these edges are
families.  Every pair that shares a bucket is in one family.  Rows per band are chosen so that a pair at the threshold
shares no bucket with a probability of at most ``MISS``.

*Verification.* Each text in a family is shuffled once, to its family's task, which settles the exact components there:
it compares nodes only while they are in different components, through an inverted index of full shingle sets.
Families beyond ``family_rows`` texts or ``family_shingles`` shingles are cut into blocks: all blocks are held against the
family's most used bucket centre.  What doesn't link to it is parted by its rare shingles (a prefix filter: sets that link
have one of each other's rarest in common, whatever the order, and the order is by a sample of the family that every block
sees), and each part is a query set against itself and the others that have one of these.  Pages of one template, which
have their own rare shingles, meet nobody.  No list of pairs arises.

A node's text is fetched by id and text hash, once however often the row repeats, so null and repeated ids cost no more
than others.

Defined cases: null and empty texts have no shingles and link with nothing (their component is their own id); a text
with fewer words than a shingle is one shingle; equal ids with different texts are told apart by their sets; a null id
takes part, and the component id is the least known id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeline.llm.common import ASCII_LOWER, WordHashes, cut, rolling, scramble, steps, texts_of
from takeline.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Chance, at most, that a pair just at the threshold shares no bucket.
MISS = 1e-6
#: Coordinates of a sketch, unless bands of one row need more.
COORDINATES = 400
#: Nodes, and shingles of all of them, that one verification task takes whole.
FAMILY_ROWS = 1000
FAMILY_SHINGLES = 1_000_000


def banding(percent: int) -> tuple[int, int]:
    """``(bands, rows)``: the most rows whose bands keep ``MISS`` within ``COORDINATES``; one row if none do."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    s, best = percent / 100, (0, 0)
    for rows in range(1, 33):
        bands = math.ceil(math.log(MISS) / math.log1p(-(s**rows))) if s < 1 else 1
        if bands * rows <= COORDINATES or rows == 1:
            best = (bands, rows)
    return best


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    return np.unique(rolling(h, width) if len(h) >= width else rolling(h, len(h), len(h)))


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return scramble(shingles, 11).sum(dtype=np.uint64).tobytes() + scramble(shingles, 12).sum(dtype=np.uint64).tobytes()


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, a row of ``t`` coordinates for each set (empty sets: all ones)."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * t, none)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * t):
        if not len(x):
            break
        h = scramble(x, 100 + i)
        bins = (((h >> np.uint64(44)) * np.uint64(t)) >> np.uint64(20)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, of * t + bins, np.uint64(i << 44) | (h & np.uint64((1 << 44) - 1)))
        open_ = (out.reshape(-1, t) == none).any(1)[of]
        if not open_.all():
            x, of = x[open_], of[open_]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        keys = scramble(keys ^ sketch[:, r : bands * rows : rows], 200 + r)
    return scramble(keys + np.arange(bands, dtype=np.uint64), 300).view(np.int64)


class Sets:
    """Shingle sets of one task with an inverted index."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.sets = percent, sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.end = np.cumsum(self.n)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, self.ids = np.unique(values, return_inverse=True)
        order = np.argsort(self.ids, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]
        self.df = np.bincount(self.ids) if len(values) else np.zeros(0, np.int64)
        self.posting = np.cumsum(self.df) - self.df

    def common(self) -> np.ndarray:
        """How much of each set others have too: large for a set amid its copies."""
        total = np.r_[0, np.cumsum(self.df[self.ids])]
        return (total[self.end] - total[self.end - self.n]) / np.maximum(self.n, 1)

    def linked(self, x: int) -> np.ndarray:
        """Sets that reach the threshold with set ``x``, itself included."""
        ids = self.ids[self.end[x] - self.n[x] : self.end[x]]
        count = self.df[ids]
        at = np.repeat(self.posting[ids] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(self.owner[at], minlength=len(self.n))
        return np.flatnonzero((100 * both >= self.percent * (self.n[x] + self.n - both)) & (both > 0))


def spanning_links(sets: Sets, label: np.ndarray, query: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components; ``label`` names those known before and is changed.

    Without ``query``, every pair in different components is settled: a set outside the largest component is compared
    with all.  With it, the sets it marks are compared with all.
    """
    links, done, score = [], np.zeros(len(label), bool), sets.common()
    order = np.argsort(-score, kind="stable")
    largest = label[order[0]] if len(order) and query is not None else None
    while True:
        if query is None:
            todo = order[~done[order] & (label[order] != largest)] if largest is not None else order
        else:
            todo = order[query[order] & ~done[order]]
        if not len(todo):
            return links
        for x in todo.tolist():
            if query is None and largest is not None and label[x] == largest:
                continue
            done[x] = True
            joined = False
            for other in np.unique(label[near := sets.linked(x)]).tolist():
                if other != label[x]:
                    y = int(near[label[near] == other][0])
                    links.append((x, y))
                    label[label == other] = label[x]
                    joined = True
            if largest is None or (joined and query is None):
                largest = np.bincount(label).argmax()
        if query is not None:
            return links


def near_duplicates(documents: DataFrame, percent: int = PERCENT, width: int = SHINGLE, family_rows: int = FAMILY_ROWS, family_shingles: int = FAMILY_SHINGLES) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept`` (``kept``: its id is the component's)."""
    bands, rows = banding(percent)
    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in steps(batches):
            sets = [shingle_set(t, width, hashes) for t in texts_of(batch)]
            keys = band_keys(sketches(sets, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.array([k if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "sig", "bands"],
            )

    sketched = cut(texts.mapInArrow(sketch, f"doc_id {kind}, text_hash long, n_shingles long, sig binary, bands array<long>"))
    # Rows of one set agree in its size and bands; the text comes from the least of them, known ids first.
    source = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    nodes = sketched.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), source.alias("source"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre < other")
    stars = banded.join(buckets.select("key", "centre"), "key").where("node <> centre")
    edges = cut(stars.groupBy("node", "centre").agg(F.count("*").alias("shared")))
    families = components(edges.select(F.col("node").alias("u"), F.col("centre").alias("v")))
    links = _verified(texts, nodes, edges, families, percent, width, family_rows, family_shingles)
    roots = components(links)
    placed = nodes.join(roots, "node", "left").select("sig", "rep", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "root").select("sig", "component_id")
    out = sketched.select("doc_id", "n_shingles", "sig").join(named, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


LINKS = "u long, v long"
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sets_of(group: pa.Table, percent: int, width: int) -> tuple[Sets, np.ndarray]:
    """Sets of a task's rows, and their nodes."""
    hashes = WordHashes()
    sets = [shingle_set(t, width, hashes) for t in group.column("text").cast(pa.large_binary()).to_pylist()]
    return Sets(sets, percent), group.column("node").to_numpy()


def _table(nodes: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([int(nodes[a]) for a, _ in links], pa.int64()), "v": pa.array([int(nodes[b]) for _, b in links], pa.int64())}, schema=_LINKS)


def _blocks(family_rows: int, family_shingles: int) -> Column:
    """Blocks of a family, from its rows' ``n_shingles``."""
    return F.greatest(F.ceil(F.count("*") / family_rows), F.ceil(F.sum("n_shingles") / family_shingles)).cast("int")


def _verified(texts: DataFrame, nodes: DataFrame, edges: DataFrame, families: DataFrame, percent: int, width: int, family_rows: int, family_shingles: int) -> DataFrame:
    """Links ``u, v`` that span the exact components."""
    members = families.select("node", F.col("root").alias("family")).unionByName(families.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct())
    members = members.join(nodes.select("node", "n_shingles", F.col("source.doc_id").alias("source_id"), F.col("source.text_hash").alias("source_hash")), "node")
    counted = members.groupBy("family").agg(_blocks(family_rows, family_shingles).alias("blocks"))
    members = cut(members.join(counted, "family").drop("n_shingles"))
    same = F.col("doc_id").eqNullSafe(F.col("source_id")) & (F.col("text_hash") == F.col("source_hash"))
    # Rows that repeat id and text collapse before the shuffle.
    placed = texts.join(members, same).groupBy("node", "family", "blocks").agg(F.any_value("text").alias("text"))

    def whole(group: pa.Table) -> pa.Table:
        sets, own = _sets_of(group, percent, width)
        return _table(own, spanning_links(sets, np.arange(len(own))))

    small = placed.where("blocks = 1").groupBy("family").applyInArrow(whole, LINKS)
    if not members.where("blocks > 1").limit(1).count():
        return small
    return small.unionByName(_large(placed.where("blocks > 1"), edges, families, percent, width, family_rows, family_shingles))


def prefix(items: np.ndarray, known: np.ndarray, texts: np.ndarray, percent: int) -> np.ndarray:
    """The part of a set that holds a shingle of every set it links to: its rarest, as many as the similarity leaves room for.

    Any one order of shingles makes this exact; this one goes by the number of reference texts (``known``: sorted
    shingles, ``texts``: of each), then by hash.
    """
    n = len(items)
    at = np.minimum(np.searchsorted(known, items), max(len(known) - 1, 0))
    held = np.where(known[at] == items, texts[at], 0) if len(known) else np.zeros(n, np.int64)
    return items[np.lexsort((items, held))[: n + (-n * percent) // 100 + 1]]


def _large(texts: DataFrame, edges: DataFrame, families: DataFrame, percent: int, width: int, family_rows: int, family_shingles: int) -> DataFrame:
    """Large families in blocks: first all against one centre, then what is left against those with a rare shingle in common."""
    votes = edges.join(families.withColumnRenamed("root", "family"), "node").groupBy("family", "centre").agg(F.sum("shared").alias("votes"))
    centres = votes.groupBy("family").agg(F.max_by("centre", F.struct("votes", "centre")).alias("centre"))
    rows = cut(texts.join(centres, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    is_centre, every_block = F.col("node") == F.col("centre"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sample = F.pmod(F.xxhash64("node", F.lit("reference")), F.col("blocks") * 5) == 0  # a fifth of a block
    guests = rows.where(is_centre | sample).withColumn("home", F.col("block")).withColumn("block", every_block)
    spread = rows.withColumn("home", F.col("block")).where(~(is_centre | sample)).unionByName(guests)

    def against_centre(group: pa.Table) -> pa.Table:
        sets, own = _sets_of(group, percent, width)
        centre = np.flatnonzero(own == group.column("centre")[0].as_py())
        here = group.column("home").to_numpy() == group.column("block").to_numpy()  # a guest tells about itself at home
        near = [int(y) for y in (sets.linked(int(centre[0])) if len(centre) else []) if own[y] != own[centre[0]] and here[y]]
        guest = np.flatnonzero(group.column("sample").to_numpy(zero_copy_only=False))
        known, texts_of_it = np.unique(np.concatenate([np.zeros(0, np.uint64), *(sets.sets[i] for i in guest.tolist())]), return_counts=True)
        linked = np.zeros(len(own), bool)
        linked[near] = True
        linked |= own == group.column("centre")[0].as_py()
        members = np.flatnonzero(here)
        parts = [prefix(sets.sets[i], known, texts_of_it, percent).view(np.int64) for i in members.tolist()]
        return pa.table(
            {"family": pa.array([group.column("family")[0].as_py()] * len(members), pa.int64()), "node": pa.array(own[members], pa.int64()), "centre": pa.array([int(own[centre[0]]) if len(centre) else None] * len(members), pa.int64()),
             "linked": pa.array(linked[members]), "near": pa.array(np.isin(members, near)), "n_shingles": pa.array(sets.n[members]), "rare": pa.array(parts, pa.list_(pa.int64()))}
        )

    schema = "family long, node long, centre long, linked boolean, near boolean, n_shingles long, rare array<long>"
    first = cut(spread.withColumn("sample", sample).groupBy("family", "block").applyInArrow(against_centre, schema))
    links = first.where("near").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    if first.where("not linked").isEmpty():
        return links
    members = cut(_parted(first))
    if members.isEmpty():
        return links
    counted = members.join(first.select("node", "n_shingles"), "node").groupBy("family").agg(_blocks(family_rows, family_shingles).alias("blocks"))
    sized = cut(members.join(counted, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    flagged = rows.select("node", "text").join(sized, "node")
    # Query rows of block q meet every block b; only blocks that have any are asked.
    asked = sized.where("asks").select("family", F.col("block").alias("q")).distinct()
    base = flagged.join(asked, "family").withColumn("asks", F.lit(False)).withColumn("b", F.col("block"))
    query = flagged.where("asks").withColumn("q", F.col("block")).withColumn("b", every_block)
    meet = base.unionByName(query.select(base.columns))

    def against_block(group: pa.Table) -> pa.Table:
        sets, own = _sets_of(group, percent, width)
        _, label = np.unique(own, return_inverse=True)  # a node that asks and is asked is one
        return _table(own, spanning_links(sets, label, group.column("asks").to_numpy(zero_copy_only=False)))

    second = meet.groupBy("family", "q", "b").applyInArrow(against_block, LINKS)
    return links.unionByName(second)


def _parted(first: DataFrame) -> DataFrame:
    """``family, node, asks``: new families of the nodes that are not linked yet, by the rare shingles they have in common,
    each with the linked nodes that have one of these too.

    Two texts that link have a rare shingle in common, so a node without a partner here needs no comparison.
    """
    each = first.select("family", "node", "linked", F.explode("rare").alias("s"))
    asks = each.where("not linked")
    buckets = asks.groupBy("family", "s").agg(F.min("node").alias("head"), F.max("node").alias("other"))
    stars = asks.join(buckets.where("head < other"), ["family", "s"]).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    roots = components(stars)
    named = cut(buckets.join(roots.withColumnRenamed("node", "head"), "head", "left").select("family", "s", F.coalesce("root", "head").alias("new")))
    base = each.where("linked").join(named, ["family", "s"]).select(F.col("new").alias("family"), "node").distinct()
    parted = roots.select(F.col("root").alias("family"), "node").unionByName(roots.select(F.col("root").alias("family"), F.col("root").alias("node"))).unionByName(base.select("family", F.col("family").alias("node"))).distinct()
    return parted.withColumn("asks", F.lit(True)).unionByName(base.withColumn("asks", F.lit(False)))


