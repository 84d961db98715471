"""Source divergence audit: how far a source's words lie from its language's other sources, and which words set it apart.

Terms are runs of ``A-Z a-z`` and characters beyond ASCII, with A-Z lower-cased.  A language keeps the ``V`` terms that
at least ``MIN_DOCS`` of its documents hold.  Each (lang, source) group and each language gives a kept term
``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``, ``N`` being its count of all kept terms; two of them differ there by
``f(p, q) = floor((p - q)^2 / (p + q))``.  All arithmetic is in whole numbers.

``pairs`` sums ``f`` over all kept terms for each pair of sources of a language.  Most terms are missing from most
sources, so the sum is corrected from a baseline in which both lack all: a group's own terms against the other's
baseline (from a histogram of the group's ``p``), and terms of both, which are summed in each task before any row
leaves it.  ``tops`` takes the terms above a group's ``k``-th value by radix selection: distributed histograms over the
value's bits, high to low, then over the UTF-8 bytes of the terms that tie.

Defined cases: null text, lang and source count as ''; a group without terms has its pairs and no terms; a language that
keeps no term has pairs of value 0; repeated rows are documents of their own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.llm.common import scratch_table, steps, texts_of

MIN_DOCS = 10
SCALE = 1_000_000_000
#: Bits of a value, and of one histogram's digit; ``f`` is below ``2 ** 30``.
VALUE_BITS, DIGIT_BITS = 32, 8
#: Tied terms of a group that a window may sort once the histograms have narrowed them down.
FEW = 1000
#: Entries of a task's counts before they are summed and, if still more than half as many, handed on; entries handed on at once.
MAX_ENTRIES, ROWS_OUT = 1 << 21, 1 << 16
#: Pairs made in one step, and a task's pair sums before they are handed on.
STEP_PAIRS, MAX_SUMS = 1 << 18, 1 << 20

#: Letters to lower case, other ASCII to spaces; bytes beyond ASCII stay.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def share(count: Column, total: Column, kept: Column) -> Column:
    """``p`` of a count; the product outgrows 64 bits, so it is a decimal."""
    scaled = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", scaled, (total + 2 * kept).cast("decimal(20,0)"))


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values)


def partial_counts(documents: DataFrame) -> DataFrame:
    """``lang, term, found`` (source, count and documents), summed by each task; a row without term names a language's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        groups: dict[tuple[str, str], int] = {}
        waiting: list[tuple[np.ndarray, ...]] = []  # of keys (group, term), counts and documents
        held = 0

        def rows(keys: np.ndarray, counts: np.ndarray, docs: np.ndarray, term: pa.Array) -> pa.RecordBatch:
            """A row for each run of one language and term; ``term`` belongs to the sorted keys."""
            names = list(groups)
            number = {x: k for k, x in enumerate(dict.fromkeys(lang for lang, _ in names))}
            lang_of = np.array([number[lang] for lang, _ in names], np.int64)
            group, word = keys >> 32, keys & 0xFFFFFFFF
            order = np.lexsort((group, word, lang_of[group]))
            group, word = group[order], word[order]
            lang = lang_of[group]
            starts = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (word[1:] != word[:-1])])
            found = pa.StructArray.from_arrays([pa.array([source for _, source in names], pa.string()).take(pa.array(group)), pa.array(counts[order]), pa.array(docs[order])], names=["source", "count", "docs"])
            listed = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(keys)], pa.int32()), found)
            return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()).take(pa.array(lang[starts])), term.take(pa.array(word[starts])), listed], names=["lang", "term", "found"])

        def out() -> Iterator[pa.RecordBatch]:
            if waiting:
                keys, counts, docs = waiting[0]
                word = pa.array(list(codes), pa.binary()).cast(pa.string())
                parts = np.argsort(keys & 0xFFFFFFFF, kind="stable")
                for s in range(0, len(parts), ROWS_OUT):
                    some = parts[s : s + ROWS_OUT]
                    yield rows(keys[some], counts[some], docs[some], word)
            waiting.clear()
            codes.clear()

        for batch in steps(batches):
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            split = [terms_of(t) for t in texts_of(batch)]
            for term in set().union(*split).difference(codes):
                codes[term] = len(codes)
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter((codes[t] for terms in split for t in terms), np.int64, int(sizes.sum()))
            pairs, counts = np.unique(np.repeat(np.arange(len(split)), sizes) << 32 | ids, return_counts=True)
            waiting.append((group[pairs >> 32] << 32 | pairs & 0xFFFFFFFF, counts.astype(np.int64), np.ones(len(pairs), np.int64)))
            held += len(pairs)
            if held > MAX_ENTRIES:
                waiting[:] = [summed(*(np.concatenate(c) for c in zip(*waiting, strict=True)))]
                held = len(waiting[0][0])
                if held > MAX_ENTRIES // 2:
                    yield from out()
                    held = 0
        if waiting:
            waiting[:] = [summed(*(np.concatenate(c) for c in zip(*waiting, strict=True)))]
        yield from out()
        if groups:
            named = np.arange(len(groups), dtype=np.int64) << 32
            yield rows(named, np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64), pa.array([None], pa.string()))

    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return named.mapInArrow(run, "lang string, term string, found array<struct<source: string, count: long, docs: long>>")


def kept_terms(documents: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """``lang, term, lang_count, source, count`` of kept terms, and the groups: ``lang, source, total, kept, lang_total, base``."""
    spark = documents.sparkSession
    path = scratch_table(spark, "divergence-terms")
    parts = partial_counts(documents).repartition("lang", "term").select("lang", "term", F.inline("found"))
    by_group = parts.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    # One exchange serves both: a group's row goes where its term's rows are.
    by_term = by_group.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"), F.collect_list(F.struct("source", "count")).alias("found"))
    by_term.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "term", "lang_count", F.explode("found").alias("found")).select("lang", "term", "lang_count", "found.*").write.parquet(path)
    rows = spark.read.parquet(path)
    terms = rows.where("term is not null")
    langs = terms.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count_distinct("term").alias("kept"))
    groups = rows.groupBy("lang", "source").agg(F.sum("count").alias("total")).join(langs, "lang", "left").na.fill(0, ["lang_total", "kept"])
    groups = groups.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(1).cast("long")))
    path = scratch_table(spark, "divergence-groups")
    groups.write.parquet(path)
    return terms, spark.read.parquet(path)


def term_pairs(ends: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of a row in ``start .. stop`` and a later row of its term; ``ends``: where each row's term ends."""
    left = np.arange(start, stop)
    more = ends[start:stop] - left - 1
    first = np.repeat(left, more)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)


def shared_sums(rows: DataFrame) -> DataFrame:
    """``lang, a, b, shared`` (``a < b``): what the terms of both add to the baselines, from ``lang, term, source, p, base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        sums: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if sums:
                keys, value = sums[0]
                names = list(codes)
                lang, name = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
                a, b = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([lang.take(a), name.take(a), name.take(b), pa.array(value)], names=["lang", "a", "b", "shared"])
            sums.clear()

        def add(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of whole terms, by source."""
            langs, terms = table.column("lang").to_pylist(), table.column("term").to_pylist()
            code = np.array([codes.setdefault(g, len(codes)) for g in zip(langs, table.column("source").to_pylist(), strict=True)], np.int64)
            p, base = (table.column(c).to_numpy() for c in ("p", "base"))
            new = np.array([True, *(x != y for x, y in zip(zip(langs[1:], terms[1:], strict=True), zip(langs, terms, strict=False), strict=False))])
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(new)][np.cumsum(new) - 1]
            made = np.cumsum(ends - np.arange(len(new)) - 1)
            start = 0
            while start < len(new):
                stop = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + STEP_PAIRS, side="right")))
                left, right = term_pairs(ends, start, stop)
                f = lambda x, y: (x - y) * (x - y) // (x + y)
                x, y, u, v = p[left], p[right], base[left], base[right]
                sums.append(summed(code[left] << 32 | code[right], f(x, y) - f(x, v) - f(u, y) + f(u, v)))
                start = stop
                if sum(len(k) for k, _ in sums) > MAX_SUMS:
                    sums[:] = [summed(*(np.concatenate(c) for c in zip(*sums, strict=True)))]
                    if len(sums[0][0]) > MAX_SUMS // 2:
                        yield from out()

        open_: list[pa.Table] = []  # rows of the last term seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*open_, pa.Table.from_batches([batch])])
            langs, terms = table.column("lang").to_pylist(), table.column("term").to_pylist()
            last = table.num_rows - 1
            while last and (langs[last - 1], terms[last - 1]) == (langs[-1], terms[-1]):
                last -= 1
            open_ = [table.slice(last)]
            if last:
                yield from add(table.slice(0, last))
        for table in open_:
            yield from add(table)
        if sums:
            sums[:] = [summed(*(np.concatenate(c) for c in zip(*sums, strict=True)))]
        yield from out()

    dealt = rows.select("lang", "term", "source", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(run, "lang string, a string, b string, shared long").groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"))


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of each source and each other of its language; ``rows``: ``lang, term, source, p, base``."""
    group = groups.select("lang", "source", "base", "kept")
    other = group.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    both = group.join(other, "lang").where(F.col("source") != F.col("item"))
    zero = differ(F.col("base"), F.col("item_base"))
    # A group's own terms against another's baseline: alike for all terms of one p, so the group's histogram will do.
    shape = rows.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("terms"))
    own = shape.join(other, "lang").where(F.col("source") != F.col("item"))
    own = own.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (differ(F.col("p"), F.col("item_base")) - zero)).alias("own"))
    mine = own.unionByName(own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "own"))
    shared = shared_sums(rows)
    ab, ba = (shared.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), F.col("shared").alias("own")) for x, y in (("a", "b"), ("b", "a")))
    parts = both.select("lang", "source", "item", (F.col("kept") * zero).alias("own")).unionByName(mine).unionByName(ab).unionByName(ba)
    return parts.groupBy("lang", "source", "item").agg(F.sum("own").alias("value"))


def _narrowed(state: DataFrame, digits: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` (``keys, want``) with the ``digit`` whose rows hold the wanted one, in ascending order of digits, and the rows before it taken off ``want``."""
    counts = digits.groupBy(*keys, "digit").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("digit")  # at most 257 digits of a group
    counts = counts.withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    found = state.join(counts, keys).where((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("n")))
    return found.withColumn("want", F.col("want") - F.col("before")).drop("before")


def tops(rows: DataFrame, keys: list[str], k: int, few: int = FEW) -> DataFrame:
    """The ``k`` rows of each group of ``keys, item, value`` (value below ``2 ** 32``) with the largest value, least item among equal ones, with ``rank``.

    Radix selection: a histogram over each digit of the value finds the ``k``-th value of every group; of the rows that
    have just that value, histograms over one byte of the item after the other find the last one, unless so few are left
    that a window sorts them.  Rows are written once; each step reads them and aggregates before it shuffles.
    """
    spark = rows.sparkSession
    path = scratch_table(spark, "divergence-values")
    rows.select(*keys, "item", "value").write.parquet(path)
    rows = spark.read.parquet(path)
    mask = (1 << VALUE_BITS) - 1
    flipped = F.lit(mask) - F.col("value")  # so that the largest comes first
    state = rows.groupBy(*keys).agg(F.least(F.count("*"), F.lit(k)).alias("want")).withColumn("prefix", F.lit(0).cast("long"))
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        near = rows.join(state.select(*keys, "prefix"), keys).where(F.shiftright(flipped, shift + DIGIT_BITS) == F.col("prefix"))
        digits = near.select(*keys, F.shiftright(flipped, shift).bitwiseAND((1 << DIGIT_BITS) - 1).alias("digit"))
        state = _narrowed(state.drop("n"), digits, keys).select(*keys, "want", (F.col("prefix") * (1 << DIGIT_BITS) + F.col("digit")).alias("prefix"), "n")
        state = _written(state, "divergence-state")
    bound = state.select(*keys, (F.lit(mask) - F.col("prefix")).alias("bound"), "want", "n")
    over = rows.join(bound, keys)
    taken = [over.where("value > bound").select(*keys, "item", "value")]
    # Rows of the k-th value: all of them, few enough to sort, or narrowed byte by byte.
    tied = _written(over.where("value = bound").select(*keys, "item", "value", "want", "n"), "divergence-ties")
    byte = 1
    while True:
        taken.append(tied.where("n = want").select(*keys, "item", "value"))
        small = tied.where(f"n > want and n <= {few}")
        order = Window.partitionBy(*keys).orderBy("item")
        taken.append(small.withColumn("place", F.row_number().over(order)).where("place <= want").select(*keys, "item", "value"))
        tied = tied.where(f"n > want and n > {few}")
        if tied.isEmpty():
            break
        digit = F.coalesce(F.conv(F.hex(F.substring(F.col("item").cast("binary"), byte, 1)), 16, 10).cast("int"), F.lit(-1))  # an item that ends comes first
        digits = tied.withColumn("digit", digit)
        found = _narrowed(tied.groupBy(*keys).agg(F.max("want").alias("want")), digits, keys).select(*keys, F.col("digit").alias("bin"), F.col("want").alias("left"), F.col("n").alias("size"))
        met = digits.drop("n").join(found, keys)
        taken.append(met.where("digit < bin").select(*keys, "item", "value"))
        tied = _written(met.where("digit = bin").select(*keys, "item", "value", F.col("left").alias("want"), F.col("size").alias("n")), "divergence-ties")
        byte += 1
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item")))  # k rows of a group


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_table(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def audit(documents: DataFrame, k: int = 10, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank``: ``pair`` rows for each other source, ``term`` rows for the first ``k`` terms above the language."""
    terms, groups = kept_terms(documents, min_docs)
    rows = terms.join(groups, ["lang", "source"]).where("count > 0")
    rows = rows.select("lang", "source", "term", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_count"), F.col("lang_total"), F.col("kept")).alias("q"), "base")
    rows = _written(rows, "divergence-shares")
    keys = ["lang", "source"]
    by_pair = pairs(rows.drop("q"), groups).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item")))
    by_term = tops(rows.where("p > q").select(*keys, F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value")), keys, k)
    named = lambda df, part: df.select(*keys, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return named(by_pair, "pair").unionByName(named(by_term, "term"))
