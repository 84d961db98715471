"""Benchmark decontamination: CGK embedding, bit-sampling LSH over segment-sized windows, exact edit verification.

Texts and items are words: lower case, without marks at their ends.  A document leaks an item of ``n`` words if some
run of its words is within ``n * percent // 100`` word edits of it.

*Segments.* CGK distance grows faster than the edits, so an item of more than ``SEGMENT_WORDS`` words is cut into
segments of nearly equal length.  If a run is within ``percent`` of the item in edits, some segment is within ``percent``
of its own words of its part of the run (else the edits would sum to more), so no item is missed by the cut.
*Rare words.* A run within ``k`` edits of an item keeps one of any ``k + 1`` of its words.  The ``k + 1`` that the fewest
items of the block have are filed, and a document is held against an item only about places where one of them stands, so
what many items share (an instruction, a template) proposes none of them.
*Windows.* A window at each word, as long as the segment.  By the q-gram lemma a window within ``k`` edits shares at
least ``n - q + 1 - k q`` of its q-grams with the segment, so windows with fewer q-grams of any segment are passed over
without loss, from the positions of each segment's q-grams.
*Embedding.* The CGK random walk writes ``3 n`` symbols: at step ``j`` it copies the current word and goes on to the next
if a random bit of ``(j, word)`` says so.  Few edits become few differences.
*LSH.* Equal segments are one.  In each of ``REPEATS`` rounds, with a walk of its own, a few sampled steps of the embedding form a key; a window
and a segment with one key in common are a candidate.
*Verification.* The least edit distance of the whole item to any run of words about the window's place in it, by dynamic
programming.

The items are a stated query set: they are read in blocks of a bounded size, and each block is broadcast, its tables are
built once a worker, and it is held against all documents in one pass without a shuffle.

Defined cases: null and empty texts leak nothing; items without words are skipped; repeated rows are judged each, and
so are repeated items, whatever their ids; of runs with equally few edits the first, and of those the shortest, is told; null
ids pass through; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from takeline.llm.common import WordHashes, cut, rolling, scramble, steps, texts_of

PERCENT = 20
REPEATS = 24
SAMPLED = 3
#: Words of a segment, at most: so few that ``REPEATS`` rounds find one with all its edits.
SEGMENT_WORDS = 25
#: Characters of items that one pass holds, at most (about; a longer item is a block of its own).
BLOCK_CHARS = 8_000_000

#: Pairs of an item and a place that one step holds, at most (about; a document is never split).
STEP_PAIRS = 1 << 21

_MARKS = b"\"'`.,;:!?()[]{}<>*#$%&|_-"


def normal_word(word: bytes) -> int:
    """Hash of a word as it is compared: lower case, no marks at the ends unless it is all marks."""
    low = word.decode().lower().encode()
    return xxhash.xxh3_64_intdigest(low.strip(_MARKS) or low)


def sampled_steps(n: np.ndarray, repeat: int) -> np.ndarray:
    """The steps that round ``repeat`` samples for each length, within the first two thirds, where walks move."""
    drawn = scramble(np.arange(SAMPLED, dtype=np.uint64)[None, :] + (n.astype(np.uint64) << np.uint64(20))[:, None], 1000 + repeat)
    return np.sort((drawn % (2 * n.astype(np.uint64))[:, None]).astype(np.int64), 1)


def keys_of(windows: np.ndarray, n: np.ndarray, repeat: int) -> np.ndarray:
    """Keys of round ``repeat``: sampled symbols of the CGK walks over the first ``n`` words of each row.

    A walk is followed only as far as the sampled steps; at step ``j`` it stands at a word, and a random bit of
    (round, step, word) moves it on.  Past the end it reads zeros.
    """
    m = len(windows)
    padded = np.concatenate([windows, np.zeros((m, 1), np.uint64)], 1)
    sample = sampled_steps(n, repeat)
    at, rows, key = np.zeros(m, np.int64), np.arange(m), n.astype(np.uint64) << np.uint64(16) | np.uint64(repeat)
    column = np.zeros(m, np.int64)
    for j in range(int(sample.max()) + 1 if m else 0):
        symbol = padded[rows, at]
        while (due := sample[rows, np.minimum(column, SAMPLED - 1)] == j).any() and (due := due & (column < SAMPLED)).any():
            key = np.where(due, scramble(key ^ symbol, 400), key)
            column += due
        at = np.minimum(at + (scramble(symbol, 7919 * (repeat + 1) + j) >> np.uint64(63)).astype(np.int64), n)
    return key


def run_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edits that turn ``item`` into a run of ``text``, and that run; ``(most + 1, 0, 0)`` if there are more."""
    n, best = len(item), (most + 1, 0, 0)
    cost, start = np.arange(n + 1), np.zeros(n + 1, np.int64)
    for j, word in enumerate(text.tolist()):
        # Column of the dynamic programme; a run may start anywhere, so the first cell is free.
        diag = cost[:-1] + (item != np.uint64(word))
        new = np.r_[0, np.minimum(diag, cost[1:] + 1)]
        origin = np.r_[j + 1, np.where(diag <= cost[1:] + 1, start[:-1], start[1:])]
        steps_ = new - np.arange(n + 1)
        low = np.minimum.accumulate(steps_)
        source = np.maximum.accumulate(np.where(steps_ == low, np.arange(n + 1), 0))
        cost, start = low + np.arange(n + 1), origin[source]
        if cost[n] < best[0]:
            best = (int(cost[n]), int(start[n]), j + 1)
    return best


def stretches(places: list[int], slack: int, length: int, end: int) -> list[tuple[int, int]]:
    """Words in which runs of at most ``length`` words may lie that start within ``slack`` of a place; none overlap."""
    out: list[tuple[int, int]] = []
    for a in sorted(places):
        low, high = max(0, a - slack), min(end, a + slack + length)
        if out and low < out[-1][1]:
            low = out.pop()[0]
        if low < high:
            out.append((low, high))
    return out


def matches(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``values`` that occur in a sorted table, and the first row and number of rows there."""
    if not len(table):
        return (np.zeros(0, np.int64),) * 3
    low = np.searchsorted(table, values, "left")
    at = np.flatnonzero(table[np.minimum(low, len(table) - 1)] == values)
    low = low[at]
    return at, low, np.searchsorted(table, values[at], "right") - low


def spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``low .. low + count - 1`` of each row, end to end."""
    return np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())


def parted(cost: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose costs sum to at most ``most``, one row at least."""
    done, start = np.cumsum(cost), 0
    while start < len(cost):
        end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, side="right")))
        yield slice(start, end)
        start = end


def among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys a sorted table has."""
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), bool)


class Items:
    """A block of items, their rare words, their segments, and the segments' q-grams and LSH keys."""

    def __init__(self, items: list[tuple[object, str]], percent: int, hashes: WordHashes) -> None:
        self.ids, self.words = [], []
        for item_id, text in items:
            words = hashes((text or "").encode().split())
            if len(words):
                self.ids.append(item_id)
                self.words.append(words)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = self.size * percent // 100
        self.file_rare_words()
        #: Distinct segments, and who owns them: sorted by segment, the item and the place in it.
        known: dict[bytes, int] = {}
        owners: list[tuple[int, int, int]] = []
        for i, w in enumerate(self.words):
            for part in np.array_split(np.arange(len(w)), -(-len(w) // SEGMENT_WORDS)):
                owners.append((known.setdefault(w[part].tobytes(), len(known)), i, int(part[0])))
        segments = [np.frombuffer(x, np.uint64) for x in known]
        self.owner, self.item, self.place = (np.array(c, np.int64) for c in zip(*sorted(owners), strict=True)) if owners else (np.zeros(0, np.int64),) * 3
        self.by_item = np.argsort(self.item, kind="stable")  # an item's rows of the three
        self.item_starts = np.searchsorted(self.item[self.by_item], np.arange(len(self.words) + 1))
        #: Of each segment: words, q, and q-grams that a window within its edits must share.
        self.n = np.array([len(w) for w in segments], np.int64)
        self.q, self.need = self.n * 0, self.n * 0
        grams: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for i, w in enumerate(segments):
            k = len(w) * percent // 100
            q = max((q for q in (1, 2, 3) if len(w) - q + 1 - k * q >= 1), default=1)
            self.q[i], self.need[i] = q, max(len(w) - q + 1 - k * q, 1)
            grams[q].append((np.unique(rolling(w, q, 31)), i))
        #: By q: sorted (gram, segment) pairs.  A segment that repeats a gram needs fewer distinct ones; positions count, so that is safe.
        self.grams = {}
        for q, parts in grams.items():
            gram, segment = np.concatenate([g for g, _ in parts]), np.concatenate([np.full(len(g), i) for g, i in parts])
            order = np.argsort(gram, kind="stable")
            self.grams[q] = (gram[order], segment[order])
        #: Of each round: sorted keys and their segments.
        groups: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(self.n.tolist()):  # segments of similar length walk together
            groups[n.bit_length()].append(i)
        of = np.array([i for g in groups.values() for i in g], np.int64)
        padded = []
        for g in groups.values():
            rows = np.zeros((len(g), int(self.n[g].max())), np.uint64)
            for row, i in zip(rows, g, strict=True):
                row[: len(segments[i])] = segments[i]
            padded.append((rows, self.n[g]))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for r in range(REPEATS):
            keys = np.concatenate([keys_of(rows, n, r) for rows, n in padded]) if padded else np.zeros(0, np.uint64)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], of[order]))

    def file_rare_words(self) -> None:
        """``rare``: sorted words and the items they are filed for, the words that the fewest items have."""
        held = [np.unique(w) for w in self.words]
        words, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        number = dict(zip(words.tolist(), count.tolist(), strict=True))
        filed_words, filed_items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            order = np.lexsort((w, [number[x] for x in w.tolist()]))
            some = np.unique(w[order[: self.edits[i] + 1]])  # as many places, which may hold fewer words
            filed_words.append(some)
            filed_items.append(np.full(len(some), i))
        word, item = np.concatenate(filed_words), np.concatenate(filed_items)
        order = np.argsort(word, kind="stable")
        self.rare = word[order], item[order]

    def windows(self, h: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Lengths and window starts (in documents end to end) that share enough q-grams with a segment of that length.

        ``asked``: sorted ``document << 32 | segment`` of what may be found.
        """
        last = np.cumsum(sizes)
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for q, (grams, segments) in self.grams.items():
            at, low, count = matches(grams, rolling(h, q, 31))
            doc = np.searchsorted(last, at, "right")
            inside = at + q <= last[doc]
            at, doc, low, count = at[inside], doc[inside], low[inside], count[inside]
            met = []
            for part in parted(count, STEP_PAIRS):  # a gram of many segments meets the few that are asked for
                segment = segments[spread(low[part], count[part])]
                place, of = np.repeat(at[part], count[part]), np.repeat(doc[part], count[part])
                own = among(of << 32 | segment, asked)
                met.append((segment[own], place[own], of[own]))
            if not met:
                continue
            item, at, doc = (np.concatenate(c) for c in zip(*met, strict=True))
            order = np.lexsort((at, item))
            item, at, doc = item[order], at[order], doc[order]
            # `need` hits of one segment, neighbours in this order, within one window of one document.
            j = np.arange(len(at))
            end = j + self.need[item] - 1
            fits = end < len(at)
            j, end = j[fits], end[fits]
            ok = (item[j] == item[end]) & (doc[j] == doc[end]) & (at[end] - at[j] <= self.n[item[j]] - q)
            j, end = j[ok], end[ok]
            n = self.n[item[j]]
            first = np.maximum(at[end] - (n - q), (last - sizes)[doc[j]])
            span = at[j] - first + 1
            every = spread(first, span)
            n = np.repeat(n, span)
            for length in np.unique(n).tolist():
                starts[length].append(np.unique(every[n == length]))
        return [(length, np.unique(np.concatenate(x))) for length, x in sorted(starts.items())]

    def candidates(self, h: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and window starts with a key in common, of those ``asked`` for."""
        found = self.windows(h, sizes, asked)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for n, at in found:  # windows of similar length walk together
            by_size[n.bit_length()].append((n, at))
        last = np.cumsum(sizes)
        end = np.repeat(last, sizes)
        out = [np.zeros(0, np.uint64)]
        for group in by_size.values():
            n_all = np.concatenate([np.full(len(at), n) for n, at in group])
            at_all = np.concatenate([at for _, at in group])
            for start in range(0, len(at_all), 20_000):
                n, at = n_all[start : start + 20_000], at_all[start : start + 20_000]
                place = at[:, None] + np.arange(int(n.max()))
                inside = (np.arange(int(n.max())) < n[:, None]) & (place < end[at][:, None])
                rows = np.where(inside, h[np.minimum(place, len(h) - 1)], np.uint64(0))
                doc = np.searchsorted(last, at, "right")
                pairs = [np.zeros(0, np.uint64)]
                for r, (keys, of) in enumerate(self.tables):
                    w, low, count = matches(keys, keys_of(rows, n, r))
                    for part in parted(count, STEP_PAIRS):
                        segment, window = of[spread(low[part], count[part])], np.repeat(w[part], count[part])
                        own = among(doc[window] << 32 | segment, asked)
                        pairs.append(segment[own].astype(np.uint64) << np.uint64(32) | window[own].astype(np.uint64))
                    if sum(map(len, pairs)) > STEP_PAIRS:
                        pairs = [np.unique(np.concatenate(pairs))]
                pair = np.unique(np.concatenate(pairs))
                out.append(pair >> np.uint64(32) << np.uint64(32) | at[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)].astype(np.uint64))
        both = np.unique(np.concatenate(out))
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def found_in(self, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(document, item, edits, first word, end word)``: the best run of each leaked item in documents of word hashes."""
        sizes = np.array([len(x) for x in parts], np.int64)
        if not sizes.sum() or not self.words:
            return
        h = np.concatenate(parts)
        at, low, count = matches(self.rare[0], h)
        doc = np.searchsorted(np.cumsum(sizes), at, "right")
        some = np.unique(doc)  # documents with a rare word of some item
        cost = np.bincount(doc, count, len(parts))[some]
        for group in parted(cost, STEP_PAIRS):
            docs = some[group]
            own = np.isin(doc, docs)
            firsts = np.cumsum(sizes) - sizes
            shift = np.zeros(len(parts), np.int64)  # from places in all documents to those in these
            shift[docs] = firsts[docs] - (np.cumsum(sizes[docs]) - sizes[docs])
            item = self.rare[1][spread(low[own], count[own])]
            place = np.repeat(at[own] - shift[doc[own]], count[own])
            which = np.repeat(np.searchsorted(docs, doc[own]), count[own])
            for d, *leak in self.found_near([parts[d] for d in docs.tolist()], sizes[docs], item, place, which):
                yield int(docs[d]), *leak

    def found_near(self, parts: list[np.ndarray], sizes: np.ndarray, item: np.ndarray, place: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The same for documents whose rare words are given: the item, place and document of each."""
        asked = np.unique(doc << 32 | item)
        of_doc, of_item = asked >> 32, asked & 0xFFFFFFFF
        count = self.item_starts[of_item + 1] - self.item_starts[of_item]
        segment = self.owner[self.by_item[spread(self.item_starts[of_item], count)]]
        firsts = np.cumsum(sizes) - sizes
        segment, start = self.candidates(np.concatenate(parts), sizes, np.unique(np.repeat(of_doc, count) << 32 | segment))
        hits = np.sort(item << 40 | place)
        low = np.searchsorted(self.owner, segment, "left")
        count = np.searchsorted(self.owner, segment, "right") - low
        met: list[np.ndarray] = []
        for part in parted(count, STEP_PAIRS):
            row = spread(low[part], count[part])
            own, run = self.item[row], np.repeat(start[part], count[part]) - self.place[row]  # where the item's run would start
            reach = self.edits[own] + np.minimum(self.size[own], SEGMENT_WORDS)
            first = np.searchsorted(hits, own << 40 | np.maximum(run - reach, 0))
            near = np.searchsorted(hits, own << 40 | np.maximum(run + reach + self.size[own] + self.edits[own], 0), "right") > first
            d = np.searchsorted(firsts, np.repeat(start[part], count[part])[near], "right") - 1
            met.append(np.stack([d, own[near], run[near] - firsts[d]]))
        if not met:
            return
        d, own, run = np.unique(np.concatenate(met, axis=1), axis=1)
        ends = np.flatnonzero(np.r_[(d[1:] != d[:-1]) | (own[1:] != own[:-1]), True]) + 1 if len(d) else []
        begin = 0
        for end in ends:
            which, i, about = int(d[begin]), int(own[begin]), run[begin:end].tolist()
            begin = end
            h, words, k = parts[which], self.words[i], int(self.edits[i])
            best, slack = (k + 1, 0, 0), k + min(len(words), SEGMENT_WORDS)  # a window may lie off its segment by its length
            for low_, high in stretches(about, slack, len(words) + k, len(h)):
                text = h[low_:high]
                if np.isin(words, text).sum() < len(words) - k:  # each word that isn't there is an edit
                    continue
                edits, first_, end_ = run_distance(words, text, k)
                best = min(best, (edits, low_ + first_, low_ + end_))
            if best[0] <= k:
                yield which, i, *best


#: The block a worker has built last, by its label; words seen are remembered by a task only, since a worker goes on to other work.
_built: dict[str, Items] = {}


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, n_edits, first_word, end_word``: the best run of each leaked item in each document."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // block_chars))
    out = None
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text")
        one = _leaks_of(documents, [tuple(r) for r in rows.collect()], benchmark.schema["item_id"], percent)
        if blocks > 1:  # a block's items leave the driver before the next block's are read
            one = cut(one)
        out = one if out is None else out.unionByName(one)
    return out


def _leaks_of(documents: DataFrame, items: list[tuple[object, str]], item_id: StructField, percent: int) -> DataFrame:
    kind = dict(documents.dtypes)["doc_id"]
    item_type = to_arrow_type(item_id.dataType)
    sent, label = documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # ``block_chars`` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(normal_word)
        if label not in _built:
            _built.clear()
            _built[label] = Items(sent.value, percent, hashes)
        block = _built[label]
        for batch in steps(batches):
            parts = [hashes((t or b"").split()) for t in texts_of(batch)]
            found = list(block.found_in(parts))
            doc_ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            item_ids = pa.array([block.ids[f[1]] for f in found], item_type)
            yield pa.RecordBatch.from_arrays([doc_ids, item_ids, *(pa.array([f[c] for f in found], pa.int64()) for c in (2, 3, 4))], names=["doc_id", "item_id", "n_edits", "first_word", "end_word"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_id.dataType.simpleString()}, n_edits long, first_word long, end_word long")
