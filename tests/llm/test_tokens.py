import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from takeline.llm import common
from takeline.llm import packing as P
from takeline.llm import token_files as F
from takeline.llm.tokens import TokenIds, default_tokenizer
from tests.llm.corpus import documents, frame


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", [None, "", " a ", "It's a <|endoftext|> x<|startoftext|>y", "a\u00a0b\x1cc\u2028d", "É e\u0301 \u0301x ß İ", "x" * 600 + " 12345 ---'s", "a\n\n\tb\x0bc \x85 d"])
def test_words_are_enough(text, ids):
    assert TokenIds().ids(None if text is None else text.encode()).tolist() == ids(text)


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def robin(docs, quanta, window, first=None):
    """The stream of a deficit round-robin as ``(queue, document, start, length)``, one round after another."""
    waiting = {q: [(d, a, min(window, n - a)) for d, n in rows for a in range(0, n, window)] for q, rows in docs.items()}
    deficit, out, r = dict.fromkeys(docs, Fraction(0)), [], 0
    while any(waiting.values()):
        r += 1
        for q in sorted(docs):
            if r <= (first or {}).get(q, 0):
                continue
            deficit[q] += quanta[q]
            while waiting[q] and waiting[q][0][2] <= deficit[q]:
                d, a, n = waiting[q].pop(0)
                deficit[q] -= n
                out.append((q, d, a, n))
    return out


def check_pieces(got, want_ids):
    """Every id once, gapless sequences of the right sizes; returns pieces by sequence."""
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, want in want_ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == crc(want[at : at + r["length"]])
            assert np.frombuffer(r["ids"], "<u2").tolist() == want[at : at + r["length"]]
            at += r["length"]
        assert at == len(want)
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.r_[0, np.cumsum([r["length"] for r in rs])][:-1].tolist()
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


def stream(by_seq):
    """``(queue, document, tokens)`` in order, pieces of one document that follow each other joined."""
    out = []
    for k in sorted(by_seq):
        for r in by_seq[k]:
            if out and out[-1][:2] == [r["source_queue"], r["doc_id"]] and out[-1][3] == r["start"]:
                out[-1][2] += r["length"]
                out[-1][3] += r["length"]
            else:
                out.append([r["source_queue"], r["doc_id"], r["length"], r["start"] + r["length"]])
    return [tuple(x[:3]) for x in out]


def test_packing(spark, ids):
    rows = documents()
    got = P.pack(frame(spark, rows)).collect()
    by_seq = check_pieces(got, {i: ids(text) for i, text, _ in rows})
    total = sum(len(ids(text)) for _, text, _ in rows)
    sizes = [sum(r["length"] for r in by_seq[k]) for k in sorted(by_seq)]
    assert sizes == [2048] * (total // 2048) + np.diff(P.tail_starts(total)).tolist()
    assert P.pack(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("weights, packet", [(None, 256), (None, 40), ({"s0": 5, "s1": 3}, 256), ({"s2": 1, "absent": 7}, 100)])
def test_round_robin(spark, ids, weights, packet):
    """The stream is what a round-robin sends that keeps deficits round by round; one input part, so queues are in row order."""
    rows = [r for r in documents() if r[0] != 1008] + [(2000, " ".join(f"x{k}" for k in range(900)), "s1")]
    docs, window = {}, 256
    for i, text, source in rows:
        docs.setdefault("null" if source is None else f"s:{source}", []).append((i, len(ids(text))))
    tokens = {q: sum(n for _, n in d) for q, d in docs.items()}
    given = {f"s:{q}": w for q, w in (weights or {}).items() if f"s:{q}" in docs}
    rest = [q for q in docs if q not in given]
    quanta = {q: Fraction(window * given[q], sum(given.values())) for q in given} | {q: Fraction(window * tokens[q], sum(tokens[r] for r in rest)) for q in rest}
    first = dict.fromkeys(rest, max((-(-tokens[q] // quanta[q]) for q in given), default=0))
    got = P.pack(frame(spark, rows).coalesce(1), window=window, weights=weights, packet=packet).collect()
    by_seq = check_pieces(got, {i: ids(text) for i, text, _ in rows})
    want = []
    for q, d, a, n in robin(docs, quanta, packet, first):
        if want and want[-1][:2] == [q, d]:
            want[-1][2] += n
        else:
            want.append([q, d, n])
    assert stream(by_seq) == [tuple(x) for x in want]


@pytest.mark.parametrize("sources, packet", [(20, 2048), (400, 2048), (20, 512), (20, 128)])
def test_shares_after_every_window(spark, ids, sources, packet):
    """At every window's end each source is within a packet of its share; pieces a document are few."""
    rng = np.random.default_rng(3)
    rows = [(i, "the " * int(rng.integers(1, 400)), f"q{int(rng.integers(sources))}") for i in range(3000)] + [(3000, "the " * 20_000, "q0")]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), packet=packet).collect()
    tokens = {i: len(ids(t)) for i, t, _ in rows}
    assert len(got) <= 1.02 * sum(1 + n / 2048 + n / packet * (packet < 2048) for n in tokens.values()) + 12
    share, total = {}, sum(tokens.values())
    for i, _, s in rows:
        share[f"s:{s}"] = share.get(f"s:{s}", 0) + tokens[i] / total
    sent, by_seq = dict.fromkeys(share, 0), {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k in range(total // 2048):
        for r in by_seq[k]:
            sent[r["source_queue"]] += r["length"]
        # All deficits together hold the stream back by less than their sum; a queue's own by less than a packet (or document).
        behind = sum(max(0.0, share[q] * 2048 * (k + 1) - sent[q]) for q in share)
        assert all(abs(sent[q] - share[q] * 2048 * (k + 1)) <= packet + share[q] * (behind + 2 * 2048 + sources * min(packet, 200)) for q in share), k


def test_windows_near_the_mixture(spark, ids):
    """Small packets bring every window to its targets; whole documents bring runs of windows there."""
    rng = np.random.default_rng(4)
    rows = [(i, "the " * int(rng.integers(50, 300)), f"q{int(rng.integers(5))}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"q0": 4, "q1": 3, "q2": 2, "q3": 2, "q4": 1}

    def distance(packet, run):
        by_seq = {}
        for r in P.pack(docs, packet=packet, weights=weights).collect():
            by_seq.setdefault(r["sequence_id"] // run, dict.fromkeys(weights, 0))[r["source_queue"][2:]] += r["length"]
        dry = min(sum(len(ids(t)) for _, t, s in rows if s == q) * 12 / w for q, w in weights.items())  # tokens before a source runs dry
        whole = [c for k, c in by_seq.items() if (k + 1) * run * 2048 <= dry and sum(c.values()) == run * 2048]
        return np.mean([sum(abs(c[q] / sum(c.values()) - w / 12) for q, w in weights.items()) / 2 for c in whole])

    assert distance(32, 1) < 0.04 and distance(2048, 16) < 0.05 and distance(512, 1) < 0.4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=20), st.integers(1, 64))
def test_every_token_once(lengths, window):
    cutter, places, at = P.Cutter(sum(lengths), window), [], 0
    for n in lengths:
        done = 0
        for start, length, w, offset in cutter.pieces([(a, min(window, n - a), at + a) for a in range(0, n, window)]):
            assert start == done
            done += length
            places += [(w, offset + k) for k in range(length)]
        assert done == n
        at += n
    sizes = [window] * (at // window) + np.diff(P.tail_starts(at, window)).tolist()
    assert places == [(w, k) for w, n in enumerate(sizes) for k in range(n)]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 500), st.integers(1, 10**9), min_size=1, max_size=80))
def test_code_lengths(counts):
    import heapq

    lengths = F.code_lengths(counts, 16)
    assert sum(2.0 ** -n for n in lengths.values()) <= 1 and max(lengths.values()) <= 16
    heap, cost = sorted(counts.values()), 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    mine = sum(counts[s] * n for s, n in lengths.items())
    assert mine >= cost and (max(lengths.values()) == 16 or len(counts) == 1 or mine == cost)


def test_limit_is_optimal():
    assert sorted(F.code_lengths({i: 2**i for i in range(6)}, 3).values()) == [2, 2, 3, 3, 3, 3]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700))
def test_blocks(values):
    x = np.array(values)
    coder = F.Coder(F.code_lengths({s: int((x == s).sum()) for s in set(values)}))
    offsets, bits = coder.encode(x)
    assert coder.decode(offsets, bits, len(x)).tolist() == values


def test_files(spark, ids):
    rows = documents()
    path = F.write_token_files(frame(spark, rows), shards=3)
    got = {r["doc_id"]: r for r in F.read_token_files(spark, path).collect()}
    at = 0
    for i, text, _ in sorted(rows):
        want = ids(text)
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), crc(want))
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)
    assert F.read_token_files(spark, F.write_token_files(frame(spark, rows).limit(0))).count() == 0


def test_memo_keeps_its_bound_and_its_values(monkeypatch):
    monkeypatch.setattr(common, "MEMO_ENTRIES", 10)
    asked = []
    memo = common.Memo(lambda k: asked.append(k) or k * k)
    for n in range(200):
        memo.trim()
        assert memo[n] == n * n and memo[3] == 9
        assert len(memo) + len(memo.older) <= 14  # the bound, and what came in between two trims
    assert asked.count(3) == 1  # a frequent key stays


def test_weights_among_many_sources(spark):
    """Weighted sources keep to their targets; each of the others has a queue of its own and comes after them."""
    rows = [(i, "some words of a text " * 20, f"s{i % 2}") for i in range(40)] + [(100 + i, "rare text", f"other{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = P.pack(docs, window=64, weights={"s0": 3, "s1": 1}).collect()
    queues = {r["source_queue"] for r in out}
    assert queues == {"s:s0", "s:s1", *(f"s:other{i}" for i in range(30))}
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    sent = dict.fromkeys(queues, 0)
    for w in range(30):
        for r in out:
            if r["sequence_id"] == w:
                sent[r["source_queue"]] += r["length"]
        assert abs(sent["s:s0"] - 48 * (w + 1)) <= 64 and abs(sent["s:s1"] - 16 * (w + 1)) <= 64
        assert sum(sent.values()) == sent["s:s0"] + sent["s:s1"]


def test_scratch_tables(spark, monkeypatch):
    """A cluster without a shared folder is an error; scratch tables can be removed, other paths not."""
    path = common.scratch_table(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    common.remove_scratch(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
    with pytest.raises(ValueError, match="no scratch table"):
        common.remove_scratch(spark, "/root/testdata")

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
