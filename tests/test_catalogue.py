import os

import pytest

import __spark_entry__ as entry
from takeline.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def normal(rows, names):
    return sorted(repr(tuple(r[n] for n in names)) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    import duckdb

    df = catalogue.QUERIES[name](spark, SF)
    got, names = [r.asDict() for r in df.collect()], sorted(df.columns)
    if name not in catalogue.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "conversations", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(catalogue.ORACLES[name])
    heads = [d[0] for d in cursor.description]
    assert sorted(heads) == names
    assert normal(got, names) == normal([dict(zip(heads, r, strict=True)) for r in cursor.fetchall()], names)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_beam_is_exact_on_pairs(spark):
    """The beam finds the exact best labels of every take of two."""
    import numpy as np

    from takeline.operators import decode

    takes, probs = catalogue.embedding_takes(spark, SF, 2), catalogue.embedding_probs(spark, SF)
    beam = {r["clip_id"]: r["label"] for r in decode.decode_takes(takes, probs, np.full((10, 10), 0.1), classes=10).collect()}
    for r in decode.pair_map(catalogue.take_rows(spark, SF, 2)).collect():
        assert (beam[str(2 * r["take_id"])], beam[str(2 * r["take_id"] + 1)]) == (r["label0"], r["label1"])
