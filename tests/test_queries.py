"""Registered queries against their SQL, as the driver compares them."""

from __future__ import annotations

import glob
import os
import random

import duckdb
import pytest

from quatrain.operators import sampling
from quatrain.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_exact_draw_is_the_sequential_program_s(spark):
    """A plain program over lists, run on the whole table."""
    from quatrain.plans import wide

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "source").collect()
    targets = {k: min(n, 12) for k, n in wide.DRAW.items()}
    drawn = []
    for lang, target in targets.items():
        by_source = {}
        for r in sorted(rows):
            if r["lang"] == lang:
                by_source.setdefault(r["source"], []).append(r["doc_id"])
        stream, names = random.Random(wide.DRAW_SEED + wide.DRAW_OFFSETS[lang]), sorted(by_source)
        stream.shuffle(names)
        for name in names:
            stream.shuffle(by_source[name])
        taken = []
        for k in range(wide.DRAW_MOST):
            turn = names[:]
            stream.shuffle(turn)
            taken += [by_source[name][k] for name in turn if k < len(by_source[name])]
        drawn += taken[:target]
    random.Random(wide.DRAW_SEED + 997).shuffle(drawn)
    docs = spark.createDataFrame(rows)
    got = sampling.exact_sample(docs, "lang", "source", "doc_id", targets, wide.DRAW_SEED, wide.DRAW_MOST, wide.DRAW_OFFSETS)
    assert [r["doc_id"] for r in got.orderBy("annotation_pos").collect()] == drawn
    assert [r["annotation_pos"] for r in got.orderBy("annotation_pos").collect()] == list(range(1, len(drawn) + 1))
    with pytest.raises(Exception, match="repeats"):
        sampling.exact_sample(docs.union(docs), "lang", "source", "doc_id", {"en": 60}, 1, 3).collect()
