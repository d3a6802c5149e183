"""Queries over whole tables, and operators that were cut or unrefined, on small fixtures."""

from statistics import median

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_catalog import plain

from tessera.functions import text
from tessera.operators import curves, frontier
from tessera.plans import catalog

SF = "/root/testdata/sf0.01"


WHOLE = {"finite_difference_orders": ("part", "id"), "leave_one_out_outlier": ("part", "seed"), "melody_token_stats": ("events", "piece"), "clip_spread_order": ("documents", "name"), "prefix_shift": ("documents", "doc_id"), "utf8_byte_spans": ("benchmark", "item_id")}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "part", "events"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, want = catalog.QUERIES[name](spark, SF), db.sql(catalog.ORACLE_SQL[name])
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got == plain(want.fetchall(), want.columns)
    table, key = WHOLE[name]
    every = {"part": "count(*)", "events": "count(DISTINCT user_id)", "documents": "count(*) FILTER (strlen(text) >= 255)", "benchmark": "count(*)"}[table]
    if name != "prefix_shift":
        assert len({r[0] for r in df.select(key).collect()}) == db.sql(f"SELECT {every} FROM {table}").fetchall()[0][0]


def test_families_are_looked_for_in_all_parts(spark):
    assert catalog.QUERIES["detect_families"](spark, SF).agg({"id": "max"}).first()[0] >= 200


@pytest.mark.parametrize("name", ["skyline_melody", "melody_to_notes", "melody_token_stats"])
def test_notes_of_large_ids_equal_sql(spark, tmp_path, name):
    """Of one pitch, the note that starts a tick earlier has an id three million higher and ends earlier."""
    pq.write_table(pa.table({"event_id": [1401, 1400 + 76 * 40_000], "user_id": [1, 1], "value": [60.0, 60.0]}), tmp_path / "events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df, want = catalog.QUERIES[name](spark, str(tmp_path)), db.sql(catalog.ORACLE_SQL[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_outliers_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), i, float(v)) for i, (a, v) in enumerate(zip(rng.integers(0, 6, 90), rng.integers(1, 9, 90)))] + [(7, 90, 100.0), (8, 91, 3.0), (8, 92, 60.0)]
    got = {r.seed: r.outlier for r in curves.outliers(spark.createDataFrame(rows, "arm long, seed long, v double")).collect()}
    for a, i, v in rows:
        others = [x for b, j, x in rows if b == a and j != i]
        assert got[i] == bool(others and v > 2.5 * median(others) and v > 1.1 * max(x for _, _, x in rows if x != v))


def test_spans_of_wide_characters(spark):
    s = "aä€😀b" * 3
    got = spark.createDataFrame([(s,)], "s string").select(text.byte_spans("s").alias("x")).first().x
    assert [(r.ch, r.first, r.size) for r in got] == [(c, len(s[:i].encode()), len(c.encode())) for i, c in enumerate(s)]


def test_each_group_has_its_own_exponent(spark):
    laws = {"a": (0.3137, 2.0, 0.5), "b": (1.2345, 1.0, 0.2), None: (0.071, 3.0, 0.1)}
    rows = [(g, 1e15 * c, e + k * c**-a) for g, (a, k, e) in laws.items() for c in np.geomspace(0.1, 50, 12).tolist()]
    fit = frontier.floor_fit(spark.createDataFrame(rows, "g string, C double, bpb double"), "g").collect()
    assert {r.g for r in fit} == set(laws)
    for r in fit:
        assert (r.alpha, r.amplitude, r.floor) == pytest.approx(laws[r.g], abs=2e-4)
