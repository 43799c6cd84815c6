"""Every registered query: against its SQL where there is one, and by its shape elsewhere."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from talkspan.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return repr(round(float(x), 6)) if isinstance(x, (int, float)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0 or name == "fragment_zones"
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_backends_side_by_side(spark):
    """Each backend's turns are the runs of its own labels."""
    queries = catalogue.queries()
    got = queries["backend_compare"](spark, SF).toPandas()
    times = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for backend, name in (("recording", "recording_cluster"), ("vbx", "vbx_cluster")):
        labels = queries[name](spark, SF).toPandas().sort_values(["item_id", "win_no"])
        assert len(labels) == times
        want, before = [], None
        for item, win, label in labels[["item_id", "win_no", "label"]].itertuples(index=False):
            if before == (item, label):
                want[-1] = (item, want[-1][1], 600 * win + 1500, label)
            else:
                want.append((item, 600 * win, 600 * win + 1500, label))
            before = (item, label)
        rows = got[got.backend == backend][["item_id", "start_ms", "end_ms", "speaker"]]
        assert sorted(want) == sorted(rows.itertuples(index=False, name=None))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_interval_joins_are_not_nested_loops(spark):
    for name in ("word_speaker_overlap", "words_in_turn_count", "active_segment_asof", "contained_turns"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["library_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_scores_that_round_to_zero_keep_their_sign(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table embeddings as select vec_id, cast(list_transform(range(64), lambda i: case when i = 2 then (vec_id - 3) * 1e-6 when i = 5 then 1 else 0 end) as float[]) as embedding, 0 as label from range(6) t(vec_id)")
    con.execute(f"copy embeddings to '{tmp_path}/embeddings.parquet' (format parquet)")
    got = catalogue.queries()["pluggable_scores"](spark, str(tmp_path)).toPandas()
    want = con.execute(catalogue.oracle_sql()["pluggable_scores"]).df()
    exact = lambda df: sorted((r.item_id, r.win_no, [repr(float(x)) for x in r.scores], repr(r.prob)) for r in df.itertuples())
    assert exact(got) == exact(want)
    assert any(x == 0 and math.copysign(1, x) < 0 for r in got.scores for x in r)


def test_signals_are_dealt_out_and_passed_once(spark):
    """A table of one small file is no single task; presets share one pass; frames are not exploded over their samples."""
    from talkspan.plans import signals

    assert signals.signals(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = lambda name: catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan("preset_features").count("customer.parquet") == 1
    assert "Generate" not in plan("raw_frames")


def test_signals_by_their_definition(spark):
    from talkspan.plans import signals

    i = np.arange(signals.LENGTH)
    rows = signals.signals(spark, SF).where("item_id % 5 = 0").collect()
    assert len(rows) == 30
    for key, x in rows:
        tones = [a * np.sin(i * (2 * np.pi * (key % 50 + f) / signals.RATE)) for f, a in ((233.0, 0.07), (701.0, 0.03), (1234.5, 0.01))]
        assert np.abs(np.array(x) - (key % 7 + 1) * sum(tones)).max() < 1e-13
