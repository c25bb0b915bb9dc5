"""Every registered query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from mnemora.plans import extension_queries, flow_queries, incremental_queries, registry, relational_queries, search_queries, source_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cells(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        else:
            frame[c] = frame[c].map(lambda v: "null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, db, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(cells(got), cells(want), check_dtype=False)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_alignment_takes_every_row(spark, tmp_path):
    """Beyond the first 400 ids too: the groups of a section are those of the plain version over all of its rows."""
    import numpy as np

    from mnemora.operators import align

    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=4).tolist(), i * 7 % 45) for i in range(900)] + [(900, [1.0, 0.0, 0.0, 0.0], 99)]  # a section of one side alone
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(x.section, x.number): (x.left, x.right) for x in registry.QUERIES["d_align_dp"](spark, str(tmp_path)).collect()}
    want = {}
    for label in [*range(45), 99]:
        side = [[x for x in rows if x[2] == label and x[0] % 2 == k] for k in (0, 1)]
        vectors = [np.array([x[1] for x in s], np.float32).reshape(len(s), 4).astype(float) for s in side]
        lengths = [np.array([x[0] % 13 + 5 for x in s], float) for s in side]
        for k, (x, y) in enumerate(align.groups(*vectors, *lengths)):
            want[label, k] = (list(x), list(y))
    assert got == want


def test_lines_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """More rows are more tasks, each with about as many."""
    from mnemora.plans import views

    monkeypatch.setattr(views, "TASK_ROWS", 500)
    for name in ("w_bump_micros", "d_github_pr"):
        plan = registry.QUERIES[name](spark, sf_dir)
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        assert "REPARTITION_BY_NUM" in text and f"{rows // 500 + 1})" in text


def test_hits_are_mapped_once_and_dealt_by_number(spark, sf_dir, monkeypatch):
    """Rows of hits are found once for a query of one row, and more lines are more tasks."""
    from mnemora.operators import retrieval
    from mnemora.plans import views

    monkeypatch.setattr(views, "TASK_ROWS", 500)
    plan = registry.QUERIES["r_rows_for_hit"](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert f"{lines // 500 + 1}), REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()
    calls, plain = [], retrieval.rows_of_hits
    monkeypatch.setattr(retrieval, "rows_of_hits", lambda *a: calls.append(1) or plain(*a))
    registry.QUERIES["r_hits_for_row"](spark, sf_dir)
    assert len(calls) == 1


def test_resumed_series_is_planned_once(spark, sf_dir):
    """The plan reads the events for what the windows give, and not again for each use of the windows."""
    plan = registry.QUERIES["resume_windows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id") and plan.count("user_id") and plan.count("Window") == 0
