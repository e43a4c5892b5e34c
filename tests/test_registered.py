import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from telewatch.operators import availability as A
from telewatch.operators import scoring as D
from telewatch.plans import registered
from telewatch.plans.network import Network
from telewatch.sources import event_log

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_every_query_has_a_name_and_nearly_every_one_has_sql():
    queries, oracles = registered.queries(), registered.oracle_sql()
    assert set(queries) <= set(entry.queries()) and set(oracles) <= set(entry.oracle_sql())
    assert set(oracles) <= set(queries) and set(queries) - set(oracles) == {"fault_clusters", "cluster_parameter_sweep"}


@pytest.mark.parametrize("gone", ["public_tokenizers", "telewatch.llm", "corpus_pipeline"])
def test_entry_works_without_the_training_text_operators(gone):
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, timeout=300)
    found = [int(x) for x in done.stdout.split()]
    n, m = len(registered.queries()), len(registered.oracle_sql())
    assert found == [n, m] if gone != "corpus_pipeline" else (found[0] >= n and found[1] >= m), done.stderr


@needs_tables
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"event_id", "station_id", "start_utc", "end_utc", "duration_hours", "outage_class"}


CHECKED = ["latest_per_bin", "complete_local_grid", "station_manifest", "audit_summary", "classified_events", "station_reliability", "cooccurrence",
           "window_geography", "window_durations", "window_recovery", "observation_cadence", "anomaly_scores", "fault_episodes", "review_queue",
           "channel_confirmation", "relabelled_episodes", "gap_table_checks", "committed_stages", "station_file_checks", "station_file_headers", "rejected_text", "published_columns"]


@needs_tables
@pytest.mark.parametrize("name", CHECKED)
def test_results_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{table}'")
    df = entry.queries()[name](spark, SMALL)
    answer = db.execute(entry.oracle_sql()[name])
    assert df.columns == [d[0] for d in answer.description]

    def key(r):
        return [(x is None, str(x)) for x in r]

    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(answer.fetchall(), key=key)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_plans_have_no_nested_loops(spark):
    net = Network(spark, SMALL)
    for df in (net.states, A.outage_events(net.states), A.classify_events(net.stored_events, net.stored_windows), net.members,
               event_log.station_hours(spark, SMALL)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


@needs_tables
def test_the_log_is_read_once(spark):
    for df in (event_log.station_hours(spark, SMALL), Network(spark, SMALL).states):
        assert "events.parquet" not in plan(df)


@needs_tables
@pytest.mark.parametrize("name", ["raw_table_checks", "gap_table_checks", "validation_verdict", "complete_utc_grid", "complete_local_grid"])
def test_checks_and_grids_read_the_log_at_most_twice(spark, name, monkeypatch):
    reads, load = [], event_log.load
    monkeypatch.setattr(event_log, "load", lambda spark, folder, table, *c: (reads.append(table), load(spark, folder, table, *c))[1])
    text = plan(entry.queries()[name](spark, SMALL))
    assert reads.count("events") <= 2 and "events.parquet" not in text  # each read ends in a stored table


@needs_tables
def test_detectors_share_one_exchange(spark):
    hours = event_log.station_hours(spark, SMALL)
    long = D.by_series(D.long_channels(hours.sparkSession.createDataFrame([], hours.schema), ["temp_avg_c", "uv_high"]))
    text = plan(D.stuck_values(D.score_series(long, D.SERIES), D.SERIES, "hour_utc"))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text


@needs_tables
def test_scans_read_only_what_is_needed(spark):
    text = plan(event_log.observations(spark, SMALL).select("station_id", "obs_time_utc"))
    schema = text[text.index("ReadSchema"):]
    assert "user_id" in schema and "ts" in schema and "props" not in schema and "value" not in schema
