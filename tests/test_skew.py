"""The same answers when one entity holds a third of all rows and one window is crowded."""

import shutil

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import DATA, TABLES

NAMES = (
    "agg_gps_latest_setup", "agg_grid_force_classic", "agg_grid_isr_classic", "agg_active_threats_setup",
    "join_aircraft_gps_setup", "join_cyber_gps_setup", "join_units_threat_classic",
    "join_operational_picture_classic", "union_alerts_classic", "track_unified", "union_dedupe_merge_cyber",
    "state_fresh_gps_day", "snk_upsert", "doc_upsert_naval", "derive_affected_units", "lookup_corrective_actions",
    "action_audit", "stream_stateful_latest",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for table in TABLES:
        if table != "events":
            shutil.copyfile(f"{DATA}/{table}.parquet", folder / f"{table}.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (
        SELECT event_id, CASE WHEN event_id % 4 = 1 THEN TIMESTAMP '2024-01-10 00:01:00' + INTERVAL (event_id) MILLISECOND
                              ELSE ts END AS ts,
          CAST(CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS BIGINT) AS user_id, event_type, value, props
        FROM '{DATA}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)""")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, skewed, name):
    folder, con = skewed
    df = contract.queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    assert ours == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
