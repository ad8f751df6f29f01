"""Quotients of values that aren't prices, held to the SQL row by row."""

import random

import duckdb
import pytest

from ensemblake.plans import q_more, q_ragged


@pytest.mark.parametrize("name", ["div", "rdiv"])
def test_quotients_round_as_their_sql(spark, tmp_path, name):
    rng = random.Random(6)
    kinds = ["click", "error", "purchase", "signup", "view"]
    values = [0.0, -0.0, -3.5, 5.12, 1e300, 1e-300] + [rng.random() * 10.0 ** rng.randint(-12, 12) for _ in range(20_000)]
    path = f"{tmp_path}/events.parquet"
    rows = [(k, f"2024-01-01 00:{k // 60 % 60:02}:{k % 60:02}", k % 50, kinds[k % 5], v) for k, v in enumerate(values + [0.0] * 5)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "ts::timestamp AS ts", "user_id", "event_type", "value", "'{}' AS props").write.parquet(path)
    run, sql = (q_ragged.Q | q_more.Q)[f"ragged_arith_{name}"]
    run(spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    con.execute(f"CREATE TABLE want AS {sql}")
    con.execute(f"CREATE VIEW got AS SELECT traj_id, frame, v FROM '{tmp_path}/got/*.parquet'")
    assert con.execute("SELECT count(*) FROM want").fetchall() == [(len(rows),)]
    assert con.execute("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall() == []
