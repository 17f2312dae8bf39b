"""Choices at thresholds do not hang on how rows are dealt to tasks."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from driftlake.plans import catalog, evaluation  # noqa: F401


def test_mean_at_the_threshold_of_the_weighting(spark, tmp_path):
    rng = random.Random(4)
    per_user = {}
    for user in range(100):
        x = [rng.randrange(6000) for _ in range(59)]  # hundredths; a tenth modulo 7 is x itself
        while not 0 <= 60 * 2600 - sum(x) < 6000:
            x[rng.randrange(59)] = rng.randrange(6000)
        per_user[user] = [v / 100 for v in (*x, 60 * 2600 - sum(x))]  # the mean of y is 2.6
    rows = [(f * 100 + u, datetime(2024, 1, 1) + timedelta(seconds=f * 100 + u), u, "view", per_user[u][f]) for f in range(60) for u in range(100)]
    (tmp_path / "events.parquet").mkdir()
    for i in range(4):
        part = zip(*rows[i * 1500 : (i + 1) * 1500], strict=True)
        pq.write_table(pa.table(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), map(list, part), strict=True))), tmp_path / f"events.parquet/{i}.parquet")
    con = duckdb.connect(config={"threads": 1})  # rows in their order
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(catalog.ORACLE_SQL["reconciliation_selector"]).fetchall())
    assert {r[1] for r in want} == {"EQUAL", "ROBUST"}
    assert sorted(map(tuple, catalog.QUERIES["reconciliation_selector"](spark, str(tmp_path)).collect())) == want
