"""Every registered query on tables without rows."""

from palimpsest.plans import queries as q

SLOW = {"stream_steps", "stream_chunks"}  # their logs are empty: tests/test_streams.py has that case


def test_every_query_runs_on_empty_tables(spark, small, tmp_path):
    for name in ("documents", "conversations", "embeddings", "events", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    failed = {}
    for name, query in q.QUERIES.items():
        if name in SLOW:
            continue
        try:
            query(spark, str(tmp_path)).collect()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    assert not failed
