"""Streams that hold state: rows of trusted runs, and the fingerprint cache by increments."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.operators import audit
from sylva.sources import cache
from sylva.streaming import jobs
from tests.test_engine import LOG, LOG_SCHEMA


def drained(query, seconds=180):
    try:
        assert query.awaitTermination(seconds)
    finally:
        query.stop()


def test_rows_of_trusted_runs(spark, tmp_path):
    """Runs that end in the first or the second input, one longer than a release, late rows after a summary; a restart from
    the checkpoint lies between the inputs. The rows are those of the batch form."""
    row = lambda run, seq, kind, **k: (run, seq, kind, k.get("class_"), k.get("ok"), k.get("total"), k.get("counts"), k.get("conflicts"), k.get("calls"), None, None)
    log = list(LOG)
    for run, n, said in (("long", jobs.RELEASED + 50, 0), ("wrong", 30, 1), ("second", 40, 0)):
        log += [row(run, k, "file", class_="add") for k in range(n)] + [row(run, n, "summary", ok=True, total=n + said, counts={"add": n + said}, conflicts=0, calls=0)]
    log.sort(key=lambda r: r[1])
    first = [r for r in log if r[1] <= 20 and r[0] != "second"]
    rest = [r for r in log if r[1] > 20 or r[0] == "second"]
    parts = [spark.createDataFrame(x, LOG_SCHEMA).coalesce(1) for x in (first, rest)]
    run = lambda: jobs.released_rows(spark.readStream.schema(parts[0].schema).json(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    out = lambda: spark.read.schema(parts[0].schema).parquet(f"{tmp_path}/out")
    read = lambda q, n: sum(p["numInputRows"] for p in q.recentProgress) >= n
    parts[0].write.json(f"{tmp_path}/in")
    until(q := run(), lambda: read(q, len(first)) and not out().isEmpty())
    assert {r["run_id"] for r in out().collect()} == {"good"}
    parts[1].write.mode("append").json(f"{tmp_path}/in")
    late = [row("good", 99, "file", class_="add"), row("wrong", 99, "file", class_="add")]
    until(q := run(), lambda: read(q, len(rest)) and out().select("run_id").distinct().count() == 3)
    spark.createDataFrame(late, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    until(q := run(), lambda: read(q, len(late)))
    want = audit.trusted_rows(parts[0].unionByName(parts[1]))
    text = lambda df: Counter(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    assert text(out().select(*want.columns)) == text(want)


def until(query, seen, seconds=150):
    """Run a query until ``seen`` says so: timers keep batches coming, so such a stream never counts as drained."""
    try:
        end = time.time() + seconds
        while not seen() and time.time() < end and query.isActive:
            time.sleep(1)
        assert seen()
    finally:
        query.stop()


ROW = "path_key string, size long, mtime timestamp, digest string"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "path_key string, size long, s long, digest string").select("path_key", "size", F.timestamp_seconds("s").alias("mtime"), "digest")


def held(spark, at, pending=None):
    return {r["path_key"]: r["digest"] for r in cache.read_cache(spark, at, pending).collect()}


def test_increments(spark, tmp_path):
    """Random upserts: newest wins, what is written follows the batch, merged buckets say the same, NULL keys are dropped."""
    at, rng, want = f"{tmp_path}/cache", random.Random(5), {}
    assert cache.read_cache(spark, at).isEmpty()
    for n in range(9):
        batch = {f"/w/{rng.randint(0, 60)}": f"d{n}-{k}" for k in range(20)}
        want |= batch
        cache.append_cache(rows_of(spark, [(p, 1, 100 - n, d) for p, d in batch.items()] + [(None, 1, 1, "x")]), at, f"b{n}", buckets=4, most=3)
        assert held(spark, at) == want
        live = cache.live_files(spark, at)
        assert max(Counter(bucket for bucket, _ in live).values()) <= 3
    some = spark.createDataFrame([("/w/1",), ("/w/none",)], "path_key string")
    assert held(spark, at, some) == {p: d for p, d in want.items() if cache.bucket_of(spark, p, 4) in {cache.bucket_of(spark, "/w/1", 4), cache.bucket_of(spark, "/w/none", 4)}}
    before = cache.version(spark, at)
    cache.append_cache(rows_of(spark, [("/w/1", 1, 1, "again")]), at, "b8", buckets=4, most=3)  # a batch that is replayed
    assert cache.version(spark, at) == before and held(spark, at) == want
    with pytest.raises(ValueError, match="buckets"):
        cache.append_cache(rows_of(spark, [("/w/1", 1, 1, "x")]), at, "b10", buckets=8)


def test_a_crash_leaves_the_version_before(spark, tmp_path):
    """Files without a list that names them, and a list that was never published, aren't read; old ones go in the end."""
    at = f"{tmp_path}/cache"
    cache.append_cache(rows_of(spark, [("a", 1, 1, "1")]), at, "b0", buckets=2)
    (tmp_path / "cache" / "data" / "half").mkdir(parents=True)
    (tmp_path / "cache" / "data" / "half" / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "cache" / "lists" / ".tmp-7").write_bytes(b'{"live": [')
    assert held(spark, at) == {"a": "1"}
    for n in range(1, 6):
        cache.append_cache(rows_of(spark, [("a", 1, n, str(n))]), at, f"b{n}", buckets=2, most=2)
    assert held(spark, at) == {"a": "5"}
    cache.drop_unused(spark, at, keep=1, older_than_s=0)
    assert held(spark, at) == {"a": "5"} and len(list((tmp_path / "cache" / "lists").glob("*.json"))) == 1
    assert len(list((tmp_path / "cache" / "data").iterdir())) == len({d for _, d in cache.live_files(spark, at)})


def test_cache_stream_by_increments(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, 1, "1"), ("b", 1, 1, "1")], [("b", 1, 2, "2")]]):
        rows_of(spark, rows).coalesce(1).write.mode("append" if i else "error").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a restart finds nothing new
        drained(jobs.maintain_cache(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/cp").trigger(availableNow=True).start())
        assert held(spark, f"{tmp_path}/cache") == {"a": "1", "b": "2"}
