import json
import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from haulplan import assign_shards, estimate, pending_work, plan, retry_plan, shard_status, shard_summary
from haulplan.operators.attempts import attempt_summary, number_attempts
from haulplan.operators.transfer_time import time_range, time_steps_for, time_table
from haulplan.sources import listing
from haulplan.streaming import jobs as live

ATTEMPTS = [
    (0, 1, 1), (0, 2, 0),              # done at the second attempt
    (1, 1, 3), (1, 2, 4),              # failed twice
    (2, 1, 0), (2, 2, 7),              # what follows a success is ignored
    (4, 1, None),                      # shard file was missing
    (5, 1, 9), (5, 2, None),           # failed, then missing
    (6, 1, 1), (6, 2, 1), (6, 3, 1),   # used up with three attempts
]
STATE = {0: (2, "done", 0), 1: (2, "fail", 4), 2: (1, "done", 0), 4: (1, "pending", None), 5: (2, "fail", 9), 6: (3, "fail", 1)}


@pytest.fixture
def attempts(spark):
    return spark.createDataFrame(ATTEMPTS, "shard_id int, attempt bigint, rc int").repartition(3)


def test_summary(attempts):
    assert {r.shard_id: (r.attempts, r.status, r.last_rc) for r in attempt_summary(attempts).collect()} == STATE


def test_status_retry_and_pending(spark, attempts):
    sharded = spark.createDataFrame([(i, 1 + i % 7, 10) for i in range(35)], "seq bigint, shard_id int, size bigint").where("shard_id < 7")
    status = shard_status(shard_summary(sharded, 8), attempts)
    found = {r.shard_id: (r.attempts, r.status, r.last_rc) for r in status.collect()}
    assert found == {**STATE, 0: (2, "done", 0), 3: (0, "pending", None), 7: (0, "done", None)}
    actions = {r.shard_id: r.action for r in retry_plan(status, max_attempts=3).collect()}
    assert actions == {0: "none", 1: "retry", 2: "none", 3: "start", 4: "start", 5: "retry", 6: "exhausted", 7: "none"}
    assert {r.shard_id for r in pending_work(sharded, status).collect()} == {1, 3, 4, 5, 6}


def test_numbering(spark):
    log = [(s, f"2024-01-0{1 + (i * 7) % 9} 00:00:00", i, i % 4) for i in range(60) for s in (1, 2)]
    rows = spark.createDataFrame(log, "shard_id int, ts string, event_id bigint, rc int").withColumn("ts", F.to_timestamp("ts"))
    got = number_attempts(rows).orderBy("shard_id", "attempt").collect()
    want = [(s, n + 1, rc) for s in (1, 2) for n, (_, _, rc) in enumerate(sorted((t, e, rc) for k, t, e, rc in log if k == s))]
    assert [tuple(r) for r in got] == want


def test_live_status_equals_batch(spark, attempts, tmp_path):
    attempts.coalesce(1).write.parquet(str(tmp_path / "log"))
    schema = attempts.schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    live.keep_latest(live.live_shard_status(stream()), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([(1, 3, 0)], schema).write.mode("append").parquet(str(tmp_path / "log"))
    live.keep_latest(live.live_shard_status(stream()), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batches = spark.read.parquet(str(tmp_path / "out"))
    latest = batches.where(F.col("batch") == batches.agg(F.max("batch")).first()[0])
    found = {r.shard_id: (r.attempts, r.status, r.last_rc) for r in latest.collect()}
    assert found == {**STATE, 1: (3, "done", 0)}


def test_arriving_parts(spark, tmp_path):
    parts, out, state = tmp_path / "parts", str(tmp_path / "manifest"), str(tmp_path / "state")
    parts.mkdir()

    def arrive(name, objects, prefix=None):
        if prefix:
            (parts / f"{name}.prefix").write_text(prefix)
        (parts / f"{name}.json").write_text(objects if isinstance(objects, str) else json.dumps(objects))

    def run():
        live.append_parts(live.stream_parts(spark, str(parts)), str(parts), out, f"{state}/a", "s:b", "d:b", "r").awaitTermination()
        live.keep_latest(live.live_progress(live.stream_parts(spark, str(parts))), f"{out}_p", f"{state}/p").awaitTermination()
        batches = spark.read.parquet(f"{out}_p")
        return tuple(batches.orderBy(F.col("batch").desc()).select("files_listed", "bytes_listed").first())

    arrive("lsjson-1", [{"Path": "a", "Size": 4}, {"Path": "d", "IsDir": True}, 7])
    assert run() == (1, 4)
    arrive("lsjson-2", [{"Path": "b", "Size": 5}, {"Path": "c"}], prefix="sub\n")
    arrive("lsjson-3", "[broken")
    assert run() == (3, 9)
    rows = spark.read.parquet(out).select("path", "source", "size").collect()
    assert sorted(tuple(r) for r in rows) == [("a", "s:b/a", 4), ("sub/b", "s:b/sub/b", 5), ("sub/c", "s:b/sub/c", 0)]
    assert [r.part for r in spark.read.json(f"{out}_rejected").collect()] == ["lsjson-3.json"]


def test_late_sidecars(spark, tmp_path):
    """A sidecar after its part counts; a part without one waits for a file that is young enough."""
    parts, out, state = tmp_path / "parts", str(tmp_path / "manifest"), str(tmp_path / "state")
    parts.mkdir()

    def arrive(name, text, minute):
        (parts / name).write_text(text)
        os.utime(parts / name, (10**9 + 60 * minute,) * 2)

    def run():
        arriving = live.stream_parts_and_sidecars(spark, str(parts), "5 minutes")
        live.append_parts(arriving, str(parts), out, state, "s:b", "d:b", "r").awaitTermination()
        rows = spark.read.parquet(out).select("path", "size").collect() if list(Path(out).glob("batch=*/*.parquet")) else []
        return sorted(tuple(r) for r in rows)

    arrive("lsjson-1.json", '[{"Path": "a", "Size": 4}]', 0)
    arrive("lsjson-2.json", '[{"Path": "b", "Size": 5}]', 1)
    arrive("lsjson-3.json", "[broken", 1)
    assert run() == []
    arrive("lsjson-1.prefix", " late/x\n", 3)
    assert run() == [("late/x/a", 4)]
    arrive("lsjson-4.json", '[{"Path": "c"}]', 4)
    arrive("lsjson-4.prefix", "same", 4)
    assert run() == [("late/x/a", 4), ("same/c", 0)]
    arrive("lsjson-5.json", "[]", 30)
    assert run() == [("b", 5), ("late/x/a", 4), ("same/c", 0)]
    assert [r.part for r in spark.read.json(f"{out}_rejected").collect()] == ["lsjson-3.json"]


def totals_row(spark):
    return spark.createDataFrame([("a", 10**12), ("b", 0)], "name string, bytes_total bigint")


def test_time_table(spark):
    rows = time_table(totals_row(spark), "64Gbps", "1Gbps").where("name = 'a'").orderBy("step").collect()
    assert [r.rate_text for r in rows] == ["1.00 Gbps", "2.00 Gbps", "4.00 Gbps", "8.00 Gbps", "16.00 Gbps", "32.00 Gbps", "64.00 Gbps"]
    assert rows[0].time_text == "2h 13m 20s" and rows[-1].seconds == pytest.approx(125)
    assert time_table(totals_row(spark), "1Gbps", "1Gbps").count() == 2
    assert time_table(totals_row(spark), "0Gbps", "1Gbps").count() == 0


def test_time_range(spark):
    rows = time_range(totals_row(spark), "1GB/s", "1MB/s", "MBps").where("name = 'a'").collect()
    assert {r.end: (r.rate_text, r.time_text) for r in rows} == {"slow": ("1.00 MB/s", "11d 13h 46m 40s"), "fast": ("1000.00 MB/s", "16m 40s")}
    with pytest.raises(ValueError):
        time_range(totals_row(spark), "0Gbps", "1Gbps")


def test_time_steps_of_a_table(spark):
    ranges = spark.createDataFrame([(1, 1.0, 64.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 64.0, 1.0)], "k int, min_rate double, max_rate double")
    rows = time_steps_for(ranges.withColumn("bytes_total", F.lit(640))).orderBy("k", "step").collect()
    assert [r.rate for r in rows if r.k in (1, 4)] == pytest.approx([1, 2, 4, 8, 16, 32, 64] * 2)
    assert [r.seconds for r in rows if r.k == 2] == [128.0] and not [r for r in rows if r.k == 3]


@pytest.mark.parametrize("mode, bins", [("pow2", 30), ("log", 30), (None, 0)])
def test_estimate(sizes_of, mode, bins):
    result = estimate(sizes_of([2000, 5 * 1024**2]), "1Gbps", "10Gbps", hist_mode=mode)
    assert result.totals.first().asDict() == {"objects": 2, "bytes_total": 5 * 1024**2 + 2000, "bytes_human": "5.00 MiB"}
    assert result.times.count() == 7 and result.ends.count() == 2
    assert (result.bins.count() if mode else 0) == bins
    with pytest.raises(ValueError):
        estimate(sizes_of([1]), "1Gbps", "10Gbps", hist_mode="linear")


def test_plan(spark):
    rows = [(i, f"p{i}", i * 10, False, None) for i in range(20)]
    listing = spark.createDataFrame(rows, "seq bigint, path string, size bigint, is_dir boolean, mtime string")
    sharded = plan(listing, "s", "d", num_shards=4)
    want = assign_shards(listing, 4)
    assert {(r.seq, r.shard_id) for r in sharded.collect()} == {(r.seq, r.shard_id) for r in want.collect()}


def test_live_attempts_from_the_raw_log(spark, tmp_path):
    """Several batches, repeated events, events behind a success, codes that are missing."""
    log = [[(0, 1, 11, 1), (0, 2, 12, 1), (1, 1, 21, 0), (2, 1, 31, None), (0, 2, 12, 1)], [(0, 3, 13, 0), (1, 2, 22, 5), (2, 2, 32, 7), (0, 1, 11, 1)], [(0, 4, 14, 9), (2, 2, 32, 7), (3, 1, 41, None)]]
    schema = "shard_id int, ts int, event_id bigint, rc int"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    for batch in log:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        live.keep_latest(live.live_attempts(stream()), str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination()
    found = {r.shard_id: (r.attempts, r.status, r.last_rc) for r in live.read_latest(spark, str(tmp_path / "out"), "shard_id").collect()}
    events = spark.createDataFrame(sorted({e for batch in log for e in batch}, key=str), schema)
    assert found == {r.shard_id: (r.attempts, r.status, r.last_rc) for r in attempt_summary(number_attempts(events)).collect()}
    assert found == {0: (3, "done", 0), 1: (1, "done", 0), 2: (2, "fail", 7), 3: (1, "pending", None)}


def test_live_progress_reports_every_threshold(spark, tmp_path):
    parts, out = tmp_path / "parts", str(tmp_path / "manifest")
    parts.mkdir()
    sizes = list(range(1, 58))
    cuts = [0, 3, 3, 30, 57]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (parts / f"lsjson-{k}.json").write_text(json.dumps([{"Path": f"p{i}", "Size": sizes[i]} for i in range(a, b)]))
        live.append_parts(live.stream_parts(spark, str(parts)), str(parts), out, str(tmp_path / "state"), "s", "d", "r", every=10).awaitTermination()
    rows = live.read_progress(spark, f"{out}_progress").orderBy("checkpoint").collect()
    assert [(r.files_listed, r.bytes_listed) for r in rows] == [(n, sum(sizes[:n])) for n in (10, 20, 30, 40, 50, 57)]


def test_live_batches_read_only_what_is_theirs(spark, tmp_path):
    """Progress goes on from the batch before, and sidecars are looked for by the names of a batch's parts."""
    parts, out = tmp_path / "parts", str(tmp_path / "manifest")
    parts.mkdir()
    for k, text in enumerate(['[{"Path": "a", "Size": 1}, {"Path": "b", "Size": 2}]', "[broken", '[{"Path": "c", "Size": 4}]', '[{"Path": "d", "Size": 8}]']):
        name = f"lsjson-{k} 50%"
        if k % 2 == 0:
            (parts / f"{name}.prefix").write_text(f"set{k}\n")
        (parts / f"{name}.json").write_text(text)
        if k == 3:  # a batch long past is not needed, the empty one before the last is passed over
            for file in Path(f"{out}_progress/batch=0").glob("*.parquet"):
                file.write_text("gone")
                (file.parent / f".{file.name}.crc").unlink()
        live.append_parts(live.stream_parts(spark, str(parts)), str(parts), out, str(tmp_path / "state"), "s", "d", "r", every=2).awaitTermination()
    rows = spark.read.parquet(f"{out}_progress/batch=2", f"{out}_progress/batch=3").orderBy("files_listed").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 7), (1, 4, 15)]
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["d", "set0/a", "set0/b", "set2/c"]
    found = listing.read_prefixes(spark, str(parts), ["lsjson-2%2050%25.json", "lsjson-3%2050%25.json"])
    assert [r.prefix for r in found.collect()] == ["set2"] and len(found.inputFiles()) == 1
    assert listing.read_prefixes(spark, str(parts), []).isEmpty()


def test_progress_of_a_batch_above_one_chunk(spark, tmp_path, monkeypatch):
    rows = [(k // 3, f"p{k:02}", k) for k in range(40)]
    records = spark.createDataFrame(rows, "seq bigint, path string, size bigint")
    live.write_progress(records, str(tmp_path / "small"), 0, 7, len(rows))
    monkeypatch.setattr(live, "CHUNK_SHIFT", 2)
    live.write_progress(records, str(tmp_path / "large"), 0, 7, len(rows))
    small, large = (sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / n / "batch=0")).collect()) for n in ("small", "large"))
    assert small == large == [(n // 7, min(n + 7, 40), sum(range(min(n + 7, 40)))) for n in range(0, 40, 7)]


def test_many_files_are_written_at_once(spark, tmp_path, monkeypatch):
    """Two files at least are on their way together, and names and texts are not drawn far ahead."""
    together, drawn, done = threading.Barrier(2), [], []
    write = inputs.write_file

    def slow(session, folder, name, text, changed_at=None):
        together.wait(20)
        assert len(drawn) - len(done) <= inputs.WAITING
        write(session, folder, name, text, changed_at)
        done.append(name)

    monkeypatch.setattr(inputs, "write_file", slow)
    monkeypatch.setattr(inputs, "WAITING", 4)
    files = ((drawn.append(k) or f"f{k}", f"text {k}") for k in range(10))
    inputs.write_files(spark, str(tmp_path / "files"), files, 10**12)
    written = {p.name: (p.read_text(), p.stat().st_mtime) for p in (tmp_path / "files").glob("f*")}
    assert written == {f"f{k}": (f"text {k}", 10**9) for k in range(10)}
