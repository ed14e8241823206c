import json

import pytest

from haulplan.__main__ import main


def records(folder):
    return [json.loads(line) for file in sorted(folder.rglob("*.json")) for line in file.read_text().splitlines()]


@pytest.fixture
def listing(tmp_path):
    objects = [{"Path": f"d/f{i}", "Size": i * 1000, "IsDir": False} for i in range(50)]
    (tmp_path / "list.json").write_text(json.dumps(objects))
    return tmp_path


def test_build_rebase_shard_analyze(spark, listing, capsys):
    at = lambda name: str(listing / name)
    main(["build", "--in", at("list.json"), "--source", "s:b", "--dest", "d:b", "--out", at("m"), "--run-id", "r", "--progress", at("p")])
    assert records(listing / "p") == [{"checkpoint": 0, "files_listed": 50, "bytes_listed": sum(range(50)) * 1000}]
    assert [r["path"] for r in records(listing / "m")] == [f"d/f{i}" for i in range(50)]
    main(["rebase", "--in", at("m"), "--out", at("m2"), "--dest-root", "e:c"])
    moved = [json.loads(line) for file in sorted((listing / "m2").glob("*.txt")) for line in file.read_text().splitlines()]
    assert moved[1]["dest"] == "e:c/d/f1" and moved[1]["source"] == "s:b/d/f1" and moved[1]["schema"]
    main(["shard", "--in", at("m"), "--outdir", at("run"), "--num-shards", "4"])
    assert len(records(listing / "run" / "shards")) == 50
    main(["analyze", "--in", at("m"), "--out", at("report")])
    report = json.loads(next((listing / "report").glob("*.txt")).read_text())
    assert report["total_files"] == 50 and report["profile"] == "small_files"
    main(["analyze", "--in", at("m")])
    assert json.loads(capsys.readouterr().out) == report


def test_parquet_manifests(spark, listing):
    at = lambda name: str(listing / name)
    main(["build", "--in", at("list.json"), "--source", "s:b", "--dest", "d:b", "--out", at("m"), "--format", "parquet"])
    main(["rebase", "--in", at("m"), "--out", at("m2"), "--source-root", "x:y", "--format", "parquet"])
    assert {r.source_root for r in spark.read.parquet(at("m2")).collect()} == {"x:y"}
    main(["analyze", "--in", at("m2"), "--format", "parquet", "--group-by", "source_root", "--out", at("report")])
    assert json.loads(records(listing / "report")[0]["report"])["total_files"] == 50


def test_combine_and_estimate(spark, tmp_path, capsys):
    (tmp_path / "lsjson-1.json").write_text(json.dumps([{"Path": "a", "Size": 2**20}]))
    (tmp_path / "lsjson-2.json").write_text("broken")
    main(["combine", "--parts-dir", str(tmp_path), "--source", "s", "--dest", "d", "--out", str(tmp_path / "m")])
    assert capsys.readouterr().out == "skipped lsjson-2.json: not JSON\n"
    assert [r["source"] for r in records(tmp_path / "m")] == ["s/a"]
    main(["estimate", "--in", str(tmp_path / "lsjson-1.json"), "--min-rate", "8Mbps", "--max-rate", "8Gbps"])
    assert "1.00 MiB" in capsys.readouterr().out


def test_plan_and_status(spark, listing, capsys):
    at = lambda name: str(listing / name)
    main(["plan", "--in", at("list.json"), "--source", "s:b", "--dest", "d:b", "--outdir", at("run"), "--num-shards", "60", "--one-file-per-shard"])
    folders = {int(f.name.split("=")[1]): list(f.glob("*.json")) for f in (listing / "run" / "shards").glob("shard_id=*")}
    assert set(folders) == set(range(60)) and all(len(files) == 1 for files in folders.values())
    filled = {k for k, (file,) in folders.items() if file.stat().st_size}
    assert len(records(listing / "run" / "shards")) == 50 and 0 < len(filled) < 60
    done, failed = sorted(filled)[:2]
    log = [{"shard_id": done, "attempt": 1, "rc": 0}, *[{"shard_id": failed, "attempt": k, "rc": 3} for k in (1, 2)]]
    (listing / "attempts.json").write_text("\n".join(map(json.dumps, log)))
    main(["status", "--outdir", at("run"), "--attempts", at("attempts.json"), "--pending", at("todo"), "--max-attempts", "2"])
    assert capsys.readouterr().out.splitlines() == [f"done none {60 - len(filled) + 1}", "fail exhausted 1", f"pending start {len(filled) - 2}"]
    copied = {json.loads(line)["path"] for line in folders[done][0].read_text().splitlines()}
    assert {r["path"] for r in records(listing / "todo")} == {f"d/f{i}" for i in range(50)} - copied
