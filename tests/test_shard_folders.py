"""Shard folders: segment lists and scans pruned to unfinished shards."""

import pytest

from haulplan.sources.shard_files import read_pending, read_shard, read_shard_index, read_shards, write_shards


@pytest.fixture
def sharded(spark):
    """Shard 0 holds most records, shard 3 none; some sizes tie."""
    return spark.range(5000).selectExpr(
        "id AS seq", "concat('p/', id) AS path", "(id * 7919) % 301 AS size", "cast(CASE WHEN id % 10 < 7 THEN 0 ELSE id % 3 END AS int) AS shard_id"
    )


@pytest.mark.parametrize("strategy", ["bytes", "count"])
def test_shard_in_order_without_shuffle(spark, sharded, tmp_path, strategy):
    out = str(tmp_path / "shards")
    write_shards(sharded, out, 4, strategy, "parquet", partitions=9)
    index = read_shard_index(spark, out).collect()
    assert sum(r.rows for r in index) == 5000 and len([r for r in index if r.shard_id == 0]) > 3
    rows = [r for r in sharded.collect()]
    for shard in range(4):
        found = read_shard(spark, out, sharded.schema, shard)
        mine = [r for r in rows if r.shard_id == shard]
        mine.sort(key=(lambda r: (-r.size, r.seq)) if strategy == "bytes" else (lambda r: r.seq))
        assert [(r.shard_pos, r.seq) for r in sorted(found.collect(), key=lambda r: r.shard_pos)] == [(i, r.seq) for i, r in enumerate(mine)]
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert read_shards(spark, out, sharded.schema, "parquet").count() == 5000


def test_empty_table_has_an_empty_index(spark, sharded, tmp_path):
    out = str(tmp_path / "shards")
    write_shards(sharded.where("seq < 0"), out, 2, "count", "parquet")
    assert read_shard_index(spark, out).count() == 0
    assert read_shard(spark, out, sharded.schema, 0).count() == 0


def test_finished_folders_are_not_read(spark, sharded, tmp_path):
    out = str(tmp_path / "shards")
    write_shards(sharded, out, 4, "count")
    states = [(0, "done"), (1, "fail"), (2, "pending"), (3, "done")]
    status = spark.createDataFrame(states, "shard_id bigint, status string")
    left = read_pending(spark, out, sharded.schema, status)
    assert "dynamicpruning" in left._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.shard_id for r in left.collect()} == {1, 2}
    assert left.count() == sharded.where("shard_id IN (1, 2)").count()
