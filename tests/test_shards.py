import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from haulplan import assign_shards, shard_manifest, shard_summary
from haulplan.operators.ordering import largest, number_within, record_index, total_before
from haulplan.operators.progress import progress_checkpoints, progress_now
from haulplan.operators.shards import pour, shard_positions, work_list
from haulplan.sources.shard_files import write_shards

chance = random.Random(9)
LISTS = {
    "mixed": [int(chance.lognormvariate(10, 3)) for _ in range(1500)],
    "equal": [100] * 333,
    "zeros": [0] * 50 + [5, 9, 0, 3] + [0] * 50,
    "one giant": [10**12] + list(range(200)),
    "few": [3, 1, 2],
    "unknown": [-1, 4, -1, 0, 9, 4],
    "only empty": [0, 0, -1],
}


def manifest_of(spark, sizes, partitions=4, step=3):
    rows = [(i * step, f"src/p{i}", f"p{i}", size) for i, size in enumerate(sizes)]
    return spark.createDataFrame(rows, "seq bigint, source string, path string, size bigint").repartition(partitions)


def one_by_one(sizes, shards):
    """The rule, one record at a time: largest first to the lightest, sizes taken as the mean of their class."""
    order = sorted((i for i in range(len(sizes)) if (sizes[i] or 0) > 0), key=lambda i: -sizes[i])
    classes = defaultdict(list)
    for i in order:
        shift = max(0, sizes[i].bit_length() - 9)
        classes[sizes[i] >> shift << shift].append(sizes[i])
    loads, placed = [0] * shards, {}
    for i in order:
        shift = max(0, sizes[i].bit_length() - 9)
        own = classes[sizes[i] >> shift << shift]
        placed[i] = loads.index(min(loads))
        loads[placed[i]] += sum(own) // len(own)
    lightest = loads.index(min(loads))
    return {i: placed.get(i, lightest) for i in range(len(sizes))}


def placed_by(sharded, step=3):
    return {r.seq // step: r.shard_id for r in sharded.collect()}


@pytest.mark.parametrize("name", LISTS)
@pytest.mark.parametrize("shards", [4, 37])
def test_bytes_equals_the_rule(spark, name, shards):
    sharded = assign_shards(manifest_of(spark, LISTS[name]), shards)
    assert placed_by(sharded) == one_by_one(LISTS[name], shards)


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("strategy", ["bytes", "count", "hash"])
def test_independent_of_partitioning(spark, strategy, partitions):
    sizes = LISTS["mixed"]
    got = placed_by(assign_shards(manifest_of(spark, sizes, partitions), 6, strategy))
    assert got == placed_by(assign_shards(manifest_of(spark, sizes, 3), 6, strategy))
    assert set(got) == set(range(len(sizes)))


@pytest.mark.parametrize("shards", [2, 5, 16])
@pytest.mark.parametrize("name", ["mixed", "equal", "one giant"])
def test_loads_differ_by_the_largest_size_at_most(spark, name, shards):
    sizes = LISTS[name] * 8
    sharded = assign_shards(manifest_of(spark, sizes), shards)
    loads = [r.bytes for r in shard_summary(sharded, shards).collect()]
    assert sum(loads) == sum(sizes) and sharded.count() == len(sizes)
    assert max(loads) - min(loads) <= max(sizes)


def heaviest(sizes, shards):
    """Heaviest load against the lower bound, from the pouring of classes alone."""
    sizes = sorted(sizes, reverse=True)
    classes = defaultdict(list)
    for s in sizes:
        shift = max(0, s.bit_length() - 9)
        classes[s >> shift << shift].append(s)
    segments, _ = pour([(b, len(c), sum(c)) for b, c in classes.items()], shards)
    loads = [0] * shards
    for bucket, _, parts in segments:
        for rank, size in enumerate(classes[bucket]):
            start, cycle = [p for p in parts if p[0] <= rank][-1]
            loads[cycle[(rank - start) % len(cycle)]] += size
    return max(loads) / max(max(sizes), sum(sizes) / shards)


def test_heaviest_shard_is_near_the_lower_bound(spark):
    even = random.Random(5)
    assert heaviest([int(even.lognormvariate(14, 2.5)) + 1 for _ in range(50000)], 64) < 1.02
    assert heaviest([int(1000 * even.paretovariate(1.1)) for _ in range(50000)], 64) < 1.02
    assert heaviest([10**13] + [10**6] * 20000, 2) == 1.0
    rows = spark.createDataFrame([(i, 10**13 if i == 7 else 10**6) for i in range(20000)], "seq bigint, size bigint")
    assert {r.files for r in shard_summary(assign_shards(rows, 2), 2).collect()} == {1, 19999}


def test_equal_sizes_are_exactly_largest_first(spark):
    """Classes of one size each: the rule with the sizes themselves, ties to the first shard."""
    sizes = [7] * 40 + [300] * 9 + [2**30] * 3 + [1] * 100 + [90000] * 17
    loads, want = [0] * 6, {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        want[i] = loads.index(min(loads))
        loads[want[i]] += sizes[i]
    assert placed_by(assign_shards(manifest_of(spark, sizes), 6)) == want


def test_repeated_seq_and_nulls_keep_every_row(spark):
    rows = [(1, "s/a", "a", 5), (1, "s/b", "b", 5), (1, "s/b", "b", 5), (2, "s/c", "c", None), (None, "s/d", "d", 7), (None, None, None, 7)]
    manifest = spark.createDataFrame(rows, "seq bigint, source string, path string, size bigint")
    sharded = assign_shards(manifest, 2)
    assert sharded.count() == 6 and sharded.where("shard_id IS NULL").count() == 0
    assert shard_positions(sharded).count() == 6


def test_spread_empty(spark):
    sizes = [0] * 90 + [5] * 3
    kept = shard_summary(assign_shards(manifest_of(spark, sizes), 3), 3).collect()
    spread = shard_summary(assign_shards(manifest_of(spark, sizes, step=1), 3, spread_empty=True), 3).collect()
    assert sorted(r.files for r in kept) == [1, 1, 91] and [r.files for r in spread] == [31, 31, 31]


def test_count(spark):
    assert placed_by(assign_shards(manifest_of(spark, [1] * 20), 7, "count")) == {i: i % 7 for i in range(20)}


def test_hash(spark):
    rows = [(0, "s/é", "p"), (1, "", "p"), (2, None, "q\"x"), (3, "", ""), (4, None, None), (5, "s/z", None)]
    keys = ["s/é", "p", 'q"x', "3", "4", "s/z"]
    manifest = spark.createDataFrame([(10 * s, a, b, 1) for s, a, b in rows], "seq bigint, source string, path string, size bigint")
    for shards in (1, 97, 2**17):
        got = placed_by(assign_shards(manifest, shards, "hash"), 10)
        assert got == {i: int(hashlib.sha1(k.encode()).hexdigest(), 16) % shards for i, k in enumerate(keys)}


def test_refused_settings(spark):
    manifest = manifest_of(spark, [1])
    for shards, strategy in [(0, "bytes"), (3, "size")]:
        with pytest.raises(ValueError):
            assign_shards(manifest, shards, strategy)
    with pytest.raises(ValueError, match="no records"):
        assign_shards(manifest.where("false"), 3)


def test_summary_has_every_shard(spark):
    summary = shard_summary(assign_shards(manifest_of(spark, LISTS["few"]), 8), 8).orderBy("shard_id").collect()
    assert [r.shard_id for r in summary] == list(range(8))
    assert [r.bytes for r in summary] == [3, 2, 1, 0, 0, 0, 0, 0] and sum(r.files for r in summary) == 3


@pytest.mark.parametrize("strategy", ["bytes", "hash"])
def test_positions(spark, strategy):
    sizes = LISTS["zeros"] + LISTS["few"] * 5
    sharded = assign_shards(manifest_of(spark, sizes), 4, "hash")
    order = (lambda r: (-r.size, r.seq)) if strategy == "bytes" else (lambda r: r.seq)
    rows = sorted(shard_positions(sharded, strategy).collect(), key=order)
    seen = defaultdict(int)
    for row in rows:
        assert row.shard_pos == seen[row.shard_id]
        seen[row.shard_id] += 1


@pytest.mark.parametrize("one_file", [False, True])
def test_shard_files_hold_the_order(spark, tmp_path, one_file):
    sizes = [0] * 400 + LISTS["mixed"][:300]
    sharded = assign_shards(manifest_of(spark, sizes), 5)
    write_shards(sharded, str(tmp_path / "out"), 5, partitions=6, one_file_per_shard=one_file)
    for shard in range(5):
        files = sorted((tmp_path / "out" / f"shard_id={shard}").glob("*.json"))
        records = [json.loads(line) for file in files for line in file.read_text().splitlines()]
        want = sharded.where(F.col("shard_id") == shard).orderBy(F.col("size").desc(), "seq").collect()
        assert [r["seq"] for r in records] == [r.seq for r in want]
        assert not one_file or len(files) == 1
    hot = max(range(5), key=lambda k: sharded.where(F.col("shard_id") == k).count())
    assert one_file or len(list((tmp_path / "out" / f"shard_id={hot}").glob("*.json"))) > 1


def test_shard_job(spark, tmp_path):
    sharded = shard_manifest(manifest_of(spark, LISTS["few"]), str(tmp_path), 4, source="m.jsonl")
    meta = spark.read.json(f"{tmp_path}/metadata/meta").first()
    assert (meta.num_records, meta.bytes_total, meta.num_shards, meta.strategy, meta.input) == (3, 6, 4, "bytes", "m.jsonl")
    assert spark.read.json(f"{tmp_path}/metadata/summary").count() == 4
    assert [r.path for r in work_list(sharded, 0).collect()] == ["p0"]


@pytest.mark.parametrize("seqs", [sorted(chance.sample(range(10**6), 500)), list(range(90, 400)), [0, 0, 2], [0, 5, None], [-3, -2, -1, 0], [2**40, 2**40 + 1], [None], []])
def test_record_index(spark, seqs):
    rows = spark.createDataFrame([(s, f"p{k}") for k, s in enumerate(seqs)], "seq bigint, path string").repartition(7)
    got = sorted((r["index"], r.path, r.seq) for r in record_index(rows).collect())
    assert got == [(k, f"p{k}", s) for k, s in enumerate(seqs)]


def test_total_before(spark):
    rows = spark.createDataFrame([(k, k * 2) for k in range(50)], "k bigint, v bigint")
    got = {r.k: r.v_before for r in total_before(rows, "k", ["v"], shift=2).collect()}
    assert got == {k: sum(2 * j for j in range(k)) for k in range(50)}


def test_number_within(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, x bigint").repartition(5)
    got = number_within(rows, ["g"], [F.col("x")], "place").collect()
    assert all(r.place == r.x // 3 for r in got)


def test_largest(spark):
    assert [r.seq for r in largest(manifest_of(spark, [5, 9, 9, 1]), 3).collect()] == [3, 6, 0]


def test_progress(spark):
    manifest = manifest_of(spark, list(range(25)))
    rows = progress_checkpoints(manifest, every=10).orderBy("checkpoint").collect()
    assert [(r.files_listed, r.bytes_listed) for r in rows] == [(10, 45), (20, 190), (25, 300)]
    assert progress_now(manifest.where("false")).first().asDict() == {"files_listed": 0, "bytes_listed": 0}
