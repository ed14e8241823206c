import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haulplan import build_manifest, combine_parts, read_json_arrays, read_listing, read_manifest, read_ndjson, read_sizes, rebase_file, write_manifest
from haulplan.operators.normalize import (
    duplicate_paths,
    first_roots,
    from_table,
    is_directory,
    is_directory_any_case,
    join_root,
    listed_size,
    new_run_id,
    put_prefix,
    rebase,
    resolve_roots,
    totals_input,
)
from haulplan.operators.stats import totals
from haulplan.schema import MANIFEST, MANIFEST_COLUMNS, MANIFEST_SCHEMA

SRC, DST = "s:b/data/", "d:b/copy//"

OBJECTS = [
    {"Path": "a", "Size": 5, "IsDir": False, "ModTime": "2024-01-01T00:00:00Z", "Hashes": {"md5": "x", "n": 3}, "ETag": "E"},
    7,
    "x",
    None,
    [1],
    {"Path": 5, "Size": 1},
    {"Path": "", "Size": 1},
    {"Size": 1},
    {"Path": "dir", "IsDir": True, "Size": -1},
    {"Path": "b", "IsDir": "true", "Size": None, "size": 9},
    {"Path": "c", "Size": "12", "ETag": "", "etag": "low", "StorageClass": "COLD", "Metadata": {"k": {"z": 1}}},
    {"Path": "d/é \"q\"\\", "Size": 3.7, "isdir": True, "Hashes": "none"},
    {"Path": "e", "Size": -1},
    {"Path": "f", "size": 4},
    {"Path": "g", "Size": ""},
    {"Path": "h", "Size": True, "ETag": 0},
    {"Path": "i", "Size": []},
]
SIZES = {"a": 5, "b": 0, "c": 12, 'd/é "q"\\': 3, "e": -1, "f": 0, "g": 0, "h": 1, "i": 0}
LISTED = [5, 1, 1, 1, 12, -1, 4, 1]  # sizes that count for totals: no directories, no missing sizes


def text_file(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def array(tmp_path):
    return text_file(tmp_path / "list %20+é.json", "\n " + json.dumps(OBJECTS, ensure_ascii=False) + "\n")


@pytest.fixture
def ndjson(tmp_path):
    lines = [json.dumps(o) for o in OBJECTS]
    return text_file(tmp_path / "list a+b.jsonl", "\n\n" + "\n  \n".join(lines) + "\n")


@pytest.mark.parametrize("form", ["array", "ndjson"])
def test_manifest_of_hostile_objects(spark, request, form):
    path = request.getfixturevalue(form)
    objects = (read_json_arrays if form == "array" else read_ndjson)(spark, path)
    manifest = build_manifest(objects, SRC, DST, "r1")
    rows = manifest.orderBy("seq").collect()
    assert manifest.columns == MANIFEST_COLUMNS
    assert [(r.path, r.size) for r in rows] == list(SIZES.items())
    assert len({r.seq for r in rows}) == len(rows)
    by_path = {r.path: r for r in rows}
    assert by_path["a"].hashes == {"md5": "x", "n": "3"} and by_path["a"].etag == "E" and by_path["a"].mtime == "2024-01-01T00:00:00Z"
    assert by_path["c"].etag == "low" and by_path["c"].storage_class == "COLD" and by_path["c"].meta == {"k": '{"z":1}'}
    assert by_path['d/é "q"\\'].hashes == {} and by_path["e"].meta == {} and by_path["b"].etag is None
    assert by_path["a"].source == "s:b/data/a" and by_path["a"].dest == "d:b/copy/a"
    assert by_path["a"].source_root == SRC and by_path["a"].schema == MANIFEST_SCHEMA and by_path["a"].run_id == "r1"


@pytest.mark.parametrize("form", ["array", "ndjson"])
def test_totals_rules(spark, request, form):
    objects = read_listing(spark, request.getfixturevalue(form), ordered=False)
    assert sorted(r.size for r in totals_input(objects).collect()) == sorted(LISTED)
    assert totals(totals_input(objects)).first().asDict() == {"objects": len(LISTED), "bytes_total": sum(LISTED)}


def test_named_form(spark, array, ndjson):
    assert read_listing(spark, array, form="array").count() == read_listing(spark, ndjson, form="ndjson", ordered=False).count()
    with pytest.raises(ValueError):
        read_listing(spark, array, form="csv")


def test_directory_flags(spark, ndjson):
    rows = read_ndjson(spark, ndjson).select(
        F.try_variant_get("object", "$.Path", "string").alias("p"), is_directory(F.col("object")).alias("strict"),
        is_directory_any_case(F.col("object")).alias("any"), listed_size(F.col("object")).alias("size")
    )
    flags = {r.p: (r.strict, r.any) for r in rows.collect()}
    assert flags["dir"] == (True, True) and flags["b"] == (False, False) and flags['d/é "q"\\'] == (False, True)


def test_both_forms_in_one_listing(spark, array, ndjson):
    objects = read_listing(spark, [array, ndjson])
    manifest = build_manifest(objects, SRC, DST)
    assert [r.path for r in manifest.orderBy("seq").collect()] == 2 * list(SIZES)


def test_line_order_with_many_splits(spark, tmp_path):
    for part in range(3):
        lines = [json.dumps({"Path": f"{part}-{i}", "Size": i}) for i in range(400)]
        text_file(tmp_path / f"p{part}.jsonl", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        objects = read_ndjson(spark, str(tmp_path))
        rows = objects.select("seq", F.try_variant_get("object", "$.Path", "string").alias("p")).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.p for r in rows] == [f"{part}-{i}" for part in range(3) for i in range(400)]
    assert [r.seq for r in rows] == list(range(1200))


@pytest.mark.parametrize("text", ["{}", "5", "[1", "[1] 2", "[1] [2]", '[{"Path":"a"}], [', ""])
def test_bad_arrays_fail(spark, tmp_path, text):
    path = text_file(tmp_path / "bad.json", text)
    with pytest.raises(PySparkException, match="not a JSON array"):
        read_json_arrays(spark, path).collect()


@pytest.mark.parametrize("line", ["{", '{"Path":"a"} {"Path":"b"}', "x", '{"Path":"a"},', '{"Path":"a"}]'])
def test_bad_lines_fail(spark, tmp_path, line):
    path = text_file(tmp_path / "bad.jsonl", '{"Path":"ok"}\n' + line + "\n")
    with pytest.raises(PySparkException, match="not JSON"):
        read_ndjson(spark, path, ordered=False).collect()


def test_unreadable_size_fails_the_manifest(spark, tmp_path):
    path = text_file(tmp_path / "bad.jsonl", '{"Path":"a","Size":"3.7"}\n')
    with pytest.raises(PySparkException, match="not a size: 3.7"):
        build_manifest(read_ndjson(spark, path, ordered=False).withColumn("seq", F.lit(0).cast("bigint")), SRC, DST).collect()
    assert totals(totals_input(read_ndjson(spark, path, ordered=False))).first().objects == 0


def line_array(objects):
    return "[\n" + ",\n".join(map(json.dumps, objects)) + "\n]\n"


STRANGE = [{"Path": "a}{[", "Meta": {"x": [{"y": 1}, {}]}}, {"Path": 'q"}],[{\\"', "Hashes": {}}, 7, None, "]}", [{"Path": "inner"}], {}, {"Path": "\\\\"}, {"Path": "é日"}]
FORMS = {
    "one line": json.dumps(STRANGE * 40, ensure_ascii=False),
    "spread": json.dumps(STRANGE * 40, indent=3),
    "lines": line_array(STRANGE * 40),
    "no objects": "[1, [2], \"}\"]",
    "empty": " [ ]\n",
    "long string": json.dumps(["x}" * 3000, {"Path": "end"}, "{" * 3000]),
    "one object": json.dumps([{"Path": "p", "Metadata": {str(i): {"v": i} for i in range(500)}}]),
    "compact": json.dumps([{"Path": str(i)} for i in range(3000)], separators=(",", ":")),
    "numbers first": json.dumps([*range(900), {"Path": "z"}, *range(900)]),
}


@pytest.fixture
def many_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", FORMS)
def test_arrays_of_any_form_in_splits(spark, tmp_path, many_splits, name):
    path = text_file(tmp_path / "a.json", FORMS[name])
    objects = [o for o in json.loads(FORMS[name]) if isinstance(o, dict)]
    for limit in (5, 10**8):
        rows = read_json_arrays(spark, path, limit).select("seq", F.to_json("object").alias("o")).orderBy("seq").collect()
        assert [json.loads(r.o) for r in rows] == objects and len({r.seq for r in rows}) == len(rows)


def test_large_and_small_arrays_in_path_order(spark, tmp_path, many_splits):
    objects = [{"Path": f"d/{i}", "Size": i} for i in range(300)]
    text_file(tmp_path / "a.json", json.dumps([{"Path": "first", "Size": 1}]))
    text_file(tmp_path / "b.json", line_array(objects))
    text_file(tmp_path / "c.json", json.dumps([{"Path": "last", "Size": 1}]))
    for limit in (100, 10**8):
        rows = build_manifest(read_json_arrays(spark, str(tmp_path), limit), SRC, DST, "r").orderBy("seq").collect()
        assert [r.path for r in rows] == ["first", *[o["Path"] for o in objects], "last"]


BAD = ["[\n{},\n{}\n", "{}\n]\n", "[\n{}\n]\n]\n", "[\n{},\nx\n]\n", "[\n[\n{}\n]\n", "[{} {}]", "[{},{},]", "[,{}]", "[{},,{}]", "[{}] {}", "[{}]}",
       "{} [{}]", "[{}, 7", "[{}, {", "[{}, {}", "[{}}]", '[{}, "x]', "[{}][{}]", "[[{}], {}", '{"a": [{}]}', "[{}\\, {}]", "xxx", "[{},{}]x"]


def test_refusals_do_not_depend_on_size(spark, tmp_path, many_splits):
    """The same parts are left out whether parts are read whole or in splits."""
    for k, text in enumerate([*BAD, *FORMS.values()]):
        text_file(tmp_path / f"lsjson-{k:03}.json", text)
    want = {f"lsjson-{k:03}.json" for k in range(len(BAD))}
    found = []
    for limit in (0, 10**8):
        combined = combine_parts(spark, str(tmp_path), SRC, DST, "r", max_bytes=limit)
        assert {r.part for r in combined.rejected_parts.collect()} == want
        found.append([r.path for r in combined.manifest.orderBy("seq").collect()])
    assert found[0] == found[1]
    with pytest.raises(PySparkException, match="not a JSON array"):
        read_json_arrays(spark, str(tmp_path / "lsjson-000.json"), max_bytes=2).collect()


def test_combine_large_parts(spark, tmp_path):
    text_file(tmp_path / "lsjson-1.json", json.dumps([{"Path": "s", "Size": 1}]))
    text_file(tmp_path / "lsjson-2.json", line_array([{"Path": f"l{i}", "Size": i} for i in range(40)]))
    text_file(tmp_path / "lsjson-2.prefix", "p\n")
    text_file(tmp_path / "lsjson-3.json", line_array([{"Path": f"cut{i}"} for i in range(40)])[:-3])
    text_file(tmp_path / "lsjson-4.json", "[" + "x" * 200)
    combined = combine_parts(spark, str(tmp_path), SRC, DST, "r", max_bytes=100)
    rows = combined.manifest.orderBy("seq").collect()
    assert [(r.path, r.size) for r in rows] == [("s", 1), *[(f"p/l{i}", i) for i in range(40)]]
    assert sorted(r.part for r in combined.rejected_parts.collect()) == ["lsjson-3.json", "lsjson-4.json"]


def test_combine(spark, tmp_path):
    text_file(tmp_path / "lsjson-0002.json", json.dumps([{"Path": "x", "Size": 2}, {"Path": "sub", "IsDir": True}]))
    text_file(tmp_path / "lsjson-0001.json", json.dumps([3, {"Path": "y", "Size": 1}, {"Path": "x", "Size": 1}]))
    text_file(tmp_path / "lsjson-0001.prefix", " a/b\n")
    text_file(tmp_path / "lsjson-0003.json", '[{"Path":"lost"}')
    text_file(tmp_path / "lsjson-0004.json", "{}")
    text_file(tmp_path / "lsjson-0005.json", json.dumps([{"Path": "x", "Size": 7}]))
    text_file(tmp_path / "lsjson-0005.prefix", "  \n")
    text_file(tmp_path / "lsjson-0006.json", json.dumps([{"Path": "z"}]))
    text_file(tmp_path / "lsjson-0006.prefix", "c/")
    text_file(tmp_path / "lsjson-0007.json", "")
    text_file(tmp_path / "lsjson-0008 a.json", json.dumps([{"Path": "w"}]))
    text_file(tmp_path / "lsjson-0008 a.prefix", "p")
    text_file(tmp_path / "other.json", json.dumps([{"Path": "ignored"}]))
    combined = combine_parts(spark, str(tmp_path), SRC, DST, "r")
    rows = combined.manifest.orderBy("seq").collect()
    assert [(r.path, r.size) for r in rows] == [("a/b/y", 1), ("a/b/x", 1), ("x", 2), ("x", 7), ("c//z", 0), ("p/w", 0)]
    rejected = {r.part: r.reason for r in combined.rejected_parts.collect()}
    assert rejected == {"lsjson-0003.json": "not JSON", "lsjson-0004.json": "not a JSON array", "lsjson-0007.json": "not JSON"}
    assert [(r.path, r.copies) for r in duplicate_paths(combined.manifest).collect()] == [("x", 2)]


def test_combine_without_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        combine_parts(spark, str(tmp_path), SRC, DST)


def listing_table(spark):
    rows = [(3, "b", None, False, None), (1, "a", 5, None, "t"), (2, "dir", 0, True, None), (4, "", 1, False, None), (5, None, 1, False, None)]
    return spark.createDataFrame(rows, "seq bigint, path string, size bigint, is_dir boolean, mtime string")


def test_manifest_of_a_table(spark):
    rows = from_table(listing_table(spark), SRC, DST, "r").orderBy("seq").collect()
    assert [(r.seq, r.path, r.size, r.mtime, r.dest) for r in rows] == [(1, "a", 5, "t", "d:b/copy/a"), (3, "b", 0, None, "d:b/copy/b")]


def test_run_ids():
    assert new_run_id() != new_run_id() and len(new_run_id()) == len("20240101T000000Z_abcdef")


@pytest.mark.parametrize("root", ["r:b", "r:b/", "r:b///"])
def test_join_root(spark, root):
    assert spark.range(1).select(join_root(F.lit(root), F.lit("x/y"))).first()[0] == "r:b/x/y"


def test_prefix(spark):
    rows = spark.createDataFrame([("a/", "x"), ("", "x"), (None, "x"), ("a", "x")], "prefix string, path string")
    assert [r[0] for r in rows.select(put_prefix(F.col("prefix"), F.col("path"))).collect()] == ["a//x", "x", "x", "a/x"]


def test_json_round_trip(spark, tmp_path, array):
    manifest = build_manifest(read_json_arrays(spark, array), SRC, DST, "r")
    path = str(tmp_path / "manifest")
    write_manifest(manifest, path, "json")
    back = read_manifest(spark, path)
    assert back.schema.simpleString() == MANIFEST.simpleString()
    assert back.orderBy("seq").collect() == manifest.orderBy("seq").collect()
    with pytest.raises(PySparkException, match="unknown manifest schema"):
        read_manifest(spark, path, accepted=["other.v2"]).collect()


MANIFEST_LINES = [
    {"schema": "other.v1", "path": "a", "size": 4, "source_root": "s//", "dest_root": "d", "source": "s/a", "dest": "d/a", "extra": {"deep": [1, 2]}},
    {"schema": "other.v1", "path": "é\"b", "size": "7", "source_root": None, "note": None},
    {"schema": "other.v1"},
]


def test_foreign_manifest(spark, tmp_path):
    path = text_file(tmp_path / "m.jsonl", "\n".join(json.dumps(x) for x in MANIFEST_LINES))
    rows = read_manifest(spark, path, accepted=["other.v1"]).orderBy("seq").collect()
    assert [(r.seq, r.path, r.size, r.hashes) for r in rows] == [(0, "a", 4, {}), (1, 'é"b', 7, {}), (2, None, 0, {})]


def test_rebase_file_keeps_unknown_fields(spark, tmp_path):
    path = text_file(tmp_path / "m.jsonl", "\n".join(json.dumps(x) for x in MANIFEST_LINES))
    out = str(tmp_path / "out")
    rebase_file(spark, path, out, dest_root="new:x/")
    records = [json.loads(r.value) for r in spark.read.text(out).collect()]
    records.sort(key=lambda r: r["seq"])
    assert records[0]["extra"] == {"deep": [1, 2]} and records[0]["source"] == "s/a" and records[0]["source_root"] == "s//"
    assert records[0]["dest"] == "new:x/a" and records[0]["dest_root"] == "new:x/" and records[0]["size"] == 4
    assert records[1]["source"] == '/é"b' and records[1]["dest"] == 'new:x/é"b' and "note" in records[1]
    assert records[2]["dest"] == "new:x/" and [r["seq"] for r in records] == [0, 1, 2]


def test_rebase_table(spark):
    manifest = from_table(listing_table(spark), SRC, DST, "r").withColumn("extra", F.lit(1))
    row = rebase(manifest, source_root="n:z").orderBy("seq").first()
    assert (row.source, row.dest, row.source_root, row.dest_root, row.path, row.extra) == ("n:z/a", "d:b/copy/a", "n:z", DST, "a", 1)


def test_lenient_sizes(spark, tmp_path):
    lines = ['{"size":5}', "broken", "", '{"size":"abc"}', '{"path":"x"}', '{"size":null}', '{"size":""}', '{"size":"12"}',
             '{"size":"3.7"}', '{"size":3.7}', "[1]", "5", '{"size":true}', '{"size":1} x', '{"size":[1]}']
    path = text_file(tmp_path / "m.jsonl", "\n".join(lines))
    assert sorted(r.size for r in read_sizes(spark, path).collect()) == [0, 0, 0, 1, 3, 5, 12]


def test_roots(spark):
    manifest = from_table(listing_table(spark), SRC, DST, "r")
    assert resolve_roots(manifest) == (SRC, DST)
    assert resolve_roots(manifest, dest_root="z") == (SRC, "z")
    mixed = manifest.unionByName(rebase(manifest, "other").withColumn("seq", F.col("seq") - 100))
    assert first_roots(mixed).first().asDict() == {"source_root": "other", "dest_root": DST, "distinct_roots": 2}
    with pytest.raises(ValueError):
        resolve_roots(manifest.withColumn("source_root", F.lit("")))
