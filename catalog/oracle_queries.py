"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

from catalog.inputs import DEST, DOCS_PER_PART, LISTINGS, ORDER_OBJECT, RUN_ID, SOURCE
from haulplan.operators.advise import BASE_FLAGS, PROFILE_FLAGS
from haulplan.schema import MANIFEST_SCHEMA, SHARDS_SCHEMA

SRC, DST = SOURCE.rstrip("/"), DEST.rstrip("/")

ORACLES: dict[str, str] = {}


def listed(name: str) -> str:
    return f"listing AS (SELECT {LISTINGS[name]} FROM {name})"


def sized(name: str) -> str:
    return f"{listed(name)}, sized AS (SELECT seq, dataset, coalesce(size, 0) AS size FROM listing WHERE NOT is_dir)"


def manifest(name: str) -> str:
    return f"""{listed(name)}, manifest AS (
 SELECT '{MANIFEST_SCHEMA}' AS schema, '{RUN_ID}' AS run_id, '{SOURCE}' AS source_root, '{DEST}' AS dest_root,
  '{SRC}/' || path AS source, '{DST}/' || path AS dest, path, coalesce(size, 0) AS size, mtime,
  CAST(NULL AS VARCHAR) AS etag, CAST(NULL AS VARCHAR) AS storage_class, seq FROM listing WHERE NOT is_dir)"""


def human_bytes(x: str) -> str:
    steps = " ".join(
        f"WHEN {x} < {1024 ** (p + 1)} THEN printf('%.2f {unit}', CAST({x} AS DOUBLE) / {1024**p})"
        for p, unit in enumerate(["B", "KiB", "MiB", "GiB", "TiB"])
        if p
    )
    return f"CASE WHEN {x} < 1024 THEN {x} || ' B' {steps} ELSE printf('%.2f PiB', CAST({x} AS DOUBLE) / {1024**5}) END"


def human_seconds(x: str) -> str:
    s = f"CAST(round_even({x}, 0) AS BIGINT)"
    d, h, m, r = f"({s} // 86400)", f"({s} % 86400 // 3600)", f"({s} % 3600 // 60)", f"({s} % 60)"
    return f"""CASE WHEN {x} < 0 THEN 'n/a' ELSE
 CASE WHEN {d} > 0 THEN {d} || 'd ' ELSE '' END ||
 CASE WHEN {h} > 0 OR ({d} > 0 AND ({m} > 0 OR {r} > 0)) THEN {h} || 'h ' ELSE '' END ||
 CASE WHEN {m} > 0 OR (({d} > 0 OR {h} > 0) AND {r} > 0) THEN {m} || 'm ' ELSE '' END || {r} || 's' END"""


def one_decimal(x: str) -> str:
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


# --- Sources ---------------------------------------------------------------

DOC_PARTS = f"""docs AS (SELECT doc_id, doc_id // {DOCS_PER_PART} AS part,
 lang || '/doc_' || doc_id || '.txt' AS path, n_chars AS size FROM documents)"""

ORACLES["s1_json_arrays"] = f"""WITH {DOC_PARTS}
 SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, path, size, '{SRC}/' || path AS source FROM docs"""

ORDER_FIELDS = f"""raw AS (SELECT o_orderkey AS seq, o_orderkey AS k, {ORDER_OBJECT} AS value,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority, o_orderstatus, o_orderdate FROM orders),
 objects AS (SELECT *, k % 97 = 0 AS dir, k % 97 = 0 OR (k % 89 <> 0 AND k % 83 = 0) AS dir_any,
  CASE WHEN k % 29 <> 0 AND k % 31 <> 0 THEN 'orders/' || substr(o_orderpriority, 1, 1) || '/' || k || '.dat' END AS path,
  CASE WHEN k % 53 = 0 OR k % 59 = 0 OR k % 61 = 0 OR k % 7 = 3 THEN 0 ELSE cents END AS manifest_size,
  CASE WHEN k % 53 = 0 OR k % 59 = 0 OR k % 61 = 0 THEN NULL ELSE cents END AS any_size
  FROM raw WHERE k % 101 <> 0)"""

OBJECT_MANIFEST = f"""{ORDER_FIELDS}, kept AS (SELECT k, '{MANIFEST_SCHEMA}' AS schema, '{RUN_ID}' AS run_id,
  '{SOURCE}' AS source_root, '{DEST}' AS dest_root, '{SRC}/' || path AS source, '{DST}/' || path AS dest, path,
  manifest_size AS size, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS mtime,
  CASE WHEN k % 5 = 0 THEN 'low-' || k WHEN k % 5 = 1 THEN 'up-' || k END AS etag, o_orderstatus AS storage_class,
  CASE WHEN k % 3 = 0 THEN 'h' || k END AS md5, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS hash_count,
  o_orderpriority AS priority, '3' AS copies
  FROM objects WHERE NOT dir AND path IS NOT NULL)"""

ORACLES["s2_ndjson"] = f"""WITH {OBJECT_MANIFEST}
 SELECT * EXCLUDE (k), row_number() OVER (ORDER BY k) - 1 AS index FROM kept"""

ORACLES["s3_detected_form"] = f"""WITH {ORDER_FIELDS}, {DOC_PARTS}, sizes AS (
  SELECT any_size AS size FROM objects WHERE NOT dir_any AND any_size IS NOT NULL UNION ALL SELECT size FROM docs)
 SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes_total FROM sizes"""

ORACLES["s4_combine_parts"] = f"""WITH {DOC_PARTS}, kept AS (SELECT doc_id, size,
  CASE WHEN part % 2 = 1 THEN 'set-' || (part % 5) || '/x/' || path ELSE path END AS path
  FROM docs WHERE part % 7 NOT IN (3, 5))
 SELECT row_number() OVER (ORDER BY doc_id) - 1 AS index, path, size, '{SRC}/' || path AS source, '{DST}/' || path AS dest FROM kept"""

ORACLES["s4_part_files"] = ORACLES["s4_combine_parts"]
ORACLES["s1_arrays_in_splits"] = ORACLES["s1_json_arrays"]

ORACLES["s4_rejected_parts"] = f"""WITH {DOC_PARTS}
 SELECT DISTINCT printf('lsjson-%06d.json', part) AS part,
  CASE WHEN part % 7 = 3 THEN 'not JSON' ELSE 'not a JSON array' END AS reason FROM docs WHERE part % 7 IN (3, 5)"""

ORACLES["s5_manifest_strict"] = f"WITH {manifest('orders')} SELECT * FROM manifest"

ORACLES["s6_sizes_lenient"] = """SELECT count(*) AS objects, CAST(sum(
  CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT) AS bytes_total
 FROM orders WHERE o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0 AND o_orderkey % 47 <> 0"""

# --- Projections and filters -----------------------------------------------

ORACLES["p1_manifest"] = ORACLES["s5_manifest_strict"]
ORACLES["p1_manifest_from_objects"] = f"WITH {OBJECT_MANIFEST} SELECT * EXCLUDE (k) FROM kept"
ORACLES["p2_join_root"] = f"WITH {listed('pages')} SELECT seq, dataset || '/' || path AS joined FROM listing"
ORACLES["p3_rebase"] = f"""WITH {manifest('orders')}
 SELECT * REPLACE ('other:pool/' AS source_root, 'other:pool/' || path AS source), path AS note FROM manifest"""
ORACLES["p3_rebase_lines"] = f"""WITH {manifest('documents')}
 SELECT source_root, 'other:pool//' AS dest_root, source, 'other:pool/' || path AS dest, path, size, path AS note FROM manifest"""
ORACLES["p4_part_prefix"] = f"""WITH {listed('documents')}
 SELECT seq, CASE WHEN seq % 3 = 0 THEN dataset || '//' || path ELSE path END AS path FROM listing"""


def sha1_modulo(key: str, divisor: int) -> str:
    """Fold the 40 hex digits of the SHA-1 one by one."""
    return f"""list_reduce(list_transform(string_split(sha1({key}), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)),
 lambda rest, digit: (rest * 16 + digit) % {divisor}, CAST(0 AS BIGINT))"""


ORACLES["p5_work_list"] = f"WITH {manifest('orders')} SELECT path FROM manifest WHERE {sha1_modulo('source', 16)} = 3"
ORACLES["p7_first_roots"] = f"""WITH {manifest('orders')} SELECT arg_min(source_root, seq) AS source_root,
 arg_min(dest_root, seq) AS dest_root, count(DISTINCT (source_root, dest_root)) AS distinct_roots FROM manifest"""
ORACLES["f_object_rules"] = f"""WITH {ORDER_FIELDS}
 SELECT seq, dir AS is_directory, dir_any AS is_directory_any_case, path, manifest_size,
  CASE WHEN NOT dir_any THEN any_size END AS listed_size FROM objects"""

# --- Aggregations ----------------------------------------------------------

ORACLES["a1_totals"] = f"""WITH {ORDER_FIELDS} SELECT count(any_size) AS objects, CAST(sum(any_size) AS BIGINT) AS bytes_total
 FROM objects WHERE NOT dir_any"""
ORACLES["a1_totals_by_dataset"] = f"""WITH {sized('orders')}
 SELECT dataset, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes_total FROM sized GROUP BY dataset"""


def size_stats(name: str, group: str) -> str:
    """Common table expressions up to ``stats``, one row per group."""
    return f"""{sized(name)}, ranked AS (SELECT {group} AS dataset, size,
  row_number() OVER (PARTITION BY {group} ORDER BY size) - 1 AS r, count(*) OVER (PARTITION BY {group}) AS n FROM sized),
 stats AS (SELECT dataset, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes,
  min(size) AS min_size, max(size) AS max_size, CAST(sum(size) AS DOUBLE) / count(*) AS mean_size,
  max(size) FILTER (r = CAST(floor(CAST(0.1 AS DOUBLE) * (n - 1)) AS BIGINT)) AS p10_size,
  max(size) FILTER (r = CAST(floor(CAST(0.5 AS DOUBLE) * (n - 1)) AS BIGINT)) AS median_size,
  max(size) FILTER (r = CAST(floor(CAST(0.9 AS DOUBLE) * (n - 1)) AS BIGINT)) AS p90_size,
  100.0::DOUBLE * count(*) FILTER (size < 1048576) / count(*) AS small_files_pct,
  100.0::DOUBLE * count(*) FILTER (size BETWEEN 1048576 AND 104857600) / count(*) AS medium_files_pct,
  100.0::DOUBLE * count(*) FILTER (size > 104857600) / count(*) AS large_files_pct FROM ranked GROUP BY dataset)"""


FLOOR_LOG2 = "length(bin(greatest({x}, 1))) - 1"
CEIL_LOG2 = "CASE WHEN {x} >= 2 THEN length(bin({x} - 1)) ELSE 0 END"


def pow2_bins(name: str, group: str, low: str, high: str) -> str:
    """Common table expressions up to ``bins``: one row per group and power of two."""
    return f"""{sized(name)}, grouped AS (SELECT {group} AS dataset, size, {FLOOR_LOG2.format(x='size')} AS e FROM sized),
 extremes AS (SELECT dataset, min(size) AS lo, max(size) AS hi, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM grouped GROUP BY dataset),
 limits AS (SELECT *, CAST({low} AS BIGINT) AS a, greatest({high}, {low} + 1) AS b FROM extremes),
 edges AS (SELECT *, unnest(range(a, b)) AS x FROM limits),
 counted AS (SELECT g.dataset, least(greatest(e, a), b - 1) AS x, count(*) AS c, CAST(sum(size) AS BIGINT) AS s
  FROM grouped g JOIN limits l ON g.dataset IS NOT DISTINCT FROM l.dataset GROUP BY ALL),
 bins AS (SELECT d.dataset, CAST(d.x - d.a AS INTEGER) AS bin, CAST(1 AS BIGINT) << d.x AS range_min, CAST(1 AS BIGINT) << (d.x + 1) AS range_max,
  d.x = d.b - 1 AS is_last, coalesce(c, 0) AS file_count, coalesce(s, 0) AS bytes, n, total
  FROM edges d LEFT JOIN counted k ON d.dataset IS NOT DISTINCT FROM k.dataset AND d.x = k.x)"""


SHARES = """100.0::DOUBLE * file_count / n AS pct_files_raw, 100.0::DOUBLE * bytes / total AS pct_bytes_raw"""
INTERVAL = f"""'[' || {human_bytes('range_min')} || ', ' || {human_bytes('range_max')} || CASE WHEN is_last THEN ']' ELSE ')' END"""


def histogram(name: str, group: str) -> str:
    observed = pow2_bins(name, group, FLOOR_LOG2.format(x="lo"), CEIL_LOG2.format(x="hi"))
    return f"""{observed}, hist AS (SELECT dataset, bin, range_min, range_max,
  {human_bytes('range_min')} || ' - ' || {human_bytes('range_max')} AS range_label, file_count, bytes,
  {human_bytes('bytes')} AS bytes_human, {SHARES},
  {one_decimal('100.0::DOUBLE * file_count / n')} AS pct_files, {one_decimal('100.0::DOUBLE * bytes / total')} AS pct_bytes FROM bins)"""


def intervals(name: str, group: str, low: int, high: int) -> str:
    widened = pow2_bins(
        name,
        group,
        f"least({low.bit_length() - 1}, {FLOOR_LOG2.format(x='lo')})",
        f"greatest({(high - 1).bit_length()}, {CEIL_LOG2.format(x='hi')})",
    )
    return f"""{widened}, hist AS (SELECT dataset, bin, range_min, range_max, {INTERVAL} AS range_label, file_count,
  bytes, {human_bytes('bytes')} AS bytes_human, {SHARES} FROM bins)"""


def log_intervals(name: str, group: str, low: int, high: int, bins: int) -> str:
    return f"""{sized(name)}, grouped AS (SELECT {group} AS dataset, size FROM sized),
 extremes AS (SELECT dataset, min(size) AS lo, max(size) AS hi, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM grouped GROUP BY dataset),
 limits AS (SELECT *, log10(CASE WHEN {low} > greatest(lo, 1) THEN 1 << ({FLOOR_LOG2.format(x='lo')}) ELSE {low} END) AS a,
  log10(CASE WHEN {high} < hi THEN 1 << ({CEIL_LOG2.format(x='hi')}) ELSE {high} END) AS b FROM extremes),
 edges AS (SELECT *, list_transform(range(0, {bins} + 1), lambda i: pow(CAST(10 AS DOUBLE), a + i * ((b - a) / {bins}))) AS e FROM limits),
 counted AS (SELECT g.dataset, least(greatest(len(list_filter(e, lambda x: x <= size)) - 1, 0), {bins} - 1) AS bin, count(*) AS c,
  CAST(sum(size) AS BIGINT) AS s FROM grouped g JOIN edges l ON g.dataset IS NOT DISTINCT FROM l.dataset GROUP BY ALL),
 numbered AS (SELECT *, unnest(range(0, {bins})) AS bin FROM edges),
 bins AS (SELECT d.dataset, CAST(d.bin AS INTEGER) AS bin, CAST(floor(e[d.bin + 1]) AS BIGINT) AS range_min, CAST(floor(e[d.bin + 2]) AS BIGINT) AS range_max,
  d.bin = {bins} - 1 AS is_last, coalesce(c, 0) AS file_count, coalesce(s, 0) AS bytes, n, total
  FROM numbered d LEFT JOIN counted k ON d.dataset IS NOT DISTINCT FROM k.dataset AND d.bin = k.bin),
 hist AS (SELECT dataset, bin, range_min, range_max, {INTERVAL} AS range_label, file_count,
  bytes, {human_bytes('bytes')} AS bytes_human, {SHARES} FROM bins)"""


PERCENT = "CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def profile(name: str, group: str) -> str:
    median = human_bytes("median_size")
    flags = " ".join(f"WHEN '{key}' THEN '{value} {BASE_FLAGS}'" for key, value in PROFILE_FLAGS.items())
    return f"""{size_stats(name, group)}, judged AS (SELECT *,
  CASE WHEN small_files_pct > 70 OR median_size < 1048576 THEN 'small_files'
       WHEN large_files_pct > 50 OR median_size > 104857600 THEN 'large_files' ELSE 'mixed' END AS profile FROM stats),
 advised AS (SELECT *, CASE profile {flags} END AS suggested_flags, CASE profile
  WHEN 'small_files' THEN 'Optimized for small files (' || {PERCENT.format(x='small_files_pct')} || '% < 1MB, median ' || {median} || ')'
  WHEN 'large_files' THEN 'Optimized for large files (' || {PERCENT.format(x='large_files_pct')} || '% > 100MB, median ' || {median} || ')'
  ELSE 'Balanced settings for mixed file sizes (median ' || {median} || ')' END AS profile_explanation FROM judged)"""


def report(name: str, group: str) -> str:
    hist = histogram(name, group)[len(sized(name)) + 1 :]
    cap = 10 * 1024**4
    return f"""{profile(name, group)}, {hist},
 binned AS (SELECT dataset, CAST(count(*) AS INTEGER) AS bins, min_by(range_label, bin) AS first_bin, CAST(sum(file_count) AS BIGINT) AS binned_files FROM hist GROUP BY dataset),
 report AS (SELECT a.dataset, 'ok' AS status, total_files, total_bytes, {human_bytes('total_bytes')} AS total_bytes_human, min_size,
  {human_bytes('max_size')} AS max_size_human, median_size, {one_decimal('small_files_pct')} AS small_files_pct,
  {one_decimal('large_files_pct')} AS large_files_pct, profile, suggested_flags,
  CASE WHEN total_bytes < {cap} THEN 1 ELSE least(10, (total_bytes + {cap} - 1) // {cap}) END AS suggested_shard_count,
  bins, first_bin, binned_files FROM advised a JOIN binned b ON a.dataset IS NOT DISTINCT FROM b.dataset)"""


ALL_ROWS = "CAST(NULL AS VARCHAR)"
for _name in LISTINGS:
    ORACLES[f"a2_size_stats_{_name}"] = f"WITH {size_stats(_name, ALL_ROWS)} SELECT * EXCLUDE (dataset) FROM stats"
    ORACLES[f"a2_size_stats_by_dataset_{_name}"] = f"WITH {size_stats(_name, 'dataset')} SELECT * FROM stats"
    ORACLES[f"a5_histogram_{_name}"] = f"WITH {histogram(_name, ALL_ROWS)} SELECT * EXCLUDE (dataset) FROM hist"
    ORACLES[f"a5_histogram_by_dataset_{_name}"] = f"WITH {histogram(_name, 'dataset')} SELECT * FROM hist"
    ORACLES[f"a6_range_histogram_{_name}"] = f"WITH {intervals(_name, ALL_ROWS, 1024, 1024**4)} SELECT * EXCLUDE (dataset) FROM hist"
    ORACLES[f"a7_log_histogram_{_name}"] = f"WITH {log_intervals(_name, ALL_ROWS, 1024, 1024**4, 30)} SELECT * EXCLUDE (dataset) FROM hist"
    _kept = "total_files, median_size, profile, profile_explanation, suggested_flags"
    ORACLES[f"a9_profile_{_name}"] = f"WITH {profile(_name, ALL_ROWS)} SELECT {_kept} FROM advised"
    ORACLES[f"a9_profile_by_dataset_{_name}"] = f"WITH {profile(_name, 'dataset')} SELECT dataset, {_kept} FROM advised"
    ORACLES[f"k4_report_{_name}"] = f"WITH {report(_name, ALL_ROWS)} SELECT * EXCLUDE (dataset) FROM report"
    ORACLES[f"k4_report_by_dataset_{_name}"] = f"WITH {report(_name, 'dataset')} SELECT * FROM report"

ORACLES["a3_order_statistics"] = f"""WITH {sized('orders')}, ranked AS (
  SELECT size, row_number() OVER (ORDER BY size) - 1 AS r, count(*) OVER () AS n FROM sized)
 SELECT {', '.join(f"max(size) FILTER (r = CAST(floor(CAST(0.{q} AS DOUBLE) * (n - 1)) AS BIGINT)) AS p{q}" for q in ('01', '25', '50', '75', '99'))}
 FROM ranked"""
ORACLES["a6_range_histogram_by_dataset"] = f"WITH {intervals('orders', 'dataset', 1000, 5_000_000)} SELECT * FROM hist"
ORACLES["a7_log_histogram_by_dataset"] = f"WITH {log_intervals('pages', 'dataset', 1, 10**12, 12)} SELECT * FROM hist"

ORACLES["a10_shard_plan"] = f"""WITH {sized('orders')},
 datasets AS (SELECT dataset, CAST(sum(size) AS BIGINT) * 1024 AS total_bytes FROM sized GROUP BY dataset),
 settings(cpus, tasks, cores, cap) AS (VALUES (CAST(4 AS BIGINT), CAST(64 AS BIGINT), CAST(NULL AS BIGINT), CAST(10 AS BIGINT)),
  (4, 64, 40, 10), (8, 2, NULL, 20), (4, 64, 200, 10000)),
 bounds AS (SELECT *, cap * 1099511627776 AS cap_bytes, tasks * 4 AS by_tasks, greatest(1, cores // cpus) AS by_cores
  FROM datasets, settings),
 counted AS (SELECT *, (total_bytes + cap_bytes - 1) // cap_bytes AS by_bytes,
  CASE WHEN cores IS NULL THEN by_tasks ELSE least(by_tasks, by_cores) END AS upper_limit FROM bounds),
 chosen AS (SELECT *, greatest(1, least(upper_limit, by_bytes)) AS shards FROM counted)
 SELECT dataset, cpus, tasks, cores, cap, total_bytes, CASE WHEN total_bytes < cap_bytes THEN 1 ELSE shards END AS num_shards,
  CASE WHEN total_bytes < cap_bytes
   THEN 'total_bytes (' || {human_bytes('total_bytes')} || ') is below the per-shard cap (' || cap || ' TiB); a single shard is sufficient.'
   ELSE 'shards_by_bytes=' || by_bytes || ' (total ' || {human_bytes('total_bytes')} || ' / ' || cap || ' TiB cap); '
    || 'shards_by_concurrency=' || by_tasks || ' (4 x ' || tasks || '); '
    || CASE WHEN cores IS NULL THEN '' ELSE 'shards_by_cores=' || by_cores || ' (' || cores || ' cores / ' || cpus || ' cpus_per_task); ' END
    || 'chose max(1, min(upper=' || upper_limit || ', shards_by_bytes)) = ' || shards END AS reasoning FROM chosen"""

# --- Shards ----------------------------------------------------------------

ORACLES["h1_count"] = f"""WITH {manifest('orders')}
 SELECT seq, CAST((row_number() OVER (ORDER BY seq) - 1) % 7 AS INTEGER) AS shard_id FROM manifest"""
ORACLES["h2_hash"] = f"WITH {manifest('orders')} SELECT seq, CAST({sha1_modulo('source', 97)} AS INTEGER) AS shard_id FROM manifest"
ORACLES["h2_hash_without_source"] = f"""WITH {manifest('orders')}, keyed AS (SELECT seq,
  CASE WHEN seq % 2 = 0 THEN path ELSE CAST(row_number() OVER (ORDER BY seq) - 1 AS VARCHAR) END AS key FROM manifest)
 SELECT seq, CAST({sha1_modulo('key', 97)} AS INTEGER) AS shard_id FROM keyed"""


def dealt(name: str, shards: int, empty: str = "(SELECT list_position(f.l, list_min(f.l)) - 1 FROM folded)") -> str:
    """Records with bytes in descending size, each to the lightest shard; the others go to one shard.

    Loads count the mean size of a record's class, the sizes with the same first nine bits.
    """
    return f"""WITH {manifest(name)},
 classed AS (SELECT seq, size, greatest(length(bin(size)) - 9, 0) AS cut FROM manifest WHERE size > 0),
 meant AS (SELECT seq, size, CAST(sum(size) OVER c // count(*) OVER c AS BIGINT) AS v FROM classed
  WINDOW c AS (PARTITION BY (size >> CAST(cut AS INTEGER)) << CAST(cut AS INTEGER), cut)),
 ranked AS (SELECT seq, v, row_number() OVER (ORDER BY size DESC, seq) AS r FROM meant),
 start AS (SELECT {{'v': 0::BIGINT, 'l': list_transform(range({shards}), lambda x: 0::BIGINT), 'p': []::BIGINT[]}} AS s),
 items AS (SELECT list({{'v': v, 'l': []::BIGINT[], 'p': []::BIGINT[]}} ORDER BY r) AS all_items FROM ranked),
 folded AS (SELECT list_reduce(all_items, lambda a, x: {{'v': 0::BIGINT,
   'l': list_transform(a.l, lambda y, i: CASE WHEN i = list_position(a.l, list_min(a.l)) THEN y + x.v ELSE y END),
   'p': list_append(a.p, list_position(a.l, list_min(a.l)) - 1)}}, s) AS f FROM items, start),
 dealt_out AS (SELECT unnest(f.p) AS shard, generate_subscripts(f.p, 1) AS r FROM folded),
 placed AS (SELECT seq, size, CAST(shard AS INTEGER) AS shard_id FROM dealt_out JOIN ranked USING (r) JOIN manifest USING (seq)
  UNION ALL SELECT seq, size, CAST({empty} AS INTEGER) FROM manifest WHERE size IS NULL OR size <= 0)"""


def summary(placed: str, shards: int) -> str:
    return f"""SELECT CAST(i AS INTEGER) AS shard_id, count(p.seq) AS files, CAST(coalesce(sum(p.size), 0) AS BIGINT) AS bytes
 FROM range({shards}) t(i) LEFT JOIN {placed} p ON p.shard_id = i GROUP BY i"""


ORACLES["h3_bytes_documents"] = f"{dealt('documents', 8)} SELECT seq, shard_id FROM placed"
ORACLES["h3_bytes_pages"] = f"{dealt('pages', 12)} SELECT seq, shard_id FROM placed"
ORACLES["h3_bytes_orders"] = f"{dealt('orders', 64)} SELECT seq, shard_id FROM placed"
ORACLES["plan_end_to_end"] = f"{dealt('documents', 8)} {summary('placed', 8)}"
ORACLES["h3_bytes_spread"] = f"{dealt('orders', 16, 'seq % 16')} SELECT seq, shard_id FROM placed"

HASHED_PAGES = f"{manifest('pages')}, placed AS (SELECT *, {sha1_modulo('source', 400)} AS shard_id FROM manifest)"
ORACLES["a8_shard_summary"] = f"WITH {HASHED_PAGES} {summary('placed', 400)}"
ORACLES["k1_manifest_round_trip"] = f"WITH {manifest('documents')} SELECT * FROM manifest"
ORACLES["k2_shard_files"] = f"""WITH {manifest('orders')}
 SELECT CAST((row_number() OVER (ORDER BY seq) - 1) % 7 AS INTEGER) AS shard_id, seq, path, size FROM manifest"""
ORACLES["k2_shard_positions"] = f"""WITH {manifest('orders')}, dealt AS (
  SELECT seq, size, CAST((row_number() OVER (ORDER BY seq) - 1) % 7 AS INTEGER) AS shard_id FROM manifest)
 SELECT seq, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY seq) - 1 AS shard_pos,
  row_number() OVER (PARTITION BY shard_id ORDER BY size DESC, seq) - 1 AS pos_by_size FROM dealt"""
ORACLES["k2_shard_by_index"] = f"""WITH {manifest('orders')}, dealt AS (
  SELECT seq, path, size, row_number() OVER (ORDER BY seq) - 1 AS place FROM manifest)
 SELECT place // 3 AS shard_pos, seq, path, size FROM dealt WHERE place % 3 = 1"""
ORACLES["k2_file_per_shard"] = f"""WITH {manifest('documents')}, placed AS (
  SELECT seq, path, CAST({sha1_modulo('source', 40)} AS INTEGER) AS shard_id FROM manifest)
 SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY seq) - 1 AS shard_pos, seq, path FROM placed"""
ORACLES["k2_one_shard_positions"] = f"""WITH {manifest('orders')}
 SELECT seq, row_number() OVER (ORDER BY size DESC, seq) - 1 AS shard_pos FROM manifest"""
ORACLES["k3_shard_metadata"] = f"""WITH {manifest('pages')}
 SELECT '{SHARDS_SCHEMA}' AS schema, 'pages' AS input, 'out' AS outdir, CAST(400 AS BIGINT) AS num_shards, 'hash' AS strategy,
  count(*) AS num_records, CAST(sum(size) AS BIGINT) AS bytes_total FROM manifest"""

# --- Order -----------------------------------------------------------------

ORACLES["o2_record_index"] = f"WITH {manifest('orders')} SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS index FROM manifest"
ORACLES["o5_largest"] = f"WITH {manifest('orders')} SELECT seq, path, size FROM manifest ORDER BY size DESC, seq LIMIT 100"
ORACLES["duplicate_paths"] = "SELECT source || '/' || lang AS path, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1"

# --- Texts and transfer times ----------------------------------------------

ORACLES["c1_human_bytes"] = f"""WITH {sized('orders')}, scaled AS (SELECT seq,
  {', '.join(f'CAST(trunc(size * pow(2, {p})) AS BIGINT) AS "s{p}"' for p in (-20, -10, 0, 10, 20))} FROM sized)
 SELECT seq, {', '.join(f'{human_bytes(chr(34) + f"s{p}" + chr(34))} AS "bytes_{p}"' for p in (-20, -10, 0, 10, 20))} FROM scaled"""
ORACLES["c2_human_seconds"] = f"""SELECT o_orderkey AS seq, {human_seconds('o_totalprice')} AS long_time,
  {human_seconds('(o_totalprice / 3600.0::DOUBLE)')} AS short_time,
  {human_seconds('(round_even(o_totalprice / 100.0::DOUBLE, 0) * 60.0::DOUBLE)')} AS whole_minutes,
  {human_seconds('(-o_totalprice)')} AS undefined_time FROM orders"""
ORACLES["c3_rates"] = """WITH numbers AS (SELECT event_id, CAST(CAST(trunc(value * 100) AS BIGINT) AS DOUBLE) AS v FROM events)
 SELECT event_id, v * 1e9 / 8.0::DOUBLE AS gbps, v * 1e6 AS mb_s, v * 1024.0::DOUBLE AS kib_s, v * 1e12 / 8.0::DOUBLE AS tb_per_sec,
  v AS plain, v * 1125899906842624.0::DOUBLE AS pib FROM numbers"""
ORACLES["c4_human_rates"] = """SELECT o_orderkey AS seq,
  printf('%.2f Gbps', o_totalprice * 12345.0::DOUBLE * 8.0::DOUBLE / 1e9) AS gbps,
  printf('%.2f MB/s', o_totalprice * 12345.0::DOUBLE / 1e6) AS mb_s FROM orders"""
ORACLES["e1_time_steps"] = """WITH limits AS (SELECT user_id, floor(min(value)) * 1e6 AS a, floor(max(value) + 1) * 1e6 AS b FROM events GROUP BY user_id),
 ranges AS (SELECT user_id, least(a, b) AS a, greatest(a, b) AS b FROM limits),
 steps AS (SELECT *, unnest(range(0, CASE WHEN a <= 0 THEN 0 WHEN b - a <= 1e-9 * b THEN 1 ELSE 7 END)) AS step FROM ranges)
 SELECT user_id, CAST(step AS INTEGER) AS step, CAST(round(a * pow(b / a, step / 6.0::DOUBLE), 0) AS BIGINT) AS rate FROM steps"""


def at_rates(rates: str) -> str:
    return f"""WITH {sized('orders')}, summed AS (SELECT dataset, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes_total FROM sized GROUP BY dataset),
 rates AS ({rates}), timed AS (SELECT *, bytes_total / rate AS seconds FROM summed, rates)"""


_STEPS = "SELECT CAST(i AS INTEGER) AS step, CASE WHEN i = 0 THEN 125000000.0::DOUBLE ELSE 125000000.0::DOUBLE * pow(40.0::DOUBLE, i / 6.0::DOUBLE) END AS rate FROM range(7) t(i)"
ORACLES["e2_time_table"] = f"""{at_rates(_STEPS)}
 SELECT *, printf('%.2f Gbps', rate * 8.0::DOUBLE / 1e9) AS rate_text, {human_seconds('seconds')} AS time_text FROM timed"""
ORACLES["e3_time_range"] = f"""{at_rates("SELECT 'slow' AS end, 125000000.0::DOUBLE AS rate UNION ALL SELECT 'fast', 5000000000.0::DOUBLE")}
 SELECT *, printf('%.2f MB/s', rate / 1e6) AS rate_text, {human_seconds('seconds')} AS time_text FROM timed"""

# --- State, retry, resume --------------------------------------------------

ATTEMPTS = """attempts AS (SELECT user_id AS shard_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
  CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS rc FROM events),
 seen AS (SELECT shard_id, coalesce(min(attempt) FILTER (rc = 0), max(attempt)) AS attempts,
  CASE WHEN bool_or(rc = 0) THEN 'done' ELSE 'fail' END AS status,
  CAST(CASE WHEN bool_or(rc = 0) THEN 0 ELSE max_by(rc, attempt) END AS BIGINT) AS last_rc FROM attempts GROUP BY shard_id)"""
STATUS = f"""{ATTEMPTS}, shards AS (SELECT o_custkey AS shard_id, count(*) AS files FROM orders GROUP BY o_custkey),
 state AS (SELECT s.shard_id, files, coalesce(attempts, 0) AS attempts, coalesce(status, 'pending') AS status, last_rc
  FROM shards s LEFT JOIN seen USING (shard_id))"""

ORACLES["t1_attempt_summary"] = f"WITH {ATTEMPTS} SELECT * FROM seen"
ORACLES["t1_shard_status"] = f"WITH {STATUS} SELECT * FROM state"
ORACLES["t2_pending_work"] = f"""WITH {STATUS} SELECT o_custkey AS shard_id, o_orderkey AS seq, o_totalprice FROM orders
 WHERE o_custkey NOT IN (SELECT shard_id FROM state WHERE status = 'done')"""
ORACLES["t2_pending_folders"] = f"""WITH {manifest('orders')}, dealt AS (SELECT CAST(seq % 32 AS INTEGER) AS shard_id, seq, path, size FROM manifest),
 done AS (SELECT DISTINCT user_id % 32 AS shard_id FROM events WHERE event_type = 'purchase' AND user_id % 32 < 20)
 SELECT * FROM dealt WHERE shard_id NOT IN (SELECT shard_id FROM done)"""
ORACLES["t3_retry_plan"] = f"""WITH {STATUS} SELECT *, CASE WHEN status = 'done' THEN 'none' WHEN status = 'pending' THEN 'start'
  WHEN attempts < 60 THEN 'retry' ELSE 'exhausted' END AS action FROM state"""


def progress(name: str, every: int) -> str:
    return f"""WITH {manifest(name)}, indexed AS (SELECT size, row_number() OVER (ORDER BY seq) - 1 AS i FROM manifest),
 intervals AS (SELECT i // {every} AS checkpoint, count(*) AS files, sum(size) AS bytes FROM indexed GROUP BY ALL)
 SELECT checkpoint, CAST(sum(files) OVER (ORDER BY checkpoint) AS BIGINT) AS files_listed,
  CAST(sum(bytes) OVER (ORDER BY checkpoint) AS BIGINT) AS bytes_listed FROM intervals"""


ORACLES["t4_progress"] = progress("orders", 10_000)
ORACLES["t4_progress_fine"] = progress("documents", 64)

# --- Streams ---------------------------------------------------------------

ORACLES["x1_live_manifest"] = f"WITH {DOC_PARTS} SELECT path, size, '{SRC}/' || path AS source FROM docs"
ORACLES["x1_late_sidecars"] = f"SELECT path, size, source FROM ({ORACLES['s4_combine_parts']})"
ORACLES["x1_live_progress"] = "SELECT count(*) AS files_listed, CAST(sum(n_chars) AS BIGINT) AS bytes_listed FROM documents"
ORACLES["x1_live_checkpoints"] = """SELECT count(*) AS files_listed, CAST(sum(n_chars) AS BIGINT) AS bytes_listed,
 (count(*) + 63) // 64 AS reports FROM documents"""
ORACLES["x2_live_attempts"] = ORACLES["t1_attempt_summary"]
ORACLES["x2_live_shard_status"] = ORACLES["t1_attempt_summary"]
