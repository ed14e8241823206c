"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words.  The targets come from the sizes of the sources.  The documents
of a source are dealt to ``BLOCKS`` blocks by the MD5 of their id, and the blocks
are permuted.  A source gives all its blocks as often as its target allows, then
blocks in permuted order up to the rest, the last of them in part: the documents up
to a threshold of their MD5.  Each block given once is one draw.

The draws of all sources are divided among the output shards by a splitting tree:
a node cuts its draws in half, and how many of each source fall to the left is a
multivariate hypergeometric number, drawn source by source by inverting the exact
distribution function.  Quotas so add up exactly at every node.  A leaf takes its
quota of each source from the permuted draws, disjoint from all other leaves, and
its rows are shuffled locally by a hash.

All randomness is MD5 of fixed texts, so reruns agree.  What is joined to the
documents is one row per source; Spark broadcasts it only if its written size is
small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulplan.llm.common import table
from haulplan.staging import stage

BLOCKS = 1024
DEPTH = 5  # 2**DEPTH output shards
WEIGHTS = (5, 2, 1)  # of the sources in code point order, null last, repeated
SHARE = 1.5  # of all words go into the mix
MOST = 2  # times that a source or a document is used

WORD = r"[^\x20\x09-\x0D]+"
SPREAD = 12  # standard deviations around the mean that are inverted; beyond lie less than 1e-30


def words(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def block_number() -> Column:
    return (F.conv(F.substring(document_key(), 1, 6), 16, 10).cast("bigint") % BLOCKS).cast("int")


def text_md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source with ``source_size``.

    A target is the smaller of its cap and ``weight * level``, where the level
    makes the targets add up; sources are capped in order of cap per weight.
    The windows run over one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    all_rows = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    goal = share * F.sum("source_size").over(all_rows)
    level = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = capped.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    solved = levels.withColumn("level", F.max(fits).over(all_rows))  # levels fall behind the first that fits
    over = F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("cap"))
    target = F.when(over, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return solved.select("source", "rank", "source_size", target.alias("target"))


def block_uses(sized: DataFrame, most: int = MOST, **goal) -> tuple[DataFrame, DataFrame]:
    """One row per source, and one per source and block: how often it is used whole, and whether once in part.

    ``sized`` has source, size, block, key; it is read three times.
    """
    blocks = stage(sized.groupBy("source", "block").agg(F.sum("size").alias("size")), "blocks")
    sources = targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")), most=most, **goal)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("full", full)
    sources = stage(sources.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "sources")
    known = sources.withColumnRenamed("source", "_source")
    used = blocks.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = text_md5("block", F.coalesce("source", F.lit("")), F.col("block"))
    permuted = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    used = used.withColumn("before", F.coalesce(F.sum("size").over(permuted), F.lit(0)))
    more = F.col("before") + F.col("size") <= F.col("rest")
    used = used.withColumn("whole", F.col("full") + F.when(more & (F.col("size") > 0), 1).otherwise(0))
    used = used.withColumn("part", ~more & (F.col("before") < F.col("rest")))
    used = stage(used.select("source", "rank", "block", "whole", "part", (F.col("rest") - F.col("before")).alias("room")), "uses")
    parts = used.where("part").select(F.col("source").alias("_source"), F.col("block").alias("_block"), "room")
    inside = sized.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    rows = inside.groupBy("source", "room", "key", "size").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("key", "size"))  # one block of the source
    taken = rows.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2 <= F.col("room"))
    limits = taken.groupBy(F.col("source").alias("_source")).agg(F.max(F.struct("key", "size")).alias("limit"))
    sources = sources.join(limits, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return stage(sources, "limits"), used


def log_factorial(n: str) -> str:
    """SQL text of ln n!, by Stirling's series (error below 1e-9 from 8 on; smaller n are shifted up)."""
    series = "(({m}) * ln({m}) - ({m}) + 0.918938533204672742D - 0.5D * ln({m}) + 1D / (12 * ({m})) - 1D / (360 * ({m}) * ({m}) * ({m})))"
    big = series.format(m=f"({n}) + 9D")
    shift = " * ".join(f"(({n}) + {k}D)" for k in range(1, 9))
    return f"({big} - ln({shift}))"


def hypergeometric(draws: str, marked: str, total: str, u: str) -> str:
    """SQL text of a number of marked items among ``draws`` of ``total``, by inversion at ``u`` in [0, 1)."""
    mean = f"({draws} * {marked} / greatest({total}, 1))"
    spread = f"({SPREAD} * sqrt(({draws} * {marked} / greatest({total}, 1)) * (1 - {marked} / greatest({total}, 1))) + {SPREAD})"
    low = f"greatest(0, {draws} + {marked} - {total}, cast(floor({mean} - {spread}) as bigint))"
    high = f"least({draws}, {marked}, cast(ceil({mean} + {spread}) as bigint))"
    terms = [log_factorial(x) for x in ("k", f"{marked} - k", f"{draws} - k", f"{total} - {marked} - {draws} + k")]
    logs = f"transform(sequence({low}, {high}), k -> -({' + '.join(terms)}))"
    weights = f"transform(array({logs}), l -> transform(l, x -> exp(x - array_max(l))))[0]"
    sums = f"aggregate({weights}, array(0D), (s, x) -> concat(s, array(element_at(s, -1) + x)))"
    found = f"transform(array({sums}), s -> size(filter(s, x -> x <= {u} * element_at(s, -1))) - 1)[0]"
    return f"least({high}, {low} + {found})"


def splitting_tree(spark: SparkSession, quotas: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``shard, rank, quota``: exact division of the sources' draws (one row ``rank, draws`` each) among 2**depth shards.

    A node is one row with an array of one number per source; written level by level.
    """
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "draws"))).alias("q"))
    nodes = root.select(F.lit(0).alias("node"), F.expr("transform(q, x -> x.rank)").alias("ranks"), F.expr("transform(q, x -> x.draws)").alias("q"))
    for level in range(depth):
        unit = f"conv(substr(md5(cast(concat_ws('/', 'split', {level}, node, size(a.left)) as binary)), 1, 12), 16, 10) / pow(2D, 48)"
        number = f"transform(array({unit}), u -> {hypergeometric('a.take', 'x', 'a.total', 'u')})[0]"
        total = "aggregate(q, 0L, (s, x) -> s + x)"
        state = f"named_struct('left', cast(array() as array<bigint>), 'take', ({total} + 1) div 2, 'total', {total})"
        step = (
            f"transform(array(cast({number} as bigint)), n -> "
            "named_struct('left', concat(a.left, array(n)), 'take', a.take - n, 'total', a.total - x))[0]"
        )
        split = nodes.withColumn("left", F.expr(f"aggregate(q, {state}, (a, x) -> {step}).left"))
        both = "array(named_struct('node', 2 * node, 'q', left), named_struct('node', 2 * node + 1, 'q', zip_with(q, left, (x, n) -> x - n)))"
        nodes = stage(split.select("ranks", F.explode(F.expr(both)).alias("s")).select("s.node", "ranks", "s.q"), "tree")
    leaves = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("ranks", "q")).alias("z"))
    return leaves.select("shard", F.col("z.ranks").alias("rank"), F.col("z.q").alias("quota"))


def plan(sized: DataFrame, depth: int = DEPTH, **goal) -> DataFrame:
    """One row per source: source_size, target, limit, and for every block the shards that use it whole and in part."""
    spark = sized.sparkSession
    sources, used = block_uses(sized, **goal)
    draw = used.where("whole > 0 OR part").select("source", "rank", "block", "whole", F.explode(F.expr("sequence(1, whole + int(part))")).alias("copy"))
    order = text_md5("draw", F.coalesce("source", F.lit("")), F.col("block"), F.col("copy"))
    number = F.row_number().over(Window.partitionBy("source").orderBy(order, "block", "copy")) - 1
    draws = stage(draw.withColumn("number", number), "draws")
    quotas = splitting_tree(spark, draws.groupBy("rank").agg(F.count("*").alias("draws")), depth)
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = quotas.withColumn("end", F.sum("quota").over(upto)).groupBy("rank").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    sharded = draws.join(stage(ranges, "ranges"), "rank").withColumn("shard", F.expr("size(filter(ends, x -> x <= number))"))
    whole = F.array_sort(F.collect_list(F.when(F.col("copy") <= F.col("whole"), F.col("shard"))))
    part = F.max(F.when(F.col("copy") > F.col("whole"), F.col("shard")))
    by_block = sharded.groupBy("rank", "block").agg(whole.alias("whole"), part.alias("part"))
    listed = by_block.groupBy("rank").agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("whole", "part")))).alias("m"))
    dense = listed.select("rank", F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> m[b])").alias("uses"))
    return stage(sources.join(dense, "rank", "left").select("source", "source_size", "target", "limit", "uses"), "plan")


def mix(docs: DataFrame, size: Column | None = None, depth: int = DEPTH, **goal) -> DataFrame:
    """``docs`` with size (the words of ``text`` unless given), source_size, target, ``shards`` (one for each use of the row) and ``taken`` words.

    Columns of ``docs`` with these names are replaced.  Null texts and texts
    without words have size 0 and take nothing.  Rows with one doc_id and size share
    their fate.  An empty table gives no rows.
    """
    made = ("size", "source_size", "target", "shards", "taken")
    size = words(F.col("text").cast("string")) if size is None else size
    rows = docs.withColumn("size", size).drop(*made[1:]).withColumns({"_block": block_number(), "_key": document_key()})
    sized = stage(rows.select("source", "size", F.col("_block").alias("block"), F.col("_key").alias("key")), "sizes")
    planned = plan(sized, depth, **goal).withColumnRenamed("source", "_source")
    joined = rows.join(planned, F.col("source").eqNullSafe(F.col("_source")))
    use = F.element_at("uses", F.col("_block") + 1)
    in_part = use["part"].isNotNull() & (F.struct(F.col("_key").alias("key"), F.col("size").alias("size")) <= F.col("limit"))
    whole = F.coalesce(use["whole"], F.expr("cast(array() as array<int>)"))
    shards = F.when(F.col("size") == 0, F.expr("cast(array() as array<int>)")).when(in_part, F.concat(whole, F.array(use["part"]))).otherwise(whole)
    joined = joined.withColumn("shards", shards)
    return joined.withColumn("taken", F.col("size") * F.size("shards")).drop("_block", "_key", "_source", "limit", "uses")


def mixture(docs: DataFrame, depth: int = DEPTH, **goal) -> DataFrame:
    """The mix itself: a row of ``docs`` for each use, with ``shard`` and ``place``, its random order in the shard.

    Of ``docs`` only these two columns are replaced, should they be there.  Defined cases as in :func:`mix`.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    uses = mix(rows, depth=depth, **goal).select("doc_id", "_row", F.posexplode("shards").alias("use", "shard"))
    place = text_md5("place", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("use"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "place")]
    return uses.select(*kept, "shard", place.alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("words"))
    return mix(stage(docs, "words"), F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
d AS (SELECT *, ('0x' || substr(key, 1, 6))::BIGINT % {BLOCKS} AS block FROM docs),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
           - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER ()
           - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS l
       FROM s2),
s4 AS (SELECT *, max(CASE WHEN l * weight <= cap THEN l END) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * weight > cap THEN cap::DOUBLE ELSE level * weight END AS target FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_uses FROM s5),
b0 AS (SELECT source, block, sum(size)::BIGINT AS size FROM d GROUP BY source, block),
b1 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source
           ORDER BY md5('block/' || coalesce(source, '') || '/' || block), block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b0),
b2 AS (SELECT b1.*, s.full_uses, s.target - s.full_uses * s.source_size AS rest
       FROM b1 JOIN s ON b1.source IS NOT DISTINCT FROM s.source),
b AS (SELECT source, block, full_uses + CASE WHEN before + size <= rest AND size > 0 THEN 1 ELSE 0 END AS whole,
             before + size > rest AND before < rest AS part, rest - before AS room FROM b2),
k0 AS (SELECT d.source, d.block, b.room, d.key, d.size, sum(d.size) AS words
       FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block WHERE b.part GROUP BY ALL),
k1 AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, size) AS upto FROM k0),
k AS (SELECT * FROM k1 WHERE upto - words / 2 <= room)
SELECT d.doc_id, d.size::BIGINT AS size, s.source_size, s.target,
       (d.size * (b.whole + CASE WHEN k.key IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.block = k.block AND d.key = k.key AND d.size = k.size
"""
