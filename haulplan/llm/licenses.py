"""Licence scan by Dice similarity of word bigrams, with DataFrame functions only.

Units of a text are normalised and compared with licence templates as sets of word
bigrams.  A Dice coefficient of at least ``d`` needs ``d / (2 - d)`` to ``(2 - d) / d``
times a template's bigrams.  Units are

- each line, and the text as a whole: a template is listed under the size classes that
  its bounds touch, and a unit meets only templates of its own class;
- windows of words, for notices that are wrapped over lines or stand inside one.  A
  template has anchors, its longest bigrams, so many that a unit which lacks them all
  is below the coefficient.  Where an anchor occurs, the words are compared that the
  template would cover.  A window with several anchors is made by its first one.

Nothing is shuffled as long as templates are few: they are a parameter, joined as a
broadcast table up to ``MOST_SENT`` rows, and with more as Spark sees fit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import table
from haulplan.llm.license_texts import NOTICES, TEXTS

DICE = 0.8
STEP = 1.25  # a size class reaches from a power of this to the next
MOST_SENT = 10_000  # rows of a template table that is broadcast by hint
MOST_LISTED = 50_000  # anchors that a generator looks for itself

TEMPLATES = {**NOTICES, **TEXTS}


def unit_words(text: Column) -> Column:
    """Words of a text: letters and digits in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ", -1), lambda w: w != "")


def pair_at(w: Column, i: Column) -> Column:
    return F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))


def pairs_of(w: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: pair_at(w, i))
    return F.when(F.size(w) < 2, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(pairs))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once a row as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), 0)


def bigram_set(text: Column) -> Column:
    return bound(unit_words(text), pairs_of)


def size_class(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(STEP))).cast("int")


def template_rows(spark: SparkSession, templates: Mapping[str, str], dice: float) -> DataFrame:
    """``license, words, template`` (its bigrams) with ``low`` and ``high``, the sizes that its bounds allow."""
    if not 0 < dice <= 1:
        raise ValueError(f"the coefficient must be above 0 and at most 1: {dice}")
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = rows.select("license", F.explode(F.array(unit_words(F.col("text")))).alias("words"))
    rows = rows.withColumn("template", pairs_of(F.col("words"))).where(F.size("template") > 0)
    low = F.ceil(F.size("template") * F.lit(dice / (2 - dice)) - 1e-9).cast("int")
    high = F.floor(F.size("template") * F.lit((2 - dice) / dice) + 1e-9).cast("int")
    return rows.withColumns({"low": F.greatest(low, F.lit(1)), "high": high})


def template_anchors(rows: DataFrame, dice: float) -> DataFrame:
    """``anchor, offset, license, length, template, anchors``: each place of an anchor in its template.

    ``length`` counts words; ``anchors`` lists all places of the template's anchors.
    """
    count = F.floor(F.size("template") * F.lit((2 - 2 * dice) / (2 - dice)) + 1e-9).cast("int") + 1
    by_length = F.array_sort(F.transform("template", lambda b: F.struct(-F.length(b), b.alias("b"))))
    chosen = rows.withColumn("chosen", F.transform(F.slice(by_length, F.lit(1), count), lambda x: x["b"]))
    places = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.struct(i.alias("offset"), pair_at(F.col("words"), i).alias("anchor")))
    chosen = chosen.withColumn("anchors", F.filter(places, lambda x: F.array_contains("chosen", x["anchor"])))
    length = F.size("words").alias("length")
    kept = ["license", "low", "high", "template", "anchors"]
    return chosen.select(*kept, length, F.explode("anchors").alias("a")).select("a.*", "length", *kept)


def dice_of(pairs: str, template: str) -> Column:
    return 2.0 * F.size(F.array_intersect(pairs, template)) / (F.size(pairs) + F.size(template))


def sent(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= MOST_SENT else rows


def scan_units(docs: DataFrame, rows: DataFrame, dice: float) -> DataFrame:
    """``doc_id, line, word, license, dice`` of lines, and of whole texts with several lines (line -1); ``word`` is null."""
    bounds = rows.agg(F.count("*").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    classes = F.sequence(size_class(F.col("low")), size_class(F.col("high")))
    by_class = rows.select("license", "template", "low", "high", F.explode(classes).alias("class"))
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line", "unit"))
    whole = docs.where(F.instr(text, "\n") > 0).select("doc_id", F.lit(-1).alias("line"), text.alias("unit"))
    # A unit of n bigrams has n + 1 words with a sign between them at least.  Only sizes in bounds leave the generator.
    units = lines.union(whole).where(F.length("unit") > 2 * F.lit(bounds["low"] or 0))
    fits = F.filter(F.array(bigram_set(F.col("unit"))), lambda p: F.size(p).between(F.lit(bounds["low"]), F.lit(bounds["high"])))
    units = units.select("doc_id", "line", F.explode(fits).alias("pairs")).withColumn("class", size_class(F.size("pairs")))
    met = units.join(sent(by_class, 8 * bounds["rows"]), "class").where(F.size("pairs").between(F.col("low"), F.col("high")))
    found = met.select("doc_id", "line", F.lit(None).cast("int").alias("word"), "license", dice_of("pairs", "template").alias("dice"))
    return found.where(F.col("dice") >= dice)


def scan_windows(docs: DataFrame, rows: DataFrame, dice: float) -> DataFrame:
    """``doc_id, line, word, license, dice`` of windows (line -2) by their first word, counted from 0 in the whole text.

    A window has a template's number of words and an anchor at its place in the template;
    at the ends of a text it is cut off.
    """
    anchors = template_anchors(rows, dice)
    known = anchors.agg(F.count("*").alias("rows"), F.max("length").alias("longest"), F.count_distinct("anchor").alias("distinct")).first()
    listed = [r["anchor"] for r in anchors.select("anchor").distinct().collect()] if known["distinct"] <= MOST_LISTED else None
    openers = sorted({a.split(" ")[0] for a in listed or []})  # few places get as far as a pair
    reach = F.lit(known["longest"] or 0)

    def hits(w: Column) -> Column:
        places = F.when(F.size(w) < 2, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), F.size(w) - 2))
        met = places if listed is None else F.filter(places, lambda i: F.get(w, i).isin(openers) & pair_at(w, i).isin(listed))
        near = lambda i: F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, 2 * reach)
        return F.transform(met, lambda i: F.struct(i.alias("at"), pair_at(w, i).alias("anchor"), near(i).alias("near")))

    found = docs.select("doc_id", F.explode(bound(unit_words(F.col("text").cast("string")), hits)).alias("hit")).select("doc_id", "hit.*")
    met = found.join(sent(anchors, known["rows"]), "anchor").withColumn("first", F.least("at", reach) - F.col("offset"))
    same = lambda x: (F.col("first") + x["offset"] >= 0) & (pair_at(F.col("near"), F.col("first") + x["offset"]) == x["anchor"])
    met = met.where(~F.exists("anchors", lambda x: (x["offset"] < F.col("offset")) & F.coalesce(same(x), F.lit(False))))
    begin = F.greatest("first", F.lit(0))
    pairs = bound(F.slice("near", begin + 1, F.col("first") + F.col("length") - begin), pairs_of)
    met = met.withColumn("pairs", pairs).where(F.size("pairs").between(F.col("low"), F.col("high")))
    word = F.greatest(F.col("at") - F.col("offset"), F.lit(0)).alias("word")
    return met.select("doc_id", F.lit(-2).alias("line"), word, "license", dice_of("pairs", "template").alias("dice")).where(F.col("dice") >= dice)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """``doc_id, line, word, license, dice`` for every unit and template with at least the coefficient.

    ``line`` counts from 0; the whole text is line -1, where it has several lines, and a
    window is line -2 with the number of its first ``word``.  A notice that fills a line is found
    as a line and as a window.  Null, empty and blank texts match nothing; repeated rows
    are reported as often; an empty table gives no rows; other columns are ignored.  Texts
    may be of any length: of a long one only the words around anchors leave the generator.
    """
    rows = template_rows(docs.sparkSession, templates, dice)
    docs = docs.select("doc_id", "text")
    return scan_units(docs, rows, dice).union(scan_windows(docs, rows, dice))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_words(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _sql_bigrams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    spare = (2 - 2 * DICE) / (2 - DICE)
    return f"""
WITH tw AS MATERIALIZED (SELECT license, {_sql_words('text')} AS w FROM (VALUES {values}) v(license, text)),
t AS MATERIALIZED (SELECT license, len(w) AS m, {_sql_bigrams('w')} AS b FROM tw),
tp AS (SELECT license, i AS "offset", w[i + 1] || ' ' || w[i + 2] AS pair FROM (SELECT license, w, unnest(range(0, len(w) - 1)) AS i FROM tw)),
tr AS (SELECT license, pair, row_number() OVER (PARTITION BY license ORDER BY length(pair) DESC, pair) AS n FROM (SELECT DISTINCT license, pair FROM tp)),
ta AS MATERIALIZED (
  SELECT tp.license, tp."offset", tp.pair, t.m, t.b FROM tp JOIN tr USING (license, pair) JOIN t USING (license)
  WHERE tr.n <= floor(len(t.b) * {spare!r}::DOUBLE + 1e-9) + 1),
l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(0, len(lines)))::INTEGER AS line, unnest(lines) AS unit FROM l
      UNION ALL SELECT doc_id, -1, text FROM l WHERE len(lines) > 1),
b AS (SELECT doc_id, line, {_sql_bigrams('w')} AS b FROM (SELECT doc_id, line, {_sql_words('unit')} AS w FROM u) x WHERE len(w) > 1),
d AS MATERIALIZED (SELECT doc_id, w, row_number() OVER () AS r FROM (SELECT doc_id, {_sql_words('text')} AS w FROM l)),
dp AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] AS pair FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS i FROM d)),
s AS (SELECT DISTINCT dp.r, ta.license, ta.m, ta.b AS tb, dp.i - ta."offset" AS s FROM dp JOIN ta USING (pair)),
x AS (SELECT d.doc_id, s.license, s.tb, greatest(s.s, 0)::INTEGER AS word, w[greatest(s.s, 0) + 1 : s.s + s.m] AS w FROM s JOIN d USING (r)),
wb AS (SELECT doc_id, word, license, tb, {_sql_bigrams('w')} AS b FROM x)
SELECT * FROM (
  SELECT doc_id, line, NULL::INTEGER AS word, license, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice FROM b, t WHERE len(b.b) > 0
  UNION ALL
  SELECT doc_id, -2, word, license, 2.0::DOUBLE * len(list_intersect(wb.b, tb)) / (len(wb.b) + len(tb)) FROM wb)
WHERE dice >= {DICE}
"""


ORACLE = oracle()
