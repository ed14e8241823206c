"""Benchmark decontamination: training texts streamed through a suffix automaton of the test items.

The items' words, letter case folded, form one generalised suffix automaton.  A
text is read word by word; the automaton's state and the matched length are the
longest string of words that ends here and stands in any item.  A length of at least
``window`` words is a hit of all words it covers; an item shorter than that hits
where the whole of it has just been read.  States know the items of their windows,
so a text also gets the list of items it leaks.

The automaton is built on an executor from a block of at most about
``BLOCK_WORDS`` item words and broadcast; larger benchmarks have several blocks, each
read against all texts, and the results of a text are united.  Long items are cut into
overlapping segments, so neither an item nor a block can outgrow a task.  Texts are not
shuffled.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import BYTE_VALUES, Words, discard, find_package, released, table, text_slices
from haulplan.staging import stage

WINDOW = 10  # words
BLOCK_WORDS = 1 << 17  # item words of one automaton: at most twice as many states, some 50 MB in a worker
SEGMENT = 4096  # words of an item that stay together
MAX_COVERAGE = 0.5  # share of its words above which a text goes as a whole

#: Bytes that part words: ASCII but digits and letters.
_PARTING = np.ones(256, bool)
_PARTING[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = BYTE_VALUES[_LOWER]
_SPAN = "struct<first: int, end: int, low: int, high: int>"
_FOUND = f"doc_id bigint, text_class bigint, n_words bigint, spans array<{_SPAN}>, items array<string>"


def read_words(data: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a slice of texts and a 64-bit value of each, letter case folded."""
    words = Words(data, bounds, _PARTING)
    return words, words.hashes(_LOWER_VALUES).view(np.int64)


# ---- the automaton -----------------------------------------------------------------------------------------


class Automaton:
    """Generalised suffix automaton of items (lists of word numbers) with the items of every window.

    ``steps[state * words + word]`` is the next state, ``link`` the suffix link and
    ``length`` the longest string of a state.  ``top`` is the state of the last
    ``window`` words, for states at least that long; ``items_of`` names its items.
    ``near`` is the nearest state up the links (or the state) where a short item ends, or -1,
    ``short`` its lengths and items.
    """

    def __init__(self, items: list[tuple[int, list[int]]], words: int, window: int):
        self.words, self.window = words, window
        link, length, nexts = [-1], [0], [{}]

        def state(size: int, edges: dict, suffix: int) -> int:
            link.append(suffix)
            length.append(size)
            nexts.append(edges)
            return len(link) - 1

        def split(parent: int, word: int, child: int) -> int:
            """The state of the parent's longest string and the word, parted from ``child`` if that is longer."""
            if length[child] == length[parent] + 1:
                return child
            part = state(length[parent] + 1, dict(nexts[child]), link[child])
            link[child] = part
            while parent >= 0 and nexts[parent].get(word) == child:
                nexts[parent][word] = part
                parent = link[parent]
            return part

        for _, item in items:
            last = 0
            for word in item:
                child = nexts[last].get(word)
                if child is not None:
                    last = split(last, word, child)
                    continue
                new, at = state(length[last] + 1, {}, 0), last
                while at >= 0 and word not in nexts[at]:
                    nexts[at][word] = new
                    at = link[at]
                if at >= 0:
                    link[new] = split(at, word, nexts[at][word])
                last = new

        self.link, self.length = link, length
        self.steps = {s * words + word: to for s, edges in enumerate(nexts) for word, to in edges.items()}
        order = sorted(range(1, len(link)), key=length.__getitem__)
        self.top, self.near = [-1] * len(link), [-1] * len(link)
        self.items_of: dict[int, set[int]] = {}
        self.short: dict[int, set[tuple[int, int]]] = {}
        ends = []
        for number, item in items:
            at = 0
            for word in item:
                at = nexts[at][word]
                ends.append((at, number))
            if len(item) < window and item:
                self.short.setdefault(at, set()).add((len(item), number))
        for s in order:
            if length[s] >= window:
                self.top[s] = s if length[link[s]] < window else self.top[link[s]]
            self.near[s] = s if s in self.short else self.near[link[s]]
        for s, number in ends:
            if self.top[s] >= 0:
                self.items_of.setdefault(self.top[s], set()).add(number)

    def stream(self, text: list[int]) -> tuple[list[list[int]], set[int]]:
        """Hit ranges of words (merged) and items of one text; unknown words are -1."""
        steps, link, length, near, top, window = self.steps, self.link, self.length, self.near, self.top, self.window
        step, many = steps.get, self.words
        at = size = 0
        hits: list[list[int]] = []
        tops, found = set(), set()
        for place, word in enumerate(text):
            to = step(at * many + word) if word >= 0 else None
            while to is None and at:
                at = link[at]
                size = length[at]
                to = step(at * many + word) if word >= 0 else None
            if to is None:
                continue
            at, size = to, size + 1
            reach = 0
            if size >= window:
                reach = window
                tops.add(top[at])
            up = near[at]
            while up >= 0:
                for least, number in self.short[up]:
                    if least <= size:
                        reach = max(reach, least)
                        found.add(number)
                up = near[link[up]]
            if reach:
                begin = place + 1 - reach
                while hits and begin <= hits[-1][1]:
                    begin = min(begin, hits.pop()[0])
                hits.append([begin, place + 1])
        for state in tops:
            found |= self.items_of[state]
        return hits, found


# ---- blocks of items ---------------------------------------------------------------------------------------


def item_segments(items: DataFrame, window: int, segment: int) -> DataFrame:
    """``item_id, words``: word values of items, long ones in segments that overlap by a window less a word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for lo, hi, data, bounds in text_slices(batch):
                words, values = read_words(data, bounds)
                ids = batch.column("item_id").slice(lo, hi - lo).to_pylist()
                out = []
                for k, name in enumerate(ids):
                    own = values[words.first[k] : words.first[k + 1]]
                    cuts = range(0, max(1, len(own) - window + 1), segment - window + 1)
                    out += [(name, own[a : a + segment].tolist()) for a in cuts if len(own)]
                columns = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "item_id string, words array<bigint>")


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``block, packed``: the automaton of each block of items, built on the executors."""
    find_package(items.sparkSession)
    segments = stage(item_segments(items, window, min(SEGMENT, max(2 * window, block_words))), "items")
    total = segments.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_words))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        # Items are numbered in a fixed order, so a rerun gives the same automaton.
        pairs = sorted((name is not None, name or "", list(words)) for name, words in zip(rows["item_id"], rows["words"]))
        names = [name if known else None for known, name, _ in pairs]
        known_words = np.unique(np.concatenate([np.array(w, np.int64) for *_, w in pairs]))
        numbered = [(k, np.searchsorted(known_words, np.array(w, np.int64)).tolist()) for k, (*_, w) in enumerate(pairs)]
        many = len(known_words)
        two = np.unique(np.array([a * many + b for _, w in numbered for a, b in zip(w, w[1:])], np.int64))
        least = min(window, *[len(w) for _, w in numbered])
        packed = pickle.dumps((names, known_words, two, least, Automaton(numbered, many, window)), protocol=5)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "packed": [packed]})

    dealt = segments.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int"))
    built = stage(dealt.groupBy("block").applyInPandas(build, "block int, packed binary"), "automata")
    discard(segments)
    return built


# ---- texts ---------------------------------------------------------------------------------------------------


def stretches(numbers: np.ndarray, first: np.ndarray, two: np.ndarray, many: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Text, first word and end of the longest stretches whose neighbouring words also neighbour in an item."""
    pairs = numbers[:-1] * many + numbers[1:]
    place = np.minimum(np.searchsorted(two, pairs), max(0, len(two) - 1))
    joined = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & ((two[place] == pairs) if len(two) else np.zeros(len(pairs), bool))
    inner = first[1:-1]
    joined[inner[(inner > 0) & (inner < len(numbers))] - 1] = False
    begins = np.flatnonzero(np.append(True, ~joined)) if len(numbers) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(numbers))
    use = (ends - begins >= least) & (numbers[begins] >= 0) if len(begins) else np.zeros(0, bool)
    begins, ends = begins[use], ends[use]
    of = np.searchsorted(first, begins, "right") - 1
    yield from zip(of.tolist(), begins.tolist(), ends.tolist())


def read_texts(rows: DataFrame, packed: Broadcast) -> DataFrame:
    """Hit spans and items of all ``doc_id, text_class, text`` against one automaton."""
    kind = pa.struct([(name, pa.int32()) for name in ("first", "end", "low", "high")])
    loaded: list = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(pickle.loads(packed.value))
        names, known, two, least, automaton = loaded[0]
        for batch in released(batches):
            for lo, hi, data, bounds in text_slices(batch):
                words, values = read_words(data, bounds)
                place = np.minimum(np.searchsorted(known, values), len(known) - 1)
                numbers = np.where(known[place] == values, place, -1)
                spans: list[list[tuple]] = [[] for _ in range(hi - lo)]
                items: list[set] = [set() for _ in range(hi - lo)]
                for of, begin, end in stretches(numbers, words.first, two, len(known), least):
                    hits, found = automaton.stream(numbers[begin:end].tolist())
                    for a, b in hits:
                        a, b, base = a + begin, b + begin, words.first[of]
                        low, high = words.starts[a] - bounds[of], words.ends[b - 1] - bounds[of]
                        spans[of].append((int(a - base), int(b - base), int(low), int(high)))
                    items[of] |= {names[k] for k in found}
                columns = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_class")]
                columns += [pa.array(words.counts()), pa.array([[dict(zip(kind.names, s)) for s in one] for one in spans], pa.list_(kind))]
                columns.append(pa.array([sorted(one - {None}) for one in items], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_class", "n_words", "spans", "items"])

    return rows.select("doc_id", "text_class", "text").mapInArrow(read, _FOUND)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_class, n_words, n_hit, spans, items`` of every row of ``docs``.

    ``spans`` are the hit ranges, disjoint and in order: words ``first`` to ``end`` and bytes
    ``low`` to ``high`` of the UTF-8 text; ``items`` the ids, as text, of all items with a
    window in the text, sorted.  Null and empty texts have no words and no hits, and an item
    without words has no window.  An item without an id hits but is not listed.  Rows of one id
    and text, and items of one text, are treated alike, each for itself.  Texts and items may
    be of any length.  An empty table of items hits nothing, an empty table of texts gives no rows;
    columns beyond id and text are ignored.
    """
    spark = docs.sparkSession
    find_package(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_class", F.xxhash64("text"))
    built = automata(items, window, block_words)
    blocks = [r.block for r in built.select("block").orderBy("block").collect()]  # one number per block
    empty = (["?"], np.zeros(1, np.int64), np.zeros(0, np.int64), 1 << 40, Automaton([], 1, window))

    def sent(block: int) -> Broadcast:
        return spark.sparkContext.broadcast(bytes(built.where(F.col("block") == block).first().packed))

    found = read_texts(rows, sent(blocks[0]) if blocks else spark.sparkContext.broadcast(pickle.dumps(empty)))
    if len(blocks) > 1:
        # Only texts with hits leave a pass over a block; those of several blocks are united.
        some = F.size("items") + F.size("spans") > 0
        hits = found.where(some).drop("n_words")
        for block in blocks[1:]:
            automaton = sent(block)
            hits = hits.union(stage(read_texts(rows, automaton).where(some).drop("n_words"), "hits"))
            automaton.destroy()
        items_of_all = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        hits = hits.groupBy("doc_id", "text_class").agg(_united(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), items_of_all.alias("items"))
        hits = stage(hits, "hits").toDF("_doc", "_class", "spans", "items")
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_class") == F.col("_class"))
        none = [F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c) for c, kind in (("spans", _SPAN), ("items", "string"))]
        found = found.drop("spans", "items").join(hits, same, "left").select("doc_id", "text_class", "n_words", *none)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "text_class", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _united(spans: Column) -> Column:
    """Disjoint ranges of words, in order, from overlapping ones."""

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"), last["low"].alias("low"), F.greatest(last["high"], span["high"]).alias("high"))
        joins = (F.size(done) > 0) & (span["first"] <= last["end"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as array<{_SPAN}>)"), add)


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``; a text with more than ``max_coverage`` of its words hit goes.

    What is left around a span is joined as it stands.  Texts without hits stay as they
    are, null texts too; other columns are kept.  Defined cases as in :func:`contamination`.
    """
    found = contamination(docs, items, window, block_words).where("n_hit > 0").distinct()
    hits = stage(found.select(F.col("doc_id").alias("_doc_hit"), F.col("text_class").alias("_class_hit"), (F.col("n_hit") / F.col("n_words")).alias("_share_hit"), F.col("spans").alias("_spans_hit")), "hits")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, ranges in zip(texts, spans):
            if ranges is None:
                out.append(text)
                continue
            data = text.encode()
            edges = [0, *[e for r in ranges for e in (r["low"], r["high"])], len(data)]
            out.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode())
        return pd.Series(out, dtype=object)

    text = F.col("text").cast("string")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc_hit")) & (F.xxhash64(text) == F.col("_class_hit"))
    joined = docs.join(hits, same, "left").where(F.coalesce(F.col("_share_hit") <= max_coverage, F.lit(True)))
    return joined.withColumn("text", F.when(F.col("_spans_hit").isNotNull(), cut(text, F.col("_spans_hit"))).otherwise(text)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in all documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w"""

#: Every window of the items, looked up at every place of the texts.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} FROM benchmark),
placed AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM placed),
read AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows)),
hits AS (SELECT r, p, read.k, item_id FROM read JOIN windows ON windows.k = read.k AND s = array_to_string(w[p:p + read.k - 1], ' ')),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
names AS (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hits WHERE item_id IS NOT NULL),
listed AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS all_names FROM names GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(all_names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
