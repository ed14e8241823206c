"""Periodic runs by online dyadic square catching.

Words are appended one after another.  Once ``2 * size`` words from a multiple of
``size`` (a power of two) are there, they are a completed block, and a catcher holds
its hash.  The catcher looks for squares whose period is ``size`` to ``2 * size - 1``
words: each appended word completes a suffix of the block's length, which is
compared with the one block that began that many words earlier.  So a word costs one
comparison for each size, and all the words of a slice of texts are appended in one
vectorised step per size; hashes of the next size come from two of the last.

A run of at least four periods ``q`` holds, for ``size <= q < 2 * size``, a block that
begins inside its first ``size`` words and comes again ``q`` words later, so its catcher
must report.  A reported square grows word by word to both sides into the run that it
belongs to, which compares words and not block hashes; squares inside a run that is
known are merged into it.  Sizes rise, so the smallest period is found first and its
multiples fall inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import Words, find_package, mix, released, table, text_slices

MIN_PERIODS = 4
MIN_WORDS = 6
_STEP = 4096  # words compared at once while a run grows

_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
_FOUND = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def grown(values: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """Begin and end of the stretch around ``at`` inside ``low:high`` whose words equal those a period later."""
    end = at
    while end < high - period:
        stop = min(end + _STEP, high - period)
        other = np.flatnonzero(values[end:stop] != values[end + period : stop + period])
        if len(other):
            end += int(other[0])
            break
        end = stop
    begin = at
    while begin > low:
        stop = max(low, begin - _STEP)
        other = np.flatnonzero(values[stop:begin] != values[stop + period : begin + period])
        if len(other):
            begin = stop + int(other[-1]) + 1
            break
        begin = stop
    return begin, end + period


def catch_runs(values: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """``begin, end, period`` of every run of at least four periods in texts ``first[i]:first[i + 1]`` of word values.

    Shorter runs may be among them; no stretch is given with a multiple of its smallest period.
    """
    longest = int(np.diff(first).max(initial=0))
    hashes, size = values, 1
    reach = np.zeros(0, np.int64)  # furthest end of the known runs that begin at or before a word
    runs: list[tuple[int, int, int]] = []
    while MIN_PERIODS * size <= longest:
        # hashes[i] stands for `size` words; blocks and suffixes have twice as many
        hashes = mix(hashes[:-size] * np.uint64(0x9FB21C651E98DF25) + hashes[size:])
        places = np.arange(size, len(hashes))
        blocks = (places // size - 1) * size
        caught = hashes[blocks] == hashes[size:]
        places, blocks = places[caught], blocks[caught]
        if len(places):
            of = np.searchsorted(first, blocks, "right") - 1
            inside = places + 2 * size <= first[of + 1]
            if len(reach):
                inside &= reach[blocks] < places + 2 * size
            places, blocks, of = places[inside], blocks[inside], of[inside]
            order = np.lexsort((blocks, places - blocks))
            known, news = (0, 0, 0), []
            for k in order.tolist():
                block, period = int(blocks[k]), int(places[k] - blocks[k])
                if known[2] == period and known[0] <= block and block + period + 2 * size <= known[1]:
                    continue  # merges into the run found last
                begin, end = grown(values, block, period, int(first[of[k]]), int(first[of[k] + 1]))
                known = (begin, end, period)
                if end - begin >= 2 * period:
                    news.append(known)
            # Of two periods caught at one size in one stretch the longer is no multiple of the shorter.
            runs += news
            if news:
                reach = np.zeros(len(values), np.int64) if not len(reach) else reach
                begins, ends = np.array([n[0] for n in news]), np.array([n[1] for n in news])
                np.maximum.at(reach, begins, ends)
                reach = np.maximum.accumulate(reach)
        size *= 2
    return runs


def collapsed_texts(words: Words, kept: np.ndarray) -> list[bytes]:
    """Kept words of each text, joined by single spaces."""
    lengths = words.ends - words.starts
    use = np.repeat(kept, lengths)
    chosen = words.data[words.solid][use]
    sizes = lengths[kept]
    out = np.full(len(chosen) + len(sizes), 32, np.uint8)
    out[np.arange(len(chosen)) + np.repeat(np.arange(len(sizes)), sizes)] = chosen
    edges = np.append(0, np.cumsum(sizes + 1))
    rank = np.append(0, np.cumsum(kept))[words.first]
    joined = out.tobytes()
    return [joined[edges[a] : max(edges[a], edges[b] - 1)] for a, b in zip(rank, rank[1:])]


def periodic_runs(docs: DataFrame, min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    ``runs`` are all stretches of words with smallest period ``q`` (words ``q`` apart are
    identical) and at least ``min_words`` and ``min_periods * q`` words (four periods or more) that
    no neighbouring word extends, as ``start, length, period`` in words, by start, then
    period.  ``collapsed`` is the text without the words that any run contains after its
    first ``q`` words, the rest joined by one space.  Null and empty texts have no words, no
    runs and an empty ``collapsed``.  Texts of any length are read whole; a text is one row of
    one task and needs some tens of bytes for each of its words.  Repeated rows are treated alike, null ids are
    kept, an empty table gives no rows, and other columns are ignored.
    """
    if min_periods < MIN_PERIODS:
        raise ValueError(f"catchers report runs of at least {MIN_PERIODS} periods: {min_periods}")
    find_package(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for lo, hi, data, bounds in text_slices(batch):
                words = Words(data, bounds)
                kept = np.ones(len(words.starts), bool)
                runs: list[list[tuple]] = [[] for _ in range(hi - lo)]
                for begin, end, period in sorted(set(catch_runs(words.hashes(), words.first))):
                    if end - begin >= max(min_words, min_periods * period):
                        of = int(np.searchsorted(words.first, begin, "right")) - 1
                        runs[of].append((begin - int(words.first[of]), end - begin, period))
                        kept[begin + period : end] = False
                rows = [[dict(zip(("start", "length", "period"), r)) for r in one] for one in runs]
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(words.counts()), pa.array(rows, pa.list_(_RUN))]
                columns.append(pa.array([t.decode() for t in collapsed_texts(words, kept)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, _FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text, by a hash of its id, turned periodic from some word on.

    With ``h`` the crc32 of the id in decimal and ``g = h div 10``, each word ``i >= a`` becomes word
    ``a + (i - a) % p`` where ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``, if ``h % 10 = 0`` and the
    text has ``n > 0`` words.  Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    changed = F.expr(r"""
        transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w ->
          transform(array(struct(size(w) AS n, h div 10 AS g)), c ->
            transform(array(struct(c.g % c.n AS a, 1 + (c.n - c.g % c.n) div (3 + c.g % 8) AS p)), d ->
              array_join(transform(w, (word, i) -> if(i < d.a, word, w[cast(d.a + (i - d.a) % d.p AS int)])), ' '))[0])[0])[0]
    """)
    planted = F.when((F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    return rows.select("doc_id", planted.alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth made periodic."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    rank = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    top = F.array_min(rank)
    listing = F.concat(*[F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")])
    ended = F.when(F.size("runs") > 0, F.concat(listing, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), _digest(ended).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("top.start").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(-1000 * top.l) div top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
