"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulplan.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
chance = random.Random(12)


def brute_runs(words):
    """``start, length, period`` of all runs."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        same = [a == b for a, b in zip(words, words[q:])] + [False]
        begin = None
        for i, equal in enumerate(same):
            if equal and begin is None:
                begin = i
            if not equal and begin is not None:
                length = i - begin + q
                part = words[begin : begin + length]
                if length >= max(6, 4 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                    out.append((begin, length, q))
                begin = None
    return sorted(out)


def brute(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc, len(runs), *best, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def prose(count, vocabulary=("ab", "ça", "日本", "d")):
    return " ".join(chance.choice(vocabulary) + chance.choice(["", "", "\n"]) for _ in range(count))


def periodic(period, count):
    unit = [f"u{chance.randrange(5)}" for _ in range(period)]
    return " ".join(unit[i % period] for i in range(count))


DOCS = [(None, None), (None, prose(50)), (0, ""), (1, " \n\t"), (2, "for " * 300), (2, "for " * 300), (3, "a b " * 2), (4, "a a a a a"), (5, "a a a a a a")]
DOCS += [(10 + i, " ".join([prose(chance.randrange(0, 30)), periodic(chance.randrange(1, 40), chance.randrange(1, 300)), prose(chance.randrange(0, 30))])) for i in range(60)]
DOCS += [(100 + i, prose(chance.randrange(1, 200))) for i in range(80)]
DOCS += [(300, periodic(700, 3000)), (301, periodic(3, 40) + " " + periodic(6, 60) + " " + periodic(4, 200))]


def test_query_equals_brute_force(spark, tmp_path):
    extra = {c: F.lit(7) for c in ("h", "runs", "n_words", "collapsed", "top")}
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumns(extra).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = periodic_runs.query(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted((brute(*d) for d in DOCS), key=str)
    assert sum(r.n_runs for r in rows) > 60
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.integers(1, 5))
def test_catchers_find_every_run(texts, times):
    texts = [t * times for t in texts]
    first = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    values = np.array([w for t in texts for w in t], np.uint64)
    found = [(b, e - b, q) for b, e, q in set(periodic_runs.catch_runs(values, first)) if e - b >= max(6, 4 * q)]
    want = [(int(first[k]) + s, length, q) for k, t in enumerate(texts) for s, length, q in brute_runs(t)]
    assert sorted(found) == sorted(want)


def test_very_long_text(spark):
    """A text above the size of a slice, periodic over hundreds of thousands of words."""
    unit = [str(i) for i in range(60000)]
    text = " ".join(["x", *(unit * 5), "y"])
    docs = spark.createDataFrame([(1, text), (2, "b " * 200000)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in rows[1].runs] == [(1, 300000, 60000)] and rows[1].collapsed == " ".join(["x", *unit, "y"])
    assert [tuple(r) for r in rows[2].runs] == [(0, 200000, 1)] and rows[2].collapsed == "b"


def test_fewer_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string"), min_periods=2)
