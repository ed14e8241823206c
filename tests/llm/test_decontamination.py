"""Benchmark decontamination against a search for every window in every text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from haulplan.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
chance = random.Random(13)
VOCABULARY = ["Ab", "ça", "d", "E9", "日本", "x-y", "z.", "q"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def prose(count, vocabulary=VOCABULARY):
    return " ".join(chance.choice(vocabulary) + chance.choice(["", "", ",", "\n"]) for _ in range(count))


LONG = prose(9000, [f"w{i}" for i in range(900)])
ITEMS = [(i, prose(chance.randrange(11, 40))) for i in range(25)]
ITEMS += [(100, "only three words"), (101, "Z"), (102, ""), (103, None), (104, "!!"), (105, LONG), (106, ITEMS[0][1]), (0, ITEMS[1][1]), (None, "nameless item of four")]
ITEMS += [(107, "aa " * 30), (108, "bb cc dd ee ff gg hh ii"), (109, "gg hh")]
DOCS = [(None, None), (1, ""), (2, " \n"), (3, LONG[5000:30000]), (4, "aa " * 25), (5, "so ONLY three\nWords, here"), (6, "a nameless item of four"), (7, "bb cc dd ee ff gg hh jj gg hh ii")]
DOCS += [(8, ITEMS[0][1]), (8, ITEMS[0][1]), (8, "clean text"), (None, "start " + ITEMS[3][1] + " end")]
DOCS += [(10 + i, prose(chance.randrange(0, 60)) + " " + " ".join(words(ITEMS[chance.randrange(25)][1])[: chance.randrange(7, 14)]) + " " + prose(5)) for i in range(60)]
DOCS += [(200, prose(60000))]


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for window in [tuple(w[i : i + 10]) for i in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []:
            windows.setdefault(window, set()).add(name)
    widths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in widths:
            for i in range(len(w) - size + 1):
                names = windows.get(tuple(w[i : i + size]))
                if names:
                    found |= names
                    hit.update(range(i, i + size))
        ids = sorted(str(n) for n in found if n is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    extra = {c: F.lit(7) for c in ("spans", "items", "n_words", "text_class", "block")}
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumns(extra).repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumns(extra).repartition(2)


def table_of(docs, items, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_query_equals_brute_force(spark, tables, tmp_path):
    rows = decontamination.query(spark, table_of(*tables, tmp_path)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("block_words", [2500])
def test_blocks_give_the_same(tables, block_words):
    docs, items = tables
    rows = decontamination.contamination(docs, items, block_words=block_words).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in rows]
    assert sorted(got, key=str) == brute(DOCS, ITEMS)
    for r in rows:
        assert all(a.end <= b.first for a, b in zip(r.spans, r.spans[1:]))


def test_spans_are_cut(tables):
    docs, items = tables
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert (None, None) in texts and (8, "clean text") in texts and (1, "") in texts
    assert not any(d == 4 for d, _ in texts)  # covered as a whole
    assert (5, "so , here") not in texts  # three of five words are hit
    assert (6, "a ") not in texts
    assert (5, "so , here") in {(r.doc_id, r.text) for r in decontamination.decontaminate(docs, items, max_coverage=0.7).collect()}


def test_empty_tables(spark, tables):
    docs, items = tables
    assert decontamination.contamination(docs.limit(0), items).collect() == []
    rows = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.n_hit or r["items"] for r in rows)
    assert decontamination.decontaminate(docs, items.limit(0)).count() == len(DOCS)
