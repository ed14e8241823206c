"""The ten operators against brute force, on small tables with odd rows."""

import hashlib
import json
import math
import random
import re
import textwrap
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from haulplan.llm import exact_substrings, licenses, line_rules, mixing, near_passages, packing, queries, simhash, token_counts, toxicity, vector_search
from haulplan.llm.common import vocabulary
from haulplan.llm.components import components

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the test tables")

chance = random.Random(4)
SYLLABLES = ["ta", "ro", "ne", "li", "éa", "ß", "mu", "ki", "ox", "日", "the", "ing"]


def prose(words):
    return " ".join("".join(chance.choice(SYLLABLES) for _ in range(chance.randrange(1, 5))) + chance.choice(["", "", ",", ".\n", "  x"]) for _ in range(words))


BASE = prose(400)
TEXTS = [None, "", "   ", "a", "\n\n", BASE, BASE, BASE[:1500] + prose(30), prose(30) + BASE[900:2000], prose(3000), "for " * 300, "x" * 1500, "<|endoftext|> <s> 1d10t"]
TEXTS += [prose(chance.randrange(1, 90)) for _ in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with repeated and null ids, null sources and columns with clashing names."""
    rows = [(i if i != 3 else None, t, chance.choice(["s1", "s2", "s3", None])) for i, t in enumerate(TEXTS)]
    rows += [rows[9], rows[9], (500, TEXTS[5], "s1")]
    extra = ["size", "score", "taken", "class", "key", "first", "block", "bits", "row", "length", "spans"]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(7) for c in extra}).repartition(3)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_packing(spark, docs):
    pieces = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"), keep_ids=True)
    rows = packing.pack(pieces, ["doc_id", "piece", "ids_crc32"]).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in pairs(docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((doc, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for members in filled.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("counts", [{}, {1: 5}, {1024: 3}, {600: 10, 400: 10, 24: 10}, {700: 5, 130: 40, 7: 100}])
def test_packing_plan(counts):
    plan = packing.make_plan(counts)
    total, biggest = sum(s * n for s, n in counts.items()), sum(n for s, n in counts.items() if s > 512)
    assert max(biggest, -(-total // 1024)) <= plan.sequences <= max(biggest, -(-total // 1024)) + 2


@pytest.fixture(scope="module")
def notices(spark):
    """Notices as lines, inside lines, wrapped, in comments, with other words, cut off, and beside odd rows."""
    mit, mpl, gpl = (licenses.TEMPLATES[k] for k in ("MIT-text", "MPL-2.0", "GPL-3.0-or-later"))
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(mpl, 40))
    changed = " ".join("other" if n % 25 == 7 else w for n, w in enumerate(gpl.split()))
    rows = [(1, "Released under the MIT License."), (2, "text\nLICENSED under the apache license, version 2.0\n\nmore"), (None, None), (3, ""), (3, "\n"),
            (4, "Licensed under CC BY-NC 4.0. " * 3), (5, "released under MIT License"), (6, "one"), (7, prose(40) + "\n/*\n" + wrapped + "\n*/\n" + prose(40)),
            (8, prose(30) + " " + licenses.TEMPLATES["MIT"] + " " + prose(30)), (9, prose(20) + "\n" + "\n".join(textwrap.wrap(changed, 60)) + prose(20)),
            (10, prose(2000) + "\nCopyright 2020 A. Nobody\n" + "\n".join(textwrap.wrap(mit, 70)) + "\n" + prose(2000)), (11, mpl[25:]), (12, mpl[:-30]),
            (13, "released under the " * 50 + "MIT License"), (1, "Released under the MIT License.")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_licenses(spark, notices):
    db = duckdb.connect()
    documents = notices.toPandas()  # noqa: F841
    db.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM documents")
    clashing = {c: F.lit(7) for c in ("size", "license", "line", "word", "anchor", "pairs", "at", "near", "template", "length", "offset", "first")}
    got = licenses.scan(notices.withColumns(clashing).repartition(3)).collect()
    assert ordered((r.doc_id, r.line, r.word, r.license, round(r.dice, 9)) for r in got) == ordered(
        (a, b, w, c, round(d, 9)) for a, b, w, c, d in db.execute(f"SELECT doc_id, line, word, license, dice FROM ({licenses.ORACLE})").fetchall()
    )
    found = {(r.doc_id, r.license) for r in got}
    assert found >= {(1, "MIT"), (2, "Apache-2.0"), (7, "MPL-2.0"), (8, "MIT"), (9, "GPL-3.0-or-later"), (10, "MIT-text"), (10, "MIT-notice"), (11, "MPL-2.0"), (12, "MPL-2.0"), (13, "MIT")}
    assert not any(r.doc_id in (3, 6, None) for r in got)
    assert sum(r.doc_id == 1 for r in got) == 4  # two equal rows, each as a line and as a window
    assert licenses.scan(notices.where("false")).count() == 0
    assert licenses.scan(notices, {}).count() == 0 and licenses.scan(notices, {"x": "word"}).count() == 0


def test_licenses_of_many_templates(spark, notices, monkeypatch):
    want = ordered(licenses.scan(notices).collect())
    monkeypatch.setattr(licenses, "MOST_LISTED", 0)
    monkeypatch.setattr(licenses, "MOST_SENT", 0)
    assert ordered(licenses.scan(notices).collect()) == want


def test_licenses_miss_no_window(spark):
    """Windows that reach the coefficient hold an anchor: all starts of a changed notice against the scan."""
    names = ("MPL-2.0", "GPL-3.0-or-later", "ISC-text")
    words = lambda text: [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]
    grams = lambda w: {(a, b) for a, b in zip(w, w[1:])}
    texts = []
    for name in names:
        for rate in (0.02, 0.05, 0.08):
            texts.append(" ".join("changed" if chance.random() < rate else w for w in words(licenses.TEMPLATES[name])))
    texts = [prose(15).lower() + " " + t + " " + prose(15) for t in texts]
    want = set()
    for d, text in enumerate(texts):
        w = words(text)
        for name in names:
            whole = words(licenses.TEMPLATES[name])
            b = grams(whole)
            for start in range(len(w) - len(whole) + 1):
                part = grams(w[start : start + len(whole)])
                aligned = any(w[start + k : start + k + 2] == whole[k : k + 2] for k in range(len(whole) - 1))
                if aligned and 2 * len(part & b) / (len(part) + len(b)) >= licenses.DICE and w[start : start + 2] == whole[:2]:
                    want.add((d, name, start))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), {n: licenses.TEMPLATES[n] for n in names})
    assert len(want) >= 4
    assert {(r.doc_id, r.license, r.word) for r in rows.where("line = -2").collect()} >= want


def test_toxicity(spark):
    bad = ["idiot", "1d1ot", "IDIOT", "lowerxa", "lowerqu"]
    rows = [(i, prose(60) + (" " + " ".join(chance.choice(bad) for _ in range(4)) if i % 4 == 0 else "")) for i in range(400)]
    rows += [(None, None), (900, ""), (901, "идiот"), (902, "x " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(None, 0, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    scored = toxicity.score(frame, toxicity.learn(frame, labels)).select("doc_id", toxicity.held_out().alias("held"), "score").collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    judged = [r for r in scored if r.held and r.doc_id is not None and r.doc_id < 400]
    assert judged and sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in judged) >= 0.97 * len(judged)
    assert toxicity.learn(frame, labels.where("false")).weights == {}


def removed(rows, length=400):
    seen, texts = Counter(), [(t or "").encode() for _, t in rows]
    for b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for (doc, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        yield doc, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


def test_exact_substrings(spark, docs):
    kept = exact_substrings.remove_repeats(docs)
    got = kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), "kept_sha256").collect()
    assert ordered(got) == ordered(removed(pairs(docs)))
    assert exact_substrings.remove_repeats(docs.where("false")).count() == 0


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(pairs(docs)) and all(r.size == len(WORD.findall(r.text or "")) for r in rows)
    assert all(r.taken == r.size * len(r.shards) <= 2 * r.size for r in rows)
    sources = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * sum(s for s, _ in sources.values()))
    for source, (size, target) in sources.items():
        own = [r for r in rows if r.source == source]
        alike = Counter()  # rows with one id and size share their fate
        for r in own:
            alike[r.doc_id, r.size] += r.size
        assert target <= 2 * size and abs(sum(r.taken for r in own) - target) <= max(alike.values())
    again = mixing.mix(docs.repartition(5)).collect()
    assert ordered((r.doc_id, r.text, r.taken, r.shards) for r in rows) == ordered((r.doc_id, r.text, r.taken, r.shards) for r in again)
    assert mixing.mixture(docs).count() == sum(len(r.shards) for r in rows)


def test_splitting_tree_adds_up(spark):
    quotas = spark.createDataFrame([(0, 900), (1, 35), (2, 1), (3, 0)], "rank int, draws bigint")
    leaves = mixing.splitting_tree(spark, quotas, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in leaves:
        assert r.quota >= 0
        by_source[r.rank] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == Counter({0: 900, 1: 35, 2: 1, 3: 0}) and set(by_shard.values()) == {117}


def test_vector_search(spark):
    vectors = [(i, [chance.uniform(-1, 1) for _ in range(37)]) for i in range(300)]
    vectors += [(20, vectors[7][1]), (None, vectors[3][1]), (301, None), (302, [None, 1.0]), (303, [float("nan")] * 37), (304, []), (320, [1.0] * 5)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("row", F.monotonically_increasing_id())
    table = vector_search.stage(table, "vectors")
    got = vector_search.top_k(table, table.where("vec_id % 20 = 0"), 20).collect()
    usable = [(i, np.floor(64 * np.array([np.float32(x) for x in v], float)).astype(int)) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for k, (query, q) in enumerate(usable):
        if query is not None and query % 20 == 0:
            scores = [(-int((q[: len(v)] * v[: len(q)]).sum()), i is None, i or 0, i) for j, (i, v) in enumerate(usable) if j != k]
            want += [(query, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:20], 1)]
    assert ordered(got) == ordered(want)
    assert vector_search.top_k(table, table.where("false")).count() == 0
    assert vector_search.top_k(table.where("false"), table).count() == 0


@pytest.mark.parametrize("largest", [1e9, 3e38, 1e300])
def test_vector_search_of_large_components(spark, largest):
    """One outlier among usual values, equal vectors, and scores that no long holds."""
    vectors = [[chance.uniform(-1, 1) for _ in range(12)] for _ in range(90)]
    for n in (3, 20, 40, 41):
        vectors[n][n % 12] = largest * (-1) ** n
    vectors[60] = vectors[20]
    rows = [(i, v, 7) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int").withColumn("row", F.monotonically_increasing_id())
    table = vector_search.stage(table, "vectors")
    got = vector_search.top_k(table, table.where("vec_id % 20 = 0"), 7).collect()
    whole = [[math.floor(64 * Fraction(x)) for x in v] for v in vectors]
    want = []
    for q in range(0, 90, 20):
        scores = sorted((-sum(x * y for x, y in zip(whole[q], v)), c) for c, v in enumerate(whole) if c != q)
        want += [(q, rank, c, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, c) in enumerate(scores[:7], 1)]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("scale", [1, 1e7])
def test_vector_search_keeps_ties_and_prunes(scale):
    """Few heavy dimensions: survivors are followed one query at a time, with exact sums and without."""
    draw = np.random.default_rng(5)
    matrix = np.floor(64 * scale * draw.normal(size=(40, 700)) * np.where(np.arange(40) < 8, 1, 0.02)[:, None]) / 64
    matrix[:, 300:310] = matrix[:, :1]
    same = np.arange(0, 700, 7)
    whole = (64 * matrix).astype(np.int64).astype(object)
    scores = whole[:, same].T @ whole
    scores[np.arange(len(same)), same] = -(10**30)
    least = np.sort(scores, axis=1)[:, -5].astype(float) * (1 - 1e-9) - 1
    for threshold in (None, least):
        for n, (found, values) in enumerate(vector_search.best_of_blocks(matrix[:, same], matrix, same, 5, threshold, 4)):
            floor = sorted(scores[n])[-5]
            got = dict(zip(found.tolist(), values))
            assert {c: v for c, v in got.items() if v >= floor} == {c: v for c, v in enumerate(scores[n]) if v >= floor}


def counted(text):
    words, lines, seen, again = WORD.findall(text or ""), (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if often[gram] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_line_rules(spark, docs):
    common = "Subscribe to the  newsletter 2024 and share this page with all friends"
    extra = spark.createDataFrame([(1000 + i, f"{common.upper() if i % 2 else common}\n{common}\nown words {i} " + (prose(80) if i < 30 else "x"), "s9") for i in range(40)], "doc_id bigint, text string, source string")
    frame = docs.unionByName(extra, allowMissingColumns=True)
    rows = line_rules.judge(frame).collect()
    facts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert ordered((r.doc_id, *(r[f] for f in facts)) for r in rows) == ordered((d, *counted(t)) for d, t in pairs(frame))
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    verdict = {r.doc_id: r.kept for r in rows if not r.base_failed}
    assert all(verdict[1000 + i] for i in range(30) if 1000 + i in verdict) and not any(verdict.get(1000 + i) for i in range(30, 40))


def test_near_passages(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    edited = passage.replace("w30", "changed")
    rows = [(i, f"{prose(70)} {passage if i % 2 else edited} {prose(70)}") for i in range(12)]
    rows += [(50, prose(200)), (51, passage), (52, passage), (53, f"{passage} {prose(90)} {passage}"), (60, None), (61, ""), (62, "a b"), (None, prose(300))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"class": F.lit(1), "key": F.lit(2)}).repartition(3)
    found = {r.doc_id: r for r in near_passages.near_duplicate_passages(frame).collect()}
    assert len(found) == len(rows) and not found[50].spans and not found[60].spans and not found[62].spans and not found[None].spans
    assert found[52].class_id == 51 and found[52].spans[0].end == found[52].n_bytes
    holders = [*range(12), 51, 53]
    whole = [i for i in holders if not any(s.end - s.begin >= 0.9 * len(passage) for s in found[i].spans)]
    assert len(whole) == 1
    kept = near_passages.cut_passages(frame, near_passages.near_duplicate_passages(frame)).collect()
    assert sum((r.text or "").count("w10 w11 w12") for r in kept) == 1


def test_near_passages_around_frequent_lines(spark):
    """Copies are found although the smallest shingles of their passage stand in unrelated texts too."""
    own = random.Random(11)
    fresh = lambda n: [f"{own.getrandbits(40):x}" for _ in range(n)]
    rows, planted = [], []
    for k in range(20):
        passage = fresh(50)
        data = np.frombuffer(" ".join(passage).encode(), np.uint8)
        words = near_passages.Words(data, np.array([0, len(data)]))
        shingles = near_passages.windows(words.hashes(), words.first, near_passages.SHINGLE)[1]
        frequent = {int(np.argmin(near_passages.mix(shingles + seed))) for seed in near_passages._SEEDS[: near_passages.HASHES]}
        for at in frequent:
            rows += [" ".join(fresh(30) + passage[at : at + 5] + fresh(n)) for n in (2, 20, 30, 40, 50, 60) for _ in range(2)]
        second = list(passage)
        if k % 2:  # similarity 41 of 51 shingles
            second[next(w for w in range(10, 40) if not any(at <= w < at + 5 for at in frequent))] = "changed"
        pair = [" ".join(fresh(60) + p + fresh(60)) for p in (passage, second)]
        planted.append((len(rows), len(rows) + 1, [len(" ".join(p).encode()) for p in (passage, second)]))
        rows += pair
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in near_passages.near_duplicate_passages(frame).collect()}
    later = [(a, sizes[0]) if found[a].text_class > found[b].text_class else (b, sizes[1]) for a, b, sizes in planted]
    cut = [sum(s.end - s.begin for s in found[doc].spans) >= 0.9 * size for doc, size in later]
    assert sum(cut) == len(cut)  # brute force finds each of them
    holders = {doc for doc, _ in later}
    assert not any(r.spans for r in found.values() if r.doc_id not in holders)


def test_token_counts(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t in pairs(docs)]
    assert ordered(got) == ordered(want)


def test_token_counts_of_chunks():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library, words, whole = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.compiled(path), token_counts.CHUNK
    parts = [" ", "  ", "▁", "a", "the", "lly", "\n", "é", "日", "😀", "\x00", "aaaa", "ﬁ", "<s>"]
    try:
        for token_counts.CHUNK in (1, 3, 7, whole):
            for _ in range(300):
                text = "".join(chance.choice(parts) for _ in range(chance.randrange(25)))
                assert words.tokens(text) == len(library.encode(text)), text
    finally:
        token_counts.CHUNK = whole


def test_simhash(spark, docs):
    import xxhash

    def bits(text):
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = simhash.near_duplicates(docs).collect()
    prints = [(d, bits(t)) for d, t in pairs(docs)]
    assert ordered((r.doc_id, r.bits % 2**64) for r in rows) == ordered(prints)
    distinct = sorted({b for _, b in prints})
    group = {b: b for b in distinct}
    for _ in distinct:
        group = {b: min(group[c] for c in distinct if (b ^ c).bit_count() <= 2) for b in distinct}
    first = {g: min((d for d, b in prints if group[b] == g and d is not None), default=None) for g in group.values()}
    assert all(r.component_id == first[group[r.bits % 2**64]] for r in rows)


def test_simhash_links_of_dense_groups(spark):
    """A large group of near fingerprints is linked as completely as by comparing all pairs."""
    base = chance.getrandbits(64)
    values = {base ^ sum(1 << chance.randrange(64) for _ in range(chance.randrange(6))) for _ in range(700)}
    values |= {base ^ chance.getrandbits(12) for _ in range(700)} | {chance.getrandbits(64) for _ in range(300)}
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "bits bigint")
    roots = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(frame)).collect()}
    array = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 2
    labels = np.arange(len(array))
    while True:
        new = np.array([labels[row].min() for row in near])
        if (new == labels).all():
            break
        labels = new
    got = defaultdict(set)
    for v in values:
        got[roots.get(v, v)].add(v)
    want = defaultdict(set)
    for v, label in zip(array.tolist(), labels):
        want[label].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 51)}, 100: 0, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    from check_oracle import rows_of

    db = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame, result = queries.QUERIES[name](spark, SF_DIR), db.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(0 <= r.offset and r.offset + r.length <= 1024 for r in rows)
    assert json.dumps(rows[0].asDict(), default=str)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, two texts under one id, clashing names."""
    long = prose(9000)
    near = prose(200)
    rows = [(None, None, None, None), (None, near, "s1", 5), (None, near, "s1", 5), (1, near, "s1", 5), (2, "", None, 0), (3, long, "s2", 9), (3, "another text " + prose(30), "s2", 9), (4, BASE, "s1", 1), (4, BASE, "s1", 1), (5, BASE + " tail", None, 2)]
    names = ["spans", "_class", "_doc", "shard", "use", "_block", "size", "score", "place", "taken", "component", "text_class", "key", "links", "_key", "lang"]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").withColumns({c: F.lit(70) for c in names}).repartition(3)


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline as pipe

    docs = odd_documents(spark)
    rows = {}
    kept = docs
    for name, step in pipe.STAGES[:4]:
        kept = step(spark, kept, SF_DIR)
        assert kept.columns == docs.columns
        rows[name] = kept.collect()
        assert all(r["size"] == 70 and r.score == 70 and r.shard == 70 and r["_class"] == 70 for r in rows[name])
        kept = spark.createDataFrame(rows[name], docs.schema)
    assert len(rows["toxicity"]) == 10
    single = sorted(((r.doc_id, len(r.text or "")) for r in rows["near_duplicates"]), key=str)
    # The null text is one with the empty one; copies without an id go for the one that has one; both texts of id 3 stay.
    assert [d for d, _ in single].count(3) == 2 and [d for d, _ in single].count(4) == 1 and None not in [d for d, _ in single] and 1 in [d for d, _ in single]
    assert all((r.n_chars or 0) == len(r.text or "") for r in rows["repeated_passages"])
    pieces = pipe.pack_sequences(spark, kept, SF_DIR).collect()
    assert sum(r.length for r in pieces) > 0


def test_pipeline_on_no_documents(spark):
    import corpus_pipeline as pipe

    docs = odd_documents(spark).limit(0)
    for name, step in pipe.STAGES:
        assert step(spark, docs, SF_DIR).collect() == [], name
