"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: letter case, accents, look-alike letters of other scripts,
and digits or signs that stand for letters.  Entries match at word starts, so an
entry is a word or a stem.  A match inside an exception phrase (entry and a word
beside it) does not count.  The score is a logistic function of the matched weight,
as it is and per word of the text.

Everything is learned from labelled rows: stems and words that toxic texts hold far
more often, their log odds as weights, phrases around entries that occur only in
clean texts, and the logistic function.  Learning uses a sample of at most about
``SAMPLE`` labelled rows, chosen by a hash of the id; the lexicon is bounded by
``ENTRIES``.  Scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import find_package, released, table
from haulplan.staging import stage

SAMPLE = 20_000  # labelled rows that are learned from
ENTRIES = 400  # lexicon entries
PHRASES = 2_000  # exception phrases
STEMS = range(4, 9)  # lengths of stems that may become entries
LEAST = 0.004  # share of the toxic texts that must hold an entry, and 5 texts at least
ODDS = 2.5  # least log odds of an entry
CLEAN_TEXTS = 3  # texts that must hold an exception phrase

# Look-alike letters and what they stand for; then digits and signs used as letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n", "ω": "w", "ɡ": "g", "ı": "i", "ß": "ss",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "l": "i"}


class _Folding(dict):
    """Folding of a character, worked out when first met; other signs separate words."""

    def __missing__(self, code: int) -> str:
        out = ""
        for char in unicodedata.normalize("NFKD", chr(code).lower()):
            for low in LOOK_ALIKES.get(char, char):
                low = SUBSTITUTES.get(low, low)
                if low.isalnum():
                    out += low
                elif not unicodedata.combining(low) and low not in "​‌‍⁠﻿­":
                    out += " "
        self[code] = out
        return out


_folding = _Folding()


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    return (text or "").translate(_folding).split()


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the logistic function (intercept, then one slope a feature)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str]] = frozenset()
    slopes: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry in self.weights:
            found.add_word(" " + entry, entry)
        if self.weights:
            found.make_automaton()
        return found

    def matches(self, words: list[str], automaton) -> list[tuple[int, str]]:
        """Word number and entry of each match that no exception phrase covers; the longest entry of a word counts."""
        if not self.weights or not words:
            return []
        text, best = " " + " ".join(words), {}
        for end, entry in automaton.iter(text):
            start = end - len(entry)
            if len(entry) >= len(best.get(start, "")):
                best[start] = entry
        out, number, at = [], 0, 0
        for start in sorted(best):
            number += text.count(" ", at, start)
            at = start
            entry = best[start]
            sides = ((words[number - 1] if number else "", entry), (entry, words[number + 1] if number + 1 < len(words) else ""))
            if not any(side in self.exceptions for side in sides):
                out.append((number, entry))
        return out

    def features(self, words: list[str], automaton) -> tuple[float, float]:
        """Matched weight in all (log scale) and per 100 words."""
        total = sum(self.weights[entry] for _, entry in self.matches(words, automaton))
        return math.log1p(total), min(100 * total / max(len(words), 20), 30.0)

    def scores(self, texts: Iterator[str | None]) -> list[float]:
        automaton = self.automaton()
        rows = np.array([(1.0, *self.features(fold(t), automaton)) for t in texts]).reshape(-1, 3)
        return (1 / (1 + np.exp(-np.clip(rows @ np.array(self.slopes), -500, 500)))).tolist()


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of about ``sample`` labelled rows, texts distinct; ids repeated with both labels are left out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.where(~held_out())
    total = max(1, usable.count())
    lot = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    chosen = usable.where(lot < F.lit(sample * 1_000_000 // total))
    chosen = chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    # about `sample` rows of two numbers, whatever the tables' size
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    texts = rows.groupBy(F.xxhash64("text"), F.length("text")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return stage(texts.select("text", "toxic"), "labelled")


def _counted(sample: DataFrame, keys_of) -> DataFrame:
    """``key``, and the clean and toxic texts that hold it; each task counts first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean, toxic = Counter(), Counter()

        def rows() -> pd.DataFrame:
            keys = list(clean.keys() | toxic.keys())
            out = pd.DataFrame({"key": keys, "clean": [clean[k] for k in keys], "toxic": [toxic[k] for k in keys]})
            clean.clear(), toxic.clear()
            return out.astype({"key": "str", "clean": "int64", "toxic": "int64"})

        for frame in frames:
            for text, label in zip(frame["text"], frame["toxic"]):
                (toxic if label else clean).update(keys_of(text))
                if len(clean) + len(toxic) > 400_000:
                    yield rows()
        yield rows()

    counted = sample.repartition(16).mapInPandas(count, "key string, clean bigint, toxic bigint")
    return counted.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _keys(text: str) -> set[str]:
    """Words of a text and their stems."""
    words = set(fold(text))
    stems = {w[:n] for w in words for n in STEMS if len(w) > n}
    return stems | {w for w in words if 3 <= len(w) <= 24}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Lexicon from the labelled rows that are not held out; without toxic rows it is empty and scores are low."""
    find_package(docs.sparkSession)
    rows = labelled_sample(docs, labels, sample)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon()
    least = max(min(5, toxic), LEAST * toxic)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    keys = _counted(rows, _keys).withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") >= ODDS))
    keys = keys.orderBy((F.col("odds") * F.col("toxic")).desc(), F.length("key"), "key").limit(10 * ENTRIES).collect()
    lexicon = Lexicon(_choose([(r["key"], r["toxic"], r["odds"]) for r in keys]))

    def phrases(text: str) -> set[str]:
        words = fold(text)
        found = lexicon.matches(words, lexicon.automaton()) if lexicon.weights else []
        return {f"{w} <{e}" for n, e in found for w in words[max(0, n - 1) : n]} | {f"{e}> {w}" for n, e in found for w in words[n + 1 : n + 2]}

    spared = _counted(rows, phrases).where((F.col("toxic") == 0) & (F.col("clean") >= CLEAN_TEXTS))
    pairs = set()
    for r in spared.orderBy(F.col("clean").desc(), "key").limit(PHRASES).collect():
        one, two = r["key"].split(" ")
        pairs.add((one, two[1:]) if two.startswith("<") else (one[:-1], two))
    lexicon.exceptions = frozenset(pairs)
    lexicon.slopes = _fit(rows, lexicon)
    return lexicon


def _choose(keys: list[tuple[str, int, float]]) -> dict[str, float]:
    """Entries in order of weight of evidence; what starts with an entry of almost its odds adds nothing, nor does
    a stem whose texts an entry below it holds almost alone."""
    chosen: dict[str, tuple[int, float]] = {}
    for key, texts, odds in keys:
        if any(key.startswith(e) and odds <= o + 0.5 for e, (_, o) in chosen.items()):
            continue
        if any(e.startswith(key) and texts <= 1.1 * n for e, (n, _) in chosen.items()):
            continue
        chosen[key] = (texts, odds)
        if len(chosen) == ENTRIES:
            break
    return {key: odds for key, (_, odds) in chosen.items()}


def _fit(rows: DataFrame, lexicon: Lexicon) -> tuple[float, ...]:
    """Logistic regression on the sample's features (three numbers a row), by Newton steps with a small ridge."""

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for frame in frames:
            x = np.array([lexicon.features(fold(t), automaton) for t in frame["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "toxic": frame["toxic"].to_numpy(np.float64)})

    data = rows.repartition(16).mapInPandas(features, "a double, b double, toxic double").toPandas()
    data = data.sort_values(["a", "b", "toxic"])  # sums in a fixed order
    x, y = np.column_stack([np.ones(len(data)), data["a"], data["b"]]), data["toxic"].to_numpy()
    w, ridge = np.zeros(3), np.diag([1e-3, 0.5, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``score`` in [0, 1], higher for toxic; a null or empty text scores as one without matches.

    Only the text is read; a column named score is replaced.
    """
    find_package(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in released(parts):
            yield pd.Series(lexicon.scores(texts), dtype="float64")

    return docs.withColumn("score", scored(F.col("text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
