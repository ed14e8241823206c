"""Token counts by a compiled finite-state transducer.

The vocabulary merges neighbouring symbols, best score first, whatever the pair
came from.  Two facts make that a finite-state job: a prefix of a tokenization is
the tokenization of that prefix, and a token sequence is the tokenization of its
text exactly if each neighbouring pair is.  So the last token of a prefix follows
from the last tokens of the few shorter prefixes that one vocabulary entry can
span.  These last tokens, and how many tokens each prefix has less than the
longest, are the state; reading a character leads to the next state and changes
the count by a fixed number.  Transitions are compiled when first used and kept.

No entry holds a word-start mark behind another character, so every run of marks
that begins a word leads to one and the same state, whatever came before.  A chunk
of text therefore acts on the incoming state as (head up to its first word, count,
tail from its last word on): such maps compose associatively, and a long text is
the product of its chunks' maps.  Whole words are read as one transition each,
compiled by the character transducer and kept up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import find_package, table, vocabulary

LIMIT = 4096  # tokens above which a document is over the limit
MARK = "▁"  # stands for a space
CHUNK = 1 << 15  # characters of a chunk
KEPT_WORDS = 300_000
KEPT_STATES = 400_000


class Transducer:
    """Counts tokens of words; states are numbers, transitions ``(next state, change of the count)``."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = (library.is_control, library.is_unknown, library.is_byte, library.is_unused)
        entries = [i for i in range(library.get_piece_size()) if not any(test(i) for test in skip)]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in entries}
        self.prefixes = {entry[:k] for entry in self.score for k in range(1, len(entry))}
        if any(MARK in entry.lstrip(MARK) for entry in self.score):
            raise ValueError("an entry holds a space behind another character; words are then not separate")
        if library.encode("a  b ", out_type=str)[:2] != [MARK + "a", MARK]:
            raise ValueError("the model changes white space; only plain replacement of spaces is compiled")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        #: A state: for each place from which a token could still reach beyond the text read so far, longest
        #: first, the characters since, the last token before it, and the tokens up to there less those of all.
        start = (("", None, 0),)
        self.numbers: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """Tokens of a short text, merged one by one."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: str | None, right: str) -> bool:
        """Whether ``right`` can follow ``left`` as a token."""
        if left is None:
            return self.merged(right) == [right]
        pair = (left, right)
        if pair not in self.pairs:
            if len(self.pairs) > KEPT_STATES:
                self.pairs.clear()
            self.pairs[pair] = self.merged(left + right) == [left, right]
        return self.pairs[pair]

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """Transition of a state by one character: the one token that fits behind its place ends the longer text."""
        for rest, last, before in self.states[state]:
            token = rest + char
            if (not rest or token in self.score) and self.fits(last, token):
                break
        else:
            raise AssertionError("a prefix without a last token")
        known = rest or char in self.score
        count = before + (1 if known else len(char.encode()))  # an unknown character counts a token a byte
        live = [(r + char, t, n - count) for r, t, n in self.states[state] if r + char in self.prefixes]
        key = (*live, ("", token, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][char] = (number, count)
        return number, count

    def count(self, word: str) -> int:
        """Tokens of a word, read from the start state."""
        if len(self.states) > KEPT_STATES:
            self.forget()
        state = total = 0
        moves = self.moves
        for char in word:
            move = moves[state].get(char) or self.compile(state, char)
            state = move[0]
            total += move[1]
        return total


class WordMoves(dict):
    """Tokens of whole words; a word that is missing is read by the transducer."""

    def __init__(self, path: str):
        super().__init__()
        self.transducer = Transducer(path)

    def __missing__(self, word: str) -> int:
        tokens = self.transducer.count(word)
        if len(self) < KEPT_WORDS:
            self[word] = tokens
        return tokens

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """Action of a chunk: head, tokens of the whole words between, tail; no number if no word starts in it.

        A word starts at a mark behind another character, so that runs of marks stay whole.
        """
        words = words_of(chunk)
        if len(words) == 1:
            return words[0], None, ""
        return words[0], sum(map(self.__getitem__, words[1:-1])), words[-1]

    def compose(self, left: tuple, right: tuple) -> tuple:
        """Action of two neighbouring chunks."""
        if right[1] is None and left[1] is None:
            return self.joined(left[0], right[0])
        if right[1] is None:
            head, n, tail = self.joined(left[2], right[0])
            return (left[0], left[1], head) if n is None else (left[0], left[1] + self[head] + n, tail)
        if left[1] is None:
            head, n, tail = self.joined(left[0], right[0])
            return (head, right[1], right[2]) if n is None else (head, n + self[tail] + right[1], right[2])
        head, n, tail = self.joined(left[2], right[0])
        middle = self[head] if n is None else self[head] + n + self[tail]
        return left[0], left[1] + middle + right[1], right[2]

    def joined(self, end: str, start: str) -> tuple:
        """Action of a piece that lies over a chunk boundary; a word may start exactly there."""
        if end and start and start[0] == MARK and end[-1] != MARK:
            return end, 0, start
        return end + start, None, ""

    def tokens(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.chunk_map(text[lo : lo + CHUNK]) for lo in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # neighbours are composed level by level, as in a parallel scan
            paired = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = paired + maps[len(maps) & ~1 :]
        head, n, tail = maps[0]
        return self[head] if n is None else (self[head] if head else 0) + n + self[tail]


def words_of(text: str) -> list[str]:
    """Text cut before each run of marks that follows another character."""
    if MARK * 2 in text or text.endswith(MARK):
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
    first, *rest = text.split(MARK)
    words = [MARK + w for w in rest]
    return [first, *words] if first else words


_compiled: dict[str, WordMoves] = {}


def compiled(path: str) -> WordMoves:
    if path not in _compiled:
        _compiled[path] = WordMoves(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text counts as empty.

    No shuffle: texts are read where they lie.
    """
    find_package(docs.sparkSession)

    @F.pandas_udf("bigint")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = compiled(path)
        for texts in parts:
            yield pd.Series([words.tokens(t) if t else 0 for t in texts], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
