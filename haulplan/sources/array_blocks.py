"""JSON arrays of any size and form, read in splits that need not end with a line.

A file is split and cut into pieces behind every ``}``, wherever it stands.  What a split does to
a reader's state, inside a string or not and how many brackets deep, is a small map,
known without the state itself: both cases are counted.  The maps of a file's splits
compose by running sums over one row per split; then every split knows its state and its byte
offset, and cuts the text behind each object of the outer array.  Between two
such cuts stands ``, element, ..., {object}``; with brackets put around, the JSON parser
checks it.  The whole text is an array exactly if the first cut text opens one, the
last closes it, and all of them parse, so the grammar does not depend on size or splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulplan.staging import stage

#: Bytes of text that are parsed together, about.
GROUP_BYTES = 1 << 18

_QUOTE, _ESCAPE, _CLOSE = 34, 92, 125
_STEPS = np.zeros(256, np.int64)
_STEPS[np.frombuffer(b"[{", np.uint8)] = 1
_STEPS[np.frombuffer(b"]}", np.uint8)] = -1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """First row and bytes of each run of rows of one split, with the ``}`` that ends a piece."""
    pieces = pc.binary_join_element_wise(batch.column("value"), pa.scalar(b"", batch.column("value").type), pa.scalar(b"}", batch.column("value").type))
    kind = np.int64 if pa.types.is_large_binary(pieces.type) else np.int32
    offsets = np.frombuffer(pieces.buffers()[1], kind)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8)
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    new = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(pieces)]):
        yield a, data[offsets[a] : offsets[b]]


def _inside(data: np.ndarray) -> np.ndarray:
    """0 or 1 for each byte: whether it stands in a string, for a text that begins outside of one."""
    escapes = data == _ESCAPE
    quotes = data == _QUOTE
    if escapes.any():
        place = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(escapes, -1, place))
        odd = (place - plain) % 2 == 1  # of the escapes up to here an odd number in a row
        quotes[1:] &= ~(escapes[:-1] & odd[:-1])
    return np.cumsum(quotes) & 1


def split_maps(lines: DataFrame) -> DataFrame:
    """``file, block, size, bytes, flips, outside, within``: length of a split, whether it leaves the other side
    of a string, and the brackets it opens more than it closes if it begins outside or within a string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "size", "bytes", "flips", "outside", "within"]
        key, total = None, (0, 0, 0, 0)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*key, *total)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for at, data in _runs(batch):
                own = tuple(batch.column(c)[at].as_py() for c in ("file", "block", "size"))
                if own != key:
                    if key is not None:
                        yield row()
                    key, total = own, (0, 0, 0, 0)
                inside = _inside(data)
                steps = _STEPS[data]
                out, within = int(steps[inside == 0].sum()), int(steps[inside == 1].sum())
                seen, flips, depth, depth_within = total
                if flips:
                    out, within = within, out
                total = (seen + len(data), flips ^ int(inside[-1]), depth + out, depth_within + within)
        if key is not None:
            yield row()

    schema = "file bigint, block bigint, size bigint, bytes bigint, flips bigint, outside bigint, within bigint"
    return lines.select("file", "block", "size", "value").mapInArrow(read, schema)


def split_states(maps: DataFrame) -> DataFrame:
    """``file, block, mode, depth, offset, last, whole``: the state at the begin of each split, one row per split."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")

    def before(value: Column | str) -> Column:
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    entered = maps.withColumn("mode", before("flips") % 2)
    return entered.select(
        "file",
        "block",
        "mode",
        before(F.when(F.col("mode") == 0, F.col("outside")).otherwise(F.col("within"))).alias("depth"),
        before("bytes").alias("offset"),
        (F.col("block") == F.max("block").over(every)).alias("last"),
        # Every piece counts with its }, which the last one must not have.
        (F.sum("bytes").over(every) == F.col("size") + 1).alias("whole"),
    )


def cut_texts(lines: DataFrame, states: DataFrame) -> DataFrame:
    """``file, offset, starts, ends, final, text``: texts between objects of the outer array.

    A text that a split boundary cuts has no begin or no end; its parts follow one another.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "starts", "ends", "final", "text"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
        key, last, rest = None, False, []
        mode = depth = offset = 0
        starts = True

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        def leave() -> list[tuple]:
            text = b"".join(rest)
            text = text[:-1] if last else text
            return [(key[0], offset, starts, last, last, text)] if text or last else []

        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[tuple] = []
            for at, data in _runs(batch):
                own = tuple(batch.column(c)[at].as_py() for c in ("file", "block"))
                if own != key:
                    found += leave() if key is not None else []
                    key, rest = own, []
                    mode, depth, offset, last = (batch.column(c)[at].as_py() for c in ("mode", "depth", "offset", "last"))
                    starts = offset == 0 or (mode == 0 and depth == 1)
                inside = _inside(data) ^ mode
                depths = depth + np.cumsum(np.where(inside == 0, _STEPS[data], 0))
                ends = np.flatnonzero((data == _CLOSE) & (inside == 0) & (depths == 1)) + 1
                mode, depth = int(inside[-1]), int(depths[-1])
                begin = 0
                while len(ends) and begin < ends[-1]:
                    # The first text may have begun before; others are taken together.
                    end = int(ends[0]) if not begin else int(ends[max(np.searchsorted(ends, begin + GROUP_BYTES, "right") - 1, np.searchsorted(ends, begin, "right"))])
                    text = b"".join([*rest, data[begin:end].tobytes()])
                    found.append((key[0], offset, starts, True, False, text))
                    offset, starts, rest, begin = offset + len(text), True, [], end
                if begin < len(data):
                    rest.append(data[begin:].tobytes())
            yield rows(found)
        if key is not None:
            yield rows(leave())

    kept = lines.select("file", "block", "value").join(F.broadcast(states), ["file", "block"])  # one row per split
    kept = kept.select("file", "block", "mode", "depth", "offset", "last", "value")
    return kept.mapInArrow(read, "file bigint, offset bigint, starts boolean, ends boolean, final boolean, text binary")


def joined_texts(cut: DataFrame) -> DataFrame:
    """``file, offset, final, text`` with the parts of texts over split boundaries put together, at most two parts per split."""
    whole = F.col("starts") & F.col("ends")
    begun = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("offset"))
    parts = cut.where(~whole).withColumn("number", begun).groupBy("file", "number").agg(
        F.min("offset").alias("offset"), F.max("final").alias("final"), F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("parts")
    )
    parts = parts.select("file", "offset", "final", F.expr("array_join(transform(parts, p -> cast(p.text AS string)), '')").alias("text"))
    return cut.where(whole).select("file", "offset", "final", F.col("text").cast("string").alias("text")).union(parts)


def framed(blanks: str) -> Column:
    """The text as an array of its own; null where it cannot be part of one."""
    text = F.ltrim("text", F.lit(blanks))
    behind = F.expr("substring(text, instr(text, ',') + 1)")
    closes = F.trim("text", F.lit(blanks)) == "]"
    comma = F.startswith(text, F.lit(",")) & ~(F.col("final") & (F.trim(behind, F.lit(blanks)) == "]"))
    body = (
        F.when((F.col("offset") == 0) & F.startswith(text, F.lit("[")), F.col("text"))
        .when(F.col("offset") == 0, None)
        .when(F.col("final") & closes, "[]")
        .when(comma, F.concat(F.lit("["), behind))
    )
    return F.when(F.col("final"), body).otherwise(F.concat(body, F.lit("]")))


def array_texts(lines: DataFrame, blanks: str) -> tuple[DataFrame, DataFrame]:
    """Texts ``file, offset, text`` that must all be arrays, and files ``file, whole``.

    ``lines`` is a scan of array files by ``}``: file (a hash of its name), block (first byte of the split), size (of
    the file), value.  It is read twice; texts are not shuffled.
    """
    states = stage(split_states(split_maps(lines)), "splits")
    texts = joined_texts(cut_texts(lines, states.drop("whole")))
    return texts.select("file", "offset", framed(blanks).alias("text")), states.groupBy("file").agg(F.min("whole").alias("whole"))
