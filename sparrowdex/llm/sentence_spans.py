"""Substring deduplication by sliding spans of sentences.

A sentence ends at a word that ends in . ! or ?, or at a line break.  One of more than LONGEST words
is cut further, after words whose hash is a multiple of CUT and at 4 * LONGEST words at the latest: the
cuts follow the content, so that a passage is cut alike whatever stands before it.  From each sentence on,
the shortest run of consecutive sentences that has RUN sentences and MIN_WORDS words or more is hashed (128
bits over ASCII-lower-cased words, so blanks do not matter).  If `whole`, a run needs MIN_WORDS words only,
and the shortest one that ends with each sentence is hashed as well: then all whole sentences of a repeated
passage are covered to its end once they have MIN_WORDS words.  A longer run that is repeated is covered by
the shortest ones inside it, which are repeated too, so hashing these is hashing every run.  Runs are joined
over all documents; sentences covered by a run that occurred before - in a document of smaller id, or
earlier in the same one - are removed with the blanks after them.

Null texts stay null and empty ones empty, with no sentences.  Rows equal in id and text are one
document and all keep what it keeps; rows that only share an id are told apart by their text, and come in
the order of its hash.  Rows without an id come last in the order.  A very long text is cut whole, as a slice
of its own.  An empty table gives an empty one.  Columns other than id and text, whatever their names, are
not read.

A run that occurs very often is one row of the table of first places, made with partial sums before
the shuffle, and is joined back from written tables, where a frequent key can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, mix, slices, word_bounds, word_hashes
from .shared import ship, written

RUN = 3
MIN_WORDS = 25
LONGEST = 24
CUT = 4

_R = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?")] = True


def _powers(r: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    out[1:] = r
    return np.cumprod(out, dtype=np.uint64)


class Units:
    """Sentences of all texts of a slice, and the run that begins with each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, whole: bool = False):
        starts, ends, first = word_bounds(data, offs)
        self.starts, self.ends, self.offs = starts, ends, offs
        n = len(starts)
        if not n:
            self.first = np.zeros(0, np.int64)
            self.doc = np.zeros(0, np.int64)
            self.unit_first = np.zeros(len(offs), np.int64)
            self.last = self.back = np.zeros(0, np.int64)
            return
        lines = np.cumsum(data == 10)
        stop = _STOPS[data[ends - 1]]
        stop[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
        begins = np.zeros(n, dtype=bool)
        begins[0] = True
        begins[1:] = stop[:-1]
        begins[first[first < n]] = True
        self.words = word_hashes(LOWER[data], starts, ends)
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, n))
        long = np.repeat(size > LONGEST, size)
        begins[1:] |= long[:-1] & (self.words[:-1] % np.uint64(CUT) == 0)
        at = np.flatnonzero(begins)
        begins |= (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))) % (4 * LONGEST) == 0
        self.first = np.flatnonzero(begins)  # first word of each sentence
        self.end = np.append(self.first[1:], n)  # its end in words
        self.unit_first = np.searchsorted(self.first, first)  # sentences before each text
        self.doc = np.searchsorted(first, self.first, side="right") - 1
        # the run from each sentence on: its last sentence, -1 if the text ends before
        last = np.maximum(np.searchsorted(self.end, self.first + MIN_WORDS), np.arange(len(self.first)) + (0 if whole else RUN - 1))
        inside = last < self.unit_first[self.doc + 1]
        self.last = np.where(inside, last, -1)
        # the run that ends with each sentence: its first sentence, -1 if the text begins after or a run from there is the same
        back = np.searchsorted(self.first, self.end - MIN_WORDS, side="right") - 1
        inside = whole & (back >= self.unit_first[self.doc])
        self.back = np.where(inside & (self.last[back] != np.arange(len(back))), back, -1)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last sentence of each run, and both halves of the runs' hashes."""
        starts, ends = np.flatnonzero(self.last >= 0), np.flatnonzero(self.back >= 0)
        who, last = np.concatenate([starts, self.back[ends]]), np.concatenate([self.last[starts], ends])
        if not len(who):
            return who, last, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        w = self.words
        a, b = self.first[who], self.end[last]
        out = []
        with np.errstate(over="ignore"):
            for r in _R:
                # sum of word * r^place, divided by r^(place of the run): the same wherever the run stands
                power, back = _powers(r, len(w)), _powers(np.uint64(pow(int(r), -1, 1 << 64)), len(w))
                total = np.concatenate([[np.uint64(0)], np.cumsum(w * power[:-1], dtype=np.uint64)])
                out.append(mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)))
        return who, last, out[0], out[1]


def _hashes(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(Units(data, offs, whole).hashes()[2].view(np.int64))], names=["h1"])

    return run


def _runs(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in slices(batch.column(1)):
                units = Units(data, offs, whole)
                who, last, h1, h2 = units.hashes()
                rows = pa.array(lo + units.doc[who])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        batch.column(0).take(rows),
                        batch.column(2).take(rows),
                        pa.array((who - units.unit_first[units.doc[who]]).astype(np.int32)),
                        pa.array((last - who + 1).astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc_id", "key", "at", "size"],
                )

    return run


def _cut(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count, gone = [], [], []
            for lo, hi, data, offs in slices(batch.column(1)):
                units = Units(data, offs, whole)
                for i in range(lo, hi):
                    k = i - lo
                    a, b = int(units.unit_first[k]), int(units.unit_first[k + 1])
                    count.append(b - a)
                    marks = batch.column(2)[i].values
                    if not batch.column(1)[i].is_valid or marks is None or not len(marks):
                        texts.append(batch.column(1)[i].as_py())
                        gone.append(0)
                        continue
                    cover = np.zeros(b - a + 1, dtype=np.int64)
                    marks = np.asarray(marks.to_numpy(zero_copy_only=False), dtype=np.int64)
                    at, size = marks >> 32, marks & 0xFFFFFFFF
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    covered = np.cumsum(cover)[:-1] > 0
                    gone.append(int(covered.sum()))
                    edges = np.append(units.starts[units.first[a:b]], offs[k + 1])
                    keep = [data[offs[k] : edges[0]].tobytes()]
                    keep += [data[edges[u] : edges[u + 1]].tobytes() for u in np.flatnonzero(~covered)]
                    texts.append(b"".join(keep).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())],
                names=["doc_id", "text", "n_sentences", "n_removed"],
            )

    return run


def drop_repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """doc_id, text without repeats, n_sentences, n_removed of every row."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    # runs are cut twice instead of stored; most occur once: they are counted by half of their hash alone,
    # and only the others are ordered, by the whole hash
    runs = source.mapInArrow(_runs(whole), "h1 long, h2 long, doc_id long, key long, at int, size int")
    hashes = source.select("text").mapInArrow(_hashes(whole), "h1 long")
    several = written(hashes.groupBy("h1").count().filter("count > 1").select("h1"), "repeated-hashes")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")
    repeated = written(runs.join(several.hint("merge"), "h1", "left_semi").select("h1", "h2", "doc_id", "key", "at", "size"), "repeated-runs")
    first = written(repeated.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first-runs")
    again = repeated.join(first.hint("merge"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    marks = again.groupBy("doc_id", "key").agg(F.collect_set(F.shiftleft(F.col("at").cast("long"), 32) + F.col("size")).alias("marks"))
    marks = written(marks.withColumnsRenamed({"doc_id": "marked", "key": "marked_key"}), "marks").hint("merge")
    same = source["doc_id"].eqNullSafe(marks["marked"]) & (source["key"] == marks["marked_key"])
    joined = source.join(marks, same, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_cut(whole), "doc_id long, text string, n_sentences long, n_removed long")
