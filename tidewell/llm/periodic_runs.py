"""Periodic runs of words, by an all-lag vectorised scan (operator 11)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import byte_batches, discard, shuffle_partitions, staged, text_or_empty
from tidewell.operators.sizes import spread

#: A run has this many words and repeats its period this many times at least.
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Comparisons of one block of lags: what it needs stays in a core's cache.
BLOCK = 1 << 17
#: Texts of more characters are scanned by ranges of lags on many machines, each range of about so many comparisons.
LONG_CHARS, RANGE_WORK = 1 << 20, 1 << 32
#: A word and the blank after it, for the estimate of a long text's comparisons.
WORD_CHARS = 6
BATCH_BYTES = 2 << 20

# fixed values: what words are made of
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD).findall


def word_ids(words: list[str]) -> np.ndarray:
    """Equal words get equal numbers, from 0."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int16 if len(number) < 1 << 15 else np.int32, len(words))


def stretches(ids: np.ndarray, first: int, last: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """``(start, length, lag)`` of every maximal stretch of each lag of ``first..last`` that is long enough for a run, as rows.

    Blocks of lags are compared with the ids at once.  A run of lag q has max(min_length, min_exponent q) - q
    words that equal those q later.  Where that is 15 or more, some aligned byte of the packed
    comparison is all ones, so only lags with such a byte are run-length encoded.
    """
    n, found = len(ids), []
    padded = np.concatenate([ids, np.full(last + 1, -1, ids.dtype)])
    step = max(1, BLOCK // max(n, 1))
    for q in range(first, last + 1, step):
        lags = np.arange(q, min(q + step, last + 1))
        same = np.lib.stride_tricks.as_strided(padded[q:], (len(lags), n), (ids.itemsize, ids.itemsize)) == ids
        least = np.maximum(min_length, min_exponent * lags) - lags
        if least.min() >= 15:
            packed = np.packbits(same, axis=1) == 255
            some = np.flatnonzero(packed.any(axis=1))
            if not len(some):
                continue
            same, lags, least = same[some], lags[some], least[some]
        at = np.flatnonzero(same)  # the last place of a lag is never equal, so stretches of two lags don't touch
        if not len(at):
            continue
        breaks = np.flatnonzero(np.diff(at) != 1) + 1
        begin, end = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks - 1, [len(at) - 1]])] + 1
        row = begin // n
        long = end - begin >= least[row]
        begin, end, row = begin[long], end[long], row[long]
        found.append(np.stack([begin - row * n, end - begin + lags[row], lags[row]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def primitive(found: np.ndarray) -> np.ndarray:
    """Runs by start, then period: of stretches with the same words the one of the smallest lag.

    A run of three periods q whose smallest period p is less has p dividing q, and the maximal stretch of
    lag p is the same words; it was found, as it is longer than 3p.
    """
    if len(found) < 2:
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    keep = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])
    found = found[keep]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words, without those that any run repeats, joined by blanks."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "struct<start: long, length: long, period: long>"


def run_lists(each: list[np.ndarray]) -> pa.Array:
    rows = np.concatenate(each) if each else np.zeros((0, 3), np.int64)
    structs = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)), structs)


def _finished(ids: pa.Array, words: list[list[str]], runs: list[np.ndarray]) -> pa.RecordBatch:
    best = [strongest(x) for x in runs]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(w) for w in words], pa.int64()), run_lists(runs), pa.array([x and dict(zip(("start", "length", "period"), x, strict=True)) for x in best], RUN),
         pa.array([collapse(w, x) for w, x in zip(words, runs, strict=True)], pa.string())],
        names=["id", "n_words", "runs", "best", "collapsed"])


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
              long_chars: int = LONG_CHARS, range_work: int = RANGE_WORK, prepare: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """``(<id_col>, n_words, runs, best, collapsed)`` of every whole text.

    A run is a maximal stretch of words with smallest period q and at least ``max(min_length,
    min_exponent * q)`` words (``min_exponent`` is 2 or more); ``runs`` has all of them, ``(start, length, period)`` in words from 0, by start,
    then period, ``best`` the one of the greatest length / period (null without runs), ``collapsed`` the
    words joined by blanks without those that a run repeats after its first period.

    All lags up to n / ``min_exponent`` are compared, so a text costs about 0.28 n² comparisons, some
    thousand million a second.  Texts of up to ``long_chars`` characters are scanned where they are read, without a
    shuffle.  Longer ones are written once and dealt out by ranges of lags of about ``range_work``
    comparisons each, so one text of any length occupies many machines; only runs come back, fewer than words.
    A task holds the words of one text (about 100 bytes each) and a few MB besides.  With ``prepare``,
    the words that it makes of an id and a text's words are looked at.

    Null, empty and blank texts have no words and no runs, and collapse to an empty text.  Repeated rows,
    equal and null ids give a row each.  An empty table gives no rows.  Other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    result = f"id {id_type}, n_words long, runs array<{RUN_SQL}>, best {RUN_SQL}, collapsed string"

    def words_of(batch: pa.RecordBatch) -> list[list[str]]:
        words = map(WORDS, batch.column("text").to_pylist())
        return list(words) if prepare is None else list(map(prepare, batch.column("id").to_pylist(), words))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            words = words_of(batch)
            yield _finished(batch.column("id"), words, [primitive(stretches(word_ids(w), 1, len(w) // min_exponent, min_length, min_exponent)) for w in words])

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            for key, words, part, parts in zip(batch.column("key").to_pylist(), words_of(batch), *(batch.column(c).to_pylist() for c in ("part", "parts")), strict=True):
                lags = len(words) // min_exponent
                got = stretches(word_ids(words), 1 + part * lags // parts, (part + 1) * lags // parts, min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), *(pa.array(got[:, k], pa.int64()) for k in range(3))], names=["key", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            words = words_of(batch)
            found = [np.array([[r["start"], r["length"], r["period"]] for r in rows or ()], np.int64).reshape(-1, 3) for rows in batch.column("found").to_pylist()]
            yield _finished(batch.column("id"), words, [primitive(x) for x in found])

    is_long = F.char_length("text") > long_chars
    done = spread(source.where(~is_long)).mapInArrow(whole, result)
    long = staged(source.where(is_long).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    if long.isEmpty():
        discard(long)
    else:
        words = F.char_length("text") / WORD_CHARS
        parts = F.ceil(words * words * 0.28 / range_work).cast("int")
        dealt = long.select("id", "key", "text", parts.alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
            .repartition(4 * shuffle_partitions(docs.sparkSession), "key", "part")
        found = dealt.mapInArrow(by_range, "key long, start long, length long, period long")
        lists = found.groupBy(F.col("key").alias("f_key")).agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
        done = done.unionByName(long.join(lists, F.col("key") == F.col("f_key"), "left").select("id", "text", "found").mapInArrow(joined, result))
    return done.withColumnRenamed("id", id_col)
