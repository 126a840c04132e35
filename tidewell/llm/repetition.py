"""Quality rules on repetition within a text, by suffix arrays (operator 12)."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import byte_batches, text_or_empty
from tidewell.operators.sizes import spread

#: Words of the base rule's windows; a text fails with fewer than LEAST_WORDS words or more than BASE_PERCENT of them in repeated windows.
WINDOW, LEAST_WORDS, BASE_PERCENT = 8, 20, 30
#: The suffix-array rule: repeats of MIN_REPEAT words or more cover COVERED_PERCENT of the words at most, and the longest has LONGEST words at most.
MIN_REPEAT, COVERED_PERCENT, LONGEST = 5, 40, 100
#: Powers of two up to which ranks of every place are kept; longer common prefixes are stepped through at the last.
LEVELS = 12
BATCH_BYTES = 1 << 20

# fixed values: what words are made of, blanks, symbols
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass
class Suffixes:
    """Suffix array of many texts laid out one after another, each closed by an end mark of its own, with common prefixes of neighbours."""

    order: np.ndarray  # places, by text and then by suffix
    lcp: np.ndarray  # words that a suffix shares with the one before it in order, if that is ``least`` or more, else 0
    longest: np.ndarray  # by place, the longest prefix of its suffix that stands elsewhere in its text too, likewise


def suffixes(codes: np.ndarray, least: int) -> Suffixes:
    """``codes``: numbers that are equal for equal words of one text and for nothing else.

    Prefix doubling over all texts at once: places are ranked by their first 1, 2, 4, ... words, and only
    those not yet alone in their rank are sorted again, so rounds beyond the usual repeat touch few places.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.concatenate([[True], codes[order[1:]] != codes[order[:-1]]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    shared = ~new
    shared[:-1] |= ~new[1:]
    active = order[shared]  # by rank
    while len(active):
        keys = rank[active].astype(np.int64) * n + rank[active + width]  # an end mark is alone in its rank, so active + width is a place
        by = np.argsort(keys, kind="stable")
        active, keys = active[by], keys[by]
        old = rank[active]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank = rank.copy() if len(levels) <= LEVELS else rank
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - group
        width *= 2
        if len(levels) < LEVELS:
            levels.append(rank)
        shared = ~new
        shared[:-1] |= ~new[1:]
        active = active[shared]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return Suffixes(order, lcp := _common(order, levels, least), _longest(order, lcp))


def _common(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Common prefixes of neighbours in order, from the ranks of doubling widths; those below ``least`` are 0."""
    lcp = np.zeros(len(order), np.int64)
    first = min(least.bit_length() - 1, len(levels) - 1)
    pairs = np.flatnonzero(levels[first][order[1:]] == levels[first][order[:-1]]) + 1 if len(order) > 1 else np.zeros(0, np.int64)
    x, y, total = order[pairs - 1], order[pairs], np.zeros(len(pairs), np.int64)
    rest = np.arange(len(pairs))
    top = len(levels) - 1
    while len(rest):  # whole steps of the last level
        rest = rest[levels[top][x[rest]] == levels[top][y[rest]]]
        x[rest] += 1 << top
        y[rest] += 1 << top
        total[rest] += 1 << top
    for k in range(top - 1, -1, -1):
        step = (levels[k][x] == levels[k][y]).astype(np.int64) << k
        x, y, total = x + step, y + step, total + step
    lcp[pairs] = np.where(total >= least, total, 0)
    return lcp


def _longest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]])) if len(order) else lcp
    return out


def maximal_repeats(found: Suffixes, codes: np.ndarray) -> np.ndarray:
    """``(first place, length, occurrences)`` of each maximal repeated substring, as rows in order of their LCP intervals' ends.

    An LCP interval of value v is a substring of v words that can't be prolonged to the right at all its
    places; it is maximal if the words before them differ too.
    """
    order, lcp = found.order, found.lcp
    before = np.where(order > 0, codes[order - 1], -1)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    rows: list[tuple[int, int, int]] = []
    at = np.flatnonzero(lcp)
    stack: list[tuple[int, int]] = []  # (left end, value)
    values, last = lcp[at].tolist(), -2
    for i, v in zip([*at.tolist(), len(lcp) + 1], [*values, 0], strict=True):
        if i != last + 1:  # prefixes of 0 lie between
            rows += [(left, last, value) for left, value in reversed(stack)]
            stack = []
        left = i - 1
        while stack and stack[-1][1] > v:
            left, value = stack.pop()
            rows.append((left, last, value))
        if v and (not stack or stack[-1][1] < v):
            stack.append((left, v))
        last = i
    spans = np.array(rows, np.int64).reshape(-1, 3)
    spans = spans[changes[spans[:, 1]] > changes[spans[:, 0]]]
    firsts = np.array([order[a:b + 1].min() for a, b in spans[:, :2].tolist()], np.int64)
    return np.stack([firsts, spans[:, 2], spans[:, 1] - spans[:, 0] + 1], axis=1)


def covered(found: Suffixes, ends: np.ndarray, least: int) -> np.ndarray:
    """Words of each text that lie in a repeated substring of ``least`` words or more; ``ends`` are the end marks' places."""
    long = np.flatnonzero(found.longest >= least)
    change = np.zeros(len(found.order) + 1, np.int64)
    change[long] += 1
    np.add.at(change, long + found.longest[long], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return np.diff(inside[ends], prepend=0)


@dataclass
class Laid:
    """The words of texts as codes, one text after another, each closed by a mark of its own."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    texts: np.ndarray  # of each place


def lay_out(words: list[list[str]]) -> Laid:
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = lambda: len(number) + 1
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts + 1) - 1
    codes = np.zeros(int(counts.sum()) + len(words), np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    texts = np.repeat(np.arange(len(words)), counts + 1)
    return Laid(texts * (len(number) + 1) + codes, ends - counts, ends, texts)


def line_counts(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


REPEAT_SQL = "array<struct<start: long, length: long, occurrences: long>>"


def measure_repetition(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_repeat: int = MIN_REPEAT, repeats: bool = False) -> DataFrame:
    """Counts of every whole text's words, symbols, lines and repeated substrings, a row each.

    ``(<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat[, repeats])``.
    ``n_repeat_words`` are the words in windows of ``window`` words that the text holds twice or more,
    the first included; ``n_covered`` those in repeated substrings of ``min_repeat`` words or more;
    ``longest_repeat`` the words of the longest such substring, occurrences overlapping or not (0: none).
    ``repeats`` lists every maximal repeated substring: ``start`` of its first occurrence in words from 0, ``length``, ``occurrences``.

    A batch of texts shares one suffix array, whose common prefixes never cross texts.  No shuffle.  Memory is about
    that of one batch of ``BATCH_BYTES``, or of the longest text: some 200 bytes a word.

    Null, empty and blank texts count nothing.  Repeated rows, equal and null ids give a row each.  An
    empty table gives no rows.  Other columns are ignored.
    """
    source = spread(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")))
    id_type = source.schema["id"].dataType.simpleString()
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
    least = min(window, min_repeat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            words = [WORDS(t) for t in texts]
            laid = lay_out(words)
            found = suffixes(laid.codes, least)
            longest = np.zeros(len(texts), np.int64)
            np.maximum.at(longest, laid.texts, np.where(found.longest >= min_repeat, found.longest, 0))
            columns = [laid.ends - laid.starts, [sum(map(len, w)) for w in words], [sum(map(t.count, SYMBOLS)) for t in texts], list(map(line_counts, texts)),
                       covered(found, laid.ends, window), covered(found, laid.ends, min_repeat), longest]
            out = [batch.column("id"), *(pa.array(c, pa.int64()) for c in columns)]
            if repeats:
                rows = maximal_repeats(found, laid.codes)
                rows = rows[rows[:, 1] >= min_repeat]
                rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
                of = laid.texts[rows[:, 0]]
                structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (rows[:, 0] - laid.starts[of], rows[:, 1], rows[:, 2])], names=["start", "length", "occurrences"])
                out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)), structs))
            yield pa.RecordBatch.from_arrays(out, names=["id", *counted, *(["repeats"] if repeats else [])])

    schema = f"id {id_type}, {', '.join(f'{c} long' for c in counted)}" + f", repeats {REPEAT_SQL}" * repeats
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def judged(measured: DataFrame, *, least_words: int = LEAST_WORDS, base_percent: int = BASE_PERCENT, covered_percent: int = COVERED_PERCENT, longest: int = LONGEST) -> DataFrame:
    """``measured`` with ``base_failed`` (too few words, or too many in repeated windows) and ``kept``: not failed, repeats cover little and none is long."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > base_percent * F.col("n_words"))
    fine = (100 * F.col("n_covered") <= covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
