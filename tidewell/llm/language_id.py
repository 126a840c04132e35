"""Language identification of whole texts, mixed languages included (operator 5).

Script ranges narrow each word's candidate languages; character n-grams score the word for those;
a Viterbi pass with a switching penalty labels spans; a text's language is that of most of its letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tidewell.llm.common import byte_batches, text_or_empty
from tidewell.operators.sizes import spread

#: The model is fitted on this many labelled documents of each language at most, those of the smallest id hash.
TRAIN_DOCS_PER_LANGUAGE = 1000
#: That many times as many documents are looked at for the sample; fewer than are wanted among them are next to impossible.
SPARE_SAMPLE = 4
#: Tasks that count the sample, each of which may give a row for every slot of the model.
COUNTING_TASKS = 8
#: Slots of each n-gram order, smoothing, and what a change of language costs (nats).
SLOTS, SMOOTHING, SWITCH_PENALTY = 1 << 15, 0.5, 6.0
#: n-grams overlap, so their evidence is scaled down.
EVIDENCE = 1 / 3
#: A language has a script if this part of its letters is in it.
SCRIPT_SHARE = 0.01
#: Words that the Viterbi pass takes as one chunk.
CHUNK = 128
UNKNOWN = "und"
#: Notices of a licence or copyright, often in another language than their text's; longer lines are text.
LICENCE = re.compile(r"licen[sc]|copyright|\u00a9|all rights reserved|public domain|creative commons", re.IGNORECASE)
LICENCE_CHARS = 200
BATCH_BYTES = 1 << 20
ORDERS = 3

# fixed values: scripts and their code point ranges (letters of none of these are "other")
SCRIPTS = [
    ("latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("sinhala", [(0xD80, 0xDFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
OTHER = len(SCRIPTS) + 1


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the lower-case code point, the script's number (0: neither letter nor mark), and whether it is a mark."""
    top = 0x323B0
    lower, script, mark = np.arange(top, dtype=np.uint32), np.zeros(top, np.uint8), np.zeros(top, bool)
    for c in range(top):
        ch = chr(c)
        if ch.isalpha():
            script[c] = OTHER
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif unicodedata.category(ch) in ("Mn", "Mc"):
            script[c], mark[c] = OTHER, True
    for k, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            part = script[a:b + 1]
            part[part > 0] = k
    return lower, script, mark


@dataclass
class Words:
    """The words of a batch of texts laid out one after another."""

    starts: np.ndarray  # in characters of the batch
    ends: np.ndarray
    doc: np.ndarray
    script: np.ndarray  # of the first letter
    letters: np.ndarray  # script of each letter, marks and other letters have their word's
    first: np.ndarray  # the word's first place among the letters
    grams: list[np.ndarray]  # by order, the slot of each letter
    offsets: np.ndarray  # where each text starts


def split_words(texts: list[str]) -> Words:
    """Runs of letters and the marks after them, with the n-grams around each; a break counts as a character."""
    lower, scripts, marks = _characters()
    codes = np.frombuffer("\n".join(texts).join(("\n\n", "\n\n\n")).encode("utf-32-le", "replace"), "<u4")
    codes = np.where(codes < len(lower), codes, 0)
    script = scripts[codes]
    letter = script > 0
    if (mark := letter & marks[codes]).any():  # a mark without a letter before it in its run is no letter
        place = np.arange(len(codes))
        run = np.maximum.accumulate(np.where(letter, 0, place))
        letter &= np.maximum.accumulate(np.where(letter & ~mark, place, 0)) > run
        script = np.where(letter, script, 0)
    c = np.where(letter, lower[codes], 0).astype(np.uint32)
    edge = np.diff(letter.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    at = np.flatnonzero(letter)
    a, b, d = c[at - 1], c[at], c[at + 1]
    a2, d2 = np.where(a > 0, c[at - 2], 0), np.where(d > 0, c[at + 2], 0)
    m1, m2, m3, m4 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F)
    pair = a * m1 + b * m2
    triple = pair + d * m3
    wide = triple * m4 + a2 * m2 + d2 * m1
    shift = np.uint32(32 - (SLOTS.bit_length() - 1))
    grams = [((g ^ (g >> np.uint32(15))) * m3 >> shift).astype(np.int32) for g in (pair, triple, wide)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = 2 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    letters = script[at]
    letters = np.where(letters == OTHER, np.repeat(script[starts], ends - starts), letters)
    return Words(starts, ends, np.searchsorted(offsets, starts, side="right") - 1, script[starts], letters,
                 np.concatenate([[0], np.cumsum(ends - starts)[:-1]]).astype(np.int64) if len(starts) else np.zeros(0, np.int64), grams, offsets)


@dataclass
class Model:
    languages: list[str]
    tables: np.ndarray  # orders x slots x languages, centred log-likelihoods
    scripts: np.ndarray  # scripts + 2 x languages: may it be
    prior: np.ndarray  # share of letters


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          usable: Column | None = None, docs_per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> Model:
    """Fit on at most ``docs_per_language`` labelled documents of each language (a bounded, documented sample).

    The sample is fixed by hashes of ids and read by a second scan (a language of few documents, or of
    one id repeated, may give fewer); n-grams are counted on the
    executors, and only the model, whose size doesn't depend on the corpus, reaches the driver.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        named = named.where(usable)
    # the smallest hashes of a language: all but a few times as many as are wanted go before any row is moved
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sizes = named.groupBy(F.col(lang_col).alias("n_lang")).agg(F.count(F.lit(1)).alias("n"))
    likely = named.select(F.col(id_col).alias("pick_id"), F.col(lang_col).alias("pick_lang"), place.alias("place")).join(F.broadcast(sizes), F.col("pick_lang") == F.col("n_lang")) \
        .where(F.col("place") * F.col("n") < SPARE_SAMPLE * docs_per_language)
    picked = likely.select("pick_id", "pick_lang", F.row_number().over(Window.partitionBy("pick_lang").orderBy("place", "pick_id")).alias("nth")).where(F.col("nth") <= docs_per_language)
    sample = named.join(F.broadcast(picked), (F.col(id_col) == F.col("pick_id")) & (F.col(lang_col) == F.col("pick_lang"))) \
        .select(F.col(text_col).cast("string").alias("text"), F.col("pick_lang").cast("string").alias("lang")).repartition(COUNTING_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), object)
            words = split_words(batch.column("text").to_pylist())
            owner = np.repeat(words.doc, words.ends - words.starts)
            script = np.repeat(words.script, words.ends - words.starts)
            for lang in set(langs.tolist()):
                mine = (langs == lang)[owner]
                got = sums.setdefault(lang, np.zeros(ORDERS * SLOTS + OTHER + 1, np.int64))
                for k, grams in enumerate(words.grams):
                    got[k * SLOTS:(k + 1) * SLOTS] += np.bincount(grams[mine], minlength=SLOTS)
                got[ORDERS * SLOTS:] += np.bincount(script[mine], minlength=OTHER + 1)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], names=["lang", "slot", "n"])

    counts = sample.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    tables = np.zeros((len(languages), ORDERS * SLOTS + OTHER + 1))
    of = {x: i for i, x in enumerate(languages)}
    tables[[of[x] for x in counts["lang"].to_pylist()], counts["slot"].to_numpy()] = counts["n"].to_numpy()
    if not languages:
        return Model([], np.zeros((ORDERS, SLOTS, 0), np.float32), np.zeros((OTHER + 1, 0), bool), np.zeros(0))
    grams = tables[:, :ORDERS * SLOTS].reshape(len(languages), ORDERS, SLOTS) + SMOOTHING
    logs = np.log(grams / grams.sum(2, keepdims=True))
    letters = tables[:, ORDERS * SLOTS:]
    share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray((EVIDENCE * (logs - logs.mean(0))).transpose(1, 2, 0), np.float32), (share >= SCRIPT_SHARE).T, letters.sum(1) / max(letters.sum(), 1))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Words x languages; languages that lack the word's script are out, unless all lack it."""
    if not len(words.starts):
        return np.zeros((0, len(model.languages)), np.float32)
    each = model.tables[0][words.grams[0]]
    for table, grams in zip(model.tables[1:], words.grams[1:], strict=True):
        each += table[grams]
    scores = np.add.reduceat(each, words.first, axis=0)
    may = model.scripts[words.script]
    known = may.any(1, keepdims=True)
    return np.where(known, np.where(may, scores, np.float32(-1e4)), np.float32(0)).astype(np.float32)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float = SWITCH_PENALTY, chunk: int = CHUNK) -> np.ndarray:
    """The best label of each word; ``doc`` is non-decreasing, and each run of it is labelled on its own.

    Staying costs nothing, any change ``penalty``.  Long texts are cut into chunks whose max-plus
    matrices are computed side by side and then chained, so time doesn't depend on the longest text.
    """
    n, k = scores.shape
    if not n or k < 2:
        return np.zeros(n, np.int64)
    doc_starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    doc_ends = np.concatenate([doc_starts[1:], [n]])
    per_doc = -(-(doc_ends - doc_starts) // chunk)
    owner = np.repeat(np.arange(len(doc_starts)), per_doc)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    begin = doc_starts[owner] + nth * chunk
    size = np.minimum(chunk, doc_ends[owner] - begin)
    by_size = np.argsort(-size, kind="stable")
    begin_s, size_s = begin[by_size], size[by_size]
    active = [int(np.searchsorted(-size_s, -t, side="left")) for t in range(int(size_s[0]))]  # chunks longer than t
    pen, eye = np.float32(penalty), np.eye(k, dtype=bool)

    through = np.where(eye, np.float32(0), -pen)[None].repeat(len(owner), 0)  # chunk, state before, state at its end
    through += scores[begin_s][:, None, :]
    for t in range(1, len(active)):
        m = active[t]
        part = through[:m]
        np.maximum(part, part.max(2, keepdims=True) - pen, out=part)
        part += scores[begin_s[:m] + t][:, None, :]
    rank = np.empty(len(owner), np.int64)
    rank[by_size] = np.arange(len(owner))

    entry = np.zeros((len(owner), k), np.float32)  # best value of each state before the chunk
    rounds = int(per_doc.max())
    heads = np.cumsum(per_doc) - per_doc
    value = np.zeros((len(doc_starts), k), np.float32)
    for r in range(rounds):
        live = np.flatnonzero(per_doc > r)
        at = heads[live] + r
        entry[at] = value[live]
        got = (value[live][:, :, None] + through[rank[at]]).max(1)
        value[live] = got - got.max(1, keepdims=True)

    state = entry[by_size]
    switch = np.zeros((n, k), bool)
    best = np.zeros(n, np.int8 if k < 128 else np.int32)
    for t in range(len(active)):
        m = active[t]
        part, place = state[:m], begin_s[:m] + t
        top = part.argmax(1)
        other = part[np.arange(m), top][:, None] - pen
        switch[place] = other > part
        best[place] = top
        state[:m] = np.maximum(part, other) + scores[place]

    label = np.zeros((n, k), best.dtype)  # for each state at the chunk's end
    current = np.arange(k)[None].repeat(len(owner), 0)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        place = begin_s[:m] + t
        cur = current[:m]
        label[place] = cur
        moved = np.take_along_axis(switch[place], cur, 1)
        current[:m] = np.where(moved, best[place][:, None], cur)
    before = current[rank]  # chunk, end state: state before the chunk

    end_state = np.zeros(len(owner), np.int64)
    want = value.argmax(1)
    for r in range(rounds - 1, -1, -1):
        live = np.flatnonzero(per_doc > r)
        at = heads[live] + r
        end_state[at] = want[live]
        want[live] = before[at, want[live]]
    return label[np.arange(n), np.repeat(end_state, size)].astype(np.int64)


def identify_texts(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list[str], np.ndarray, list[list[tuple[str, int, int]]]]:
    """Language, score and spans ``(language, first, end)`` in code points of each text."""
    words = split_words(texts)
    k, n = len(model.languages), len(texts)
    if not k:
        return [UNKNOWN] * n, np.zeros(n), [[] for _ in texts]
    labels = viterbi(word_scores(words, model), words.doc, penalty)
    known = np.add.reduceat(model.scripts.any(1)[words.letters], words.first, dtype=np.int64) if len(labels) else labels
    letters = np.bincount(words.doc * k + labels, known, minlength=n * k).reshape(n, k)
    total = np.bincount(words.doc, words.ends - words.starts, minlength=n)
    top = np.where(letters.sum(1) > 0, letters.argmax(1), model.prior.argmax())
    score = np.where(total > 0, letters[np.arange(n), top] / np.maximum(total, 1), 0.0)
    languages = [model.languages[t] if s else UNKNOWN for t, s in zip(top.tolist(), (total > 0).tolist(), strict=True)]
    new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (words.doc[1:] != words.doc[:-1])])) if len(labels) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(labels)]]) - 1 if len(new) else new
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    base = words.offsets[words.doc[new]]
    for d, lab, a, b in zip(words.doc[new].tolist(), labels[new].tolist(), (words.starts[new] - base).tolist(), (words.ends[last] - base).tolist(), strict=True):
        spans[d].append((model.languages[lab], a, b))
    return languages, score, spans


def without_licence_lines(text: str) -> str:
    """``text`` without its short lines of licence or copyright; the whole text if they hold all its letters."""
    if not LICENCE.search(text):
        return text
    rest = "\n".join(x for x in text.split("\n") if len(x) > LICENCE_CHARS or not LICENCE.search(x))
    return rest if any(map(str.isalpha, rest)) else text


def with_language(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = True, penalty: float = SWITCH_PENALTY, prepare: Callable[[str], str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred, score`` and ``lang_spans`` (replacing columns of these names); only the text decides.

    ``score`` is the part of all letters that Viterbi spans give to ``lang_pred``; spans are in code
    points.  Null, empty and letterless texts get ``und`` and 0.  Letters of scripts that no learned
    language has count for no language but in the whole, so a text of such letters alone gets the language of
    most letters in training, with a score of 0.  A model without languages gives ``und``.  An empty table gives no rows.  With
    ``prepare``, what it makes of a text is looked at (spans are then places in that).  All
    rows stay, repeated ones with repeated results.  No shuffle; the model is broadcast (its size is
    fixed by SLOTS and the number of languages).
    """
    new = ("lang_pred", "score", *(("lang_spans",) if spans else ()))
    source = spread(docs.drop(*new))
    kept = source.columns
    span = StructType().add("lang", StringType()).add("first", IntegerType()).add("end", IntegerType())
    schema = StructType(source.schema.fields + [StructField("lang_pred", StringType()), StructField("score", DoubleType())] + [StructField("lang_spans", ArrayType(span))] * spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, text_col, BATCH_BYTES):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            languages, score, found = identify_texts(texts if prepare is None else list(map(prepare, texts)), shared.value, penalty)
            columns = [*(batch.column(c) for c in kept), pa.array(languages, pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array([[{"lang": x, "first": a, "end": b} for x, a, b in s] for s in found], span_type))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``(<id_col>, lang_pred, score[, lang_spans])`` of every whole text, as ``with_language``; other columns are ignored."""
    return with_language(docs.select(id_col, text_or_empty(text_col).alias("_text")), model, text_col="_text", spans=spans).drop("_text")
