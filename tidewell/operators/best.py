"""The best ``k`` rows of every question within a task, by blocks of whole matrices, and functions of Arrow batches that use them.

A task holds ``k`` rows a question, however many rows it reads, so what leaves it doesn't grow with the pairs.
Values that come out are summed in the order of ``functions.vectors``; matrix products only say which pairs can be among the best.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewell.operators.sizes import byte_slices

#: Cells of a block of scores; pairs whose values are computed one by one at a time; words of a slice of texts.
CELLS, PAIRS, WORDS = 1 << 21, 1 << 16, 1 << 21
#: What is kept beyond a threshold: two roundings to six decimals.
MARGIN = 2e-6
#: Squared norms outside of these may lose their digits in a matrix product; single precision is for those below the third.
TINY, HUGE, MOST_SINGLE = 1e-200, 1e200, 1e30
#: Rows and questions of a block of vectors.
MET, ASKED = 2048, 512
#: A term of so large a part of the questions is a row of a dense matrix; so many rows at most.
DENSE_PART, MOST_DENSE = 16, 512
#: Which of the first characters are letters, numbers or the underscore; of bytes, only those of one-byte characters.
WORD_CODES = np.array([c == "_" or unicodedata.category(c)[0] in "LN" for c in map(chr, range(0x180))])
WORD_BYTES = np.concatenate([WORD_CODES[:128], np.zeros(128, bool)])


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds a double: the shortest decimal that reads as it, half away from zero."""
    unit = 10.0**digits
    with np.errstate(all="ignore"):
        y = np.abs(x) * unit
        low = np.floor(y)
        out = np.copysign(np.floor(y + 0.5) / unit, x)
        close = np.isfinite(x) & ((np.abs(y - low - 0.5) < 1e-3) | (y > 2**40))
    for i in np.flatnonzero(close):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(x[i]) < 1e20 else x[i]
    return np.where(np.isfinite(x), out, x)


class Best:
    """The best ``k`` of each of ``n`` questions so far: by rounded value, then ``chunk_id``.

    Nearest first, nulls before numbers and NaN last; or ``largest`` first, NaN before numbers and nulls last, as Spark sorts them.
    """

    def __init__(self, n: int, k: int, largest: bool, digits: int):
        self.n, self.k, self.largest, self.digits = n, k, largest, digits
        self.limit = np.full(n, np.inf)  # no pair whose key is beyond is among the best
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []
        self.size = 0

    def add(self, question: np.ndarray, value: np.ndarray, null: np.ndarray, rows: pa.Table) -> None:
        if len(question):
            self.parts.append((question, value, null, rows))
            self.size += len(question)
        if self.size > max(1 << 16, 3 * self.n * self.k):
            self.compact()

    def compact(self) -> None:
        if not self.parts:
            return
        question, value, null = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        rows = pa.concat_tables([p[3] for p in self.parts])
        rounded = half_up(value, self.digits)
        if self.largest:
            key = np.where(np.isnan(rounded), -np.inf, -rounded)
            key[null] = np.nan
        else:
            key = np.where(null, -1.0, rounded)
        ids = pc.rank(rows.column("chunk_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((ids, key, question))
        q = question[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.limit[question[last]] = np.where(np.isnan(key[last]), np.inf, key[last]) + MARGIN
        self.parts = [(question[kept], value[kept], null[kept], rows.take(pa.array(kept)))]
        self.size = len(kept)

    def result(self) -> tuple[np.ndarray, pa.Array, pa.Table] | None:
        self.compact()
        if not self.parts:
            return None
        question, value, null, rows = self.parts[0]
        return question, pa.array(value, pa.float64(), mask=null), rows


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every length of vectors: the rows that have it, their components as doubles, and which components are null; null vectors have none."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == d)
        flat = vectors.take(pa.array(rows)).flatten()
        null = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(rows), d)
        yield rows, pc.fill_null(pc.cast(flat, pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(len(rows), d), null


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += x[:, j] * y[:, j]
    return s


def _squared_l2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += (x[:, j] - y[:, j]) ** 2
    return s


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norms = np.sqrt(_dot(x, x)) * np.sqrt(_dot(y, y))
    return np.where(norms == 0, 0.0, _dot(x, y) / norms)


def _odd(x: np.ndarray, null: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Vectors whose product with others says nothing."""
    return null.any(1) | ~np.isfinite(x).all(1) | ~((squares == 0) & (x == 0).all(1) | (squares > TINY) & (squares < HUGE))


def _told_apart(x: np.ndarray, null: np.ndarray, ids: pa.Array, k: int, own: bool) -> np.ndarray:
    """Places of rows that can be among the best ``k`` of a question: of equal vectors, those of the ``k`` smallest ids.

    Equal vectors are as far from any question, so their ids decide.  Vectors with a null are equal here, and so are those with
    NaN, as is what they give.  With ``own``, a question leaves out its own id: of one more id, and of none without a name.
    """
    x = np.where(np.isnan(x).any(1)[:, None], np.nan, x)
    x[null.any(1)] = -np.inf
    named = np.flatnonzero(pc.is_valid(ids).to_numpy(zero_copy_only=False)) if own else np.arange(len(x))
    if not x.shape[1] or not len(named):
        return named
    marked = np.column_stack([x, null.any(1)])[named]
    group, many = np.unique(marked.view(np.dtype((np.void, marked.shape[1] * 8))).ravel(), return_inverse=True, return_counts=True)[1:]
    if many.max() <= k:
        return named
    codes = pc.rank(ids.take(pa.array(named)), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((codes, group))
    group, codes = group[order], codes[order]
    new = np.ones(len(order), bool)  # another vector, or with own, another id
    new[1:] = (group[1:] != group[:-1]) | (codes[1:] != codes[:-1] if own else True)
    count = np.cumsum(new)
    place = count - count[np.searchsorted(group, group)]
    return np.sort(named[order[place < k + own]])


class Nearest:
    """Batches of ``chunk_id, vec, ...`` against ``questions``, an Arrow array of vectors: its positions, ``value`` and the batches' other columns."""

    def __init__(self, questions: pa.Array, ids: pa.Array | None, k: int, metric: str, digits: int, names: list[str]):
        self.questions, self.ids, self.k, self.metric, self.digits, self.names = questions, ids, k, metric, digits, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(self.questions), self.k, self.metric == "cosine", self.digits)
        own, codes = None, {}
        if self.ids is not None:
            own = np.array([-1 if i is None else codes.setdefault(i, len(codes)) for i in self.ids.to_pylist()], np.int64)
        with np.errstate(all="ignore"):
            sides = {y.shape[1]: [_Side(rows[b:b + ASKED], y[b:b + ASKED], null[b:b + ASKED], self.metric, own, True) for b in range(0, len(y), ASKED)] for rows, y, null in matrices(self.questions)}
            for batch in batches:
                table = pa.Table.from_batches([batch]).combine_chunks()
                ids = None if own is None else np.array([-1 if i is None else codes.get(i, -2) for i in table.column("chunk_id").to_pylist()], np.int64)
                vectors = table.column("vec").combine_chunks()
                for rows, x, null in matrices(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors):
                    if x.shape[1] not in sides:
                        continue
                    told = _told_apart(x, null, pc.take(table.column("chunk_id"), pa.array(rows)).combine_chunks(), self.k, own is not None)
                    rows, x, null = rows[told], x[told], null[told]
                    for a in range(0, len(x), MET):
                        mine = _Side(rows[a:a + MET], x[a:a + MET], null[a:a + MET], self.metric, ids, False)
                        for asked in sides[x.shape[1]]:
                            self._block(best, table.select(self.names), mine, asked)
            done = best.result()
        if done is not None:
            question, value, rows = done
            yield from rows.append_column("_q", pa.array(question.astype(np.int32))).append_column("value", value).to_batches(10_000)

    def _block(self, best: Best, table: pa.Table, mine: _Side, asked: _Side) -> None:
        """Pairs that may be among the best by a matrix product; these get their value one by one."""
        fine = max(mine.most, asked.most) >= MOST_SINGLE
        chosen = self._chosen(best, mine, asked, np.float64 if fine else np.float32)
        if not fine and len(chosen) > max(PAIRS, 4 * self.k * len(asked.x)):  # too close for single precision
            chosen = self._chosen(best, mine, asked, np.float64)
        way = _cosine if self.metric == "cosine" else _squared_l2
        for i in range(0, len(chosen), PAIRS):
            qi, ci = np.divmod(chosen[i:i + PAIRS], len(mine.x))
            null = (mine.null[ci] | asked.null[qi]).any(1)
            best.add(asked.rows[qi], way(mine.x[ci], asked.x[qi]), null, table.take(pa.array(mine.rows[ci])))

    def _chosen(self, best: Best, mine: _Side, asked: _Side, kind: type) -> np.ndarray:
        """Places of these pairs in the block, question by question.  A question's threshold holds from its first block on."""
        key = asked.factor(kind) @ mine.factor(kind).T
        slack = 16 * np.finfo(kind).eps * (mine.x.shape[1] + 2)
        error, base = (np.full(len(asked.x), slack), 0.0) if self.metric == "cosine" else (slack * (asked.squares + mine.most), asked.squares)
        twins = None if mine.codes is None else np.flatnonzero(mine.codes >= 0)
        same = None if twins is None else asked.codes[:, None] == mine.codes[twins][None, :]
        limit = best.limit[asked.rows]
        if key.shape[1] > self.k and (kind is np.float64 or np.isinf(limit).any()):
            plain = key.copy()
            plain[:, mine.odd | mine.nameless] = np.inf  # the k-th best of the others is a bound for all
            plain[asked.odd | asked.nameless] = np.inf
            if same is not None:
                plain[:, twins] = np.where(same, np.inf, plain[:, twins])
            plain.partition(self.k - 1, axis=1)
            limit = best.limit[asked.rows] = np.minimum(limit, plain[:, self.k - 1] + base + error + MARGIN)
        chosen = key <= (limit + error - base).astype(kind)[:, None]
        for at, far in ((mine.odd, (slice(None), mine.odd)), (asked.odd, asked.odd)):
            if at.any():
                chosen[far] = True
        if same is not None:
            chosen[:, twins] &= ~same
            chosen[:, mine.nameless] = False
            chosen[asked.nameless] = False
        return np.flatnonzero(chosen.ravel())


class _Side:
    """Vectors of one length, a side of a block: their places ``rows``, components and what a matrix product takes of them."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, null: np.ndarray, metric: str, codes: np.ndarray | None, asked: bool):
        self.rows, self.x, self.null, self.metric, self.asked = rows, x, null, metric, asked
        self.codes = None if codes is None else codes[rows]
        self.nameless = np.zeros(len(rows), bool) if codes is None else self.codes == -1
        self.squares = (x * x).sum(1)
        self.odd = _odd(x, null, self.squares)
        self.squares[self.odd] = 0.0  # all their pairs are chosen
        self.most = 0.0 if metric == "cosine" else self.squares.max(initial=0.0)
        self.made: dict[type, np.ndarray] = {}

    def factor(self, kind: type) -> np.ndarray:
        """Products of two sides' rows are the negative cosine, or what is added to a question's square to give the squared distance."""
        if kind not in self.made:
            x = np.where(self.odd[:, None], 0.0, self.x)
            if self.metric == "cosine":
                x /= np.where(self.squares == 0, 1.0, np.sqrt(self.squares))[:, None] * (-1 if self.asked else 1)
            else:
                x = np.column_stack([-2 * x, np.ones(len(x))] if self.asked else [x, self.squares])
            self.made[kind] = x.astype(kind)
        return self.made[kind]


def latin_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of letters, digits and underscores of lower-cased texts that aren't ``beyond_latin``: how many a text has, and all in order.

    Bytes of the texts are marked by what their character is; no word is handled on its own.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    _, at, data = low.buffers()
    at = np.frombuffer(at, np.int32)[low.offset:low.offset + len(low) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = WORD_BYTES[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    inside[lead] = inside[lead + 1] = WORD_CODES[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]  # a text's first byte begins a word, whatever the one before ends with
    begins[first] = inside[first]
    begins = np.flatnonzero(begins)
    ends = np.append((np.cumsum(inside)[begins] - 1), inside.sum()).astype(np.int32)
    return np.diff(np.searchsorted(begins, at)), pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data[inside]))


def beyond_latin(texts: pa.Array) -> np.ndarray:
    """Which texts have characters that ``latin_words`` doesn't know: others than Latin letters (but for a capital I with a dot, whose lower case is two characters) and marks of punctuation."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    odd = data >= 0xC6
    marks, dotted = np.flatnonzero(data == 0xE2), np.flatnonzero(data == 0xC4)
    odd[marks] = (data[marks + 1] > 0x81) | (data[marks + 1] == 0x81) & (data[marks + 2] >= 0xB0)  # up to U+206F
    odd[dotted] = data[dotted + 1] == 0xB0
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(at - at[0], np.flatnonzero(odd), side="right") - 1] = True
    return out


def counted_latin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chunk_id, text`` as ``chunk_id, dl, terms, tfs``: each text's different words and how often it has them; without texts beyond Latin."""
    for part in byte_slices(batches, "text"):
        part = part.filter(pa.array(~beyond_latin(part.column("text"))))
        yield _counted(part.column("chunk_id"), *latin_words(part.column("text")))


def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``chunk_id, text``, the texts beyond Latin."""
    for batch in batches:
        yield batch.filter(pa.array(beyond_latin(batch.column("text"))))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chunk_id, words`` as ``counted_latin`` gives them."""
    for batch in batches:
        start, ends = 0, np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False))
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, side="right")))
            part = batch.slice(start, stop - start)
            words = part.column("words")
            yield _counted(part.column("chunk_id"), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten())
            start = stop


def _counted(ids: pa.Array, lengths: np.ndarray, flat: pa.Array) -> pa.RecordBatch:
    coded = flat.dictionary_encode()
    size = max(1, len(coded.dictionary))
    found, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(found // size, minlength=len(lengths)))]).astype(np.int32))
    terms = coded.dictionary.take(pa.array(found % size))
    return pa.RecordBatch.from_arrays([ids, pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64)))],
                                      ["chunk_id", "dl", "terms", "tfs"])


class Scored:
    """Batches of ``chunk_id, dl, terms, tfs`` against questions by words: ``query_id, chunk_id, bm25_score``, unrounded, the best ``k`` that are above 0."""

    def __init__(self, asked: pa.Table, k: int, k1: float, b: float, avgdl: float, digits: int):
        self.k, self.k1, self.b, self.avgdl, self.digits = k, k1, b, avgdl, digits
        questions, words = (asked.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        questions, words = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (questions, words))
        self.ids, self.words = questions.dictionary, words.dictionary
        q, t = questions.indices.to_numpy(), words.indices.to_numpy()
        weight = asked.column("qtf").to_numpy() * asked.column("idf").to_numpy()
        order = np.lexsort((q, t))
        self.q, self.weight = q[order], weight[order]
        self.many = np.bincount(t, minlength=len(self.words))
        self.start = np.concatenate([[0], np.cumsum(self.many)])[:-1]
        dense = np.flatnonzero(self.many * DENSE_PART >= len(self.ids))
        self.dense = dense[np.argsort(-self.many[dense], kind="stable")][:MOST_DENSE]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        best = Best(n, self.k, True, self.digits)
        column = np.full(len(self.words), -1)
        column[self.dense] = np.arange(len(self.dense))
        wide = np.zeros((len(self.dense), n))
        for i, t in enumerate(self.dense):
            own = slice(self.start[t], self.start[t] + self.many[t])
            wide[i, self.q[own]] = self.weight[own]
        high = max(1, CELLS // max(1, n))
        for batch in batches:
            row, term, part = self._parts(batch)
            ids = pa.table({"chunk_id": batch.column("chunk_id")})
            pairs = np.concatenate([[0], np.cumsum(np.bincount(row, np.where(column[term] < 0, self.many[term], 0), batch.num_rows))])
            at, a = np.searchsorted(row, np.arange(batch.num_rows + 1)), 0
            while a < batch.num_rows:  # so many texts as give a bounded block and a bounded number of pairs
                z = min(a + high, max(a + 1, int(np.searchsorted(pairs, pairs[a] + CELLS, side="right")) - 1), batch.num_rows)
                own = slice(at[a], at[z])
                self._block(best, ids, a, row[own] - a, term[own], part[own], z - a, column, wide)
                a = z
        done = best.result()
        if done is not None:
            question, value, rows = done
            yield from rows.append_column("query_id", self.ids.take(pa.array(question))).append_column("bm25_score", value).select(["query_id", "chunk_id", "bm25_score"]).to_batches(10_000)

    def _parts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, asked term and what it adds for one asking of weight 1."""
        terms = batch.column("terms")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        found = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(found >= 0)
        row, tf = row[kept], batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[kept]
        dl = batch.column("dl").to_numpy(zero_copy_only=False)[row]
        return row, found[kept], tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))

    def _block(self, best, ids, first, row, term, part, height, column, wide) -> None:
        n = len(self.ids)
        narrow = np.zeros((height, len(self.dense)))
        often = column[term] >= 0
        narrow[row[often], column[term[often]]] = part[often]
        scores = narrow @ wide
        row, term, part = row[~often], term[~often], part[~often]
        many = self.many[term]
        if many.sum():
            at = np.repeat(self.start[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            scores += np.bincount(np.repeat(row, many) * n + self.q[at], np.repeat(part, many) * self.weight[at], height * n).reshape(height, n)
        limit = best.limit
        if height > self.k and np.isinf(limit).any():
            limit = np.minimum(limit, MARGIN - np.partition(scores, height - self.k, axis=0)[height - self.k])
        chunk, question = np.nonzero((scores > 0) & (-scores <= limit + MARGIN))
        best.add(question, scores[chunk, question], np.zeros(len(chunk), bool), ids.take(pa.array(chunk + first)))
