"""Hierarchical multi-length packing of tokenised documents (operator 8)."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import byte_batches, text_or_empty

#: Context sizes, short to long: powers of two.
TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens that a task gathers before it packs them.
ROUND_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 1 << 16
BATCH_BYTES = 2 << 20
#: Characters of the blank-free strings whose ids a worker remembers: with their ids some 30 bytes each.
CACHED_CHARS = 1 << 20
#: Stands for the end of a word; no UTF-8 holds this byte.
WORD_END = b"\xff"

#: Code points for which splitting and folding here are known to equal the library's: up to U+02FF but for four separators, and common punctuation.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\u02ff\u2010-\u2027\u2030-\u205e\u20ac]")


def alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str, of: dict[str, int]) -> bytes:
    end = token.endswith("</w>")
    return bytes(of[c] for c in (token[:-4] if end else token)) + WORD_END * end


def merger(path: str):
    """A merging function for whole words (bytes and ``WORD_END``) to ranks, and the id of each rank.

    A rank merger joins whatever adjacent parts make a known token, the vocabulary only pairs of its
    list.  The two agree if every token, taken alone, merges to itself by the list; a test shows that.
    """
    import json

    import numpy as np
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    of, vocab = alphabet(), model["vocab"]
    singles = [t for t in vocab if len(t) == 1]
    ends = [t for t in vocab if len(t) == 5 and t.endswith("</w>")]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = list(dict.fromkeys([*singles, *ends, *merged]))
    ranks = {token_bytes(t, of): i for i, t in enumerate(order)}
    same = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
    return same._core_bpe.encode_single_piece, np.array([vocab[t] for t in order], "<u4")


class WordEncoder:
    """Ids of whole texts by a word-level BPE file of ``tokenizers``, each distinct string between blanks encoded once.

    The vocabulary's pre-tokenizer makes every word's ids independent of its neighbours, and no word
    holds a blank.  Texts with special strings or code points outside the compared ranges go through
    the library whole.
    """

    def __init__(self, path: str, cached: int = CACHED_CHARS):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # fixed values: the word pattern of the vocabulary file
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.merge, id_of = merger(path)
        self.coded = [int(i).to_bytes(4, "little") for i in id_of]  # by rank
        self.cached, self.known, self.held = cached, {}, 0

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        """Ids of one word by merging its bytes, the end of the word among them."""
        coded = self.coded
        return b"".join([coded[rank] for rank in self.merge(word.encode() + WORD_END)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        if self.held > self.cached:
            known.clear()
            self.held = 0
        split: list[list[str] | None] = [
            None if UNUSUAL.search(text) or any(s in text for s in self.special) else text.lower().split() for text in texts]
        got = [None if strings is None else list(map(known.get, strings)) for strings in split]
        fresh = list({s for strings, found in zip(split, got, strict=True) if strings and None in found for s, x in zip(strings, found, strict=True) if x is None})
        self.held += sum(map(len, fresh))
        word, get = self.encode_word, known.get
        for s in fresh:
            known[s] = word(s) if s.isalpha() else b"".join([get(w) or word(w) for w in self.words(s)])
        out = []
        for text, strings, found in zip(texts, split, got, strict=True):
            if strings is None:
                out.append(self.whole(text))
            elif None in found:
                out.append(b"".join([known[s] if x is None else x for s, x in zip(strings, found, strict=True)]))
            else:
                out.append(b"".join(found))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Packs one task's documents; holds ``round_tokens`` tokens and one window a tier at most."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, round_tokens: int = ROUND_TOKENS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.top = tuple(sorted(tiers)), max(tiers)
        self.round_tokens, self.step_tokens = round_tokens, step_tokens
        self.full: list[tuple[int, list]] = []  # (window, pieces)
        # by tier, pieces sorted by length: (length, order, document, start, ids, document's tokens)
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.held = self.order = self.sequences = self.steps = 0

    def route(self, piece: tuple) -> None:
        """To the pool of the smallest tier that holds the piece."""
        insort(self.pools[next(t for t in self.tiers if t >= piece[0])], piece, key=lambda p: (p[0], p[1]))

    def add(self, doc, ids) -> Iterator[tuple]:
        n = len(ids)
        for start in range(0, n, self.top):
            piece = (min(self.top, n - start), self.order, doc, start, ids[start:start + self.top], n)
            self.order += 1
            self.held += piece[0]
            if piece[0] == self.top:
                self.full.append((self.top, [piece]))
            else:
                self.route(piece)
        if self.held >= self.round_tokens:
            yield from self.pack()

    def take(self, gap: int) -> tuple | None:
        """The longest waiting piece of a shorter tier that fits into ``gap``; else a cut of the shortest waiting piece."""
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            at = bisect_right(pool, gap, key=lambda p: p[0])
            if at:
                return pool.pop(at - 1)
        for tier in self.tiers:
            if self.pools[tier]:
                n, order, doc, start, ids, total = self.pools[tier].pop(0)
                rest = (n - gap, order, doc, start + gap, ids[gap:], total)
                self.route(rest)
                return (gap, order, doc, start, ids[:gap], total)
        return None

    def fill(self, window: int, first: tuple | None = None) -> list:
        got = [first] if first else []
        gap = window - (first[0] if first else 0)
        while gap and (piece := self.take(gap)):
            got.append(piece)
            gap -= piece[0]
        return got

    def waiting(self) -> int:
        return sum(p[0] for pool in self.pools.values() for p in pool)

    def pack(self, last: bool = False) -> Iterator[tuple]:
        """Long windows first; their gaps take pieces of shorter tiers. What can't fill a window waits for the next round."""
        rest = self.waiting()
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            while pool and rest >= tier:
                self.full.append((tier, self.fill(tier, pool.pop())))
                rest -= tier
        if last:
            # the rest of a task, less than its longest piece's tier: windows of falling powers of two
            while rest:
                window = min(self.top, 1 << (rest.bit_length() - 1))
                self.full.append((window, self.fill(window)))
                rest -= window
        yield from self.emit()
        self.held = rest

    def emit(self) -> Iterator[tuple]:
        """Windows of one tier share steps of equal tokens; within a round they are dealt out by attention cost, to and fro."""
        by_window: dict[int, list] = {}
        for window, got in self.full:
            by_window.setdefault(window, []).append(got)
        self.full = []
        for window in sorted(by_window, reverse=True):
            rows = sorted(by_window[window], key=lambda got: -sum(p[0] ** 2 for p in got))
            steps = -(-len(rows) * window // self.step_tokens)
            for i, got in enumerate(rows):
                lap, at = divmod(i, steps)
                step = self.steps + (at if lap % 2 == 0 else steps - 1 - at)
                offset = 0
                for n, _, doc, start, ids, total in got:
                    yield doc, start, n, ids, total, self.sequences, offset, window, step
                    offset += n
                self.sequences += 1
            self.steps += steps


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                   tiers: tuple[int, ...] = TIERS, round_tokens: int = ROUND_TOKENS, step_tokens: int = STEP_TOKENS,
                   make_encoder: Callable[[str], Callable] = encoder) -> DataFrame:
    """Tokenise, close each document with ``end_id`` and pack all ids into windows of several lengths.

    Returns a row per piece: ``(<id_col>, start, length, input_ids, doc_tokens, sequence_id, offset,
    window, step_group)``.  ``input_ids`` are little-endian unsigned 32-bit ids.  Each id is in one
    piece.  Every window is a power of two and full, so none needs padding.

    Each document is routed to the smallest tier that holds it (documents beyond the longest tier
    first fill windows of their own).  Tiers are packed from long to short; a window's gap takes the
    longest waiting piece of a shorter tier that fits, and at last a cut piece.  At the end of a task
    the rest leaves in windows of falling powers of two.  ``step_group`` joins windows of one length
    into steps of at most ``step_tokens`` tokens, dealt out so that steps differ little in attention cost.

    Packing is a map over input partitions: no shuffle, no global order, memory of ``round_tokens``.
    Sequence ids hold the partition number in their upper bits.  Ids repeat exactly when a task is
    run again, as long as its rows come in the same order, as from files; stage other inputs first.

    Null and empty texts are documents of one token.  Rows with equal ids are packed as documents of
    their own.  An empty table gives no rows.  Other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encode = make_encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        packer = Packer(tiers, round_tokens, step_tokens)
        id_arrow: list[pa.DataType] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, n, ids, total, seq, offset, window, step = zip(*rows, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, id_arrow[0]), long(start), long(n), pa.array([x.tobytes() for x in ids], pa.binary()), long(total),
                 long([base + s for s in seq]), long(offset), long(window), long([base + s for s in step])],
                names=["id", "start", "length", "input_ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"])

        rows: list[tuple] = []
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            id_arrow[:] = [batch.column("id").type]
            for doc, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                for row in packer.add(doc, np.frombuffer(ids + end, "<u4")):
                    rows.append(row)
                if len(rows) >= 2000:
                    yield out(rows)
                    rows = []
        rows += packer.pack(last=True)
        for start in range(0, len(rows), 2000):
            yield out(rows[start:start + 2000])

    out = source.mapInArrow(run, f"id {id_type}, start long, length long, input_ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long")
    return out.withColumnRenamed("id", id_col)
