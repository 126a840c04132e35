"""Token counts of whole texts by a public byte-level BPE vocabulary (operator 4)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import BATCH_BYTES, byte_batches, text_or_empty
from tidewell.operators.sizes import spread

#: Characters of a text that are encoded at once.
PIECE_CHARS = 1 << 16
#: The end of a run of letters, of any script: the pre-tokenizer's pattern ends a token there whatever follows, so counts on both sides add up.
SAFE = regex.compile(r"(?<=\p{L})(?!\p{L})")

_loaded: dict[str, tuple] = {}


def _load(json_path: str, ranks_path: str):
    """The library's tokenizer, a faster encoder of the same vocabulary, and the special strings, once a worker."""
    if json_path not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        reference = Tokenizer.from_file(json_path)
        special = [t.content for t in reference.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[json_path] = reference, fast, special
    return _loaded[json_path]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut only where token counts add up; uncut where there is no such place."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None or cut.start() == len(text):
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def filled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def count_tokens(docs: DataFrame, json_path: str, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(<id_col>, n_bytes, n_tokens)`` of every whole text; only lengths leave the Arrow function.

    Counts are those of the ``tokenizers`` library for ``json_path`` at its defaults, without added
    begin or end tokens.  Texts without special strings go through a second encoder of the same
    vocabulary (``ranks_path``), whose ids are the same for every code point (the tests compare them); a text that holds a special string goes through the library itself.

    Batches hold about ``batch_bytes`` of text however rows vary, short texts filling them up, and are
    encoded at once; a long text is encoded in parts cut at safe boundaries.  No shuffle: a lost executor's task is simply run again.

    Null and empty texts count 0 bytes and 0 tokens.  Repeated rows give repeated results; a null id
    stays null.  Other columns are ignored.
    """
    source = spread(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference, fast, special = _load(json_path, ranks_path)
        for batch in filled(byte_batches(batches, "text", batch_bytes), batch_bytes):
            texts = batch.column("text").to_pylist()
            odd = [any(s in text for s in special) for text in texts]
            counts = np.zeros(len(texts), np.int64)
            parts = [(i, p) for i, text in enumerate(texts) if not odd[i] for p in pieces(text)]
            found = fast.encode_ordinary_batch([p for _, p in parts], num_threads=1)
            np.add.at(counts, [i for i, _ in parts], [len(ids) for ids in found])
            whole = [i for i, x in enumerate(odd) if x]
            counts[whole] = [len(e.ids) for e in reference.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)]
            lengths = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())],
                                             schema=schema.set(0, pa.field("id", ids.type)))

    out = source.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
