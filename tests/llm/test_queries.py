"""The registered queries and the pipeline over a whole small data set against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_small_cases import brute_lines, brute_shards
from tidewell.llm import language_id, queries as q


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    """Class and number of links of each id."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root, links = {k: k for k in texts}, dict.fromkeys(texts, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in texts}


def test_token_counts_and_sizes(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(q.op4_token_counts(spark, sf))
    assert got.keys() == docs.keys()
    for k, d in docs.items():
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_media(spark, sf, docs):
    got = rows(q.op2_progressive_jpeg(spark, sf))
    for k, d in docs.items():
        raw = (d.text or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    by_text = {}
    for k, d in docs.items():
        by_text.setdefault(d.text, set()).add((got[k].media_sha256, got[k].feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_neighbours_have_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in vectors], float)
    ids = np.array([r.vec_id for r in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = q.op1_ann(spark, sf).collect()
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        best = np.lexsort((ids, -s))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == ids[i])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score - x[i] @ x[np.flatnonzero(ids == v)[0]]) < 1e-6 for _, v, score in mine)
        hit += len({v for _, v, _ in mine} & set(ids[best].tolist()))
        total += 5
    assert hit / total >= 0.9


def test_near_duplicates(spark, sf, docs):
    want = brute_classes({k: d.text for k, d in docs.items()})
    got = rows(q.op3_ngram_jaccard(spark, sf))
    assert {k: (r.class_id, r.n_links) for k, r in got.items()} == want


def test_near_duplicates_have_recall():
    """Against an index of all shingles, ten times the data."""
    import pyarrow.parquet as pq

    from tidewell.llm.shingles import shingle_sets
    from pyspark.sql import SparkSession

    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    ids, sets = t["doc_id"].to_pylist(), shingle_sets([x or "" for x in t["text"].to_pylist()])
    at = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            at.setdefault(h, []).append(i)
    common = {}
    for who in at.values():
        if len(who) > 1:
            for a, b in combinations(who, 2):
                common[a, b] = common.get((a, b), 0) + 1
    links = dict.fromkeys(ids, 0)
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[ids[a]] += 1
            links[ids[b]] += 1
    got = {r.doc_id: r.n_links for r in q.op3_ngram_jaccard(SparkSession.getActiveSession(), sf).collect()}
    assert all(got[k] <= n for k, n in links.items()) and sum(got.values()) >= 0.99 * sum(links.values()) > 0


def test_languages(spark, sf, docs):
    got = rows(q.op5_language_id(spark, sf))
    held = [k for k in docs if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k in docs)
    assert sum(got[k].lang_pred == docs[k].lang for k in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_lines(spark, sf, docs):
    got = rows(q.op9_line_dedup(spark, sf))
    for k, n, gone, kept in brute_lines([(k, d.text) for k, d in docs.items()]):
        assert (got[k].n_lines, got[k].n_dropped, got[k].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_shards(spark, sf, docs):
    got = rows(q.op6_sharding(spark, sf))
    loads = [0] * 24
    for k, d in docs.items():
        raw = (d.text or "").encode()
        assert (got[k]["size"], got[k].text_crc32, got[k].law, got[k].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        loads[got[k].shard] += got[k]["size"]
    groups = {}
    for k, d in docs.items():
        groups.setdefault(d.text, set()).add(got[k].shard)
    assert all(len(s) == 1 for s in groups.values()) and loads == brute_shards([d.text for d in docs.values()], 24)[1]


def test_segmentations(spark, sf, docs):
    got = q.op10_piece_sampling(spark, sf).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()
        assert r.log_prob <= 0 and r.log_inclusion <= 0
    assert seen.keys() == docs.keys() and all(len({r.ids_crc32 for r in v}) == 2 for v in seen.values())


def test_pipeline_stage_by_stage(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = spark.createDataFrame([(-1, "12345 !!", "en", "x", 8), (-2, None, None, None, None), (-3, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra)
    now = {r.doc_id: r.text for r in table.collect()}
    seen = [name for name, _ in corpus_pipeline.STAGES]
    assert seen == ["language ID", "line dedup", "n-gram Jaccard join", "packing"]

    df = corpus_pipeline.by_language(spark, table, sf)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = language_id.train(table, usable=fold != 0)
    keys = list(now)
    langs, scores, _ = language_id.identify_texts([now[k] or "" for k in keys], model)
    now = {k: now[k] for k, lang, s in zip(keys, langs, scores, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_SCORE}
    assert df.columns == table.columns and {r.doc_id: r.text for r in df.collect()} == now and now.keys() == docs.keys()

    df = corpus_pipeline.without_repeated_lines(spark, df, sf)
    now = {k: kept for k, _, _, kept in brute_lines(list(now.items()))}
    assert df.columns == table.columns and {r.doc_id: (r.text, r.n_chars) for r in df.collect()} == {k: (x, len(x)) for k, x in now.items()}

    df = corpus_pipeline.without_near_copies(spark, df, sf)
    classes = brute_classes(now)
    now = {k: x for k, x in now.items() if classes[k][0] == k}
    assert df.columns == table.columns and {r.doc_id: r.text for r in df.collect()} == now

    pieces = corpus_pipeline.packed(spark, df, sf).collect()
    length = {}
    for r in pieces:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
        ids = library.encode(now[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert length == {k: len(library.encode(x, add_special_tokens=False).ids) + 1 for k, x in now.items()}

    assert corpus_pipeline.run(spark, sf).count() > 0


def test_packing_as_registered(spark, sf, docs):
    """Every id of every document in one piece, by the library's own ids; sequences without gaps, each as long as a power of two."""
    from zlib import crc32

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in q.op8_packing(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == docs.keys()
    for k, d in docs.items():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
