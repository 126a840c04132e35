"""Nulls, empties, ties, repeats, empty tables, clashing columns for every operator."""

from __future__ import annotations

import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewell.llm import ann, chat, language_id, line_dedup, minhash_forest, packing, piece_sampling, progressive_jpeg, sharding, token_counts

LONG = ("alpha beta gamma delta " * 4000).strip()
ROWS = [(1, None), (2, ""), (3, "The quick brown fox jumps over the lazy dog again and again."), (4, "The quick brown fox jumps over the lazy dog again and again."), (5, "12 34 !?"), (6, LONG),
        (7, "Ünïcødé ﬁ \t\r\n\x0b x’s don't <|endoftext|> <|startoftext|> </s> 東京 हिन्दी"), (7, "Ünïcødé twice the same number"), (None, "no number here")]
WORD, BYTE, RANKS, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    names = "id n_bytes media shard slot key line h1 h2 pos score rank sample lang_pred n_tokens window run grp"
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *(F.lit("x").alias(n) for n in names.split()))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = 99").select("doc_id", "text")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    got = by_id(token_counts.count_tokens(docs, BYTE, RANKS))
    for key, text in ROWS:
        want = len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids)
        assert want in [(r.n_bytes, r.n_tokens) for r in got[key]]
    assert sum(map(len, got.values())) == len(ROWS)
    assert token_counts.count_tokens(empty, BYTE, RANKS).count() == 0


def test_token_pieces_add_up():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for text in ["word, other 'tis  two   blanks\n\nline x " * 50, "слово, it's  don't\n\n 12абв34 e\u0301te\u0301 " * 50, "汉字，没有空格。\n\n 第二行！" * 60, "مرحبا بالعالم، هذا نص " * 50, "'s'S 'll a'd b'rex \t\n c " * 60]:
        for most in (1, 37):
            parts = list(token_counts.pieces(text, most))
            assert "".join(parts) == text and len(parts) > 10
            assert sum(len(library.encode(p).ids) for p in parts) == len(library.encode(text).ids)
    assert list(token_counts.pieces("a" * 100, 10)) == ["a" * 100]


def test_small_batches_are_filled_up():
    import pyarrow as pa

    batches = [pa.record_batch({"text": ["x" * 10] * n}) for n in (3, 1, 40, 2, 2)]
    got = list(token_counts.filled(iter(batches), 100))
    assert [b.num_rows for b in got] == [4, 40, 4] and not list(token_counts.filled(iter([]), 9))


def test_byte_vocabularies_agree_on_every_kind_of_character():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    _, fast, _ = token_counts._load(BYTE, RANKS)
    codes = [c for c in range(0x323B0) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}\n {chr(c)}" for c in codes]
    for start in range(0, len(texts), 5000):
        part = texts[start:start + 5000]
        assert fast.encode_ordinary_batch(part, num_threads=2) == [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = [t or "" for _, t in ROWS] + [f"A{chr(c)}B 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}\n {chr(c)}" for c in range(0x3000)] + ["it's 'S !!'s <|endoftext|> a\x1cb İI ΑΣ"]
    got = packing.WordEncoder(WORD)(texts)
    import numpy as np

    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(docs, empty):
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    got = packing.pack_documents(docs, WORD).collect()
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in ROWS)
    of_doc = {}
    for r in got:
        of_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.input_ids, "<u4").tolist(), r.length))
    built = []
    for pieces in of_doc.values():
        ids = []
        for start, part, length in sorted(pieces, key=lambda p: p[0]):
            assert start == len(ids) and length == len(part)
            ids += part
        built.append(tuple(ids))
    assert sorted(built) == want
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.window))
    for parts in windows.values():
        at = 0
        for offset, length, window in sorted(parts):
            assert offset == at
            at += length
        assert at == window <= 4096 and window & (window - 1) == 0
    assert packing.pack_documents(empty, WORD).count() == 0


def brute_shards(texts, n):
    """Shard of each distinct text: longest first, ties in any order, to the least-loaded shard."""
    sizes = {}
    for t in texts:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 8
    loads = [0] * n
    for size in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    return sizes, loads


def check_shards(got, texts, n):
    sizes, want = brute_shards(texts, n)
    assert [sum(r["size"] for r in got if r.shard == s) for s in range(n)] == want
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(where) == len(sizes) and all(len(s) == 1 for s in where.values())
    for s in range(n):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))


def test_sharding_is_brute_force_lpt(spark, docs, empty):
    got = sharding.lpt_shards(docs, 3).collect()
    assert len(got) == len(ROWS)
    check_shards(got, [t for _, t in ROWS], 3)
    for r, text in ((r, dict(ROWS[:6]).get(r.doc_id)) for r in got if r.doc_id in range(1, 7)):
        raw = (text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.lpt_shards(empty, 3).count() == 0


def test_sharding_of_many_groups(spark):
    """6,000 groups of many sizes, one of a third of all rows; ranks and slots over several runs."""
    text = lambda i: "hot" if i % 3 == 0 else f"{i % 9000:05d}" + "x" * (i % 9000 % 41 % 7 * 3)
    rows = spark.createDataFrame([(i, text(i)) for i in range(12000)], "doc_id long, text string")
    for n, settings in ((5, {}), (7, {"hot_groups": 2, "run_rows": 100})):
        check_shards(sharding.lpt_shards(rows, n, **settings).collect(), [text(i) for i in range(12000)], n)


def test_a_class_is_dealt_as_the_heap_deals_it():
    import heapq
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        loads = [rng.randint(0, 60) for _ in range(rng.randint(1, 6))]
        size, count = rng.randint(1, 20), rng.randint(1, 40)
        heap, want = sorted((load, s) for s, load in enumerate(loads)), [0] * len(loads)
        for _ in range(count):
            load, s = heap[0]
            want[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        assert sharding.deal(np.array(loads), size, count).tolist() == want


def brute_lines(rows, least=5):
    keys = {}
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                keys.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(keys.get(key(x), ())) < least or i == max(keys[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, docs, empty):
    shared, edge = "This is a licence line that many documents repeat, Événement", "x" * 40
    rows = [(i, f"own {i}\n{'  ' * (i % 2)}{shared.upper() if i == 3 else shared}\t\n{edge}\n{edge}\n\nend {i}\n") for i in range(1, 7) if i != 3]
    rows += [(3, shared + "\n" + shared), (9, None), (10, ""), (11, shared), (12, edge[:39]), (None, shared), (13, edge + "\n" + edge)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("pos", F.lit(2))
    for hot in (0, 4096):
        kept = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, hot_keys=hot))
        got = sorted(((r.doc_id, r._n_lines, r._n_dropped, r.text or "") for r in kept.collect()), key=str)
        assert got == brute_lines(rows)
    assert {"line", "pos"} <= set(kept.columns)
    assert line_dedup.keep_bitmaps(empty).count() == 0
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).count() == len(ROWS)


def test_progressive_jpeg(docs, empty):
    media = progressive_jpeg.encode_payloads(docs)
    got = by_id(progressive_jpeg.decode_media(media))
    for key, text in ROWS:
        raw = (text or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert want in [bytes(r.payload) for r in got[key]]
        assert all(len(r.rgb) == 3 * r.height * r.width and r.error is None for r in got[key])
    bad = progressive_jpeg.decode_media(media.select("doc_id", F.when(F.col("doc_id") == 1, F.lit(b"junk")).otherwise(F.lit(None).cast("binary")).alias("media"), F.lit(1).alias("rgb")))
    rows = bad.collect()
    assert len(rows) == len(ROWS) and sum(r.error is not None for r in rows) == 1 and all(r.payload is None and r.rgb is None for r in rows)
    assert progressive_jpeg.encode_payloads(empty).count() == 0
    with pytest.raises(ValueError):
        progressive_jpeg.encode_payload(b"x")


def test_language(spark, docs, empty):
    texts = [(i, ["the cat and the dog went into the house", "der hund und die katze gehen in das haus"][i % 2], ["en", "de"][i % 2]) for i in range(40)]
    model = language_id.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    got = by_id(language_id.identify(docs, model))
    assert [(r.lang_pred, r.score) for r in got[1] + got[2] + got[5]] == [("und", 0.0)] * 3
    assert got[3][0].lang_pred == "en" and 0 < got[3][0].score <= 1
    mixed = spark.createDataFrame([(1, "the dog went into the house and the cat went into the house. Der hund und die katze gehen in das haus und der hund")], "doc_id long, text string")
    spans = language_id.identify(mixed, model).first().lang_spans
    assert [s.lang for s in spans] == ["en", "de"]
    assert sum(map(len, got.values())) == len(ROWS) and language_id.identify(empty, model).count() == 0
    marks = spark.createDataFrame([(1, "\u0301\u0302 \u0301"), (2, "\u0301 the cat\u0301")], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(marks, model).collect()} == {1: ("und", 0.0), 2: ("en", 1.0)}
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.with_language(docs, model).columns == [*(c for c in docs.columns if c not in ("lang_pred", "score")), "lang_pred", "score", "lang_spans"]


def test_near_duplicates(spark, docs, empty):
    got = minhash_forest.jaccard_classes(docs).collect()
    assert len(got) == sum(k is not None for k, _ in ROWS)
    of = {r.doc_id: r for r in got}
    assert (of[3].class_id, of[4].class_id, of[3].n_links, of[4].copy_of) == (3, 3, 1, 3)
    assert all(of[k].n_links == 0 and of[k].class_id == k for k in (1, 2, 6))
    assert minhash_forest.jaccard_classes(empty).count() == 0
    short = spark.createDataFrame([(1, "Two words"), (2, "two  WORDS!"), (3, "two other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in minhash_forest.jaccard_classes(short).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("rank", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("vec_id").isin(1, 4, 5, 8, 9), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert {q: sorted(v) for q, v in got.items()} == {1: [(1, 2, 1.0), (2, 9, 1.0), (3, 3, 0.0)], 9: [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]}
    assert ann.nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0
    lengths = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 1.0]), (5, [0.0, 1.0]), (6, [2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(lengths, F.lit(True), 1).collect()) == [(1, 2), (2, 1), (3, 4), (4, 3), (5, 4)]
    assert ann.nearest(df.where("vec_id = 99"), F.lit(True)).count() == 0


def test_chat_windows(spark):
    marked = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", marked), (1, 2, "assistant", "a\\<|end|>\\\\" + "x" * 50), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 4, "assistant", "tie"), (1, None, "user", "first"),
            (2, 0, "user", "<|turn|>" * 3), (None, 0, None, "stray"), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup"), *((4, t, ["user", "assistant"][t % 2], "word " * 60) for t in range(40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("win", F.lit(1)).withColumn("window", F.lit(1)).withColumn("pos", F.lit(1))
    for budget, history in ((60, 20), (300, 100), (2048, 256), (1, 0), (40, 40)):
        out = chat.format_windows(df, budget=budget, history=history)
        got = out.select("conv_id", "window", "n_turns", "n_repeated", "n_tokens", "formatted", chat.parse_window(F.col("formatted"), F.col("n_repeated")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
        for conv in (1, 2, 3, 4, None):
            mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.window)
            order = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
            assert [(t.role, t.text) for r in mine for t in r.t] == [(r[2] or "", r[3] or "") for r in order]
            assert "".join(r.loss for r in mine) == "".join(r[3] or "" for r in order if r[2] == "assistant")
            assert all(len(r.t) == r.n_turns - r.n_repeated for r in mine)
            assert all(r.n_tokens <= budget or len(r.t) == 1 for r in mine)
            assert [(r.window, r.n_turns, r.n_repeated) for r in mine] == brute_windows(order, budget, history)
    assert chat.format_windows(df.where("conv_id = 99")).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(df, budget=1, history=2)


def test_a_turn_beyond_the_budget_is_alone(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi " * 50), (1, 2, "assistant", "long " * 24_000), (1, 3, "user", "and " * 50), (1, 4, "assistant", "yes " * 50)]
    got = sorted((r.window, r.n_turns, r.n_repeated, r.n_tokens <= 2048) for r in chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(1, 2, 0, True), (3, 2, 1, False), (4, 3, 1, True)]


def brute_windows(order, budget, history):
    """(first own turn, turns, repeated ones) of each window, turn by turn."""
    marks = re.compile(r"([<\[])(?=" + "|".join(re.escape(c[1:]) for c in chat.CONTROL) + ")")
    escaped = lambda x: marks.sub(r"\1\\", x.replace("\\", "\\\\"))
    size = [-(-len((chat.TURN + escaped(r[2] or "") + chat.TEXT + escaped(r[3] or "") + chat.END).encode()) // 4) for r in order]
    start = [sum(size[:i]) for i in range(len(size))]
    system = next((i for i, r in enumerate(order) if r[2] == "system"), None)
    room = max(0, budget - history - (size[system] if system is not None else 0))
    spans = []
    for i, n in enumerate(size):
        block = start[i] // (chat.BLOCK_BUDGETS * budget)
        if spans and spans[-1][2] == block and spans[-1][1] + n <= room:
            spans[-1][1] += n
        else:
            spans.append([i, n, block])
    out = []
    for (first, own, _), end in zip(spans, [*(s[0] for s in spans[1:]), len(size)], strict=True):
        again = {j for j in range(first) if own <= room and start[first] - start[j] <= history} | ({system} if system is not None and system < first else set())
        out.append((first + 1, end - first + len(again), len(again)))
    return out


def test_segmentations(docs, empty):
    out = piece_sampling.decode_pieces(piece_sampling.sample_segmentations(docs, PIECES, k=3).withColumn("decoded", F.lit(1)), PIECES)
    got = by_id(out)
    for key, text in ROWS:
        assert (text or "") in [r.decoded for r in got[key]]
        assert len({(bytes(r.input_ids), r.decoded) for r in got[key]}) == len(got[key]) and (len(got[key]) == 1) == (not text)
    again = by_id(piece_sampling.sample_segmentations(docs.repartition(3), PIECES, k=3))
    assert {k: sorted((bytes(r.input_ids), r.perturbed) for r in v) for k, v in got.items()} == {k: sorted((bytes(r.input_ids), r.perturbed) for r in v) for k, v in again.items()}
    at_once = piece_sampling.sample_segmentations(docs, PIECES, k=3, decode=True)
    assert at_once.columns == [*piece_sampling.sample_segmentations(docs, PIECES).columns, "decoded"]
    key = lambda r: str((r.doc_id, bytes(r.input_ids), r.decoded))
    assert sorted(map(key, at_once.collect())) == sorted(map(key, out.collect()))
    assert piece_sampling.sample_segmentations(empty, PIECES).count() == 0
