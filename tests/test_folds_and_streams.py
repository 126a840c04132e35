"""Order-dependent folds, streams against batches, sources and models."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import models
from tidewell.config import EngineConfig
from tidewell.functions import text as t
from tidewell.operators import chunking as c, folds, json_records as j, learning
from tidewell.sources import files, html
from tidewell.streaming import sessions as s


def test_rate_limit_fold():
    assert s.accepted([0, 1, 2, 60.5, 61.5], 2)[0] == [True, True, False, True, True]


def test_session_boundary(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:30:00"), (3, 1, "2024-01-01 01:00:01")]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(x.n_events for x in s.sessions(e).collect()) == [1, 2]
    assert [x.session_no for x in s.session_numbers(e).orderBy("event_id").collect()] == [1, 1, 2]


def stream_of(spark, tmp_path, df, name):
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def run(stream, name):
    """All that is there, once."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)


def test_sessions_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id")
    late = spark.createDataFrame([(-1, -1)], "event_id long, user_id long").select("event_id", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "user_id")
    folder = tmp_path / "in"
    e.coalesce(1).write.parquet(str(folder))
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = s.sessions(source, late="1 hour").writeStream.format("memory").queryName("sess").outputMode("append").start()
    query.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(str(folder))
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("sess").where("user_id >= 0").collect()}
    assert got == {tuple(r) for r in s.sessions(e).collect()}


def test_limits_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id")
    batch = {(r.event_id, r.allowed) for r in s.rate_limited(e.withColumn("limit", F.lit(2)), window=36000.0).collect()}
    run(s.rate_limited_stream(stream_of(spark, tmp_path, e, "e"), 2, 36000.0), "limits")
    assert {(r.event_id, r.allowed) for r in spark.table("limits").collect()} == batch and {a for _, a in batch} == {True, False}


def test_history_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{i:02d}:00", "user", f"m{i}") for i in range(25)] + [(2, "2024-01-01 00:00:00", "user", "old"), (2, "2024-01-01 01:00:00", "user", "new")]
    m = spark.createDataFrame(rows, "conv_id long, ts string, role string, text string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    run(s.history_stream(stream_of(spark, tmp_path, m, "m")), "hist")
    got = {r.conv_id: r for r in spark.table("hist").collect()}
    assert got[1].n_kept == 20 and got[1].history.startswith("user: m5") and got[2].history == "user: new"


FIELDS = [x.split()[0] for x in c.CHUNK_SCHEMA.split(", ")]


def chunks(key, text, config=EngineConfig()):
    return [dict(zip(FIELDS, row, strict=True)) for row in c.chunk_document(key, text, config)]


def test_faq_chunks():
    text = "\n\n".join(f"Q: Question {i}?\nA: Answer {i}." for i in range(3))
    got = chunks("d", text)
    assert [x["section_title"] for x in got] == ["FAQ"] * 3 and got[0]["text"] == "Q: Question 0?\n\nA: Answer 0." and got[2]["total_chunks"] == 3


def test_blank_and_long_documents():
    assert chunks("d", "") == chunks("d", "   ") == chunks("d", None) == []
    text = " ".join(f"Sentence number {i} talks about network coverage." for i in range(300))
    got = chunks("d", text)
    assert len(got) > 3 and all(x["text"].startswith("[...] ") for x in got[1:]) and got[1]["subsection_title"] == " (continued)"
    plain = chunks("d", text, EngineConfig(overlap_tokens=0))
    assert " ".join(x["text"].split("]\n")[-1] for x in plain).split() == text.split()
    assert all(x["token_count"] <= 650 for x in plain) and len({x["chunk_id"] for x in plain}) == len(plain)


def test_packing_fold():
    assert folds.packed([3, 3, 3, 10, 1], 7) == [0, 0, 1, 2, 3] and folds.packed([0, 5, 5], 10) == [0, 0, 0] and folds.packed([], 1) == []
    assert folds.packed([4, 4, 1], 9, joins=[1, 1, 1]) == [0, 0, 1] and folds.packed([1, 1, 1], 9, breaks=[False, False, True]) == [0, 0, 1]
    assert folds.packed([1, 1, 1, 1], 9, alone=1) == [0, 1, 1, 1] and folds.packed([0, 4], 9, joins=[2, 2]) == [0, 1]
    assert folds.filled([10, 500, 5, 30, 9], 40, 240) == [0, 0, 1, 1, 1] and folds.filled([500, 7, 50, 1], 40, 240) == [0, 0, 0, 1]
    assert folds.together("abcd", [0, 0, 1, 2]) == [["a", "b"], ["c"], ["d"]]


def test_merging_small_pieces():
    groups = lambda *pieces: folds.merged([4 * n for n, _ in pieces], [h for _, h in pieces], 150, 800)
    assert groups((10, ""), (10, ""), (10, "")) == [0, 0, 0]
    assert groups((10, "a"), (200, "a"), (10, "b"), (200, "c")) == [0, 0, 1, 2]
    assert groups((795, ""), (10, "")) == [0, 1] and groups((780, ""), (10, "")) == [0, 0]
    assert groups((140, "a"), (140, "a"), (140, "a"), (200, "a")) == [0, 0, 0, 1] and groups() == []
    pieces = [c.Piece("x" * 40, "a", "s"), c.Piece("y" * 800, "a", "t"), c.Piece("z" * 40, "b")]
    assert [(len(p.content), p.heading, p.subheading) for p in c.merged(pieces, EngineConfig())] == [(40 + 2 + 800 + 2 + 40, "a", "t")]


def test_topics_part_at_headings():
    parts = c.segmented("# One\ncats chase mice daily\n\ncats chase mice nightly\n\n# Two\ncats chase mice daily\n\nwholly different words here", r"\n\s*\n")
    assert [(p.heading, p.subheading) for p in parts] == [("One", ""), ("One", ""), ("Two", ""), ("Two", "")]
    assert [p.content.count("\n\n") + 1 for p in c.topics(parts, EngineConfig())] == [2, 1, 1]
    assert folds.alike(["", "", ""], [["a", "b"], ["b", "c"], ["x", "a"]], 0.2) == [0, 0, 0]  # like the run, not like the one before
    assert folds.alike(["", "", ""], [["a", "b"], ["b", "c"], ["x", "a"]], 0.25) == [0, 0, 1] and folds.alike(["", ""], [[], []], 0.1) == [0, 1]


def test_python_and_jvm_rules_agree(spark, sf):
    from tidewell.operators.structure import segments

    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["Table of Contents\nIntro .... 3\nPage 2 of 3\nA – b\n\n\n\nDr. Who?  Yes. no", "## Head\n- x\n1. y\n| a | b |", "TOP\n\ncode `x`\n\nSub Title\nwords here\n\n# Great\n\nend", "Ääh. École. i.e. Fine! OK"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "doc_id int, text string")
    for r in df.select("text", t.clean(F.col("text")).alias("clean"), t.sentences(F.col("text")).alias("sents"), t.heading(F.split("text", "\n")[0]).alias("head"), t.words(F.col("text")).alias("ws"))\
            .select("*", t.keywords(F.col("ws")).alias("keys")).collect():
        assert r.clean == c.cleaned(r.text) and r.sents == c.sentences(r.text) and r.head == c.heading(r.text.split("\n")[0]) and set(r["keys"]) == c.keywords(r.text)
    for separator in (r"\n", r"\n\s*\n"):
        got = {}
        for r in segments(df, separator=separator).orderBy("doc_id", "pos").collect():
            got.setdefault(r.doc_id, []).append((r.content, r.heading, r.subheading, r.type))
        assert got == {i: found for i, x in enumerate(docs) if (found := [(p.content, p.heading, p.subheading, p.kind) for p in c.segmented(x, separator)])}


def test_speech_and_messages(spark):
    long = " ".join(f"This is sentence number {i} of the answer, and it is long enough." for i in range(20))
    texts = {1: "Short one.", 2: " ", 3: long, 4: "para one. " * 300 + "\n\n" + "para two. " * 300, 5: None, 6: "a\n\n\n\nb" * 3000, 7: "q" * 5000 + ". r \n\nend", 8: "Hi. " + "z" * 500 + "\nab. cd."}
    df = spark.createDataFrame(list(texts.items()), "k int, text string")
    got = {r.k: r for r in c.message_parts(c.speech_chunks(c.speech_sentences(df))).collect()}
    assert got[1].spoken == ["Short one."] and got[2].spoken == got[5].spoken == got[2].sentences == []
    assert len(got[3].spoken[0]) < 180 and all(len(x) <= 400 for x in got[3].spoken) and " ".join(got[3].spoken).split() == long.split()
    assert [len(x) for x in got[8].sentences] == [504, 7]
    assert got[1].parts == ["Short one."] and len(got[4].parts) == 2 and got[4].parts[0].startswith("*[Part 1/2]*\n\n")
    for k in (4, 6, 7):
        bare = [p.split("]*\n\n", 1)[1] for p in got[k].parts]
        assert "".join(bare).split() == "".join(texts[k]).split() or "".join("".join(bare).split()) == "".join(texts[k].split())
        assert sum(len(p) > 4096 for p in bare) == (k == 7)


def test_gap_clusters(spark):
    rows = [("t", 3, "How much?", [1.0, 0.0]), ("t", 2, "how much?", [0.99, 0.1]), ("t", 1, "Where?", [0.0, 1.0]), ("u", 1, "Why?", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "client_slug string, recency_key long, question string, vec array<double>")
    got = [(r.client_slug, r.representative, r.n, list(r.examples)) for r in learning.gap_clusters(df).orderBy("client_slug", "position").collect()]
    assert got == [("t", "How much?", 2, ["How much?", "how much?"]), ("t", "Where?", 1, ["Where?"]), ("u", "Why?", 1, ["Why?"])]


def test_json(tmp_path, spark):
    assert j.field_roles({"Title": "x", "price": 3, "note": "y" * 51, "kind_id": 1}) == (["Title", "note"], ["price", "kind_id"])
    assert j.structure('{"a": 1, "rows": [{"text": "x"}]}')["array_field"] == "rows" and j.structure("[]")["total_items"] == 0
    assert j.object_text({"id": 1, "text": " hi ", "tags": ["a", "b"], "deep": {"x_y": {"z": [{"q": 1}]}}, "none": None}, ["text"]) == "hi\nId: 1\nTags: a, b\nDeep: X Y: Z: {'q': 1}"
    (tmp_path / "k.json").write_text(json.dumps({"items": [{"name": "a"}, {"name": "b"}]}))
    got = files.load(spark, f"file://{tmp_path}/k.json").orderBy("item_no").collect()
    assert [(r.kind, r.item_no, json.loads(r.object)["name"]) for r in got] == [("object_with_array", 0, "a"), ("object_with_array", 1, "b")]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="invalid JSON"):
        files.load(spark, f"file://{tmp_path}/bad.json").collect()
    with pytest.raises(ValueError):
        files.load(spark, "x.doc")


def test_webhook(spark):
    message = lambda kind, body: {"type": kind, "from": "94", "id": "m", "text": {"body": body}}
    payload = {"entry": [{"changes": [{"value": {"metadata": {"phone_number_id": "7"}, "messages": [message("text", "hi"), message("image", "x"), message("text", "")]}}]}]}
    df = spark.createDataFrame([(json.dumps(payload),), ("{}",)], "payload string")
    assert [tuple(r) for r in files.webhook_messages(df).collect()] == [("7", "94", "m", "hi")]


def test_collections(spark, tmp_path):
    store = files.Collections(spark, f"file://{tmp_path}/chunks")
    rows = spark.createDataFrame([("c1", "hello", [1.0, 2.0])], "chunk_id string, text string, embedding array<double>")
    store.append("a", rows, 2)
    store.append("b", rows, 2)
    with pytest.raises(ValueError):
        store.append("a", rows, 3)
    assert store.read("a").count() == 1 and {r.client_slug: r.n for r in store.counts().collect()} == {"a": 1, "b": 1}
    assert store.drop("b") and {r.client_slug for r in store.counts().collect()} == {"a"}


def test_page_text():
    page = '<html><head><title>T  x</title><link rel="canonical" href="http://a/b"></head><body><nav>menu</nav><div class="sidebar">no</div><main><h1>H</h1><p>one<br>two</p><script>x</script></main><footer>f</footer></body></html>'
    assert html.read_page(page) == ("T x", "http://a/b", "H\none\ntwo")
    assert html.read_page(None) == ("", "", "") and html.read_page("<p>just <b>text")[2] == "just\ntext"


def test_models(spark):
    embed = models.hash_embedder(16)
    assert np.allclose(embed(["a b"]), embed(["b a"])) and np.allclose(np.linalg.norm(embed(["x"])[0]), 1)
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k int, text string")
    assert [r.k for r in models.embedded(df, lambda: embed).collect()] == [1]
    assert df.select(models.nfkc(F.lit("ﬁ…")).alias("x")).first().x == "fi..."
    score = df.select(models.rerank_column(F.lit("red fox"), F.lit("a red hat")).alias("x")).first().x
    assert score == 0.5
    got = df.select(models.guarded_rewrite(F.lit("abc"), F.lit("x" * 10)).alias("a"), models.guarded_rewrite(F.lit("abc"), F.lit(" fine ")).alias("b")).first()
    assert (got.a, got.b) == ("abc", "fine")
