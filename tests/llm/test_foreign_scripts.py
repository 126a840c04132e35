"""The language stage on foreign scripts, mixed languages and licence lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import language_id


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def words(table):
    """By language, many words of the data's own."""
    return {r.lang: " ".join(r.texts).replace("\n", " ").split() for r in table.where("n_chars < 3000").groupBy("lang").agg(F.sort_array(F.collect_list("text")).alias("texts")).collect()}


def part(words, lang, letters):
    out, n = [], 0
    for w in words[lang][100:]:
        if n >= letters:
            break
        out.append(w)
        n += sum(map(str.isalpha, w))
    return " ".join(out)


def test_only_documents_of_one_language_stay(spark, sf, table, words):
    russian, chinese = "Совершенно незнакомый язык этого длинного документа. " * 8, "人工智能技术的发展改变了世界。" * 20
    licence = "\nReleased under the MIT License."
    planted = {
        -1: (russian, False), -2: (chinese, False), -3: ("தமிழ் மொழி ஒரு பழமையான மொழி " * 10, False), -4: ("AI" + "人工智能技术的发展" * 30, False),
        -5: (part(words, "en", 150) + " " + russian, False), -6: (part(words, "en", 900) + " Привет мир", True),
        -7: (part(words, "en", 600) + "\n" + part(words, "fr", 600), False), -8: ("\n".join(part(words, x, 500) for x in ("en", "fr", "de")), False),
        -9: (part(words, "fr", 900) + "\n" + part(words, "en", 300), True),
        -10: (part(words, "es", 24) + licence, True), -11: (part(words, "fr", 24) + "\nThis work is licensed under the GNU General Public License, version 3.", True),
        -12: (russian + licence, False), -13: (part(words, "en", 600) + "\n" + part(words, "fr", 600) + licence, False), -14: ("123 !?", False), -15: (part(words, "de", 300), True)}
    extra = spark.createDataFrame([(k, t) for k, (t, _) in planted.items()], "doc_id long, text string")
    docs = table.unionByName(extra, allowMissingColumns=True).select(*table.columns)
    got = {r.doc_id: r.text for r in corpus_pipeline.by_language(spark, docs, sf).where("doc_id < 0").collect()}
    assert got == {k: t for k, (t, stays) in planted.items() if stays}


def test_letters_of_unlearned_scripts_count_only_in_the_whole(table):
    model = language_id.train(table)
    texts = ["the and that Привет", "Привет мир", "", "e\u0301te\u0301 e\u0301te\u0301", "人工智能技术", "12 !?"]
    languages, score, _ = language_id.identify_texts(texts, model)
    likely = model.languages[model.prior.argmax()]
    assert languages[1] == languages[4] == likely and languages[2] == languages[5] == "und" and score[[1, 2, 4, 5]].tolist() == [0, 0, 0, 0]
    assert abs(score[0] - 10 / 16) < 1e-9 and score[3] == 1
    assert language_id.identify_texts(["word"], language_id.train(table.limit(0)))[0] == ["und"]


def test_every_text_with_a_letter_gets_a_learned_language(spark, table):
    """The contract of op5: whatever the script."""
    model = language_id.train(table)
    rows = [(1, "Совершенно незнакомый язык"), (2, "人工智能"), (3, "தமிழ் மொழி"), (4, "the 人工智能技术的发展改变了世界 and"), (5, None), (6, " 1.5 \n"), (7, "é"), (8, "ℵ"), (9, "")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, spans=False).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {5, 6, 9}
    assert all(r.lang_pred in model.languages for k, r in got.items() if k not in (5, 6, 9)) and got[1].score == got[2].score == 0 and 0 < got[4].score < 0.6


def test_licence_lines():
    cut = language_id.without_licence_lines
    assert cut("a\nReleased under the MIT License.\nb") == "a\nb"
    assert cut("12\n© 2020 Someone") == "12\n© 2020 Someone" and cut("licence " * 40) == "licence " * 40
