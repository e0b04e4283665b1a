"""Text functions on English, Hindi and Telugu, by column and by driver function alike."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import query as Q
from tessera.functions import text as T


def one(spark, value, function, *more):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x"), *more)).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Network SECURITY, the Net", ["network", "security", "the", "net"]),
        ("see https://a.b/c?d www.x.y me@x.org end", ["see", "end"]),
        ("విద్య Security १२३ é1", ["విద్య", "security", "१२३", "1"]),
        ("ABCవిద్య", ["ABCవిద్య"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, text, T.tokens) == expected


@pytest.mark.parametrize("text", ["Network security 123 12345 १२३ a " + "x" * 51, "the और మరియు విద్య", "mixed Case me@x.org 00000"])
def test_terms_agree_with_the_driver(spark, text):
    assert one(spark, text, T.terms) == Q.searched_terms(text)
    assert one(spark, text, T.language) == Q.language(text)


@pytest.mark.parametrize("text, expected", [("విద్య", "te"), ("network", "en"), ("123", "en"), ("सुरक्षा", "hi"), ("", "en"), ("ab सुर", "hi")])
def test_language(spark, text, expected):
    assert one(spark, text, T.language) == expected == Q.language(text)


def test_labels_and_stopwords(spark):
    assert one(spark, "123", T.language_label) == "en" and one(spark, "abc", T.language_label) == "English" and one(spark, "विद्या", T.language_label) == "Hindi"
    assert [len(set(x)) for x in (fixed.ENGLISH_STOPWORDS, fixed.HINDI_STOPWORDS, fixed.TELUGU_STOPWORDS)] == [126, 83, 57]


def test_ngrams_and_names(spark):
    assert one(spark, "ab the", T.ngrams) == ["$a", "ab", "b$"]
    assert one(spark, "s-1_Mark.sheet.pdf", T.normal_name) == "s 1 mark.sheet"
    assert one(spark, "x..xlsx", T.normal_name) == "x."
    assert [one(spark, p, T.file_type) for p in ("a/B.PDF", "a.tar.md", "a", "x.webp", ".txt")] == ["pdf", "text", "unknown", "image", "text"]


def test_name_terms(spark):
    got = one(spark, "body", lambda x: T.with_name_terms(x, F.lit("d/My-id_card.txt")))
    assert got == "body\n\nmy id card identity card student id id card identity identity card student student id"
    assert one(spark, "body", lambda x: T.with_name_terms(x, F.lit("d/plain.txt"))) == "body\n\nplain"


def test_encoder_inputs(spark):
    assert one(spark, " a b ", T.embedding_input, True) == "query: a b" and one(spark, "  ", T.embedding_input, False) == ""
    assert one(spark, " a\n b " + "x" * 2000, T.rerank_input) == "a b " + "x" * 1196
    for text in ("a AND b or* c?", '"er en"', "'x not y'"):
        assert one(spark, text, T.plain_query).split() == Q.plain(text).split()


def test_snippets(spark):
    text = "x" * 100 + " needle " + "y" * 300
    got = one(spark, text, T.snippet, "Needle absent")
    assert got == "..." + text[101 - 66 : 101 - 66 + 200].strip() + "..."
    assert one(spark, "short text", T.snippet, "text") == "short text"
    assert one(spark, "z" * 250, T.snippet, "") == "z" * 200 + "..." and one(spark, None, T.snippet, "a") == ""


@pytest.mark.parametrize("line, expected", [("Heading here:", True), ("ALL UPPER WORDS", True), ("Section 12 of it", True), ("Plain line", False), ("ABC:", False), ("1234567", False)])
def test_headings(spark, line, expected):
    assert one(spark, line, T.is_heading) is expected


def test_query_parsing():
    p = Q.parse("id card")
    assert p.weighted_terms == {"id": 1.4, "card": 1.2, "identity": 1.5, "identity card": 1.5, "student id": 0.3, "id proof": 0.3} and p.intent == ["id"]
    assert Q.parse("network security").expand_reason == "strong_phrase" and Q.parse("api design").expand_reason == "technical_phrase"
    assert Q.parse("document form").expandable and Q.parse("security").expanded_terms == ["protection", "safety"]
    assert Q.parse("విద్య").expanded_terms == ["చదువు", "శిక్షణ"]
    assert [Q.parse(x).type for x in ("", "terms and conditions", '"a and b"', '"er en"', "net*", "what is it?", "plain")] == ["empty", "boolean", "boolean", "phrase", "wildcard", "wildcard", "free_text"]
    assert Q.fusion_weights(Q.parse("network security")) == (0.4, 0.8)
    assert Q.fusion_weights(Q.parse("alpha beta gamma delta epsilon zeta 12345")) == (0.55, 1.0)


def test_clean_synonyms():
    table = {"en": {"net": ["Net", "network", "internet", "web site", "mesh", "NETWORK", "grid", 7]}, "hi": {"पानी": ["पानी", "जल"]}, "te": {"x": ["x"]}}
    assert Q.clean_synonyms(table) == {"en": {"net": ["network", "mesh"]}, "hi": {"पानी": ["जल"]}, "te": {}}


def test_ngrams_are_cut_once_a_term(spark):
    """Each distinct term is cut once: the rows that are cut are no more than there are terms, whatever their copies."""
    docs = spark.createDataFrame([("ab the ab cdé AB",), (None,), ("a 12 x@y.z 12345 ab",), ("ab " * 500,)], "text string")
    got = T.ngram_counts(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.count("Aggregate") == 2
    assert "Aggregate [term" in plan
    one_by_one = docs.select(F.explode(T.ngrams(F.col("text"))).alias("ngram")).groupBy("ngram").count()
    counts = lambda df, n: {r["ngram"]: r[n] for r in df.collect()}
    assert counts(got, "n") == counts(one_by_one, "count") and counts(got, "n")["ab"] == 504
