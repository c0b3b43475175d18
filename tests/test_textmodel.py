"""Fitted classifiers (E3, E4): held-out accuracy, the vote as yardstick, odd rows, bounded samples."""

from pyspark.sql import functions as F

from skillgrid.operators import enrich as E
from skillgrid.operators.textmodel import TextClassifier, letters
from skillgrid.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}


def accuracy(df, want, got):
    return df.agg(F.avg(F.coalesce((F.col(want) == F.col(got)).cast("int"), F.lit(0))).alias("a")).first().a


def test_language_held_out_and_against_the_vote(spark):
    """Fitted on half of the documents, judged on the other half: at least the vote's accuracy, and 95 %."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    fit, other = docs.where("pmod(xxhash64(text), 2) = 0"), docs.where("pmod(xxhash64(text), 2) = 1")
    scored = TextClassifier().fit(fit, "text", "lang").score(other, "text", "got")
    voted = (other.withColumn("tok", E.tokenize_letters("text")).withColumn("got", E.detect_language("tok"))
             .replace({v: k for k, v in NAMES.items()}, subset=["got"]))
    mine, vote = accuracy(scored, "lang", "got"), accuracy(voted, "lang", "got")
    assert scored.count() == other.count() > 300
    assert mine >= vote and mine >= 0.95, (mine, vote)


def test_level_learns_its_words(spark):
    rows = [(i, "Easy", f"first steps gently number {i}") for i in range(30)] + [(i, "Hard", f"proofs and rigour number {i}") for i in range(30, 50)]
    fit = spark.createDataFrame(rows, "id int, level string, text string")
    ask = spark.createDataFrame([(1, "gently, please"), (2, "RIGOUR!"), (3, None), (4, "123 --"), (5, "")], "id int, text string")
    got = TextClassifier(unit="words", n=1).fit(fit, "text", "level").score(ask, "text", "level")
    assert {r.id: r.level for r in got.collect()} == {1: "Easy", 2: "Hard", 3: None, 4: None, 5: None}


def test_sample_is_bounded_and_no_labels_give_null(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_rank", F.lit(1)).withColumn("label", F.lit("clash"))
    names, sample = TextClassifier(sample_rows=80).sample(docs, "text", "lang")
    assert names == sorted(NAMES)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {k: 20 for k in NAMES}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    got = TextClassifier().fit(none, "text", "lang").score(docs, "text", "got")
    assert got.where("got IS NOT NULL").count() == 0 and got.count() == docs.count()
    assert TextClassifier().fit(docs.limit(0), "text", "lang").score(docs.limit(0), "text", "got").count() == 0


def test_copies_collapse_and_labels_without_letters(spark):
    rows = [("a", "copy of a text")] * 3000 + [("a", f"text {i}") for i in range(50)] + [("b", "12 34")]
    fit = spark.createDataFrame(rows, "label string, text string").repartition(8)
    _, sample = TextClassifier(sample_rows=40).sample(fit, "text", "label")
    got = [tuple(r) for r in sample.collect()]
    assert len(got) == len(set(got)) <= 21
    assert TextClassifier().fit(fit, "text", "label").score(fit.where("label = 'b'"), "text", "got").first().got is None


def test_one_label_and_repeated_rows(spark):
    fit = spark.createDataFrame([("x", "same words")] * 5, "label string, text string")
    assert {r.got for r in TextClassifier().fit(fit, "text", "label").score(fit, "text", "got").collect()} == {"x"}


def test_letters(spark):
    row = spark.createDataFrame([("Ärger,  über\n12x ",)], "t string").select(letters("t").alias("l")).first()
    assert row.l == " ärger über x "


def test_every_run_of_letters_is_counted(spark):
    """Hashed counts add up to the runs that a sliding window finds, for each unit and length."""
    docs = spark.createDataFrame([("Ab c",), ("😀 straße über",), ("a",), (None,)], "t string")
    low = [" ab c ", " straße über ", " a ", ""]
    for n in (1, 2, 3, 4):
        want = [max(0, len(x) - n + 1) for x in low]
        rows = TextClassifier(n=n).counts(docs, "t").collect()
        assert [sum(r._grams.values) for r in rows] == want and [r._any for r in rows] == [w > 0 for w in want]
        words = TextClassifier(unit="words", n=n).counts(docs, "t").collect()
        assert [sum(r._grams.values) for r in words] == [max(0, len(x.split()) - n + 1) for x in low]


def test_queries_score_every_row(spark):
    sf = "/root/testdata/sf0.001"
    lang = QUERIES["detect_language_fitted"](spark, sf)
    assert lang.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    levels = QUERIES["enrich_level_fitted"](spark, sf)
    assert levels.count() == QUERIES["enrich_level"](spark, sf).count() > 0
    assert levels.where("level IS NULL").count() == 0
