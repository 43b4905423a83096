import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import awkward, docs, empty, no_labels
from streamlearn.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_folding():
    assert X.folded("An ІDІОT, a c1own; tr4sh! ＬＯＳＥＲ $cum id!ot m0r0n###") == " an idiot a ciown trash ioser scum idiot moron "
    assert X.folded("pa$$word @home a@b") == X.folded("password home aab")
    assert X.folded("") == "  " and X.folded("i d i") == " i d i " and X.folded("Élan ÜBER") == " éian über "


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_both_ways_of_folding_agree(text):
    """Latin-1 text is folded through bytes, other text character by character; a Cyrillic word forces the latter."""
    assert X.folded(text + " ж") == X.folded(text).rstrip() + " ж "


@given(st.lists(st.sampled_from(["bad", "badly", "badger", "good", "ba", "sobad", "worse"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_matches_against_plain_search(words):
    entries = {" bad": 2.0, " badly ": 3.0, " wor": 1.0}
    exceptions = (" badger ", " good bad ")
    text = " " + " ".join(words) + " "
    want = 0.0
    for i, w in enumerate(words):
        spared = w == "badger" or (w == "bad" and i and words[i - 1] == "good")
        weights = [v for p, v in entries.items() if f" {w} ".startswith(p)]
        want += 0 if spared else max(weights, default=0)
    m = X.Lexicon(entries, exceptions).matcher()
    assert np.isclose(sum(m.words(text).values()), want)
    assert np.isclose(m.strength(text), want / np.log2(1 + text.count(" ")))


def test_held_out_labels(spark):
    got = X.op4_weighted_lexicon(spark, SF).toPandas()
    m = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    toxic = m[m.toxic == 1]
    assert len(toxic) > 100 and (toxic.predicted == 1).mean() > 0.85 and m[m.toxic == 0].predicted.mean() < 0.005
    assert ((got.score >= X.THRESHOLD) == (got.predicted == 1)).all()


def test_substituted_words_are_found(spark):
    bad, fine = "you are a moron and scum", "you are a friend and helper"
    texts = [f"{bad} {i}" for i in range(30)] + [f"{fine} {i} trash can" for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in range(90)], "doc_id long, quality int, toxic int")
    lexicon = X.fit(docs(spark, texts), labels)
    d = docs(spark, ["what a m0r0n you are, sсum", "what a friend you are", "the trash can", "MORON"])
    score = [r["score"] for r in X.score(d, lexicon).orderBy("doc_id").collect()]
    assert score[0] > 0.7 and score[3] > 0.7 and score[1] < 0.3 and score[2] < 0.3


def test_learnt_exceptions(spark):
    texts = [f"grim lie x{i}" for i in range(40)] + [f"grimsby town y{i}" for i in range(20)] + [f"calm z{i}" for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(460)], "doc_id long, quality int, toxic int")
    lexicon = X.fit(docs(spark, texts), labels, held=99)
    m = lexicon.matcher()
    assert m.words(X.folded("grim day")) and not m.words(X.folded("grimsby town"))


def test_awkward_rows(spark):
    d = awkward(spark, True)
    lexicon = X.fit(d, spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, 1, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int"), held=99)
    got = X.score(d, lexicon, keep=d.columns)
    assert got.count() == d.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    none = X.fit(d, no_labels(spark))
    assert len({r["score"] for r in X.score(d, none).collect()}) == 1 and X.score(empty(spark), none).count() == 0


def test_repeated_ids_train_once(spark):
    """Rows that repeat an id count as its smallest text, so copies of a labelled row do not change the lexicon."""
    texts = [f"you utter zorgblat number {i} again" for i in range(30)] + [f"a calm note number {i} again" for i in range(90)]
    ids = list(range(len(texts)))
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in ids], "doc_id long, quality int, toxic int")
    once, copied = docs(spark, texts, ids), docs(spark, texts + texts[:5] * 20 + ["zz other words"] * 3, ids + ids[:5] * 20 + [0, 1, 40])
    a, b = X.fit(once, labels, mod=1, held=5), X.fit(copied, labels, mod=1, held=5)
    assert a.entries == b.entries and a.exceptions == b.exceptions and (a.slope, a.bias) == (b.slope, b.bias) and a.entries
