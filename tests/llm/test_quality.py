import numpy as np

from helpers import awkward, docs, empty, no_labels
from streamlearn.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_trees_equal_row_by_row_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    m = Q.fit_trees(x, y, trees=20, depth=3)

    def walk(row):
        z = m.base
        for f, c, leaf in zip(m.feature, m.cut, m.leaf):
            node = 0
            for _ in range(m.depth):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            z += leaf[node - (2 ** m.depth - 1)]
        return 1 / (1 + np.exp(-z))
    p = m.predict(x)
    assert np.allclose(p, [walk(r) for r in x])
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97


def test_first_split_is_the_best_of_all_cuts():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = (x[:, 1] > 4).astype(float)
    m = Q.fit_trees(x, y, trees=1, depth=1)
    assert m.feature[0, 0] == 1 and 4 <= m.cut[0, 0] < 5


def test_statistics_by_hand():
    s = dict(zip(Q.FEATURES, Q.document_statistics(["Ab é!\nab".encode()])[0]))
    assert s["log_words"] == np.log1p(3) and s["log_lines"] == np.log1p(2) and s["log_chars"] == np.log1p(8)
    assert s["distinct_words"] == 2 / 3 and np.isclose(s["upper"], 1 / 8) and np.isclose(s["end"], 1 / 8)
    assert not Q.document_statistics([b""])[0].any()


def test_held_out_accuracy(spark):
    got = Q.op10_quality_trees(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    m = got[got.held_out].merge(labels, on="doc_id")
    assert len(m) > 20 and (m.predicted == m.quality).mean() > 0.93
    assert ((got.score >= Q.THRESHOLD) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_label_bound_is_kept(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from streamlearn.llm.common import bounded_labels
    assert len(bounded_labels(lab, "quality", 50, 5, 0)) <= 50
    assert Q.fit(d, lab, max_rows=50).leaf.shape[0] > 0


def test_awkward_rows(spark):
    model = Q.fit(awkward(spark, True), spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    d = awkward(spark, True)
    got = Q.score(d, model, keep=d.columns)
    assert got.count() == d.count() and set(got.columns) == set(d.columns)
    assert Q.keep_accepted(d, model).columns == d.columns
    plain = Q.fit(d, no_labels(spark))
    assert {r.score for r in Q.score(d, plain).collect()} == {0.5}
    assert Q.score(empty(spark), plain).count() == 0 and Q.fit(empty(spark), no_labels(spark)).predict(np.zeros((1, len(Q.FEATURES)))) == 0.5
    same = Q.score(docs(spark, [None, "", ""]), model).toPandas().score
    assert same.nunique() == 1


def same_trees(a, b):
    return a.base == b.base and all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("feature", "cut", "leaf"))


def test_repeated_ids_train_once(spark):
    """Copies of an id, with the same text or another, leave the fit as it is: only its least statistics count."""
    from pyspark.sql import functions as F
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    d = spark.read.parquet(f"{SF}/documents.parquet").join(lab.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    model = Q.fit(d, lab)
    copies = d.withColumn("_c", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 7 == 0, 60).otherwise(1)))).drop("_c")
    assert copies.count() > 5 * d.count() and same_trees(Q.fit(copies, lab), model)
    longer = d.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" some more words that follow")))
    short, long = Q.document_statistics([b"x", b"x some more words that follow"]).tolist()
    assert short < long and same_trees(Q.fit(d.union(longer), lab), model)


def test_whole_result_against_plain_walk(spark):
    """Every document of the table: statistics one by one, trees walked node by node."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = Q.fit(d, lab)
    got = {r.doc_id: r for r in Q.op10_quality_trees(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == d.count()
    for r in d.collect():
        row, z = Q.document_statistics([(r.text or "").encode()])[0], m.base
        for f, c, leaf in zip(m.feature, m.cut, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            z += leaf[node - len(f)]
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-12 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
