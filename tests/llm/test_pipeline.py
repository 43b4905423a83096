import numpy as np

import corpus_pipeline as P
from helpers import LABELS, awkward, empty
from streamlearn.llm import decontaminate, packing, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    """Each stage on its input, by a plain loop over the rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {i: t for i, t in rows.items() if model.predict(quality.document_statistics([t.encode()]))[0] >= quality.THRESHOLD}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in keep.items()}
    ids, seen = sorted(keep), {}
    f = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    for i in range(len(ids)):                                       # components by search
        if i not in seen:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in seen:
                    seen[k] = i
                    stack += np.nonzero(near[k])[0].tolist()
    keep = {ids[i]: keep[ids[i]] for i in range(len(ids)) if seen[i] == i}
    matcher = decontaminate.Matcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    keep = {i: t for i, t in keep.items() if not matcher.matches(decontaminate.normalised(t))}
    crf = pii.fit(pii.training_table(spark))
    keep = {i: pii.masked(t, pii.find_spans(crf, [t.encode()])[0][1]) for i, t in keep.items()}
    tok = packing.ChunkTokenizer(str(packing.public_tokenizers.path("word_bpe_49k.json")))
    length = {i: len(tok.ids([t])[0]) // 4 + 1 for i, t in keep.items()}
    got = P.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(keep) and len(keep) < len(rows)
    assert got.groupby("doc_id").length.sum().to_dict() == length
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_stages_keep_columns(spark, tmp_path):
    d = awkward(spark, True)
    folder = str(tmp_path)
    spark.createDataFrame([(5, 1, 0), (4, 1, 0)], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such words anywhere in these texts at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    d.write.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, d, folder)
        assert out.columns == d.columns and 0 < out.count() <= d.count()
        assert stage(spark, empty(spark), folder).count() == 0
    assert P.STAGES[-1][1](spark, d, folder).count() >= d.count()
    assert P.STAGES[-1][1](spark, empty(spark), folder).count() == 0
    assert P.run(spark, folder).count() > 0
