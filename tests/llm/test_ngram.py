import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import awkward, docs, empty
from streamlearn.llm import ngram as G

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        rows = [tokens(t) for t in texts]
        self.c = Counter(w for d in rows for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.two = Counter(p for d in rows for p in zip([0] + d[:-1], d))
        self.context, self.after, self.before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
        for (v, w), k in self.two.items():
            self.context[v] += k
            self.after[v][min(k, 3) - 1] += 1
            self.before[w] += 1
        self.d, self.u = self.discounts(self.two.values()), self.discounts(self.before.values())

    @staticmethod
    def discounts(counts):
        n = [0] + [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [0] + [min(max(x, 0.05), i) for i, x in enumerate(d[1:], 1)]

    def p1(self, w):
        if not self.two:
            return 1.0
        x = self.before.get(w, 0)
        rest = sum(self.u[min(k, 3)] for k in self.before.values())
        return (max(x - self.u[min(x, 3)], 0) + rest / (self.v + 1)) / len(self.two)

    def p2(self, v, w):
        if not self.context.get(v):
            return self.p1(w)
        k = self.two.get((v, w), 0)
        back = sum(self.d[i + 1] * n for i, n in enumerate(self.after[v])) / self.context[v]
        return max(k - self.d[min(k, 3)], 0) / self.context[v] + back * self.p1(w)

    def scores(self, text):
        d = tokens(text)
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in d)
        return len(d), sum(self.c[w] > 0 for w in d), base, sum(math.log10(self.p2(v, w)) for v, w in zip([0] + d[:-1], d))


def same(row, want):
    assert (row["n_tokens"], row["n_known"]) == want[:2]
    assert np.allclose([row["base_score"], row["score"]], want[2:], rtol=1e-9)


def test_query_against_dictionaries(spark):
    got = G.op9_kneser_ney(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    m = Plain([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10])
    assert len(got) == len(texts) and {r["train_tokens"] for r in got} == {m.n}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        same(r, m.scores(texts[r["doc_id"]]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "b c c a a d", "a", "d d d d e a b c a b f"]
    m, model = Plain(texts), G.train(docs(spark, texts))
    vocabulary = sorted(w for w in m.c if w) + [b"unseen"]
    for v in [b"", b"a", b"d", b"unseen"]:
        # p(w | v) from the score of "v w" less that of what stands around it
        p = [10 ** (model.score([v + b" " + w])["score"][0] - model.score([v])["score"][0]) for w in vocabulary]
        del p
        assert np.isclose(sum(m.p2(v or 0, w) for w in [*vocabulary, None]), 1.0)


@pytest.mark.parametrize("bucket_bytes,chunk", [(10, 3), (50, 10), (10**9, 10**6)])
def test_grid_and_chunks_do_not_change_the_model(spark, monkeypatch, bucket_bytes, chunk):
    monkeypatch.setattr(G, "CHUNK_TOKENS", chunk)
    texts = ["the cat sat on the mat", "The dog sat", "the the the the", "", None, "cat dog cat dog mat"] * 3
    d, m = docs(spark, texts).repartition(3), Plain(texts)
    model = G.train(d, bucket_bytes)
    for r in G.score(d, model, keep=["text"]).collect():
        same(r, m.scores(r["text"]))


def test_nothing_to_learn_from(spark):
    model = G.train(empty(spark))
    r = G.score(docs(spark, ["a b", None]), model).collect()
    assert [x["score"] for x in r] == [0.0, 0.0] and r[0]["n_known"] == 0 and G.score(empty(spark), model).count() == 0


def test_awkward_rows(spark):
    d = awkward(spark, True)
    model = G.train(d)
    got = G.score(d, model, keep=d.columns)
    assert got.count() == d.count() and {"doc_id", "text", "fp", "score"} <= set(got.columns)
    m = Plain([r["text"] for r in d.collect()])
    for r in got.collect():
        same(r, m.scores(r["text"]))


def test_a_folder_that_is_not_mounted():
    assert G.local_folder("file:///a/b") == G.local_folder("file:/a/b") == G.local_folder("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        G.local_folder("hdfs://x/a")
