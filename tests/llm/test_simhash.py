import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import awkward, docs, empty
from streamlearn.llm import simhash as S
from streamlearn.llm.graph import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps) -> list[int]:
    """Index of the least member for each of distinct fingerprints, by all pairs."""
    f = np.array(fps, np.uint64)
    label = list(range(len(f)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)):
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return [root(i) for i in range(len(f))]


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_bit_counts_over_many_blocks():
    h = np.random.default_rng(1).integers(0, 2**63, 70_001).astype(np.uint64) * np.uint64(3)
    want = [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert S.bit_counts(h).tolist() == want


def test_golay_indices_are_all_codewords_within_four():
    g = S.Golay()
    data = np.arange(4096)
    code = (data << 11) | S._remainder(data << 11)
    assert min(np.bitwise_count(code[1:])) == 7                        # the perfect code's distance
    for w in np.random.default_rng(3).integers(0, 2**23, 300):
        want = set(data[np.bitwise_count(code ^ w) <= 4].tolist())
        assert want == {int(x) for x in g.indices(np.array([w]))[0] if x >= 0}


def test_linked_fingerprints_share_a_key():
    rng, g = np.random.default_rng(4), S.Golay()
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for p in rng.choice(64, rng.integers(0, 5), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(p)
    keys = [set(zip(*(x.tolist() for x in S.fuzzy_keys(f, g)))) for f in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(a)))


@pytest.mark.parametrize("run", [3, 2048])
def test_links_connect_as_all_pairs_do(spark, run):
    """Dense clusters; the small run length sends them through block pairs."""
    rng, points = np.random.default_rng(5), set()
    for x in rng.integers(0, 2**63, 6):
        for _ in range(25):
            y = int(x)
            for p in rng.choice(64, rng.integers(0, 6), replace=False):
                y ^= 1 << int(p)
            points.add(y & (2**64 - 1))
    points = np.array(sorted(points), np.uint64)
    signed = points.view(np.int64).tolist()
    fps = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    root = {r["u"]: r["root"] for r in components(S.links(fps, 4, run)).collect()}
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups([root.get(x, x) for x in signed]) == groups(plain_components(points))


def test_components_of_a_path_and_awkward_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 101), (7, 7), (None, 3), (3, None)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_all_pairs(spark):
    got = S.op3_simhash_golay(spark, SF).toPandas().sort_values("doc_id")
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    assert all(f == f"{plain_fingerprint(texts[i]):016x}" for i, f in zip(got.doc_id, got.fingerprint))
    fps = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    u, at = np.unique(fps, return_inverse=True)
    label, ids = np.array(plain_components(u))[at], got.doc_id.to_numpy()
    assert got.component_id.tolist() == [ids[label == x].min() for x in label]


def test_awkward_rows(spark):
    d = awkward(spark, True)
    got = S.near_duplicates(d).collect()
    assert len(got) == d.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    kept = S.keep_first(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 1 and 2 not in ids and 1 in ids
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_first(empty(spark)).count() == 0


def test_repeated_ids_are_told_apart_by_row(spark):
    """Different texts under one id that lead their own components all stay; a near copy of another document does not."""
    a, b, c = (" ".join(f"{w}{i * i % 89}" for i in range(60)) for w in ("north", "red", "lake"))
    d = docs(spark, [a, a, b, c, b, c, c], [1, 5, 5, 5, 7, 8, 5], extra=True)
    kept = S.keep_first(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (5, b), (5, c)])


def test_only_null_ids(spark):
    got = S.near_duplicates(docs(spark, ["same text here now", "same text here now"], [None, None])).collect()
    assert [r["component_id"] for r in got] == [None, None]
