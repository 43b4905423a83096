import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import awkward, docs, empty
from streamlearn.llm import license_scan as L

SF = "/root/testdata/sf0.001"


@given(st.lists(st.integers(0, 30), max_size=25, unique=True))
@settings(max_examples=200, deadline=None)
def test_longest_increasing_subsequence(js):
    got = L._increasing(list(enumerate(js)))
    best = [1] * len(js)
    for i, x in enumerate(js):
        best[i] = 1 + max((best[k] for k in range(i) if js[k] < x), default=0)
    assert len(got) == max(best, default=0) and all(a < b and x < y for (a, x), (b, y) in zip(got, got[1:]))


@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_is_a_common_subsequence(a, b):
    got = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(i < i2 and j < j2 for (i, j), (i2, j2) in zip(got, got[1:]))
    assert len(L.patience(a, a)) == len(a)
    if len(set(a)) == len(a) and len(set(b)) == len(b):                  # all words unique: the longest common subsequence
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        assert len(got) == n[-1][-1]


def test_every_template_is_found_in_noise():
    rng, s = random.Random(8), L.Scanner()
    noise = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    for name, words in s.templates:
        text = noise(30) + words + noise(20) + words + noise(5)
        got = s.scan(text)
        assert [(m.license, m.first, m.last) for m in got] == [(name, 30, 30 + len(words)), (name, 50 + len(words), 50 + 2 * len(words))]
        assert all(m.coverage == 1.0 for m in got)
        if len(words) > 20:                                              # a few changed words
            changed = [w if rng.random() > 0.06 else "changed" for w in words]
            assert [m.license for m in s.scan(noise(9) + changed + noise(9))] == [name]
    assert s.scan(noise(500)) == []


def test_densest_run():
    assert L.densest([(0, 0), (1, 1), (2, 3), (30, 4), (31, 5)]) == [(0, 0), (1, 1), (2, 3)]
    assert L.densest([(0, 0), (9, 1), (10, 2)]) == [(9, 1), (10, 2)] and L.densest([(4, 4)]) == [(4, 4)] and L.densest([]) == []
    assert L.densest([(0, 0), (1, 1), (3, 2), (4, 3)]) == [(0, 0), (1, 1), (3, 2), (4, 3)]


def test_adjacent_edited_notices():
    """Two copies of a notice next to each other, each with 6 % of its words deleted, are two matches wherever each alone is one."""
    rng, s, tried = random.Random(1), L.Scanner(), 0
    for name, words in s.templates:
        if len(words) < 10:
            continue
        for _ in range(60):
            one, two = ([w for w in words if rng.random() > 0.06] for _ in range(2))
            if [[m.license for m in s.scan(c)] for c in (one, two)] == [[name], [name]]:
                tried += 1
                got = s.scan(one + two)
                assert [m.license for m in got] == [name, name], (name, one, two)
                assert got[0].last <= got[1].first
    assert tried > 500


def test_query_against_plain_lines(spark):
    got = sorted((r["doc_id"], r["license"], r["span_start"]) for r in L.op5_patience_licenses(spark, SF).collect())
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for name, line in L.TEMPLATES.items():
            if name.endswith("line"):
                at = r["text"].find(line)
                while at >= 0:
                    want.append((r["doc_id"], name, at))
                    at = r["text"].find(line, at + 1)
    assert set(want) <= set(got) and want


def test_spans_and_changed_case(spark):
    text = "Ä prefix. LICENSED under the apache license -- version 2.0! Rest; licensed under CC BY-NC 4.0"
    got = L.scan(docs(spark, [text])).orderBy("span_start").collect()
    assert [(r["license"], text[r["span_start"]:r["span_end"]]) for r in got] == [
        ("Apache-2.0 line", "LICENSED under the apache license -- version 2.0"), ("CC-BY-NC-4.0 line", "licensed under CC BY-NC 4.0")]
    assert SequenceMatcher(None, "a", "a").ratio() == 1


def test_awkward_rows(spark):
    assert L.scan(awkward(spark, True)).count() == 0 and L.scan(empty(spark)).count() == 0
    many = "Released under the MIT License. " * 2000
    got = L.scan(docs(spark, [many, None, many], [1, None, 1])).collect()
    assert len(got) == 4000 and {r["coverage"] for r in got} == {1.0}
