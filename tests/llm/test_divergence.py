import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from helpers import DOCS, awkward, empty
from streamlearn.llm import divergence as D


def plain(rows, min_docs=3, top=200):
    """[(lang, source, text)] -> result rows, by dictionaries and Python integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = Counter(w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        n[lang, source].update(words)
        docs[lang].update(words.keys())
    out = []
    for lang, sources in groups.items():
        vocab = [t for t, d in docs[lang].items() if d >= min_docs]
        total = {t: sum(n[lang, s][t] for s in sources) for t in vocab}

        def shares(counts):
            whole = sum(counts.values()) + len(vocab)
            return {t: 1 + 10**9 * (c + 1) // whole for t, c in counts.items()}
        q = shares(total)
        p = {s: shares({t: n[lang, s][t] for t in vocab}) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in vocab)) for o in sources - {s}]
            terms = [(t, f(p[s][t], q[t])) for t in vocab if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_whole_table(spark):
    rows = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(D.op13_source_divergence(spark, SF_SMALL)) == plain(rows)


@pytest.mark.parametrize("min_docs,top", [(1, 200), (2, 2), (3, 1)])
def test_rules(spark, min_docs, top):
    rows = [("en", "a", "The the THE cat_cat"), ("en", "a", "the dog"), ("en", "b", "the Äpfel äpfel"), ("en", "b", "cat 3dog"), ("en", None, None),
            ("en", "c", "... 12"), (None, "a", "the"), (None, None, "the"), (None, "b", "the the"), ("xx", "a", ""), ("xx", "b", "!"), ("yy", "only", "word word word"),
            ("yy", "only", "word"), ("yy", "only", "word"), ("en", "a", "the dog")] * 2
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (lang, s, t) in enumerate(rows)], DOCS)
    assert got(D.divergence(df, min_docs, top)) == plain(rows, min_docs, top)


def test_awkward_and_empty(spark):
    df = awkward(spark, extra=True)
    assert got(D.divergence(df)) == plain([(r["lang"], r["source"], r["text"]) for r in df.collect()])
    assert got(D.divergence(empty(spark))) == []


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=3, max_size=3), st.integers(1, 5)), min_size=1, max_size=30), st.integers(0, 10**12))
@settings(max_examples=200, deadline=None)
def test_pair_sums(rows, more):
    counts, runs = np.array([r for r, _ in rows], np.int64), np.array([k for _, k in rows], np.int64)
    counts[0] += [more, 0, more // 7]
    sizes, terms = (counts * runs[:, None]).sum(axis=0), int(runs.sum())
    p = [[1 + 10**9 * (int(c) + 1) // (int(sizes[j]) + terms) for c in counts[:, j]] for j in range(3)]
    out = D.pair_sums(counts, runs, sizes, terms)
    for g in range(3):
        for q in range(3):
            if g != q:
                assert out[g, q] == sum((a - b) ** 2 // b * int(k) for a, b, k in zip(p[g], p[q], runs))


def test_flush_and_layout_bounds_change_nothing(spark, monkeypatch):
    """Partial counts and pieces of runs add up to the same sums (run here, not on workers)."""
    rng = np.random.default_rng(1)
    counts, runs = rng.integers(0, 4, (50, 4)), rng.integers(1, 9, 50)
    sizes, terms = (counts * runs[:, None]).sum(axis=0), int(runs.sum())
    whole = D.pair_sums(counts, runs, sizes, terms)
    parts = sum(D.pair_sums(counts[i:i + 7], runs[i:i + 7], sizes, terms) for i in range(0, 50, 7))
    assert (whole == parts).all()


def test_share_agrees_with_python(spark):
    rows = [(0, 1), (0, 7), (5, 6), (10**15, 10**15 + 1), (10**14, 8 * 10**15), (3, 10**9)]
    df = spark.createDataFrame(rows, "c long, w long").select(D.share("c", "w").alias("s"))
    want = [1 + 10**9 * (c + 1) // w for c, w in rows]
    assert [r.s for r in df.collect()] == want
    assert [int(D.shares(np.array([c]), w)[0]) for c, w in rows] == want
