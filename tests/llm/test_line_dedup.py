import hashlib
from collections import defaultdict

import pytest

from conftest import SF_SMALL
from helpers import awkward, docs, empty
from streamlearn.llm import line_dedup as L

LONG = "this line is long enough to be counted as one"


def plain(rows, least=40, min_docs=5):
    """[(id, text)] -> [(id, n_lines, n_dropped, text)] by dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=repr)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows)]
    assert sorted((tuple(r) for r in L.op11_line_dedup(spark, SF_SMALL).collect()), key=repr) == sorted(want, key=repr)
    assert any(d for _, _, d, _ in want)


@pytest.mark.parametrize("extra", [False, True])
def test_rules(spark, extra):
    texts = [f"{LONG}\nown {i}" for i in range(6)]
    texts[2] = f" \t{LONG.upper()}\r\nown 2\n{LONG}"                # another writing, twice
    texts[4] = f"{LONG}\x85\nown 4"                                # U+0085 is no blank: another key
    texts += ["é" * 39 + "\nshort"] * 6 + ["é" * 40] * 6           # code points, not bytes
    texts += [None, "", "\n", "\n".join([LONG] * 3)]
    df = docs(spark, texts, extra=extra).repartition(5)
    out = L.dedup_lines(df)
    assert got(out) == plain(list(enumerate(texts)))
    assert {c for c in df.columns} <= set(out.columns)
    if extra:
        assert out.filter("key = 'extra' and part = 'extra'").count() == len(texts)


def test_repeated_and_null_ids(spark):
    ids = [1, 1, 1, 1, 1, 2, 3, 4, None, None]
    texts = [LONG] * 5 + [LONG, "x", LONG, LONG, f"{LONG}\ny"]
    assert got(L.dedup_lines(docs(spark, texts, ids), min_docs=4)) == plain(list(zip(ids, texts)), min_docs=4)
    assert got(L.dedup_lines(docs(spark, texts, ids), min_docs=5)) == plain(list(zip(ids, texts)), min_docs=5)     # four ids: nothing goes


def test_awkward_and_empty(spark):
    df = awkward(spark, extra=True)
    assert got(L.dedup_lines(df)) == plain([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got(L.dedup_lines(empty(spark))) == []


def test_writes_no_files_and_parses_twice(spark, tmp_path, monkeypatch):
    """The keys go through shuffles alone, and the two readers of the hits share one of them."""
    made = []
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda self, path, *a, **k: made.append(path))
    texts = [f"{LONG}\n{LONG} {i % 3}\nown {i}" for i in range(30)]
    out = L.dedup_lines(docs(spark, texts))
    assert got(out) == plain(list(enumerate(texts))) and not made
    lost = L.lost_lines(L.long_lines(docs(spark, texts)))
    lost.collect()
    plan = lost._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("MapInArrow") == 2
