import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import awkward, docs, empty
from streamlearn.llm import packing as P

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_ids_of_the_whole_text(whole, text):
    got = np.frombuffer(P.ChunkTokenizer(PATH).ids([text])[0], "<u4").tolist() if not hasattr(whole, "chunks") else None
    assert got == whole.encode(text, add_special_tokens=False).ids


def placed(df):
    """Check what holds for any packing; the rows, and the number of sequences."""
    rows = df.toPandas().sort_values(["sequence_id", "offset"])
    at = rows.groupby("sequence_id").length.cumsum() - rows.length
    assert (at == rows.offset).all()
    return rows, rows.groupby("sequence_id").length.sum()


def test_query(spark, whole):
    rows, fill = placed(P.op7_best_fit_packing(spark, SF))
    assert fill.max() <= P.CAPACITY
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for i, t in texts:
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), P.CAPACITY):
            cut = ids[k:k + P.CAPACITY]
            want.add((i, k // P.CAPACITY, k, len(cut), zlib.crc32(cut.tobytes())))
    assert want == set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) and len(want) == len(rows)
    assert len(fill) <= 1.01 * rows.length.sum() / P.CAPACITY + 2


@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_rank_once(lengths, groups):
    """The plan over a histogram, followed piece by piece."""
    cap, small = 64, 16
    hist = Counter(lengths)
    big = {x: n for x, n in hist.items() if x > small}
    little = {x: n for x, n in hist.items() if x <= small}
    runs, bins = P.plan_large(big, cap, groups)
    order = np.array(sorted((x for x in lengths if x > small), reverse=True), int)
    used = np.zeros(bins, int)
    if len(order):
        np.add.at(used, runs.bins(np.arange(len(order))), order)
    assert not bins or used.max() <= cap and used.min() > 0
    room = np.sort(cap - used)
    runs, new = P.plan_small(little, dict(Counter(room.tolist())), len(order), cap)
    rest = np.array(sorted((x for x in lengths if x <= small), reverse=True), int)
    left = np.concatenate([room, np.full(new, cap)])
    if len(rest):
        np.subtract.at(left, runs.bins(len(order) + np.arange(len(rest))), rest)
    assert not len(left) or left.min() >= 0


def test_configurations_reach_the_best_packing_of_a_small_case():
    """Sizes 6, 5 and 3 in bins of 14: 6+5+3 ten times is perfect."""
    plan = P.configurations(np.array([6, 5, 3]), np.array([10, 10, 10]), 14)
    got = sum(c * n for c, n in plan)
    assert (got == 10).all() and sum(n for _, n in plan) == 10


@pytest.mark.parametrize("value,size,cap", [([3.0, 4.0, 5.0], [3, 4, 5], 13), ([1.0, 2.1], [2, 4], 9), ([1.0], [5], 4)])
def test_knapsack(value, size, cap):
    import itertools
    got = P._knapsack(np.array(value), np.array(size), cap)
    best = max(sum(v * n for v, n in zip(value, c)) for c in itertools.product(range(8), repeat=len(size)) if sum(s * n for s, n in zip(size, c)) <= cap)
    assert got @ np.array(size) <= cap and np.isclose(got @ np.array(value), best)


def test_equal_lengths_and_full_pieces(spark):
    """Many pieces of one length, pieces that fill a sequence, repeated rows."""
    rows = [(i % 50, 0, 700) for i in range(300)] + [(1000 + i, 0, 2048) for i in range(5)] + [(None, 0, 1), (None, 0, 1)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(4)
    got, fill = placed(P.pack_pieces(pieces))
    assert len(got) == len(rows) and fill.max() <= 2048 and len(fill) == 5 + 150


def test_no_large_pieces_and_ids(spark):
    got, fill = placed(P.pack_documents(docs(spark, ["a b c", None, "", "d"]), with_ids=True))
    assert len(fill) == 1 and fill.iloc[0] == 8
    for r in got.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 0


def test_awkward_rows(spark):
    d = awkward(spark, True)
    got, fill = placed(P.pack_documents(d))
    assert fill.max() <= P.CAPACITY and (got.piece == 0).sum() == d.count()
    assert P.pack_documents(empty(spark)).count() == 0
