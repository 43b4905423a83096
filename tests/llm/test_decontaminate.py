import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import awkward, docs, empty
from streamlearn.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"


def edit_search(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to a part of the text by the full table."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text):
        new = [0]
        for i, p in enumerate(item):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[-1] + 1))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j + 1)
    return best


@given(st.text("ab c", min_size=1, max_size=30), st.text("ab c", max_size=80))
@settings(max_examples=300, deadline=None)
def test_myers(item, text):
    assert D.Pattern(item).search(text) == edit_search(item, text)


def test_every_occurrence_within_the_budget_is_found():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(8)]
    m = D.Matcher(items)
    for trial in range(120):
        i, item = rng.choice(items)
        s, k = list(item), int(D.RATE * len(item))
        for _ in range(rng.randint(0, k + 6)):
            at = rng.randrange(len(s))
            s[at:at + 1] = rng.choice(["", rng.choice("abcdefgh "), s[at] + rng.choice("abcdefgh")])
        text = D.normalised(" ".join([word() for _ in range(20)] + ["".join(s)] + [word() for _ in range(20)]))
        found = {x[0]: x for x in m.matches(text)}
        for j, other in items:
            dist = edit_search(other, text)[0]
            assert (j in found) == (dist <= int(D.RATE * len(other)))
            if j in found:
                assert found[j][1] == dist and edit_search(other, text[found[j][2]:found[j][3]])[0] == dist


def test_query_against_brute_force(spark):
    got = {(r["doc_id"], r["item_id"]) for r in D.op8_edit_matches(spark, SF).collect()}
    items = [(r["item_id"], D.normalised(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r["doc_id"], D.normalised(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {(d, i) for d, t in texts for i, s in items if s in t} <= got
    for d, i in got:
        assert edit_search(dict(items)[i], dict(texts)[d])[0] <= D.RATE * len(dict(items)[i])
    assert got


def test_spans_point_into_the_text(spark):
    item = "The quick brown fox jumps over the lazy dog, and the dog sleeps on in the sun."
    text = "Vorspann: ÄÖÜ! -- THE QUICK, brown fox jumps over the lazy dog; and the dog sleep on in the sun -- Ende"
    d = docs(spark, [text, "the quick brown fox is elsewhere"])
    r = D.matches(d, spark.createDataFrame([(5, item), (5, item), (6, None), (7, ""), (None, "!!")], ITEMS)).collect()
    assert len(r) == 1 and (r[0]["doc_id"], r[0]["item_id"], r[0]["distance"]) == (0, 5, 1)
    assert text[r[0]["span_start"]:r[0]["span_end"]] == text[18:97].rstrip(" -")


def test_short_items_match_exactly_at_word_ends(spark):
    d = docs(spark, ["a catalog", "the cat sat", "cat", "concat cat"])
    got = D.matches(d, spark.createDataFrame([(1, "Cat!")], ITEMS)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3] and {r["distance"] for r in got} == {0}


def test_awkward_rows_and_item_blocks(spark, monkeypatch):
    d = awkward(spark, True)
    items = spark.createDataFrame([(i, f"word{i} and{i % 13} word{i + 1} and{(i + 1) % 13} word{i + 2}") for i in range(7)], ITEMS)
    one = sorted(map(tuple, D.matches(d, items).collect()))
    assert {r[0] for r in one} == {5} and len(one) == 7
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(D.item_blocks, "__defaults__", (2,))
    assert len(D.item_blocks(items)) == 4 and sorted(map(tuple, D.matches(d, items).collect())) == one
    kept = D.keep_clean(d, items)
    assert kept.columns == d.columns and kept.count() == d.count() - 1
    none = spark.createDataFrame([], ITEMS)
    assert D.matches(d, none).count() == 0 and D.keep_clean(d, none).count() == d.count()
    assert D.matches(empty(spark), items).count() == 0 and D.keep_clean(empty(spark), items).count() == 0


def least_distances(items: list[str], text: str) -> list[int]:
    """Least edit distance of each item to a part of the text: the full tables of all items, a column a character."""
    n = max(map(len, items))
    grid = np.array([list(s.ljust(n, "\0")) for s in items])
    differs = {c: (grid != c).astype(np.int16) for c in set(text)}
    steps = np.arange(n + 1, dtype=np.int16)
    row = np.tile(steps, (len(items), 1))
    ends = (np.arange(len(items)), [len(s) for s in items])
    best = row[ends]
    for c in text:
        new = np.zeros_like(row)
        np.minimum(row[:, :-1] + differs[c], row[:, 1:] + np.int16(1), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, row[ends])
    return best.tolist()


def test_least_distances():
    items = ["abc abd", "xyz", "b"]
    for text in ("", "abc abd", "zzabcabdxz", "bca bxyy"):
        assert least_distances(items, text) == [edit_search(s, text)[0] for s in items]


def test_whole_result_against_full_tables(spark):
    """Every document against every item of the small tables: the same pairs with the same distances, edited ones included."""
    items = [(r["item_id"], D.normalised(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert min(len(s) for _, s in items) * D.RATE >= 1                  # none of the short items, which follow another rule
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for (i, s), dist in zip(items, least_distances([s for _, s in items], D.normalised(r["text"] or ""))):
            if dist <= int(D.RATE * len(s)):
                want[r["doc_id"], i] = dist
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.op8_edit_matches(spark, SF).collect()}
    assert got == want and want


def test_blocks_come_one_at_a_time(spark, monkeypatch):
    """Blocks hold all items once, by count and by length; results do not depend on them; copies and null ids stay rows of their own."""
    rows = [(1, "first item of the list"), (1, "first item of the list"), (2, "second item of the list"), (None, "third item, without an id"),
            (4, None), (5, "a long item " * 50)]
    items = spark.createDataFrame(rows, ITEMS)
    text = "here comes the second item of the list, and more"
    d = spark.createDataFrame([(1, text, 7), (1, text, 7), (None, "a third item without an id", 8), (None, "clean", 9), (3, None, 1),
                               (4, "a long item " * 60, 2), (4, "clean", 3)], "doc_id long, text string, _row int")
    one, kept = sorted(map(str, D.matches(d, items).collect())), sorted(map(str, D.keep_clean(d, items).collect()))
    assert len(D.item_blocks(items)) == 1 and len(one) == 4 and len(kept) == 3
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    blocks = D.item_blocks(items)
    assert len(blocks) == 4 and sorted(map(str, (r for b in blocks for r in b))) == sorted(map(str, set(rows)))
    assert next(iter(blocks)) is not None                               # an iterator, not a list of all blocks
    assert sorted(map(str, D.matches(d, items).collect())) == one
    many = D.keep_clean(d, items)
    assert many.columns == d.columns and sorted(map(str, many.collect())) == kept
