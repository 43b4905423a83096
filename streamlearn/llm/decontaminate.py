"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: lower case, every run of ASCII characters
that are no letters or digits becomes one blank.  An item of n characters may
occur with k = floor(``rate`` * n) edits.  It is split into k + 1 pieces; k edits
leave one piece intact, so an Aho-Corasick automaton over all pieces finds a
piece of every occurrence.  Each hit names a window of the text.  A window that
holds too few of the item's 3-grams for k edits (one edit destroys three) is
dropped, the rest is verified with Myers' bit-parallel distance.

Documents are scanned whole, without a shuffle.  The items are a stated query
set.  Up to ``BLOCK_ITEMS`` items of ``BLOCK_CHARS`` characters in all are one
automaton that travels with the tasks, and one pass over the documents finds
everything.  More items are written as a table partitioned by block; the blocks
are taken one after another, a pass over the documents each, and what a pass
finds is written before the next block is read.  So the driver and a task hold
one block, however long the item list is.  (Blocks are dealt by hash: sizes
spread around the bound; an item longer than it makes a larger block.)

Defined results: null texts count as empty and match nothing; an empty item or
one without letters and digits matches nothing; an item shorter than 1/rate
characters must occur exactly and end at word ends; of several occurrences of an item in a document the one with
the least distance counts, then the first; repeated documents each give rows;
repeated items (same id and text) give one; null ids are kept as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.llm.common import filter_rows, read, shared_path, slices, stash

#: Edits allowed per character of the item.
RATE = 0.08
#: Items in one automaton, and characters of their texts.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 10_000_000

_KEPT = re.compile("[0-9a-z\u0080-\U0010ffff]+")
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def lowered(text: str) -> str:
    """Lower case, character by character where the whole text would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalised(text: str) -> str:
    return b" ".join(lowered(text).encode().translate(_FOLD).split()).decode()


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` that the span of its normalised form stands for."""
    at, first, last = 0, None, 0
    for m in _KEPT.finditer(lowered(text)):
        n = m.end() - m.start()
        if first is None and start < at + n:
            first = m.start() + max(0, start - at)
        if at < end:
            last = m.start() + min(n, end - at)
        at += n + 1
    return (first or 0), last


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """The error budget and the (offset, piece) list of a normalised item."""
    k = int(rate * len(item))
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


class Pattern:
    """Myers' bit vectors of one item, as Python integers of the item's length."""

    def __init__(self, item: str):
        self.n, self.top, self.ones, self.eq = len(item), 1 << (len(item) - 1), (1 << len(item)) - 1, {}
        for i, c in enumerate(item):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def search(self, window: str) -> tuple[int, int]:
        """Least distance of the item to a part of the window, and where that part ends (first such end)."""
        up, down, score, ones, top, eq = self.ones, 0, self.n, self.ones, self.top, self.eq
        best, where = self.n, 0
        for j, c in enumerate(window):
            e = eq.get(c, 0)
            same = e | down
            diag = (((e & up) + up) ^ up) | e
            grow = (down | ~(diag | up)) & ones
            fall = up & diag
            if grow & top:
                score += 1
            elif fall & top:
                score -= 1
            grow, fall = (grow << 1) & ones, (fall << 1) & ones     # a match may begin anywhere: no carry into row 0
            up = (fall | ~(same | grow)) & ones
            down = grow & same
            if score < best:
                best, where = score, j + 1
        return best, where


class Matcher:
    """All occurrences of a block of items in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items, self.automaton = [], ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in sorted(set(items), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            s = normalised(text or "")
            if not s:
                continue
            k, parts = pieces(s, rate)
            grams = {s[i:i + 3] for i in range(len(s) - 2)}
            self.items.append((item_id, s, k, grams, len(s) - 2 - 3 * k))
            for off, p in parts:
                by_piece.setdefault(p, []).append((len(self.items) - 1, off + len(p)))
        for p, where in by_piece.items():
            self.automaton.add_word(p, where)
        if by_piece:
            self.automaton.make_automaton()
        self.empty, self.patterns = not by_piece, {}

    def _pattern(self, i: int) -> tuple[Pattern, Pattern]:
        if i not in self.patterns:
            s = self.items[i][1]
            self.patterns[i] = Pattern(s), Pattern(s[::-1])
        return self.patterns[i]

    def _windows(self, text: str):
        """Merged windows of each item that a piece hit allows."""
        found: dict[int, list[int]] = {}
        for end, where in self.automaton.iter(text):
            for i, after in where:
                found.setdefault(i, []).append(end + 1 - after)        # where the item would begin
        for i, starts in found.items():
            n, k = len(self.items[i][1]), self.items[i][2]
            starts = sorted(set(starts))
            if k == 0:                                                 # the hit is the whole item; it must end at word ends
                starts = [s for s in starts if self._bounded(text, s, s + n)][:1]
                if not starts:
                    continue
            a = starts[0]
            for s, t in zip(starts, starts[1:] + [None]):
                if t is None or t - s > n + 2 * k:                     # no occurrence spans both
                    yield i, max(0, a - k), s + n + k
                    a = t

    def matches(self, text: str, first_only: bool = False) -> list[tuple[int | None, int, int, int]]:
        """``(item_id, distance, start, end)`` in the normalised text, one per item."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.empty or not text:
            return []
        for i, a, b in self._windows(text):
            _, s, k, grams, least = self.items[i]
            window = text[a:b]
            if least > 0 and sum([window[j:j + 3] in grams for j in range(len(window) - 2)]) < least:
                continue
            forward, backward = self._pattern(i)
            dist, end = forward.search(window)
            if dist > k:
                continue
            _, back = backward.search(window[max(0, end - len(s) - k):end][::-1])
            start = a + end - back
            if i not in best or (dist, start) < best[i][:2]:
                best[i] = (dist, start, a + end)
                if first_only:
                    break
        return [(self.items[i][0], *best[i]) for i in sorted(best)]

    @staticmethod
    def _bounded(text: str, a: int, b: int) -> bool:
        return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")


class ItemBlocks:
    """The distinct items in blocks; iteration brings one block at a time to the driver."""

    def __init__(self, benchmark: DataFrame, size: int, chars: int):
        items = benchmark.select("item_id", "text").distinct()
        n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        self.blocks, self.items = max(1, -(-n // size), -(-total // chars)), items
        if self.blocks > 1:
            path = shared_path(benchmark.sparkSession, "items")
            part = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.blocks)).cast("int")
            items.withColumn("_block", part).repartition("_block").write.partitionBy("_block").parquet(path)
            schema = T.StructType([*items.schema.fields, T.StructField("_block", T.IntegerType())])
            self.items = benchmark.sparkSession.read.schema(schema).parquet(path)

    def __len__(self) -> int:
        return self.blocks

    def __iter__(self) -> Iterator[list[tuple[int | None, str | None]]]:
        for b in range(self.blocks):
            rows = self.items if self.blocks == 1 else self.items.filter(F.col("_block") == b).drop("_block")
            yield [(r[0], r[1]) for r in rows.collect()]


def item_blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> ItemBlocks:
    """The items in blocks of about ``size`` items and ``BLOCK_CHARS`` characters; a block is what one pass over the documents holds."""
    return ItemBlocks(benchmark, size, BLOCK_CHARS)


_MATCH = [("item_id", "long"), ("distance", "int"), ("span_start", "long"), ("span_end", "long")]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``(doc_id, item_id, distance, span_start, span_end)`` of every contaminated document; spans in code points of the text."""
    found, blocks = [], item_blocks(benchmark)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in _MATCH])
    for block in blocks:
        def run(batches, block=block):
            matcher = Matcher(block, rate)
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    ids, rows = part.column(0), []
                    for r, raw in enumerate(texts):
                        text = raw.decode()
                        for item, dist, a, b in matcher.matches(normalised(text)):
                            rows.append((r, item, dist, *original_span(text, a, b)))
                    if rows:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                             pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=[f.name for f in schema])
        got = docs.select("doc_id", "text").mapInArrow(run, schema)
        found.append(got if len(blocks) == 1 else stash(got, "matches"))
    return reduce(DataFrame.union, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item occurs, with all their columns.

    One block of items filters the rows as they pass.  For several, the documents are written once with a number of their
    own, each block finds the numbers of its documents, and those leave in one anti-join.
    """
    def make(block, wanted):
        matcher = Matcher(block, rate)
        return lambda texts: np.array([bool(matcher.matches(normalised(t.decode()), True)) == wanted for t in texts], dtype=bool)

    blocks = item_blocks(benchmark)
    if len(blocks) == 1:
        block, = blocks
        return filter_rows(docs, partial(make, block, False))
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hit = [stash(filter_rows(numbered.select(row, "text"), partial(make, block, True)).select(row), "hits") for block in blocks]
    return numbered.join(reduce(DataFrame.union, hit), row, "left_anti").drop(row)


def op8_edit_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matches(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


QUERIES = {"op8_edit_matches": op8_edit_matches}
ORACLES: dict[str, str] = {}
