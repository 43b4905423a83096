"""Best-fit packing of tokenised documents by linear grouping.

``token_pieces`` turns every document into token ids plus an end id and cuts those
longer than a sequence.  ``pack_pieces`` places the pieces in sequences:

1. large pieces (over ``SMALL`` tokens) are ranked by length and split into groups
   of equal cardinality; within a group lengths are rounded up to the longest;
2. the few sizes are packed by a configuration program: columns are generated by a
   knapsack over the capacity and a revised simplex, the solution is rounded down
   and the rest packed best-fit;
3. the actual pieces replace the rounded ones, by rank;
4. small pieces go, longest first, where they leave the least room.

Lengths are integers up to the capacity, so what the plan needs of the data is a
histogram of at most ``capacity`` numbers.  The driver plans on the histogram in
runs (ranges of ranks), whose number does not depend on the number of documents.
Ranks come from a range sort that splits equally long pieces by id, so neither a
hot length nor a group of copies meets in one task; a sequence holds at most
``capacity`` pieces.

Defined results: null text counts as empty and gives one piece, the end id; null
ids and repeated rows are packed like any other row; an empty table gives no rows;
a document of exactly the capacity is not cut.
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.llm.common import read, slices, stash

CAPACITY = 2048
END_ID = 0
#: Pieces over this length are grouped and packed by configurations.
SMALL = CAPACITY // 3
GROUPS = 320
#: Chunks whose ids a worker remembers (about 200 bytes each); bytes of text it takes at once.
CACHE, SLICE = 1_000_000, 1_000_000
#: Signs of which a run is one pre-token (an apostrophe may begin one of another kind).
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


# ------------------------------------------------------------------- tokens
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids (little-endian unsigned 32-bit) of lower-case Latin-1 chunks without blanks, learnt when first asked for.

    A chunk of letters, of marks, or of letters and then marks is made of one or two
    pre-tokens, which go to the vocabulary's model directly; others are encoded whole.
    """

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()

    def _pre_token(self, word: str) -> bytes:
        ids = self.get(word)
        if ids is None:
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(raw)]
            ids = self[word] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        if word.isalpha() or not word:
            if len(word) in (0, len(chunk)):
                return self._pre_token(chunk)
            ids = self._pre_token(word) + self._pre_token(chunk[len(word):])
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids


class ChunkTokenizer:
    """Ids of whole texts, put together from the ids of their blank-separated chunks.

    The vocabulary's pattern never spans white space and its normaliser works on
    single characters and their combining marks, so a text's ids are those of its
    chunks in a row.  Chunks repeat, so most cost a dictionary lookup.  That is done
    for Latin-1 text, lower-cased as the normaliser would do; other text is encoded
    by the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Chunks(self.tokenizer)

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def of_worker(path: str) -> ChunkTokenizer:
        """One for each Python worker: what a task has learnt serves the next."""
        return ChunkTokenizer(path)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHE:
            self.known = _Chunks(self.tokenizer)
        get = self.known.__getitem__
        return [b"".join(map(get, t.lower().replace("\n", " ").split(" "))) if _latin1(t) and "<|" not in t else self._encode(t) for t in texts]


def _latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
                           *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = ChunkTokenizer.of_worker(path)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, b in enumerate(tokenizer.ids([t.decode() for t in texts])):
                    b += end
                    for k in range(0, len(b), 4 * capacity):
                        cut = b[k:k + 4 * capacity]
                        row.append(r)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --------------------------------------------------- plan on the histogram
def _knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the sizes that fit the capacity and have the greatest value."""
    best, choice = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(size.min())):
        room = np.arange(capacity + 1)[None, :] - size[:, None]
        gain = np.where(room >= 0, best[-1][np.maximum(room, 0)] + value[:, None], -1.0)
        pick = gain.argmax(0)
        top = gain[pick, np.arange(capacity + 1)]
        more = top > best[-1] + 1e-12
        if not more[capacity]:
            break
        best.append(np.where(more, top, best[-1]))
        choice.append(np.where(more, pick, -1))
    counts, c = np.zeros(len(size), int), capacity
    for pick in reversed(choice):
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= size[pick[c]]
    return counts


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """``(counts by size, how often)`` covering the demand, from the rounded linear program."""
    m = len(size)
    if not m:
        return []
    basis = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(m))
        column = _knapsack(np.maximum(price, 0.0), size, capacity).astype(float)
        if price @ column < 1 + 1e-7:
            break
        x, y = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(y > 1e-9, np.maximum(x, 0.0) / np.where(y > 1e-9, y, 1.0), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0.0)
    plan, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        column = np.rint(basis[:, j]).astype(np.int64)
        held = column > 0
        times = min(int(x[j] + 1e-9), int((left[held] // column[held]).min()))
        if times > 0:
            plan.append((column, times))
            left -= times * column
    rest: list[list] = []                               # best-fit of what the rounding left, longest first
    for i in np.argsort(-size, kind="stable"):
        for _ in range(int(left[i])):
            fits = [b for b in rest if b[0] >= size[i]]
            if fits:
                b = min(fits, key=lambda b: b[0])
            else:
                rest.append(b := [capacity, np.zeros(m, np.int64)])
            b[0] -= int(size[i])
            b[1][i] += 1
    return plan + [(b[1], 1) for b in rest]


@dataclasses.dataclass(frozen=True)
class Runs:
    """Rows ``first <= rank < last`` go to bins ``to + (rank - first) // each``."""

    first: np.ndarray
    last: np.ndarray
    to: np.ndarray
    each: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, int, int, int]]) -> Runs:
        a = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return Runs(*a.T)

    def bins(self, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, rank, side="right") - 1
        return self.to[k] + (rank - self.first[k]) // self.each[k]


def plan_large(hist: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[Runs, int]:
    """Runs of ranks (longest first) of the large pieces, and the number of bins."""
    n = sum(hist.values())
    lengths = sorted(hist, reverse=True)
    ends = np.cumsum([hist[x] for x in lengths]) if n else np.zeros(0, int)
    cuts = sorted({n * i // groups for i in range(groups)}) if n else []
    size = [lengths[int(np.searchsorted(ends, c, side="right"))] for c in cuts]
    merged: list[list[int]] = []                        # [first rank, size]; groups of one size are one
    for c, s in zip(cuts, size):
        if not merged or merged[-1][1] != s:
            merged.append([c, s])
    first = np.array([c for c, _ in merged], np.int64)
    sizes = np.array([s for _, s in merged], np.int64)
    demand = np.diff(np.append(first, n))
    rows, bins, used = [], 0, first.copy()
    for counts, times in configurations(sizes, demand, capacity):
        for i in np.nonzero(counts)[0]:
            k = int(counts[i])
            rows.append((int(used[i]), int(used[i]) + k * times, bins, k))
            used[i] += k * times
        bins += times
    return Runs.of(rows), bins


def plan_small(hist: dict[int, int], room: dict[int, int], first_rank: int, capacity: int) -> tuple[Runs, int]:
    """Best-fit of the small pieces, longest first, into bins ordered by (room, bin); new bins follow.

    ``room`` counts the bins by the room they have left.  Bins in equal state are
    handled as one run, so the work depends on the number of lengths alone.
    """
    runs, at = [], 0                                    # (room, first bin, bins), sorted
    for r in sorted(room):
        runs.append((r, at, room[r]))
        at += room[r]
    rows, rank, new = [], first_rank, 0
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            k = bisect.bisect_left(runs, (length, -1, -1))
            if k == len(runs):
                count = -(-n // (capacity // length))
                bisect.insort(runs, (capacity, at, count))
                at, new = at + count, new + count
                continue
            r, b, count = runs.pop(k)
            take = min(n, count)
            rows.append((rank, rank + take, b, 1))
            rank, n = rank + take, n - take
            bisect.insort(runs, (r - length, b, take))
            if take < count:
                bisect.insort(runs, (r, b + take, count - take))
    return Runs.of(rows), new


# ------------------------------------------------------------- distributed
def ranked(df: DataFrame, order: list[str], col: str) -> DataFrame:
    """The 0-based position of every row in ``order``.

    Rows are range-partitioned and sorted locally; a table of one offset per
    partition is added.  Written once, so that positions cannot change.
    """
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())    # one number a partition
    offset, total = {}, 0
    for p, n in counts:
        offset[p], total = total, total + n
    spark = df.sparkSession
    table = spark.createDataFrame(list(offset.items()) or [(0, 0)], "_p long, _o long")
    return (rows.withColumn("_p", part).join(F.broadcast(table), "_p")
                .withColumn(col, F.col("_o") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_o", "_at"))


def _placed(df: DataFrame, runs: Runs, rank: str, col: str) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField(col, T.LongType())])

    def run(batches):
        for b in batches:
            at = b.column(b.schema.get_field_index(rank)).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs.bins(at))], names=schema.names)
    return df.mapInArrow(run, schema)


def _histogram(df: DataFrame, col: str) -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in df.groupBy(col).count().collect()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, small: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``length`` (1 to capacity), ``doc_id`` and ``piece``."""
    small = capacity // 3 if small is None else small
    pieces = ranked(pieces.withColumn("_less", -F.col("length")), ["_less", "doc_id", "piece"], "_rank").drop("_less")
    hist = _histogram(pieces, "length")
    full = hist.get(capacity, 0)                        # a full piece is a sequence: ranks 0 to full - 1
    big = {x: n for x, n in hist.items() if small < x < capacity}
    little = {x: n for x, n in hist.items() if x <= small}
    runs, bins = plan_large(big, capacity, groups)
    runs = Runs.of([(0, full, 0, 1)] * bool(full) + [(a + full, b + full, t + full, e) for a, b, t, e in zip(runs.first, runs.last, runs.to, runs.each)])
    bins += full
    first = full + sum(big.values())
    out = []
    if first:
        out.append(_placed(pieces.filter(F.col("_rank") < first), runs, "_rank", "sequence_id"))
    if little:
        rest = pieces.filter(F.col("_rank") >= first)
        if first:
            filled = out[0].filter(F.col("length") < capacity).groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
            order = ranked(filled, ["room", "sequence_id"], "_bin")
            room = _histogram(order, "room")
        else:
            order, room = None, {}
        runs, _ = plan_small(little, room, first, capacity)
        known = sum(room.values())
        rest = _placed(rest, runs, "_rank", "_bin")
        if order is not None:
            names = order.select(F.col("_bin"), F.col("sequence_id").alias("_known"))
            rest = rest.join(names, "_bin", "left")
            rest = rest.withColumn("sequence_id", F.coalesce("_known", F.col("_bin") - known + bins)).drop("_known", "_bin")
        else:
            rest = rest.withColumn("sequence_id", F.col("_bin")).drop("_bin")
        out.append(rest.select(*pieces.columns, "sequence_id"))
    if not out:
        return pieces.drop("_rank").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    placed = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    before = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_rank")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack; ``path`` is the tokenizer file (the public 49k word vocabulary by default)."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(stash(token_pieces(docs, str(path), capacity, with_ids=with_ids), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(read(spark, sf, "documents"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
