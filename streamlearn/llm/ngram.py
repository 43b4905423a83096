"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

``train`` counts in one Spark job of two shuffles and leaves sorted hash arrays in
the shared folder; ``score`` maps those files into the workers' memory and looks
n-grams up by binary search.

Layout.  A word is the upper 48 bits of its XXH64.  Bigrams (v, w) are dealt out
over a square grid of buckets by the leading bits of v and of w, so a very common
word, as context or as successor, is spread over a whole row or column of buckets
and no task holds all bigrams of one word.  The grid grows with the bytes of text
(``BUCKET_BYTES`` for a bucket).  Tasks send sorted arrays that are already counted.
Each bucket is merged by one task, which writes its bigram arrays (key: a 64-bit mix
of v and w; count) and passes on, by word, what it adds to the word's statistics:
how often it is a context, how many successors it has once, twice, more often, and
how many different words it follows.  A second shuffle adds those up into the word arrays, in
as many parts as there are buckets (twice the leading bits), so a part's share of the
words does not grow with the corpus.  Files are written under a temporary name and renamed, so a repeated task
does no harm and a lost executor loses nothing that is finished.

Probabilities.  With D(c) the modified Kneser-Ney discounts from the counts of counts,
p(w | v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w), where p(w) discounts the number of
different words before w in the same way and gives its rest evenly to the V words seen
and one unknown word.

The shared folder must be mounted on the driver and all executors (a ``file:`` path):
memory-mapping needs one.  48-bit hashes make two of V words alike with probability
V^2 / 2^49, which at a million words changes nothing.

Defined results: null text counts as empty and is one end token; a null id is not held
out and is learnt from; repeated rows count as often as they occur; without training
text every probability is 1; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlearn.llm.common import id_bucket, read, shared_path, slices, with_computed

#: Bytes of training text for one bucket of the grid, about.
BUCKET_BYTES = 32_000_000
#: Tokens that a task counts before it sends arrays on.
CHUNK_TOKENS = 2_000_000
BITS = 48
#: Hashes of the end token and of the context of a first word; a blank never is in a word.
END, BEGIN = (xxhash.xxh64_intdigest(x) >> 16 for x in (b" end", b" begin"))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    key = (v * _M1) ^ (w * _M2 + (v >> np.uint64(17)))
    return (key ^ (key >> np.uint64(31))) * _M1


def local_folder(path: str) -> str:
    """The mounted folder behind a ``file:`` path."""
    m = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if not m:
        raise ValueError(f"the model needs a shared folder mounted on all machines, not {path}")
    return m[1]


class Numbering:
    """Consecutive numbers for the words of one chunk, and their hashes; 0 is the end, 1 the beginning."""

    def __init__(self):
        self.at: dict[bytes, int] = {}

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(v, w, first)``: number pairs of all texts, and where each text begins."""
        at, seq, first, n = self.at, [], [], 0
        for t in texts:
            first.append(n)
            ws = words(t)
            seq.append(1)
            seq += [at.setdefault(x, len(at) + 2) for x in ws]
            n += len(ws) + 1
        seq = np.array(seq, np.int64)
        v = seq
        w = np.append(seq[1:], 1)
        return v, np.where(w == 1, 0, w), np.array(first, np.int64)

    def hashes(self) -> np.ndarray:
        h = xxhash.xxh64_intdigest
        return np.concatenate([np.array([END, BEGIN], np.uint64), np.fromiter((h(x) >> 16 for x in self.at), np.uint64, len(self.at))])


# ------------------------------------------------------------------ payloads
def _pack(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array in its smallest unsigned type, under a temporary name first."""
    top = int(values.max()) if len(values) else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, values.astype(kind))
    os.replace(part, f"{folder}/{name}.npy")


def _add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the values."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.zeros(0, int)
    return (k[first], *[np.add.reduceat(v[order], first) if len(k) else v for v in values], order[first] if len(k) else first)


_SENT = "bucket long, v binary, n binary, w binary, c binary"


def _count(bits: int):
    """Counted bigrams of each chunk of texts, dealt out by bucket."""
    def chunk(names, vs, ws):
        h = names.hashes()
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h = h[order]
        key = np.sort((rank[np.concatenate(vs)] << 32) | rank[np.concatenate(ws)])
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        count = np.diff(np.append(first, len(key)))
        v, w = h[key[first] >> 32], h[key[first] & 0xFFFFFFFF]
        shift = np.uint64(BITS - bits)
        column = (w >> shift).astype(np.int64)
        edge = np.searchsorted((v >> shift).astype(np.int64), np.arange((1 << bits) + 1))
        for i in range(1 << bits):
            a, b = edge[i], edge[i + 1]
            by = np.argsort(column[a:b], kind="stable") + a
            cut = np.searchsorted(column[by], np.arange((1 << bits) + 1))
            for j in range(1 << bits):
                at = by[cut[j]:cut[j + 1]]
                if len(at):
                    x = v[at]
                    start = np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0]
                    yield [i << bits | j, _pack(x[start]), np.diff(np.append(start, len(x))).astype("<u4").tobytes(),
                           _pack(w[at]), count[at].astype("<u4").tobytes()]

    def sent(rows, most: int = 4_000_000):
        """Record batches of about ``most`` bytes."""
        held, size = [], 0

        def out():
            cols = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                              names=["bucket", "v", "n", "w", "c"])
        for row in rows:
            held.append(row)
            size += sum(map(len, row[1:]))
            if size > most:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def run(batches):
        names, vs, ws, held = Numbering(), [], [], 0
        for batch in batches:
            for _, texts in slices(batch, "text"):
                v, w, _ = names.pairs(texts)
                vs.append(v)
                ws.append(w)
                held += len(v)
                if held >= CHUNK_TOKENS:
                    yield from sent(chunk(names, vs, ws))
                    names, vs, ws, held = Numbering(), [], [], 0
        if held:
            yield from sent(chunk(names, vs, ws))
    return run


def _groups(batches, key: int = 0):
    """Rows of sorted batches, one list per value of the key column."""
    now, rows = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*cols):
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


_PASSED = "part long, h binary, stats binary, coc binary"


def _merge_bigrams(folder: str, bits: int):
    """Write each bucket's arrays; pass on the statistics by word and the counts of counts."""
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for bucket, rows in _groups(batches):
            v = np.concatenate([np.repeat(_unpack(r[1]), np.frombuffer(r[2], "<u4")) for r in rows])
            w = np.concatenate([_unpack(r[3]) for r in rows])
            c = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows]).astype(np.int64)
            key, c, at = _add_up(bigram_key(v, w), c)
            v, w = v[at], w[at]
            _save(folder, f"bigram-{bucket}-key", key)
            _save(folder, f"bigram-{bucket}-count", c)
            hv, total, n1, n2, n3, _ = _add_up(v, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
            hw, before, _ = _add_up(w, np.ones(len(w), np.int64))
            coc = np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype("<i8").tobytes()
            z = np.zeros(0, "<i8")
            rows = []
            for h, stats in ((hv, (total, n1, n2, n3, z)), (hw, (z, z, z, z, before))):
                stats = np.stack([s if len(s) else np.zeros(len(h), np.int64) for s in stats]).astype("<i8")
                part = (h >> np.uint64(BITS - 2 * bits)).astype(np.int64)              # sorted, as h is
                for a, e in zip(*_pieces(part)):
                    rows.append((int(part[a]), _pack(h[a:e]), stats[:, a:e].tobytes(), coc if not rows else b""))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(x, pa.binary()) for x in cols[1:]]],
                                             names=["part", "h", "stats", "coc"])
    return run


def _pieces(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal values."""
    starts = np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0].tolist() if len(values) else []
    return starts, [*starts[1:], len(values)][:len(starts)]


_TOTALS = ["tokens", "words", "pairs", "b1", "b2", "b3", "b4", "u1", "u2", "u3", "u4"]


def _merge_words(folder: str):
    """Write the word arrays of each part; one row of totals for each."""
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for part, rows in _groups(batches):
            h = np.concatenate([_unpack(r[1]) for r in rows])
            stats = np.concatenate([np.frombuffer(r[2], "<i8").reshape(5, -1) for r in rows], axis=1)
            h, total, n1, n2, n3, before, _ = _add_up(h, *stats)
            _save(folder, f"word-{part}", np.stack([h, *[x.astype(np.uint64) for x in (total, n1, n2, n3, before)]]))
            coc = sum((np.frombuffer(r[3], "<i8") for r in rows if r[3]), np.zeros(4, np.int64))
            u = np.bincount(np.minimum(before, 5), minlength=6)[1:5]
            values = [total.sum(), (before > 0).sum(), before.sum(), *coc, *u]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in values], names=_TOTALS)
    return run


# --------------------------------------------------------------------- model
def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of n-grams
    seen once to four times; where one of those is zero the fixed values .5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Model:
    """Reads the arrays that ``train`` left; files are memory-mapped when first needed."""

    def __init__(self, folder: str, bits: int, totals: dict[str, int]):
        self.folder, self.bits, self.totals = folder, bits, totals
        self.two = discounts([totals[f"b{i}"] for i in (1, 2, 3, 4)])
        self.one = discounts([totals[f"u{i}"] for i in (1, 2, 3, 4)])

    def _opened(self):
        if not hasattr(self, "_load"):
            @functools.lru_cache(maxsize=4096)
            def load(name):
                path = f"{self.folder}/{name}.npy"
                return np.load(path, mmap_mode="r") if os.path.exists(path) else None
            self._load = load
        return self._load

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_load"}

    @staticmethod
    def _by(bucket: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        cut = np.nonzero(np.diff(bucket[order]))[0] + 1
        return [(int(bucket[x[0]]), x) for x in np.split(order, cut) if len(x)]

    @staticmethod
    def _find(keys, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the wanted keys in the sorted array, and whether they are there."""
        order = np.argsort(wanted)
        at = np.empty(len(wanted), np.int64)
        at[order] = np.searchsorted(keys, wanted[order].astype(keys.dtype))
        at = np.minimum(at, len(keys) - 1)
        return at, keys[at] == wanted

    def word_stats(self, h: np.ndarray) -> np.ndarray:
        """``5 x n``: context total, successors seen once, twice, more often, and different words before."""
        load, out = self._opened(), np.zeros((5, len(h)))
        for part, x in self._by((h >> np.uint64(BITS - 2 * self.bits)).astype(np.int64)):
            table = load(f"word-{part}")                     # hashes, then the statistics
            if table is not None and table.shape[1]:
                at, there = self._find(table[0], h[x])
                out[:, x[there]] = table[1:, at[there]]
        return out

    def bigram_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        load, out = self._opened(), np.zeros(len(v), np.int64)
        shift, key = np.uint64(BITS - self.bits), bigram_key(v, w)
        bucket = ((v >> shift) << np.uint64(self.bits) | (w >> shift)).astype(np.int64)
        for b, x in self._by(bucket):
            keys = load(f"bigram-{b}-key")
            if keys is not None and len(keys):
                at, there = self._find(keys, key[x])
                out[x[there]] = load(f"bigram-{b}-count")[at[there]]
        return out

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, the base score and the model's score, both as sums of log10."""
        names = Numbering()
        v, w, first = names.pairs(texts)
        h, t = names.hashes(), self.totals
        total, n1, n2, n3, before = self.word_stats(h)
        seen = total.copy()
        seen[0], seen[1] = total[1], 0                   # every text has one end
        base = np.log10((seen + 0.1) / (t["tokens"] + 0.1 * (t["words"] + 1)))
        if t["pairs"]:
            rest = self.one @ [0, t["u1"], t["u2"], t["words"] - t["u1"] - t["u2"]]
            p1 = (np.maximum(before - self.one[np.minimum(before, 3).astype(int)], 0) + rest / (t["words"] + 1)) / t["pairs"]
        else:
            p1 = np.ones(len(h))
        there = total > 0
        back = np.where(there, (self.two[1] * n1 + self.two[2] * n2 + self.two[3] * n3) / np.where(there, total, 1), 1.0)
        pair, which = np.unique((v << 32) | w, return_inverse=True)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        c = self.bigram_counts(h[a], h[b])
        p = np.maximum(c - self.two[np.minimum(c, 3)], 0) / np.where(there[a], total[a], 1) + back[a] * p1[b]
        return {"n_tokens": np.diff(np.append(first, len(w))), "n_known": np.add.reduceat((seen[w] > 0).astype(np.int64), first),
                "base_score": np.add.reduceat(base[w], first), "score": np.add.reduceat(np.log10(p)[which], first)}


def train(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Count the texts of ``docs`` into the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 1
    while 4 ** bits * bucket_bytes < size:
        bits += 1
    folder = local_folder(shared_path(spark, "ngram"))
    bigrams = (docs.select("text").mapInArrow(_count(bits), _SENT)
                   .repartition(4 ** bits, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_bigrams(folder, bits), _PASSED))
    totals = (bigrams.repartition(4 ** bits, "part").sortWithinPartitions("part")
                     .mapInArrow(_merge_words(folder), ", ".join(f"{c} long" for c in _TOTALS)))
    got = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TOTALS]).first()
    return Model(folder, bits, got.asDict())


def score(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """Append the columns of ``Model.score`` to the kept columns."""
    return with_computed(docs, lambda: model.score, [("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")], keep=keep)


def op9_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    held = F.coalesce(id_bucket("doc_id", 10) == 0, F.lit(False))
    model = train(docs.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known",
                                     F.lit(model.totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op9_kneser_ney": op9_kneser_ney}
ORACLES: dict[str, str] = {}
