"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: bit b is set if it is set in more than half of
the XXH64 hashes of its word shingles.  Two fingerprints link at ``max_bits`` = 4
or fewer differing bits.

Candidate keys.  A fingerprint is cut into two 23-bit segments G1, G2 and an
18-bit tail T.  The perfect binary Golay code [23, 12, 7] gives each segment the
indices of all codewords within distance 4: one index, or six.  Two segments that
differ in at most two bits share an index (for one error take the codeword within
3 of either; for two, a codeword within 3 of the word between them).  With at most
four errors (g1, g2, t) in total:

* t = 0: g1 or g2 is at most 2, so T and one segment's index agree;
* g1 = 0 or g2 = 0 (t > 0): that segment agrees exactly;
* g1, g2, t all at least 1: g1 and g2 are at most 2 and t at most 2, so both
  segments share an index and one of three 6-bit pieces of T agrees.

So linked fingerprints share a key always; the rows of one key are verified by
counting differing bits.  Equal fingerprints are one row here, so a group of exact
copies costs nothing.  A key's rows are scanned in sorted order; the links found
in a run are reduced to a spanning forest before they leave the task.  A run over
``RUN`` rows is cut into blocks, and each pair of blocks is compared in a task of
its own, so no link is lost and no group is held whole.

Defined results: null text counts as empty; no words give fingerprint zero, linked
like any other; fewer words than the shingle length give one shingle of all words;
repeated rows and null ids each give a row; a component of null ids has a null
``component_id``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlearn.llm.common import read, stash, with_computed
from streamlearn.llm.graph import components

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Rows of one key compared within the scanning task; a longer run goes to block pairs of this size.
RUN = 2048
_GENERATOR = 0xAE3                    # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


# ------------------------------------------------------------- fingerprints
def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle of ``width`` space-joined words, repeats included."""
    words = text.lower().split()                 # bytes: only A-Z fold, only the six ASCII spaces split
    if not words:
        return np.zeros(0, np.uint64)
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(start, end[width - 1:].tolist())], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set (bit 0 first)."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_280):                    # 256 groups of 255
        part = hashes[k:k + 65_280]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:                                               # eight one-byte counters in a word, 255 rows at a time
            lanes = bits[:full].view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
            total += lanes.view(np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    hashes = shingle_hashes(text, width)
    bits = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprint_column(width: int):
    return lambda: lambda texts: {"fp": np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)}


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``: the 64 bits as a signed long."""
    return with_computed(docs, _fingerprint_column(width), [("fp", "long")], keep=["doc_id"])


# --------------------------------------------------------------- Golay code
def _remainder(x: np.ndarray) -> np.ndarray:
    """x modulo the generator polynomial, for 23-bit x."""
    x = x.copy()
    for b in range(22, 10, -1):
        x ^= np.where((x >> b) & 1, _GENERATOR << (b - 11), 0)
    return x


class Golay:
    """Indices (12 bits) of the codewords within distance 4 of a 23-bit word."""

    def __init__(self):
        bit = 1 << np.arange(23)
        patterns = [np.zeros(1, np.int64)]
        for k in (1, 2, 3, 4):
            at = np.array(np.meshgrid(*[np.arange(23)] * k, indexing="ij")).reshape(k, -1)
            at = at[:, (np.diff(at, axis=0) > 0).all(axis=0)]
            patterns.append(bit[at].sum(axis=0))
        self.errors = np.full((2048, 6), -1, np.int64)         # by syndrome: error patterns of weight 4 at most
        for e in np.concatenate(patterns):
            s = int(_remainder(np.array([e]))[0]) if e >= 2048 else int(e)
            row = self.errors[s]
            row[np.argmax(row < 0)] = e

    def indices(self, word: np.ndarray) -> np.ndarray:
        """n x 6, -1 where there is none."""
        e = self.errors[_remainder(word)]
        return np.where(e < 0, -1, (word[:, None] ^ e) >> 11)


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every candidate key of the fingerprints (uint64)."""
    f = fp.astype(np.uint64)
    g1 = (f & np.uint64(0x7FFFFF)).astype(np.int64)
    g2 = ((f >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64)
    tail = (f >> np.uint64(46)).astype(np.int64)
    i1, i2 = golay.indices(g1), golay.indices(g2)
    row = np.arange(len(f))
    rows, keys = [row, row], [(1 << 40) | g1, (2 << 40) | g2]
    for family, idx in ((3, i1), (4, i2)):
        r, c = np.nonzero(idx >= 0)
        rows.append(r)
        keys.append((family << 40) | (tail[r] << 12) | idx[r, c])
    both = (i1[:, :, None] << 12) | i2[:, None, :]
    r, a, b = np.nonzero((i1 >= 0)[:, :, None] & (i2 >= 0)[:, None, :])
    for j in range(3):
        piece = (tail >> (6 * j)) & 63
        rows.append(r)
        keys.append(((5 + j) << 40) | (both[r, a, b] << 6) | piece[r])
    return np.concatenate(rows), np.concatenate(keys)


# ------------------------------------------------------------ verified links
def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_within_runs(key: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Rows sorted by key: the forest label of each row under the links inside its key."""
    n = len(key)
    i_all, j_all = [], []
    left, d = np.arange(n - 1), 1
    while len(left):
        left = left[left + d < n]
        left = left[key[left] == key[left + d]]
        near = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= max_bits]
        i_all.append(near)
        j_all.append(near + d)
        d += 1
    i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (i_all, j_all))
    return _forest(n, i, j)


def near_between(a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of a, of b) within ``max_bits``, compared 256 rows at a time."""
    i_all, j_all = [], []
    for k in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[k:k + 256, None] ^ b[None, :]) <= max_bits)
        i_all.append(i + k)
        j_all.append(j)
    return np.concatenate(i_all) if i_all else np.zeros(0, int), np.concatenate(j_all) if j_all else np.zeros(0, int)


_LINK = "u long, v long, key long, block long"


def _batch(u, v, key, block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, key, block)], names=["u", "v", "key", "block"])


def _scan(max_bits: int, run: int):
    """Links (u, v) of each key's rows; the rows of a long run come out as (u, null, key, block)."""
    def of(key, fp):
        f = fp.view(np.uint64)
        label = near_within_runs(key, f, max_bits)
        i = np.nonzero(label != np.arange(len(label)))[0]
        return fp[i], fp[label[i]]

    def scan(batches):
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)   # the run that may go on
        hot, sent = None, 0
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            if hot is not None:                                            # rows that continue a long run
                k = int(np.searchsorted(key, hot, side="right"))
                if k:
                    at = sent + np.arange(k)
                    yield _batch(fp[:k], [None] * k, key[:k], at // run)
                    sent += k
                if k < len(key):
                    hot, sent = None, 0
                key, fp = key[k:], fp[k:]
                if not len(key):
                    held_key, held_fp = key, fp
                    continue
            first = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
            size = np.diff(np.append(first, len(key)))
            for s, n in zip(first[size > run], size[size > run]):          # long runs leave as blocks
                yield _batch(fp[s:s + n], [None] * n, key[s:s + n], np.arange(n) // run)
                if s + n == len(key):
                    hot, sent = int(key[-1]), int(n)
            keep = np.repeat(size <= run, size)
            if hot is None:                                                # the last run may go on in the next batch
                keep[first[-1]:] = False
                held_key, held_fp = key[first[-1]:], fp[first[-1]:]
            else:
                held_key, held_fp = key[:0], fp[:0]
            u, v = of(key[keep], fp[keep])
            if len(u):
                yield _batch(u, v, [None] * len(u), [None] * len(u))
        if len(held_key):
            u, v = of(held_key, held_fp)
            if len(u):
                yield _batch(u, v, [None] * len(u), [None] * len(u))
    return scan


def _block_pairs(max_bits: int):
    """Links between the two blocks of each (key, i, j); rows come sorted by (key, i, j, block)."""
    def run(batches):
        def flush(rows):
            at = np.concatenate([r[0] for r in rows])
            fp = np.concatenate([r[1] for r in rows])
            a, b = fp[at == at.min()], fp[at == at.max()]
            i, j = near_between(a.view(np.uint64), b.view(np.uint64), max_bits)
            nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = _forest(len(nodes), inverse[i], inverse[len(a) + j])
            k = np.nonzero(label != np.arange(len(label)))[0]
            return pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(nodes[label[k]])], names=["u", "v"])

        pair, rows = None, []
        for batch in batches:
            key, i, j, block, fp = (batch.column(c).to_numpy() for c in range(5))
            change = np.nonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))[0] + 1
            for part in np.split(np.arange(len(key)), change):
                if not len(part):
                    continue
                now = (key[part[0]], i[part[0]], j[part[0]])
                if pair is not None and now != pair:
                    yield flush(rows)
                    rows = []
                pair = now
                rows.append((block[part], fp[part]))
        if rows:
            yield flush(rows)
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """Links ``(u, v)`` that connect the distinct fingerprints ``fps(fp)`` exactly as all pairs within ``max_bits`` would."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys cover up to four differing bits")

    def keyed(batches):
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k in range(0, len(fp), 20_000):
                part = fp[k:k + 20_000]
                r, key = fuzzy_keys(part.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[r])], names=["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    found = stash(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_scan(max_bits, run), _LINK), "near")
    hot = found.filter("key is not null").select("key", "block", F.col("u").alias("fp"))
    last = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = (hot.join(last, "key")
                .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
                .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp"))
    dense = (pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "fp")
                  .mapInArrow(_block_pairs(max_bits), "u long, v long"))
    return found.filter("key is null").select("u", "v").union(dense)


def _placed(docs: DataFrame, width: int, max_bits: int) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` for every row of ``docs``; ``root`` is the component's least fingerprint."""
    rows = stash(fingerprints(docs, width), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(fps, max_bits))
    placed = (fps.join(root, fps["fp"] == root["u"], "left")
                 .select(fps["fp"], "least", F.coalesce("root", fps["fp"]).alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    return _placed(docs, width, max_bits).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate component: that of its smallest ``doc_id``.

    All columns stay.  Rows without id are kept, as they cannot be told apart.
    Of rows that share the kept id, only those of the component it leads count:
    they are reduced to the one of least text, and each component that the id
    leads keeps its own.
    """
    found = stash(_placed(docs, width, max_bits).filter("doc_id is not null"), "components")
    leads = F.col("doc_id") == F.col("component_id")
    times = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(leads).alias("leads")).filter("leads")
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(times.filter("n = 1").select("doc_id"), "doc_id", "left_semi").select(*names)
    again = stash(times.filter("n > 1").select("doc_id"), "repeated")
    if not again.isEmpty():                                                # these rows are told apart by their fingerprint
        rows = docs.join(again, "doc_id", "left_semi").select("doc_id", "text", F.struct(*names).alias("row"))
        rows = with_computed(rows, _fingerprint_column(width), [("fp", "long")])
        first = found.filter(leads).join(again, "doc_id", "left_semi").select("doc_id", "fp", "root").distinct()
        one = rows.join(first, ["doc_id", "fp"]).groupBy("doc_id", "root").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
        out = out.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
    return out.unionByName(docs.filter("doc_id is null"))


def op3_simhash_golay(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_golay": op3_simhash_golay}
ORACLES: dict[str, str] = {}
