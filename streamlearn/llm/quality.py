"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_statistics`` turns a whole text into a fixed vector of counts and
shares.  ``fit`` grows boosted trees from per-feature histograms on a bounded
sample of labelled rows (``max_rows``, a parameter).  The trees are complete
binary trees flattened into arrays, so a batch of rows walks all of them with
numpy indexing.  Scoring is one pass over the documents without a shuffle.

Defined results: a null text counts as empty; an empty text has the all-zero
vector and gets the score of that vector; a null ``doc_id`` is scored, is not
held out and never trains; repeated rows are scored each; an empty table gives
an empty result; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlearn.llm.common import bounded_labels, filter_rows, id_bucket, labelled_documents, read, with_computed

#: Accepted at this score or above.
THRESHOLD = 0.3
#: Labelled rows that the trees are fitted on, at most.
MAX_ROWS = 20_000


def _byte_classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    lower, upper = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    digit = (b >= 48) & (b <= 57)
    space = np.isin(b, [32, 9, 10, 11, 12, 13])
    lead = b >= 192                       # first byte of a multi-byte character
    tail = (b >= 128) & (b < 192)
    end = np.isin(b, [46, 33, 63])        # . ! ?
    punct = (b > 32) & (b < 127) & ~lower & ~upper & ~digit
    symbol = punct & ~np.isin(b, [46, 44, 33, 63, 58, 59, 39, 34, 40, 41, 45])
    return {"lower": lower, "upper": upper, "digit": digit, "space": space, "lead": lead, "char": ~tail,
            "end": end, "punct": punct, "symbol": symbol, "newline": b == 10, "bar": b == 124,
            "bang": b == 33, "control": (b < 32) & ~space}


_CLASSES = _byte_classes()
_MASK = np.stack(list(_CLASSES.values()), axis=1).astype(np.float64)      # 256 x classes
_AT = {n: i for i, n in enumerate(_CLASSES)}

FEATURES = ["log_chars", "log_words", "log_lines", "mean_word", "distinct_words", "distinct_lines", "top_word",
            "chars_per_line", "words_per_end", "entropy", "top_byte",
            "lower", "upper", "digit", "space", "lead", "end", "punct", "symbol", "bar", "bang", "control"]


def document_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per UTF-8 text."""
    n = len(texts)
    hist = np.zeros((n, 256))
    words, lines, kinds, line_kinds, top = (np.zeros(n) for _ in range(5))
    for i, t in enumerate(texts):
        if not t:
            continue
        hist[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        ws = t.lower().split()
        words[i] = len(ws)
        if ws:
            ids, counts = {}, []
            for w in ws:
                k = ids.setdefault(w, len(counts))
                if k == len(counts):
                    counts.append(1)
                else:
                    counts[k] += 1
            kinds[i], top[i] = len(counts), max(counts)
        ls = [x for x in t.split(b"\n") if x]
        lines[i], line_kinds[i] = len(ls), len(set(ls))
    c = hist @ _MASK
    chars = c[:, _AT["char"]]
    one = lambda a: np.maximum(a, 1.0)
    total = one(hist.sum(1))
    p = hist / total[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1)
    cols = [np.log1p(chars), np.log1p(words), np.log1p(lines), (chars - c[:, _AT["space"]]) / one(words),
            kinds / one(words), line_kinds / one(lines), top / one(words), chars / one(lines),
            words / one(c[:, _AT["end"]]), entropy, p.max(1)]
    cols += [c[:, _AT[k]] / one(chars) for k in FEATURES[11:]]
    return np.stack(cols, axis=1)


@dataclasses.dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray       # trees x (2^depth - 1)
    cut: np.ndarray           # same shape; right when value > cut
    leaf: np.ndarray          # trees x 2^depth
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += leaf[node - (2 ** self.depth - 1)]
        return 1.0 / (1.0 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64,
              rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss.

    Every level of a tree builds one gradient and one curvature histogram per
    (node, feature, bin) with ``bincount`` and takes the best split of each
    node.  A node without a useful split sends all rows left.
    """
    n, d = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    inner = 2 ** depth - 1
    if not n:
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = np.array([len(e) for e in edges])
    flat = np.arange(d) * bins + code                              # n x d
    splits = np.arange(bins)[None, :] < width[:, None]             # cut k lies after bin k
    z = np.full(n, base)
    feature, cut, leaf = np.zeros((trees, inner), int), np.zeros((trees, inner)), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            k, first = 2 ** level, 2 ** level - 1
            at = ((node - first)[:, None] * (d * bins) + flat).ravel()
            G, H = (np.bincount(at, np.repeat(v, d), k * d * bins).reshape(k, d, bins) for v in (g, h))
            gl, hl = G.cumsum(2), H.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain = np.where(splits & (hl >= least / 4) & (ht - hl >= least / 4), gain, -1.0).reshape(k, -1)
            best = gain.argmax(1)
            for i in range(k):
                f, b = divmod(int(best[i]), bins)
                ok = gain[i, best[i]] > 1e-6
                feature[t, first + i] = f
                cut[t, first + i] = edges[f][b] if ok else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        G, H = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf[t] = -rate * G / (H + l2)
        z += leaf[t][at]
    return Trees(base, feature, cut, leaf, depth)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, mod: int = 5, held: int = 0) -> Trees:
    """Fit on at most ``max_rows`` labelled documents outside the held-out bucket.

    Only the statistics of the sampled rows reach the driver (22 numbers a row).  Rows that repeat an id train once, with
    the least of their statistics, so their number is bounded too.
    """
    sample = bounded_labels(labels, "quality", max_rows, mod, held)
    if not sample:
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0))

    def make():
        return lambda texts: {"x": list(document_statistics(texts))}
    rows = with_computed(labelled_documents(docs, sample), make, [("x", "array<double>")], keep=["doc_id", "y"])
    got = rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit_trees(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, keep=("doc_id",)) -> DataFrame:
    """Append ``score`` and ``predicted`` (score >= threshold) to the kept columns."""
    def make():
        def run(texts):
            s = model.predict(document_statistics(texts))
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}
        return run
    return with_computed(docs, make, [("score", "double"), ("predicted", "int")], keep=keep)


def keep_accepted(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return filter_rows(docs, lambda: lambda texts: model.predict(document_statistics(texts)) >= threshold)


def op10_quality_trees(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = fit(docs, read(spark, sf, "labels"))
    return (score(docs, model)
            .select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted"))


QUERIES = {"op10_quality_trees": op10_quality_trees}
ORACLES: dict[str, str] = {}
