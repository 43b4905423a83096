"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and styled letters to
plain ones, digits and signs inside words to the letters they stand for (``0`` o,
``1`` i, ``3`` e, ...; l and i become one letter, as ``1`` stands for both), and turns
everything else into single blanks.  Accents stay: they tell words apart.

The lexicon is learnt from labelled documents: entries are beginnings of words (3 to
7 letters) and whole words, weighted by the log ratio of their document shares in
toxic and other documents.  Where a word matches several entries the heaviest counts.
Exception phrases cancel matches: whole words and pairs of words that hold an entry
but occur in other documents and not in toxic ones, besides those given.  Which are
kept is decided by their document counts and weights alone; Spark does all counting.

The weights of a text are summed, normalised by its length (divided by the logarithm
of its number of words) and turned into a score by a logistic curve fitted on the
same labelled rows.  The fit uses at most ``MAX_ROWS`` labelled rows (a parameter);
scoring is one pass over whole texts without a shuffle.

Defined results: a null or empty text scores as one without matches; a null id is
not held out; repeated rows are scored each; without toxic labels nothing matches
and all scores are equal; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlearn.llm.common import bounded_labels, id_bucket, labelled_documents, read, slices, stash, with_computed

THRESHOLD = 0.7
#: Labelled rows that lexicon and curve are fitted on, at most.
MAX_ROWS = 20_000
#: Toxic documents an entry must occur in, and its least weight (log ratio).
LEAST_DOCS, LEAST_WEIGHT = 4, 2.5
#: Taken off every weight, so that several weak entries do not outweigh a strong one.
MARGIN = 2.0
PREFIXES = range(3, 8)
#: Phrases that are harmless although a word of them may be in the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "rodeo clown", "clown fish", "sore loser")

# ------------------------------------------------------------------- folding
#: Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "i", "һ": "h",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "µ": "u", "μ": "u",
}
#: Digits and signs that stand for letters.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])|(?<!\S)\$(?=[^\W\d_])")


def _letter(c: str) -> str:
    """The folded form of one lower-case character: a letter a-z, another letter as it is, or a blank."""
    c = _LOOK_ALIKES.get(c, c)
    if c in "@$!|":
        return " "                                   # handled before, where it stands inside a word
    c = _SIGNS.get(c, c)
    if "a" <= c <= "z":
        return c
    plain = unicodedata.normalize("NFKC", c).lower()
    if plain and plain != c:
        return "".join(_LOOK_ALIKES.get(x, _SIGNS.get(x, x)) for x in plain if x.isalpha()) or " "
    return c if c.isalpha() else " "


class _Table(dict):
    """A translation table filled as characters occur."""

    def __missing__(self, code: int) -> str:
        self[code] = v = _letter(chr(code))
        return v


_TABLE = _Table()
_LATIN1 = [_letter(chr(c)) for c in range(256)]
#: One byte for one byte where that is enough; Latin-1 letters fold to one letter or stay.
_LATIN1_BYTES = bytes(ord(x[0]) if ord(x[0]) < 256 else 32 for x in _LATIN1)
_COMBINING = re.compile("[\u0300-\u036f\u200b-\u200f\u00ad]")


def folded(text: str) -> str:
    """Folded words, single blanks between, one blank before and after."""
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _INSIDE.sub(lambda m: "".join(_SIGNS[c] for c in m.group()), text)
    try:
        plain = text.encode("latin-1").replace(b"\xad", b"").translate(_LATIN1_BYTES)
        return " " + b" ".join(plain.split()).decode("latin-1") + " "
    except UnicodeEncodeError:
        text = _COMBINING.sub("", unicodedata.normalize("NFC", text))
        return " " + " ".join(text.translate(_TABLE).split()) + " "


# ------------------------------------------------------------------- lexicon
@dataclasses.dataclass(frozen=True)
class Lexicon:
    """``entries``: folded pattern (with its leading blank) to weight; ``exceptions``: folded phrases with blanks around."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = 0.0

    def matcher(self) -> Matcher:
        return Matcher(self)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * x + self.bias, -60, 60)))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        for p, w in lexicon.entries.items():
            self.automaton.add_word(p, (len(p), w))
        for p in lexicon.exceptions:
            self.automaton.add_word(p, (len(p), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def words(self, text: str) -> dict[int, float]:
        """Heaviest entry by the position of the blank before the word; excepted words are left out."""
        best: dict[int, float] = {}
        spared: set[int] = set()
        if self.empty:
            return best
        for end, (n, weight) in self.automaton.iter(text):
            start = end + 1 - n
            if weight is None:
                at = start
                while 0 <= at < end:
                    spared.add(at)
                    at = text.find(" ", at + 1)
            elif weight > best.get(start, 0.0):
                best[start] = weight
        return {k: w for k, w in best.items() if k not in spared}

    def strength(self, text: str) -> float:
        """Summed weights over the logarithm of the number of words."""
        found = self.words(text)
        return sum(found.values()) / math.log2(1 + text.count(" ")) if found else 0.0


def _patterns(word: str):
    for n in PREFIXES:
        if n < len(word):
            yield " " + word[:n]
    yield f" {word} "


_COUNTS = "pattern string, docs long"


def _counted(make, limit: int = 200_000):
    """``mapInArrow`` function: document counts of what ``make()`` finds in a text; a task's partial sums leave it when there are many."""
    def send(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["pattern", "docs"])

    def run(batches):
        find, counts = make(), Counter()
        for batch in batches:
            for _, texts in slices(batch, "text"):
                for t in texts:
                    counts.update(find(folded(t.decode())))
                    if len(counts) > limit:
                        yield send(counts)
                        counts = Counter()
        if counts:
            yield send(counts)
    return run


def _all_patterns():
    return lambda text: {p for w in set(text.split()) if len(w) > 2 for p in _patterns(w)}


def _held_phrases(entries: dict[str, float]):
    """Whole words that hold an entry, and the same with the word before or after."""
    def make():
        matcher = Matcher(Lexicon(entries))

        def find(text):
            found = set()
            for at in matcher.words(text):
                after = text.find(" ", at + 1)
                found.add(text[at:after + 1])
                before, later = text.rfind(" ", 0, at) if at else -1, text.find(" ", after + 1)
                if before >= 0:
                    found.add(text[before:after + 1])
                if later >= 0:
                    found.add(text[at:later + 1])
            return found
        return find
    return make


def _beyond_longer(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Weights of the entries, less ``MARGIN``.

    The beginning of a word must tell something beyond the longer entry it shares most documents with: its weight
    is that of the documents left, and it is dropped if those are too few or tell too little.  Five letters or more
    that no other document has are kept as they are: they cover inflected forms.
    """
    longest = max(PREFIXES)
    child: dict[str, tuple[int, int]] = {}
    for p, c in counts.items():
        for n in range(min(PREFIXES), min(len(p.rstrip()) - 1, longest + 1)):
            child[p[:n + 1]] = max(child.get(p[:n + 1], (0, 0)), c)
    out = {}
    for p, (bad, fine) in counts.items():
        b, f = (0, 0) if not fine and len(p) > 5 else child.get(p, (0, 0))
        bad, fine = bad - b, max(fine - f, 0)
        w = math.log((bad + 0.5) / (toxic + 1)) - math.log((fine + 0.5) / (other + 1))
        if bad >= max(LEAST_DOCS, toxic // 500) and w >= LEAST_WEIGHT:
            out[p] = w - MARGIN
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope (not negative) and bias of a lightly penalised logistic fit by Newton steps."""
    a = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.05])
        step = np.linalg.solve(h, a.T @ (y - p) - 0.05 * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, mod: int = 3, held: int = 1,
        exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn lexicon, exceptions and curve from at most ``max_rows`` labelled documents outside the held-out bucket."""
    given = tuple(folded(p) for p in exceptions)
    sample = bounded_labels(labels, "toxic", max_rows, mod, held)
    toxic = sum(y for _, y in sample)
    if not toxic:
        return Lexicon({}, given)
    # the sampled texts are written once; of rows that repeat an id the smallest text counts, so their number is bounded too
    rows = stash(labelled_documents(docs, sample).groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    other = len(sample) - toxic

    def count(y, make):
        return rows.filter(F.col("y") == y).select("text").mapInArrow(_counted(make), _COUNTS).groupBy("pattern").agg(F.sum("docs").alias("docs"))
    bad, fine = count(1, _all_patterns), count(0, _all_patterns).withColumnRenamed("docs", "fine")
    weight = F.log((F.col("docs") + 0.5) / (toxic + 1)) - F.log((F.coalesce("fine", F.lit(0)) + 0.5) / (other + 1))
    top = (bad.filter(F.col("docs") >= max(LEAST_DOCS, toxic // 500)).join(fine, "pattern", "left").withColumn("w", weight)
              .filter(F.col("w") >= LEAST_WEIGHT).collect())                            # patterns of a bounded number of texts
    entries = _beyond_longer({r["pattern"]: (r["docs"], r["fine"] or 0) for r in top}, toxic, other)
    phrases: list[str] = []
    if entries:                                        # phrases of other documents, and of no toxic one, that hold an entry
        held_in = count(0, _held_phrases(entries)).filter(F.col("docs") >= max(3, other // 500)).join(count(1, _held_phrases(entries)), "pattern", "left_anti")
        phrases = sorted(r["pattern"] for r in held_in.collect())
    lexicon = Lexicon(entries, tuple(dict.fromkeys([*given, *phrases])))

    def make():
        m = lexicon.matcher()
        return lambda texts: {"x": np.array([m.strength(folded(t.decode())) for t in texts], float)}
    got = sorted((r["doc_id"], r["x"], r["y"]) for r in with_computed(rows, make, [("x", "double")], keep=["doc_id", "y"]).collect())
    slope, bias = _logistic(np.array([g[1] for g in got]), np.array([g[2] for g in got], float))
    return dataclasses.replace(lexicon, slope=slope, bias=bias)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, keep=("doc_id",)) -> DataFrame:
    """Append ``score``, ``predicted`` (score >= threshold) and ``n_matches`` to the kept columns."""
    def make():
        m = lexicon.matcher()

        def run(texts):
            words = [folded(t.decode()) for t in texts]
            found = [m.words(w) for w in words]
            x = np.array([sum(f.values()) / math.log2(1 + w.count(" ")) if f else 0.0 for w, f in zip(words, found)], float)
            s = lexicon.score(x)
            return {"score": s, "predicted": (s >= threshold).astype(np.int32), "n_matches": np.array([len(f) for f in found], np.int64)}
        return run
    return with_computed(docs, make, [("score", "double"), ("predicted", "int"), ("n_matches", "long")], keep=keep)


def op4_weighted_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    lexicon = fit(docs, read(spark, sf, "labels"))
    return (score(docs, lexicon)
            .select("doc_id", F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_matches"))


QUERIES = {"op4_weighted_lexicon": op4_weighted_lexicon}
ORACLES: dict[str, str] = {}
