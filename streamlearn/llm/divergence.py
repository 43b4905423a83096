"""Source divergence audit: term shares of sources against each other and their language.

Terms are counted inside tasks (partial counts, flushed at a bounded size) and meet in one
shuffle by (lang, term), which also gives the document counts that decide the vocabulary.

Run-length columns: terms of a language with the same counts in all sources are one run; runs
are reordered so that equal counts stand together, and every source is a column of counts over
that order, run-length encoded.  For a pair of sources the run boundaries are intersected and
the term f of a stretch is multiplied by its length.  Tasks hold a bounded number of runs and
add up a language's pairs before the shuffle, so a language with a third of all rows is spread
over tasks.  The work of a pair follows the number of distinct count vectors, not the vocabulary.

All arithmetic is on integers.  Shares come from a long division in steps of 1000, exact for
sums of counts under 9e15; f is at most 1e18, and its sum over terms under (1e9 + V)^2.

Defined results: a row is a document (repeated rows count each); null text, lang and source are
empty strings; a language without kept terms has pair values of zero and no term rows; a language
with one source has no pair rows; a group without terms takes part with counts of zero; ties in value go to the smaller
item (UTF-8); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from streamlearn.llm.common import as_bytes, read, stash

#: Documents of a language that hold a term at least; term rows of a group at most.
MIN_DOCS, TOP_TERMS = 3, 200
#: Distinct terms a task counts before it hands them on; cells (runs x sources) it lays out at once.
FLUSH_TERMS, CELLS = 400_000, 2_000_000
UNIT = 1_000_000_000
#: Runs of ASCII letters and of bytes over 0x7F; in UTF-8 the same as runs of those code points.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: partial counts of tasks; a triple may come several times."""
    def flush(acc):
        rows = [(lang, source, t, n, d) for (lang, source), terms in acc.items() for t, (n, d) in terms.items()]
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()),
                                           pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        acc, size = {}, 0
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, text in zip(keys, as_bytes(batch.column(2))):
                terms = acc.setdefault(key, {})
                size -= len(terms)
                for t, n in Counter(_TERM.findall(text.lower())).items():
                    if t in terms:
                        terms[t][0] += n
                        terms[t][1] += 1
                    else:
                        terms[t] = [n, 1]
                size += len(terms)
                if size > FLUSH_TERMS:
                    yield flush(acc)
                    acc, size = {}, 0
        yield flush(acc)

    empty = F.lit("")
    return (docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"), "text")
                .mapInArrow(run, "lang string, source string, term string, n long, docs long"))


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, total, counts array<struct<source,n>>)`` of the kept terms, counts in order of the source.

    Rows are dealt by (lang, term), which serves both groupings.
    """
    by_source = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (by_source.groupBy("lang", "term")
                     .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
                     .filter(F.col("docs") >= min_docs).drop("docs"))


def group_totals(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(lang, source, size, terms, lang_size)`` of every occurring group: its count of kept terms, V, and the language's count."""
    empty = F.lit("")
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source")).distinct()
    sizes = vocab.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("size"))
    langs = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    return groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])


def share(count: str, whole: str) -> Column:
    """``1 + floor(1e9 * (count + 1) / whole)`` by long division in steps of 1000."""
    rest, out = f"({count} + 1)", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000 + {rest} * 1000 div ({whole}))", f"({rest} * 1000 % ({whole}))"
    return F.expr(f"{out} + 1")


def shares(count: np.ndarray, whole: int) -> np.ndarray:
    """``share`` on arrays."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def pair_sums(counts: np.ndarray, runs: np.ndarray, sizes: np.ndarray, terms: int) -> np.ndarray:
    """Sum over terms of f for each pair of columns; ``counts`` is runs x sources, ``runs`` the terms of each row."""
    n, s = counts.shape
    ends = np.concatenate([[0], np.cumsum(runs)])
    starts, columns = [], []
    for j in range(s):                                     # run-length encoding of every column
        at = np.flatnonzero(np.concatenate([[True], counts[1:, j] != counts[:-1, j]]))
        starts.append(at)
        columns.append(shares(counts[at, j], int(sizes[j]) + terms))
    out = np.zeros((s, s), np.int64)
    for g in range(s):
        for q in range(s):
            if g != q:
                at = np.union1d(starts[g], starts[q])      # boundaries of both
                pg = columns[g][np.searchsorted(starts[g], at, "right") - 1]
                pq = columns[q][np.searchsorted(starts[q], at, "right") - 1]
                length = np.diff(np.append(ends[at], ends[n]))
                out[g, q] = int(((pg - pq) * (pg - pq) // pq * length).sum())
    return out


def pair_part(vocab: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of sources of a language."""
    runs = vocab.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("run"))
    columns = totals.filter("terms > 0").groupBy("lang", "terms").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("sources"))
    rows = runs.join(columns, "lang").repartition("lang", "counts").sortWithinPartitions("lang").select("lang", "terms", "sources", "counts", "run")

    def run(batches):
        state = None                                       # of the language at hand: names, sums and rows not yet laid out

        def lay_out():
            names, place = state["names"], state["place"]
            m = np.zeros((len(state["rows"]), len(names)), np.int64)
            for i, row in enumerate(state["rows"]):
                for c in row:
                    m[i, place[c["source"]]] = c["n"]
            order = np.lexsort(m.T[np.argsort(np.count_nonzero(m, axis=0))])       # equal counts of the fullest columns stand together
            state["sums"] += pair_sums(m[order], np.array(state["runs"], np.int64)[order], state["sizes"], state["terms"])
            state["rows"], state["runs"] = [], []

        def finished():
            if state["rows"]:
                lay_out()
            names, s = state["names"], len(state["names"])
            g, q = (x.ravel() for x in np.indices((s, s)))
            off = g != q
            take = lambda k: pa.array([names[i] for i in k], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([state["lang"]] * int(off.sum()), pa.string()), take(g[off]), take(q[off]),
                                               pa.array(state["sums"].ravel()[off], pa.int64())], names=["lang", "source", "item", "value"])

        for batch in batches:
            langs, counts, lengths = batch.column(0).to_pylist(), batch.column(3), batch.column(4).to_pylist()
            for i, lang in enumerate(langs):
                if state is None or state["lang"] != lang:
                    if state is not None:
                        yield finished()
                    sources = batch.column(2)[i].as_py()
                    names = [x["source"] for x in sources]
                    state = {"lang": lang, "names": names, "place": {x: k for k, x in enumerate(names)}, "sizes": np.array([x["size"] for x in sources], np.int64),
                             "terms": batch.column(1)[i].as_py(), "rows": [], "runs": [], "sums": np.zeros((len(names), len(names)), np.int64)}
                state["rows"].append(counts[i].as_py())
                state["runs"].append(lengths[i])
                if len(state["rows"]) * len(state["names"]) >= CELLS:
                    lay_out()
        if state is not None:
            yield finished()

    sums = rows.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    return pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])


def term_part(vocab: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: every term that a group uses more than its language."""
    p, q = share("n", "size + terms"), share("total", "lang_size + terms")
    return (vocab.select("lang", F.col("term").alias("item"), "total", F.explode("counts").alias("c")).select("lang", "item", "total", "c.source", "c.n")
                 .join(totals, ["lang", "source"]).select("lang", "source", "item", p.alias("p"), q.alias("q")).filter("p > q")
                 .select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ranked distances of a group to the other sources, and its telling terms."""
    vocab = stash(vocabulary(docs, min_docs), "divergence-terms")
    totals = stash(group_totals(docs, vocab), "divergence-groups")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(pair_part(vocab, totals), "pair").unionByName(ranked(term_part(vocab, totals), "term").filter(F.col("rank") <= top_terms))


def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence(read(spark, sf, "documents").select("lang", "source", "text"))


def _share_sql(count: str, whole: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({count} + 1)) // ({whole})::HUGEINT)"


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
 k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 z AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL),
 l AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY ALL),
 a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total, coalesce(z.size, 0) AS size, l.v, l.size AS lang_size
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN z ON z.lang = g.lang AND z.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT *, {_share_sql('n', 'size + v')} AS p, {_share_sql('total', 'lang_size + v')} AS q FROM a),
 s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
 r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""}
