"""Conversation structure repair: the lightest derivation of a legal order of roles.

A legal conversation has the role initials ``(s?(ua)+)?``.  Rows may be kept, given another
role, or deleted, and empty turns may be inserted, each at a cost; blank rows and repeats must
go, truncated rows that stay cost extra.  An item ``(i, q)`` says that the first i rows are
repaired and the grammar is in state q; edits are deductions from one item to the next, and a
derivation weighs (cost, audit), the audit being the initials of its edits.  ``lightest`` is
Knuth's agenda: items wait in a heap and the smallest is final when it is popped.  That needs
superior functions: appending edits never lowers the cost and always enlarges the audit, and of
two derivations of one item with equal cost neither audit is the beginning of the other (both
hold as many row edits, so the longer one has paid for more insertions); hence order is kept.

Scale: rows are dealt by ranges of (conversation, turn, role, text), so a conversation with a
third of all rows spreads over tasks.  A task cuts a conversation into segments of bounded rows
and derives each segment from every state it may be entered in.  The segments of a conversation
then meet in order: the same agenda runs over deductions with two premises, what came before
and a segment's derivation.  The repaired texts are hashed in a last pass that streams the rows
of a conversation past its audit.  No task holds a conversation's rows; one audit is one row by
contract.  First and repeated rows are told apart by 128-bit hashes of role and text.

Defined results: null role and text are one space; rows of equal turn come in the order of role,
then text (null turns first); a null ``conv_id`` is a conversation; role initials other than s, u
and a, and empty roles, are never legal; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Hashable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.llm.common import read, stash

# ------------------------------------------------------------------- agenda
Weight = tuple[int, str]


def lightest(axioms: Iterable[tuple[Hashable, Weight]], deduce: Callable[[Hashable, Weight], Iterable[tuple[Hashable, Weight]]],
             goals: Iterable[Hashable]) -> dict[Hashable, Weight]:
    """Knuth's agenda: the weights of the items that finalise until all reachable goals have.

    ``deduce(item, weight)`` gives the conclusions that the item, just finalised, allows
    together with premises given before; weights must never fall.
    """
    agenda = [(w, item) for item, w in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, Weight] = {}
    waiting: dict[Hashable, Weight] = {}
    open_goals = set(goals)
    while agenda and open_goals:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        open_goals.discard(item)
        for conclusion, w in deduce(item, weight):
            if conclusion not in final and (conclusion not in waiting or w < waiting[conclusion]):
                waiting[conclusion] = w
                heapq.heappush(agenda, (w, conclusion))
    return final


# ------------------------------------------------------------------ grammar
#: States: nothing yet, after s, after u, after a.  A legal conversation ends in the first or the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
_GO = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A row as one character: its role's initial (OTHER for any other), in upper case or OTHER_CUT if truncated; GONE for a row that must go.
GONE, OTHER, OTHER_CUT = "-", ".", ":"


def wanted(state: int) -> str:
    """The role that edits may put in a state (user or assistant)."""
    return "a" if state == AFTER_U else "u"


def edits(state: int, row: str | None):
    """(initial, cost, whether the row is used, next state) of the edits in a state."""
    yield "I", INSERT, False, _GO[state, wanted(state)]
    if row is None:
        return
    yield "D", DELETE, True, state
    if row != GONE:
        extra = TRUNCATED if row.isupper() or row == OTHER_CUT else 0
        to = _GO.get((state, row.lower()))
        if to is not None:
            yield "K", KEEP + extra, True, to
        yield "R", REROLE + extra, True, _GO[state, wanted(state)]


@lru_cache(maxsize=50_000)
def segment(rows: str, entry: int) -> tuple[Weight | None, ...]:
    """Lightest derivation of a run of rows from the state ``entry`` to each state (None: impossible)."""
    n = len(rows)

    def deduce(item, weight):
        i, state = item
        for initial, cost, used, to in edits(state, rows[i] if i < n else None):
            yield (i + used, to), (weight[0] + cost, weight[1] + initial)

    final = lightest([((0, entry), (0, ""))], deduce, [(n, q) for q in range(4)])
    return tuple(final.get((n, q)) for q in range(4))


def join_segments(before: dict[int, Weight], after: Callable[[int], tuple[Weight | None, ...]]) -> dict[int, Weight]:
    """Deductions with two premises: a derivation up to here and one of the next segment, entered where it ended."""
    def deduce(item, weight):
        joined, state = item
        for to, w in enumerate(() if joined else after(state)):
            if w is not None:
                yield (True, to), (weight[0] + w[0], weight[1] + w[1])

    goals = [(True, q) for q in range(4)]
    final = lightest([((False, q), w) for q, w in before.items()], deduce, goals)
    return {q: final[True, q] for q in range(4) if (True, q) in final}


# ----------------------------------------------------------------- operators
#: Rows of a segment at most.
SEGMENT_ROWS = 512
_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
_ORDER = ["conv_id", "_turn", "_role", "_text"]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage dealt by a checksum of their place; dropped rows stay as marks (``_there`` false), so no conversation is lost."""
    blank = F.lit(" ")
    case = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.coalesce(F.col("text"), blank)
    return (rows.select("conv_id", F.col("turn").cast("long").alias("_turn"), case.alias("_case"), F.coalesce(F.col("role"), blank).alias("_role"), text.alias("_text"))
                .select("conv_id", "_turn", (F.col("_case") != 0).alias("_there"),
                        F.when(F.col("_case") == 0, "").when(F.col("_case") == 4, "user").otherwise(F.col("_role")).alias("_role"),
                        F.when(F.col("_case").isin(0, 1), "").when(F.col("_case") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")).alias("_text"),
                        F.explode(F.when(F.col("_case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``_blank``, ``_ended``, ``_copies`` (equal rows of the turn) and ``_first`` (no earlier turn has an equal row).

    Equal rows (conversation, turn, role, text) become one row with a count, so copies do not travel.
    """
    equal = (rows.withColumn("_h1", F.xxhash64("_role", "_text")).withColumn("_h2", F.xxhash64("_text", F.lit(1), "_role"))
                 .groupBy("conv_id", "_turn", "_there", "_role", "_text", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_copies")))
    equal = stash(equal.withColumn("_blank", ~F.col("_text").rlike(_BLANK)).withColumn("_ended", F.col("_text").rlike(_ENDED)), "conversation-rows")
    place = F.struct(F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"))
    first = (equal.filter("_there and not _blank").groupBy("conv_id", "_h1", "_h2").agg(F.min(place).alias("_place"), F.count(F.lit(1)).alias("_turns"))
                  .filter("_turns > 1").select(F.col("conv_id").alias("_c"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), "_place"))
    return (equal.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")), "left")
                 .withColumn("_first", F.col("_place").isNull() | (F.col("_place") == place))
                 .drop("_c", "_a", "_b", "_place", "_h1", "_h2"))


_SEGMENT = ("at long, n long, low long, high long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, "
            "illegal long, head string, tail string, derivations array<struct<entry:int,state:int,cost:long,audit:string>>")
_LEGAL = {"su", "ua", "au"}


class _Counts:
    """What a run of rows adds up to, and its rows as characters."""

    def __init__(self, at):
        self.at, self.n, self.low, self.high, self.turns, self.first_turn, self.last_turn = at, 0, None, None, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.tail = None
        self.rows = []

    def add(self, turn, role, blank, repeat, ended):
        initial = role[:1] if role[:1] in ("s", "u", "a") else OTHER
        if self.n == 0:
            self.head = initial
        elif self.tail + initial not in _LEGAL:
            self.illegal += 1
        self.tail = initial
        self.n += 1
        if turn is not None:
            if self.last_turn != turn:
                self.turns += 1
            if self.low is None:
                self.low = self.first_turn = turn
            self.high = self.last_turn = turn
        if blank:
            self.blank += 1
        elif repeat:
            self.duplicate += 1
        elif not ended:
            self.truncated += 1
        self.rows.append(GONE if blank or repeat else initial if ended else initial.upper() if initial != OTHER else OTHER_CUT)

    def row(self, entries):
        rows = "".join(self.rows)
        found = [{"entry": p, "state": q, "cost": w[0], "audit": w[1]} for p in entries for q, w in enumerate(segment(rows, p)) if w is not None]
        return {"at": self.at, "n": self.n, "low": self.low, "high": self.high, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
                "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "head": self.head, "tail": self.tail, "derivations": found}


def segments(rows: DataFrame, limit: int = SEGMENT_ROWS) -> DataFrame:
    """``(conv_id, at, ...)``: each run of at most ``limit`` rows of a conversation, in order of ``at``, with its derivations."""
    ordered = (rows.select("conv_id", "_turn", "_there", "_role", "_text", "_blank", "_ended", "_first", "_copies")
                   .repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).drop("_text")
                   .select(F.spark_partition_id().cast("long").alias("_part"), "conv_id", "_turn", "_there", "_role", "_blank", "_ended", "_first", "_copies"))
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string(_SEGMENT).fields])
    inner = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches):
        conv, counts, entries, serial, out, id_type = None, None, (), 0, [], None

        def table():
            cols = [pa.array([c for c, _ in out], id_type)]
            for f in schema.fields[1:]:
                kind = inner if f.name == "derivations" else pa.string() if f.name in ("head", "tail") else pa.int64()
                cols.append(pa.array([r[f.name] for _, r in out], kind))
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for b in batches:
            id_type = b.column(1).type
            for part, c, turn, there, role, blank, ended, first, copies in zip(*(x.to_pylist() for x in b.columns)):
                if counts is None or c != conv:
                    if counts is not None:
                        out.append((conv, counts.row(entries)))
                    # only the first conversation of a partition may have begun in another
                    entries = (START, AFTER_S, AFTER_U, AFTER_A) if counts is None and part else (START,)
                    conv, counts = c, _Counts((part << 40) + serial)
                    serial += 1
                for k in range(copies if there else 0):
                    if counts.n == limit:
                        out.append((conv, counts.row(entries)))
                        entries, counts = (START, AFTER_S, AFTER_U, AFTER_A), _Counts((part << 40) + serial)
                        serial += 1
                    counts.add(turn, role, blank, k > 0 or not first, ended)
                if len(out) >= 1000:
                    yield table()
                    out = []
        if counts is not None:
            out.append((conv, counts.row(entries)))
        if out:
            yield table()
    return ordered.mapInArrow(run, schema)


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def joined_segments(parts: DataFrame) -> DataFrame:
    """One row per conversation: the counts and the lightest repair of its segments in order."""
    schema = T.StructType([parts.schema["conv_id"], *T._parse_datatype_string(_RESULT).fields])
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "at")

    def run(batches):
        conv, total, reached, begun, id_type = None, None, None, False, None

        def result():
            weight = min(reached[q] for q in ENDS if q in reached)
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            return (conv, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], *weight)

        def table(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.string())], names=schema.names)

        for b in batches:
            id_type, out = b.column(0).type, []
            for s in b.to_pylist():
                if not begun or s["conv_id"] != conv:
                    if begun:
                        out.append(result())
                    conv, begun, reached = s["conv_id"], True, {START: (0, "")}
                    total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0) | {"low": None, "high": None, "last_turn": None, "tail": None}
                if not s["n"]:
                    continue
                by_entry = {}
                for d in s["derivations"]:
                    by_entry.setdefault(d["entry"], [None] * 4)[d["state"]] = (d["cost"], d["audit"])
                reached = join_segments(reached, lambda q: by_entry[q])
                for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
                    total[k] += s[k]
                if total["tail"] is not None and total["tail"] + s["head"] not in _LEGAL:
                    total["illegal"] += 1
                if s["low"] is not None:
                    total["turns"] -= total["last_turn"] == s["first_turn"]
                    total["low"] = s["low"] if total["low"] is None else total["low"]
                    total["high"], total["last_turn"] = s["high"], s["last_turn"]
                total["tail"] = s["tail"]
            if out:
                yield table(out)
        if begun:
            yield table([result()])
    return ordered.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, repairs: DataFrame, make) -> DataFrame:
    """Stream each conversation's rows past its audit.

    ``make()`` gives an object with ``turn(role, text)`` and ``end()``; what ``end`` returns is the
    conversation's ``value`` (string).  A conversation's repair travels as a row in front of its rows.
    """
    none = F.lit(None)
    marks = repairs.select("conv_id", F.lit(0).alias("_kind"), none.cast("long").alias("_turn"), F.lit("").alias("_role"), F.lit("").alias("_text"),
                           F.lit(1).cast("long").alias("_copies"), F.col("audit").alias("_audit"))
    body = rows.filter("_there").select("conv_id", F.lit(1).alias("_kind"), "_turn", "_role", "_text", "_copies", none.cast("string").alias("_audit"))
    keys = ["conv_id", "_kind", "_turn", "_role", "_text"]
    ordered = marks.unionByName(body).repartition("conv_id").sortWithinPartitions(*keys)
    schema = T.StructType([repairs.schema["conv_id"], T.StructField("value", T.StringType())])
    names = {"u": "user", "a": "assistant"}

    def run(batches):
        sink, state, audit, i, conv, id_type = None, START, "", 0, None, None

        def inserted():
            nonlocal i, state
            while i < len(audit) and audit[i] == "I":
                role = wanted(state)
                sink.turn(names[role], "")
                state, i = _GO[state, role], i + 1

        def finished():
            inserted()
            return conv, sink.end()

        for b in batches:
            id_type, out = b.column(0).type, []
            for c, kind, _, role, text, copies, mark in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 0:
                    if sink is not None:
                        out.append(finished())
                    sink, state, audit, i, conv = make(), START, mark, 0, c
                    continue
                for _ in range(copies):
                    inserted()
                    edit, i = audit[i], i + 1
                    if edit == "D":
                        continue
                    initial = wanted(state) if edit == "R" else role[:1]
                    sink.turn(names[initial] if edit == "R" else role, text)
                    state = _GO[state, initial]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.string())], names=schema.names)
        if sink is not None:
            c, v = finished()
            yield pa.RecordBatch.from_arrays([pa.array([c], id_type), pa.array([v], pa.string())], names=schema.names)
    return ordered.mapInArrow(run, schema)


class TurnHash:
    """SHA-256 of ``role:text`` of the turns, joined by newlines, without holding them."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def turn(self, role, text):
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def end(self):
        return self.hash.hexdigest()


class TurnText:
    """The repaired conversation as JSON lines of [role, text]; for texts that fit a row."""

    def __init__(self):
        self.lines = []

    def turn(self, role, text):
        self.lines.append(json.dumps([role, text], ensure_ascii=False))

    def end(self):
        return "\n".join(self.lines)


def repair(rows: DataFrame, make=TurnHash, limit: int = SEGMENT_ROWS) -> DataFrame:
    """Repair conversations given as rows ``(conv_id, _turn, _there, _role, _text)``: counts, cost, audit and ``value`` (see ``repaired_rows``)."""
    faults = stash(with_faults(rows), "conversation-faults")
    found = stash(joined_segments(segments(faults, limit)), "conversation-repairs")
    return found.join(repaired_rows(faults, found, make).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def op12_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows)).withColumnRenamed("value", "repaired_sha256")


QUERIES = {"op12_structure_repair": op12_structure_repair}
ORACLES: dict[str, str] = {}
