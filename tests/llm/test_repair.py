import hashlib
import re
import sys
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_MID
from streamlearn.llm import repair as R

CONV = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)                     # the plain search goes one call deeper per edit
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) by trying every edit of every row, without the agenda; rows as characters."""
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(rows) and q in (0, 3) else []
        want = "a" if q == 2 else "u"
        if inserted < 3:
            c, a = best(i, go[q, want], inserted + 1)
            found.append((c + 5, "I" + a))
        if i < len(rows):
            moves = [("D", 2, q)]
            if rows[i] != "-":
                extra = 5 if rows[i].isupper() or rows[i] == ":" else 0
                moves.append(("R", 1 + extra, go[q, want]))
                if (q, rows[i].lower()) in go:
                    moves.append(("K", extra, go[q, rows[i].lower()]))
            for letter, cost, to in moves:
                c, a = best(i + 1, to, 0)
                found.append((c + cost, letter + a))
        return min(found, default=(10**9, ""))
    return best(0, 0, 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda v: " " if v is None else v
        case = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def plain(rows, broken=True):
    after = damage(rows) if broken else [(c, t, *(" " if v is None else v for v in (r, x))) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        seen, chars, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            body = text.rstrip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "."
            chars += "-" if fault in ("blank", "duplicate") else (c.upper() if c != "." else ":") if fault else c
        starts = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        cost, audit = cheapest(chars)
        state, at, lines = 0, iter(own), []
        for letter in audit:
            want = "a" if state == 2 else "u"
            if letter == "I":
                lines.append(("assistant" if want == "a" else "user") + ":")
            else:
                _, role, text = next(at)
                if letter == "D":
                    continue
                want = role[:1] if letter == "K" else want
                lines.append(f"{role if letter == 'K' else 'assistant' if want == 'a' else 'user'}:{text}")
            state = {"s": 1, "u": 2, "a": 3}[want]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def got(df, value="value"):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in [*COLS, value]) for r in rows}
    assert len(out) == len(rows)
    return out


@given(st.text("suaxSUA-:.", max_size=9).map(lambda s: s.replace("x", ".")))
@settings(max_examples=400, deadline=None)
def test_agenda_finds_the_lightest(rows):
    ends = R.segment(rows, R.START)
    assert min(ends[q] for q in R.ENDS if ends[q]) == cheapest(rows)


@given(st.lists(st.text("suaSUA-:.", max_size=4), max_size=5))
@settings(max_examples=300, deadline=None)
def test_segments_join_to_the_same(parts):
    reached = {R.START: (0, "")}
    for p in parts:
        reached = R.join_segments(reached, lambda q: R.segment(p, q))
    assert min(reached[q] for q in R.ENDS if q in reached) == cheapest("".join(parts))


def test_insertions_where_they_pay(monkeypatch):
    monkeypatch.setattr(R, "INSERT", 1)
    R.segment.cache_clear()
    ends = R.segment("sa", R.START)
    assert min(ends[q] for q in R.ENDS if ends[q]) == (1, "KIK")
    R.segment.cache_clear()


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    assert got(R.op12_structure_repair(spark, SF_MID), "repaired_sha256") == want
    letters = "".join(w[6] for w in want.values())
    assert set(letters) == set("KRD")            # an insertion costs more than the deletion that serves as well


def conversation(n, conv=1):
    """A long conversation with faults of all kinds, equal rows far apart, and repeated turns."""
    roles = ["system", "user", "assistant", "user", "user", "assistant", "assistant", "tool", ""]
    texts = ["Fine.", "what?", "cut off", " \t", "", "Fine.", "é!", "."]
    return [(conv, None if i < 3 else 3 * (i // 4), roles[(i * 7 + i // 5) % 9], texts[(i * 5 + i // 3) % 8] if i % 4 else f"row {i}.") for i in range(n)]


@pytest.mark.parametrize("limit", [1, 3, 512])
def test_segments_and_partitions(spark, limit):
    rows = conversation(300) + conversation(40, None) + conversation(7, -5) + [(8, 1, "user", "a."), (9, None, None, None)]
    df = spark.createDataFrame(rows, CONV).repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(R.repair(R.damaged(df), limit=limit)) == plain(rows)
        whole = df.selectExpr("conv_id", "turn as _turn", "true as _there", "coalesce(role, ' ') as _role", "coalesce(text, ' ') as _text", "'x' as audit", "1 as blank")
        assert got(R.repair(whole, limit=limit)) == plain(rows, broken=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_every_row_dropped_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hello.")], CONV)
    assert got(R.repair(R.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(R.repair(R.damaged(spark.createDataFrame([], CONV)))) == {}


def test_long_texts_and_text_sink(spark):
    long = "word " * 200_000 + "end."
    df = spark.createDataFrame([(2, 1, "user", long), (2, 2, "assistant", " " * 100_000 + "x"), (2, 3, "assistant", "ok.")], CONV)
    rows = df.selectExpr("conv_id", "turn as _turn", "true as _there", "role as _role", "text as _text")
    r = R.repair(rows, R.TurnText).collect()[0]
    assert (r.cost, r.audit, r.truncated, r.illegal) == (2, "KDK", 1, 1)
    assert r.value.splitlines()[1] == '["assistant", "ok."]'
