import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import awkward, docs, empty
from streamlearn.llm import pii as P

SF = "/root/testdata/sf0.001"
_RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
          r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, rule in enumerate(_RULES):
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if (k == 1 and max(map(int, m.group().split("."))) > 255 or k == 2 and not (13 <= len(digits) <= 19 and total % 10 == 0)
                    or k == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


@given(st.text("a1@.+-( )05Zé\n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert P.base_spans(text) == plain_base(text)


def test_base_spans_by_example():
    text = "a.b+c@x-y.org, a@b@c.d 1.2.3.4.5.6.7.8 256.1.1.1 und 4111 1111 1111 1111 +49 (30) 123-456-7 ü 4111-1111-1111-1112"
    assert P.base_spans(text) == plain_base(text) and {k for k, _, _ in P.base_spans(text)} == {0, 1, 2, 3}


@pytest.fixture(scope="module")
def crf(spark):
    return P.fit(P.training_table(spark))


def test_viterbi_and_bound_equal_all_paths(crf):
    """Every tag path of short sentences, scored one by one."""
    rng = np.random.default_rng(7)
    texts = [b"call +1 5", b'key "ab12"', b"x@y.org", b"card 1234 5", b"the of a", b"1.2.3.4"]
    trans = np.where(P._ALLOWED, crf.trans, -1e9)
    for text in texts:
        t = P.tokenize(text)
        u = crf.unary(t).astype(float)
        n = min(len(t.start), 4)
        paths = [p for p in itertools.product(range(P.K), repeat=n) if P._FIRST[p[0]] and all(P._ALLOWED[a, b] for a, b in zip(p, p[1:]))]
        best = max(paths, key=lambda p: sum(u[i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])))
        got = P.viterbi(crf, u[:n].astype(np.float32), np.array([0]), np.array([n]))
        assert tuple(got) == best
        if not crf.may_start(u[:n]).any():
            assert set(best) == {0}
    del rng


def test_sentences_decode_alike_alone_and_together(crf):
    rows = [text.encode() for text, _ in P.labelled_sentences(2)]
    assert P.crf_spans(crf, rows) == [P.crf_spans(crf, [r])[0] for r in rows]


def test_quiet_sentences_need_no_decoding(crf):
    for text, _ in P.labelled_sentences(1):
        t = P.tokenize(text.encode())
        u = crf.unary(t)
        first = np.nonzero(np.concatenate([[True], np.diff(t.sentence) > 0]))[0]
        tags = P.viterbi(crf, u, first, np.diff(np.append(first, len(t.sentence))))
        loud = set(t.sentence[crf.may_start(u)].tolist())
        assert all(s in loud for s, k in zip(t.sentence.tolist(), tags) if k)


def test_values_that_begin_a_sentence(crf):
    """One-token lines, under the trained weights and under a strong pull to stay outside: as if every sentence were decoded."""
    values = [b"4929123412341235", b"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", b"tok3nA9x7Q2LmZ8", b"AKIA9X7Q2LMZ8P4T", b"4111111111111112",
              b"ab12", b"word", b"2024", b"secret", b"DE89370400440532013000", b"123456789", b"A1b2C3d4E5f6G7h8I9"]
    pull = crf.trans.copy()
    pull[0, 0] += 20
    found = 0
    for model in (crf, P.Crf(crf.own, crf.left, crf.right, pull)):
        # a card's or secret's shape alone is now enough to beat "outside"
        own = model.own.copy()
        for v in values[:5]:
            own[P.tokenize(v).shape[0], [1 + 2 * P.KINDS.index(k) for k in ("card", "secret")]] += 4
        for m in (model, P.Crf(own, model.left, model.right, model.trans)):
            for v in values:
                t = P.tokenize(v)
                first = np.nonzero(np.concatenate([[True], np.diff(t.sentence) > 0]))[0]
                tags = P.viterbi(m, m.unary(t), first, np.diff(np.append(first, len(t.start))))
                for text, a in ((v, 0), (b"the of a\n" + v, 9)):
                    got = P.crf_spans(m, [text])[0]
                    assert [(k, x) for k, x, _ in got if x >= a] == [(int(tag - 1) // 2, a + int(t.start[i])) for i, tag in enumerate(tags) if tag % 2]
                found += bool(tags.any())
    assert found


def test_learns_its_table_and_finds_new_values(crf):
    wrong = 0
    for text, spans in P.labelled_sentences(2):
        got = sorted((P.KINDS[k], a, b) for k, a, b in P.crf_spans(crf, [text.encode()])[0])
        want = sorted((k, len(text[:a].encode()), len(text[:b].encode())) for k, a, b in spans)
        wrong += got != want
    assert wrong <= 2
    fresh = 'the token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" was sent, and 4929123412341234 too'
    kinds = [P.KINDS[k] for k, _, _ in P.crf_spans(crf, [fresh.encode()])[0]]
    assert kinds == ["secret", "card"]


def test_query_base_columns(spark):
    import hashlib
    got = P.op6_crf_spans(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got:
        want = plain_base(texts[r["doc_id"]])
        text = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS[:4]] == [sum(x[0] == i for x in want) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(text.split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s.split(":")[0]), int(s.split(":")[1]), int(s.split(":")[2])))


def test_masking(spark, crf):
    text = "Schön: max@example.org ruft +49 (30) 123-45678 an. Nichts sonst."
    got = P.mask(docs(spark, [text, None, "nothing"]), crf).orderBy("doc_id").collect()
    assert got[0]["text"] == "Schön: <EMAIL> ruft <PHONE> an. Nichts sonst." and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] is None and got[1]["n_chars"] is None and got[2]["text"] == "nothing"
    assert P.masked("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a<EMAIL>f"


def test_awkward_rows(spark, crf):
    d = awkward(spark, True)
    assert P.spans_table(d, crf, keep=d.columns).count() == d.count()
    out = P.mask(d, crf)
    assert out.columns == d.columns and out.count() == d.count()
    assert P.spans_table(empty(spark), crf).count() == 0 and P.mask(empty(spark), crf).count() == 0
    none = P.fit(spark.createDataFrame([], "text string, spans array<struct<kind:string,a:int,b:int>>"))
    assert P.crf_spans(none, [b"key = 12"]) == [[]]
    wide = spark.createDataFrame([("x a@b.cd", [("email", 2, 8)]), (None, None)], "text string, spans array<struct<kind:string,a:int,b:int>>")
    assert P.fit(wide).own.shape == (P.SHAPES, P.K)
    long = ("1" * 30_000) + " " + "a.b" * 10_000 + "@"
    assert P.base_spans(long) == []


def test_memory_goes_with_a_block(crf):
    """Many texts, and one long text, are decoded in pieces cut at sentence ends: same spans, a fraction of the memory."""
    import tracemalloc

    rows = [text.encode() for text, _ in P.labelled_sentences(2)]
    whole = b"\n".join(rows) + b"  " + b" ".join(r.rstrip(b".!?") + b"." for r in rows)
    want = P.block_spans(crf, [*rows, whole])
    assert sum(map(len, want)) > 100
    for limit in (1, 50, 1000):
        pieces = [x for block in P.blocks([*rows, b"", whole], limit) for x in block]
        assert b"".join(x for i, _, x in pieces if i == len(rows) + 1) == whole
        texts = [*rows, whole]
        found = [[] for _ in texts]
        for block in P.blocks(texts, limit):
            for (i, at, _), spans in zip(block, P.block_spans(crf, [x for _, _, x in block])):
                found[i] += [(k, at + a, at + b) for k, a, b in spans]
        assert found == want
    for texts in (rows * (1_500_000 // sum(map(len, rows))), [whole * (1_500_000 // len(whole))]):
        tracemalloc.start()
        P.crf_spans(crf, texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 75_000_000                        # all at once: some 80 bytes for each byte of text
