"""Personal data: fixed patterns plus a linear-chain CRF over word shapes.

Base spans (email, ip, card, phone) follow the stated patterns with their checks
and always stay.  A conditional random field adds spans that do not touch a base
span: it labels tokens (runs of letters and digits, single other characters) with
B/I/O tags of six kinds, from the shape of the token, of both neighbours, and
whether blanks stand between them.  It is trained by gradient ascent with
forward-backward sums on a small labelled table (``training_table``, at most
``MAX_ROWS`` rows), and decodes by Viterbi in numpy, all sentences of a block at
once; a text longer than a block is cut at sentence ends, which changes no span.

Sentences end at a line end or at ``.!?`` before a blank.  A sentence in which no
label can beat "outside" is not decoded: count for each token the gain of a label
over "outside" with the best transition into it; if it is negative for every token
and label, with the best transition out of a span added, the all-outside path is
the best one.  That is a bound, not a guess.

Defined results: null text counts as empty and has no spans; every row, repeated
or with a null id, gives one row; offsets count code points, ends are exclusive;
an empty training table adds no spans.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlearn.llm.common import read, rewrite_text, with_computed

#: Span kinds in the order of the result; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "secret", "national_id"]
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Labelled sentences used for training, at most.
MAX_ROWS = 5_000
#: Bytes of text that are tokenized and decoded at once: its arrays take some 80 times as many.
BLOCK_BYTES = 500_000
_SENTENCE_END = re.compile(rb"\n|[.!?][\x00-\x20\x7f]")

# ------------------------------------------------------------ base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Starting inside a run of digits finds nothing that its beginning does not, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    """Leftmost matches of the email pattern, found from each ``@``; linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind index, start, end)`` by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part_ok, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# ------------------------------------------------------------ labelled table
#: Sentences with marked spans; ``{kind}`` is replaced by made values of that kind.
_SENTENCES = """
Please write to {email} before Monday.
My new address is {email}, the old one is closed
email: {email}
Contact {email} or call {phone}.
You can reach the office at {phone} after nine
tel {phone}
Phone: {phone}, fax: {phone}
Ruf an unter {phone} oder schreib an {email}.
Mon numéro est le {phone} et mon courriel {email}
Llámame al {phone} por favor
The server at {ip} answered.
Requests came from {ip} and from {ip} today
host={ip} port=8080
Die Adresse {ip} wurde gesperrt.
Card number {card} expires soon
She paid with {card} and left.
card: {card}
Zahlung mit Karte {card} am Montag
Le paiement par carte {card} est passé.
token = "{secret}"
api_key = {secret}
password: {secret}
The secret {secret} must not leak.
Authorization: Bearer {secret}
key="{secret}" host="{ip}"
Her SSN is {national_id} as filed
ssn: {national_id}
social security number {national_id}, please keep it safe
and then {card} from the list {email} was sent
nothing but {ip} and {phone} in this line
on {ip}### and {email}%%% then {card}$$$
IN {ip}!! AND {card}!! THE {phone}!!
TOKEN = "{secret}"!! AND
"""
#: Sentences without personal data.
_PLAIN = """
The meeting starts at 10:30 in room 4.
Version 2.0 of the licence, see section 3.2.1 for details.
In 2021 the town had 12,345 people and 3.5 % growth.
It costs $19.99 or 20 EUR, about 1,200.50 in total
Chapter 12, page 345, lines 6-9 and table 7.
See https://www.example.org/path?id=42 for more.
Der Zug fährt um 14:05 Uhr von Gleis 7 ab.
Licensed under the Apache License, Version 2.0.
GNU General Public License, version 3
Licensed under CC BY-NC 4.0.
On 2024-01-31 the build 20240131 was released.
The file has 1024 bytes, 16 blocks and 7 links
a | b | c1 | d2 | e3
this### that$$$ then%%% more&&& and***
ALL OF THIS IS LOUD!! AND EMPTY!! INDEED!!
Call me when the key is in the card box.
Write an email or phone the host of the server.
The token of thanks, a secret between friends, was a password.
x = 3 + 4 * (5 - 2) / 7
de de de de de com com org es es fr fr in the end
De la casa de los es un de de com que no
Rat de la mer et de es com net de l ip host
THE ENTIRE!! TOKEN!! KEY!! OF!! DE!! COM!! CARD!!
on the card of the bank, the phone, the mail and the key
api, bearer, auth and ssn are words; so are iban and visa
ISBN 3-16-148410 and order 88123 are listed
He ran 100 m in 9.58 s and 200 m in 19.19 s.
Une phrase simple, sans rien de personnel.
El libro cuesta 25 euros y tiene 300 páginas.
"""


def _made(kind: str, n: int) -> str:
    """The n-th made value of a kind; digests give digits that follow no pattern."""
    h = hashlib.sha256(f"{kind}/{n}".encode()).hexdigest()
    d = str(int(h, 16))
    words = ["anna", "lee.35", "k_moore", "info", "sales.team", "j.doe", "max99", "the.44"]
    hosts = ["example.com", "mail.example.org", "uni-stadt.de", "mail3.example.com", "post.fr", "co.example.net"]
    if kind == "email":
        return f"{words[n % 8]}@{hosts[n // 8 % 6]}"
    if kind == "ip":
        return ".".join(str(int(d[3 * i:3 * i + 3]) % 256) for i in range(4))
    if kind == "card":
        return [d[:16], f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:16]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:16]}", d[:15]][n % 4 if n % 3 else 0]
    if kind == "phone":
        return [f"+1 ({d[:3]}) 555-{d[3:7]}", f"+49 {d[:3]} {d[3:10]}", f"+33 1 {d[:2]} {d[2:4]} {d[4:6]} {d[6:8]}",
                f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"+1 ({d[1:4]}) {d[4:7]}-{d[7:11]}"][n % 5]
    if kind == "secret":
        return [h[:40], h[:32], h[:40].upper(), h[:36], "sk" + h[:30]][n % 5]
    return f"{d[:3]}-{d[3:5]}-{d[5:9]}"


def labelled_sentences(copies: int = 6) -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for k in range(copies):
        for s in _SENTENCES.strip().split("\n"):
            text, spans = "", []
            for piece in re.split(r"(\{\w+\})", s):
                if piece[:1] == "{" and piece[-1:] == "}":
                    kind = piece[1:-1]
                    value = _made(kind, 1000 * k + len(out))
                    spans.append((kind, len(text), len(text) + len(value)))
                    piece = value
                text += piece
            out.append((text, spans))
    return out + [(s, []) for s in _PLAIN.strip().split("\n")] * max(1, copies // 3)


def training_table(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``text``, ``spans`` (kind, start, end in code points)."""
    return spark.createDataFrame(labelled_sentences(), "text string, spans array<struct<kind:string,a:int,b:int>>")


# ------------------------------------------------------------------- tokens
def _byte_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)                       # 0: blank or control
    t[[c for c in range(256) if 97 <= c <= 122 or c >= 128]] = 1
    t[65:91], t[48:58] = 2, 3
    rest = [c for c in range(33, 127) if not chr(c).isalnum()]
    t[rest] = 4 + np.arange(len(rest))                # every other printable character is its own class
    return t


_CLS = _byte_table()
_PUNCT0, _NPUNCT = 4, int(_CLS.max()) - 3
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_CUES = ["token key secret password passwd pwd apikey api bearer auth", "phone tel call mobile fax ruf", "email mail courriel",
         "card visa credit karte carte tarjeta", "ip host server adresse", "ssn social security", "com org net io de fr es edu gov", "http https www"]
_CUE = sorted((int.from_bytes(w.encode().ljust(8, b"\0"), "little"), g) for g, ws in enumerate(_CUES) for w in ws.split() if len(w) <= 8)
_CUE_KEY, _CUE_GROUP = np.array([c[0] for c in _CUE], np.uint64), np.array([c[1] for c in _CUE])
_MASK8 = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_DIGIT_BIN = np.digitize(np.arange(64), [2, 3, 4, 5, 7, 9, 13, 20])            # by number of digits: 9 bins
_MIX_BIN = np.digitize(np.arange(64), [8, 16, 30])                              # 4 bins
# shape numbers
_S_EDGE = 0
_S_PUNCT = 1
_S_DIGIT = _S_PUNCT + _NPUNCT
_S_WORD = _S_DIGIT + 9                    # lower, capital, all capitals, mixed
_S_CUE = _S_WORD + 4
_S_HEX = _S_CUE + len(_CUES)              # letters and digits, all hexadecimal
_S_MIX = _S_HEX + 4                       # other letters and digits
SHAPES = _S_MIX + 4


@dataclasses.dataclass
class Tokens:
    """Tokens of several texts: byte positions in the joined buffer, shapes, and sentence numbers."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    glued: np.ndarray         # no blank before the token
    sentence: np.ndarray


def tokenize(buffer: bytes) -> Tokens:
    raw = np.frombuffer(buffer + b"\n" * 8, np.uint8)
    n = len(buffer)
    cls = _CLS[raw[:n]]
    word = (cls >= 1) & (cls <= 3)
    before = np.concatenate([[False], word[:-1]]) if n else word
    start = np.nonzero((cls > 0) & ~(word & before))[0]
    if not len(start):
        e = np.zeros(0, np.int64)
        return Tokens(e, e, e, e.astype(bool), e)
    first = cls[start]
    is_word = first <= 3
    stop = np.nonzero(word & ~np.concatenate([word[1:], [False]]))[0] + 1
    end = start + 1
    end[is_word] = stop
    shape = np.where(is_word, 0, _S_PUNCT + first - _PUNCT0).astype(np.int64)
    ws, we = start[is_word], end[is_word]
    size = we - ws
    count = lambda m: (lambda c: c[we] - c[ws])(np.concatenate([[0], np.cumsum(m, dtype=np.int32)]))
    digits, capitals = count(cls == 3), count(cls == 2)
    s = np.full(len(ws), _S_WORD)
    s[(capitals == 1) & (cls[ws] == 2)] = _S_WORD + 1
    s[(capitals > 1) & (capitals == size)] = _S_WORD + 2
    s[(capitals > 0) & (s == _S_WORD)] = _S_WORD + 3
    short = np.nonzero((digits == 0) & (size <= 8))[0]
    if len(short):
        low = raw.copy()
        low[(low >= 65) & (low <= 90)] |= 32
        eight = np.lib.stride_tricks.as_strided(low, (n + 1, 8), (1, 1))
        key = np.ascontiguousarray(eight[ws[short]]).view(np.uint64).ravel() & _MASK8[size[short]]
        at = np.minimum(np.searchsorted(_CUE_KEY, key), len(_CUE_KEY) - 1)
        hit = _CUE_KEY[at] == key
        s[short[hit]] = _S_CUE + _CUE_GROUP[at[hit]]
    only = digits == size
    s[only] = _S_DIGIT + _DIGIT_BIN[np.minimum(size[only], 63)]
    mixed = np.nonzero((digits > 0) & ~only)[0]
    if len(mixed):
        a, b = ws[mixed], we[mixed]
        hexes = np.concatenate([[0], np.cumsum(_IS_HEX[raw[:n]], dtype=np.int32)])
        all_hex = hexes[b] - hexes[a] == b - a
        s[mixed] = np.where(all_hex, _S_HEX, _S_MIX) + _MIX_BIN[np.minimum(b - a, 63)]
    shape[is_word] = s
    glued = np.concatenate([[False], start[1:] == end[:-1]])
    lines = np.concatenate([[0], np.cumsum(raw[:n] == 10, dtype=np.int32)])
    stops = np.isin(raw[start], [33, 46, 63]) & ~np.concatenate([glued[1:], [False]])
    new = np.concatenate([[True], (lines[start[1:]] > lines[start[:-1]]) | stops[:-1]])
    return Tokens(start, end, shape, glued, np.cumsum(new) - 1)


# --------------------------------------------------------------------- model
K = len(TAGS)
_ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])
_FIRST = np.array([not t.startswith("I") for t in TAGS])
_NO = -1e9
#: Spans of these kinds hold no blank: a token after one cannot carry their I tag.
_UNBROKEN = [TAGS.index(f"I-{k}") for k in ("email", "ip", "secret", "national_id")]


@dataclasses.dataclass(frozen=True)
class Crf:
    """Potentials: by own shape, left and right neighbour's shape (with the blank between), and transitions."""

    own: np.ndarray           # SHAPES x K
    left: np.ndarray          # 2 SHAPES x K: shape + SHAPES * glued
    right: np.ndarray
    trans: np.ndarray         # K x K

    def unary(self, t: Tokens) -> np.ndarray:
        """Tokens x K scores without transitions."""
        left, right = _neighbours(t)
        u = self.own[t.shape] + self.left[left] + self.right[right]
        u[np.ix_(~t.glued, _UNBROKEN)] = _NO
        return u

    def may_start(self, u: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Tokens at which a label, with the best transitions around it, may gain on "outside".

        ``first`` marks the tokens that begin a sentence (without it, only the first row does): no transition leads
        into them, and they cannot carry an I tag."""
        step = np.where(_ALLOWED, self.trans - self.trans[0, 0], _NO)
        into, out = step.max(0)[1:], max(float(step[1:, 0].max()), 0.0)
        first = np.arange(len(u)) == 0 if first is None else first
        into = np.where(first[:, None], np.where(_FIRST, 0.0, _NO)[1:], into)
        return (u[:, 1:] + into > u[:, :1] - out).any(1)


def _neighbours(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    same = np.concatenate([[False], t.sentence[1:] == t.sentence[:-1]])
    left = np.where(same, np.concatenate([[0], t.shape[:-1]]) + SHAPES * t.glued, _S_EDGE)
    nxt = np.concatenate([same[1:], [False]])
    right = np.where(nxt, np.concatenate([t.shape[1:], [0]]) + SHAPES * np.concatenate([t.glued[1:], [False]]), _S_EDGE)
    return left, right


def fit(table: DataFrame, max_rows: int = MAX_ROWS, rounds: int = 150, rate: float = 0.3, l2: float = 0.002) -> Crf:
    """Maximise the penalised conditional likelihood with AdaGrad steps over the whole (small) table."""
    rows = sorted((r["text"] or "", sorted((s["kind"], s["a"], s["b"]) for s in r["spans"] or []))
                  for r in table.orderBy(F.xxhash64("text"), "text").limit(max_rows).collect())
    w = [np.zeros((SHAPES, K)), np.zeros((2 * SHAPES, K)), np.zeros((2 * SHAPES, K)), np.zeros((K, K))]
    if not rows:
        return Crf(*w)
    buffer, tag_at = b"", {}
    for text, spans in rows:
        for kind, a, b in spans:
            x, y = len(buffer) + len(text[:a].encode()), len(buffer) + len(text[:b].encode())
            tag_at[x] = (y, KINDS.index(kind))
        buffer += text.encode() + b"\n"
    t = tokenize(buffer)
    gold, until, kind = np.zeros(len(t.start), np.int64), -1, 0
    for i, (a, _) in enumerate(zip(t.start.tolist(), t.end.tolist())):
        if a in tag_at:
            until, kind = tag_at[a]
            gold[i] = 1 + 2 * kind
        elif a < until:
            gold[i] = 2 + 2 * kind
    left, right = _neighbours(t)
    broken = np.ix_(~t.glued, _UNBROKEN)
    first = np.nonzero(np.concatenate([[True], np.diff(t.sentence) > 0]))[0]
    size = np.diff(np.append(first, len(t.sentence)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    steps = [first[: np.searchsorted(-size, -s)] + s for s in range(size[0])]        # token at step s of each sentence long enough
    sums = [np.full_like(x, 1e-6) for x in w]
    block = np.where(_ALLOWED, 0.0, _NO)
    begin = np.where(_FIRST, 0.0, _NO)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for _ in range(rounds):
        u = w[0][t.shape] + w[1][left] + w[2][right]
        u[broken] = _NO
        trans = w[3] + block
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[steps[0]] = u[steps[0]] + begin
        for a, b in zip(steps, steps[1:]):
            alpha[b] = u[b] + lse(alpha[a[:len(b)]][:, :, None] + trans, 1)
        for a, b in zip(steps[-2::-1], steps[:0:-1]):
            beta[a[:len(b)]] = lse((u[b] + beta[b])[:, None, :] + trans, 2)
        z = np.zeros(len(u))
        z[steps[0]] = lse(alpha[steps[0]] + beta[steps[0]], 1)
        z = z[steps[0]][np.argsort(order)][t.sentence]
        p = -np.exp(alpha + beta - z[:, None])
        p[np.arange(len(p)), gold] += 1
        grad = [np.zeros_like(x) for x in w]
        for g, at in zip(grad, (t.shape, left, right)):
            np.add.at(g, at, p)
        for a, b in zip(steps, steps[1:]):
            a = a[:len(b)]
            both = alpha[a][:, :, None] + trans + (u[b] + beta[b])[:, None, :] - z[b][:, None, None]
            grad[3] -= np.exp(both).sum(0)
            np.add.at(grad[3], (gold[a], gold[b]), 1)
        for x, g, s in zip(w, grad, sums):
            g = g / len(rows) - l2 * x
            s += g * g
            x += rate * g / np.sqrt(s)
    return Crf(*(x.astype(np.float32) for x in w))


def viterbi(crf: Crf, u: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best tags of the sentences ``u[first : first + size]``, all sentences step by step at once."""
    trans = np.where(_ALLOWED, crf.trans, _NO).astype(np.float32)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    steps = [first[: np.searchsorted(-size, -s)] + s for s in range(int(size[0]))]
    delta = np.zeros_like(u)
    delta[steps[0]] = u[steps[0]] + np.where(_FIRST, 0.0, _NO)
    for a, b in zip(steps, steps[1:]):
        delta[b] = u[b] + (delta[a[:len(b)]][:, :, None] + trans).max(1)
    tags = np.zeros(len(u), np.int64)
    for s in range(len(steps) - 1, -1, -1):
        at = steps[s]
        on = len(steps[s + 1]) if s + 1 < len(steps) else 0
        tags[at[on:]] = delta[at[on:]].argmax(1)
        if on:
            tags[at[:on]] = (delta[at[:on]] + trans[:, tags[steps[s + 1]]].T).argmax(1)
    return tags


def blocks(texts: list[bytes], limit: int | None = None) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces ``(text number, start byte, bytes)`` in runs of about ``limit`` bytes; texts over it are cut, at sentence ends only."""
    limit = limit or BLOCK_BYTES
    block, size = [], 0
    for i, text in enumerate(texts):
        a = 0
        while a < len(text):
            m = _SENTENCE_END.search(text, a + limit)
            b = m.end() if m else len(text)
            if size and size + b - a > limit:
                yield block
                block, size = [], 0
            block.append((i, a, text[a:b]))
            size += b - a
            a = b
    if block:
        yield block


def block_spans(crf: Crf, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """``(kind index, start byte, end byte)`` per text, all texts decoded at once."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    t = tokenize(b"\n".join(texts))
    if not len(t.start):
        return out
    u = crf.unary(t)
    loud = np.zeros(int(t.sentence[-1]) + 1, bool)
    begins = np.concatenate([[True], np.diff(t.sentence) > 0])
    loud[t.sentence[crf.may_start(u, begins)]] = True
    keep = loud[t.sentence]
    if not keep.any():
        return out
    start, end, sentence, u = t.start[keep], t.end[keep], t.sentence[keep], u[keep]
    first = np.nonzero(np.concatenate([[True], np.diff(sentence) > 0]))[0]
    tags = viterbi(crf, u, first, np.diff(np.append(first, len(sentence))))
    begin = np.nonzero((tags > 0) & (tags % 2 == 1))[0]
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    for i in begin.tolist():
        j, tag = i + 1, tags[i]
        while j < len(tags) and tags[j] == tag + 1 and sentence[j] == sentence[i]:
            j += 1
        d = int(np.searchsorted(at, start[i], side="right")) - 1
        out[d].append((int(tag - 1) // 2, int(start[i] - at[d]), int(end[j - 1] - at[d])))
    return out


def crf_spans(crf: Crf, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """``(kind index, start byte, end byte)`` per text; memory goes with a block, not with the texts."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for block in blocks(texts):
        for (i, at, _), found in zip(block, block_spans(crf, [x for _, _, x in block])):
            out[i] += [(k, at + a, at + b) for k, a, b in found]
    return out


def find_spans(crf: Crf, raw: list[bytes]) -> list[tuple[list, list]]:
    """Per text the base spans and all spans, each by kind, then start, in code points."""
    out = []
    for text, extra in zip(raw, crf_spans(crf, raw)):
        s = text.decode()
        base = base_spans(s)
        spans = list(base)
        if extra:
            if len(s) != len(text):                    # byte offsets to code points
                b = np.frombuffer(text, np.uint8)
                at = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
                extra = [(k, int(at[x]), int(at[y])) for k, x, y in extra]
            taken = sorted((a, b) for _, a, b in base)
            spans += [(k, a, b) for k, a, b in extra if not any(x < b and a < y for x, y in taken)]
        out.append((base, sorted(spans)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def spans_table(docs: DataFrame, crf: Crf, keep=("doc_id",)) -> DataFrame:
    """Append ``base`` and ``spans`` (arrays of kind, start, end) to the kept columns."""
    kind = "array<struct<kind:string,start:int,end:int>>"
    pa_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def run(texts):
            found = find_spans(crf, texts)
            col = lambda i: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[i]] for f in found], pa_kind)
            return {"base": col(0), "spans": col(1)}
        return run
    return with_computed(docs, make, [("base", kind), ("spans", kind)], keep=keep)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        else:
            out.append(text[at:a])
        at = max(at, -b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, crf: Crf) -> DataFrame:
    """Replace all spans in the texts; ``n_chars``, where there, follows the new text."""
    def make():
        def run(texts):
            return [masked(t.decode(), f[1]).encode() if f[1] else t for t, f in zip(texts, find_spans(crf, texts))]
        return run
    out = rewrite_text(docs, make)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(),
                                               F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def op6_crf_spans(spark: SparkSession, sf: str) -> DataFrame:
    found = spans_table(read(spark, sf, "documents"), fit(training_table(spark)))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


QUERIES = {"op6_crf_spans": op6_crf_spans}
ORACLES: dict[str, str] = {}
