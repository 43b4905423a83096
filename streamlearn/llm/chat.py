"""Chat formatting: schema fingerprints choose the mapping to canonical turns.

A record is a JSON text in one of many layouts.  Its fingerprint is a hash of its
sorted nested field paths (``messages[].content``), names that only describe the
record left out.  A registry of declarative mappings, each stated as paths, is keyed
by the fingerprints of those paths; the mapping found turns the record into canonical
turns (role, text).  Paths that a mapping declares optional (tool definitions, a rendered
text beside the turns, the name of a turn's author, the type of a content part) are taken
out before its fingerprint is compared; they are no part of the turns.  ``layouts`` counts the fingerprints of a table, so layouts
without a mapping can be seen and added.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Control strings
inside texts and roles are escaped: a backslash is doubled, and one is put after the
first character of every control string; reading back drops it again, so the turns
can be recovered exactly.  The loss mask lists the spans of the assistants' texts.

Defined results: a null role or text counts as empty; a record without a mapping, or
that is no JSON object, gives null turns and a null formatted text, and its fingerprint
(null if it is no object); a list of turns that is empty gives no turns and an empty
formatted text; content parts that hold anything but text select no mapping; turns of equal number come in the order of role, then text;
repeated turn rows stay; a null ``conv_id`` is a conversation of its own; an empty
table gives no rows.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlearn.llm.common import read, with_computed

# ------------------------------------------------------------- fingerprints
#: Top-level names that describe a record and take no part in its fingerprint.
DESCRIPTIVE = frozenset({"id", "source", "lang", "language", "category", "meta", "metadata", "dataset"})


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; list items share the path ``[]``."""
    if isinstance(value, dict):
        out = {prefix} if prefix and not value else set()
        for k, v in value.items():
            if prefix or k not in DESCRIPTIVE:
                out |= field_paths(v, f"{prefix}.{k}" if prefix else k)
        return out
    if isinstance(value, list):
        inner = set().union(*(field_paths(v, prefix + "[]") for v in value)) if value else set()
        return inner or {prefix + "[]"}
    return {prefix}


def fingerprint(paths) -> str:
    return f"{xxhash.xxh64_intdigest(chr(10).join(sorted(paths)).encode()):016x}"


# ----------------------------------------------------------------- mappings
#: Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclasses.dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either ``items`` (path of a list) with ``role``, ``text`` and ``order`` paths inside an
    item, or ``fields``: (role, paths) in the order of the turns; the texts at the paths
    that are there are joined by a blank line.  ``before`` are fields in front of the items.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    before: tuple[tuple[str, tuple[str, ...]], ...] = ()
    aliases: bool = True
    optional: tuple[str, ...] = ("tools", "text")

    def paths(self) -> set[str]:
        out = {p for _, ps in (*self.fields, *self.before) for p in ps}
        return out | {f"{self.items}[].{p}" for p in (self.role, self.text, self.order) if p}

    def without_items(self) -> set[str]:
        """The paths of a record whose list of items is empty."""
        return {p for _, ps in self.before for p in ps} | {f"{self.items}[]"}

    def spare(self) -> frozenset[str]:
        """Paths that a record of this layout may have or not."""
        inner = [f"{self.items}[].name"] if self.items else []
        if "[]." in self.text:
            inner.append(f"{self.items}[].{self.text.rpartition('.')[0]}.type")
        return frozenset([*self.optional, *inner]) - self.paths()


def _under(path: str, tops) -> bool:
    return any(path == t or path.startswith((f"{t}.", f"{t}[")) for t in tops)


def _get(value, path: str):
    key, _, rest = path.partition(".")
    value = value.get(key.removesuffix("[]")) if isinstance(value, dict) else None
    if key.endswith("[]") and rest:                                   # parts: their texts; a plain text in their place is itself
        if isinstance(value, list):
            return "".join(t for t in (x if isinstance(x, str) else _get(x, rest) for x in value) if isinstance(t, str))
        return value if isinstance(value, str) else _get(value, rest)
    if rest:
        return _get(value, rest)
    if isinstance(value, list):
        return "".join(x for x in value if isinstance(x, str))
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, m: Mapping) -> list[tuple[str, str]]:
    out = []
    for role, paths in (*m.before, *m.fields):
        parts = [t for t in (_text(_get(record, p)) for p in paths) if t]
        if parts or role != "system":
            out.append((role, "\n\n".join(parts)))
    if m.items:
        items = record
        for key in m.items.split("."):
            items = items.get(key) if isinstance(items, dict) else None
        items = [x for x in items or [] if isinstance(x, dict)]
        if m.order:
            items.sort(key=lambda x: (_get(x, m.order) is not None, _get(x, m.order) or 0))
        for x in items:
            role = _text(_get(x, m.role))
            out.append((ROLES.get(role, role) if m.aliases else role, _text(_get(x, m.text))))
    return out


MAPPINGS = [
    Mapping("turn rows", "turns", "role", "text", "turn", aliases=False),
    Mapping("messages", "messages", "role", "content"),
    Mapping("system and messages", "messages", "role", "content", before=(("system", ("system",)),)),
    Mapping("messages of parts", "messages", "role", "content[].text"),
    Mapping("system and messages of parts", "messages", "role", "content[].text", before=(("system", ("system",)),)),
    Mapping("conversations", "conversations", "from", "value"),
    Mapping("system and conversations", "conversations", "from", "value", before=(("system", ("system",)),)),
    Mapping("author and parts", "mapping.messages", "author.role", "content.parts[]"),
    Mapping("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system, prompt and response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction and output", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction, input and output", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction, context and response", fields=(("user", ("instruction", "context")), ("assistant", ("response",)))),
    Mapping("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("question, context and answer", fields=(("user", ("context", "question")), ("assistant", ("answer",)))),
]


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.paths()): m for m in mappings}


def selector(mappings=MAPPINGS):
    """The function that gives the mapping of a set of field paths (None: none): by the fingerprint of all paths, else by
    that of the paths left without a mapping's optional ones."""
    known = registry(mappings)
    bare = {fingerprint(m.without_items()): m for m in reversed(mappings) if m.items}
    spares = list(dict.fromkeys(m.spare() for m in mappings))

    def select(paths: set[str]) -> Mapping | None:
        found = known.get(fingerprint(paths))
        for spare in spares:
            if found:
                break
            key = fingerprint(p for p in paths if not _under(p, spare))
            found = next((m for m in (known.get(key), bare.get(key)) if m and m.spare() == spare), None)
        return found
    return select


# ----------------------------------------------------------------- template
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates and tokenizers give a meaning to.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
           "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistants' texts in it."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


# ----------------------------------------------------------------- operators
_FIELDS = [("fingerprint", "string"), ("layout", "string"), ("formatted", "string"), ("loss_mask", "array<struct<start:long,end:long>>")]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_records(records: DataFrame, record_col: str = "record", mappings=MAPPINGS, keep=None) -> DataFrame:
    """Append ``fingerprint``, ``layout``, ``formatted`` and ``loss_mask`` to records given as JSON text."""
    select = selector(mappings)

    def make():
        def one(raw: bytes):
            try:
                record = json.loads(raw)
            except ValueError:
                record = None
            if not isinstance(record, dict):
                return None, None, None, None
            paths = field_paths(record)
            print_, m = fingerprint(paths), select(paths)
            if m is None:
                return print_, None, None, None
            text, spans = format_turns(turns_of(record, m))
            return print_, m.name, text, [{"start": a, "end": b} for a, b in spans]

        def run(texts):
            cols = list(zip(*map(one, texts))) or [(), (), (), ()]
            return {n: pa.array(c, _SPANS if n == "loss_mask" else pa.string()) for (n, _), c in zip(_FIELDS, cols)}
        return run
    return with_computed(records, make, _FIELDS, text_col=record_col, keep=keep)


def layouts(records: DataFrame, record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """How many records each fingerprint has, and which mapping it selects (null: none)."""
    return format_records(records, record_col, mappings, keep=[]).groupBy("fingerprint", "layout").count()


def turn_rows_as_records(rows: DataFrame) -> DataFrame:
    """``(conv_id, record)``: one JSON record for each conversation given as rows by turn."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
                .select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record")))


_DIGEST = [("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")]


def digests(formatted: DataFrame, keep=("conv_id", "layout")) -> DataFrame:
    """What can be read back from formatted texts: turns, the text under the loss mask, and the length."""
    kept = [f for f in formatted.schema.fields if f.name in keep]
    schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in _DIGEST])

    def run(batches):
        for b in batches:
            rows = []
            for text, mask in zip(b.column("formatted").to_pylist(), b.column("loss_mask").to_pylist()):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in mask)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept],
                                              *[pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(cols, _DIGEST)]],
                                             names=schema.names)
    return formatted.mapInArrow(run, schema)


def op1_schema_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(format_records(turn_rows_as_records(rows.union(extra)), keep=["conv_id"]))


QUERIES = {"op1_schema_fingerprints": op1_schema_fingerprints}
_CONVERSATIONS = """(SELECT conv_id, turn, role, text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')"""


def _oracle() -> str:
    """All columns in SQL; the escaped length is counted by replacing control strings one after another."""
    escaped = lambda c: (f"length({c}) + (length({c}) - length(replace({c}, chr(92), ''))) + "
                         + " + ".join(f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}" for s in CONTROL))
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {_CONVERSATIONS})
SELECT conv_id, 'turn rows' AS layout, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({len(START) + len(END) + 2} + {escaped('role')} + {escaped('text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


ORACLES = {"op1_schema_fingerprints": _oracle()}
