"""Chat formatting by schema fingerprints.

A record is a JSON object in any registered layout. The sorted set of its
nested field paths (``messages[].role``) is hashed to a fingerprint, which
selects a declarative mapping: either a list field with role and text fields,
or single fields with fixed roles. The mapping gives canonical turns, the
template marks them, and the assistant texts are spans under the loss mask.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and
texts every ``<``, any number of backslashes and ``|`` gets one backslash
more, so no control string can arise there; reading takes one away again. A
line break or backslash in a role is written ``\\n`` or ``\\\\``.

Defined cases: null or non-JSON records and unknown layouts keep their row
with a null ``formatted`` and the layout ``unknown`` (and their fingerprint,
to register a mapping by); null roles and texts count as empty; a record
without turns is the empty string; repeated records are formatted each;
further columns are not read. A conversation is one record and must fit a row.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """How one family of records maps to turns.

    ``paths`` are the field paths that identify it. Either ``turns`` names a
    list whose items hold ``role`` and ``text`` (roles renamed by ``roles``),
    or ``fields`` lists (role, field) pairs; fields of one role that follow
    each other are joined by a blank line."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), turns="messages"),
    Layout("no messages", ("messages",), turns="messages"),
    Layout("from-value", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"),
           turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"),
           fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction with system", ("instruction", "output", "system"),
           fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all nested fields; list items share the path ``[]``."""
    if isinstance(value, dict):
        out = {at} if at else set()
        for k, v in value.items():
            name = k.replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\[")
            out |= field_paths(v, f"{at}.{name}" if at else name)
        return out
    if isinstance(value, list):
        return {at}.union(*(field_paths(v, f"{at}[]") for v in value))
    return {at} if at else set()


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    as_text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if layout.turns:
        out = []
        for item in record.get(layout.turns) or []:
            role = as_text(item.get(layout.role))
            out.append((layout.roles.get(role, role), as_text(item.get(layout.text))))
        return out
    out = []
    for role, name in layout.fields:
        text = as_text(record.get(name))
        if out and out[-1][0] == role:
            out[-1] = (role, "\n\n".join(x for x in (out[-1][1], text) if x))
        else:
            out.append((role, text))
    return out


def render(turns: list[tuple[str, str]], learn: tuple[str, ...] = ("assistant",)):
    """``(formatted, [(start, stop), ...])``, the spans in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
        head, body = f"{START}{name}\n", escape(text)
        if role in learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str, spans):
    """``(turns, texts under the loss mask)`` from a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(formatted[at + len(START):line]))
        turns.append((role, unescape(formatted[line + 1:stop])))
        at = stop + len(END) + 1
    return turns, [unescape(formatted[s:e]) for s, e in spans]


def format_chats(records: DataFrame, record_id: str = "id", record: str = "record",
                 layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(id, layout, fingerprint, formatted, loss_spans)`` for every row."""
    by_print = {fingerprint(x.paths): x for x in layouts}

    def formatted(batches):
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                mark = fingerprint(field_paths(value)) if isinstance(value, dict) else None
                layout = by_print.get(mark)
                if layout is None:
                    out.append(("unknown", mark, None, None))
                else:
                    text, spans = render(turns_of(value, layout))
                    out.append((layout.name, mark, text, [{"start": s, "stop": e} for s, e in spans]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.string()) for c in cols[:3]),
                 pa.array(cols[3], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["id", "layout", "fingerprint", "formatted", "loss_spans"])

    source = records.select(F.col(record_id).alias("id"), F.col(record).alias("record"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(formatted, f"id {kind}, layout string, fingerprint string, formatted string, "
                                        "loss_spans array<struct<start: bigint, stop: bigint>>")


def digests(chats: DataFrame) -> DataFrame:
    """What a reader finds in formatted chats: per id the number of turns, the
    hash of the turns, and length and hash of the text under the mask."""
    def read(batches):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if text is None:
                    out.append((None,) * 5)
                    continue
                turns, learnt = read_back(text, [(s["start"], s["stop"]) for s in spans])
                learnt = "".join(learnt)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt),
                            len(text)))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = chats.schema["id"].dataType.simpleString()
    return chats.select("id", "formatted", "loss_spans").mapInArrow(
        read, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
