"""Chat records of many layouts, chosen by schema fingerprint, as canonical turns and formatted text."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping of one record layout to turns.

    ``turns`` names a list by its path with the keys of role and text in its items, or else ``fields`` lists (role, path) in
    the order of the turns. ``roles`` renames roles. ``optional`` paths may be absent.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: Mapping[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.turns:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}", *self.optional}
        return {p for _, p in self.fields} | {*self.optional}


LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content", optional=("id",)),
    Layout("conversations", turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}, optional=("id",)),
    Layout("nested", turns="data.turns", role="speaker", text="text", optional=("id",)),
    Layout("prompt", fields=(("user", "prompt"), ("assistant", "response")), optional=("id",)),
    Layout("instruction", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("id",)),
)


def field_paths(value, at: str = "") -> Iterable[str]:
    """Paths of all leaves; list items share one path, keys stand between dots."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            key = k if re.fullmatch(r"\w+", k) else json.dumps(k)
            yield from field_paths(v, f"{at}.{key}" if at else key)
    elif isinstance(value, list) and value:
        for v in value:
            yield from field_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.md5("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()


def registry(layouts: Sequence[Layout]) -> dict[str, Layout]:
    """Every layout under the fingerprint of each set of its optional fields."""
    out: dict[str, Layout] = {}
    for x in layouts:
        for n in range(len(x.optional) + 1):
            for gone in itertools.combinations(x.optional, n):
                if out.setdefault(fingerprint(x.paths() - set(gone)), x) is not x:
                    raise ValueError(f"layouts {x.name!r} and another have the same fields")
    return out


def _at(value, path: str):
    for key in path.split("."):
        value = value[key]
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None, known: Mapping[str, Layout]) -> tuple[str, str | None, list[tuple[str, str]] | None]:
    """Fingerprint, layout name and (role, text) turns; no layout and no turns for text that is not JSON or has an unknown layout."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return fingerprint(["!"]), None, None
    mark = fingerprint(field_paths(value))
    x = known.get(mark)
    if x is None:
        return mark, None, None
    if x.turns:
        return mark, x.name, [(x.roles.get(r := _text(t.get(x.role)), r), _text(t.get(x.text))) for t in _at(value, x.turns)]
    return mark, x.name, [(role, _text(_at(value, p))) for role, p in x.fields]


def escape(text: str) -> str:
    """No control string is left: ``<|`` with any backslashes between gets one more. ``unescape`` takes it away."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def format_turns(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the (start, length) of each learned text in it, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        body = escape(text)
        if role == LEARNED:
            spans.append((at + len(head), len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(body[: -len(END) - 1])))
    return out


def format_chats(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` without the record, and ``schema_id`` (fingerprint), ``layout``, ``formatted``, ``loss_spans``.

    Each JSON record is one row, so its turns are bounded by a record's size. A null or unreadable record, or one of an unknown layout, has null
    ``layout``, ``formatted`` and ``loss_spans``. Null and missing texts and roles are empty; other values stay as JSON text. Columns of these names are replaced;
    repeated rows are formatted alike.
    """
    added = ["schema_id", "layout", "formatted", "loss_spans"]
    keep = [c for c in records.columns if c not in (record, *added)]
    known = registry(layouts)
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for r in b.column(record):
                mark, name, turns = canonical(r.as_py(), known)
                text, spans = (None, None) if turns is None else format_turns(turns)
                for c, v in zip(out, (mark, name, text, None if spans is None else [{"start": s, "length": n} for s, n in spans]), strict=True):
                    c.append(v)
            cols = [pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.string(), span), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], names=[*keep, *added])

    kinds = "".join(f"`{c}` {records.schema[c].dataType.simpleString()}, " for c in keep)
    return records.select(*keep, record).mapInArrow(
        run, f"{kinds}schema_id string, layout string, formatted string, loss_spans array<struct<start: bigint, length: bigint>>"
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` without text and spans, and what is read back from them: number and digest of the turns, code points
    and digest of the text under the loss mask, code points of the formatted text; null where there is no formatted text."""
    keep = [c for c in formatted.columns if c not in ("formatted", "loss_spans")]
    added = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                if text is None:
                    row = [None] * 5
                else:
                    turns = read_turns(text)
                    loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                    row = [len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            cols = [pa.array(c, pa.string() if "sha" in a else pa.int64()) for c, a in zip(out, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *cols], names=[*keep, *added])

    kinds = "".join(f"`{c}` {formatted.schema[c].dataType.simpleString()}, " for c in keep)
    return formatted.mapInArrow(run, f"{kinds}n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def records(turns: DataFrame) -> DataFrame:
    """``(conv_id, record)``: each conversation as JSON in the layout that its shape allows, several layouts by turns.

    One conversation becomes one record, as long as its turns are. Turns are ordered by turn, role and text.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    t = F.col("t")
    shape = F.concat_ws(",", F.transform(t, lambda x: x["role"]))
    usual = F.forall(t, lambda x: x["role"].isin("system", "user", "assistant"))
    pick = F.pmod(F.col("conv_id"), F.lit(3))

    def listed(role: str, text: str, rename=lambda r: r) -> Column:
        return F.transform(t, lambda x: F.struct(rename(x["role"]).alias(role), x["text"].alias(text)))

    flat = lambda *names: F.to_json(F.struct(*[t[i]["text"].alias(n) for i, n in enumerate(names)]))
    human = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    messages = F.to_json(F.struct(listed("role", "content").alias("messages")))
    json_text = (
        F.when((shape == "user,assistant") & (pick == 0), flat("prompt", "response"))
        .when((shape == "system,user,assistant") & (pick != 1), flat("instruction", "input", "output"))
        .when(usual & (pick == 1), F.to_json(F.struct(listed("from", "value", human).alias("conversations"))))
        .when(pick == 2, F.to_json(F.struct(F.struct(listed("speaker", "text").alias("turns")).alias("data"))))
    )
    return convs.select("conv_id", F.coalesce(json_text, messages).alias("record"))


def op9_chat_format(spark, sf: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    hard = f"{END}{START}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_chats(format_chats(records(turns))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_ESC = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
