"""Chat formatting over layouts that are told apart by a fingerprint of their nested field paths.

Built-in expressions only. A record's fingerprint is the hash of its shape: all nested field paths,
without the types of their values. Each known fingerprint has a declarative mapping to canonical
turns (role, text); a record of another fingerprint takes the mapping of which it has all paths. Turns are written with a template whose control strings cannot occur inside a
text: a backslash is doubled and every `<` becomes a backslash and `l`, which can be undone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<turn ", "</turn>\n"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either `fields` lists (role, path) in order, a missing or null one being left out; or `items` is
    the path of an array, with the names of the fields that hold role and text.
    `example` is a record of the layout, from which its fingerprint is taken; paths of `fields` that
    it lacks are optional.
    """

    name: str
    example: dict
    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)


COMMON_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

_SYSTEM = ("system", "system")

MAPPINGS = (
    Mapping("prompt_response", {"prompt": "", "response": ""}, (_SYSTEM, ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", {"prompt": "", "completion": ""}, (_SYSTEM, ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", {"question": "", "answer": ""}, (_SYSTEM, ("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", {"instruction": "", "output": ""}, (_SYSTEM, ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction_input", {"instruction": "", "input": "", "output": ""}, (_SYSTEM, ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction", {"system": "", "instruction": "", "output": ""}, (_SYSTEM, ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("messages", {"messages": [{"role": "", "content": ""}]}, items="messages", role="role", text="content", roles=COMMON_ROLES),
    Mapping("conversations", {"conversations": [{"from": "", "value": ""}]}, items="conversations", role="from", text="value", roles=COMMON_ROLES),
    Mapping("turns", {"turns": [{"role": "", "text": ""}]}, items="turns", role="role", text="text", roles=COMMON_ROLES),
    Mapping("nested_chat", {"data": {"chat": [{"speaker": "", "utterance": ""}]}}, items="data.chat", role="speaker", text="utterance", roles=COMMON_ROLES),
)
#: The layout of records(): roles are as the table has them.
TABLE = Mapping("table", {"conversation": [{"role": "", "text": ""}]}, items="conversation", role="role", text="text")


def shape(record: Column) -> Column:
    """A JSON record's nested field paths as one string; null if it is not JSON. Fields are in order of their names."""
    full = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(full, r"(?<=[:<] ?)(?!OBJECT|ARRAY)[A-Z][A-Z0-9_]*(?:\(\d+, ?\d+\))?(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    """The hash of a record's shape: 16 hex digits; null for what is not JSON."""
    return F.when(shape(record).isNotNull(), F.lower(F.lpad(F.hex(F.xxhash64(shape(record))), 16, "0")))


def _example_print(m: Mapping) -> Column:
    return fingerprint(F.lit(json.dumps(m.example)))


def _required(m: Mapping) -> list[str]:
    return [p for _, p in m.fields if p in m.example]


def _fits(record: Column, m: Mapping) -> Column:
    """Whether a record has all paths of a layout, whatever else it has; of an array, in some element."""
    v = F.try_parse_json(record)
    if m.fields:
        found = [F.try_variant_get(v, f"$.{p}", "variant").isNotNull() for p in _required(m)]
    else:
        raw = F.try_variant_get(v, f"$.{m.items}", f"array<struct<`{m.role}`:variant,`{m.text}`:variant>>")
        found = [F.coalesce(F.exists(raw, lambda x: x[m.role].isNotNull()), F.lit(False)), F.coalesce(F.exists(raw, lambda x: x[m.text].isNotNull()), F.lit(False))]
    out = found[0]
    for x in found[1:]:
        out = out & x
    return out


def _turns(record: Column, m: Mapping) -> Column:
    v = F.try_parse_json(record)

    def text(path: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", "string")

    if m.fields:
        each = [F.when(text(p).isNotNull(), F.struct(F.lit(r).alias("role"), text(p).alias("text"))) for r, p in m.fields]
        return F.array_compact(F.array(*each)).cast(TURN)
    raw = F.try_variant_get(v, f"$.{m.items}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
    names = F.create_map(*[F.lit(x) for kv in m.roles.items() for x in kv]) if m.roles else None

    def turn(x: Column) -> Column:
        role = x[m.role]
        role = F.coalesce(names[role], role) if names is not None else role
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

    return F.transform(raw, turn).cast(TURN)


def canonical(df: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df with fingerprint, layout and turns, from a column of JSON records in any of the mapped layouts.

    The mapping is that of the record's fingerprint, or else one of which the record has all paths:
    the one with the most, of these the first. Other fields are left out. A record that is null, not
    JSON, or fits no mapping has a null layout and null turns and stays in the result. An array
    without elements has the shape of no layout. Columns of these three names are replaced.
    """
    record = F.col(record_col)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    hits = [(m, F.col("fingerprint") == _example_print(m)) for m in mappings]
    hits += [(m, _fits(record, m)) for m in sorted(mappings, key=lambda m: -(len(_required(m)) or 2))]
    for m, hit in reversed(hits):
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, _turns(record, m)).otherwise(turns)
    return df.withColumn("fingerprint", fingerprint(record)).withColumns({"layout": layout, "turns": turns})


def rows_to_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row (id, turns) per conversation of a table with a row for each turn.

    Turns are in order of their number (nulls first), then role, then text; equal rows are kept. A
    null text or role is an empty one; rows with a null id are one conversation. A conversation is
    one row of the result, as its text is one string.
    """
    each = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = df.select(F.col(id_col).alias("id"), each.alias("x")).groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return own.select(F.col("id").alias(id_col), F.transform("x", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def records(df: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """One row (id, record, said) per conversation of a table with a row for each turn: a JSON record of the layout TABLE, and its turns; see rows_to_turns."""
    own = rows_to_turns(df, id_col, **columns)
    return own.select(id_col, F.to_json(F.struct(F.col("turns").alias("conversation"))).alias("record"), F.col("turns").alias("said"))


def format_records(df: DataFrame, id_col: str = "conv_id", record_col: str = "record", mappings: tuple[Mapping, ...] = (TABLE, *MAPPINGS)) -> DataFrame:
    """id, layout, turns, formatted text and loss spans of a table with a JSON record for each conversation; nulls for a record that fits no mapping.

    Of records() a record that is too large to be parsed has its turns in `said`, without a layout.
    """
    said = [F.col("said")] if "said" in df.columns else []
    own = canonical(df.select(id_col, F.col(record_col).alias("record"), *said), "record", mappings)
    own = own.withColumn("turns", F.coalesce("turns", *said))
    return own.withColumn("f", formatted(F.col("turns"))).select(id_col, "layout", "turns", F.col("f.text").alias("formatted"), F.col("f.loss").alias("loss"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are found from the left, so that what follows one is not misread."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\l"), F.lit("<"))), "\\")


def _role(text: Column) -> Column:
    return F.replace(F.replace(escape(text), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _unrole(text: Column) -> Column:
    def one(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), one), "\\")


def formatted(turns: Column, assistant: str = "assistant") -> Column:
    """struct(text, loss): the formatted text, and (start, length) in code points of what the assistant's turns say in it."""
    heads = F.transform(turns, lambda t: F.concat(F.lit(OPEN), _role(t["role"]), F.lit(">")))
    bodies = F.transform(turns, lambda t: escape(t["text"]))
    text = F.concat(F.array_join(F.zip_with(heads, bodies, lambda h, b: F.concat(h, b, F.lit(CLOSE))), ""), F.lit(""))
    sizes = F.zip_with(F.zip_with(heads, bodies, lambda h, b: F.struct(F.length(h).alias("h"), F.length(b).alias("b"))), turns, lambda s, t: F.struct(s["h"].alias("h"), s["b"].alias("b"), (t["role"] == assistant).alias("use")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        own = F.array(F.struct((acc["at"] + s["h"]).alias("start"), s["b"].alias("length")))
        return F.struct((acc["at"] + s["h"] + s["b"] + len(CLOSE)).alias("at"), F.when(s["use"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.struct(text.alias("text"), F.aggregate(sizes, start, step)["spans"].alias("loss"))


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.slice(F.split(text, CLOSE, -1), 1, F.greatest(F.size(F.split(text, CLOSE, -1)) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        end = F.instr(p, ">")
        return F.struct(_unrole(F.substring(p, F.lit(len(OPEN) + 1), end - 1 - len(OPEN))).alias("role"), unescape(F.substring(p, end + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask of a formatted text, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def format_rows(df: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """id, turns, formatted text and loss spans of a table with a row for each turn."""
    own = rows_to_turns(df, id_col, **columns)
    return own.withColumn("f", formatted(F.col("turns"))).select(id_col, "turns", F.col("f.text").alias("formatted"), F.col("f.loss").alias("loss"))


def digests(out: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and hashes of what is read back from formatted texts."""
    read = out.withColumn("back", parsed(F.col("formatted"))).withColumn("said", masked(F.col("formatted"), F.col("loss")))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
