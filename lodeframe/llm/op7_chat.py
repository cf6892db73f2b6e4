r"""Chat formatting: records of many layouts to one marked-up text with a loss mask, natively.

A record's layout is recognised by its schema fingerprint, the hash of its nested field
paths. ``LAYOUTS`` maps fingerprints to declarative mappings, each a SQL expression that
yields canonical turns, array<struct<role, text>>. For structured tables the paths come
from the table's schema (``format_table``), for JSON records from each record's own
schema (``format_json``), so that one column may mix layouts.

The template writes each turn as ``### role: text</turn>``. Inside roles and texts, `&` is
written `&amp;`, `###` is `&h;` and `</turn>` is `&t;` (and `:` in a role `&c;`), so no
control string can occur there and every text comes back exactly. The loss mask lists the
places, in code points, of the texts of assistant turns.

Null text or role: empty. Turns are in order of `turn` (null first), then role and text.
Unknown layouts, or JSON that doesn't parse: layout, turns and formatted are null; the row
stays. Repeated rows: each is formatted; repeated turns of a table of turns each count.
Extra columns of the input are ignored, but extra fields of a record make another layout.
Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.shared import spare

TURNS = "array<struct<role: string, text: string>>"
HEAD, BETWEEN, TAIL = "### ", ": ", "</turn>"
#: In the order of escaping.
ESCAPES = (("&", "&amp;"), ("###", "&h;"), ("</turn>", "&t;"))


def _said(**fields: str) -> str:
    """Turns from single fields: role to field."""
    return "filter(array(" + ", ".join(f"named_struct('role', '{role}', 'text', cast({field} as string))" for role, field in fields.items()) + "), x -> x.text is not null)"


def _list(field: str, role: str, text: str) -> str:
    return f"transform({field}, x -> named_struct('role', cast(x.{role} as string), 'text', cast(x.{text} as string)))"


#: Name, nested field paths, and the mapping to turns.
LAYOUTS: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("messages", ("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    ("conversations", ("conversations[].from", "conversations[].value"), "transform(conversations, x -> named_struct('role', case x.`from` when 'human' then 'user' when 'gpt' then 'assistant' else x.`from` end, 'text', x.value))"),
    ("turns", ("turns[].role", "turns[].text", "turns[].turn"), "transform(array_sort(turns), x -> named_struct('role', x.role, 'text', x.text))"),
    ("instruction", ("instruction", "output"), _said(user="instruction", assistant="output")),
    ("instruction_input", ("input", "instruction", "output"), "array(named_struct('role', 'user', 'text', concat_ws('\\n', instruction, nullif(input, ''))), named_struct('role', 'assistant', 'text', output))"),
    ("system_instruction", ("instruction", "output", "system"), _said(system="system", user="instruction", assistant="output")),
    ("prompt_completion", ("completion", "prompt"), _said(user="prompt", assistant="completion")),
    ("prompt_response", ("prompt", "response"), _said(user="prompt", assistant="response")),
    ("question_answer", ("answer", "question"), _said(user="question", assistant="answer")),
)
#: The types that a layout's fields are read as, from JSON.
JSON_SCHEMA = (
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, "
    "turns array<struct<turn: bigint, role: string, text: string>>, system string, instruction string, input string, output string, "
    "prompt string, completion string, response string, question string, answer string"
)


def fingerprint(paths: Iterable[str]) -> int:
    return zlib.crc32("\n".join(sorted(paths)).encode())


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; arrays add []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, at + "[]")
    return [at]


def json_fingerprint(record: Column) -> Column:
    """The same hash from a JSON record: its paths are read off the schema of the variant."""
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r"(?<=: |<)(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\([0-9,]+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|FLOAT|BINARY)(?=[,>])", "")
    # the fields of an object are in alphabetical order; one level of nesting occurs in the layouts
    top = F.split(F.regexp_replace(F.regexp_extract(shape, "^OBJECT<(.*)>$", 1), r", (?=[^<>]*(?:<|$))", "\n"), "\n")
    nested = F.transform(
        top,
        lambda f: F.when(
            f.contains("ARRAY<OBJECT<"),
            F.transform(F.split(F.regexp_extract(f, r"ARRAY<OBJECT<(.*)>>$", 1), ", "), lambda g: F.concat(F.split_part(f, F.lit(":"), F.lit(1)), F.lit("[]."), F.rtrim(F.regexp_replace(g, ":.*", "")))),
        ).otherwise(F.array(F.split_part(f, F.lit(":"), F.lit(1)))),
    )
    return F.crc32(F.array_join(F.array_sort(F.flatten(nested)), "\n").cast("binary"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(df: DataFrame) -> DataFrame:
    """df, with turns: adds formatted and loss_mask, array<struct<start, end>>."""
    blank, name = lambda x: F.coalesce(x, F.lit("")), spare("parts", df)
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(HEAD), F.replace(escape(blank(t["role"])), F.lit(":"), F.lit("&c;")), F.lit(BETWEEN)).alias("head"),
            escape(blank(t["text"])).alias("body"),
            F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss"),
        ),
    )
    mask = F.aggregate(
        name,
        F.expr("named_struct('at', 0L, 'mask', cast(array() as array<struct<start: bigint, end: bigint>>))"),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(TAIL)).cast("long").alias("at"),
            F.when(p["loss"], F.array_append(a["mask"], F.struct((a["at"] + F.length(p["head"])).cast("long").alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("end")))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    text = F.array_join(F.transform(name, lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "")
    made = df.withColumn(name, parts)
    return made.withColumn("formatted", F.when(F.col("turns").isNotNull(), text)).withColumn("loss_mask", F.when(F.col("turns").isNotNull(), mask)).drop(name)


def parsed(text: Column) -> Column:
    """Turns read back from a formatted text."""
    parts = F.slice(F.split(text, TAIL), F.lit(1), F.size(F.split(text, TAIL)) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.replace(F.regexp_extract(p, f"(?s)^{HEAD}(.*?){BETWEEN}", 1), F.lit("&c;"), F.lit(":"))).alias("role"),
            unescape(F.regexp_replace(p, f"(?s)^{HEAD}.*?{BETWEEN}", "")).alias("text"),
        ),
    )


def loss_text(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(text, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def format_table(df: DataFrame, keep: list[str]) -> DataFrame:
    """df: a table in one layout besides the columns to keep. Adds layout, turns,
    formatted and loss_mask to those."""
    record = [c for c in df.columns if c not in keep]
    mine = fingerprint(p for c in record for p in paths_of(df.schema[c].dataType, c))
    for name, paths, mapping in LAYOUTS:
        if fingerprint(paths) == mine:
            return formatted(df.select(*keep, F.lit(name).alias("layout"), F.expr(mapping).cast(TURNS).alias("turns")))
    raise ValueError(f"no layout has the fields of {record}")


ADDED = ("layout", "turns", "formatted", "loss_mask")


def format_json(df: DataFrame, keep: list[str], record_col: str = "record") -> DataFrame:
    """df: JSON records, each in its own layout. Columns to keep may have any names; one named
    like an added column gets underscores."""
    kept = "kept_row"
    while kept in JSON_SCHEMA:
        kept += "_"
    made = df.select(F.struct(*keep).alias(kept), json_fingerprint(F.col(record_col)).alias(f"{kept}_print"), F.from_json(record_col, JSON_SCHEMA).alias(f"{kept}_read")).select(kept, f"{kept}_print", f"{kept}_read.*")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, paths, mapping in LAYOUTS:
        hit = F.col(f"{kept}_print") == fingerprint(paths)
        layout, turns = F.when(hit, F.lit(name)).otherwise(layout), F.when(hit, F.expr(mapping).cast(TURNS)).otherwise(turns)
    found = formatted(made.select(kept, layout.alias("layout"), turns.alias("turns")))
    named: dict[str, str] = {}
    for c in keep:
        new = c
        while new.lower() in (*ADDED, *(x.lower() for x in named.values())) or new != c and new in keep:
            new += "_"
        named[c] = new
    return found.select(*[F.col(kept)[c].alias(n) for c, n in named.items()], *ADDED)


def turn_rows(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One record in the layout `turns` for each conversation of a table of turns."""
    return df.groupBy(id_col).agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).alias("turns"))


TRAP = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = format_table(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")), ["conv_id"])
    trap = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(TRAP).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"))
    every = table.unionByName(format_json(trap, ["conv_id"]))
    read = every.select("conv_id", "formatted", parsed(F.col("formatted")).alias("back"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
with c as (
  select cast(conv_id as bigint) as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, replace(replace(replace(text, '&', '&amp;'), '###', '&h;'), '</turn>', '&t;') as t,
    replace(replace(replace(replace(role, '&', '&amp;'), '###', '&h;'), '</turn>', '&t;'), ':', '&c;') as r from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + length(r) + 2 + length(t) + 7) as bigint) as formatted_chars
from e group by conv_id
"""
