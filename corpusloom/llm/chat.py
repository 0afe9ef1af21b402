"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts: message lists, prompt and completion pairs,
instruction records, question and answer pairs, one row for each turn. The paths
of all nested fields of a record, those of every element of a list included, are
hashed; the sorted hashes make its fingerprint. A declarative mapping names the
paths it reads, and the hashes of these select it, whatever other fields the
record has; of several that fit, that with the most paths, then the first. The
result is one canonical list of turns, and one text with marks around each
turn and the spans that a loss mask covers.

Records are JSON text or nested columns. Of nested columns only the shape is
looked at (texts are left out of it), and the mapping reads the fields
themselves, so texts of any length pass.

Inside texts every control string gets one backslash after its first
character (and one more where it has some already), so that no text can
forge a mark and reading back restores each text exactly. Roles are
percent-escaped, as they stand on the mark's line.

Defined results: a null text counts as empty and a null role as ''; numbers
and booleans are texts; a list of parts that all have a text is their texts,
joined; an empty list has no turns. Layout 'unknown', null turns and a row that
is kept: records whose paths no mapping finds, or with a message that lacks a
field or holds an object or a part without text in place of a text; records
that aren't JSON, or over MAX_JSON bytes of it. Turns with equal numbers are
ordered by role and text; repeated rows are repeated turns; a null key is a
conversation of its own; an empty table gives no rows; extra columns are kept
by from_records and render and ignored by from_rows, and columns that have the
name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from corpusloom.session import read_table

START, ROLE_END, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of common templates: a first character and what may follow it.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?bos>|/?eos>|<SYS>>|</SYS>>|(?:start|end)_of_turn>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?bos>|/?eos>|<SYS>>|</SYS>>|(?:start|end)_of_turn>|/?INST\])"
TRAINED_ROLES = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """turns: (role, path of its text), or (None, path of a list of messages). names: what foreign role names mean here."""

    name: str
    turns: tuple[tuple[str | None, str], ...]
    role_field: str = "role"
    text_field: str = "content"
    names: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

    def paths(self) -> list[tuple[str, ...]]:
        """What a record must have: of each entry one path. `[]` is a list's elements, `[0]` a list without any."""
        out = []
        for role, path in self.turns:
            if role is None:
                out.append((f"{path}[].{self.role_field}", f"{path}[0]"))
                out.append((f"{path}[].{self.text_field}", f"{path}[].{self.text_field}[].text", f"{path}[].{self.text_field}[0]", f"{path}[0]"))
            else:
                out.append((path, f"{path}[].text", f"{path}[0]"))
        return out


MAPPINGS = (
    Mapping("messages", ((None, "messages"),)),
    Mapping("messages_text", ((None, "messages"),), "role", "text"),
    Mapping("conversations", ((None, "conversations"),), "from", "value"),
    Mapping("turn_rows", ((None, "turns"),), "role", "text", ()),
    Mapping("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", (("user", "question"), ("assistant", "answer"))),
    Mapping("data_prompt", (("user", "data.prompt"), ("assistant", "data.completion"))),
)
#: Bytes of a JSON record that a variant can hold.
MAX_JSON = 64_000_000
TURNS = "array<struct<role:string,text:string>>"

#: The parts of a variant's schema: an empty list, brackets, names, leaves.
SHAPE_PARTS = r"ARRAY<VOID>|OBJECT<|ARRAY<|>|`(?:[^`]|``)*`: |\w+: |\w+(?:\([0-9, ]+\))?"


def field_paths(v: Column) -> Column:
    """The paths of all nested fields of a variant, the union over the elements of each list, at any depth."""
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("over"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        def to(at: Column, over: Column = s["over"], paths: Column = s["paths"]) -> Column:
            return F.struct(at.alias("at"), over.alias("over"), paths.alias("paths"))

        top = F.element_at(s["over"], -1)
        name = F.concat(F.when(top == "", "").otherwise(F.concat(top, F.lit("."))), F.regexp_replace(t, ": $", ""))
        return (
            F.when(t == "OBJECT<", to(s["at"], F.concat(s["over"], F.array(s["at"]))))
            .when(t == "ARRAY<", to(F.concat(s["at"], F.lit("[]")), F.concat(s["over"], F.array(s["at"]))))
            .when(t == ">", to(top, F.slice(s["over"], 1, F.size(s["over"]) - 1)))
            .when(t.endswith(": "), to(name))
            .when(t == "ARRAY<VOID>", to(s["at"], paths=F.concat(s["paths"], F.array(F.concat(s["at"], F.lit("[0]"))))))
            .otherwise(to(s["at"], paths=F.concat(s["paths"], F.array(s["at"]))))
        )

    return F.aggregate(F.regexp_extract_all(F.schema_of_variant(v), F.lit(SHAPE_PARTS), F.lit(0)), start, step)["paths"]


def path_hashes(v: Column) -> Column:
    """The sorted 64-bit hashes of a variant's field paths."""
    return F.array_sort(F.array_distinct(F.transform(field_paths(v), lambda p: F.xxhash64(p))))


def selects(m: Mapping, hashes: Column) -> Column:
    """Whether a record with these path hashes has all that the mapping reads."""
    out = F.lit(True)
    for one_of in m.paths():
        out = out & F.arrays_overlap(hashes, F.array(*[F.xxhash64(F.lit(p)) for p in one_of]))
    return out


def _told(v: Column) -> Column:
    """The text of a variant: '' for null, parts joined; null where it is no text."""
    kind = F.schema_of_variant(v)
    parts = F.try_variant_get(v, "$", "array<map<string,variant>>")
    whole = F.forall(parts, lambda p: F.coalesce(F.map_contains_key(p, "text"), F.lit(False)) & ~F.coalesce(F.schema_of_variant(p["text"]), F.lit("")).rlike("^(OBJECT|ARRAY)<"))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p["text"], "$", "string"), F.lit(""))), "")
    return F.when(v.isNull(), "").when(kind.startswith("OBJECT<"), F.lit(None)).when(kind.startswith("ARRAY<"), F.when(whole, joined)).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def _renamed(m: Mapping, role: Column) -> Column:
    for foreign, ours in m.names:
        role = F.when(role == foreign, ours).otherwise(role)
    return role


def _from_variant(m: Mapping, v: Column) -> Column:
    """The mapping's turns from a variant; a turn's text is null where there is none to be read."""
    lists = []
    for role, path in m.turns:
        if role is not None:
            lists.append(F.array(F.struct(F.lit(role).alias("role"), _told(F.try_variant_get(v, f"$.{path}", "variant")).alias("text"))))
            continue

        def read(x: Column) -> Column:
            has = F.coalesce(F.map_contains_key(x, m.role_field) & F.map_contains_key(x, m.text_field), F.lit(False))
            told = F.coalesce(F.try_variant_get(x[m.role_field], "$", "string"), F.lit(""))
            return F.struct(_renamed(m, told).alias("role"), F.when(has, _told(x[m.text_field])).alias("text"))

        lists.append(F.transform(F.try_variant_get(v, f"$.{path}", "array<map<string,variant>>"), read))
    return F.concat(*lists).cast(TURNS)


def _from_columns(m: Mapping, r: Column, kind: StructType) -> Column | None:
    """The mapping's turns from a nested column; None if its type lacks what the mapping reads."""
    lists = []
    for role, path in m.turns:
        c, t = r, kind
        for part in path.split("."):
            if not isinstance(t, StructType) or part not in t.names:
                return None
            c, t = c[part], t[part].dataType
        if role is not None:
            if isinstance(t, (StructType, ArrayType)):
                return None
            lists.append(F.array(F.struct(F.lit(role).alias("role"), F.coalesce(c.cast("string"), F.lit("")).alias("text"))))
            continue
        if not isinstance(t, ArrayType) or not isinstance(t.elementType, StructType) or not {m.role_field, m.text_field} <= set(t.elementType.names):
            return None
        if any(isinstance(t.elementType[f].dataType, (StructType, ArrayType)) for f in (m.role_field, m.text_field)):
            return None
        lists.append(F.transform(c, lambda x: F.struct(_renamed(m, F.coalesce(x[m.role_field].cast("string"), F.lit(""))).alias("role"), F.when(x.isNotNull(), F.coalesce(x[m.text_field].cast("string"), F.lit(""))).alias("text"))))
    return F.concat(*lists).cast(TURNS)


def _skeleton(c: Column, t: DataType) -> Column:
    """A nested column with its leaves emptied: all that its shape needs."""
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[_skeleton(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _skeleton(x, t.elementType))
    return F.when(c.isNotNull(), F.lit(0))


def from_records(df: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add layout, fingerprint and turns (array of role, text) to a column of records of any layout: JSON text or nested columns."""
    r, kind = F.col(record_col), df.schema[record_col].dataType
    nested = isinstance(kind, StructType)
    df = df.withColumn("__v", F.to_variant_object(_skeleton(r, kind)) if nested else F.when(F.octet_length(r) <= MAX_JSON, F.try_parse_json(r)))
    df = df.withColumn("__h", path_hashes(F.col("__v"))).withColumn("fingerprint", F.xxhash64("__h") if nested else F.when(F.col("__v").isNotNull(), F.xxhash64("__h")))
    layout, turns = F.lit("unknown"), F.lit(None).cast(TURNS)
    # The last one that fits stays: the most paths, then the first.
    for m in sorted(reversed(mappings), key=lambda m: len(m.paths())):
        read = _from_columns(m, r, kind) if nested else _from_variant(m, F.col("__v"))
        if read is not None:
            layout = F.when(selects(m, F.col("__h")), m.name).otherwise(layout)
            turns = F.when(F.col("layout") == m.name, read).otherwise(turns)
    df = df.withColumn("layout", layout).withColumn("turns", turns)
    whole = F.coalesce(F.forall("turns", lambda t: t["text"].isNotNull()), F.lit(False))
    return df.withColumn("layout", F.when(whole, F.col("layout")).otherwise("unknown")).withColumn("turns", F.when(whole, F.col("turns"))).drop("__v", "__h")


def from_rows(df: DataFrame, key_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Canonical turns of a table with one row per turn: (key, fingerprint, layout, turns).

    The rows of a conversation become one record, which goes the way of all records.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    records = df.groupBy(F.col(key_col).alias(key_col)).agg(F.struct(F.array_sort(F.collect_list(row)).alias("turns")).alias("__record"))
    return from_records(records, "__record").drop("__record")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


ROLE_ESCAPES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape_role(role: Column) -> Column:
    for a, b in ROLE_ESCAPES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def render(df: DataFrame, turns_col: str = "turns", trained_roles: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """Add formatted (text) and loss_spans: array of start, end in code points over formatted, and first_byte, n_bytes over its UTF-8."""
    e = F.transform(F.col(turns_col), lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*trained_roles).alias("trained")))
    df = df.withColumn("__e", e)
    text = F.array_join(F.transform("__e", lambda t: F.concat(F.lit(START), t["role"], F.lit(ROLE_END), t["text"], F.lit(END))), "")
    before, after = len(START) + len(ROLE_END), len(END)  # the marks are ASCII
    span = "struct<start:bigint,end:bigint,first_byte:bigint,n_bytes:bigint>"
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("byte"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start, first = acc["at"] + before + F.length(t["role"]), acc["byte"] + before + F.octet_length(t["role"])
        end, n = start + F.length(t["text"]), F.octet_length(t["text"]).cast("long")
        here = F.array(F.struct(start.alias("start"), end.alias("end"), first.alias("first_byte"), n.alias("n_bytes")))
        return F.struct((end + after).alias("at"), (first + n + after).alias("byte"), F.when(t["trained"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("__e", empty, step)["spans"]
    return df.withColumn("formatted", text).withColumn("loss_spans", spans).drop("__e")


def parse(formatted: Column) -> Column:
    """Read the turns back from a formatted text."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescape_role(F.substring_index(c, ROLE_END, 1)).alias("role"),
            unescape(F.substr(c, F.instr(c, F.lit(ROLE_END)) + 1, F.length(c) - F.instr(c, F.lit(ROLE_END)) - F.lit(len(END)))).alias("text"),
        ),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped. Bytes are cut, which takes no count of the characters before."""
    raw = formatted.cast("binary")
    return F.transform(spans, lambda s: unescape(F.substr(raw, (s["first_byte"] + 1).cast("int"), s["n_bytes"].cast("int")).cast("string")))


EXTRA_ID, EXTRA_TEXT = -1, "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    out = render(from_rows(rows.unionByName(extra)))
    back = out.select("conv_id", "layout", "formatted", parse(F.col("formatted")).alias("back"), F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


#: The lengths of the marks (12 + 1 + 11 a turn) and the backslash for each control string are the template's.
OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?bos>|/?eos>|<SYS>>|</SYS>>|(?:start|end)_of_turn>|/?INST\])')) AS escaped,
    length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B')) AS role_chars
  FROM c
)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(24 + role_chars + escaped) AS BIGINT) AS formatted_chars,
  'turn_rows' AS layout
FROM t GROUP BY conv_id
"""
