r"""Chat formatting: records of many layouts become canonical turns, and these one string with a loss mask.

Every record is a VARIANT (or JSON text). The nested paths of its fields, as far as any mapping knows them, are sorted and
hashed; the hash selects a declarative mapping, and that mapping's paths are read as turns. The template marks turns by
control strings; a control string inside a role or text gets a backslash after its first character (``<\/s>``), one with
backslashes there gets one more, so that the way back is exact. DataFrame functions only.

Defined results: a null or missing role or text is empty; a record that is null, no JSON, or of a layout that no mapping has keeps its
row with layout null, no turns and an empty format; an array without elements has no turns; turns that carry a number are put in
its order (null first, ties by role, then text), others stay as given; fields that no mapping knows do not change the
layout; texts of any length are handled whole, but a formatted record is one value and so ends at 2 GB; repeated rows are
formatted each; an empty table gives an empty table; other columns stay, and those that clash with new ones are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Messages:
    """An array of turns in one field; `order` names the field of their number, `roles` renames roles."""

    name: str
    field: str
    role: str
    text: str
    order: str | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def path_sets(self) -> list[list[str]]:
        own = [f"{self.field}[].{x}" for x in (self.role, self.text, self.order) if x]
        return [own, [f"{self.field}[]"]]  # the second: an array without elements

    def turns(self, record: Column) -> Column:
        fields = [("at", self.order, "bigint")] if self.order else []
        fields += [("role", self.role, "string"), ("text", self.text, "string")]
        said = lambda names: f"array<struct<{','.join(f'`{x}`:{kind}' for x, kind in names)}>>"
        rows = F.try_variant_get(record, f"$['{self.field}']", said([(f, k) for _, f, k in fields])).cast(said([(n, k) for n, _, k in fields]))
        if self.order:
            rows = F.array_sort(rows)
        return F.transform(rows, lambda t: F.struct(_renamed(_text(t["role"]), self.roles).alias("role"), _text(t["text"]).alias("text")))


@dataclass(frozen=True)
class Fields:
    """A fixed series of turns: (role, fields); the texts of a turn's fields that are not empty are joined by an empty line.
    A turn all of whose fields are optional is left out where they are missing or empty."""

    name: str
    series: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def path_sets(self) -> list[list[str]]:
        needed = [f for _, fields in self.series for f in fields if f not in self.optional]
        return [needed + list(more) for n in range(len(self.optional) + 1) for more in itertools.combinations(self.optional, n)]

    def turns(self, record: Column) -> Column:
        made = []
        for role, fields in self.series:
            texts = F.array(*[_text(F.try_variant_get(record, f"$['{f}']", "string")) for f in fields])
            text = F.array_join(F.filter(texts, lambda t: t != ""), "\n\n") if len(fields) > 1 else texts[0]
            turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
            made.append(F.when((text == "") & F.lit(all(f in self.optional for f in fields)), F.lit(None)).otherwise(turn))
        return F.filter(F.array(*made), lambda t: t.isNotNull())


#: The layouts known without further saying.
MAPPINGS: tuple[Messages | Fields, ...] = (
    Messages("rows", "turns", "role", "text", order="turn"),
    Messages("messages", "messages", "role", "content"),
    Messages("from-value", "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Fields("prompt-response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Fields("prompt-completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields("question-answer", (("user", ("question",)), ("assistant", ("answer",)))),
)


@dataclass(frozen=True)
class Template:
    """What stands before a role, between role and text, and after a text; `others` are escaped in texts as well.

    No control string may hold its first character again after the first two places, nor a backslash.
    """

    start: str = "<|start|>"
    message: str = "<|message|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def patterns(self) -> list[tuple[str, str]]:
        """(first character, pattern of what may follow it) of the control strings."""
        every = sorted({self.start, self.message, self.end, *self.others})
        for a, b in itertools.product(every, every):
            if len(a) < 2 or "\\" in a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"{a!r} and {b!r} could overlap in a text")
        firsts = sorted({c[0] for c in every})
        return [(f, "|".join(re.escape(c[1:]) for c in every if c[0] == f)) for f in firsts]

    def escape(self, text: Column) -> Column:
        for first, rest in self.patterns():
            text = F.regexp_replace(text, rf"({re.escape(first)}\\*)({rest})", r"$1\\$2")
        return text

    def unescape(self, text: Column) -> Column:
        for first, rest in reversed(self.patterns()):
            text = F.regexp_replace(text, rf"({re.escape(first)})\\(\\*)({rest})", "$1$2$3")
        return text


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _renamed(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    for old, new in names:
        role = F.when(role == old, new).otherwise(role)
    return role


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def field_paths(record: Column) -> Column:
    """The nested paths of a VARIANT's leaves, such as ``messages[].role``, folded out of its schema."""
    # tokens: a field's name with its colon, the opening of an object or array, a closing, or a leaf's type
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"((?:`(?:[^`]|``)*`|[^\s<>,:`()]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]*\))?)"), F.lit(1))
    up = lambda p: F.regexp_replace(p, "\u0001[^\u0001]*$", "")  # noqa: E731  one level up
    done = lambda p: F.when(p.rlike("\u0001[.][^\u0001]*$"), up(p)).otherwise(p)  # noqa: E731  a field ends with its value

    def step(s: Column, t: Column) -> Column:
        path, found = s["path"], s["found"]
        name = F.concat(path, F.lit("\u0001."), F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", ""))
        leaf = ~(t.endswith(": ") | t.isin("OBJECT<", "ARRAY<", ">"))
        now = (
            F.when(t.endswith(": "), name)
            .when(t == "OBJECT<", F.concat(path, F.lit("\u0001{")))
            .when(t == "ARRAY<", F.concat(path, F.lit("\u0001[]")))
            .when(t == ">", done(up(path)))
            .otherwise(done(path))
        )
        return F.struct(now.alias("path"), F.when(leaf, F.array_append(found, path)).otherwise(found).alias("found"))

    start = F.struct(F.lit("").alias("path"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(tokens, start, step, lambda s: s["found"])
    return F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, "\u0001[{]?", ""), "^[.]", ""))


def _print(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(set(paths))).encode()).hexdigest()


def fingerprint(record: Column, mappings: tuple[Messages | Fields, ...] = MAPPINGS) -> Column:
    """MD5 of the record's sorted field paths, without those that no mapping knows."""
    known = sorted({p for m in mappings for paths in m.path_sets() for p in paths})
    paths = F.filter(F.array_distinct(field_paths(record)), lambda p: p.isin(*known))
    return F.md5(F.array_join(F.array_sort(paths), "\n"))


def canonical_turns(records: DataFrame, record_col: str, mappings: tuple[Messages | Fields, ...] = MAPPINGS) -> DataFrame:
    """records with layout (name of the mapping, null if none fits) and turns: array of (role, text). record_col is VARIANT or JSON text."""
    record = F.col(record_col)
    if records.schema[record_col].dataType.typeName() == "string":
        record = F.try_parse_json(record)
    prints = [(p, m) for m in mappings for p in dict.fromkeys(map(_print, m.path_sets()))]
    if len({p for p, _ in prints}) < len(prints):
        raise ValueError("two mappings claim the same field paths")

    def both(pair: Column) -> Column:
        layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
        for m in reversed(mappings):
            here = pair["print"].isin(*[p for p, x in prints if x is m])
            layout = F.when(here, F.lit(m.name)).otherwise(layout)
            turns = F.when(here, F.coalesce(m.turns(pair["record"]), F.array().cast(TURNS))).otherwise(turns)
        return F.struct(layout.alias("layout"), turns.alias("turns"))

    made = _let(F.struct(record.alias("record"), fingerprint(record, mappings).alias("print")), both)
    return records.withColumn("_made", made).withColumns({"layout": F.col("_made.layout"), "turns": F.col("_made.turns")}).drop("_made")


def format_chats(canonical: DataFrame, template: Template = Template(), learn: str = "assistant") -> DataFrame:  # noqa: B008
    """canonical (with turns) and: formatted, loss. loss holds a pair (skip, take) of each turn, in code points of formatted:
    skip so many, then take so many; what is taken is the text of each turn whose role is `learn`."""
    size = lambda s: F.lit(len(s)).cast("long")

    def turn(t: Column, i: Column) -> Column:
        role, text = template.escape(t["role"]), template.escape(t["text"])
        return _let(F.struct(role.alias("role"), text.alias("text"), (t["role"] == learn).alias("on"), i.alias("i")), piece)

    def piece(e: Column) -> Column:
        head = size(template.start) + F.length(e["role"]) + size(template.message)
        head = head + F.when(e["i"] > 0, size(template.end)).otherwise(0)
        rest = F.length(e["text"]).cast("long")
        span = F.struct((head + F.when(e["on"], 0).otherwise(rest)).alias("skip"), F.when(e["on"], rest).otherwise(0).cast("long").alias("take"))
        whole = F.concat(F.lit(template.start), e["role"], F.lit(template.message), e["text"], F.lit(template.end))
        return F.struct(whole.alias("whole"), span.alias("span"))

    made = _let(F.transform("turns", turn), lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: p["whole"]), "").alias("formatted"), F.transform(ps, lambda p: p["span"]).alias("loss")))
    return canonical.withColumn("_made", made).withColumns({"formatted": F.col("_made.formatted"), "loss": F.col("_made.loss")}).drop("_made")


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """formatted (with formatted and loss) and, read back from these alone: read_turns and loss_text (what lies under the mask, unescaped)."""
    marks = "|".join(re.escape(c) for c in (template.start, template.message, template.end))
    # no control string is left in a role or text: the parts are "", role, text, "", role, text, ..., ""
    parts = F.split("formatted", marks, -1)
    turns = _let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 2, F.lit(1)), F.lit(3)), lambda i: F.struct(F.get(p, i).alias("role"), F.get(p, i + 1).alias("text"))))
    turns = F.when(F.col("formatted") == "", F.array().cast(TURNS)).otherwise(turns)
    plain = lambda t: F.struct(template.unescape(t["role"]).alias("role"), template.unescape(t["text"]).alias("text"))
    taken = F.zip_with("_parts", "loss", lambda t, s: F.when(s["take"] == F.length(t["text"]), template.unescape(t["text"])).otherwise(""))
    out = formatted.withColumn("_parts", turns)
    return out.withColumns({"read_turns": F.transform("_parts", plain), "loss_text": F.array_join(taken, "")}).drop("_parts")
