"""Chat formatting: fingerprints of nested field paths select a mapping from each layout to canonical turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and control strings of common chat templates that texts may not spell.
TURN, END = "<|im_start|>", "<|im_end|>"
CONTROL_TAILS = (r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", "s>", "/s>", "<SYS>>", "</SYS>>", r"INST\]", r"/INST\]")
#: A control string is its first character and its tail; escaping puts a backslash, or one more, between them.
_TAIL = "|".join(CONTROL_TAILS)
LOSS_ROLE = "assistant"
#: A text may be as long as a string can be.
JSON = {"maxStringLen": str(2**31 - 1)}
#: Levels of fields that fingerprints tell apart.
DEPTH = 3
# Fields that say nothing about turns; a record may have them in any layout.
IGNORED = ("id", "uuid", "name", "metadata", "meta", "source", "timestamp", "created_at", "weight", "tags", "lang", "language", "model_name")

_MESSAGE = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_TAIL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_TAIL})", r"$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


#: A JSON string. All quantifiers are possessive, so that texts of any length match without recursion.
_STRING = r'(?s)"{mark}([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def _marked(payload: Column) -> Column:
    """The JSON with an s before every string and key: a value's first character then tells a string from what it may spell."""
    return F.regexp_replace(payload, _STRING.format(mark=""), '"s$1"')


def _text(value: Column) -> Column:
    """The text of a marked value: a string itself, anything else as its JSON."""
    return F.when(value.startswith("s"), F.substring(value, 2, 2**31 - 1)).otherwise(F.regexp_replace(value, _STRING.format(mark="s"), '"$1"'))


def _fields(value: Column) -> Column:
    """The fields of a marked JSON object by name; null for what is no object."""
    return F.when(F.substring(F.ltrim(value), 1, 1) == "{", F.from_json(value, "map<string,string>", JSON))


def _elements(value: Column) -> Column:
    return F.when(F.substring(F.ltrim(value), 1, 1) == "[", F.from_json(value, "array<string>", JSON))


def _paths_below(value: Column, depth: int) -> Column:
    """Paths of the fields in an object, or in the objects of an array, each with what leads to it; texts are not walked."""
    none = F.array().cast("array<string>")

    def of(fields: Column, lead: str) -> Column:
        own = F.transform(F.map_keys(fields), lambda k: F.concat(F.lit(lead), F.substring(k, 2, 2**31 - 1)))
        if depth > 1:
            deeper = F.flatten(F.transform(F.map_entries(fields), lambda e: F.transform(_paths_below(e["value"], depth - 1), lambda p: F.concat(F.lit(lead), F.substring(e["key"], 2, 2**31 - 1), p))))
            own = F.concat(own, deeper)
        return F.coalesce(own, none)

    inside = F.flatten(F.transform(_elements(value), lambda o: of(_fields(o), "[].")))
    return F.array_distinct(F.concat(of(_fields(value), "."), F.coalesce(inside, none)))


def field_paths(payload: Column) -> Column:
    """The sorted distinct field paths of a JSON record, DEPTH levels down, without those of IGNORED fields.

    `a`, `a.b` for an object in a field, `a[].b` for objects in an array, `a[].b[].c` and so on. Values play no part, nor
    does what a text spells.
    """
    named = F.transform(F.filter(_paths_below(_marked(payload), DEPTH), lambda p: p.startswith(".")), lambda p: F.substring(p, 2, 2**30))
    ignored = rf"(^|\.)({'|'.join(IGNORED)})(\[\])?(\.|$)"
    return F.array_sort(F.filter(F.array_distinct(named), lambda p: ~p.rlike(ignored)))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _pairs(*parts: tuple[str, str, bool]) -> dict:
    return {"parts": parts}


#: Declarative mappings: the field paths of a layout, and where its turns are. `list` names an array of messages with
#: its role and text fields; `parts` names single fields with the role each one's text has; True: left out when empty.
LAYOUTS: tuple[dict, ...] = (
    {"paths": ("messages", "messages[].role", "messages[].text"), "list": ("messages", "role", "text")},
    {"paths": ("messages", "messages[].content", "messages[].role"), "list": ("messages", "role", "content")},
    {"paths": ("messages", "messages[].content", "messages[].content[].text", "messages[].content[].type", "messages[].role"), "list": ("messages", "role", "content"), "pieces": True},
    {"paths": ("conversations", "conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    {"paths": ("turns", "turns[].speaker", "turns[].utterance"), "list": ("turns", "speaker", "utterance")},
    {"paths": ("prompt", "response"), **_pairs(("prompt", "user", False), ("response", "assistant", False))},
    {"paths": ("completion", "prompt"), **_pairs(("prompt", "user", False), ("completion", "assistant", False))},
    {"paths": ("prompt", "response", "system"), **_pairs(("system", "system", True), ("prompt", "user", False), ("response", "assistant", False))},
    {"paths": ("instruction", "output"), **_pairs(("instruction", "user", False), ("output", "assistant", False))},
    {"paths": ("input", "instruction", "output"), **_pairs(("instruction", "user", False), ("input", "user", True), ("output", "assistant", False))},
    {"paths": ("answer", "question"), **_pairs(("question", "user", False), ("answer", "assistant", False))},
)
# Names that layouts give to the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def known_paths() -> list[str]:
    """All field paths that some layout names; fields that none names play no part in the choice of a layout."""
    return sorted({p for known in LAYOUTS for p in known["paths"]})


def _text_of(content: Column) -> Column:
    """The text of a content that may be a list of pieces: those of type text, one after the other."""
    pieces = F.when(content.startswith("["), F.from_json(content, "array<struct<stype:string,stext:string>>", JSON))
    return F.coalesce(F.array_join(F.transform(F.filter(pieces, lambda p: p["stype"] == "stext"), lambda p: F.coalesce(_text(p["stext"]), F.lit(""))), ""), _text(content))


def _turns_of(layout: dict, marked: Column) -> Column:
    if "list" in layout:
        field, role, text = layout["list"]
        shape = f"array<struct<`s{role}`:string,`s{text}`:string>>"
        rows = F.from_json(marked, f"struct<`s{field}`:{shape}>", JSON)[f"s{field}"]
        name = lambda r: F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])[r], r, F.lit("")) if role != "role" else F.coalesce(r, F.lit(""))
        spoken = _text_of if layout.get("pieces") else _text
        return F.transform(F.coalesce(rows, F.array().cast(shape)), lambda m: F.struct(name(_text(m[f"s{role}"])).alias("role"), F.coalesce(spoken(m[f"s{text}"]), F.lit("")).alias("text")))
    fields = F.from_json(marked, "map<string,string>", JSON)
    found = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(_text(fields[f"s{field}"]), F.lit("")).alias("text"), F.lit(optional).alias("o")) for field, role, optional in layout["parts"]])
    return F.transform(F.filter(found, lambda t: ~t["o"] | (t["text"] != "")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def canonical_turns(records: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds `layout` (the fingerprint of the paths that layouts name) and `turns` (role and text of each turn; null where no
    mapping is known)."""
    others = [c for c in records.columns if c.lower() not in ("layout", "turns")]
    named = F.filter(field_paths(F.col(payload_col)), lambda p: p.isin(known_paths()))
    step = records.select(*others, fingerprint(named).alias("layout"), _marked(F.col(payload_col)).alias("_marked"))
    # the fingerprints of the known layouts fold to constants
    turns = None
    for known in LAYOUTS:
        hit = F.col("layout") == F.xxhash64(F.lit("\n".join(sorted(known["paths"]))))
        turns = (F.when if turns is None else turns.when)(hit, _turns_of(known, F.col("_marked")))
    return step.withColumn("turns", turns.cast(_MESSAGE)).drop("_marked")


def format_turns(turns: Column) -> Column:
    """The formatted string: each turn is mark, role, line feed, escaped text, mark, line feed."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """Start (from 1) and length, in code points of the formatted string, of each assistant text."""
    frame = len(TURN) + 1 + len(END) + 1
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        role, n = F.length(_escape_role(t["role"])), F.length(escape(t["text"]))
        span = F.struct((a["at"] + len(TURN) + role + 1).cast("int").alias("start"), n.cast("int").alias("length"))
        return F.struct(
            (a["at"] + frame + role + n).cast("int").alias("at"),
            F.when(t["role"] == LOSS_ROLE, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_chats(records: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Formats records of mixed layouts with one template; adds layout, turns, formatted and loss_spans.

    A record is a JSON string. Its fingerprint, the hash of its sorted field paths without IGNORED ones and those that no
    layout names, selects a mapping of LAYOUTS to canonical turns. A text is kept as it is, whatever it spells (JSON, code,
    calls of tools); a content that is a number, a truth value or an object is its JSON. Contents may be lists of pieces, of
    which those of type text count, beside contents that are texts. Control strings inside texts and roles are escaped so
    that `read_formatted` gives them back.

    A null or unknown record keeps its row, with null turns, formatted and loss_spans. Null roles and texts count as
    empty. A record without turns formats as ''. Repeated records are formatted alike; an empty table stays empty.
    Input columns named like an output are replaced.
    """
    drop = [c for c in records.columns if c.lower() in ("formatted", "loss_spans")]
    step = canonical_turns(records.drop(*drop), payload_col)
    return step.withColumn("formatted", format_turns(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns")))


def read_formatted(formatted: Column) -> Column:
    """The turns that a formatted string holds."""
    pieces = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)
    body = F.transform(pieces, lambda p: F.substring(p, len(TURN) + 1, 2**30))
    return F.transform(body, lambda p: F.struct(_unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + 1, F.lit(2**30))).alias("text")))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")


def records_of_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One message-list record for each conversation from a table with a row for each turn.

    Rows are put in order of turn, then role, then text; nulls come first. A conversation's rows meet in one record,
    as they must to be formatted as one string.
    """
    message = F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(message))
    return rows.groupBy(F.col(conv_col)).agg(F.to_json(F.struct(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))).alias("payload"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2\3', 'g') AS et,
  replace(replace(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2\3', 'g'), '\', '\b'), chr(10), '\n') AS er
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(er) + 1 + length(et) + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
