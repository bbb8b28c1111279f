"""Tool interactions of episodes as relations: the first rule that an episode's tools, calls and answers break.

Messages and calls become rows; answers meet their calls by (episode, call id); every broken rule is an event with its place in
the episode, and the earliest event names the episode.  Python only compares one call's arguments with its tool's
JSON Schema.

Input: episodes with ``tools`` (JSON) and ``messages`` (array of role, action (JSON), tool_call_id).
"""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from ..scratch import written

# The names of the rules' violations, the roles, and the call that may end an episode without an answer.
TOOLS_MISSING, TOOLS_INVALID, TOOLS_EXTERNAL = "missing_tool_schema", "invalid_tool_schema", "external_tool_schema_reference"
#: This module's own: a schema with a keyword that it can't check; nothing is accepted by default.
TOOLS_UNCHECKED = "unchecked_tool_schema_keyword"
ROLE_UNKNOWN, UNANSWERED, GRAMMAR, CALL_ID = "unknown_role", "missing_tool_response", "unsupported_action_grammar", "invalid_tool_call_id"
CALL_UNKNOWN, ARGUMENTS, ORPHAN, NO_ACTIONS = "unknown_tool_or_arguments", "invalid_tool_arguments", "orphan_tool_response", "no_tool_actions"
ROLES, LAST_CALL = ("system", "developer", "user", "assistant", "tool"), "finish"

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_NUMBER, _COUNT, _SCHEMA, _NAMED, _SCHEMAS = "number", "count", "schema", "schemas by name", "schemas"
# The keywords of JSON Schema 2020-12 that assert something, with what they hold, and those that only describe.
_KEYWORDS = {
    "type": "type", "enum": list, "const": None, "required": "names", "pattern": "pattern", "uniqueItems": bool, "dependentRequired": "names by name", "$ref": str,
    "multipleOf": _NUMBER, "minimum": _NUMBER, "maximum": _NUMBER, "exclusiveMinimum": _NUMBER, "exclusiveMaximum": _NUMBER,
    "minLength": _COUNT, "maxLength": _COUNT, "minItems": _COUNT, "maxItems": _COUNT, "minContains": _COUNT, "maxContains": _COUNT, "minProperties": _COUNT, "maxProperties": _COUNT,
    "properties": _NAMED, "patternProperties": _NAMED, "dependentSchemas": _NAMED, "$defs": _NAMED, "definitions": _NAMED, "anyOf": _SCHEMAS, "oneOf": _SCHEMAS, "allOf": _SCHEMAS, "prefixItems": _SCHEMAS,
    "items": _SCHEMA, "contains": _SCHEMA, "not": _SCHEMA, "additionalProperties": _SCHEMA, "propertyNames": _SCHEMA, "if": _SCHEMA, "then": _SCHEMA, "else": _SCHEMA,
}
DESCRIBE = frozenset("$schema $id $comment $anchor $vocabulary title description default examples deprecated readOnly writeOnly format contentEncoding contentMediaType contentSchema".split())


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def _equal(a, b) -> bool:
    """Equality of JSON values: numbers by value, and no number is true or false."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    return a == b


def _divides(part, value) -> bool:
    try:
        return Decimal(str(value)) % Decimal(str(part)) == 0
    except InvalidOperation:  # a quotient of too many digits
        return Fraction(str(value)) % Fraction(str(part)) == 0


def _object_fits(schema: dict, value: dict, fits) -> bool:
    known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
    patterns = {p: s for p, s in schema.get("patternProperties", {}).items()}
    for name, member in value.items():
        own = [known[name]] if name in known else []
        own += [s for p, s in patterns.items() if re.search(p, name)]
        if not all(fits(s, member) for s in own or [extra]):
            return False
    if any(k not in value for k in schema.get("required", ())) or not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
        return False
    if any(k in value and any(n not in value for n in names) for k, names in schema.get("dependentRequired", {}).items()):
        return False
    return all(fits(schema.get("propertyNames", True), k) for k in value) and all(fits(s, value) for k, s in schema.get("dependentSchemas", {}).items() if k in value)


def _array_fits(schema: dict, value: list, fits) -> bool:
    first = schema.get("prefixItems", [])
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
        return False
    if not all(fits(s, x) for s, x in zip(first, value)) or not all(fits(schema.get("items", True), x) for x in value[len(first) :]):
        return False
    if schema.get("uniqueItems") and any(_equal(x, y) for i, x in enumerate(value) for y in value[:i]):
        return False
    met = sum(fits(schema["contains"], x) for x in value) if "contains" in schema else None
    return met is None or schema.get("minContains", 1) <= met <= schema.get("maxContains", met)


def accepts(schema, value, root=None) -> bool:
    """Whether a value satisfies a JSON Schema of the keywords in _KEYWORDS; references lead within the schema."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    fits = lambda s, x: accepts(s, x, root)
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#").strip("/").split("/") if schema["$ref"] != "#" else ():
            target = target[part.replace("~1", "/").replace("~0", "~")]
        if not fits(target, value):
            return False
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(_equal(value, x) for x in schema["enum"]) or "const" in schema and not _equal(value, schema["const"]):
        return False
    if isinstance(value, dict) and not _object_fits(schema, value, fits) or isinstance(value, list) and not _array_fits(schema, value, fits):
        return False
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) or "pattern" in schema and not re.search(schema["pattern"], value):
            return False
    elif _is(value, "number"):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value) or "multipleOf" in schema and not _divides(schema["multipleOf"], value):
            return False
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            return False
    if "if" in schema and not fits(schema.get("then" if fits(schema["if"], value) else "else", True), value):
        return False
    each = lambda k: [fits(s, value) for s in schema.get(k, ())]
    return all(each("allOf")) and ("anyOf" not in schema or any(each("anyOf"))) and ("oneOf" not in schema or sum(each("oneOf")) == 1) and ("not" not in schema or not fits(schema["not"], value))


def below(schema: dict) -> list:
    """The schemas that stand directly in a schema."""
    out = []
    for k, v in schema.items():
        kind = _KEYWORDS.get(k)
        out += [v] if kind is _SCHEMA else v if kind is _SCHEMAS else list(v.values()) if kind is _NAMED else []
    return out


def _sound(kind, value) -> bool:
    names = lambda x: isinstance(x, list) and all(isinstance(n, str) for n in x)
    if kind == "type":
        return (isinstance(value, str) or names(value)) and set([value] if isinstance(value, str) else value) <= {*_TYPES, "integer", "number"}
    if kind == "names":
        return names(value)
    if kind == "names by name":
        return isinstance(value, dict) and all(map(names, value.values()))
    if kind == "pattern":
        return isinstance(value, str) and _compiles(value)
    if kind is _NUMBER:
        return _is(value, "number")
    if kind is _COUNT:
        return _is(value, "integer") and value >= 0
    return kind is None or isinstance(value, {_SCHEMA: (dict, bool), _SCHEMAS: list, _NAMED: dict}.get(kind, kind))


def _compiles(pattern: str) -> bool:
    try:
        return bool(re.compile(pattern))
    except re.error:
        return False


def well_formed(schema) -> bool:
    """Whether the keywords of a schema have values of the right kind, all the way down."""
    if isinstance(schema, bool):
        return True
    if not isinstance(schema, dict) or any(not _sound(_KEYWORDS[k], v) for k, v in schema.items() if k in _KEYWORDS):
        return False
    if schema.get("multipleOf", 1) <= 0 or not all(map(_compiles, schema.get("patternProperties", ()))):
        return False
    return all(well_formed(s) for s in below(schema))


def unknown_keywords(schema) -> set[str]:
    """The keywords of a well-formed schema that this module neither checks nor knows to check nothing: dynamic references, unevaluated
    members, keywords of other vocabularies."""
    if isinstance(schema, bool):
        return set()
    return {k for k in schema if k not in _KEYWORDS and k not in DESCRIBE and not k.startswith("x-")}.union(*map(unknown_keywords, below(schema)))


@F.pandas_udf(ArrayType(StringType()))
def schema_unknown(schemas: pd.Series) -> pd.Series:
    """The unknown keywords of each JSON Schema, sorted; null for one that is not well formed."""

    def one(s):
        schema = json.loads(s)
        return sorted(unknown_keywords(schema)) if well_formed(schema) else None

    return schemas.map(lambda s: None if s is None else one(s))


def _accepted(schema, value) -> bool:
    try:
        return accepts(schema, value)
    except (KeyError, TypeError, ValueError, RecursionError):
        return False


def _parsed(text: str):
    """(whether it is JSON, its value)."""
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


@F.pandas_udf(BooleanType())
def schema_accepts(schemas: pd.Series, values: pd.Series) -> pd.Series:
    """Whether each JSON value satisfies its JSON Schema; false where a reference leads nowhere."""
    read = {s: _parsed(s) for s in set(schemas) if s is not None}  # schemas repeat in a batch

    def one(schema, value):
        sound, v = _parsed(value)
        return sound and read[schema][0] and _accepted(read[schema][1], v)

    return pd.Series([None if s is None or v is None else one(s, v) for s, v in zip(schemas, values, strict=True)], dtype=object)


def schemas_accept(schemas: list[str], value: Column) -> Column:
    """``schema_accepts`` of one JSON value for each of several schemas, as an array; a value is read once, a schema once for many values."""

    def each(values: pd.Series) -> pd.Series:
        read = [_parsed(s) for s in schemas]

        def one(text):
            sound, v = _parsed(text)
            return [sound and good and _accepted(s, v) for good, s in read]

        return pd.Series([None if x is None else one(x) for x in values], dtype=object)

    return F.pandas_udf(each, ArrayType(BooleanType()))(value)


def _kind(v: Column) -> Column:
    """Name of a variant's type: OBJECT, ARRAY, STRING, ..; null for a missing one."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _part(v: str | Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def references(schema: Column) -> Column:
    """Targets of all ``$ref`` of a JSON Schema in canonical JSON."""
    return F.regexp_extract_all(schema, F.lit(r'"\$ref":"((?:[^"\\]|\\.)*)"'), F.lit(1))


def tool_rows(episodes: DataFrame, episode: str) -> DataFrame:
    """(episode, at, name, parameters, fault): each tool definition and what is wrong with it."""
    v = episodes.select(episode, F.try_parse_json("tools").alias("v"))
    rows = v.where(_kind(F.col("v")) == "ARRAY").select(episode, F.posexplode(_part("v", "$", "array<variant>")).alias("at", "tool"))
    rows = rows.select(episode, "at", _part("tool", "$.function.name", "string").alias("name"), _part("tool", "$.function.parameters").alias("p"))
    rows = rows.withColumn("parameters", F.to_json("p")).withColumn("object", (_kind(F.col("p")) == "OBJECT") & (_part("p", "$.type", "string") == "object")).drop("p")
    first = F.row_number().over(Window.partitionBy(episode, "name").orderBy("at")) == 1
    # schemas repeat in very many episodes: each is looked at once
    each = rows.where("object").select("parameters").distinct().select(F.col("parameters").alias("s"), schema_unknown("parameters").alias("unknown"))
    each = each.withColumn("sound", F.col("unknown").isNotNull())
    outside = F.exists(references(F.col("parameters")), lambda r: ~r.startswith("#"))
    rows = rows.withColumn("first", first).join(each, F.col("parameters") == F.col("s"), "left")
    sound = F.coalesce((F.length("name") > 0) & F.col("first") & F.col("object") & F.col("sound"), F.lit(False))
    fault = F.when(~sound, TOOLS_INVALID).when(outside, TOOLS_EXTERNAL).when(F.size("unknown") > 0, TOOLS_UNCHECKED)
    return rows.select(episode, "at", "name", "parameters", fault.alias("fault"))


def call_rows(messages: DataFrame, episode: str) -> DataFrame:
    """(episode, pos, nth, n, last, id, name, arguments, whole): each call of the assistants' actions."""
    v = messages.where("role = 'assistant' and action is not null").select(episode, "pos", "last", F.try_parse_json("action").alias("v"))
    rows = v.where(_kind(F.col("v")) == "ARRAY").select(episode, "pos", "last", F.posexplode(_part("v", "$", "array<variant>")).alias("nth", "c"), F.size(_part("v", "$", "array<variant>")).alias("n"))
    given = lambda path: _part("c", path)
    whole = F.coalesce((_kind(F.col("c")) == "OBJECT") & (_kind(given("$.function")) == "OBJECT"), F.lit(False))
    for path in ("$.id", "$.function.name", "$.function.arguments"):
        whole = whole & given(path).isNotNull()
    text = lambda path: F.when(_kind(given(path)) == "STRING", _part("c", path, "string"))
    arguments = F.when(_kind(given("$.function.arguments")) == "OBJECT", F.to_json(given("$.function.arguments")))
    return rows.select(episode, "pos", "nth", "n", "last", text("$.id").alias("id"), text("$.function.name").alias("name"), arguments.alias("arguments"), whole.alias("whole"))


def interaction_events(episodes: DataFrame, episode: str = "episode_id") -> DataFrame:
    """(episode, pos, nth, step, fault): every broken rule, at its place.  Events of the tools come before all messages
    (pos -1), those of the whole episode behind them (pos null)."""
    # the key goes under a name of its own, so that it can have any; rows are read several times, so they are written first
    rows = written(episodes.select(F.col(episode).alias("__episode"), "tools", "messages"), "interactions")
    return _events(rows, "__episode").withColumnRenamed("__episode", episode)


def _events(episodes: DataFrame, episode: str) -> DataFrame:
    messages = episodes.select(episode, (F.size("messages") - 1).alias("last"), F.posexplode("messages").alias("pos", "m")).select(episode, "last", "pos", "m.role", "m.action", "m.tool_call_id")
    tools, calls = tool_rows(episodes, episode), call_rows(messages, episode)
    event = lambda df, fault, pos="pos", nth="0", step=0: df.select(episode, F.expr(str(pos)).cast("int").alias("pos"), F.expr(nth).cast("int").alias("nth"), F.lit(step).alias("step"), F.expr(fault).alias("fault"))

    v = episodes.select(episode, F.try_parse_json("tools").alias("v"))
    none = v.where(~F.coalesce((_kind(F.col("v")) == "ARRAY") & (F.size(_part("v", "$", "array<variant>")) > 0), F.lit(False)))
    events = [event(none, f"'{TOOLS_MISSING}'", -1), event(tools.where("fault is not null"), "fault", -1, "at")]
    events.append(event(messages.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))), f"'{ROLE_UNKNOWN}'"))
    grammar = messages.where("role = 'assistant' and action is not null").withColumn("v", F.try_parse_json("action"))
    bad = ~F.coalesce((_kind(F.col("v")) == "ARRAY") & (F.size(_part("v", "$", "array<variant>")) > 0), F.lit(False))
    events.append(event(grammar.where(bad), f"'{GRAMMAR}'", step=1))

    known = tools.where("fault is null").select(F.col(episode).alias("e"), F.col("name").alias("tool"), "parameters")
    calls = calls.withColumn("nth_of_id", F.row_number().over(Window.partitionBy(episode, "id").orderBy("pos", "nth")))
    calls = calls.join(known, (F.col(episode) == F.col("e")) & (F.col("name") == F.col("tool")), "left").drop("e")
    checked = calls.where("parameters is not null and arguments is not null").select("parameters", "arguments").distinct()
    checked = checked.select(F.col("parameters").alias("s"), F.col("arguments").alias("v"), schema_accepts("parameters", "arguments").alias("fits"))
    calls = calls.join(checked, (F.col("parameters") == F.col("s")) & (F.col("arguments") == F.col("v")), "left")
    fault = (
        F.when(~F.col("whole"), ARGUMENTS).when(F.coalesce(F.length("id"), F.lit(0)) == 0, CALL_ID).when(F.col("nth_of_id") > 1, CALL_ID)
        .when(F.col("tool").isNull() | F.col("arguments").isNull(), CALL_UNKNOWN).when(~F.col("fits"), ARGUMENTS)
    )
    judged = calls.withColumn("fault", fault)
    events.append(event(judged.where("fault is not null"), "fault", nth="nth", step=2))

    # answers meet their calls; of several answers to one call the first counts
    waits = calls.where(f"length(id) > 0 and nth_of_id = 1 and not (name <=> '{LAST_CALL}' and pos = last and n = 1)").select(F.col(episode).alias("e"), "id", F.col("pos").alias("asked"))
    answers = messages.where("role = 'tool'").join(waits, (F.col(episode) == F.col("e")) & (F.col("tool_call_id") == F.col("id")) & (F.col("pos") > F.col("asked")), "left")
    answers = answers.withColumn("answer_no", F.row_number().over(Window.partitionBy(episode, "id").orderBy("pos")))
    events.append(event(answers.where("id is null or answer_no > 1"), f"'{ORPHAN}'"))
    answered = answers.where("answer_no = 1 and id is not null").select(F.col(episode).alias("e2"), F.col("id").alias("id2"), F.col("pos").alias("answer"))
    open_calls = waits.join(answered, (F.col("e") == F.col("e2")) & (F.col("id") == F.col("id2")), "left")
    # the next user or assistant message, of each place
    speaks = F.when(F.col("role").isin("user", "assistant"), F.col("pos"))
    after = F.min(speaks).over(Window.partitionBy(episode).orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    turns = messages.select(F.col(episode).alias("e3"), F.col("pos").alias("p3"), after.alias("next"))
    late = open_calls.join(turns, (F.col("e") == F.col("e3")) & (F.col("asked") == F.col("p3"))).where("answer is null or answer > next").select(F.col("e").alias(episode), "next")
    events.append(event(late, f"'{UNANSWERED}'", "next"))
    idle = episodes.select(episode).join(calls.select(episode).distinct(), episode, "left_anti")
    events.append(event(idle, f"'{NO_ACTIONS}'", "null", step=1))
    out = events[0]
    for more in events[1:]:
        out = out.unionByName(more)
    return out


def first_violations(episodes: DataFrame, episode: str = "episode_id") -> DataFrame:
    """(episode, violation): the first broken rule of each episode that breaks one."""
    # at one message: its role and open calls, then its grammar, then its calls in turn
    order = F.struct(F.coalesce("pos", F.lit(2**31 - 1)), (F.col("step") == 2).cast("int"), F.when(F.col("step") == 2, F.col("nth")).otherwise(F.col("step")), F.col("nth"))
    return interaction_events(episodes, episode).groupBy(episode).agg(F.min_by("fault", order).alias("violation"))
