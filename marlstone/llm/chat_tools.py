"""Chat formatting: link tool calls and results, order calls, validate arguments, serialise canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialise, spread
from .common import text_batches, whole_groups

#: How a text holds calls and results besides being one JSON object itself.
_BLOCK = re.compile(r"<(tool_call|tool_response)>(.*?)</\1>", re.S)
#: An argument {"$result": id} stands for the result of another call.
REFERENCE = "$result"
#: Schemas of the tools used in tests and by the query; callers pass their own.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]},
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: JSON nested deeper is not parsed; its text stays a message.
DEPTH = 200
#: Calls of a conversation with at most so many needs are ordered in one pass, of larger ones level by level.
PASS_NEEDS = 50_000
_LONE = re.compile("[\ud800-\udfff]")


def escaped(s: str) -> str:
    """A string with lone surrogates, which UTF-8 cannot hold, written as their escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def number(v: int | float) -> str:
    """A number as ECMAScript writes it; an integer that no double equals keeps its digits."""
    if isinstance(v, int):
        if abs(v) <= 1 << 53:
            return str(v)
        try:
            if int(float(v)) != v:
                return str(v)
        except OverflowError:
            return str(v)
        v = float(v)
    if not math.isfinite(v):
        raise ValueError("no JSON number")
    if v == 0:
        return "0"
    digits, _, power = repr(abs(v)).partition("e")
    whole, _, part = digits.partition(".")
    point = len(whole) + int(power or 0)  # where the decimal point stands among all digits
    plain = whole + part
    digits = plain.lstrip("0")
    point -= len(plain) - len(digits)
    digits = digits.rstrip("0")
    k, sign = len(digits), "-" if v < 0 else ""
    if k <= point <= 21:
        return sign + digits + "0" * (point - k)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' if k > 1 else ''}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def canonical(value) -> str:
    """JSON after RFC 8785: keys by their UTF-16 code units, no spaces, ECMAScript numbers, UTF-8 unescaped.

    Two things that the RFC has no form for are given one: lone surrogates stay escapes, and integers beyond doubles
    keep their digits. NaN and infinities raise ValueError.
    """
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number(value)
    return escaped(json.dumps(value, ensure_ascii=False))


def depth(value) -> int:
    """How deep arrays and objects nest, without recursion."""
    deep, layer = 0, [value]
    while layer:
        deep += 1
        layer = [x for v in layer if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    return deep


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema (type, enum, const, bounds, lengths, pattern, properties, items).

    A reference to another call's result fits any schema: what it stands for is not known yet.
    """
    if isinstance(value, dict) and set(value) == {REFERENCE}:
        return []
    out = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def is_a(kind):
        if kind in ("integer", "number"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
        return isinstance(value, _KINDS[kind])

    if kinds and not any(map(is_a, kinds)):
        return [f"{at}: not {'/'.join(kinds)}"]
    allowed = schema.get("enum", []) + ([schema["const"]] if "const" in schema else [])
    if allowed and canonical(value) not in map(canonical, allowed):
        out.append(f"{at}: not an allowed value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{at}: out of bounds")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {REFERENCE}:
            return [_ident(value[REFERENCE])] if value[REFERENCE] is not None else []
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def _loads(text: str):
    try:
        value = json.loads(text)
        if depth(value) > DEPTH:
            return None
        canonical(value)
        return value
    except (ValueError, RecursionError):
        return None


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, call_id, depends on, errors, canonical JSON) of the parts of one message, in order.

    Calls and results keep their other keys. Of keys that an object repeats the last counts. An assistant's calls are a JSON object with tool_calls or tool_call blocks; results are the whole text of role
    tool, a JSON object with tool_call_id, or tool_response blocks. What else the text says is a message part.
    """
    raw, calls, results = text, [], []
    whole = _loads(text) if text and text.lstrip()[:1] == "{" else None
    if role == "assistant" and isinstance(whole, dict) and isinstance(whole.get("tool_calls"), list):
        calls, raw = whole["tool_calls"], whole.get("content")
    elif role == "tool" and isinstance(whole, dict) and "tool_call_id" in whole:
        results, raw = [whole], None
    elif text and role in ("assistant", "tool") and _BLOCK.search(text):
        for m in _BLOCK.finditer(text):
            (calls if m[1] == "tool_call" else results).append(_loads(m[2]))
        raw = _BLOCK.sub("", text).strip() or None
    parts = []
    if raw is not None or not (calls or results):
        parts.append(("message", None, [], [], canonical({"content": raw, "role": role})))
    for c in calls:
        if not isinstance(c, dict):
            parts.append(("call", None, [], ["$: not a call"], canonical(c)))
            continue
        inner = c.get("function") if isinstance(c.get("function"), dict) else c
        name, args = inner.get("name"), inner.get("arguments", {})
        args = _loads(args) if isinstance(args, str) else args
        known = isinstance(name, str) and name in schemas
        wrong = violations(args, schemas[name]) if known else [f"$: no schema for {name}"]
        ident = _ident(c.get("id"))
        others = {k: v for x in (c, inner) for k, v in x.items() if k != "function" or inner is c}
        wrong = [escaped(x) for x in wrong] + ([] if ident else ["$: no id"])
        parts.append(("call", ident, sorted(set(references(args))), wrong, canonical(others | {"arguments": args, "id": ident, "name": name})))
    for r in results:
        ident = _ident(r.get("tool_call_id")) if isinstance(r, dict) else None
        fields = r if isinstance(r, dict) else {"content": r}
        parts.append(("result", ident, [], [] if ident else ["$: no id"], canonical({"content": None} | fields | {"role": "tool", "tool_call_id": ident})))
    return parts


def _ident(value) -> str | None:
    """An identifier as text, so that 7 and "7" are one."""
    return None if value is None else escaped(value) if isinstance(value, str) else canonical(value)


_PART = "conv_id long, turn long, part int, role string, kind string, call_id string, needs array<string>, errors array<string>, json string"


def parts_of(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(conv, turn, i, role, *p) for i, p in enumerate(parse_message(role, text, schemas))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _PART.split(", ")])

    src = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return text_batches(spread(src)).mapInArrow(run, _PART)


def levels_of(needs: dict[str, list[str]]) -> dict[str, int]:
    """Levels of the calls of one conversation, given what each needs; calls on or behind a cycle have none."""
    behind: dict[str, list[str]] = {}
    waits = {c: len(n) for c, n in needs.items()}
    for c, n in needs.items():
        for x in n:
            behind.setdefault(x, []).append(c)
    level, ready = {}, [c for c, n in waits.items() if not n]
    at = 0
    while ready:
        level |= dict.fromkeys(ready, at)
        at += 1
        done, ready = ready, []
        for c in done:
            for x in behind.get(c, ()):
                waits[x] -= 1
                if not waits[x]:
                    ready.append(x)
    return level


def _levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "conv_id"):
        graphs: dict[int, dict[str, set[str]]] = {}
        for conv, call, need in zip(*(t.column(c).to_pylist() for c in ("conv_id", "call_id", "need"))):
            graph = graphs.setdefault(conv, {})
            graph.setdefault(need, set())
            graph.setdefault(call, set()).add(need)
        rows = [(conv, call, x) for conv, graph in graphs.items() for call, x in levels_of(graph).items()]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32()))], names=["conv_id", "call_id", "level"])


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 for calls that need no other, else one more than the deepest they need.

    ``calls`` has conv_id, call_id, needs, each call once. Needs of unknown calls don't count; calls on or behind a
    cycle get level null. Conversations of up to PASS_NEEDS needs are each ordered in one pass; of larger ones, a
    round settles one level by a join and an aggregate, so that none is gathered.
    """
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode("needs").alias("need")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = materialise(edges.join(known, ["conv_id", "need"]).select(*key, "need"), "edges")
    if not edges.limit(1).count():
        return calls.select(*key, F.lit(0).alias("level"))
    large = materialise(edges.groupBy("conv_id").count().where(F.col("count") > PASS_NEEDS).select("conv_id"), "large")
    small = edges.join(large, "conv_id", "left_anti").repartition("conv_id").sortWithinPartitions("conv_id")
    done = small.mapInArrow(_levelled, "conv_id long, call_id string, level int")
    tied = edges.select(*key).unionByName(edges.select("conv_id", F.col("need").alias("call_id"))).distinct()
    free = calls.select(*key).join(tied, key, "left_anti").withColumn("level", F.lit(0))
    if large.limit(1).count():
        done = done.unionByName(_level_rounds(edges.join(large, "conv_id", "left_semi")))
    return calls.select(*key).join(done.unionByName(free), key, "left")


def _level_rounds(edges: DataFrame) -> DataFrame:
    """Levels of the calls of large conversations, a level a round."""
    key = ["conv_id", "call_id"]
    needed = edges.select("conv_id", F.col("need").alias("call_id")).distinct()
    done = materialise(needed.join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0)), "levels")
    level = 0
    while True:
        level += 1
        met = edges.join(done.select("conv_id", F.col("call_id").alias("need"), F.lit(1).alias("met")), ["conv_id", "need"], "left")
        ready = met.groupBy(*key).agg(F.count("*").alias("n"), F.count("met").alias("m")).where("n = m").select(*key).join(done.select(*key), key, "left_anti")
        nxt = materialise(done.unionByName(ready.withColumn("level", F.lit(level))), "levels")
        grown = nxt.where(F.col("level") == level).limit(1).count()
        discard(done)
        done = nxt
        if not grown:
            return done


def link_tools(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """The parts of all messages as canonical JSON, calls and results linked.

    Returns conv_id, turn, part (place in its message), role, kind (message, call, result), call_id, status,
    other_turn (turn of the linked result or call), level (topological, of calls), errors and json. The parts of a
    conversation are in order by turn, level, part; they stay rows, so a conversation of any length is never one value.
    Status of a call: linked, unanswered, or duplicate for all but the first of an id (by turn, part); of a
    result: linked, early (before its call), duplicate, or orphan; of a part without id: none. Null texts
    are messages with null content, null roles stay null; rows without conv_id or turn are parsed and never linked;
    repeated rows count each (the parts of equal turn and place are one call); other columns are ignored; an
    empty table gives an empty result.
    """
    parts = materialise(parts_of(messages, SCHEMAS if schemas is None else schemas), "parts")
    key = ["conv_id", "call_id"]
    tied = parts.where("call_id is not null and conv_id is not null and turn is not null and kind <> 'message'")
    at = F.struct("turn", "part")
    calls = materialise(tied.where("kind = 'call'").groupBy(*key).agg(F.min(at).alias("call_at"), F.min_by("needs", at).alias("needs")), "calls")
    results = tied.where("kind = 'result'").groupBy(*key).agg(F.min(at).alias("result_at"))
    facts = calls.select(*key, "call_at").join(results, key, "full_outer").join(call_levels(calls), key, "left")
    facts = facts.withColumnsRenamed({"conv_id": "f_conv", "call_id": "f_call"})
    out = parts.join(facts, (F.col("conv_id") == F.col("f_conv")) & (F.col("call_id") == F.col("f_call")) & F.col("turn").isNotNull() & (F.col("kind") != "message"), "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when((call | result) & F.col("f_conv").isNull(), "none")
        .when(call & (at > F.col("call_at")), "duplicate")
        .when(call & F.col("result_at").isNull(), "unanswered")
        .when(call & (F.col("result_at") < F.col("call_at")), "unanswered")
        .when(call, "linked")
        .when(result & F.col("call_at").isNull(), "orphan")
        .when(result & (at > F.col("result_at")), "duplicate")
        .when(result & (at < F.col("call_at")), "early")
        .when(result, "linked")
    )
    out = out.withColumn("status", status)
    other = F.when((F.col("status") == "linked") & call, F.col("result_at.turn")).when((F.col("status") == "linked") & result, F.col("call_at.turn"))
    errors = F.when(call & F.col("f_conv").isNotNull() & F.col("level").isNull(), F.concat("errors", F.array(F.lit("$: needs itself")))).otherwise(F.col("errors"))
    return out.select("conv_id", "turn", "part", "role", "kind", "call_id", "status", other.alias("other_turn"), F.when(call, F.col("level")).alias("level"), errors.alias("errors"), "json")
