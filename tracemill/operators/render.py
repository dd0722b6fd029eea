"""Whole messages as text: header, name, tool result, content and calls, in the order of a policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import schemas as S
from tracemill.functions import text


def call_line(call: Column) -> Column:
    """One call as canonical JSON: keys sorted, no spaces, what is not ASCII escaped."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    written = F.to_json(F.struct(blank(call["function"]["arguments"]).alias("arguments"), blank(call["id"]).alias("id"), blank(call["function"]["name"]).alias("name")))
    return F.concat(F.lit("TOOL_CALL "), ascii_json(written))


def ascii_json(written: Column) -> Column:
    """A JSON text with each character outside ASCII as \\\\u escapes of its UTF-16 units, and the writer's own escapes in lower case."""

    def unit(pair: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(pair))

    def escaped(c: Column) -> Column:
        units = F.hex(F.encode(c, "UTF-16BE"))
        return F.when(F.octet_length(c) == 1, c).otherwise(F.concat(unit(F.substring(units, 1, 4)), F.when(F.length(units) > 4, unit(F.substring(units, 5, 4))).otherwise("")))

    # The writer escapes control characters in upper case; a backslash before it would be doubled, so this is exact.
    plain = F.when(F.octet_length(written) == F.char_length(written), written).otherwise(F.array_join(F.transform(F.split(written, ""), escaped), ""))
    parts = F.regexp_extract_all(plain, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(plain, F.lit("\\u")), F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\u"), F.lower(p)).otherwise(p)), "")).otherwise(plain)


def message(m: Column, policy: int) -> Column:
    """``[ROLE]`` and the lines of a message; policy 1 puts the name before the tool result and cuts content later than policies 2 and 3."""
    if policy not in (1, 2, 3):
        raise ValueError("policy 1, 2 or 3")
    some = lambda c, line: F.when(F.coalesce(c, F.lit("")) != "", line)
    name = some(m["name"], F.concat(F.lit("name="), m["name"]))
    result = some(m["tool_call_id"], F.concat(F.lit("TOOL_RESULT id="), m["tool_call_id"]))
    content = some(m["content"], text.bounded(m["content"], S.MAX_MESSAGE_CHARS if policy == 1 else S.MAX_RENDERED_CHARS))
    calls = F.transform(F.coalesce(m["tool_calls"], F.array().cast(f"array<{S.CALL}>")), call_line)
    lines = F.filter(F.concat(F.array(*([name, result] if policy == 1 else [result, name]), content), calls), lambda x: x.isNotNull())
    body = F.when(F.size(lines) == 0, "[EMPTY]").otherwise(F.array_join(lines, "\n"))
    return F.concat(F.lit("["), F.upper(F.coalesce(m["role"], F.lit("unknown"))), F.lit("]\n"), body)
