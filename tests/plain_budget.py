"""State texts by plain refilling, for comparison: every number of newest history tried on whole texts, all cuts in turn."""

import json
import re

from tracemill import schemas as S


def shorten(text, limit):
    if len(text) <= limit:
        return text
    marker = f"\n...[TRUNCATED {len(text) - limit} CHARS]...\n"
    room = max(0, limit - len(marker))
    tail = room - room // 2
    return text[: room // 2] + marker + (text[-tail:] if tail else "")


def shown(m):
    lines = [f"TOOL_RESULT id={m['tool_call_id']}"] if m["tool_call_id"] else []
    if m["name"]:
        lines.append(f"name={m['name']}")
    if m["content"]:
        lines.append(shorten(m["content"], S.MAX_RENDERED_CHARS))
    for c in m["tool_calls"] or []:
        call = {"id": c["id"] or "", **{k: (c["function"] or {}).get(k) or "" for k in ("name", "arguments")}}
        lines.append("TOOL_CALL " + json.dumps(call, sort_keys=True, separators=(",", ":")))
    return f"[{(m['role'] or 'unknown').upper()}]\n" + ("\n".join(lines) or "[EMPTY]")


def words(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def fill(messages, room, count=words):
    """(state, kept places, omitted places, observation, tokens before the policy, limits) of a prefix; None for what can't fit."""
    task = next((i for i, m in enumerate(messages) if m["role"] == "user"), None)
    system = next((m["content"] or "" for m in messages if m["role"] == "system"), "")
    tools = [i for i, m in enumerate(messages) if m["role"] == "tool"]
    others = [i for i, m in enumerate(messages) if m["role"] != "system" and i != task]
    seen = (tools or others or [None])[-1]
    pool = [i for i in others if i != seen]

    def text(limits, order):
        part = lambda t, n: shorten(t, limits[n])
        observation = shown(messages[seen]) if seen is not None else "[NO OBSERVATION]"
        body = [part(messages[task]["content"] or "" if task is not None else "", 2), part(system, 0), ", ".join(S.ONTOLOGY), part(observation, 1), "\n\n".join(shown(messages[i]) for i in order) or "[NO ADDITIONAL HISTORY]"]
        return "\n\n".join(h + "\n" + b for h, b in zip(S.SECTIONS, body, strict=True))

    steps = [(max(100, 3000 - 400 * a), max(300, 7000 - 400 * b), max(300, 6000 - 400 * c)) for a, b, c in [(a, 0, 0) for a in range(9)] + [(8, b, 0) for b in range(1, 18)] + [(8, 17, c) for c in range(1, 16)]]
    before = S.ENVELOPE_TOKENS + count(text(steps[0], pool))
    limits = next((x for x in steps if count(text(x, [])) <= room), None)
    if limits is None:
        return None, None, None, seen, before, None
    n = 0
    while n < len(pool) and count(text(limits, pool[::-1][: n + 1])) <= room:
        n += 1
    kept = sorted(pool[::-1][:n])
    return text(limits, kept), kept, [i for i in pool if i not in kept], seen, before, limits
