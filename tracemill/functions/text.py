"""Text and array functions, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import schemas as S


def normalize_task(c: Column) -> Column:
    """Lower case, Unicode white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def task_family(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def template_task(c: Column) -> Column:
    """Normalised task with numbers and quoted spans replaced by marks."""
    numbered = F.regexp_replace(normalize_task(c), r"(?U)\b\d+(?:\.\d+)*\b", "<num>")
    return F.regexp_replace(numbered, "`[^`]+`|'[^']+'|\"[^\"]+\"", "<quoted>")


def bounded(c: Column, limit: int) -> Column:
    """Head and tail of a text, with a marker between, of ``limit`` code points in all.

    Limits below the marker's length keep the marker only.
    """
    n = F.char_length(c)
    marker = F.concat(F.lit("\n...[TRUNCATED "), (n - limit).cast("string"), F.lit(" CHARS]...\n"))
    room = F.greatest(F.lit(limit) - F.char_length(marker), F.lit(0))
    left = F.floor(room / 2).cast("int")
    return F.when(n <= limit, c).otherwise(F.concat(F.substring(c, F.lit(1), left), marker, F.substring(c, n - (room - left) + 1, n)))


def tool_action(name: Column) -> Column:
    """The action type of a tool name; the first rule that holds wins."""
    n = F.replace(F.trim(F.lower(name)), F.lit("-"), F.lit("_"))
    return (
        F.when(n.isin(S.READ_NAMES) | n.startswith("read_"), "read")
        .when(n.isin(S.SEARCH_NAMES) | n.rlike("search|grep|glob|find"), "search")
        .when(n.isin(S.EDIT_NAMES) | n.rlike("edit|write|patch"), "edit")
        .when(n.isin(S.EXECUTE_NAMES) | n.rlike("shell|terminal|execute"), "execute")
        .otherwise("other_tool")
    )


def tool_family(name: Column) -> Column:
    return F.when(name.rlike("(?i)bash|shell|terminal|exec|command"), "shell").when(name.rlike("(?i)read|write|edit|file|glob|grep|search"), "file").when(name.rlike("(?i)web|browser|fetch|http"), "web").otherwise("other")


def empty_argument(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin("", "{}", "[]", "null", "None")


def word_tokens(c: Column) -> Column:
    """Words of two or more letters, digits or underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def probe_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_./:-]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by a space; none if there are fewer tokens."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(grams)


def presence_features(tokens: Column) -> Column:
    """Distinct unigrams ('u=') and bigrams ('b=') of a column of probe tokens."""
    one = F.transform(tokens, lambda x: F.concat(F.lit("u="), x))
    two = F.transform(ngrams(tokens, 2), lambda x: F.concat(F.lit("b="), F.replace(x, F.lit(" "), F.lit("_"))))
    return F.array_distinct(F.concat(one, two))


def whitespace_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))


def payload_texts(value: Column, kind: str) -> Column:
    """Texts between the call or response tags."""
    return F.regexp_extract_all(value, F.lit(S.TAGS[kind]), F.lit(1))


def payloads(value: Column, kind: str) -> Column:
    """Payload texts, or null if a tag is stray or nested or a payload is not an object with a string name."""
    tag = "tool_call" if kind == "call" else "tool_response"
    found = payload_texts(value, kind)
    stray = F.regexp_replace(value, S.TAGS[kind], "").rlike(rf"(?i)</?{tag}\b")
    nested = F.exists(found, lambda p: p.rlike(rf"(?i)</?{tag}\b"))

    def named(p):
        parsed = F.try_parse_json(p)
        return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get(parsed, "$.name", "variant")) == "STRING"), F.lit(False))

    return F.when(~stray & ~nested & F.forall(found, named), found)


def strip_reasoning(value: Column) -> Column:
    """(text, valid): text outside think spans; valid if tags are balanced and not nested."""
    tags = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(S.THINK_TAG), F.lit(0)), lambda t: F.when(t.startswith("</"), "C").otherwise("O")), "")
    text = F.regexp_replace(value, r"(?is)<think\b[^>]*>.*?</think\s*>", "")
    return F.struct(text.alias("text"), (tags.rlike("^(OC)*$") & ~text.rlike(S.THINK_TAG)).alias("valid"))


def previous_action(state: Column) -> Column:
    """Action type of the last tool name in the observation, else in the history; task text is not looked at."""
    mark = "LATEST RELEVANT OBSERVATION\n"
    rest = F.substring(state, F.instr(state, mark) + len(mark), F.char_length(state))
    split = F.split(rest, "\n\nRECENT HISTORY\n", 2)
    names = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'"name":"([^"]+)"'), F.lit(1))
    every = F.concat(names(F.get(split, 1)), names(F.get(split, 0)))
    return F.when(F.instr(state, mark) > 0, tool_action(F.try_element_at(every, F.lit(-1))))


def sections(state: Column) -> Column:
    """Map of section texts if every heading stands once, in order; else null."""
    heads = "|".join(S.SECTIONS)
    found = F.regexp_extract_all(state, F.lit(rf"(?m)^({heads})\n"), F.lit(1))
    pattern = r"(?s)^.*?" + "".join(rf"(?:^|\n){h}\n(.*?)" for h in S.SECTIONS[:-1]) + rf"\n{S.SECTIONS[-1]}\n(.*)$"
    texts = [F.regexp_replace(F.regexp_extract(state, pattern, i + 1), r"\n+$", "") if i < 4 else F.regexp_extract(state, pattern, 5) for i in range(5)]
    ok = found == F.array(*[F.lit(s) for s in S.SECTIONS])
    return F.when(ok, F.create_map(*[x for s, t in zip(S.SECTIONS, texts, strict=True) for x in (F.lit(s), t)]))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    """1-based place of the first largest value, in the array's own order."""
    return F.array_position(values, F.array_max(values))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
