"""Fill-in-the-middle: a text's prefix, middle and suffix, cut at token ends and put in another order.

A text is decoded to an array of code points. A token ends where a code point that is no white space stands before
one that is, or at the text's end; the draws of a document choose two of these ends (or the text's begin), and the
three slices are joined with the markers in suffix-prefix-middle or prefix-suffix-middle order. ``restore`` undoes it.

Draws come from the sha256 of seed and id, so reruns and other partitions agree. Each text is a row of its own: there is
no shuffle, and a batch holds as many texts as Spark's bound of rows and bytes for a batch lets in.

Defined cases: a null text counts as empty; an empty text, one that holds a marker and one that the rate leaves out stay
as they are (form ``plain``, lengths null); a text of white space is one token; a null id draws as an empty one; equal rows
are cut alike; other columns pass through, and those named as an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import table

#: Markers of prefix, suffix and middle; of all texts so many in a hundred are cut, and of those so many in suffix-prefix-middle order.
MARKERS, SEED, RATE, SPM_RATE = ("<P>", "<S>", "<M>"), 42, 50, 80
_MADE = "struct<n: bigint, prefix_chars: bigint, middle_chars: bigint, output: string>"


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def ends(code: np.ndarray) -> np.ndarray:
    """Where the tokens of a text end: white space and the run after it are one, and so is white space at the text's end."""
    if not len(code):
        return np.zeros(0, np.int64)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    return np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(code))


def cut(text: str, first: int, second: int, form: str, markers: tuple[str, str, str] = MARKERS) -> tuple[int, int | None, int | None, str | None]:
    """(tokens, code points of prefix and of middle, output) of a text; only the tokens where the form is plain."""
    code = points(text)
    after = ends(code)
    n = len(after)
    if form == "plain":
        return n, None, None, None
    low, high = (int(after[k - 1]) if k else 0 for k in sorted((first % (n + 1), second % (n + 1))))
    p, s, m = map(points, markers)
    prefix, middle, suffix = code[:low], code[low:high], code[high:]
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return n, low, high - low, np.concatenate(parts).tobytes().decode("utf-32-le")


def _cutter(markers: tuple[str, str, str]):
    @F.arrow_udf(_MADE)
    def made(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second, form in batches:
            rows = [cut(t.as_py() or "", a, b, f, markers) for t, a, b, f in zip(texts, first.to_pylist(), second.to_pylist(), form.to_pylist(), strict=True)]
            n, low, mid, out = zip(*rows, strict=True) if rows else ((), (), (), ())
            numbers = [pa.array(x, pa.int64()) for x in (n, low, mid)]
            yield pa.StructArray.from_arrays([*numbers, pa.array(out, pa.string())], ["n", "prefix_chars", "middle_chars", "output"])

    return made


def _draws(doc: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` with n (tokens), form (plain, spm, psm), prefix_chars, middle_chars and the ``output`` text."""
    if len(set(markers)) < 3 or not all(len(m) > 2 and not any(m[:k] == m[-k:] for k in range(1, len(m))) for m in markers):
        raise ValueError("markers differ, and none begins as it ends; else a text could not be told apart at its seams")
    whole, (h1, h2, h3, h4) = F.coalesce(F.col(text), F.lit("")), _draws(doc, seed)
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(whole, F.lit(m))
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    made = _cutter(markers)(F.col(text), h1, h2, form)
    # One struct for all that is added, so that columns of the input can have any names.
    rows = docs.select(F.struct(*docs.columns).alias("row"), whole.alias("whole"), form.alias("form"), made.alias("made"))
    added = {"n": F.col("made.n"), "form": F.col("form"), "prefix_chars": F.col("made.prefix_chars"), "middle_chars": F.col("made.middle_chars"), "output": F.coalesce("made.output", "whole")}
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of a form was made from, read from these two alone."""
    p, s, m = (F.lit(x) for x in markers)
    # No text that is cut holds a marker, so each stands once.
    lead = F.when(form == "psm", F.char_length(p)).otherwise(F.char_length(s))
    body = F.substring(output, lead + 1, F.char_length(output))
    second = F.when(form == "psm", s).otherwise(p)
    at = F.position(second, body)
    one, rest = F.substring(body, F.lit(1), at - 1), F.substring(body, at + F.char_length(second), F.char_length(body))
    end = F.position(m, rest)
    two, three = F.substring(rest, F.lit(1), end - 1), F.substring(rest, end + F.char_length(m), F.char_length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op12_fill_middle(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
