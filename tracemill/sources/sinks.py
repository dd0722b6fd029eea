"""Sinks: ordered JSON lines, and writes that happen only if every gate holds."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.records import record_reasons


def write_lines(df: DataFrame, order: list[str], path: str, by_name: bool = True) -> None:
    """JSON lines in a total order over all part files; refuses an existing folder. Columns are written by name, or as they stand."""
    names = sorted(df.columns) if by_name else df.columns
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_valid(df: DataFrame, record: str, order: list[str], path: str) -> None:
    """Writes the JSON texts of ``record`` in order, only if every one is a valid record; the first bad ones are named in the error."""
    bad = df.select(record, record_reasons(record).alias("reasons")).where("size(reasons) > 0").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{','.join(r['reasons'])} in {(r[record] or '')[:80]}" for r in bad))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(record).write.mode("errorifexists").text(path)


def create_once(path: str, data: bytes) -> None:
    """A file that is there whole or not at all, and never overwritten: written aside, flushed to disk, then linked to its name."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, aside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(aside, path)  # fails if the name is taken
    finally:
        os.unlink(aside)


def file_stats(path: str) -> dict:
    """bytes, rows and sha256 of a file of lines, read in pieces."""
    digest, size, rows = hashlib.sha256(), 0, 0
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
            size += len(piece)
            rows += piece.count(b"\n")
    return {"bytes": size, "rows": rows, "sha256": digest.hexdigest()}


def write_if(gates: DataFrame, df: DataFrame, order: list[str], path: str) -> bool:
    """Writes only if every row of ``gates`` (name, passed) has passed; tells whether it did."""
    if gates.where("passed is not true").limit(1).count():
        return False
    write_lines(df, order, path)
    return True


def report(sections: DataFrame, path: str, most: int = 100_000) -> None:
    """One sorted JSON document from (section, key, value) rows; they must be few."""
    rows = sections.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is for few rows")
    out: dict = {}
    for r in rows:
        out.setdefault(r["section"], {})[r["key"]] = r["value"]
    create_once(path, json.dumps(out, indent=2, sort_keys=True).encode())


def markdown(rows: list[dict]) -> str:
    names = list(rows[0]) if rows else []
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)] if names else []
    return "\n".join(lines + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows])


def gzip_bytes(data: bytes) -> bytes:
    """The same bytes for the same data: no time, no name."""
    return gzip.compress(data, mtime=0)
