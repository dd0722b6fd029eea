"""Queries of the training-text operators and the SQL that some of them equal."""

from __future__ import annotations

from tracemill.llm import chat_format, decontaminate, fill_middle, html_extract, line_dedup, lloyd, quality, simhash, source_mix, token_counts, toxicity, url_filter, winnow


def queries() -> dict:
    found = [
        url_filter.op1_url_filter,
        quality.op2_quality,
        chat_format.op3_chat_format,
        html_extract.op4_html_extract,
        simhash.op5_simhash,
        winnow.op6_winnow,
        line_dedup.op7_line_dedup,
        source_mix.op8_source_mix,
        decontaminate.op9_decontaminate,
        token_counts.op10_token_counts,
        toxicity.op11_toxicity,
        fill_middle.op12_fill_middle,
        lloyd.op13_lloyd,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.OP1_SQL,
        "op3_chat_format": chat_format.OP3_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op8_source_mix": source_mix.OP8_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op12_fill_middle": fill_middle.OP12_SQL,
        "op13_lloyd": lloyd.OP13_SQL,
    }
