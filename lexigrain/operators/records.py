"""Raw CSV records that cannot be loaded, with the reason (minimum-cost error parse).

A record is read by an automaton over three fields and four modes (field start,
plain, quoted, closed).  Reading it as written costs nothing; inserting or
deleting a quote or a delimiter costs one.  Dynamic programming over the
twelve states finds the cheapest reading.  Records with a zero-cost reading
whose values are valid are loaded; of the others the edits, or the invalid
values, are the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIELDS = 3
START, PLAIN, QUOTED, CLOSED = range(4)
TICKET = r"\[обращение [0-9]+\]\Z"  #: what ``col1`` holds at its end, unless another pattern (or None) is given
BAD_CHAR = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]")
TRIM = " \t\r\n"
_SYMBOLS = re.compile(r'[",]|[^",]+')
_FIELD = r'("(?:[^"]|"")*"|[^",]*)'
_CLEAN = re.compile(",".join([_FIELD] * FIELDS), re.S)


def _moves(mode: int, k: int, s: str) -> Iterator[tuple[int, int, int, str]]:
    """(cost, mode, k, emitted text or edit) of consuming symbol ``s``; edits start with a backslash."""
    if s == '"':
        if mode == START:
            yield 0, QUOTED, k, ""
        elif mode == QUOTED:
            yield 0, CLOSED, k, ""
        elif mode == CLOSED:
            yield 0, QUOTED, k, '"'
        yield 1, mode, k, "\\delete quote"
    elif s == ",":
        if mode == QUOTED:
            yield 0, QUOTED, k, ","
        else:
            if k < FIELDS - 1:
                yield 0, START, k + 1, ""
            yield 1, mode, k, "\\delete delimiter"
    elif mode in (START, PLAIN):
        yield 0, PLAIN, k, s
    elif mode == QUOTED:
        yield 0, QUOTED, k, s


def _inserts(mode: int, k: int) -> Iterator[tuple[int, int, str]]:
    """(mode, k, edit) of inserting one character at cost 1."""
    if mode == START:
        yield QUOTED, k, "\\insert quote"
    elif mode == QUOTED:
        yield CLOSED, k, "\\insert quote"
    elif mode == CLOSED:
        yield QUOTED, k, '\\insert quote"'
    if mode != QUOTED and k < FIELDS - 1:
        yield START, k + 1, "\\insert delimiter"


def cheapest_parse(raw: str) -> tuple[int, list[str], list[str]]:
    """Cost, edits (``operation at offset``) and the three fields of the cheapest reading.

    Runs of ordinary characters are one symbol, so the work follows the number
    of quotes and delimiters, not the length.  Ties go to fewer insertions made
    late, a fixed order, so the result is deterministic.
    """
    origin = (START, 0)
    best: dict[tuple[int, int], int] = {origin: 0}
    trail: list[dict[tuple[int, int], tuple]] = []

    def relax(costs: dict, back: dict) -> None:
        for state in sorted(costs, key=lambda x: (costs[x], x)):
            todo = [state]
            while todo:
                at = todo.pop()
                for mode, k, edit in _inserts(*at):
                    if costs[at] + 1 < costs.get((mode, k), 1 << 30):
                        costs[mode, k] = costs[at] + 1
                        back[mode, k] = ("insert", at, edit)
                        todo.append((mode, k))

    symbols = [(m.start(), m.group()) for m in _SYMBOLS.finditer(raw)]
    first: dict = {}
    relax(best, first)
    trail.append(first)
    for _, s in symbols:
        costs: dict[tuple[int, int], int] = {}
        back: dict = {}
        for at in sorted(best):
            for cost, mode, k, text in _moves(*at, s):
                if best[at] + cost < costs.get((mode, k), 1 << 30):
                    costs[mode, k] = best[at] + cost
                    back[mode, k] = ("take", at, text)
        relax(costs, back)
        best = costs
        trail.append(back)
    ends = [(best[m, FIELDS - 1], m) for m in (START, PLAIN, CLOSED) if (m, FIELDS - 1) in best]
    cost, mode = min(ends)
    at, i = (mode, FIELDS - 1), len(symbols)
    steps: list[tuple[int, str, int]] = []
    while True:
        how = trail[i].get(at)
        if how is None:
            break
        kind, before, text = how
        where = symbols[i][0] if i < len(symbols) else len(raw)
        if kind == "take":
            i -= 1
            where = symbols[i][0]
        steps.append((where, text, before[1]))
        at = before
    fields, edits = [""] * FIELDS, []
    for where, text, k in reversed(steps):
        if text.startswith("\\") and text[1:].startswith(("insert", "delete")):
            edits.append(f"{text[1:].rstrip(chr(34))} at {where}")
            fields[k] += '"' if text.endswith('"') else ""
        else:
            fields[k] += text
    return cost, edits, fields


def check_values(fields: list[str], first_pattern: str | None = TICKET) -> list[str]:
    """What is invalid in three parsed fields; empty for a valid record.  The trimmed first field must hold ``first_pattern``, if given."""
    found = []
    first = fields[0].strip(TRIM)
    if not first:
        found.append("col1 is blank")
    elif first_pattern is not None and not re.search(first_pattern, first):
        found.append("col1 has no ticket tag at its end")
    found += [f"col{i} holds a control or replacement character" for i, x in enumerate(fields, 1) if BAD_CHAR.search(x)]
    return found


def parse_record(raw: str | None, first_pattern: str | None = TICKET) -> tuple[bool, str | None, int, list[str], list[str | None]]:
    """(loadable, reason, edit cost, edits, fields) of one record."""
    if raw is None:
        return False, "record: null", 0, [], [None] * FIELDS
    if raw == "":
        return False, "record: empty", 0, [], [None] * FIELDS
    if m := _CLEAN.fullmatch(raw):  # the automaton's zero-cost reading, found without the table
        fields = [x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in m.groups()]
        cost, edits = 0, []
    else:
        cost, edits, fields = cheapest_parse(raw)
    reasons = []
    if cost:
        kind = "quoting" if any("quote" in x for x in edits) else "fields"
        reasons.append(f"{kind}: {'; '.join(edits)}")
    reasons += [f"value: {x}" for x in check_values(fields, first_pattern)]
    return not reasons, " | ".join(reasons) or None, cost, edits, fields


RESULT = "loaded boolean, reason string, cost int, edits array<string>, field1 string, field2 string, field3 string"


def parse_records(df: DataFrame, id_col: str = "rec_id", raw_col: str = "raw", first_pattern: str | None = TICKET) -> DataFrame:
    """One row per record: id, ``loaded``, ``reason``, ``cost``, ``edits``, ``field1..3``.

    ``field1..3`` are the values of the cheapest reading: final for loaded
    records, a proposal for the others (null for null and empty records).
    Repeated records are parsed each; an empty table gives an empty result;
    other columns of ``df`` are not read.  One narrow pass, no shuffle.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL(RESULT).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse_record(x, first_pattern) for x in b["raw"]]
            yield pd.DataFrame({
                "id": b["id"], "loaded": [r[0] for r in rows], "reason": [r[1] for r in rows],
                "cost": pd.Series([r[2] for r in rows], dtype="int32"), "edits": [r[3] for r in rows],
                **{f"field{i + 1}": [r[4][i] for r in rows] for i in range(FIELDS)},
            })

    out = df.select(df[id_col].alias("id"), df[raw_col].cast("string").alias("raw")).mapInPandas(run, schema)
    return out.withColumnRenamed("id", id_col)


def loaded(df: DataFrame, id_col: str = "rec_id", raw_col: str = "raw", first_pattern: str | None = TICKET) -> DataFrame:
    """The valid records as ``id, col1, col2, col3``."""
    p = parse_records(df, id_col, raw_col, first_pattern)
    return p.where("loaded").select(id_col, *(p[f"field{i}"].alias(f"col{i}") for i in (1, 2, 3)))


def rejected(df: DataFrame, id_col: str = "rec_id", raw_col: str = "raw", first_pattern: str | None = TICKET) -> DataFrame:
    """The records that cannot be loaded as ``id, reason, cost, edits`` and the proposed fields."""
    p = parse_records(df, id_col, raw_col, first_pattern)
    return p.where("NOT loaded").select(id_col, "reason", "cost", "edits", *(p[f"field{i}"].alias(f"proposed{i}") for i in (1, 2, 3)))
