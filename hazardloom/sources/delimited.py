"""Strict parsing of raw csv records, in vectors.

A record is one element, so a quote that never closes can't swallow the records after it. Quoting is
screened by one linear pattern per delimiter; what passes goes to the Arrow csv reader in one block, whose
invalid-row callback names the records with another number of fields than the header. Fields are read as
strings only; casting comes later, vector by vector.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv

DELIMITERS = (",", ";", "|", "\t")
MISSING = ("", "null", "none", "nan", "unknown", "n/a")  # fixed values
#: Field rules of problem 3 (fixed values).
WHOLE_FIELDS = ("NUM_FATALITIES", "NUM_INJURIES", "HOSPITALIZED", "AMPUTATION")
NUMBER_FIELDS = ("UNINTENTIONAL_RELEASE_BBLS",)
DATETIME_FIELDS = {"LOCAL_DATETIME": (r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "%Y-%m-%d %H:%M:%S"), "INCIDENT DATE": (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "%m/%d/%Y")}
#: Line breaks outside quotes go through the csv reader as private-use characters.
HIDDEN = {"\n": "\ue00a", "\r": "\ue00d"}
TEXT_FIELDS = {"NARRATIVE": 10, "FINAL NARRATIVE": 10}


@lru_cache(maxsize=64)
def _patterns(delim: str) -> tuple[re.Pattern, re.Pattern]:
    d = re.escape(delim)
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}]*+)'
    return re.compile(rf"{field}(?:{d}{field})*+"), re.compile(rf'"[^"]*+(?:""[^"]*+)*+"|[\r\n]')


def delimiter_of(header: str) -> str:
    """The delimiter that occurs most in the header outside quotes; a comma where none does."""
    bare = re.sub(r'"[^"]*"', "", header or "")
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


@lru_cache(maxsize=4096)
def header_fields(header: str) -> tuple[str, ...]:
    """Field names of a header; a header that can't be read gives one field."""
    try:
        return tuple(next(csv.reader([header.lstrip("\ufeff")], delimiter=delimiter_of(header)), [""]))
    except csv.Error:
        return (header,)


@lru_cache(maxsize=4096)
def readable(header: str) -> bool:
    """Whether a header holds field names: no quote is left open and nothing follows a closing one."""
    try:
        return bool(next(csv.reader([header.lstrip("\ufeff")], delimiter=delimiter_of(header), strict=True), []))
    except csv.Error:
        return False


@dataclass
class Parsed:
    """``reason``: None, ``quoting`` or ``column_count`` for each line. ``at``: lines that have fields, in the order of ``columns``."""

    names: tuple[str, ...]
    reason: np.ndarray
    at: np.ndarray
    columns: list[pa.Array]


def parse_lines(header: str, lines: list[str]) -> Parsed:
    """All records under one header. A null record is an empty one."""
    delim, names = delimiter_of(header), header_fields(header)
    whole, outside = _patterns(delim)
    reason = np.full(len(lines), None, dtype=object)
    text: list[str] = []
    swapped = False
    for k, line in enumerate(lines):
        line = line or ""
        if not whole.fullmatch(line):
            reason[k] = "quoting"
            continue
        if "\n" in line or "\r" in line:  # line breaks outside quotes are kept as content, so they are hidden from the reader
            new = outside.sub(lambda m: HIDDEN.get(m[0], m[0]), line)
            swapped |= new != line
            line = new
        text.append(f"{k}{delim}{line}\n")
    wrong: list[int] = []

    def on_invalid(row) -> str:
        wrong.append(int(re.match(r"[0-9]+", row.text)[0]))
        return "skip"

    ids = ["__k", *(f"c{i}" for i in range(len(names)))]
    if not text:
        return Parsed(names, reason, np.zeros(0, dtype=np.int64), [pa.array([], pa.string()) for _ in names])
    block = "".join(text).encode("utf-8", "replace")
    got = pacsv.read_csv(
        pa.BufferReader(block),
        read_options=pacsv.ReadOptions(column_names=ids, use_threads=False, block_size=max(1 << 20, len(block) + 1)),
        parse_options=pacsv.ParseOptions(delimiter=delim, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=on_invalid),
        convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in ids}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    reason[wrong] = "column_count"
    columns = [got.column(c).combine_chunks() for c in ids[1:]]
    if swapped:
        for mark, hidden in HIDDEN.items():
            columns = [pc.replace_substring(c, hidden, mark) for c in columns]
    return Parsed(names, reason, np.asarray(got.column("__k").combine_chunks().cast(pa.int64())), columns)


def missing_mask(column: pa.Array) -> pa.Array:
    return pc.is_in(pc.utf8_lower(pc.utf8_trim_whitespace(column)), value_set=pa.array(MISSING))


def _real_time(column: pa.Array, form: str, fmt: str) -> np.ndarray:
    ok = np.asarray(pc.match_substring_regex(column, f"^(?:{form})$"))
    at = np.flatnonzero(ok)
    if len(at):
        values = column.take(pa.array(at)).to_pandas()
        good = pd.to_datetime(values, format=fmt, errors="coerce").notna().to_numpy().copy()
        for k in np.flatnonzero(~good):  # years outside the range of nanosecond timestamps
            try:
                datetime.strptime(values.iloc[k], fmt)
                good[k] = True
            except ValueError:
                pass
        ok[at] = good
    return ok


def failing_cells(names: tuple[str, ...], columns: list[pa.Array]) -> dict[str, np.ndarray]:
    """For each field under a rule, which cells fail it."""
    out: dict[str, np.ndarray] = {}
    for name, column in zip(names, columns):
        rule = name.strip().upper()
        if rule in WHOLE_FIELDS:
            ok = pc.or_(missing_mask(column), pc.match_substring_regex(column, r"^\s*[0-9]+(?:\.0+)?\s*$"))
        elif rule in NUMBER_FIELDS:
            ok = pc.match_substring_regex(column, r"^\s*\+?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$")
        elif rule in DATETIME_FIELDS:
            ok = _real_time(column, *DATETIME_FIELDS[rule])
        elif rule in TEXT_FIELDS:
            ok = pc.greater_equal(pc.utf8_length(pc.utf8_trim_whitespace(column)), TEXT_FIELDS[rule])
        else:
            continue
        out[name] = ~np.asarray(ok).astype(bool)
    return out
