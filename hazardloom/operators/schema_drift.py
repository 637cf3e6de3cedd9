"""Problem 1: one consistent table per source from files whose fields drift, and a list of every change.

Records become path-value maps with raw types; path-type statistics are aggregated by file; files are
compared with the file before them in their feed (joined on the sequence, no window over a feed); typed
columns are projected from the maps with a report of the casts that fail.

A field that vanishes and one that appears in the same file are one renamed field if their names say so or
their contents do: every (file, field) has a profile of fixed length (hashed counts of value shapes and of all
words, mean length, share of each type), and pairs are matched best first, mutually. The cells of a batch are
parsed, typed and profiled in vectors.

Defined cases: null or unreadable lines and files without a sequence add nothing; a csv header that can't be parsed gives
no fields, so its file is compared with none, and a warning of the task names it; a field whose values are
all missing has no type, which is no change of type; fields inside objects are paths (``site->name``), compared
where both files have an object there; integers beside decimals are decimals, anything
beside text is text, other mixtures take the most frequent type (ties in the order of ``TYPES``); repeated rows change no result; an empty
input gives no rows; further columns of the inputs are ignored.
"""

from __future__ import annotations

import json
import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardloom.operators import raw_rows
from hazardloom.sources import delimited
from hazardloom.storage import Workspace

TYPES = ("text", "integer", "decimal", "boolean", "list", "object")
SHAPES, WORDS = 24, 40
PROFILE = [f"p{i}" for i in range(SHAPES + WORDS)]
#: Values of more signs share one shape.
LONG = 48
#: Stands between the names of an inner path.
INNER = "->"
#: Distinct renames and headers of a source (a vocabulary, held on the driver) and columns of its table.
MOST_NAMES, MOST_COLUMNS = 200_000, 2_000
#: Least similarity of a renamed field; see ``similarity``.
RENAMED = 0.44

_INT, _DEC = r"^[+-]?[0-9]+$", r"^[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)$"


def _word(w: str) -> str:
    """Numbers by their leading digits: neighbours in a run of identifiers or times agree."""
    return w if len(w) < 3 or not w.isdigit() else w[: len(w) - 2] if len(w) <= 6 else w[:1]


@lru_cache(maxsize=200_000)
def _word_bucket(w: str) -> int:
    return zlib.crc32(_word(w).encode()) % WORDS


_JSON_TYPES = {bool: 3, int: 1, float: 2, list: 4, dict: 5}


@dataclass
class Cells:
    """Path-value maps of a batch in columns: position of the record, path, raw type (-1 missing) and text of each cell.

    ``shown``: (position, path) of fields that only a header shows, its file having no sound record in the batch.
    """

    row: np.ndarray
    path: np.ndarray
    kind: np.ndarray
    text: pa.Array
    shown: list[tuple[int, str]]

    def held(self) -> np.ndarray:
        return np.flatnonzero(self.kind >= 0)


def _csv_cells(header: str, at: np.ndarray, files: np.ndarray, lines: list[str]) -> Cells:
    if not delimited.readable(header):  # its one "name" would pass for a change of every field
        warnings.warn(f"no fields are read of files {sorted(set(files.tolist()))[:10]}: their header can't be parsed: {header[:80]!r}", stacklevel=2)
        return Cells(np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int8), pa.array([], pa.string()), [])
    parsed = delimited.parse_lines(header, lines)
    bad = np.zeros(len(lines), dtype=bool)
    for mask in delimited.failing_cells(parsed.names, parsed.columns).values():
        bad[parsed.at[mask]] = True
    good = np.flatnonzero(~bad[parsed.at])
    rows = parsed.at[good]
    names = [n.strip() for n in parsed.names]
    taken = pa.array(good)
    text = pa.concat_arrays([pc.utf8_trim_whitespace(c.take(taken)) for c in parsed.columns]) if names else pa.array([], pa.string())
    kind = np.zeros(len(text), dtype=np.int8)
    kind[np.asarray(pc.match_substring_regex(text, _DEC)).astype(bool)] = TYPES.index("decimal")
    kind[np.asarray(pc.match_substring_regex(text, _INT)).astype(bool)] = TYPES.index("integer")
    kind[np.asarray(delimited.missing_mask(text)).astype(bool)] = -1
    sound = set(files[rows].tolist())
    lone = {f: int(k) for k, f in zip(at, files.tolist()) if f not in sound}
    shown = [(k, n) for k in lone.values() for n in names]
    return Cells(np.tile(at[rows], len(names)), np.repeat(np.array(names, dtype=object), len(rows)), kind, text, shown)


def _json_paths(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for k, v in record.items():
        yield prefix + k, v
        if type(v) is dict:
            yield from _json_paths(v, f"{prefix}{k}{INNER}")


def _json_cells(at: np.ndarray, lines: list[str]) -> Cells:
    rows, paths, kinds, texts = [], [], [], []
    for k, line in zip(at.tolist(), lines):
        try:
            record = json.loads(line or "")
        except ValueError:
            continue
        if not isinstance(record, dict):
            continue
        for path, v in _json_paths(record):
            rows.append(k)
            paths.append(path)
            if v is None:
                kinds.append(-1)
                texts.append("")
            else:
                kinds.append(_JSON_TYPES.get(type(v), 0))
                texts.append(v if type(v) is str else json.dumps(v, ensure_ascii=False))
    # lone surrogates of a JSON escape can't be stored; they come out as question marks
    try:
        text = pa.array(texts, pa.string())
    except UnicodeEncodeError:
        text = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
    kind = np.array(kinds, dtype=np.int8)
    kind[(kind == 0) & np.asarray(delimited.missing_mask(text)).astype(bool)] = -1
    path = np.empty(len(paths), dtype=object)
    path[:] = paths
    return Cells(np.array(rows, dtype=np.int64), path, kind, text, [])


def batch_cells(pdf: pd.DataFrame) -> Cells:
    """The path-value maps of all sound records of a batch (file_id, file_format, header, line_text; index 0 to n)."""
    parts = []
    for (form, header), part in pdf.groupby(["file_format", "header"], sort=False):
        at, lines = part.index.to_numpy(), part["line_text"].tolist()
        parts.append(_csv_cells(header, at, part["file_id"].to_numpy(), lines) if form == "csv" else _json_cells(at, lines))
    if not parts:
        return Cells(np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int8), pa.array([], pa.string()), [])
    return Cells(np.concatenate([p.row for p in parts]), np.concatenate([p.path for p in parts]), np.concatenate([p.kind for p in parts]), pa.concat_arrays([p.text for p in parts]), [s for p in parts for s in p.shown])


def _shape_buckets(values: pa.Array) -> np.ndarray:
    """Bucket of each value's shape: letters as a, digits as 9, integers by length, one shape for all long values."""
    size = np.asarray(pc.utf8_length(values))
    shape = pc.replace_substring_regex(pc.replace_substring_regex(values, r"[0-9]+", "9"), r"[\p{L}\p{Nl}\p{No}]+", "a")
    whole = np.asarray(pc.match_substring_regex(values, _INT)).astype(bool)
    text = [f"int{n}" if i else "long" if n > LONG else s for s, n, i in zip(shape.to_pylist(), size.tolist(), whole.tolist())]
    return np.fromiter((zlib.crc32(s.encode()) % SHAPES for s in text), dtype=np.int64, count=len(text))


def _profiles(key: np.ndarray, n_keys: int, text: pa.Array) -> np.ndarray:
    """Per key the summed profile of its values: a count of each shape, and of each word a weight of 1 / words of its value."""
    out = np.zeros((n_keys, SHAPES + WORDS))
    coded = text.dictionary_encode()
    values, index = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    pair, n = np.unique(key * max(1, len(values)) + index, return_counts=True)
    k, u = pair // max(1, len(values)), pair % max(1, len(values))
    np.add.at(out, (k, _shape_buckets(values)[u]), n)
    words = pc.split_pattern_regex(pc.utf8_lower(values), r"[^\p{L}\p{N}_]+")
    flat = words.flatten().dictionary_encode()
    bucket = np.array([-1 if w == "" else _word_bucket(w) for w in flat.dictionary.to_pylist()], dtype=np.int64)
    bucket = bucket[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64)
    ends = np.asarray(words.offsets).astype(np.int64)
    ends -= ends[0]
    real = np.concatenate([[0], np.cumsum(bucket >= 0)])
    count = real[ends[1:]] - real[ends[:-1]]
    size = (ends[1:] - ends[:-1])[u]
    first = np.repeat(ends[:-1][u], size)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    b = bucket[first + step]
    weight = np.repeat(n / np.maximum(1, count[u]), size)
    ok = b >= 0
    out[:, SHAPES:] += np.bincount(np.repeat(k, size)[ok] * WORDS + b[ok], weights=weight[ok], minlength=n_keys * WORDS).reshape(n_keys, WORDS)
    return out


def _batch_statistics(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per (file, field) of a batch, in the columns of ``field_statistics``."""
    cells = batch_cells(pdf)
    files = pdf["file_id"].to_numpy()
    shown = cells.shown
    row = np.concatenate([cells.row, np.array([r for r, _ in shown], dtype=np.int64)])
    path = np.concatenate([cells.path, np.array([p for _, p in shown], dtype=object)])
    kind = np.concatenate([cells.kind, np.full(len(shown), -1, dtype=np.int8)])
    code, names = pd.factorize(path)
    pair, key = np.unique(files[row] * max(1, len(names)) + code, return_inverse=True)
    n = len(pair)
    out = pd.DataFrame({"file_id": pair // max(1, len(names)), "field": np.asarray(names, dtype=object)[pair % max(1, len(names))] if n else np.zeros(0, object), "n_records": np.bincount(key, minlength=n)})
    held = cells.held()
    types = np.bincount(key[held] * len(TYPES) + cells.kind[held], minlength=n * len(TYPES)).reshape(n, len(TYPES))
    for k, t in enumerate(TYPES):
        out[f"n_{t}"] = types[:, k]
    text = cells.text.take(pa.array(held))
    out["length"] = np.bincount(key[held], weights=np.log1p(np.asarray(pc.utf8_length(text)).astype(float)), minlength=n)
    profile = _profiles(key[held], n, text) if len(held) else np.zeros((n, len(PROFILE)))
    return pd.concat([out, pd.DataFrame(profile.astype(np.float32), columns=PROFILE)], axis=1)


def _sources(files: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    return files.filter(F.lower(F.trim("source")).isin(*sources))


def field_statistics(records: DataFrame, files: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """One row per (file, field): records with it, values of each type, summed length and profile."""
    schema = "file_id long, field string, n_records long, " + ", ".join(f"n_{t} long" for t in TYPES) + ", length double, " + ", ".join(f"{p} float" for p in PROFILE)
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _batch_statistics(pdf.reset_index(drop=True))

    wanted = _sources(files, sources)
    rows = raw_rows.with_headers(records.join(wanted.select("file_id").distinct(), "file_id", "left_semi"), wanted)
    return rows.mapInPandas(run, schema).groupBy("file_id", "field").agg(*(F.sum(c).alias(c) for c in columns[2:]))


def _type_of() -> Column:
    counts = [F.col(f"n_{t}") for t in TYPES]
    most = F.greatest(*counts)
    both = (F.col("n_decimal") > 0) & (F.col("n_integer") + F.col("n_decimal") >= most) & (F.col("n_text") == 0)
    first = F.coalesce(*(F.when(c == most, F.lit(t)) for t, c in zip(TYPES, counts)))
    return F.when(most == 0, F.lit(None)).when(F.col("n_text") > 0, F.lit("text")).when(both, F.lit("decimal")).otherwise(first)


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())


def _abbreviates(a: str, b: str) -> bool:
    """Whether the shorter word keeps the order of letters of the longer one, from its first two letters or without vowels."""
    a, b = sorted((a, b), key=len)
    rest = iter(b)
    return len(a) >= 2 and (a[:2] == b[:2] or a[0] == b[0] and not set(a) & set("aeiou")) and all(c in rest for c in a)


def name_similarity(a: str, b: str) -> float:
    """1 if only case, spacing and marks differ, else the share of words that agree or abbreviate one another."""
    x, y = _words(a), _words(b)
    if "".join(x) == "".join(y):
        return 1.0
    free, hits = list(y), 0.0
    for w in x:
        k = next((v for v in free if v == w), None) or next((v for v in free if _abbreviates(w, v)), None)
        if k is not None:
            free.remove(k)
            hits += 1.0 if k == w else 0.8
    return hits / max(1, len(x) + len(y) - hits)


def similarity(a: dict, b: dict) -> float:
    """Similarity from 0 to 1 of two (name, profile) pairs. Fields without values are compared by name alone."""
    name = name_similarity(a["field"], b["field"])
    if name == 1.0:
        return 1.0
    p, q = np.asarray(a["profile"]), np.asarray(b["profile"])
    if not p.any() or not q.any():
        return 0.9 * name

    def cosine(u: np.ndarray, v: np.ndarray) -> float:
        d = np.linalg.norm(u) * np.linalg.norm(v)
        return float(u @ v / d) if d else 0.0

    near = np.exp(-abs(a["length"] - b["length"]))
    content = (0.45 * cosine(p[:SHAPES], q[:SHAPES]) + 0.55 * cosine(p[SHAPES:], q[SHAPES:])) * (0.6 + 0.4 * near)
    if (a["type"] or "text") != (b["type"] or "text"):
        content *= 0.8 if {a["type"], b["type"]} <= {"integer", "decimal"} else 0.5
    return 0.72 * content + 0.28 * name if content > 0.5 or name else content * 0.72


def _pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """Matches gone and new fields of files, best first, each used once; the groups are the fields of one file."""
    out = []
    for file_id, gone, new, retyped in zip(pdf["file_id"], pdf["gone"], pdf["new"], pdf["retyped"]):
        pairs = sorted(((similarity(a, b), a["field"], b["field"]) for a in gone for b in new), key=lambda x: (-x[0], x[1], x[2]))
        a_used, b_used = set(), set()
        for score, a, b in pairs:
            if score >= RENAMED and a not in a_used and b not in b_used:
                a_used.add(a)
                b_used.add(b)
                out.append((file_id, "renamed", b, a, score))
        out += [(file_id, "removed", a["field"], "", 0.0) for a in gone if a["field"] not in a_used]
        out += [(file_id, "added", b["field"], "", 0.0) for b in new if b["field"] not in b_used]
        out += [(file_id, "retyped", f, "", 0.0) for f in retyped]
    return pd.DataFrame(out, columns=["file_id", "change_kind", "field_name", "old_field_name", "score"])


def file_fields(records: DataFrame, files: DataFrame, sources: tuple[str, ...], space: Workspace) -> DataFrame:
    """(file_id, fields) with the type, mean length and profile of every field of a file; written once, as several steps read it."""
    stats = field_statistics(records, files, sources)
    values = F.greatest(sum((F.col(f"n_{t}") for t in TYPES), F.lit(0)), F.lit(1))
    profile = F.array(*(F.col(p) for p in PROFILE))
    stats = stats.select("file_id", "field", _type_of().alias("type"), (F.col("length") / values).alias("length"), profile.alias("profile"))
    # the fields of one file: bounded by its width
    return space.cut(stats.groupBy("file_id").agg(F.collect_list(F.struct("field", "type", "length", "profile")).alias("fields")), "fields")


def _comparable(fields: str, other: str) -> Column:
    """The fields of a file; those inside an object only where the other file has an object there as well."""
    objects = F.transform(F.filter(other, lambda x: x["type"] == "object"), lambda x: x["field"])
    parent = lambda x: F.regexp_replace(x["field"], f"{INNER}(?:(?!{INNER}).)*$", "")
    return F.filter(fields, lambda x: ~x["field"].contains(INNER) | F.array_contains(objects, parent(x)))


def changes_between(packed: DataFrame, files: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """(file_id, change_kind, field_name, old_field_name, score) of every file against the one before it in its feed."""
    meta = _sources(files, sources).select(F.col("file_id").cast("long"), "feed_id", "file_seq").filter("file_id is not null and feed_id is not null and file_seq is not null").dropDuplicates(["file_id"])
    # a file's neighbour is found in the small table of files; fields only follow by file_id
    ahead = meta.select("feed_id", (F.col("file_seq") + 1).alias("file_seq"), F.col("file_id").alias("old_id"))
    pairs = meta.join(ahead, ["feed_id", "file_seq"]).select("file_id", "old_id")
    both = pairs.join(packed, "file_id").join(packed.select(F.col("file_id").alias("old_id"), F.col("fields").alias("before")), "old_id")
    both = both.select("file_id", _comparable("fields", "before").alias("fields"), _comparable("before", "fields").alias("before"))
    names, before = F.transform("fields", lambda x: x["field"]), F.transform("before", lambda x: x["field"])
    types = F.map_from_entries(F.transform("before", lambda x: F.struct(x["field"], x["type"])))
    compared = both.select(
        "file_id",
        F.filter("before", lambda x: ~F.array_contains(names, x["field"])).alias("gone"),
        F.filter("fields", lambda x: ~F.array_contains(before, x["field"])).alias("new"),
        F.transform(F.filter("fields", lambda x: x["type"] != F.element_at(types, x["field"])), lambda x: x["field"]).alias("retyped"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _pair(pdf)

    schema = "file_id long, change_kind string, field_name string, old_field_name string, score double"
    return compared.filter("size(gone) + size(new) + size(retyped) > 0").mapInPandas(run, schema)


def changes(records: DataFrame, files: DataFrame, sources: tuple[str, ...] = ("phmsa", "oisd", "export"), space: Workspace | None = None) -> DataFrame:
    """``changes_between`` of the files of some sources; records are read once."""
    space = space or Workspace(records.sparkSession, "p1")
    return changes_between(file_fields(records, files, sources, space), files, sources)


def aliases(changed: DataFrame, packed: DataFrame, files: DataFrame, source: str, most: int = MOST_NAMES) -> dict[str, str]:
    """Canonical name of each field name of a source: the most delivered name of its rename class.

    Two names that stand in one file are two fields, whatever the renames say, and are never merged. Renames and
    headers are the schema's vocabulary, not data; more than ``most`` of either is an error.
    """
    own = _sources(files, (source,)).select(F.col("file_id").cast("long").alias("file_id")).distinct()
    links = changed.filter("change_kind = 'renamed'").join(own, "file_id", "left_semi").groupBy("old_field_name", "field_name").count().limit(most + 1).collect()
    sets = packed.join(own, "file_id", "left_semi").select(F.sort_array(F.transform("fields", lambda x: x["field"])).alias("names")).distinct().limit(most + 1).collect()
    if max(len(links), len(sets)) > most:
        raise ValueError(f"more than {most} distinct renames or headers in {source}: its field names aren't a vocabulary")
    seen: dict[str, int] = {}
    for a, b, n in links:
        seen[a], seen[b] = seen.get(a, 0) + n, seen.get(b, 0)
    members = {x: {x} for x in seen}
    of = {x: x for x in seen}
    beside: dict[str, set[str]] = {x: set() for x in seen}
    for (names,) in sets:
        held = [x for x in names if x in of]
        for x in held:
            beside[x].update(held)
    for a, b, _ in sorted(links, key=lambda r: (-r[2], r[0], r[1])):
        x, y = of[a], of[b]
        if x == y or any(m in beside[k] for k in members[x] for m in members[y]):
            continue
        keep, drop = sorted((x, y), key=lambda v: (-seen[v], v))
        for m in members.pop(drop):
            members[keep].add(m)
            of[m] = keep
    return of


def _record_maps(pdf: pd.DataFrame, names: dict[str, str]) -> pd.DataFrame:
    """One row per sound record; of two values under one canonical name that of the canonical or smaller raw name stays, the other goes to ``collisions``."""
    cells = batch_cells(pdf)
    held = cells.held()
    fields: dict[int, dict] = {}
    types: dict[int, dict] = {}
    other: dict[int, dict] = {}
    raw: dict[tuple[int, str], str] = {}
    for r, path, kind, text in zip(cells.row[held].tolist(), cells.path[held], cells.kind[held].tolist(), cells.text.take(pa.array(held)).to_pylist()):
        name = names.get(path, path)
        mine = fields.setdefault(r, {})
        if name in mine:
            first = raw[r, name]
            if name != path and (first == name or first <= path):
                other.setdefault(r, {})[path] = text
                continue
            other.setdefault(r, {})[first] = mine[name]
        raw[r, name] = path
        mine[name] = text
        types.setdefault(r, {})[name] = TYPES[kind]
    rows = list(fields)
    out = pdf.loc[rows, ["file_id", "line_no"]].copy()
    for column, values in (("fields", fields), ("raw_types", types), ("collisions", other)):
        out[column] = pd.Series([values.get(r, {}) for r in rows], index=out.index, dtype=object)
    return out


def consistent_rows(records: DataFrame, files: DataFrame, source: str, names: dict[str, str]) -> DataFrame:
    """(file_id, line_no, fields, raw_types, collisions) of every sound record with canonical field names: the table as maps."""
    own = _sources(files, (source,))
    rows = raw_rows.with_headers(records.join(own.select("file_id").distinct(), "file_id", "left_semi"), own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _record_maps(pdf.reset_index(drop=True), names)

    maps = "fields map<string,string>, raw_types map<string,string>, collisions map<string,string>"
    return rows.mapInPandas(run, f"file_id long, line_no long, {maps}").dropDuplicates(["file_id", "line_no"])


def consistent_table(records: DataFrame, files: DataFrame, source: str, space: Workspace, packed: DataFrame | None = None, most: int = MOST_COLUMNS) -> DataFrame:
    """One typed row per sound record: a column per canonical field, ``cast_failures`` (field -> text that doesn't cast) and ``collisions``.

    A column is bigint, double or boolean if at least nine tenths of its values cast so, else string. Beyond the
    ``most`` fullest fields the values stay in the map ``other_fields``, which holds nothing otherwise.
    """
    packed = file_fields(records, files, (source,), space) if packed is None else packed
    changed = space.cut(changes_between(packed, files, (source,)), "changes")
    # what the records hold is written once: its types are counted and its columns projected
    long = space.cut(consistent_rows(records, files, source, aliases(changed, packed, files, source)), "rows")
    flat = long.select(F.explode("fields").alias("field", "value"))
    number = F.col("value").rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$")
    ok = {"bigint": F.expr("try_cast(value as bigint)").isNotNull() & F.col("value").rlike(r"^\s*[+-]?[0-9]+\s*$"), "double": number, "boolean": F.lower("value").isin("true", "false")}
    seen = flat.groupBy("field").agg(F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(t) for t, c in ok.items())).orderBy(F.desc("n"), "field").limit(most).collect()
    types = {r["field"]: next((t for t in ok if r[t] >= 0.9 * r["n"]), "string") for r in sorted(seen, key=lambda r: r["field"])}
    cast = {f: F.col("fields").getItem(f) if t == "string" else F.expr(f"try_cast(fields[{_sql(f)}] as {t})") for f, t in types.items()}
    failed = [F.when(c.isNull() & F.col("fields").getItem(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col("fields").getItem(f).alias("value"))) for f, c in cast.items() if types[f] != "string"]
    nothing = F.lit(None).cast(T.MapType(T.StringType(), T.StringType()))
    failures = F.map_from_entries(F.filter(F.array(*failed), lambda x: x.isNotNull())) if failed else nothing
    clean = {f: re.sub(r"\W+", "_", f.strip()).strip("_").lower() or "field" for f in types}
    taken: dict[str, int] = {"file_id": 1, "line_no": 1, "cast_failures": 1, "collisions": 1, "other_fields": 1}
    columns = []
    for f, c in cast.items():
        taken[clean[f]] = taken.get(clean[f], 0) + 1
        columns.append(c.alias(clean[f] if taken[clean[f]] == 1 else f"{clean[f]}_{taken[clean[f]]}"))
    rest = F.map_filter("fields", lambda k, v: ~F.array_contains(F.lit(list(types)), k)) if len(types) >= most else F.create_map().cast("map<string,string>")
    return long.select("file_id", "line_no", *columns, failures.alias("cast_failures"), "collisions", rest.alias("other_fields"))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
