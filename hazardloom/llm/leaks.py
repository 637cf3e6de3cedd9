"""Problem 8: evaluation passages inside training text.

The test items are the index, the corpus is the queries: an inverted index with BM25 weights and block maxima
is built over the passages (in shards of bounded size) and sent to every task once. Each document is cut into
overlapping windows; a window whose known terms could reach the least threshold at all (told in vectors for a
whole batch) asks the index with block-max WAND for the items above theirs, and what comes back is verified word
by word. The threshold loses nothing: per item it is the least score that any
window can have that holds a reportable part, which is the minimum over the item's own word windows.

The terms are shingles (3 words, 4 characters), which texts that share no passage hardly have in common.

A case: 12 consecutive words of a passage, or 24 and more consecutive words of it of which at most one in ten
is replaced, dropped or added (an added word counts as one edit). Words are runs of letters, marks and digits,
compared without case. Passages in Chinese are compared as streams of letters and digits, 30 in a row.

Defined cases: null and empty texts and passages match nothing; texts of any length are read whole; repeated
documents each get their rows, repeated rows one; an empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from operator import itemgetter, sub

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.storage import spread

RUN, SPAN, CHARS = 12, 24, 30
#: Windows of a document; the overlap holds the longest stretch that a verdict may rest on (24 words and 4 additions).
WINDOW, STRIDE = 64, 32
CHAR_WINDOW, CHAR_STRIDE = 128, 64
#: Signs of passages in one index: some 170,000 words, about 100 MB where it is held. More items are more shards.
SHARD_CHARS = 1_000_000
K1, B, BLOCK = 1.2, 0.75, 16
#: Any case has so many equal words in a row: e edits leave e + 1 runs of at least 9 e words together, e = 3 being the worst.
SEED = 7
#: Any near part has in some stretch of so many words of the document so many of its shingles: each edit breaks three of L - 2.
DENSE = (52, 15)
#: Words and characters of a term.
SHINGLE, CHAR_SHINGLE = 3, 4

_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_HAN = regex.compile(r"\p{Han}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFC", text).casefold()) if text else []


def chars_of(text: str | None) -> str:
    return "".join(words_of(text))


@dataclass
class Index:
    """Postings (item position, weight) by term with the maximum of each block and list, and per item its words and threshold."""

    ids: list[int]
    words: list
    terms: list[list]
    postings: dict[str, tuple[list[int], list[float]]] = field(default_factory=dict)
    block_max: dict[str, list[float]] = field(default_factory=dict)
    list_max: dict[str, float] = field(default_factory=dict)
    threshold: list[float] = field(default_factory=list)
    least: float = math.inf
    seeds: dict[int, dict] = field(default_factory=dict)
    sets: dict[int, set] = field(default_factory=dict)

    def runs(self, k: int) -> dict:
        """Where each run of ``SEED`` words of an item begins, made when it is first asked for."""
        if k not in self.seeds:
            at = self.seeds[k] = defaultdict(list)
            for i, run in enumerate(shingles(self.words[k], SEED)):
                at[run].append(i)
        return self.seeds[k]

    def term_set(self, k: int) -> set:
        if k not in self.sets:
            self.sets[k] = set(self.terms[k])
        return self.sets[k]


def shingles(units, size: int) -> list:
    return [tuple(units[i : i + size]) for i in range(len(units) - size + 1)] if isinstance(units, list) else [units[i : i + size] for i in range(len(units) - size + 1)]


def build_index(items: list[tuple[int, object]], size: int, run: int, span: int | None, edits: int) -> Index:
    """``run``: units of the shortest exact part. ``span``: units of a near part with ``edits`` edits, each breaking ``size`` shingles."""
    items = [(i, t) for i, t in items if len(t) >= run]
    run, span, lost = run - size + 1, span and span - size + 1, edits * size
    index = Index([i for i, _ in items], [t for _, t in items], [shingles(t, size) for _, t in items])
    n = len(items)
    if not n:
        return index
    mean = sum(len(t) for t in index.terms) / n
    df = Counter(t for terms in index.terms for t in set(terms))
    weight: list[dict] = []
    for terms in index.terms:
        norm = K1 * (1 - B + B * len(terms) / mean)
        weight.append({t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(terms).items()})
    lists: dict = defaultdict(list)
    for k, w in enumerate(weight):
        for t, x in w.items():
            lists[t].append((k, x))
        terms = index.terms[k]
        low = min(sum(w[t] for t in set(terms[i : i + run])) for i in range(len(terms) - run + 1))
        if span and len(terms) >= span:
            for i in range(len(terms) - span + 1):
                held = [w[t] for t in set(terms[i : i + span])]
                low = min(low, sum(held) - sum(heapq.nlargest(lost, held)))
        index.threshold.append(low * (1 - 1e-9))
    index.postings = {t: ([k for k, _ in p], [x for _, x in p]) for t, p in lists.items()}
    index.block_max = {t: [max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for t, p in lists.items()}
    index.list_max = {t: max(b) for t, b in index.block_max.items()}
    index.least = min(index.threshold)
    return index


def above_threshold(index: Index, query: set) -> list[int]:
    """Positions of all items whose score reaches their threshold: document-at-a-time WAND with block maxima."""
    least = index.least
    cursors = []  # [item, position, items, weights, block maxima, list maximum]
    bound = 0.0
    for t in query:
        most = index.list_max.get(t)
        if most is not None:
            items, weights = index.postings[t]
            cursors.append([items[0], 0, items, weights, index.block_max[t], most])
            bound += most
    found: list[int] = []
    if bound < least:
        return found
    thresholds = index.threshold
    first = itemgetter(0)
    while True:
        cursors.sort(key=first)
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += c[5]
            if bound >= least:
                pivot = k
                break
        if pivot < 0:
            return found
        item = cursors[pivot][0]
        n = len(cursors)
        while pivot + 1 < n and cursors[pivot + 1][0] == item:
            pivot += 1
        moved = cursors[: pivot + 1]
        if moved[0][0] == item:
            if sum([c[4][c[1] // BLOCK] for c in moved]) >= thresholds[item] and sum([c[3][c[1]] for c in moved]) >= thresholds[item]:
                found.append(item)
            target = item + 1
        else:
            # block maxima of the lists that may hold the pivot; below its own threshold it is passed, below the least of all the blocks are
            ends, high = math.inf, 0.0
            for c in moved:
                items = c[2]
                b = bisect_left(items, item, c[1]) // BLOCK
                if b < len(c[4]):
                    high += c[4][b]
                    ends = min(ends, items[min(len(items), (b + 1) * BLOCK) - 1] + 1)
            following = cursors[pivot + 1][0] if pivot + 1 < n else math.inf
            target = item if high >= thresholds[item] else item + 1 if high >= least else max(item + 1, min(ends, following))
        gone = False
        for c in moved:
            if c[0] < target:
                k = bisect_left(c[2], target, c[1])
                c[1] = k
                if k < len(c[2]):
                    c[0] = c[2][k]
                else:
                    c[0], gone = math.inf, True
        if gone:
            cursors = [c for c in cursors if c[0] != math.inf]
            if not cursors:
                return found


def holds_part(doc: list[str], item: list[str], run: int = RUN, span: int = SPAN, near: set[int] | None = None) -> bool:
    """Whether ``doc`` has ``run`` consecutive words of ``item``, or ``span`` with at most a tenth of them edited.

    Dynamic programming over equal word pairs: for each pair and number of edits, the earliest word of the item
    that a stretch ending there can begin with. Between two pairs lie as many edits as the longer gap has words.
    ``near``: only pairs on these diagonals (item minus doc) are looked at.
    """
    at: dict[str, list[int]] = defaultdict(list)
    for k, w in enumerate(item):
        at[w].append(k)
    most = len(item) // 10
    reach = most + 1
    state: dict[tuple[int, int], tuple[int, list[int]]] = {}  # (doc, item) -> run length, earliest start by edits
    recent: list[list[int]] = []
    for j, w in enumerate(doc):
        here = at.get(w, [])
        if near is not None and here:
            here = [i for i in here if i - j in near]
        for i in here:
            before = state.get((j - 1, i - 1))
            length = before[0] + 1 if before else 1
            if length >= run:
                return True
            starts = list(before[1]) if before else [i] + [i + 1] * most
            starts[0] = min(starts[0], i)
            for dj in range(1, reach + 1):
                if j - dj < 0:
                    break
                for i2 in recent[j - dj]:
                    di = i - i2
                    if di < 1 or di > reach:
                        continue
                    e = max(dj, di) - 1
                    if e:
                        old = state[(j - dj, i2)][1]
                        for k in range(most + 1 - e):
                            if old[k] < starts[k + e]:
                                starts[k + e] = old[k]
            state[(j, i)] = (length, starts)
            for e in range(most + 1):
                size = i - starts[e] + 1
                if size >= span and 10 * e <= size:
                    return True
        recent.append(here)
        if j > reach + 1:
            for i in recent[j - reach - 1]:
                state.pop((j - reach - 1, i), None)
            recent[j - reach - 1] = []
    return False


def _windows(n: int, width: int, stride: int) -> range:
    return range(0, max(1, n - (width - stride)), stride)


def _asked(index: Index, units, size: int, width: int, stride: int, starts: set[int] | None = None) -> Iterator[tuple[int, int]]:
    """(start of a window, item position) of everything the index returns for the windows of a document, or those that begin at ``starts``."""
    terms = shingles(units, size)
    known = [k for k, t in enumerate(terms) if t in index.list_max]
    if not known:
        return
    first = 0
    for start in _windows(len(units), width, stride):
        if starts is not None and start not in starts:
            continue
        while first < len(known) and known[first] < start:
            first += 1
        k, query = first, set()
        while k < len(known) and known[k] <= start + width - size:
            query.add(terms[known[k]])
            k += 1
        if query:
            for item in above_threshold(index, query):
                yield start, item


def _in_words(text: str, index: Index, starts: set[int] | None = None) -> set[int]:
    doc = words_of(text)
    found: set[int] = set()
    seen: dict[int, int] = {}  # item -> end of the stretch that is verified already
    long, short = shingles(doc, SEED), shingles(doc, SHINGLE)
    for start, k in _asked(index, doc, SHINGLE, WINDOW, STRIDE, starts):
        end = min(len(doc), start + WINDOW)
        if index.ids[k] in found or seen.get(k, -1) >= end:
            continue
        item = index.words[k]
        wide = len(item) + len(item) // 10
        low, high = max(0, start - wide), min(len(doc), end + wide)
        seen[k] = high if high == len(doc) else end
        seeds = index.runs(k)
        if not seeds.keys().isdisjoint(long[low : high - SEED + 1]) and _verified(doc[low:high], item, long[low : high - SEED + 1], short[low : high - SHINGLE + 1], seeds, index.term_set(k)):
            found.add(index.ids[k])
    return found


def _verified(part: list[str], item: list[str], long: list, short: list, seeds: dict, terms: set) -> bool:
    """The exact check. Any case has ``SEED`` equal words in a row, and its other words lie no further from that diagonal than edits shift them."""
    runs: dict[int, tuple[int, int]] = {}  # diagonal -> end and length of its last run
    for j in [j for j, run in enumerate(long) if run in seeds]:
        for i in seeds[long[j]]:
            last, length = runs.get(i - j, (-2, 0))
            length = length + 1 if last == j - 1 else SEED
            if length >= RUN:
                return True
            runs[i - j] = (j, length)
    sums = list(accumulate(map(terms.__contains__, short), initial=0))
    width = min(DENSE[0], len(short))
    if not width or max(map(sub, sums[width:], sums)) < DENSE[1]:
        return False
    shift = len(item) // 10
    return holds_part(part, item, near={d + k for d in runs for k in range(-shift, shift + 1)})


def _in_chars(text: str, index: Index, starts: set[int] | None = None) -> set[int]:
    doc = chars_of(text)
    found: set[int] = set()
    for start, k in _asked(index, doc, CHAR_SHINGLE, CHAR_WINDOW, CHAR_STRIDE, starts):
        if index.ids[k] not in found:
            part = doc[start : start + CHAR_WINDOW]
            if any(part[i : i + CHARS] in index.words[k] for i in range(len(part) - CHARS + 1)):
                found.add(index.ids[k])
    return found


_PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Screen:
    """What an index knows, for vectors: hashed terms in order, the greatest weight a term can add, and the least threshold."""

    vocabulary: dict
    terms: np.ndarray
    most: np.ndarray
    least: float


def _hashed(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` units from each position on; two terms of one hash only ask the index once too often."""
    h = np.zeros(max(0, len(ids) - size + 1), dtype=np.uint64)
    for k in range(size):
        h = (h ^ ids[k : k + len(h)].astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def make_screen(index: Index) -> Screen:
    vocabulary: dict = {}
    terms, most = [], []
    for t, x in index.list_max.items():
        ids = np.array([vocabulary.setdefault(u, len(vocabulary)) for u in t], dtype=np.int64)
        terms.append(int(_hashed(ids, len(t))[0]))
        most.append(x)
    terms, most = np.array(terms, dtype=np.uint64), np.array(most, dtype=float)
    order = np.lexsort((-most, terms))  # of two terms with one hash the heavier comes first
    return Screen(vocabulary, terms[order], most[order], index.least)


def _may_hold(screen: Screen, units: pa.Array, of: np.ndarray, size: int, width: int, stride: int) -> dict[int, set[int]]:
    """Per document the starts of the windows whose known terms could reach the least threshold. ``units``: words or signs, ``of``: their document."""
    found: dict[int, set[int]] = {}
    if len(units) < size or not len(screen.terms):
        return found
    coded = units.dictionary_encode()
    known = np.array([screen.vocabulary.get(u, -1) for u in coded.dictionary.to_pylist()], dtype=np.int64)
    ids = known[np.asarray(coded.indices)]
    h = _hashed(ids, size)
    inside = of[: len(h)] == of[size - 1 :]
    for k in range(size):
        inside &= ids[k : k + len(h)] >= 0
    at = np.minimum(np.searchsorted(screen.terms, h), len(screen.terms) - 1)
    worth = np.where(inside & (screen.terms[at] == h), screen.most[at], 0.0)
    total = np.concatenate([[0.0], np.cumsum(worth)])
    # windows begin at every stride of a document, counted from its first unit
    first = np.searchsorted(of, of[: len(h)], side="left")
    offset = np.arange(len(h)) - first
    begins = np.flatnonzero(offset % stride == 0)
    ends = np.minimum(begins + width - size + 1, len(h))
    last = np.searchsorted(of, of[begins], side="right")
    ends = np.maximum(begins, np.minimum(ends, last - size + 1))
    held = total[np.minimum(ends, len(h))] - total[begins]
    passed = begins[held >= screen.least * (1 - 1e-6)]
    for doc, start in zip(of[passed].tolist(), offset[passed].tolist()):
        found.setdefault(doc, set()).add(start)
    return found


def _candidates(texts: list, words: tuple[Index, Screen], chars: tuple[Index, Screen]) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
    """Windows by text that may hold a part of a spaced and of a Chinese item."""
    plain = pa.array([unicodedata.normalize("NFC", t).casefold().encode("utf-8", "replace").decode() if t else "" for t in texts], pa.large_string())
    lists = pc.split_pattern_regex(plain, r"[^\p{L}\p{M}\p{Nd}]+")
    of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    flat = lists.flatten()
    real = np.asarray(pc.not_equal(flat, "")).astype(bool)
    of, flat = of[real], flat.filter(pa.array(real))
    in_words = _may_hold(words[1], flat, of, SHINGLE, WINDOW, STRIDE)
    in_chars: dict[int, set[int]] = {}
    if chars[0].ids:
        han = np.flatnonzero(np.asarray(pc.match_substring_regex(plain, r"\p{Han}")).astype(bool))
        units = [list(chars_of(texts[k])) for k in han]
        of = np.repeat(np.arange(len(han)), [len(u) for u in units])
        passed = _may_hold(chars[1], pa.array([c for u in units for c in u], pa.string()), of, CHAR_SHINGLE, CHAR_WINDOW, CHAR_STRIDE)
        in_chars = {int(han[k]): starts for k, starts in passed.items()}
    return in_words, in_chars


def _one_shard(docs: DataFrame, rows: list, schema: str) -> DataFrame:
    chinese = [(r[0], chars_of(r[2])) for r in rows if (r[1] or "").lower().startswith("zh")]
    spaced = [(r[0], words_of(r[2])) for r in rows if not (r[1] or "").lower().startswith("zh")]
    indexes = build_index(spaced, SHINGLE, RUN, SPAN, 4), build_index(chinese, CHAR_SHINGLE, CHARS, None, 0)
    shared = docs.sparkSession.sparkContext.broadcast(tuple((i, make_screen(i)) for i in indexes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, chars = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            in_words, in_chars = _candidates(texts, words, chars)
            out = []
            ids = pdf["doc_id"].tolist()
            for k in sorted(in_words.keys() | in_chars.keys()):
                found = _in_words(texts[k], words[0], in_words[k]) if k in in_words else set()
                if k in in_chars:
                    found |= _in_chars(texts[k], chars[0], in_chars[k])
                out += [(ids[k], i) for i in sorted(found)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return docs.mapInPandas(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id). ``docs``: doc_id, text. ``items``: item_id, lang, passage.

    Items are dealt by hash into shards of about ``shard_chars`` signs of passages; each shard is one index and one pass.
    """
    told = items.select("item_id", "lang", "passage").filter("item_id is not null and passage is not null").distinct()
    size = told.agg(F.sum(F.length("passage"))).first()[0] or 0
    shards = max(1, -(-size // shard_chars))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}"
    texts = spread(docs.select("doc_id", "text"))
    out = None
    for k in range(shards):
        one = _one_shard(texts, told.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect(), schema)
        out = one if out is None else out.union(one)
    return out.distinct()
