"""Problem 10: sentence boundaries by a hidden-event n-gram model.

Between any two words of a text (signs, in scripts without spaces) stands a hidden event, boundary or none. What is
seen of an event is its separator: a mark with its quotes, a space between Thai letters, plain white space, nothing.
The model multiplies, gap by gap, P(boundary | word and separator before), P(form of what follows | event, separator)
and P(next word | boundary) against P(next word | word before, none), and chains the events by a transition that
depends on the event before and the words in between. Posteriors come from forward-backward over all gaps of a document.

Nothing is labelled. Blank lines show which marked words end sentences (a word whose full stop never stands before
a blank line is an abbreviation, in any script) and which words begin them; n-gram counts over the words of all
documents say what follows what inside sentences; EM over all documents learns the rest, transitions and forms
included. All tables stay distributed and are joined by key, hot keys with salts.

Evidence is bounded, so a gap without any mark in a paragraph that has marks can never reach one half: such gaps are
decided without being carried. In a paragraph without a single mark that is too long for one sentence or heading
(``BARE_WORDS`` words, ``BARE_SIGNS`` signs, or spaces between signs of scripts without spaces) every gap is carried.

Defined cases: null, empty and blank texts have no units; offsets count code points; a blank line always is a
boundary; a text cut off at either end gives its rest as a unit; texts of any length are read whole, in linear time;
equal texts under several ids each get their rows, a repeated id with the same text gives one set; other columns are
ignored. The model reads each distinct text once, so copies are no evidence: a table and its copies give the same units.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.operators.skew import HOT_ROWS, counted, join_hot
from hazardloom.storage import Workspace, spread

_BLANK = re.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+\s*")
_MARK = re.compile(r"\.{2,}|…+|[.!?؟。！？।॥۔｡]+|(?<=[ऀ-ॿ])\|+")
#: The run of word signs that ends here, read backwards.
_RUN_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}_]+")
#: A word that a full stop without a space may part from the next sentence.
_GLUES = regex.compile(r"(?r)[\p{Ll}\p{N}]\p{M}*\p{Ll}")
_NEXT = regex.compile(r"([\"“„«「『(（\[¿¡‘‚‹]*)\s?([\p{L}\p{M}\p{N}_]+|.)", regex.S)
_THAI_GAP = re.compile(r"(?<=[ก-ฮะ-ฺเ-ๅ็-๎])[^\S\n]*(?:\n)?[^\S\n]+(?=[ก-ฮะ-ฺเ-ๅ])|(?<=[ก-ฮะ-ฺเ-ๅ็-๎])\n(?=[ก-ฮะ-ฺเ-ๅ])")
_THAI_SIGN = re.compile(r"[\u0e00-\u0e7f]")
_DIGITS = re.compile(r"[0-9]+")
_WIDE = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af"
_CASELESS_WIDE = re.compile(r"[　-鿿豈-﫿가-힯]")
_WIDE_SIGN = re.compile(f"[{_WIDE}]")
_CLOSE = set(")]”’»›」』）】》｣")
_OPENERS = set("\"“„«「『‘‹(¿¡")
_OPEN_QUOTES = "\"“„«「『‘‹"
_NEVER_BEFORE = set(",;:)]}»”’…،؛，；：、）」』】–—-/%")
#: Event fractions of a marked word: from an abbreviation that hardly ever ends a sentence to a word that always does.
_GRID = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)
#: Weight of a witness for or against a marked word.
_TEMPER, _WITNESSES = 0.7, 30.0
#: Prior observations behind the next word's evidence at sentence heads and inside, and its bounds in log odds.
_SMOOTH, _SMOOTH_INSIDE, _BOUND = 2.0, 20.0, 8.0
#: Distinct places of a pair at which its evidence counts half.
_TRUST = 12.0
#: Words of a paragraph without marks from which on its gaps are carried, and signs in scripts without spaces.
BARE_WORDS, BARE_SIGNS = 24, 40
#: Share of gaps without a mark that are boundaries, before anything is known of the word; between spaced wide signs.
_BARE, _BARE_WIDE = 0.06, 0.75
EM_STEPS = 2

#: Separators and the forms of what follows them; a gap's form is FORMS * separator + form.
STRONG, ELLIPSIS, PERIOD, THAI, BARE = range(5)
LOWER, UPPER, OPENER, DIGIT, OTHER = range(5)
FORMS = 5
#: Log odds of a form after a boundary against none, from which EM starts, and the sightings they are worth.
_FORM_ODDS = np.zeros(25)
for _k in (STRONG, ELLIPSIS, PERIOD):
    _FORM_ODDS[FORMS * _k : FORMS * _k + 5] = (-2.5, 1.5, 1.0, -0.5 if _k == STRONG else -2.0, 0.0)
_FORM_PRIOR = 400.0
#: Words between two gaps: 1, 2, 3-4, 5-8, 9-16, more; the last one stands for gaps after a certain boundary.
DISTANCES, FRESH = 7, 6
#: Log odds that the event before adds, (none, boundary) x distance: a mark on the very next word seldom ends a sentence.
_TRANSITIONS = np.zeros((2, DISTANCES))
_TRANSITIONS[1, 0] = -4.0
_TRANSITION_PRIOR = 200.0
#: Part of a learnt transition that counts, as key and word tell some of the same.
_CHAIN_TEMPER = 0.4

_SCHEMA = "doc_id {}, kind string, at int, stop int, next int, key long, word long, p0 double, form int, distance int, place int"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def _closes(text: str, k: int, low: int) -> bool:
    """Whether the quote at k, right after a mark, closes: before white space or a mark it does, before a word by parity."""
    if k + 1 >= len(text) or not (text[k + 1].isalnum() or text[k + 1] in _OPEN_QUOTES):
        return True
    if text[k] == '"':
        return text.count('"', low, k) % 2 == 1
    return text.count("„", low, k) > text.count("“", low, k)


def _quote_kind(text: str, start: int, low: int) -> str:
    """How the quotation that ends here began: L at the head of a sentence, I after a colon or comma, M within one."""
    k = max(text.rfind(c, low, start) for c in _OPEN_QUOTES)
    if k < 0:
        return "M"
    k -= 1
    while k >= low and text[k].isspace():
        k -= 1
    if k < low:
        return "L"
    return "L" if _MARK.match(text[k]) or text[k] in _CLOSE or text[k] == '"' else "I" if text[k] in ":,：，،" else "M"


def _distance(text: str, start: int, stop: int) -> int:
    """Class of the number of words in text[start:stop]; two wide signs count as a word."""
    n = text.count(" ", start, stop) + 1
    if n < 4 and stop - start > 12 * n:
        n = max(n, (stop - start) // 2 if _CASELESS_WIDE.match(text[stop - 1]) else n)
    return 0 if n <= 1 else 1 if n == 2 else 2 if n <= 4 else 3 if n <= 8 else 4 if n <= 16 else 5


def _form(c: str) -> int:
    return LOWER if c.islower() else UPPER if c.isupper() else OPENER if c in _OPENERS else DIGIT if c.isdigit() else OTHER


def scan(text: str) -> list[tuple]:
    """(kind, at, stop, next, key, word, p0, form, distance, place) of the carried gaps of a text, in order.

    kind: ``text`` (its trimmed bounds), ``hard`` (blank line) or ``open`` (to be decided). stop is where a unit
    would end, next where the following one would begin.
    """
    n = len(text)
    first, last = n - len(text.lstrip()), len(text.rstrip())
    if first >= last:
        return []
    out = [("text", -1, last, first, None, _hash(_next_word(text, first)[0]), 1.0, None, FRESH, None)]
    blanks = [(m.start(), m.end()) for m in _BLANK.finditer(text, first, last)]
    lows = [first, *(b for _, b in blanks)]
    ends = [*(a for a, _ in blanks), last]
    thai = _THAI_SIGN.search(text) is not None
    for number, (low, high) in enumerate(zip(lows, ends)):
        previous_end, previous_gap, chain, marks = -1, -1, "", 0
        tail = None
        gaps_ = [*_MARK.finditer(text, low, high)]
        if thai:
            gaps_ = sorted([*gaps_, *_THAI_GAP.finditer(text, low, high)], key=lambda m: m.start())
        since, piece_before = low, 0
        for m in gaps_:
            start, stop = m.span()
            mark = m[0]
            if mark.isspace():
                word = _hash(_next_word(text, stop)[0])
                here, place = _place(text, since, start, piece_before)
                out.append(("open", start, start, stop, _hash("space"), word, 0.9999, FORMS * THAI + OTHER, FRESH if previous_gap < 0 else _distance(text, previous_gap, start), place))
                previous_gap = since = stop
                piece_before = here
                marks += 1
                continue
            after = text[stop] if stop < high else ""
            run = _RUN_BEFORE.match(text, max(low, previous_end), start)
            piece = run[0] if run else ""
            # a dotted word grows mark by mark, so that it is read once; a full stop between two glued sentences parts it
            if chain and piece and start - len(piece) == previous_end and not (piece[0].isupper() and _GLUES.match(text, low, previous_end - 1)):
                raw = chain + piece
            else:
                raw = piece
            joined = previous_gap >= 0 and start - previous_gap <= len(raw) + 1
            # what the next mark may continue, kept short: the hash of a long chain stands for it
            chain = (raw if len(raw) <= 64 else f"{_hash(raw):x}") + "." if raw and mark == "." else ""
            previous_end = stop
            if mark == "." and start > low and text[start - 1].isdigit() and after.isdigit():
                continue
            marks += 1
            quoted = False
            while stop < high:
                c = text[stop]
                if c in _CLOSE or c in '"“' and _closes(text, stop, low):
                    quoted |= c not in ")]）】"
                    stop += 1
                elif c in " \u00a0\u202f\u2009" and stop + 1 < high and text[stop + 1] == "»":
                    quoted = True
                    stop += 2
                else:
                    break
            following = stop
            while following < high and text[following].isspace():
                following += 1
            word = _DIGITS.sub("0", raw.lower())
            strong = any(c in "!?؟。！？।॥۔｡|" for c in mark)
            ellipsis = not strong and (len(mark) > 1 or "…" in mark)
            sort = STRONG if strong else ELLIPSIS if ellipsis else PERIOD
            kind = _quote_kind(text, start, low) if quoted else ""
            key = _hash(("!" if strong else "…" if ellipsis else word + ".") + kind + ("w" if start > low and _CASELESS_WIDE.match(text[start - 1]) else ""))
            plain = len(word) > 3 and not any(c in ".0" for c in word)
            p0 = (0.5 if kind == "L" else 0.97) if strong else 0.2 if ellipsis else 0.95 if plain or word[-1:] == "0" else 0.6
            distance = FRESH if previous_gap < 0 else 0 if joined and not strong else max(1, _distance(text, previous_gap, start))
            if following >= high:
                tail = (key, p0, distance, _place(text, since, start, piece_before)[1])
                break
            nxt, c = _next_word(text, following)
            spaced = following > stop
            if c in _NEVER_BEFORE or c.islower() and (quoted or ellipsis):
                continue
            if not spaced and not _CASELESS_WIDE.match(c):
                if c.isdigit() or c.islower() or len(word) == 1 and word.isalpha() and not strong or "." in word and not strong and not c.isupper():
                    continue
                if not strong and not c.isupper() and c.isascii() and c.isalpha():
                    continue
            here, place = _place(text, since, start, piece_before)
            out.append(("open", start, stop, following, key, _hash(nxt), p0, FORMS * sort + _form(c), distance, place))
            previous_gap = since = stop
            piece_before = here
        if not marks:
            out += _bare_gaps(text, low, high)
        if high < last:
            begin = lows[number + 1]
            key, p0, distance, place = tail or (None, 1.0, FRESH, None)
            out.append(("hard", high, high, begin, key, _hash(_next_word(text, begin)[0]), p0, None, distance, place))
    return out


_BARE_SPACE = re.compile(r"(?<=\S)\s+(?=\S)")


def _bare_gaps(text: str, low: int, high: int) -> list[tuple]:
    """All gaps of a paragraph without marks that is too long to be one unit for sure."""
    spaces = [m.span() for m in _BARE_SPACE.finditer(text, low, high)]
    between = [(a, b) for a, b in spaces if _WIDE_SIGN.match(text[a - 1]) and _WIDE_SIGN.match(text[b])]
    wide = bool(between) or not spaces and high - low >= BARE_SIGNS and bool(_WIDE_SIGN.match(text[low]))
    if wide:
        spots = between if len(between) > 1 and high - low >= 12 else [(k, k) for k in range(low + 1, high)] if high - low >= BARE_SIGNS else []
    else:
        spots = spaces if len(spaces) + 1 >= BARE_WORDS else []
    out, before = [], low
    for a, b in spots:
        if wide:
            key, p0 = text[a - 1] + ".", _BARE_WIDE if a < b else _BARE
        else:
            run = _RUN_BEFORE.match(text, before, a)
            key, p0 = _DIGITS.sub("0", run[0].lower() if run else "") + ".", _BARE
        word, c = _next_word(text, b)
        if c not in _NEVER_BEFORE:
            out.append(("open", a, a, b, _hash(key), _hash(word), p0, FORMS * BARE + OTHER, FRESH if not out else _distance(text, out[-1][3], a), None))
        before = b
    return out


def _place(text: str, since: int, start: int, before: int) -> tuple[int, int]:
    """Hash of what stands between the gap before and the mark, digits alike, and the place: with the stretch before that one it tells copied passages from independent ones."""
    here = _hash(_DIGITS.sub("0", " ".join(text[since:start].split())))
    return here, (here ^ before * 31) & 0x7FFFFFFF


def _next_word(text: str, at: int) -> tuple[str, str]:
    """Key of the word that begins here (openers kept as one mark, digits as 0, two signs of wide scripts), and its first sign."""
    m = _NEXT.match(text, at)
    if not m:
        return "", " "
    w = m[2]
    w = w[:2] if _CASELESS_WIDE.match(w) else _DIGITS.sub("0", w)
    return ("<" if m[1] else "") + w, (m[1] or m[2])[0] if m[1] and m[1][0] in "¿¡" else m[2][0]


def gaps(docs: DataFrame) -> DataFrame:
    schema = _SCHEMA.format(dict(docs.dtypes)["doc_id"])
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], []
            for text in batch.column(1).to_pylist():
                found = scan(text)
                rows += found
                size.append(len(found))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size), pa.int64()))
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields))], names=["doc_id", *(n for n, _ in fields)])

    return spread(docs.select("doc_id", "text").filter("text is not null")).mapInArrow(run, schema)


#: Boundaries that may be sentence ends part the word n-grams; what is left between two of them is inside for sure.
_PARTS = r"[.!?…؟。！？।॥۔｡|]+|\n\s*\n"


def _batch_grams(texts: list[str]) -> pd.DataFrame:
    """(key, word, n): pairs of neighbours inside sentences, hashed as in ``scan``."""
    spaced = pc.replace_substring_regex(pa.array(texts, pa.large_string()), _PARTS, " \u0001 ")
    spaced = pc.replace_substring_regex(spaced, "([\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af])", r" \1 ")
    flat = pc.split_pattern_regex(spaced, r"[^\p{L}\p{M}\p{N}_\x01]+").flatten()
    flat = flat.filter(pc.not_equal(flat, ""))
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    ids = np.asarray(coded.indices).astype(np.int64)
    if len(ids) < 2:
        return pd.DataFrame({"key": np.zeros(0, np.int64), "word": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    wide = np.array([bool(_WIDE_SIGN.match(w)) for w in words])
    part = np.array([w == "\x01" for w in words])
    after = np.append(ids[2:], -1)  # the sign after the next word: wide words are two signs
    pair = wide[ids[1:]] & (after >= 0) & wide[after]
    inside = ~part[ids[:-1]] & ~part[ids[1:]]
    width = len(words) + 1
    code = ((ids[:-1] * width + ids[1:]) * width + np.where(pair, after, len(words)))[inside]  # fits 64 bits up to two million words a batch
    found, n = np.unique(code, return_counts=True)
    first, second, third = found // width // width, found // width % width, found % width
    plain = [_DIGITS.sub("0", w) for w in words]
    before = np.array([_hash(w.lower() + ".") for w in plain], dtype=np.int64)
    word = np.array([_hash(w) for w in plain], dtype=np.int64)[second]
    for k in np.flatnonzero(third < len(words)).tolist():
        word[k] = _hash(plain[second[k]] + plain[third[k]])
    return pd.DataFrame({"key": before[first], "word": word, "n": n})


def grams(docs: DataFrame, wanted: DataFrame, space: Workspace) -> DataFrame:
    """(key, word, n) over the words of all documents, for the pairs and words before that ``wanted`` (key, word) asks for; word null sums a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _batch_grams([t for t in pdf["text"] if t])

    found = spread(docs.select("text").filter("text is not null")).mapInPandas(run, "key long, word long, n long")
    asked = space.cut(found.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key", "word").agg(F.sum("n").alias("n")), "asked")
    keys = asked.groupBy("key").agg(F.sum("n").alias("n_before"))
    return wanted.join(asked, ["key", "word"], "left").join(keys, "key", "left").select("key", "word", F.coalesce("n", F.lit(0)).alias("n_inner"), F.coalesce("n_before", F.lit(0)).alias("n_before"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _lookup(values: np.ndarray, at: Column) -> Column:
    return F.get(F.array(*(F.lit(float(v)) for v in values)), at)


def _priors(marked: DataFrame, space: Workspace) -> DataFrame:
    """(key, prior): log odds of a boundary after each marked word, from blank lines."""
    # the share of true ends that stand before a blank line, from the marks that leave no doubt
    sure = marked.filter("p0 between 0.97 and 0.98").agg(F.count_if(F.col("kind") == "hard").alias("e"), F.count("*").alias("n")).first()
    r = min(0.6, (sure["e"] + 1) / (sure["n"] + 20))
    # copied passages are no independent witnesses: one place speaks for _WITNESSES sightings at most, in its own proportion
    places = marked.groupBy("key", "place").agg(F.sum((F.col("kind") == "open").cast("double")).alias("n"), F.sum((F.col("kind") == "hard").cast("double")).alias("ended"), F.avg("p0").alias("p"))
    part = F.least(F.lit(1.0), _WITNESSES / (F.col("n") + F.col("ended")))
    keys = places.groupBy("key").agg(F.sum(F.col("n") * part).alias("n"), F.sum(F.col("ended") * part).alias("ended"), F.avg("p").alias("p"))
    weight = lambda k: (0.96 * (1 - F.col("p")) if k == 0 else 0.96 * F.col("p") if k == len(_GRID) - 1 else F.lit(0.0)) + 0.04 / len(_GRID)
    logs = [F.log(weight(k)) + _TEMPER * (F.col("ended") * math.log(f * r) + F.col("n") * math.log(1 - f * r)) for k, f in enumerate(_GRID)]
    top = F.greatest(*logs)
    mean = sum((F.exp(x - top) * f for x, f in zip(logs, _GRID)), F.lit(0.0)) / sum((F.exp(x - top) for x in logs), F.lit(0.0))
    # a separator that leaves no doubt (a space between Thai letters) keeps its own odds
    sure_one = F.when(F.col("p") > 0.99, F.col("p")).otherwise(F.least(F.greatest(mean, F.lit(0.005)), F.lit(0.995)))
    return space.cut(keys.select("key", _logit(sure_one).alias("prior")), "keys")


def fit(docs: DataFrame, found: DataFrame, space: Workspace, steps: int = EM_STEPS) -> tuple[DataFrame, np.ndarray]:
    """(open gaps with the log odds ``score`` of a boundary, transitions)."""
    bare = FORMS * BARE
    opened = found.filter("kind = 'open'")
    keys = _priors(found.filter(f"key is not null and (form is null or form < {bare})"), space)
    sized = counted(opened, keys, "key", space)
    rows = join_hot(opened.filter(f"form < {bare}"), sized, "key", "n", stored=True)
    # gaps without a mark: how often the word before ends sentences elsewhere, against how often it goes on
    loose = opened.filter(f"form >= {bare}")
    inner = space.cut(grams(docs, loose.select("key", "word").distinct(), space), "grams")
    ends = found.filter(f"key is not null and (form is null or form < {bare})").join(loose.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_ends"))
    known = inner.join(ends, "key", "left").na.fill(0, ["n_ends"])
    loose = loose.join(known, ["key", "word"])
    share = (F.col("n_ends") + 4 * F.col("p0")) / (F.col("n_ends") + F.col("n_before") + 4)
    loose = loose.withColumn("prior", _logit(F.least(F.greatest(F.when(F.col("p0") == _BARE, share).otherwise(F.col("p0")), F.lit(0.005)), F.lit(0.9))))
    rows = rows.withColumns({"n_inner": F.lit(0).cast("long"), "n_before": F.lit(0).cast("long")})
    rows = rows.unionByName(loose.drop("n_ends")).withColumn("ratio", F.lit(0.0))
    rows = space.cut(rows.drop("kind"), "rows")
    heads = found.filter("kind in ('hard', 'text') and word is not null").groupBy("word").agg(F.count("*").cast("double").alias("s"))
    odds, chain = _FORM_ODDS.copy(), _TRANSITIONS.copy()
    for step in range(steps):
        scored = rows.withColumn("score", F.col("prior") + _lookup(odds, F.col("form")) + F.col("ratio"))
        if step == 0:
            counts_of = scored.withColumns({"post": 1 / (1 + F.exp(-F.col("score"))), "tells": F.lit(None).cast("array<double>")})
        else:
            counts_of = posteriors(scored, chain)
        known = space.cut(counts_of, "posteriors")
        odds, chain = _learnt(known, odds, chain)
        told = space.cut(_ratios(known, heads, space), "pairs")
        fresh = join_hot(known.drop("ratio", "score", "post", "tells").withColumn("pair", F.struct("key", "word")), told, "pair", "n_pair", stored=True).drop("pair")
        nxt = space.cut(fresh, "rows")
        space.drop(rows, known, told)
        rows = nxt
    return rows.withColumn("score", F.col("prior") + _lookup(odds, F.col("form")) + F.col("ratio")), chain


def _learnt(known: DataFrame, odds: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Form odds and transitions from the posteriors: a handful of sums. A parameter without sightings keeps its value."""
    per_form = known.groupBy("form").agg(F.sum("post").alias("b"), F.count("*").alias("n")).collect()
    b, none = np.zeros(25), np.zeros(25)
    for f, yes, n in per_form:
        b[f], none[f] = yes, n - yes
    out = odds.copy()
    for sort in (STRONG, ELLIPSIS, PERIOD):
        at = slice(FORMS * sort, FORMS * sort + OTHER)  # signs of scripts without case tell nothing and stay at 0
        seen = b[at] + none[at]
        if seen.sum() > 0:
            learnt = _TEMPER * np.log((b[at] + 1) / (b[at].sum() + OTHER) / ((none[at] + 1) / (none[at].sum() + OTHER)))
            out[at] = np.clip((learnt * seen + odds[at] * _FORM_PRIOR) / (seen + _FORM_PRIOR), -4, 4)
    # tells: by the event before (none, boundary) the expected boundaries and cases
    sums = [F.sum(F.coalesce(F.get("tells", F.lit(k)), F.lit(0.0))).alias(f"t{k}") for k in range(4)]
    new = chain.copy()
    told = {r["distance"]: r for r in known.filter("tells is not null").groupBy("distance").agg(*sums).collect() if r["distance"] != FRESH}
    logit = lambda yes, n: math.log((yes + 0.5) / (max(0.0, n - yes) + 0.5))
    usual = logit(sum(r["t0"] + r["t2"] for r in told.values()), sum(r["t1"] + r["t3"] for r in told.values()))
    for d, r in told.items():
        for s in (0, 1):
            yes, cases = r[f"t{2 * s}"], r[f"t{2 * s + 1}"]
            learnt = _CHAIN_TEMPER * (logit(yes, cases) - usual)
            new[s, d] = np.clip((learnt * cases + chain[s, d] * _TRANSITION_PRIOR) / (cases + _TRANSITION_PRIOR), -4, 4)
    return out, new


def _ratios(known: DataFrame, heads: DataFrame, space: Workspace) -> DataFrame:
    """(pair, ratio, n_pair): log P(word | boundary) - log P(word | word before, none) of every pair of a marked word and the next."""
    bare = FORMS * BARE
    pairs = space.cut(known.groupBy("key", "word").agg(F.sum("post").alias("s"), F.sum(1 - F.col("post")).alias("inside"), F.count("*").alias("n_pair"), F.countDistinct("place").alias("n_places"), F.max((F.col("form") >= bare).cast("int")).alias("bare"), F.max((F.col("p0") > 0.99).cast("int")).alias("sure"), F.max((F.col("form") < FORMS).cast("int")).alias("strong"), F.max("n_inner").alias("n_inner"), F.max("n_before").alias("n_before")), "pairs")
    of_words = pairs.groupBy("word").agg(F.sum("s").alias("s"), F.sum("n_pair").alias("n_word"), F.sum("inside").alias("inside_word"))
    words = space.cut(of_words.join(heads.withColumnRenamed("s", "headed"), "word", "left").select("word", (F.col("s") + F.coalesce("headed", F.lit(0.0))).alias("begins"), "n_word", "inside_word"), "words")
    inside = pairs.groupBy("key").agg(F.sum("inside").alias("inside_key"))
    all_begins, n_all, all_inside = (x or 1.0 for x in words.agg(F.sum("begins"), F.sum("n_word"), F.sum("inside_word")).first())
    usual = F.col("n_word") / F.lit(float(n_all))
    # a word counts as a beginner by what it does elsewhere: without the events of its pair, which are to be decided
    # together; after a strong mark, which stands behind any word, without one such event
    own = F.when(F.col("strong") == 1, F.col("s") / F.col("n_pair")).otherwise(F.col("s"))
    elsewhere = F.greatest(F.col("begins") - own, F.lit(0.0))
    begin = (elsewhere + _SMOOTH * usual) / F.lit(all_begins + _SMOOTH)
    anywhere = (F.col("inside_word") + _SMOOTH * usual) / F.lit(all_inside + _SMOOTH)
    within = (F.col("inside") + _SMOOTH_INSIDE * anywhere) / (F.col("inside_key") + _SMOOTH_INSIDE)
    inner = (F.col("n_inner") + _SMOOTH * usual) / (F.col("n_before") + _SMOOTH)
    bounded = lambda x, most: F.least(F.greatest(x, F.lit(-most)), F.lit(most))
    trust = F.col("n_places") / (F.col("n_places") + _TRUST)
    ratio = F.when(F.col("bare") == 1, bounded(F.log(begin / inner), _BOUND)).when(F.col("sure") == 1, bounded(F.log(begin / within) * trust, _BOUND / 2)).otherwise(bounded(F.log(begin / within), _BOUND) * trust)
    # vocabulary sized: one row per distinct pair
    table = join_hot(join_hot(pairs, counted(pairs, words, "word", space), "word", "n", stored=True), counted(pairs, inside, "key", space), "key", "n", stored=True)
    return table.select(F.struct("key", "word").alias("pair"), ratio.alias("ratio"), "n_pair")


def forward_backward(score: np.ndarray, distance: np.ndarray, size: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all gaps, and (gaps, 4) what each tells of its transition. ``size``: gaps of each document, which lie one after another.

    All documents of a batch take each step together, longest first.
    """
    n = len(score)
    post, tells = np.zeros(n), np.zeros((n, 4))
    if not n:
        return post, tells
    score = np.clip(score, -30, 30)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    add = chain[:, distance]  # what the event before adds to a boundary here
    ahead = np.zeros((2, n))  # log weight of all ways to here, for none and boundary
    live = int((size > 0).sum())
    ahead[1, start[:live]] = score[start[:live]]
    for k in range(1, int(size[0])):
        at = start[: np.searchsorted(-size, -k, side="left")] + k
        a0, a1 = ahead[0, at - 1], ahead[1, at - 1]
        ahead[0, at] = np.logaddexp(a0, a1)
        ahead[1, at] = score[at] + np.logaddexp(a0 + add[0, at], a1 + add[1, at])
        # keep the weights near zero in long texts
        top = np.maximum(ahead[0, at], ahead[1, at])
        ahead[:, at] -= top
    behind = np.zeros((2, n))
    for k in range(int(size[0]) - 2, -1, -1):
        at = start[: np.searchsorted(-size, -(k + 1), side="left")] + k
        b0, b1 = behind[0, at + 1], score[at + 1] + behind[1, at + 1]
        behind[0, at] = np.logaddexp(b0, b1 + add[0, at + 1])
        behind[1, at] = np.logaddexp(b0, b1 + add[1, at + 1])
        behind[:, at] -= np.maximum(behind[0, at], behind[1, at])
    both = ahead + behind
    post = 1 / (1 + np.exp(both[0] - both[1]))
    inner = np.ones(n, dtype=bool)
    inner[start[:live]] = False
    at = np.flatnonzero(inner)
    ways = np.stack([ahead[s, at - 1] + e * (score[at] + add[s, at]) + behind[e, at] for s in (0, 1) for e in (0, 1)])
    ways = np.exp(ways - ways.max(axis=0))
    ways /= ways.sum(axis=0)
    for s in (0, 1):
        tells[at, 2 * s], tells[at, 2 * s + 1] = ways[2 * s + 1], ways[2 * s] + ways[2 * s + 1]
    return post, tells


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))


def posteriors(scored: DataFrame, chain: np.ndarray) -> DataFrame:
    """``scored`` with ``post`` and ``tells``; the gaps of a document come together in one row."""
    types = dict(scored.dtypes)
    columns = ["at", *(c for c in scored.columns if c not in ("doc_id", "at"))]
    packed = scored.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("g")).select("doc_id", *(F.col(f"g.{c}").alias(c) for c in columns))
    schema = f"doc_id {types['doc_id']}, " + ", ".join(f"{c} {types[c]}" for c in columns) + ", post double, tells array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
            size = np.diff(np.asarray(lists["at"].offsets))
            post, tells = forward_backward(np.asarray(lists["score"].flatten()), np.asarray(lists["distance"].flatten()), size, chain)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
            told = pa.ListArray.from_arrays(pa.array(np.arange(len(post) + 1, dtype=np.int32) * 4), pa.array(tells.ravel()))
            yield pa.RecordBatch.from_arrays([ids, *(lists[c].flatten() for c in columns), pa.array(post), told], names=["doc_id", *columns, "post", "tells"])

    return packed.mapInArrow(run, schema)


def decode(found: DataFrame, rows: DataFrame, chain: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """(doc_id, starts, ends) of the units, one row a document; the gaps of one document come together in one row."""
    gap = ["doc_id", "at", "kind", "stop", "next", "score", "distance"]
    scored = rows.withColumn("kind", F.lit(1)).select(*gap)
    scored = scored.union(found.filter("kind != 'open'").select("doc_id", "at", F.when(F.col("kind") == "text", 0).otherwise(2), "stop", "next", F.lit(30.0), "distance"))
    packed = scored.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(*gap[1:]))).alias("g")).select("doc_id", *(F.col(f"g.{c}").alias(c) for c in gap[1:]))
    schema = f"doc_id {dict(found.dtypes)['doc_id']}, starts array<long>, ends array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = _flat(batch.column(1))
            kind, stop, follows, score, distance = (_flat(batch.column(k))[0] for k in range(2, 7))
            doc = np.repeat(np.arange(len(size)), size)
            open_ = kind == 1
            post = np.ones(len(at))
            post[open_] = forward_backward(score[open_], distance[open_], np.bincount(doc[open_], minlength=len(size)), chain)[0]
            # a unit goes from the last place where one may begin to the next boundary that lies behind it
            text = np.flatnonzero(kind == 0)
            cut = np.flatnonzero((kind != 0) & (post > threshold))
            begin = {int(doc[k]): (int(follows[k]), int(stop[k])) for k in text}
            ids, starts, ends = [], [], []
            now, low, last = -1, 0, 0
            for k, d, a, b in zip(cut.tolist(), doc[cut].tolist(), stop[cut].tolist(), follows[cut].tolist()):
                if d != now:
                    if now >= 0 and low < last:
                        ids.append(now), starts.append(low), ends.append(last)
                    now, (low, last) = d, begin[d]
                if low < a:
                    ids.append(d), starts.append(low), ends.append(a)
                    low = b
            if now >= 0 and low < last:
                ids.append(now), starts.append(low), ends.append(last)
            whole = sorted(set(begin) - set(doc[cut].tolist()))
            ids += whole
            starts += [begin[d][0] for d in whole]
            ends += [begin[d][1] for d in whole]
            order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
            until = pa.array(np.append(0, np.cumsum(np.bincount(np.array(ids, dtype=np.int64), minlength=len(size)))), pa.int32())
            lists = [pa.ListArray.from_arrays(until, pa.array(np.array(v, dtype=np.int64)[order])) for v in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "starts", "ends"])

    return packed.mapInArrow(run, schema)


def sentences(docs: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence and heading. ``docs``: doc_id, text."""
    # the key of a text stands for its copies; counts of the model are over texts, not over deliveries
    keyed = docs.filter("text is not null").select("doc_id", "text", F.unhex(F.md5("text")).alias("same"))
    once = keyed.groupBy("same").agg(F.first("text").alias("text"), F.count("*").alias("n_docs"))
    texts = space.cut(once, "texts", most=F.max("n_docs"))
    read = texts.select(F.col("same").alias("doc_id"), "text")
    found = space.cut(gaps(read), "gaps")
    units = decode(found, *fit(read, found, space)).withColumnRenamed("doc_id", "same")
    most = space.seen_of(texts, "most")
    if most > HOT_ROWS:
        units = units.join(texts.select("same", "n_docs"), "same")
    dealt = join_hot(keyed.select("doc_id", "same").distinct(), units, "same", "n_docs", most=most)
    return dealt.select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("u")).select("doc_id", F.col("u.starts").alias("start_char"), F.col("u.ends").alias("end_char"))
