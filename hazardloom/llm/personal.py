"""Problem 4: personal information inside free text, by anchor expansion.

One Aho-Corasick automaton finds anchors in a single pass: at-signs and their spelled forms, digits (all written as
one sign), identifier prefixes and cues, street words, phone cues, name cues, capital runs. Each anchor calls a
deterministic parser that expands it to the left or right and validates the boundaries. Digit groups are refused
where the word before them says that they number a thing (drawing, batch, order, serial ...) and no cue of a phone
or identity number stands before that.

Names without a cue are decided by a model of capital runs in their context. ``learn_names`` counts, over all texts,
which words stand before, after and in the runs that cues prove to be names, against all others (hashed to a table of
fixed size); general evidence (roles and verbs of people, frequent given names, marks of companies and places) is
added, and a run counts as a name if the sum of log odds is positive.

Defined cases: null and empty texts give nothing; offsets count code points of the text as it is; texts of any
length are read whole in linear time, parsers have no windows; overlapping finds keep the first of EMAIL, ADDRESS, ID, PHONE,
NAME; a record that comes twice with the same text gives one result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.storage import spread

KINDS = ("EMAIL", "ADDRESS", "ID", "PHONE", "NAME")
#: Words that make the number after them the number of a thing.
THINGS = {
    "order", "no", "nr", "number", "batch", "drawing", "drawings", "job", "serial", "sn", "part", "item", "asset", "tag", "lot", "invoice", "po", "wo", "ref", "reference", "case",
    "permit", "coordinates", "valve", "kp", "line", "model", "firmware", "version", "ticket", "cylinder", "document", "procedure", "certificate", "heat", "code", "log", "equipment", "unit", "pump",
}
#: Words that never belong to a name.
NOT_NAMES = {
    "the", "a", "an", "and", "or", "of", "for", "with", "this", "that", "his", "her", "their", "our", "my", "no", "not", "safety", "officer", "supervisor", "manager", "engineer", "operator", "driller",
    "crew", "team", "control", "room", "site", "contractor", "shift", "hse", "control-room", "maintenance", "operations", "production", "drilling", "logistics", "well", "services", "mr", "mrs", "ms", "dr", "sir",
    "foreman", "permit", "line", "model", "everyone", "nobody", "someone", "who", "he", "she", "they", "it", "is", "was", "to", "at", "on", "in", "by", "from", "advisor", "dept", "department", "company", "ltd", "inc",
    "llc", "gmbh", "ulc", "station", "rig", "unit", "plant", "police", "control room", "field", "head", "office", "day", "night", "one", "two", "three", "work", "job", "see", "statement", "photos", "please",
}

_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_CAP = rf"(?:[{_U}][{_L}]+(?:['’-][{_U}][{_L}]+)*|[{_U}][{_U}]+(?:['’-][{_U}]+)*)"
_LOW = rf"[{_L}]+(?:['’-][{_L}]+)*"
_INITIAL = rf"[{_U}]\."
_PARTICLE = r"(?:(?:de|del|van|von|der|den|bin|al|la|le|di|da)\s+)*"
#: Last, First [M.] | initials Last | First [M.] Last [Last]
_NAME_FORMS = (
    rf"{_CAP},\s{_CAP}(?:\s{_INITIAL})?",
    rf"{_CAP},\s{_INITIAL}(?:\s?{_INITIAL})*",
    rf"{_INITIAL}(?:\s?{_INITIAL})*\s{_PARTICLE}{_CAP}(?:\s{_CAP})?",
    rf"{_CAP}\s(?:{_INITIAL}\s)*{_PARTICLE}{_CAP}(?![{_L}])(?:\s{_CAP}(?![{_L}]))?",
)
_CAP_NAME = "(?:" + "|".join(_NAME_FORMS) + ")"
_LOW_NAME = rf"(?:{_LOW},\s{_LOW}|[{_L}]\.\s{_LOW}|{_LOW}\s(?:[{_L}]\.\s)?{_LOW})"
_NAME_AT = re.compile(_CAP_NAME)
_LOW_NAME_AT = re.compile(rf"{_LOW_NAME}(?![\w-])")
#: Read backwards from what follows a name; the longest form counts.
_NAMES_BEFORE = [regex.compile(rf"(?r)(?<![\w.'’-]){form}") for form in _NAME_FORMS]
_LOW_NAME_BEFORE = regex.compile(rf"(?r)(?:^|[.!?\n\"”]\s*)({_LOW_NAME})")

_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_DOT = r"(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_HOST = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
#: Read backwards from the at-mark.
_LOCAL_BEFORE = regex.compile(r"(?r)[A-Za-z0-9](?:[A-Za-z0-9._%+\-]|\s*[\[(]\s*dot\s*[\])]\s*)*", regex.I)
_TOKEN_BEFORE = regex.compile(rf"(?r)(?<!\S){_LOCAL}")
_SPELLED_HOST = re.compile(rf"{_LABEL}(?:\s+dot\s+{_LABEL})+", re.I)

_NUMBER = re.compile(
    r"(?<![\w+/.,-])(?:"
    r"(?P<phone>\+\d{1,3}[ -]?\(\d{2,4}\)[ -]?\d{3}[ .-]?\d{4}|\+\d{10,13}|\+\d{1,3}[ .-]\(?\d{1,5}\)?(?:[ .-]\d{2,8}){1,5}|\+\d{1,3}[ -]\d{10}"
    r"|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}|0\d{2,4}-\d{3}[ -]\d{4}|0\d{2,4} \d{3} \d{4}|0\d{4} \d{6}|0\d(?:[ .]\d{2}){4}|0\d{2,4}[ /-]\d{6,8}|\d{10,11})"
    r"(?P<ext>(?:,?\s*(?:ext\.?|extension|x)\s*\d{1,6}))?"
    r"|(?P<id>\d{3}-\d{2}-\d{4}|\d{4}[ -]\d{4}[ -]\d{4}|\d{12}))(?![\w-]|[.,/]\d)",
    re.I,
)
_PREFIXED_ID = re.compile(r"(?:EMP(?:LOYEE)?|OIL\s?ID|STAFF|BADGE|PERS)(?:\s?(?:ID|NO\.?))?\s?[:#-]?\s?\d{4,8}(?!\w)", re.I)
_TAX_ID = re.compile(r"(?<!\w)[A-Z]{5}\d{4}[A-Z](?!\w)")

_SUFFIX = r"(?:Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Marg|Nagar|Way|Court|Ct|Close|Place|Pl|Terrace|Square|Sq|Crescent|Highway|Hwy)"
_TOWN = rf"{_CAP}(?:[ -]{_CAP}){{0,2}}"
_DOOR = r"(?:(?:Flat|Apt|Apartment|Unit|Door|House|Plot|Room|Suite|H\.?)\s?(?:No\.?\s?)?\d+[A-Za-z]?(?:/\d+)?)"
_SUFFIX_AT = re.compile(rf"{_SUFFIX}(?![\w])\.?")
_STREET_BEFORE = regex.compile(rf"(?r)(?<![\w.])(?:{_DOOR},\s(?:\d+[A-Za-z]?,?\s)?|\d{{1,5}}[A-Za-z]?,?\s)(?:{_CAP}\s){{1,3}}")
_STREET_AFTER = re.compile(
    rf"(?:,\s(?:(?:Apt|Apartment|Flat|Unit|Suite|Ward|Floor|Block|Sector|Phase)\.?\s?(?:No\.?\s?)?\w+))*"
    rf"(?:,?[ \n]+(?!(?:TX|and|tel)\b){_TOWN}(?:,\s[A-Z]{{2}}\s\d{{5}}(?:-\d{{4}})?|\s?[-–]\s?\d{{5,6}}|,?\s\d{{5,6}})?(?!\d))?",
)
_WORDS = rf"(?:(?:{_CAP}|{_LOW}|[dl]['’]{_CAP})[ -]){{0,5}}{_CAP}"
_TOWN_AFTER = rf"(?:,?\s(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s{_TOWN}|,\s{_TOWN})?"
#: Street word first, number before (French) or after (Spanish, Italian), and German compounds.
_RUE = re.compile(rf"(?:rue|avenue|boulevard|chemin|impasse|allée|quai|route|place)\s{_WORDS}{_TOWN_AFTER}", re.I)
_NUMBER_BEFORE = regex.compile(r"(?r)(?<![\w.])\d{1,4}(?:\s?(?:bis|ter)|[A-Za-z])?,?\s")
_CALLE = re.compile(rf"(?:calle|avenida|paseo|plaza|via|viale|corso)\s{_WORDS},?\s(?:n\.?º\s?)?\d{{1,4}}{_TOWN_AFTER}", re.I)
_GERMAN = regex.compile(rf"(?r)(?<![\w-])(?:{_CAP}[ -]){{0,2}}[{_U}][{_L}]*")
_GERMAN_AFTER = re.compile(rf"(?:e|\.)?\s\d{{1,4}}\s?[a-z]?(?![\w]){_TOWN_AFTER}")

#: Before a number: whose it is.
PHONE_CUES = ("phone", "tel", "telephone", "mobile", "cell", "fax", "whatsapp", "hotline", "call", "called", "reach", "téléphone", "telefon", "teléfono", "handy", "phone number", "मोबाइल", "फोन")
ID_CUES = ("passport", "aadhaar", "ssn", "social security", "national id", "identity card", "id card", "id no", "licence no", "license no", "driving licence", "driver's license", "badge", "employee no", "employee id", "staff no", "personnel no", "personalnummer", "ausweis", "dni", "nif", "pan card", "pan no")
_CUED_PHONE = re.compile(r"(?:\s?(?:number|no\.?|nr\.?))?\s?(?:is|:|at|on|\(|#)?\s?(\+?\(?\d(?:[\d]|[ ()./-](?=[\d(])){5,18}\d)(?![\w-]|[.,/]\d)", re.I)
_CUED_ID = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|id|card))?\s?(?:is|:|#)?\s?((?=[A-Z0-9/-]*\d[A-Z0-9/-]*\d[A-Z0-9/-]*\d)[A-Z0-9](?:[A-Z0-9]|[/-](?=[A-Z0-9])){4,19})(?!\w)")

#: Cues with a name to the right; a name in lower case only after a capitalised title or role, or (second list) after any.
RIGHT = ("mr. ", "mr ", "mrs. ", "mrs ", "ms. ", "ms ", "dr. ", "shri ", "smt. ", "sri ", "er. ", "supervisor ", "foreman ", "engineer ", "manager ", "driver ", "operator ", "officer ", "advisor ", "technician ", "signed by ", "approved by ", "signature of ")
RIGHT_ANY = (
    "contact ", "reported by: ", "reported by ", "gate pass shows ", "injured person, ", "witness ", "i spoke with ", "spoke with ", "spoke to ", "checked with ", "confirmed with ", "discussed with ", "medical file of ", "ask ", "per ", "name: ", "employee ", "attn: ", "attention ",
)
LEFT = (" says ", " said that ", " agrees", " confirms ", " told ", " (dob")
HINDI = "घटना के समय "
_HINDI_TITLED = re.compile(r"[ऀ-ॣ]+(?:\s(?!ने|को|से|का|की|के|और)[ऀ-ॣ]+){0,2}")
_HINDI_NAME = re.compile(r"([ऀ-ॣ]+(?:\s[ऀ-ॣ]+){1,2})\sने(?![ऀ-ॣ])")
#: What follows a name after the cues that also take it in lower case.
_AFTER_LOW = re.compile(r"\s*(?:[,.;:!?()]|$|\n|(?:at|on|can|could|was|after|refused|says|said|agrees|in|about|and|via|by|ne|for|by phone)\b)")


#: Evidence of people, in log odds: roles and relations before a name, verbs of people after it, weaker words of both kinds.
BEFORE = dict.fromkeys(("victim", "nurse", "worker", "employee", "colleague", "coworker", "patient", "mechanic", "welder", "technician", "electrician", "roustabout", "foreman", "witness", "supervisor", "superintendent", "apprentice", "trainee", "contractor", "named", "name", "doctor", "medic", "paramedic", "sir", "madam", "señor", "señora", "herr", "frau", "monsieur", "madame", "don", "doña", "deceased", "injured", "casualty", "inspector", "manager", "engineer", "crewman", "rigger", "scaffolder", "driver"), 4.0) | dict.fromkeys(("by", "with", "told", "asked", "thanked", "informed", "and", "helped", "from", "to", "saw", "for"), 1.5)
AFTER = dict.fromkeys(("fell", "said", "says", "told", "slipped", "tripped", "suffered", "sustained", "treated", "noticed", "stated", "confirmed", "refused", "climbed", "lifted", "died", "complained", "walked", "stepped", "felt", "lost", "broke", "helped", "asked", "reported", "saw", "heard", "went", "who", "whose", "signed", "hurt", "injured", "cut", "burned", "collapsed", "replied", "agreed", "admitted", "explained", "wrote", "fractured", "sprained", "twisted"), 4.0) | dict.fromkeys(("was", "had", "has", "is", "did", "came", "left", "opened", "closed", "started", "stopped", "then", "pulled", "hit", "got"), 2.0)
#: Frequent given names of several languages.
GIVEN = {
    "john", "james", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "charles", "daniel", "matthew", "anthony", "mark", "paul", "steven", "andrew", "kevin", "brian", "george", "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "nancy", "lisa", "anna", "maria",
    "priya", "rahul", "amit", "anil", "sunil", "rajesh", "suresh", "ramesh", "vijay", "sanjay", "deepak", "pooja", "neha", "anita", "sunita", "ravi", "arjun", "mohammed", "mohamed", "ahmed", "ali", "hassan", "fatima", "omar", "yusuf", "ibrahim",
    "jean", "pierre", "marie", "claire", "luc", "michel", "françois", "jacques", "sophie", "camille", "hans", "peter", "klaus", "jürgen", "stefan", "andreas", "ursula", "sabine", "monika", "petra", "josé", "juan", "carlos", "luis", "miguel", "carmen", "lucía", "pedro", "jorge", "manuel", "rosa", "elena",
    "giovanni", "marco", "luca", "giulia", "ivan", "olga", "natalia", "sergei", "dmitri", "piotr", "katarzyna", "wei", "li", "min", "hiroshi", "yuki", "kenji", "sven", "lars", "ingrid", "erik", "emma", "laura", "julia",
}
#: Words of companies, places, equipment and documents, which no name of a person holds.
IMPERSONAL = set(
    "ltd limited inc llc gmbh ulc corp corporation company co plc group energy gas oil pipeline pipelines drilling services service lifting works inspection petroleum refinery systems solutions industries basin ridge creek station house farm rig terminal plant platform field yard dock bay pad "
    "tank valve pump compressor separator manifold unit well block deck room area line road street lane avenue north south east west upper lower main toolbox talk permit work hot cold lock out tag gate pass safety control shift night day emergency shutdown line fire confined space energy isolation act law rule "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december report incident section figure table unit project department team crew international national united new san santa saint lake river mount port cape "
    "please thank thanks note see also both each every this these those there here where when while after before during because although however then later yesterday today tomorrow once if as no nobody everyone someone they we you it he she his her our your their did was is are were had has have do does".split()
)
_PERSON_RUN = re.compile(_CAP_NAME)
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}'’-]+[.,:]?\s+")
_WORD_AFTER = regex.compile(r"[,\s]+([\p{L}'’-]+)")
BINS = 1 << 16
#: Log odds of a capital run to be a name before anything is known of it, and the bound of what is learnt of one word.
_BASE, _LEARNT = -3.5, 3.0
#: Frequent Chinese family names, one sign each, and what may follow a name at the head of a clause.
_HAN_NAME = re.compile(r"(?<![一-鿿])([王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛][一-鿿]{1,2}?)(?=在|被|说|称|受伤|先生|女士|师傅|告诉|没有|从)")


def _bin(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BINS


def _run_features(text: str, start: int, stop: int) -> tuple[str, str, list[str]]:
    """Word before (empty at the head of a sentence), word after, words of a run."""
    before = _WORD_BEFORE.match(text, 0, start)
    prev = before[0].strip().lower() if before else ""
    prev = "" if prev.endswith((".", ":")) and len(prev) > 4 else prev.rstrip(".,:")
    after = _WORD_AFTER.match(text, stop)
    return prev, after[1].lower() if after else "", [w.strip(".,").lower() for w in text[start:stop].replace(",", " ").split()]


def _run_score(text: str, start: int, stop: int, evidence: np.ndarray | None) -> float:
    prev, after, words = _run_features(text, start, stop)
    if any(w in IMPERSONAL or w in NOT_NAMES or w in THINGS for w in words) or after in IMPERSONAL and after not in AFTER and text[stop : stop + 1] == " " and text[stop + 1 : stop + 2].isupper():
        return -99.0
    given = any(w in GIVEN for w in words[:2])
    score = _BASE + BEFORE.get(prev, 0.0) + AFTER.get(after, 0.0) + 3.0 * given
    if evidence is not None:
        tokens = [evidence[_bin("t" + w)] for w in words if len(w) > 1]
        score += float(evidence[_bin("<" + prev)] + evidence[_bin(">" + after)] + (sum(tokens) / len(tokens) if tokens else 0.0))
    return score


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, words in (
        ("at", ("@", "[at]", "(at)", "{at}", "<at>", "[ at ]", "( at )")), ("spelled", (" at ",)), ("digit", ("0",)), ("id", ("emp", "oil", "staff", "pers", "badge")), ("hindi", (HINDI,)), ("title", ("श्री ", "श्रीमती ", "सुश्री ")),
        ("right", RIGHT), ("right_any", RIGHT_ANY), ("left", LEFT), ("phone_cue", PHONE_CUES), ("id_cue", ID_CUES),
        ("street", (" road", " rd", " street", " st", " lane", " ln", " avenue", " ave", " boulevard", " blvd", " drive", " dr", " marg", " nagar", " way", " court", " ct", " close", " place", " pl", " terrace", " square", " sq", " crescent", " highway", " hwy")),
        ("rue", ("rue ", "avenue ", "boulevard ", "chemin ", "impasse ", "allée ", "quai ", "route ", "place ")), ("calle", ("calle ", "avenida ", "paseo ", "plaza ", "via ", "viale ", "corso ")), ("german", ("straße", "strasse", "str", "weg", "platz", "allee", "gasse")),
    ):
        for word in words:
            kinds.setdefault(word, []).append(kind)
    for word, of in kinds.items():
        auto.add_word(word, (tuple(of), len(word)))
    auto.make_automaton()
    return auto


_DIGITS = str.maketrans("123456789", "0" * 9)


def _lower(text: str) -> str:
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)).translate(_DIGITS)


def _email(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Expands an at-mark at [start, end) to both sides."""
    while start > 0 and text[start - 1] == " ":
        start -= 1
    while end < len(text) and text[end] == " ":
        end += 1
    left = _LOCAL_BEFORE.match(text, 0, start)
    right = _HOST.match(text, end)
    if not left or not right or not re.search(r"[A-Za-z]", right[0]):
        return None
    stop = right.end()
    return (left.start(), stop) if re.search(r"[A-Za-z]{2,}$", right[0]) else None


def _spelled(text: str, start: int, end: int) -> tuple[int, int] | None:
    """``user at host dot tld`` around a spelled at-mark."""
    while start > 0 and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    right = _SPELLED_HOST.match(text, end)
    left = right and _TOKEN_BEFORE.match(text, 0, start)
    return (left.start(), right.end()) if left else None


def _address(text: str, at: int) -> tuple[int, int] | None:
    """Expands a street word that begins at ``at`` to the number before and the town after it."""
    suffix = _SUFFIX_AT.match(text, at)
    left = suffix and _STREET_BEFORE.match(text, 0, at)
    return (left.start(), _STREET_AFTER.match(text, suffix.end()).end()) if left else None


def _street_first(text: str, at: int) -> tuple[int, int] | None:
    left = _NUMBER_BEFORE.match(text, 0, at)
    right = left and _RUE.match(text, at)
    return (left.start(), right.end()) if right else None


def _german_street(text: str, start: int, end: int) -> tuple[int, int] | None:
    right = _GERMAN_AFTER.match(text, end)
    left = right and _GERMAN.match(text, 0, start)
    return (left.start(), right.end()) if left and left.start() < start else None


def _number(text: str, at: int) -> tuple[str, int, int] | None:
    """Expands the first digit of a group to the phone or identity number that it begins."""
    for back in ("+(", "+", "("):
        if text.startswith(back, at - len(back)):
            m = _NUMBER.match(text, at - len(back))
            if m:
                break
    else:
        m = _NUMBER.match(text, at)
    if m:
        return None if _word_before(text, m.start()) in THINGS else ("ID" if m["id"] else "PHONE", *m.span())
    tax = _TAX_ID.match(text, at - 5) if at >= 5 else None
    return ("ID", *tax.span()) if tax else None


def _named_words(name: str) -> bool:
    words = [w.strip(".,").lower() for w in re.split(r"[\s]+", name)]
    return all(w not in NOT_NAMES and w not in THINGS for w in words if len(w) > 1)


def _name_right(text: str, at: int, any_case: bool) -> tuple[int, int] | None:
    m = _NAME_AT.match(text, at)
    if m and _named_words(m[0]):
        stop = m.end()
        if m[0].count(" ") == 2 and "." not in m[0] and "," not in m[0] and re.search(r"\s[A-Z][a-z]+$", m[0]) and m[0].split()[-1].lower() in NOT_NAMES:
            stop = m.start() + m[0].rindex(" ")
        return m.start(), stop
    if any_case:
        m = _LOW_NAME_AT.match(text, at)
        if m and _named_words(m[0]) and _AFTER_LOW.match(text, m.end()):
            return m.start(), m.end()
    return None


def _name_left(text: str, at: int) -> tuple[int, int] | None:
    starts = [m.start() for form in _NAMES_BEFORE if (m := form.match(text, 0, at))]
    if starts:
        start, name = min(starts), text[min(starts) : at]
        while not _named_words(name) and " " in name:  # a cue or a role before the name isn't part of it
            cut = name.index(" ") + 1
            start, name = start + cut, name[cut:]
        if _named_words(name) and _NAME_AT.fullmatch(name):
            return start, at
    m = _LOW_NAME_BEFORE.match(text, 0, at)
    return m.span(1) if m and _named_words(m[1]) else None


_LETTERS_BEFORE = regex.compile(r"(?r)([A-Za-z]+)[.:#\s]*")


def _word_before(text: str, at: int) -> str:
    m = _LETTERS_BEFORE.match(text, 0, at)
    return m[1].lower() if m else ""


def _anchored(text: str) -> list[tuple[int, int, int]]:
    """(rank, start, end) of what the anchors of a text expand to."""
    found: list[tuple[int, int, int]] = []
    low = _lower(text)

    def add(kind: str, span: tuple[int, int] | None) -> None:
        if span and span[0] < span[1]:
            found.append((KINDS.index(kind), *span))

    reached = digits = -1
    for last, (kinds, size) in _automaton().iter(low):
        start, end = last - size + 1, last + 1
        bounded = start == 0 or not low[start - 1].isalnum()
        closed = end == len(low) or not low[end].isalnum()
        for kind in kinds:
            if kind == "digit":
                if start > digits:
                    number = _number(text, start)
                    if number:
                        add(number[0], number[1:])
                    # the rest of a group can't begin a number
                    digits = number[2] - 1 if number else start
                    while digits + 1 < len(low) and low[digits + 1] == "0":
                        digits += 1
            elif kind == "at":
                add("EMAIL", _email(text, start, end))
            elif kind == "spelled":
                add("EMAIL", _spelled(text, start, end))
            elif kind == "street":
                if closed and end > reached:
                    span = _address(text, start + 1)
                    add("ADDRESS", span)
                    reached = span[1] if span else reached
            elif kind == "left":
                at = start - 1 if low[start] != " " else start
                add("NAME", _name_left(text, at - 1 if text[at - 1 : at] == "," else at))
            elif kind == "german":
                if not bounded:
                    add("ADDRESS", _german_street(text, start, end))
            elif not bounded:
                continue
            elif kind == "id":
                m = _PREFIXED_ID.match(text, start)
                add("ID", m and m.span())
            elif kind == "right":
                add("NAME", _name_right(text, end, text[start].isupper()))
            elif kind == "right_any":
                add("NAME", _name_right(text, end, True))
            elif kind == "phone_cue" and closed:
                m = _CUED_PHONE.match(text, end)
                add("PHONE", m and m.span(1))
            elif kind == "id_cue" and closed:
                m = _CUED_ID.match(text, end)
                add("ID", m and m.span(1))
            elif kind == "rue":
                add("ADDRESS", _street_first(text, start))
            elif kind == "calle":
                m = _CALLE.match(text, start)
                add("ADDRESS", m and m.span())
            elif kind == "hindi":
                m = _HINDI_NAME.match(text, end)
                add("NAME", m and m.span(1))
            elif kind == "title":
                m = _HINDI_TITLED.match(text, end)
                add("NAME", m and m.span())
    return found


def _person_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words and initials that could be a person."""
    at = 0
    while m := _PERSON_RUN.search(text, at):
        start, stop = m.span()
        if start and (text[start - 1].isalnum() or text[start - 1] in "-_&"):
            at = start + 1
            continue
        words = [w.strip(".,").lower() for w in m[0].split()]
        # a capitalised word that opens a sentence isn't part of the name behind it
        if len(words) > 2 and words[0] in (IMPERSONAL | NOT_NAMES | BEFORE.keys()):
            at = start + m[0].index(" ") + 1
            continue
        if len(words) == 2 and words[0] in (IMPERSONAL | NOT_NAMES | BEFORE.keys()):
            at = start + m[0].index(" ") + 1
            continue
        if len(words) == 3 and words[-1] in AFTER:
            stop = start + m[0].rindex(" ")
        yield start, stop
        at = stop


def find_personal(text: str | None, evidence: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every place, without overlaps, in order. ``evidence``: what ``learn_names`` gave."""
    if not text:
        return []
    found = _anchored(text)
    name = KINDS.index("NAME")
    for start, stop in _person_runs(text):
        if _run_score(text, start, stop, evidence) > 0:
            found.append((name + 1, start, stop))  # behind what a cue proves
    if _HAN_NAME.search(text):
        found += [(name + 1, *m.span(1)) for m in _HAN_NAME.finditer(text)]
    taken: list[tuple[int, int, int]] = []
    for item in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if all(item[2] <= a or item[1] >= b for _, a, b in taken):
            taken.append(item)
    return [(KINDS[min(k, name)], a, b) for k, a, b in sorted(taken, key=lambda x: x[1])]


def learn_names(texts: DataFrame) -> np.ndarray:
    """Log odds by hashed feature (word before, word after, word of the run), over all texts: names proved by cues against other runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = KINDS.index("NAME")
        for pdf in batches:
            counts = np.zeros((2, BINS), dtype=np.int64)
            for text in pdf["text"]:
                runs = list(_person_runs(text))
                if runs:
                    proved = [(a, b) for k, a, b in _anchored(text) if k == name]
                    for start, stop in runs:
                        yes = any(start < b and a < stop for a, b in proved)
                        prev, after, words = _run_features(text, start, stop)
                        for f in ("<" + prev, ">" + after, *("t" + w for w in words if len(w) > 1)):
                            counts[int(yes), _bin(f)] += 1
            bins = np.flatnonzero(counts.any(axis=0))
            yield pd.DataFrame({"bin": bins, "no": counts[0, bins], "yes": counts[1, bins]})

    rows = spread(texts.select("text").filter("text is not null")).mapInPandas(run, "bin int, no long, yes long").groupBy("bin").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    got = rows.toPandas()  # at most BINS rows
    no, yes = np.zeros(BINS), np.zeros(BINS)
    no[got["bin"]], yes[got["bin"]] = got["no"], got["yes"]
    seen = no + yes
    odds = np.log((yes + 0.5) / (yes.sum() + 1.0)) - np.log((no + 0.5) / (no.sum() + 1.0))
    return np.clip(odds * seen / (seen + 10.0), -_LEARNT, _LEARNT).astype(np.float32)


def redact(text: str | None, evidence: np.ndarray | None = None) -> str | None:
    """The text with ``[KIND]`` in place of what was found."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in find_personal(text, evidence):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def _mapped(texts: DataFrame, schema: str, make: Callable[[str, str, str], list[tuple]], once: bool = False) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([row for t, i, x in zip(pdf["source_table"], pdf["record_id"], pdf["text"]) for row in make(t, i, x)], columns=names)

    rows = texts.select("source_table", "record_id", "text").filter("record_id is not null and text is not null")
    return spread(rows.distinct() if once else rows).mapInPandas(run, schema)


def places(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, pii_kind, start_char, end_char) of every place. ``texts``: source_table, record_id, text. Repeated rows are told apart by their results, so no text is shuffled."""
    evidence = learn_names(texts)
    return _mapped(texts, "source_table string, record_id string, pii_kind string, start_char long, end_char long", lambda t, i, x: [(t, i, *p) for p in find_personal(x, evidence)]).distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """(source_table, record_id, text) with placeholders."""
    evidence = learn_names(texts)
    return _mapped(texts, "source_table string, record_id string, text string", lambda t, i, x: [(t, i, redact(x, evidence))], once=True)


def union_texts(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """One table of (source_table, record_id, text) from (table, name, id column, text column)."""
    out = None
    for df, name, key, text in parts:
        one = df.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("record_id"), F.col(text).cast("string").alias("text"))
        out = one if out is None else out.union(one)
    return out
