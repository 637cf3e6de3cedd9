"""Suppression of negated hazards: clauses that deny an event are taken out, missing controls stay as evidence.

A clause goes if a negator stands within 48 characters before a hazard, unless a protected control phrase ('no permit',
'without harness') stands there or covers the hazard; so does one whose hazard is said not to have taken place ('the
lift was not performed'). The 48 characters are looked at by themselves, so this is Python
in Arrow batches: a pattern over the whole clause can't say that.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAZARD = re.compile(
    r"\b(?:expos(?:ed|ure)|contact(?:ed)?|inhal(?:ed|ation)|released?|leak(?:ed|age)?|spill(?:ed)?|ignit(?:ed|ion)|explod(?:ed|e|ion)|fire|burn(?:ed|ing)?|lift(?:ed|ing)?|hoist(?:ed|ing)?|rigg(?:ed|ing)|crane(?:d)?|"
    r"enter(?:ed|ing)?|confined\s+space\s+entry|work(?:ed|ing)?\s+at\s+height|fall(?:en|ing)?|dropped?|struck|collision|driv(?:e|en|ing)|arc\s+flash|energiz(?:ed|ing)|electrocut(?:ed|ion))\b",
    re.IGNORECASE,
)  # fixed values
_NEGATOR = re.compile(r"\b(?:no|not|never|neither|nor|without)\b", re.IGNORECASE)
_CLAUSE = re.compile(r"(?<=[,;])|\b(?:but|however|although|whereas)\b", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PROTECTED = re.compile(r"\b(?:no|without)\s+(?:a\s+)?(?:permit|ptw|harness|gas\s+test|isolation|fire\s+watch|attendant|lifeline)\b", re.IGNORECASE)
_REACH = 48


#: A hazard that is itself what did not take place.
_NOT_DONE = re.compile(_HAZARD.pattern + r"\s+(?:was|were|is|are|(?:has|have|had)\s+been)\s+(?:not|never)\s+(?:performed|done|made|started|carried\s+out|observed|reported|recorded|noted|found|seen|present)\b", re.IGNORECASE)


def _spans(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text)]


def _denied(clause: str) -> bool:
    """Whether a hazard of the clause has a negator within reach before it, or is said not to have taken place."""
    controls = _spans(_PROTECTED, clause)
    if not controls and _NOT_DONE.search(clause):
        return True
    negators = _spans(_NEGATOR, clause)
    for at, _ in _spans(_HAZARD, clause) if negators else ():
        reach = lambda a, b: at - _REACH <= a and b <= at  # noqa: B023, E731
        if any(reach(a, b) for a, b in negators) and not any(reach(a, b) or a <= at < b for a, b in controls):
            return True
    return False


def suppress(text: str | None) -> tuple[str | None, list[str], str]:
    """(text without negated hazard clauses, those clauses, method: 'none' where nothing could be negated)."""
    if not text or not _HAZARD.search(text) or not _NEGATOR.search(text):
        return text, [], "none"
    left, gone = [], []
    for sentence in _SENTENCE.split(text):
        for clause in _CLAUSE.split(sentence):
            if clause and _denied(clause):
                if phrase := " ".join(clause.split()).strip(" ,;"):
                    gone.append(phrase)
            elif clause:
                left.append(clause)
    return " ".join(" ".join(left).split()), gone, "regex_fallback"


def suppressed(c: Column) -> Column:
    """Struct (text, negated_phrases, method)."""
    import pandas as pd

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([suppress(t) for t in texts], columns=["text", "negated_phrases", "method"])

    batch.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, "text string, negated_phrases array<string>, method string")(c)
