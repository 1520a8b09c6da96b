"""Finding quoted evidence in a source: normal forms with offset maps, spliced quotes, minimal edits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "‚": "'", "–": "-", "—": "-", "‐": "-", "‑": "-"})
HAN = re.compile(r"[㐀-鿿]")


def normal(text: str, spaces: bool = True) -> tuple[str, list[int]]:
    """A comparable form, and for each of its characters the place in text it comes from.

    Widths, quotes, dashes and case are folded, invisible characters dropped; white space becomes one space, none between
    Han characters, and none at all where spaces is false.
    """
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if unicodedata.category(c) == "Cf":
            continue
        for x in unicodedata.normalize("NFKC", c).translate(QUOTES).lower():
            if x.isspace():
                if not spaces or not out or out[-1] == " ":
                    continue
                x = " "
            elif spaces and len(out) > 1 and out[-1] == " " and HAN.match(x) and HAN.match(out[-2]):
                out.pop()
                at.pop()
            out.append(x)
            at.append(i)
    while out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def locate(evidence: str, source: str) -> tuple[int, int] | None:
    """[start, end) of the evidence in the source: word for word, else with words broken at line ends joined, else without
    regard to spaces. Empty evidence is nowhere."""
    for joined, spaces in ((False, True), (True, True), (True, False)):
        hidden = {i for m in re.finditer(r"-\s*\n\s*", source) for i in range(*m.span())} if joined else set()
        kept = [i for i in range(len(source)) if i not in hidden]
        want, _ = normal(evidence, spaces)
        have, at = normal("".join(source[i] for i in kept), spaces)
        if want and (p := have.find(want)) >= 0:
            return kept[at[p]], kept[at[p + len(want) - 1]] + 1
    return None


def locate_spliced(evidence: str, source: str) -> tuple[int, int] | None:
    """The longest piece of a quote with omissions ('...'), if all its pieces stand in the source in order."""
    found, begin = [], 0
    for piece in re.split(r"\s*(?:\.{3,}|…+|\[\.\.\.\])\s*", evidence):
        if not piece.strip():
            continue
        span = locate(piece, source[begin:])
        if span is None:
            return None
        found.append((span[0] + begin, span[1] + begin))
        begin += span[1]
    return max(found, key=lambda s: s[1] - s[0]) if found else None


def minimal_edit(old: str, new: str) -> tuple[int, int, str]:
    """The least stretch of whole words to replace: [start, end) of old and its replacement."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    end = len(old) - b
    while a and old[a - 1].isalnum() and not HAN.match(old[a - 1]):
        a -= 1
    while end < len(old) and old[end].isalnum() and not HAN.match(old[end]):
        end += 1
    return a, end, new[a : len(new) - (len(old) - end)]


def remove_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[int]]:
    """The text without the spans, and the place each character left had."""
    kept = [i for i in range(len(text)) if not any(a <= i < b for a, b in spans)]
    return "".join(text[i] for i in kept), kept


SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


@F.pandas_udf(SPAN)
def locate_udf(evidence: pd.Series, source: pd.Series) -> pd.DataFrame:
    got = [(locate_spliced(e, s) if isinstance(e, str) and isinstance(s, str) else None) or (None, None) for e, s in zip(evidence, source)]
    return pd.DataFrame(got, columns=["start", "end"]).astype("Int32")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("at", ArrayType(IntegerType()))]))
def normal_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normal(t) if isinstance(t, str) else (None, None) for t in text], columns=["text", "at"])
