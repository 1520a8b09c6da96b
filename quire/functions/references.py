"""Bibliography lines in the common styles, taken apart."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

INITIAL = re.compile(r"(?:^|[\s.,&-])[^\W\d_]$")
YEAR = re.compile(r"(?<!\d)(?:1[89]|20)\d\d(?!\d)")
LABEL = re.compile(r"^\s*(?:\[(\d+)\]|(\d+)\.)\s*")
DOI = re.compile(r"10\.\d{4,}/[^\s,;]+[^\s,;.]")


def parse_line(raw: str) -> tuple[str, str, str]:
    """Authors, title and the rest of a line; '' where there is none. Quoted titles, a year in brackets after the authors,
    a type code after the title, and 'Authors. Title. Rest' are told apart in this order."""
    raw = LABEL.sub("", raw).strip()
    if m := re.search(r"[“\"](.+?)[,.]?[”\"]", raw):
        return raw[: m.start()], m[1], raw[m.end() :]
    if m := re.match(r"(.{2,}?)\s*[(（](?:\d{4})[a-z]?[)）]\s*[.。:：,]?\s*(.+)$", raw, re.S):
        rest = m[2]
        end = re.search(r"。\s*《|。|\.\s+(?=[^\sa-z])|\.$", rest)
        return (m[1], rest[: end.start()], rest[end.end() - 1 :]) if end else (m[1], rest, "")
    if m := re.search(r"\[[JCDMPRNS](?:/OL)?\]", raw):
        head, rest = raw[: m.start()], raw[m.end() :]
        a = re.search(r"\bet al\.?\s+|等[.。]\s*", head) or re.search(r"[.。]\s*", head)
        return (head[: a.start()], head[a.end() :], rest) if a else ("", head, rest)
    at = 0
    while (end := raw.find(". ", at)) >= 0:
        if INITIAL.search(raw[:end]) or raw[:end].endswith(" et"):
            at = end + 2
            continue
        stop = re.search(r"\.\s+(?=[^\sa-z])|\.$", raw[end + 2 :])
        title = raw[end + 2 : end + 2 + stop.start()] if stop else raw[end + 2 :]
        return raw[:end], title, raw[end + 2 + len(title) :]
    return "", raw, ""


def authors_of(part: str) -> list[str]:
    """Names of an author part: 'Lee, A., & Kim, B.', 'A. Lee and B. Kim', 'LEE A, KIM B', '王一、李二'."""
    part = re.sub(r"\bet al\b\.?|等$", "", part).strip(" ,.;，。、")
    if re.search(r"[一-鿿]", part):
        return [x for x in re.split(r"[,，、;；\s]+", part) if x]
    part = re.sub(r"\s*(?:&|\band\b|\bund\b)\s*", ", ", part)
    pieces = [p.strip() for p in re.split(r"[,;]", part) if p.strip()]
    out: list[str] = []
    for p in pieces:
        if out and re.fullmatch(r"(?:[^\W\d_]\.?[\s-]?){1,3}", p) and "," not in out[-1] and not re.search(r"(?:^|\s)[^\W\d_]\.?$", out[-1]):
            out[-1] += f", {p}"  # initials that belong to the family name before them
        else:
            out.append(p)
    return out


def parse_reference(raw: str) -> dict:
    """label, authors, year, title, venue, doi of a bibliography line; null for what isn't found."""
    text = unicodedata.normalize("NFKC", raw or "").strip()
    label = LABEL.match(text)
    names, title, rest = parse_line(text)
    after_names = text[text.find(names) + len(names) :][:12] if names else ""
    year = next(iter(YEAR.findall(after_names) or YEAR.findall(rest) or YEAR.findall(text)), None)
    venue = re.match(r"[\s.,。，《]*([^\d\W][^\d,，。》:]*?)(?=[,，。》:]|\s+\d|\s*$)", rest)
    doi = DOI.search(text)
    return {
        "label": (label[1] or label[2]) if label else None, "authors": authors_of(names) or None, "year": int(year) if year else None,
        "title": title.strip(" .。,，") or None, "venue": venue[1].strip(" .") or None if venue else None, "doi": doi[0].lower() if doi else None,
    }


PARSED = StructType([StructField("label", StringType()), StructField("authors", ArrayType(StringType())), StructField("year", IntegerType()), StructField("title", StringType()), StructField("venue", StringType()), StructField("doi", StringType())])


@F.pandas_udf(PARSED)
def parse_reference_udf(raw: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([parse_reference(r) if isinstance(r, str) else dict.fromkeys(PARSED.names) for r in raw], columns=PARSED.names)
    return out.astype({"year": "Int32"})
