"""Column expressions over text. All are built-in expressions, so scans stay in whole-stage code; null gives null unless said."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and wordings that decide the results below.
ABSTRACT_LEAST, ABSTRACT_HEAD, ABSTRACT_NAMES = 150, 200, 0.6
TYPE_CODES = {"J": "journal", "C": "conference", "A": "conference", "M": "book", "G": "book", "D": "thesis", "EB": "web", "DB": "web", "CP": "web"}
OTHER_CODES = ("R", "P", "S", "N", "Z")
PREPRINT_WORDS = r"(?i)arxiv|preprint"
FRAGMENT = {"characters": 40, "digits": 12, "colons": 3}
FLATTENED = {"characters": 500, "colons": 10}
TABLE_SHARES = {"digits": 0.08, "colons": 0.015}
CLAIM_HAN, CLAIM_WORDS = 8, 4
CENTURY_PIVOT = 91
PREFIX_WORDS, HEAD_WORDS, HEAD_SHARE = 4, 6, 0.6

#: How bibliographic styles number what stands in a larger work: volume, issue, pages, and numbers of books and series.
NUMERATION = {"volume": r"\b(?:vol|volume)\b[. ]*[0-9]", "issue": r"\b(?:no|issue)\b[. ]*[0-9]", "pages": r"\bpp?\b[. ]*[0-9]|\bpages? [0-9]", "number": r"\biss?n\b|\bisbn\b"}
#: Kinds of venue by the words in their names.
VENUES = {
    "conference": ("conference", "congress", "symposium", "workshop", "proceedings", "meeting of", "会议", "研讨会", "论文集", "大会"),
    "journal": ("journal", "annals", "transactions", "letters", "bulletin", "quarterly", "zeitschrift", "revue", "revista", "学报", "杂志", "期刊"),
}
#: Kinds of grey literature: what is issued outside publishers' channels, by how bibliographies name it.
GREY_KINDS = {
    "report": ("technical report", "tech. rep", "research report", "working paper", "white ?paper", "discussion paper", "policy brief", "final report"),
    "web": ("https?://", "www[.]", "web ?site", "web ?page", "blog", "wiki"), "data": ("data ?set", "data ?base", "corpus release"), "code": ("software", "source code", "tool ?kit", "git(?:hub|lab)", "computer program"),
    "draft": ("unpublished", "manuscript", "in preparation", "forthcoming", "personal communication"), "teaching": ("lecture notes", "slides", "tutorial", "course material"), "other": ("press release", "newsletter", "fact ?sheet"),
}
#: When an online source was seen, and the date of a page with its month.
SEEN = r"(?:accessed|retrieved|available (?:at|from|online))\b|访问日期|检索"
DATED = r"\((?:19|20)[0-9]{2}, *(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: An author who says what the work itself does: who, and what is done. "We" alone says nothing.
OWN_WHO = {"person": "we|i", "work": "(?:this|the present) (?:paper|study|work|article|chapter|thesis|report)", "thing": "our (?:method|model|approach|system|results?|findings|experiments?|analysis|contribution)"}
OWN_DOES = "propose|present|introduce|develop|describe|report|show|find|demonstrate|investigate|examine|study|evaluate|compare|argue|extend|apply|design|measure|analy[sz]e|contribute|explain|use|aim"
OWN_HAN = "(?:本文|本研究|本章|本论文|我们)(?:提出|介绍|研究|发现|分析|设计|采用|考察|探讨|证明|认为|比较|评估)"

FORMULA = r"[$^=<>±×÷∑∫√≤≥∈]|\\[a-zA-Z]+|[A-Za-z]_[A-Za-z0-9{]"
HAN = "一-鿿"
LATIN_WORD = "[A-Za-zÀ-ɏ0-9]+(?:['’-][A-Za-zÀ-ɏ0-9]+)*"


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose, and their base letters, by rule."""
    pairs = [(chr(c), b[0]) for c in range(0xC0, 0x250) if (b := unicodedata.normalize("NFD", chr(c))) and len(b) > 1 and b[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in "，。：；！？（）")
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)


def latin_words(c: Column) -> Column:
    """Number of Latin words and numbers; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(LATIN_WORD)), F.lit(0)).cast("bigint")


def han_characters(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[{HAN}]")), F.lit(0)).cast("bigint")


def count_words(c: Column) -> Column:
    """Latin words plus Han characters, each a word."""
    return latin_words(c) + han_characters(c)


def entry_language(c: Column) -> Column:
    """zh from two Han characters on, en if over nine tenths are ASCII, else other."""
    ascii_share = F.regexp_count(c, F.lit("[\\x00-\\x7F]")) / F.length(c)
    return F.when(han_characters(c) >= 2, "zh").when((F.length(c) > 0) & (ascii_share > 0.9), "en").otherwise("other")


def squash(c: Column) -> Column:
    """Comparison key: small ASCII letters, digits and Han characters; '' for null."""
    return F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), f"[^0-9a-z{HAN}]+", "")


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only, alike in every engine."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unaccent(c: Column) -> Column:
    """Latin letters without diacritics, combining marks dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[̀-ͯ]", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def clean_page(c: Column) -> Column:
    """Running text of a page: words broken at line ends joined, lines joined (Han lines without a space), widths folded."""
    c = F.regexp_replace(c, "­", "")
    c = F.regexp_replace(c, "([a-z])-\\n([a-z])", "$1$2")
    c = F.regexp_replace(c, f"([{HAN}])[ \\t]*\\n\\s*", "$1")
    c = F.regexp_replace(c, "[ \\t]*\\n\\s*", " ")
    return F.trim(F.regexp_replace(F.translate(c, WIDE, NARROW), "[ \\t]{2,}", " "))


def any_of(words: tuple | dict) -> str:
    """A pattern of words, or of kinds of words, without regard to case."""
    some = words if not isinstance(words, dict) else [w for kind in words.values() for w in ((kind,) if isinstance(kind, str) else kind)]
    return f"(?i){'|'.join(some)}"


IMPRINT, GREY, CONFERENCE, JOURNAL = any_of(NUMERATION), any_of(GREY_KINDS), any_of(VENUES["conference"]), any_of(VENUES["journal"])
ISSUE = r"[0-9]+ *[(（] *[0-9]+"
OWN = f"(?i)\\b(?:{'|'.join(OWN_WHO.values())}) (?:(?:also|then|here|further|first|therefore) )?(?:{OWN_DOES})[a-z]*\\b|{OWN_HAN}"


def good_abstract(c: Column, least: int = ABSTRACT_LEAST, head: int = ABSTRACT_HEAD) -> Column:
    """Whether a text reads like an abstract: long enough, and in front neither an imprint nor mostly capitalised words, as lists of names are."""
    c = F.trim(c)
    front = F.substring(c, 1, head)
    words, names = F.regexp_count(front, F.lit("[A-Za-z]{2,}")), F.regexp_count(front, F.lit("\\b[A-Z][a-z]+"))
    return F.coalesce((F.length(c) >= least) & ~front.rlike(IMPRINT) & (names <= ABSTRACT_NAMES * words), F.lit(False))


def tokens(c: Column) -> Column:
    """Small words and numbers as they are; of a Han run its pairs of neighbours."""
    runs = F.regexp_extract_all(ascii_lower(c), F.lit(f"[a-z0-9]+|[{HAN}]+"), 0)
    pairs = lambda x: F.when((x >= "一") & (F.length(x) > 1), F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.array(x))
    return F.flatten(F.transform(runs, pairs))


def reference_type(c: Column) -> Column:
    """Kind of a bibliography line: preprint wording, else the bracketed type code, else the venue's wording."""
    code = F.upper(F.regexp_extract(c, rf"\[ *({'|'.join(sorted([*TYPE_CODES, *OTHER_CODES], key=len, reverse=True))}) *(?:/ *OL)? *\]", 1))
    coded = F.create_map(*(F.lit(x) for pair in TYPE_CODES.items() for x in pair))[code]
    worded = F.when(c.rlike(CONFERENCE), "conference").when(c.rlike(JOURNAL) | c.rlike(ISSUE), "journal").when(c.rlike(r"https?://"), "web").otherwise("other")
    return F.when(c.rlike(PREPRINT_WORDS), "preprint").when(code != "", F.coalesce(coded, F.lit("other"))).otherwise(worded)


def grey_literature(raw: Column, venue: Column, doi: Column) -> Column:
    """Reports, web pages, data sets, software and drafts by their wording, what was accessed or is dated to a month, and
    entries with neither venue nor DOI."""
    text = F.concat_ws(" ", raw, venue)
    worded = text.rlike(GREY) | text.rlike(f"(?i){SEEN}|{DATED}")
    return F.coalesce(worded, F.lit(False)) | ((F.trim(F.coalesce(venue, F.lit(""))) == "") & doi.isNull())


def marker_numbers(c: Column) -> Column:
    """The numbers of a numeric marker; '3-5' gives 3, 4, 5 and '5-3' the same, however wide the range. Ends of over six
    digits are no places in a list and name nothing."""
    items = F.regexp_extract_all(c, F.lit(r"[0-9]+ *[-–] *[0-9]+|[0-9]+"), 0)
    low = lambda x: F.regexp_extract(x, "^[0-9]+", 0).try_cast("bigint")
    high = lambda x: F.regexp_extract(x, "[0-9]+$", 0).try_cast("bigint")
    place = lambda x: F.coalesce(F.greatest(low(x), high(x)) < 1_000_000, F.lit(False)) & low(x).isNotNull() & high(x).isNotNull()
    run = lambda x: F.sequence(F.least(low(x), high(x)), F.greatest(low(x), high(x)))
    return F.flatten(F.transform(F.filter(items, place), run))


def author_year_items(c: Column) -> Column:
    """STRUCT<names, year, suffix> of each item of a marker like '(Smith et al., 2019a; Lee, 2020)'."""
    inner = F.regexp_replace(c, r"^[ \t]*[\\(（\[]|[\\)）\]][ \t]*$", "")
    year = r"((?:19|20)[0-9][0-9])([a-z]?)"
    part = lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_extract(x, f"^(.*?)[,， (（]*{year}", 1), "[,， ]+$", "")).alias("names"), F.regexp_extract(x, year, 1).try_cast("bigint").alias("year"), F.regexp_extract(x, year, 2).alias("suffix"))
    return F.filter(F.transform(F.split(inner, "[;；]"), part), lambda x: (x["names"] != "") & x["year"].isNotNull())


def table_fragment(c: Column, whole: bool = False) -> Column:
    """Whether a text is a flattened table, by its shares of digits and colons; whole: long and without any sentence end."""
    compact = F.regexp_replace(c, r"\s+", "")
    n = F.length(compact)
    digits, colons = F.regexp_count(compact, F.lit("[0-9]")), F.regexp_count(compact, F.lit("[:：∶]"))
    dense = (digits >= TABLE_SHARES["digits"] * n) & (colons >= TABLE_SHARES["colons"] * n)
    if whole:
        return F.coalesce((n >= FLATTENED["characters"]) & (colons >= FLATTENED["colons"]) & dense & ~c.rlike(r"[。．！？!?]|\.(?:\s|$)"), F.lit(False))
    return F.coalesce((n >= FRAGMENT["characters"]) & (digits >= FRAGMENT["digits"]) & (colons >= FRAGMENT["colons"]) & dense, F.lit(False))


def too_short(c: Column) -> Column:
    """Whether a claim says too little to check: under 8 Han characters or, where words prevail, under 4 words."""
    han, words = han_characters(c), F.coalesce(F.regexp_count(c, F.lit("[A-Za-z0-9]+")), F.lit(0))
    return F.when((han > 0) & (han >= words), han < CLAIM_HAN).otherwise(words < CLAIM_WORDS)


def own_contribution(c: Column) -> Column:
    """Whether a sentence says what its author's own work does: a subject and a verb; "we" alone isn't enough."""
    return F.coalesce(c.rlike(OWN), F.lit(False))


def id_year(c: Column, pivot: int = CENTURY_PIVOT) -> Column:
    """The year in an identifier like 'pb:1407.47185' (two digits of the year, two of the month)."""
    yy = F.regexp_extract(c, r"([0-9]{2})[0-9]{2}[.]", 1)
    return F.when(yy != "", F.when(yy.try_cast("bigint") >= pivot, 1900 + yy.try_cast("bigint")).otherwise(2000 + yy.try_cast("bigint")))


def title_kind(c: Column) -> Column:
    """What a title announces: a correction, a reply, a survey, a case study or research."""
    return (
        F.when(c.rlike(r"(?i)^ *(?:correction|corrigendum|erratum)|^ *(?:更正|勘误)"), "correction").when(c.rlike(r"(?i)^ *(?:reply|response|comment)\b|^ *(?:答复|评论)"), "reply")
        .when(c.rlike(r"(?i)\b(?:survey|review|overview)\b|综述"), "survey").when(c.rlike(r"(?i)\bcase stud(?:y|ies)\b|案例"), "case").when(c.isNotNull(), "research")
    )


def clean_venue(c: Column) -> Column:
    """Key of a venue name: no leading proceedings words, dots or surplus spaces."""
    c = F.regexp_replace(ascii_lower(c), r"^ *(?:in:? +)?(?:proceedings|proc\.?)(?: of)?(?: the)? +", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[.,&]", " "), " +", " "))


def content_key(kind: str, *parts: Column) -> Column:
    """kind|sha256 of the parts; a null part differs from an empty one."""
    return F.concat(F.lit(kind + "|"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256))


def common_words(a: Column, b: Column) -> Column:
    """How many leading words two titles share."""
    x, y = F.split(F.trim(ascii_lower(a)), r"\s+"), F.split(F.trim(ascii_lower(b)), r"\s+")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("bigint")


def title_prefix(a: Column, b: Column, least: int = PREFIX_WORDS) -> Column:
    """Whether one title is the other's leading words, at least `least`, the other going on."""
    n = lambda c: F.size(F.split(F.trim(ascii_lower(c)), r"\s+"))
    k = common_words(a, b)
    return F.coalesce((k >= least) & (k == F.least(n(a), n(b))) & (n(a) != n(b)), F.lit(False))


def title_head(a: Column, b: Column, least: int = HEAD_WORDS, share: float = HEAD_SHARE) -> Column:
    """Whether two titles share `least` leading words and `share` of the shorter one."""
    n = lambda c: F.size(F.split(F.trim(ascii_lower(c)), r"\s+"))
    k = common_words(a, b)
    return F.coalesce((k >= least) & (k >= share * F.least(n(a), n(b))), F.lit(False))


def year_only_difference(a: Column, b: Column) -> Column:
    """Whether two different titles are the same but for the year numbers in them."""
    bare = lambda c: F.regexp_replace(ascii_lower(c), "(?:19|20)[0-9]{2}", "#")
    return F.coalesce((ascii_lower(a) != ascii_lower(b)) & (bare(a) == bare(b)), F.lit(False))


def edit_class(old: Column, new: Column) -> Column:
    """What a correction changes: spaces, width, hyphens, cuts, formulas (signs of mathematics or commands) or wording."""
    spaces = lambda c: F.regexp_replace(c, r"\s+", "")
    hyphens = lambda c: F.regexp_replace(spaces(c), "[-‐‑–]", "")
    return (
        F.when(old == new, "same").when(spaces(old) == spaces(new), "space").when(F.translate(old, WIDE, NARROW) == F.translate(new, WIDE, NARROW), "width")
        .when(hyphens(old) == hyphens(new), "hyphen").when(old.startswith(new) | new.startswith(old), "truncate").when(old.rlike(FORMULA) | new.rlike(FORMULA), "formula").otherwise("other")
    )


#: What stands before a stop without ending a sentence, in several languages, besides single letters.
SHORTENED = "Dr|Mr|Mrs|Ms|Prof|St|Figs?|Eqs?|Secs?|Tab|Nos?|Vol|pp|Ch|eds?|cf|vs|al|approx|resp|Refs?|etc|Abb|bzw|ca|Nr|Bd|vgl|usw|Kap|env|chap|fig|vol|no|pág|núm|рис|табл|см|стр|др"
ASIDE, HERE = "\x02", "\x03"
#: (pattern, replacement) in turn: marks are set aside, stops that end nothing are hidden, and a mark is put behind each end.
SPLITTING = [
    (f"[{ASIDE}{HERE}]", " "), (f"(^|[^\\p{{L}}])({SHORTENED}|\\p{{L}})[.]", f"{{1}}{{2}}{ASIDE}"),
    ("([.!?…]+[\"”’»)\\]]*(?:\\[[0-9, –-]*\\])?)(\\s+)([^\\s\\p{Ll}])", f"{{1}}{HERE}{{2}}{{3}}"), ("([。！？｡؟۔।॥]+[”’」』）)\\]》\"]*)", f"{{1}}{HERE}"),
]


def sentences(c: Column) -> Column:
    """ARRAY<STRUCT<start_pos, end_pos, text>>: the sentences of a text by its stops, with their places; null for null.

    A stop ends a sentence where white space and no small letter follows, closing quotes and a numeric citation with it;
    stops of scripts that write no spaces always do. Abbreviations, initials and decimals end nothing. Pieces without
    anything but white space are left out. Built-in expressions only; problem 4's operator learns what this takes from a list.
    """
    marked = c
    for pattern, put in SPLITTING:
        marked = F.regexp_replace(marked, pattern, put.replace("{1}", "$1").replace("{2}", "$2").replace("{3}", "$3"))
    pieces = F.split(marked, HERE, -1)
    none = F.array().cast("array<struct<start_pos:bigint,end_pos:bigint,text:string>>")

    def add(done: Column, piece: Column) -> Column:
        begin = F.regexp_replace(piece, "^\\s+", "")
        core = F.regexp_replace(begin, "\\s+$", "")
        start = done["at"] + F.length(piece) - F.length(begin)
        one = F.array(F.struct(start.cast("bigint").alias("start_pos"), (start + F.length(core)).cast("bigint").alias("end_pos"), F.translate(core, ASIDE, ".").alias("text")))
        return F.struct((done["at"] + F.length(piece)).cast("bigint").alias("at"), F.when(core == "", done["out"]).otherwise(F.concat(done["out"], one)).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), add, lambda done: done["out"])


#: Section kinds by the words in a title, the first kind that has one; a word in Latin letters must begin there.
HEADING_WORDS = {
    "related": ("related", "literature", "prior work", "previous", "state of the art", "相关工作", "文献综述", "研究现状", "stand der forschung", "état de l", "estado del arte", "trabajos relacionados"),
    "conclusion": ("conclu", "summary", "future work", "outlook", "closing", "结论", "总结", "结语", "展望", "fazit", "schluss", "ausblick"),
    "discussion": ("discuss", "limitation", "implication", "threats", "讨论", "局限", "启示", "diskussion", "discus", "ethic", "伦理"),
    "experiment": ("experiment", "result", "evaluation", "ablation", "finding", "baseline", "metric", "case study", "analysis of results", "实验", "结果", "评估", "评价", "消融", "案例", "ergebnis", "résultat", "resultado", "auswertung"),
    "method": ("method", "approach", "model", "architecture", "implementation", "procedure", "data", "design", "sampling", "statistic", "framework", "study area", "方法", "模型", "数据", "实现", "抽样", "框架", "method", "méthod", "métod", "verfahren"),
    "intro": ("introduc", "background", "motivation", "overview", "research question", "contribution", "引言", "绪论", "前言", "背景", "动机", "问题", "贡献", "einleitung", "einführung", "introducc"),
}


def heading_kind(c: Column) -> Column:
    """The canonical section that a title's words name, by ordered kinds; 'other' where none does, null for null or blank."""
    low = F.lower(c)
    out = F.when(F.trim(c) == "", F.lit(None).cast("string"))
    for kind, words in HEADING_WORDS.items():
        latin, han = [w for w in words if w[0] < "一"], [w for w in words if w[0] >= "一"]
        out = out.when(low.rlike(f"(?:^|[^\\p{{L}}])(?:{'|'.join(latin)})|{'|'.join(han)}"), kind)
    return out.when(c.isNotNull(), "other")


def fix_page(c: Column) -> Column:
    """Text of a page as taken from a PDF file: typographic ligatures as letters, control characters out, words broken at
    line ends joined, spaces before punctuation out."""
    for sign, plain in {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    c = F.regexp_replace(c, "[\x00-\x08\x0b\x0c\x0e-\x1f­]", "")
    c = F.regexp_replace(c, "([a-z])-[ \t]*\n[ \t]*([a-z])", "$1$2")
    return F.regexp_replace(c, " +([,.;:!?])", "$1")


TAIL_HEADS = "(?i)\\n[ \\t0-9.]*(?:references|bibliography|works cited|literaturverzeichnis|bibliographie|bibliografía|参考文献)[ \\t]*:?[ \\t]*\\n"


def without_tail(c: Column, share: float = 0.3) -> Column:
    """A text up to its last heading of a reference list, if that stands beyond `share` of it; else the whole."""
    parts = F.split(c, TAIL_HEADS, -1)
    tail = F.element_at(parts, -1)
    head = F.substr(c, F.lit(1), F.length(c) - F.length(tail))
    kept = F.regexp_replace(head, f"{TAIL_HEADS}$", "")
    return F.when((F.size(parts) > 1) & (F.length(kept) > share * F.length(c)), kept).otherwise(c)


def list_window(c: Column) -> Column:
    """Whether a window of text looks like entries of a reference list: several years, and signs of names, pages or DOIs."""
    years = F.regexp_count(c, F.lit("[(（ ,.](?:19|20)[0-9]{2}[a-z]?[)）.,; ]"))
    signs = F.regexp_count(c, F.lit("\\b[A-Z][.](?:[ -]?[A-Z][.])*,|\\bpp?[.] *[0-9]|[0-9]+ *[(][0-9]+[)] *[,:]|doi|10[.][0-9]{4}/|\\[[JMCDPR]\\]|\\bet al\\b"))
    return F.coalesce((years >= 2) & (signs >= 3) & (years * 400 >= F.length(c)), F.lit(False))


def short_number(c: Column) -> Column:
    """A measure for a screen: whole numbers without a point, below 1 three places, below 100 one, else none; '–' for null."""
    size = F.abs(c)
    at = lambda places: F.regexp_replace(F.format_string(f"%.{places}f", F.round(c, places)), "(\\.[0-9]*?)0+$", "$1")
    text = F.when(size >= 100, F.format_string("%.0f", F.round(c, 0))).when(size >= 1, at(1)).when(size < 1, at(3))
    return F.coalesce(F.regexp_replace(text, "\\.$", ""), F.lit("–"))


def short_range(low: Column, high: Column) -> Column:
    """A range for a screen; one number where both ends read alike, '–' where both are null."""
    a, b = short_number(low), short_number(high)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))
