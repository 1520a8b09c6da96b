"""Sentence spans in any script: a hidden-event language model over candidate gaps, decided by forward-backward posteriors."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalike import canonical
from quire.session import busy, cut, largest

#: Scripts whose sentences end in a space only.
UNPUNCTUATED = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}"
HIDDEN = r"\p{Cf}­"
TOKEN = regex.compile(
    rf"""(?P<cite>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{{[^{{}}]*\}}|\[[\d,;\s–-]+\]|[(（][^()（）.!?。！？]{{0,60}}?(?:\s(?:et|и|und|y)\s(?:al|др)\.)?[^()（）.!?。！？]{{0,20}}?[12]\d{{3}}[a-z]?[)）])
    |(?P<number>\p{{N}}+(?:[.,]\p{{N}}+)*)
    |(?P<dense>[{DENSE}])
    |(?P<word>(?:[\p{{L}}--[{DENSE}]]|[\p{{M}}{HIDDEN}])+(?:['’](?:[\p{{L}}--[{DENSE}]]|[\p{{M}}{HIDDEN}])+)*)
    |(?P<stop>[.．!?。！？｡؟۔।॥…‼⁇⁈⁉]+)
    |(?P<space>\s+)
    |(?P<sign>.)""",
    regex.V1 | regex.X | regex.S,
)
OPEN = {"(": ")", "（": "）", "[": "]", "［": "］", "{": "}", "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "‘": "’", "‚": "‘’", "〔": "〕"}
CLOSE = set(")）]］}”“»›」』》〉】’\"〕‘")
AFTER = set(",;:，；：、،؛·-–—%")
SURE = set("!?。！？｡؟۔।॥‼⁇⁈⁉")
# Abbreviations that take a name or number after them, in several languages, without their stop.
ABBREVIATIONS = set(
    "dr mr mrs ms prof st fig figs eq eqs sec secs tab no nos vol pp p ch ed eds cf vs e.g i.e e g i approx resp ref refs bros dept univ gen col capt rev hon "
    "abb bzw ca nr bd vgl z b d h u a sog evtl hr fr abs kap tab zit insb "
    "m mm mme mlle c.-à-d p ex chap env tabl art "
    "pág págs núm sr sra dra ud art cap ej aprox "
    "рис табл см стр ок т ч е д проф им ул тыс млн "
    "د أ م डॉ श्री प्रो".split()
)

# Months that may follow an ordinal number with a stop.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())


def plain(word: str) -> str:
    """A word in small letters, look-alikes and hidden characters brought to one form."""
    return word.lower() if word.isascii() else canonical(canonical(word).lower())


ABBREVIATIONS |= {plain(w) for w in ABBREVIATIONS}
MONTHS |= {plain(w) for w in MONTHS}


#: The longest word before a stop that may turn out to be an abbreviation.
SHORT = 6


class Gap:
    """A place where a sentence may end; small: a small letter or a digit follows, which few beginnings do; short: the word
    before the stop may be an abbreviation, so the prior is that of a boundary if it is none."""

    __slots__ = ("at", "left", "right", "prior", "pair", "sure", "small", "short")

    def __init__(self, at, left, right, prior, pair=False, sure=False, small=False, short=False):
        self.at, self.left, self.right, self.prior, self.pair, self.sure, self.small, self.short = at, left, right, prior, pair, sure, small, short


def _bare(word: str) -> str:
    return regex.sub(rf"[{HIDDEN}]", "", word)


def shape(token: str) -> str:
    """The class of a token: script and case."""
    c = token[:1]
    if c.isnumeric():
        return "<0>"
    if not c.isalpha():
        return f"<{c}>"
    if c.isupper():
        return "<A>" if len(token) == 1 else "<Aa>"
    if c.islower():
        return "<a>"
    return f"<{ord(c) >> 7:x}>"


def scan(text: str) -> tuple[list[Gap], str, str]:
    """The gaps of a text where a sentence may end, and its first token and last left context.

    No gap lies inside brackets or quotation marks that close again, before a comma, colon or semicolon, or at the end of
    a mere line.
    """
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    n = len(tokens)
    closed: dict[int, int] = {}
    stack: list[tuple[int, str]] = []
    straight = [i for i, t in enumerate(tokens) if t[1] == '"']
    for a, b in zip(straight[::2], straight[1::2]):
        closed[a] = b
    for i, (kind, s, begin, end) in enumerate(tokens):
        if kind != "sign":
            continue
        if stack and s in stack[-1][1]:
            closed[stack.pop()[0]] = i
        elif s in OPEN and not (s == "‘" and begin and text[begin - 1].isalpha()):
            stack.append((i, OPEN[s]))
        elif s in CLOSE:
            for k in range(len(stack) - 1, -1, -1):
                if s in stack[k][1]:
                    closed[stack[k][0]] = i
                    del stack[k:]
                    break
    depth, change = 0, [0] * (n + 1)
    for a, b in closed.items():
        change[a] += 1
        change[b] -= 1
    inside = []
    for i in range(n):
        depth += change[i]
        inside.append(depth)
    ends = {b: a for a, b in closed.items()}

    thai = len(regex.findall(rf"[{UNPUNCTUATED}]", text))
    loose = thai > 3 and thai * 2 > len(regex.findall(r"\p{L}", text))
    words = [i for i, t in enumerate(tokens) if t[0] in ("word", "dense", "number", "cite")]
    first = next((_key(tokens[i]) for i in range(n) if tokens[i][0] != "space"), "")
    gaps: list[Gap] = []
    last_word = -1
    count = at_count = 0
    i = 0
    while i < n:
        kind, s, begin, end = tokens[i]
        if kind in ("word", "dense", "number", "cite"):
            last_word = i
            count += 1
        elif kind == "stop":
            j = i + 1
            while j < n and (tokens[j][1] in CLOSE and j in ends or tokens[j][0] == "cite" or tokens[j][0] == "stop"):
                j += 1
            level = inside[j - 1] if j - 1 < n else 0
            k = j
            while k < n and tokens[k][0] == "space":
                k += 1
            if level <= 0 and k < n and tokens[k][1][0] not in AFTER and not (tokens[k][0] == "sign" and k in ends):
                quoted = inside[i] > 0 and j > i + 1
                outer = [ends[x] for x in range(i + 1, j) if x in ends]
                before = max(0, min(outer, default=0) - 1)
                before -= tokens[before][0] == "space" and before > 0
                told = quoted and tokens[before][1] in (":", "：")  # someone was said to speak, so the quote ends the sentence
                spaced = k > j
                right = _key(tokens[k])
                left = _left(tokens, i, last_word)
                char = s[-1] if s[-1] in SURE else "…" if "…" in s or s.startswith("..") else "."
                gap = _gap(tokens[j - 1][3], left, char, right, tokens[k][1], spaced, quoted and not told, told, tokens[j - 1][0] == "cite")
                if gap:
                    gap.pair = count - at_count <= 1 and bool(gaps)
                    at_count = count
                    gaps.append(gap)
            i = j
            continue
        elif kind == "space" and loose and 0 < i < n - 1 and inside[i] == 0 and tokens[i - 1][0] != "stop":
            before, following = tokens[i - 1], tokens[i + 1]
            if before[1] not in AFTER and following[0] in ("word", "number") and not before[1] in OPEN:
                gaps.append(Gap(before[3], _before(before), _key(following), 0.5 if following[0] == "word" and not following[1][0].isascii() else 0.05))
        i += 1
    while n and tokens[n - 1][0] == "space":
        n -= 1
    last = ""
    if loose and n:
        last = _before(tokens[n - 1])
    elif n > 1 and tokens[n - 1][0] == "stop" and tokens[n - 1][1][-1] in ".．":
        last = "." + _left(tokens, n - 1, words[-1] if words else -1)
    return gaps, first, last


def _before(token: tuple) -> str:
    """What stands before a space that may end a sentence."""
    return "฀" + (_bare(token[1])[-4:] if token[0] == "word" and not token[1][-1:].isascii() else shape(token[1]))


def _key(token: tuple) -> str:
    kind, s, _, _ = token
    if kind == "number":
        return "<0>"
    if kind == "cite":
        return "<cite>"
    if kind == "word":
        bare = _bare(s)
        return bare[:4] if regex.match(rf"[{UNPUNCTUATED}]", bare) else bare or "<>"
    return s[:1]


def _left(tokens: list[tuple], i: int, last_word: int) -> str:
    """What stands before a stop: the word, or the class of anything else."""
    if i and last_word == i - 1 and tokens[last_word][0] == "word":
        return plain(_bare(tokens[last_word][1]))[-12:]
    if i and tokens[i - 1][0] == "number":
        return "<n>" if len(tokens[i - 1][1]) < 3 else "<0>"
    return "<cite>" if i and tokens[i - 1][0] == "cite" else "<x>"


def _gap(at: int, left: str, char: str, right: str, after: str, spaced: bool, quoted: bool, told: bool, cited: bool) -> Gap | None:
    c = after[:1]
    small = c.isalpha() and c.islower() and after.islower()
    if char in SURE:
        if told and not small:
            return Gap(at, f"{char}t", right, 0.98, False, True)
        if quoted and not spaced:
            return None  # who speaks follows
        prior = 0.15 if small else 0.55 if quoted else 0.98
        return Gap(at, f"{char}{'q' if quoted else ''}", right, prior, False, char in "。！？।" and not quoted and not small)
    caseless = c.isalpha() and not c.isupper() and not c.islower()
    if char == ".":
        if not spaced and not cited:
            if c.isdigit() or small or not c.isalpha():
                return None
            prior = 0.1 if len(left) <= 2 else 0.9 if caseless else 0.7
        elif small:
            prior = 0.02
        elif len(left) == 1 and left.isalpha() or left == "<n>" and plain(after) in MONTHS:
            prior = 0.03
        else:
            prior = 0.6 if c.isdigit() else 0.95
        if caseless and left == "al":
            prior = 0.02
        if quoted or told:  # an abbreviation hardly ends what is quoted
            return Gap(at, f".{left}”", right, prior)
        return Gap(at, f".{left}", right, prior, small=small or c.isdigit(), short=prior > 0.5 and (1 < len(left) <= SHORT and left[0] != "<" or left in ABBREVIATIONS))
    return Gap(at, f"…{'s' if spaced else ''}{'A' if c.isupper() else 'a' if small else ''}", right, 0.02 if small else 0.93 if spaced and c.isupper() else 0.5 if spaced else 0.1, False, False)


class Model:
    """Counts of an n-gram model with boundary tokens between words; keys of few counts fall back to their class.

    abbreviations: the posterior of each short word that it is an abbreviation.
    """

    def __init__(self, counts: dict[str, float] | None = None, abbreviations: dict[str, float] | None = None):
        self.n = counts or {}
        self.short = dict.fromkeys(ABBREVIATIONS, 0.999) if abbreviations is None else abbreviations

    @staticmethod
    def backoff(left: str) -> str:
        return left[0] + shape(left[1:]) if left[1:2] != "<" else left

    def prior(self, gap: Gap) -> float:
        if not gap.short:
            return gap.prior
        p = self.short.get(gap.left[1:], 0.0)
        return 0.03 * p + gap.prior * (1 - p)

    def log_odds(self, gap: Gap) -> float:
        """log P(boundary, next word | context) - log P(no boundary, next word | context)."""
        first = self.prior(gap)
        prior = math.log(first / (1 - first))
        if not self.n:
            return prior if gap.left[0] != "฀" else -30.0  # where no stop is written, only what is certain counts first
        get = self.n.get
        wide, kind = self.backoff(gap.left), shape(gap.right)
        b0, n0 = get("b|" + wide, 0.0) + 0.5 * first, get("n|" + wide, 0.0) + 0.5 * (1 - first)
        p0 = b0 / (b0 + n0)
        b1, n1 = get("b|" + gap.left, 0.0), get("n|" + gap.left, 0.0)
        others = max(0.0, b1 + n1 - 1) / max(1.0, b1 + n1)  # a gap's own count tells nothing
        b1, n1 = b1 * others, n1 * others
        p = (b1 + 4 * (0.5 * p0 + 0.5 * first)) / (b1 + n1 + 4)
        script = "t" if gap.left[0] == "฀" else ""
        total_s, total_n = get(f"s{script}|", 0.0) + 1, get(f"c{script}|", 0.0) + 1
        s_kind = (get(f"s{script}|{kind}", 0.0) + 0.5) / (total_s + 20)
        c_kind = (get(f"c{script}|{kind}", 0.0) + 0.5) / (total_n + 20)
        s_word = (get(f"s{script}|{gap.right}", 0.0) + 8 * s_kind * 0.05) / (total_s + 8)
        c_word = (get(f"c{script}|{gap.right}", 0.0) + 8 * c_kind * 0.05) / (total_n + 8)
        # what follows this very word, without and with a boundary, as far as it is known; a word's counts are kept together
        c_word *= (others * get(f"w|{gap.left} {kind}", 0.0) / c_kind + 10) / (n1 + 10)
        if not script:  # a space's neighbours are all of one script, where a boundary shows by the words alone
            s_word *= (others * get(f"v|{gap.left} {kind}", 0.0) / s_kind + 10) / (b1 + 10)
        # a long word that is no abbreviation ends its sentence, whatever often follows the others
        most = 1.5 if gap.left[0] == "." and len(gap.left) > 4 and gap.left[1] != "<" and self.short.get(gap.left[1:], 0.0) < 0.5 else 6.0
        # after the first round, gaps count as no boundaries, so those like a text's ends and beginnings stand out from below
        shift = 2.5 if script and not get("settled") else 0.0
        return shift + math.log(p / (1 - p)) + max(-most, min(most, math.log(s_word / c_word)))

    def posteriors(self, gaps: list[Gap]) -> list[float]:
        """P(boundary) of each gap by forward-backward; two boundaries with one word between them are improbable."""
        n = len(gaps)
        if not n:
            return []
        odds = [math.exp(max(-30.0, min(30.0, self.log_odds(g)))) for g in gaps]
        forward, a = [], (1.0, 0.0)
        for i, (g, o) in enumerate(zip(gaps, odds)):
            stay = a[0] + a[1]
            both = a[0] + a[1] * (0.05 if g.pair else 1.0)
            a = (stay, both * o)
            z = a[0] + a[1]
            a = (a[0] / z, a[1] / z)
            forward.append(a)
        out, b = [0.0] * n, (1.0, 1.0)
        for i in range(n - 1, -1, -1):
            f = forward[i]
            out[i] = f[1] * b[1] / (f[0] * b[0] + f[1] * b[1])
            k = 0.05 if gaps[i].pair else 1.0
            b = (b[0] + odds[i] * b[1], b[0] + k * odds[i] * b[1])
            z = b[0] + b[1]
            b = (b[0] / z, b[1] / z)
        return out

    def count(self, gaps: list[Gap], first: str, last: str, into: Counter) -> None:
        """Adds one text's expected counts; where it begins and ends, a boundary is certain."""
        script = "t" if regex.match(rf"[{UNPUNCTUATED}]", first) else ""
        into[f"s{script}|"] += 2
        into[f"s{script}|{first}"] += 2
        into[f"s{script}|{shape(first)}"] += 2
        for g, p in zip(gaps, self.posteriors(gaps)):
            script = "t" if g.left[0] == "฀" else ""
            kind = shape(g.right)
            for key, v in (("b|" + g.left, p), ("n|" + g.left, 1 - p), ("b|" + self.backoff(g.left), p), ("n|" + self.backoff(g.left), 1 - p)):
                into[key] += v
            for key in ("", g.right, kind):
                into[f"s{script}|{key}"] += p
                into[f"c{script}|{key}"] += 1 - p
            into[f"w|{g.left} {kind}"] += 1 - p
            into[f"v|{g.left} {kind}"] += p
        if last:
            into["b|" + last] += 2
            into["b|" + self.backoff(last)] += 2

    def cuts(self, gaps: list[Gap]) -> list[int]:
        """The numbers of the gaps where a sentence ends."""
        return [i for i, (g, p) in enumerate(zip(gaps, self.posteriors(gaps))) if g.sure or p > 0.5]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences of a text, without white space at their ends."""
        gaps, _, _ = scan(text)
        begin, end = ends_of(text)
        return spans_of(begin, end, [(gaps[i].at, after(text, gaps[i].at)) for i in self.cuts(gaps)])


def ends_of(text: str) -> tuple[int, int]:
    """Where a text begins and ends without the white space around it."""
    return len(text) - len(text.lstrip()), len(text.rstrip())


def after(text: str, at: int) -> int:
    """The first place from `at` on that is no white space."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def spans_of(begin: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for at, following in cuts:
        if begin < at:
            out.append((begin, at))
        begin = following
    return [*out, (begin, end)] if begin < end else out


def short_words(text: str) -> list[str]:
    """The words of a text that may be abbreviations but have no stop after them."""
    return [plain(w) for w in BARE_WORD.findall(text)]


BARE_WORD = regex.compile(rf"(?<![\p{{L}}\p{{M}}])[\p{{L}}\p{{M}}]{{2,{SHORT}}}(?![\p{{L}}\p{{M}}.．])")
# How often an abbreviation stands without its stop, ends a text, or has a small letter or digit after it.
BARE, FINAL, SMALL = 0.03, 0.01, (0.02, 0.7)


def is_abbreviation(word: str, bare: int, stops: int, final: int, small: int, final_share: float, small_share: float) -> float:
    """The posterior that a word is an abbreviation, from all its occurrences: how many stand without a stop, before one,
    end a text with it, and have a small letter or digit after it.

    Another word may stand before a stop at any rate, ends a text as often as stops do, and is followed as stops are. The
    prior falls with the length; a word of the list begins with even odds.
    """
    if len(word) > SHORT and word not in ABBREVIATIONS or not stops:
        return 0.0
    n = bare + stops
    odds = 0.0 if word in ABBREVIATIONS else -3.0 - 0.4 * len(word)
    odds += math.lgamma(n + 1) - math.lgamma(stops + 1) - math.lgamma(n - stops + 1) + stops * math.log(1 - BARE) + (n - stops) * math.log(BARE) + math.log(n + 1)
    odds += final * math.log(FINAL / final_share) + (stops - final) * math.log((1 - FINAL) / (1 - final_share))
    follow = max(0, stops - final)
    ways = [min(small, follow) * math.log(s / small_share) + max(0, follow - small) * math.log((1 - s) / (1 - small_share)) for s in SMALL]
    top = max(ways)
    odds += top + math.log(sum(math.exp(w - top) for w in ways) / len(ways))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


SCANNED = "key {0}, begin int, end int, at array<int>, following array<int>, lefts array<string>, rights array<string>, priors array<float>, flags array<int>, first string, last string, word string, n bigint"


def scanned(texts: DataFrame, flush: int = 300_000) -> DataFrame:
    """One row for each text of key, text, with its gaps, and one for each task's count of each short word (word not null)."""
    kind = texts.schema[0].dataType.simpleString()

    def run(batches):
        words: Counter = Counter()
        types = [pa.int32(), pa.int32(), *([pa.list_(pa.int32())] * 2), *([pa.list_(pa.string())] * 2), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = [c.strip().split(" ")[0] for c in SCANNED.split(",")]

        def counted(key_type):
            n = len(words)
            some = [pa.nulls(n, t) for t in types[:-2]]
            return pa.RecordBatch.from_arrays([pa.nulls(n, key_type), *some, pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                rows = []
                for text in some.column(1).to_pylist():
                    gaps, first, last = scan(text)
                    words.update(short_words(text))
                    rows.append((*ends_of(text), [g.at for g in gaps], [after(text, g.at) for g in gaps], [g.left for g in gaps], [g.right for g in gaps], [g.prior for g in gaps], [g.pair | g.sure << 1 | g.small << 2 | g.short << 3 for g in gaps], first, last, None, None))
                cols = list(zip(*rows)) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)
            if len(words) > flush:
                yield counted(key_type)
                words.clear()
        if words:
            yield counted(key_type)

    return texts.mapInArrow(run, SCANNED.format(kind))


def gaps_of(at, lefts, rights, priors, flags) -> list[Gap]:
    return [Gap(a, l, r, p, bool(f & 1), bool(f & 2), bool(f & 4), bool(f & 8)) for a, l, r, p, f in zip(at, lefts, rights, priors, flags)]


def learn_abbreviations(found: DataFrame, most: int = 20_000) -> dict[str, float]:
    """Posteriors of short words over all texts, where they are not near none; `most` words that stand before stops most often."""
    gaps = found.where("word IS NULL")
    stops = gaps.select(F.explode(F.arrays_zip("lefts", "flags")).alias("g")).where("left(g.lefts, 1) = '.' AND substring(g.lefts, 2, 1) <> '<'").select(F.expr("substring(g.lefts, 2)").alias("word"), F.lit(0).alias("final"), F.expr("cast(g.flags & 4 > 0 AS int)").alias("small"))
    last = gaps.where("left(last, 1) = '.' AND substring(last, 2, 1) <> '<'").select(F.expr("substring(last, 2)").alias("word"), F.lit(1).alias("final"), F.lit(0).alias("small"))
    by = cut(stops.unionByName(last).groupBy("word").agg(F.count("*").alias("stops"), F.sum("final").alias("final"), F.sum("small").alias("small")))
    whole = by.agg(F.sum("stops"), F.sum("final"), F.sum("small")).first()
    if not whole[0]:
        return {}
    final_share, small_share = (whole[1] + 1) / (whole[0] + 2), (whole[2] + 1) / (whole[0] + 2)
    top = largest(by.where(F.length("word") >= 2), "stops", most)
    n = found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).join(F.broadcast(top.select("word")), "word", "left_semi")
    rows = top.join(n, "word", "left").select("word", "n", "stops", "final", "small").collect()  # at most `most`
    told = {r.word: is_abbreviation(r.word, r.n or 0, r.stops, r.final, r.small, final_share, small_share) for r in rows}
    return dict.fromkeys(ABBREVIATIONS, 0.9) | {w: p for w, p in told.items() if p > 0.01 or w in ABBREVIATIONS}


def train(found: DataFrame, rounds: int = 3, most: int = 60_000, least: float = 2.0, flush: int = 300_000) -> Model:
    """Expectation-maximisation over the gaps of all texts.

    The model keeps the counts of the `most` words before or after gaps that occur most (at least `least` times), which
    bounds what is broadcast; all counts of a word stay or go together, and a word that goes falls back to its class.
    """
    short = learn_abbreviations(found)
    gaps = found.where("word IS NULL").select("at", "lefts", "rights", "priors", "flags", "first", "last")
    model = Model(abbreviations=short)
    for turn in range(rounds):

        def count(batches, model=model):
            seen: Counter = Counter()

            def rows():
                word = [k.split("|", 1)[1] if k[0] not in "wv" else k[2:].rsplit(" ", 1)[0] for k in seen]
                return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(list(seen), pa.string()), pa.array(list(map(float, seen.values())), pa.float64())], ["g", "k", "v"])

            for batch in batches:
                for at, lefts, rights, priors, flags, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                    model.count(gaps_of(at, lefts, rights, priors, flags), first, last, seen)
                if len(seen) > flush:
                    yield rows()
                    seen.clear()
            yield rows()

        parts = cut(gaps.mapInArrow(count, "g string, k string, v double").groupBy("g", "k").agg(F.round(F.sum("v"), 3).alias("v")))
        words = cut(parts.groupBy("g").agg(F.sum("v").alias("v")).where(F.col("v") >= least))
        kept = parts.join(F.broadcast(largest(words, "v", most).select("g")), "g", "left_semi")
        model = Model({r.k: r.v for r in kept.select("k", "v").where("v > 0").collect()} | ({"settled": 1.0} if turn else {}), short)
    return model


def split_sentences(paragraphs: DataFrame, leave_out: DataFrame | None = None, *, key: str = "para_id", column: str = "text") -> DataFrame:
    """key, start_pos, end_pos (code points from 0, end exclusive) of each sentence, distinct.

    Each text is scanned once, into its gaps; abbreviations, the model and the boundaries follow from those. The model is
    trained on all texts given. Together the spans of a text cover all but white space. Null and blank texts give no row;
    a text without a final stop is a sentence. leave_out: keys that are no case.
    """
    rows = busy(paragraphs.select(key, column).where(F.col(column).isNotNull()))
    found = cut(scanned(rows))
    model = train(found)

    def run(batches):
        for batch in batches:
            spans = []
            for begin, end, at, following, lefts, rights, priors, flags in zip(*(c.to_pylist() for c in batch.columns[1:])):
                gaps = gaps_of(at, lefts, rights, priors, flags)
                spans.append(spans_of(begin, end, [(at[i], following[i]) for i in model.cuts(gaps)]))
            kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"start_pos": a, "end_pos": b} for a, b in s] for s in spans], kind)], [key, "spans"])

    kind = paragraphs.schema[key].dataType.simpleString()
    texts = found.where("word IS NULL").select("key", "begin", "end", "at", "following", "lefts", "rights", "priors", "flags")
    out = texts.mapInArrow(run, f"{key} {kind}, spans array<struct<start_pos:int,end_pos:int>>")
    if leave_out is not None:
        out = out.join(leave_out.select(key), key, "left_anti")
    return out.distinct().select(key, F.explode("spans").alias("s")).select(key, "s.start_pos", "s.end_pos").distinct()
