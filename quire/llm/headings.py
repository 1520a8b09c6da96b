"""Freely typed headings and section labels mapped to a list."""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalike import canonical
from quire.session import spread

# Words that carry no heading's meaning.
FILLER = set("the a an of and in on for to our this that overview brief study revised der die das des le la les l de du el los las".split())
CJK = "㐀-鿿豈-﫿"
NUMBERING = re.compile(rf"^[\s§#*]*(?:第[一二三四五六七八九十百\d]+[章节]|[一二三四五六七八九十]+[、.]|(?:section|chapter|part|kapitel|chapitre|capitulo)\s*\d+\s*[:.]?|\d+(?:\.\d+)*\s*[.):、]?(?=[\s{CJK}]|$)|[a-z]\)|(?:x{0,2}(?:ix|iv|v?i{1,3}|v)|x{1,2})[.)](?=\s|$)|§)\s*")
#: How like a word of the list a typed word must be to count at all.
LIKE = 0.55
SPACED = re.compile(r"(?<!\S)\w(?: \w)+(?!\S)")
TAIL = re.compile(r"\([^()]*\)\s*$|\s[:：].*$|[:：].*$|\bof the \S+ study\b|\bin brief\b|\band overview\b")


def words_of(text: str) -> list[str]:
    """The words of a heading as typed, in plain letters: without numbering, spread letters, digits for letters and signs."""
    text = unicodedata.normalize("NFKD", canonical(text))
    text = unicodedata.normalize("NFC", "".join(c for c in text if not unicodedata.combining(c))).casefold()
    text = re.sub(rf"(?<=[{CJK}])\s+(?=[{CJK}])", "", text.strip())
    for _ in range(2):
        text = NUMBERING.sub("", text, 1)
    text = re.sub(r"[^\w\s]|_", lambda m: " " if m[0] not in ".'’" else m[0], text)
    text = re.sub(r" ?\.", ". ", text) if re.search(r"\w \.", text) else text.replace(".", " . ")
    text = SPACED.sub(lambda m: m[0].replace(" ", "") if len(m[0]) >= 5 else m[0], text)
    text = re.sub(r"(?<=[a-z])1|1(?=[a-z]{2})", "l", text)
    text = re.sub(r"(?<=[a-z])0|0(?=[a-z]{2})", "o", text)
    return re.findall(r"[^\W_]+", text)


def body_of(text: str) -> str:
    """A heading without what its writer hung on: a parenthesis, what follows a colon, the study it is of."""
    kept = re.sub(r"^(\s*(?:section|chapter|part)\s*\d+)\s*:", r"\1 ", canonical(text).casefold())
    kept = TAIL.sub(" ", kept)
    return kept if words_of(kept) else text


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, change, swap of neighbours) from a to b, most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def likeness(a: str, b: str) -> float:
    """1 for equal words, a little less for a word cut short, else by edits; 0 if less than about half agrees."""
    if a == b:
        return 1.0
    if len(a) >= 3 and b.startswith(a):
        return 0.9
    n = max(len(a), len(b))
    d = distance(a, b, n // 2)
    return 1 - d / n if d <= n // 2 else 0.0


class Matcher:
    """An automaton over the names and other wordings of a list, and token-set similarity for what it finds nothing in."""

    def __init__(self, wordings: list[tuple[str, str]], none: str = "none", least: float = 0.7):
        self.none, self.least, self.seen, self.near = none, least, {}, {}
        self.net = ahocorasick.Automaton()
        self.names: list[tuple[str, list[str], str]] = []
        for target, wording in wordings:
            words = words_of(wording)
            name = " ".join(words)
            if not words:
                continue
            dense = bool(re.search(f"[{CJK}]", name))
            pattern = name.replace(" ", "") if dense else f" {name} "
            if pattern not in self.net:
                self.net.add_word(pattern, (len(pattern), target))
                self.names.append((target, [w for w in words if w not in FILLER] or words, name.replace(" ", "")))
        self.net.make_automaton()
        self.tokens = sorted({t for _, some, _ in self.names for t in some})
        self.having: dict[str, list[int]] = {}
        for i, (_, some, _) in enumerate(self.names):
            for t in set(some):
                self.having.setdefault(t, []).append(i)
        self.token_bags, self.name_bags = self._bags(self.tokens), self._bags([name for _, _, name in self.names])
        self.token_sizes, self.name_sizes = (np.array(list(map(len, x)), int) for x in (self.tokens, [name for _, _, name in self.names]))
        self.longest = max([0, *(sum(map(len, some)) for _, some, _ in self.names), *self.name_sizes.tolist()])

    @staticmethod
    def _bags(some: list[str]) -> np.ndarray:
        """How often each letter occurs, by 64 classes of letters."""
        out = np.zeros((len(some), 64), np.int16)
        for i, w in enumerate(some):
            np.add.at(out[i], np.fromiter(map(ord, w), np.int64, len(w)) % 64, 1)
        return out

    def like(self, word: str) -> dict[str, float]:
        """The list's words that are like enough to count. An edit distance is at least the length less the letters both hold."""
        if (got := self.near.get(word)) is None:
            if len(self.near) > 100_000:
                self.near.clear()
            got = {}
            if self.tokens:
                both = np.minimum(self.token_bags, self._bags([word])[0]).sum(1)
                for i in np.flatnonzero((both >= LIKE * np.maximum(self.token_sizes, len(word))) | (both >= min(len(word), 3))):
                    t = self.tokens[i]
                    if (both[i] >= LIKE * max(len(t), len(word)) or t.startswith(word)) and (x := likeness(word, t)) >= LIKE:
                        got[t] = x
            self.near[word] = got
        return got

    def mentions(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(length, start, target) of the longest non-overlapping mentions."""
        text = f" {' '.join(words)} "
        found = sorted(((size, end + 1 - size, target) for end, (size, target) in self.net.iter(text)), key=lambda x: (-x[0], x[1]))
        out: list[tuple[int, int, str]] = []
        for size, start, target in found:
            if all(start + size <= s + 1 or start >= s + n - 1 for n, s, _ in out):
                out.append((size, start, target))
        return out

    def similar(self, words: list[str]) -> tuple[float, str]:
        """The likest of all wordings, by the set of words and by the letters without spaces.

        Only wordings that can't reach `least` are left unscored: what shares no like word and too few letters, and, for a
        value of 2.7 times the letters of the longest wording, all of them, as most of its letters stay without a partner.
        """
        joined = "".join(words)
        own = [w for w in words if w not in FILLER] or words
        best = (0.0, self.none)
        if len(joined) <= 1.5 * self.longest + 1 and len(self.names):
            most = np.maximum(self.name_sizes, len(joined))
            both = np.minimum(self.name_bags, self._bags([joined])[0]).sum(1)
            for i in np.flatnonzero(both >= np.minimum(most - 1, 0.7 * most)):
                target, _, name = self.names[i]
                n = max(len(joined), len(name))
                d = distance(joined, name, n // 3)
                best = max(best, (1 - d / n if d <= max(1, n * 0.3) else 0.0, target))
        if sum(map(len, own)) <= 2.7 * self.longest:
            near = [(w, self.like(w)) for w in own]
            for i in {i for _, some in near for t in some for i in self.having[t]}:
                target, tokens, _ = self.names[i]
                left, gain = list(near), 0.0
                for t in tokens:
                    at = max(range(len(left)), key=lambda k: (left[k][1].get(t, 0.0), left[k][0]), default=None)
                    if at is not None and t in left[at][1]:
                        gain += left.pop(at)[1][t] * len(t)
                total = sum(map(len, tokens)) + 0.7 * sum(len(w) for w, _ in left)
                best = max(best, (gain / total, target))
        return best

    def match(self, text: str) -> str:
        if (got := self.seen.get(text)) is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            got = self.seen[text] = self._match(text)
        return got

    def _match(self, text: str) -> str:
        words = words_of(text)
        if not words:
            return self.none
        if found := self.mentions(words):
            return found[0][2]
        body = words_of(body_of(text))
        if found := self.mentions(body):
            return found[0][2]
        score, target = max(self.similar(words), self.similar(body))
        return target if score >= self.least else self.none


def matchers(catalog: list[tuple[str, str, str, list[str] | None]], headings: dict[str, list[str]], labels: dict[str, list[str]]) -> tuple[Matcher, Matcher]:
    """For headings and for section labels. catalog: entry_code, canonical, name, other_names."""
    titles, sections = [], [(k, x) for k, some in labels.items() for x in [*([k] if k != "none" else []), *some]]
    for code, section, name, others in catalog:
        mine = [name, *(others or [])]
        titles += [(code, x) for x in [*mine, *headings.get(name, [])] if x]
        sections += [(section, x) for x in mine if x]
    titles += [("none", x) for x in headings.get("none", [])]
    sections += [(k, k) for k in dict.fromkeys(section for _, section, _, _ in catalog) if k]
    return Matcher(titles), Matcher(sections)


def map_headings(sections: DataFrame, catalog: DataFrame, *, headings: dict[str, list[str]] | None = None, labels: dict[str, list[str]] | None = None, most_entries: int = 10_000) -> DataFrame:
    """section_id, field_name, target: what each non-blank title and canonical means, 'none' where it means no entry.

    Names, names in other languages and other wordings form one automaton; the longest mention that overlaps no longer
    one wins, the first of equal ones. A value without mention goes to the likest of all wordings by token-set similarity,
    if it is like enough. headings and labels: other wordings of the entries, by English name, and of the sections; those
    under 'none' mean nothing in the list. Null and blank values give no row, repeated rows count once, values of any
    length are searched whole. The list is collected: more than most_entries entries are refused. An empty list maps
    titles to 'none'.
    """
    entries = [tuple(r) for r in catalog.select("entry_code", "canonical", "name", "other_names").limit(most_entries + 1).collect()]
    if len(entries) > most_entries:
        raise ValueError(f"the list has more than {most_entries} entries")
    entries.sort(key=lambda r: r[0] or "")

    def run(batches):
        title, label = matchers(entries, headings or {}, labels or {})
        for batch in batches:
            fields, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [(title if f == "title" else label).match(t) for f, t in zip(fields, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["section_id", "field_name", "target"])

    values = sections.select(F.col("section_id").cast("string").alias("section_id"), F.expr("stack(2, 'title', title, 'canonical', canonical) AS (field_name, typed)"))
    values = values.where(F.col("typed").rlike(r"[^\s\p{Z}]"))
    # equal values meet in few tasks, which map them once each; a value that a third of the sections bear still fills no task
    spark = sections.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.hash("section_id"), F.lit(-(-tasks // 3)))
    return spread(values, F.col("typed"), salt).mapInArrow(run, "section_id string, field_name string, target string").distinct()


def unmatched(found: DataFrame, sections: DataFrame) -> DataFrame:
    """The values that mean no entry, with how often they were typed."""
    none = found.where("target = 'none'").select("section_id", "field_name")
    values = sections.select("section_id", F.expr("stack(2, 'title', title, 'canonical', canonical) AS (field_name, typed)")).distinct()
    return values.join(none, ["section_id", "field_name"]).groupBy("field_name", "typed").agg(F.count("*").alias("n_sections"))
