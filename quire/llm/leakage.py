"""Documents that hold passages of held-out items: template windows, slot consistency, alignment."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.lookalike import canonical
from quire.session import busy

CJK = "぀-ヿ㐀-鿿豈-﫿⼀-⿟"
TOKEN = re.compile(rf"\d+(?:[.,]\d+)+|[{CJK}]|(?:[^\W_{CJK}]|[̀-ͯ­​-‏⁠﻿])+")
WINDOW = 5
BAND = 24
#: The share of a stretch's slots that must agree.
SLOTS = 0.4
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Placeholders: a number, a name or another word that is no common one, a unit after a number.
NUMBER, NAME, UNIT = 1, 2, 3
#: Units of measure as they stand after a number, in plain letters.
UNITS = frozenset(
    "mm cm dm m km in inch inches ft feet yd mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours d day days week weeks month months year years ms ns "
    "hz khz mhz ghz pa kpa mpa bar n j kj w kw mw kwh v kv ma a c f k percent pct degree degrees usd eur gbp dollars euros pounds "
    "tag tage woche wochen monat monate jahr jahre stunde stunden jour jours semaine semaines mois an ans heure heures "
    "dia dias semana semanas mes meses ano anos hora horas 年 月 日 天 米 公里 千米 克 千克 公斤 吨 升 元 度 时 分 秒".split()
)


def plain(token: str) -> str:
    """A token without case, accents, width and look-alikes; a number without its points."""
    if not token.isascii():
        token = unicodedata.normalize("NFKD", canonical(token))
        token = "".join(c for c in token if not unicodedata.combining(c))
    return token.replace(".", "").replace(",", "").casefold()


def tokens_of(text: str) -> list[str]:
    if "-\n" in text or "­\n" in text:
        text = text.replace("-\n", "").replace("­\n", "")
    return TOKEN.findall(text)


class Codes(dict):
    def __init__(self, items: Items):
        self.items = items

    def __missing__(self, word: str) -> int:
        p = plain(word)
        kind = NUMBER if p[:1].isnumeric() else self.items.common.get(p, NAME)
        self[word] = code = self.items.literals.get(p, 0) << 32 | kind
        return code


class Items:
    """Passages of a bounded block of items, as template windows and as tokens to align with."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.keys = [k for k, _ in passages]
        raw = [tokens_of(p) for _, p in passages]
        small, spread = set(), {}
        for i, words in enumerate(raw):
            for w in words:
                if w[0].isnumeric():
                    continue
                p = plain(w)
                spread.setdefault(p, set()).add(i)
                if not w[0].isupper():
                    small.add(p)
        #: Words that stay literal in a template: those not only written as names.
        self.common = {w: n for n, w in enumerate((w for w in spread if w in small or len(spread[w]) >= 3), UNIT + 1)}
        self.literals = {p: n for n, p in enumerate(dict.fromkeys(plain(w) for words in raw for w in words), 1)}
        self.codes = Codes(self)
        self.tokens, self.weights, self.slots, self.bags, self.matchers = [], [], [], [], []
        hashes, owner, place = [], [], []
        for i, words in enumerate(raw):
            kind, lit = self.templates(x := self.code(words)), x >> 32
            self.tokens.append(lit.tolist())
            self.weights.append(np.array([len(w) for w in words], float))
            masks: dict[int, int] = {}
            for at, c in enumerate(self.tokens[-1]):
                masks[c] = masks.get(c, 0) | 1 << at
            heaviest = np.concatenate([[0.0], np.cumsum(np.sort(self.weights[-1])[::-1])])
            slots = sum(1 << int(at) for at in np.flatnonzero(kind <= UNIT))
            self.bags.append((masks, (heaviest / max(1.0, heaviest[-1])).tolist(), slots, {}))
            self.slots.append(np.concatenate([[0], np.cumsum(kind <= UNIT)]))
            if not len(words):
                continue
            size = min(WINDOW, len(words))
            h = self.hash(kind, size)
            thin = np.convolve(kind > UNIT, np.ones(size, int), "valid") < size // 2  # slots alone say nothing: literal there
            h = np.where(thin, self.hash(lit, size) ^ np.uint64(1), h)
            hashes.append(h)
            owner.append(np.full(len(h), i))
            place.append(np.arange(len(h)))
        self.sizes = sorted({min(WINDOW, len(t)) for t in self.tokens if t}, reverse=True)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = (np.concatenate(x)[order] if x else np.zeros(0, int) for x in (owner, place))
        self.hashes, self.first, self.times = np.unique(hashes[order], return_index=True, return_counts=True)
        #: Which low bits of a hash occur at all: what isn't here needs no search.
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(self.hashes & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
        self.windows = np.array([max(1, len(t) - WINDOW + 1) for t in self.tokens])
        self.total = np.array([w.sum() for w in self.weights])

    def code(self, words: list[str]) -> np.ndarray:
        """Each token's literal code, 0 for a word of no item, and below it its typed code."""
        if len(self.codes) > 400_000:  # what is here is only kept to save time
            self.codes = Codes(self)
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))

    @staticmethod
    def templates(codes: np.ndarray) -> np.ndarray:
        """The typed codes: a word that may be a unit is one where it follows a number."""
        kind, unit = codes & 0x7FFFFFFF, (codes >> 31 & 1).astype(bool)
        unit[1:] &= kind[:-1] == NUMBER
        unit[:1] = False
        return np.where(unit, UNIT, kind)

    @staticmethod
    def hash(codes: np.ndarray, size: int) -> np.ndarray:
        n = len(codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, codes = np.zeros(n, np.uint64), codes.astype(np.uint64)
        for k in range(size):
            out = (out ^ codes[k : k + n]) * BASE
            out ^= out >> np.uint64(29)
        return out

    def candidates(self, codes: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
        """(document, item, lowest, highest diagonal) of bands of diagonals that hold at least `least` of an item's windows.

        codes: of many documents in a row, of these sizes. A diagonal is a place in the document less the place in the item.
        """
        found = []
        ends = np.cumsum(sizes)
        doc, local = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        kind, lit = self.templates(codes), codes >> 32
        for size in self.sizes:
            if len(codes) < size or not len(self.hashes):
                continue
            whole = doc[size - 1 :] == doc[: len(doc) - size + 1]
            for h in (self.hash(kind, size), self.hash(lit, size) ^ np.uint64(1)):
                hit = np.flatnonzero(self.maybe[(h & np.uint64((1 << 21) - 1)).astype(np.int64)] & whole)
                at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                sure = self.hashes[at] == h[hit]
                hit, at = hit[sure], at[sure]
                if len(hit):
                    times = self.times[at]
                    upto = np.cumsum(times)
                    inside = np.arange(upto[-1]) - np.repeat(upto - times, times) + np.repeat(self.first[at], times)
                    found.append((np.repeat(hit, times), self.owner[inside], self.place[inside]))
        if not found:
            return []
        where, item, place = (np.concatenate(x) for x in zip(*found))
        diagonal = local[where] - place
        pair = doc[where].astype(np.int64) * len(self.keys) + item
        # a pair with fewer hits in all than a band needs has no band
        pairs, back, hits = np.unique(pair, return_inverse=True, return_counts=True)
        enough = (hits >= np.maximum(1, least * self.windows[pairs % len(self.keys)]))[back]
        diagonal, place, pair = diagonal[enough], place[enough], pair[enough]
        if not len(pair):
            return []
        low = diagonal + max(map(len, self.tokens))  # never below 0, wherever a document stands and however long an item is
        bands = int(low.max()) // BAND + 2
        out = []
        for shift in (0, BAND // 2):
            key = pair * bands + (low + shift) // BAND
            order = np.lexsort((place, key))
            k, p, d = key[order], place[order], diagonal[order]
            begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            upto = np.concatenate([begins[1:], [len(k)]])
            fresh = np.concatenate([[True], (p[1:] != p[:-1]) | (k[1:] != k[:-1])])
            count = np.add.reduceat(fresh.astype(np.int64), begins)
            owner = k[begins] // bands % len(self.keys)
            wide = (p[upto - 1] - p[begins] + 1) / self.windows[owner]
            for b in np.flatnonzero((count >= np.maximum(1, least * self.windows[owner])) & (wide >= 2 * least)):
                mine = d[begins[b] : upto[b]]
                out.append((int(k[begins[b]] // bands // len(self.keys)), int(owner[b]), int(mine.min()), int(mine.max())))
        return list(dict.fromkeys(out))  # both shifts may give the same band

    def search(self, keys: list, texts: list[str], least: float, share: float, agree: float, mode: str) -> list[tuple]:
        """(key, item) found in some documents, which are looked through together."""
        words = [tokens_of(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.code([w for some in words for w in some])
        ends = np.cumsum(sizes)
        held: dict[tuple[int, int], bool] = {}
        for d, item, low, high in self.candidates(codes, sizes, least):
            if not held.get((d, item)):
                lit = codes[ends[d] - sizes[d] : ends[d]] >> 32
                if not self.possible(item, lit, low, high, share, agree):
                    held.setdefault((d, item), False)
                    continue
                got, same, slots = self.stretch(item, lit, low, high)
                held[d, item] = got >= share and same >= agree and slots >= SLOTS
        return [(keys[d], i) for (d, i), yes in held.items() if yes == (mode == "held")]

    def possible(self, item: int, lit: np.ndarray, low: int, high: int, share: float, agree: float) -> bool:
        """Whether an alignment near these diagonals may reach `share` of the item: a bound that loses none.

        It can match no more of the item's heaviest words than the longest common subsequence has, which is found a machine
        word of the item at a time, and fill no more slots than have their word there; a stretch has at least as many slots
        as the item's stretch of that share with the fewest.
        """
        masks, heaviest, slots, fewest = self.bags[item]
        n = len(self.tokens[item])
        full = row = (1 << n) - 1
        seen = 0
        for c in filter(None, map(masks.get, lit[max(0, low - 16) : max(0, high + n + 16)].tolist())):
            u = row & c
            row = (row + u | row - u) & full
            seen |= c
        if heaviest[n - row.bit_count()] < agree * share:
            return False
        if share not in fewest:
            ends, marks = np.concatenate([[0.0], np.cumsum(self.weights[item])]), self.slots[item]
            upto = np.searchsorted(ends, ends[:-1] + share * ends[-1] - 1e-6)
            fewest[share] = min((int(marks[b] - marks[a]) for a, b in enumerate(upto) if b <= n), default=0)
        return fewest[share] <= 2 or (seen & slots).bit_count() >= SLOTS * fewest[share]

    def stretch(self, item: int, lit: np.ndarray, low: int, high: int) -> tuple[float, float, float]:
        """The share of the item in the best continuous stretch near these diagonals, how much of the stretch agrees, and
        how many of its slots do: the same words around other names and numbers are another item."""
        tokens, weights = self.tokens[item], self.weights[item]
        begin = max(0, low - 16)
        some = lit[begin : max(0, high + len(tokens) + 16)].tolist()
        if not self.matchers:
            self.matchers = [None] * len(self.tokens)
        m = self.matchers[item]
        if m is None:
            m = self.matchers[item] = SequenceMatcher(None, autojunk=False)
            m.set_seq2(tokens)
        m.set_seq1(some)
        ends = np.concatenate([[0.0], np.cumsum(weights)])
        slots, mean = self.slots[item], float(weights.mean())
        best, score, start, matched, filled, last = (0.0, 0, 0, 0.0, 0), 0.0, 0, 0.0, 0, None
        for a, b, n in m.get_matching_blocks():
            if not n:
                continue
            if last is not None:
                gap = max(ends[b] - ends[last[1]], (a - last[0]) * mean)
                score -= 1.5 * gap
            if last is None or score <= 0:
                score, start, matched, filled = 0.0, b, 0.0, 0
            gain = ends[b + n] - ends[b]
            score, matched, filled, last = score + gain, matched + gain, filled + int(slots[b + n] - slots[b]), (a + n, b + n)
            if score > best[0]:
                best = (score, start, b + n, matched, filled)
        span, all_slots = ends[best[2]] - ends[best[1]], slots[best[2]] - slots[best[1]]
        return (span / ends[-1], best[3] / span, best[4] / all_slots if all_slots > 2 else 1.0) if span else (0.0, 0.0, 0.0)


def _portions(keys: list, texts: list[str], most: int = 300_000):
    """Some documents at a time, by length."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield keys[a : b + 1], texts[a : b + 1]
            a, size = b + 1, 0
    if a < len(keys):
        yield keys[a:], texts[a:]


def leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", item: str = "item_id", share: float = 0.46, agree: float = 0.82, least: float | None = None, block: int = 20_000, mode: str = "held") -> DataFrame:
    """key, item of the documents that hold an item's passage, or one continuous stretch of at least `share` of it.

    Both sides become templates: numbers, units after them and names are typed placeholders, other words are stripped of case, accents,
    width and look-alikes. Windows of a document's template are looked up in a hash table of the items' windows; diagonals
    that hold enough of an item's windows are aligned word by word, which is where the slots must agree. mode 'held'
    returns the pairs whose stretch agrees literally; mode 'template' those that follow the whole template but fill its
    slots otherwise.

    `least` is the share of an item's windows that a band of diagonals must hold to be aligned: a tenth by default, which
    half a passage keeps where every sixth word is changed, and 0.4 for templates. Bounds of what an alignment can reach
    drop only pairs that it would refuse.

    Items are collected in blocks of at most `block`, each joined with all documents; share is a little under one half, as
    a changed word at the stretch's end is lost to it. Null and blank texts and passages give no row; repeated rows once.
    """
    least = least or (0.1 if mode == "held" else 0.4)
    docs = busy(documents.select(key, F.col("text")).where(F.col("text").isNotNull()))
    items = items.where(F.col("passage").isNotNull() & F.col(item).isNotNull()).select(item, "passage").distinct()
    blocks = max(1, -(-items.count() // block))
    item_type = items.schema[item].dataType
    kinds = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def search(rows: list[tuple]):
        def run(batches):
            net = Items(rows)
            for batch in batches:
                out = []
                for keys, texts in _portions(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.extend((k, net.keys[i]) for k, i in net.search(keys, texts, least, share, agree, mode))
                out = list(dict.fromkeys(out))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([i for _, i in out], to_arrow_type(item_type))], [key, item])

        return run

    parts = []
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64(item, "passage"), F.lit(blocks)) == b).orderBy(item).collect()]
        parts.append(docs.mapInArrow(search(rows), f"{key} {kinds[0]}, {item} {kinds[1]}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
