"""Reading level of texts by a familiar-word formula: shares of words outside high-frequency lists, and sentence length."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import busy, cut, largest

LEVELS = 4
#: Lists are nested: list b holds the words that at least 2 ** (-b / 4) of all texts hold. The last place is for words on no list.
BANDS = 64
RUN = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W\d_぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)*")
STOP = re.compile(r"[.!?。！？؟।…]+")


def words_of(text: str) -> list[str]:
    """Lower-case words; of a script without spaces, the pairs of neighbouring characters."""
    out: list[str] = []
    for run in RUN.findall(text.lower()):
        if "぀" <= run[0] <= "鿿":
            out.extend([run[i : i + 2] for i in range(len(run) - 1)] or [run])
        else:
            out.append(run)
    return out


def document_frequencies(texts: DataFrame, languages: list[str], flush: int = 200_000) -> DataFrame:
    """word, df, by: how many texts hold the word, and how many of those of each language. texts: language, text."""
    place = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total: Counter = Counter()
        by: Counter = Counter()

        def rows():
            words = list(total)
            own = [[by[w, i] for i in range(len(languages))] for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["word", "df", "by"])

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(words_of(text))
                total.update(words)
                if (i := place.get(language)) is not None:
                    by.update((w, i) for w in words)
                if len(total) > flush:
                    yield rows()
                    total.clear()
                    by.clear()
        yield rows()

    parts = texts.where("text <> ''").mapInArrow(count, "word string, df bigint, by array<bigint>")
    sums = [F.sum(F.get("by", F.lit(i))).alias(f"l{i}") for i in range(len(languages))]
    return parts.groupBy("word").agg(F.sum("df").alias("df"), *sums).select("word", "df", F.array(*(F.col(f"l{i}") for i in range(len(languages)))).cast("array<bigint>").alias("by"))


class Lists:
    """Familiar words with the smallest list they are on and the language whose texts hold them most."""

    def __init__(self, rows: list[tuple[str, int, list[int]]], texts: int, languages: list[str]):
        self.languages = languages
        size = np.array([b for _, _, b in rows], float).reshape(len(rows), len(languages)).sum(0) + 1
        self.code = {}
        for word, df, by in rows:
            band = min(BANDS - 2, max(0, math.ceil(-4 * math.log2(df / max(1, texts)))))
            own = int(np.argmax(np.array(by) / size)) if sum(by) else len(languages)
            self.code[word] = own * BANDS + band

    def features(self, text: str) -> tuple[int, np.ndarray] | None:
        """The text's language, by its familiar words, and its terms: the share of words that each list adds, and sentence length.

        None for a text without words.
        """
        words = words_of(text)
        if not words:
            return None
        get, none = self.code.get, len(self.languages) * BANDS + BANDS - 1
        at = np.bincount([get(w, none) for w in words], minlength=none + 1).reshape(-1, BANDS)
        told = at[:-1].sum(1)
        language = int(told.argmax()) if len(told) and told.any() else len(self.languages)
        length = math.log(len(words) / max(1, len(STOP.findall(text))))
        return language, np.concatenate([at.sum(0) / len(words), [length, 1.0]])


class Formula:
    """Weights of the terms, for all languages together and what each language adds."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, common: np.ndarray, own: np.ndarray):
        self.mean, self.spread, self.common, self.own = mean, spread, common, own

    @staticmethod
    def wide(z: np.ndarray, language: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(z), n + 2, z.shape[1]))
        out[:, 0] = z
        out[np.arange(len(z)), language + 1] = z
        return out.reshape(len(z), -1)

    @classmethod
    def fit(cls, language: np.ndarray, x: np.ndarray, votes: np.ndarray, n: int, rounds: int = 1500, decay: float = 3e-4) -> Formula:
        """A multinomial logistic fit to votes (a row per text, a column per level) by accelerated gradient steps."""
        mean, spread = x.mean(0), x.std(0)
        mean[-1], spread[-1] = 0, 1
        spread[spread < 1e-6] = np.inf
        z = cls.wide((x - mean) / spread, language, n)
        weight = votes.sum(1, keepdims=True)
        top, v = 1.0, np.ones(z.shape[1])
        for _ in range(30):
            v = z.T @ (weight[:, 0] * (z @ v)) / weight.sum()
            top = float(np.linalg.norm(v)) or 1.0
            v /= top
        step = 1 / (0.5 * top + decay)
        w = before = np.zeros((z.shape[1], LEVELS))
        for k in range(rounds):
            ahead = w + k / (k + 3) * (w - before)
            p = np.exp((s := z @ ahead) - s.max(1, keepdims=True))
            before, w = w, ahead + step * (z.T @ (votes - weight * p / p.sum(1, keepdims=True)) / weight.sum() - decay * ahead)
        w = w.reshape(n + 2, x.shape[1], LEVELS)
        return cls(mean, spread, w[0], w[1:])

    def levels(self, language: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        return (z @ self.common + np.einsum("nf,nfl->nl", z, self.own[language])).argmax(1) + 1


def reading_levels(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", column: str = "text", language: str | None = "lang", labelled: int = 20_000, size: int = 60_000, least: int = 3, languages: int = 16) -> DataFrame:
    """key, level INT (1 to 4), one row for each distinct row of documents with words.

    The lists come from document frequencies over all texts and from nothing else: list b holds the words that at least
    2 ** (-b / 4) of all texts hold, the largest list at most the `size` words that most texts hold (`least` texts or
    more), which is what is broadcast with the task. A text's terms are the shares of its words outside each list and its
    mean sentence length. The terms' weights, which put the limits between the levels, are fitted to the votes of at most
    `labelled` labelled documents, chosen by digest of their key, for all languages together and for what each of the
    `languages` commonest adds; the language of a word and so of a text follows from the texts that hold it, and the
    column `language`, where there is one, is a hint that counts over the whole corpus only. Votes that are null or
    outside 1 to 4 are left out; raters who disagree both count. Null, blank and figures-only texts give no row. Without
    any vote, level is null.
    """
    given = labels.where(F.col("level").between(1, LEVELS)).groupBy(key).agg(*(F.count_if(F.col("level") == i + 1).alias(f"v{i}") for i in range(LEVELS)))
    given = given.where(F.col(key).isNotNull())
    few = given.withColumn("draw", F.pmod(F.xxhash64(key), F.lit(1 << 20)) + 1)
    votes = {r[0]: tuple(r[1:5]) for r in largest(cut(few), "draw", labelled).collect()} if few.count() > labelled else {r[0]: tuple(r[1:5]) for r in given.collect()}
    kind = documents.schema[key].dataType.simpleString()
    hint = F.lower(F.substring(F.trim(F.col(language)), 1, 2)) if language in documents.columns else F.lit(None).cast("string")
    documents = busy(documents.select(F.col(key).alias("k"), hint.alias("language"), F.col(column).alias("text")).where(F.col(column).isNotNull()))
    if not votes:
        lists, formula = Lists([], 0, []), None
    else:
        sizes = documents.where("text <> ''").groupBy("language").count().orderBy(F.desc("count"), "language").limit(languages + 1).collect()
        names = [r[0] for r in sizes if r[0]][:languages]
        known = cut(document_frequencies(documents.select("language", "text"), names).where(F.col("df") >= least))
        texts = documents.where("text <> ''").count()
        lists = Lists([tuple(r) for r in largest(known, "df", size).collect()], texts, names)
        some = documents.sparkSession.createDataFrame([(k,) for k in votes], f"k {kind}")
        rows = [(r.k, r.f) for r in _scored(documents.join(F.broadcast(some), "k"), lists, kind).collect()]  # no more than `labelled`
        formula = None
        if rows:
            x = np.array([f for _, f in rows])
            formula = Formula.fit(x[:, 0].astype(int), x[:, 1:], np.array([votes[k] for k, _ in rows], float), len(names))

    def judge(batches):
        for batch in batches:
            keys, some, x = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f := lists.features(text):
                    keys.append(k)
                    some.append(f[0])
                    x.append(f[1])
            level = formula.levels(np.array(some), np.array(x)) if formula and x else None
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array([None] * len(x) if level is None else level, pa.int32())], [key, "level"])

    return documents.select("k", "text").mapInArrow(judge, f"{key} {kind}, level int")


def _scored(documents: DataFrame, lists: Lists, kind: str) -> DataFrame:
    """k, f: the language's number and the terms of each text with words."""

    def score(batches):
        for batch in batches:
            rows = [(k, f) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (f := lists.features(t))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch.schema.field(0).type), pa.array([[float(i), *map(float, f)] for _, (i, f) in rows], pa.list_(pa.float64()))], ["k", "f"])

    return documents.select("k", "text").mapInArrow(score, f"k {kind}, f array<double>")
