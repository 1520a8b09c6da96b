"""Encoding of texts with a public byte-level BPE vocabulary through a lexicon of the corpus's frequent words."""

from __future__ import annotations

import base64
import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.transducer import Transducer, compile_words
from quire.session import busy, cut, largest, shared_folder

VOCABULARY = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte-level BPE of this vocabulary cuts text into words.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CUT = regex.compile(r"(?<=\S)(?= \S)")
BLOCK = 1_000_000


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, block by block; a block ends only where every cut into words has a boundary."""
    at = 0
    while len(text) - at > BLOCK:
        found = CUT.search(text, at + BLOCK)
        end = found.start() if found else len(text)
        yield PATTERN.findall(text[at:end])
        at = end
    yield PATTERN.findall(text[at:] if at else text)


@lru_cache(2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: join the adjacent pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    whole = [True] * n  # whether a part begins here
    queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, i, j, end = heappop(queue)
        if not whole[i] or after[i] != j or j >= n or not whole[j] or after[j] != end:
            continue  # one of the two has been joined since
        whole[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heappush(queue, (r, i, end, after[end]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end])) is not None:
            heappush(queue, (r, before[i], i, end))
    return [ranks[word[i : after[i]]] for i in range(n) if whole[i]]


@lru_cache(2)
def merger(path: str):
    """merge for the vocabulary at path."""
    ranks = ranks_of(path)
    return lambda word: merge(word, ranks)


def count_words(texts: DataFrame, column: str = "text", flush: int = 300_000) -> DataFrame:
    """word BINARY, n BIGINT: the occurrences of each word in all texts, pre-aggregated in each task."""

    def count(batches):
        seen: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in words_of(text or ""):
                    seen.update(words)
                if len(seen) > flush:
                    yield rows()
                    seen.clear()
        yield rows()

    parts = texts.select(column).where(F.col(column) != "").mapInArrow(count, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame, vocabulary: str, column: str = "text", words: int = 30_000) -> str | bytes:
    """Compiles the most frequent words of all texts, at most `words` of them, with their ids.

    Counts cover every text; the bound is on the lexicon only, and a word outside it is merged exactly where it occurs.
    Returns the path of the file in the shared folder, or, where that is no file system path, the bytes themselves, whose
    size the bound on words limits.
    """
    top = largest(cut(count_words(texts, column).where(F.length("word") <= 48)), "n", words).select("word").collect()
    encode = merger(vocabulary)
    data = compile_words([(w, encode(w)) for w in sorted(bytes(r.word) for r in top)])
    folder = shared_folder(texts.sparkSession)
    if folder.startswith("file:") or "://" not in folder:
        folder = os.path.join("/" + folder.removeprefix("file:").lstrip("/"), "quire-lexicon")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, hashlib.sha256(data).hexdigest()[:32])
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(data)
        os.replace(f"{path}.{os.getpid()}", path)
        return path
    return data


class Encoder:
    """Encodes batches of texts by a transducer, merging the words it lacks."""

    def __init__(self, source: str | bytes, vocabulary: str):
        self.net, self.merge = Transducer(source), merger(vocabulary)

    def block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each word has."""
        names = list(dict.fromkeys(words))
        coded = [w.encode() for w in names]
        ranks = self.net.rank(coded)
        known = ranks >= 0
        missing = [self.merge(coded[i]) for i in np.flatnonzero(~known)]
        sizes, begins = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        sizes[known] = self.net.starts[ranks[known] + 1] - self.net.starts[ranks[known]]
        begins[known] = self.net.starts[ranks[known]]
        sizes[~known] = lens = np.fromiter(map(len, missing), np.int64, len(missing))
        begins[~known] = len(self.net.outputs) + np.cumsum(lens) - lens
        pool = np.concatenate([self.net.outputs, np.fromiter((x for m in missing for x in m), np.int64, int(lens.sum()))])
        index = dict(zip(names, range(len(names))))
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        each = sizes[at]
        ends = np.cumsum(each)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - each, each)
        return pool[np.repeat(begins[at], each) + inside].astype(np.int32), each

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last's end. Null and empty texts have none."""
        ids, lens, words, spans = [], np.zeros(len(texts), np.int64), [], []

        def flush():
            if words:
                out, each = self.block(words)
                ends = np.concatenate([[0], np.cumsum(each)])
                at = 0
                for i, n in spans:
                    lens[i] += ends[at + n] - ends[at]
                    at += n
                ids.append(out)
                words.clear()
                spans.clear()

        for i, text in enumerate(texts):
            for some in words_of(text) if text else ():
                words.extend(some)
                spans.append((i, len(some)))
                if len(words) > 400_000:
                    flush()
        flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(lens)])


def encode_corpus(texts: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str | None = None, words: int = 30_000) -> DataFrame:
    """key, ids ARRAY<INT>: the ids of each text, without special tokens.

    Null and empty texts give an empty list, strings that look like special tokens are ordinary text, repeated rows are
    kept as they are, and other columns are ignored.
    """
    texts = busy(texts.select(key, column))
    vocabulary = vocabulary or f"{VOCABULARY}/byte_bpe_50k.tiktoken"
    source = lexicon(texts, vocabulary, column, words)
    if isinstance(source, bytes):
        shared = texts.sparkSession.sparkContext.broadcast(source)
        load = lambda: shared.value
    else:
        load = lambda: source

    def encode(batches):
        coder = None
        for batch in batches:
            coder = coder or Encoder(load(), vocabulary)
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, ends = coder.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], [key, "ids"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, column).mapInArrow(encode, f"{key} {kind}, ids array<int>")
