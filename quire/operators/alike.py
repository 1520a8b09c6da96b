"""All pairs of strings from a likeness on: blocks by length, an upper bound by letters, exact subsequences for the rest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.fuzzy import plain
from quire.session import cut, shared_folder, spread

# Strings of a block, steps of length bands, columns of the letter bound, pairs measured at a time, stretches measured first: these bound memory, not results.
BLOCK, STEP, COLUMNS, AT_ONCE, STRIDE = 1500, 1.15, 512, 1 << 14, 4
LETTERS = {c: i for i, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}
#: The first columns count the letters above, each up to EACH times with a column a time; all else shares the columns after them.
EACH = 10
OWN = len(LETTERS) * EACH
PLACES = np.array([LETTERS.get(chr(x), -1) for x in range(129)])  # the last stands for all others


@F.pandas_udf(StringType())
def arranged_udf(a: pd.Series) -> pd.Series:
    """The words that sorted_ratio compares: plain, in alphabetical order."""
    return a.map(lambda t: " ".join(sorted(plain(t).split())), na_action="ignore")


def bags(strings: list[str]) -> np.ndarray:
    """A row a string whose products with another's row are at least the number of letters both have.

    The k-th occurrence of a letter stands in its column k; columns may be shared, which only raises the product.
    """
    flat, owner, _ = letters_of(strings)
    order = np.lexsort((flat, owner))  # stable: equal letters of a string stand together
    char, row = flat[order].astype(np.int64), owner[order]
    new = np.ones(len(char), dtype=bool)
    new[1:] = (char[1:] != char[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(char))
    k = at - np.maximum.accumulate(np.where(new, at, 0))
    place = PLACES[np.minimum(char, len(PLACES) - 1)]
    column = np.where((place >= 0) & (k < EACH), place * EACH + k, OWN + (char * 31 + k * 7) % (COLUMNS - OWN))
    return np.bincount(row * COLUMNS + column, minlength=len(strings) * COLUMNS).astype(np.float32).reshape(len(strings), COLUMNS)


def letters_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all strings one after another, the string each stands in, and its place there."""
    n = np.array([len(s) for s in strings], dtype=np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
    return flat, np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)


class Measured:
    """Longest common subsequences of many pairs at once, 64 letters of the left string a machine word."""

    def __init__(self, left: list[str], right: list[str] | None = None):
        letters = {c: i for i, c in enumerate(sorted(set("".join(left))))}
        self.n = np.array([len(s) for s in left], dtype=np.int64)
        self.letters = np.array([ord(c) for c in letters], dtype=np.uint32)
        self.words, self.width = max(1, -(-int(self.n.max(initial=0)) // 64)), len(letters) + 1
        self.masks = np.zeros((self.words, len(left) * self.width), dtype=np.uint64)
        for i, s in enumerate(left):
            for k, c in enumerate(s):
                self.masks[k >> 6, i * self.width + letters[c]] |= np.uint64(1 << (k & 63))
        if right is not None:
            self.meet(right)

    def meet(self, right: list[str]) -> None:
        self.m = np.array([len(s) for s in right], dtype=np.int64)
        # a letter that no left string has, and what lies behind a string's end, have an empty mask and change nothing
        none = len(self.letters)
        self.codes = np.full((int(self.m.max(initial=0)), len(right)), none, dtype=np.int32)
        if none:
            flat, owner, place = letters_of(right)
            code = np.minimum(np.searchsorted(self.letters, flat), none - 1)
            self.codes[place, owner] = np.where(self.letters[code] == flat, code, none)

    def common(self, i: np.ndarray, j: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """start: only the stretch of the right string that begins there and is as long as the left one."""
        rows = np.full((self.words, len(i)), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        base = (i * self.width).astype(np.int32)
        if start is None:
            steps = self.codes[: int(self.m[j].max(initial=0))].take(j, axis=1)
        else:
            k = np.arange(int(self.n[i].max(initial=0)))[:, None]
            steps = np.where(k < self.n[i], self.codes[np.minimum(start + k, len(self.codes) - 1), j], np.int32(self.width - 1))
        steps += base
        mask, u, total = (np.empty(len(i), dtype=np.uint64) for _ in range(3))
        for at in steps:
            carry = None
            for w, row in enumerate(rows):
                self.masks[w].take(at, out=mask, mode="clip")
                np.bitwise_and(row, mask, out=u)
                np.add(row, u, out=total)
                if w + 1 < self.words or carry is not None:
                    over = total < u
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                np.bitwise_xor(row, u, out=row)
                np.bitwise_or(row, total, out=row)
        # only bits of the string count: no mask holds those behind its end
        out = np.zeros(len(i), dtype=np.int64)
        for w, row in enumerate(rows):
            held = np.clip(self.n[i] - 64 * w, 0, 64)
            kept = np.where(held == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(held, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(~row & kept)
        return out


def near(left: list[str], right: list[str], least: np.ndarray | float, part: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left and of right, and their ratio where it is `least` or more, which may differ from pair to pair.

    part: the best ratio of the shorter string with a stretch of the longer one of its length, in place of both whole strings.
    """
    n, m = (np.array([len(s) for s in x], dtype=np.float32) for x in (left, right))
    shorter = np.minimum(n[:, None], m[None, :])
    both = 2 * shorter if part else n[:, None] + m[None, :]
    least = np.broadcast_to(np.asarray(least, dtype=np.float64), both.shape)
    bound = np.minimum(bags(left) @ bags(right).T, shorter)
    bound *= 200
    open_ = bound >= least.astype(np.float32) * both - 0.05
    found = []
    # strings of up to 64 letters take one machine word; of a part, the shorter string is the left one
    for these in (n <= 64), (n > 64):
        at = np.nonzero(these)[0]
        for turned in (False, True) if part else (False,):
            i, j = np.nonzero(open_[at] & ((n[at][:, None] > m[None, :]) == turned) if part else open_[at])
            if not len(i):
                continue
            names = [left[k] for k in at], right
            measured = Measured(*(names[::-1] if turned else names))
            for k in range(0, len(i), AT_ONCE):
                x, y = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
                if part:
                    score = stretched(measured, *((y, x) if turned else (x, y)), least[at[x], y])
                else:
                    total = measured.n[x] + measured.m[y]
                    score = np.where(total == 0, 100.0, 200.0 * measured.common(x, y) / np.maximum(total, 1))
                hit = score >= least[at[x], y]
                found.append((at[x[hit]], y[hit], score[hit]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def stretched(measured: Measured, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The best ratio of each left string with a stretch of the right one of its length; 0 where it is under `least`.

    No stretch has more in common than the whole right string, and the next stretch one letter more at most; so every
    fourth is measured first, and of those between only what can still be best.
    """
    n, m = measured.n[i], measured.m[j]
    out = np.where((n == 0) & (m == 0), 100.0, 0.0)
    kept = np.nonzero((n > 0) & (100.0 * measured.common(i, j) >= least * n - 1e-6))[0]
    if not len(kept):
        return out
    best = np.zeros(len(i), dtype=np.int64)
    last = (m - n)[kept]
    coarse = last // STRIDE + 1 + (last % STRIDE > 0)  # each STRIDE-th and the last
    for a in range(0, len(kept), AT_ONCE // 16):
        part, ends, steps = kept[a : a + AT_ONCE // 16], last[a : a + AT_ONCE // 16], coarse[a : a + AT_ONCE // 16]

        def measure(row: np.ndarray, start: np.ndarray) -> np.ndarray:
            got = [measured.common(i[part[row[k : k + AT_ONCE]]], j[part[row[k : k + AT_ONCE]]], start[k : k + AT_ONCE]) for k in range(0, len(row), AT_ONCE)]
            got = np.concatenate(got) if got else np.zeros(0, dtype=np.int64)
            np.maximum.at(best, part[row], got)
            return got

        row = np.repeat(np.arange(len(part)), steps)
        start = np.minimum((np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)) * STRIDE, ends[row])
        got = measure(row, start)
        low = np.maximum(best[part] + 1, np.ceil(least[part] * n[part] / 100.0 - 1e-6))[row]
        more = [(row[k], start[k] + d) for d in range(1 - STRIDE, STRIDE) if d for k in [np.nonzero((got + abs(d) >= low) & (start + d >= 0) & (start + d <= ends[row]) & (abs(d) <= STRIDE // 2))[0]]]
        measure(np.concatenate([x[0] for x in more]), np.concatenate([x[1] for x in more]))
    out[kept] = 100.0 * best[kept] / n[kept]
    return out


def block_pairs(left: list[str], right: list[str], least: float) -> Iterator[pd.DataFrame]:
    """a, b, score of all pairs of two lists from `least` on."""
    i, j, score = near(left, right, least)
    names = np.array(left, dtype=object), np.array(right, dtype=object)
    yield pd.DataFrame({"a": names[0][i], "b": names[1][j], "score": score})


def likest(left: DataFrame, right: DataFrame, least: float, most: int) -> DataFrame:
    """a, b, score: of the distinct strings `b` of right those of the `most` highest ratios with each string `a` of left, from
    `least` on; all that are as like as the last of them as well, so whatever order settles ties finds its rows.

    All of right is written to the shared folder, in the order of length. A task takes a range of lengths of left and reads
    what lengths may fit, the nearest first; what a string's `most` highest ratios are so far bounds what is measured next,
    so no pair is lost that can be among them.
    """
    spark = left.sparkSession
    uri = f"{shared_folder(spark)}/likest-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(uri)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    right = right.where(F.col("b").isNotNull()).select("b").distinct().withColumn("n", F.length("b"))
    right.repartitionByRange(F.col("n")).sortWithinPartitions("n").write.option("parquet.block.size", 1 << 20).parquet(uri)
    left = cut(left.where(F.col("a").isNotNull()).select("a").distinct())
    parts = max(3 * spark.sparkContext.defaultParallelism, -(-left.count() // BLOCK))
    share = least / (200.0 - least)

    def search(batches):
        rows = [s for batch in batches for s in batch.column(0).to_pylist()]
        if not rows:
            return
        files, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
        known = ds.dataset(path, filesystem=files, format="parquet")
        rows.sort(key=len)
        short = sum(len(s) <= 64 for s in rows)
        blocks = [side[k : k + BLOCK] for side in (rows[:short], rows[short:]) for k in range(0, len(side), BLOCK)]
        for block in blocks:
            low, high, mid = len(block[0]), len(block[-1]), len(block[len(block) // 2])
            low, high = int(low * share - 1e-6), int(high / share + 1e-6) + 1
            best, kept = Best(block, least, most), []
            for a, b in (mid - 1, mid + 1), (low, mid - 2), (mid + 2, high):
                for batch in known.to_batches(columns=["b"], filter=(ds.field("n") >= a) & (ds.field("n") <= b), batch_size=2 * BLOCK, batch_readahead=1, fragment_readahead=1, use_threads=False):
                    if batch.num_rows:
                        kept.append(best.meet(batch.column(0).to_pylist()))
            i, names, score = (np.concatenate(c) if kept else np.zeros(0) for c in (zip(*kept) if kept else ((), (), ())))
            if len(i):
                keep = score >= best.need[i]
                yield pa.RecordBatch.from_arrays([pa.array([block[x] for x in i[keep]], pa.string()), pa.array(names[keep].tolist(), pa.string()), pa.array(score[keep], pa.float64())], ["a", "b", "score"])

    return left.repartitionByRange(parts, F.length("a"), F.xxhash64("a")).mapInArrow(search, "a string, b string, score double")


class Best:
    """Strings with the `most` highest ratios each has met so far; `need`: what a further one must have."""

    def __init__(self, left: list[str], least: float, most: int):
        self.measured, self.bags, self.least, self.most = Measured(left), bags(left), least, most
        self.top, self.need = np.zeros((len(left), most)), np.full(len(left), least)

    def meet(self, right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of left, strings of right and ratios of the pairs that reach what the rows need."""
        self.measured.meet(right)
        n, m = self.measured.n, self.measured.m
        # letters in common less what the ratio asks for, in one product
        ask = (self.need / 200.0).astype(np.float32)
        mine = np.hstack([self.bags, -(ask * n)[:, None].astype(np.float32), -ask[:, None]])
        other = np.hstack([bags(right), np.ones((len(right), 1), np.float32), m[:, None].astype(np.float32)])
        i, j = np.divmod(np.flatnonzero((mine @ other.T).ravel() >= -0.01), len(right))
        found = []
        for k in range(0, len(i), AT_ONCE):
            x, y = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            total = n[x] + m[y]
            score = np.where(total == 0, 100.0, 200.0 * self.measured.common(x, y) / np.maximum(total, 1))
            hit = score >= self.need[x]
            found.append((x[hit], y[hit], score[hit]))
        i, j, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((-score, i))
        row = i[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        few = rank < self.most
        more = np.zeros_like(self.top)
        more[row[few], rank[few]] = score[order][few]
        self.top = np.sort(np.hstack([self.top, more]), axis=1)[:, -self.most :]
        self.need = np.maximum(self.least, self.top[:, 0] - 1e-3)  # scores that are equal when rounded count as equal
        hit = score >= self.need[i]
        return i[hit], np.array(right, dtype=object)[j[hit]], score[hit]


def meeting(left: DataFrame, right: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column `pair`: rows of one group of `by` meet in exactly one pair, which holds about BLOCK rows a side.

    Large groups are cut into blocks on each side, small ones share pairs, so a pair may hold rows of several groups.
    """
    n = left.groupBy(by).agg(F.count("*").alias("na")).join(right.groupBy(by).agg(F.count("*").alias("nb")), by)
    large = F.greatest("na", "nb") > BLOCK // 4
    n = cut(n.select(by, "na", "nb", large.alias("large")))
    shared = max(1, -(-(n.where("NOT large").agg(F.sum(F.greatest("na", "nb"))).first()[0] or 0) // BLOCK))
    n = n.select(by, "large", F.ceil(F.col("na") / BLOCK).cast("int").alias("pa"), F.ceil(F.col("nb") / BLOCK).cast("int").alias("pb"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(n, by)
        mine = F.pmod(F.xxhash64(*(c for c in df.columns if c not in ("large", "pa", "pb"))), F.col(own)).cast("string")
        theirs = F.explode(F.sequence(F.lit(0), F.when(F.col("large"), F.col(other) - 1).otherwise(0)))
        df = df.withColumn("mine", mine).withColumn("theirs", theirs)
        ends = ("mine", "theirs") if own == "pa" else ("theirs", "mine")
        pair = F.when(F.col("large"), F.concat_ws("|", *ends, by)).otherwise(F.concat(F.lit("~"), F.pmod(F.xxhash64(by), F.lit(shared)).cast("string")))
        return spread(df.withColumn("pair", pair).drop("large", "pa", "pb", "mine", "theirs"), "pair")

    return dealt(left, "pa", "pb"), dealt(right, "pb", "pa")


def alike(left: DataFrame, right: DataFrame, least: float, by: str | None = None) -> DataFrame:
    """a, b, score: all pairs of the distinct strings `a` of left and `b` of right whose ratio is `least` or more.

    No pair is lost: a ratio of t needs lengths within t / (200 - t) of each other, and at least as many letters in common
    as the subsequence has. Strings are cut into bands of length and blocks of BLOCK; only blocks whose lengths can fit
    meet, each pair of them in one group. by: a column of both sides; only strings of the same group are compared, and the
    result bears it as well. A group is not cut by length.
    """
    keys = [by] if by else []

    def blocked(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        band = F.lit(0) if by else F.floor(F.log(F.length(name) + 1) / F.log(F.lit(STEP)))
        df = df.where(F.col(name).isNotNull()).select(*keys, name).distinct().withColumn("n", F.length(name)).withColumn("band", band)
        sizes = df.groupBy(*keys, "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        df = df.join(sizes if by else F.broadcast(sizes), [*keys, "band"]).withColumn("part", F.pmod(F.xxhash64(name), "parts"))  # without by one row a band
        df = df.select(*keys, name, "n", F.concat_ws("/", "band", "part").alias(f"block_{name}"))
        return df.select(*keys, name, f"block_{name}"), df.groupBy(*keys, f"block_{name}").agg(F.min("n").alias(f"low_{name}"), F.max("n").alias(f"high_{name}"))

    (a, at), (b, bt) = blocked(left, "a"), blocked(right, "b")
    share = least / (200.0 - least)
    fits = (F.col("high_b") >= share * F.col("low_a") - 1e-6) & (F.col("high_a") >= share * F.col("low_b") - 1e-6)
    meet = (at.join(bt, by) if by else at.crossJoin(bt)).where(fits).select(*keys, "block_a", "block_b")  # one row a pair of blocks
    pair = F.concat_ws("|", "block_a", "block_b", *keys).alias("pair")
    sides = spread(a.join(meet, [*keys, "block_a"]).select("a", pair, *(F.concat(k).alias("group") for k in keys)), "pair"), spread(b.join(meet, [*keys, "block_b"]).select("b", pair), "pair")
    kind = [f"group {left.schema[by].dataType.simpleString()}"] if by else []

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        got = list(block_pairs(x["a"].tolist(), y["b"].tolist(), least)) if len(x) and len(y) else []
        got = pd.concat(got) if got else pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str), "score": pd.Series(dtype=float)})
        if by:
            got.insert(0, "group", x["group"].iloc[0] if len(x) else None)
        return got

    out = sides[0].groupBy("pair").cogroup(sides[1].groupBy("pair")).applyInPandas(score, ", ".join([*kind, "a string, b string, score double"]))
    return out.withColumnRenamed("group", by) if by else out
