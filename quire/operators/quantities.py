"""Numbers with their units and the words around them as a table, and claims whose numbers their source gives otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import HAN, NARROW, WIDE

# Numbers agree within this gap or this share of the larger; words looked at on each side; common ones needed.
SAME_GAP, SAME_SHARE, REACH, SHARED = 0.051, 0.01, 6, 2
NUMBER = "[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?"
#: Numbers, words, single Han characters, and signs that may stand for a unit.
PIECE = f"{NUMBER}|[a-zà-öø-ɏµ]+|[{HAN}]|[%‰°€$£]"


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(SAME_GAP), SAME_SHARE * F.greatest(F.abs(a), F.abs(b)))


def quantities(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, at, value, unit, context: each number that a unit follows. context: words of four letters and pairs of Han
    characters within six pieces on each side; unit: the next piece, an English plural as its singular.

    A row per number, by built-in expressions only; null texts give none.
    """
    plain = F.lower(F.translate(F.col(text), WIDE, NARROW))
    rows = texts.select(key, F.regexp_extract_all(plain, F.lit(PIECE), 0).alias("pieces")).select(key, "pieces", F.posexplode("pieces").alias("at", "piece"))
    after = F.get("pieces", F.col("at") + 1)
    rows = rows.where(F.col("piece").rlike(f"^{NUMBER}$")).withColumn("unit", after).where(F.col("unit").isNotNull() & ~F.col("unit").rlike("^[0-9]"))

    def words(begin: Column, n: Column) -> Column:
        some = F.slice("pieces", begin, n)
        pairs = F.zip_with(some, F.slice("pieces", begin + 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        return F.concat(F.filter(some, lambda w: w.rlike("^[a-zà-öø-ɏµ]{4,}$")), F.filter(pairs, lambda w: w.rlike(f"^[{HAN}]{{2}}$")))

    low = F.greatest(F.col("at") - REACH, F.lit(0))
    context = F.array_distinct(F.concat(words(low + 1, F.col("at") - low), words(F.col("at") + 3, F.lit(REACH))))
    unit = F.regexp_replace("unit", "^(.{3,})s$", "$1")
    return rows.select(key, "at", F.regexp_replace("piece", ",", "").cast("double").alias("value"), unit.alias("unit"), context.alias("context"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """pair, claimed, given: of each pair the first number of the claim that the source gives otherwise.

    pairs: pair, claim, source. The source must hold a number of the same unit with two common context words (the most
    common ones count, then the first); no number of the source may be close to the claimed one, and no sum, difference,
    product or quotient of two of its numbers of that unit. Pairs with a null text give no row. Joined on pair and unit;
    what is gathered is the numbers of one text.
    """
    number = F.lower(F.translate("source", WIDE, NARROW))
    every = F.transform(F.regexp_extract_all(number, F.lit(NUMBER), 0), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    mine = quantities(pairs.where("source IS NOT NULL"), "pair", "claim")
    theirs = quantities(pairs.where("claim IS NOT NULL"), "pair", "source").groupBy("pair", "unit").agg(F.sort_array(F.collect_list(F.struct("at", "value", "context"))).alias("given"))
    p = mine.join(theirs, ["pair", "unit"]).join(pairs.select("pair", every.alias("every")), "pair").where(~F.exists("every", lambda x: close(x, F.col("value"))))
    best = F.array_max(F.transform("given", lambda g: F.struct(F.size(F.array_intersect(g["context"], F.col("context"))).alias("common"), (-g["at"]).alias("place"), g["value"].alias("value"))))
    made = lambda a, b: F.array_compact(F.array(a + b, F.abs(a - b), a * b, F.try_divide(a, b), F.try_divide(b, a)))
    derived = F.exists("given", lambda x: F.exists("given", lambda y: (y["at"] > x["at"]) & F.exists(made(x["value"], y["value"]), lambda z: close(z, F.col("value")))))
    told = p.withColumn("best", best).where((F.col("best.common") >= SHARED) & ~derived)
    first = told.withColumn("n", F.row_number().over(Window.partitionBy("pair").orderBy("at", "unit"))).where("n = 1")
    return first.select("pair", F.col("value").alias("claimed"), F.col("best.value").alias("given"))
