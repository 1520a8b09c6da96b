"""Which files of a folder are the manuscript, its side papers and its library, from names and times alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
# Names of folders that hold what is cited, and words in the names of papers that go with a manuscript.
LIBRARIES = ("references", "reference", "refs", "ref", "literature", "library", "papers", "pdfs", "参考文献", "文献")
BESIDE = "(?i)cover|response|rebuttal|letter|diff|回复|说明|修改|对照|投稿信"


def folder_layout(spark: SparkSession, path: str) -> DataFrame:
    """folder, kind, paper, library, others of each folder directly below path.

    kind: docx, tex or unknown. paper: the Word file at the folder's top that was changed last, papers that go with one only
    where there is no other; for LaTeX the folder. library: the subfolder named like one that holds a PDF file, else, for
    folders without LaTeX, the only one with three or more. others: the other Word files. Only names and times are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    inner = F.split(F.substring_index("path", path.removeprefix("file:").rstrip("/") + "/", -1), "/")
    f = files.select("path", "modificationTime", inner.alias("p")).where("size(p) >= 2").select(c("p")[0].alias("folder"), F.size("p").alias("depth"), c("p")[1].alias("sub"), F.element_at("p", -1).alias("name"), "path", "modificationTime").where(~c("name").rlike(r"^[.~]"))
    low = F.lower("name")
    top = c("depth") == 2
    word = top & low.endswith(".docx")
    order = F.struct((~c("name").rlike(BESIDE)).alias("main"), c("modificationTime").alias("at"), "path")
    per = f.groupBy("folder").agg(F.max(F.when(word, order)).alias("best"), F.bool_or(top & low.endswith(".tex")).alias("tex"), F.sort_array(F.collect_set(F.when(word, c("path")))).alias("word"))
    subs = f.where((c("depth") > 2) & low.endswith(".pdf")).groupBy("folder", "sub").agg(F.count("*").alias("n"))
    named = F.lower("sub").isin(*LIBRARIES) | F.lower("sub").endswith(" ref")
    libs = subs.groupBy("folder").agg(F.min(F.when(named, c("sub"))).alias("named"), F.count_if(c("n") >= 3).alias("many"), F.min(F.when(c("n") >= 3, c("sub"))).alias("full"))
    kind = F.when(c("best").isNotNull(), "docx").when(c("tex"), "tex").otherwise("unknown")
    out = per.join(libs, "folder", "left").withColumn("kind", kind)
    library = F.coalesce("named", F.when((c("kind") != "tex") & (c("many") == 1), c("full")))
    paper = F.when(c("kind") == "docx", c("best.path")).when(c("kind") == "tex", c("folder"))
    return out.select("folder", "kind", paper.alias("paper"), library.alias("library"), F.array_except("word", F.array(paper)).alias("others"))
