"""Findings written back into LaTeX text, and small rule files read as tables."""

from __future__ import annotations

import difflib
import json
import os
import re
import tomllib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Environments above which a note about a line inside them goes.
BARRED = re.compile(r"\\(begin|end)\{(?:verbatim|lstlisting|minted|figure|table|tabular|longtable|equation|align)[*x]?\}")
NOTED = StructType([StructField("text", StringType()), StructField("diff", StringType())])


def note(text: str, lines: list[int], messages: list[str], path: str) -> tuple[str, str]:
    """The text with each message as a comment line above its line (1 is the first), and the unified diff.

    A line inside a listing, float or formula takes the place above it, lines beyond the text take the end; messages of one line keep their order, line breaks in them become spaces.
    """
    old = text.split("\n")
    at: dict[int, list[str]] = {}
    begins, depth = {}, []
    for n, line in enumerate(old, 1):  # a comment inside these would be printed, or end up in the wrong place
        if m := BARRED.search(line):
            depth += [n] if m[1] == "begin" else []
        begins[n] = depth[0] if depth else n
        if depth and BARRED.search(line) and BARRED.search(line)[1] == "end":
            depth.pop()
    for n, m in zip(lines, messages):
        at.setdefault(begins.get(min(max(n, 1), len(old) + 1), len(old) + 1), []).append("% NOTE: " + " ".join((m or "").split()))
    new = [x for i, line in enumerate([*old, None], 1) for x in (*at.get(i, ()), line) if x is not None]
    return "\n".join(new), "\n".join(difflib.unified_diff(old, new, path, path, lineterm=""))


def annotate(files: DataFrame, findings: DataFrame) -> DataFrame:
    """path, text, diff of the files that have findings. files: path, text; findings: path, line, message."""

    @F.pandas_udf(NOTED)
    def put(text: pd.Series, found: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([note(t or "", [f["line"] for f in fs], [f["message"] for f in fs], p) for t, fs, p in zip(text, found, path)], columns=["text", "diff"])

    grouped = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "message"))).alias("found"))
    return files.join(grouped, "path").select("path", put("text", "found", "path").alias("x")).select("path", "x.text", "x.diff")


def uncomment(text: str) -> str:
    """What annotate was given: the text without its notes."""
    return "\n".join(line for line in text.split("\n") if not line.startswith("% NOTE: "))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """id, name, aliases, doi_prefixes, numbers, rules (JSON) of each .toml or .json rule file below a folder of any file
    system; a file that can't be read is left out."""

    def parse(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = path.rpartition("/")[2]
                try:
                    got = tomllib.loads(content.decode()) if name.endswith(".toml") else json.loads(content)
                except ValueError:
                    continue
                many = lambda k: [str(x) for x in got.get(k) or []]
                detect = many("detect")
                rows.append({"id": str(got.get("id") or os.path.splitext(name)[0]), "name": got.get("name"), "aliases": many("aliases"), "doi_prefixes": [x for x in detect if x.startswith("10.")], "numbers": [x for x in detect if not x.startswith("10.")], "rules": json.dumps(got.get("rules", {}), sort_keys=True, ensure_ascii=False)})
            yield pa.RecordBatch.from_pylist(rows, REGISTRY)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{toml,json}").load(folder)
    return files.select("path", "content").mapInArrow(parse, "id string, name string, aliases array<string>, doi_prefixes array<string>, numbers array<string>, rules string")


REGISTRY = pa.schema([("id", pa.string()), ("name", pa.string()), ("aliases", pa.list_(pa.string())), ("doi_prefixes", pa.list_(pa.string())), ("numbers", pa.list_(pa.string())), ("rules", pa.string())])


def write_baseline(baseline: DataFrame, path: str) -> None:
    """Keeps the statistics of a group of manuscripts, a folder a group; texts are never written."""
    baseline.write.mode("overwrite").partitionBy("group").parquet(path)
