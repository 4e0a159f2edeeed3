"""Commands, events and reports that come and go as text."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import humanised, one_line

#: Commands of a live session (fixed values).
COMMANDS = ["start", "stop", "hints", "hint_now", "ask"]
_COMMAND = "type string, title string, record_audio boolean, mode string, enabled boolean, question string, segment_ids array<string>"
#: Megabytes in the units that container statistics use (fixed values).
UNITS = {"GiB": 1024.0, "MiB": 1.0, "KiB": 1 / 1024, "B": 1 / 1048576}


def commands(messages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(known commands as columns, the rest with a reason)."""
    parsed = messages.withColumn("_c", F.from_json(body, _COMMAND))
    known = F.coalesce(F.col("_c.type").isin(COMMANDS), F.lit(False))
    return parsed.filter(known).select("*", "_c.*").drop("_c"), parsed.filter(~known).withColumn("error", F.when(F.col("_c.type").isNull(), "not a command").otherwise("unknown command")).drop("_c")


def segment_ids(ids: Column) -> Column:
    """The whole numbers among what a client sent, as numbers or digits; anything else, 1.5 and 5.0 too, is left out."""
    return F.filter(F.transform(ids, lambda x: F.when(x.rlike("^-*[0-9]+$"), x.try_cast("long"))), lambda x: x.isNotNull())


def events(rows: DataFrame, kind: str, *fields: str) -> DataFrame:
    """Rows as one JSON text each, its type first; letters stay as they are."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *fields)).alias("value"))


def memory_mb(text: Column) -> Column:
    """The used part of texts such as 1.8GiB / 3GiB, in MB; 0 if unreadable."""
    pattern = r"^\s*([0-9.]+)\s*(GiB|MiB|KiB|B)"
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.regexp_extract(text, pattern, 2))
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double") * F.when(F.regexp_extract(text, pattern, 2) != "", scale), F.lit(0.0))


def junit_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of JUnit reports with their status."""
    schema = "_name string, _classname string, _time double, failure string, error string, skipped string"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return cases.select(F.col("_classname").alias("suite"), F.col("_name").alias("name"), F.col("_time").alias("seconds"), status.alias("status"))


def test_names(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) of the test functions in Python sources below a folder."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "test_*.py").text(folder, wholetext=True)
    names = F.regexp_extract_all("value", F.lit(r"(?m)^\s*(?:async\s+)?def\s+(test_\w+)"), F.lit(1))
    return text.select(F.col("_metadata.file_path").alias("path"), F.explode(names).alias("name"))


def test_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, title, parameters) of test functions: their docstring on one line or else their name's words, and how
    many cases their parameter lists name. A file that is no Python has none."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "test_*.py").text(folder, wholetext=True)

    @F.pandas_udf("array<struct<name:string,doc:string,parameters:long>>")
    def tests(sources: pd.Series) -> pd.Series:
        return pd.Series([_test_functions(s) for s in sources])

    found = text.select(F.col("_metadata.file_path").alias("path"), F.explode(tests("value")).alias("t"))
    doc = one_line(F.col("t.doc"))
    return found.select("path", "t.name", F.when(doc != "", doc).otherwise(humanised(F.col("t.name"))).alias("title"), "t.parameters")


def _test_functions(source: str) -> list[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("test_")]
    listed = lambda d: sum(len(a.elts) for a in d.args if isinstance(a, (ast.List, ast.Tuple)))
    marks = lambda n: [d for d in n.decorator_list if isinstance(d, ast.Call) and getattr(d.func, "attr", "") == "parametrize"]
    return [{"name": n.name, "doc": ast.get_docstring(n) or "", "parameters": sum(map(listed, marks(n)))} for n in found]


def usable_url(url: Column, hosts: list[str] | None = None) -> Column:
    """Web addresses with a host, of an allowed one where ``hosts`` are given."""
    host = F.try_parse_url(url, F.lit("HOST"))
    fine = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (host != ""), F.lit(False))
    return fine if hosts is None else fine & F.coalesce(host.isin(hosts), F.lit(False))


def error_detail(body: Column) -> Column:
    """The message of a JSON error, else the first 200 characters."""
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.left(body, F.lit(200)))
