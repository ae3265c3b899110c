"""Sources and sinks: directory scans, JSON task suites, manifests, alias configurations, documentation prose, ledger exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P

MAX_FILES, MAX_DOCUMENTS, MAX_DOCUMENT_CHARS = 20_000, 200, 50_000
SUITE = "tasks array<struct<id:string,category:string,subcategory:string,repo_key:string,task_prompt:string,expected_grounding:array<string>,expected_path_prefixes:array<string>,bug_fixture:struct<file_path:string,find:string,replace:string>,verify_command:string>>"


def scan_directory(spark: SparkSession, root: str, most: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """Files below a root, skipped directories and sensitive names left out, the first ``most`` in the order of paths, and a
    one-row table ``truncated``. The cap is the scan's own feature. Contents are read only by queries that select them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^" + "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in base) + "/", "")
    f = raw.withColumn("file_path", rel).filter(~P.is_skipped(F.col("file_path")) & ~P.is_sensitive(F.col("file_path")))
    f = f.select("file_path", P.extension(F.col("file_path")).alias("extension"), F.col("length").alias("size_bytes"), F.col("content").alias("source_bytes"))
    return f.orderBy("file_path").limit(most), f.agg((F.count("*") > most).alias("truncated"))


def within(path: Column, root: str) -> Column:
    """Whether a normalised path lies under a root."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/\./", "/"), r"/[^/]+/\.\.(?=/|$)", "")
    return (plain == root.rstrip("/")) | (plain.startswith(root.rstrip("/") + "/") & ~plain.contains("/../"))


def read_text(files: DataFrame) -> DataFrame:
    """Contents as text, invalid bytes replaced; sensitive files have none."""
    return files.withColumn("content", F.when(~P.is_sensitive(F.col("file_path")), F.make_valid_utf8(F.col("source_bytes").cast("string"))))


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a JSON suite, one row each."""
    return spark.read.schema(SUITE).json(path, multiLine=True).select(F.inline("tasks"))


def dependencies(files: DataFrame) -> DataFrame:
    """``file_path, name``: dependency names of package manifests: JSON dependencies, TOML tables and requirement lines."""
    name = P.basename(F.col("file_path"))
    js = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    a = files.filter(name == "package.json").select("file_path", js.alias("j")).select("file_path", F.explode(F.concat(F.coalesce(F.map_keys("j.dependencies"), F.array().cast("array<string>")), F.coalesce(F.map_keys("j.devDependencies"), F.array().cast("array<string>")))).alias("name"))
    lines = F.filter(F.transform(F.split("content", "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    b = files.filter(name.rlike("^requirements.*[.]txt$")).select("file_path", F.explode(F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^([A-Za-z0-9_.-]+)", 1)))).alias("name"))
    project = F.regexp_extract_all(F.regexp_extract("content", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([A-Za-z0-9_.-]+)"), F.lit(1))
    poetry = F.regexp_extract_all(F.regexp_extract("content", r"(?s)\[tool\.poetry\.dependencies\](.*?)(\n\[|\z)", 1), F.lit(r"(?m)^([A-Za-z0-9_.-]+)\s*="), F.lit(1))
    c = files.filter(name == "pyproject.toml").select("file_path", F.explode(F.transform(F.concat(project, poetry), F.lower)).alias("name"))
    return a.unionByName(b).unionByName(c).filter("name != '' and name != 'python'").distinct()


def path_aliases(files: DataFrame) -> DataFrame:
    """``file_path, pattern, position, target`` of alias configurations: JSON with comments."""
    plain = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)^\s*//.*$", "")
    c = F.from_json(plain, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")
    f = files.filter(P.basename(F.col("file_path")).isin("tsconfig.json", "jsconfig.json")).select("file_path", c.alias("c"))
    return f.select("file_path", F.coalesce("c.compilerOptions.baseUrl", F.lit(".")).alias("base"), F.explode("c.compilerOptions.paths").alias("pattern", "targets")).select("file_path", "base", "pattern", F.posexplode("targets").alias("position", "target"))


def doc_prose(files: DataFrame) -> DataFrame:
    """The first 200 documentation files of each repository by path, 50 000 characters of each."""
    d = files.filter(P.is_document(F.col("file_path"))).withColumn("_r", F.row_number().over(Window.partitionBy("repo").orderBy("file_path")))
    return d.filter(F.col("_r") <= MAX_DOCUMENTS).select("repo", "file_path", F.left(F.make_valid_utf8(F.col("source_bytes").cast("string")), F.lit(MAX_DOCUMENT_CHARS)).alias("content"))


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, every value quoted, quotes doubled; arrays become their lengths."""
    flat = rows.select(*[F.size(c).alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("map", "struct")) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown_table(rows: DataFrame, most: int = 1_000) -> str:
    """A small result as a Markdown table, in its own order; nulls are dashes. More than ``most`` rows raise an error, as a report
    is read by people and made by the driver."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    text = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in got])
