"""Functions and predicates on paths, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SKIPPED_DIRECTORIES = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", ".next", "target", "vendor"]
SENSITIVE = [".env", ".env.*", "*.pem", "*.key", "id_rsa", "id_rsa.*", "*credentials*", "*.p12", "*.pfx", "secrets.*", "*.secret"]
GENERATED_PATHS = ["/generated/", "/.generated/", "/__generated__/"]
GENERATED_SUFFIXES = ["_pb2.py", "_pb2_grpc.py", ".g.cs", ".g.dart", ".pb.go", ".freezed.dart", ".designer.cs"]
GENERATED_MARKERS = ["@generated", "do not edit", "code generated by", "this file is auto-generated", "<auto-generated"]
DISPATCH_MARKERS = ["getattr(", "setattr(", "importlib.import_module(", "@inject", "reflect.", "class.forname(", "activator.createinstance("]
NOISY_SEGMENTS = ["test", "tests", "testdata", "examples", "example", "benchmark", "benchmarks"]


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def extension(path: Column) -> Column:
    """Last extension of a path with its dot, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the root ``''`` last."""
    ps = F.split(directory, "/")
    up = F.transform(F.sequence(F.size(ps), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(ps, 1, n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))


def name_prefix(path: Column) -> Column:
    """What precedes the first underscore of a file's name, extension aside."""
    return F.element_at(F.split(file_stem(path), "_"), 1)


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob whose ``*`` crosses directories; understood alike by Java and RE2."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([.^$+{}()|\[\]\\])", r"\\\1", c) for c in re.sub(r"\*+", "*", pattern)) + "$"


def matches_any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(glob_regex(p))
    return out


def matches_glob(path: Column, patterns: list[str]) -> Column:
    """Whether any glob matches the whole path or the file's name."""
    return matches_any(path, patterns) | matches_any(basename(path), patterns)


def contains_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def is_sensitive(path: Column) -> Column:
    return matches_any(F.lower(basename(path)), SENSITIVE)


def is_skipped(path: Column) -> Column:
    """Whether a directory above a file is one that scans leave out."""
    return F.arrays_overlap(F.split(dirname(path), "/"), F.array(*[F.lit(x) for x in SKIPPED_DIRECTORIES]))


def is_generated(path: Column, content: Column) -> Column:
    low = F.lower(path)
    suffix = F.lit(False)
    for s in GENERATED_SUFFIXES:
        suffix = suffix | low.endswith(s)
    return contains_any(low, GENERATED_PATHS) | suffix | F.coalesce(contains_any(F.lower(F.left(content, F.lit(500))), GENERATED_MARKERS), F.lit(False))


def has_dynamic_dispatch(content: Column) -> Column:
    return F.coalesce(contains_any(F.lower(content), DISPATCH_MARKERS), F.lit(False))


def is_noisy(path: Column) -> Column:
    """Tests, examples and benchmarks."""
    stem = file_stem(path)
    return F.arrays_overlap(F.split(F.lower(dirname(path)), "/"), F.array(*[F.lit(x) for x in NOISY_SEGMENTS])) | F.lower(stem).rlike(r"^test_|(^|[_.])tests?$|\.spec$") | stem.rlike("[a-z0-9]Tests?$")


def is_document(path: Column) -> Column:
    return F.lower(basename(path)).rlike(r"^(readme|changelog|contributing|history)(\.\w+)?$") | extension(path).isin(".md", ".rst", ".txt")


def is_within(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    return (start >= outer_start) & (end <= outer_end)


def clean(path: Column) -> Column:
    """A path without leading ``./``."""
    return F.regexp_replace(path, r"^(\./)+", "")
