"""Anchors of a request: quoted tokens, derived identifiers, keyword classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Keywords of each class, in the order that decides ties (fixed values).
DOMAINS = {
    "frontend": ["react", "vue", "css", "html", "ui", "component", "frontend", "browser"],
    "backend": ["api", "endpoint", "server", "database", "backend", "service", "controller"],
    "testing": ["test", "pytest", "playwright", "spec", "unit test", "e2e", "assertion"],
    "infrastructure": ["docker", "kubernetes", "ci", "pipeline", "deploy", "terraform", "infra"],
    "data": ["dataset", "schema", "migration", "sql", "etl", "data pipeline"],
    "documentation": ["readme", "docs", "documentation", "changelog"],
}
TASKS = {
    "bug_fix": ["fix", "bug", "broken", "failing", "error", "crash", "regression"],
    "feature": ["add", "implement", "create", "new feature", "support for"],
    "refactor": ["refactor", "clean up", "restructure", "simplify", "reorganize"],
    "documentation": ["document", "readme", "explain", "changelog"],
    "test": ["test", "coverage", "assert", "spec", "unit tests"],
}
AGENTS = ["er", "or"]
MOST_CANDIDATES, MORPH_WORD = 100, 3


def keyword_class(text: Column, classes: dict[str, list[str]], noun_suffix: str | None = None) -> Column:
    """The class with most of its keywords in a text, the first of equal ones, ``unknown`` for none. A keyword whose every
    occurrence goes on with ``noun_suffix`` doesn't count."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def present(k: str) -> Column:
        if noun_suffix:
            return (T.occurrences(low, F.lit(k)) > T.occurrences(low, F.lit(k + noun_suffix))).cast("int")
        return low.contains(k).cast("int")

    scores = F.array(*[sum((present(k) for k in ks[1:]), present(ks[0])) for ks in classes.values()])
    names = F.array(*[F.lit(c) for c in classes])
    # Bound as a lambda's variable, the scores are computed once; array_position gives the first of equal ones.
    best = F.transform(F.array(scores), lambda s: F.when(F.array_max(s) > 0, F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))).otherwise("unknown"))
    return F.element_at(best, 1)


def query_tokens(text: Column) -> Column:
    """Quoted tokens, file names and paths of a request, lower-cased, outer dots and slashes taken off, each once."""
    quoted = F.regexp_extract_all(text, F.lit("[`'\"]([^`'\"]{2,80})[`'\"]"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"\b\w[\w./\\-]*\.[A-Za-z0-9]{1,10}\b"), F.lit(0))
    paths = F.regexp_extract_all(text, F.lit(r"\b[\w-]+(?:/[\w.-]+){1,6}\b"), F.lit(0))
    clean = F.transform(F.concat(quoted, names, paths), lambda t: F.lower(F.regexp_replace(t, r"^[./\\]+|[./\\]+$", "")))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def morph_words(text: Column) -> Column:
    """Stems of the words of a request; make it a column of its own before ``morphological``, which uses it often."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= MORPH_WORD), lambda w: T.stem_suffix(F.lower(w)))


def morphological(ws: Column) -> Column:
    """Identifiers that neighbouring stems and stems with an agent's suffix may stand for; up to 100, in order."""
    cap = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))

    def pair(i: Column) -> Column:
        a, b = F.element_at(ws, i), F.element_at(ws, i + 1)
        joined, snake = F.concat(cap(a), cap(b)), F.concat_ws("_", a, b)
        out = [joined, F.concat(F.lit("_"), joined), snake]
        for s in AGENTS:
            out += [F.concat(joined, F.lit(s)), F.concat(F.lit("_"), joined, F.lit(s)), F.concat(snake, F.lit("_" + s))]
        return F.array(*out)

    def single(w: Column) -> Column:
        return F.array(*[x for s in AGENTS for x in (F.concat(cap(w), F.lit(s)), F.concat(F.lit("_"), cap(w), F.lit(s)), F.concat(w, F.lit(s)), F.concat(F.lit("_"), w, F.lit(s)))])

    n = F.size(ws)
    pairs = F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), pair))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(pairs, F.flatten(F.transform(ws, single)))), 1, MOST_CANDIDATES)


def file_blocks(text: Column) -> Column:
    """``path, content`` of fenced blocks under ``### path`` headers."""
    pattern = r"(?sm)^### (\S+)\r?\n```[^\n]*\r?\n(.*?)\r?\n```"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("path"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("content"))


def shares_root(text: Column, request: Column) -> Column:
    """Whether any probe prefix of a request occurs in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(T.probe_prefixes(request), lambda p: F.contains(low, p))
