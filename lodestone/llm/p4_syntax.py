"""Source files that do not parse (problem 4).

Every file is lexed and its token classes are parsed with memoised derivatives (``derivatives``, ``grammars``): the first
token whose derivative is empty is the failing one, and a last derivative that isn't nullable says the file was cut off.
The parse is a narrow map over the files, so nothing but the verdicts (path, time, few numbers) is shuffled.

Null, empty and comment-only sources are valid; paths without one of the six extensions get no row; re-delivered files get
one row, that of the latest delivery. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = "file_path string, repo string, language string, status string, failing_line int, failing_token string, delivered timestamp"


def is_source(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(py|ts|js|java|go|rs)$")


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import grammars, lexing

    for batch in batches:
        paths, repos, sources, times = (batch.column(c) for c in ("file_path", "repo", "source_bytes", "delivered"))
        langs, status, lines, failed = [], [], [], []
        for path, source in zip(paths.to_pylist(), sources, strict=True):
            lang, text = lexing.language_of(path), lexing.decode(source.as_buffer() if source.is_valid else b"")
            verdict, at = grammars.parse(lang, text)
            langs.append(lang)
            status.append(verdict)
            if verdict == "broken":
                at, line, token = locate(lang, text, at)
                lines.append(line)
                failed.append(token[:40])
            else:
                lines.append(text.count("\n") + 1 if verdict == "truncated" else None)
                failed.append(None)
        yield pa.RecordBatch.from_arrays([paths, repos, pa.array(langs, pa.string()), pa.array(status, pa.string()), pa.array(lines, pa.int32()), pa.array(failed, pa.string()), times], ["file_path", "repo", "language", "status", "failing_line", "failing_token", "delivered"])


def locate(language: str, text: str, at: int) -> tuple[int, int, str]:
    """Index, line and text of the failing token; ``at`` counts the tokens that the grammar of the language sees."""
    from . import grammars, lexing

    memo = grammars.memo(language)
    for m in lexing.LEXERS[language].finditer(text):
        t = m.group(0)
        if language in ("java", "rust") and not memo[t]:
            continue
        if at == 0:
            return m.start(), text.count("\n", 0, m.start()) + 1, t
        at -= 1
    return len(text), text.count("\n") + 1, ""


def syntax_report(files: DataFrame) -> DataFrame:
    """One row per source file: ``status`` is ok, broken (with the failing line and token) or truncated."""
    verdicts = (
        files.filter(is_source(F.col("file_path")))
        .select("file_path", "repo", "source_bytes", F.col("ingested_at").cast("timestamp").alias("delivered"))
        .mapInArrow(parse_batches, VERDICTS)
    )
    last = F.max_by(F.struct("repo", "language", "status", "failing_line", "failing_token"), F.coalesce("delivered", F.lit("1970-01-01").cast("timestamp")))
    return verdicts.groupBy("file_path").agg(last.alias("v")).select("file_path", "v.*")


def found(files: DataFrame) -> DataFrame:
    return syntax_report(files).filter("status != 'ok'").select("file_path")


def rates(files: DataFrame) -> DataFrame:
    """Files, broken files and their share per repository and language."""
    return (
        syntax_report(files)
        .groupBy("repo", "language")
        .agg(F.count("*").alias("files"), F.count_if(F.col("status") != "ok").alias("broken"), F.count_if(F.col("status") == "truncated").alias("truncated"))
        .withColumn("share", F.round(F.col("broken") / F.col("files"), 6))
    )
