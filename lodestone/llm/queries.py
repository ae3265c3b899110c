"""The queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, table
from . import p1_documentation, p2_unwritten, p3_splitting, p4_syntax, p5_pairs, p6_tokenizer, p7_leaks, p8_stuffing


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(*(table(spark, sf_dir, t) for t in tables))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _over(p1_documentation.found, "symbols", "files"),
    "p1_pairs": _over(p1_documentation.pairs, "symbols", "files"),
    "p2_found": _over(p2_unwritten.found, "candidates", "packaged_files", "files"),
    "p2_report": _over(p2_unwritten.report, "candidates", "packaged_files", "files"),
    "p3_found": _over(p3_splitting.found, "packaged_files", "split_limits"),
    "p3_pieces": _over(p3_splitting.pieces, "packaged_files", "split_limits"),
    "p4_found": _over(p4_syntax.found, "files"),
    "p4_rates": _over(p4_syntax.rates, "files"),
    "p5_found": _over(p5_pairs.found, "runs"),
    "p5_rates": _over(p5_pairs.rates, "runs"),
    "p6_ids": _over(p6_tokenizer.encode, "documents"),
    "p7_found": _over(p7_leaks.found, "documents", "eval_items"),
    "p7_items": _over(p7_leaks.items_leaked, "documents", "eval_items"),
    "p8_found": _over(p8_stuffing.found, "documents"),
    "p8_scores": _over(p8_stuffing.scored, "documents"),
}

ORACLE: dict[str, str] = {
    "p3_found": """
        SELECT DISTINCT p.item_id FROM packaged_files p JOIN split_limits l ON coalesce(p.language, '*') = l.language
        WHERE ceil(length(p.content) / 4.0) > l.max_tokens""",
}
