"""Relevance of candidates from their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights by the first word of a reason, and by profile; ``*`` stands for all other words (fixed values).
REASON_WEIGHTS = {"defines": 1.0, "calls": 0.7, "called": 0.7, "extends": 0.6, "references:": 0.8, "*": 0.3}
PROFILES = {
    "unknown": REASON_WEIGHTS,
    "bug_fix": {"defines": 1.0, "calls": 0.95, "called": 0.95, "imports": 0.7, "extends": 0.5, "references:": 0.85, "evidence:": 0.3, "*": 0.2},
    "refactor": {"extends": 1.0, "defines": 0.85, "calls": 0.9, "called": 0.9, "imports": 0.8, "references:": 0.7, "evidence:": 0.3, "*": 0.25},
    "explanation": {"defines": 0.9, "evidence:": 0.85, "references:": 0.7, "imports": 0.5, "calls": 0.4, "called": 0.4, "extends": 0.4, "*": 0.4},
    "architecture": {"defines": 1.0, "evidence:": 0.75, "imports": 0.7, "references:": 0.6, "calls": 0.4, "called": 0.4, "extends": 0.4, "*": 0.35},
    "ci_cd": {"evidence:": 1.0, "references:": 0.8, "defines": 0.5, "imports": 0.3, "calls": 0.2, "called": 0.2, "extends": 0.2, "*": 0.4},
    "performance": {"defines": 0.9, "calls": 1.0, "called": 1.0, "imports": 0.6, "extends": 0.5, "references:": 0.7, "evidence:": 0.3, "*": 0.25},
}
PROFILES["large_structural_change"] = PROFILES["refactor"]
ENTRY_BONUS, IMPACT_BONUS, IMPACT_CAP = 0.2, 0.1, 5
#: Added before scores are rounded, so that ties of the last digit go up whatever the binary value.
TIE = 1e-9
DECAY = 0.6


def verb(reason: Column) -> Column:
    return F.element_at(F.split(F.coalesce(reason, F.lit("")), " "), 1)


def weight(reason: Column, profile: str | Column = "unknown") -> Column:
    """Weight of a reason by its first word, for a profile or a column of profiles; literals, so nothing is joined."""

    def of(name: str) -> Column:
        out = F.lit(PROFILES[name]["*"])
        for word, w in PROFILES[name].items():
            if word != "*":
                out = F.when(verb(reason) == word, F.lit(w)).otherwise(out)
        return out

    if isinstance(profile, str):
        return of(profile)
    out = F.lit(None).cast("double")
    for name in PROFILES:
        out = F.when(profile == name, of(name)).otherwise(out)
    return out


def relevance(c: DataFrame, profile: str | Column = "unknown", entry: str = "is_entry", impact: str = "impact") -> Column:
    """Capped sum of weight, entry bonus and impact bonus, times the three confidences, null ones as 1."""
    base = F.least(weight(F.col("reason"), profile) + F.when(F.col(entry), ENTRY_BONUS).otherwise(0.0) + F.least(F.col(impact), F.lit(IMPACT_CAP)) / IMPACT_CAP * IMPACT_BONUS, F.lit(1.0))
    for confidence in ("anchor_confidence", "ambiguity_confidence", "path_mask_confidence"):
        base = base * F.coalesce(F.col(confidence), F.lit(1.0))
    return F.round(base + TIE, 4)


def rank(c: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Ranks by score; ties keep the order of the input, which ``input_pos`` and the path carry."""
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "input_pos", "file_path")))


def hop(reason: Column) -> Column:
    """Hop that a reason names; 1 where it names none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(reason, F.lit("")), r"\(hop (\d+)\)", 1), F.lit("")), F.lit("999")).cast("int"), F.lit(1))


def decay(confidence: Column, hop: Column) -> Column:
    return F.round(confidence * F.pow(F.lit(DECAY), hop), 6)
