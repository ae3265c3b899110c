"""Pieces of SQL that several checks share."""

from __future__ import annotations

from ..functions.text import STOPWORDS


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[A-Za-z][A-Za-z0-9_]*')"


def parts(text: str) -> str:
    joined = f"replace(coalesce(array_to_string({words(text)}, ' '), ''), '_', ' ')"
    return rf"string_split_regex(lower(regexp_replace(regexp_replace({joined}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' +')"


STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def plural(w: str) -> str:
    return f"""CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {w}[:-4] || 'y'
        WHEN regexp_matches({w}, '(ches|shes|sses|xes|zes)$') THEN {w}[:-3]
        WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(us|is|ss)$') THEN {w}[:-2] ELSE {w} END"""


def verb(w: str) -> str:
    return f"""CASE WHEN regexp_matches({w}, '[aeiou].*ing$') AND length({w}) > 5 THEN {w}[:-4]
        WHEN {w} NOT LIKE '%ing' AND regexp_matches({w}, '[aeiou].*ed$') AND length({w}) > 4 THEN {w}[:-3] ELSE {w} END"""


def tokens(name: str, source: str, keys: str, text: str) -> str:
    """CTEs that end in ``name(keys, term)``, a row per token of each text of ``source``."""
    return f"""
    {name}_w AS (SELECT {keys}, unnest({parts(text)}) AS w FROM {source}),
    {name}_p AS (SELECT {keys}, w, {plural("w")} AS s FROM {name}_w WHERE length(w) >= 2 AND w NOT IN ({STOP})),
    {name} AS (SELECT {keys}, CASE WHEN length(w) <= 3 THEN w ELSE {verb("s")} END AS term FROM {name}_p)"""
