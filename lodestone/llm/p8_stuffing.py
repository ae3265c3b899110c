"""Keyword-stuffed and link-list pages (problem 8).

Four figures describe a document, none of which knows a language:

* density: the share of its text that is neither sentences nor code, logs, tables or change logs, that is, in links, tags, keywords and
  names. A sentence is told by its form: a closed run of five words or more that begins like one, has a short word, few commas and no
  repeated wording,
* function words: the share of its words that the corpus itself shows to be function words of a language (``learnt``: the
  short words that most documents of that language have),
* entropy of its words, and repetition of its word pairs.

The figures' centre and scatter are estimated robustly for each language over all documents: median and median deviation, then
mean and covariance of the documents near them, twice, from a histogram of the figures (``BINS`` to a figure, so a language has a
bounded number of cells, whatever the corpus). Small groups lean on the estimate of all documents, and that on ``PRIOR``, by
``LEAN`` documents' weight, so nothing is switched by size. A document is spam when it is an outlier by its Mahalanobis distance, lies
towards spam (``TOWARDS`` is the least cosine), and its density is more than half, which is the definition.

Two passes: one counts short words (the only part run while the query is defined; its result is at most ``WORDS`` words a
language), the other measures; its figures, a few numbers per document, are exchanged once for both histogram and verdict.

Null and blank texts are no spam. Languages are taken from the first two letters of ``lang``; other values form one group. In a
language of which the corpus has few documents no function words are known, so there density and wording must tell. Extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIGURES = ["density", "function_words", "entropy", "repetition"]
#: Where spam lies on each figure.
DIRECTION = [1, -1, -1, 1]
#: Least standard deviation of each figure. That of density is wide, as unpunctuated lists of prose are no spam: density alone
#: makes no outlier.
FLOOR = [0.3, 0.05, 0.04, 0.05]
#: Squared distance beyond which a document is an outlier: the 0.975 quantile of chi squared with four degrees of freedom, as is
#: usual for robust distances.
CUTOFF = 11.143
TOWARDS, ROUNDS, BINS, AGAIN = 0.15, 2, 25, 4
#: Centre of ordinary documents, which ``LEAN`` documents' weight of every estimate leans on.
PRIOR, LEAN = [0.05, 0.3, 0.93, 0.05], 20
#: Function words: at most so many letters, in at least this share of a language's documents, at most so many.
LETTERS, COMMON, WORDS = 4, 0.25, 60

_LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)\S+", re.I | re.S)
_FENCE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_BLANK = re.compile(r"\n[ \t]*\n")
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[ T]|\[?\d\d:\d\d(?::\d\d)?\S* .*\b(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b|File \"|Traceback|\w+(?:Error|Exception)\b|at [\w.$]+\()")
#: Words; in scripts without spaces, every three letters.
_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_RUN = re.compile(r"[^\W\d_぀-ヿ㐀-鿿가-힯]+|[぀-ヿ㐀-鿿가-힯]{1,3}")
#: Between pieces: after closing punctuation, perhaps with one more token stuck to it, and at line ends unless the line goes on in lower case.
_PIECE = re.compile(r"(?<=[.!?…])(?:[\"')]|[^\x00-\x7f\s])*\s+|(?<=[。！？])\s*|(?<=[^\W\d_][.!?…])[^\s.!?]{1,12}\s+(?=[A-ZÀ-Þ])|\n+(?![^\W\d_A-ZÀ-Þ])|\n\n+")
_OPENING = re.compile(r"(?:[-*•>+]\s+|\d+[.)]\s+|#+\s+|[*_`]*\w{1,40}[*_`]*:[*_`]*\s+)*[\"“„«(`*_]*")
#: The end of a sentence, perhaps with one more token stuck to it.
_CLOSED = re.compile(r"[\w`)\]\"”'’*%][.!?…。！？]\S{0,12}$")
_VERSION = re.compile(r"\s*(?:#+\s*)?\[?v?\d+\.\d+(?:\.\d+)?\S*\s*(?:[(-].*)?$|\s*#+\s*(?:change ?log|\[?unreleased)", re.I)
_ITEM = re.compile(r"\s*[-*•+]\s+")


def pairs_repeated(words: list[str]) -> float:
    """Share of neighbouring pairs of words that were there before."""
    n = len(words) - 1
    return 1 - len(set(zip(words, words[1:], strict=False))) / n if n > 0 else 0.0


def words_of(text: str) -> list[str]:
    return (_WORD if text.isascii() or not _UNSPACED.search(text) else _RUN).findall(text.lower())


def code_marks(text: str) -> int:
    return sum(map(text.count, "(){}[]=")) + text.count(";\n") + text.endswith(";") + text.count("->")


def begins(sentence: str) -> bool:
    """Whether a piece begins like a sentence: not in lower case, marks of lists, labels, quotes and one stray word aside."""
    first = sentence[:1]
    if not first.isupper():
        first = sentence[_OPENING.match(sentence).end() :][:1]
    return not first.islower() or sentence.split(None, 2)[1][:1].isupper()


def in_sentences(text: str, seen: Counter[str]) -> int:
    """Characters of a text in sentences; ``seen`` counts the sentences of the document so far. One that is repeated more than
    ``AGAIN`` times is repeated keywords."""
    good = 0
    for piece in _PIECE.split(text):
        low = piece.lower()
        words = low.split() if piece.isascii() or not _UNSPACED.search(piece) else words_of(piece)
        n = len(words)
        if n < 5 or piece.count(",") * 4 > n or min(map(len, words)) > 3:
            continue
        if len(set(words)) < n and len(set(zip(words, words[1:], strict=False))) < 0.9 * (n - 1):
            continue
        body = piece.strip()
        if _CLOSED.search(body, max(0, len(body) - 15)) and begins(body):
            seen[low] += 1
            if seen[low] <= 1 + AGAIN:
                good += len(piece)
    return good


def set_aside(lines: list[str], size: int, text: str, words: list[str]) -> bool:
    """Whether a block is a log, a table, a record of data, code or quoted code."""
    half = size / 2
    if text[:1] in "{[" and text.rstrip()[-1:] in "}]" and '":' in text:  # a record of data
        return True
    if (":" in text or "(" in text) and sum(len(x) for x in lines if _LOG.match(x)) > half or "|" in text and sum(len(x) for x in lines if x.startswith("|") and x.endswith("|")) > half:
        return True
    marks = code_marks(text)
    if ">" in text and sum(len(x) for x in lines if x.startswith(">")) > half:
        return len(words) < 20 or marks > 0.01 * len(text)
    return marks > 0.03 * len(text)


def figures(text: str | None, lists: list[frozenset[str]]) -> tuple[float, float, float, float] | None:
    """The four figures of a text; ``lists`` are the function words of each language."""
    if not text or text.isspace():
        return None
    listed, every, seen = 0, [], Counter()
    fences = sum(len(m.group()) for m in _FENCE.finditer(text))
    total, versioned = fences, False
    for block in _BLANK.split(_FENCE.sub("\n\n", text) if fences else text):
        block = block.strip()
        if not block:
            continue
        total += len(block)
        lines = block.split("\n")
        log, versioned = versioned, bool(_VERSION.match(lines[0]))
        found = _LINK.findall(block) if "](" in block or "http" in block or "www." in block or "<a " in block else ()
        linked = sum(map(len, found))
        rest = _LINK.sub(" ", block) if found else block
        words = words_of(rest)
        crowded = linked > 0.3 * len(block) and len(words) < 5 * len(found)
        if not crowded and set_aside(lines, len(block), rest, words):
            continue
        every += words_of(block) if found else words  # the words of links are words of the page
        if crowded:
            listed += len(block)
        elif (log or versioned) and not found and sum(len(x) for x in lines if _ITEM.match(x) and len(x.split()) > 3) > len(block) / 2:
            continue  # the entries of a change log
        elif len(words) >= 5:
            listed += max(0, len(block) - linked - in_sentences(rest, seen))
    n = len(every)
    if not n:
        return listed / max(1, total), 0.0 if listed else PRIOR[1], 0.0 if listed else PRIOR[2], 1.0 if listed else 0.0
    count = Counter(every)
    h = math.log(n) - sum(c * math.log(c) for c in count.values()) / n
    share = max((sum(map(count.__getitem__, ws.intersection(count))) / n for ws in lists), default=PRIOR[1])
    return min(1.0, listed / total), share, h / math.log(n) if n > 1 else 1.0, pairs_repeated(every)


def language(column: str = "lang") -> Column:
    """The first two letters of a language in lower case, ``other`` for what isn't two letters."""
    two = F.lower(F.substring(column, 1, 2))
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise("other").alias("lang")


def short_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language, the number of documents that have each short word, by white space; the empty word counts all documents."""
    for b in batches:
        count: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text and not text.isspace():
                count.update([(lang, w) for w in set(text.lower().split()) if len(w) <= LETTERS and w.isalpha()])
                count[lang, ""] += 1
        langs, words = zip(*count, strict=True) if count else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(count.values(), pa.int64())], ["lang", "word", "n"])


def learnt(documents: DataFrame) -> list[frozenset[str]]:
    """The function words of every language, from all documents: its short words that at least ``COMMON`` of its documents have,
    the ``WORDS`` most common; languages of fewer than ``LEAN`` documents have none."""
    n = documents.select(language(), "text").mapInArrow(short_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    per = n.groupBy("lang").agg(F.max("n").alias("all"))  # all documents have the empty word
    # The condition needs both sides, so neither is filtered before their common exchange.
    common = n.join(F.broadcast(per), "lang").filter((F.col("n") >= COMMON * F.col("all")) & F.when(F.col("all") >= LEAN, F.col("word") != ""))
    top = common.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, WORDS).alias("w"))
    return [frozenset(x["word"] for x in r["w"]) for r in top.orderBy("lang").collect()]


def measured(documents: DataFrame, lists: list[frozenset[str]]) -> DataFrame:
    """``doc_id, lang, density, function_words, entropy, repetition``; the figures of blank texts are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [figures(t, lists) for t in b.column("text").to_pylist()]
            columns = [pa.array([r[k] if r else None for r in rows], pa.float64()) for k in range(len(FIGURES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *columns], ["doc_id", "lang", *FIGURES])

    return documents.select("doc_id", language(), "text").mapInArrow(run, "doc_id bigint, lang string, " + ", ".join(f"{f} double" for f in FIGURES))


def _middle(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(n[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)])


def _with_floor(scatter: np.ndarray) -> np.ndarray:
    return scatter + np.diag(np.square(FLOOR))


def estimate(x: np.ndarray, n: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Robust centre and scatter of figures ``x`` with multiplicities ``n``, leaning on a given estimate."""
    share = n.sum() / (n.sum() + LEAN)
    lean = lambda c, s: (share * c + (1 - share) * centre, share * s + (1 - share) * scatter)
    c = np.array([_middle(x[:, k], n) for k in range(x.shape[1])])
    mad = np.array([1.4826 * _middle(np.abs(x[:, k] - c[k]), n) for k in range(x.shape[1])])
    c, s = lean(c, np.diag(mad**2))
    for _ in range(ROUNDS):
        d = x - c
        near = np.einsum("ij,jk,ik->i", d, np.linalg.inv(_with_floor(s)), d) <= CUTOFF
        if not near.any():
            break
        m = np.average(x[near], axis=0, weights=n[near])
        d = x[near] - m
        c, s = lean(m, np.einsum("i,ij,ik->jk", n[near] / n[near].sum(), d, d))
    return c, s


def centres(cells: pd.DataFrame) -> pd.DataFrame:
    """Centre and inverse scatter of every language of a histogram of bin numbers; ``*`` are all documents."""
    cells = cells.dropna(subset=FIGURES)
    x, n, langs = (cells[FIGURES].to_numpy(float) + 0.5) / BINS, cells["n"].to_numpy(float), cells["lang"].to_numpy()
    prior = np.array(PRIOR), np.zeros((len(FIGURES), len(FIGURES)))
    every = estimate(x, n, *prior) if len(n) else prior
    out = []
    for lang in sorted(set(langs)):
        at = langs == lang
        c, s = estimate(x[at], n[at], *every)
        out.append((lang, c.tolist(), np.linalg.inv(_with_floor(s)).ravel().tolist(), np.sqrt(np.diag(_with_floor(s))).tolist()))
    return pd.DataFrame(out, columns=["of", "centre", "inverse", "deviation"])


def scored(documents: DataFrame) -> DataFrame:
    """Figures of every document with its squared distance and how far it lies towards spam, a cosine.

    Histogram and verdict read one exchange of the figures, so no filter may move below it: the join is null-safe and the
    figures stand within ``coalesce``."""
    figs = measured(documents, learnt(documents)).repartition("doc_id")
    bins = [F.least(F.floor(F.col(f) * BINS), F.lit(BINS - 1)).cast("int").alias(f) for f in FIGURES]
    cells = figs.select("lang", *bins).groupBy("lang", *FIGURES).agg(F.count("*").alias("n")).withColumn("whole", F.lit(True))
    known = cells.groupBy("whole").applyInPandas(centres, "of string, centre array<double>, inverse array<double>, deviation array<double>")
    j = figs.join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("of")), "left")
    k = len(FIGURES)
    x = [F.coalesce(F.col(f), F.lit(float("nan"))) for f in FIGURES]
    d = [x[i] - F.coalesce("centre", F.array())[i] for i in range(k)]
    inverse, deviation = F.coalesce("inverse", F.array()), F.coalesce("deviation", F.array())
    distance = sum(inverse[i * k + m] * d[i] * d[m] for i in range(k) for m in range(k))
    z = [d[i] / deviation[i] for i in range(k)]
    length = F.sqrt(sum(v * v for v in z) * k)
    towards = F.when(length > 0, sum(s * v for s, v in zip(DIRECTION, z, strict=True)) / length).otherwise(0.0)
    measured_ = lambda c: F.when(~F.isnan(x[0]), c)
    return j.select("doc_id", "lang", *FIGURES, measured_(distance).alias("distance"), measured_(towards).alias("towards"))


def found(documents: DataFrame) -> DataFrame:
    is_spam = (F.col("distance") > CUTOFF) & (F.col("towards") > TOWARDS) & (F.coalesce("density", F.lit(0.0)) * F.signum("distance") > 0.5)
    return scored(documents).filter(is_spam).select("doc_id")
