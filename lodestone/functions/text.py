"""Text functions as column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed-class English words left out of every index (fixed values).
STOPWORDS = (
    "about above after again against all also although always an and any are around as at be because been before being "
    "below between both but by can cannot could did do does doing down during each either even every few for from "
    "further had has have having here how however if in into is it its itself just like make makes may might more most "
    "must neither no nor not now of off on once only onto or other our out over own please same should since so some "
    "such than that the their them then there these they this those through thus to too under until up upon us used "
    "using very was we were what when where whether which while who whom why will with within without would you your"
).split()

WORD = "[A-Za-z][A-Za-z0-9_]*"
#: Tokens shorter than this are dropped; words this short are not stemmed.
MIN_TOKEN, MIN_STEM = 2, 3
#: Words as long as this are probed by a prefix of this length.
PROBE = 6
#: Where a comparing question is cut in two (fixed values).
AXIS_MARKERS = [" differs from ", " differ from ", " versus ", " vs. ", " vs ", " compared to ", " as opposed to ", " rather than ", " and what ", " and how ", " while "]


def cut(c: Column, n: int) -> Column:
    """A text without its last ``n`` characters."""
    return F.left(c, F.length(c) - n)


def _ends(c: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for x in suffixes:
        out = out | c.endswith(x)
    return out


def singular_stem(word: Column) -> Column:
    """First step of the stemmer: plurals."""
    return (
        F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(cut(word, 3), F.lit("y")))
        .when(_ends(word, ["ches", "shes", "sses", "xes", "zes"]), cut(word, 2))
        .when(word.endswith("s") & ~_ends(word, ["us", "is", "ss"]), cut(word, 1))
        .otherwise(word)
    )


def verb_stem(word: Column, plural: Column) -> Column:
    """Second step of the stemmer, fed by the first: -ing and -ed after a vowel; words of up to three letters stay."""
    verb = (
        F.when(plural.endswith("ing") & (F.length(plural) > 5) & cut(plural, 3).rlike("[aeiou]"), cut(plural, 3))
        .when(plural.endswith("ed") & (F.length(plural) > 4) & cut(plural, 2).rlike("[aeiou]"), cut(plural, 2))
        .otherwise(plural)
    )
    return F.when(F.length(word) <= MIN_STEM, word).otherwise(verb)


def stem(word: Column) -> Column:
    """Light English stemmer."""
    return verb_stem(word, singular_stem(word))


def stem_suffix(word: Column) -> Column:
    """The alternative stemmer: the first of -ing, -ed, -es, -s that leaves three letters."""
    out = word
    for s in ("s", "es", "ed", "ing"):
        out = F.when(word.endswith(s) & (F.length(word) - len(s) >= 3), cut(word, len(s))).otherwise(out)
    return out


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 4) & word.endswith("s") & ~word.endswith("ss"), cut(word, 1)).otherwise(word)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def parts(text: Column) -> Column:
    """Lower-cased parts of the words of a text, split at underscores and changes of case; nulls and empty texts have none."""
    joined = F.array_join(words(F.coalesce(text, F.lit(""))), " ")
    spaced = F.regexp_replace(F.regexp_replace(F.translate(joined, "_", " "), "([A-Z])([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.split(F.lower(spaced), " +")


def tokenize(text: Column) -> Column:
    """Index tokens of a text, in order, repeats kept."""
    kept = F.filter(parts(text), lambda w: (F.length(w) >= MIN_TOKEN) & ~w.isin(STOPWORDS))
    return F.transform(kept, stem)


def token_rows(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, term``: a row per index token. Tokens are exploded before they are stemmed, so both steps are generated code over
    plain columns instead of lambdas over arrays."""
    w = docs.select(*keys, F.explode(parts(F.col(text))).alias("_w")).filter((F.length("_w") >= MIN_TOKEN) & ~F.col("_w").isin(STOPWORDS))
    return w.withColumn("_s", singular_stem(F.col("_w"))).select(*keys, verb_stem(F.col("_w"), F.col("_s")).alias("term"))


def probe_prefixes(text: Column) -> Column:
    """Distinct prefixes of the longer words of a request, in the order of their first appearance."""
    lowered = F.transform(words(F.coalesce(text, F.lit(""))), F.lower)
    return F.array_distinct(F.transform(F.filter(lowered, lambda w: (F.length(w) >= PROBE) & ~w.isin(STOPWORDS)), lambda w: F.left(w, F.lit(PROBE))))


def axes(text: Column) -> Column:
    """A question cut at the leftmost comparing marker into two axes; one axis where there is none."""
    low = F.lower(text)
    at = F.least(*[F.when(F.instr(low, m) > 0, F.instr(low, m)) for m in AXIS_MARKERS], F.lit(None).cast("int"))
    length = F.lit(None).cast("int")
    for m in reversed(AXIS_MARKERS):  # the first marker in the list wins where two begin at one place
        length = F.when(F.instr(low, m) == at, F.lit(len(m))).otherwise(length)
    return F.when(at.isNull(), F.array(text)).otherwise(F.array(F.trim(F.left(text, at - 1)), F.trim(F.substring(text, at + length, F.length(text)))))


def pascal(ws: Column) -> Column:
    return F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000)))), "")


def camel(ws: Column) -> Column:
    return F.concat(F.element_at(ws, 1), pascal(F.slice(ws, 2, 1_000_000)))


def prose_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: singular(F.lower(w)))


def permutations(text: Column) -> Column:
    """Identifiers that a phrase of two words or more may stand for: all words, pairs and single words in Pascal case, then camel
    and snake case of all."""
    ws = prose_words(text)
    n = F.size(ws)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: pascal(F.slice(ws, i, 2)))
    every = F.array_distinct(F.concat(F.array(pascal(ws)), pairs, F.transform(ws, lambda w: pascal(F.array(w))), F.array(camel(ws), F.array_join(ws, "_"))))
    return F.when(n >= 2, every).otherwise(F.array().cast("array<string>"))


def comment_text(content: Column) -> Column:
    """Text of block comments, triple-quoted strings and whole-line comments, one chunk a line."""
    c = F.left(content, F.lit(300_000))
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1))
    quotes = F.transform(F.regexp_extract_all(c, F.lit("(?s)\"\"\".*?\"\"\"|'''.*?'''"), F.lit(0)), lambda q: F.substring(q, F.lit(4), F.length(q) - 6))
    lines = F.transform(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*(#|//)")), lambda x: F.regexp_replace(x, r"^\s*(#|//)\s?", ""))
    return F.array_join(F.concat(blocks, quotes, lines), "\n")


def modified_files(text: Column) -> Column:
    """Paths in diff and markdown headers, each once, in the order of the three header styles."""
    a = F.regexp_extract_all(text, F.lit(r"(?m)^diff --git a/(\S+) b/\S+"), F.lit(1))
    b = F.regexp_extract_all(text, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1))
    git = F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))
    unified = F.filter(F.regexp_extract_all(text, F.lit(r"(?m)^(?:---|\+\+\+) (?:[ab]/)?(\S+)"), F.lit(1)), lambda p: p != "/dev/null")
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^### (\S+)"), F.lit(1))
    return F.array_distinct(F.concat(git, unified, heads))


def changed_lines(text: Column) -> Column:
    """Changed lines of a diff, headers aside; zero for a text without a diff header."""
    has = text.rlike(r"(?m)^((---|\+\+\+) \S+|diff --git a/\S+ b/\S+)")
    plain = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("^[+-]") & ~x.rlike("^[+-][+-][+-]")))
    return F.when(has, plain).otherwise(0)


def qualified_references(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_]\w*\.[A-Za-z_]\w*"), F.lit(0)))


def occurrences(text: Column, needle: Column) -> Column:
    """How often a non-empty needle occurs in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("bigint")


def token_count(text: Column) -> Column:
    """Tokens of a text by the fallback of four characters a token."""
    return F.ceil(F.length(text) / 4).cast("bigint")
