"""Evaluation texts leaking into training text (problem 7).

Both sides are cut into windows as long as the passages that count, less the one word by which every second window of a document
may miss its passage: ``WINDOW`` = 11 words, at each word of an item and at every second word of a document. Each window has one
64-bit SimHash of its words; words that no item has weigh nothing, so an added or changed word costs little. The fingerprints
of the items' windows are indexed by four blocks of 16 bits, each under all values within ``NEAR`` = 2 bits: two fingerprints
within a Hamming distance of ``RADIUS`` = 11 are within 2 bits in one block at least (pigeonhole), so the look-ups find all of
them. That radius spares one changed word of eleven (about 6 bits where the new word is none of the items', about 9 where it is).

For the candidates, weighted word shingles verify exactly: a shingle that several items have weighs nothing, as shared wording is
no evidence, any other the mean inverse item frequency of its words. Shared shingles of a document and an item are chained over the
gaps of single edits; the best chain by evidence less ``SIMILARITY`` of what it covers must hold ``LEAST_EVIDENCE``
of the item's own shingles, be similar by weight and span the passage, the words beyond an edit near its ends included.

The corpus is read once by a map, whatever the number of items; nothing is shuffled but the few pairs found. The items are the
stated query set. Their weights are computed as tables; the driver passes them on in blocks of about ``BLOCK_CHARS`` characters, one
at a time, and a task holds the index of one block at a time.

Null and empty texts and answers have no windows; items with a null id are left out; repeated items count once. Case,
punctuation, markup, spacing and line breaks don't matter. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

WINDOW, STRIDE, RADIUS, NEAR = 11, 2, 11, 2
#: Known words of a window that has a fingerprint: with fewer, more than three of eleven words are none of the items'.
LEAST_KNOWN = 8
SHINGLE = 3
PASSAGE_WORDS = 12
#: Positions between matched shingles of a chain, on either side, that an edit may leave, and the shift it may bring.
GAP, SHIFT = 4, 2
#: Two edits in twelve words, far from each other, leave four of ten shingles.
LEAST_EVIDENCE, SIMILARITY = 4, 0.4
BLOCK_CHARS = 1_000_000

_WORDS = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|&[a-z]+;|[*~]+|\\(?=_)")
FIELD = "item_id bigint, field string, words array<string>"
FOUND = "doc_id bigint, item_id bigint, field string, words int, similarity double"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text or "*" in text or "&" in text or "\\" in text or "~" in text:
        text = _MARKUP.sub("", text)
    return _WORDS.findall(text.lower())


def sign_rows(words: list[str]) -> np.ndarray:
    """The bits of each word's hash as +1 and -1."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def simhashes(signs: np.ndarray, stride: int = 1) -> np.ndarray:
    """Fingerprints of windows of words whose signs are given: the sign of each column's sum, at every ``stride``-th word."""
    n = len(signs) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = signs[:-1] + signs[1:]
    four = two[:-2] + two[2:]
    at = slice(0, n, stride)
    total = four[at] + four[4:][at] + two[8:][at] + signs[10:][at]
    return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()


#: All values of a block within ``NEAR`` bits of zero.
_NEAR = np.array([0, *(1 << i for i in range(16)), *(1 << i | 1 << j for i in range(16) for j in range(i))], np.uint16)


class Index:
    """Fingerprints and weighted shingles of a block of fields ``(item, field, words, weights)``; a weight belongs to the shingle
    that begins at its word and is 0 for shingles that other items have."""

    def __init__(self, fields: list[tuple[int, str, list[str], list[float]]]):
        self.fields = fields
        every = sorted({w for f in fields for w in f[2]})
        self.ids = {w: k + 1 for k, w in enumerate(every)}
        self.signs = np.concatenate([np.zeros((1, 64), np.int8), sign_rows(every)]) if every else np.zeros((1, 64), np.int8)
        self.shingles: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.weights, self.sums = [], []
        prints, of = [], []
        for k, (_, _, words, weights) in enumerate(fields):
            ids = np.array([self.ids[w] for w in words], np.int64)
            for pos, x in enumerate(self.keys(ids).tolist()):
                self.shingles[x].append((k, pos))
            w = np.zeros(max(0, len(words) - SHINGLE + 1))
            w[: len(weights)] = weights
            self.weights.append(w.tolist())
            self.sums.append(np.concatenate([[0], np.cumsum(w)]).tolist())
            p = simhashes(self.signs[ids])
            own = np.array([w[i : i + WINDOW - SHINGLE + 1].any() for i in range(len(p))], bool)  # others are no evidence of their item
            prints.append(p[own])
            of += [k] * int(own.sum())
        every_print = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.prints, at = np.unique(every_print, return_inverse=True)
        self.of: list[set[int]] = [set() for _ in self.prints]
        for i, k in zip(at.tolist(), of, strict=True):
            self.of[i].add(k)
        blocks = self.prints.view(np.uint16).reshape(-1, 4) if len(self.prints) else np.zeros((0, 4), np.uint16)
        self.order, self.starts = [], []
        for b in range(4):
            values = (blocks[:, b][:, None] ^ _NEAR[None, :]).ravel()
            self.order.append((np.argsort(values, kind="stable") // len(_NEAR)).astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(values, minlength=65536))]).astype(np.int64))

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Shingles as numbers; those with a word that no item has are -1."""
        n = len(ids) - SHINGLE + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        a, b, c = ids[:n], ids[1 : n + 1], ids[2 : n + 2]
        return np.where((a > 0) & (b > 0) & (c > 0), (a << 42) + (b << 21) + c, -1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, distinct item fingerprint) within the radius."""
        blocks = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b in range(4):
            value = blocks[:, b].astype(np.int64)
            first = self.starts[b][value]
            n = self.starts[b][value + 1] - first
            last = np.cumsum(n)
            if not len(last) or not last[-1]:
                continue
            col = self.order[b][np.arange(last[-1]) + np.repeat(first - (last - n), n)]
            close = np.flatnonzero(np.bitwise_count(np.repeat(prints, n) ^ self.prints[col]) <= RADIUS)
            rows.append(np.searchsorted(last, close, side="right"))
            cols.append(col[close])
        return np.concatenate(rows), np.concatenate(cols)

    def candidates(self, ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> dict[int, set[int]]:
        """Fields near each text; ``ids`` are the words of texts one after another, which begin at ``begin``. Windows that cross
        over to the next text are dropped."""
        out: dict[int, set[int]] = defaultdict(set)
        if not len(self.prints):
            return out
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for a in range(0, max(0, len(ids) - WINDOW + 1), 8_192):
            part = ids[a : a + 8_192 + WINDOW - 1]
            at = np.arange(a, a + max(0, len(part) - WINDOW + 1), STRIDE)
            doc = np.searchsorted(begin, at, side="right") - 1
            keep = np.flatnonzero((known[at + WINDOW] - known[at] >= LEAST_KNOWN) & (at + WINDOW <= begin[doc] + length[doc]))
            if len(keep):
                row, col = self.near(simhashes(self.signs[part], STRIDE)[keep])
                for d, c in set(zip(doc[keep[row]].tolist(), col.tolist(), strict=True)):
                    out[d] |= self.of[c]
        return out

    def verify(self, ids: np.ndarray, fields: set[int]) -> list[tuple[int, str, int, float]]:
        """Items, fields, words and similarity of the passages that a text of these words holds of these fields."""
        matched: dict[int, list[tuple[int, int]]] = defaultdict(list)
        get = self.shingles.get
        for at, x in enumerate(self.keys(ids).tolist()):
            for f, pos in get(x) or ():
                if f in fields:
                    matched[f].append((at, pos))
        out = []
        for f, hits in matched.items():
            best = self.best_chain(f, hits, ids)
            if best:
                out.append((self.fields[f][0], self.fields[f][1], *best))
        return out

    def beyond(self, f: int, text: np.ndarray, at: int, pos: int, step: int) -> tuple[int, int]:
        """Words of a text and a field that go on beyond one edit next to matched words which end at ``at`` and ``pos``."""
        words, ids, best = self.fields[f][2], self.ids, (0, 0)
        for da, dp in ((2, 2), (2, 1), (1, 2)):  # a word changed, added, dropped
            n = 0
            while 0 <= at + step * (da + n) < len(text) and 0 <= pos + step * (dp + n) < len(words) and text[at + step * (da + n)] == ids[words[pos + step * (dp + n)]]:
                n += 1
            if n and n + dp > best[1]:
                best = (n + da - 1, n + dp - 1)
        return best

    def spans(self, f: int, text: np.ndarray, a: int, p: int, at: int, pos: int) -> bool:
        """Whether matched words from ``a, p`` to ``at, pos`` make a passage: alone, or with what goes on beyond an edit on either side."""
        if min(at - a, pos - p) + 1 >= PASSAGE_WORDS - 1:
            return True
        if min(at - a, pos - p) + 1 < PASSAGE_WORDS - 4:
            return False
        before, after = self.beyond(f, text, a, p, -1), self.beyond(f, text, at, pos, 1)
        return at - a + 1 + before[0] + after[0] >= PASSAGE_WORDS - 1 and pos - p + 1 + before[1] + after[1] >= PASSAGE_WORDS

    def best_chain(self, f: int, hits: list[tuple[int, int]], text: np.ndarray) -> tuple[int, float] | None:
        """The longest passage among the best chains that end at each matched shingle; chains go forward on both sides with small
        gaps. A shingle has one best chain: evidence less ``SIMILARITY`` of the weight covered, the longer of equal ones."""
        w, sums = self.weights[f], self.sums[f]
        ends: dict[tuple[int, int], tuple[float, int, int, int]] = {}  # score, first place in the text and the field, own shingles
        best = None
        for at, pos in hits:  # in the order of the text
            mine, top = w[pos], None
            for da in range(1, SHINGLE + GAP + 1):
                for dp in range(max(1, da - SHIFT), min(SHINGLE + GAP, da + SHIFT) + 1):
                    before = ends.get((at - da, pos - dp))
                    if before is not None:
                        score = before[0] - SIMILARITY * (sums[pos] - sums[pos - dp + 1])
                        if score >= 0 and (top is None or (score, -before[1]) > (top[0], -top[1])):
                            top = (score, *before[1:])
            score, a, p, own = top or (0.0, at, pos, 0)
            score, own = score + (1 - SIMILARITY) * mine, own + (mine > 0)
            ends[at, pos] = (score, a, p, own)
            span = min(at - a, pos - p) + SHINGLE
            if own >= LEAST_EVIDENCE and (best is None or span > best[0]) and self.spans(f, text, a, p, at + SHINGLE - 1, pos + SHINGLE - 1):
                covered = sums[pos + 1] - sums[p]
                best = (span, min(1.0, score / covered + SIMILARITY))
        return best


def field_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [words_of(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("field"), pa.array(words, pa.list_(pa.string()))], ["item_id", "field", "words"])


def weighted_fields(items: DataFrame) -> DataFrame:
    """``item_id, field, words, weights`` of every distinct text of an item that is long enough for a passage."""
    kept = items.filter("item_id is not null")
    texts = [kept.select("item_id", F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("task_prompt", "expected_answer")]
    base = texts[0].unionByName(texts[1]).filter("text is not null").distinct().mapInArrow(field_batches, FIELD)
    base = base.withColumn("key", F.xxhash64("item_id", "field", "words"))
    n = kept.agg(F.countDistinct("item_id").alias("n")).scalar()
    frequency = base.select("item_id", F.explode("words").alias("word")).distinct().groupBy("word").agg((F.log1p(n / F.count("*")) / F.log1p(n)).alias("rarity"))
    shingles = F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.slice("words", i + 1, SHINGLE))
    long = base.filter(F.size("words") >= SHINGLE).select("key", "item_id", F.posexplode(shingles).alias("pos", "shingle"))
    owner = long.groupBy("shingle").agg((F.min("item_id") == F.max("item_id")).alias("own"))
    rarity = owner.filter("own").select("shingle", F.explode("shingle").alias("word")).join(frequency, "word").groupBy("shingle").agg((F.sum("rarity") / SHINGLE).alias("weight"))
    weighed = long.join(rarity, "shingle", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("weights"))
    return base.filter(F.size("words") >= PASSAGE_WORDS - 1).dropDuplicates(["key"]).join(weighed, "key").select("item_id", "field", "words", "weights.weight", "key").withColumnRenamed("weight", "weights")


def leaks(documents: DataFrame, items: DataFrame, batch_rows: int = 400, block_chars: int | None = None) -> DataFrame:
    """``doc_id, item_id, field, words, similarity`` of every passage found, the longest of each field."""
    spark, most = documents.sparkSession, block_chars or BLOCK_CHARS
    chars = items.agg(F.sum(F.coalesce(F.length("task_prompt"), F.lit(0)) + F.coalesce(F.length("expected_answer"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-chars // most))
    fields = weighted_fields(items)
    if n > 1:
        shared_dir(spark)
        fields = fields.checkpoint()
    blocks = []
    for k in range(n):
        part = fields.filter(F.pmod("key", F.lit(n)) == k) if n > 1 else fields
        blocks.append(spark.sparkContext.broadcast([(r["item_id"], r["field"], list(r["words"]), list(r["weights"])) for r in part.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = None, -1
        for big in batches:
            for number, block in enumerate(blocks):
                if held != number:
                    index, held = Index(block.value), number
                for k in range(0, big.num_rows, batch_rows):
                    yield _search(index, big.slice(k, batch_rows))

    return documents.select("doc_id", "text").mapInArrow(run, FOUND)


def _search(index: Index, part: pa.RecordBatch) -> pa.RecordBatch:
    get = index.ids.get
    numbers = [[get(w, 0) for w in words_of(t)] for t in part.column("text").to_pylist()]
    length = np.array([len(x) for x in numbers], np.int64)
    ids = np.fromiter((i for x in numbers for i in x), np.int64, int(length.sum()))
    begin = np.cumsum(length) - length
    doc_ids, out = part.column("doc_id").to_pylist(), []
    for d, fields in index.candidates(ids, begin, length).items():
        out += [(doc_ids[d], *found) for found in index.verify(ids[begin[d] : begin[d] + length[d]], fields)]
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "field", "words", "similarity"])


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def items_leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Of each test item that leaked, the number of documents that hold it and the longest passage."""
    return leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))
