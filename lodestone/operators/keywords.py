"""Counting many keywords in many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_KEYWORDS = 200_000


def keyword_hits(docs: DataFrame, queries: DataFrame, k: int, batch_rows: int = 500) -> DataFrame:
    """``item_id, doc_id, hits``: for each query of ``item_id, keyword``, occurrences of its keywords in each text of ``doc_id, text``,
    whatever their case and without overlaps; of each batch the ``k`` best documents of each query, ties by id, so that the best of all
    are among them. Documents without a hit, null texts and null ids have no row.

    The queries are a stated set: they are read by the driver, which raises an error past ``MOST_KEYWORDS``. One automaton finds all
    keywords of a text in one pass."""
    rows = [(r["item_id"], r["keyword"]) for r in queries.select("item_id", "keyword").distinct().filter("keyword != ''").limit(MOST_KEYWORDS + 1).collect()]
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords of queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words, items = sorted({w for _, w in rows}), sorted({i for i, _ in rows})
        number, column = {w: n for n, w in enumerate(words)}, {i: n for n, i in enumerate(items)}
        wanted = np.zeros((len(words), len(items)), np.float32)
        automaton = ahocorasick.Automaton()
        for i, w in rows:
            wanted[number[w], column[i]] = 1
        overlaps = {n for w, n in number.items() if any(w[j:] == w[:-j] for j in range(1, len(w)))}
        for w, n in number.items():
            automaton.add_word(w, (n, len(w)))
        if words:
            automaton.make_automaton()
        for big in batches:
            for at in range(0, big.num_rows if words else 0, batch_rows):
                part = big.slice(at, batch_rows).to_pydict()
                counts = np.zeros((len(part["doc_id"]), len(words)), np.float32)
                for d, text in enumerate(part["text"]):
                    if not text or part["doc_id"][d] is None:
                        continue
                    ends: dict[int, int] = {}
                    row = counts[d]
                    for end, (n, size) in automaton.iter(text.lower()):
                        if n in overlaps:
                            if ends.get(n, -1) > end - size:
                                continue
                            ends[n] = end
                        row[n] += 1
                hits = (counts.astype(np.float64) @ wanted).astype(np.int64)
                ids = np.array([-1 if x is None else x for x in part["doc_id"]], np.int64)
                order = np.argsort(ids, kind="stable")
                out: list[tuple] = []
                for c, item in enumerate(items):
                    col = hits[order, c]
                    best = np.argsort(-col, kind="stable")[:k]
                    out += [(item, int(ids[order[b]]), int(col[b])) for b in best if col[b] > 0]
                i, d_, h = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(d_, pa.int64()), pa.array(h, pa.int64())], ["item_id", "doc_id", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, "item_id bigint, doc_id bigint, hits bigint")
