"""Splitting oversized items at natural boundaries (problem 3).

A token stands for four code points, so a text of n code points has ceil(n / 4) tokens. An item over its language's limit is
cut into pieces within the limit, each sharing exactly the overlap with the piece before it.

All boundaries of all items of a batch are one table. Each boundary is joined to its farthest legal successor: where a piece
that begins the overlap before it may end, at the farthest boundary of the best kind (blank line, line, sentence, word) in the
second half of its room; a kind gives way to the next one where it has no boundary there. The successor table is then squared
again and again (pointer doubling), so all cuts of all items are known after as many rounds as the logarithm of the
longest item's pieces. Where a text has no boundary for long, every ``STEP``-th part of its room counts as one.

Null contents and those within the limit are not split; a null or unknown language has the limit of ``*``; where that is
missing too, nothing is split. An overlap of half the limit or more is taken as just under half of it. Of repeated items the
latest counts. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
STEP = 4
_BOUNDARY = re.compile(r"\n[ \t\r]*\n\s*|\n|[.!?;:。！？][\"')\]]*\s+|\s+")
PIECES = "item_id long, delivered timestamp, chars int, pieces array<struct<start: long, stop: long, tokens: int, boundary: string, text: string>>"
KINDS = ["hard", "word", "sentence", "line", "paragraph"]


def boundaries(text: str, room: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a text may be cut, and their kinds as indexes of ``KINDS``; long stretches without one are filled up."""
    at, kinds = [], []
    for m in _BOUNDARY.finditer(text):
        t = m.group()
        at.append(m.end())
        kinds.append(4 if t.count("\n") > 1 else 3 if "\n" in t else 2 if t[0] in ".!?;:。！？" else 1)
    at.append(len(text))
    kinds.append(4)
    pos, kind = np.asarray(at, np.int64), np.asarray(kinds, np.int8)
    step = max(1, (room - overlap) // STEP)
    gaps = np.diff(pos, prepend=0)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        fill = np.concatenate([np.arange(pos[k] - gaps[k] + step, pos[k], step) for k in wide])
        pos, kind = np.concatenate([pos, fill]), np.concatenate([kind, np.zeros(len(fill), np.int8)])
        order = np.argsort(pos, kind="stable")
        pos, kind = pos[order], kind[order]
    keep = np.flatnonzero(np.diff(pos, append=-1) != 0)  # the last of equal positions
    return pos[keep], kind[keep]


def successors(pos: np.ndarray, kind: np.ndarray, starts: np.ndarray, room: int) -> np.ndarray:
    """For pieces that begin at ``starts``, the index of the boundary where each ends."""
    last = np.searchsorted(pos, starts + room, side="right") - 1
    best = last.copy()
    open_ = last < len(pos) - 1
    lower = starts + room // 2
    for k in range(len(KINDS) - 1, 0, -1):
        of_kind = np.flatnonzero(kind >= k)
        near = np.searchsorted(of_kind, last, side="right") - 1
        at = of_kind[np.maximum(near, 0)]
        fits = open_ & (near >= 0) & (pos[at] > lower)
        best[fits] = at[fits]
        open_ &= ~fits
    return best


def cuts(items: list[tuple[str, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces ``(start, stop, kind of the boundary at stop)`` of each ``(text, room, overlap)``, all items at once."""
    tables, base, n = [], [], 0
    for text, room, overlap in items:
        pos, kind = boundaries(text, room, overlap)
        nxt = successors(pos, kind, np.maximum(pos - overlap, 0), room)
        nxt = np.maximum(nxt, np.minimum(np.arange(len(pos)) + 1, len(pos) - 1))  # always forward
        first = successors(pos, kind, np.zeros(1, np.int64), room)[0]
        tables.append((pos, kind, nxt + n, first + n))
        base.append(n)
        n += len(pos)
    if not tables:
        return []
    succ = np.concatenate([t[2] for t in tables])
    reached = np.zeros(n, bool)
    reached[[t[3] for t in tables]] = True
    while True:  # reached holds the first 2^k cuts of every item, succ leads 2^k cuts on
        more = succ[np.flatnonzero(reached)]
        if reached[more].all():
            break
        reached[more] = True
        succ = succ[succ]
    out = []
    for (_, _, overlap), (pos, kind, _, _), b in zip(items, tables, base, strict=True):
        ends = np.flatnonzero(reached[b : b + len(pos)])
        stops = pos[ends]
        starts = np.concatenate([[0], np.maximum(stops[:-1] - overlap, 0)])
        out.append([*zip(starts.tolist(), stops.tolist(), kind[ends].tolist(), strict=True)])
    return out


def split_batches(texts: bool):
    """A map from ``item_id, delivered, chars, content, max_tokens, overlap_tokens`` to the first three and ``pieces``: null for a
    null content, which is that of an item within its limit. The pieces' texts are kept only where they are asked for."""
    names = ["start", "stop", "tokens", "boundary", "text"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 500):
                part = big.slice(k, 500)
                rows = part.select(["content", "max_tokens", "overlap_tokens"]).to_pylist()
                items = []
                for r in rows:
                    if r["content"] is not None:
                        room = max(1, r["max_tokens"] * CHARS_PER_TOKEN)
                        items.append((r["content"], room, min(max(0, (r["overlap_tokens"] or 0) * CHARS_PER_TOKEN), (room - 1) // 2)))
                out: list[list] = [[] for _ in names]
                ends = []
                for (text, _, _), pieces in zip(items, cuts(items), strict=True):
                    for a, b, kind in pieces:
                        for column, v in zip(out, (a, b, -(-(b - a) // CHARS_PER_TOKEN), KINDS[kind], text[a:b] if texts else None), strict=True):
                            column.append(v)
                    ends.append(len(out[0]))
                ends, offsets = iter(ends), [0]
                for r in rows:
                    offsets.append(next(ends) if r["content"] is not None else offsets[-1])
                values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("item_id", "delivered", "chars")), lists], ["item_id", "delivered", "chars", "pieces"])

    return run


def limited(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Every delivery of an item with its limit; the content only where it is over the limit. The limits are a table of a few
    languages and broadcast."""
    known = limits.filter("language is not null").groupBy("language").agg(F.max("max_tokens").alias("max_tokens"), F.max("overlap_tokens").alias("overlap_tokens"))
    other = known.filter("language = '*'")
    most, overlap = (other.agg(F.max(c)).scalar() for c in ("max_tokens", "overlap_tokens"))
    time = F.coalesce(F.col("packaged_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))
    rows = items.filter("item_id is not null").select("item_id", time.alias("delivered"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"), "content", "language")
    joined = rows.join(F.broadcast(known), "language", "left")
    limit = F.coalesce("max_tokens", most)
    over = F.when(F.ceil(F.col("chars") / CHARS_PER_TOKEN) > limit, F.col("content"))
    return joined.select("item_id", "delivered", "chars", over.alias("content"), limit.alias("max_tokens"), F.coalesce("overlap_tokens", overlap).alias("overlap_tokens"))


def pieces(items: DataFrame, limits: DataFrame, texts: bool = True) -> DataFrame:
    """The ordered pieces of every oversized item: ``item_id, piece, start, stop, tokens, boundary, text``.

    Deliveries are split where they are read; what is shuffled to pick the latest of each item are its pieces, not the contents of
    items within their limit, and without ``texts`` only numbers."""
    split = limited(items, limits).mapInArrow(split_batches(texts), PIECES)
    latest = split.groupBy("item_id").agg(F.max_by("pieces", F.struct("delivered", "chars")).alias("pieces"))
    return latest.select("item_id", F.posexplode("pieces").alias("piece", "p")).select("item_id", "piece", "p.*")


def found(items: DataFrame, limits: DataFrame) -> DataFrame:
    return pieces(items, limits, texts=False).filter("piece = 1").select("item_id")
