"""Substring dedup by hashing lines and paragraphs.

Units of a text are its lines of PARAGRAPH words or more and, because passages are also copied into the middle of lines, paragraphs of
exactly PARAGRAPH words that begin at content-defined words: in every STRETCH consecutive words the one of smallest hash begins
one. Units are normalised (A-Z folded, white space as single blanks) and grouped globally by a 96-bit digest; the
occurrence earliest by (doc_id, offset) stays and all others are removed, with their offsets in the original text kept. A passage
of PARAGRAPH + STRETCH - 1 words that repeats always holds a whole unit, wherever it stands.

Counts and earliest documents of digests are combined before the shuffle; only units that repeat are joined further, each to
one earliest occurrence, so a passage in m documents makes m matches. An occurrence that overlaps its own
earliest one (a text of one repeated word) is not removed. Null and empty texts and texts of fewer words have no units. Rows
of null doc_id are left as they are; rows of equal doc_id and text are one document; rows of equal doc_id and other text follow each other in
order of a digest. Other columns stay as they are.

With every=True nothing depends on where units begin: a word goes if and only if some PARAGRAPH consecutive words that hold it
(of one text, in any lines) begin earlier too, at a place that they don't overlap. So repeated runs of PARAGRAPH words or more go to their real borders,
and shorter ones stay. Every window of PARAGRAPH words has an anchor, the ANCHOR words that begin at its start of smallest rank among the first REACH,
which all its copies share; windows are compared in two steps. Those that begin at anchors cover the inside of long runs. Then all windows
are compared whose anchor repeats and is neither the first of its kind nor inside what the first step covered, with all windows of
equal anchors.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Words, map_arrow, mix, powers, row_key, texts_of, tune
from tickloom.session import materialize

PARAGRAPH, STRETCH = 24, 16
ANCHOR, REACH = 9, 16  # ANCHOR + REACH - 1 is PARAGRAPH
GROUP_CHARS = 1 << 18


def units(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all units: index of the text, start and end (code points), 64-bit and 32-bit digest."""
    w = Words(texts)
    n = len(w.hash)
    if n < PARAGRAPH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.int32)
    picked = np.zeros(0, np.int64)
    if n >= STRETCH:
        rank = mix(w.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        windows = np.lib.stride_tricks.sliding_window_view(rank, STRETCH)
        inside = np.flatnonzero(w.doc[: n - STRETCH + 1] == w.doc[STRETCH - 1 :])
        picked = np.unique(inside + windows[inside].argmin(axis=1))
        picked = picked[picked + PARAGRAPH <= n]
        picked = picked[w.doc[picked] == w.doc[picked + PARAGRAPH - 1]]
    # lines: words between line feeds; texts end in a blank, so a line never crosses texts but at their ends
    feeds = np.cumsum(w.data == 10)[w.start]
    fresh = np.concatenate([[True], (feeds[1:] != feeds[:-1]) | (w.doc[1:] != w.doc[:-1])])
    first = np.flatnonzero(fresh)
    after = np.append(first[1:], n)
    long = after - first >= PARAGRAPH
    start, stop = np.concatenate([picked, first[long]]), np.concatenate([picked + PARAGRAPH, after[long]])
    up, down = powers(n + 1)
    digests = []
    for h in (w.hash, mix(w.hash + np.uint64(0x632BE59BD9B4E019))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
        digests.append(mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    doc = w.doc[start]
    base = points[w.offset[doc]]
    return doc, points[w.start[start]] - base, points[w.end[stop - 1]] - base, digests[0].view(np.int64), (digests[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_digests(hashes: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit and 32-bit digests of length words from each start."""
    up, down = powers(len(hashes) + 1)
    digests = []
    for h in (hashes, mix(hashes + np.uint64(0x632BE59BD9B4E019))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        digests.append(mix((total[start + length] - total[start]) * down[start] + np.uint64(length)))
    return digests[0].view(np.int64), (digests[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def offsets(w: Words, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (code points in their text) of the words from start to before stop."""
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    base = points[w.offset[w.doc[start]]]
    return points[w.start[start]] - base, points[w.end[stop - 1]] - base


def anchors(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all anchors: index of the text, place, digest; start, end and digests of the window that begins there (end 0: the text ends before).

    place: 256 x the number of the word in its text, 16 x words from the first window of this anchor to it, and words from the last one to it.
    """
    w = Words(texts)
    n = len(w.hash)
    at = np.arange(max(n - PARAGRAPH + 1, 0))
    at = at[w.doc[at] == w.doc[at + PARAGRAPH - 1]]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none.astype(np.int32)
    rank = mix(window_digests(w.hash, np.arange(n - ANCHOR + 1), ANCHOR)[0].view(np.uint64))  # ranks of words would favour some frequent ones
    anchor = at + np.lib.stride_tricks.sliding_window_view(rank, REACH)[at].argmin(axis=1)
    picked, lo, count = np.unique(anchor, return_index=True, return_counts=True)
    lo, hi = at[lo], at[lo + count - 1]
    doc = w.doc[picked]
    place = (picked - w.first[doc]) * 256 + (picked - lo) * 16 + picked - hi
    fits = picked + PARAGRAPH <= w.first[doc + 1]
    begin = np.where(fits, picked, 0)
    start, end = offsets(w, begin, begin + PARAGRAPH)
    one, two = window_digests(w.hash, begin, PARAGRAPH)
    return doc, place, rank[picked].view(np.int64), start, np.where(fits, end, 0), one, two


def windows_at(texts: list[str], places: list[list[int]], goes: list[list[int]]) -> tuple[np.ndarray, ...]:
    """Of all windows of the anchors at places: index of the text, start, end, digests, and whether the place is one of goes."""
    w = Words(texts)
    at, marks = [], []
    for i, x in enumerate(places):
        marked = set(goes[i])
        for place in x:
            word = int(w.first[i]) + (place >> 8)
            at.append(np.arange(word - (place >> 4 & 15), word - (place & 15) + 1))
            marks.append(np.full(len(at[-1]), place in marked))
    at, marks = np.concatenate(at), np.concatenate(marks)
    return w.doc[at], *offsets(w, at, at + PARAGRAPH), *window_digests(w.hash, at, PARAGRAPH), marks


def grouped(batch: pa.RecordBatch, fn, *columns: list) -> list[np.ndarray]:
    """fn of the texts of a batch, a bounded number of characters at a time; the first result is the index of the text."""
    texts, first, parts = texts_of(batch), 0, []
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < GROUP_CHARS):
            size += len(texts[last])
            last += 1
        doc, *rest = fn(texts[first:last], *[c[first:last] for c in columns])
        parts.append([doc + first, *rest])
        first = last
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def later_windows(found: DataFrame, goes: Column | None = None) -> DataFrame:
    """Of windows (doc_id, x, start, end, h1, h2, others) those that go because they repeat, with `first`, the earliest; one that overlaps its earliest stays."""
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.struct("doc_id", "x").alias("_row"), "start", "end")).alias("first")).filter("n > 1").drop("n")
    same = F.struct("doc_id", "x") == F.col("first._row")
    return found.filter(F.lit(True) if goes is None else goes).join(materialize(first), ["h1", "h2"]).filter(~(same & (F.col("start") < F.col("first.end"))))


def release(docs: DataFrame) -> None:
    """Let the driver see now which shuffles and checkpoints nothing reads any more, so that their files go."""
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, x, place, key, start, end, h1, h2 of the anchors (see anchors()) that repeat."""
    row = docs.schema["_row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, place, key, start, end, one, two = grouped(batch, anchors)
        return pa.record_batch([batch.column("_row").take(pa.array(doc)), pa.array(place), pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(one), pa.array(two)],
                               ["_row", "place", "key", "start", "end", "h1", "h2"])

    keys = map_arrow(docs, lambda batch: pa.record_batch([pa.array(grouped(batch, anchors)[2])], ["key"]), "key long")
    often = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    release(docs)
    # anchors are made twice rather than written
    made = map_arrow(docs, run, f"_row {row}, place long, key long, start int, end int, h1 long, h2 int").select("_row.doc_id", "_row.x", "place", "key", "start", "end", "h1", "h2")
    return materialize(made.join(often, "key"))


def open_anchors(again: DataFrame, inside: DataFrame) -> DataFrame:
    """doc_id, x, place, key of the anchors whose windows may go and aren't covered by those of inside.

    An anchor is done when the windows that go cover all of its own; the first of its kind has no earlier copy.
    """
    word, lo = F.shiftright("place", 8), F.shiftright("place", 8) - F.shiftright("place", 4).bitwiseAND(15)
    line = Window.partitionBy("doc_id", "x").orderBy("place")
    before = F.lag("place").over(line)
    fresh = before.isNull() | (F.shiftright(before, 8) + PARAGRAPH < word)
    chained = inside.select("doc_id", "x", "place", word.alias("word"), lo.alias("lo"), fresh.alias("fresh"))
    chained = chained.withColumn("since", F.last(F.when(F.col("fresh"), F.col("word")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    done = chained.filter("since <= lo").select("doc_id", "x", "place").distinct()
    first = again.groupBy("key").agg(F.min(F.struct("doc_id", "x", "place")).alias("first"))
    later = again.join(materialize(first), "key").filter(F.struct("doc_id", "x", "place") != F.col("first")).select("doc_id", "x", "place", "key")
    return materialize(later.join(done, ["doc_id", "x", "place"], "left_anti"))


def open_windows(docs: DataFrame, again: DataFrame, inside: DataFrame) -> DataFrame:
    """doc_id, x, start, end, h1, h2, goes of the windows of open anchors (goes) and of all others that they may copy."""
    row = docs.schema["_row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, start, end, one, two, goes = grouped(batch, windows_at, batch.column("places").to_pylist(), batch.column("goes").to_pylist())
        return pa.record_batch([batch.column("_row").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(one), pa.array(two), pa.array(goes)],
                               ["_row", "start", "end", "h1", "h2", "goes"])

    left = open_anchors(again, inside)
    release(docs)
    keys = materialize(left.select("key").distinct())
    places = again.join(keys, "key").select("doc_id", "x", "place", F.lit(None).cast("long").alias("goes"))
    places = places.unionByName(left.select("doc_id", "x", "place", F.col("place").alias("goes")))
    places = materialize(places.groupBy(F.struct("doc_id", "x").alias("_row")).agg(F.collect_set("place").alias("places"), F.collect_set("goes").alias("goes")))
    release(docs)
    found = map_arrow(docs.join(places, "_row"), run, f"_row {row}, start int, end int, h1 long, h2 int, goes boolean")
    return materialize(found.select("_row.doc_id", "_row.x", "start", "end", "h1", "h2", "goes"))


def every_later(docs: DataFrame) -> DataFrame:
    """_row, start, end, first of windows of PARAGRAPH words that cover all words to remove."""
    again = repeated_anchors(docs)
    release(docs)
    inside = materialize(later_windows(again.filter("end > 0").drop("key")))
    found = open_windows(docs, again, inside)
    inside = inside.select("doc_id", "x", "start", "end", "first")
    del again
    release(docs)
    edges = materialize(later_windows(found, F.col("goes")).select("doc_id", "x", "start", "end", "first"))
    del found
    release(docs)
    return inside.unionByName(edges).withColumn("_row", F.struct("doc_id", "x"))


def unit_later(docs: DataFrame) -> DataFrame:
    """_row, start, end, first of the units that repeat an earlier one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, start, end, one, two = grouped(batch, units)
        return pa.record_batch([batch.column("_row").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(one), pa.array(two)],
                               ["_row", "start", "end", "h1", "h2"])

    row = docs.schema["_row"].dataType.simpleString()
    made = map_arrow(docs, run, f"_row {row}, start int, end int, h1 long, h2 int").select("_row.doc_id", "_row.x", "start", "end", "h1", "h2")
    made = materialize(made)
    # written before the joins, so that both sides of these are plain shuffles and hot digests can be split
    often = materialize(made.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    again = materialize(made.join(often, ["h1", "h2"]).withColumn("_row", F.struct("doc_id", "x")).drop("doc_id", "x"))
    first = materialize(again.groupBy("h1", "h2").agg(F.min(F.struct("_row", "start", "end")).alias("first")))
    same = F.col("_row") == F.col("first._row")
    return again.join(first, ["h1", "h2"]).filter(~(same & (F.col("start") < F.col("first.end"))))


def repeated_spans(docs: DataFrame, every: bool = False) -> DataFrame:
    """_row, start, end, kept_row, kept_start of every span to remove; docs: _row, text. Spans that touch and copy the same place are one."""

    later = every_later(docs) if every else unit_later(docs)
    later = later.select("_row", "start", "end", F.col("first._row").alias("kept_row"), (F.col("start") - F.col("first.start")).alias("shift"))
    line = Window.partitionBy("_row", "kept_row", "shift").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("begins", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1)))
    later = later.withColumn("no", F.sum("begins").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = later.groupBy("_row", "kept_row", "shift", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select("_row", "start", "end", "kept_row", (F.col("start") - F.col("shift")).alias("kept_start"))


def cut(text: str, spans: list[int]) -> str:
    """The text without spans (start and end in turn)."""
    out, at = [], 0
    for a, b in sorted(zip(spans[0::2], spans[1::2], strict=True)):
        out.append(text[at:a])
        at = max(at, b)
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else cut(t, [int(x) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)


_cut = _cut.asNondeterministic()  # evaluated once, also where filters on the text follow


def removed_spans(docs: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, start, end, kept_doc_id, kept_start: one row for each span that dedup_substrings() removes."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(base.filter("doc_id IS NOT NULL").select(row_key(base).alias("_row"), "text"), every)
    return spans.select(F.col("_row.doc_id").alias("doc_id"), "start", "end", F.col("kept_row.doc_id").alias("kept_doc_id"), "kept_start")


def dedup_substrings(docs: DataFrame, every: bool = False) -> DataFrame:
    """The columns of docs with text cut, and _removed: array of the removed (start, end) in the original text."""
    tune(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("_removed",)]  # columns of these names are replaced
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text, doc_id = (f"c{names.index(c)}" for c in ("text", "doc_id"))
    base = base.withColumn("_row", row_key(base, doc_id, text))
    spans = repeated_spans(base.filter(F.col(doc_id).isNotNull()).select("_row", F.col(text).cast("string").alias("text")), every)
    spans = spans.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_removed"))
    joined = base.join(spans, "_row", "left")
    flat = F.flatten(F.transform("_removed", lambda s: F.array(s["start"], s["end"])))
    cut_ = _cut(F.when(F.col("_removed").isNotNull(), F.col(text)), flat)  # texts without a span don't leave the JVM
    return joined.select(*[(F.when(F.col("_removed").isNotNull(), cut_).otherwise(F.col(text)) if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], "_removed")
