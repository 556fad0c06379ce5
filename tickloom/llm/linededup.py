"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that aren't blank, each trimmed and hashed. In every window of `run` consecutive line
hashes the smallest one (the rightmost of equals) is the window's fingerprint, so two copies of a run of at least `run`
lines select the same fingerprints at the same places. Occurrences are joined on the fingerprint together with the
window's digest, each to its earliest one in order of (doc_id, line); matches that touch on one diagonal (same distance to the same
earlier document) extend each other to whole runs, both ways. A line of `words` words or more is a run by itself, its own window
of one. Lines of the later run are deleted; every deleted line has an equal, earlier one, so the first of each distinct line always stays.

A line goes if and only if it lies in a run of `run` or more lines that also begins at an earlier (doc_id, line), or has `words`
words (between spaces and ASCII control blanks) or more and an equal at an earlier (doc_id, line); so short stock lines alone are spared,
and a passage that stands as one line, or a whole document of one, is not. Runs are found within a document too. Texts split at line feeds; trimming takes blanks, tabs and carriage returns. Blank lines stay where
they are and interrupt no run. Null text stays null and has no lines; a row of null doc_id is left as it is; rows of equal
doc_id and text are one document (all are cut alike), rows of equal doc_id and other text follow each other in order of a
digest of their texts. Other columns stay as they are. Hot windows are reduced to their earliest occurrence before the join, so they make one match for each occurrence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import map_arrow, row_key, tune
from tickloom.session import materialize

TRIM = " \t\r"


def line_hashes(text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that aren't blank, and which of them have that many words."""
    lines = [x.encode("utf-8", "surrogatepass") for x in (y.strip(TRIM) for y in text.split("\n")) if x]
    hashes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in lines]
    return np.array(hashes, np.int64), np.array([len(x) >= 2 * words - 1 and len(x.split()) >= words for x in lines], bool)


def winnow(hashes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its fingerprint (the smallest line hash) and a digest of the window."""
    n = len(hashes) - run + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    digest = np.zeros(n, np.uint64)
    for i in range(run):
        digest = digest * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n].view(np.uint64)
        digest ^= digest >> np.uint64(29)
    return windows.min(axis=1), digest.view(np.int64)


def repeated_lines(docs: DataFrame, run: int = 2, words: int = 24) -> DataFrame:
    """_row and the runs to delete, first line and number of lines in turn; rows without any are not listed. docs: _row (an ordered key), text."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, size, place, finger, digest = [], [], [], [], []
        for no, text in enumerate(batch.column("text").to_pylist()):
            hashes, long = line_hashes(text or "", words)
            for n, (f, d), at in ((run, winnow(hashes, run), None), (1, winnow(hashes[long], 1), np.flatnonzero(long))):
                doc += [no] * len(f)
                size += [n] * len(f)
                place.append(np.arange(len(f)) if at is None else at)
                finger.append(f)
                digest.append(d)
        rows = batch.column("_row").take(pa.array(doc, pa.int64()))
        return pa.record_batch([rows, pa.array(size, pa.int32()), *[pa.array(np.concatenate(x)) for x in (place, finger, digest)]], ["_row", "size", "place", "finger", "digest"])

    row = docs.schema["_row"].dataType.simpleString()
    found = materialize(map_arrow(docs.select("_row", "text").filter("text IS NOT NULL"), windows, f"_row {row}, size int, place long, finger long, digest long"))
    # written before the join, so that both sides of it are plain shuffles and hot windows can be split
    first = materialize(found.groupBy("size", "finger", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "place")).alias("first")).filter("n > 1").drop("n"))
    match = found.join(first, ["size", "finger", "digest"]).filter(F.struct("_row", "place") != F.col("first"))
    match = match.select("_row", "size", "place", F.col("first._row").alias("from_row"), F.col("first.place").alias("from_place"))
    # neighbours on a diagonal extend each other: a new run begins where the gap to the last match exceeds a window
    line = Window.partitionBy("_row", "size", "from_row", F.col("place") - F.col("from_place")).orderBy("place")
    match = match.withColumn("begins", (F.col("place") - F.lag("place").over(line) > F.col("size")) | F.lag("place").over(line).isNull())
    match = match.withColumn("no", F.sum(F.col("begins").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = match.groupBy("_row", "size", "from_row", (F.col("place") - F.col("from_place")).alias("shift"), "no").agg(F.min("place").alias("line"), (F.max("place") + F.col("size") - F.min("place")).alias("lines"))
    return runs.groupBy("_row").agg(F.flatten(F.collect_set(F.array("line", "lines"))).alias("runs"))


def cut(text: str, runs: list[int]) -> tuple[str, int]:
    """The text without the lines of the runs (first line and number of lines in turn, lines that are blank not counted), and how many went."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip(TRIM)]
    gone = {at[i] for first, n in zip(runs[0::2], runs[1::2], strict=True) for i in range(first, first + n)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
def _cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = [(None, None) if r is None else cut(t, [int(x) for x in r]) for t, r in zip(texts, runs, strict=True)]
    return pd.DataFrame(out, columns=["text", "n"])


_cut = _cut.asNondeterministic()  # evaluated once, also where filters on the text follow


def dedup_lines(docs: DataFrame, run: int = 2, words: int = 24) -> DataFrame:
    """The columns of docs with text cut, and _n_lines (before) and _n_removed."""
    tune(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]  # columns of these names are replaced
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text, doc_id = (F.col(f"c{names.index(c)}") for c in ("text", "doc_id"))
    base = base.withColumn("_row", row_key(base, f"c{names.index('doc_id')}", f"c{names.index('text')}"))
    runs = repeated_lines(base.filter(doc_id.isNotNull()).select("_row", text.alias("text")), run, words)
    # texts without a run don't leave the JVM
    joined = base.join(runs, "_row", "left").withColumn("_cut", _cut(F.when(F.col("runs").isNotNull(), text), F.col("runs")))
    lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(TRIM)) != "")), F.lit(0))
    after = F.when(F.col("runs").isNotNull(), F.col("_cut.text")).otherwise(text)
    return joined.select(*[(after if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)],
                         F.when(text.isNull(), 0).otherwise(lines).cast("long").alias("_n_lines"), F.coalesce("_cut.n", F.lit(0)).cast("long").alias("_n_removed"))
