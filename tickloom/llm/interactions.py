"""Interactions of filters: what each order of applying them removes, by relations of failing ids.

One narrow pass decides every filter for every document; texts are not read again. Each filter's failing ids are stored as a
table of their own. A prefix of filters is a set of them (its order does not change what survives), so 31 sets stand for all
prefixes of all orders: left-anti joins of the ids with the tables of the set give its survivors, and a left-semi join of all
other failing ids with these survivors gives what each next filter removes. Only counts by part leave these joins; orders,
redundancies, losses and Shapley sums are arithmetic on them. The joins share the exchanges of the id tables.

A document is a row. Rows equal in doc_id, text and part are one id that counts as often as it occurs; no order of rows
matters. A null text counts as empty, a null part as the empty string. A row of null doc_id is no copy of anything, nor is anything
a copy of it, and it has no labels. Equal texts under one doc_id are not copies of each other. Where labels repeat, a document
is good (toxic) if any of its rows says so. Texts of any length are read whole. Other columns are dropped; an empty
table has no rows.
"""

from __future__ import annotations

import functools
import json
from itertools import combinations, permutations
from math import factorial
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def standard_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides: short, repetitive, capitals, symbols."""
    capitals = F.length(text) - F.length(F.translate(text, ascii_uppercase, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing(docs: DataFrame, part: str = "source", filters=standard_filters, copies: str = "E") -> tuple[DataFrame, list[str]]:
    """key, doc_id, part, n and one boolean for each filter; and the names of the filters. `copies` names the filter of repeated texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    own = filters(F.col("text"), F.col("words"))
    rows = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[F.coalesce(c, F.lit(False)).alias(f) for f, c in own.items()])
    ids = materialize(rows.groupBy("doc_id", "part", "digest", *own).agg(F.count(F.lit(1)).alias("n")))
    # written before it is joined back, so that the rows of a text with very many copies can be split
    first = materialize(ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"))
    out = ids.join(first, "digest", "left").withColumn(copies, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("digest"), "part")
    names = [*own, copies]
    return out.select(F.unhex(F.md5(name)).alias("key"), "doc_id", "part", "n", *names), names


def removals(ids: DataFrame, names: list[str]) -> DataFrame:
    """part, prefix (bits of the filters applied before), filter (its bit), removed, good, toxic; ids: key, part, n, good, toxic and the filters."""
    tables = {f: materialize(ids.filter(f).select("key", "part", "n", "good", "toxic")) for f in names}
    every = functools.reduce(DataFrame.unionByName, [t.withColumn("filter", F.lit(1 << i)) for i, t in enumerate(tables.values())])
    every = materialize(every)
    left, found = {(): ids.select("key")}, []
    for size in range(len(names)):
        for prefix in combinations(range(len(names)), size):
            bits = sum(1 << i for i in prefix)
            if prefix:
                left[prefix] = left[prefix[:-1]].join(tables[names[prefix[-1]]].select("key"), "key", "left_anti")
            # failing ids of the prefix's own filters meet no survivor; without a filter all sets read one exchange of this table
            removed = every.join(left[prefix], "key", "left_semi")
            found.append(removed.select("part", F.lit(bits).alias("prefix"), "filter", "n", "good", "toxic"))
    total = lambda c: F.sum(c).cast("long")
    joined = functools.reduce(DataFrame.unionByName, found)
    return joined.groupBy("part", "prefix", "filter").agg(total("n").alias("removed"), total(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good_lost"),
                                                          total(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic_lost"))


def orders(names: list[str]) -> Column:
    """All orders and steps as an array: filter_order, step, filter (its bit), prefix (bits before it)."""
    rows = []
    for order in permutations(range(len(names))):
        bits = 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": "".join(names[j] for j in order), "step": step, "filter": 1 << i, "prefix": bits})
            bits |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, filter: int, prefix: int>>")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters=standard_filters, copies: str = "E") -> DataFrame:
    """One row for each part, order and step; labels: doc_id, quality, toxic."""
    ids, names = failing(docs, part, filters, copies)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    ids = materialize(ids.join(marks, "doc_id", "left").select("key", "part", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), *names))
    counts = materialize(removals(ids, names))
    last = (1 << len(names)) - 1
    alone = F.col("prefix") + F.col("filter") == last
    bits = functools.reduce(lambda a, b: a + b, [F.col("prefix").bitwiseAND(1 << i).cast("boolean").cast("int") for i in range(len(names))])
    ways = F.element_at(F.array(*[F.lit(factorial(s) * factorial(len(names) - 1 - s)) for s in range(len(names))]), bits + 1)
    own = counts.groupBy("part", "filter").agg(F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
                                               F.sum(F.col("removed") * ways).alias("shapley"))
    parts = ids.groupBy("part").agg(F.sum("n").cast("long").alias("total"))
    grid = parts.select("part", "total", F.inline(orders(names)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = grid.join(counts, ["part", "prefix", "filter"], "left").join(own, ["part", "filter"], "left")
    line = Window.partitionBy("part", "filter_order").orderBy("step")
    rows = rows.withColumns({"removed": zero("removed"), "kept": F.col("total") - F.sum(zero("removed")).over(line)})
    return rows.select("part", "filter_order", "step", F.col("kept").cast("long").alias("kept"), "removed", (zero("fails") - F.col("removed")).alias("redundant"), zero("unique_fails").alias("unique_fails"),
                       zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"))
