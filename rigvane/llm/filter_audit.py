"""Audit of how text filters interact, by the Walsh-Hadamard transform of their failure masks.

A document's mask has a bit for each filter that it fails.  Of each part and each class of labels (all, good, toxic) only
the 32 signed parity sums are gathered: S[s] = sum over documents of (-1)^|mask and s|.  They add up from any split of the
rows, and the transform is its own inverse up to the factor 32, so the number of documents with each mask comes back exactly
(integers only).  All orders of the filters are then evaluated on the 32 cells: a filter removes, in a given order, the cells
that have its bit and none of those before it.  Summed over all 120 orders a filter removes a document with j failures
120 / j times if it is one of them (closed form of the Shapley value times 120).

Filters (words: maximal runs of other than space and U+0009 to U+000D, case-sensitive; null text: empty):
A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] characters > 2 * code points; D holds any of #$%&*|;
E identical to the text of a smaller id anywhere in the table, whatever was removed.

Plan: one pass over the texts with DataFrame functions leaves some 60 bytes for each document; these meet their labels by id, and are summed
by text digest before texts are compared over the table, so that copies of one text arrive as one row for each part, class and task.

Defined results: a null source is the part ''; a null id has no labels, is no smaller id, and never fails E; ids that repeat count row by
row, and rows with the smallest id of a text do not fail E; several labels of one id count as good (toxic) if one of them says so,
null labels say nothing; null and empty texts are equal; parts without documents do not exist, so an empty table gives an empty result;
texts of any length are worked on whole; texts are told apart by SHA-256; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Classes of labels; each has its own 32 sums.
CLASSES = ("all", "good", "toxic")
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows without an id are dealt to so many groups, as none of them has labels to meet.
SPREAD = 1024


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, from the text alone."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * upper > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, good, toxic, mask, n): how many documents have each mask of the five filters, in rows that may repeat a mask."""
    whole = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), text_mask(whole).alias("mask"),
    )
    facts = facts.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD)) + 1).otherwise(0))
    # Repeated rows become one before they are dealt out.
    once = facts.groupBy("id", "spread", "digest", "part", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast(facts.schema["id"].dataType).alias("id")).agg(says("quality"), says("toxic"))
    known = known.select("id", F.lit(0).cast("long").alias("spread"), F.col("quality").alias("good"), "toxic")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = once.join(known, ["id", "spread"], "left").select("id", "digest", "part", "mask", "n", flag("good"), flag("toxic"))
    # Of each text: how many rows a part and class has, how many of them without an id, and the smallest id with its rows.
    has = F.col("id").isNotNull()
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(has, 0).otherwise(F.col("n"))).alias("n_null"), F.min(F.when(has, F.struct("id", "n"))).alias("least")
    )
    first = F.min("least.id").over(Window.partitionBy("digest"))
    free = F.col("n_null") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    cells = texts.withColumn("free", free).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct("mask", F.col("free").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("free")).alias("n")))).alias("cell"),
    )
    return cells.select("part", "good", "toxic", "cell.mask", "cell.n").where("n > 0")


def parity_sums(cells: DataFrame) -> DataFrame:
    """(part, all, good, toxic): the 32 signed parity sums of each class, as arrays."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    of = {"all": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    sums = cells.groupBy("part").agg(*[F.sum(of[c] * sign(s)).alias(f"{c}_{s}") for c in CLASSES for s in range(CELLS)])
    return sums.select("part", *[F.array(*[F.col(f"{c}_{s}") for s in range(CELLS)]).alias(c) for c in CLASSES])


def inverse(sums: str) -> Column:
    """The 32 cells of a column with 32 parity sums: the same transform, divided by 32 without a remainder."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    signed = lambda m, s: F.element_at(sums, s + 1) * (1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2))
    return F.transform(every, lambda m: F.shiftright(F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + signed(m, s)), 5))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step of it: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    found = parity_sums(masks(docs, labels, id_col, text, part))
    found = found.select("part", *[inverse(c).alias(c) for c in CLASSES])
    steps = [(o, k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(f) for f in o[:k])) for o in ORDERS for k in range(len(FILTERS))]
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, k, b, p in steps])
    rows = found.select("part", *CLASSES, F.inline(listed))

    def total(cells: str, share: Callable[[Column], Column]) -> Column:
        every = F.sequence(F.lit(0), F.lit(CELLS - 1))
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.element_at(cells, m + 1) * share(m))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    seen = lambda m: m.bitwiseAND(before) != 0
    one = lambda wanted: F.when(wanted, F.lit(1)).otherwise(F.lit(0))
    here = lambda m: one(fails(m) & ~seen(m))
    share = lambda m: F.when(fails(m), F.lit(len(ORDERS)) / F.bit_count(m)).otherwise(F.lit(0)).cast("int")
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda m: one(~seen(m) & ~fails(m))).alias("kept"), total("all", here).alias("removed"), total("all", lambda m: one(fails(m) & seen(m))).alias("redundant"),
        F.element_at("all", bit + 1).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("all", share).alias("shapley"),
    )


#: The same rows without masks of bits or transforms: each order is applied filter by filter to counts of failures.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
 l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first < doc_id, false)} AS x FROM w LEFT JOIN l USING (doc_id)),
 n AS (SELECT part, good, toxic, concat(CASE WHEN x.A THEN 'A' ELSE '' END, CASE WHEN x.B THEN 'B' ELSE '' END, CASE WHEN x.C THEN 'C' ELSE '' END, CASE WHEN x.D THEN 'D' ELSE '' END, CASE WHEN x.E THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM f GROUP BY ALL),
 letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM letters a, letters b, letters d, letters e, letters g WHERE b.c <> a.c AND d.c NOT IN (a.c, b.c) AND e.c NOT IN (a.c, b.c, d.c) AND g.c NOT IN (a.c, b.c, d.c, e.c)),
 steps AS (SELECT o, k, substr(o, k, 1) AS c FROM orders, range(1, 6) r(k)),
 firsts AS (SELECT o, part, good, toxic, fails, n, list_min([position(c IN o) FOR c IN string_split(fails, '') IF c <> '']) AS hit FROM n, orders),
 r AS (SELECT part, o, k, c, sum(CASE WHEN hit IS NULL OR hit > k THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = k THEN n ELSE 0 END) AS removed, sum(CASE WHEN contains(fails, c) AND hit < k THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit = k AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN hit = k AND toxic THEN n ELSE 0 END) AS toxic_lost FROM firsts JOIN steps USING (o) GROUP BY part, o, k, c)
 SELECT part, o AS filter_order, CAST(k AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
