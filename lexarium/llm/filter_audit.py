"""Filter interaction audit: what every order of a set of filters keeps and removes at each step, by part of the corpus."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import scratch, stored, table

SPACE = r"[\x20\x09-\x0D]+"
#: The filter that fails copies; it looks at the table, the others at a row.
COPIES = "E"
#: What is counted of the rows of a part: all, those labelled good, those labelled toxic.
MEASURES = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, on texts without nulls."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows by part and by the set of filters that they fail (bit i: the i-th letter, copies last).

    Call it inside a ``scratch``. A row's digest, part and mask are written once. Copies need no join of a text's whole group: the rows of a
    part and mask are counted alike with and without copies, and those that are nobody's copy are found by the pair (digest, first id),
    which repeats no more than the row itself.
    """
    text = F.coalesce("text", F.lit(""))
    mask = reduce(lambda m, bit: m + bit, (F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # Repeated rows are one from here on; a label counts once however often it is given.
    rows = stored(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg((F.max("quality") == 1).alias("is_good"), (F.max("toxic") == 1).alias("is_toxic"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    first = first.where("first is not null").select(F.col("digest").alias("digest_"), F.col("first").alias("first_"))
    told = rows.join(first, (F.col("digest") == F.col("digest_")) & (F.col("doc_id") == F.col("first_")), "left")
    told = told.withColumn("fresh", F.col("first_").isNotNull() | F.col("doc_id").isNull())
    told = told.join(known, F.col("doc_id") == F.col("labelled"), "left")
    bit = F.when(F.col("fresh"), 0).otherwise(1 << len(filters))
    return told.groupBy("part", (F.col("mask") + bit).alias("mask")).agg(
        F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col(f"is_{m}"), F.col("n"))), F.lit(0)).alias(m) for m in MEASURES[1:])
    )


def survivors(counts: DataFrame, size: int) -> DataFrame:
    """``part`` and, for each measure, an array whose item X counts the part's rows that fail no filter of the set X.

    ``counts`` has at most 2 ** size rows a part. The subset-zeta transform adds, filter by filter, to every set what the same set without that filter
    holds; rows that fail no filter of X are those whose mask lies in the complement of X.
    """
    every = F.sequence(F.lit(0), F.lit((1 << size) - 1))

    def by_set(m: str) -> Column:
        return F.transform(every, lambda x: F.coalesce(F.col("by_mask")[x][m], F.lit(0).cast("long")))

    def summed(m: str, bit: int) -> Column:
        return F.transform(every, lambda x: F.col(m)[x] + F.when(x.bitwiseAND(bit) != 0, F.col(m)[x - bit]).otherwise(0))

    sums = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("by_mask"))
    sums = sums.select("part", *(by_set(m).alias(m) for m in MEASURES))
    for i in range(size):
        sums = sums.select("part", *(summed(m, 1 << i).alias(m) for m in MEASURES))
    return sums.select("part", *(F.reverse(m).alias(m) for m in MEASURES))


def steps(kept: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters, step by step: differences between the survivors of neighbouring sets."""
    size, every = len(letters), (1 << len(letters)) - 1
    bit = {x: 1 << i for i, x in enumerate(letters)}
    # A set of s filters stands before a given one in s! (size - 1 - s)! of all orders.
    weight = {x: factorial(x.bit_count()) * factorial(size - 1 - x.bit_count()) for x in range(every)}
    share = [" + ".join(f"{w} * (n[{x}] - n[{x | b}])" for x, w in weight.items() if not x & b) for b in bit.values()]
    rows = kept.withColumn("share", F.array(*map(F.expr, share))).withColumn("filter_order", F.explode(F.lit(["".join(o) for o in permutations(letters)])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    rows = rows.withColumn("before", F.expr(" + ".join(f"if(instr(filter_order, '{x}') < step, {b}, 0)" for x, b in bit.items())))
    rows = rows.withColumn("which", F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    rows = rows.withColumn("own", F.expr("shiftleft(1, which)"))
    lost = lambda m, before, own: F.col(m)[before] - F.col(m)[before.bitwiseOR(own)]
    before, own = F.col("before"), F.col("own")
    removed, fails = lost("n", before, own), lost("n", F.lit(0), own)
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.col("n")[before.bitwiseOR(own)].alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        lost("n", F.lit(every) - own, own).alias("unique_fails"),
        lost("good", before, own).alias("good_lost"),
        lost("toxic", before, own).alias("toxic_lost"),
        F.col("share")[F.col("which")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """What all orders of the filters do to each part of ``docs(doc_id, text, source)``, as a stored table.

    ``filters`` maps letters to failure conditions (default: those of ``text_filters``); the filter of copies comes last, as ``E``. Five
    filters have 120 orders, so keep them few. A null text is empty, a null source the part ''; a null doc_id is nobody's copy and
    nobody's original; repeated rows count each, and rows of one id are not copies of each other. A document is good or toxic if any of
    its rows in ``labels(doc_id, quality, toxic)`` says 1. Other columns are ignored; an empty table gives no rows.
    """
    filters = text_filters(F.coalesce("text", F.lit(""))) if filters is None else filters
    letters = "".join(filters) + COPIES
    with scratch(docs.sparkSession):
        counts = mask_counts(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"), filters)
        return stored(steps(survivors(counts, len(letters)), letters), "filter-audit", keep=True)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents: one row a part, order and step; see ``audit`` for odd rows."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: DuckDB form: every document goes through every order by itself.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
        {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
         'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
grown(o) AS (SELECT '' UNION ALL SELECT o || x FROM grown, letters WHERE length(o) < 5 AND NOT contains(o, x)),
orders AS (SELECT o FROM grown WHERE length(o) = 5),
m AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failed FROM f),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT part, o, k, substr(o, k, 1) AS x, failed, n, good, toxic,
        coalesce(list_min(list_transform(failed, lambda y: strpos(o, y))), 6) AS gone
      FROM c, orders, range(1, 6) r(k)),
t AS (SELECT part, o AS filter_order, k::INTEGER AS step, x,
        sum(CASE WHEN gone > k THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = k THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN gone < k AND list_contains(failed, x) THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN failed = [x] THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN gone = k THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = k THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM s GROUP BY ALL)
SELECT * EXCLUDE (x), sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM t"""
