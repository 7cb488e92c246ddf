"""Filter interaction audit: what each filter removes at each place of every order of application.

1. One scan gives every document a mask, a bit per filter that it fails. That its text stands under a
   smaller id too is settled over digests of the texts, table-wide, after copies of one part and label
   have been counted together: a text copied into a third of all rows is a few rows by then.
2. Documents are counted per (part, mask) cell; there are 2^filters cells a part at most.
3. A recursive CTE extends filter prefixes by letters that they do not use yet, over all mask cells,
   and carries the bits applied so far. Each level of the recursion emits that step's flags of a cell:
   kept, removed here, redundant, failing this filter only. Its size depends on the number of filters
   alone (10,432 rows for five), which bounds its broadcast and its loop over the letters.
4. The flags meet the counted cells by mask and are summed per part and prefix. A prefix stands for all
   orders that start with it, so sums are made per prefix and only then repeated per order.

A null text is empty and a null part an empty string. A null id is no smaller than another and has none
smaller; it has no label. Rows that repeat count each; an equal id is not a smaller one. Labels that
repeat an id count if any of them says so. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.common import table, text_or_empty

WORD = r"([^\x20\x09-\x0D]+)"
DUPLICATE = "E"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure of each filter that a text decides by itself."""
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def fail_masks(docs: DataFrame, part: str = "source", filters=text_filters) -> tuple[DataFrame, str]:
    """(id, part, digest, mask) of every document, and the letters of the bits from the lowest on."""
    read = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text")
    )
    failures = filters(F.col("text"), F.regexp_extract_all("text", F.lit(WORD)))
    mask = F.lit(0)
    for place, failed in enumerate(failures.values()):
        mask += F.when(failed, 1 << place).otherwise(0)
    return read.select("id", "part", F.sha2("text", 256).alias("digest"), mask.alias("mask")), "".join(failures)


def mask_cells(judged: DataFrame, labels: DataFrame, duplicate_bit: int) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by the filters they fail, copies of earlier texts among them."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key"))
    marks = marks.agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    # A null id meets no label; its key is spread by the text.
    keyed = judged.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), "digest")))
    marked = keyed.join(marks, "key", "left").na.fill(0, ["good", "toxic"])
    alike = ["digest", "part", "mask", "good", "toxic"]
    counted = marked.groupBy(*alike, "key", "id").agg(F.count(F.lit(1)).alias("n")).groupBy(*alike)
    counted = counted.agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnumbered"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("at_first"),  # rows under the smallest id
    )
    earliest = F.min("first").over(Window.partitionBy("digest")).eqNullSafe(F.col("first"))
    fresh = counted.withColumn("fresh", F.col("unnumbered") + F.when(earliest, F.coalesce("at_first", F.lit(0))).otherwise(0))
    kinds = F.array(
        F.struct(F.col("mask"), F.col("fresh").alias("n")),
        F.struct((F.col("mask") + duplicate_bit).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
    )
    split = fresh.select("part", "good", "toxic", F.explode(kinds).alias("k")).select("part", "k.mask", "k.n", "good", "toxic")
    return split.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("docs"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic")
    )


def order_steps(spark: SparkSession, letters: str) -> DataFrame:
    """(prefix, step, letter, mask, kept, removed, redundant, unique_fails): flags of every mask cell after
    every sequence of different filters, the last of which is ``letter``."""
    filters = ", ".join(f"('{letter}', {1 << place})" for place, letter in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {filters}),
        extended(prefix, step, letter, bit, before, applied, mask) AS (
            SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, 0, CAST(id AS INT) FROM range({1 << len(letters)})
            UNION ALL
            SELECT concat(e.prefix, f.letter), e.step + 1, f.letter, f.bit, e.applied, e.applied | f.bit, e.mask
            FROM extended e JOIN filters f ON e.applied & f.bit = 0
            WHERE e.step < {len(letters)}
        )
        SELECT prefix, step, letter, mask,
            int(mask & applied = 0) AS kept,
            int(mask & bit <> 0 AND mask & before = 0) AS removed,
            int(mask & bit <> 0 AND mask & before <> 0) AS redundant,
            int(mask = bit) AS unique_fails
        FROM extended WHERE step > 0""")


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step."""
    steps = order_steps(cells.sparkSession, letters)
    met = cells.join(F.broadcast(steps), "mask")
    docs = {name: F.sum(F.expr(f"docs * {name}")).alias(name) for name in COUNTS[:4]}
    lost = [F.sum(F.expr(f"{mark} * removed")).alias(f"{mark}_lost") for mark in ("good", "toxic")]
    summed = met.groupBy("part", "prefix", "step", "letter").agg(*docs.values(), *lost)
    # A prefix of k letters starts (letters - k)! orders.
    orders_of = F.factorial(F.lit(len(letters)) - F.col("step"))
    shapley = F.sum(F.col("removed") * orders_of).over(Window.partitionBy("part", "letter"))
    whole = steps.filter(f"step = {len(letters)} AND mask = 0").select(F.col("prefix").alias("filter_order"))
    places = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("length"))
    places = places.select("filter_order", F.expr("substring(filter_order, 1, length)").alias("prefix"))
    rows = summed.withColumn("shapley", shapley).join(F.broadcast(places), "prefix")
    return rows.select("part", "filter_order", "step", *COUNTS, "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five text filters, copies of earlier texts being the last one."""
    judged, letters = fail_masks(docs, part)
    return audit(mask_cells(judged, labels, 1 << len(letters)), letters + DUPLICATE)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS earliest FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
         100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(words.doc_id > earliest, false)] AS fails
    FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
alike AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE b.i <> a.i AND c.i NOT IN (a.i, b.i) AND d.i NOT IN (a.i, b.i, c.i) AND e.i NOT IN (a.i, b.i, c.i, d.i)),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
applied AS (
    SELECT part, filter_order, step, places[step] AS filter, n, good, toxic, fails[places[step]] AS failed,
        len(list_filter(places[1:step - 1], lambda p: fails[p])) > 0 AS gone,
        len(list_filter(fails, lambda f: f)) = 1 AS lone
    FROM steps, alike),
summed AS (
    SELECT part, filter_order, step, filter,
        coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed AND lone), 0) AS unique_fails,
        coalesce(sum(good) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0) AS toxic_lost
    FROM applied GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM summed
"""
