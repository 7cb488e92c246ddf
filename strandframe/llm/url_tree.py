"""URL filtering: host and path rules, then a path-template tree judged by labelled purity.

Per host, path segments form a tree. Segments that look generated (numbers, hexadecimal strings, long
mixed ids) become wildcards at once. Below every node, as soon as it has more than ``max_children``
different children, those without labels and the largest branch of like children become one wildcard,
level by level; children whose labelled rates differ from these keep their names. Sibling templates with labels are
merged, in order of their rates, as long as a two-proportion test does not tell the next from the branch so
far. A template, merged with its like, is rejected if its purity, the share of bad among labelled urls
smoothed towards the host's and the corpus' rate, reaches ``threshold``. A template without labels is in
no branch and has the smoothed rate of its parent's labelled children, the host's if there are none.

All counts are aggregates combined before the shuffle; a hot host is rows of counts by then. A url
with null or without ``://`` has empty host and path; its template is the empty one. Pages are kept
one by one, repeated rows too; null labels and ids count as unlabelled. An empty table gives no rows.
The tree goes down as far as there are segments; a round goes on with nodes of many unlike paths only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import table, written

BLOCK, ALLOW = "block", "allow"
RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]
MAX_CHILDREN, THRESHOLD, SMOOTHING, MAX_Z = 32, 0.5, 8.0, 1.96
WILD, UNKNOWN = "*", "?"
SALTS = 16  # tasks that the paths of one node are dealt to
# Shapes of generated segments, each with the wildcard that stands for it; a file ending is kept.
SHAPES = [(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$", "{number}"), (r"^[0-9A-Fa-f-]{12,}(\.[A-Za-z0-9]{1,5})?$", "{hex}"), (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{16,}(\.[A-Za-z0-9]{1,5})?$", "{id}")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule: by host, then by path; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segment_template(segment: Column) -> Column:
    shaped = segment
    for pattern, wildcard in reversed(SHAPES):
        shaped = F.when(segment.rlike(pattern), F.concat(F.lit(wildcard), F.regexp_extract(segment, pattern, 1) if "(?=" not in pattern else F.lit(""))).otherwise(shaped)
    return shaped


def wild_children(children: DataFrame, max_children: int, max_z: float) -> DataFrame:
    """(host, template, child, wild) of those of ``children``, with their counts, that become a wildcard, and which.

    Below a node of more than ``max_children`` these are the children of its branch of most children and
    those without labels. Children of other branches, whose labelled counts differ, keep their names.
    """
    wide = children.groupBy("host", "template").agg(F.count("*").alias("children")).filter(F.col("children") > max_children).drop("children")
    named = children.join(wide, ["host", "template"], "left_semi").filter("child NOT LIKE '{%'")
    found = branches(named.withColumnRenamed("template", "parent"), max_z).withColumnRenamed("parent", "template")
    main = found.groupBy("host", "template").agg(F.max_by("branch", F.struct("branch_siblings", "branch_labelled", -F.col("branch"))).alias("branch"))
    main = found.join(main, ["host", "template", "branch"]).select("host", "template", "labelled", "bad", F.lit(WILD).alias("wild"))
    return named.filter("labelled = 0").select("host", "template", "child", F.lit(UNKNOWN).alias("wild")).union(
        named.filter("labelled > 0").join(main, ["host", "template", "labelled", "bad"]).select("host", "template", "child", "wild"))


def salted(nodes: DataFrame) -> DataFrame:
    """A row per node and salt; paths have one of the salts."""
    return nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def template_tree(urls: DataFrame, max_children: int = MAX_CHILDREN, max_z: float = MAX_Z) -> DataFrame:
    """(host, path) counts with ``n``, ``labelled``, ``bad`` to the same with the path's ``template``.

    A node with ``max_children`` paths or fewer, or with one shape of path, has no wide node below it: its
    paths end at once. Other nodes first go to the end of what all their paths share, then one level down.
    """
    parts = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/", -1), segment_template)
    current = urls.withColumn("template", F.lit("")).withColumn("rest", parts).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    current = written(current, "url-level")
    keys, ended = ["host", "template"], []
    while not current.isEmpty():
        nodes = current.groupBy(*keys).agg(F.count("*").alias("paths"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        # What the least and the greatest path share, all between them share.
        differ = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False).cast("int")
        nodes = nodes.select(*keys, F.when((F.col("paths") > max_children) & (differ > 0), differ - 1).alias("shared"))
        current = current.join(salted(nodes), [*keys, "salt"]).withColumn("shared", F.coalesce("shared", F.size("rest")))
        current = current.withColumn("template", _extended(F.slice("rest", F.lit(1), F.col("shared"))))
        current = written(current.withColumn("rest", F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest"), F.lit(1)))).drop("shared"), "url-shared")
        ended.append(current.filter(F.size("rest") == 0).drop("rest"))
        current = current.filter(F.size("rest") > 0).withColumn("child", F.get("rest", F.lit(0)))
        children = current.groupBy(*keys, "child").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        wild = salted(wild_children(children, max_children, max_z))
        current = current.join(wild, [*keys, "child", "salt"], "left").withColumn("template", F.concat("template", F.lit("/"), F.coalesce("wild", "child")))
        current = current.withColumn("rest", F.slice("rest", F.lit(2), F.size("rest"))).drop("wild", "child")
        current = written(current, "url-level")  # each level reads the one before twice
        ended.append(current.filter(F.size("rest") == 0).drop("rest"))
        current = current.filter(F.size("rest") > 0)
    return (reduce(DataFrame.union, ended) if ended else current.drop("rest")).drop("salt")


def _extended(segments: Column) -> Column:
    return F.concat("template", F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.array_join(segments, "/"))).otherwise(F.lit("")))


def apart(bad: int, labelled: int, other_bad: int, other_labelled: int, max_z: float) -> bool:
    """Whether a two-proportion test tells the two rates apart."""
    pooled = (bad + other_bad) / (labelled + other_labelled)
    spread = math.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / other_labelled))
    return abs(bad / labelled - other_bad / other_labelled) > max_z * spread


def branches(siblings: DataFrame, max_z: float = MAX_Z) -> DataFrame:
    """(host, parent, labelled, bad) per sibling to those with labels, each once, with their branch.

    Siblings of equal counts are one step. In order of rate, a step joins the branch before it unless it is
    apart from the branch's pooled counts or from its first step. ``branch_labelled``, ``branch_bad`` and
    ``branch_siblings`` are the branch's totals. Different counts under one parent are few beside its labels.
    """
    steps = siblings.filter("labelled > 0").groupBy("host", "parent", "labelled", "bad").agg(F.count("*").alias("siblings"))
    steps = steps.repartition("host", "parent").sortWithinPartitions("host", "parent", F.col("bad") / F.col("labelled"), F.desc("labelled"))
    names = ["host", "parent", "labelled", "bad", "branch", "branch_labelled", "branch_bad", "branch_siblings"]
    types = [pa.string(), pa.string(), *[pa.int64()] * 6]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, number, held, totals, out = None, 0, [], (0, 0, 0), []

        def close() -> None:
            out.extend((*parent, n, b, number, *totals) for n, b in held)

        for batch in batches:
            for host, path, n, b, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = parent != (host, path)
                if new or apart(totals[1], totals[0], b, n, max_z) or apart(held[0][1], held[0][0], b, n, max_z):
                    close()
                    parent, number, held, totals = (host, path), 0 if new else number + 1, [], (0, 0, 0)
                held.append((n, b))
                totals = (totals[0] + n * k, totals[1] + b * k, totals[2] + k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return steps.mapInArrow(fold, "host string, parent string, " + ", ".join(f"{n} bigint" for n in names[2:]))


def judge_templates(templates: DataFrame, threshold: float = THRESHOLD, smoothing: float = SMOOTHING, max_z: float = MAX_Z) -> DataFrame:
    """(host, template) with n, labelled, bad to the same with ``branch``, ``purity`` and ``verdict``."""
    total = templates.agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    corpus_rate = F.coalesce(F.try_divide("all_bad", "all_labelled"), F.lit(0.0))
    rated = templates.join(hosts, "host").join(F.broadcast(total)).withColumn(  # the total is one row
        "host_rate", (F.col("host_bad") + smoothing * corpus_rate) / (F.col("host_labelled") + smoothing))
    rated = rated.withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    parents = rated.groupBy("host", "parent").agg(F.sum("labelled").alias("parent_labelled"), F.sum("bad").alias("parent_bad"))
    found = branches(rated.select("host", "parent", "labelled", "bad"), max_z)
    rated = rated.join(parents, ["host", "parent"]).join(found, ["host", "parent", "labelled", "bad"], "left")
    # Templates without labels are in no branch; what is known about them is the rate under their parent.
    bad, labelled = F.coalesce("branch_bad", "parent_bad"), F.coalesce("branch_labelled", "parent_labelled")
    purity = (bad + smoothing * F.col("host_rate")) / (labelled + smoothing)
    return rated.withColumn("purity", purity).select(
        "host", "template", "branch", "purity", F.when(F.col("purity") >= threshold, BLOCK).otherwise(ALLOW).alias("verdict"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) per page; ``labels``: (page_id, bad boolean)."""
    known = labels.select(F.col(f"`{page_id}`").alias("page_id"), "bad").filter("page_id IS NOT NULL AND bad IS NOT NULL")
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    counted = rows.join(known, "page_id", "left").groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    tree = written(template_tree(counted), "url-tree")
    verdicts = judge_templates(tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad"))))
    by_path = tree.select("host", "path", "template").join(
        verdicts.withColumnRenamed("verdict", "method"), ["host", "template"])
    judged = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).join(by_path, ["host", "path"])
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.translate("template", UNKNOWN, WILD).alias("template"), "purity",
        F.coalesce("found.verdict", "method").alias("verdict"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are bad where the label with their number has low quality or is toxic."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(table(spark, folder, "pages"), labels, RULES)
