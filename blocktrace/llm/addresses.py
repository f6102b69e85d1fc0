"""URL rules and path-template trees.

Every host has a tree of path templates. Numbers and hashes in a segment become
placeholders at once; then, level by level, a segment that holds too small a
share of its parent becomes the wildcard `*`, so each node keeps a bounded number
of literal children. From the leaves upwards, sibling branches are merged whose
subtrees have the same templates and whose labelled rates a likelihood ratio
doesn't tell apart. The rate of every node of the merged tree is smoothed towards
that of its parent, from all hosts over the host down to the template, and a
template is rejected by its rate.

Labels are the addresses that a rule judges. The tree is built from counts per
(host, path shape), not from addresses, so a hot host costs no more than its
shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktrace.llm.common import join_uneven, settle

#: (host, path, verdict); a rule fits the host and its subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A literal segment has at least this share of its parent's addresses.
LITERAL_SHARE = 0.02
#: Levels of a tree; what is deeper is one wildcard.
DEPTH = 6
#: Weight of the parent in a smoothed rate, and rate of blocked addresses from which a template is rejected.
PRIOR_WEIGHT, REJECT = 4.0, 0.5
#: Likelihood ratio from which two branches differ: 95 % of a chi-square with one degree of freedom.
APART = 3.84
#: Share of a branch that a template needs to count in its signature, which bounds one to twenty templates.
SIGNATURE_SHARE = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one; of equal lengths the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=False):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """Path with placeholders: `{h}` for long hexadecimal runs with a digit, `{n}` for numbers.

    A backslash goes before characters that templates use themselves.
    """
    plain = F.regexp_replace(path, r"([\\{|*])", r"\\$1")
    hashed = F.regexp_replace(plain, r"\b(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}\b", "{h}")
    return F.regexp_replace(hashed, r"[0-9]+", "{n}")


def templates(shapes: DataFrame) -> DataFrame:
    """Add the `template` (array of segments) to `shapes` (`host`, `shape`, `n`, ...), level by level."""
    parts = F.filter(F.split("shape", "/"), lambda part: part != "")
    tree = settle(shapes.select("*", parts.alias("_parts"), F.array().cast("array<string>").alias("template")), "tree")
    deepest = tree.agg(F.max(F.size("_parts"))).first()[0] or 0
    for level in range(1, min(deepest, DEPTH) + 1):
        here = F.get("_parts", F.lit(level - 1))
        nodes = tree.filter(F.size("_parts") >= level).groupBy("host", "template", here.alias("_part")).agg(
            F.sum("n").alias("_n"))
        whole = tree.groupBy(F.col("host").alias("_host"), F.col("template").alias("_above")).agg(F.sum("n").alias("_all"))
        literal = (nodes.join(whole, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_above")))
                   .filter(F.col("_n") >= LITERAL_SHARE * F.col("_all"))
                   .select("host", "template", "_part", F.lit(True).alias("_literal")))
        segment = F.when(F.col("_literal"), F.col("_part")).otherwise(F.lit("*"))
        tree = (tree.withColumn("_part", here).join(literal, ["host", "template", "_part"], "left")
                .withColumn("template", F.when(F.col("_part").isNull(), F.col("template")).otherwise(
                    F.concat("template", F.array(segment)))).drop("_part", "_literal"))
        tree = settle(tree, "tree")
    deeper = F.size("_parts") > DEPTH
    return tree.withColumn("template", F.when(deeper, F.concat("template", F.array(F.lit("**")))).otherwise(
        F.col("template"))).drop("_parts")


def _log_likelihood(blocked: Column, labelled: Column) -> Column:
    """Of so many blocked among the labelled, at their own rate."""
    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))
    return part(blocked) + part(labelled - blocked) - part(labelled)


def _classes(siblings: Column) -> Column:
    """Labelled siblings (`rate`, `head`, `blocked`, `labelled`), sorted, as classes of equal rates.

    Each sibling joins the class before it unless their rates differ. Siblings
    are less than `1 / LITERAL_SHARE`, so the array is short.
    """
    zero = F.array().cast("array<struct<heads:array<string>,blocked:double,labelled:double>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        blocked, labelled = last["blocked"] + x["blocked"], last["labelled"] + x["labelled"]
        ratio = 2 * (_log_likelihood(last["blocked"], last["labelled"]) + _log_likelihood(x["blocked"], x["labelled"])
                     - _log_likelihood(blocked, labelled))
        alone = F.struct(F.array(x["head"]).alias("heads"), x["blocked"].alias("blocked"), x["labelled"].alias("labelled"))
        joined = F.struct(F.concat(last["heads"], F.array(x["head"])).alias("heads"), blocked.alias("blocked"),
                          labelled.alias("labelled"))
        return (F.when(F.size(done) == 0, F.array(alone))
                .when(ratio >= APART, F.concat(done, F.array(alone)))
                .otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))))

    return F.aggregate(siblings, zero, add)


def merged_level(placed: DataFrame, level: int) -> DataFrame:
    """Rename segment `level` of each template to the names of the siblings that it is merged with, joined by `|`.

    Siblings merge if the templates below them are the same and their labelled
    rates don't differ. Those without a label join a single class, and stand by
    themselves beside several.
    """
    counts = ("n", "allowed", "blocked")
    deep = F.size("template") >= level
    prefix, head = F.slice("template", 1, level - 1), F.get("template", F.lit(level - 1))
    rest = F.concat_ws("/", F.slice("template", level + 1, F.greatest(F.size("template"), F.lit(1))))
    keyed = placed.withColumns({"_prefix": prefix, "_head": F.coalesce(head, F.lit(""))})
    below = keyed.filter(deep).groupBy("host", "_prefix", "_head", rest.alias("_rest")).agg(
        *[F.sum(c).alias(c) for c in counts])
    whole = F.sum("n").over(Window.partitionBy("host", "_prefix", "_head"))
    branches = below.withColumn("_share", F.col("n") / whole).groupBy("host", "_prefix", "_head").agg(
        F.array_sort(F.collect_set(F.when(F.col("_share") >= SIGNATURE_SHARE, F.col("_rest")))).alias("_signature"),
        *[F.sum(c).cast("double").alias(c) for c in counts])
    labelled = F.col("allowed") + F.col("blocked")
    known = F.struct((F.col("blocked") / labelled).alias("rate"), F.col("_head").alias("head"),
                     F.col("blocked").alias("blocked"), labelled.alias("labelled"))
    groups = branches.groupBy("host", "_prefix", "_signature").agg(
        F.array_sort(F.collect_list(F.when(labelled > 0, known))).alias("_known"),
        F.array_sort(F.collect_list(F.when(labelled == 0, F.col("_head")))).alias("_silent"))
    classes = groups.withColumn("_classes", F.transform(_classes(F.col("_known")), lambda c: c["heads"]))
    silent = F.when(F.size("_silent") > 0, F.array("_silent")).otherwise(F.array().cast("array<array<string>>"))
    classes = classes.withColumn("_classes", F.when(
        F.size("_classes") == 1, F.array(F.concat(F.get("_classes", F.lit(0)), F.col("_silent")))).otherwise(
        F.concat("_classes", silent)))
    names = (classes.select("host", "_prefix", F.explode("_classes").alias("_heads"))
             .select("host", "_prefix", F.explode("_heads").alias("_head"),
                     F.concat_ws("|", F.array_sort("_heads")).alias("_name")))
    # A segment that isn't merged keeps its name, so only the others are looked up.
    changed = names.filter(F.col("_name") != F.col("_head"))
    template = F.when(F.col("_name").isNull() | ~deep, F.col("template")).otherwise(F.concat(
        "_prefix", F.array("_name"), F.slice("template", level + 1, F.greatest(F.size("template"), F.lit(1)))))
    return settle(keyed.join(changed, ["host", "_prefix", "_head"], "left").withColumn("template", template)
                  .drop("_prefix", "_head", "_name"), "merged")


def smoothed_rates(leaves: DataFrame) -> DataFrame:
    """Rate of blocked addresses of each template (`host`, `template`, `n`, `allowed`, `blocked`): add `purity`.

    Counts are added up at every node. From the root downwards the rate of a node
    is smoothed towards its parent's; a node with all of its parent's addresses
    brings nothing new and has its parent's rate.
    """
    # The end of a path is a child of its own beside longer paths. No segment is empty.
    ended = leaves.withColumn("_path", F.concat("template", F.array(F.lit(""))))
    size = F.size("_path")
    steps = ended.select("*", F.explode(F.sequence(F.lit(0), size)).alias("_level")).withColumn(
        "_node", F.slice("_path", 1, F.col("_level")))
    counts = [F.sum(c).cast("double").alias(f"_{c}") for c in ("n", "allowed", "blocked")]
    nodes = settle(steps.groupBy("host", "_node").agg(F.count(F.lit(1)).alias("_leaves"), *counts), "nodes")
    # One row: the rate over all hosts.
    total = nodes.filter(F.size("_node") == 0).agg(
        F.sum("_blocked").alias("b"), F.sum(F.col("_allowed") + F.col("_blocked")).alias("l")).first()
    base = total["b"] / total["l"] if total["l"] else 0.0
    chain = join_uneven(steps.select("host", "template", "_level", "_node"), nodes, ["host", "_node"], "_leaves")
    step = F.struct("_level", F.col("_n").alias("n"), F.col("_blocked").alias("b"), (F.col("_allowed") + F.col("_blocked")).alias("l"))
    start = F.struct(F.lit(-1.0).alias("n"), F.lit(base).alias("rate"))

    def down(above: Column, x: Column) -> Column:
        rate = (x["b"] + PRIOR_WEIGHT * above["rate"]) / (x["l"] + PRIOR_WEIGHT)
        return F.struct(x["n"].alias("n"), F.when(x["n"] == above["n"], above["rate"]).otherwise(rate).alias("rate"))

    return chain.groupBy("host", "template").agg(F.array_sort(F.collect_list(step)).alias("_steps")).select(
        "host", "template", F.aggregate("_steps", start, down, lambda last: last["rate"]).alias("purity"))


def judged_templates(shapes: DataFrame) -> DataFrame:
    """Rate of blocked addresses and verdict of every shape: `host`, `shape`, `template`, `purity`, `_judged`.

    `shapes` has `host`, `shape`, `n` and the labelled counts `allowed` and `blocked`.
    """
    placed = settle(templates(shapes), "templates")
    deepest = placed.agg(F.max(F.size("template"))).first()[0] or 0
    for level in range(deepest, 0, -1):
        placed = merged_level(placed, level)
    leaves = settle(placed.groupBy("host", "template").agg(
        *[F.sum(c).alias(c) for c in ("n", "allowed", "blocked")], F.count(F.lit(1)).alias("_shapes")), "leaves")
    rates = smoothed_rates(leaves.drop("_shapes")).join(leaves.select("host", "template", "_shapes"), ["host", "template"])
    named = join_uneven(placed.select("host", "shape", "template"), rates, ["host", "template"], "_shapes")
    return named.select(
        "host", "shape", F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "purity",
        F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")).alias("_judged"))


def judge_urls(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """Verdict on every address: the longest rule's, else its template's.

    Returns one row per row of `pages`: `page_id`, `host`, `path`, `rule`,
    `verdict`, `template` and `purity`. Null addresses and those without `://`
    have an empty host and path and are judged like a host of that name. Equal
    addresses get equal verdicts. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_shape", shape_of(F.col("path")))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = settle(parsed.withColumn("rule", rule).withColumn("_said", said), "addresses")
    shapes = parsed.groupBy("host", F.col("_shape").alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_said") == "allow").alias("allowed"),
        F.count_if(F.col("_said") == "block").alias("blocked"))
    judged = judged_templates(shapes).withColumnRenamed("shape", "_shape")
    return parsed.join(judged, ["host", "_shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_said", "_judged", F.lit("allow")).alias("verdict"),
        "template", "purity")
