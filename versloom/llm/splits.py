"""Problem 1: train, validation and test splits that keep related records together.

Method: a persisted table of components (node, component, split). New links are
first mapped through it, so that only what is new or merges takes part; the
contracted graph is solved by hooking every node to its least neighbour and
pointer jumping. Components that exist keep their split, new ones fill what
each split lacks, and a merge of components with different splits is
quarantined: it stays together under the split ``quarantine`` until someone
decides.

Links join *entities* (a run, a narrator, a work), never pairs of records, and
are made distinct before anything else: an entity that holds a third of the
records is one node with as many links as it has distinct partners.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versloom.llm.blocks import current_blocks, run_number, voice_key, work_key
from versloom.operators.positions import with_running_total
from versloom.session import shared_dir, staged
from versloom.tables import table

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"


def _jumped(parents: DataFrame) -> DataFrame:
    """``parents`` (node, parent) with every parent a root: each step doubles the distance looked over."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        step = staged(parents.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), (F.col("_up") != F.col("parent")).alias("_moved")), "parents")
        if not step.where("_moved").limit(1).count():
            return step.drop("_moved")
        parents = step.drop("_moved")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its least node.

    Rows with a null end, loops and repeated links change nothing (a loop makes
    its node known). Every round hooks each node to its least neighbour, which
    at least halves long paths, jumps to the roots and contracts the links; the
    number of rounds grows with the logarithm of the nodes.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    edges = staged(edges, "links")
    labels = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    edges = edges.where("a != b")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")), "hooks")
        roots = _jumped(parents)
        ra, rb = (roots.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in ("a", "b"))
        labels = staged(labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        edges = staged(edges.join(ra, "a").join(rb, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return labels


def update_components(links: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(node, component, splits) after ``links`` (a, b) were added to ``previous`` (node, component, split).

    ``splits`` has the distinct splits of the old components that now make up
    the component. Only links between different old components, or with nodes
    not seen before, are solved anew.
    """
    if previous is None:
        return connected_components(links).withColumn("splits", F.array().cast("array<string>"))
    old = previous.select("node", "component")
    for end in ("a", "b"):
        links = links.join(old.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    merged = connected_components(links.select("a", "b")).withColumnRenamed("node", "was")
    nodes = old.withColumnRenamed("component", "was").join(merged, "was", "left").select("node", F.coalesce("component", "was").alias("component"))
    fresh = merged.join(old.select(F.col("component").alias("was")).distinct(), "was", "left_anti").select(F.col("was").alias("node"), "component")
    splits = previous.groupBy("component").agg(F.max("split").alias("split")).withColumnRenamed("component", "was").join(merged, "was", "left")
    splits = splits.groupBy(F.coalesce("component", "was").alias("component")).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    all_nodes = staged(nodes.unionByName(fresh), "components")
    return all_nodes.join(splits, "component", "left").select("node", "component", F.coalesce("splits", F.array().cast("array<string>")).alias("splits"))


def assign_splits(components: DataFrame, sizes: DataFrame, proportions: dict[str, float] | None = None, giant: float = 0.001) -> DataFrame:
    """(component, n, split, status) with ``split`` for every component.

    ``components`` is from :func:`update_components`, ``sizes`` has (node, n),
    the records that hang on a node. A component with one old split keeps it
    (status kept); with several it is quarantined, as it is if one of them was.
    New components (status new) fill what the splits lack of their
    ``proportions``: those above the share ``giant`` of all records (at most
    1/giant of them) one by one, largest first, each into the split that lacks
    most; the rest in the order of a hash along their running total. The
    outcome depends on names and sizes only.
    """
    proportions = proportions or PROPORTIONS
    sizes = sizes.groupBy("node").agg(F.sum("n").alias("n"))
    per = components.select("node", "component", "splits").join(sizes, "node", "left").groupBy("component").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.first("splits").alias("splits"))
    known = F.size("splits")
    status = F.when((known > 1) | F.array_contains("splits", QUARANTINE), "quarantined").when(known == 1, "kept").otherwise("new")
    split = F.when(F.col("status") == "quarantined", QUARANTINE).when(F.col("status") == "kept", F.col("splits")[0])
    per = staged(per.withColumn("status", status).withColumn("split", split).drop("splits"), "sizes")
    have = {r["split"]: r["n"] for r in per.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # one row a split
    total = sum(have.values()) or 0
    lacks = {s: p * (total - have.get(QUARANTINE, 0)) - have.get(s, 0) for s, p in proportions.items()}
    new = per.where("status = 'new'")
    chosen, placed_n = [], []
    for r in new.where(F.col("n") > giant * total).orderBy(F.desc("n"), "component").collect():  # at most 1 / giant rows
        s = max(lacks, key=lambda x: (lacks[x], x))
        lacks[s] -= r["n"]
        chosen.append((r["component"], s))
        placed_n.append(r["n"])
    small = with_running_total(new.where(F.col("n") <= giant * total).select("component", "n", F.xxhash64("component").alias("_h")), [F.col("_h"), F.col("component")], "n").drop("_h")
    open_ = {s: max(0.0, v) for s, v in lacks.items()}
    if not any(open_.values()):
        open_ = dict(proportions)
    unplaced = total - sum(v for s, v in have.items() if s is not None) - sum(placed_n)
    scale, bound, edges = unplaced / sum(open_.values()), 0.0, []
    for s, v in open_.items():
        bound += v * scale
        edges.append((bound, s))
    pick = F.lit(edges[-1][1])
    for edge, s in reversed(edges[:-1]):
        pick = F.when(F.col("before") + F.col("n") / 2 < F.lit(edge), s).otherwise(pick)
    placed = small.select("component", pick.alias("_new"))
    if chosen:
        placed = placed.unionByName(per.sparkSession.createDataFrame(chosen, "component string, _new string"))
    return per.join(placed, "component", "left").select("component", "n", F.coalesce("split", "_new").alias("split"), "status")


def block_entities(blocks: DataFrame) -> DataFrame:
    """(block_id, run, voice, filename, anchor) of current blocks; the anchor is a node that stands for the block."""
    named = blocks.select("block_id", run_number(F.col("run_id")).alias("run"), voice_key("voice").alias("voice"), "filename")
    anchor = F.coalesce(F.concat(F.lit("r"), F.col("run").cast("string")), F.concat(F.lit("v"), "voice"), F.concat(F.lit("f"), "filename"), F.concat(F.lit("b"), "block_id"))
    return named.withColumn("anchor", anchor)


def entity_links(blocks: DataFrame, works: DataFrame) -> DataFrame:
    """Distinct links (a, b) between the anchors of ``blocks`` and their narrators and works.

    ``works`` has (filename, title). Blocks without any name link to themselves.
    """
    seen = blocks.select("anchor", "voice", "filename").distinct()
    spellings = works.where("filename IS NOT NULL AND title IS NOT NULL").select("filename", "title").distinct()
    keys = spellings.select("title").distinct().withColumn("work", work_key("title")).where("work IS NOT NULL")
    titles = spellings.join(keys, "title").select("filename", "work").distinct()
    to_voice = seen.select(F.col("anchor").alias("a"), F.concat(F.lit("v"), "voice").alias("b"))
    to_work = seen.select("anchor", "filename").distinct().join(titles, "filename").select(F.col("anchor").alias("a"), F.concat(F.lit("w"), "work").alias("b"))
    return to_voice.unionByName(to_work).unionByName(seen.select(F.col("anchor").alias("a"), F.col("anchor").alias("b"))).where("b IS NOT NULL").distinct()


_ENTITIES = ["run_id", "voice", "filename"]


def save_components(nodes: DataFrame, folder: str) -> None:
    """Writes the component table (node, component, split) to ``folder``, a place of the caller that outlives the session."""
    nodes.select("node", "component", "split").write.mode("overwrite").parquet(folder)


def load_components(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("node string, component string, split string").parquet(folder)


def split_blocks(blocks: DataFrame, works: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(block_id, component, split, status) of ``blocks`` and the component table (node, component, split) to save for the next time.

    ``blocks`` has one row for each block, with run_id, voice and filename;
    ``works`` has (filename, title). ``previous`` is the table saved the last
    time: its components keep their splits however many blocks come to them.
    """
    blocks = staged(block_entities(blocks), "blocks")
    components = update_components(entity_links(blocks, works), previous)
    sizes = blocks.groupBy(F.col("anchor").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    splits = staged(assign_splits(components, sizes), "splits")
    nodes = components.join(splits, "component").select("node", "component", "split", "status")
    return blocks.join(nodes.withColumnRenamed("node", "anchor"), "anchor").select("block_id", "component", "split", "status"), nodes.drop("status")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks = staged(block_entities(current_blocks(spark, folder, _ENTITIES)), "blocks")
    components = update_components(entity_links(blocks, table(spark, folder, "works_manifest")))
    run = F.when(F.col("node").startswith("r"), F.expr("try_cast(substring(node, 2) AS bigint)"))
    groups = components.groupBy("component").agg(F.count(run).alias("runs"), F.min(run).alias("group_run")).where("runs > 1")
    member = components.join(groups, "component").select(F.col("node").alias("anchor"), "group_run")
    return blocks.select("block_id", "anchor").join(member, "anchor").select("block_id", "group_run")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return split_blocks(current_blocks(spark, folder, _ENTITIES), table(spark, folder, "works_manifest"))[0]


def p1_added(spark: SparkSession, folder: str) -> DataFrame:
    """(block_id, component, split, status, before): all current blocks, split in two goes.

    First the blocks ingested up to the median time are split and their
    component table is saved; then all are split with that table. ``before``
    is the split of the first go, null for blocks that came later.
    """
    blocks = current_blocks(spark, folder, ["ingested_at", *_ENTITIES])
    works = table(spark, folder, "works_manifest")
    when = F.col("ingested_at").cast("timestamp").cast("double")
    middle = blocks.agg(F.percentile_approx(when, 0.5).alias("t")).first()["t"]
    early = blocks.where(when <= F.lit(middle or 0.0))
    first, nodes = split_blocks(early, works)
    place = os.path.join(shared_dir(spark), "components", uuid.uuid4().hex)
    save_components(nodes, place)
    then, _ = split_blocks(blocks, works, load_components(spark, place))
    return then.join(first.select("block_id", F.col("split").alias("before")), "block_id", "left")


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_added": p1_added}
_NUMBER = "(?:[0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)"
_ORDINAL = r"(?:[0-9]+\s*(?:st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|new|revised|enlarged)"
_CLOSING = rf"(?s)^(.+?)[\s,;:.()\[\]–—\"”-]\s*(?:(?:volume|vol|part|pt|tome|edition|ed)\b\.?\s*{_NUMBER}|{_ORDINAL}\s+(?:edition|ed)\b)[\s.,;:)\]]*$"
_BARE = "trim(lower(strip_accents(title)))"
for _ in range(3):
    _BARE = rf"rtrim(regexp_replace({_BARE}, '{_CLOSING}', '\1'))"
_WORDS = rf"regexp_extract_all(replace(replace({_BARE}, chr(39), ''), '’', ''), '[\p{{L}}\p{{N}}]+')"
_VOICE = r"NULLIF(NULLIF(trim(regexp_replace(lower(strip_accents(voice)), '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g')), ''), 'unknown')"
ORACLE_SQL = {
    "p1_found": f"""
WITH RECURSIVE c AS (SELECT block_id, TRY_CAST(NULLIF(regexp_replace(run_id, '[^0-9]', '', 'g'), '') AS BIGINT) AS run, filename, {_VOICE} AS voice
  FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) AS r FROM voice_blocks) WHERE r = 1),
w AS (SELECT filename, {_WORDS} AS ws FROM works_manifest WHERE filename IS NOT NULL AND title IS NOT NULL),
w1 AS (SELECT filename, CASE WHEN len(ws) > 1 AND ws[1] IN ('a', 'an', 'the') THEN ws[2:] ELSE ws END AS ws FROM w),
w2 AS (SELECT DISTINCT filename, array_to_string(CASE WHEN len(ws) > 1 AND ws[-1] IN ('a', 'an', 'the') THEN ws[:-2] ELSE ws END, ' ') AS work FROM w1 WHERE len(ws) > 0),
m AS (SELECT DISTINCT block_id, 'r' || run AS node, run FROM c WHERE run IS NOT NULL UNION SELECT block_id, 'v' || voice, NULL FROM c WHERE voice IS NOT NULL UNION SELECT block_id, 'w' || work, NULL FROM c JOIN w2 USING (filename)),
e AS (SELECT DISTINCT x.node AS a, y.node AS b FROM m x JOIN m y USING (block_id) WHERE x.node <> y.node),
reach(a, b) AS (SELECT DISTINCT node, node FROM m UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS node, count(DISTINCT n.run) AS runs, min(n.run) AS group_run FROM reach JOIN (SELECT DISTINCT node, run FROM m WHERE run IS NOT NULL) n ON n.node = reach.b GROUP BY a)
SELECT DISTINCT block_id, group_run FROM m JOIN g USING (node) WHERE runs > 1
"""
}
