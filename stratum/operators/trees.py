"""Walks of any depth: trees of topics whose directory and filter go down, and texts that include texts.

A walk goes level by level: the frontier meets the children (or the included files) in a join, and a round ends when nothing
new was found. The place of a row in a depth-first walk is an array of positions, which sorts as the walk would come by. A
place that leads back to one of its own ancestors is cut, so that cycles end; of several places of one file the first in
the walk's order counts. Rounds are staged, so that a plan holds one level, and no level passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.normalise import without_blank
from stratum.operators.retrieval import kept


def allowed(filters: Column, target: str) -> Column:
    """Whether a list between commas names the target, or nothing."""
    return (F.trim(F.coalesce(filters, F.lit(""))) == "") | F.array_contains(F.transform(F.split(filters, ","), lambda x: F.trim(x)), target)


def _bare(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"^[/\\]+|[/\\]+$", "")


def joined_path(*parts: Column) -> Column:
    """Parts between slashes, blank ones left out."""
    return F.array_join(without_blank(F.array(*[_bare(p) for p in parts])), "/")


def slug_of(path: Column) -> Column:
    """A path without its suffix, in lower case: parts between two underscores, other characters as one."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    parts = F.array_join(F.transform(without_blank(F.split(stem, "/")), lambda p: F.lower(F.trim(p))), "__")
    return F.regexp_replace(F.regexp_replace(parts, r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")


def walk(nodes: DataFrame) -> DataFrame:
    """tree, node, place, names, dirs, filters: each node that its tree's roots lead to, once, with the columns of all nodes above it.

    nodes: tree, node, parent (null: a root), pos, name, dir, filter. A node of several parents is walked from each; a place
    on a cycle is cut. A null position comes first, equal ones go by node.
    """
    own = nodes.select("tree", "node", "parent", F.struct(F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"), F.col("node").cast("string").alias("node")).alias("step"), *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "dir", "filter")])
    own = kept(own.filter("node IS NOT NULL"), "nodes")
    start = own.filter("parent IS NULL").select("tree", "node", F.array("step").alias("place"), F.array("node").alias("above"), F.array("name").alias("names"), F.array("dir").alias("dirs"), F.array("filter").alias("filters"))
    child = own.filter("parent IS NOT NULL").select(F.col("tree").alias("in"), F.col("node").alias("child"), F.col("parent").alias("up"), "step", "name", "dir", "filter")
    frontier = kept(start, "walk")
    out = frontier
    while not frontier.isEmpty():
        more = lambda column, value: F.concat(column, F.array(value)).alias(column)
        met = frontier.join(child, F.col("tree").eqNullSafe(F.col("in")) & (F.col("node") == F.col("up")) & ~F.array_contains("above", F.col("child")))
        frontier = kept(met.select("tree", F.col("child").alias("node"), more("place", "step"), more("above", "child"), more("names", "name"), more("dirs", "dir"), more("filters", "filter")), "walk")
        out = out.unionByName(frontier)
    return out.drop("above")


def topic_entries(nodes: DataFrame, files: DataFrame, target: str, suffix: str = ".adoc") -> DataFrame:
    """tree, ordinal, node, slug, title, path, topic_path, family of each topic that has a file, in the order of the walk.

    nodes: as walk() takes them, and file; roots are groups: one without a dir is left out with all below. files: path. A node
    whose filter doesn't allow the target is left out with all below; of the topics of one file the first stays.
    """
    seen = walk(nodes).filter((F.element_at("dirs", 1) != "") & F.forall("filters", lambda x: allowed(x, target)))
    named = seen.join(nodes.select(F.col("tree").alias("in"), F.col("node").alias("of"), F.trim("file").alias("file")).distinct(), F.col("tree").eqNullSafe(F.col("in")) & (F.col("node") == F.col("of"))).drop("in", "of")
    stem = _bare(F.col("file"))
    dirs = F.array_join(without_blank(F.transform("dirs", _bare)), "/")
    path = joined_path(dirs, F.when(stem.endswith(suffix), stem).otherwise(F.concat(stem, F.lit(suffix))))
    placed = named.filter((F.size("place") > 1) & (F.coalesce("file", F.lit("")) != "")).withColumn("path", path).join(files.select("path").distinct(), "path", "left_semi")
    first = placed.groupBy("tree", "path").agg(F.min_by(F.struct("node", "place", "names"), "place").alias("topic")).select("tree", "path", "topic.*")
    title = F.element_at("names", -1)
    own = without_blank(F.slice("names", F.lit(2), F.size("names")))
    rows = first.select("tree", "node", "place", slug_of(F.col("path")).alias("slug"), F.when(title != "", title).otherwise(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")).alias("title"), "path", own.alias("topic_path"), without_blank(F.slice("names", 1, 1)).alias("family"))
    return numbered(rows, "tree", "place")


def numbered(rows: DataFrame, by: str, place: str) -> DataFrame:
    """rows with ordinal (from 1) in the order of place. Of a tree the rows below each first two steps are counted, so that no task sorts a whole tree."""
    rows = kept(rows.withColumn("part", F.slice(place, 1, 2)), "numbered")
    parts = rows.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(by).alias("in"), F.col("part").alias("of"), "before")
    inside = F.row_number().over(Window.partitionBy(by, "part").orderBy(place))
    met = rows.withColumn("inside", inside).join(before, F.col(by).eqNullSafe(F.col("in")) & (F.col("part") == F.col("of")))
    return met.withColumn("ordinal", F.col("inside") + F.col("before")).drop("inside", "before", "part", "in", "of", place)


# texts that include texts

#: What a line is that includes a file, defines an attribute, or stands for no text.
INCLUDE = r"^include::([^\[]+)\[[^\]]*\]\s*$"
ATTRIBUTE = r"^:([A-Za-z0-9][\w-]*):(?:\s+(.*))?$"
SILENT = r"^(?:ifdef|ifndef|ifeval|endif)::.*$|^image::?.*$|^//.*$|^:!?[\w-]+!?:.*$"
PASSES = 5


def normal_path(path: Column) -> Column:
    """A path without '.' and '..'; null if it leaves the root."""
    step = lambda a, p: F.when(a.isNull() | ((p == "..") & (F.size(a) == 0)), F.lit(None)).when((p == "") | (p == "."), a).when(p == "..", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def segments(files: DataFrame) -> DataFrame:
    """path, seg, text, target: a file's lines up to each include, and what is included after them (null for the last). files: path, text."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n", -1)
    shown = lambda own: F.when(F.size(own) > 0, F.array_join(own, "\n"))
    empty = F.struct(F.array().cast("array<struct<text:string,target:string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(a: Column, line: Column) -> Column:
        target = F.trim(F.regexp_extract(line, INCLUDE, 1))
        part = F.struct(shown(a["open"]).alias("text"), target.alias("target"))
        return F.when(target == "", F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(line)).alias("open"))).otherwise(F.struct(F.concat(a["done"], F.array(part)).alias("done"), F.array().cast("array<string>").alias("open")))

    # files without an include, most of all, aren't folded
    whole = F.array(F.struct(F.array_join(lines, "\n").alias("text"), F.lit(None).cast("string").alias("target")))
    cut = F.aggregate(lines, empty, step, lambda a: F.concat(a["done"], F.array(F.struct(shown(a["open"]).alias("text"), F.lit(None).cast("string").alias("target")))))
    return files.select("path", F.posexplode(F.when(F.exists(lines, lambda x: x.rlike(INCLUDE)), cut).otherwise(whole)).alias("seg", "part")).select("path", "seg", "part.text", "part.target")


def _edges(parts: DataFrame, paths: DataFrame) -> DataFrame:
    """path, seg, child: which file each include means: beside the including one, else from the root. Targets with braces, and those that no file has, are none."""
    asked = parts.filter("target IS NOT NULL AND target NOT LIKE '%{%' AND target NOT LIKE '%}%'")
    beside = normal_path(F.concat_ws("/", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "target"))
    tried = asked.select("path", "seg", F.posexplode(F.array(beside, normal_path(F.col("target")))).alias("nth", "child")).filter("child IS NOT NULL")
    there = tried.join(paths.select(F.col("path").alias("child")), "child", "left_semi")
    return there.groupBy("path", "seg").agg(F.min_by("child", "nth").alias("child"))


def expanded(files: DataFrame, roots: DataFrame) -> DataFrame:
    """root, n_files, text: each root (path) with all that it includes, in order. files: path, text.

    A file stands where it is included first; later includes of it, missing ones, and such as lead back give nothing. Of
    several rows of one path the one with the least text counts.
    """
    files = kept(files.filter("path IS NOT NULL").groupBy("path").agg(F.min("text").alias("text")), "files")
    parts = kept(segments(files), "segments")
    edges = kept(_edges(parts, files).select(F.col("path").alias("from"), F.col("seg").cast("long").alias("step"), "child"), "includes")
    start = roots.select("path").distinct().join(files.select("path"), "path", "left_semi")
    best = frontier = kept(start.select(F.col("path").alias("root"), "path", F.array().cast("array<bigint>").alias("place"), F.array("path").alias("above")), "includes-0")
    while not frontier.isEmpty():
        met = frontier.join(edges, (F.col("path") == F.col("from")) & ~F.array_contains("above", F.col("child")))
        found = met.select("root", F.col("child").alias("path"), F.concat("place", F.array("step")).alias("place"), F.concat("above", F.array("child")).alias("above"))
        first = found.groupBy("root", "path").agg(F.min_by(F.struct("place", "above"), "place").alias("at")).select("root", "path", "at.*")
        # a file that was found later in the walk's order is found anew from here
        known = best.groupBy("root", "path").agg(F.min("place").alias("known"))
        frontier = kept(first.join(known, ["root", "path"], "left").filter("known IS NULL OR place < known").drop("known"), "includes")
        best = best.unionByName(frontier)
    best = best.groupBy("root", "path").agg(F.min("place").alias("place"))
    # a segment stands before what its include gives: one step deeper, between the steps
    rows = best.join(parts, "path").select("root", "path", F.concat(F.transform("place", lambda p: 2 * p + 1), F.array(2 * F.col("seg").cast("long"))).alias("place"), "text")
    whole = rows.groupBy("root").agg(F.count_distinct("path").alias("n_files"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
    texts = whole.select("root", "n_files", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))
    return texts.mapInPandas(_with_attributes, "root string, n_files long, text string")


def scoped(text: str, attributes: dict[str, str] | None = None) -> str:
    """A text with its attributes in place of {name}: each holds from its definition on. Definitions, comments and conditions go, and so do lines of an unknown name alone."""
    known, out = dict(attributes or {}), []

    def put(line: str) -> str:
        for _ in range(PASSES):
            new = re.sub(r"\{([\w-]+)\}", lambda m: known.get(m[1], m[0]), line)
            if new == line:
                break
            line = new
        return line

    for line in text.split("\n"):
        bare = line.strip()
        if m := re.match(ATTRIBUTE, bare):
            known[m[1]] = put((m[2] or "").strip())
        elif not re.match(SILENT, bare) and not re.fullmatch(r"\{[^}]+\}", (shown := put(line.rstrip())).strip()):
            out.append(shown)
    return "\n".join(out).strip()


def _with_attributes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(text=[scoped(t) for t in f["text"]])
