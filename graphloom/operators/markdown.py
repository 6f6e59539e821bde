"""Markdown documents as sections, and their references to code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import file_references, inline_code, strip_frontmatter

EXTENSIONS = (".md", ".markdown")
#: Parts that the targets of one name or section are dealt in, and ids of several names that are broadcast at most.
PARTS, MOST_SHARED = 16, 1000
SECTIONS = "path string, id string, name string, level int, start_line int, end_line int, content string"
_ATX = re.compile(r"^(#{1,6})(?:\s+(.*)|)$")


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, text) of ATX headings and of lines underlined by `=` or `-`; fences are not looked at."""
    found = []
    for i, line in enumerate(lines):
        bare = line.strip()
        atx = _ATX.match(line.lstrip())
        if atx and (text := (atx[2] or "").strip()):
            found.append((i, len(atx[1]), text))
        under = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if bare and under and set(under) == {"="}:
            found.append((i, 1, bare))
        elif bare and not bare.startswith("#") and under and set(under) == {"-"}:
            found.append((i, 2, bare))
    return found


def sections(path: str, text: str) -> Iterator[tuple]:
    """Rows of `SECTIONS` for a text without front matter.

    A section runs to the next heading of its level or a higher one, so nested ones lie within it;
    what precedes the first heading belongs to none. Repeated ids get `:2`, `:3`, ...
    """
    lines = text.splitlines()
    heads = headings(lines)
    taken: set[str] = set()
    for k, (at, level, name) in enumerate(heads):
        end = next((h[0] for h in heads[k + 1 :] if h[1] <= level), len(lines))
        key, n = f"{path}:{name}", 1
        while key in taken:
            n += 1
            key = f"{path}:{name}:{n}"
        taken.add(key)
        yield path, key, name, level, at + 1, end, "\n".join(lines[at + 1 : end]).strip()


def parse(files: DataFrame) -> DataFrame:
    """`SECTIONS` and inline_code_refs, file_path_refs of `files` (path, content); other files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["content"], strict=True) for r in sections(p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])

    wanted = files.where(F.lower("path").rlike(r"\.(md|markdown)$")).select("path", strip_frontmatter(F.coalesce("content", F.lit(""))).alias("content"))
    found = wanted.mapInPandas(run, SECTIONS)
    return found.select("*", inline_code(F.col("content")).alias("inline_code_refs"), file_references(F.col("content")).alias("file_path_refs"))


def resolve(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, match_type, matched_text): references of sections to functions and classes by
    name, all of that name, and to files by id; a name goes before a path for the same target."""
    code = nodes.where("label = 'Entity' and entity_type in ('Function', 'Class')").select(F.col("id").alias("to_id"), F.col("name").alias("matched_text"))
    files = nodes.where("label = 'Entity' and entity_type = 'File'").select(F.col("id").alias("to_id"), F.col("id").alias("matched_text"))

    def refs(column: str) -> DataFrame:
        return parsed.select(F.col("id").alias("from_id"), F.explode(column).alias("matched_text"))

    # a target has one name, but for nodes that share an id: only theirs can give a pair twice, so no
    # other pair is shuffled or sorted
    names = code.groupBy("to_id").agg(F.min("matched_text").alias("matched_text"), F.countDistinct("matched_text").alias("names"))
    asked = refs("inline_code_refs").distinct()
    named = asked.join(names.where("names = 1").drop("names"), "matched_text").select("from_id", "to_id", "matched_text")
    several = asked.join(code.join(names.where("names > 1").select("to_id"), "to_id", "left_semi"), "matched_text").groupBy("from_id", "to_id").agg(F.min("matched_text").alias("matched_text"))
    # code spans can name files, too; a file that is also code by its id gives way to the name
    paths = asked.unionAll(refs("file_path_refs")).distinct().join(files.distinct(), "matched_text").select("from_id", "to_id", "matched_text")
    both = code.join(files.select("to_id"), "to_id", "left_semi").join(asked, "matched_text").select("from_id", "to_id").distinct()
    found = named.unionByName(several).withColumn("match_type", F.lit("inline_code"))
    return found.unionByName(paths.join(both, ["from_id", "to_id"], "left_anti").withColumn("match_type", F.lit("file_path"))).select("from_id", "to_id", "match_type", "matched_text")


def affected(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(section, matched_text): references to the nodes of `deleted` (id), as they stood before."""
    refs = edges.where("relationship = 'REFERENCES'")
    return refs.join(deleted.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("section"), F.get_json_object("properties", "$.matched_text").alias("matched_text")).where("matched_text is not null").distinct()


def relink(hit: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, relationship, properties) that restore references by name, where the section is
    still there and the edge isn't; each once."""
    alive = hit.join(nodes.where("entity_type = 'Section'").select(F.col("id").alias("section")), "section", "left_semi")
    code = nodes.where("label = 'Entity' and entity_type in ('Function', 'Class')").select(F.col("id").alias("to_id"), F.col("name").alias("matched_text"))
    # targets go as sets of a section and of a name, dealt in parts, so that no pair is sorted or shuffled as a row
    parts = F.pmod(F.xxhash64("to_id"), F.lit(PARTS)).cast("int").alias("part")
    names = code.groupBy("matched_text", parts).agg(F.collect_set("to_id").alias("named"))
    there = edges.where("relationship = 'REFERENCES'").select(F.col("from_id").alias("section"), "to_id").groupBy("section", parts).agg(F.collect_set("to_id").alias("there"))
    several = code.groupBy("to_id").agg(F.countDistinct("matched_text").alias("names")).where("names > 1").select("to_id")
    several = F.broadcast(several) if several.limit(MOST_SHARED + 1).count() <= MOST_SHARED else several
    sets = alive.distinct().join(names, "matched_text").join(there, ["section", "part"], "left")
    left = F.when(F.col("there").isNull(), F.col("named")).otherwise(F.array_except("named", "there"))
    new = sets.select("section", "matched_text", F.explode(left).alias("to_id"))
    shared = new.join(several, "to_id", "left_semi").groupBy("section", "to_id").agg(F.min("matched_text").alias("matched_text"))
    new = new.join(several, "to_id", "left_anti").unionByName(shared)
    properties = F.to_json(F.struct(F.lit("inline_code").alias("match_type"), "matched_text", F.lit(True).alias("relinked")))
    return new.select(F.col("section").alias("from_id"), "to_id", F.lit("REFERENCES").alias("relationship"), properties.alias("properties"))
