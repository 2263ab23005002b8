"""A source repository as tables: census, inventory and facts of every file.

Git is asked on the driver for the list of tracked files only; contents are read and
facts extracted by the executors, file by file.
"""

from __future__ import annotations

import os
import subprocess
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import paths, text
from strandloom.sources import anchors, extractors

for _module in (sys.modules[__name__], anchors, extractors, paths):  # workers need no copy of this package
    cloudpickle.register_pickle_by_value(_module)

#: Files over these sizes have no line count, and no facts.
LARGEST_COUNTED, LARGEST_EXTRACTED = 4_000_000, 2_000_000
FACTS = "path string, module string, language string, tag string, name string, kind string, visibility string, value string, target string, channel string, line int, anchor string, package string, primary string"


def tracked_files(repo: str) -> list[str] | None:
    """Git's own list in order, or None outside a work tree."""
    got = subprocess.run(["git", "-C", repo, "ls-files", "-z"], capture_output=True)
    return sorted(x for x in got.stdout.decode("utf-8", "replace").split("\0") if x) if got.returncode == 0 else None


def walked_files(repo: str) -> list[str]:
    """Files below folders that are neither hidden nor excluded."""
    found = []
    for folder, names, files in os.walk(repo):
        names[:] = [n for n in names if n not in paths.WALK_EXCLUDE and not n.startswith(".")]
        found += [os.path.relpath(os.path.join(folder, f), repo) for f in files if not f.startswith(".")]
    return sorted(found)


def head(repo: str) -> str:
    """The commit, or one that says it is none."""
    got = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True)
    if got.returncode:
        return "unpinned"
    dirty = subprocess.run(["git", "-C", repo, "status", "--porcelain"], capture_output=True, text=True).stdout
    return got.stdout.strip() + ("+dirty" if dirty.strip() else "")


def changed_files(repo: str, a: str, b: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old path) between two commits, renames followed."""
    got = subprocess.run(["git", "-C", repo, "diff", "--name-status", "-M", "-z", a, b], capture_output=True, text=True, check=True).stdout.split("\0")
    out, i = [], 0
    while i + 1 < len(got):
        status = got[i]
        if status[:1] in "RC":
            out.append((status, got[i + 2], got[i + 1]))
            i += 3
        else:
            out.append((status, got[i + 1], None))
            i += 2
    return out


def contents(spark: SparkSession, repo: str, listed: list[str], excludes: list[str] | None = None) -> DataFrame:
    """(path, bytes, content) of the listed files, read by the executors."""
    root = os.path.abspath(repo)
    census = spark.createDataFrame([(p,) for p in listed], "path string")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load("file://" + root)
    at = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 20)
    files = read.select(F.url_decode(F.regexp_replace(at, r"\+", "%2B")).alias("path"), F.col("length").alias("bytes"), "content")
    files = files.join(F.broadcast(census), "path", "left_semi")
    return files.where(~paths.has_segment(F.col("path"), excludes)) if excludes else files


def module_roots(listed: list[str]) -> list[str]:
    """Folders with a manifest, else the folders at the top; deepest first, the root as (root)."""
    manifests = {k for k in paths.BY_NAME if k != "Dockerfile"} - {"settings.gradle", "settings.gradle.kts"}
    roots = {p.rsplit("/", 1)[0] for p in listed if "/" in p and (p.rsplit("/", 1)[1] in manifests or p.endswith(paths.PROJECT_ENDINGS))}
    roots = roots or {p.split("/", 1)[0] for p in listed if "/" in p}
    return sorted(roots, key=lambda r: (-r.count("/"), r))


def inventory(files: DataFrame, roots: list[str]) -> DataFrame:
    """path, module, language, role, loc, bytes, binary for each file."""
    body = F.decode("content", "utf-8")
    binary = paths.is_binary(F.col("path")) | (F.instr(F.hex(F.substring("content", 1, 8192)), "00") > 0) & F.contains(F.substring("content", 1, 8192), F.lit(b"\x00"))
    spark = files.sparkSession
    owners = spark.createDataFrame([(r,) for r in roots] or [("",)], "root string")
    each = files.select("path", F.explode(paths.path_prefixes(F.col("path"))).alias("root")).join(F.broadcast(owners), "root").groupBy("path").agg(F.max_by("root", F.char_length("root")).alias("module"))
    rows = files.select("path", "bytes", paths.language(F.col("path")).alias("language"), paths.role(F.col("path")).alias("role"), binary.alias("binary"), F.when(~binary & (F.col("bytes") < LARGEST_COUNTED), F.when(F.col("bytes") == 0, 0).otherwise(F.size(text.lines_of(body)))).otherwise(0).alias("loc"))
    return rows.join(each, "path", "left").select("path", F.coalesce("module", F.lit("(root)")).alias("module"), "language", "role", "loc", "bytes", "binary")


def facts(files: DataFrame, listed: DataFrame) -> DataFrame:
    """All facts of all text files, each with its anchor; facts without one are dropped, notes and dependencies stay."""
    schema = pa.schema([(n, pa.int32() if n == "line" else pa.string()) for n in (f.split()[0] for f in FACTS.split(", "))])

    def run(batches):
        for b in batches:
            rows = []
            for p, m, lang, content in zip(*(b.column(k).to_pylist() for k in ("path", "module", "language", "content"))):
                lines = content.decode("utf-8", "replace").splitlines()
                index = anchors.LineIndex(lines)
                headr, found = extractors.extract(p, lang, lines)
                rows.append((p, m, lang, "file", p, None, None, None, None, None, len([x for x in lines if x.strip()]), None, headr["package"], headr["primary"]))
                for tag, name, kind, vis, value, target, channel, line in found:
                    anchor = index.build(line) if tag not in ("note", "dep") else None
                    if anchor is not None or tag in ("note", "dep"):
                        rows.append((p, m, lang, tag, name, kind, vis, value, target, channel, line, anchor, headr["package"], headr["primary"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    known = listed.where((~F.col("binary")) & (F.col("bytes") <= LARGEST_EXTRACTED)).select("path", "module", "language")
    return files.join(known, "path").select("path", "module", "language", "content").repartition("path").mapInArrow(run, FACTS)
