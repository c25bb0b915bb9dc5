"""Ignore patterns that directories set for what lies below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters that stand for some directories and for everything below while a pattern is compiled.
SOME, ALL = "\ue000", "\ue001"
#: Ignore lines that are broadcast; more are sorted.
FEW_LINES = 20_000


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of an ignore line, for paths relative to the root.

    A slash before its end ties a line to the root; ``*`` and ``?`` stay within a name, ``**`` crosses directories.
    """
    core = F.regexp_replace(F.regexp_replace(pattern, "^!", ""), "/+$", "")
    tied = core.contains("/")
    path = F.regexp_replace(core, "^/", "")
    quoted = F.regexp_replace(path, r"([.+^$(){}|\\])", r"\\$1")
    # what crosses directories is set aside while the stars within names are replaced
    held = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"^\*\*/", SOME), r"/\*\*/", f"/{SOME}"), r"/\*\*$", f"/{ALL}")
    within = F.regexp_replace(F.regexp_replace(held, r"\*+", "[^/]*"), r"\?", "[^/]")
    body = F.replace(F.replace(within, F.lit(SOME), F.lit("(?:.*/)?")), F.lit(ALL), F.lit(".*"))
    return F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), body, F.lit("$"))


def _ancestors(path: Column, itself: bool) -> Column:
    """``(at, distance)`` of a relative path's directories, the root as the empty path, and of itself."""
    parts = F.split(path, "/")
    n = F.size(parts)
    upto = F.transform(F.sequence(F.lit(0), n if itself else n - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at"), (n - k).alias("distance")))
    return upto


def ignored(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """``entries (path, is_dir)`` with ``kept``, ``pattern`` and ``at``: the line that leaves an entry out and the path it matched.

    ``frames (directory, patterns)``: lines set in directories, relative to the root (the root is the empty path). An entry is tested by the lines of all
    directories above it, outer ones first, and a directory by its own too; the last line that matches it decides, else
    its parent's match does, and ``!`` keeps. What lies below a directory that is left out is left out with it.

    Joins are by equality of paths: an entry has a row for each directory above it and each of its frames. Tables of entries are
    never broadcast, since a path takes far more memory than the bytes it was read from or shuffled in; a few lines are.
    """
    entries = entries.repartition("path")  # every step below is by path: one shuffle of entries, in as many tasks as it has
    lines = frames.select("directory", F.posexplode("patterns").alias("line", "pattern")).where("pattern <> '' and pattern not like '#%'")
    compiled = lines.select(
        F.col("directory").alias("at"), "line", "pattern", pattern_regex(F.col("pattern")).alias("regex"), F.col("pattern").startswith("!").alias("keeps"), F.col("pattern").endswith("/").alias("directories"),
        F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))).alias("level"),
    )
    scopes = entries.select("path", "is_dir", F.explode(_ancestors(F.col("path"), True)).alias("s")).where("s.distance > 0 or is_dir").select("path", "is_dir", F.col("s.at").alias("at"))
    lines_side = F.broadcast(compiled) if compiled.count() <= FEW_LINES else compiled.hint("merge")
    tested = scopes.join(lines_side, "at").select("path", "is_dir", "line", "level", "pattern", "regex", "keeps", "directories", F.explode(_ancestors(F.col("path"), True)).alias("q")).where("q.at <> ''")
    hit = F.expr("rlike(q.at, regex)") & (~F.col("directories") | (F.col("q.distance") > 0) | F.col("is_dir"))
    decided = tested.where(hit).groupBy("path").agg(F.max_by(F.struct("pattern", "keeps", F.col("q.at").alias("at")), F.struct(-F.col("q.distance"), "level", "line")).alias("d"))
    out = decided.where("not d.keeps").select("path", "d.pattern", "d.at")
    shut = out.join(entries.where("is_dir").select("path").hint("merge"), "path", "left_semi").select(F.col("path").alias("above"), F.col("pattern").alias("above_pattern"))
    pruned = (
        entries.select("path", F.explode(_ancestors(F.col("path"), False)).alias("s")).select("path", F.col("s.at").alias("above"), F.col("s.distance").alias("distance")).join(shut.hint("merge"), "above")
        .groupBy("path").agg(F.max_by(F.struct("above", "above_pattern"), "distance").alias("p"))
    )
    both = entries.join(out.hint("merge"), "path", "left").join(pruned.hint("merge"), "path", "left")
    return both.select("path", "is_dir", (F.col("at").isNull() & F.col("p").isNull()).alias("kept"), F.coalesce("p.above_pattern", "pattern").alias("pattern"), F.coalesce("p.above", "at").alias("at"))
