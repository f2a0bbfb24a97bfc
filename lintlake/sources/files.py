"""Source trees: reading them, choosing files, and the limits on a snapshot."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import values as V
from lintlake.functions.text import directory_keys, file_name, ignored, path_parts, source_text, walk_key
from lintlake.operators.timelines import prefix_sums
from lintlake.session import materialize, spread

KEY = "snapshot_id"


READ_BYTES = 32 * 1024 * 1024


def list_source_trees(roots: DataFrame) -> DataFrame:
    """Regular files below each root of ``roots(snapshot_id, root)``, symbolic links left out.

    Spark's own file listing hides empty files and names that start with an
    underscore, which source trees are full of, so each task walks its roots.
    Folders must be reachable from the executors. A folder that cannot be
    listed is a row too: its path ends in a slash and has no length.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for snapshot, root in zip(frame[KEY], frame["root"]):
                closed: list[OSError] = []
                for folder, _, names in os.walk(root, followlinks=False, onerror=closed.append):
                    listed = []
                    for name in names:
                        full = os.path.join(folder, name)
                        try:
                            info = os.lstat(full)
                        except OSError as error:
                            closed.append(error)
                            continue
                        if stat.S_ISREG(info.st_mode):
                            listed.append((snapshot, root, os.path.relpath(full, root), info.st_size))
                    yield pd.DataFrame(listed, columns=[KEY, "root", "path", "length"])
                lost = [(snapshot, root, os.path.relpath(e.filename, root) + "/" * os.path.isdir(e.filename), None) for e in closed]
                yield pd.DataFrame(lost, columns=[KEY, "root", "path", "length"]).astype({"length": "Int64"})

    return spread(roots.select(KEY, "root")).mapInPandas(walk, f"{KEY} BIGINT, root STRING, path STRING, length BIGINT")


def read_source_trees(roots: DataFrame, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """``(snapshot_id, path, length, content)`` of every file; content only of Python files up to ``max_bytes``.

    The listing is spread over all cores before contents are read, so one
    large tree does not stay with the task that listed it. Contents leave a
    task in pieces of bounded size.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents, begin, held = [], 0, 0
            rows = frame.drop(columns=["root", "wanted"])
            for i, (root, path, wanted) in enumerate(zip(frame["root"], frame["path"], frame["wanted"])):
                data = None
                if wanted:
                    try:
                        with open(os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW), "rb") as handle:
                            data = handle.read(max_bytes + 1)
                    except OSError:
                        pass  # gone, replaced or closed: a row without content, which parse_status shows
                contents.append(data)
                held += len(data or b"")
                if held >= READ_BYTES:
                    yield rows.iloc[begin : i + 1].assign(content=contents)
                    contents, begin, held = [], i + 1, 0
            yield rows.iloc[begin:].assign(content=contents)

    listed = list_source_trees(roots)
    parts = 4 * listed.sparkSession.sparkContext.defaultParallelism
    return (
        listed.withColumn("wanted", F.coalesce(is_eligible(max_bytes), F.lit(False)))
        .repartition(parts, KEY, "path")
        .mapInPandas(read, schemas.SOURCE_FILES)
    )


def read_source_tree(spark: SparkSession, root: str, snapshot_id: int = 0) -> DataFrame:
    """S1 for one tree."""
    return read_source_trees(spark.createDataFrame([(snapshot_id, root)], f"{KEY} BIGINT, root STRING"))


def with_source(files: DataFrame, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """Decoded ``source``, or the ``problem`` of a file that has none: too_large or unreadable."""
    size = F.greatest(F.coalesce("length", F.lit(0)), F.coalesce(F.length("content"), F.lit(0)))
    problem = F.when(size > max_bytes, "too_large").when(F.col("content").isNull(), "unreadable")
    return files.select(KEY, "path", F.when(problem.isNull(), source_text("content")).alias("source"), problem.alias("problem"))


def is_python() -> Column:
    return file_name("path").endswith(".py") & ~ignored("path")


def is_eligible(max_bytes: int = V.MAX_FILE_BYTES) -> Column:
    return is_python() & (F.col("length") <= max_bytes)


def python_files(files: DataFrame) -> DataFrame:
    """Python files outside ignored directories, of any size, and what could not be listed."""
    return files.filter(is_python() | (F.col("path").endswith("/") & ~ignored("path")))


def eligible_files(files: DataFrame) -> DataFrame:
    """Python files outside ignored directories and not above the size limit."""
    return files.filter(is_eligible())


def inventory_cuts(
    files: DataFrame,
    max_files: int = V.MAX_FILES,
    max_bytes: int = V.MAX_SOURCE_BYTES,
    max_dirs: int = V.MAX_DIRECTORIES,
) -> DataFrame:
    """Where the walk of a snapshot stops: ``(snapshot_id, cut)``, only for those that reach a limit.

    Totals, which combine before the shuffle, find the few snapshots that can
    reach a limit. Only their rows are ordered, in slices, so one snapshot may
    hold all files and a limit may have any size.
    """
    files = files.select(KEY, "path", "length")
    python, entered = eligible_files(files), files.filter(~ignored("path"))
    # A file lies in as many directories as its path has parts, the root included.
    counted = entered.groupBy(KEY).agg(
        F.count_if(is_eligible()).alias("n"),
        F.sum(F.when(is_eligible(), F.col("length"))).alias("b"),
        F.sum(F.size(path_parts("path"))).alias("d"),
    )
    heavy, wide = (F.col("n") > max_files) | (F.col("b") > max_bytes), F.col("d") > max_dirs
    suspects = counted.select(KEY, F.coalesce(heavy, F.lit(False)).alias("heavy"), wide.alias("wide")).filter("heavy OR wide")
    suspects = materialize(suspects, "suspects")

    if suspects.isEmpty():
        return suspects.select(KEY, F.lit(None).cast("array<string>").alias("cut"))
    ordered = python.join(suspects.filter("heavy"), KEY, "left_semi").select(KEY, walk_key("path").alias("cut"), "length")
    ordered = prefix_sums(ordered, [KEY], [F.col("cut")], {"files": F.lit(1), "bytes": F.col("length")})
    file_cut = ordered.filter((F.col("files") > max_files) | (F.col("bytes") > max_bytes))

    folders = entered.join(suspects.filter("wide"), KEY, "left_semi").select(KEY, F.explode(directory_keys("path")).alias("cut"))
    folders = prefix_sums(folders.distinct(), [KEY], [F.col("cut")], {"folders": F.lit(1)})
    folder_cut = folders.filter(F.col("folders") > max_dirs)

    cuts = file_cut.select(KEY, "cut").unionByName(folder_cut.select(KEY, "cut"))
    return cuts.groupBy(KEY).agg(F.min("cut").alias("cut"))


def bounded_inventory(
    files: DataFrame,
    max_files: int = V.MAX_FILES,
    max_bytes: int = V.MAX_SOURCE_BYTES,
    max_dirs: int = V.MAX_DIRECTORIES,
) -> DataFrame:
    """S3: the files a walk yields before it reaches a limit.

    Files before the cut are exactly those of the walk, so the limit is a
    filter and file contents are not sorted. The cuts, one short row for each
    snapshot that reaches a limit, are written first: their size is then known
    when the join is planned, and contents are not shuffled to meet them.
    Directories are those that hold files of any kind; an empty one does not
    exist in a table of files.
    """
    cuts = materialize(inventory_cuts(files, max_files, max_bytes, max_dirs), "cuts")
    kept = eligible_files(files)
    if cuts.isEmpty():
        return kept
    kept = kept.join(cuts, KEY, "left")
    return kept.filter(F.col("cut").isNull() | (walk_key("path") < F.col("cut"))).drop("cut")


def workload(inventory: DataFrame) -> DataFrame:
    """Files and bytes per snapshot."""
    return inventory.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("length").cast("long").alias("source_bytes")
    )


def resource_audit(
    files: DataFrame, byte_limit: int = V.WORKSPACE_BYTES, entry_limit: int = V.WORKSPACE_ENTRIES
) -> DataFrame:
    """Per snapshot ``ok``, ``workspace_bytes`` or ``workspace_entries``, whichever is exceeded first.

    Entries are files and the directories above them, in walk order: what a
    directory holds (subdirectories, then files) comes before what its
    subdirectories hold. On the same entry bytes are tested first.
    """
    files = files.select(KEY, "path", "length")
    totals = files.groupBy(KEY).agg(
        F.sum("length").alias("b"), F.sum(F.size(path_parts("path"))).alias("most_entries")
    )
    suspects = totals.filter((F.col("b") > byte_limit) | (F.col("most_entries") > entry_limit)).select(KEY)
    suspects = materialize(suspects, "suspects")
    listed = files.join(suspects, KEY, "left_semi")

    parent = F.element_at(directory_keys("path"), -1)
    as_files = listed.select(
        KEY, parent.alias("parent"), F.lit(1).alias("is_file"), file_name("path").alias("name"), "length"
    )
    folder = listed.select(KEY, F.explode(directory_keys("path")).alias("k")).filter(F.size("k") > 0).distinct()
    as_folders = folder.select(
        KEY,
        F.slice("k", F.lit(1), F.size("k") - 1).alias("parent"),
        F.lit(0).alias("is_file"),
        F.substr(F.element_at("k", -1), F.lit(2)).alias("name"),
        F.lit(0).cast("long").alias("length"),
    )
    entries = as_files.unionByName(as_folders)
    order = [F.col("parent"), F.col("is_file"), F.col("name")]
    walked = prefix_sums(entries, [KEY], order, {"entries": F.lit(1), "bytes": F.col("length")})
    # The first entry at which a limit is passed; on the same one bytes come first.
    over = F.when(F.col("bytes") > byte_limit, "workspace_bytes").when(F.col("entries") > entry_limit, "workspace_entries")
    breached = walked.filter(over.isNotNull()).groupBy(KEY).agg(F.min_by(over, "entries").alias("reason"))
    return totals.select(KEY).join(breached, KEY, "left").select(KEY, F.coalesce("reason", F.lit("ok")).alias("outcome"))
