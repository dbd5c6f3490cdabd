"""Change an output in place, file by file: only files with a changed row are written anew.

A full output of a large table mostly stays as it is when a few rows were corrected.  Rows
are told apart by their key; the file each lies in is known to the scan.  A file with a row
that differs is read again, its rows are replaced in their order, and the new file takes
the old one's name.  All other files are left alone, byte by byte.

New files are first written beside the old ones under a name that readers pass over.  Then
a list of them is put in place in one step, and only then they take their names, one rename
that replaces a file each.  Whoever opens the output next finishes what such a list asks
for, so a driver lost on the way leaves no mixture: ``finish_rewrite``.  A reader that
starts in the middle sees every file in its old or its new form, and no row twice.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seriesmend.model import join_on_key, named
from seriesmend.plans.staging import delete_folder
from seriesmend.sinks.files import qualified

LIST = "_sm_rewrite.json"
FILE, PLACE = "_sm_file", "_sm_place"


def rewrite_changed(
    spark: SparkSession, path: str, corrected: DataFrame, row_key: tuple[str, ...], variables: list[str]
) -> list[str] | None:
    """Put the ``variables`` of ``corrected`` (with the row key) into the parquet output at ``path``.

    Returns the names of the rewritten files; None, and nothing is written, if the output
    can't be changed this way: a variable it has no double column for, or files in
    subfolders.  Call ``check_same_rows`` first: a row without a partner keeps its values.
    Null keys match null keys; a missing value replaces a present one and the other way.
    """
    finish_rewrite(spark, path)
    table = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    if any(not isinstance(kinds.get(v), T.DoubleType) for v in variables):
        return None
    root = path.rstrip("/")
    new = {v: f"_sm_new_{i}" for i, v in enumerate(variables)}
    fixed = corrected.select(
        *[named(k) for k in row_key], F.lit(True).alias("_sm_there"),
        *[named(v).cast("double").alias(n) for v, n in new.items()])
    placed = table.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    differs = reduce(lambda a, b: a | b, [~named(v).eqNullSafe(named(n)) for v, n in new.items()])
    touched = join_on_key(
        placed.select(*dict.fromkeys((*row_key, *variables, FILE))), fixed, row_key
    ).filter(F.col("_sm_there") & differs)
    # names of files: far fewer than the scan's own list of them
    changed = sorted(r[0] for r in touched.select(FILE).distinct().collect())
    # the scan may write an empty authority that the root leaves out
    if any(urlsplit(f).path.rpartition("/")[0] != urlsplit(qualified(spark, root)).path for f in changed):
        return None
    if not changed:
        return []
    # a condition on the file leaves the others out of the scan
    again = table.filter(F.col("_metadata.file_path").isin(changed)).select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
    joined = join_on_key(again, fixed, row_key)
    value = {v: F.when(F.col("_sm_there"), named(n)).otherwise(named(v)).alias(v) for v, n in new.items()}
    rows = joined.select(*[value.get(c, named(c)) for c in table.columns], FILE, PLACE)
    # as long as the list of changed files
    numbers = F.broadcast(spark.createDataFrame(list(zip(changed, range(len(changed)))), f"{FILE} string, _sm_no int"))
    # one task per file, its rows in their order
    work = f"{root}/_sm_fresh-{uuid.uuid4().hex}"
    dealt = rows.join(numbers, FILE).repartition(len(changed), "_sm_no")
    dealt.sortWithinPartitions("_sm_no", PLACE).drop(FILE, PLACE).write.option("maxRecordsPerFile", 0).partitionBy(
        "_sm_no").parquet(work)
    moves = []
    for i, old in enumerate(changed):
        made = [f for f in _files(spark, f"{work}/_sm_no={i}") if f.endswith(".parquet")]
        if len(made) != 1:
            delete_folder(spark, work)
            raise OSError(f"{len(made)} new files for {old}")
        moves.append((made[0], _as_path(spark, old)))
    _put(spark, f"{root}/{LIST}", json.dumps({"work": work, "moves": moves}))
    finish_rewrite(spark, path)
    return [f.rpartition("/")[2] for f in changed]


def finish_rewrite(spark: SparkSession, path: str) -> None:
    """Carry out a rewrite whose list is in place; nothing if there is none."""
    root = path.rstrip("/")
    told = _read(spark, f"{root}/{LIST}")
    if told is None:
        return
    plan = json.loads(told)
    context, overwrite = _file_context(spark, root)
    for fresh, old in plan["moves"]:
        source, target = _path(spark, fresh), _path(spark, old)
        if context.util().exists(source):   # else it has its name already
            context.rename(source, target, overwrite)
    delete_folder(spark, plan["work"])
    context.delete(_path(spark, f"{root}/{LIST}"), False)


# --- files ---------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _as_path(spark: SparkSession, reported: str) -> str:
    """A file as the scan reports it, percent-encoded, as a plain path."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(reported)).toString()


def _file_context(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = _path(spark, path)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    return context, options


def _files(spark: SparkSession, folder: str) -> list[str]:
    where = _path(spark, folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in system.listStatus(where)]


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all."""
    where, beside = _path(spark, path), _path(spark, f"{path}.part")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(beside, where):
        raise OSError(f"could not write {path}")


def _read(spark: SparkSession, path: str) -> str | None:
    where = _path(spark, path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
