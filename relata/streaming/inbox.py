"""Import inbox (Z1): every file arriving in a folder becomes one import run.

Structured Streaming's file source tracks which files were taken (in the
checkpoint), so each file is imported once even across restarts; the
import itself is idempotent on natural keys, so a replayed micro-batch
finds everything unchanged.  One file per trigger keeps runs independent:
a file with errors is recorded as ERROR and does not block the next one.

Run records (status PROCESSING when a file is taken, then DONE or ERROR
with counts and step timings) are appended to ``<state>/runs``, error rows
to ``<state>/errors``.

A successful run writes the new table, the links of every n-n column and the
child tables under ``<state>/data/run=<id>`` and then, as one small file
written last, the manifest ``<state>/manifest/<id>.json``: the paths of all
parts that are current after the run, those that this run did not change
included.  The newest manifest is the next run's store, so links and children
of earlier files are kept; a run that died between two writes has no manifest
and leaves the store as it was.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.catalog import Catalog
from relata.plans.ingest import ImportSpec, MappingError, run_import
from relata.sources import fs
from relata.sources.stage import stage_file

RUN_SCHEMA = "run_id long, file string, status string, last_step string, res string, steps string"


def manifests(spark: SparkSession, state: str) -> list[int]:
    """Ids of the complete runs, in order."""
    names = fs.files(spark, posixpath.join(state, "manifest"))
    return sorted(int(n[:-len(".json")]) for n in names if n.endswith(".json"))


def current(spark: SparkSession, state: str) -> dict:
    """The newest manifest: ``{"table": path, "links": {column: path}, "children": {relation: path}}``; empty before the first run."""
    runs = manifests(spark, state)
    if not runs:
        return {"table": None, "links": {}, "children": {}}
    return json.loads(fs.read_text(spark, posixpath.join(state, "manifest", f"{runs[-1]:020d}.json")))


def store(spark: SparkSession, state: str) -> tuple[DataFrame | None, dict[str, DataFrame], dict[str, DataFrame]]:
    """The current table, links and children as frames."""
    now = current(spark, state)
    read = spark.read.parquet
    return (read(now["table"]) if now["table"] else None, {k: read(p) for k, p in now["links"].items()},
            {k: read(p) for k, p in now["children"].items()})


def commit_run(spark: SparkSession, state: str, run_id: int, result) -> dict:
    """Write what the run changed, then the manifest that makes it the store; returns the manifest."""
    now, root = current(spark, state), posixpath.join(state, "data", f"run={run_id}")
    for kind, frames in (("links", result.links), ("children", result.children)):
        for name, frame in frames.items():
            path = posixpath.join(root, kind, str(name))
            frame.write.mode("overwrite").parquet(path)
            now[kind][str(name)] = path
    now["table"] = posixpath.join(root, "table")
    result.table.write.mode("overwrite").parquet(now["table"])
    fs.write_text(spark, posixpath.join(state, "manifest", f"{run_id:020d}.json"), json.dumps(now))
    return now


def process_file(spark: SparkSession, catalog: Catalog, spec: ImportSpec, path: str, state: str, run_id: int,
                 initial: DataFrame) -> dict:
    """Import one staged file against the current store; record the run (PROCESSING, then DONE or ERROR).

    What is wrong with the file (its form, its rows, its mapping) is recorded
    and does not stop the files after it.  Any other failure, such as a lost
    executor or a full disk, is raised: the micro-batch fails and is run again.
    """
    if run_id in manifests(spark, state):  # a replayed batch: this run is stored
        return {"run_id": run_id, "file": path, "status": "DONE", "res": {}}
    spark.createDataFrame([(run_id, path, "PROCESSING", None, "{}", "{}")], RUN_SCHEMA).write.mode("append").parquet(
        posixpath.join(state, "runs"))
    table, links, children = store(spark, state)
    r = None
    try:
        r = run_import(catalog, spec, stage_file(spark, path), target=initial if table is None else table, links=links, children=children)
        status, last, res, steps = r.status, r.last_step, r.res, r.steps
        if status == "ERROR":
            r.errors.withColumn("run_id", F.lit(run_id)).withColumn("file", F.lit(path)).write.mode("append").parquet(
                posixpath.join(state, "errors"))
        elif r.table is not None:
            commit_run(spark, state, run_id, r)
    except MappingError as e:
        status, last, res, steps = "ERROR", "mapping_view", {"error": type(e).__name__, "message": str(e)[:500]}, {}
    finally:
        if r is not None:
            r.release()  # the result is written; a long stream must not fill the executors
    rec = (run_id, path, status, last, json.dumps(res, default=str), json.dumps(steps))
    spark.createDataFrame([rec], RUN_SCHEMA).write.mode("append").parquet(posixpath.join(state, "runs"))
    return {"run_id": run_id, "file": path, "status": status, "res": res}


def start_inbox(
    spark: SparkSession,
    inbox: str,
    state: str,
    catalog: Catalog,
    spec: ImportSpec,
    initial: DataFrame,
    checkpoint: str | None = None,
    once: bool = True,
    on_run: Callable[[dict], None] | None = None,
):
    """Start the inbox stream; ``once`` processes what is there now (availableNow) and stops."""
    checkpoint = checkpoint or posixpath.join(state, "_checkpoint")
    stream = (
        spark.readStream.format("text").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.csv").load(inbox)
        .select(F.input_file_name().alias("file"))
    )

    def batch(df: DataFrame, batch_id: int) -> None:
        # at most maxFilesPerTrigger distinct names per batch: bounded
        files = sorted({r.file for r in df.select("file").distinct().collect()})
        for i, f in enumerate(files):
            path = f[len("file:"):] if f.startswith("file:") else f
            info = process_file(spark, catalog, spec, path, state, batch_id * 1000 + i, initial)
            if on_run:
                on_run(info)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    q = w.start()
    if once:
        q.awaitTermination()
    return q
