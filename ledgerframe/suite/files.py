"""Readers, writers and streams, over data written to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.operators import registry as R
from ledgerframe.operators.catalog import artifact_path
from ledgerframe.session import fresh_path
from ledgerframe.sources import catalogue as K
from ledgerframe.sources import scripts as W
from ledgerframe.streaming import jobs as Z
from ledgerframe.suite import sqltext as S
from ledgerframe.suite.registry import query


@query("read_scripts", f"select name, text, {S.fingerprint('text')} as file_hash from dir_scripts")
def _(v):
    root = fresh_path(v.spark, "scripts")
    files = v("dir_scripts").select(F.col("name").alias("path"), "text")
    W.write_files(files, root).agg(F.sum("bytes")).collect()
    scripts = W.read_scripts(v.spark, root)
    return R.with_fingerprint(scripts).select("name", "text", "file_hash")


STORED = f"""select {S.artifact_path('object_name', 'object_type')} as path, ddl as text from ddl_corpus
    union all select {S.artifact_path('object_name', 'object_type')} as path, ddl as text from program_ddl"""


def stored(v):
    corpus = v("ddl_corpus").unionByName(v("program_ddl"))
    path = artifact_path(F.col("object_name"), F.col("object_type"))
    return corpus.select(path.alias("path"), F.col("ddl").alias("text"))


@query("write_corpus", STORED)
def _(v):
    root = fresh_path(v.spark, "corpus")
    W.write_corpus(stored(v), root)
    return W.read_corpus(v.spark, root)


@query("write_files", f"select path, cast(strlen(text) as bigint) as bytes from ({STORED})")
def _(v):
    return W.write_files(stored(v), fresh_path(v.spark, "files"))


@query("read_catalogue", "select owner, object_name, object_type, generated, status from objects")
def _(v):
    root = fresh_path(v.spark, "catalogue")
    v("objects").write.parquet(f"{root}/objects")
    return K.read_catalogue(v.spark, root, "objects")


@query(
    "reconcile_stream",
    f"""select name, {S.fingerprint('text')} as file_hash, text, {S.type_('name')} as type, 0 as status from dir_scripts where {S.valid('name')}
    union all
    select name, {S.fingerprint('text')} as file_hash, text, {S.type_('name')} as type, status from registry where name not in (select name from dir_scripts)""",
)
def _(v):
    arrivals, root = fresh_path(v.spark, "arrivals"), fresh_path(v.spark, "registry")
    scripts = v("dir_scripts")
    # as many files as tasks, so that none holds a fixed share of all texts; they come in two batches
    scripts.write.parquet(arrivals)
    files = len(v.spark.read.schema(scripts.schema).parquet(arrivals).inputFiles())
    Z.seed_registry(v("registry"), root)
    stream = v.spark.readStream.schema(scripts.schema).option("maxFilesPerTrigger", max(1, (files + 1) // 2)).parquet(arrivals)
    Z.reconcile_stream(stream, root, fresh_path(v.spark, "progress")).awaitTermination()
    return Z.latest(Z.registry_versions(v.spark, root))


@query(
    "run_log_stream",
    """select run_id, step_id, ts, exit_code, seconds, case when exit_code = 0 then 0 else 2 end as status from
    (select *, coalesce(sum(exit_code) over (partition by run_id order by ts, step_id rows between unbounded preceding and 1 preceding), 0) = 0 as recorded
     from run_log) where recorded""",
)
def _(v):
    arrivals, root = fresh_path(v.spark, "steps"), fresh_path(v.spark, "replay")
    progress = fresh_path(v.spark, "progress")
    log = v("run_log")
    # Four stretches of time arrive one after the other; each is one batch of the stream.
    span = log.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    edges = [span.lo + (span.hi - span.lo) * i / 4 for i in range(1, 4)]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = log if low is None else log.where(F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
        part = part if high is None else part.where(F.col("ts") < F.lit(high).cast("timestamp_ntz"))
        part.write.mode("append").parquet(arrivals)
        steps = v.spark.readStream.schema(log.schema).parquet(arrivals)
        Z.run_log_stream(steps, root, progress).awaitTermination()
    return Z.recorded_steps(v.spark, root)
