import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerframe.operators import ordering as O
from ledgerframe.session import fresh_path, materialize
from ledgerframe.sources import change_json as J
from ledgerframe.sources import scripts as W
from ledgerframe.sources.catalogue import read_catalogue
from ledgerframe.streaming import jobs as Z
from ledgerframe.streaming import registry_log as L
from ledgerframe.streaming.run_log import GROUPS


def test_scripts_round_trip(spark):
    root = fresh_path(spark, "scripts")
    texts = {"1_a.sql": "x\r\ny é", "2_b c%20+.sql": "b", "note.txt": "no", "deep/3_c.sql": "no"}
    frame = spark.createDataFrame(list(texts.items()), "path string, text string")
    sizes = {r.path: r.bytes for r in W.write_files(frame, root).collect()}
    assert sizes["1_a.sql"] == 7
    W.write_files(frame.where("path = '1_a.sql'").withColumn("text", F.lit("again")), root).collect()
    got = {r.name: r.text for r in W.read_scripts(spark, root).collect()}
    # Only the folder's own *.sql files, the rewritten one in its last form.
    assert got == {"1_a.sql": "again", "2_b c%20+.sql": "b"}
    assert not [n for n in os.listdir(root) if n.endswith(".tmp")]
    assert {r.name for r in W.read_script_listing(spark, root).collect()} == set(got)


def test_listing_does_not_read_content(spark):
    root = fresh_path(spark, "scripts")
    W.write_files(spark.createDataFrame([("1_a.sql", "x")], "path string, text string"), root).collect()
    plan = W.read_script_listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_bundled_scripts_win(spark):
    bundled = spark.createDataFrame([("9_z.sql", "b", None)], "name string, text string, ts timestamp")
    assert [r.name for r in W.read_scripts(spark, "/nowhere", bundled).collect()] == ["9_z.sql"]


def test_corpus_round_trip(spark):
    root = fresh_path(spark, "corpus")
    rows = [("tables/a.sql", "1"), ("views/b.sql", "2"), ("top.sql", "3")]
    W.write_corpus(spark.createDataFrame(rows, "path string, text string"), root)
    assert sorted(tuple(r) for r in W.read_corpus(spark, root).collect()) == sorted(rows)


def test_catalogue_from_files(spark):
    root = fresh_path(spark, "catalogue")
    spark.createDataFrame([("TR", "T", 1)], "trigger_name string, table_name string, more int").write.parquet(f"{root}/triggers")
    assert [tuple(r) for r in read_catalogue(spark, root, "triggers").collect()] == [("TR", "T")]


def test_json_defaults(spark):
    texts = ["{}", '{"should_run": true, "warnings": ["a"], "error": null, "scripts_written": 3}', '{"error": "e"}']
    got = [tuple(r) for r in J.read_change_set_result(spark.createDataFrame([(t,) for t in texts], "json string")).collect()]
    assert got == [(False, 0, 0, [], None), (True, 3, 0, ["a"], None), (False, 0, 0, [], "e")]


def test_change_set_json(spark):
    text = '{"head": {"ref": "b"}, "files": [{"filename": "x"}, {}], "commits": [{"sha": "s", "commit": {"message": "m"}}, {"sha": "t"}]}'
    frame = spark.createDataFrame([(1, text)], "change_id bigint, json string")
    assert [tuple(r) for r in J.read_change_files(frame).collect()] == [(1, 0, "x"), (1, 1, "")]
    assert [tuple(r) for r in J.read_change_commits(frame).collect()] == [(1, "s", 0, "m"), (1, "t", 1, "")]
    assert J.read_change_heads(frame).first().head_branch == "b"


def test_materialized_frame_is_the_same(spark):
    frame = spark.range(10).selectExpr("id", "struct(id as a, 'x' as b) as s")
    back = materialize(frame, "check")
    assert back.schema == frame.schema or back.columns == frame.columns
    assert sorted(r.id for r in back.collect()) == list(range(10))


def test_script_stream_equals_batch(spark, registry):
    arrivals, root, progress = (fresh_path(spark, n) for n in ("arrivals", "registry", "progress"))
    Z.seed_registry(registry({"1_a.sql": "old", "2_b.sql": "kept", "9_r_rollback.sql": "r"}), root)
    batches = [{"1_a.sql": "new", "3_c.sql": "c", "dev.sql": "d"}, {"3_c.sql": "c2", "2_b.sql": "kept"}, {"1_a.sql": "newest"}]
    for items in batches:
        spark.createDataFrame(list(items.items()), "name string, text string").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema("name string, text string").parquet(arrivals)
        Z.reconcile_stream(stream, root, progress).awaitTermination()
    got = {r.name: r.text for r in Z.latest(Z.registry_versions(spark, root)).collect()}
    assert got == {"1_a.sql": "newest", "2_b.sql": "kept", "9_r_rollback.sql": "r", "3_c.sql": "c2"}
    # A batch writes what it changes and nothing else.
    assert Z.registry_versions(spark, root).where("version = 2").count() == 1


def test_stream_goes_on_after_compaction(spark, registry):
    arrivals, old, new, progress = (fresh_path(spark, n) for n in ("arrivals", "old", "new", "progress"))
    Z.seed_registry(registry({"1_a.sql": "a", "2_b.sql": "b"}), old)
    for root, items in ((old, {"1_a.sql": "a2", "3_c.sql": "c"}), (new, {"3_c.sql": "c2", "2_b.sql": "b"})):
        if root == new:
            Z.compact_registry(spark, old, new)
        spark.createDataFrame(list(items.items()), "name string, text string").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema("name string, text string").parquet(arrivals)
        Z.reconcile_stream(stream, root, progress).awaitTermination()
    got = {r.name: r.text for r in Z.latest(Z.registry_versions(spark, new)).collect()}
    assert got == {"1_a.sql": "a2", "2_b.sql": "b", "3_c.sql": "c2"}
    versions = {r.version for r in Z.registry_versions(spark, new).select("version").distinct().collect()}
    assert versions == {0, 2}


def test_repeated_batch_changes_nothing(spark, registry, scripts):
    root = fresh_path(spark, "registry")
    Z.seed_registry(registry({"1_a.sql": "old"}), root)
    for _ in range(2):
        batch = scripts({"1_a.sql": "new", "2_b.sql": "b"})
        Z.write_version(Z.absorb_scripts(batch, Z.registry_versions(spark, root, 0)), root, 1)
    got = {r.name: r.text for r in Z.latest(Z.registry_versions(spark, root)).collect()}
    assert got == {"1_a.sql": "new", "2_b.sql": "b"}


def run_log(spark, rows):
    frame = spark.createDataFrame(rows, "run_id bigint, step_id bigint, t bigint, exit_code int, seconds double")
    return frame.selectExpr("run_id", "step_id", "cast(timestamp_micros(t) as timestamp_ntz) as ts", "exit_code", "seconds")


@pytest.mark.parametrize("lanes", [1, 5])
def test_step_stream_equals_batch(spark, lanes):
    """Each batch is a run of the query of its own, so it starts from the checkpoint."""
    rows = [(i % 7, i, i * 1001, int(i % 23 == 5), float(i) if i % 5 else None) for i in range(200)]
    # one run holds most rows; a run fails at a time of several steps; late steps; nulls
    rows += [(100, i, 10**6 + i, int(i == 150), 1.0) for i in range(300)]
    rows += [(101, i, 5, int(i in (3, 4)), 1.0) for i in range(8)] + [(102, 1, 50, None, None), (102, 2, 60, 1, 0.5), (102, 3, 70, 0, 0.5)]
    arrivals, root, progress = (fresh_path(spark, n) for n in ("steps", "replay", "progress"))
    log = run_log(spark, rows)
    order = sorted(range(len(rows)), key=lambda i: i * 7919 % 13)
    for part in (order[:200], order[200:350], order[350:]):
        run_log(spark, [rows[i] for i in part]).write.mode("append").parquet(arrivals)
        Z.run_log_stream(spark.readStream.schema(log.schema).parquet(arrivals), root, progress, lanes).awaitTermination()
    assert sorted(map(str, Z.recorded_steps(spark, root).collect())) == sorted(map(str, O.run_until_failure(log).collect()))
    # a second run without new files changes nothing
    Z.run_log_stream(spark.readStream.schema(log.schema).parquet(arrivals), root, progress, lanes).awaitTermination()
    assert Z.recorded_steps(spark, root).count() == O.run_until_failure(log).count()


def test_steps_after_a_failure_of_an_earlier_batch_are_not_written(spark):
    arrivals, root, progress = (fresh_path(spark, n) for n in ("steps", "replay", "progress"))
    written = []
    for start in (0, 100, 200):
        log = run_log(spark, [(1, i, i, int(i % 50 == 49), 1.0) for i in range(start, start + 100)])
        log.write.mode("append").parquet(arrivals)
        Z.run_log_stream(spark.readStream.schema(log.schema).parquet(arrivals), root, progress, 1).awaitTermination()
        written.append(spark.read.parquet(f"{root}/recorded").count())
    # the one lane saw the failure in the first batch, and the state knows it in all later runs
    assert written == [50, 50, 50]
    assert Z.recorded_steps(spark, root).count() == 50


def test_the_state_of_many_runs_is_asked_for_by_group(spark):
    """2,000 failed runs in lanes: the state has a value per group, not per run and lane."""
    arrivals, root, progress = (fresh_path(spark, n) for n in ("steps", "replay", "progress"))
    rows = [(run, step, step, int(step % 4 == 2), 1.0) for run in range(2000) for step in range(8)] + [(None, 1, 1, 1, 1.0)]
    log = run_log(spark, rows)
    for half in ("step_id < 5", "step_id >= 5"):
        log.where(half).write.mode("append").parquet(arrivals)
        stream = Z.run_log_stream(spark.readStream.schema(log.schema).parquet(arrivals), root, progress)
        stream.awaitTermination()
        assert 0 < stream.lastProgress.stateOperators[0].numRowsTotal <= GROUPS
    assert sorted(map(str, Z.recorded_steps(spark, root).collect())) == sorted(map(str, O.run_until_failure(log).collect()))


def test_registry_log_reads_and_keeps_few_runs(spark, registry):
    """50 batches of one name each: lookups stay flat, and the result is that of one batch operator."""
    root = fresh_path(spark, "registry")
    L.seed_registry(registry({f"{i}_s.sql": "seed" for i in range(1, 40)}), root, buckets=4)
    read, want = [], {f"{i}_s.sql": "seed" for i in range(1, 40)}
    for n in range(50):
        name, text = f"{n * 7 % 45 + 1}_s.sql", f"text {n}"
        want[name] = text
        batch = spark.createDataFrame([(name, text)], "name string, text string")
        L.drop_merged(spark, root, n)
        known = L.looked_up(batch, root, n)
        read.append(len(known.inputFiles()))
        L.write_version(L.absorb_scripts(batch, known), root, n + 1, 4)
        L.merge_runs(spark, root, n + 1, fanout=3)
    # one bucket of: the seed, and two runs of each of four levels at most
    assert max(read) <= 1 + 2 * 4 and max(read[40:]) <= max(read[:30]) + 2
    assert len(L.stored_runs(spark, root)) <= 2 + 3 * 4
    assert {r.name: r.text for r in L.latest(L.registry_versions(spark, root)).collect()} == want


def test_a_lookup_lists_the_buckets_of_its_names_alone(spark, registry, scripts):
    root = fresh_path(spark, "registry")
    L.seed_registry(registry({f"{i}_s.sql": "seed" for i in range(200)}), root, buckets=16)
    L.write_version(L.absorb_scripts(scripts({"3_s.sql": "new"}), L.looked_up(scripts({"3_s.sql": "new"}), root, 0)), root, 1, 16)
    known = L.looked_up(scripts({"3_s.sql": "x"}), root, 1)
    assert len(known.inputFiles()) == 2 and len({f.split("bucket=")[1].split("/")[0] for f in known.inputFiles()}) == 1
    assert {(r.name, r.version) for r in known.where("name = '3_s.sql'").collect()} == {("3_s.sql", 0), ("3_s.sql", 1)}
    assert L.looked_up(scripts({"none_s.sql": "x"}).where("false"), root, 1).collect() == []


def test_registry_log_survives_a_repeated_batch_that_merged(spark, registry, scripts):
    root = fresh_path(spark, "registry")
    L.seed_registry(registry({"1_a.sql": "old"}), root, buckets=2)
    for n, again in ((0, 1), (1, 2), (2, 1), (3, 2)):
        for _ in range(again):
            batch = scripts({"1_a.sql": f"a{n}", f"{n + 2}_b.sql": "b"})
            L.drop_merged(spark, root, n)
            L.write_version(L.absorb_scripts(batch, L.looked_up(batch, root, n)), root, n + 1, 2)
            L.merge_runs(spark, root, n + 1, fanout=2)
    got = {r.name: r.text for r in L.latest(L.registry_versions(spark, root)).collect()}
    assert got == {"1_a.sql": "a3", **{f"{n}_b.sql": "b" for n in range(2, 6)}}
    assert L.cover(L.stored_runs(spark, root)) == [(1, 4), (0, 0)]
    assert [L.merge_span(v, 2) for v in range(1, 9)] == [1, 2, 1, 4, 1, 2, 1, 8]


def test_parts_are_appended_in_order(spark, tmp_path):
    rows = [("d/a.sql", p, f"<{p}>") for p in range(50)] + [("d/b.sql", 0, "whole"), ("c.sql", 0, None)]
    frame = spark.createDataFrame(rows, "path string, part bigint, text string").repartition(7)
    sizes = {r.path: r.bytes for r in W.write_files(frame, str(tmp_path / "out")).collect()}
    whole = "".join(f"<{p}>" for p in range(50))
    assert sizes == {"d/a.sql": len(whole), "d/b.sql": 5, "c.sql": 0}
    assert (tmp_path / "out" / "d" / "a.sql").read_text() == whole
    W.write_corpus(frame, str(tmp_path / "corpus"))
    back = W.read_corpus(spark, str(tmp_path / "corpus")).collect()
    assert sorted((r.path, r.part, r.text or "") for r in back) == sorted((a, b, c or "") for a, b, c in rows)


def test_empty_files_and_bad_bytes_are_read(spark, tmp_path):
    (tmp_path / "1_a.sql").write_bytes(b"")
    (tmp_path / "2_b.sql").write_bytes(b"x\xffy")
    got = {r.name: r.text for r in W.read_scripts(spark, str(tmp_path)).collect()}
    assert got == {"1_a.sql": "", "2_b.sql": "x�y"}


def test_finding_empty_files_does_not_pass_the_folder_to_python(spark, tmp_path, monkeypatch):
    for i in range(400):
        (tmp_path / f"{i}_a.sql").write_text("" if i == 7 else "x")
    (tmp_path / "0.txt").write_text("")
    (tmp_path / "deep.sql").mkdir()
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: (calls.append(a), send(*a, **k))[1])
    found = W.empty_scripts(spark, str(tmp_path))
    monkeypatch.undo()
    assert len(calls) < 300
    assert [r.name for r in found.collect()] == ["7_a.sql"]


def test_the_files_of_a_folder_stay_off_the_driver(spark, tmp_path):
    for i in range(1500):
        (tmp_path / f"{i}_a.sql").write_text("" if i == 7 else f"text {i}")
    read = W.read_scripts(spark, str(tmp_path))
    # the plan knows the listing alone, and tasks take many files each
    assert len(read.inputFiles()) <= 4 and read.rdd.getNumPartitions() <= 4
    assert {r.name: r.text for r in read.collect()} == {f"{i}_a.sql": "" if i == 7 else f"text {i}" for i in range(1500)}


def test_tasks_and_batches_are_dealt_by_files_and_bytes(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i}_a.sql").write_text(f"<{i}>" * (i % 3))
    monkeypatch.setattr(W, "TASK_FILES", 6)
    monkeypatch.setattr(W, "BATCH_BYTES", 5)
    read = W.read_scripts(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 7
    assert {r.name: r.text for r in read.collect()} == {f"{i}_a.sql": f"<{i}>" * (i % 3) for i in range(40)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    try:
        assert W.read_scripts(spark, str(tmp_path)).rdd.getNumPartitions() == -(-sum(len(f"<{i}>") * (i % 3) for i in range(40)) // 9)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_listed_and_scanned_folders_have_the_same_scripts(spark, tmp_path):
    home = tmp_path / "a b%20c"
    for name in ("1_a.sql", "2 b%20+é.sql", "_x.sql", ".y.sql", "_a=1.sql", "_metadata.sql", "z.SQL", "n.txt", "sub.sql/3_c.sql", "sub.sql/4_d.txt"):
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_bytes(b"\xff\xe2\x82 " + name.encode())
    for name in ("5_e.sql", "_e.sql", ".e.sql"):
        (home / name).touch()
    (home / "link.sql").symlink_to(home / "n.txt")
    (home / "gone.sql").symlink_to(home / "none")
    os.utime(home / "1_a.sql", ns=(1, 1_600_000_000_123_999_999))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "1_a.sql").write_text("again")
    (tmp_path / "empty").mkdir()
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    for path in ("a b%20c", "[ao]*", "other", "other/1_a.sql", "a*/5_e.sql", "a*/*", "empty"):
        want = rows(W.scanned_scripts(spark, f"{tmp_path}/{path}"))
        assert rows(W.read_scripts(spark, f"{tmp_path}/{path}")) == want
        assert rows(W.read_scripts(spark, f"file://{tmp_path}/{path}")) == want
        assert bool(want) == (path != "empty")


def test_other_file_systems_and_missing_folders(spark, tmp_path):
    (tmp_path / "1_a.sql").write_text("x")
    (tmp_path / "2_b.sql").touch()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.scripts.link./in", f"file://{tmp_path}")
    assert {(r.name, r.text) for r in W.read_scripts(spark, "viewfs://scripts/in").collect()} == {("1_a.sql", "x"), ("2_b.sql", "")}
    for path in (f"{tmp_path}/none", f"{tmp_path}/none*"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            W.read_scripts(spark, path)


def test_malformed_documents_are_reported(spark):
    frame = spark.createDataFrame([(1, '{"go": true, "scripts_written": 2}'), (2, "{oops"), (3, None)], "change_id int, json string")
    told = {r.change_id: (r.should_run, r.error) for r in J.read_change_set_result(frame, keep=("change_id",), run_flag="go").collect()}
    assert told == {1: (True, None), 2: (False, J.MALFORMED), 3: (False, J.MALFORMED)}
    assert {r.change_id for r in J.rejected_documents(frame).collect()} == {2, 3}


def test_mistyped_fields(spark):
    documents = [
        '{"files": [{"filename": "a"}, {"filename": 5}, "x", null, {}], "head": {"ref": null}}',
        '{"files": "q", "head": [1], "commits": [{"sha": true, "commit": {"message": {}}}, {"commit": 1.5}]}',
        "{}",
        "[1]",
        "not json",
        None,
        "",
    ]
    frame = spark.createDataFrame(list(enumerate(documents)), "change_id long, json string")
    assert {tuple(r) for r in J.mistyped_fields(frame.withColumn("path", F.lit("clash"))).collect()} == {
        (0, "$.files[1].filename", "STRING", "BIGINT"),
        (0, "$.files[2]", "OBJECT", "STRING"),
        (1, "$.files", "ARRAY", "STRING"),
        (1, "$.head", "OBJECT", "ARRAY"),
        (1, "$.commits[0].sha", "STRING", "BOOLEAN"),
        (1, "$.commits[0].commit.message", "STRING", "OBJECT"),
        (1, "$.commits[1].commit", "OBJECT", "DECIMAL"),
    }
    assert {r.change_id for r in J.rejected_documents(frame).collect()} == {3, 4, 5, 6}
    assert J.mistyped_fields(frame.limit(0)).count() == 0


def test_readers_keep_what_is_not_mistyped(spark):
    documents = [
        (1, '{"files": [{"filename": "a"}, 7], "head": {"ref": "main"}, "commits": {"all": []}}'),
        (2, '{"files": [{"filename": "b"}], "head": {"ref": [1]}, "commits": [{"sha": "c"}]}'),
    ]
    frame = spark.createDataFrame(documents, "change_id long, json string")
    assert [tuple(r) for r in J.read_change_files(frame).collect()] == [(2, 0, "b")]
    assert sorted((r.change_id, r.head_branch) for r in J.read_change_heads(frame).collect()) == [(1, "main"), (2, "[1]")]
    assert [tuple(r) for r in J.read_change_commits(frame).collect()] == [(2, "c", 0, "")]
