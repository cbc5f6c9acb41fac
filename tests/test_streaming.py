import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.memory import interests as batch_interests
from quillgraph.plans import stream_queries
from quillgraph.streaming import ingest, jobs
from quillgraph.streaming import memories as memory_jobs

ROWS = [(u, c, dt.datetime(2024, 1, d, h)) for u, c, d, h in [(1, "a", 1, 0), (1, "a", 3, 5), (1, "a", 2, 0), (1, "b", 1, 1), (2, "a", 1, 2), (None, "a", 1, 0)]]


@pytest.fixture
def touches(spark, tmp_path):
    spark.conf.set(*jobs.STATE_STORE)
    for i in range(0, len(ROWS), 2):
        spark.createDataFrame(ROWS[i : i + 2], "user_id long, cui string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    yield spark.readStream.schema("user_id long, cui string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.unset(jobs.STATE_STORE[0])


def run(df, spark, tmp_path, mode):
    df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table("out")


def test_interests_equal_the_closed_form(spark, touches, tmp_path):
    out = run(jobs.interests(touches), spark, tmp_path, "update").groupBy("user_id", "cui").agg(F.max("weight").alias("w"), F.max("last_accessed").alias("l"))
    want = batch_interests(spark.createDataFrame(ROWS, "user_id long, cui string, ts timestamp"))
    assert {(r.user_id, r.cui): (round(r.w, 9), r.l) for r in out.collect()} == {(r.user_id, r.cui): (round(r.weight, 9), r.last_accessed) for r in want.collect()}


def test_quotas_and_reuse(spark, touches, tmp_path):
    out = run(jobs.quota_windows(touches.withColumn("client", F.col("user_id")), "100 days"), spark, tmp_path, "update")
    best = out.groupBy("day", "client").agg(F.max("n").alias("n"))
    assert sum(r.n for r in best.collect()) == len(ROWS)
    got = run(jobs.fresh_queries(touches, "cui", "30 days"), spark, tmp_path / "x", "append")
    assert sorted(r.cui for r in got.collect()) == ["a", "b"]


def test_intake_upserts(spark, tmp_path):
    for name in ("old", "new"):
        spark.createDataFrame([("d1", name), (f"d_{name}", name)], "doc_id string, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    jobs.intake(docs, lambda b: b.withColumn("n", F.length("text")), "doc_id", str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.doc_id: r.text for r in jobs.intake_table(spark, str(tmp_path / "t"), "doc_id").collect()}
    assert got.keys() == {"d1", "d_old", "d_new"}
    jobs.compact(spark, str(tmp_path / "t"), "doc_id", str(tmp_path / "u"))
    assert {r.doc_id: r.text for r in jobs.intake_table(spark, str(tmp_path / "u"), "doc_id").collect()} == got


DOCS = [("d1", "Acute renal failure after aspirin. Low dose aspirin."), ("d2", "Warfarin and aspirine together.\n\nRenal failure again"), ("d3", ""), ("d4", "nothing known here"), (None, "aspirin"), ("d5", None)]
DICTIONARY = [("renal failure", "Disease", 0.9), ("aspirin", "Drug", 0.9), ("warfarin", "Drug", 0.8), ("aspirine", "Drug", 0.8)]
CONCEPTS = [("D1", "Aspirin", "Drug", ["ASA"], None), ("D2", "Renal Failure", "Disease", [], None)]


def _build(spark):
    concepts = spark.createDataFrame(CONCEPTS, "cui string, label string, entity_type string, synonyms array<string>, lang_labels map<string,string>")
    return ingest.Build(spark.createDataFrame(DICTIONARY, "term string, entity_type string, confidence double"), concepts, most_tokens=12, overlap=4)


def _held(tables):
    return {name: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str) for name, df in tables.items()}


def test_ingest_equals_a_build_at_once_and_may_run_again(spark, tmp_path):
    kind = "doc_id string, text string, language string"
    build = _build(spark)
    for i, part in enumerate((DOCS[:2], DOCS[2:], [("d1", "Now warfarin only.")])):
        spark.createDataFrame([(d, x, "en") for d, x in part], kind).coalesce(1).write.mode("append").json(str(tmp_path / f"in{i}"))
    source = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in[012]"))
    ingest.ingest(source(), build, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination(300)
    got = ingest.graph(spark, str(tmp_path / "s"))
    newest = {d: x for d, x in DOCS} | {"d1": "Now warfarin only."}
    build.write(spark.createDataFrame([(d, x, "en") for d, x in newest.items()], kind), str(tmp_path / "b"), 0)
    want = _held(ingest.graph(spark, str(tmp_path / "b")))
    first = _held(got)
    assert first == want and len(first["documents"]) == 5
    edges = {(r.doc_id, r.cui) for r in got["mentions"].collect()}
    assert edges == {("d1", "MENTION:Drug:warfarin"), ("d2", "MENTION:Drug:warfarin"), ("d2", "D1"), ("d2", "D2")}
    # the last batch is run again, as after a failure before its commit
    for name in ("2", ".2.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    ingest.ingest(source(), build, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination(300)
    assert _held(ingest.graph(spark, str(tmp_path / "s"))) == want


NOW = dt.datetime(2024, 3, 1)
MEMORIES = [(u, str(q), ["a", "b"] if q % 3 else ["a", "a", None], dt.datetime(2024, 1, 1 + q % 9, q % 24)) for u in (1, 2) for q in range(12)] + [(None, "1", ["a"], NOW), (1, None, ["a"], NOW), (1, "99", None, NOW)]


@pytest.mark.parametrize("order", [1, -1])
def test_written_memories_equal_the_batch_form_in_any_order(spark, tmp_path, order):
    from quillgraph.operators import memory as m

    kind = "user_id long, qa_id string, cuis array<string>, ts timestamp"
    rows = MEMORIES[::order]
    spark.conf.set(*jobs.STATE_STORE)
    for i in range(0, len(rows), 9):
        spark.createDataFrame(rows[i : i + 9], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(memory_jobs.memory_write(stream, NOW, cap=4), spark, tmp_path, "update")
    got = {(r.user_id, r.cui, r.qa_id) for r in memory_jobs.memories(out).collect()}
    spark.conf.unset(jobs.STATE_STORE[0])
    new = spark.createDataFrame(rows, kind).where("user_id is not null and qa_id is not null").withColumn("cuis", F.array_distinct("cuis"))
    none = spark.createDataFrame([], "user_id long, qa_id string, cui string, weight double, last_accessed timestamp")
    kept, _ = m.memory_write(none, new.select("user_id", "qa_id").limit(0), new, F.lit(NOW), cap=4)
    assert got == {(r.user_id, r.cui, r.qa_id) for r in kept.where("cui is not null").collect()} and len(got) == 16


def test_reinforced_memories_equal_the_batch_form_and_late_uses_go(spark, tmp_path):
    from quillgraph.operators import memory as m

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    stored = spark.createDataFrame([(1, "q1", "a", 1.0, day(1)), (1, "q2", "a", 2.5, day(2)), (2, "q1", "b", 1.0, day(3))], "user_id long, qa_id string, cui string, weight double, last_accessed timestamp")
    kind = "user_id long, qa_id string, cui string, ts timestamp"
    uses = [[(1, "q1", "a", day(10)), (1, "q1", "a", day(9)), (2, "nobody", "b", day(10))], [(1, "q1", "a", day(9, 12)), (1, "q2", "a", day(12)), (None, "q1", "a", day(12))], [(2, "q1", "b", day(20))], [(1, "q2", "a", day(3))]]
    spark.conf.set(*jobs.STATE_STORE)
    for i, part in enumerate(uses):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(memory_jobs.memory_reinforce(stream, stored, "2 days"), spark, tmp_path, "update")
    got = {(r.user_id, r.qa_id): (round(r.weight, 9), r.last_accessed) for r in memory_jobs.reinforced(stored, out).collect()}
    spark.conf.unset(jobs.STATE_STORE[0])
    in_time = [r for part in uses[:3] for r in part]  # the last one is 17 days behind
    want = m.memory_reinforce(stored, spark.createDataFrame(in_time, kind))
    assert got == {(r.user_id, r.qa_id): (round(r.weight, 9), r.last_accessed) for r in want.collect()}


def test_progress_is_written_by_the_listener_and_outlives_a_restart(spark, tmp_path):
    listener = jobs.Progress(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        for part in (range(5), range(5, 7)):
            spark.createDataFrame([(i,) for i in part], "n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
            jobs.intake(stream, lambda b: b, "n", str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    rows = jobs.progress_table(spark, str(tmp_path / "progress")).collect()
    assert sorted((r.batch, r.rows) for r in rows if r.stage == "batch" and r.rows) == [(0, 5), (1, 2)]
    assert len({r.run for r in rows}) == 2 and sorted(r.stage for r in rows if r.stage != "batch") == ["ended", "ended", "started", "started"]


def test_interests_are_counted_before_the_shuffle(spark, tmp_path):
    """No state store of Python processors is set: the state is Spark's own, of counts and times."""
    spark.createDataFrame(ROWS, "user_id long, cui string, ts timestamp").write.parquet(str(tmp_path / "in"))
    updates = jobs.interests(spark.readStream.schema("user_id long, cui string, ts timestamp").parquet(str(tmp_path / "in")))
    got = {(r.user_id, r.cui): (round(r.weight, 9), r.last_accessed) for r in run(updates, spark, tmp_path, "update").collect()}
    assert got == {(1, "a"): (2.71, dt.datetime(2024, 1, 3, 5)), (1, "b"): (1.0, dt.datetime(2024, 1, 1, 1)), (2, "a"): (1.0, dt.datetime(2024, 1, 1, 2))}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_a_file_or_a_folder(spark, tmp_path, files):
    rows = spark.range(9).select(F.col("id").alias("event_id"))
    rows.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    if files == 1:
        (one,) = (tmp_path / "events.parquet").glob("*.parquet")
        one.rename(tmp_path / "one")
        (tmp_path / "events.parquet").rename(tmp_path / "gone")
        (tmp_path / "one").rename(tmp_path / "events.parquet")
    got = stream_queries._finished(stream_queries._stream(spark, str(tmp_path), "events"), "files")
    assert sorted(r.event_id for r in got.collect()) == list(range(9))


def test_a_key_costs_one_read_and_one_write_of_its_state():
    """Rows instead of a frame for each key, and the watermark once for a batch."""
    from pyspark.sql import Row

    asked = []

    class State:
        held = {}

        def get(self):
            asked.append("get")
            return self.held.get(self.key)

        def update(self, value):
            asked.append("update")
            self.held[self.key] = value

    class Handle:
        def getValueState(self, *_):
            return State()

    class Timers:
        def getCurrentWatermarkInMs(self):
            asked.append("late")
            return 2

    of = memory_jobs.Reinforced()
    of.init(Handle())
    got = []
    for i in range(3):
        of.state.key = (1, f"q{i}", "a")
        if i < 2:
            of.handleInitialState(of.state.key, Row(weight=1, last_accessed=1000 * i), Timers())
        got += [tuple(r) for r in of.handleInputRows(of.state.key, iter([Row(us=2000), Row(us=1999), Row(us=5000)]), Timers())]
    assert got == [(1, f"q{i}", "a", pytest.approx(2.71), 5000, 2) for i in range(2)]
    assert asked.count("get") == 3 and asked.count("update") == 4 and asked.count("late") == 1
