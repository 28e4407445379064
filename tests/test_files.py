"""Files in, streams and stores."""

import time

import pytest
from pyspark.sql import Row

from probanda import streaming as ST
from probanda.operators import ingest
from probanda.plans import ingest as plan
from probanda.plans.ingest import store_uploads
from probanda.schemas import TRACE_EVENTS
from probanda.sources import files
from probanda.streaming.events import StageFlags
from probanda.streaming.tokens import TokenAssembler


def test_uploads_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.TXT": b"hello \r\n world", "b.md": b"  ", "c.pdf": b"x", "d.txt": b"", "e.md": b"\xff ok"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    path = f"file://{tmp_path}/in"
    done = ingest.ingest(files.read_uploads(spark, path))
    assert {r["filename"]: r["reject_reason"] for r in done.rejected.collect()} == {
        "b.md": "no_text", "c.pdf": "unsupported_type"}  # file sources pass over d.txt
    assert {r["chunk_text"] for r in done.chunks.collect()} == {"hello \n world", "� ok"}
    assert {r["name"] for r in done.concepts.collect()} == {"a.TXT", "e.md"}
    assert {r["filename"] for r in files.read_text_uploads(spark, path).collect()} == {"a.TXT", "b.md", "e.md"}


def test_streamed_files_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"first " * 400)
    path, out = f"file://{tmp_path}/in", str(tmp_path / "out")

    def run():
        uploads = ST.stream_uploads(spark, path, files_per_batch=1)
        ST.ingest_stream(uploads, out, str(tmp_path / "cp")).awaitTermination()

    run()
    (tmp_path / "in" / "b.md").write_bytes(b"second")
    run()
    run()  # nothing new: nothing changes
    columns = ["chunk_id", "chunk_index", "chunk_text", "concept_id"]
    got = ST.read_committed(spark, out, "chunks").select(*columns).collect()
    wanted = ingest.ingest(files.read_uploads(spark, path)).chunks.select(*columns).collect()
    assert sorted(got) == sorted(wanted) and len(got) == 4
    names = [r["name"] for r in ST.read_batches(spark, f"{out}/bus_events").collect()]
    assert names.count("DocumentImported") == 2 and names.count("EmbeddingCreated") == 4


def test_stored_tables(spark, tmp_path):
    rows = [(f"p/{i}.txt", f"{i}.txt", bytearray(b"word " * 300 * (i % 3)), i) for i in range(9)]
    uploads = spark.createDataFrame(rows, "path string, filename string, content binary, ingest_order long").selectExpr(
        "*", "timestamp_seconds(ingest_order) as created_at")
    out = str(tmp_path / "store")
    for n in (0, 1, 1):  # a batch stored again replaces itself
        store_uploads(uploads.where(f"ingest_order % 2 = {n}"), out, n)
    counts = [ST.read_batches(spark, f"{out}/{t}").count() for t in ("documents", "rejected", "chunks", "bus_events")]
    assert counts == [6, 3, 3 * 2 + 3 * 4, 6 + 18]
    titles = {r["document_title"] for r in ST.read_batches(spark, f"{out}/chunks").collect()}
    assert titles == {f"{i}.txt" for i in range(9) if i % 3}


def test_a_large_file_is_refused_by_its_length(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in {"small.txt": 20, "edge.txt": 100, "large.txt": 101}.items():
        (tmp_path / "in" / name).write_bytes(b"x" * n)
    found = files.read_uploads(spark, f"file://{tmp_path}/in", max_bytes=100)
    setting = "spark.sql.sources.binaryFile.maxLength"  # the content of a longer file cannot be read
    spark.conf.set(setting, "100")
    try:
        assert {r["filename"]: (r["length"], r["content"] is None) for r in found.collect()} == {
            "small.txt": (20, False), "edge.txt": (100, False), "large.txt": (101, True)}
    finally:
        spark.conf.unset(setting)
    checked = ingest.validate_uploads(found, max_bytes=100)
    assert {r["filename"]: r["reject_reason"] for r in checked.collect()} == {"small.txt": None, "edge.txt": None, "large.txt": "too_large"}


def upload_rows(spark, names):
    rows = [(f"p/{n}", n, bytearray(f"text of {n}".encode()), i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "path string, filename string, content binary, ingest_order long").selectExpr(
        "*", "timestamp_seconds(ingest_order) as created_at")


def test_two_streams_share_a_store(spark, tmp_path):
    out = str(tmp_path / "out")
    for who in "ab":
        folder = str(tmp_path / who)
        rows = upload_rows(spark, [f"{who}{i}.txt" for i in range(3)])
        rows.write.parquet(folder)
        schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
        ST.ingest_stream(ST.stream_table(spark, folder, schema), out, str(tmp_path / f"cp-{who}")).awaitTermination()
    got = {r["document_title"] for r in ST.read_committed(spark, out, "chunks").collect()}
    assert got == {f"{who}{i}.txt" for who in "ab" for i in range(3)}


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """Writing ends between two tables, at first and when a batch is written again."""
    out = str(tmp_path / "store")
    store_uploads(upload_rows(spark, ["a.txt"]), out, "one")
    names = lambda: {r["document_title"] for r in ST.read_committed(spark, out, "chunks").collect()}
    counts = lambda: [ST.read_committed(spark, out, t).count() for t in ("documents", "chunks", "bus_events")]

    def dies(*args):
        raise RuntimeError("killed")

    for batch in ("two", "one"):
        with monkeypatch.context() as patch:
            patch.setattr(plan, "ingest_events", dies)
            with pytest.raises(RuntimeError):
                store_uploads(upload_rows(spark, ["b.txt"]), out, batch)
        assert names() == ({"a.txt"} if batch == "two" else set())
    store_uploads(upload_rows(spark, ["b.txt"]), out, "two")
    store_uploads(upload_rows(spark, ["a.txt"]), out, "one")
    assert names() == {"a.txt", "b.txt"} and counts() == [2, 2, 4]


def replay(spark, folder, rows, schema, start):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    query = start()
    query.awaitTermination()
    return query


def test_token_turns_end(spark, tmp_path):
    """Pieces out of order and twice, late ones for a finished turn, a turn that never ends."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "turn_id string, seq long, text string, is_last boolean"

    def start():
        whole = ST.assemble_tokens(ST.stream_table(spark, folder, schema), patience_seconds=20)
        return ST.batch_sink(whole, str(tmp_path / "cp"), lambda batch: {out: batch})

    replay(spark, folder, [("a", 1, "wo", False), ("a", 3, "!", True), ("b", 0, "never", False), ("b", 2, "gap", False), ("d", 0, "all", True)], schema, start)
    replay(spark, folder, [("a", 0, "hello ", False), ("a", 1, "XX", False), ("a", 2, "rld", False), ("d", 0, "late", True)], schema, start)
    time.sleep(21)
    replay(spark, folder, [("c", 0, "x", False)], schema, start)
    got = sorted(tuple(r) for r in ST.read_batches(spark, out).select("turn_id", "response_text", "finished").collect())
    assert got == [("a", "hello world!", True), ("b", "never", False), ("d", "all", True)]


def test_stage_state_ends(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    names = [c.strip().split(" ")[0] for c in TRACE_EVENTS.split(",")]

    def events(*rows):
        values = {"trace_id": None, "stage": "s", "event_type": None}
        return [tuple({**values, "trace_id": t, "event_type": e}.get(n) for n in names) for t, e in rows]

    def start():
        arriving = ST.stream_table(spark, folder, TRACE_EVENTS)
        return ST.live_stage_status(arriving, out, str(tmp_path / "cp"), keep_seconds=4)

    def kept(query):
        return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])

    first = replay(spark, folder, events(("t1", "stage_start"), ("t2", "failure")), TRACE_EVENTS, start)
    assert kept(first) >= 2
    time.sleep(5)
    last = replay(spark, folder, events(("t3", "stage_start"), ("t1", "stage_end")), TRACE_EVENTS, start)
    assert kept(last) <= kept(first)
    latest = {r["trace_id"]: r["status"] for r in ST.latest_status(ST.read_batches(spark, out, keep_batch=True)).collect()}
    assert latest == {"t1": "done", "t2": "failed", "t3": "active"}


class Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValueState(self, name, *_):
        return Held(self, name)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer


class Held:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def all(self):
        self.store.calls += 1
        return self.store.values.setdefault(self.name, {})

    def get(self):
        return self.all().get(())

    def exists(self):
        return () in self.all()

    def update(self, value):
        self.all()[()] = value

    def containsKey(self, key):
        return key in self.all()

    def getValue(self, key):
        return self.all()[key]

    def updateValue(self, key, value):
        self.all()[key] = value

    def iterator(self):
        return iter(list(self.all().items()))

    def clear(self):
        self.all().clear()


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_calls_to_the_store_do_not_grow_with_the_pieces():
    store, assembler = Store(), TokenAssembler(1000)
    assembler.init(store)
    pieces = [Row(seq=n, text=f"{n} ", is_last=n == 199) for n in range(200)]
    assert list(assembler.handleInputRows(("t",), iter(pieces[1::2]), Clock(5))) == []
    assert list(assembler.handleInputRows(("t",), iter(pieces[1:100:2]), Clock(900))) == []
    assert list(assembler.handleExpiredTimer(("t",), Clock(1005), None)) == []
    done = list(assembler.handleInputRows(("t",), iter(pieces[::2]), Clock(1100)))
    assert done == [Row(turn_id="t", response_text="".join(p.text for p in pieces), finished=True)]
    assert store.calls < 40


def test_a_trace_is_one_value():
    """Its stages are forgotten one by one."""
    store, flags = Store(), StageFlags(1000)
    flags.init(store)
    seen = lambda now, *rows: [tuple(r) for r in flags.handleInputRows(("t",), iter([Row(stage=s, flags=f) for s, f in rows]), Clock(now))]
    assert seen(0, ("a", 4), ("b", 4), ("a", 2), (None, 0)) == [("t", "a", 0, 1, 1), ("t", "b", 0, 0, 1), ("t", None, 0, 0, 0)]
    assert seen(900, ("a", 1)) == [("t", "a", 1, 1, 1)]
    assert seen(1500, ("a", 0), ("b", 1)) == [("t", "a", 1, 1, 1), ("t", "b", 1, 0, 0)]
    assert store.calls == 6
