import pytest

from kgspark.streaming import ingest, windows
from kgspark.tables import table


def test_stream_windows_equal_batch(spark, data, tmp_path):
    ev = table(spark, data, "events", "event_id", "ts", "user_id", "event_type", "value")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = windows.tumbling(windows.timed(ev))
    live = windows.tumbling(windows.timed(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), late="400 days"))
    q = live.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("win").collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_log_keeps_every_row_once(spark, data, tmp_path):
    m = table(spark, data, "history_messages").select("id", "user_id", "message_id", "message_text", "message_date", "message_type", "bot_answer")
    late = m.limit(1).selectExpr("id - 1000000 AS id", "user_id", "message_id + 1000000 AS message_id", "message_text", "message_date - INTERVAL 40 DAY AS message_date", "message_type", "bot_answer")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run over the same folder finds nothing new
        ingest.append_log(ingest.message_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # more than a month late
    ingest.append_log(ingest.message_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == m.count() + 1
    assert ingest.logged_once(got).count() == m.select("user_id", "message_id").distinct().count() + 1


def test_states():
    now = "idle"
    for kind, text, want in (
        ("text", "привет", "clarifying_text"), ("text_artifact", "заметка", "waiting_for_artifact"), ("voice", "x", "waiting_for_artifact"), (".pdf", None, "waiting_for_artifact"),
        ("action", "Кнопка: удалить", "waiting_for_delete_query"), ("delete_query", "x", "waiting_for_delete_query"), ("search_query", "x", "waiting_for_search"), ("action", "Кнопка: база", "idle"), ("voice", "x", "idle"),
    ):
        now = ingest.next_state(now, kind, text)
        assert now == want


def test_numbers_of_a_stream(spark, tmp_path):
    first = [("u", 1, "a", None), ("u", 2, "b", "a"), ("u", 3, "c", "b"), ("v", 1, "d", None), ("u", 4, "e", "zz")]
    then = [("u", 5, "f", "a"), ("u", 5, "a", None), ("u", 6, "g", "b"), ("v", 2, "h", None)]
    kind = "user_id string, seq bigint, zettel_id string, parent_id string"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKSDB)
    try:
        for k, rows in enumerate((first, then)):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            try:
                live = ingest.numbered(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
                q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            except ImportError as e:
                pytest.skip(f"stateful Python processing is not available here: {e}")
            q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {(r.user_id, r.zettel_id): r.luhmann_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("u", "a"): "1", ("u", "b"): "1.1", ("u", "c"): "1.1a", ("v", "d"): "1", ("u", "e"): "2", ("u", "f"): "1.2", ("u", "g"): "1.1b", ("v", "h"): "2"}


def test_dialog_stream_equals_batch(spark, data, tmp_path):
    m = table(spark, data, "history_messages").select("id", "user_id", "message_id", "message_text", "message_date", "message_type", "bot_answer")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKSDB)
    try:
        try:
            live = ingest.dialog_states(ingest.message_stream(spark, str(tmp_path / "in")))
            q = live.writeStream.format("memory").queryName("dlg").outputMode("append").trigger(availableNow=True).start()
        except ImportError as e:
            pytest.skip(f"stateful Python processing is not available here: {e}")
        q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted(map(tuple, spark.table("dlg").collect())) == sorted(map(tuple, ingest.dialog_states_batch(m).collect()))
