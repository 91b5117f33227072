"""Streaming ingestion of messages: audit log, idempotence, dialog state and numbering per tenant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kgspark import schema
from kgspark.plans.linking import next_id

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages from a folder that new parquet files keep arriving in."""
    return spark.readStream.schema(schema.MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_log(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only audit log; the checkpoint makes each logged row land exactly once, however late its date is.

    A message that was logged again is a row of its own; ``logged_once`` reads each message once.
    """
    return messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged_once(log: DataFrame) -> DataFrame:
    """Each message of the log once, by its first row; the ids' aggregate is combined before the shuffle."""
    first = log.groupBy("user_id", "message_id").agg(F.min("id").alias("id"))
    return log.join(first, ["user_id", "message_id", "id"], "left_semi")


#: Dialog states.
STATES = ("idle", "waiting_for_artifact", "waiting_for_search", "clarifying_text", "waiting_for_delete_query")
STATE_SCHEMA = "user_id bigint, id bigint, state string, n_seen bigint"
#: The state in which each logged kind of message is taken, and the state each button leads to; other buttons end the dialog.
TAKEN_IN = {"text_artifact": "waiting_for_artifact", "search_query": "waiting_for_search", "delete_query": "waiting_for_delete_query"}
BUTTONS = (("добав", "waiting_for_artifact"), ("поиск", "waiting_for_search"), ("удал", "waiting_for_delete_query"))


def next_state(state: str, kind: str, text: str | None) -> str:
    """The dialog state after a message.

    A free text outside any mode asks back what to do with it; speech and files are taken in any mode and leave it as it is.
    """
    if kind == "action":
        return next((to for word, to in BUTTONS if word in (text or "").lower()), "idle")
    if kind == "text" and state == "idle":
        return "clarifying_text"
    return TAKEN_IN.get(kind, state)


class Dialog(StatefulProcessor):
    """Per user: the dialog state and how many messages were seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("dialog", "state string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now, n = self.state.get() if self.state.exists() else ("idle", 0)
        out = []
        for pdf in rows:
            for r in pdf.sort_values(["message_date", "id"]).itertuples(index=False):
                now, n = next_state(now, r.message_type, r.message_text), n + 1
                out.append((key[0], r.id, now, n))
        self.state.update((now, n))
        yield pd.DataFrame(out, columns=["user_id", "id", "state", "n_seen"])

    def close(self) -> None:
        pass


def dialog_states(messages: DataFrame) -> DataFrame:
    """State after every message; needs the RocksDB state store on a stream."""
    return messages.groupBy("user_id").transformWithStateInPandas(Dialog(), STATE_SCHEMA, "Append", "None")


def dialog_states_batch(messages: DataFrame) -> DataFrame:
    """The same over a log, for backfills: the last message that decides a state, by window.

    A log holds no unanswered free text, so each row's state follows from the last button or taken message.
    """
    text = F.lower(F.coalesce("message_text", F.lit("")))
    pressed = F.lit("idle")
    for word, to in reversed(BUTTONS):
        pressed = F.when(text.contains(word), to).otherwise(pressed)
    decides = F.when(F.col("message_type") == "action", pressed)
    for kind, to in TAKEN_IN.items():
        decides = F.when(F.col("message_type") == kind, to).otherwise(decides)
    order = Window.partitionBy("user_id").orderBy("message_date", "id")
    now = F.coalesce(F.last(decides, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("idle"))
    return messages.select("user_id", "id", now.alias("state"), F.row_number().over(order).cast("bigint").alias("n_seen"))


class Numbering(StatefulProcessor):
    """Per tenant: the last root number, each card's id and the last number of a child below each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.roots = handle.getValueState("roots", "n bigint")
        self.ids = handle.getMapState("ids", "zettel_id string", "luhmann_id string, kids bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last = self.roots.get()[0] if self.roots.exists() else 0
        out = []
        for pdf in rows:
            for r in pdf.sort_values(["seq", "zettel_id"]).itertuples(index=False):
                if self.ids.containsKey((r.zettel_id,)):
                    continue  # delivered before
                up = None
                if r.parent_id is not None and self.ids.containsKey((r.parent_id,)):
                    up, kids = self.ids.getValue((r.parent_id,))
                    kids += 1
                    self.ids.updateValue((r.parent_id,), (up, kids))
                else:
                    last += 1
                    kids = last
                lid = next_id(up, kids)
                self.ids.updateValue((r.zettel_id,), (lid, 0))
                out.append((key[0], r.zettel_id, lid))
        self.roots.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "zettel_id", "luhmann_id"])

    def close(self) -> None:
        pass


NUMBERED = "user_id string, zettel_id string, luhmann_id string"


def numbered(cards: DataFrame) -> DataFrame:
    """(user_id, zettel_id, luhmann_id) of arriving cards (user_id, seq, zettel_id, parent_id), in order of arrival.

    A card whose parent has not arrived becomes a root; a card that arrives again gets no second id. Needs the
    RocksDB state store on a stream.
    """
    return cards.groupBy("user_id").transformWithStateInPandas(Numbering(), NUMBERED, "Append", "None")
