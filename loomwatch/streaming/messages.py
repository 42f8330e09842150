"""Messages between stages: their shapes, redelivery of those that aren't acknowledged, and a sink that commits.

A message is (message_id, kind, value): a JSON text and an id that follows from it, by which a consumer that gets one twice
knows it. Mentions of an article, its resolved entities and stories (``story_state.cluster_messages``) each have a schema here,
by which ``polls.decoded`` reads them back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwatch.functions import text as tx
from loomwatch.settings import Settings
from loomwatch.streaming.polls import _rocks

MENTION = "struct<article_id: string, entity_type: string, surface_text: string, char_span: array<int>, extraction_confidence: double, context_snippet: string>"
ENTITY = "struct<canonical_node_key: string, entity_type: string, resolution_status: string, node_confidence: double>"
#: The schemas of messages by kind.
SHAPES = {
    "mentions": f"article_id string, title string, published_at string, mentions array<{MENTION}>",
    "resolved": f"article_id string, title string, published_at string, source_id string, resolved_entities array<{ENTITY}>",
    "story": f"story_cluster_id string, article_ids array<string>, union_resolved_entities array<{ENTITY}>",
}


def enveloped(values: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """(message_id, kind, value) of JSON texts."""
    return values.select(F.sha2(F.concat_ws("\n", F.lit(kind), F.col(value)), 256).alias("message_id"), F.lit(kind).alias("kind"), F.col(value).alias("value"))


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")


def mention_messages(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """A message for each article, also those without any mention. articles: (article_id, title, published_at string), one row each; mentions: columns of ``mentions.FIELDS``."""
    key = F.col("article_id").cast("string")
    one = F.struct(key.alias("article_id"), "entity_type", "surface_text", F.array("char_start", "char_end").alias("char_span"), "extraction_confidence", "context_snippet").alias("m")
    held = mentions.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("seq", one))).alias("ms"))
    none = F.array().cast(f"array<{MENTION}>")
    rows = articles.select("article_id", "title", "published_at").join(held, "article_id", "left")
    listed = F.coalesce(F.transform("ms", lambda x: x["m"]), none).cast(f"array<{MENTION}>")
    return enveloped(rows.select(_json(key.alias("article_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("published_at", F.lit("")).alias("published_at"), listed.alias("mentions"))), "mentions")


def resolved_messages(articles: DataFrame, resolved: DataFrame) -> DataFrame:
    """A message for each article with all its resolved, provisional and rejected entities. articles: as above, their ids keys of (source, guid); resolved: (article_id, entity_type, node_key, resolution_status, node_confidence)."""
    one = F.struct(F.col("node_key").alias("canonical_node_key"), "entity_type", "resolution_status", "node_confidence")
    held = resolved.groupBy("article_id").agg(F.array_sort(F.collect_list(one)).alias("es"))
    rows = articles.select("article_id", "title", "published_at").join(held, "article_id", "left")
    source, _ = tx.split_key(F.col("article_id").cast("string"))
    listed = F.coalesce("es", F.array().cast(f"array<{ENTITY}>"))
    fields = [F.col("article_id").cast("string").alias("article_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("published_at", F.lit("")).alias("published_at"), source.alias("source_id"), listed.alias("resolved_entities")]
    return enveloped(rows.select(_json(*fields)), "resolved")


def unwrapped(events: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, rest): the messages that queue events hold, a row (value) for each record, and what holds none, as it came, with ``reason``.

    An event is a JSON text {"Records": [...]}, whose records have the message as ``body`` (of a queue) or ``Sns.Message`` (of a topic). A
    record without either is among the rest with its event. Other columns go with each record."""
    shape = "Records array<struct<body: string, Sns: struct<Message: string>>>"
    parsed = events.withColumn("_r", F.from_json(value, shape)["Records"])
    bodies = F.transform("_r", lambda r: F.coalesce(r["body"], r["Sns"]["Message"]))
    parsed = parsed.withColumn("_b", bodies).drop("_r")
    reason = F.when(F.col("_b").isNull(), "no records").when(F.exists("_b", lambda b: b.isNull()), "a record without a message")
    others = [F.col(f"`{c}`") for c in events.columns if c != value]
    records = parsed.select(*others, F.explode(F.filter("_b", lambda b: b.isNotNull())).alias(value)).select(*[F.col(f"`{c}`") for c in events.columns])
    return records, parsed.withColumn("reason", reason).where("reason IS NOT NULL").drop("_b")


DELIVERED = "message_id string, value string, action string, receive_count int, at timestamp"


class Delivery(StatefulProcessor):
    """What a queue does with one message: it is delivered, and again whenever it wasn't acknowledged in time or failed, until it has been
    received ``most`` times; then it goes to the dead letters. A message that is through is remembered for ``kept`` milliseconds, so that
    sending it again in that time does nothing."""

    def __init__(self, visible: int, most: int, kept: int):
        self.visible, self.most, self.kept = visible, most, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "value string, receives int, until long")
        self.through = handle.getValueState("through", "until long")

    def _receive(self, key: tuple, value: str, receives: int, at: int) -> tuple:
        """The next delivery, or the end of it."""
        if receives > self.most:
            self._end(at)
            return (key[0], value, "dead_letter", self.most, at)
        self.open.update((value, receives, at + self.visible))
        self.handle.registerTimer(at + self.visible)
        return (key[0], value, "deliver", receives, at)

    def _end(self, at: int) -> None:
        self.open.clear()
        self.through.update((at + self.kept,))
        self.handle.registerTimer(at + self.kept)

    def _stop(self, until: int) -> None:
        self.handle.deleteTimer(until)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["message_id", "value", "action", "receive_count", "at"])
        return out.assign(at=pd.to_datetime(out["at"], unit="ms"), receive_count=out["receive_count"].astype("int32"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        events = pd.concat(list(rows))
        order = events["event"].map({"sent": 0, "failed": 1, "acked": 2})
        events = events.assign(_o=order, _at=events["at"].astype("datetime64[ms]").astype("int64")).sort_values(["_at", "_o"], kind="stable")
        out = []
        for r in events.itertuples(index=False):
            now, _, value = r[-1], r[-2], r.value
            if r.event == "sent":
                if not self.open.exists() and not self.through.exists():
                    out.append(self._receive(key, value, 1, now))
            elif self.open.exists():
                value, receives, until = self.open.get()
                self._stop(until)
                if r.event == "acked":
                    self._end(now)
                    out.append((key[0], value, "done", receives, now))
                else:
                    out.append(self._receive(key, value, receives + 1, now))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.open.exists():
            value, receives, until = self.open.get()
            if until <= now:
                yield self._frame([self._receive(key, value, receives + 1, now)])
        if self.through.exists() and self.through.get()[0] <= now:
            self.through.clear()

    def close(self) -> None: ...


def redelivery(events: DataFrame, visible_seconds: float = 60.0, max_receives: int = Settings.max_receives, kept_seconds: float = 86_400.0, delay: str = "0 seconds") -> DataFrame:
    """A stream of DELIVERED: action is 'deliver', 'done' or 'dead_letter'.

    events: a stream of (message_id, value, event, at timestamp), event being 'sent', 'acked' or 'failed'. Times are those of the events: a message
    is delivered again when the watermark, ``delay`` behind the latest event, has passed the end of its time. An event of an unknown kind does nothing."""
    _rocks(events.sparkSession)
    known = events.where(F.col("event").isin("sent", "acked", "failed") & F.col("message_id").isNotNull()).select("message_id", "value", "event", "at").withWatermark("at", delay)
    ms = [int(s * 1000) for s in (visible_seconds, kept_seconds)]
    return known.groupBy("message_id").transformWithStateInPandas(Delivery(ms[0], max_receives, ms[1]), DELIVERED, "append", "EventTime")


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task wrote."""

    name: str
    rows: int


class MessageWriter(DataSourceStreamWriter):
    """Tasks write files aside; the driver renames all of a batch's into place at once. One query writes to a folder at a time."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.run = path, names, uuid.uuid4().hex

    def _fs(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system, root.rstrip("/")

    def write(self, rows: Iterator) -> Staged:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, root = self._fs()
        folder = f"{root}/staging/{self.run}"
        system.create_dir(folder, recursive=True)
        name, n, held = f"{uuid.uuid4().hex}.parquet", 0, []
        schema = pa.schema([(c, pa.string()) for c in self.names])

        def table() -> pa.Table:
            return pa.table({c: pa.array([r[c] for r in held], pa.string()) for c in self.names}, schema=schema)

        with system.open_output_stream(f"{folder}/{name}") as out, pq.ParquetWriter(out, schema) as writer:
            for r in rows:
                held.append(r)
                n += 1
                if len(held) == 4096:
                    writer.write_table(table())
                    held = []
            writer.write_table(table())
        return Staged(f"{folder}/{name}", n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        """One rename shows the batch; a batch that is there already is left as it is."""
        system, root = self._fs()
        ready, place = f"{root}/staging/ready-{batchId}-{uuid.uuid4().hex}", f"{root}/messages/batch={batchId:012d}"
        if system.get_file_info(place).type.name == "NotFound":
            system.create_dir(ready, recursive=True)
            for m in messages:
                if m is not None and m.rows:
                    system.move(m.name, f"{ready}/{m.name.rsplit('/', 1)[1]}")
            system.create_dir(f"{root}/messages", recursive=True)
            system.move(ready, place)
        if system.get_file_info(f"{root}/staging").type.name == "Directory":
            system.delete_dir_contents(f"{root}/staging")  # also what tasks of failed batches left, which may have ended after ``abort``

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        """What tasks staged goes."""
        system, root = self._fs()
        for folder in {f"{root}/staging/{self.run}", *(m.name.rsplit("/", 1)[0] for m in messages if m is not None)}:
            if system.get_file_info(folder).type.name == "Directory":
                system.delete_dir(folder)


class MessageSink(DataSource):
    """``writeStream.format("messages").option("path", folder)``: string columns, as a rule those of ``enveloped``."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def streamWriter(self, schema, overwrite: bool) -> MessageWriter:  # noqa: N802
        if odd := [f.name for f in schema if f.dataType.typeName() != "string"]:
            raise ValueError(f"columns of messages are strings: {', '.join(odd)}")
        return MessageWriter(self.options["path"], [f.name for f in schema])


def register(spark: SparkSession) -> None:
    """Makes the sink known to a session."""
    spark.dataSource.register(MessageSink)


def sent_messages(spark: SparkSession, path: str) -> DataFrame:
    """(message_id, kind, value) that a sink's committed batches hold, each message once."""
    return spark.read.schema("message_id string, kind string, value string").parquet(f"{path}/messages").dropDuplicates(["message_id"])
