"""Redelivery, the sink's commits, and messages that are read back."""

from __future__ import annotations

import datetime as dt
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwatch.streaming import messages, polls
from loomwatch.streaming.story_state import ENTITIES

START = dt.datetime(2024, 1, 1)
EVENT = "message_id string, value string, event string, at timestamp"


def steps(spark, path, batches):
    """Files that a stream takes one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(m, v, e, START + dt.timedelta(seconds=s)) for m, v, e, s in rows], EVENT).coalesce(1).write.parquet(f"{path}/p{i}")
        for f in Path(f"{path}/p{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def plain(batches, visible, most):
    """One event after the other; before each, what wasn't acknowledged in time is delivered again."""
    out, held, through = [], {}, set()
    events = sorted(((s, {"sent": 0, "failed": 1, "acked": 2}.get(e, 3), m, v, e) for rows in batches for m, v, e, s in rows), key=lambda x: x[:2])

    def receive(m, v, n, s):
        if n > most:
            held.pop(m, None)
            through.add(m)
            out.append((m, "dead_letter", most, s))
        else:
            held[m] = (v, n, s + visible)
            out.append((m, "deliver", n, s))

    for s, _, m, v, e in events:
        while due := [(u, k) for k, (_, _, u) in held.items() if u < s]:
            u, k = min(due)
            receive(k, held[k][0], held[k][1] + 1, u)
        if e == "sent" and m not in held and m not in through:
            receive(m, v, 1, s)
        elif e == "failed" and m in held:
            receive(m, held[m][0], held[m][1] + 1, s)
        elif e == "acked" and m in held:
            out.append((m, "done", held.pop(m)[1], s))
            through.add(m)
    return out


def test_redelivery(spark, tmp_path):
    """``bad`` is never acknowledged, ``slow`` the second time, ``loud`` says that it failed five times, ``good`` at once, and is sent again."""
    tick = lambda s: ("clock", "", "acked", s)
    batches = [
        [("bad", "b", "sent", 0), ("slow", "s", "sent", 1), ("good", "g", "sent", 2)],
        [("good", None, "acked", 5), ("loud", "l", "sent", 6), ("odd", "o", "nonsense", 6), ("nobody", None, "acked", 6)],
        *([("loud", None, "failed", s)] for s in (7, 8, 9, 10, 11)), *([tick(s)] for s in (12, 14)), [("slow", None, "acked", 15)], [tick(24), ("good", "g", "sent", 24)], *([tick(s)] for s in range(27, 90, 6)),
    ]
    out = []
    stream = messages.redelivery(steps(spark, tmp_path / "in", batches), visible_seconds=10, max_receives=5)
    q = stream.writeStream.foreachBatch(lambda b, n: out.extend((r.message_id, r.action, r.receive_count, (r.at - START).total_seconds()) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    of = lambda rows, m: [r[1:] for r in rows if r[0] == m]
    want = plain(batches, 10, 5)
    for m in ("bad", "slow", "good", "loud", "odd", "nobody", "clock"):
        assert of(out, m) == of(want, m), m
    assert of(out, "bad") == [("deliver", k + 1, 10.0 * k) for k in range(5)] + [("dead_letter", 5, 50.0)]
    assert of(out, "slow") == [("deliver", 1, 1.0), ("deliver", 2, 11.0), ("done", 2, 15.0)]
    assert of(out, "loud") == [("deliver", k, 5.0 + k) for k in range(1, 6)] + [("dead_letter", 5, 11.0)]
    assert of(out, "good") == [("deliver", 1, 2.0), ("done", 1, 5.0)]


def test_the_sink_commits_batches_whole(spark, tmp_path):
    messages.register(spark)
    path = str(tmp_path / "out")
    rows = [[("m%d" % i, "v%d" % i, "sent", i)] for i in range(3)]
    source = steps(spark, tmp_path / "in", rows)

    def run(fails=None):
        told = messages.enveloped(source.select(F.when(F.col("value") == F.lit(fails), F.raise_error(F.lit("broken"))).otherwise(F.col("value")).alias("value")), "test")
        told.writeStream.format("messages").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)

    with pytest.raises(Exception, match="broken"):
        run(fails="v1")
    assert {r.value for r in messages.sent_messages(spark, path).collect()} == {"v0"}  # of the batch that failed nothing is left
    run()
    assert not list(Path(path, "staging").rglob("*.parquet"))
    got = messages.sent_messages(spark, path).collect()
    assert sorted(r.value for r in got) == ["v0", "v1", "v2"] and len({r.message_id for r in got}) == 3
    assert len(list(Path(path, "messages").iterdir())) == 3


def test_a_repeated_batch_changes_nothing(tmp_path):
    def write(values):
        w = messages.MessageWriter(str(tmp_path / "o"), ["message_id", "value"])
        return w, [w.write(iter([{"message_id": v, "value": v}])) for v in values] + [w.write(iter([]))]

    for values in (["a", "b"], ["a", "b"]):
        w, staged = write(values)
        w.commit(staged, 4)
    w, staged = write(["c"])
    w.abort([*staged, None], 5)
    files = [str(p.relative_to(tmp_path / "o")) for p in (tmp_path / "o").rglob("*.parquet")]
    assert len(files) == 2 and all(f.startswith("messages/batch=000000000004/") for f in files)
    with pytest.raises(ValueError, match="strings: n"):
        from pyspark.sql import types as T

        messages.MessageSink({"path": "x"}).streamWriter(T.StructType([T.StructField("n", T.LongType())]), False)


def test_messages_are_read_back(spark):
    articles = spark.createDataFrame([("s::1", "One", "2024"), ("s::2", None, None)], "article_id string, title string, published_at string")
    m = spark.createDataFrame([("s::1", "cve", None, "CVE-2024-1", 3, 13, 1.0, "… x", 1), ("s::1", "ttp", None, "T1", 0, 2, 0.9, "y", 0)], "article_id string, entity_type string, ioc_type string, surface_text string, char_start int, char_end int, extraction_confidence double, context_snippet string, seq int")
    told = messages.mention_messages(articles, m)
    good, bad = polls.decoded(told, messages.SHAPES["mentions"], ["article_id", "mentions"])
    assert bad.count() == 0
    got = {r.article_id: r for r in good.collect()}
    assert [(x.surface_text, x.char_span, x.extraction_confidence, x.article_id) for x in got["s::1"].mentions] == [("T1", [0, 2], 0.9, "s::1"), ("CVE-2024-1", [3, 13], 1.0, "s::1")]
    assert (got["s::2"].title, got["s::2"].published_at, got["s::2"].mentions) == ("", "", [])
    assert set(json.loads(told.first().value)["mentions"][0] if json.loads(told.first().value)["mentions"] else ["article_id"]) >= {"article_id"}
    resolved = spark.createDataFrame([("s::1", "cve", "CVE-2024-1", "resolved", 1.0), ("s::1", "ttp", "", "rejected", 0.0)], "article_id string, entity_type string, node_key string, resolution_status string, node_confidence double")
    good, bad = polls.decoded(messages.resolved_messages(articles, resolved), messages.SHAPES["resolved"], ["article_id", "source_id"])
    got = {r.article_id: r for r in good.collect()}
    assert bad.count() == 0 and got["s::1"].source_id == "s"
    assert [tuple(x) for x in got["s::1"].resolved_entities] == [("", "ttp", "rejected", 0.0), ("CVE-2024-1", "cve", "resolved", 1.0)]
    assert ENTITIES == f"array<{messages.ENTITY}>"


def test_records_of_events(spark):
    texts = ['{"Records": [{"body": "a"}, {"Sns": {"Message": "b"}}, {"body": "c", "Sns": {"Message": "no"}}]}', '{"Records": []}', "{broken", None, "{}", '{"Records": [{"body": "d"}, {"x": 1}]}', '{"Records": [null]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "value_id long, value string")
    records, rest = messages.unwrapped(df)
    assert sorted(map(tuple, records.collect())) == [(0, "a"), (0, "b"), (0, "c"), (5, "d")]
    assert {r.value_id: r.reason for r in rest.collect()} == {2: "no records", 3: "no records", 4: "no records", 5: "a record without a message", 6: "a record without a message"}
    assert all(r.value == texts[r.value_id] for r in rest.collect())
