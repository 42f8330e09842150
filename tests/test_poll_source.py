"""The polled source over recorded payload folders: windows, failures, time limits, restarts."""

from __future__ import annotations

import json
import time
from pathlib import Path

import pytest

from loomwatch.streaming import poll_source
from loomwatch.streaming.poll_source import Source

HOUR = 3_600_000_000


def recorded(folder: str):
    """A fetch of files ``<source>/<microseconds>.json`` that came within the window; it notes what it was asked for. A source fails while it has a file ``down``."""

    def fetch(source_id: str, start: int, end: int) -> list[str]:
        at = Path(folder, source_id)
        with open(at / "asked.log", "a") as log:
            log.write(json.dumps([start, end]) + "\n")
        if (at / "down").exists():
            raise ConnectionError("down")
        if (at / "slow").exists():
            time.sleep(20)
        return [p.read_text() for p in sorted(at.glob("*.json")) if start <= int(p.stem) < end]

    return fetch


def asked(folder, source) -> list[list[int]]:
    return [json.loads(x) for x in Path(folder, source, "asked.log").read_text().splitlines()]


def test_windows_failures_and_restarts(spark, tmp_path):
    folder, clock = tmp_path / "feeds", tmp_path / "clock"
    for source in ("a", "b/ü", "c"):
        (folder / source).mkdir(parents=True)
        for t in (70, 99, 105, 111, 121):
            (folder / source / f"{t * HOUR}.json").write_text(f"{source}{t}")
    fetch, out = recorded(str(folder)), []
    read_clock = lambda: int(clock.read_text())
    poll_source.register(spark, [Source("a", fetch), Source("b/ü", fetch), Source("c", fetch, timeout=2)], str(tmp_path / "marks"), clock=read_clock)

    def run(at: int, keep=out.append):
        clock.write_text(str(at * HOUR))
        stream = spark.readStream.format("polls").load()
        q = stream.writeStream.foreachBatch(lambda b, n: keep([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    def got() -> dict:
        rows = [r for batch in out for r in batch]
        out.clear()
        return {s: sorted((r[1] // HOUR, r[2] // HOUR, r[3], r[5], r[6]) for r in rows if r[0] == s) for s in ("a", "b/ü", "c")}

    down, slow = folder / "b/ü/down", folder / "c/slow"
    down.touch(), slow.touch()
    run(100)
    first = got()
    assert first["a"] == [(76, 100, True, "a99", None)]  # the first poll looks 24 hours back
    assert first["b/ü"] == [(76, 100, False, None, "ConnectionError: down")]
    assert first["c"][0][:4] == (76, 100, False, None) and first["c"][0][4].startswith("TimeoutError")
    down.unlink(), slow.unlink()
    run(110)  # a failure moved nothing
    assert got() == {"a": [(100, 110, True, "a105", None)], "b/ü": [(86, 110, True, "b/ü105", None), (86, 110, True, "b/ü99", None)], "c": [(86, 110, True, "c105", None), (86, 110, True, "c99", None)]}

    def breaks(rows):
        raise RuntimeError("the sink broke")

    with pytest.raises(Exception, match="the sink broke"):
        run(120, breaks)
    clocks = len(asked(folder, "a"))
    run(125)  # the batch that broke is asked for again as it was, whatever the time is now; then comes the next one
    again = got()
    assert again["a"][0] == (110, 120, True, "a111", None)
    assert asked(folder, "a")[clocks - 1 : clocks + 1] == [[110 * HOUR, 120 * HOUR]] * 2
    assert {r[:2] for r in again["a"]} <= {(110, 120), (120, 125)}
    run(130)
    last = got()
    seen = again["a"] + last["a"]
    assert [r[3] for r in seen if r[3]] == ["a111", "a121"]
    assert all(r[2] for r in seen)
    assert [len(list(p.iterdir())) for p in (tmp_path / "marks").iterdir()] in ([1, 1, 1], [2, 2, 2])
