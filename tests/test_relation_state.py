"""Relations of stories: asked about once a text, checked, kept, and counted for what a story has now."""

from __future__ import annotations

from loomwatch.streaming import relation_state
from loomwatch.streaming.messages import ENTITY

STORY = f"cluster_id string, content_hash string, text string, entities array<{ENTITY}>"


def entity(key, kind, status="resolved"):
    return (key, kind, status, 1.0)


CVE, ACTOR, TOOL = entity("CVE-1", "cve"), entity("G1", "threat_actor"), entity("S1", "malware_family")
GOOD = {"entity_a": "CVE-1", "entity_b": "G1", "relationship": "exploited by", "assertion_strength": 0.8}
ODD = [None, "x", {}, GOOD | {"entity_b": "invented"}, GOOD | {"entity_b": "CVE-1"}, GOOD | {"assertion_strength": 7}, GOOD | {"assertion_strength": "1"}, GOOD | {"polarity": "maybe"}, GOOD | {"relationship": None}, GOOD | {"entity_a": ["CVE-1"]}]


def test_relations_are_asked_for_once(spark, tmp_path):
    cache = relation_state.cache_table(spark, str(tmp_path / "cache"), buckets=8)
    log = tmp_path / "asked"

    def provider(items):
        with open(log, "a") as f:
            f.writelines(f"{len(items)} {text}\n" for text, _ in items)
        if any(text == "breaks" for text, _ in items):
            raise RuntimeError("can't read")
        if len(items) > 2:
            return []  # too few: they are asked about one by one
        return ["nonsense" if text == "nonsense" else [*ODD, GOOD, GOOD | {"polarity": "hedged", "assertion_strength": 1}, GOOD | {"entity_a": "G1", "entity_b": "S1", "relationship": "uses"}] if text.startswith("rich") else [] for text, _ in items]

    stories = [
        ("c1", "h1", "rich one", [CVE, ACTOR, TOOL]), ("c2", "h1", "rich one", [CVE, ACTOR]), ("c3", "h2", "poor", [CVE]), ("c4", "h3", "breaks", [CVE, ACTOR]), ("c5", "h4", "nonsense", [CVE]), ("c6", None, "rich", [CVE]),
        ("c|7", "h5", "rich two", [CVE, entity("G1", "threat_actor", "rejected"), entity("", "ttp"), TOOL]), ("c8", "h6", None, None),
    ]
    df = spark.createDataFrame(stories, STORY).coalesce(1)
    edges, failures = relation_state.infer_relations(df, cache, provider, 0)
    got = sorted((r.cluster_id, r.edge_type, r.start_key, r.end_key, round(r.contribution, 6)) for r in edges.collect())
    # Of h1 c1 was asked about or c2; a relation counts where both ends are the story's own.
    rich = [("c1", "EXPLOITED_BY", "CVE-1", "G1", 0.5), ("c1", "EXPLOITED_BY", "CVE-1", "G1", 0.8), ("c2", "EXPLOITED_BY", "CVE-1", "G1", 0.5), ("c2", "EXPLOITED_BY", "CVE-1", "G1", 0.8)]
    assert [x for x in got if x[1] != "USES"] == rich
    assert {x for x in got if x[1] == "USES"} <= {("c1", "USES", "G1", "S1", 0.8)}
    assert {r.content_hash: r.reason for r in failures.collect()} == {"h3": "RuntimeError: can't read", "h4": "no list of relations"}
    assert {r.content_hash: len(r.relations) for r in cache.read().collect() if r.content_hash != "h1"} == {"h2": 0, "h5": 0, "h6": 0}
    assert {x.split(" ", 1)[1] for x in log.read_text().splitlines()} == {"rich one", "poor", "breaks", "nonsense", "rich two", ""}

    # The next batch asks about what is new and what failed; a kept relation counts for what the story has now.
    log.write_text("")
    more = spark.createDataFrame([("c9", "h1", "rich one", [entity("CVE-1", "cve"), entity("G1", "campaign")]), ("c1", "h1", "rich one", [CVE]), ("c4", "h3", "breaks", [CVE]), ("c10", "h7", "rich three", [CVE, ACTOR])], STORY)
    edges, failures = relation_state.infer_relations(more, cache, provider, 1)
    assert sorted({(r.cluster_id, r.edge_type, r.start_label, r.end_label) for r in edges.collect()}) == [("c10", "EXPLOITED_BY", "CVE", "ThreatActor"), ("c9", "EXPLOITED_BY", "CVE", "Campaign")]
    assert {x.split(" ", 1)[1] for x in log.read_text().splitlines()} == {"breaks", "rich three"}
    assert [r.content_hash for r in failures.collect()] == ["h3"]


def test_no_stories(spark, tmp_path):
    cache = relation_state.cache_table(spark, str(tmp_path / "cache"), buckets=2)
    edges, failures = relation_state.infer_relations(spark.createDataFrame([], STORY), cache, lambda items: 1 / 0)
    assert edges.collect() == [] and failures.collect() == []
