"""Labels of merged nodes, guarded writers, and what models answer."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from loomwatch.functions import text as tx
from loomwatch.operators import graph, mentions, resolve
from loomwatch.sources import feeds, stix

EDGES = "start_label string, start_key string, rel_type string, end_label string, end_key string, confidence double, origin array<string>, feed_sources array<string>, first_observed long, last_confirmed long, note string"


def test_nodes_of_one_label_are_merged(spark):
    nodes = spark.createDataFrame([("ThreatActor", "fox", "Fox", None), ("ThreatActor", "G1", "Fox", ["FX"]), ("MalwareFamily", "fox", "Fox", None), ("MalwareFamily", "S1", "S", None)], "label string, merge_key string, name string, aliases array<string>")
    edges = spark.createDataFrame(
        [
            ("ThreatActor", "fox", "USES", "TTP", "T1", 0.4, ["inferred"], ["f1"], 5, 6, "new"), ("ThreatActor", "G1", "USES", "TTP", "T1", 0.3, ["authoritative"], ["f2", "f1"], 7, 8, "old"), ("MalwareFamily", "fox", "HAS_SAMPLE", "IOC", "h::md5", 0.9, None, None, 1, 1, None),
            ("Campaign", "c", "ATTRIBUTED_TO", "ThreatActor", "fox", 0.2, ["inferred"], [], 3, 4, None), ("ThreatActor", "fox", "KNOWS", "ThreatActor", "G1", 0.2, [], [], 3, 4, None), ("ThreatActor", "G1", "RELATED", "MalwareFamily", "G1", 0.1, [], [], 1, 2, None),
        ],
        EDGES,
    )
    merges = spark.createDataFrame([("ThreatActor", "fox", "G1"), ("MalwareFamily", "none", "S1")], "label string, merge_key string, canonical_key string")
    left, moved = resolve.merge_nodes(nodes, edges, merges)
    assert {(r.label, r.merge_key): r.aliases for r in left.collect()} == {("ThreatActor", "G1"): ["FX", "Fox"], ("MalwareFamily", "fox"): [], ("MalwareFamily", "S1"): []}
    got = {(r.start_label, r.start_key, r.rel_type, r.end_key): (r.confidence, r.origin, r.feed_sources, r.first_observed, r.last_confirmed, r.note, r.merged) for r in moved.collect()}
    assert got == {
        ("ThreatActor", "G1", "USES", "T1"): (0.4, ["authoritative", "inferred"], ["f1", "f2"], 5, 8, "old", 2),
        ("MalwareFamily", "fox", "HAS_SAMPLE", "h::md5"): (0.9, [], [], 1, 1, None, 1),
        ("Campaign", "c", "ATTRIBUTED_TO", "G1"): (0.2, ["inferred"], [], 3, 4, None, 1),
        ("ThreatActor", "G1", "RELATED", "G1"): (0.1, [], [], 1, 2, None, 1),
    }
    # Without labels a key of two labels isn't touched.
    plain = edges.select("start_key", "rel_type", "end_key", "confidence")
    assert ("fox", "HAS_SAMPLE") in {(r.start_key, r.rel_type) for r in resolve.merge_nodes(nodes, plain, merges)[1].collect()}


def test_writers_refuse_a_wrong_direction(spark):
    state = spark.createDataFrame([], f"start_key string, rel_type string, end_key string, {graph.INFERRED}")
    event = "start_key string, rel_type string, end_key string, cluster_id string, contribution double, article_ids array<string>, ts long, seq long"
    good, bad = (spark.createDataFrame([("a", "ASSOCIATED_WITH", end, "s1", 0.5, ["x"], 1, 1)], event) for end in ("1.2.3.4::ipv4", "CVE-2024-1"))
    assert graph.merge_inferred(state, good).count() == 1
    with pytest.raises(Exception, match="must end at an IOC"):
        graph.merge_inferred(state, bad).collect()
    said = "start_key string, rel_type string, end_label string, end_key string, source_id string, credibility_score double, ts long"
    none = graph.authoritative_edges(spark.createDataFrame([], said))
    assert graph.merge_authoritative(none, spark.createDataFrame([("a", "ASSOCIATED_WITH", "IOC", "b", "f", 0.5, 1), ("a", "USES", "TTP", "b", "f", 0.5, 1)], said)).count() == 2
    for label in ("CVE", None):
        with pytest.raises(Exception, match="must end at an IOC"):
            graph.merge_authoritative(none, spark.createDataFrame([("a", "ASSOCIATED_WITH", label, "b", "f", 0.5, 1)], said)).collect()


def test_no_mention_is_passed_over(spark):
    """Texts whose mentions depend on other scripts' classes, or on characters that refanging takes away."""
    texts = ["a​T1234 x", "T١٢٣٤", "́T1234", "1٠.١.2.3", "é@日本.org", "hxxps[:]//x", "a[.]b(dot)co", "no", "", None, "cve-2024-1234 CVE-2024-12345678", "xT1234", "d41d8cd98f00b204e9800998ecf8427e", "fe80:1:2:3", "ab﻿c.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "article_id long, text string")
    got = {(r.article_id, r.entity_type, r.surface_text) for r in mentions.extract_mentions(df, benign=()).collect()}
    find, want = mentions.Finder().rows, set()
    for i, t in enumerate(texts):
        want |= {(i, r[0], r[2]) for r in find(t or "") if not (r[1] == "ipv4" and re.match(tx.RESERVED, r[2]))}
    assert got == want
    assert {0, 1, 2, 3} <= {i for i, *_ in got}


GOOD = {"entity_type": "tool", "surface_text": "Kit", "char_start": 0, "char_end": 3, "extraction_confidence": 1}
ODD = [None, 7, {}, {"surface_text": "Kit"}, GOOD | {"entity_type": None}, GOOD | {"extraction_confidence": "high"}, GOOD | {"extraction_confidence": float("nan")}, GOOD | {"char_end": 99}, GOOD | {"surface_text": "invented"}, GOOD | {"ioc_type": 3}, GOOD | {"extraction_confidence": True}]


def test_malformed_answers_cost_no_others(spark):
    df = spark.createDataFrame([(1, "Kit one"), (1, "Kit again"), (2, "none"), (3, None)], "article_id long, text string")
    got = mentions.model_mentions(df, lambda text: [*ODD, GOOD, *ODD])
    assert sorted((r.article_id, r.surface_text, r.extraction_confidence, r.seq) for r in got.collect()) == [(1, "Kit", 0.99, len(ODD))] * 2
    assert "Join" not in got._jdf.queryExecution().toString()
    for answer in (None, 5, "text", {"a": 1}):
        assert mentions.model_mentions(df, lambda text, a=answer: a).collect() == []


def test_a_provider_that_fails_answers_nonsense_and_too_little(spark):
    rows = [(i, f"title {i}", f"Kit {i}" if i % 4 else f"broken {i}") for i in range(23)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "article_id long, title string, text string").coalesce(1)

    def provider(texts):
        if any(t.startswith("broken") for _, t in texts):
            raise RuntimeError("can't take this")
        if len(texts) > 3:
            return [[]] * (len(texts) - 1)  # one too few: they are asked about one by one
        return [[*ODD, GOOD, {**GOOD, "surface_text": title, "char_start": 0, "char_end": 0}] if t != "Kit 5" else "nonsense" for title, t in texts]

    found, failed = mentions.provider_mentions(df, provider, size=5)
    got = sorted((r.article_id, r.surface_text) for r in found.collect())
    fine = [i for i in range(23) if i % 4 and i != 5]
    assert got == sorted([(i, "Kit") for i in fine] + [(i, f"title {i}") for i in fine])
    assert {r.article_id: r.reason for r in failed.collect()} == {i: "RuntimeError: can't take this" for i in range(0, 23, 4)} | {5: "no list of mentions"}


def _payload(spark, schema, doc):
    return spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", schema).alias("p")).select("p.*")


def test_a_bundle_s_edges(spark):
    ref = lambda i: [{"source_name": "other", "external_id": "x"}, {"source_name": "mitre-attack", "external_id": i, "url": f"https://e.org/{i}"}]
    objects = [
        {"type": "attack-pattern", "id": "ap1", "name": "Phish", "external_references": ref("T1566.001"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "initial-access"}]},
        {"type": "intrusion-set", "id": "is1", "name": "Quiet  Fox", "aliases": ["QF"]}, {"type": "malware", "id": "mw1", "name": "Dropper", "external_references": ref("S0001"), "malware_types": ["trojan", "rat"], "revoked": True},
        *({"type": "relationship", "id": f"r{i}", "relationship_type": kind, "source_ref": a, "target_ref": b} for i, (kind, a, b) in enumerate([("uses", "is1", "mw1"), ("uses", "mw1", "ap1"), ("uses", "mw1", "gone"), ("mitigates", "mw1", "ap1")])),
    ]
    parsed = stix.objects(_payload(spark, stix.BUNDLE, {"objects": objects}).withColumn("domain", F.lit("enterprise-attack")))
    want = {("ThreatActor", "quiet fox", "USES", "MalwareFamily", "S0001"), ("MalwareFamily", "S0001", "USES", "TTP", "T1566.001")}
    assert {tuple(r)[:5] for r in stix.edges(parsed).select("start_label", "start_key", "rel_type", "end_label", "end_key").collect()} == want
    said = graph.authoritative_edges(stix.assertions(parsed, 9)).collect()
    assert {(r.start_key, r.end_key, r.authoritative_confidence, tuple(r.feed_sources), r.last_confirmed) for r in said} == {("quiet fox", "S0001", 1.0, ("mitre_attck",), 9), ("S0001", "T1566.001", 1.0, ("mitre_attck",), 9)}


def test_records_of_feeds(spark):
    v = lambda i, **k: {"cve": {"id": i, "published": "2024-01-01", "lastModified": "2024-02-02T00:00:00.000", **k}}
    weak = [{"description": [{"value": "CWE-79"}, {"value": "NVD-CWE-Other"}, {"value": "CWE-79"}]}]
    items = [
        v("CVE-1", descriptions=[{"lang": "fr", "value": "un"}, {"lang": "en", "value": "one"}], metrics={"cvssMetricV31": [{"cvssData": {"vectorString": "V", "baseScore": 9.8}}]}, weaknesses=weak),
        v("CVE-2", descriptions=[{"lang": "fr", "value": "deux"}], metrics={"cvssMetricV31": [], "cvssMetricV2": [{"cvssData": {"vectorString": "W", "baseScore": 5.0}}]}), v("", descriptions=[]),
    ]
    n = feeds.nvd(_payload(spark, feeds.NVD, {"vulnerabilities": items})).collect()
    assert {(r.cve_id, r.description, r.cvss_score, r.cvss_vector, tuple(r.cwe_ids)) for r in n} == {("CVE-1", "one", 9.8, "V", ("CWE-79",)), ("CVE-2", "deux", 5.0, "W", ())}
    fox = [{"ioc": "1.2.3.4:80", "ioc_type": "ip:port", "malware": "win.x", "malware_printable": " Xbot "}, {"ioc": "ab", "ioc_type": "sha256_hash", "malware_printable": "Xbot"}, {"ioc": "", "ioc_type": "url", "malware_printable": "Y"}]
    edges = feeds.threatfox(_payload(spark, feeds.THREATFOX, {"query_status": "ok", "data": fox}))[2]
    assert {tuple(r) for r in edges.collect()} == {("xbot", "COMMUNICATES_WITH", "1.2.3.4:80::ip:port", "threatfox"), ("xbot", "HAS_SAMPLE", "ab::sha256_hash", "threatfox")}


def test_every_key_is_unique(spark):
    assert [graph.checked_name(x) for x in ("a", "_b1", "CVE")] == ["a", "_b1", "CVE"]
    for bad in ("", "1a", "a-b", "a b", "a;", "ä", "a\n"):
        with pytest.raises(ValueError, match="identifier"):
            graph.checked_name(bad)
