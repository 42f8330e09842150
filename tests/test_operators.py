"""Stated values of the rules: scores, tiers, caps, extraction order, feeds, streams."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomwatch.functions import text as tx
from loomwatch.operators import components, graph, mentions, relations, resolve, stories
from loomwatch.sources import feeds, stix
from loomwatch.streaming import polls

EVENT = "start_key string, rel_type string, end_key string, cluster_id string, contribution double, ts long, seq long"


@pytest.mark.parametrize(("given", "want"), [([0.5, 0.5], 0.75), ([0.7, 0.7], 0.91), ([0.45], 0.45)])
def test_noisy_or(spark, given, want):
    rows = [("a", "USES", "b", f"c{i}", c, i, i) for i, c in enumerate(given)]
    rows.append(("a", "USES", "b", "c0", 0.99, 9, 9))  # a cluster counts once, by its first contribution
    e = graph.inferred_edges(spark.createDataFrame(rows, EVENT)).first()
    assert e.inferred_confidence == pytest.approx(want) and e.contributing_story_cluster_ids == [f"c{i}" for i in range(len(given))]
    assert (e.first_observed, e.last_confirmed) == (0, 9)


def test_confidence_is_the_larger_component(spark):
    auth = spark.createDataFrame([("a", "USES", "b", "f1", 0.6, 5)], "start_key string, rel_type string, end_key string, source_id string, credibility_score double, ts long")
    inf = graph.inferred_edges(spark.createDataFrame([("a", "USES", "b", "c", 0.7, 1, 1), ("x", "USES", "y", "c", 0.2, 1, 1)], EVENT))
    got = {r.start_key: r for r in graph.combine_edges(graph.authoritative_edges(auth), inf).collect()}
    assert got["a"].confidence == pytest.approx(0.7) and got["a"].origin == ["authoritative", "inferred"] and (got["a"].first_observed, got["a"].last_confirmed) == (1, 5)
    assert got["x"].confidence == pytest.approx(0.2) and got["x"].origin == ["inferred"]


def test_recompute_counts_other_feeds(spark):
    edges = spark.createDataFrame([("a", "U", "b", ["otx"], 0.6, 0.0, 0.6), ("c", "U", "d", ["otx", "mitre"], 1.0, 0.0, 1.0), ("e", "U", "f", ["kev"], 0.9, 0.0, 0.9)], "start_key string, rel_type string, end_key string, feed_sources array<string>, authoritative_confidence double, inferred_confidence double, confidence double")
    sources = spark.createDataFrame([("mitre", 1.0)], "source_id string, credibility_score double")  # otx itself is absent
    got = {r.start_key: r.confidence for r in graph.recompute_for_feed(edges, sources, "otx", 0.75).collect()}
    assert got == {"a": 0.75, "c": 1.0}


def test_capped_list_counts_past_the_cap(spark):
    df = spark.createDataFrame([("k", i, [f"a{i}"]) for i in range(5)], "k string, seq long, article_ids array<string>")
    r = graph.capped_ids(df, ["k"], cap=2).first()
    assert (r.source_article_ids, r.supporting_article_count) == (["a0", "a1"], 5)


def test_upsert_null_is_absent(spark):
    old = spark.createDataFrame([("k", "x", "first")], "k string, p string, made string")
    new = spark.createDataFrame([("k", None, "later", 1), ("n", "y", "n1", 2), ("n", "z", "n2", 3)], "k string, p string, made string, seq long")
    got = {r.k: (r.p, r.made) for r in graph.upsert_nodes(old, new, ["k"], ["p"], ["made"]).collect()}
    assert got == {"k": ("x", "first"), "n": ("z", "n1")}
    with pytest.raises(ValueError):
        graph.upsert_nodes(old, new, ["k"], ["p; drop"], [])


@pytest.mark.parametrize(("incoming", "stored", "want"), [("2024-01-02", "2024-01-01", True), ("2024-01-01", "2024-01-01", False), (None, "2024-01-01", False), (None, None, True), ("2024-01-01", None, True)])
def test_freshness(spark, incoming, stored, want):
    df = spark.createDataFrame([(incoming, stored)], "i string, s string")
    assert df.select(graph.is_fresher(F.col("i"), F.col("s")).alias("x")).first().x is want


def test_direction_is_guarded(spark):
    df = spark.createDataFrame([("a", "ASSOCIATED_WITH", "b", "CVE")], "start_key string, rel_type string, end_key string, end_label string")
    with pytest.raises(Exception, match="must end at an IOC"):
        graph.guard_direction(df).collect()


def found(spark, text):
    rows = mentions.extract_mentions(spark.createDataFrame([(1, text)], "article_id long, text string")).collect()
    return {(r.entity_type, r.surface_text): r for r in rows}


SHA = "ab" * 32


def test_extraction(spark):
    got = found(spark, "CVE-2024-12345 is used with T1059.001 and T1059; 8.8.4[.]4 and 10.0.0.1, github.com, CVE-2024-12345 again")
    assert set(got) == {("cve", "CVE-2024-12345"), ("ttp", "T1059.001"), ("ttp", "T1059"), ("ioc", "8.8.4.4")}
    assert got[("ioc", "8.8.4.4")].extraction_confidence == 0.9 and got[("ioc", "8.8.4.4")].char_start == 0
    assert found(spark, "see 8.8.4.4 today")[("ioc", "8.8.4.4")].extraction_confidence == 0.4


def test_extraction_overlaps(spark):
    inside = {v for _, v in found(spark, f"http://evil.example/{SHA}/x")}
    assert inside == {SHA, f"http://evil.example/{SHA}/x"}  # an enclosing match stays
    at_end = {v for _, v in found(spark, f"http://evil.example/{SHA}")}
    assert at_end == {SHA, "evil.example"}  # one that ends with an earlier match goes
    assert {v for _, v in found(spark, "hxxp://A.example/Q and http://a.example/q")} == {"http://A.example/Q"}  # equal but for case


def naive_mentions(text):
    """The rule in its plainest form."""
    plain = text
    for c in tx.ZERO_WIDTH:
        plain = plain.replace(c, "")
    for a, b in tx.REFANG:
        plain = plain.replace(a, b)
    refang = lambda t: mentions.refanged(t)
    spans, rows = [], [(k, None, m[0], m.start(), 1.0) for k, p in (("cve", tx.CVE), ("ttp", tx.TTP)) for m in re.finditer(p, text)]
    for kind, p in tx.PATTERNS.items():
        for m in re.finditer(p, plain):
            a, b = m.span()
            if all(not (s <= a < e) and not (s < b <= e) for s, e in spans):
                spans.append((a, b))
                near = text[max(0, a - 10) : b + 10]
                rows.append(("ioc", kind, m[0], max(0, text.find(m[0])), 0.9 if refang(near) != near else 0.4))
    best = {}
    for r in rows:
        if (r[1] == "ipv4" and re.match(tx.RESERVED, r[2])) or (r[1] == "domain" and r[2].lower() in tx.BENIGN):
            continue
        key = (r[0], r[2].lower())
        if key not in best or r[4] > best[key][4]:
            best[key] = r
    return {(r[0], r[1], r[2].upper() if r[0] in ("cve", "ttp") else r[2], r[3], r[4]) for r in best.values()}


def test_extraction_equals_the_plain_rule(spark):
    r = random.Random(6)
    bits = ["CVE-2024-12345", "cve-2024-1", "T1059", "T1059.001", "8.8.4.4", "8[.]8.4[.]4", "10.1.2.3", "http://a.example/q", "hxxp://b[.]example/" + "ab" * 20, "x@y.org", "x[at]y(dot)org", "fe80:1:2:3", "github.com", "EVIL.example", "evil.example", "ab" * 16, "AB" * 32, "word", "\u200b", "\n", ",", "/"]
    texts = ["".join(r.choice(bits) + r.choice([" ", "", " ", "/"]) for _ in range(r.randrange(25))) for _ in range(150)] + [None, "", "8.8.4.4 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "article_id long, text string").repartition(3)
    got = {}
    for x in mentions.extract_mentions(df).collect():
        got.setdefault(x.article_id, set()).add((x.entity_type, x.ioc_type, x.surface_text, x.char_start, x.extraction_confidence))
        t = texts[x.article_id]
        assert x.context_snippet == t[max(0, x.char_start - 40) : x.char_end + 40].strip()
    for i, t in enumerate(texts):
        assert got.get(i, set()) == naive_mentions(t or ""), t


def test_model_mentions_are_guarded_and_failures_keep_articles(spark):
    df = spark.createDataFrame([(1, "Fancy Bear used CVE-2024-12345"), (2, "boom CVE-2024-12345"), (3, None)], "article_id long, text string")
    names = mentions.dictionary_model({"fancy bear": "threat_actor"})

    def model(text):
        if "boom" in text:
            raise TimeoutError
        return [*names(text), {"entity_type": "malware_family", "surface_text": "invented", "extraction_confidence": 1.0}, {"entity_type": "cve", "surface_text": "CVE-2024-12345", "extraction_confidence": 1.0}]

    got = {(r.article_id, r.entity_type, r.surface_text, r.extraction_confidence) for r in mentions.all_mentions(df, model).collect()}
    assert got == {(1, "threat_actor", "Fancy Bear", 0.8), (1, "cve", "CVE-2024-12345", 1.0), (2, "cve", "CVE-2024-12345", 1.0)}
    assert mentions.all_mentions(df).count() == 2


def test_story_score_and_clusters(spark):
    day = dt.datetime(2024, 1, 1)
    arts = [(i, day + dt.timedelta(hours=h), f"h{i}", c) for i, h, c in ((1, 5, 0.5), (2, 3, 0.5), (3, 3, 0.9), (4, 90, None))] + [(5, None, "", 0.9)]
    a = spark.createDataFrame(arts, "article_id long, published_at timestamp, content_hash string, credibility_score double")
    e = spark.createDataFrame([(i, "cve", "k") for i in range(1, 6)], "article_id long, entity_type string, node_key string")
    pairs = sorted(map(tuple, stories.candidate_pairs(e, a).collect()))
    assert pairs == [(1, 2), (1, 3), (2, 3)]  # 4 is out of the window, 5 has no date
    scores = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.7), (3, 4, 0.59)], "a long, b long, score double")
    got = {r.article_id: r for r in stories.cluster(a, scores).collect()}
    assert got[3].is_representative and got[3].cluster_size == 3 and got[1].cluster_size is None
    assert len({got[i].cluster_id for i in (1, 2, 3)}) == 1 and got[4].cluster_size == got[5].cluster_size == 1


def test_clusters_merge_on_a_bridge(spark):
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (9, 9)], "article_id long, cluster long")
    links = spark.createDataFrame([(2, 5), (3, 5)], "a long, b long")
    got = {r.article_id: r.cluster for r in stories.merge_incremental(known, links, spark.createDataFrame([(5,)], "article_id long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(100, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


ALIASES = [("G0007", "Fancy Bear", ["APT28"], 1), ("G1015", "Scattered Spider", None, 2)]


def test_resolution_tiers(spark):
    aliases = resolve.alias_index(spark.createDataFrame(ALIASES, "merge_key string, name string, aliases array<string>, seq long"))
    rows = [(1, "threat_actor", n, 0.95) for n in (" apt28 ", "Fancy Baer", "Unknown Crew", "")]
    got = {r.surface_text: r for r in resolve.resolve_names(spark.createDataFrame(rows, "article_id long, entity_type string, surface_text string, extraction_confidence double"), aliases).collect()}
    assert got[" apt28 "].node_key == got["Fancy Baer"].node_key == "G0007" and got["Fancy Baer"].resolution_status == "resolved"
    assert (got["Unknown Crew"].node_key, got["Unknown Crew"].resolution_status, got["Unknown Crew"].node_confidence) == ("unknown crew", "provisional", 0.95)
    near = resolve.fuzzy_match(spark.createDataFrame([("fancy baer",)], "name string"), aliases).first()
    assert near.ratio == pytest.approx(0.9)


def test_resolved_mentions_keep_their_confidence(spark):
    aliases = resolve.alias_index(spark.createDataFrame(ALIASES, "merge_key string, name string, aliases array<string>, seq long"))
    rows = [(1, "threat_actor", "Fancy\t  Bear", 0.7), (1, "malware_family", "New\u00a0 Thing", 1.0)]
    got = {r.node_key: (r.resolution_status, r.node_confidence) for r in resolve.resolve_names(spark.createDataFrame(rows, "article_id long, entity_type string, surface_text string, extraction_confidence double"), aliases).collect()}
    assert got == {"G0007": ("resolved", 0.7), "new thing": ("provisional", 0.99)}


def test_a_model_may_only_choose_known_keys(spark):
    aliases = resolve.alias_index(spark.createDataFrame(ALIASES, "merge_key string, name string, aliases array<string>, seq long"))
    answers = spark.createDataFrame([("the bears", "G0007"), ("nobody", "G9999")], "name string, merge_key string")
    rows = [(1, "threat_actor", "The Bears", 0.6), (1, "threat_actor", "Nobody", 0.6)]
    got = resolve.resolve_names(spark.createDataFrame(rows, "article_id long, entity_type string, surface_text string, extraction_confidence double"), aliases, lambda names, _: names.join(answers, "name"))
    assert {r.node_key: r.resolution_status for r in got.collect()} == {"G0007": "resolved", "nobody": "provisional"}
    assert resolve.known_keys(aliases).first().merge_keys == ["G0007", "G1015"]


def test_fuzzy_pairs_are_those_of_all_pairs(spark):
    import difflib

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.randrange(1, 12))).strip() or "a"
    names, aliases = sorted({" ".join(word().split()) for _ in range(80)}), sorted({" ".join(word().split()) for _ in range(60)})
    left = spark.createDataFrame([(n,) for n in names], "name string")
    right = spark.createDataFrame([(a, f"k{i}", (i, 0)) for i, a in enumerate(aliases)], "alias string, merge_key string, first_seen struct<seq:int,pos:int>")
    for least in (0.6, 0.85):
        got = {(x.name, x.alias): x.ratio for x in resolve._ratios(left, right, least).collect()}
        every = {(n, a): difflib.SequenceMatcher(None, n, a).ratio() for n in names for a in aliases}
        assert got == {k: v for k, v in every.items() if v >= least}


CANONICAL = [("ThreatActor", "G0007", "Fancy Bear", ["APT28"]), ("ThreatActor", "G1015", "Scattered Spider", None), ("ThreatActor", "G1016", "Scattered Spiders", None), ("MalwareFamily", "S1", "apt28", None)]


def test_reconciliation(spark):
    canonical = spark.createDataFrame(CANONICAL, "label string, merge_key string, name string, aliases array<string>")
    provisional = spark.createDataFrame([("ThreatActor", k) for k in ("apt28", "scattered spyder", "zzz")], "label string, merge_key string")
    got = {(r.merge_key, r.canonical_key, r.action) for r in resolve.reconcile(provisional, canonical).collect()}
    assert got == {("apt28", "G0007", "merge"), ("scattered spyder", "G1015", "review"), ("scattered spyder", "G1016", "review")}


def test_merged_nodes_leave_their_name_and_edges(spark):
    nodes = spark.createDataFrame([*CANONICAL, ("ThreatActor", "apt28", "Apt28 group", None)], "label string, merge_key string, name string, aliases array<string>")
    edges = spark.createDataFrame([("apt28", "USES", "m", 0.4), ("G0007", "USES", "m", 0.3), ("x", "USES", "apt28", 0.2)], "start_key string, rel_type string, end_key string, confidence double")
    merges = spark.createDataFrame([("ThreatActor", "apt28", "G0007")], "label string, merge_key string, canonical_key string")
    left, moved = resolve.merge_nodes(nodes, edges, merges)
    assert {(r.label, r.merge_key): r.aliases for r in left.collect()} == {("ThreatActor", "G0007"): ["APT28", "Apt28 group"], ("ThreatActor", "G1015"): [], ("ThreatActor", "G1016"): [], ("MalwareFamily", "S1"): []}
    assert {(r.start_key, r.end_key): (r.confidence, r.merged) for r in moved.collect()} == {("G0007", "m"): (0.4, 2), ("x", "G0007"): (0.2, 1)}


def test_every_kind_has_its_ladder(spark):
    aliases = resolve.alias_index(spark.createDataFrame(ALIASES, "merge_key string, name string, aliases array<string>, seq long"))
    rows = [("cve", None, "CVE-2024-1"), ("ttp", None, "T1001"), ("ttp", None, "T9999"), ("ioc", "url", "http://A/b"), ("ioc", "domain", "Evil.Example"), ("threat_actor", None, "APT28"), ("tool", None, "x")]
    m = spark.createDataFrame([(1, *r, 0.5) for r in rows], "article_id long, entity_type string, ioc_type string, surface_text string, extraction_confidence double")
    got = resolve.resolve_all(m, aliases, spark.createDataFrame([("T1001",)], "technique_id string"))
    assert {(r.node_key, r.resolution_status) for r in got.collect()} == {("CVE-2024-1", "resolved"), ("T1001", "resolved"), ("", "rejected"), ("http://A/b::url", "resolved"), ("evil.example::domain", "resolved"), ("G0007", "resolved")}
    assert resolve.mention_edges(got).count() == 5


def test_relations(spark):
    rows = [
        (1, "campaign", "c", "threat_actor", "t", "by", "asserted", 0.9), (2, "ioc", "i", "malware_family", "m", "beacons to it", "hedged", 0.9), (3, "malware_family", "m", "ioc", "i", "drops a file and calls back", "asserted", 0.5),
        (4, "malware_family", "m", "ioc", "i", "is near", "asserted", 0.5), (5, "cve", "v", "campaign", "c", "x", "negated", 0.9), (6, "cve", "v", "cve", "w", "x", "asserted", 0.9),
    ]
    df = spark.createDataFrame(rows, "relation_id long, type_a string, key_a string, type_b string, key_b string, relationship string, polarity string, strength double")
    got = {r.relation_id: (r.edge_type, r.start_key, r.end_key, r.contribution) for r in relations.map_relations(df).collect()}
    assert got == {1: ("ATTRIBUTED_TO", "c", "t", 0.9), 2: ("COMMUNICATES_WITH", "m", "i", 0.45), 3: ("HAS_SAMPLE", "m", "i", 0.5)}


def payload(spark, schema, doc):
    return spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", schema).alias("p")).select("p.*")


def test_pulses_with_one_cve_only(spark):
    ind = lambda *x: [{"indicator": v, "type": t} for v, t in x]
    doc = {"results": [{"id": "1", "indicators": ind(("CVE-1", "CVE"), ("1.1.1.1", "IPv4"))}, {"id": "2", "indicators": ind(("CVE-1", "CVE"), ("CVE-2", "CVE"), ("d.org", "hostname"))}, {"id": "3", "indicators": ind(("m", "Mutex"))}]}
    doc["results"] += [{"id": "", "indicators": ind(("CVE-9", "CVE"), ("e", "Mutex"))}, {"id": "4", "indicators": ind(("CVE-3", "CVE"), ("CVE-3", "CVE"), ("f.org", "domain"), ("", "IPv4"), ("x", None))}]
    nodes, cves, edges = feeds.otx(payload(spark, feeds.OTX, doc))
    assert {r.value_type_key for r in nodes.collect()} == {"1.1.1.1::ip", "d.org::domain", "m::mutex", "f.org::domain"}
    assert {r.cve_id for r in cves.collect()} == {"CVE-1", "CVE-2", "CVE-3"}
    assert [(r.start_key, r.end_key) for r in edges.collect()] == [("1.1.1.1::ip", "CVE-1")]


def test_missing_parts_lose_no_products(spark):
    doc = {"vulnerabilities": [{"cve": {"id": "CVE-1", "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "a"}]}, {}]}, {}, {"nodes": [{"cpeMatch": [{"criteria": "b"}, {}]}]}]}}]}
    row = feeds.nvd(payload(spark, feeds.NVD, doc)).first()
    assert row.affected_products == ["a", "b"] and row.cwe_ids == [] and row.description is None


def test_samples_are_hashes_of_three_kinds(spark):
    rows = [{"ioc": k, "ioc_type": k, "malware_printable": "X"} for k in ("md5_hash", "sha3_384_hash", "url")]
    edges = feeds.threatfox(payload(spark, feeds.THREATFOX, {"query_status": "ok", "data": rows}))[2]
    assert {r.end_key.split("::")[0]: r.rel_type for r in edges.collect()} == {"md5_hash": "HAS_SAMPLE", "sha3_384_hash": "COMMUNICATES_WITH", "url": "COMMUNICATES_WITH"}


@pytest.mark.parametrize(("feed", "schema", "good", "bad"), [("kev", feeds.KEV, {"vulnerabilities": []}, {"vulnerabilities": "x"}), ("ghsa", feeds.GHSA, {"data": {"securityAdvisories": {"nodes": []}}}, {"data": {}}), ("otx", feeds.OTX, {"results": []}, {}), ("urlhaus", feeds.URLHAUS, {"query_status": "ok", "urls": []}, {"query_status": "no_results", "urls": []})])
def test_shapes_are_checked(spark, feed, schema, good, bad):
    both = payload(spark, schema, good).unionByName(payload(spark, schema, bad))
    assert [x.count() for x in feeds.check_shape(both, feed)] == [1, 1]


def test_feed_entries_and_fallback(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://a/1</link><description>S</description></item><item><guid>g</guid><title>U</title></item></channel></rss>")
    got = {r.guid: r for r in feeds.read_rss(spark, str(tmp_path / "f.xml")).collect()}
    assert got["http://a/1"].summary == "S" and got["g"].link == "" and len(got["g"].fingerprint) == 64
    df = spark.createDataFrame([("s", "g", "t", "l", None, "sum", None), ("s", "h", "t", "l", "page", "sum", None)], "source_id string, guid string, title string, link string, page_text string, summary string, published_at string")
    rows = {r.guid: (r.cleaned_text, r.is_fallback_content) for r in feeds.article_rows(df).collect()}
    assert rows == {"g": ("sum", True), "h": ("page", False)}
    with pytest.raises(ValueError, match="lacks"):
        feeds.source_registry(spark, "- source_id: a\n  name: b\n")


def test_versions_compare_by_number(spark):
    df = spark.createDataFrame([("e", "9.1"), ("e", "14.0"), ("e", "14.x"), ("m", "1.0")], "domain string, version string")
    latest = stix.latest_versions(df)
    assert {r.domain: r.version for r in latest.collect()}["e"] in ("14.0", "14.x")
    assert [r.domain for r in stix.due(latest, spark.createDataFrame([("m", "1.0")], "domain string, version string")).collect()] == ["e"]


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("Tue, 02 Jan 2024 03:04:05 +0000",), ("Tue, 02 Jan 2024 03:04:05 GMT",), ("2024-01-02T03:04:05",), ("soon",), (None,)], "t string")
    got = [r.t for r in df.select(F.unix_seconds(tx.parse_time(F.col("t"))).alias("t")).collect()]
    assert got == [1704164645] * 4 + [None, None]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 2}", f"g{i % 3}", i, f"f{(i // 6) % 2}", i % 4 != 0) for i in range(30)]
    schema = "source_id string, guid string, seq long, fingerprint string, ok boolean"
    df = spark.createDataFrame(rows, schema)
    df.where("seq < 15").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("seq >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = polls.changes(stream.select("source_id", "guid", "seq", "fingerprint")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    cols = ("source_id", "guid", "seq", "event_type")
    got = {tuple(r[c] for c in cols) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r[c] for c in cols) for r in graph.detect_changes(df).collect()}


def test_node_sink_repeats_safely(spark, tmp_path):
    write = polls.node_sink(str(tmp_path / "n"), ["k"], ["v"])
    one = spark.createDataFrame([("a", "1", 0), ("b", "1", 1)], "k string, v string, seq long")
    two = spark.createDataFrame([("a", "2", 2)], "k string, v string, seq long")
    for number, batch in ((0, one), (1, two), (1, two)):
        write(batch, number)
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "n/v=1")).collect()} == {"a": "2", "b": "1"}


def test_page_text(spark):
    html = "<html><head><style>p{}</style><script>var a = '<p>no</p>';</script></head><body><nav><p>menu</p></nav><h1>Title &amp; more</h1><p>One <b>bold</b>\n  line</p><P class='x'>Two</P><div>not a block</div><ul><li>item</li></ul><footer><p>end</p></footer></body></html>"
    rows = spark.createDataFrame([(html,), ("no tags",), ("",), (None,), ("<p>&lt;p&gt; &quot;q&quot;&nbsp;</p>",)], "h string").select(feeds.page_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in rows] == ["Title & more\nOne bold line\nTwo\nitem", None, None, None, '<p> "q" ']


def test_poll_backoff(spark):
    assert [r.x for r in spark.range(4).select(tx.poll_backoff(F.col("id")).alias("x")).collect()] == pytest.approx([0.1, 0.2, 0.4, 0.8])
