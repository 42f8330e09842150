"""Relations of changed stories: a provider is asked about texts that weren't asked about before, and what it said is kept by the text's hash.

The cache is a ``StateTable`` whose row is a text: its relations between entity keys, perhaps none. A batch reads and writes the
buckets of its texts only. Whatever a relation's source is, this batch or an earlier one, it counts for a story only if both its ends
are entities that the story has now and that weren't rejected; their kinds are those they have there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.operators.relations import cache_misses, map_relations
from loomwatch.shared import remove, written
from loomwatch.streaming.messages import ENTITY
from loomwatch.streaming.tables import StateTable

RELATION = "struct<key_a: string, key_b: string, relationship: string, polarity: string, strength: double>"
CACHE = f"content_hash string, relations array<{RELATION}>"
#: [(text, [(key, kind), ...]), ...] -> for each a list of {"entity_a", "entity_b", "relationship", "polarity", "assertion_strength"}.
Provider = Callable[[list[tuple[str, list[tuple[str, str]]]]], list[list[dict]]]
POLARITIES = ("asserted", "hedged", "negated")


def cache_table(spark: SparkSession, path: str, buckets: int = 64) -> StateTable:
    return StateTable(spark, path, CACHE, ["content_hash"], buckets=buckets)


def checked(answer: object, keys: set[str]) -> list[dict]:
    """The sound relations of an answer: two different entities that were offered, a label, a known polarity ('asserted' if none is given), a strength from 0 to 1."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    out = []
    for r in answer if isinstance(answer, (list, tuple)) else ():
        if not isinstance(r, dict):
            continue
        a, b, label, strength, polarity = (r.get(k) for k in ("entity_a", "entity_b", "relationship", "assertion_strength", "polarity"))
        polarity = "asserted" if polarity is None else polarity
        if isinstance(a, str) and isinstance(b, str) and a in keys and b in keys and a != b and isinstance(label, str) and number(strength) and 0 <= strength <= 1 and polarity in POLARITIES:
            out.append({"key_a": a, "key_b": b, "relationship": label, "polarity": polarity, "strength": float(strength)})
    return out


def ask(texts: DataFrame, provider: Provider, size: int = 8) -> DataFrame:
    """(content_hash, relations, reason): what a provider says of each text, or why it has no answer. texts: (content_hash, text, entities); asked in tasks, ``size`` a call, and
    one by one where a call fails or doesn't answer all."""
    out = T.StructType([*T.StructType.fromDDL(CACHE), T.StructField("reason", T.StringType())])

    def call(items: list[tuple[str, list[tuple[str, str]]]]) -> list[object]:
        try:
            answers = list(provider(items))
            if len(answers) != len(items):
                raise ValueError(f"{len(answers)} answers to {len(items)} texts")
            return answers
        except Exception as e:  # whatever the provider raises
            return [call([x])[0] for x in items] if len(items) > 1 else [e]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            rows = batch.to_pylist()
            items = [(r["text"] or "", [(e["canonical_node_key"], e["entity_type"]) for e in r["entities"] or ()]) for r in rows]
            answers = [a for at in range(0, len(items), size) for a in call(items[at : at + size])]
            made, why = [], []
            for (_, entities), answer in zip(items, answers, strict=True):
                good = isinstance(answer, (list, tuple))
                made.append(checked(answer, {k for k, _ in entities}) if good else None)
                why.append(None if good else f"{type(answer).__name__}: {answer}"[:200] if isinstance(answer, Exception) else "no list of relations")
            yield pa.RecordBatch.from_arrays([pa.array([r["content_hash"] for r in rows], pa.string()), pa.array(made, schema.field(1).type), pa.array(why, pa.string())], schema=schema)

    return texts.select("content_hash", "text", "entities").mapInArrow(run, out)


def infer_relations(stories: DataFrame, cache: StateTable, provider: Provider, number: int | None = None, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """(edges, failures) of changed stories. edges: as ``map_relations`` gives them, with cluster_id; failures: (content_hash, reason), which are asked about again when
    such a text comes next.

    stories: (cluster_id, content_hash, text, entities array<ENTITY>), the text being that of the representative."""
    entities = F.filter("entities", lambda e: (e["resolution_status"] != "rejected") & (e["canonical_node_key"] != ""))
    known = written(stories.where("content_hash IS NOT NULL").select("cluster_id", "content_hash", "text", F.coalesce(entities, F.array()).cast(f"array<{ENTITY}>").alias("entities")), "relation-stories")
    hashes = known.select("content_hash").distinct()
    said = written(ask(cache_misses(known.select("content_hash", "text", "entities"), cache.get(hashes)), provider, size), "relation-answers")  # a text is asked about once
    cache.put(said.where("reason IS NULL").select("content_hash", "relations"), number)
    rel = known.select("cluster_id", "content_hash", "entities").join(cache.get(hashes), "content_hash").select("cluster_id", "entities", F.posexplode("relations").alias("at", "r"))
    kind = lambda key: F.get(F.filter("entities", lambda e: e["canonical_node_key"] == F.col(key)), F.lit(0))["entity_type"]
    rel = rel.select("cluster_id", F.concat_ws("|", "cluster_id", "at").alias("relation_id"), "r.*", "entities").withColumns({"type_a": kind("key_a"), "type_b": kind("key_b")})
    mapped = map_relations(rel.where("type_a IS NOT NULL AND type_b IS NOT NULL").drop("entities"))
    edges = written(mapped.withColumn("cluster_id", F.regexp_replace("relation_id", r"\|\d+$", "")), "relation-edges")
    failures = said.where("reason IS NOT NULL").select("content_hash", "reason")
    remove(known)
    return edges, failures
