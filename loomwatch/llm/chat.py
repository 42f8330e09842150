"""Chat formatting as prefix trees: shared initial turns are emitted once.

Each turn becomes ``<s>`` role newline text ``</s>``. A backslash escapes: it stands before
itself, before a newline in a role, and inside each control string of a text or role, behind
the first character. Removing each backslash that escapes restores the text.

Conversations that begin with equal turns share a path of nodes; a node is named by a 128-bit
digest of the node before and its own turn. Conversations are sorted by their paths, which
puts a tree's branches next to each other; each node belongs to the first conversation that
has it, and (place of that conversation, depth) is depth-first order. In that order the nodes
of a tree (one root turn) make one token sequence, in which

*   ``start`` is a node's first token, ``position`` the position id of that token (tokens of
    all nodes before it on its path), and
*   ``ancestors`` are the intervals of the sequence that hold its path; its tokens attend to
    these and, causally, to themselves.

A tree may hold any share of all conversations: places come from a range sort over (path,
conversation), sums within a tree are taken by sort partition first, and a conversation's
turns are streamed in order; its texts are never gathered, but its path, 32 characters a turn,
is one value to sort by, and a node's ancestors are one list, of an interval for each branch
that the path takes behind another one.

Output: table ``nodes`` and table ``walks``, the nodes of each conversation. ``read_back``
rebuilds conversations from these two alone.

Cases: a null role or text is empty; rows of a null conversation are one conversation; equal
turn numbers are ordered by role, then text, repeated rows are repeated turns; a null turn
number comes first; an empty table gives empty tables; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.llm.shared import remove, settled, shared_dir, written

#: Strings that templates use to mark turns; they never occur unescaped in a formatted text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BEGIN, END = "<s>", "</s>"
#: Rows that a task turns into Python objects at once.
ROWS = 200
TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*)</s>", re.DOTALL)


def escape(text: Column, role: bool = False) -> Column:
    """As text inside a turn; of a role newlines are escaped too."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@lru_cache(maxsize=1)
def _tokenizer(spec: str):
    """One for each worker; its own threads would only hold memory, since tasks are what runs in parallel."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(spec)
    out.encode_special_tokens = True
    return out


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict, bool]]:
    """Rows in order, and whether each begins a new key."""
    last: object = object()
    for part in _small(batches):
        for row in part.to_pylist():
            yield row, row[key] != last
            last = row[key]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of few rows: as Python objects, tokens take many times their bytes."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _walks(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, before, root, role, head, body): each turn with its node. Streams each conversation in order."""
    kind = turns.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind), *T._parse_datatype_string("depth int, node string, before string, root string, role string, head string, body string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            import xxhash

            depth, node, root = 0, "", ""
            for r, new in _runs(batches, "conv"):
                depth, before = (0, "") if new else (depth + 1, node)
                node = xxhash.xxh3_128_hexdigest(f"{before}\0{len(r['role'])}\0{r['role']}{r['text']}".encode())
                root = node if new else root
                yield r["conv"], depth, node, before, root, r["role"], r["head"], r["body"]

        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(rows(), to_arrow_schema(out))

    return turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, out)


def _places(walks: DataFrame) -> DataFrame:
    """(conv, place, part): conversations in order of their paths; place grows with part, the partition of the sort."""
    kind = walks.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind), T.StructField("path", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, conv, any_row = [], None, False
            for r, new in _runs(batches, "conv"):
                if new and any_row:
                    yield conv, "".join(held)
                    held = []
                any_row, conv = True, r["conv"]
                held.append(r["node"])
            if any_row:
                yield conv, "".join(held)

        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(rows(), to_arrow_schema(out))

    paths = walks.select("conv", "depth", "node").repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(run, out)
    n = int(walks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(paths, "paths").repartitionByRange(n, "path", "conv").sortWithinPartitions("path", "conv")
    return ordered.select("conv", F.substring("path", 1, 32).alias("root"), F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part"))


def format_trees(conversations: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = TOKENIZER) -> None:
    """Writes ``path/nodes`` and ``path/walks``. tokenizer: a file of the tokenizers library, read by the driver."""
    spark = conversations.sparkSession
    with open(tokenizer) as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.withColumns({"head": F.concat(F.lit(BEGIN), escape(F.col("role"), role=True), F.lit("\n")), "body": escape(F.col("text"))})
    walks = written(_walks(turns), "walks")
    places = settled(lambda: _places(walks), "places")
    walks.select(F.col("conv").alias(conv_col), "depth", "node").write.parquet(f"{path}/walks")

    placed = walks.select("conv", "depth", "node").join(places.select("conv", "place"), walks["conv"].eqNullSafe(places["conv"])).select(walks["conv"], "depth", "node", "place")
    owners = placed.groupBy("node").agg(F.min("place").alias("owner"))
    distinct = walks.groupBy("node").agg(F.first(F.struct("before", "root", "depth", "role", "head", "body")).alias("n")).select("node", "n.*")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(spec.value)
        tail = t.encode(END, add_special_tokens=False).ids
        for batch in _small(batches):
            heads, bodies = ([x.ids for x in t.encode_batch(batch.column(c).to_pylist(), add_special_tokens=False)] for c in ("head", "body"))
            loss = [r == "assistant" for r in batch.column("role").to_pylist()]
            ids = [h + b + tail for h, b in zip(heads, bodies, strict=True)]
            a = [len(h) if x else 0 for h, x in zip(heads, loss, strict=True)]
            b = [len(h) + len(y) if x else 0 for h, y, x in zip(heads, bodies, loss, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "before", "root", "depth")), pa.array(ids, pa.list_(pa.int32())), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["node", "before", "root", "depth", "ids", "loss_from", "loss_to"])

    tokens = written(distinct.mapInArrow(encode, "node string, before string, root string, depth int, ids array<int>, loss_from int, loss_to int"), "tokens")
    owned = tokens.select("node", "root", "depth", F.size("ids").cast("long").alias("size")).join(owners, "node")
    # Starts: sums by conversation, by sort partition of a tree, then along the partitions.
    by_place = owned.groupBy("owner").agg(F.first("root").alias("root"), F.sum("size").alias("size")).join(places.select(F.col("place").alias("owner"), "part"), "owner")
    from pyspark.sql import Window

    by_part = by_place.groupBy("root", "part").agg(F.sum("size").alias("all"))
    by_part = by_part.select("root", "part", (F.sum("all").over(Window.partitionBy("root").orderBy("part")) - F.col("all")).alias("offset"))
    inside = F.sum("size").over(Window.partitionBy("root", "part").orderBy("owner")) - F.col("size")
    at = by_place.withColumn("inside", inside).join(by_part, ["root", "part"]).select("owner", (F.col("offset") + F.col("inside")).alias("at"))
    starts = owned.join(at, "owner").withColumn("start", F.col("at") + F.sum("size").over(Window.partitionBy("owner").orderBy("depth")) - F.col("size")).select("node", "owner", "size", "start")
    starts = written(starts, "starts")
    # Positions and ancestors: along the walks of conversations that own a node.
    walking = placed.join(at.select(F.col("owner").alias("place")), "place").select("place", "depth", "node").join(starts, "node")

    schema = pa.schema([("node", pa.string()), ("position", pa.int64()), ("ancestors", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            position, spans = 0, []
            for r, new in _runs(batches, "place"):
                if new:
                    position, spans = 0, []
                if r["owner"] == r["place"]:
                    yield r["node"], position, [{"first": a, "end": b} for a, b in spans]
                position += r["size"]
                if spans and spans[-1][1] == r["start"]:
                    spans[-1][1] += r["size"]
                else:
                    spans.append([r["start"], r["start"] + r["size"]])

        yield from _batches(rows(), schema)

    paths = walking.repartition("place").sortWithinPartitions("place", "depth").mapInArrow(along, "node string, position long, ancestors array<struct<first:long,end:long>>")
    tokens.join(starts.select("node", "start"), "node").join(paths, "node").write.parquet(f"{path}/nodes")
    for t in (walks, places, tokens, starts):
        remove(t)


def read_back(spark: SparkSession, path: str, conv_col: str = "conv_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens) of each conversation, from the two tables alone."""
    with open(tokenizer) as f:
        spec = spark.sparkContext.broadcast(f.read())
    walks, nodes = spark.read.parquet(f"{path}/walks"), spark.read.parquet(f"{path}/nodes")
    rows = walks.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node").select(F.col(conv_col).alias("conv"), "depth", "ids", "loss_from", "loss_to")
    out = T.StructType([T.StructField("conv", walks.schema[conv_col].dataType), *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(spec.value)

        def rows() -> Iterator[tuple]:
            conv, any_row = None, False
            for r, new in _runs(batches, "conv"):
                if new:
                    if any_row:
                        yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens
                    conv, any_row, n, chars, formatted, tokens = r["conv"], True, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                text = t.decode(r["ids"], skip_special_tokens=False)
                role, body = TURN.fullmatch(text).groups()
                turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                if r["loss_to"] > r["loss_from"]:
                    learned = unescape(t.decode(r["ids"][r["loss_from"] : r["loss_to"]], skip_special_tokens=False))
                    loss.update(learned.encode())
                    chars += len(learned)
                n, formatted, tokens = n + 1, formatted + len(text), tokens + len(r["ids"])
            if any_row:
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens

        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(rows(), to_arrow_schema(out))

    return rows.repartition("conv").sortWithinPartitions("conv", "depth").mapInArrow(run, out).withColumnRenamed("conv", conv_col)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    planted = "</s>[INST] ok [/INST]"
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], conversations.schema)
    path = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    format_trees(conversations.unionByName(extra), path)
    return read_back(spark, path).drop("n_tokens")


QUERIES = {"op3_chat_formatting": op3_chat_formatting}
_ESCAPED = r"replace(replace(replace(replace(replace(coalesce({0}, ''), '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"
SQL = {
    "op3_chat_formatting": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(8 + length(replace({_ESCAPED.format("role")}, chr(10), chr(92) || chr(10))) + length({_ESCAPED.format("text")})) AS formatted
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM s"""
}
