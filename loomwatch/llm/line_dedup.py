"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped if an earlier line of the corpus, in order of (doc_id, line number), equals
it or is at most one edit (insert, delete or replace a character) away. Lines shorter than
``min_chars`` stay.

Two lines that are one edit apart meet in the deletion neighbourhood: either one of them is
the other without a character, or both become the same string when the character at the same
place is deleted. So lines emit, as 64-bit keys, the variants that deleting each place leaves,
with the place (replacements) and without it (insertions, which meet the whole shorter line).
All lines of a key with a place are within one edit of each other, and in a key without one
each is within one edit of the whole line. The earliest line of a key is therefore enough:
keys are aggregated, not joined in pairs, so a key that any number of lines share costs one
row a task. The found pairs' texts are joined back and ``levenshtein`` verifies them, so a hash
collision drops nothing.

Equal lines are aggregated first. Variants are emitted, without loss, only inside one block of
a line (half a line; less of long ones), and only if all that is outside the block is shared
with another distinct line: one edit leaves all blocks but one as they are.

Cases: a null text has no lines; an empty table gives an empty result; rows that repeat an id
with another text are ordered by a hash of the text, rows that repeat both are one document,
so none drops the other's lines; a null id comes first; other columns aren't read, or are
passed through by ``drop_lines``. ``levenshtein`` and places count
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.shared import settled, written

MIN_CHARS = 24
#: Lines of up to so many characters are cut into two blocks.
TWO_BLOCKS = 1024
#: Bytes of a table that may be broadcast; larger ones are joined by a shuffle.
FEW = 32 << 20


def _doc(id_col: str, text_col: str) -> Column:
    """Names a document; also tells apart rows that repeat an id with another text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once; the optimizer would copy it into each loop and behind each generator otherwise."""
    return F.get(F.transform(F.array(value), use), 0)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, no, line, n) of all lines. The generator makes all that depends on the text, so that its output rows don't carry it."""

    def entries(t: Column) -> Column:
        return F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(t.alias("t"), i.alias("no"), x.alias("line"), F.length(x).alias("n")))

    exploded = docs.select(F.col(id_col).alias("id"), F.explode(_bind(F.xxhash64(text_col), entries)).alias("e"))
    return exploded.select(F.struct("id", "e.t").alias("doc"), "e.no", "e.line", "e.n")


def _blocks(m: Column) -> Column:
    """Into how many blocks a line of m characters is cut: two, and more for long ones, so that neither blocks nor their number grow large."""
    return F.when(m <= TWO_BLOCKS, 2).otherwise(F.ceil(F.sqrt(m.cast("double")) / 8)).cast("int")


def _block(m: Column, i: Column) -> tuple[Column, Column]:
    """Begin and end of the i-th block of m characters."""
    i, count = i.cast("long"), _blocks(m).cast("long")
    return (i * m / count).cast("int"), ((i + 1) * m / count).cast("int")


def _frames(line: Column, n: Column) -> Column:
    """Keys of a line without one block, for each block.

    Of two lines one edit apart, of which the shorter has m characters, all is equal before
    and behind the block, cut by m, in which the edit is. A line of n characters may be the
    shorter (m = n) or the longer one (m = n - 1): first come the keys for the former.
    """

    def of(m: Column) -> Column:
        def key(i: Column) -> Column:
            a, b = _block(m, i)
            rest = m - b
            return F.xxhash64(m, i, F.substring(line, F.lit(1), a), F.substring(line, n - rest + 1, rest))

        return F.transform(F.sequence(F.lit(0), _blocks(m) - 1), key)

    def halves(m: Column) -> list[Column]:
        half = F.shiftright(m, 1)
        return [F.xxhash64(m, F.lit(0), F.lit(""), F.substring(line, n - m + half + 1, m - half)), F.xxhash64(m, F.lit(1), F.substring(line, F.lit(1), half), F.lit(""))]

    # The usual case, two blocks, without a loop.
    return F.when(n <= TWO_BLOCKS, F.array(*halves(n), *halves(n - 1))).otherwise(F.concat(of(n), of(n - 1)))


def find_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """(doc, no, first_doc, first_no) of each line to drop and of the earliest line that it repeats. max_edits: 0 or 1."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = _lines(docs, id_col, text_col).where(F.col("n") >= min_chars)
    place = F.struct("doc", "no")
    # Of each distinct line its earliest place. Two hashes name a line.
    named = lines.select("doc", "no", "line", "n", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"))
    firsts = named.select("h", "h2", place.alias("at"), "n", _frames(F.col("line"), F.col("n")).alias("frames"))
    firsts = written(firsts.groupBy("h", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("frames").alias("frames")), "lines")
    twice = firsts.where("rows > 1").select("h", "h2", "at", F.lit(None).cast(firsts.schema["at"].dataType).alias("to"))
    if max_edits == 1:
        links = _links(docs, id_col, text_col, firsts)
        linked = firsts.join(links, "at").select("h", "h2", "at", "to")
        twice = twice.join(links, "at", "left_anti").select("h", "h2", "at", "to").unionByName(linked)
    # A line goes if its text occurs earlier, or if the first line of that text has an earlier neighbour.
    out = named.select("doc", "no", "h", "h2").join(twice, ["h", "h2"]).where((place > F.col("at")) | F.col("to").isNotNull())
    to = F.coalesce("to", "at")
    return out.select("doc", "no", to["doc"].alias("first_doc"), to["no"].alias("first_no"))


def _small(df: DataFrame, row: int, items: str | None = None) -> DataFrame:
    """A written table, to be broadcast if it is small: its bytes are reckoned first, from those of a row and 8 for each of its ``items``."""
    size = df.agg(F.sum(F.lit(row) + (8 * F.size(items) if items else 0))).first()[0] or 0
    return F.broadcast(df) if size <= FEW else df


def _few(df: DataFrame, name: str, row: int, items: str | None = None) -> DataFrame:
    return _small(written(df, name), row, items)


def _links(docs: DataFrame, id_col: str, text_col: str, firsts: DataFrame) -> DataFrame:
    """(at, to) of distinct lines: the places of a line and of its earliest neighbour by one edit, if that is earlier."""
    frames = firsts.select(F.posexplode("frames").alias("x", "f"), "h", "at", "n")
    shared = _few(frames.select("f", "h").groupBy("f").agg(F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").select("f"), "frames", 32)
    near = written(frames.join(shared, "f").select("f", "x", "n", "at"), "near")
    # The texts come from their documents; only these documents' lines are made again.
    wanted = _few(near.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_set("at.no").alias("nos")), "wanted", 100, "nos")
    texts = docs.select(_doc(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc")
    cut = texts.select("doc", F.explode(_bind(F.split("text", "\n"), lambda x: F.transform("nos", lambda i: F.struct(i.alias("no"), F.get(x, i).alias("line"))))).alias("e"))
    lines = written(cut.select(F.struct("doc", "e.no").alias("at"), "e.line").dropDuplicates(["at"]), "near")
    # Each row makes many variants, so that few rows are dealt to all tasks.
    near = near.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f", "at")
    # x numbers the frames: those of m = n first. The segment is the block that the frame leaves out.
    count = _blocks(F.col("n"))
    near = near.join(lines, "at").withColumn("shorter", F.col("x") < count).withColumn("m", F.col("n") - F.when(F.col("shorter"), 0).otherwise(1))
    a, b = _block(F.col("m"), F.col("x") - F.when(F.col("shorter"), 0).otherwise(count))
    seg = F.substring("line", a + 1, b - a + F.col("n") - F.col("m"))

    def variants(s: Column) -> Column:
        text, size, f = s["text"], s["size"], F.col("f")

        def without(p: Column) -> Column:
            return F.concat(F.substring(text, F.lit(1), p - 1), F.substring(text, p + 1, size))

        places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        # Of the shorter line the whole segment, and what deleting a place leaves, with the place; of the longer one what deleting a place leaves.
        kept = F.concat(
            F.array(F.struct(F.lit(0).alias("kind"), F.xxhash64(f, F.lit(0), text).alias("v"))),
            F.transform(places, lambda p: F.struct(F.lit(2).alias("kind"), F.xxhash64(f, p, without(p)).alias("v"))),
        )
        gone = F.transform(places, lambda p: F.struct(F.lit(1).alias("kind"), F.xxhash64(f, F.lit(0), without(p)).alias("v")))
        return F.when(F.col("shorter"), kept).otherwise(gone)

    made = _bind(seg, lambda x: _bind(F.struct(x.alias("text"), F.length(x).alias("size")), variants))
    keyed = near.select("at", F.explode(made).alias("k")).select("at", "k.kind", "k.v")
    # The earliest line of a key links all later ones: for replacements any of them, else the whole line with those that became it.
    best = (
        keyed.groupBy("v")
        .agg(F.min("at").alias("least"), F.max("at").alias("most"), F.min(F.when(F.col("kind") == 0, F.col("at"))).alias("whole"), F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("cut"))
        .where("least <> most")
    )
    earlier = F.when(F.col("kind") == 2, F.col("least")).when(F.col("kind") == 0, F.col("cut")).otherwise(F.col("whole"))
    pairs = keyed.join(_few(best, "keys", 200), "v").select("at", earlier.alias("to")).where("to < at").groupBy("at").agg(F.min("to").alias("to"))
    left = lines.withColumnRenamed("line", "a")
    right = lines.select(F.col("at").alias("to"), F.col("line").alias("b"))
    return pairs.join(left, "at").join(right, "to").where(F.levenshtein("a", "b", 1) >= 0).select("at", "to")


def _with_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, max_edits: int) -> DataFrame:
    """(_row, _text, _lines): docs' columns by number, the text, and n_lines, n_kept and the text of the lines that are kept."""
    gone = settled(lambda: find_duplicate_lines(docs, id_col, text_col, min_chars, max_edits).groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("no").alias("_gone")), "gone")
    gone = _small(gone, 100, "_gone")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
    joined = docs.select(row, F.col(text_col).alias("_text"), _doc(id_col, text_col).alias("_key")).join(gone, F.col("_key") == F.col("_doc"), "left")

    def kept(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_gone")
        left = F.when(F.col("_gone").isNull(), x).otherwise(F.transform(stay, lambda i: F.get(x, i)))
        return _bind(left, lambda y: F.struct(F.size(x).alias("n_lines"), F.size(y).alias("n_kept"), F.array_join(y, "\n").alias("text")))

    return joined.select("_row", "_text", _bind(F.split("_text", "\n"), kept).alias("_lines"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """The documents without lines that repeat earlier ones; a document that loses all its words is dropped."""
    found = _with_lines(docs, id_col, text_col, min_chars, max_edits)
    text = F.col("_lines.text")
    stays = F.col("_text").isNull() | (F.col("_lines.n_lines") == F.col("_lines.n_kept")) | text.rlike(r"[^\x20\x09-\x0D]")
    return found.where(stays).select(*[(F.when(F.col("_text").isNotNull(), text) if c == text_col else F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line of the corpus, up to one edit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = _with_lines(docs, "doc_id", "text", MIN_CHARS, 1).withColumn("null", F.col("_text").isNull())
    size = lambda c: F.when(F.col("null"), 0).otherwise(F.col(f"_lines.{c}")).cast("long").alias(c)
    return found.select(F.col("_row.c0").alias("doc_id"), size("n_lines"), size("n_kept"), F.sha2(F.when(F.col("null"), "").otherwise(F.col("_lines.text")), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and documents that consist of them."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL = {
    "op10_line_dedup": """
WITH l AS (
  SELECT doc_id, i AS no, w[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
), f AS (SELECT line, min((doc_id, no)) AS pos FROM l WHERE length(line) >= 24 GROUP BY line
), v AS (SELECT line, pos, p, substr(line, 1, p - 1) || substr(line, p + 1) AS s FROM f, LATERAL (SELECT unnest(range(1, length(line) + 1)) AS p)
), g AS (
  SELECT a.line FROM v a JOIN v b ON a.s = b.s AND a.p = b.p AND b.pos < a.pos
  UNION SELECT v.line FROM v JOIN f ON v.s = f.line AND f.pos < v.pos
  UNION SELECT f.line FROM v JOIN f ON v.s = f.line AND v.pos < f.pos
), k AS (
  SELECT l.*, NOT (length(l.line) >= 24 AND ((l.doc_id, l.no) > f.pos OR g.line IS NOT NULL)) AS kept
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN g ON g.line = l.line
)
SELECT d.doc_id, count(k.no)::BIGINT AS n_lines, (count(*) FILTER (WHERE k.kept))::BIGINT AS n_kept,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.no) FILTER (WHERE k.kept), '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""
}
