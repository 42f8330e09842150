"""Links between articles of one story, found without a table of all pairs that share an entity.

The links join the same articles into the same stories as all candidate pairs whose score (``stories.score``)
reaches the threshold do; a link itself may stand for others. How that is done:

*   Articles with the same entities and wording (simhash) are one profile. Two of them link whenever they are
    near enough in time, so those of one time cell are linked to one of them, and from cell to cell the last
    article to the first of the next one. A cell of a profile, with its first and last time, is one row from
    here on, however many copies of an article there are. Articles with equal texts but other entities are
    linked in the same way by each entity they share.
*   Two profiles can reach the threshold only with enough entities in common, so each emits keys for the rarest
    of its entities only: at a key behind which r of n entities are left, the shares of both have at most r in
    common. The bound on the Jaccard index that this gives is a bound on how many bits of the simhashes may
    differ as well; where a frequent key leaves few, it is emitted once for each of ``BANDS`` bands of the
    simhash, one of which must be equal. Time, wording and the numbers of entities are compared before the
    entities themselves, all within the join.
*   In the same cell of two profiles only bounds on the times apart are known. Those cells whose articles the bounds
    don't decide are compared article by article.

What is left of a frequent key are articles with three entities or fewer: their Hamming bound is too wide for bands,
so they meet within the key and its time span, in blocks (``meetings``) that numpy compares by the bits that differ. A task joins what links
as it goes, doesn't compare what it has joined, and gives a row for each article that it joined, not for each pair. Where a key has several
parts, those are joined within themselves first, and the links between parts are looked for between what that leaves apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.operators import meetings, stories
from loomwatch.operators.components import components
from loomwatch.shared import remove, written

#: Time cells a window is cut into.
CELLS = 24
#: Keys of more rows are frequent: rows meet in bands of their simhashes where at most ``BANDS`` - 1 bits may differ.
FREQUENT, BANDS = 200, 8
#: Units of a part of a frequent key, rows of a block that are compared at once, and pairs that a task compares.
PART, ROWS, TASK_PAIRS = 8192, 128, 1_000_000_000
HOUR = 3_600_000_000


def profiles(entities: DataFrame, articles: DataFrame, hashes: DataFrame, hours: float) -> DataFrame:
    """(article_id, t, content_hash, keys, n_blocking, simhash, profile, cell) of dated articles with a blocking entity."""
    blocking = F.col("entity_type").isin(*stories.BLOCKING)
    marked = entities.select("article_id", F.concat_ws("|", "entity_type", "node_key").alias("key"), blocking.alias("b"))
    keys = marked.groupBy("article_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set(F.when(F.col("b"), F.col("key")))).alias("blocking")).where(F.size("blocking") > 0)
    dated = articles.where("published_at IS NOT NULL").select("article_id", F.unix_micros("published_at").alias("t"), "content_hash")
    rows = dated.join(keys, "article_id").join(hashes.select("article_id", "simhash"), "article_id", "left")
    profile = F.sha2(F.concat_ws("\n", F.concat_ws("\t", "keys"), F.coalesce(F.col("simhash").cast("string"), F.lit("-"))), 256)
    return rows.withColumns({"profile": profile, "cell": F.floor(F.col("t") / (hours * HOUR / CELLS))})


def _chained(rows: DataFrame, group: list[str], link: Callable[[Column], Column]) -> DataFrame:
    """(a, b): links within groups of rows (article_id, t, cell, ...), whose articles link by the time between them alone.

    Articles of a cell all link to its first one, and the last of a cell to the first of the next. link: whether so many microseconds
    do, of the group's columns; those of a cell's width must."""
    first = F.struct("t", "article_id")
    cells = rows.groupBy(*group, "cell").agg(F.min(first).alias("first"), F.max(first).alias("last"))
    star = rows.join(cells.select(*group, "cell", F.col("first.article_id").alias("b")), [*group, "cell"]).select(F.col("article_id").alias("a"), "b")
    w = Window.partitionBy(*group).orderBy("cell")
    chain = cells.withColumn("before", F.lag("last").over(w)).where(link(F.col("first.t") - F.col("before.t")))
    return star.unionByName(chain.select(F.col("before.article_id").alias("a"), F.col("first.article_id").alias("b"))).where("a <> b")


def _units(rows: DataFrame) -> DataFrame:
    """A row for each cell of a profile, named by its first article: (unit, profile, first, last, keys, blocking, simhash); a profile is named by its first unit."""
    some = lambda c: F.first(c).alias(c)  # noqa: E731  the same in all of a profile's rows
    units = rows.groupBy("profile", "cell").agg(F.min_by("article_id", F.struct("t", "article_id")).alias("unit"), F.min("t").alias("first"), F.max("t").alias("last"), some("keys"), some("blocking"), some("simhash"))
    return units.withColumn("profile", F.min("unit").over(Window.partitionBy("profile"))).drop("cell")


def _emitted(units: DataFrame, threshold: float) -> DataFrame:
    """(unit, key, left, n, freq, token, strict): the keys that a unit may meet others by."""
    a, b, c = stories.WEIGHTS
    keys = units.select("unit", F.explode("blocking").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("freq"))
    # Rarest first; the entities that nothing is met by come last, as all of a pair's first common keys are blocking ones.
    ranked = keys.join(counts, "key").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("order"))
    rows = units.select("unit", "simhash", F.size("keys").alias("n")).join(ranked, "unit").select("unit", "simhash", "n", F.posexplode("order").alias("at", "k"))
    rows = rows.select("unit", "simhash", "n", (F.col("n") - F.col("at")).alias("left"), "k.freq", "k.key")
    least_hamming = (F.lit(threshold) - c - a * F.col("left") / F.col("n")) / b - 1e-9  # 1 minus the share of bits that differ
    rows = rows.withColumn("need", least_hamming).where("need <= 1")
    bits = F.floor(64 * (1 - F.col("need")))
    frequent = (F.col("freq") > FREQUENT) & F.col("simhash").isNotNull()
    width = 64 // BANDS
    bands = F.array(*[F.shiftrightunsigned("simhash", i * width).bitwiseAND((1 << width) - 1) + (i + 1) * (1 << width) for i in range(BANDS)])
    rows = rows.withColumn("strict", frequent & (bits < BANDS))
    # A strict row meets all by its bands; so those of a key with strict rows that aren't strict have bands as well, to be met by.
    met = rows.where("strict").select("key", F.lit(True).alias("by_bands")).distinct()
    plain = F.array(F.lit(0).cast("long"))
    tokens = F.when(F.col("strict"), bands).when(frequent & F.col("by_bands"), F.concat(plain, bands)).otherwise(plain)
    return rows.join(met, "key", "left").select("unit", "key", "left", "n", "freq", "strict", F.explode(tokens).alias("token"))


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the rows x and y, pair by pair, got the lesser label of both."""
    into = np.arange(len(label))  # labels are less than the number of rows

    def root(i: int) -> int:
        while into[i] != i:
            into[i] = i = into[into[i]]
        return i

    for p, q in np.unique(np.stack([label[x], label[y]]), axis=1).T.tolist():
        p, q = root(p), root(q)
        into[max(p, q)] = min(p, q)
    while (into[into] != into).any():
        into = into[into]
    return into[label]


def _linked(table: pa.Table, hours: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """What ``_cross`` gives of one meeting, its rows by unit."""
    column = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    first, last, left, n = (column(c).astype(np.int64) for c in ("first", "last", "left", "n"))
    profile, strict, plain, known = meetings.codes(table["profile"]), column("strict"), column("token") == 0, table["simhash"].is_valid().to_numpy()
    bits = table["simhash"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    keys, names = meetings.Sets(table["keys"], table["key"]), table["group"].combine_chunks().dictionary_encode()
    group, units, label = names.indices.to_numpy(), table["unit"].combine_chunks(), names.indices.to_numpy()
    wa, wb, wc = stories.WEIGHTS
    near = lambda t: np.maximum(0.0, 1 - t / 3.6e9 / hours)

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bits each row of a may differ in from any of b."""
        most = np.minimum(left[a], left[b].max())
        rest = n[a] + n[b].min() - most
        jaccard = np.where(rest > most, most / np.maximum(rest, 1), 1.0)
        return np.clip(np.floor(64 * (1 - (threshold - wc - wa * jaccard) / wb) + 1e-6), -1, 64).astype(np.int8)

    def found(a: np.ndarray, b: np.ndarray, ok: np.ndarray, most_a: np.ndarray, most_b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(x, y, jaccard, hamming, sure) of those pairs of rows that link, or may. most: bits that a row may differ in."""
        apart = np.bitwise_count(bits[a][:, None] ^ bits[b][None, :]).view(np.int8)
        apart[~known[a]], apart[:, ~known[b]] = 64, 64  # as unlike as can be
        like = (apart <= most_a[:, None]) & (apart <= most_b[None, :])
        if np.count_nonzero(like) > like.size // 8:
            like &= ok & (label[a][:, None] != label[b][None, :])
        i, j = np.divmod(np.flatnonzero(like), len(b))
        due = ok[i, j] & (label[a[i]] != label[b[j]])
        i, j = i[due], j[due]
        x, y, h = a[i], b[j], 1 - apart[i, j] / 64
        # Times apart: of articles of different cells at least the gap between them; of one cell anything up to the whole.
        gap = np.maximum(first[y] - last[x], first[x] - last[y])
        total, most = n[x] + n[y], np.minimum(left[x], left[y])
        need = (threshold - wb * h - wc * near(np.maximum(gap, 0))) / wa - 1e-9  # of the Jaccard index
        keep = (profile[x] != profile[y]) & (plain[x] | strict[x] | strict[y]) & (gap <= hours * HOUR) & (most >= need * (total - most))
        x, y, h, gap = x[keep], y[keep], h[keep], gap[keep]
        (p, i), (q, j) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
        common = keys.common(p, q) if len(x) else None
        common = 1.0 + (0.0 if common is None else common[i, j])
        jaccard = common / (n[x] + n[y] - common)
        value = lambda t: wa * jaccard + wb * h + wc * near(t)
        whole = np.maximum(last[y] - first[x], last[x] - first[y])
        # Where the gap isn't negative it is that of two articles; else the times between are known by their bounds only.
        sure, keep = (gap >= 0) | ((whole <= hours * HOUR) & (value(whole) >= threshold)), value(np.maximum(gap, 0)) >= threshold
        return x[keep], y[keep], jaccard[keep], h[keep], sure[keep]

    def out(u: pa.Array, v: pa.Array, j: np.ndarray | None, h: np.ndarray | None, state: str) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.float64())
        return pa.RecordBatch.from_arrays([u, v, none if j is None else pa.array(j), none if h is None else pa.array(h), pa.array([state] * len(u), pa.string())], names=["u", "v", "j", "h", "state"])

    for a, b, ok in meetings.blocks(table, "unit", "met", "first"):
        most_a, most_b = bound(a, b), bound(b, a)
        for at in range(0, len(a), ROWS):
            rows, sizes = np.arange(at, min(at + ROWS, len(a))), np.bincount(label)
            large = sizes.argmax()  # rows of the largest label aren't compared with one another, if it has many
            one = (label[a[rows]] == large) & (sizes[large] > len(label) // 8)
            for some, columns in ((rows[one], np.flatnonzero(label[b] != large)), (rows[~one], np.arange(len(b)))):
                if not len(some) or not len(columns):
                    continue
                due = ok[some] if len(columns) == len(b) else ok[np.ix_(some, columns)]
                x, y, j, h, sure = found(a[some], b[columns], due, most_a[some], most_b[columns])
                if sure.any():
                    label = _joined(label, x[sure], y[sure])
                open_ = ~sure & (label[x] != label[y])
                if open_.any():
                    yield out(units.take(pa.array(x[open_])), units.take(pa.array(y[open_])), j[open_], h[open_], "some")
    held = np.zeros(len(names.dictionary), dtype=np.int64)
    held[group] = label  # of each group its label, which is the place of another group in the dictionary
    moved = np.nonzero(held != np.arange(len(held)))[0]
    yield out(names.dictionary.take(pa.array(moved)), names.dictionary.take(pa.array(held[moved])), None, None, "all")


def _cross(units: DataFrame, emitted: DataFrame, hours: float, threshold: float, crossed: bool) -> DataFrame:
    """(u, v, j, h, state) of units of two profiles and two groups: state is 'all' where some of their articles link for certain, 'some' where they may.

    units: with ``group``, an article that each is known to be of one story with. Where state is 'all', u and v are groups: a row for each group of a
    meeting that is joined with another. crossed: only between the parts of a key, or only within them."""
    span = int(hours * HOUR) + int(hours * HOUR / CELLS) + 1
    rows = emitted.drop("freq").join(units.select("unit", "profile", "group", "first", "last", "simhash", "keys"), "unit").withColumn("met", F.concat_ws("\x1f", "key", "token"))
    kind = units.schema["unit"].dataType.simpleString()
    groups = meetings.dealt(rows, "met", "unit", F.floor(F.col("first") / span), crossed, PART, TASK_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _linked(meetings.held(batches, "unit"), hours, threshold)

    return groups.applyInArrow(run, f"u {kind}, v {kind}, j double, h double, state string").distinct()


def story_links(entities: DataFrame, articles: DataFrame, hashes: DataFrame, hours: float = stories.HOURS, threshold: float = stories.THRESHOLD) -> DataFrame:
    """(a, b): links whose components are those of all candidate pairs that reach the threshold.

    entities: (article_id, entity_type, node_key); articles: (article_id, published_at, content_hash); hashes: (article_id, simhash).
    Articles without a date or a blocking entity link with none; a text without words has no simhash and counts as unlike any."""
    rows = written(profiles(entities, articles, hashes, hours), "story-profiles")
    a, b, c = stories.WEIGHTS
    if threshold > a + c * (1 - 1 / CELLS):
        raise ValueError("articles of a time cell wouldn't all link: the threshold is too high")
    near = lambda t: t <= hours * HOUR
    copies = _chained(rows.withColumn("h", F.when(F.col("simhash").isNotNull(), 1.0).otherwise(0.0)), ["profile", "h"], lambda t: near(t) & (stories.score(F.lit(1.0), F.col("h"), t / 3.6e9, F.lit(False), hours) >= threshold))
    # Equal texts with different entities link by each entity they share, and those whose likeness alone doesn't reach over the window.
    far = near(F.lit(int(hours * HOUR))) & (stories.score(F.lit(1.0), F.when(F.col("simhash").isNotNull(), 1.0).otherwise(0.0), F.lit(hours), F.lit(False), hours) >= threshold)
    mixed = rows.where("content_hash <> ''").groupBy("content_hash").agg(F.min("profile").alias("p"), F.max("profile").alias("q"), F.min(far).alias("far")).where("p <> q OR NOT far").select("content_hash")
    same = rows.join(mixed, "content_hash", "left_semi").select("article_id", "t", "cell", "content_hash", F.explode("blocking").alias("key"))
    copies = copies.unionByName(_chained(same, ["content_hash", "key"], near))
    copies = written(copies, "story-copies")
    units = written(_units(rows), "story-units")
    emitted = written(_emitted(units, threshold), "story-keys")
    sure = lambda d: d.where("state = 'all'").select(F.col("u").alias("a"), F.col("v").alias("b"))
    cross = written(_cross(units.withColumn("group", F.col("unit")), emitted, hours, threshold, False), "story-cross")
    links, made = copies.unionByName(sure(cross)), [rows, copies, units, emitted, cross]
    if units.count() > PART:
        group = components(links).select(F.col("node").alias("unit"), F.col("component").alias("group"))
        apart = written(units.join(group, "unit", "left").withColumn("group", F.coalesce("group", "unit")), "story-groups")
        between = written(_cross(apart, emitted, hours, threshold, True), "story-between")
        links, cross, made = links.unionByName(sure(between)), cross.unionByName(between), [*made, apart, between]
    cells = rows.groupBy("profile", "cell").agg(F.min_by("article_id", F.struct("t", "article_id")).alias("unit"))
    times = rows.select("profile", "cell", "t").join(cells, ["profile", "cell"]).select("unit", "t").distinct()
    one, two = (times.withColumnsRenamed({"unit": x, "t": f"{x}_t"}) for x in ("u", "v"))
    apart = F.abs(F.col("u_t") - F.col("v_t"))
    unsure = cross.where("state = 'some'").join(one, "u").join(two, "v")
    unsure = unsure.where(near(apart) & (stories.score(F.col("j"), F.col("h"), apart / 3.6e9, F.lit(False), hours) >= threshold)).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    out = written(links.unionByName(unsure).distinct(), "story-links")
    for df in made:
        remove(df)
    return out
