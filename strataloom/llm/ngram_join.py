"""Exact Jaccard self-join of shingle sets, and the components of its links.

Equal sets are one node. A node lists the rarest shingles of its set under a global order: two sets
similar enough share at least ``SHARED`` of the listed ones. Frequent shingles, found by counting all, come last in the order; shingles
whose lists turn out long are marked and put behind the others before the lists are made again. The
lists by shingle are index lists cut into blocks by size; an entry's position bounds the sizes that it can
still reach, so probes meet only blocks within that reach and skip the others.

Answers of one set are derived from those of a similar one. In long lists each node is compared with one hub, and nodes that aren't linked to
theirs with another. Two members of a hub's group differ exactly where one of their differences to the hub does, so their answer follows
from the hub's: a pair that isn't already linked through the hub must share enough of these differences, and is met over the first
of them only. Short differences give the exact overlap without looking at the sets again. The lists give the pairs between groups. Nothing
is capped: the bounds only skip pairs that cannot link, or whose link would not change a component.

Defined results: a null, empty or blank text has the empty set, links with nothing and is its own component. Rows that repeat a
text share a component; a component is named by its smallest id, null only if all its ids are null. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.components import components
from strataloom.llm.shingles import Order, digest, overlap, shingle_sets
from strataloom.llm.text import columns, map_arrow, small_side, utf8_column
from strataloom.plans.workspace import Workspace

#: Listed shingles that similar sets must share.
SHARED = 3
#: Shingles counted together before rare ones among them are left out of the order.
CHUNK = 1_000_000
#: Most frequent shingles in the order; a shingle must hold more than this share of all to be in it.
FREQUENT = 1 << 19
#: Lists this long mark their shingle; bits of the table of marks, and the most marked shingles (the length doubles beyond it).
MARKED_LENGTH, MARK_BITS, MARKED = 32, 1 << 26, 4_000_000
#: Lists this long are answered for hubs first; pairs per list entry above which that goes on while it helps, and the most such rounds.
LONG, PAIRS_PER_ENTRY, ROUNDS = 16, 8, 4


def need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any similar set."""
    return -(-num * n // den)


def listed(n: int, num: int, den: int) -> int:
    k = need(n, num, den)
    return n - k + min(SHARED, k)


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles above their share of all, with lossy document counts: at most FREQUENT, as counts add up to the total."""
    import pyarrow as pa

    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, size, total = [], 0, 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            k = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(u[k].view(np.int64)), pa.array(c[k])], schema=schema)

        for batch in batches:
            for s in shingle_sets(utf8_column(batch, "text"), width):
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield flush()
                    held, size, total = [], 0, total + size
        if size:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total + size], pa.int64())], schema=schema)

    counts = map_arrow(texts.select("text"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    work = Workspace(texts.sparkSession, "shingle-counts")
    counts = work.table(counts, "counts")
    total = counts.where("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(8, total // FREQUENT + 1)
    rows = counts.where(F.col("shingle").isNotNull() & (F.col("n") >= least)).toPandas()
    work.drop("counts")
    shingles, n = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def marked(postings: DataFrame) -> np.ndarray:
    """A bit table of the shingles with long lists; its size is fixed."""
    counts = Workspace(postings.sparkSession, "list-lengths").table(
        postings.groupBy("shingle").count().where(F.col("count") >= MARKED_LENGTH), "lengths")
    length = MARKED_LENGTH
    while counts.where(F.col("count") >= length).count() > MARKED:
        length *= 2
    hot = counts.where(F.col("count") >= length)
    mask = F.lit(MARK_BITS - 1)
    places = hot.select(F.explode(F.array(F.col("shingle").bitwiseAND(mask), F.shiftrightunsigned("shingle", 32).bitwiseAND(mask))).alias("p"))
    rows = places.groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    table = np.zeros(MARK_BITS // 8, np.uint8)
    for r in rows:  # at most MARK_BITS / 32768 rows of 4 KB
        table[r["bucket"] * 4096 : r["bucket"] * 4096 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return table


def profiles(texts: DataFrame, order: Order, width: int, num: int, den: int) -> DataFrame:
    """(id, n, digest, listed): size and digest of each row's set, and its listed shingles in order."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(order)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("listed", pa.list_(pa.int64()))])

    def run(batches):
        own = shared.value
        for batch in batches:
            sets = shingle_sets(utf8_column(batch, "text"), width)
            lists = [own.first(s, listed(len(s), num, den)).view(np.int64) for s in sets]
            offsets = np.cumsum([0] + [len(x) for x in lists], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))),
            ], schema=schema)

    return map_arrow(texts, run, "id long, n long, digest binary, listed array<long>")


def _delta(member: np.ndarray, hub: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, int]:
    """The first of the shingles that are in one of two sets only, and how many there are: what the hub lacks in order, then what the member lacks by hash.

    Two similar sets of a group differ in ``n * (den - num) / num`` shingles at most, and so do their differences to the hub. So
    the first one that they share is among that many and one more.
    """
    extra, lacking = np.setdiff1d(member, hub, assume_unique=True), np.setdiff1d(hub, member, assume_unique=True)
    length = len(member) * (den - num) // num + 1
    first = order.first(extra, min(length, len(extra)))
    return np.concatenate((first, lacking[: length - len(first)])), len(extra) + len(lacking)


_COMPARED = "a long, b long, common long, n_a long, n_b long, delta array<long>, n_delta long"


def compared(work: Workspace, texts: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, num: int, den: int, name: str, order=None) -> DataFrame:
    """(a, b, common, n_a, n_b, delta, n_delta): overlaps and sizes of the pairs (a, b), and with an order the difference of b to a; a is the side in many."""
    import pyarrow as pa

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = work.table(wanted.join(nodes.select("node", "low", "digest"), "node"), f"{name}-wanted")
    n = wanted.count()
    schema = pa.schema([("digest", pa.binary()), ("text", pa.string())])

    def digests(batches):
        for batch in batches:
            sets = shingle_sets(utf8_column(batch, "text"), width)
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), batch.column(1).cast(pa.string())], schema=schema)

    lows = wanted.select(F.col("low").alias("__low")).distinct()
    some = texts.join(small_side(lows, n), texts["id"].eqNullSafe(F.col("__low")), "left_semi")
    found = map_arrow(some.select("id", "text"), digests, "digest binary, text string")
    held = found.join(small_side(wanted.select("node", "digest"), n), "digest").groupBy("node").agg(F.min("text").alias("text"))
    both = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("delta", pa.list_(pa.int64())), ("n_delta", pa.int64())])

    def run(batches):
        last, last_set = None, None
        for batch in batches:
            common, n_a, n_b, deltas, sizes = [], [], [], [], []
            for key, text, s in zip(batch.column(0).to_pylist(), utf8_column(batch, "text_a"), shingle_sets(utf8_column(batch, "text_b"), width)):
                if key != last:
                    last, last_set = key, shingle_sets([text], width)[0]
                common.append(overlap(last_set, s))
                n_a.append(len(last_set))
                n_b.append(len(s))
                delta, size = _delta(s, last_set, order.value, num, den) if order is not None else (np.empty(0, np.uint64), None)
                deltas.append(delta.view(np.int64))
                sizes.append(size)
            arrays = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (common, n_a, n_b))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(deltas, out.field("delta").type), pa.array(sizes, pa.int64())], schema=out)

    return work.table(map_arrow(both, run, _COMPARED), f"{name}-compared")


def _linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) of the pairs that are similar enough."""
    similar = den * F.col("common") >= num * (F.col("n_a") + F.col("n_b") - F.col("common"))
    return pairs.where(similar).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _block(n):
    return F.floor(F.log(n.cast("double")) / math.log(1.03)).cast("int")


def _enough(common, n1, n2, num: int, den: int):
    return (num + den) * common >= num * (n1 + n2)


def between_groups(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of list entries (shingle, node, n, pos, root, hub, minor) of different components and hubs that can still link.

    Index side: an entry reaches sets of its own size or larger, up to a size bounded by its position; it stands
    in the blocks of that range only. Probe side: each entry looks into the block of its size. One of two entries
    is always minor, that is, not of the hub that holds most of the list.
    """
    t = num / den
    n, pos = F.col("n"), F.col("pos")
    reach = F.least(n / t, (n - pos + SHARED - 1) * ((1 + t) / t) - n) + 1e-6
    fields = F.struct("node", "n", "pos", "root", "hub")
    index = entries.withColumn("reach", reach).where("reach >= n").select(
        "shingle", F.explode(F.sequence(_block(n), _block(F.col("reach")))).alias("block"), fields.alias("y"), "minor")
    probe = entries.select("shingle", _block(n).alias("block"), fields.alias("x"), "minor")
    on = ["shingle", "block"]
    met = index.where("minor").drop("minor").join(probe.drop("minor"), on).unionByName(index.where("NOT minor").drop("minor").join(probe.where("minor").drop("minor"), on))
    x, y = (lambda f: F.col(f"x.{f}")), (lambda f: F.col(f"y.{f}"))
    pairs = met.where(
        (x("root") != y("root")) & (x("hub") != y("hub"))
        & ((y("n") < x("n")) | ((y("n") == x("n")) & (y("node") < x("node"))))
        & (den * y("n") >= num * x("n"))
        & _enough(F.least(x("n") - x("pos"), y("n") - y("pos")) + SHARED - 1, x("n"), y("n"), num, den)
    )
    least = F.least(F.lit(SHARED), F.ceil(F.col("n") * t - 1e-9))
    counted = pairs.select(y("node").alias("b"), x("node").alias("a"), x("n").alias("n")).groupBy("a", "b", "n").count()
    return counted.where(F.col("count") >= least).select("a", "b")


def within_groups(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, common, n_a, n_b) of members (node, n, hub, delta, n_delta, root, hub_root) of one hub and different components that can still link.

    Two members differ where exactly one of their differences to the hub does: |y ^ z| = |D(y)| + |D(z)| - 2 |D(y) & D(z)|. So answers follow
    from the hub's: a pair must share enough of its differences, and one that isn't linked to the hub shares at least one with any partner. Where both
    differences are listed whole, ``common`` is the pair's exact overlap; else it is null.
    """
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "n_delta", "root", "pos")]
    lists = members.select("hub", "node", "n", "n_delta", "root", (F.col("root") != F.col("hub_root")).alias("far"), F.posexplode("delta").alias("pos", "shingle"))
    first, second = lists.where("far").select("hub", "shingle", *side(1)), lists.select("hub", "shingle", *side(2), "far")
    apart = F.floor((F.col("n_1") + F.col("n_2")) * (den - num) / (den + num))
    shares = F.ceil((F.col("n_delta_1") + F.col("n_delta_2") - apart) / 2)
    left = F.least(F.col("n_delta_1") - F.col("pos_1"), F.col("n_delta_2") - F.col("pos_2"))  # if this is the first that they share
    met = first.join(second, ["hub", "shingle"]).where(
        (F.col("root_1") != F.col("root_2")) & (~F.col("far") | (F.col("node_1") < F.col("node_2")))
        & (den * F.least("n_1", "n_2") >= num * F.greatest("n_1", "n_2")) & (left >= shares)
    )
    found = met.select(F.greatest("node_1", "node_2").alias("a"), F.least("node_1", "node_2").alias("b")).distinct()
    both = found
    for k in ("a", "b"):
        both = both.join(members.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("delta").alias(f"delta_{k}"), F.col("n_delta").alias(f"n_delta_{k}")), k)
    whole = (F.size("delta_a") == F.col("n_delta_a")) & (F.size("delta_b") == F.col("n_delta_b"))
    differ = F.col("n_delta_a") + F.col("n_delta_b") - 2 * F.size(F.array_intersect("delta_a", "delta_b"))
    total = F.col("n_a") + F.col("n_b")
    return both.select("a", "b", F.when(whole, (total - differ) / 2).cast("long").alias("common"), "n_a", "n_b")


def _hub_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a: hub, b: node), one for each node of a long list without a hub: of its lists' leaders, whose sets the lists hold most of, the best."""
    rank = entries.groupBy("node").agg(F.count(F.lit(1)).alias("rank"))
    long = entries.groupBy("shingle").count().where(F.col("count") >= LONG).select("shingle")
    ranked = entries.join(long, "shingle").join(rank, "node").withColumn("score", F.round(F.col("rank") * 1000 / F.col("n")).cast("long"))
    leader = ranked.groupBy("shingle").agg(F.max(F.struct("score", "node", "n")).alias("l"))
    near = (den * F.least("n", "l.n") >= num * F.greatest("n", "l.n")) & (F.col("node") != F.col("l.node"))
    met = ranked.join(leader, "shingle").where(near)
    return met.groupBy("node").agg(F.max(F.struct("l.score", "l.node")).alias("best")).select(F.col("best.node").alias("a"), F.col("node").alias("b"))


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row per document: id, n_shingles, component (smallest id that links reach), sets of equal shingles included."""
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    shingles, counts = frequent_shingles(texts, width)
    first = work.table(_listed_once(profiles(texts, Order(shingles, counts), width, num, den)), "first")
    marks = marked(first.select(F.explode("listed").alias("shingle")))
    work.drop("first")
    rows = work.table(profiles(texts, Order(shingles, counts, marks), width, num, den), "profiles")
    nodes = work.table(
        rows.where("n > 0").groupBy("digest")
        .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("listed").alias("listed"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes",
    )
    postings = nodes.select("node", "n", F.posexplode("listed").alias("pos", "shingle"))
    met = postings.groupBy("shingle").count().where("count > 1").select("shingle")
    lists = work.table(postings.join(met, "shingle"), "lists")
    size = lists.count()

    order = spark.sparkContext.broadcast(Order(shingles, counts, marks))
    answers, hubs, open_entries, before = spark.createDataFrame([], _COMPARED), None, lists, float("inf")
    for step in range(ROUNDS):
        pairs = work.table(_hub_pairs(open_entries, num, den), f"hubs-{step}")
        if pairs.isEmpty():
            break
        answers = answers.union(compared(work, texts, nodes, pairs, width, num, den, f"round-{step}", order))
        hubs = work.table(_hubs(nodes, answers, num, den), f"hubs-of-{step}")
        untried = hubs.where("alone").select("node").join(answers.select(F.col("a").alias("node")), "node", "left_anti")
        open_entries = work.table(lists.join(untried, "node", "left_semi"), f"open-{step}")
        open_lists = open_entries.groupBy("shingle").count().where(F.col("count") >= LONG)
        left = open_lists.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        if left <= PAIRS_PER_ENTRY * size or left > 0.8 * before:
            break
        before = left

    linked = _linked(answers, num, den)
    if hubs is None:  # no list is long: each node is its own hub
        entries = _with_minor(lists.withColumn("hub", F.col("node"))).withColumn("root", F.col("node"))
        rest = work.table(between_groups(entries, num, den), "between")
    else:
        roots = components(work, linked, "hub-components")
        rooted = hubs.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = work.table(rooted, "rooted")
        owned = work.table(lists.join(rooted.select("node", "hub", "root"), "node"), "owned")
        entries = work.table(_with_minor(owned), "entries")
        work.drop("lists", "owned")
        rest = work.table(between_groups(entries, num, den), "between")
        at_hub = rooted.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
        members = work.table(rooted.where("delta IS NOT NULL").join(at_hub, "hub"), "members")
        derived = work.table(within_groups(members, num, den), "within")
        linked = linked.union(_linked(derived, num, den))
        rest = rest.union(derived.where("common IS NULL").select("a", "b"))
    checked = compared(work, texts, nodes, rest, width, num, den, "rest")
    roots = components(work, linked.union(_linked(checked, num, den)), "components")

    named = nodes.join(roots, "node", "left").select("digest", "low", "copies", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    shared = work.table(named.where("copies > 1 OR linked").join(lows, "root").select("digest", "component", F.lit(True).alias("in_group")), "shared")
    return rows.select("id", "n", "digest").join(small_side(shared, shared.count()), "digest", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("in_group"), F.col("component")).otherwise(F.col("id")).alias("component"))


def _listed_once(rows: DataFrame) -> DataFrame:
    """Lists of distinct sets, for the lengths of lists."""
    return rows.where("n > 0").groupBy("digest").agg(F.first("listed").alias("listed")).select("listed")


def _hubs(nodes: DataFrame, answers: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, hub, delta, n_delta, alone): each node's hub, itself if it has none; delta is null outside groups. A hub is in its own group.

    Of several hubs the one with the smallest difference counts. ``alone`` are nodes that aren't linked to a hub and aren't one of a linked node.
    """
    similar = den * F.col("common") >= num * (F.col("n_a") + F.col("n_b") - F.col("common"))
    is_hub = answers.groupBy(F.col("a").alias("node")).agg(F.max(similar).alias("leads"))
    best = answers.groupBy(F.col("b").alias("node")).agg(
        F.min_by(F.struct(F.col("a").alias("hub"), "delta", "n_delta"), F.struct("n_delta", "a")).alias("best"), F.max(similar).alias("follows"))
    joined = nodes.select("node", "n").join(best, "node", "left").join(is_hub, "node", "left")
    own = F.col("leads").isNotNull()
    alone = ~F.coalesce(F.col("leads"), F.lit(False)) & ~F.coalesce(F.col("follows"), F.lit(False))
    return joined.select(
        "node", "n", F.when(own | F.col("best").isNull(), F.col("node")).otherwise(F.col("best.hub")).alias("hub"),
        F.when(own, F.array().cast("array<long>")).otherwise(F.col("best.delta")).alias("delta"),
        F.when(own, F.lit(0).cast("long")).otherwise(F.col("best.n_delta")).alias("n_delta"), alone.alias("alone"),
    )


def _with_minor(entries: DataFrame) -> DataFrame:
    """Marks entries that are not of the hub with most entries of their list; lists of one hub go."""
    per = entries.groupBy("shingle", "hub").count().groupBy("shingle").agg(F.max(F.struct("count", "hub")).alias("top"), F.count(F.lit(1)).alias("hubs"))
    return entries.join(per.where("hubs > 1"), "shingle").withColumn("minor", F.col("hub") != F.col("top.hub")).drop("top", "hubs")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.c
)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = doc_id GROUP BY doc_id
"""
