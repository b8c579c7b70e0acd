"""Operator 10: near-duplicate groups by SetSketch registers.

1. Sketch.  A document's set of word shingles becomes M registers.  Register i
   is floor(1 - log_b(min of Exp(a) hashes)), truncated to one byte: minima in
   exponentially spaced steps, so sketches merge by maximum and equal registers
   are as likely as sets are alike.  Documents whose sets have one digest (of
   128-bit hashes of all shingles) are one class.
2. Bands.  Classes that agree in all registers of a band share a bucket.
3. Stars.  Every bucket has a leader, its class with the most shared buckets.
   Members are compared with their leader only: first by the joint likelihood
   of both sketches, which drops pairs more than MARGIN deviations below the
   threshold, then by full sets, whose shared shingles are compared as text.
4. Rest.  Jaccard distance is a metric, so the distances to a leader bound the
   distance of two members.  Members that their leader didn't link are compared
   with those others of its star that the bound leaves and that are still in
   another component, in blocks, by full sets.
5. Components of all links, by repeated joins: every round at least halves what
   is still apart.

No pairs of a group are listed: a group of k copies gives k - 1 comparisons and
what the rest needs.  Nothing but counts and a stop flag comes to the driver.
The plan is the same at every size.  A leader, bucket or component that holds a
large share of all rows is dealt into parts (`spread`).

What chance can lose: a pair of sets just at the threshold shares no bucket
with probability below MISS (`bands` chooses the registers for it), and is
dropped by the estimate with probability 3e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import ship, textkit, worker
from .saved import drop, saved
from .spread import heavy, spread_join

ship(__name__)

#: Registers about, base and rate of the sketch.
REGISTERS, BASE, RATE = 192, 1.1, 20.0
#: Most likely loss of a pair at the threshold to the bands.
MISS = 2e-7
#: Deviations below the threshold at which an estimate still gets verified.
MARGIN = 5.0
#: Members of a part of a star, each of which gets the leader's text.
PART = 512
#: Step 4: members of a block, and of a chunk that it is compared with.
BLOCK, CHUNK = 256, 2048
_U = np.uint64


def bands(percent: int) -> tuple[int, int]:
    """(registers, registers of a band) for a threshold: the widest bands, in
    about REGISTERS registers, that lose a pair at it with less than MISS."""
    j = percent / 100
    # two registers are equal with probability 1 - p(larger) - p(smaller)
    equal = 1 + 2 * np.log1p(-(1 - j) / 2 * (BASE - 1) / BASE) / np.log(BASE)
    for band in range(12, 0, -1):
        count = -(-REGISTERS // band)
        if (1 - equal**band) ** count < MISS:
            return count * band, band
    count = int(np.ceil(np.log(MISS) / np.log(max(1 - equal, 1e-300))))
    return max(count, REGISTERS), 1


def sketch(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Registers of non-empty sets of 64-bit hashes, one row of bytes each."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    odd = textkit.mix(np.arange(1, registers + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
    least = np.empty((registers, len(sets)), _U)
    for i in range(registers):
        np.minimum.reduceat(flat * odd[i], begin, out=least[i])
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    minimum = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, 255).astype(np.uint8).T


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, given the
    set sizes: how many registers are larger, smaller and equal is multinomial
    with probabilities that depend on the similarity alone."""
    up = (a > b).sum(axis=1).astype(float)
    down = (a < b).sum(axis=1).astype(float)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    lo, hi = np.zeros(len(u)), most.copy()

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    for _ in range(30):  # the log-likelihood is concave
        third = (hi - lo) / 3
        left = likelihood(lo + third) >= likelihood(hi - third)
        hi = np.where(left, hi - third, hi)
        lo = np.where(left, lo, lo + third)
    return (lo + hi) / 2


def sketches(df: DataFrame, keep: list[str], text_column: str, width: int, registers: int = REGISTERS) -> DataFrame:
    """`keep`, n_shingles, grp (a digest of the set) and registers; both null
    for a document without words."""

    def kernel(data, offsets):
        shingles = textkit.Shingles(data, offsets, width)
        sets, digests = [], []
        for d in range(len(shingles)):
            keys, at = shingles.set_of(d)
            sets.append(keys)
            whole = keys.tobytes() + shingles.second(d, at).tobytes() + bytes([shingles.length(d)])
            digests.append(hashlib.blake2b(whole, digest_size=16).digest() if len(keys) else None)
        full = [s for s in sets if len(s)]
        rows = iter(sketch(full, registers)) if full else iter(())
        sketched = [next(rows).tobytes() if len(s) else None for s in sets]
        return [np.array([len(s) for s in sets], np.int64), pa.array(digests, pa.binary()), pa.array(sketched, pa.binary())]

    return worker.map_text(df, keep, text_column, "n_shingles bigint, grp binary, registers binary", kernel)


def buckets(classes: DataFrame, registers: int, band: int) -> DataFrame:
    """(bucket, rep, size) of every class that shares a bucket with others."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(registers // band - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * band + 1, F.lit(band))))
    placed = classes.select(F.explode(keys).alias("bucket"), "rep")
    shared = saved(placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    return spread_join(placed, shared, "bucket", F.col("rep"), heavy(shared, "bucket", "size"))


def stars(members: DataFrame) -> DataFrame:
    """Distinct (leader, rep) from (bucket, rep, size)."""
    score = members.groupBy("rep").agg(F.sum("size").alias("score"))
    scored = saved(members.join(score, "rep").select("bucket", "rep", "score"))
    leaders = saved(scored.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("rep")).alias("first"))).alias("top"), F.count("*").alias("size")).select("bucket", (-F.col("top.first")).alias("leader"), "size"))
    led = spread_join(scored, leaders.select("bucket", "leader"), "bucket", F.col("rep"), heavy(leaders, "bucket", "size"))
    pairs = saved(led.filter("leader <> rep").select("leader", "rep").distinct())
    drop(scored, leaders)
    return pairs


def by_leader(rows: DataFrame, run, schema: str) -> DataFrame:
    """Run over rows sorted by (leader, part, kind): the rows of one (leader,
    part) reach one task, those of kind 0 first."""
    worker.small_batches(rows.sparkSession)
    return rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "kind", "rep").mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, list[dict]]]:
    """(key, new key?, rows) in pieces of bounded size, in the order of the rows."""
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500).to_pylist()
            k = 0
            while k < len(rows):
                key = (rows[k]["leader"], rows[k]["part"])
                end = k
                while end < len(rows) and (rows[end]["leader"], rows[end]["part"]) == key:
                    end += 1
                yield key, key != last, rows[k:end]
                last, k = key, end


class Sets:
    """The shingle sets of a few texts."""

    def __init__(self, rows: list[dict], width: int):
        data = [r["text"].encode() for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
        self.shingles = textkit.Shingles(np.frombuffer(b"".join(data), np.uint8), offsets, width)
        self.sets = [self.shingles.set_of(d) for d in range(len(rows))]
        self.sizes = np.array([len(keys) for keys, _ in self.sets], np.int64)

    def shared(self, d: int, other: Sets, e: int) -> int:
        """Shingles that text d and text e of the other sets share, as words."""
        if self.shingles.length(d) != other.shingles.length(e):
            return 0
        (keys, at), (theirs, there) = self.sets[d], other.sets[e]
        lo, size = np.searchsorted(theirs, keys), len(theirs)
        hit = np.flatnonzero(theirs[np.minimum(lo, size - 1)] == keys)
        equal = self.shingles.same(self.shingles.length(d), at[hit], other.shingles, there[lo[hit]])
        found = int(equal.sum())
        for k in hit[~equal].tolist():  # another shingle of that hash may be the one
            j = lo[k] + 1
            while j < size and theirs[j] == keys[k] and not equal_at(self, d, k, other, e, j):
                j += 1
            found += j < size and theirs[j] == keys[k]
        return found


def equal_at(a: Sets, d: int, k: int, b: Sets, e: int, j: int) -> bool:
    return bool(a.shingles.same(a.shingles.length(d), a.sets[d][1][k : k + 1], b.shingles, b.sets[e][1][j : j + 1])[0])


def compare_with_leaders(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(leader, rep, shared, n, n_leader) of the pairs, shared -1 where the
    estimate rules a link out.  A leader's members are dealt into parts; its own
    text goes to each."""
    counts = saved(pairs.groupBy("leader").agg(F.count("*").alias("k")))
    parts = counts.select("leader", F.ceil(F.col("k") / PART).cast("int").alias("parts"))
    dealt = spread_join(pairs, parts, "leader", F.col("rep"), heavy(counts, "leader", "k")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    theirs = dealt.select("leader", "part", "rep").join(texts.hint("merge"), "rep").select("leader", "part", F.lit(1).alias("kind"), "rep", "registers", "text")
    own = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("leader").alias("rep")).join(texts.hint("merge"), "rep").select("leader", "part", "kind", "rep", "registers", "text")
    threshold = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine, out = None, None, []
        for (leader, _), new, rows in _groups(batches):
            if new:
                head = np.frombuffer(rows[0]["registers"], np.uint8)
                mine = Sets(rows[:1], width)
                rows = rows[1:]
            if not rows:
                continue
            theirs = Sets(rows, width)
            estimate = joint_similarity(np.stack([np.frombuffer(r["registers"], np.uint8) for r in rows]), head[None, :], theirs.sizes.astype(float), np.full(len(rows), float(mine.sizes[0])))
            # a pair beyond two distances is of no use as a bound either
            least = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / len(head))
            for k, (r, e) in enumerate(zip(rows, estimate.tolist())):
                shared = theirs.shared(k, mine, 0) if e >= least else -1
                out.append((leader, r["rep"], shared, int(theirs.sizes[k]), int(mine.sizes[0])))
            if len(out) > 5000:
                yield made(out)
                out = []
        yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["leader", "rep", "shared", "n", "n_leader"])

    return by_leader(own.unionByName(theirs), run, "leader bigint, rep bigint, shared bigint, n bigint, n_leader bigint")


def compare_rest(compared: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between members of a star that are in different components.

    One of them isn't linked with the leader.  Where a distance to the leader
    is known, two members link only if their distances differ by at most
    1 - threshold; where it isn't, they are compared."""
    linked = (F.col("shared") >= 0) & (100 * F.col("shared") >= percent * (F.col("n") + F.col("n_leader") - F.col("shared")))
    distance = F.when(F.col("shared") >= 0, 1 - F.col("shared") / (F.col("n") + F.col("n_leader") - F.col("shared"))).otherwise(F.lit(-1.0))
    members = compared.select("leader", "rep", linked.alias("linked"), distance.alias("far"), "n")
    members = saved(members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    large = heavy(saved(members.groupBy("leader").agg(F.count("*").alias("k"))), "leader", "k")
    # a linked member can only matter if some loose one is near enough
    loose = members.filter(~F.col("linked"))
    counts = saved(loose.groupBy("leader").agg(F.count("*").alias("loose"), F.min(F.when(F.col("far") >= 0, F.col("far")).otherwise(F.lit(0.0))).alias("nearest"), F.min("n").alias("least"), F.max("n").alias("most")))
    reach = 1 - percent / 100 + 1e-9
    near = spread_join(members, counts, "leader", F.col("rep"), large)
    others = saved(near.filter(~F.col("linked") | (F.col("far") >= F.col("nearest") - reach)).filter((100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))).select("leader", "rep", "component", "far"))
    sizes = others.groupBy("leader").agg(F.count("*").alias("others"), F.countDistinct("component").alias("components")).filter("components > 1")
    # blocks of loose members meet chunks of all others of their star
    shape = saved(counts.join(sizes, "leader").select("leader", F.ceil(F.col("loose") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("others") / CHUNK).cast("int").alias("chunks")))
    columns = ["leader", "part", "kind", "rep", "component", "far", "text"]
    first = spread_join(loose, shape, "leader", F.col("rep"), large).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    first = first.select("leader", "rep", "component", "far", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: (F.col("block") * F.col("chunks") + c).cast("int"))).alias("part"), F.lit(0).alias("kind"))
    second = spread_join(others, shape, "leader", F.col("rep"), large).withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("chunks")))
    second = second.select("leader", "rep", "component", "far", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (b * F.col("chunks") + F.col("chunk")).cast("int"))).alias("part"), F.lit(1).alias("kind"))
    rows = first.unionByName(second).join(texts.select("rep", "text").hint("merge"), "rep").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, out, seen = [], None, [], set()
        for _, new, rows in _groups(batches):
            if new:
                block, index, seen = [], None, set()
            block += [r for r in rows if r["kind"] == 0]
            rows = [r for r in rows if r["kind"] == 1]
            if not rows:
                continue
            if index is None:
                index = Postings(block, width)
            sets = Sets(rows, width)
            for k, r in enumerate(rows):
                for a in index.links(r, sets, k, percent, reach):
                    # one link joins two components; more of them say no more
                    pair = (a["component"], r["component"])
                    if pair not in seen:
                        seen.add(pair)
                        out.append((a["rep"], r["rep"]))
        columns = list(zip(*out)) if out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return by_leader(rows, run, "a bigint, b bigint")


class Postings:
    """The sets of a block of members by element, to count what another shares
    with each; what looks linked is counted again, word by word."""

    def __init__(self, block: list[dict], width: int):
        self.block, self.sets = block, Sets(block, width)
        self.sizes = self.sets.sizes
        self.far = np.array([r["far"] for r in block])
        self.component = np.array([r["component"] for r in block], np.int64)
        flat, owner = np.concatenate([keys for keys, _ in self.sets.sets]), np.repeat(np.arange(len(block)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def links(self, row: dict, sets: Sets, k: int, percent: int, reach: float) -> list[dict]:
        own = sets.sets[k][0]
        open_ = self.component != row["component"]
        open_ &= (100 * np.minimum(self.sizes, len(own)) >= percent * np.maximum(self.sizes, len(own)))
        if row["far"] >= 0:
            open_ &= (self.far < 0) | (np.abs(self.far - row["far"]) <= reach)
        if not open_.any():
            return []
        lo, hi = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        size = hi - lo
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(lo - (ends - size), size)
        shared = np.bincount(self.owner[at], minlength=len(self.block))
        likely = open_ & (100 * shared >= percent * (self.sizes + len(own) - shared))
        found = []
        for j in np.flatnonzero(likely).tolist():
            both = sets.shared(k, self.sets, j)
            if 100 * both >= percent * (int(self.sizes[j]) + len(own) - both):
                found.append(self.block[j])
        return found


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node
    reachable.

    In a round every root that still has links hooks onto its least neighbour.
    That gives trees of at least two roots, for the only cycles are pairs that
    hook onto each other, and of a pair the lesser stays a root.  Paths to the
    roots are then halved until all nodes are named by their root, and links
    within a tree go.  Roots with links at least halve in a round, so n nodes
    need at most log2(n) rounds of at most log2(n) halvings, whatever the shape
    of the graph.
    """
    edges = saved(links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        hooks = saved(edges.groupBy("a").agg(F.min("b").alias("to")))
        if not hooks.take(1):
            break
        back = hooks.select(F.col("a").alias("to"), F.col("to").alias("back"))
        first = (F.col("back") == F.col("a")) & (F.col("a") < F.col("to"))
        roots = saved(narrow_join(hooks, back, "to").select("a", F.when(first, F.col("a")).otherwise(F.col("to")).alias("to")))
        while True:
            beyond = roots.select(F.col("a").alias("to"), F.col("to").alias("next"))
            moved = Observation()
            halved = narrow_join(roots, beyond, "to").select("a", F.col("to").alias("old"), F.col("next").alias("to"))
            last, roots = roots, saved(halved.observe(moved, F.count_if(F.col("old") != F.col("to")).alias("n"))).select("a", "to")
            drop(last)
            if not moved.get["n"]:
                break
        named = roots.select(F.col("a").alias("component"), F.col("to").alias("root"))
        last, labels = labels, saved(narrow_join(labels, named, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        drop(last)
        half = narrow_join(edges, roots, "a").select("b", F.col("to").alias("x"))
        both = narrow_join(half, roots.select(F.col("a").alias("b"), "to"), "b")
        last, edges = edges, saved(both.filter("x <> to").select(F.col("x").alias("a"), F.col("to").alias("b")).distinct())
        drop(last, hooks, roots)
    # a root is any of its component's nodes: name it by the smallest
    low = labels.groupBy("component").agg(F.min("node").alias("low"))
    return narrow_join(labels, low, "component").select("node", F.col("low").alias("component"))


def narrow_join(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows of two numbers joined with one row per key.  A key with so many rows
    that their 16 bytes each make a partition too large is split by Spark."""
    return rows.join(small.hint("merge"), key, how)


def joined_components(components_of: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) of links, with `more` links (a, b)."""
    named = more
    for end in ("a", "b"):
        label = components_of.select(F.col("node").alias(end), F.col("component").alias(f"{end}_"))
        named = narrow_join(named, label, end, "left").withColumn(f"{end}_", F.coalesce(f"{end}_", end))
    above = saved(components(saved(named.select(F.col("a_").alias("a"), F.col("b_").alias("b")))))
    # a node that has no link but those is its own component so far
    alone = above.join(components_of.select("node").hint("merge"), "node", "left_anti")
    lifted = narrow_join(components_of, above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return lifted.select("node", F.coalesce("top", "component").alias("component")).unionByName(alone)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id_column, n_shingles, component_id, kept.

    Sets are the distinct `width`-word shingles of the whole text with A-Z in
    lower case, or the whole sequence where it is shorter.  Two rows link where
    100 * shared >= percent * union.  component_id is the smallest id reachable
    and kept marks the row of that id.  A null or empty text links with
    nothing.  Ids are integers that identify rows; of rows that repeat an id,
    all get the same answer.  A null id takes part as a row of its own with the
    text's class but never names a component.  Empty in, empty out.
    """
    registers, band = bands(percent)
    rows = saved(sketches(df, [id_column], text_column, width, registers))
    full = rows.filter(F.col("grp").isNotNull() & F.col(id_column).isNotNull())
    # equal sets are one class, named by its smallest id
    classes = saved(full.groupBy("grp").agg(F.min(F.col(id_column).cast("bigint")).alias("rep"), F.first("registers").alias("registers")))
    members = saved(buckets(classes, registers, band))
    pairs = stars(members)
    drop(members)
    involved = saved(pairs.select("rep").unionByName(pairs.select(F.col("leader").alias("rep"))).distinct().join(classes.select("rep", "registers").hint("merge"), "rep"))
    texts = saved(texts_of(df, involved, id_column, text_column))
    drop(involved)
    compared = saved(compare_with_leaders(pairs, texts, percent, width))
    links = saved(compared.filter(f"shared >= 0 AND 100 * shared >= {percent} * (n + n_leader - shared)").select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    found = saved(components(links))
    rest = saved(compare_rest(compared, found, texts, percent, width))
    drop(pairs, texts, compared)
    if rest.take(1):
        found = saved(joined_components(found, rest))
    drop(links, rest)
    named = classes.select("grp", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("grp", F.coalesce("component", "rep").alias("component_id"))
    sizes = saved(rows.filter("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("k")))
    kept = rows.select(id_column, "n_shingles", "grp").withColumn("__salt", F.monotonically_increasing_id())
    out = spread_join(kept, named, "grp", F.col("__salt"), heavy(sizes, "grp", "k"), "left")
    component = F.coalesce("component_id", F.col(id_column).cast("bigint"))
    return out.select(id_column, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_column) == component, F.col("n_shingles") == 0).alias("kept"))


def texts_of(df: DataFrame, involved: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(rep, text, registers) of the documents in involved (rep, registers).
    Texts are shuffled once, at every size: a plan that broadcasts the ids
    while they are few would be another plan on a large corpus."""
    texts = df.select(F.col(id_column).cast("bigint").alias("rep"), F.col(text_column).alias("text"))
    return texts.filter("rep IS NOT NULL AND text IS NOT NULL").join(involved.hint("merge"), "rep")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLE: dict[str, str] = {}
