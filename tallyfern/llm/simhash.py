"""SimHash near-duplicates (operator 6): exact links between fingerprints.

Distinct fingerprints are dealt into overlapping shards: 64 bits fall into six
blocks, and two fingerprints that differ in at most four bits agree on at least
two whole blocks, so they meet in the shard of such a pair of blocks.  Inside a
shard a vantage-point partition finds the links: points are split by their Hamming
distance to a vantage point, and the triangle inequality prunes every branch pair
whose distances to it differ by more than the radius.  A shard yields a spanning
forest, not its pairs; components of the forests come from star contraction.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfern.llm.batches import field, map_rows, utf8
from tallyfern.sources.tables import cut_lineage, drop_cut

#: Fixed by the contract: shingle words, seed, bits that linked fingerprints may differ in.
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4

#: Blocks of the 64 bits as (shift, width): all but ``RADIUS`` of them agree.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Points of a shard whose tree grows together with others', and the leaf of larger trees,
#: which is compared pair by pair; squared sizes of the shards that grow at once.
LEAF = 256
SLICE = 1 << 22
COUNT_CHUNK = 1 << 15
#: Tasks that the rows of one hot fingerprint or hub are dealt to.
SALTS = 16
#: Shard rows that a task gathers before it looks for links in the finished shards.
STRETCH = 1 << 17

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(raw: bytes) -> int:
    """SimHash of a UTF-8 text's word shingles; zero without words."""
    words = raw.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    firsts, lasts = (ends - lengths).tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(firsts, lasts)), np.uint64, len(lasts)
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_CHUNK):
        part = hashes[i : i + COUNT_CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` with ``fingerprint`` (the 64 bits as a signed long) of whole texts.

    Null and word-less texts have fingerprint zero.  No shuffle.
    """

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            bits = np.array([fingerprint(raw) for raw in utf8(column)], np.uint64)
            return [pa.array(bits.view(np.int64))]

        return work

    fields = [field("fingerprint", T.LongType())]
    return map_rows(docs, [F.col(text).cast("string")], fields, make, keep)


class Forest:
    """Union-find over positions, as arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, members: np.ndarray) -> np.ndarray:
        found = self.parent[members]
        while not np.array_equal(above := self.parent[found], found):
            found = above
        self.parent[members] = found
        return found

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link pairs: larger roots hook onto smaller ones until none differ."""
        while len(a):
            one, two = self.roots(a), self.roots(b)
            apart = one != two
            a, b, one, two = a[apart], b[apart], one[apart], two[apart]
            np.minimum.at(self.parent, np.maximum(one, two), np.minimum(one, two))

    def gather(self, members: np.ndarray) -> None:
        """Link all members with each other."""
        if len(members) > 1:
            tops = np.unique(self.roots(members))
            self.parent[tops] = tops[0]


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage_links(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Component root (as a position) of each distinct point, over all pairs at
    distance ``radius`` or less.

    A node splits its points at the median distance to a vantage point.  Pairs
    within a side recur; pairs across meet only from the two bands beside the
    boundary that are ``radius`` wide (triangle inequality).  Parts that already
    hang together are skipped: only components are asked for.
    """
    forest = Forest(len(points))
    everything = np.arange(len(points))
    todo: list[tuple[np.ndarray, np.ndarray]] = [(everything, everything)]
    while todo:
        left, right = todo.pop()
        if not len(left) or not len(right):
            continue
        alone, top = left is right, forest.roots(left[:1])[0]
        if (forest.roots(left) == top).all() and (alone or (forest.roots(right) == top).all()):
            continue
        if len(left) * len(right) <= LEAF * LEAF:
            _brute(points, left, right, radius, forest)
            continue
        vantage = left[len(left) // 2]
        from_left = _distance(points[left], points[vantage])
        from_right = from_left if alone else _distance(points[right], points[vantage])
        forest.gather(np.concatenate([left[from_left <= radius], right[from_right <= radius]]))
        cut = int(np.median(from_left))
        inner_l, inner_r = from_left <= cut, from_right <= cut
        edge_l, edge_r = inner_l & (from_left > cut - radius), inner_r & (from_right > cut - radius)
        rim_l, rim_r = ~inner_l & (from_left <= cut + radius), ~inner_r & (from_right <= cut + radius)
        parts = [(edge_l, rim_r)] if alone else [(inner_l, inner_r), (~inner_l, ~inner_r), (edge_l, rim_r), (rim_l, edge_r)]
        if alone and not inner_l.all():
            todo += [(x, x) for x in (left[inner_l], left[~inner_l])]
        elif alone:
            _brute(points, left, right, radius, forest)
            continue
        for l, r in parts:
            if l.all() and r.all():
                _brute(points, left, right, radius, forest)
            else:
                todo.append((left[l], right[r]))
    return forest.roots(everything)


def _brute(points, left, right, radius: int, forest: Forest) -> None:
    """All pairs of two sets in row blocks of bounded size."""
    rows = max(1, LEAF * LEAF // max(1, len(right)))
    for i in range(0, len(left), rows):
        part = left[i : i + rows]
        one, two = forest.roots(part), forest.roots(right)
        near = _distance(points[part][:, None], points[right][None, :]) <= radius
        a, b = np.nonzero(near & (one[:, None] != two[None, :]))
        forest.link(part[a], right[b])


def _several(node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the nodes in sorted ``node``, and whether ``value`` differs inside each."""
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    apart = np.minimum.reduceat(value, starts) != np.maximum.reduceat(value, starts)
    return starts, apart


def vantage_forest(node: np.ndarray, points: np.ndarray, radius: int, forest: Forest) -> int:
    """Link the points of each shard (sorted ``node``) in ``forest``, by one vantage-point
    tree a shard, all trees grown together level by level; returns the nodes visited.

    A node is a set compared with itself (side 0) or two sets compared with each other
    (sides 1 and 2).  Its first member is the vantage point: it is linked with what lies
    within ``radius``, and leaves.  The others are split at their median distance to it;
    pairs across the boundary meet only from the two bands ``radius`` wide.  Nodes whose
    members already hang together end.
    """
    at, side, visited = np.arange(len(points)), np.zeros(len(points), np.int8), 0
    while len(at):
        # only nodes with several components and, of two sets, with both
        starts, apart = _several(node, forest.roots(at))
        sizes = np.diff(np.append(starts, len(node)))
        two = side[starts] > 0
        apart &= ~two | _several(node, side)[1]
        keep = np.repeat(apart, sizes)
        at, side, sizes, two = at[keep], side[keep], sizes[apart], two[apart]
        if not len(at):
            break
        visited += len(sizes)
        place = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        vantage = at[starts]
        away = _distance(points[at], points[vantage][place]).astype(np.int64)
        near = (away <= radius) & (side != 1)
        forest.link(vantage[place[near]], at[near])
        rest = np.ones(len(at), bool)
        rest[starts] = False
        at, side, place, away = at[rest], side[rest], place[rest], away[rest]
        # the median of the first set's distances, node by node
        first = np.flatnonzero(side < 2)
        first = first[np.lexsort((away[first], place[first]))]
        counts = np.bincount(place[first], minlength=len(sizes))
        middle = np.minimum(np.cumsum(counts) - counts + (counts - 1) // 2, max(0, len(first) - 1))
        cut = np.where(counts > 0, away[first[middle]] if len(first) else 0, -1)[place]
        inner = away <= cut
        edge, rim = inner & (away > cut - radius), ~inner & (away <= cut + radius)
        pair = two[place]
        children = [
            (~pair & inner, 0), (~pair & ~inner, 0), (~pair & edge, 1), (~pair & rim, 2),
            (pair & inner, side), (pair & ~inner, side),
            (pair & edge & (side == 1), 1), (pair & rim & (side == 2), 2),
            (pair & rim & (side == 1), 1), (pair & edge & (side == 2), 2),
        ]
        slots = (0, 1, 2, 2, 3, 4, 5, 5, 6, 6)
        made = [np.flatnonzero(mask) for mask, _ in children]
        node = np.concatenate([place[m] * 7 + slot for m, slot in zip(made, slots)])
        sides = [np.broadcast_to(np.asarray(s, np.int8), len(at))[m] for m, (_, s) in zip(made, children)]
        at, side = at[np.concatenate(made)], np.concatenate(sides)
        order = np.lexsort((side, node))
        node, at, side = node[order], at[order], side[order]
    return visited


def _run_edges(keys: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of one sorted stretch of whole shards: trees of shards up to ``LEAF``
    points grow together, in slices of bounded pairs, larger ones one by one."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(cuts, len(keys)))
    forest = Forest(len(points))
    large = sizes > LEAF
    several = np.flatnonzero((sizes > 1) & ~large)
    slices = np.cumsum(sizes[several] ** 2) // SLICE
    for chosen in np.split(several, np.flatnonzero(np.diff(slices)) + 1):
        n = sizes[chosen]
        shard = np.repeat(np.arange(len(chosen)), n)
        member = np.arange(len(shard)) + np.repeat(cuts[chosen] - (np.cumsum(n) - n), n)
        grown = Forest(len(member))
        vantage_forest(shard, points[member], radius, grown)
        forest.parent[member] = member[grown.roots(np.arange(len(member)))]
    for first, size in zip(cuts[large].tolist(), sizes[large].tolist()):
        roots = vantage_links(points[first : first + size], radius)
        forest.parent[first : first + size] = roots + first
    roots = forest.roots(np.arange(len(points)))
    moved = np.flatnonzero(roots != np.arange(len(points)))
    return points[moved], points[roots[moved]]


def _shard_edges(parts: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of a partition sorted by shard; a shard may span batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, full = 0, STRETCH
    for part in itertools.chain(parts, [None]):
        if part is not None:
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)))
            rows += part.num_rows
        if not held or part is not None and rows < full:
            continue
        keys, points = (np.concatenate(x) for x in zip(*held))
        # the last shard may go on in the next batch
        done = rows if part is None else int(np.searchsorted(keys, keys[-1]))
        held, rows = [(keys[done:], points[done:])], rows - done
        full = STRETCH if done else 2 * rows
        if done:
            a, b = _run_edges(keys[:done], points[:done], radius)
            made = [pa.array(x.view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(made, names=["a", "b"])


def link_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all links between the
    distinct values of ``fingerprint``."""
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"the shards are exact up to radius {len(BLOCKS) - 2}")
    bits = F.col("fingerprint")
    keys = []
    for n, ((s1, w1), (s2, w2)) in enumerate(itertools.combinations(BLOCKS, 2)):
        one = F.shiftrightunsigned(bits, s1).bitwiseAND(F.lit((1 << w1) - 1))
        two = F.shiftrightunsigned(bits, s2).bitwiseAND(F.lit((1 << w2) - 1))
        keys.append(F.lit(n << 22) + F.shiftleft(one, w2) + two)
    dealt = distinct.select(F.explode(F.array(*keys)).alias("shard"), bits)
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(lambda parts: _shard_edges(parts, radius), "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # a hub's edges are dealt by salt; its least neighbour is repeated once per salt
    salted = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # merged: repeated rows look small to a choice of broadcast, and grow with the table
    return salted.join(copies.hint("merge"), ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``a`` and ``root``, the smallest vertex of its component, for every vertex
    that is not a root itself, by alternating large-star and small-star passes.

    Each pass is cut into the shared folder and takes the place of the one before.
    Stops when a pass changes nothing.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.where("a != b").distinct()

    def state(df: DataFrame) -> tuple:
        marks = df.select(F.xxhash64("a", "b").alias("h"))
        row = marks.agg(F.count("h"), F.bit_xor("h"), F.sum(F.shiftright("h", 24))).first()
        return tuple(row)

    current = cut_lineage(clean(edges))
    before = state(current)
    while before[0]:
        passed = cut_lineage(clean(_small_star(clean(_large_star(current)))))
        drop_cut(current)
        current = passed
        after = state(current)
        if after == before:
            break
        before = after
    return current.select("a", F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: Sequence[str] = (),
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id``, ``keep``, ``fingerprint`` (signed long), ``component_id``, the smallest
    doc_id of the documents that links reach from this one, and
    ``component_fingerprint``, the smallest fingerprint of them.

    Links join fingerprints that differ in at most ``radius`` bits.  Exact copies
    share a fingerprint and collapse before any shard is built, so a group of
    copies of any size is one point.  Fingerprints are written to the shared folder
    once; texts are read once and never shuffled.

    Null and word-less texts have fingerprint zero and are linked like any other.
    A null doc_id is never the smallest; a component of null ids only has a null
    component_id.  Repeated rows stay.  No rows in, no rows out.
    A column of ``keep`` named as an output column gives way to it.
    """
    made = (doc_id.lower(), "fingerprint", "component_id", "component_fingerprint")
    kept = [doc_id, *[c for c in keep if c.lower() not in made]]
    marked = cut_lineage(fingerprints(docs, text, kept))
    distinct = cut_lineage(
        marked.groupBy("fingerprint").agg(F.min(doc_id).alias("least_id"))
    )
    rooted = components(link_edges(distinct.select("fingerprint"), radius))
    labelled = distinct.join(
        rooted.withColumnRenamed("a", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    # Only components of several fingerprints need their smallest id gathered.
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least.hint("merge"), "root").select(
        "fingerprint", "component_id", F.col("root").alias("component_fingerprint")
    )
    return _by_fingerprint(marked, named)


def _by_fingerprint(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Join on the fingerprint; a hot fingerprint's rows are dealt by salt, and the
    narrow side is repeated once per salt."""
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = named.withColumn("__salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return salted.join(copies.hint("merge"), ["fingerprint", "__salt"]).drop("__salt")
