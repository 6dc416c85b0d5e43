"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of hashed word shingles. Equal sets fold into one class first. Then each of several independent
trees branches the classes: a node's seed chooses coordinates of the documents' minwise signatures, and a class goes
to the child named by its token there. Nodes that are small are compared exhaustively; large ones branch on. All trees
are one table (node, class), and a level of all trees is one shuffle.

Nothing is ever a row a pair. A node's members meet in one task: first by signature and size alone, which leaves the
members that may have a partner; then with their full sets, where likely pairs are confirmed and only the links of a
spanning forest leave the task, fewer than members. Links found so far are contracted to components; pairs of one
component, pairs that an earlier tree has compared, and nodes with a single component are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only_ids, settle, slices, table, text_rows, trimmed

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Hashes of full sets that meet in a task (8 bytes each); nodes with more are compared in blocks of half as many.
HELD = 2 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


#: Bytes of text that are hashed at once. A longer word is hashed by itself.
PIECE = 1 << 20
_PLAIN = bytes(0x20 if i in b"\x20\t\n\x0b\x0c\r" else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
_OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_powers: list[np.ndarray] = []


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, and of its inverse modulo 2 ** 64."""
    if not _powers:
        for base in (int(_M3), pow(int(_M3), -1, 1 << 64)):
            steps = np.full(PIECE + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a text in lower case with spaces only, and where the words start.

    A word's hash is a polynomial in its bytes, taken from the difference of two prefix sums.
    """
    hashes, places, at = [], [], 0
    while at < len(text):
        end = len(text) if at + PIECE >= len(text) else text.rfind(b" ", at, at + PIECE) + 1
        if not end:  # no space within reach
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            hashes.append(np.array([xxhash.xxh64_intdigest(text[at:end])], np.uint64))
            places.append(np.array([at]))
        else:
            b = np.frombuffer(text, np.uint8, end - at, at)
            gap = np.concatenate([[True], b == 0x20, [True]])
            starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
            up, down = _weights(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_OF_BYTE[b] * up[:-1], out=sums[1:])
            hashes.append(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M1))
            places.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(bodies: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Of each text the distinct hashed shingles of k words, ascending; of fewer words their whole sequence; none
    without words. A-Z count as a-z; words are parted by \\x20 and \\x09-\\x0D."""
    h, places = word_hashes(b" ".join(bodies).translate(_PLAIN))
    ends = np.searchsorted(places, np.cumsum([0, *(len(x) + 1 for x in bodies)]))

    def folded(n: int, first: int, last: int) -> np.ndarray:
        out = np.full(last - first, n, np.uint64)
        for i in range(n):  # the words' hashes are mixed already
            out = out * _M1 + h[first + i : last + i]
        return _mix(out)

    whole = folded(k, 0, max(0, len(h) - k + 1))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - k + 1]) if b - a >= k else folded(b - a, a, a + 1) if b > a else np.empty(0, np.uint64))
    return out


def shingles(body: bytes, k: int = 5) -> np.ndarray:
    return shingle_sets([body], k)[0]


def _coordinates(size: int) -> np.ndarray:
    return (_mix(np.arange(1, size + 1, dtype=np.uint64) * _M1) >> np.uint64(32)).astype(np.uint32)


def signature(own: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, as 32 bits of its mixed hash."""
    x, out = (own >> np.uint64(32)).astype(np.uint32), np.empty(len(salts), np.uint32)
    step = max(1, (1 << 16) // len(x))
    for a in range(0, len(salts), step):
        h = x[None, :] ^ salts[a : a + step, None]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        h.min(axis=1, out=out[a : a + step])
    return out.view(np.int32)


def sketch(docs: DataFrame, coordinates: int, id_col: str, text_col: str, with_sets: bool, k: int = 5) -> DataFrame:
    """id, n (shingles), twin (128-bit hash of the set; null for an empty one) and sig, or the set itself as bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _coordinates(coordinates)
        for batch in batches:
            for a, b in slices(batch.column(1), PIECE):
                sets = shingle_sets(batch.column(1)[a:b].to_pylist(), k)
                n = pa.array([len(x) for x in sets], pa.int64())
                twins = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
                if with_sets:
                    more = pa.array([x.tobytes() for x in sets], pa.binary())
                else:
                    more = pa.array([signature(x, salts).tobytes() if len(x) else None for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], n, twins, more], names=["id", "n", "twin", "more"])

    return text_rows(docs, id_col, text_col).mapInArrow(trimmed(work), f"id {kind}, n bigint, twin binary, more binary")


def components(links: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """(id, root) for every id in links (a, b): the smallest id reachable. Large-star and small-star rounds.

    Each round takes every id to the smallest of its neighbours and links the rest to that one, so the number of
    links never grows; hot ids are pre-aggregated on the map side. Ends when a round changes nothing.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    sums = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
    step, before = 0, edges.agg(*sums).first()
    while True:
        step += 1
        # Large star: every neighbour above u is linked to the smallest neighbour of u (or u).
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: all neighbours below u, and u, are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = settle(small.filter("a <> b").distinct(), f"{name}-{step}")
        after = edges.agg(*sums).first()
        if after == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = after


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches that hold whole nodes, with each node's rows [a, b); rows come sorted by node."""

    def cut(batch: pa.RecordBatch) -> list[int]:
        return [0, *(np.flatnonzero(np.diff(batch.column("node").to_numpy())) + 1).tolist(), batch.num_rows]

    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if tail is not None:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        ends = cut(batch)
        yield batch, list(zip(ends[:-2], ends[1:-1], strict=True))
        tail = batch.slice(ends[-2])
    if tail is not None:
        yield tail, [(0, tail.num_rows)]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class _Members:
    """What is compared of some rows: sizes, components, sides, signatures and trees in which pairs have met."""

    def __init__(self, batch: pa.RecordBatch):
        self.n, self.root, self.side, self.trees, self.seen = (_numbers(batch.column(c)) for c in ("n", "root", "side", "trees", "seen"))
        self.sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int32).reshape(batch.num_rows, -1)

    def partners(self, a: int, b: int, percent: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """For rows of the node [a, b), its later rows that may be linked: of another component and, in a node of two
        sides, of the other side; sizes and signatures allow it; no small node of an earlier tree has both."""
        n, root, side, sig, trees = self.n[a:b], self.root[a:b], self.side[a:b], self.sig[a:b], int(self.trees[a])
        met = (self.seen[a:b, None] >> np.arange(trees) & 1).astype(bool)
        two = side.min() != side.max()
        for i in range(len(n) - 1):
            may = (root[i + 1 :] != root[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :]))
            if two:
                may &= side[i + 1 :] != side[i]
            at = np.flatnonzero(may) + i + 1
            if len(at):
                same = sig[at] == sig[i]
                fits = same.sum(axis=1) >= least
                if trees:
                    fits &= ~(same[:, :trees] & met[i]).any(axis=1)
                at = at[fits]
                if len(at):
                    yield i, at


MEMBER = "node bigint, cid {kind}, n bigint, root bigint, side int, trees int, seen bigint, sig binary"


def _likely(members: DataFrame, kind: str, percent: int, least: int) -> DataFrame:
    """The members of nodes that may have a partner in their node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, nodes in _whole_nodes(batches):
            rows, keep = _Members(batch), np.zeros(batch.num_rows, bool)
            for a, b in nodes:
                for i, at in rows.partners(a, b, percent, least):
                    keep[a + i] = True
                    keep[a + at] = True
            if keep.any():
                yield batch.filter(pa.array(keep))

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(trimmed(work), MEMBER.format(kind=kind))


def _linked(members: DataFrame, kind: str, percent: int, least: int) -> DataFrame:
    """Links (a, b) that connect what is linked in a node: 100 * intersection >= percent * union of full sets (set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, nodes in _whole_nodes(batches):
            rows, first, second = _Members(batch), [], []
            for a, b in nodes:
                own = [np.frombuffer(x, np.uint64) for x in batch.column("set")[a:b].to_pylist()]
                ends = np.cumsum([0, *map(len, own)])
                token = np.unique(np.concatenate(own), return_inverse=True)[1]
                n, part = np.diff(ends), np.unique(rows.root[a:b], return_inverse=True)[1]
                mark = np.zeros(int(token.max()) + 1, np.int64)
                for i, at in rows.partners(a, b, percent, least):
                    at = at[part[at] != part[i]]
                    if not len(at):
                        continue
                    mark[token[ends[i] : ends[i + 1]]] = 1
                    if 4 * len(at) > b - a:
                        both = np.add.reduceat(mark[token], ends[:-1])[at]
                    else:
                        both = np.array([mark[token[ends[j] : ends[j + 1]]].sum() for j in at.tolist()])
                    mark[token[ends[i] : ends[i + 1]]] = 0
                    for j in at[100 * both >= percent * (n[i] + n[at] - both)].tolist():
                        if part[j] != part[i]:
                            first.append(a + i)
                            second.append(a + j)
                            part[part == part[j]] = part[i]
            if first:
                ids = batch.column("cid")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), ids.take(pa.array(second))], names=["a", "b"])

    members = members.repartition("node").sortWithinPartitions("node").select("node", "cid", "n", "root", "side", "trees", "seen", "sig", "set")
    return members.mapInArrow(trimmed(work), f"a {kind}, b {kind}")


#: The share of pairs just at the threshold that signatures may rule out.
MISS = 1e-5


def agreement(percent: int, coordinates: int) -> list[float]:
    """The probability of each number of coordinates on which a pair of that similarity agrees."""
    s = percent / 100
    return [comb(coordinates, a) * s**a * (1 - s) ** (coordinates - a) for a in range(coordinates + 1)]


def least_agreeing(percent: int, coordinates: int) -> int:
    """On how many coordinates a pair must agree to be looked at: a pair at the threshold falls below with MISS at most."""
    below = np.cumsum(agreement(percent, coordinates))
    return int(np.flatnonzero(below > MISS)[0])


def fewest_trees(percent: int) -> int:
    """Trees that start with a coordinate each, so that a pair at the threshold meets in none with MISS / 10 at most."""
    trees = 1
    while (1 - percent / 100) ** trees > MISS / 10:
        trees += 1
    return trees


def missed(percent: int, coordinates: int, trees: int, children: int, tokens: int, depth: int) -> float:
    """The probability that a pair at the threshold, always in nodes that branch, is in one node of no tree after depth branchings.

    All trees share the coordinates: given that the pair agrees on a of them, a tree starts with one of them without
    repetition, and a child keeps the pair if all its tokens agree. Copies of the pair in several children count.
    """
    out = 0.0
    for a, p in enumerate(agreement(percent, coordinates)):
        stays = 1.0
        for _ in range(depth):
            stays = 1 - (1 - (a / coordinates) ** tokens * stays) ** children
        for j in range(max(0, trees - coordinates + a), min(trees, a) + 1):
            out += p * comb(a, j) * comb(coordinates - a, trees - j) / comb(coordinates, trees) * (1 - stays) ** j
    return out


def branching(percent: int, coordinates: int, depth: int, trees: int | None = None) -> tuple[int, int, int]:
    """Trees, children of a node and tokens of a child with the fewest copies of a row that miss MISS of pairs at most.

    A tree's first level, which all rows have, weighs as much as 100 copies of the few rows in nodes that branch.
    One token only where more don't do; no children, so that large nodes are compared whole in blocks, where nothing does.
    """
    least = trees or fewest_trees(percent)
    for some in ((3, 2), (1,)):
        fit = [
            (t * (c**depth + 100), t, c, k)
            for t in ((trees,) if trees else range(least, min(3 * least, coordinates) + 1))
            for c in range(2, 7)
            for k in some
            if missed(percent, coordinates, t, c, k, depth) <= MISS
        ]
        if fit:
            return min(fit)[1:]
    return least, 0, 0


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    words: int = 5,
    trees: int | None = None,
    coordinates: int = 64,
    small: int = 2048,
    levels: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups documents that are linked, directly or over others, by 100 * intersection >= percent * union.

    Sets are distinct shingles of ``words`` words of the whole text, with A-Z in lower case; shorter texts are one
    shingle, texts without words are empty and linked with nothing. ``trees`` independent trees start with a
    coordinate each, so that a pair at the threshold meets in one with probability 1 - 1e-6 at least. A node of up to
    ``small`` members is compared exhaustively; a larger one branches into children, each by coordinates its seed
    picks. ``branching`` chooses trees (unless given), children and coordinates a child from ``percent`` and
    ``levels``, so that a pair at the threshold stays together in one tree with probability 1 - 1e-5 even if all its
    nodes branch to the last level. What is still large after ``levels`` levels, or can't branch so, is compared in
    blocks of ``small`` / 2 members against each other, so no cap drops a pair. Signatures rule out pairs that agree on
    fewer coordinates than ``least_agreeing`` tells from ``percent``, a pair at the threshold with probability 1e-5 at
    most; all others are confirmed on full sets. Sets are only made for members of such pairs, and only those texts are
    shuffled; a task holds 2M hashes of them at most, or two documents.

    Returns one row per input row: ``id_col``, n_shingles, component_id (smallest id of the component), kept
    (``id_col`` = component_id). Rows with a null id get their n_shingles, a null component_id and kept = true: they
    can't be named, so they aren't linked. Repeated rows give repeated results. Other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    coordinates = max(coordinates, trees or fewest_trees(percent))
    trees, children, tokens = branching(percent, coordinates, levels - 1, trees)
    least = least_agreeing(percent, coordinates)
    rows = settle(sketch(docs, coordinates, id_col, text_col, False, words), "near-sketch")
    own = rows.filter("twin is not null and id is not null")
    classes = settle(own.groupBy("twin").agg(F.min("id").alias("cid"), F.first("n").alias("n"), F.first("more").alias("sig")), "near-classes")

    def token(i):
        """The 4 bytes of the signature at coordinate i, a column or number."""
        return F.substring("sig", F.lit(1) + F.lit(4) * i, F.lit(4))

    def shared(members: DataFrame, name: str) -> DataFrame:
        """Members of nodes that hold two at least, with the node's size."""
        nodes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        return settle(members.join(nodes, "node"), name)

    def confirm(members: DataFrame, name: str) -> DataFrame | None:
        """Links among the members of each node (rows of MEMBER); None without likely ones."""
        likely = settle(_likely(members, kind, percent, least), f"{name}-likely")
        weights = likely.groupBy("node").agg(F.sum("n").alias("held"))
        most = weights.agg(F.max("held")).first()[0]
        if most is None:
            return None
        needed = likely.select(F.col("cid").alias("id")).distinct()
        texts = only_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", needed)
        sets = settle(sketch(texts, coordinates, "id", "text", True, words).select(F.col("id").alias("cid"), F.col("more").alias("set")), f"{name}-sets")
        if most > HELD:
            heavy = likely.join(weights, "node")
            likely = heavy.filter(F.col("held") <= HELD).drop("held").union(_blocks(heavy.filter(F.col("held") > HELD), "held", HELD).drop("held"))
        return settle(_linked(likely.join(sets.dropDuplicates(["cid"]), "cid"), kind, percent, least), f"{name}-links")

    def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Members with their component's number; those of nodes with one component go."""
        if roots is None:
            return members.withColumn("root", F.xxhash64("cid"))
        named = members.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.xxhash64(F.coalesce("root", "cid")))
        opened = named.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("node")
        return named.join(opened, "node", "left_semi")

    def full(members: DataFrame) -> DataFrame:
        """Rows of MEMBER from (node, cid, root, side, trees)."""
        return members.join(facts, "cid").select("node", "cid", "n", "root", "side", "trees", "seen", "sig")

    def contracted(roots: DataFrame | None, fresh: DataFrame | None, name: str) -> DataFrame | None:
        if fresh is None:
            return roots
        return components(fresh if roots is None else roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(fresh), spark, name)

    first = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(t, token(t)).alias("node"), t.alias("tree"))))
    members = shared(classes.select(first.alias("at"), "cid").select("at.node", "at.tree", "cid"), "near-nodes-1")
    # The trees, of the first 62, in whose small nodes a class is: all pairs there are compared.
    small_in = F.when((F.col("size") <= small) & (F.col("tree") < 62), F.expr("shiftleft(1L, tree)")).otherwise(F.lit(0).cast("bigint"))
    facts = settle(members.groupBy("cid").agg(F.bit_or(small_in).alias("seen")).join(classes.select("cid", "n", "sig"), "cid"), "near-facts")

    # The first tree alone: its small nodes whole; its large ones in chunks, with about 8 members in all chunks, so that
    # what is much alike is contracted before nodes branch.
    chunks = F.ceil(2 * F.col("size") / small)
    by_hash = F.when(F.col("size") <= small, F.array(F.lit(0).cast("bigint")))
    by_hash = by_hash.when(F.pmod(F.xxhash64("node", "cid"), F.col("size")) < 8, F.sequence(F.lit(0).cast("bigint"), chunks - 1))
    chunk = F.explode(by_hash.otherwise(F.array(F.pmod(F.xxhash64("cid", "node"), chunks))))
    start = members.filter("tree = 0").withColumn("chunk", chunk)
    start = start.select(F.xxhash64("node", "chunk").alias("node"), "cid", F.lit(0).alias("side"), F.lit(0).alias("trees"))
    roots = contracted(None, confirm(full(rooted(start, None)), "near-0"), "near-roots-0")
    left = rooted(members.filter(f"tree > 0 or size > {small}"), roots).withColumn("trees", F.least("tree", F.lit(62)))
    for level in range(1, levels + 1):
        left = settle(left.withColumn("side", F.lit(0)).select("node", "cid", "size", "root", "side", "trees"), f"near-open-{level}")
        now, many = left.filter(F.col("size") <= small), left.filter(F.col("size") > small)
        more = not many.isEmpty()
        last = level == levels or not children
        if more and last:
            now = now.union(_blocks(many, "size", small))
        roots = contracted(roots, confirm(full(now.drop("size")), f"near-{level}"), f"near-roots-{level}")
        if not more or last:
            break
        # As many levels of branching at once as a child has tokens: the seed of node and child picks the coordinates.
        seed = F.xxhash64("node", F.lit(level), "j")
        picked = [token(F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(coordinates)).cast("int")) for i in range(tokens)]
        signed = many.select("node", "cid").join(facts.select("cid", "sig"), "cid")  # before a member has a row for each child
        child = signed.select("node", "cid", "sig", F.explode(F.array(*map(F.lit, range(children)))).alias("j"))
        left = shared(child.select(F.xxhash64(seed, *picked).alias("node"), "cid"), f"near-nodes-{level + 1}")
        left = rooted(left, roots).withColumn("trees", F.lit(min(trees, 62)))
    class_root = classes.select("twin", "cid")
    class_root = class_root.withColumn("root", F.lit(None).cast(kind)) if roots is None else class_root.join(roots.withColumnRenamed("id", "cid"), "cid", "left")
    class_root = class_root.select("twin", F.coalesce("root", "cid").alias("root"))
    out = rows.select("id", "n", "twin").join(class_root, "twin", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _blocks(members: DataFrame, weight: str, most: int) -> DataFrame:
    """Large nodes as nodes of two sides: the members are dealt to parts of half of `most` by their node's weight, and
    any two parts are a node, as is each part alone."""
    parts = F.greatest(F.lit(2), F.ceil(2 * F.col(weight) / most)).cast("int")
    placed = members.withColumn("side", F.pmod(F.xxhash64("cid"), parts.cast("bigint")).cast("int")).withColumn("_parts", parts)
    mates = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(F.least("side", j).alias("x"), F.greatest("side", j).alias("y")))
    return placed.withColumn("_m", F.explode(mates)).withColumn("node", F.xxhash64("node", "_m.x", "_m.y")).select(*members.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
