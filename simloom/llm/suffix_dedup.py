"""Removal of long repeated strings: anchors deal all texts out, suffix arrays by linear grouping decide.

Two equal strings of 200 bytes hold the same 64-byte anchor at the same place: the one whose hash is the lowest of
the 137 in the string. So all starts of strings are divided among anchors, and only starts with equal anchors can be
equal. Of those, most are settled by the hash of their whole surroundings. What is left - the borders of repeated
passages - is cut into blocks of 16 neighbouring starts. The strings of a block share a core of 185 bytes, which
becomes one symbol; the 15 bytes on either side stay. A suffix array over the blocks with equal cores then tells which
starts have an equal string: those that share 16 symbols with a neighbour in the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, drop_settled, marked, only_ids, settle, slices, table, text_rows, trimmed, without_ids

LENGTH, ANCHOR = 200, 64
REACH = LENGTH - ANCHOR  # starts lie 0 to 136 bytes before their anchor
BLOCK = 16
#: Blocks with equal cores that one suffix array covers; a larger group is split by the bytes that the first or the last
#: half of its starts need to have in common, again and again.
MOST = 2000
#: Bits of the bitmap of anchors that goes to the tasks (8 MB).
BITS = 1 << 26

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(0xFFFFFF)


# --- suffix array ---------------------------------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by linear grouping; the last symbol must be the only one of the lowest value.

    First, suffixes are gathered in groups of equal Lyndon prefixes: going down from the highest group, each of its
    suffixes points to the nearest suffix before it that is in a lower group, and the suffixes so pointed to leave
    their group for a new one right above it, ordered by how many pointed to them. Then, going up, each suffix in its
    final place puts the one before it, and what that one points to, at the front of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, {}
    start = 0
    for r, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = r
        place[s], group[s] = r, start
        size[start] = r - start + 1
    smaller = [-1] * n
    top = n
    while top:
        g = group[order[top - 1]]
        pointed: dict[int, int] = {}
        for s in sorted(order[g:top]):
            j = s - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[s] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        top = g
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for times, old in sorted(moves):
            own = moves[times, old]
            end = old + size[old]
            fresh = end - len(own)
            for j in own:
                end -= 1
                other, at = order[end], place[j]
                order[at], place[other] = other, at
                order[end], place[j] = j, end
                group[j] = fresh
            size[old] -= len(own)
            size[fresh] = len(own)
    out, front, placed = [0] * n, {g: g for g in size}, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = smaller[j]
    return out


def repeated_starts(variants: list[tuple[bytes, bytes]]) -> list[int]:
    """For each block of one core, given by the bytes left and right of it, a bit for each start whose string another block has too."""
    side, core = BLOCK - 1, 256
    own = 257 + len(variants)  # symbols that occur once: borders, and places beyond a text's ends
    text: list[int] = []
    for left, right in variants:
        row = [*range(own, own + side - len(left)), *(b + 1 for b in left), core + 1]
        own += side - len(left)
        row += [*(b + 1 for b in right), *range(own, own + side - len(right) + 1)]
        own += side - len(right) + 1
        text += row
    text.append(0)
    width, found = 2 * side + 2, [0] * len(variants)
    order = suffix_array(text)
    before = None
    for s in order:
        if s % width < BLOCK:  # a start of the block, so its 16 symbols hold the core
            if before is not None and text[before : before + BLOCK] == text[s : s + BLOCK]:
                for x in (before, s):
                    found[x // width] |= 1 << x % width
            before = s
    return found


# --- anchors --------------------------------------------------------------------------------------------------------


class Anchors:
    """The anchors of the starts of some texts. Starts low..high (counted over the texts on end) have the anchor at `at`."""

    def __init__(self, bodies: list[bytes]):
        self.raw = b"".join(bodies)
        b, n = np.frombuffer(self.raw, np.uint8), len(self.raw)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        usable = [(i, int(self.starts[i]), int(self.starts[i + 1])) for i in np.flatnonzero(sizes >= LENGTH)]
        if not usable:
            self.doc = self.low = self.high = self.at = np.empty(0, np.int64)
            self.key = np.empty(0, np.int64)
            return
        h, step = _BYTE[b], 1
        while step < ANCHOR:
            g = h * _MUL[step.bit_length()]
            g[: n - step] += h[step:]
            h, step = g, step * 2
        h ^= h >> np.uint64(29)
        h *= _MUL[0]
        low, step = (h & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
        while step * 2 <= REACH + 1:
            g = low.copy()
            np.minimum(low[: n - step], low[step:], out=g[: n - step])
            low, step = g, step * 2
        rest = REACH + 1 - step
        g = low.copy()
        np.minimum(low[: n - rest], low[rest:], out=g[: n - rest])
        at = (g & _PLACE).astype(np.int64)
        parts = []
        for i, a, z in usable:
            own = at[a : z - LENGTH + 1]
            new = np.flatnonzero(np.diff(own)) + 1
            first = np.concatenate([[0], new])
            parts.append((np.full(len(first), i), a + first, a + np.append(new, len(own)) - 1, own[first]))
        self.doc, self.low, self.high, self.at = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.key = h[self.at].view(np.int64)


    def keep(self, mask: np.ndarray) -> Anchors:
        self.doc, self.low, self.high, self.at, self.key = (x[mask] for x in (self.doc, self.low, self.high, self.at, self.key))
        return self


#: Bytes of texts whose anchors are found at once; places must fit in _PLACE, and one longer text is cut by itself.
_AT_ONCE = 4 << 20


def _anchored(batches: Iterator[pa.RecordBatch]):
    """(ids, place of the part in its text, the whole text if it is cut, Anchors) of ranges of rows.

    A long text goes in parts. All starts of an anchor belong to the part where the first of them lies: a part also
    sees the start before it, and REACH starts beyond its end.
    """
    for batch in batches:
        for a, b in slices(batch.column(1), _AT_ONCE):
            bodies = batch.column(1)[a:b].to_pylist()
            if len(bodies) == 1 and len(bodies[0]) > 3 * _AT_ONCE:
                for x in range(0, len(bodies[0]) - LENGTH + 1, _AT_ONCE):
                    before = min(x, 1)
                    found = Anchors([bodies[0][x - before : x + _AT_ONCE + REACH + LENGTH]])
                    yield batch.column(0)[a:b], x - before, bodies[0], found.keep((found.low >= before) & (found.low < before + _AT_ONCE))
            else:
                yield batch.column(0)[a:b], 0, None, Anchors(bodies)


def _find_anchors(rows: DataFrame, kind: str) -> DataFrame:
    """A row an anchor: id, place of the first start in the text, anchor's key, starts' distances, hash of the surroundings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shift, _, found in _anchored(batches):
            if not len(found.at):
                continue
            raw, digest = found.raw, xxhash.xxh3_64_intdigest
            around = [digest(raw[a:b]) for a, b in zip(found.low.tolist(), (found.high + LENGTH).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(found.doc)),
                    pa.array(found.low - found.starts[found.doc] + shift),
                    pa.array(found.key),
                    pa.array((found.at - found.low).astype(np.int16)),
                    pa.array((found.at - found.high).astype(np.int16)),
                    pa.array(np.array(around, np.uint64).view(np.int64)),
                ],
                names=["id", "place", "key", "far", "near", "around"],
            )

    return rows.mapInArrow(trimmed(work), f"id {kind}, place bigint, key bigint, far smallint, near smallint, around bigint")


def _key_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of anchors' keys, of a fixed size, on the driver."""
    at = F.pmod("key", F.lit(BITS))
    marks = keys.select(F.floor(at / 32768).cast("int").alias("b"), (at % 32768).alias("at")).groupBy("b").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in marks.toLocalIterator():
        out[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _cut_blocks(rows: DataFrame, kind: str, keys: DataFrame) -> DataFrame:
    """A row a block of an anchor whose key may be among keys: id, place of the block's first start in the text, key,
    block, core's hash, bytes left and right of the core, first and last start that the anchor has in the block."""
    bits = rows.sparkSession.sparkContext.broadcast(_key_bits(keys))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, side = xxhash.xxh3_64_intdigest, BLOCK - 1
        for ids, shift, whole, found in _anchored(batches):
            if not len(found.at):
                continue
            spot = np.mod(found.key, BITS)
            hit = np.flatnonzero(bits.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
            raw = whole if whole is not None else found.raw
            out: tuple[list, ...] = tuple([] for _ in range(9))
            for doc, low, high, at, key in zip(*(x[hit].tolist() for x in (found.doc, found.low, found.high, found.at, found.key)), strict=True):
                begin, end = (0, len(whole)) if whole is not None else (int(found.starts[doc]), int(found.starts[doc + 1]))
                move = shift if whole is not None else 0
                first = at + move - REACH
                for k in range((low + move - first) // BLOCK, (high + move - first) // BLOCK + 1):
                    a = first + k * BLOCK
                    core = raw[a + side : a + LENGTH]
                    row = (
                        doc, a - begin, key, k, digest(core), raw[max(begin, a) : a + side], raw[a + LENGTH : min(end, a + LENGTH + side)],
                        max(low + move - a, 0), min(high + move - a, side),
                    )
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(out[0], pa.int64())),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.int16()),
                    pa.array(np.array(out[4], np.uint64).view(np.int64)),
                    pa.array(out[5], pa.binary()),
                    pa.array(out[6], pa.binary()),
                    pa.array(out[7], pa.int16()),
                    pa.array(out[8], pa.int16()),
                ],
                names=["id", "place", "key", "block", "core", "left", "right", "first", "last"],
            )

    return rows.mapInArrow(
        trimmed(work), f"id {kind}, place bigint, key bigint, block smallint, core bigint, left binary, right binary, first smallint, last smallint"
    )


VARIANT = "key bigint, block smallint, core bigint, left binary, right binary"
GROUP = ["key", "block", "core", "low", "high", "own"]


def _decide(variants: DataFrame) -> DataFrame:
    """The suffix arrays: a row a variant and range of starts with the bits of its repeated starts.

    variants: those of VARIANT with n (blocks that are alike), low, high (the range of starts) and own (the bytes that
    all starts of the range have in common in a group).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is not None:
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(batch.num_rows - 1, bool)
            for c in ("key", "block", "core", "low"):
                new |= np.diff(batch.column(c).to_numpy()) != 0
            own = batch.column("own").to_pylist()
            for i in np.flatnonzero(~new).tolist():
                new[i] = own[i] != own[i + 1]
            ends = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield decided(batch.slice(0, ends[-1]), ends)
            tail = batch.slice(ends[-1])
        if tail is not None:
            yield decided(tail, [0, tail.num_rows])

    def decided(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        left, right, n, low, high = (batch.column(c).to_pylist() for c in ("left", "right", "n", "low", "high"))
        bits = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            mask = (1 << high[a]) - (1 << low[a])
            if all(k > 1 for k in n[a:b]):  # all starts have an equal one
                bits += [mask] * (b - a)
            elif b - a == 1:
                bits.append(0)
            else:
                found = repeated_starts(list(zip(left[a:b], right[a:b], strict=True)))
                bits += [mask if k > 1 else x & mask for x, k in zip(found, n[a:b], strict=True)]
        out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bits, pa.int32())], names=[*batch.schema.names[:5], "bits"])
        return out.filter(pa.array([x > 0 for x in bits], pa.bool_()))

    placed = variants.repartition("key", "block", "core", "low", "own").sortWithinPartitions(*GROUP)
    return placed.select("key", "block", "core", "left", "right", "n", "low", "high", "own").mapInArrow(trimmed(work), VARIANT + ", bits int")


def _ranged(variants: DataFrame) -> DataFrame:
    return variants.withColumns({"low": F.lit(0), "high": F.lit(BLOCK), "own": F.lit(b"")})


def _split(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranged variants in groups of MOST at most, and the bits of those single starts that still make larger groups.

    A larger group's range of starts is halved. Starts from `low` to before `high` share the bytes left of the core
    from high - 1 on, and the first `low` bytes right of it; variants without them have no start in the range.
    """
    whole = _ranged(variants)
    for _ in range(BLOCK.bit_length() - 1):
        sizes = whole.groupBy(*GROUP).agg(F.count("*").alias("size")).filter((F.col("size") > MOST) & (F.col("high") - F.col("low") > 1))
        large = settle(sizes.select(*GROUP), "suffix-large")
        if large.isEmpty():
            break
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))))
        parts = whole.join(large, GROUP, "left_semi").select(*variants.columns, halves.alias("half")).select(*variants.columns, "half.*")
        parts = parts.filter(f"octet_length(left) >= {BLOCK} - high and octet_length(right) >= low")
        own = F.concat(F.expr(f"substring(left, octet_length(left) - {BLOCK - 1} + high, {BLOCK})"), F.expr("substring(right, 1, low)"))
        whole = settle(whole.join(large, GROUP, "left_anti").unionByName(parts.withColumn("own", own)), "suffix-split")
    # A group of one start holds equal strings alone.
    single = whole.filter("high - low = 1")
    twice = single.groupBy(*GROUP).agg(F.sum("n").alias("k")).filter("k > 1")
    found = single.join(twice, GROUP, "left_semi").select(*variants.columns[:5], F.expr("shiftleft(1, low)").alias("bits"))
    return whole.filter("high - low > 1"), found


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): spans of bytes that strings of 200 bytes cover which also start elsewhere; they may overlap.

    Exact but for collisions of 128 bits of hashes. Rows with a null id take part, but no span can name them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = text_rows(docs, id_col, text_col)
    anchors = settle(_find_anchors(rows, kind), "suffix-anchors")
    again = settle(anchors.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "suffix-keys")
    shared = marked(anchors, "key", again.withColumnRenamed("key", "id")).filter("_hit").drop("_hit")
    where = ["key", "far", "near", "around"]
    settled = settle(shared.groupBy(*where).agg(F.count("*").alias("n")), "suffix-around")
    # Equal surroundings: all starts are repeated.
    same = settled.filter("n > 1").select(*where)
    whole = shared.join(same, where, "left_semi").select("id", F.col("place").alias("start"), (F.col("place") + F.col("far") - F.col("near") + LENGTH).alias("end"))

    keys = settled.groupBy("key").agg(F.count("*").alias("variants"), F.min("n").alias("least")).filter("variants > 1 and least = 1")
    keys = settle(keys.select("key", "variants"), "suffix-open")
    variant = ["key", "block", "core", "left", "right"]
    blocks = settle(_cut_blocks(rows, kind, keys).join(keys, "key", "left_semi"), "suffix-blocks")
    variants = settle(blocks.groupBy(*variant).agg(F.count("*").alias("n")), "suffix-variants")
    # A group has no more variants than its anchor has surroundings.
    heavy = settle(keys.filter(F.col("variants") > MOST).select("key"), "suffix-heavy")
    if heavy.isEmpty():
        bits = _decide(_ranged(variants))
    else:
        parts, single = _split(variants.join(heavy, "key", "left_semi").select(*variant, "n"))
        bits = _decide(_ranged(variants.join(heavy, "key", "left_anti").select(*variant, "n")).unionByName(parts)).union(single)
        bits = bits.groupBy(*variant).agg(F.bit_or("bits").alias("bits"))
    bits = settle(bits, "suffix-bits")
    own = blocks.join(bits, variant).select(
        "id", "place", (F.col("bits").bitwiseAND(F.expr("shiftleft(1, last + 1) - shiftleft(1, first)"))).alias("bits")
    )
    runs = F.expr(
        f"filter(transform(sequence(0, {BLOCK - 1}), i -> IF(shiftright(bits, i) % 2 = 1, i, -1)), i -> i >= 0)"
    )
    # Starts of one block lie closer than 200 bytes, so their strings make one span.
    low, high = F.array_min("_on"), F.array_max("_on")
    some = own.filter("bits <> 0").withColumn("_on", runs).select("id", (F.col("place") + low).alias("start"), (F.col("place") + high + LENGTH).alias("end"))
    return whole.union(some)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Takes out each byte of a text that a string of 200 bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross texts; overlapping occurrences count; all is judged on the input. Each
    text is cut from its own spans alone, so only texts that have spans are shuffled.

    Returns one row per input row: ``id_col``, n_bytes, n_removed, spans (maximal removed runs, array of start and
    end) and kept (the remaining bytes). Null and empty texts, and texts shorter than 200 bytes, stay as they are.
    Rows with a null id stay whole, though their strings count for others. Repeated rows are repeats of each other;
    ids must tell rows with different texts apart. Very long texts are searched in overlapping parts; nothing but a
    whole text's own bytes is held at once. Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = settle(repeated_spans(docs, id_col, text_col).filter("id is not null").distinct(), "suffix-spans")
    ids = spans.select("id").distinct()
    rows = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("body"))
    clean = without_ids(rows, "id", ids).select("id", F.octet_length("body").cast("bigint").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("body").alias("kept"))
    listed = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            runs, kept, sizes = [], [], []
            for body, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[dict] = []
                for s in sorted(own, key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                cuts = [0, *(x for s in merged for x in (s["start"], s["end"])), len(body)]
                runs.append(merged)
                kept.append(b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    cut = only_ids(rows, "id", ids).join(listed, "id").select("id", "body", "spans")
    cut = cut.mapInArrow(trimmed(work), f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    out = clean.union(cut)
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "spans", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
