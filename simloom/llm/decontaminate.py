"""Benchmark decontamination by an FM-index per training shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, settle, slices, table, text_rows, trimmed

# Bytes of words after lower-casing A-Z are digits, a-z and all bytes of characters beyond ASCII.
_WORD = bytes(b"0123456789abcdefghijklmnopqrstuvwxyz") + bytes(range(0x80, 0x100))
_TO_WORDS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if (b | 0x20 if 0x41 <= b <= 0x5A else b) in _WORD else 0x20 for b in range(256))

#: Bytes of a shard's texts that one index covers.
SHARD_BYTES = 48 << 20
#: Rows between sampled suffix positions.
SAMPLE = 8
#: Bytes of benchmark text that are broadcast at once; more is dealt with in blocks.
BLOCK_BYTES = 32 << 20


def words(body: bytes) -> list[bytes]:
    return body.translate(_TO_WORDS).split()


class WaveletTree:
    """Rank of a symbol in a prefix of a sequence, in one bit vector a level (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place; both are arrays."""
        low, high = np.zeros_like(at), at
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            one = before[at + 1] > before[at]
            out |= one.astype(out.dtype) << bit
            at = np.where(one, zeros + before[at], at - before[at])
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling ranks."""
    n = len(symbols)
    rank, step = symbols.astype(np.int64), 1
    while True:
        key = rank * (max(int(rank.max()), n) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = fresh, step * 2
        if int(rank.max()) == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search over a sequence of symbols from 1 up; 0 is kept for the end."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_order(text)
        self.bwt = WaveletTree(text[order - 1], max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.sampled = order % SAMPLE == 0
        self.below = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases of one length, a row each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.sampled), np.int64)
        for symbol in phrases.T[::-1]:
            low = self.first[symbol] + self.bwt.rank(symbol, low)
            high = self.first[symbol] + self.bwt.rank(symbol, np.maximum(high, 0))
            high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes given by their rows: walks back to a sampled one."""
        rows, steps, out, left = rows.copy(), 0, np.empty(len(rows), np.int64), np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.places[self.below[rows[done]]] + steps
            rows, left, steps = rows[~done], left[~done], steps + 1
            symbol = self.bwt.access(rows)
            rows = self.first[symbol] + self.bwt.rank(symbol, rows)
        return out


class Phrases:
    """The benchmark's windows: `window` consecutive words of an item, or the whole of a shorter one."""

    def __init__(self, items: list[tuple], window: int):
        self.ids: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set]] = {}
        for item, body in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + 2) for w in words(body)]  # 1: any other word, or a border
            n = min(window, len(symbols))
            for i in range(len(symbols) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(symbols[i : i + n]), set()).add(item)
        self.lengths = sorted(found)
        self.by_length = {n: (np.array(list(w), np.int64).reshape(-1, n), list(w.values())) for n, w in found.items()}


def match_shard(bodies: list[bytes], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], list]]:
    """For each document: number of words, merged spans of hit words [start, end), items with windows in it."""
    get, counts, parts = phrases.ids.get, [], []
    for x in bodies:
        found = words(x)
        counts.append(len(found))
        parts.append(np.fromiter((get(w, 1) for w in found), np.int64, len(found)))
        parts.append(np.ones(1, np.int64))
    text = np.concatenate(parts) if parts else np.ones(0, np.int64)
    # A window holds only benchmark words, so runs of those that are shorter than the shortest window go.
    known = np.concatenate([[False], text > 1, [False]])
    starts, ends = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    long = ends - starts >= (phrases.lengths[0] if phrases.lengths else 1 << 60)
    starts, ends = starts[long], ends[long]
    doc_at = np.cumsum([0, *(c + 1 for c in counts)])
    hit_docs, hit_starts, hit_lengths, hit_sets = [], [], [], []
    if len(starts):
        sizes = ends - starts + 1  # with a border
        new_at = np.concatenate([[0], np.cumsum(sizes)])
        origin = np.repeat(starts - new_at[:-1], sizes) + np.arange(new_at[-1])
        kept = np.where(np.arange(new_at[-1]) == np.repeat(new_at[1:] - 1, sizes), 1, text[np.minimum(origin, len(text) - 1)])
        index = FMIndex(kept, len(phrases.ids) + 1)
        for n, (rows, sets) in phrases.by_length.items():
            low, high = index.search(rows)
            size = high - low
            which = np.repeat(np.arange(len(rows)), size)
            if not len(which):
                continue
            inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            place = origin[index.locate(low[which] + inside)]
            doc = np.searchsorted(doc_at, place, "right") - 1
            hit_docs.append(doc)
            hit_starts.append(place - doc_at[doc])
            hit_lengths.append(np.full(len(doc), n))
            hit_sets.extend((d, sets[w]) for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)))
    items: dict[int, set] = {}
    for d, own in hit_sets:
        items.setdefault(d, set()).update(own)
    spans: dict[int, list[tuple[int, int]]] = {}
    if hit_docs:
        doc, start, length = map(np.concatenate, (hit_docs, hit_starts, hit_lengths))
        by = np.lexsort((start, doc))
        for d, a, b in zip(doc[by].tolist(), start[by].tolist(), (start + length)[by].tolist(), strict=True):
            own = spans.setdefault(d, [])
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], b))
            else:
                own.append((a, b))
    for d, n in enumerate(counts):
        yield n, spans.get(d, []), sorted(x for x in items.get(d, ()) if x is not None)


def _match_block(rows: DataFrame, items: list[tuple], item_kind: T.DataType, window: int) -> DataFrame:
    """For rows (id, body), their ids with n_words, spans and items."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(items)  # BLOCK_BYTES at most
    kind, of_items = rows.schema["id"].dataType.simpleString(), pa.list_(to_arrow_type(item_kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)

        def flush(ids: list, bodies: list) -> Iterator[pa.RecordBatch]:
            found = match_shard(bodies, phrases)
            for own in ids:
                made = [next(found) for _ in range(len(own))]
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        pa.array([r[0] for r in made], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([r[2] for r in made], of_items),
                    ],
                    names=["id", "n_words", "spans", "items"],
                )

        ids, bodies, held = [], [], 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.column(1)[a:b].to_pylist()
                ids.append(batch.column(0)[a:b])
                bodies += part
                held += sum(map(len, part))
                if held >= SHARD_BYTES:
                    yield from flush(ids, bodies)
                    ids, bodies, held = [], [], 0
        if ids:
            yield from flush(ids, bodies)

    return rows.mapInArrow(
        trimmed(work), f"id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<{item_kind.simpleString()}>"
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Finds the benchmark's windows in every whole text.

    One row per input row: ``id_col``, n_words, spans (hit words, merged, [start, end) in words) and items (ids of
    items with an occurring window, ascending). Each task indexes its shard of texts: words that occur in the
    benchmark are symbols, all others and the borders between documents are one more symbol; an FM-index with a
    wavelet tree over the Burrows-Wheeler transform takes the phrases by backward search, sampled suffix positions
    locate the occurrences, and spans are merged. No shuffle. The benchmark's size is checked: it is sent to the
    tasks in blocks of 32 MB at most, and with more than one block the documents' spans are merged over the blocks.

    Item ids may be of any type that orders, such as text. Very long texts are a shard of their own, which an index covers
    as a whole. Null text and null items have no words; an empty benchmark hits nothing; repeated items count by their id; null
    item ids are left out of items, though their windows hit. Repeated documents and null ids give a row each, however
    many blocks the benchmark has: the blocks' spans are merged by a key of the row's own, under which texts are written
    once to the scratch folder.
    """
    items = benchmark.select(F.col(item_id_col).alias("id"), as_bytes(item_text_col).alias("body"))
    item_kind = items.schema["id"].dataType
    total = items.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_BYTES // 2)))

    # Each row under a key of its own, kept with its id: ids may repeat or be null.
    rows = text_rows(docs, id_col, text_col)
    if blocks > 1:
        rows = settle(rows.select(F.struct(F.monotonically_increasing_id().alias("key"), "id").alias("id"), "body"), "decontaminate-rows")

    def block(k: int) -> DataFrame:
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == k)
        return _match_block(rows, [(r[0], bytes(r[1])) for r in own.toLocalIterator()], item_kind, window)

    out = block(0)
    if blocks > 1:
        for k in range(1, blocks):
            out = out.union(block(k))
        out = out.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        merged = """aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
            CASE WHEN size(acc) > 0 AND s.start <= element_at(acc, -1).end
            THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start AS start, greatest(element_at(acc, -1).end, s.end) AS end)))
            ELSE concat(acc, array(s)) END)"""
        out = out.select("id", "n_words", F.expr(merged).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")).withColumn("id", F.col("id.id"))
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
