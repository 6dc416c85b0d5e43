"""Byte-level BPE: higher-order functions fold ranked merges over byte arrays of distinct words."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_array, release, settle, slices, table, text_rows, trimmed

#: Words in the code book at most: the most frequent ones. Rarer words are folded where they stand.
BOOK = 500_000
#: Words of more bytes are split by a heap in Python instead: the fold's time grows with the square of the length.
FOLDED_BYTES = 256
#: Entries of a worker's cache from pieces of text to ids; past that it starts anew, but for what the last one still gives.
CACHE = 100_000
#: Distinct pieces that a task counts before it passes its counts on.
COUNTED = 200_000


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# --- the fold, in Spark's higher-order functions -------------------------------------------------------------------

#: Bits of an id and of a place in packed numbers, and more pieces than a word has.
ID_BITS, PLACE_BITS, MOST = 18, 9, 1 << 30


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass
class RankMap:
    """Ranks of pairs of ids as two literal arrays, laid out so that a look-up takes two accesses.

    Spark looks a key up in a map literal by going through its keys. Here the left id gives a shift, and the shift plus
    the right id is the only slot where the pair can be: the sparse table of ranks by left and right id, its rows laid
    over each other. A slot holds the left id and the rank of the merged piece, which is its id.
    """

    shift: Column
    slots: Column
    of_byte: Column
    edge: int


def lay_rows(found: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The shift of each left id up to the edge, and the slots, of pairs (left, right, rank). Long rows come first."""
    a, b, rank = found.T
    step = 4096
    size = step * (1 + 3 * len(found) // step)
    slots, shift, rng = np.full(size + edge + 1, (1 << 2 * ID_BITS) - 1, np.int64), np.zeros(edge + 1, np.int64), np.random.default_rng(5)
    order = np.argsort(a, kind="stable")
    rows = np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else []
    taken = np.zeros(len(slots), bool)
    for own in sorted(rows, key=len, reverse=True):
        places = b[own]
        for k in range(64):  # single shifts for short rows, then ranges of them
            if len(own) <= 8 and k < 8:
                at = int(rng.integers(size))
                if not taken[at + places].any():
                    break
                continue
            low = int(rng.integers(size // step)) * step
            hit = np.zeros(step, bool)
            for x in places.tolist():
                hit |= taken[low + x : low + x + step]
            if not hit.all():
                at = low + int(np.flatnonzero(~hit)[0])
                break
        else:
            raise ValueError("the ranks find no place")
        taken[at + places] = True
        shift[a[own[0]]] = at
        slots[at + places] = a[own] << ID_BITS | rank[own]
    return shift, slots


def rank_map(ranks: dict[bytes, int]) -> RankMap:
    found = []
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                found.append((left, right, rank))
    edge = max(ranks.values(), default=0) + 1
    if edge >= (1 << ID_BITS) - 1:
        raise ValueError(f"ids up to {(1 << ID_BITS) - 3} only")
    shift, slots = lay_rows(np.array(found, np.int64).reshape(-1, 3), edge)
    return RankMap(number_array(shift, "int"), number_array(slots, "bigint"), number_array([ranks[bytes([i])] for i in range(256)], "int"), edge)


def piece_list(ranks: dict[bytes, int]) -> Column:
    """The hex digits of each id's bytes as one literal array."""
    out = [""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k.hex().upper()
    return F.from_json(F.lit(json.dumps(out)), "array<string>")


def byte_ids(word: Column, of_byte: Column) -> Column:
    """A word as the ids of its single bytes."""
    digits = F.hex(word)
    return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.get(of_byte, F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))


def fold_merges(words: Column, ranks: RankMap) -> Column:
    """Ids of each word of an array of byte arrays (as ids of single bytes).

    A step merges, of all neighbours that form a ranked piece, the first of the lowest rank; a word of n bytes takes
    n - 1 steps at most, and has FOLDED_BYTES at most. The state is one array. An entry holds, from its low bits up, a
    piece's id, its place, and the rank of the pair that it forms with the next piece, or a larger number if it forms
    none. So the least entry is the next pair to merge.
    """
    id_mask, own = (1 << ID_BITS) - 1, ID_BITS + PLACE_BITS

    def fold(word: Column, shift: Column, slots: Column) -> Column:
        def entry(tag: Column, a: Column, b: Column) -> Column:
            """The entry of a piece (place and id; id) that the piece b follows."""
            slot = F.get(slots, F.get(shift, a.cast("int")) + b.cast("int"))
            return F.shiftleft(slot.bitwiseXOR(F.shiftleft(a, ID_BITS)), own).bitwiseOR(tag)

        def merged(acc: Column, low: Column) -> Column:
            def at_place(at: Column) -> Column:
                # The pieces at and at + 1 become one, and so the pairs on both sides of it change.
                def beside(piece: Column) -> Column:
                    before = F.get(acc, at - 2)
                    left = entry(before.bitwiseAND(F.lit((1 << own) - 1)), before.bitwiseAND(F.lit(id_mask)), piece)
                    made = low.bitwiseAND(F.lit(((1 << PLACE_BITS) - 1) << ID_BITS)).bitwiseOR(piece)
                    right = entry(made, piece, F.get(acc, at + 1).bitwiseAND(F.lit(id_mask)))
                    # Three parts put together; flatten takes less time for it than concat.
                    return F.flatten(F.array(F.slice(acc, 1, at - 2), F.array(left, right), F.slice(acc, at + 2, MOST)))

                return _let(F.shiftright(low, own), beside)

            return F.when(low >= 1 << own + ID_BITS, acc).otherwise(_let(F.array_position(acc, low).cast("int"), at_place))

        # A border on either side, which forms no piece, so that every pair has one before and one after it.
        edge = F.array(F.lit(ranks.edge).cast("bigint"))

        def start(pieces: Column) -> Column:
            place = lambda i: F.shiftleft(i.cast("bigint"), ID_BITS)
            return F.transform(F.slice(pieces, 1, F.size(word) + 2), lambda x, i: entry(x.bitwiseOR(place(i)), x, F.get(pieces, i + 1)))

        done = F.aggregate(
            F.sequence(F.lit(2), F.size(word)),
            _let(F.concat(edge, F.transform(word, lambda x: x.cast("bigint")), edge, edge), start),
            lambda acc, _: _let(F.array_min(acc), lambda low: merged(acc, low)),
            lambda acc: F.transform(F.slice(acc, 2, F.size(acc) - 2), lambda x: x.bitwiseAND(F.lit(id_mask)).cast("int")),
        )
        return F.when(F.size(word) < 2, word).otherwise(done)

    return _let(ranks.shift, lambda shift: _let(ranks.slots, lambda slots: F.transform(words, lambda w: fold(w, shift, slots))))


def split_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of pairs over a linked list."""
    import heapq

    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# --- pieces of text ------------------------------------------------------------------------------------------------


#: White space other than the four below, in Python's or the pattern's sense.
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def pieces(text: str) -> tuple[list[str], list[str]]:
    """Pieces whose matches together are the text's: those as they are, and those that a space goes before.

    A text is cut before spaces that follow a character other than white space: no match holds a space after such a
    character.
    """
    parts = text.split(" ")
    if not (text.startswith(" ") or "  " in text or "\n " in text or "\t " in text or "\r " in text or _RARE_SPACE.search(text)):
        return parts[:1], parts[1:]
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out, []


def finder(pattern: str):
    """A function to the pattern's matches in a piece. Two words at a line's end, `a.` and `b` with a line feed between
    them, are the most frequent pieces that aren't words: they are cut without the pattern, if it cuts these so."""
    find = regex.compile(pattern).findall
    if any(find(f"{x}a{y}\nb{z}") != [f"{x}a", y, "\n", "b", *z] for x in ("", " ") for y in ".," for z in ("", ".", ",")):
        return find

    def found(piece: str) -> list[str]:
        head, feed, tail = piece.partition("\n")
        if feed and head[-1:] in (".", ","):
            word = head[:-1]
            if (word[1:] if word[:1] == " " else word).isalpha():
                if tail.isalpha():
                    return [word, head[-1], feed, tail]
                if tail[-1:] in (".", ",") and tail[:-1].isalpha():
                    return [word, head[-1], feed, tail[:-1], tail[-1]]
        return find(piece)

    return found


def count_words(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(word, n): how often each match of the pattern occurs, counted within tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, plain, spaced, rows = finder(pattern), Counter(), Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for seen, before in ((plain, ""), (spaced, " ")):
                for piece, n in seen.items():
                    if piece.isalpha():  # one match, whatever stands around it
                        rows[before + piece] += n
                    elif piece[-1:] in (".", ",") and piece[:-1].isalpha():
                        rows[before + piece[:-1]] += n
                        rows[piece[-1]] += n
                    else:
                        for w in find(before + piece):
                            rows[w] += n
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], names=["word", "n"])
            rows.clear()

        for batch in batches:
            for body in batch.column(0):
                one, other = pieces(body.as_buffer().to_pybytes().decode("utf-8", "replace"))
                plain.update(one)
                spaced.update(other)
                if len(plain) + len(spaced) > COUNTED:
                    yield from flush()
        yield from flush()

    made = text_rows(docs, text_col, text_col).select("body").mapInArrow(trimmed(work), "word string, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words that occur at least so often that they are `most` at most. A table of counts of counts decides, so no
    task sorts the words."""
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("bigint"))
    rows = words.groupBy(step.alias("least")).agg(F.count("*").alias("words")).collect()  # 1,000 and some
    total, least = 0, None
    for r in sorted(rows, key=lambda r: -r["least"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    return words.filter(F.lit(False) if least is None else F.col("n") >= least)


@dataclass
class Book:
    """Words, by their hashes in ascending order, and their ids, in flat arrays: about 40 bytes a word."""

    hashes: np.ndarray
    words: pa.Array
    ends: np.ndarray
    ids: bytes

    @staticmethod
    def of(folded: pa.Table) -> Book:
        hashes = np.concatenate([np.empty(0, np.uint64), *(_hashes(x.to_pylist()) for x in folded.column("word").chunks)])
        order = pa.array(np.argsort(hashes, kind="stable"))
        words, ids = (folded.column(c).combine_chunks().take(order) for c in ("word", "ids"))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return Book(hashes[order.to_numpy()], words, ends, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes())

    def find(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word that the book has."""
        if not len(self.hashes) or not words:
            return [None] * len(words)
        asked = _hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        there = (self.hashes[at] == asked) & pc.equal(self.words.take(pa.array(at)), pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
        low, high, ids = (4 * self.ends[at]).tolist(), (4 * self.ends[at + 1]).tolist(), self.ids
        return [ids[a:b] if ok else None for ok, a, b in zip(there.tolist(), low, high, strict=True)]


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _ends(sizes: list[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]).astype(np.int32))


class _Codes:
    """Codes of pieces of text that all have the same before them: ids, and for each word left to the fold a number
    below -1 that leads to it in `rare`. Pieces that hold only words of the book stay known from slice to slice."""

    def __init__(self, book: Book, own: dict[bytes, int], find, before: str, rare: list[bytes]):
        self.book, self.own, self.find, self.before, self.rare = book, own, find, before, rare
        self.kept: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.passing: list[str] = []

    def of(self, texts: list[list[str]]):
        """A function from the pieces of some texts to their codes; it holds until the next call."""
        for piece in self.passing:
            del self.kept[piece]
        self.passing = []
        seen = set().union(*texts)
        missing = seen - self.kept.keys()
        if len(self.kept) + len(missing) > CACHE:
            self.last, self.kept, missing = self.kept, {}, seen
        fresh, words, counts = [], [], []
        for piece in missing:
            if (known := self.last.get(piece)) is None:
                fresh.append(piece)
            else:
                self.kept[piece] = known
        for piece in fresh:
            if piece.isalpha():  # one match, whatever stands around it
                words.append(self.before + piece)
                counts.append(1)
            elif piece[-1:] in (".", ",") and piece[:-1].isalpha():
                words += (self.before + piece[:-1], piece[-1])
                counts.append(2)
            else:
                found = self.find(self.before + piece)
                words += found
                counts.append(len(found))
        codes, numbered = self.book.find(words), set()
        for i, code in enumerate(codes):
            if code is None:
                codes[i] = self.other(words[i])
                if codes[i][-1] > 127:  # a number below 0
                    numbered.add(i)
        k = 0
        for piece, n in zip(fresh, counts, strict=True):
            self.kept[piece] = codes[k] if n == 1 else b"".join(codes[k : k + n])
            if k in numbered or n > 1 and not numbered.isdisjoint(range(k, k + n)):
                self.passing.append(piece)  # its numbers hold for these texts only
            k += n
        return self.kept.__getitem__

    def other(self, word: str) -> bytes:
        raw = word.encode()
        if len(raw) == 1:
            return self.own[raw].to_bytes(4, "little")
        if len(raw) > FOLDED_BYTES:
            return np.array(split_long(raw, self.own), np.int32).tobytes()
        self.rare.append(raw)
        return (-1 - len(self.rare)).to_bytes(4, "little", signed=True)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", book_words: int = BOOK, finish=None
) -> DataFrame:
    """One row per input row: ``id_col`` and ids (array of int) of the whole text, without special tokens.

    Distinct words are counted over all documents; the most frequent ones, ``book_words`` at most, are
    folded once into a code book, whose size is thereby bounded, and broadcast. Documents are then cut into words again; words outside of
    the book go along with their document and are folded by the same expression, so every word is encoded by rank
    whatever the book holds. Texts aren't shuffled, only words and counts.

    finish: further columns' schema and a function from batches of (id, ids) to batches of id and those, run in place.

    Null text counts as empty and has no ids; null ids pass through; repeated rows repeat; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    ranks = load_ranks(ranks_path)
    mapped = rank_map(ranks)

    words = settle(count_words(docs, pattern, text_col).filter(F.octet_length("word").between(2, FOLDED_BYTES)), "bpe-words")
    top = most_frequent(words, book_words).select("word").repartition(4 * spark.sparkContext.defaultParallelism, "word")
    folded = settle(top.select("word", F.get(fold_merges(F.array(byte_ids(F.col("word"), mapped.of_byte)), mapped), F.lit(0)).alias("ids")), "bpe-book")
    shared = spark.sparkContext.broadcast((ranks_path, Book.of(folded.toArrow())))  # book_words at most
    release()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, book = shared.value
        own = load_ranks(path)
        of_byte = np.array([own[bytes([i])] for i in range(256)], np.int32)
        find, rare = finder(pattern), []
        plain, spaced = (_Codes(book, own, find, before, rare) for before in ("", " "))
        for batch in batches:
            for a, b in slices(batch.column(1), 2 << 20):
                rare.clear()
                texts = [pieces(body.decode("utf-8", "replace")) for body in batch.column(1)[a:b].to_pylist()]
                first, rest = plain.of([x for x, _ in texts]), spaced.of([x for _, x in texts])
                codes = [np.frombuffer(b"".join(map(first, x)) + b"".join(map(rest, y)), np.int32) for x, y in texts]
                ends = np.cumsum([0, *map(len, codes)])
                flat = np.concatenate(codes)
                at = np.flatnonzero(flat < 0)
                left = -2 - flat[at]
                raws = [rare[k] for k in left.tolist()]
                ids = of_byte[np.frombuffer(b"".join(raws), np.uint8)]
                words = pa.ListArray.from_arrays(_ends([len(x) for x in raws]), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.maximum(flat, -1))),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), words),
                    ],
                    names=["id", "codes", "words"],
                )

    cut = text_rows(docs, id_col, text_col).mapInArrow(trimmed(work), f"id {kind}, codes array<int>, words array<array<int>>")
    filled = cut.select("id", "codes", fold_merges(F.col("words"), mapped).alias("rare"))
    if finish is None:
        return filled.mapInArrow(trimmed(_fill), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
    schema, function = finish

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fill(batches):
            yield function(batch)

    return filled.mapInArrow(trimmed(finished), f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def _fill(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Puts the rare words' ids where their document has -1."""
    for batch in (b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows)):
        codes, rare = batch.column(1), batch.column(2)
        flat = codes.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))])
        words = rare.flatten()
        if len(words):
            sizes = np.ones(len(flat), np.int64)
            sizes[flat < 0] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
            flat = np.repeat(flat, sizes)
            flat[flat < 0] = words.flatten().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))], names=["id", "ids"])


def decode_ids(ids: Column, pieces_of: Column) -> Column:
    """The bytes of an array of ids: their binary pieces, written as hex digits, put together."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces_of, i)), ""))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@cache
def _parts(ranks_path: str) -> tuple[pa.Array, pa.Array]:
    """For each id its decimal digits with a comma, and the bytes that it stands for."""
    ranks = load_ranks(ranks_path)
    pieces_of = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces_of[rank] = piece
    return pa.array([b"%d," % i for i in range(len(pieces_of))], pa.large_binary()), pa.array(pieces_of, pa.large_binary())


def gathered(parts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """For each range of ids between two ends, their parts put together."""
    if not len(ids):
        return [memoryview(b"")] * (len(ends) - 1)
    _, offsets, data = parts.take(pa.array(ids)).buffers()
    at, data = np.frombuffer(offsets, np.int64)[ends].tolist(), memoryview(data)
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


#: Ids of some documents that are put together at once, or those of one.
GATHERED = 1 << 20


def digests(ranks_path: str):
    """Finishes documents as the number of their ids and the digests of the ids and of the bytes they decode to."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        digits, pieces_of = _parts(ranks_path)
        flat, ends = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
        ids_sha, decoded, a = [], [], 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + GATHERED, "right")) - 1)
            own, within = flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            ids_sha += [hashlib.sha256(x[:-1]).hexdigest() for x in gathered(digits, own, within)]
            decoded += [hashlib.sha256(x).hexdigest() for x in gathered(pieces_of, own, within)]
            a = b
        columns = [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return "n_tokens bigint, ids_sha256 string, decoded_sha256 string", function


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_vocabulary()
    return encode_documents(table(spark, sf_dir, "documents"), path, pattern, finish=digests(path))
