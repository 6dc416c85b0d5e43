"""Line dedup by an exact set-similarity join. DataFrame functions only.

A line's tokens are its distinct shingles of five words (the whole line if it has fewer). Tokens are put in one order
for all lines, rarest first; two lines with a Jaccard similarity of t share a token among their first n - ceil(t n) + 1.

A token is a number: in its high bits how often the rarer of its first and last word occurs, as a power of two, which no
token can exceed in frequency; in its low bits a hash of its words. So the order of the numbers is the order of the tokens.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import collect_now, drop_settled, marked, number_array, only_ids, settle, settle_packed, table, without_ids

#: Cells of the table of word counts, a fixed size. Words that share a cell only make the order less sharp: any order
#: that is the same for all lines gives exact results.
CELLS = 1 << 16
#: Low bits of a token.
HASH_BITS = 56
#: Lines of more tokens have parities in 256 cells: in 64, sets of that size that differ much differ in few cells.
WIDE = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Characters beyond ASCII that `lower` might change.
_OTHER_CAPITALS = "[^\\x00-\\x7F&&[\\p{Lu}\\p{Lt}\\p{So}\\p{Nl}]]"


def _plain(c: Column) -> Column:
    """A-Z as a-z; `lower` does the same faster where there are no other capitals."""
    return F.when((F.octet_length(c) == F.char_length(c)) | ~c.rlike(_OTHER_CAPITALS), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def _even(c: str) -> Column:
    """A line with one space for each run of white space; lone spaces stay as they are, and few lines have others."""
    run = "[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20[\\x20\\x09\\x0B-\\x0D]+"
    others = reduce(or_, (F.contains(F.col(c), F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")))
    return F.when(others, F.regexp_replace(c, run, " ")).otherwise(F.col(c))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is evaluated once a row, whatever refers to it: a generated one isn't merged into others."""
    return df.withColumn(name, F.explode(F.array(value)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (the id and a hash of the text, which tells rows of one id apart) and text; null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    return rows.select(F.struct("id", F.xxhash64("text").alias("mark")).alias("row"), "text")


def _lines(rows: DataFrame) -> DataFrame:
    """at (row and number of the line) and line of each line that has a word; lines end at line feeds. White space
    within lines is one space each, none at the ends; A-Z are in lower case."""
    lines = rows.select("row", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = _once(lines, _plain(F.trim(_even("raw"))), "line").filter("line <> ''")
    return lines.select(F.struct("row.id", "row.mark", "pos").alias("at"), "line")


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _ranks(lines: DataFrame) -> Column:
    """For each cell, how often its words occur in all lines, as a power of two, in the high bits of a token; a literal
    array of CELLS numbers."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).select(_cell(F.xxhash64("w")).alias("cell"))
    found = {r["cell"]: r["n"] for r in words.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS at most
    return number_array([int(found.get(i, 1)).bit_length() << HASH_BITS for i in range(CELLS)], "bigint")


def _with_tokens(lines: DataFrame, k: int, ranks: Column) -> DataFrame:
    """lines with their tokens, ascending.

    Words become numbers with their ranks in the high bits; a token is the rarer of its first and last word's number, its
    low bits changed by a hash of all k. No entry can be null, so sorting works on plain numbers.
    """
    low = F.lit((1 << HASH_BITS) - 1)
    rank = lambda h: F.coalesce(F.get(ranks, _cell(h)), F.lit(0).cast("bigint"))
    numbers = F.transform(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), lambda h: h.bitwiseAND(low).bitwiseOR(rank(h)))
    out = _once(lines, numbers, "_words")
    many = F.greatest(F.size("_words") - (k - 1), F.lit(0))
    runs = F.arrays_zip(*(F.slice("_words", j + 1, many).alias(f"w{j}") for j in range(k)))
    # Zipped by a function that is compiled, so that few are interpreted for each token.
    shingle = lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - HASH_BITS).bitwiseXOR(F.least(x["w0"], x[f"w{k - 1}"]) if k > 1 else x["w0"])
    ends = F.least(*(F.coalesce(F.get("_words", i), F.lit(0).cast("bigint")) for i in (F.lit(0), F.size("_words") - 1)))
    whole = F.xxhash64("line").bitwiseAND(low).bitwiseOR(ends.bitwiseAND(F.lit(~((1 << HASH_BITS) - 1))))
    found = F.when(F.size("_words") >= k, F.transform(runs, shingle)).otherwise(F.array(whole))
    return _once(out, F.sort_array(F.array_distinct(found)), "tokens").drop("_words")


def _parities(tokens: str | Column) -> Column:
    """For each of 64 cells, whether an odd number of tokens falls into it, as the bits of a number. Where two sets differ
    in a cell, a token of only one of them falls into it; so they differ in as many tokens as in cells, at least."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda seen, t: seen.bitwiseXOR(bit(t)))


def _odd() -> Column:
    """Parities of tokens in 64 cells and, of a line of more than WIDE, in the second to fourth 64 of 256 cells."""
    quarter = lambda k: F.filter("tokens", lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(3)) == k)
    more = (F.when(F.size("tokens") > WIDE, _parities(quarter(k))).otherwise(F.lit(0).cast("bigint")).alias(f"q{k}") for k in (1, 2, 3))
    return F.struct(_parities("tokens").alias("all"), *more)


def _differing(a_odd: Column, b_odd: Column) -> Column:
    """In how many of 256 cells two lines of more than WIDE tokens differ; the first 64 follow from all and the others."""
    q1, q2, q3 = (a_odd[f"q{k}"].bitwiseXOR(b_odd[f"q{k}"]) for k in (1, 2, 3))
    q0 = a_odd["all"].bitwiseXOR(b_odd["all"]).bitwiseXOR(q1).bitwiseXOR(q2).bitwiseXOR(q3)
    return F.bit_count(q0) + F.bit_count(q1) + F.bit_count(q2) + F.bit_count(q3)


def _near(a: str, b: str, percent: int) -> Column:
    """Whether line a is earlier than b and their sets can be similar, as far as a shared token, sizes and parities tell."""
    c = lambda name: (F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    (a_n, b_n), (a_i, b_i), (a_odd, b_odd), (a_at, b_at) = c("n"), c("i"), c("odd"), c("at")
    # A common token at places i and j leaves at most the lesser rest on either side.
    most = F.least(a_i, b_i) + F.least(a_n - a_i, b_n - b_i)
    return (
        (a_at < b_at)
        & (100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n))
        & ((100 + percent) * most >= percent * (a_n + b_n))
        & ((100 + percent) * F.bit_count(a_odd["all"].bitwiseXOR(b_odd["all"])) <= (100 - percent) * (a_n + b_n))
        & ((F.least(a_n, b_n) <= WIDE) | ((100 + percent) * _differing(a_odd, b_odd) <= (100 - percent) * (a_n + b_n)))
    )


def _apart(a: str, b: str) -> Column:
    """Whether none of the two tokens before this one in line a's prefix is among those in line b's. If one is, the pair
    meets there, too: similar lines pass all filters at each token that they share. So no row is needed here."""
    return ~reduce(or_, (F.coalesce(F.col(f"{a}.{x}") == F.col(f"{b}.{y}"), F.lit(False)) for x in ("p1", "p2") for y in ("p1", "p2")))


def _places(*sides: str) -> list[Column]:
    return [F.col(f"{x}.at").alias(f"{x}_at") for x in sides]


def _later(pairs: DataFrame, lines: DataFrame, words: int, ranks: Column, percent: int) -> DataFrame:
    """The places (at) of lines b of pairs (a_at, b_at) whose full sets are similar; sets are made for those lines alone."""
    asked = settle(pairs.select(F.explode(F.array("a_at", "b_at")).alias("at")).distinct(), "line-asked")
    texts = marked(lines, "at", asked.select(F.col("at").alias("id"))).filter("_hit").drop("_hit")
    texts = texts.join(asked, "at", "left_semi").dropDuplicates(["at"])  # rows that are alike; a place has one line
    whole = settle(_with_tokens(texts, words, ranks).select("at", "tokens"), "line-sets")
    both = pairs.join(whole.select(F.col("at").alias("a_at"), F.col("tokens").alias("x")), "a_at")
    both = both.join(whole.select(F.col("at").alias("b_at"), F.col("tokens").alias("y")), "b_at")
    common = F.size(F.array_intersect("x", "y"))
    found = both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select(F.col("b_at").alias("at")).distinct()
    found = settle(found, "line-found")
    drop_settled(asked, whole)
    return found


def line_dedup(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every line that has an earlier one, by (id, line number), with 100 * intersection >= percent * union.

    Equal lines (but for the case of A-Z and for white space) fold into one class with its first place. Counts of all
    words, in a table of a fixed size, give the order; prefix rows meet on the token, with the length and positional
    filters and one by parities: it needs 256 bits of each line at most, and rules out most pairs that share little more than a
    token. What is left is verified on full sets, made for those lines alone. A line that follows a similar one goes,
    whichever that is; so each line meets the earliest one of its tokens first, and only those that no such pair settles
    meet all others. Only texts that lose lines are shuffled.

    Returns one row per input row: ``id_col``, n_lines, n_removed and kept (the lines that stay, joined by line feeds).
    Lines without words always stay. Null text has one empty line. Rows that share an id are in the order of a hash of
    their texts; those that share the text too can't be told apart, so all of them keep what the first keeps. Null ids
    come first. A very long line is one row with as many tokens. Other columns are ignored; no rows give no rows.
    """
    rows = _rows(docs, id_col, text_col)
    lines = settle_packed(_lines(rows), "line-lines")  # the largest table, and it stays to the end
    ranks = _ranks(lines)
    n = F.size("tokens")
    reach = n - F.ceil(n * percent / 100).cast("int") + 1
    # Only the prefix of a line's tokens goes through the shuffle that folds equal lines, not its text.
    key = F.unhex(F.md5("line")).alias("key")
    keys = settle(lines.select("at", key), "line-keys")
    sets = _with_tokens(lines, words, ranks).select("at", key, n.alias("n"), _odd().alias("odd"), F.slice("tokens", 1, reach).alias("prefix"))
    some = F.struct("at", "n", "odd", "prefix")  # equal lines have equal tokens
    classes = sets.groupBy("key").agg(F.min(some).alias("own"), F.count("*").alias("copies"))
    classes = settle(classes.select("key", "own.*", "copies"), "line-classes")
    first = settle(classes.select("key", "at", "copies"), "line-first")
    collect_now(rows.sparkSession)  # the shuffle of all lines' prefixes, before the next one of that size
    twice = settle(classes.select(F.explode("prefix").alias("id")).groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"), "line-twice")
    # Classes differ in their first places, so these stand for them.
    prefix = classes.select("at", "n", "odd", "prefix", F.posexplode("prefix").alias("i", "t"))
    prefix = prefix.select("at", "n", "odd", "i", "t", *(F.get("prefix", F.col("i") - k).alias(f"p{k}") for k in (1, 2)))
    shared = settle(only_ids(prefix, "t", twice), "line-shared")
    drop_settled(twice, classes)
    # First each line meets the earliest one of each of its tokens only. Of many lines alike, few are left after that.
    own = [F.col(c) for c in ("at", "n", "odd", "i")]
    earliest = Window.partitionBy("t").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = shared.select(F.first(F.struct(*own)).over(earliest).alias("a"), F.struct(*own).alias("b"))
    met = settle(met.filter(_near("a", "b", percent)).select(*_places("a", "b")).distinct(), "line-pairs")
    later = _later(met, lines, words, ranks, percent)
    # Whoever isn't known to follow a similar one meets all lines before it.
    unsettled = without_ids(shared, "at", later.select(F.col("at").alias("id")))
    a, b = (x.select("t", F.struct(*own, "p1", "p2").alias(name)) for x, name in ((shared, "a"), (unsettled, "b")))
    pairs = settle(a.join(b, "t").filter(_apart("a", "b") & _near("a", "b", percent)).select(*_places("a", "b")).distinct(), "line-rest")
    drop_settled(shared)
    more = _later(pairs, lines, words, ranks, percent)
    drop_settled(lines)
    follows = later.union(more).select("at", F.lit(True).alias("later"))  # no place is in both

    # A line goes where its class is not first, or follows a similar one.
    goes = first.join(follows, "at", "left").filter("copies > 1 or later").select("key", "later", F.col("at").alias("first"))
    goes = settle(goes, "line-goes")
    drop_settled(met, pairs, later, more)
    keyed = marked(keys, "key", goes.select(F.col("key").alias("id"))).filter("_hit").drop("_hit")
    gone = keyed.join(goes, "key").filter("later or at <> first").select("at")
    gone = settle(gone.groupBy(F.struct("at.id", "at.mark").alias("row")).agg(F.collect_set("at.pos").alias("gone")), "line-gone")
    drop_settled(first, keys, goes)
    ids = gone.select(F.col("row").alias("id"))
    split = marked(rows, "row", ids)
    none = F.array().cast("array<int>")
    clean = split.filter("not _hit").select("row.id", "text", none.alias("gone"))
    cut = split.filter("_hit").drop("_hit").join(gone, "row", "left").select("row.id", "text", F.coalesce("gone", none).alias("gone"))

    def finished(found: DataFrame) -> DataFrame:
        parts = F.split("text", "\n")
        out = found.select("id", F.size(parts).cast("bigint").alias("n_lines"), "text", parts.alias("lines"), F.sort_array("gone").alias("gone"))
        # What lies between the lines that go.
        between = F.zip_with(
            F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.col("n_lines").cast("int"))), lambda a, b: F.slice("lines", a + 2, b - a - 1)
        )
        kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
        return out.select(F.col("id").alias(id_col), "n_lines", F.size("gone").cast("bigint").alias("n_removed"), kept.alias("kept"))

    return finished(clean).union(finished(cut))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), w AS (
  SELECT doc_id, pos, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM l
), c AS (
  SELECT line, min((doc_id, pos)) AS first_at FROM w WHERE line <> '' GROUP BY line
), s AS (
  SELECT line, first_at, string_split(line, ' ') AS ws FROM c
), k AS (
  SELECT line, first_at, CASE WHEN len(ws) < 5 THEN [line]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS sh
  FROM s
), e AS (
  SELECT line, first_at, len(sh) AS n, unnest(sh) AS t FROM k
), p AS (
  SELECT b.line, a.n AS an, b.n AS bn, count(*) AS both_n
  FROM e a JOIN e b ON a.t = b.t AND a.first_at < b.first_at
  GROUP BY a.line, b.line, a.n, b.n
), later AS (
  SELECT DISTINCT line FROM p WHERE 100 * both_n >= 80 * (an + bn - both_n)
), d AS (
  SELECT w.doc_id, w.pos, w.raw, w.line = '' OR (c.first_at = (w.doc_id, w.pos) AND later.line IS NULL) AS stays
  FROM w LEFT JOIN c ON w.line = c.line LEFT JOIN later ON w.line = later.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
