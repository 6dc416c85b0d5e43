"""URL filter: hosts are split into words by a unigram Viterbi search, then naive Bayes judges host and path words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

# Rules (verdict, host, path) that come before the classifier; a rule fits its host and subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Words of hosts that mark a page as unwanted, for labels where no rule has one.
SEED_BLOCK = ("ads", "adult", "bet", "bets", "bonus", "casino", "cheap", "farm", "free", "loan", "pills", "poker", "porn", "spam", "track", "tracker", "win", "xxx")

#: Letters of the longest word that a name is split into: no part of a host name may have more.
LONGEST = 63


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to /, ?, # or the end, A-Z in lower case; path: from there to ?, # or the end."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def written_together(name: str, counts: dict[str, int]) -> bool:
    """Whether a name is a run of words of three letters or more that are all more frequent than itself."""
    reached = [True] + [False] * len(name)
    for end in range(3, len(name) + 1):
        reached[end] = any(reached[a] and counts.get(name[a:end], 0) > counts[name] for a in range(max(0, end - LONGEST), end - 2))
    return reached[-1]


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """Splits a name that is written together into the most probable words of a unigram model.

    counts: those of the model's words that stand in the name; total: of all the model's words.
    """
    # An unseen word costs as much as one seen less than once, and a tenth as much again for each further letter.
    unseen = math.log(total * 10)
    cost = {w: -math.log(n / total) for w, n in counts.items()}
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        least, at = min((best[a] + cost.get(name[a:end], unseen + 2.0 * (end - a)), a) for a in range(max(0, end - LONGEST), end))
        best.append(least)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def _parts(names: DataFrame) -> DataFrame:
    """(w, n, part): each name with every string of 2 to LONGEST letters in it, once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(w, n, x) for x in {w[a:b] for a in range(len(w) - 1) for b in range(a + 2, min(len(w), a + LONGEST) + 1)}]
                if len(rows) >= 20_000:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        w, n, part = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(part, pa.string())], names=["w", "n", "part"])

    return names.select("w", "n").mapInArrow(work, "w string, n bigint, part string")


def _per_name(names: DataFrame, kind: str, result: pa.DataType, f) -> DataFrame:
    """(w, made): what a function of (name, its count, counts of words in it) gives; names: w, n, own (part, m)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n, own = (c.to_pylist() for c in batch.columns)
            found = [f(x, k, {q["part"]: q["m"] for q in o or ()}) for x, k, o in zip(w, n, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, result)], names=["w", "made"])

    return names.select("w", "n", "own").mapInArrow(work, f"w string, made {kind}")


def split_names(unigrams: DataFrame) -> DataFrame:
    """(w, pieces): every name of (w, n), split by the unigram model that they form."""
    inside = settle(_parts(unigrams).join(unigrams.select(F.col("w").alias("part"), F.col("n").alias("m")), "part").select("w", "n", "part", "m"), "url-parts")
    own = F.collect_list(F.struct("part", "m")).alias("own")
    longer = inside.filter("length(part) > 2").groupBy("w", "n").agg(own)
    together = _per_name(longer, "boolean", pa.bool_(), lambda w, n, parts: written_together(w, parts | {w: n})).filter("made").select("w")
    known = settle(unigrams.filter("length(w) > 1").join(together, "w", "left_anti"), "url-known")
    total = known.agg(F.sum("n")).first()[0] or 1
    seen = inside.join(known.select(F.col("w").alias("part")), "part", "left_semi").groupBy("w").agg(own)
    made = _per_name(unigrams.join(seen, "w", "left"), "array<string>", pa.list_(pa.string()), lambda w, n, parts: split(w, parts, total))
    return settle(made.withColumnRenamed("made", "pieces"), "url-pieces")


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEED_BLOCK, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict (allow or block), words, score (log odds of block).

    The unigram model counts the letter runs of all hosts and paths, hyphens and dots being borders. Labels come from
    the table: a page that a rule fits has the rule's verdict; any other is labelled block if a word of its segmented
    host is among the seeds, else allow. Multinomial naive Bayes with Laplace smoothing counts the segmented words of
    all pages by label, so words that keep company with blocked ones count too. Both models are whole tables, without a
    limit to their words: distinct names are joined to them, not pages. A rule's verdict goes before the model's; a
    score of 0 allows; of equally probable splits the one with the longest last word is taken. Null urls and urls
    without :// have an empty host and path and are judged by the prior alone. Very long names only take longer, by
    LONGEST strings a letter. Repeated rows repeat; other columns are ignored; an empty table gives an empty result.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = base.select("_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_key"))
    urls = settle(urls.withColumns({"rule": rule, "told": verdict}), "url-rows")

    runs = "regexp_extract_all({}, '([a-z]+)', 1)"
    parts = urls.select(F.explode(F.expr(runs.format("concat(host, ' ', lower(path))"))).alias("w"))
    pieces = split_names(settle(parts.groupBy("w").agg(F.count("*").alias("n")), "url-counts"))

    # Names of the host but for its last label, marked by where they stand, then names of the path.
    own = F.expr(runs.format(r"regexp_replace(host, '[.][^.]*\\z', '')"))
    rest = F.expr(runs.format("lower(path)"))
    named = [F.transform(own, lambda w: F.struct(F.lit("h:").alias("side"), w.alias("w"))), F.transform(rest, lambda w: F.struct(F.lit("p:").alias("side"), w.alias("w")))]
    names = urls.select("_key", "told", F.posexplode(F.concat(*named)).alias("at", "name")).select("_key", "told", "at", "name.side", "name.w")
    bad = pieces.filter(F.arrays_overlap("pieces", F.array(*map(F.lit, seeds)).cast("array<string>"))).select("w")
    seeded = settle(names.filter("side = 'h:' and told is null").join(bad, "w", "left_semi").select("_key", F.lit(1).alias("seed")).distinct(), "url-seeded")
    y = F.coalesce((F.col("told") == "block").cast("int"), F.col("seed"), F.lit(0))
    labelled = names.join(seeded, "_key", "left").withColumn("y", y)
    distinct = labelled.groupBy("side", "w").agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b")).join(pieces, "w")
    tokens = distinct.select("side", "w", "a", "b", F.posexplode("pieces").alias("k", "piece"))
    tokens = settle(tokens.select("side", "w", "a", "b", "k", F.concat("side", "piece").alias("t")), "url-tokens")
    counts = settle(tokens.groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "url-token-counts")
    sizes = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    n_pages, n_blocked = urls.agg(F.count("*"), F.count(F.when(F.col("told") == "block", 1))).first()
    n_blocked += seeded.count()
    prior = math.log((n_blocked + 1) / (n_pages - n_blocked + 1))
    weight = F.log((F.col("b") + 1) / F.lit(float(sizes["b"] + sizes["n"] + 1))) - F.log((F.col("a") + 1) / F.lit(float(sizes["a"] + sizes["n"] + 1)))
    weighed = tokens.select("side", "w", "k", "t").join(counts.select("t", weight.alias("weight")), "t")
    judged = settle(weighed.groupBy("side", "w").agg(F.array_sort(F.collect_list(F.struct("k", "t", "weight"))).alias("own")), "url-judged")

    found = names.join(judged, ["side", "w"]).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("all"))
    found = found.select("_key", F.flatten(F.col("all.own")).alias("all"))
    none = F.array().cast("array<string>")
    # Summed in the words' order, so that the score doesn't depend on the partitioning.
    score = F.aggregate(F.coalesce(F.col("all.weight"), F.array().cast("array<double>")), F.lit(0.0), lambda x, w: x + w) + F.lit(prior)
    out = urls.join(found, "_key", "left").select("_id", "host", "path", "rule", "told", F.coalesce(F.col("all.t"), none).alias("words"), score.alias("score"))
    by_model = F.when(F.col("score") > 0, "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("told", by_model).alias("verdict"), "words", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), F.round("score", 6).alias("score"))
