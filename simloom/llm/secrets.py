"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns only near hits, embedded checksums last."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_rows

# The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
# The keywords that the prefilter looks for, in lower case, and the kind that each may start.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones never hide a longer one
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits, as tokens with an embedded checksum carry it."""
    left, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        left, digit = divmod(left, 62)
        out = BASE62[digit] + out
    return out


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _accept(kind: str, text: str, start: int) -> tuple[int, bool] | None:
    """End of the match that begins exactly at start, and whether it counts; None without a match."""
    if kind == "assign":
        m = ASSIGN.match(text, start)
        return m and (m.end(), m.end(2) - m.start(2) >= 12)
    if kind == "access":
        m = ACCESS.match(text, start)
        return m and (m.end(), m.end() - start >= 18)
    m = (GITHUB if kind == "github" else NPM).match(text, start)
    return m and (m.end(), checksum62(m[1]) == m[2])


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one whole text, in code points, by start and then by kind."""
    spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    # Lower-casing bytes touches A-Z alone, so no offset moves.
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end - n + 1, kind) for end, (n, kind) in words.iter(low))
    until = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < until[kind]:
            continue  # inside an earlier match of its kind, be that accepted or not
        if got := _accept(kind, text, start):
            end, counts = got
            if counts or kind in ("assign", "access"):
                until[kind] = end
            if counts:
                spans.append((kind, start, end))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and spans, an array of (kind, start, end) in code points, end exclusive.

    Kinds assign, access and hex are leftmost non-overlapping matches per kind whose value is long enough; github
    and npm are tokens whose embedded CRC-32 is right. The keyword automaton runs over the text once, and a pattern
    is only tried where its keyword begins; hex runs, which have no keyword, are found by their own run pattern.
    No shuffle. Null text has no spans; a null id is passed through; repeated rows give repeated results.
    """
    kept = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan(x.decode("utf-8", "replace"), words)] for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["id", "spans"])

    out = text_rows(docs, id_col, text_col).mapInArrow(work, f"id {kept}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), "spans")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("github").alias("n_github"),
        count("npm").alias("n_npm"),
    )
