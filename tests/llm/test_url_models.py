"""The URL filter's models hold every word of the table, however many there are."""

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("simloom.llm")

from simloom.llm import url_filter


def test_no_word_is_left_out(spark, monkeypatch):
    """Against brute force over all words, with a limit of old set so low that it would cut most of them."""
    monkeypatch.setattr(url_filter, "MOST_WORDS", 3, raising=False)
    names = ["quiet", "river", "stone", "casino", "house", "bread", "win"]
    rules = (("allow", "org", "/"), ("block", "river-stone.net", "/"), ("block", "net", "/breadhouse"))
    urls = [f"http://{a}-{b}.net/{b}{a}/{a}" for a in names for b in names] + [f"http://{a}win.org/x" for a in names] + ["nothing", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules=rules).collect()}

    runs = [(re.findall("[a-z]+", r["host"].rsplit(".", 1)[0] if "." in r["host"] else r["host"]), re.findall("[a-z]+", r["path"])) for _, r in sorted(got.items())]
    counts = Counter(w for _, r in got.items() for w in re.findall("[a-z]+", r["host"] + " " + r["path"]))
    known = {w: n for w, n in counts.items() if len(w) > 1 and not url_filter.written_together(w, counts)}
    total = sum(known.values())
    words = [[f"{s}:{x}" for s, own in zip("hp", r, strict=True) for w in own for x in url_filter.split(w, known, total)] for r in runs]
    seeds = {f"h:{w}" for w in url_filter.SEED_BLOCK}


    def told(r):
        fits = [(len(h + p), v) for v, h, p in rules if ("." + r["host"]).endswith("." + h) and r["path"].startswith(p)]
        return max(fits)[1] if fits else None

    told_by = [told(r) for _, r in sorted(got.items())]
    assert "allow" in told_by and "block" in told_by
    y = [bool(seeds & set(w)) if t is None else t == "block" for w, t in zip(words, told_by, strict=True)]
    by = [Counter(t for w, b in zip(words, y, strict=True) if b == k for t in w) for k in (False, True)]
    size = len(by[0] | by[1])
    low, high = (sum(c.values()) + size + 1 for c in by)
    for i, w in enumerate(words):
        want = math.log((sum(y) + 1) / (len(y) - sum(y) + 1)) + sum(math.log((by[1][t] + 1) / high) - math.log((by[0][t] + 1) / low) for t in w)
        assert got[i]["words"] == w
        assert abs(got[i]["score"] - want) < 1e-9 and got[i]["verdict"] == (told_by[i] or ("block" if want > 0 else "allow"))
    assert "p:river" in words[1] and "p:riverquiet" not in words[1]


def test_split_is_the_most_probable():
    """Viterbi against all ways to split a name."""
    r = random.Random(2)
    for _ in range(200):
        counts = {"".join(r.choices("ab", k=r.randint(2, 4))): r.randint(1, 50) for _ in range(6)}
        name, total = "".join(r.choices("ab", k=r.randint(1, 9))), sum(counts.values())

        def cost(w, counts=counts, total=total):
            return -math.log(counts[w] / total) if w in counts else math.log(total * 10) + 2.0 * len(w)

        ways = []
        for cuts in range(1 << len(name) - 1):
            at = [0, *(i + 1 for i in range(len(name) - 1) if cuts >> i & 1), len(name)]
            ways.append(sum(cost(name[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)))
        assert math.isclose(sum(map(cost, url_filter.split(name, counts, total))), min(ways))
