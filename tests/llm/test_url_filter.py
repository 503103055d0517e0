import math
import os
import re
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hoarfrost.llm import url_filter as uf
from hoarfrost.llm.common import learnable


def brute_rule(url):
    m = re.search(r"(?s)^.*?://(.*)$", url or "")
    rest = m[1] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://example.org/en/12?x=/fr/", "http://xexample.org/en/12", "http://a.com/fr/é#x", "http://a.com/de/", "http://com/de/x",
    "http://a.com?/fr/", "http://org", "http://a.b://c/", "http://casino.example.net/en/9", "http://best-casino.example.net/en/9", "http://freecasino.example.net/", "http://İx.com/fr/", "ftp://news.example.net/en/4\nx",
]


def test_rules_and_frame(spark):
    rows = [(i, u, None if i % 5 == 0 else "<p>free casino news example <script>var x</script>", "c") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = uf.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_rule(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))
    assert uf.judge_urls(pages.limit(0)).count() == 0


def test_viterbi_is_the_best_split():
    cost = {w: math.log(100 / n) for w, n in {"cheap": 5, "pills": 4, "che": 1, "ap": 2, "pill": 3, "s": 1, "ach": 1}.items()}
    unknown = 2.5

    def total(parts):
        return sum(cost[w] if w in cost else unknown * (1 + len(w)) for w in parts)

    for name in ["cheappills", "pillscheap", "xcheapx", "s", "apach", "zzz"]:
        ways = []
        for k in range(len(name)):
            for cuts in combinations(range(1, len(name)), k):
                ways.append([name[a:b] for a, b in zip((0, *cuts), (*cuts, len(name)))])
        assert abs(total(uf.viterbi(name, cost, unknown)) - min(map(total, ways))) < 1e-9
    assert uf.viterbi("cheappills", cost, unknown) == ["cheap", "pills"]


def test_bayes_against_brute_force(spark):
    rows = [(["a", "b"], True, 2), (["b", "c"], False, 3), ([], False, 1), (["a"], True, 1)]
    model = uf.fit_bayes(spark.createDataFrame(rows, "words array<string>, blocked boolean, n long"))
    blocked, allowed = {"a": 3, "b": 2, "c": 0}, {"a": 0, "b": 3, "c": 3}
    got = {r.word: r.odds for r in model.words.collect()}
    assert set(got) == set(blocked)
    for w in got:
        assert abs(got[w] - (math.log((blocked[w] + 1) / (5 + 3)) - math.log((allowed[w] + 1) / (6 + 3)))) < 1e-9
    assert abs(model.prior - math.log(4 / 5)) < 1e-9
    none = uf.fit_bayes(spark.createDataFrame([], "words array<string>, blocked boolean, n long"))
    assert none.words.count() == 0 and none.prior == 0


def brute_verdicts(pages, seeds=uf.SEED_WORDS):
    """Scores and verdicts in plain Python: (page_id, url, html) -> {page_id: (score, verdict)}."""
    letters = lambda text: re.findall(r"[^\W\d_]+", text)
    counts, places = Counter(), {}
    for i, url, html in pages:
        host, path, _, _ = brute_rule(url)
        places[i] = (host, letters(host.lower()), letters(path.lower()))
        counts.update(places[i][1] + places[i][2])
        if html is not None:
            counts.update(letters(re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", html.lower())))
    total = sum(counts.values())
    unknown = math.log(max(2, total)) / 2

    def split(name):
        subs = {name[a:b] for a in range(len(name)) for b in range(a + 2, len(name) + 1)}
        cost = {w: min(math.log(total / counts[w]) + 1, unknown * (1 + len(w))) for w in subs if counts[w] and (len(w) < len(name) or counts[w] > 2)}
        return uf.viterbi(name, cost, unknown)

    rows = {}
    for i, (host, names, path) in places.items():
        words = ["host:" + w for n in names for w in split(n)] + ["path:" + w for n in path for w in split(n)]
        whole = max((r for r in uf.RULES if r.path == "/" and (host == r.host or host.endswith("." + r.host))), key=lambda r: len(r.name), default=None)
        blocked = whole.verdict == "block" if whole else any("host:" + s in words for s in seeds)
        rows[i] = blocked, [w for w in words if w[5:] not in seeds]
    seen = {b: Counter(w for blocked, words in rows.values() if blocked == b for w in words) for b in (True, False)}
    size = max(1, len({*seen[True], *seen[False]}))
    share = lambda b, w: math.log((seen[b][w] + 1) / (sum(seen[b].values()) + size))
    n = sum(b for b, _ in rows.values())
    prior = math.log((n + 1) / (len(rows) - n + 1))
    out = {}
    for i, url, _ in pages:
        score = 1 / (1 + math.exp(-prior - sum(share(True, w) - share(False, w) for w in rows[i][1])))
        out[i] = score, brute_rule(url)[3] or ("block" if round(score, 6) >= 0.5 else "allow")
    return out


def compared(spark, pages):
    want = brute_verdicts(pages)
    got = uf.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert abs(r.block_score - want[r.page_id][0]) < 2e-6 and (r.verdict == want[r.page_id][1] or abs(want[r.page_id][0] - 0.5) < 2e-6), r
    return {r.url: r.verdict for r in got}


def test_verdicts_against_brute_force(spark):
    words = "<p>" + " win prizes news daily farm fresh cheap loans deutschlandweitenversandkostenfreiheit" * 3 + "</p>"
    urls = ["http://casino-win.example.net/en/%d" % k for k in range(6)] + ["http://poker-win.example.net/a/%d" % k for k in range(4)]
    urls += ["http://news%s.example.net/daily/%d" % (s, k) for s in ("", "daily") for k in range(12)]
    urls += ["http://winprizes.example.net/", "http://spam.farm.example.org/x", "http://farm.example.net/x", "http://newsspam.example.net/daily/1", "http://a.net/deutschlandweitenversandkostenfreiheitx", None, "", "http://a.com/de/win"]
    verdicts = compared(spark, [(i, u, words if i % 3 == 0 else None) for i, u in enumerate(urls)])
    assert verdicts["http://winprizes.example.net/"] == "block"  # no seed word: learnt from the company of others
    assert verdicts["http://newsspam.example.net/daily/1"] == "allow"  # a seed word is no verdict
    assert verdicts["http://spam.farm.example.org/x"] == "allow" and verdicts["http://casino-win.example.net/en/1"] == "block"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    compared(spark, [tuple(r) for r in rows])


def test_held_out_hosts(spark):
    """Hosts that weren't learnt from are judged by words in common with others."""
    urls = ["http://%s-%s%d.example.net/x" % (a, b, k) for k in range(60) for a, b in (("casino", "win"), ("news", "daily"))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("casino win news daily casino win news daily"))
    got = uf.judge_urls(pages, hold_out=True).where(~learnable(F.col("host"))).collect()
    assert len(got) > 10 and all(r.verdict == ("block" if "casino" in r.host else "allow") for r in got)


def test_names_of_any_length_are_split(spark):
    counts = {"cheap": 5, "pills": 4, "che": 1, "ap": 2, "pill": 3, "s": 1, "straße": 9, "xcheap": 2, "y" * 30: 5}
    names = ["cheappills", "pillscheap" * 20, "x", "straßecheap", "q" * 70, "s", "xcheap", "cheap" + "y" * 30 + "pills", "y" * 29]
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.name: r.words for r in uf.segment_names(spark.createDataFrame([(n,) for n in names * 2], "name string"), table).collect()}
    total = sum(counts.values())
    for name in names:
        cost = {w: min(math.log(total / n) + 1, math.log(total) / 2 * (1 + len(w))) for w, n in counts.items() if len(w) < len(name) or n > 2}
        cost = {w: c for w, c in cost.items() if len(w) > 1}
        assert got[name] == uf.viterbi(name, cost, math.log(total) / 2)
    assert len(got) == len(names) and got["pillscheap" * 20] == ["pills", "cheap"] * 20


def test_plain_text(spark):
    cases = {
        "<p>A <b>b</b></p>": "a b", "x<script src=1>var y<z</script>w <style>q</style>v": "x w v", "a<script>never closed": "a", "a<script>b<script>c</script>d": "a d", "1 < 2 <b>c</b>": "1 < 2 c",
        "<<<a>b": "<< b", "<SCRIPT>x</Script>y": "y", "": "", "</script>z": "z",
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r.h: " ".join(r.t.split()) for r in df.select("h", uf.plain_text(F.col("h")).alias("t")).collect()}
    assert got == cases


def test_a_megabyte_of_anything(spark):
    """Openings without ends and one long run of letters take seconds, not hours; words over SHORT_WORD letters are found in it."""
    word = "abcdefghijklmnopqrstuvwxyz"
    rng = __import__("random").Random(2)
    long = "".join(rng.choice(["ab", "cd", word]) for _ in range(20_000))
    htmls = ["<" * (1 << 20), "<script" * 150_000, "<style <" * 130_000, "ab cd " * 10 + f"{word} {word} {word} " * 5, None]
    urls = ["http://a.b/x", "http://" + "x" * 40 + ".b/" + "y/" * 200_000, f"http://c.d/{long}", "http://e.f/ab", None]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, htmls))], "page_id long, url string, html string")
    began = time.time()
    out = uf.judge_urls(pages).select("page_id", "verdict", F.length("path").alias("n")).collect()
    assert len(out) == 5 and max(r.n for r in out) >= 400_000 and time.time() - began < 100
    counts = uf.word_counts(pages)
    split = uf.segment_names(spark.createDataFrame([(long[:3000],)], "name string"), counts).first().words
    assert "".join(split) == long[:3000] and {"ab", "cd", word} >= set(split[:-1])
