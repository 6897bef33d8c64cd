"""Rules and URL parts by hand, the segmentation against all splits, and the model."""

import itertools
import math

from kontor.llm import hosts as H


def test_url_parts():
    for url, want in {
        None: ("", ""), "": ("", ""), "nothing": ("", ""), "http://": ("", ""),
        "HTTP://A.B.C/x/Y?q#f": ("a.b.c", "/x/Y"), "x://h?q/z": ("h", ""), "x://h#f": ("h", ""),
        "a://b://c/d": ("b:", "//c/d"), "s://É.NET/a\nb": ("É.net", "/a\nb"), "://h/p": ("h", "/p"),
    }.items():
        assert H.split_url(url) == want


def test_longest_rule_wins():
    for url, want in {
        "http://example.net/en/1": ("example.net/en/", "allow"),
        "http://a.example.net/en/": ("example.net/en/", "allow"),
        "http://example.net/en": ("net/", "block"), "http://x.net/": ("net/", "block"),
        "http://net/": ("net/", "block"), "http://net": None, "http://internet/": None,
        "http://m.example.com/de/1": ("example.com/de/", "block"),
        "http://myexample.com/de/1": None, "http://a.org/fr/x": ("org/fr/", "allow"),
        "http://a.org/en/x": None, "http://badexample.net/en/": ("net/", "block"),
    }.items():
        assert H.rule_for(*H.split_url(url)) == want, url


def test_segmentation_is_the_best_split():
    seg = H.Segmenter({"cheap": 50, "pills": 40, "pill": 10, "che": 3, "ap": 5, "s": 30, "free": 9,
                       "bets": 8, "be": 90, "ts": 2})
    assert seg.split("cheappills") == ("cheap", "pills") and seg.split("freebets") == ("free", "bets")
    for name in ("cheapill", "bepills", "freezq", "apap", "q"):
        def value(cuts, name=name):
            at = [0, *cuts, len(name)]
            return sum(seg._word(name[s:e]) for s, e in zip(at, at[1:]))
        best = max(value(c) for n in range(len(name))
                   for c in itertools.combinations(range(1, len(name)), n))
        got = seg.split(name)
        assert "".join(got) == name
        assert math.isclose(sum(seg._word(w) for w in got), best)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows],
                                 "page_id long, url string, html string, rule string")


HTML = "<html><style>zz{}</style><p>Cheap pills and free bets. The news of the school library.</p>"


def test_verdicts(spark):
    rows = [(i, f"http://www.cheappills.net/x/{i}", HTML) for i in range(30)]
    rows += [(100 + i, f"http://schoolnews.org/fr/{i}", HTML) for i in range(30)]
    rows += [(200, "https://cheap-pills.example.com/x/1", HTML),
             (201, "https://newslibrary.example.org/y", HTML), (202, None, None), (203, "", ""),
             (203, "", ""), (None, "http://h/" + "a" * 50_000, "<p"), (204, "no scheme", "x")]
    got = H.judge_urls(pages(spark, rows))
    assert got.columns[:3] == ["page_id", "url", "html"]
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    for i, url, _ in rows:
        host, path = H.split_url(url)
        rule = H.rule_for(host, path)
        r = by[i]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule and rule[0])
        assert r["verdict"] == (rule[1] if rule else "block" if r["score"] > 0 else "allow")
    assert by[200]["words"].startswith("cheap pills") and by[200]["verdict"] == "block"
    assert by[201]["words"].startswith("news library") and by[201]["verdict"] == "allow"


def test_counts_are_those_of_the_pages(spark):
    got = dict(tuple(r) for r in H.page_words(pages(spark, [(1, None, HTML), (2, "u", HTML), (3, "v", None)])).collect())
    assert got["pills"] == 2 and "zz" not in got and "html" not in got and got["the"] == 4


def test_rare_and_long_words_count(spark):
    """60,000 words more frequent than those of the names, and one of 26 letters."""
    many = ["".join(w) for w in itertools.islice(itertools.product("bcdfghjkmn", repeat=5), 60_000)]
    long = "abcdefghijklmnopqrstuvwxyz"
    page = "<p>" + " ".join(many * 2 + ["zebra", "quilt", long])
    rows = [(1, "http://zebraquilt.org/x", page), (2, f"http://quilt{long}zebra.org/fr/a1", None),
            (3, "http://zebra.net/1", ""), (4, "http://zebra.net/1", "")]
    words = {**{w: 2 for w in many}, "zebra": 1, "quilt": 1, long: 1}
    for seeds in H.SEED_WORDS.values():
        words.update({w: 1 for w in seeds.split()})
    seg = H.Segmenter(words)
    counts, urls = {}, [0, 0]
    for _, url, _ in rows:
        rule = H.rule_for(*H.split_url(url))
        if rule:
            side = rule[1] == "allow"
            urls[side] += 1
            for t in H.url_tokens(*H.split_url(url), seg):
                counts.setdefault(t, [0, 0])[side] += 1
    model = H.Bayes(counts, urls)
    got = {r["page_id"]: r for r in H.judge_urls(pages(spark, rows)).collect()}
    for i, url, _ in rows:
        tokens = H.url_tokens(*H.split_url(url), seg)
        assert got[i]["words"] == " ".join(tokens)
        assert math.isclose(got[i]["score"], model.score(tokens))
    assert got[1]["words"] == "zebra quilt x" and got[2]["words"] == f"quilt {long} zebra fr a1"


def test_empty_table(spark):
    assert H.judge_urls(pages(spark, [])).count() == 0


def test_bayes_counts():
    b = H.Bayes({"x": (8, 0), "y": (0, 8)}, (3, 3))
    assert b.score(["x"]) > 0 > b.score(["y"]) and b.score([]) == 0.0 and b.score(["casino"]) > 0


def test_tags_are_removed_as_by_the_pattern_and_in_one_scan():
    import random
    import re
    import time
    pattern = re.compile(rb"<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", re.DOTALL | re.IGNORECASE)
    rng = random.Random(3)
    parts = [b"<", b">", b"a", b"script", b"<script>", b"</SCRIPT>", b"<Style x", b"</style>", b"/", b"\n", b"<scripty>"]
    for _ in range(3000):
        page = b"".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert H.without_tags(page) == pattern.sub(b" ", page), page
    for page in (b"<" * 10_000_000, b"<script a " * 1_000_000, b"<style>" * 1_500_000, b"<b>x</b>" * 1_000_000):
        began = time.time()
        H.without_tags(page)
        assert time.time() - began < 20
