"""URL filters by host word segmentation.

Rules (a host and a path prefix) decide the URLs they fit.  For the others, the
names in the host are split into words by a unigram Viterbi search, whose word
counts come from the pages' own text, and a multinomial naive Bayes model
scores the words of host and path.  Both counts are tables, kept whole; names,
URLs and tokens are joined with them.  The model learns from the URLs that rules decide
and from a short list of words that speak for blocking or allowing.

Nulls and URLs without "://" have an empty host and path, no rule, and the
verdict of a text without words (the model's prior).  Equal URLs get equal
rows; long ones are judged whole.  Without any decided URL only the word list
speaks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import Staged, text_bytes

# The rules, as verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# Words that speak for a verdict wherever they stand (a blocklist's usual terms).
SEED_WORDS = {
    "block": "adult bet bets betting bonus casino cheap crack farm free gambling jackpot keygen"
             " loan loans lottery meds nude payday pharmacy pill pills poker porn replica sex"
             " slots spam torrent viagra warez win xxx",
    "allow": "academy archive blog docs education encyclopedia forum government guide health"
             " history journal library museum news research school science university wiki",
}
#: A seed word counts as often as this share of all words learned from, at least SEED_LEAST.
SEED_SHARE, SEED_LEAST = 0.002, 3
#: Words are looked up by their first letters, so many at most.
LOOKUP = 20
#: A join key with more than this share of the rows is looked up by broadcast (200 keys at most).
HOT_SHARE, HOT_LEAST = 0.005, 1000

_OPENED = re.compile(rb"<(script|style)\b", re.IGNORECASE)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)


def without_tags(page: bytes) -> bytes:
    """The page with a space for every tag, and for every script and style with its content.
    One scan: a closing mark that is missing is looked for once."""
    low, out, done, at = page.lower(), [], 0, page.find(b"<")
    missing: set[bytes] = set()
    while at >= 0:
        end, opened = -1, _OPENED.match(page, at)
        if opened:
            close = b"</" + opened.group(1).lower() + b">"
            if close not in missing:
                end = low.find(close, opened.end())
                if end < 0:
                    missing.add(close)
                else:
                    end += len(close)
        if end < 0:
            end = page.find(b">", at) + 1
            if end == 0:                       # no tag ends any more
                break
        out += [page[done:at], b" "]
        done, at = end, page.find(b"<", end)
    return b"".join([*out, page[done:]])


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lowered, path); both empty without "://"."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    m = _URL.match(url, start + 3)
    return m.group(1).translate(_LOWER), m.group(2)


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits the host or a domain above it."""
    fit = [(len(h) + len(p), h + p, verdict) for verdict, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


class Segmenter:
    """Most likely split of a name into words under unigram counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.logs = {w: math.log(n / self.total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.known: dict[str, tuple[str, ...]] = {}     # bounded cache of splits

    def split(self, name: str) -> tuple[str, ...]:
        if name not in self.known:
            if len(self.known) >= 50_000:
                self.known.clear()
            self.known[name] = self._split(name)
        return self.known[name]

    def _word(self, w: str) -> float:
        # an unknown word costs more with every letter
        known = self.logs.get(w)
        return self._unknown(len(w)) if known is None else known

    def _unknown(self, letters: int) -> float:
        return -math.log(10 * self.total) - 2.5 * letters

    def _split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        free = 0                # where an unknown word of any length starts best
        for end in range(1, len(name) + 1):
            if best[end - 1] + 2.5 * (end - 1) > best[free] + 2.5 * free:
                free = end - 1
            value, start = best[free] + self._unknown(end - free), -free
            for s in range(max(0, end - self.longest), end):
                known = self.logs.get(name[s:end])
                if known is not None:
                    value, start = max((value, start), (best[s] + known, -s))
            best.append(value)
            back.append(-start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return tuple(out[::-1])


def url_pieces(host: str, path: str) -> list[tuple[str, bool]]:
    """The host's names (its last one, the public suffix, aside) and the pieces of the path,
    with whether they are to be split."""
    out = [(n, True) for n in re.findall(r"[a-z]+", " ".join(host.split(".")[:-1]))]
    for piece in re.findall(r"[^\W_]+", path.lower()):
        if piece.isalpha() and piece.isascii() and len(piece) > 3:     # shorter: codes
            out.append((piece, True))
        else:
            out.append(("#" if piece.isdigit() else piece, False))
    return out


def url_tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Words of the host's names and of the path."""
    return [t for piece, names in url_pieces(host, path)
            for t in (segmenter.split(piece) if names else (piece,))]


class Bayes:
    """Multinomial naive Bayes over tokens; positive log odds speak for blocking."""

    def __init__(self, counts: dict[str, tuple[int, int]], urls: tuple[int, int]):
        words = sum(a + b for a, b in counts.values())
        extra = max(SEED_LEAST, SEED_SHARE * words)
        full = {t: list(c) for t, c in counts.items()}
        for side, verdict in enumerate(("block", "allow")):
            for w in SEED_WORDS[verdict].split():
                full.setdefault(w, [0, 0])[side] += extra
        block, allow = (sum(c[i] for c in full.values()) + len(full) for i in (0, 1))
        self.odds = {t: math.log((c[0] + 1) / block) - math.log((c[1] + 1) / allow)
                     for t, c in full.items()}
        self.prior = math.log((urls[0] + 1) / (urls[1] + 1))

    def score(self, tokens: list[str]) -> float:
        return self.prior + sum(self.odds.get(t, 0.0) for t in tokens)


# ------------------------------------------------------------ Spark jobs
def page_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over the text of all pages: runs of ASCII letters outside of tags."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for page in text_bytes(batch.column(0)):
                counts.update(without_tags(page).translate(_LETTERS).split())
                if len(counts) > 300_000:
                    yield _counts(counts)
                    counts = Counter()
        yield _counts(counts)

    return (pages.select(F.col(f"`{html}`")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _counts(counts: Counter) -> pa.RecordBatch:
    words = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([w.decode() for w in words], pa.string()),
         pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``; keys with a large share of the rows by broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_LEAST, HOT_SHARE * rows.count())
    hot = [r[0] for r in counts.filter((F.col("n") > least) & F.col(key).isNotNull()).collect()]
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (rows.filter(~is_hot).join(table.filter(~is_hot), key, how)
            .unionByName(rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key, how)))


def learn_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over all pages, written as a table; every seed word counts once at least."""
    spark = pages.sparkSession
    seeds = spark.createDataFrame([(w, 0) for w in sorted(
        {w for v in SEED_WORDS.values() for w in v.split()})], "word string, n long")
    counts = (page_words(pages, html).unionByName(seeds).groupBy("word")
              .agg(F.greatest(F.sum("n"), F.lit(1)).alias("n")))
    return Staged(spark, "hosts").write(counts, "words")


def _map(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` gives from one row (a dict) the rows of ``schema`` (tuples)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(got):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, types[n]) for c, n in zip(zip(*got), names)], names)

    def run(batches):
        got = []
        for batch in batches:
            for r in (r for at in range(0, batch.num_rows, 100)
                      for r in batch.slice(at, 100).to_pylist()):
                for x in fn(r):
                    got.append(x)
                    if len(got) >= 10_000:
                        yield batch_of(got)
                        got = []
        if got:
            yield batch_of(got)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(),
             "array<string>": pa.list_(pa.string())}
    types = {f.split()[0]: kinds[f.split()[1]] for f in schema.split(", ")}
    return rows.mapInArrow(run, schema)


def split_names(names: DataFrame, words: DataFrame, staged: Staged) -> DataFrame:
    """(name, tokens) of distinct ``names``: each meets all words that it holds."""
    total = words.agg(F.sum("n")).first()[0]
    names = staged.write(names.withColumn("id", F.monotonically_increasing_id()), "distinct")

    def starts(r):
        name = r["name"]
        return ((r["id"], name[i:j]) for i in range(len(name))
                for j in range(i + 1, min(i + LOOKUP, len(name)) + 1))

    lookups = staged.write(_map(names, starts, "id long, key string"), "lookups")
    keyed = words.withColumn("key", F.substring("word", 1, LOOKUP))
    # of a word longer than its key, the split looks whether the name holds it
    held = (join_hot(lookups, keyed, "key", "inner")
            .groupBy("id", "word").agg(F.max("n").alias("n"))
            .groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("held")))

    def split(r):
        counts = {w["word"]: w["n"] for w in r["held"] or () if w["word"] in r["name"]}
        return [(r["name"], Segmenter(counts, total).split(r["name"]))]

    return staged.write(_map(names.join(held, "id", "left"), split,
                             "name string, tokens array<string>"), "names")


def count_tokens(urls: DataFrame, staged: Staged, rules=RULES) -> tuple[DataFrame, float]:
    """(token, odds) and the prior over all decided URLs (u, m, tokens): ``Bayes`` on tables."""
    def decided(r):
        rule = rule_for(*split_url(r["u"]), rules)
        if rule:
            block, m = rule[1] == "block", r["m"]
            for t, n in [(None, 1), *Counter(r["tokens"]).items()]:
                yield t, n * m if block else 0, 0 if block else n * m

    counts = staged.write(
        _map(urls, decided, "token string, block long, allow long").groupBy("token")
        .agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "tokens")
    told = F.col("token").isNotNull()
    sums = counts.agg(*[F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
                        for c in (told, ~told) for n in ("block", "allow")]).first()
    extra = max(SEED_LEAST, SEED_SHARE * (sums[0] + sums[1]))
    seeds = [(w, extra * (v == "block"), extra * (v == "allow"))
             for v in ("block", "allow") for w in SEED_WORDS[v].split()]
    full = (counts.filter(told).select("token", *[F.col(c).cast("double").alias(c)
                                                  for c in ("block", "allow")])
            .unionByName(counts.sparkSession.createDataFrame(
                [(w, float(b), float(a)) for w, b, a in seeds],
                "token string, block double, allow double"))
            .groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    n, block, allow = full.agg(F.count(F.lit(1)), F.sum("block"), F.sum("allow")).first()
    odds = full.select("token", (F.log((F.col("block") + 1) / F.lit(block + n))
                                 - F.log((F.col("allow") + 1) / F.lit(allow + n))).alias("odds"))
    return staged.write(odds, "odds"), math.log((sums[2] + 1) / (sums[3] + 1))


FIELDS = ("host", "path", "rule", "verdict", "words", "score")


def judge_urls(pages: DataFrame, url: str = "url", words: DataFrame | None = None,
               html: str = "html", rules=RULES) -> DataFrame:
    """``pages`` with the columns ``FIELDS``: host, path, rule (null without one), verdict,
    the segmented words, and the model's log odds for blocking (for every URL).  ``words``
    are counts of ``learn_words``, by default those of ``pages``."""
    staged = Staged(pages.sparkSession, "hosts")
    words = learn_words(pages, html) if words is None else words
    link = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    urls = staged.write(pages.groupBy(link.alias("u")).agg(F.count(F.lit(1)).alias("m"))
                        .withColumn("id", F.monotonically_increasing_id()), "urls")
    pieces = staged.write(_map(urls.select("id", "u"), lambda r: [
        (r["id"], i, *x) for i, x in enumerate(url_pieces(*split_url(r["u"])))],
        "id long, at long, name string, names boolean"), "pieces")
    splits = split_names(pieces.filter("names").select("name").distinct(), words, staged)
    parts = (join_hot(pieces.filter("names").drop("names"), splits, "name")
             .select("id", "at", "tokens")
             .unionByName(pieces.filter("not names")
                          .select("id", "at", F.array("name").alias("tokens")))
             .groupBy("id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", "tokens")))
                                         ["tokens"]).alias("tokens")))
    urls = staged.write(urls.join(parts, "id", "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>"))), "split")
    odds, prior = count_tokens(urls, staged, rules)
    scores = (join_hot(urls.select("id", F.posexplode("tokens").alias("at", "token")),
                       odds, "token")
              .groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
                  "at", F.coalesce("odds", F.lit(0.0)).alias("odds")))).alias("o"))
              .select("id", F.aggregate("o", F.lit(0.0), lambda x, o: x + o["odds"]).alias("sum")))

    def rule_parts(r):
        host, path = split_url(r["u"])
        return [(r["id"], r["u"], host, path, *(rule_for(host, path, rules) or (None, None)))]

    score = F.lit(prior) + F.coalesce("sum", F.lit(0.0))
    judged = staged.write(
        _map(urls.select("id", "u"), rule_parts,
             "id long, u string, host string, path string, rule string, ruled string")
        .join(urls.select("id", F.array_join("tokens", " ").alias("words")), "id")
        .join(scores, "id", "left")
        .select(F.col("u").alias("__u"), "host", "path", "rule",
                F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow"))
                .alias("verdict"), "words", score.alias("score")), "judged")
    kept = [c for c in pages.columns if c.lower() not in FIELDS]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], link.alias("__u"))
    return join_hot(rows, judged, "__u").select(*[F.col(f"`{c}`") for c in kept], *FIELDS)
