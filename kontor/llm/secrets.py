"""Secret scans by grammar inference.

Three fixed patterns find the base spans.  Their matches are credentials with a
label (the kind), and a bounded sample of them trains one probabilistic
automaton per kind.  The credentials go into a prefix tree.  Its states are
merged where their outgoing frequencies, down to the ends of the strings, agree
within a Hoeffding bound (state merging in the style of ALERGIA), in two
rounds: first states of one depth, which pools the few strings of each branch,
then states of different depths on the pooled counts.  A format of fixed length
thus keeps a state per place, one of any length becomes a loop.  Four further
automata, the background, are learned from word-like runs: pieces of letters (of
one case, or with a capital first) or of digits, between other marks; one each
from words, from words in capitals, from numbers and from runs of words and numbers.

Every candidate of every text is scored: each run of credential characters of
the shortest labelled length or more, the remainders beside base spans too.
The score under a format is the log-likelihood per symbol against the best of the
background.  A run is a span of kind ``format`` where a format's score reaches its
mark, between the labelled credentials and the word-like runs held out, and where
the whole run's evidence also outweighs how much commoner word-like runs are
than labelled credentials, counted over all texts.  Candidates of unknown kind
neither train nor set the mark, so however many of them are credentials, they
do not raise it.

Null and empty texts have no spans.  Equal texts get equal spans.  Without any
base match in the table nothing is learned and only base spans (none) come
out.  Repeated values count once in learning.  Long texts are scanned whole, in
time linear in their length, and long runs are scored whole; the automata learn
from the first ``DEPTH`` symbols of a value.  Offsets are code points, end
exclusive.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import Staged, annotate, slices, text_bytes

# The base patterns (letters of the keywords in either case), the
# shortest kept match, and the order of the kinds.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    rb"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "format")

#: Words shorter than this hold no access or hex match.
LONG_RUN = 20
#: Symbols of a value that the automata learn from.
DEPTH = 96
# Candidates: as long as the shortest labelled value, with the same characters; dots at
# either end are punctuation.
_RUN = re.compile(rb"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]")
_PIECE = rb"(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)"
_DIGIT = re.compile(rb"[0-9]")
_LETTER = re.compile(rb"[A-Za-z]")
_CAPITALS = re.compile(rb"[A-Z]{2}")
_WORD_LIKE = re.compile(rb"[+/_.=-]*+" + _PIECE + rb"(?:[+/_.=-]++" + _PIECE + rb")*+[+/_.=-]*+")

# Symbols of the automata: one per character class, other characters as they are.
_CLASSES = {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF",
            "G": "GHIJKLMNOPQRSTUVWXYZ"}
_SYMBOL = bytes.maketrans("".join(_CLASSES.values()).encode(),
                          "".join(k * len(v) for k, v in _CLASSES.items()).encode())
N_SYMBOLS = 11          # five classes and + / _ . = -


def long_runs(text: bytes) -> list[tuple[int, bytes]]:
    """Words between white space of at least LONG_RUN bytes, with their places."""
    out, at = [], 0
    for w in [w for w in text.split() if len(w) >= LONG_RUN]:
        at = text.index(w, at)
        out.append((at, w))
        at += len(w)
    return out


def base_spans(text: bytes, runs: list[tuple[int, bytes]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) in bytes, leftmost and non-overlapping per kind."""
    low = text.lower()
    found = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found = [("assign", m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text)
                 if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    for kind, pattern, least in (("access", ACCESS, 20), ("hex", HEX, 24)):
        for at, run in runs:        # a match holds no white space
            if len(run) >= least:
                found += [(kind, at + m.start(), at + m.end(), at + m.start())
                          for m in pattern.finditer(run)]
    return found


def gaps(length: int, base: list[tuple[str, int, int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches of a text between its base spans, in bytes."""
    at = 0
    for s, e in sorted((s, e) for _, s, e, _ in base):
        if s > at:
            yield at, s
        at = max(at, e)
    if at < length:
        yield at, length


def candidates(text: bytes, base: list[tuple[str, int, int, int]]) -> list[bytes]:
    """Credential-character runs outside the base spans, in order."""
    return [run for s, e in gaps(len(text), base) for run in _RUN.findall(text, s, e)]


#: The sorts of word-like runs.
ORDINARY = ("words", "capitals", "numbers", "names")


def sort_of(run: bytes) -> str | None:
    """The sort of a word-like run; None of any other."""
    if not _WORD_LIKE.fullmatch(run):
        return None
    if _DIGIT.search(run):
        return "names" if _LETTER.search(run) else "numbers"
    return "capitals" if _CAPITALS.search(run) else "words"


# ------------------------------------------------------------ grammar inference
class _Tree:
    """Prefix tree with counts; states are list indices.  Strings beyond ``DEPTH`` have
    no end in it."""

    def __init__(self, strings: list[bytes]):
        self.seen, self.ends, self.next, self.used = [0], [0], [{}], [{}]
        for s in strings:
            at = 0
            self.seen[0] += 1
            for c in s[:DEPTH]:
                nxt = self.next[at].get(c)
                if nxt is None:
                    nxt = len(self.seen)
                    self.next[at][c] = nxt
                    self.used[at][c] = 0
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.used.append({})
                self.used[at][c] += 1
                at = nxt
                self.seen[at] += 1
            self.ends[at] += len(s) <= DEPTH
        self.into = list(range(len(self.seen)))      # the state that one was merged into

    def state(self, q: int) -> int:
        while self.into[q] != q:
            self.into[q] = self.into[self.into[q]]
            q = self.into[q]
        return q

    def differ(self, a: int, b: int, bound: float) -> bool:
        """Whether the frequencies of two states differ beyond the Hoeffding bound,
        there or further down."""
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            a, b = self.state(a), self.state(b)
            if a == b or (a, b) in met:
                continue
            met.add((a, b))
            na, nb = self.seen[a], self.seen[b]
            limit = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if limit >= 1:
                continue        # too few strings to tell the states, or any below, apart
            if abs(self.ends[a] / na - self.ends[b] / nb) > limit:
                return True
            for c in self.used[a].keys() | self.used[b].keys():
                if abs(self.used[a].get(c, 0) / na - self.used[b].get(c, 0) / nb) > limit:
                    return True
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return False

    def merge(self, kept: int, other: int) -> None:
        """Make two states one, and so the states that both reach by one symbol."""
        todo = [(kept, other)]
        while todo:
            a, b = todo.pop()
            a, b = self.state(a), self.state(b)
            if a == b:
                continue
            self.into[b] = a
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, nxt in self.next[b].items():
                self.used[a][c] = self.used[a].get(c, 0) + self.used[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], nxt))
                else:
                    self.next[a][c] = nxt
            self.next[b], self.used[b] = {}, {}

    def below(self, states: list[int]) -> list[int]:
        """The states that the given ones lead to, those of most strings first."""
        found = {self.state(q): None for r in states for _, q in sorted(self.next[r].items())}
        return sorted(found, key=lambda q: -self.seen[q])

    def settle(self, kept: list[int], states: list[int], bound: float) -> list[int]:
        """Merge each state into the first kept one that it agrees with, or keep it too."""
        for q in states:
            q = self.state(q)
            if q in kept:
                continue
            for r in kept:
                if not self.differ(r, q, bound):
                    self.merge(r, q)
                    break
            else:
                kept.append(q)
            kept = list(dict.fromkeys(self.state(r) for r in kept))
        return kept


def infer(strings: list[bytes], alpha: float = 0.05) -> dict:
    """Probabilistic automaton of symbol strings: log probabilities per state.

    States of one depth are merged first, depth after depth, so that each keeps the
    strings of all branches that cannot be told apart.  Then the states are taken in
    order of depth and merged into the first earlier one that they agree with.
    """
    tree = _Tree(strings)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    layers = [[0]]
    while below := tree.below(layers[-1]):
        layers.append(tree.settle([], below, bound))
    kept = [0]
    for layer in layers[1:]:
        kept = tree.settle(kept, layer, bound)
    number = {q: i for i, q in enumerate(kept)}
    step, end, missing = [], [], []
    for q in kept:
        total = tree.seen[q] + 0.5 * (N_SYMBOLS + 1)
        step.append({c: (number[tree.state(tree.next[q][c])],
                         math.log((tree.used[q][c] + 0.5) / total)) for c in tree.next[q]})
        end.append(math.log((tree.ends[q] + 0.5) / total))
        missing.append(math.log(0.5 / total))
    return {"step": step, "end": end, "missing": missing}


def log_likelihood(auto: dict, symbols: bytes) -> float:
    """Log probability per symbol (end included); a symbol not seen in a state
    costs its smoothed probability and leads back to the start."""
    at, total = 0, 0.0
    for c in symbols:
        nxt = auto["step"][at].get(c)
        if nxt is None:
            total += auto["missing"][at]
            at = 0
        else:
            at = nxt[0]
            total += nxt[1]
    return (total + auto["end"][at]) / (len(symbols) + 1)


def symbols_of(value: bytes) -> bytes:
    return value.translate(_SYMBOL)


class Grammar:
    """The automata of the formats and of the background, and what a run must reach: a
    score per symbol for each format (``marks``) and a score in all (``evidence``)."""

    def __init__(self, formats: dict[str, dict], background: dict[str, dict],
                 marks: dict[str, float], evidence: float = 0.0):
        self.formats, self.background = formats, background
        self.marks, self.evidence = marks, evidence

    def scores(self, symbols: bytes) -> dict[str, float]:
        """Score per format."""
        rest = max((log_likelihood(a, symbols) for a in self.background.values()),
                   default=-math.log(N_SYMBOLS))
        return {k: log_likelihood(a, symbols) - rest for k, a in self.formats.items()}

    def judge(self, symbols: bytes) -> tuple[float, bool]:
        """The best score, and whether the run is accepted."""
        scores = self.scores(symbols)
        return max(scores.values(), default=-math.inf), any(
            x >= self.marks[k] and x * (len(symbols) + 1) >= self.evidence
            for k, x in scores.items())


def fit(credentials: dict[str, list[bytes]], ordinary: list[bytes],
        alpha: float = 0.05) -> Grammar:
    """Learn from labelled credentials and from runs known as ordinary (raw bytes)."""
    def distinct(values):
        return [symbols_of(v)[:DEPTH + 1] for v in sorted(set(values))]

    sorts: dict[str, list[bytes]] = {k: [] for k in ORDINARY}
    for v in ordinary:
        sorts[sort_of(v) or "names"].append(v)
    return fit_symbols({k: distinct(v) for k, v in credentials.items()},
                       {k: distinct(v) for k, v in sorts.items()}, alpha=alpha)


def fit_symbols(credentials: dict[str, list[bytes]], ordinary: dict[str, list[bytes]],
                odds: float = 1.0, alpha: float = 0.05) -> Grammar:
    """Learn from symbol strings, one per distinct value, in an order that means nothing.

    Four of five strings train the automata.  The rest set the mark of each format:
    half-way between the 99.5 % quantile of the ordinary runs' scores (the largest of the
    sorts') and the 5 % quantile of the format's own, the former where they cross, and at
    least 0.1.  ``odds`` says how
    much commoner ordinary runs are; its logarithm is the evidence wanted of a run.
    """
    def held(values):
        return values[4::5]

    def trained(values):
        return [v for i, v in enumerate(values) if i % 5 != 4]

    credentials = {k: v for k, v in sorted(credentials.items()) if v}
    ordinary = {k: v for k, v in sorted(ordinary.items()) if v}
    formats = {k: infer(trained(v), alpha) for k, v in credentials.items()}
    background = {k: infer(trained(v), alpha) for k, v in ordinary.items()} if formats else {}
    grammar = Grammar(formats, background, {}, max(0.0, math.log(odds)))
    plain = [[grammar.scores(s) for s in held(v)] for v in ordinary.values()]
    for k in formats:
        good = sorted(grammar.scores(s)[k] for s in held(credentials[k]))
        low = 0.1
        for bad in (sorted(x[k] for x in scores) for scores in plain if scores):
            low = max(low, bad[int(0.995 * (len(bad) - 1))] + 1e-9)
        high = good[int(0.05 * (len(good) - 1))] if good else low
        grammar.marks[k] = max(low, (low + high) / 2)
    return grammar


# ------------------------------------------------------------ Spark jobs
_SEEN = "kind string, h long, symbols binary, n long"


def _samples(docs: DataFrame, text: str, wanted: dict[str, int]) -> DataFrame:
    """Per batch and kind the ``wanted`` distinct values of the smallest hashes, as their
    first symbols, and (h null) how many runs of the kind there are."""
    def run(batches):
        for batch in batches:
            runs: Counter = Counter()
            values: dict[str, Counter] = {k: Counter() for k in wanted}
            for part in slices(batch, 0):
                for t in text_bytes(part.column(0)):
                    base = base_spans(t, long_runs(t))
                    for k, _, e, v in base:
                        values[k][t[v:e]] += 1
                    runs.update(candidates(t, base))
            for r, n in runs.items():
                if (sort := sort_of(r)) is not None:
                    values[sort][r] = n
            out = []
            for kind, found in values.items():
                out.append((kind, None, None, sum(found.values())))
                least = heapq.nsmallest(wanted[kind], ((xxhash.xxh64_intdigest(v) >> 1, v)
                                                       for v in found))
                out += [(kind, h, symbols_of(v[:DEPTH + 1]), None) for h, v in least]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(),
                                                            pa.int64()))],
                ["kind", "h", "symbols", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, _SEEN)


def learn_grammar(docs: DataFrame, text: str = "text", per_kind: int = 500) -> Grammar:
    """Grammar from at most ``per_kind`` distinct values of each kind (and twice as
    many word-like runs of each sort), those with the smallest hashes of all texts, ``DEPTH`` symbols
    of each; the runs of both sorts are counted over all texts."""
    wanted = {**dict.fromkeys(KINDS[:3], per_kind), **dict.fromkeys(ORDINARY, 2 * per_kind)}
    staged = Staged(docs.sparkSession, "secrets")
    seen = staged.write(_samples(docs, text, wanted), "seen")
    parts = [seen.filter((F.col("kind") == kind) & F.col("h").isNotNull())
             .groupBy("h").agg(F.min("symbols").alias("symbols"))
             .orderBy("h").limit(most)
             .select(F.lit(kind).alias("kind"), "h", "symbols",
                     F.lit(None).cast("long").alias("n"))
             for kind, most in wanted.items()]
    rows = seen.filter(F.col("h").isNull()).groupBy("kind").agg(F.sum("n").alias("n")) \
        .select("kind", F.lit(None).cast("long").alias("h"),
                F.lit(None).cast("binary").alias("symbols"), "n")
    for part in parts:
        rows = rows.unionByName(part)
    values: dict[str, list] = {kind: [] for kind in wanted}
    count = dict.fromkeys(wanted, 0)
    for kind, h, symbols, n in rows.collect():       # at most 9 * per_kind + 6 short rows
        if h is None:
            count[kind] = n
        else:
            values[kind].append((h, bytes(symbols)))
    staged.drop(seen)
    strings = {kind: [s for _, s in sorted(v)] for kind, v in values.items()}
    common = sum(count[k] for k in ORDINARY)
    labelled = sum(count[k] for k in KINDS[:3])
    return fit_symbols({k: strings[k] for k in KINDS[:3]}, {k: strings[k] for k in ORDINARY},
                       odds=max(1.0, common / max(1, labelled)))


FIELDS = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_spans": "string",
          "spans": "string", "n_format": "long", "best_score": "double"}


class Judge:
    """Verdicts on runs under a grammar; those on short runs are kept for the next texts."""

    KEPT = 200_000

    def __init__(self, grammar: Grammar):
        self.grammar, self.by_run, self.by_symbols = grammar, {}, {}

    def verdict(self, run: bytes) -> tuple[float, bool]:
        """The best score, and whether the run is accepted."""
        got = self.by_run.get(run)
        if got is None:
            symbols = symbols_of(run)
            got = self.by_symbols.get(symbols)
            if got is None:
                got = self.grammar.judge(symbols)
            if len(run) <= DEPTH:
                for kept, key in ((self.by_run, run), (self.by_symbols, symbols)):
                    if len(kept) >= self.KEPT:
                        kept.clear()
                    kept[key] = got
        return got

    def spans(self, text: bytes) -> tuple[list[tuple[str, int, int]], float | None]:
        """All spans (kind, start, end) in bytes, and the best candidate's score."""
        base = base_spans(text, long_runs(text))
        out, best = [(k, s, e) for k, s, e, _ in base], None
        runs = set(candidates(text, base)) if self.grammar.formats else ()
        if runs:
            verdicts = {r: self.verdict(r) for r in runs}
            best = max(x for x, _ in verdicts.values())
            found = {r for r, (_, ok) in verdicts.items() if ok}
            if found:
                out += [("format", m.start(), m.end()) for s, e in gaps(len(text), base)
                        for m in _RUN.finditer(text, s, e) if m.group() in found]
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]))), best


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if text.isascii():
        return spans
    where, at, n = {}, 0, 0
    for b in sorted({x for _, s, e in spans for x in (s, e)}):
        n += len(text[at:b].decode())
        at = b
        where[b] = n
    return [(k, where[s], where[e]) for k, s, e in spans]


def make_scanner(grammar: Grammar):
    judge = Judge(grammar)

    def scan(texts: list[bytes]) -> dict:
        out = {n: [] for n in FIELDS}
        for text in texts:
            spans, best = judge.spans(text)
            spans = in_code_points(text, spans)
            shown = [f"{k}:{s}:{e}" for k, s, e in spans]
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in spans))
            out["base_spans"].append(",".join(x for x in shown if not x.startswith("format:")))
            out["spans"].append(",".join(shown))
            out["best_score"].append(best)
        return out

    return scan


def scan_secrets(docs: DataFrame, text: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``docs`` with the columns of ``FIELDS``; spans joined as kind:start:end by
    start, then kind.  The grammar is learned from ``docs`` unless given."""
    grammar = grammar or learn_grammar(docs, text)
    return annotate(docs, text, lambda: make_scanner(grammar), FIELDS)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]",
                   grammar: Grammar | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark`` (overlapping spans
    together, once); documents without spans, and nulls, stay as they are."""
    grammar = grammar or learn_grammar(docs, text)
    found = annotate(docs, text, lambda: make_redactor(grammar, mark.encode()),
                     {"__redacted": "string"})
    return found.withColumn(text, F.coalesce("__redacted", F.col(f"`{text}`"))) \
        .drop("__redacted").select(*[F.col(f"`{c}`") for c in docs.columns])


def make_redactor(grammar: Grammar, mark: bytes):
    judge = Judge(grammar)

    def redact(texts: list[bytes]) -> dict:
        out = []
        for text in texts:
            spans, _ = judge.spans(text)
            parts, at = [], 0
            for _, s, e in spans:
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append(b"".join([*parts, text[at:]]).decode() if spans else None)
        return {"__redacted": out}

    return redact
