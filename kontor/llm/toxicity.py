"""Toxicity: a convolutional text classifier trained in numpy.

A text's words (A-Z lowered, cut at ASCII characters that are neither letters
nor digits) are hashed twice, and their first bytes once; a word's embedding is
the sum of these three table rows, so that words sharing one row stay apart and
unseen forms of a word still count.  Filters of several widths run
over the word sequence, each filter's largest response in the text feeds a
logistic output.  Training is Adam on the labelled texts; only the positions
that win the pooling get gradients.

All labelled texts take part: word counts, training and thresholds are Spark jobs
over their coded words.  Training is dealt to parts, whose networks are averaged
after every pass.  The driver gets counted words and the network's rows of the
words it knows, no texts.

The score comes from the text alone.  Per language a threshold is calibrated
on labelled texts that the training did not see (best F1); languages with too
few of them share a common one.

Nulls and empty texts have no words: every filter gives its response to
padding, so they get a score too.  Equal texts get equal scores.  Long texts
are scored whole.  Without labels of both classes the score is the share of
label 1 (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import Staged, WordHasher, annotate, slices, text_bytes
from kontor.llm.components import small_side

BITS = 17
BUCKETS = 1 << BITS        # rows for each of the three hashes
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Training passes, and batches in all of them together, at least.
EPOCHS, BATCHES = 8, 1600
BATCH, SEED = 32, 7
#: Every fifth labelled text calibrates.
CALIBRATION = 5
#: Texts and words that a part of the training texts has at most (but for longer texts).
PART_TEXTS, PART_WORDS = 6400, 4 << 20
#: Changes of the network are added up in whole numbers of this part of one.
UNIT = float(1 << 44)
#: Words whose responses are in memory at once.
ROOM = 60_000
#: Labelled calibration texts of either class that a language needs for a threshold of its own.
LANGUAGE_LEAST = 10

class Hasher:
    """Words to three rows as one number of three times BITS bits (0 is padding)."""

    def __init__(self):
        self.words = WordHasher(bytes(b for b in range(128) if not chr(b).isalnum()), leads=True)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        most, one = np.uint64(BUCKETS - 1), np.uint64(1)
        for h, _, lead in self.words.parts(texts):
            code = (h % most + one) << np.uint64(BITS)
            code = (code | ((h >> np.uint64(32)) % most + one)) << np.uint64(BITS)
            out.append((code | (lead % most + one)).astype(np.int64))
        return out


def rows_of(codes: np.ndarray) -> np.ndarray:
    """The three table rows of every word."""
    low = BUCKETS - 1
    return np.stack([codes >> 2 * BITS, BUCKETS + (codes >> BITS & low), 2 * BUCKETS + (codes & low)])


@dataclass
class Model:
    known: np.ndarray           # rows (of 3 * buckets) of words that training knows, ascending
    embed: np.ndarray           # 1 + known x dim; the first, zero, is that of all other rows
    filters: list[np.ndarray]   # per width: width x dim x filters
    bias: np.ndarray            # filters of all widths
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]
    threshold: float = 0.5
    prior: float | None = None  # the constant score of a model without training data

    def table(self) -> "Table":
        return Table(self)


class Table:
    """Response of every row to every (width, offset, filter)."""

    def __init__(self, model: Model):
        self.place = np.zeros(3 * BUCKETS, np.int32)
        self.place[model.known] = np.arange(1, len(model.known) + 1)
        self.value = np.concatenate([model.embed @ f[j] for f in model.filters
                                     for j in range(f.shape[0])], axis=1).astype(np.float32)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return self.value[self.place[rows]]


def layout(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, ``pad`` zeros around each, and where each starts."""
    lengths = np.fromiter((len(t) + 2 * pad for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    flat = np.zeros(int(lengths.sum()), np.int64)
    for s, t in zip(starts, texts):
        flat[s + pad:s + pad + len(t)] = t
    return flat, starts


def responses(table: Table, flat: np.ndarray, widths, filters: int) -> list[np.ndarray]:
    """Per width the filters' responses at every position (window starts there)."""
    first, *more = rows_of(flat)
    rows = table[first]
    for x in more:
        rows += table[x]
    return slide(rows, widths, filters)


def slide(rows: np.ndarray, widths, filters: int) -> list[np.ndarray]:
    """Window sums of the words' responses, one array per width."""
    out, col = [], 0
    for w in widths:
        total = rows[:, col:col + filters].copy()
        for j in range(1, w):
            part = rows[j:, col + j * filters:col + (j + 1) * filters]
            total[:len(part)] += part
        col += w * filters
        out.append(total)
    return out


def pooled(table, texts, widths, filters) -> np.ndarray:
    """Largest response of every filter in every text.  Windows that start in a text's
    last zeros may reach into the next text's first ones only, never its words."""
    pad = max(widths)
    flat, starts = layout(texts, pad)
    return np.concatenate([np.maximum.reduceat(r, starts, axis=0)
                           for r in responses(table, flat, widths, filters)], axis=1)


def scores(model: Model, table: Table, texts: list[np.ndarray]) -> np.ndarray:
    if model.prior is not None:
        return np.full(len(texts), model.prior)
    filters = model.filters[0].shape[2]
    best = pooled(table, texts, [f.shape[0] for f in model.filters], filters)
    logit = np.maximum(best + model.bias, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))


def least_texts(texts: int) -> int:
    """Texts, of so many, that a word (or beginning) must stand in: one of a thousand, and two.
    The network cannot learn single texts by their rare words."""
    return max(2, round(texts / 1000))


def text_counts(part: np.ndarray, text_no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and in how many texts each stands."""
    if not len(part):
        return part, part
    order = np.lexsort((text_no, part))
    p, t = part[order], text_no[order]
    return np.unique(p[np.concatenate([[True], (p[1:] != p[:-1]) | (t[1:] != t[:-1])])],
                     return_counts=True)


def only_frequent(flat: np.ndarray, words: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The codes without the rows of words and beginnings that are not listed."""
    word, lead = flat >> BITS, flat & (BUCKETS - 1)
    return (np.where(np.isin(word, words), word, 0) << BITS) | np.where(np.isin(lead, leads), lead, 0)


def known_rows(words: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The rows of listed words and beginnings, ascending."""
    first, second, _ = rows_of(words << BITS)
    return np.unique(np.concatenate([first, second, rows_of(leads)[2]]))


def frequent_words(texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts without the rows of rare words and rare beginnings, and the rows left."""
    flat = np.concatenate(texts)
    text_no = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    listed = []
    for part in (flat >> BITS, flat & (BUCKETS - 1)):
        values, times = text_counts(part, text_no)
        listed.append(values[times >= least_texts(len(texts))])
    flat = only_frequent(flat, *listed)
    return np.split(flat, np.cumsum([len(t) for t in texts])[:-1]), known_rows(*listed)


def places_of(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The three rows of every word as places in ``known``, counted from 1 (0: not known)."""
    place = np.zeros(3 * BUCKETS, np.int32)
    place[known] = np.arange(1, len(known) + 1)
    return place[rows_of(codes)]


def numbered_words(flat: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers (0 is padding), and the three places of every number."""
    codes = np.union1d(flat, np.zeros(1, np.int64))
    return np.concatenate([np.searchsorted(codes, flat[i:i + (1 << 16)]).astype(np.int32)
                           for i in range(0, max(len(flat), 1), 1 << 16)]), places_of(codes, known)


class Net:
    """The network while it learns: rows of known words, dense weights and Adam's moments."""

    def __init__(self, known: int, rng: np.random.Generator):
        self.embed = np.zeros((1 + known, DIM), np.float32)      # the first stays zero
        self.embed[1:] = rng.normal(0, 0.02, (known, DIM))
        kernels = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = {"bias": np.zeros(len(WIDTHS) * FILTERS, np.float32),
                      "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
                      "out_bias": np.zeros(1, np.float32)}
        self.dense |= {f"k{i}": k for i, k in enumerate(kernels)}
        self.m1 = {k: np.zeros_like(v) for k, v in self.dense.items()}
        self.m2 = {k: np.zeros_like(v) for k, v in self.dense.items()}

    def matrix(self) -> np.ndarray:
        """All numbers in rows of DIM, the known words' first."""
        rest = np.concatenate([v.ravel() for d in (self.dense, self.m1, self.m2) for v in d.values()])
        rest = np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)
        return np.concatenate([self.embed, rest]).astype(np.float64)

    def set(self, matrix: np.ndarray) -> None:
        self.embed = matrix[:len(self.embed)].astype(np.float32)
        rest, at = matrix[len(self.embed):].ravel().astype(np.float32), 0
        for d in (self.dense, self.m1, self.m2):
            for k, v in d.items():
                d[k] = rest[at:at + v.size].reshape(v.shape)
                at += v.size
        self.m2 = {k: np.maximum(v, 0) for k, v in self.m2.items()}

    def model(self, known: np.ndarray) -> Model:
        return Model(known, self.embed, [self.dense[f"k{i}"] for i in range(len(WIDTHS))],
                     self.dense["bias"], self.dense["out"], float(self.dense["out_bias"][0]), {})


def winners(table: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Every filter's largest response in every text, and per width the words (numbers) of the
    first window that gives it, as texts x filters x width.  At most ROOM words' responses are
    in memory at once."""
    pad = max(WIDTHS)
    best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    won = [np.zeros((len(texts), FILTERS, w), np.int64) for w in WIDTHS]

    def take(flat, starts, ends, first):
        """Windows that start from ``starts`` to ``ends``, of text ``first`` and those behind it."""
        for i, r in enumerate(slide(table[flat], WIDTHS, FILTERS)):
            at = np.stack([s + r[s:e].argmax(0) for s, e in zip(starts, ends)])
            value = np.take_along_axis(r, at, 0)
            old = best[first:first + len(starts), i * FILTERS:(i + 1) * FILTERS]
            more = value > old
            old[more] = value[more]
            words = flat[np.minimum(at[:, :, None] + np.arange(WIDTHS[i]), len(flat) - 1)]
            won[i][first:first + len(starts)][more] = words[more]

    n = 0
    while n < len(texts):
        if len(texts[n]) > ROOM:
            flat, _ = layout(texts[n:n + 1], pad)
            for at in range(0, len(flat), ROOM):
                part = flat[at:at + ROOM + pad - 1]
                take(part, [0], [min(ROOM, len(part))], n)
            n += 1
            continue
        end, size = n, 0
        while end < len(texts) and len(texts[end]) <= ROOM and (end == n or size + len(texts[end]) <= ROOM):
            size += len(texts[end])
            end += 1
        flat, starts = layout(texts[n:end], pad)
        take(flat, starts, np.append(starts[1:], len(flat)), n)
        n = end
    return best, won


def learn(net: Net, texts: list[np.ndarray], places: np.ndarray, labels: np.ndarray,
          rng: np.random.Generator, passes: range, epochs: int, batch: int = BATCH,
          rate: float = 0.02, embed_rate: float = 5.0, decay: float = 0.01) -> None:
    """``passes`` of ``epochs`` over texts of numbered words: Adam for the dense weights, plain
    decayed steps for the embeddings (a word moves as far as the texts that hold it agree, so
    single occurrences stay near zero).  The order of ``texts`` and ``rng`` fix the result."""
    each = -(-len(texts) // batch)
    step, steps = passes.start * each, epochs * each
    number, local = np.zeros(places.shape[1], np.int64), np.zeros(len(net.embed), np.int64)
    params, m1, m2 = net.dense, net.m1, net.m2
    for _ in passes:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            # the words of this batch, and the rows of these words
            own = np.zeros(len(number), bool)
            own[0] = True
            for i in pick:
                own[texts[i]] = True
            own = np.flatnonzero(own)
            number[own] = np.arange(len(own))
            three = places[:, own]
            used = np.zeros(len(local), bool)
            used[three] = True
            used = np.flatnonzero(used)
            local[used] = np.arange(len(used))
            three = local[three]
            emb = net.embed[used]
            table = np.concatenate([emb @ params[f"k{i}"][j] for i, w in enumerate(WIDTHS)
                                    for j in range(w)], axis=1)
            best, won = winners(table[three].sum(0), [number[texts[i]] for i in pick])
            pre = best + params["bias"]
            hidden = np.maximum(pre, 0)
            logit = hidden @ params["out"] + params["out_bias"][0]
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) / len(pick)
            grads = {"out": hidden.T @ error, "out_bias": np.array([error.sum()])}
            back = np.outer(error, params["out"]) * (pre > 0)
            grads["bias"] = back.sum(0)
            rows, moves = [], []
            for i, w in enumerate(WIDTHS):
                b = back[:, i * FILTERS:(i + 1) * FILTERS]
                g_k = np.zeros_like(params[f"k{i}"])
                for j in range(w):
                    words = three[:, won[i][:, :, j]]
                    e = emb[words].sum(0)                            # texts x filters x dim
                    g_k[j] = np.einsum("nfd,nf->df", e, b)
                    g = (b[:, :, None] * params[f"k{i}"][j].T[None])[b != 0]
                    rows.extend(x[b != 0] for x in words)
                    moves.extend([g.astype(np.float32)] * 3)
                grads[f"k{i}"] = g_k
            rows, moves = np.concatenate(rows), np.concatenate(moves)
            some = used[rows] > 0
            rows, moves = rows[some], moves[some]
            slower = 1 - step / steps
            step += 1
            fix1, fix2 = 1 - 0.9 ** step, 1 - 0.999 ** step
            for name, g in grads.items():
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                params[name] -= slower * rate * (m1[name] / fix1) / (np.sqrt(m2[name] / fix2) + 1e-8)
            if len(rows):
                by = np.argsort(rows, kind="stable")
                rows, moves = rows[by], moves[by]
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                g_emb = np.add.reduceat(moves, first, axis=0)
                moved = np.any(g_emb, axis=1)
                rows = rows[first][moved]
                net.embed[used[rows]] = emb[rows] * (1 - slower * decay) \
                    - slower * embed_rate * g_emb[moved]


def epochs_of(texts: int, batch: int = BATCH) -> int:
    """Passes over so many texts."""
    return max(EPOCHS, -(-BATCHES * batch // texts))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Model:
    """Fit the network to texts in memory (``fit`` does it over tables)."""
    rng = np.random.default_rng(seed)
    texts, known = frequent_words(texts)
    net, epochs = Net(len(known), rng), epochs_of(len(texts))
    words, places = numbered_words(np.concatenate(texts), known)
    learn(net, np.split(words, np.cumsum([len(t) for t in texts])[:-1]), places, labels, rng,
          range(epochs), epochs)
    return net.model(known)


def best_threshold(values: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1; among equals the middle of the widest gap below it."""
    order = np.argsort(-values, kind="stable")
    v, y = values[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(v[1:] != v[:-1], True)          # a cut falls between different scores
    i = int(np.argmax(np.where(last, f1, -1)))
    below = v[i + 1] if i + 1 < len(v) else 0.0
    return float((v[i] + below) / 2)


def best_cuts(staged: Staged, scored: DataFrame) -> dict:
    """``best_threshold`` over a table of ``score``, ``y`` and ``lang``, for all rows (key None)
    and for each language: rows, those of label 1, and the two scores the best cut is between.

    Buckets of scores carry the running counts, so that no task holds a language's scores.
    """
    whole, own = F.lit("*"), F.concat(F.lit("="), F.col("lang"))
    groups = F.when(F.col("lang").isNull(), F.array(whole)).otherwise(F.array(whole, own))
    bucket = F.floor(F.log(F.col("score") / (1 - F.col("score"))) * 64)
    each = staged.write(
        scored.select(F.explode(groups).alias("g"), "score", "y").groupBy("g", "score")
        .agg(F.count("*").alias("n"), F.sum("y").alias("hits")).withColumn("b", bucket), "cuts")
    falling = Window.partitionBy("g").orderBy(F.desc("b"))       # some 4,000 buckets at most
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("g")
    buckets = (each.groupBy("g", "b").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"),
                                          F.max("score").alias("top"))
               .select("g", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                       F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"),
                       F.lead("top").over(falling).alias("next"),
                       F.sum("n").over(group).alias("n_all"),
                       F.sum("hits").over(group).alias("hits_all")))
    inside = Window.partitionBy("g", "b").orderBy(F.desc("score"))
    hits = F.col("hits_before") + F.sum("hits").over(inside)
    seen = F.col("n_before") + F.sum("n").over(inside)
    below = F.coalesce(F.lead("score").over(inside), F.col("next"), F.lit(0.0))
    found = (each.join(buckets, ["g", "b"])
             .select("g", "n_all", "hits_all", F.struct(
                 (2 * hits / (seen + F.col("hits_all"))).alias("f1"), "score", below.alias("below"))
                 .alias("cut"))
             .groupBy("g", "n_all", "hits_all").agg(F.max("cut").alias("cut")).collect())
    staged.drop(each)
    return {r["g"][1:] or None: (r["n_all"], r["hits_all"], r["cut"]["score"], r["cut"]["below"])
            for r in found}


def calibrate(model: Model, cuts: dict) -> None:
    """Move the scores so that the best common threshold is 0.5, and set those of languages
    with enough texts."""
    n, hits, top, below = cuts.get(None, (0, 0, 0.0, 0.0))
    if not 0 < hits < n:
        return
    # the common threshold becomes 0.5: the output's bias moves by its log odds
    t = min(max((top + below) / 2, 1e-6), 1 - 1e-6)
    shift = np.log(t / (1 - t))
    model.out_bias -= float(shift)
    moved = lambda v: 1 / (1 + np.exp(shift) * (1 / np.clip(v, 1e-13, 1 - 1e-13) - 1))
    for lang, (n, hits, top, below) in sorted((k, v) for k, v in cuts.items() if k is not None):
        if min(hits, n - hits) >= LANGUAGE_LEAST:
            model.thresholds[lang] = float((moved(top) + (moved(below) if below else 0.0)) / 2)


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 0 modulo 5; false for a null id, which no label
    belongs to."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def constant_model(score: float) -> Model:
    empty = np.zeros((1, 1), np.float32)
    return Model(np.zeros(0, np.int64), empty, [empty[None]], np.zeros(1), np.zeros(1), 0.0, {},
                 prior=score)


def _code_task(batches):
    """Texts to the codes of their words."""
    hasher = Hasher()
    for batch in batches:
        for part in slices(batch, 3):
            codes = hasher(text_bytes(part.column(3)))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(3)), pa.array([len(c) for c in codes], pa.int64()),
                 pa.array([c.tobytes() for c in codes], pa.binary())],
                ["at", "y", "lang", "words", "codes"])


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def _count_task(batches):
    """Words (kind 0) and beginnings (kind 1), and in how many of the texts each stands."""
    for batch in batches:
        for part in slices(batch, 0):
            texts = _codes(part.column(0))
            flat = np.concatenate(texts)
            text_no = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            for kind, codes in enumerate((flat >> BITS, flat & (BUCKETS - 1))):
                values, times = text_counts(codes, text_no)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), kind), pa.int64()), pa.array(values, pa.int64()),
                     pa.array(times, pa.int64())], ["kind", "value", "n"])


def _pack_task(words: np.ndarray, leads: np.ndarray, known: np.ndarray):
    """Rows of a part, in order, to one row with all its texts as numbered words."""

    def packed(part, labels, texts):
        numbers, places = numbered_words(np.concatenate(texts), known)
        blobs = [np.array([len(t) for t in texts], np.int64), numbers, places,
                 np.array(labels, np.float32)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
            ["part", "lengths", "words", "places", "labels"])

    def run(batches):
        now, labels, texts = None, [], []
        for batch in batches:
            for some in slices(batch, 2):
                codes = _codes(some.column(2))
                flat = only_frequent(np.concatenate(codes), words, leads)
                codes = np.split(flat, np.cumsum([len(c) for c in codes])[:-1])
                for part, y, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), codes):
                    if part != now and texts:
                        yield packed(now, labels, texts)
                        labels, texts = [], []
                    now = part
                    labels.append(y)
                    texts.append(text)
        if texts:
            yield packed(now, labels, texts)

    return run


def _learn_task(net: Net, passes: range, epochs: int, rng: np.random.Generator | None, n: int):
    """What the passes over each part change in the network, weighted by its texts and added up;
    in whole numbers, so that the order of the parts does not matter."""

    def run(batches):
        start, total = net.matrix(), None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                lengths = np.frombuffer(row["lengths"], np.int64)
                texts = np.split(np.frombuffer(row["words"], np.int32), np.cumsum(lengths)[:-1])
                net.set(start)
                learn(net, texts, np.frombuffer(row["places"], np.int32).reshape(3, -1),
                      np.frombuffer(row["labels"], np.float32),
                      rng or np.random.default_rng([SEED, row["part"], passes.start]), passes, epochs)
                change = np.rint((net.matrix() - start) * (len(texts) / n * UNIT)).astype(np.int64)
                total = change if total is None else total + change
        if total is not None:
            at = np.flatnonzero(np.any(total, axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in total[at].T)],
                ["at", *(f"d{i}" for i in range(DIM))])

    return run


def _score_task(model: Model):
    def run(batches):
        table = model.table()
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array(score_words(model, table, _codes(part.column(2))), pa.float64())],
                    ["y", "lang", "score"])

    return run


def bounded_labels(docs: DataFrame, known: DataFrame, per_class: int | None,
                   most_bytes: int | None) -> DataFrame:
    """Of the labelled ids those whose hashes are lowest: at most ``per_class`` of each class,
    and ``most_bytes`` of text, of which no text may have more than a hundredth."""
    h = F.xxhash64("k", F.lit("train"))
    if per_class is not None:
        zero, one = (known.filter(F.col("y") == y).orderBy(h, "k").limit(per_class) for y in (0, 1))
        known = zero.unionByName(one)
    if most_bytes is not None:
        sizes = (docs.select("k", "t").join(known, "k").groupBy("k", "y")
                 .agg(F.min(F.struct("t")).alias("d"))
                 .select("k", "y", F.coalesce(F.octet_length("d.t"), F.lit(0)).alias("size"))
                 .filter(F.col("size") * 100 <= most_bytes))
        so_far = F.sum("size").over(Window.orderBy(h, "k"))
        known = (sizes.select("k", "y", so_far.alias("bytes"))
                 .filter(F.col("bytes") <= most_bytes).select("k", "y"))
    return known


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        lang: str | None = "lang", label: str = "toxic",
        per_class: int | None = None, most_bytes: int | None = None) -> Model:
    """Train on all labelled texts outside the held-out fifth, or on a sample if ``per_class`` or
    ``most_bytes`` ask for one.  Ids and labels that are null do not count; an id with several
    labels has the largest, one with several texts the smallest.

    In the order of the ids' hashes, every fifth text calibrates and the others are dealt to
    parts.  Each pass learns on all parts side by side, from the same network, and the next
    starts from the mean of what they made of it; one part alone learns in one go.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "toxicity")
    lang_col = F.col(f"`{lang}`") if lang else F.lit(None)
    docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"),
                       lang_col.cast("string").alias("lang"))
    known = (labels.select(F.col(key).alias("k"), F.col(label).alias("y"))
             .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1)).filter(~held_out("k"))
             .groupBy("k").agg(F.max("y").cast("int").alias("y")))
    known = bounded_labels(docs, known, per_class, most_bytes)
    # ids in the order of their hashes: blocks of hashes, and places inside them
    h = F.xxhash64("k", F.lit("train"))
    ids = staged.write(known.join(docs.select("k"), "k", "left_semi")
                       .select("k", "y", h.alias("h"), F.shiftright(h, 52).alias("b")), "ids")
    sizes = sorted((r["b"], r["count"]) for r in ids.groupBy("b").count().collect())   # 4,096
    if not sizes:
        staged.drop(ids)
        return constant_model(0.0)
    ends = np.cumsum([n for _, n in sizes]).tolist()
    blocks = spark.createDataFrame([(b, e - n) for (b, n), e in zip(sizes, ends)],
                                   "b long, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "k")) - 1
    places = staged.write(ids.join(F.broadcast(blocks), "b").select("k", "y", place.alias("at")),
                          "places")
    texts = staged.write(
        docs.join(small_side(places), "k")
        .groupBy("k", "y", "at").agg(F.min(F.struct("t", "lang")).alias("d"))
        .select("at", "y", "d.lang", "d.t")
        .mapInArrow(_code_task, "at long, y int, lang string, words long, codes binary"), "codes")
    staged.drop(ids, places)
    model = fit_codes(staged, texts)
    staged.drop(texts)
    return model


def fit_codes(staged: Staged, texts: DataFrame) -> Model:
    """The model of texts whose words are coded, numbered by ``at`` from 0."""
    test = F.col("at") % CALIBRATION == CALIBRATION - 1
    groups = {(r["test"], r["y"]): (r["n"], r["words"]) for r in texts.groupBy(test.alias("test"), "y")
              .agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    if len({y for _, y in groups}) < 2:
        (_, y), = {(None, y) for _, y in groups}
        return constant_model(float(y))
    apart = len({y for t, y in groups if not t}) == 2
    learned = texts.filter(~test) if apart else texts
    n, words = (sum(v[i] for (t, _), v in groups.items() if not (t and apart)) for i in (0, 1))
    listed = (learned.select("codes").mapInArrow(_count_task, "kind long, value long, n long")
              .groupBy("kind", "value").agg(F.sum("n").alias("n"))
              .filter(F.col("n") >= least_texts(n)).select("kind", "value").toArrow())
    kind, value = (listed.column(c).to_numpy() for c in ("kind", "value"))
    listed = [np.sort(value[kind == k]) for k in (0, 1)]
    known = known_rows(*listed)

    parts = max(-(-n // PART_TEXTS), -(-words // PART_WORDS))
    number = F.col("at") - F.floor((F.col("at") + 1) / CALIBRATION) if apart else F.col("at")
    packed = staged.write(
        learned.select(F.floor(number * parts / n).alias("part"), "at", "y", "codes")
        .repartitionByRange(parts, "part").sortWithinPartitions("part", "at").select("part", "y", "codes")
        .mapInArrow(_pack_task(*listed, known),
                    "part long, lengths binary, words binary, places binary, labels binary"), "parts")
    rng = np.random.default_rng(SEED)
    net, epochs = Net(len(known), rng), epochs_of(-(-n // parts))
    changes = "at long, " + ", ".join(f"d{i} long" for i in range(DIM))
    for at in range(0, epochs, epochs if parts == 1 else 1):
        passes = range(at, epochs if parts == 1 else at + 1)
        got = (packed.mapInArrow(_learn_task(net, passes, epochs, rng if parts == 1 else None, n), changes)
               .groupBy("at").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIM))).toArrow())
        matrix = net.matrix()
        matrix[got.column("at").to_numpy()] += np.stack(
            [got.column(f"d{i}").to_numpy() for i in range(DIM)], axis=1) / UNIT
        net.set(matrix)
    staged.drop(packed)
    model = net.model(known)
    scored = (texts.filter(test) if apart and any(t for t, _ in groups) else texts).select("y", "lang", "codes")
    calibrate(model, best_cuts(staged, scored.mapInArrow(
        _score_task(model), "y int, lang string, score double")))
    return model


def make_scorer(model: Model):
    hasher, table = Hasher(), model.table()
    return lambda texts: {"score": score_words(model, table, hasher(texts))}


def score_words(model: Model, table: Table, texts: list[np.ndarray]) -> list[float]:
    """Scores of coded texts; ROOM words' responses are in memory at once."""
    out, part, size = [], [], 0
    for words in texts:
        if part and size + len(words) > ROOM:
            out.extend(scores(model, table, part).tolist())
            part, size = [], 0
        if len(words) > ROOM:
            out.extend(long_score(model, table, words, ROOM))
            continue
        part.append(words)
        size += len(words)
    if part:
        out.extend(scores(model, table, part).tolist())
    return out


def long_score(model: Model, table: Table, words: np.ndarray, room: int) -> list[float]:
    """Score of one text longer than ``room``: the windows of the whole text, ``room`` of
    their starts at a time, with padding only where the text begins and ends."""
    if model.prior is not None:
        return [model.prior]
    widths = [f.shape[0] for f in model.filters]
    filters, pad = model.filters[0].shape[2], max(widths)
    zeros = np.zeros(pad, np.int64)
    flat, best = np.concatenate([zeros, words, zeros]), None
    for at in range(0, len(flat), room):
        part = responses(table, flat[at:at + room + pad - 1], widths, filters)
        got = np.concatenate([r[:room].max(0) for r in part])
        best = got if best is None else np.maximum(best, got)
    logit = np.maximum(best + model.bias, 0)[None] @ model.out + model.out_bias
    return (1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))).tolist()


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, from the text alone."""
    return annotate(docs, text, lambda: make_scorer(model), {"score": "double"})


def threshold_of(model: Model, lang: str):
    """Column: the threshold for the language in column ``lang``."""
    if not model.thresholds:
        return F.lit(model.threshold)
    own = F.create_map(*(F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair))
    return F.coalesce(own[F.col(f"`{lang}`")], F.lit(model.threshold))


def reject_toxic(docs: DataFrame, model: Model, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """``docs`` without those that score at least their language's threshold."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    scored = score_toxicity(docs.select(F.struct(*cols).alias("doc"),
                                        F.col(f"`{text}`").alias("text"),
                                        threshold_of(model, lang).alias("threshold")), model)
    return scored.filter(F.col("score") < F.col("threshold")).select("doc.*")
