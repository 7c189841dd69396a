"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Labellers that call the same texts bad more often than by chance
make a family; expectation-maximisation over the counts of each family's vote patterns (all texts; a table of at most
3^labellers rows) estimates how often each labeller calls good and bad texts bad. Priors say that a labeller is right
as a rule; they count as a share of the texts, so that overlaps outweigh them. Where labelled texts are given, they stand at their
class in the sums. Texts with clear posteriors, a bounded sample by hash order, train a linear scorer on hashed features
of tokens, which scores every text; its gradients are summed over partitions. There are two such models: junk and abuse.
The abuse labellers are a word list and two lists learned from `labels` (words and word beginnings), from a bounded sample
of labelled texts, other ones than those that stand at their class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, named, stored, table, trimmed
from .language import Words, held_out

SLOTS = 1 << 18  # hashed features
SAMPLE = 4_000  # texts of each class that train a scorer; the only bounded sample of the texts
SAMPLE_TOKENS = 3_000  # longest text, in distinct tokens, that may train
LABELLED = 20_000  # labelled texts at most from which the abuse lists are learned, and as many that stand at their class
CACHED = 400_000
BLOCK = 100_000  # tokens whose new ones are looked at together
GOOD, BAD, NONE = 0, 1, 2
JUNK = ("symbols", "separators", "capitals", "exclamations", "repeats", "variety", "digits", "letters")
ABUSE = ("insults", "words", "beginnings")
CLEAR_BAD, CLEAR_GOOD = (0.6, 1.0), (0.0, 0.1)  # posteriors of the texts that train
LEAST_TOKENS = 20  # shorter texts have no louder tokens than this
FALSE_ALARMS, HITS = 0.002, 0.7  # prior: shares of good and of bad texts that a labeller calls bad
PRIOR = 0.2  # weight of the prior, as a share of the texts of a class
ANCHORS = 1.0  # weight of all labelled texts together, as a share of all texts
LIFT = 2.0  # of a family: so many times as often as by chance they call a text bad together
STEPS = 60  # of the scorer's descent
LOCAL = 6  # of them on a partition's own texts, before partitions are averaged
PARTS = 3  # partitions of the training sample, which is bounded
LEAST_A_PART = 100  # texts of a class
BEGINNING = 5  # characters of a word beginning

# English insults.
INSULTS = frozenset("idiot moron stupid trash scum loser pathetic worthless disgusting clown dumb imbecile jerk creep bastard bitch whore slut retard filthy vermin".split())

RUN = re.compile(r"([^\w\s])\1\1")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


ENDS = frozenset(".,;:?!")


def bare(token: str) -> str:
    return EDGES.sub("", token).lower()


class Tokens:
    """Properties of distinct tokens, computed once in a task: columns symbol run, no letter or digit, exclamation,
    letters, capitals, digits, characters, insult, learned word, learned beginning."""

    def __init__(self, words: frozenset[str], beginnings: frozenset[str]):
        self.words, self.beginnings = words, beginnings
        self.number, self.table, self.used = Words(), np.zeros((1 << 14, 10), np.float32), 0

    def ids(self, text: str) -> np.ndarray:
        tokens = text.split()
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))

    def grow(self) -> list[str]:
        """Compute the properties of the tokens that are new, and return those."""
        new, self.number.new = self.number.new, []
        if new:
            if self.used + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros((len(self.table) + len(new), 10), np.float32)))
            rows = self.table[self.used : self.used + len(new)]
            rows[:] = 0
            rows[:, 3] = rows[:, 6] = np.fromiter(map(len, new), np.int64, len(new))
            for i, t in enumerate(new):
                core = t if t.isalpha() else t[:-1]
                if core is t or core.isalpha() and t[-1] in ENDS:  # letters, and one sign at most behind them
                    if core is not t:
                        rows[i, 3] -= 1
                    word = core
                    if not core.islower():
                        word, rows[i, 4] = core.lower(), sum(map(str.isupper, core))
                else:
                    word = bare(t)
                    rows[i, :6] = bool(RUN.search(t)), not any(map(str.isalnum, t)), t.endswith("!!"), sum(map(str.isalpha, t)), sum(map(str.isupper, t)), sum(map(str.isdigit, t))
                if word in INSULTS:
                    rows[i, 7] = 1
                if word in self.words:
                    rows[i, 8] = 1
                if word[:BEGINNING] in self.beginnings:
                    rows[i, 9] = 1
            self.used += len(new)
        return new

    def numbered(self, texts: pa.Array) -> Iterator[tuple[list[np.ndarray], list[str]]]:
        """The token numbers of each text and the tokens that are new, in blocks of texts of some BLOCK tokens. A full store is emptied between blocks."""
        block, size = [], 0
        for k, text in enumerate(texts, 1):
            block.append(self.ids(text.as_py() or ""))
            size += len(block[-1])
            if size >= BLOCK or k == len(texts):
                yield block, self.grow()
                block, size = [], 0
                if self.full():
                    self.clear()

    def full(self) -> bool:
        return len(self.number) > CACHED

    def clear(self) -> None:
        self.number, self.used = Words(), 0


def shares(ids: np.ndarray, props: np.ndarray, distinct: int | None = None) -> np.ndarray:
    """Symbol, separator, capital, exclamation, repeat shares, 1 - variety, digit share, 1 - letter share; abuse counts. distinct: how many of ids differ, if known."""
    n = len(ids)
    s = props[ids].sum(axis=0)
    repeats = float((ids[1:] == ids[:-1]).sum()) / n
    variety = (distinct or len(np.unique(ids))) / min(n, 50)
    return np.array([s[0] / n, s[1] / n, s[4] / max(1.0, s[3]), s[2] / n, repeats, 1 - min(1.0, variety), s[5] / max(1.0, s[6]), 1 - s[3] / max(1.0, s[6]), s[7], s[8], s[9]])


#: Share from which a labeller votes bad, and up to which good; between them it does not vote.
CUTS = {"symbols": (0.25, 0.05), "separators": (0.2, 0.05), "capitals": (0.5, 0.3), "exclamations": (0.2, 0.05), "repeats": (0.2, 0.08), "variety": (0.7, 0.4), "digits": (0.5, 0.2), "letters": (0.6, 0.35)}


def votes(x: np.ndarray, n: int) -> str:
    """One digit a labeller. A text of under 5 tokens gets no vote on repeats and variety."""
    out = []
    for i, name in enumerate(JUNK):
        bad, good = CUTS[name]
        out.append(NONE if n < 5 and name in ("repeats", "variety") else BAD if x[i] >= bad else GOOD if x[i] <= good else NONE)
    for i in range(len(JUNK), len(JUNK) + len(ABUSE)):
        out.append(BAD if x[i] >= max(2, 0.004 * n) else GOOD if x[i] == 0 else NONE)
    return "".join(map(str, out))


def _voted(lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Tokens(*lists.value)
        for batch in batches:
            patterns = []
            for block, _ in store.numbered(batch.column(2)):
                patterns += [votes(shares(ids, store.table), len(ids)) if len(ids) else None for ids in block]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(patterns, pa.string())], ["rid", "id", "h", "pattern"])

    return run


class LabelModel:
    """P(bad) and P(vote is bad | class, there is a vote) of the labellers of a family."""

    def __init__(self, prior: float, rates: np.ndarray):
        self.prior, self.rates = prior, rates  # rates: labeller, class

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(np.array([[1 - self.prior, self.prior]])) + np.zeros((len(patterns), 1))
        for j in range(patterns.shape[1]):
            logs += np.where(patterns[:, j, None] == BAD, np.log(self.rates[j]), np.where(patterns[:, j, None] == GOOD, np.log(1 - self.rates[j]), 0.0))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray | None = None, rounds: int = 100) -> LabelModel:
    """Accuracies of a family's labellers from counted vote patterns. gold: counts of labelled good and bad texts of each
    pattern. Starts from: bad where any labeller votes bad."""
    p, total = np.where((patterns == BAD).any(axis=1), 0.9, 0.02), counts.sum()
    anchors = np.zeros((2, len(patterns))) if gold is None or not gold.sum() else gold.T * (ANCHORS * total / gold.sum())
    model = LabelModel(0.1, np.full((patterns.shape[1], 2), 0.5))
    for _ in range(rounds):
        weight = np.stack(((1 - p) * counts, p * counts)) + anchors
        rates = np.empty((patterns.shape[1], 2))
        for j in range(patterns.shape[1]):
            bad, good = (weight[:, patterns[:, j] == v].sum(axis=1) for v in (BAD, GOOD))
            trust = PRIOR * weight.sum(axis=1) + 1e-9
            rates[j] = (bad + trust * (FALSE_ALARMS, HITS)) / (bad + good + trust)
        model = LabelModel(float(np.clip((p * counts).sum() / max(1.0, total), 1e-4, 0.9)), np.clip(rates, 1e-6, 1 - 1e-6))
        p = model.posterior(patterns)
    return model


def families(patterns: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Labellers in groups that call texts bad together, LIFT times as often as by chance and beyond its scatter."""
    fires = (patterns == BAD).astype(float)
    both = (fires * counts[:, None]).T @ fires
    chance = np.outer(np.diag(both), np.diag(both)) / max(1, counts.sum())
    near, own = (both > LIFT * chance) & (both - chance > 5 * np.sqrt(chance) + 5), np.arange(len(both))
    for _ in own:
        own = np.array([min(own[near[i] | (own == own[i])], default=own[i]) for i in range(len(own))])
    return [np.flatnonzero(own == k) for k in np.unique(own)]


def label_posteriors(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
    """P(bad) of each pattern: of one kind at least, a kind for each family of labellers."""
    good = np.ones(len(patterns))
    for members in families(patterns, counts) if len(patterns) else []:
        own, at = np.unique(patterns[:, members], axis=0, return_inverse=True)
        summed = lambda x: np.bincount(at.ravel(), weights=x, minlength=len(own))  # noqa: B023, E731
        known = None
        if gold is not None:
            known = np.stack((summed(gold[:, 0]), summed(gold[:, 1]) * (own == BAD).any(axis=1)), axis=1)  # other bad texts are of other kinds
        good *= 1 - expectation_maximisation(own, summed(counts), known).posterior(own)[at.ravel()]
    return 1 - good


def _slot(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % SLOTS


def shape_of(token: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_a-zA-Z]+", "a", token))))[:12]


@lru_cache(1 << 16)
def _part_slot(text: str) -> int:
    return _slot(text)


def token_slots(token: str) -> tuple[int, int, int]:
    """Slots of a token's word, its beginning and its shape."""
    end = "" if token.isalpha() else token[-1:]
    core = token[: len(token) - len(end)]
    if core.isalpha() and core.islower() and (not end or end in ENDS):
        word, shape = core.lower(), "a" + end
    elif core.isalpha() and "A" <= core[0] <= "Z" and core[1:].islower() and (not end or end in ENDS):
        word, shape = core.lower(), "Aa" + end
    else:
        word, shape = bare(token), shape_of(token)
    return _slot("w:" + word), _part_slot("b:" + word[:BEGINNING]), _part_slot("s:" + shape)


_PLAIN = {end: _slot("s:a" + end) for end in ("", *ENDS)}
_WORD = zlib.crc32(b"w:")


def slots_of(tokens: list[str]) -> np.ndarray:
    """token_slots of many tokens, a row each."""
    words, parts, shapes = [], [], []
    for t in tokens:
        core, end = (t, "") if t.isalpha() else (t[:-1], t[-1])
        if core.islower() and core.isalpha() and end in _PLAIN:
            words.append(zlib.crc32(core.encode("utf-8", "replace"), _WORD))
            parts.append(_part_slot("b:" + core[:BEGINNING]))
            shapes.append(_PLAIN[end])
        else:
            word, part, shape = token_slots(t)
            words.append(word)
            parts.append(part)
            shapes.append(shape)
    return np.array((words, parts, shapes), np.int64).T % SLOTS


@lru_cache(1 << 10)
def _share_slot(i: int, tenths: int) -> int:
    return _slot(f"d:{i}:{tenths}")


def text_slots(x: np.ndarray) -> list[int]:
    """Slots of the shares of a whole text, in tenths."""
    return [_share_slot(i, int(10 * min(1.0, v))) for i, v in enumerate(x[: len(JUNK)].tolist())]


def _features(lists):
    """(k, y, slots) of texts; none of blank or too long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, slots = Tokens(*lists.value), {}
        for batch in batches:
            out = []
            for text in batch.column(2):
                if store.full():
                    store.clear()
                    slots = {}
                tokens = (text.as_py() or "").split()
                distinct = list(dict.fromkeys(tokens))
                if not tokens or len(distinct) > SAMPLE_TOKENS:
                    out.append(None)
                    continue
                ids = store.ids(text.as_py())
                slots.update((t, token_slots(t)) for t in store.grow())
                out.append([*text_slots(shares(ids, store.table)), *[s for t in distinct for s in slots[t]]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["k", "y", "slots"])

    return run


class LinearScorer:
    """Weights of hashed features: a text's shares count fully, its distinct tokens by the root of their number."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def gradient(slots: np.ndarray, sizes: np.ndarray, y: np.ndarray, scorer: LinearScorer) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the logistic loss over texts with sizes[i] slots each, the shares first: of the good ones and of the bad
    ones, each with the bias's at its end."""
    whole, owner = len(JUNK), np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = np.where(np.arange(len(slots)) - first < whole, 1.0, 1 / np.sqrt(np.maximum(LEAST_TOKENS, (sizes - whole) / 3))[owner])
    z = np.bincount(owner, weights=scorer.weights[slots] * value, minlength=len(sizes)) + scorer.bias
    e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
    return tuple(np.append(np.bincount(slots, weights=e[owner] * value * (y == c)[owner], minlength=SLOTS), e[y == c].sum()) for c in (0, 1))


def _steps(shared, rate: float, ridge: float):
    """A row for each model that has both classes in this partition: its weights and Adagrad's sums of squares after LOCAL steps on the partition's texts, the classes of
    one weight. The partition's share of the bounded sample is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = shared.value
        held: dict[int, list] = {}
        for batch in batches:
            k, y, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat, sizes = slots.flatten().to_numpy(), np.diff(slots.offsets.to_numpy())
            flat_k = np.repeat(k, sizes)
            for model in np.unique(k).tolist():
                if model in states:
                    held.setdefault(model, []).append((flat[flat_k == model], sizes[k == model], y[k == model]))
        rows = []
        for model, parts in held.items():
            flat, sizes, y = (np.concatenate(x) for x in zip(*parts, strict=True))
            share = [int((y == c).sum()) for c in (0, 1)]
            if not all(share):
                continue
            weights, squares = (x.astype(np.float64) for x in states[model])
            for _ in range(LOCAL):
                found = gradient(flat, sizes, y, LinearScorer(weights[:-1], float(weights[-1])))
                total = sum(0.5 / n * g for n, g in zip(share, found, strict=True)) + np.append(ridge * weights[:-1], 0.0)
                squares += total**2
                weights -= rate * total / np.sqrt(squares)
            rows.append((model, np.concatenate((weights, squares)).astype(np.float32).tobytes()))
        columns = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["k", "state"])

    return run


def train_linear(features: DataFrame, models: int, steps: int = STEPS, rate: float = 1.0, ridge: float = 1e-4) -> list[LinearScorer]:
    """Logistic regressions by Adagrad on the rows (k, y, slots) of a bounded sample, both classes of one weight. Each of PARTS partitions takes LOCAL of the steps on its own texts,
    then the partitions' weights and sums of squares are averaged, and so on: against one gradient over all texts a step, the weights differ by what partitions differ among themselves. 2 * SLOTS numbers a
    partition and model come to the driver. A sample with fewer than LEAST_A_PART texts of a class for each partition is one partition. A model with one class only, or none, has no weights."""
    spark = features.sparkSession
    sizes = {(r["k"], r["y"]): r["n"] for r in features.groupBy("k", "y").agg(F.count("*").alias("n")).collect()}
    both = [k for k in range(models) if (k, 0) in sizes and (k, 1) in sizes]
    scorers = [LinearScorer(np.zeros(SLOTS, np.float32), 0.0 if k in both else 3.0 if (k, 1) in sizes else -3.0) for k in range(models)]
    states = {k: (np.zeros(SLOTS + 1, np.float32), np.full(SLOTS + 1, 1e-8, np.float32)) for k in both}
    few = both and min(sizes[k, y] for k in both for y in (0, 1)) < PARTS * LEAST_A_PART
    features = features.coalesce(1 if few else PARTS)  # however the sample was dealt before
    for _ in range(-(-steps // LOCAL) if both else 0):
        shared = spark.sparkContext.broadcast(states)
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for r in features.mapInArrow(trimmed(_steps(shared, rate, ridge)), "k int, state binary").collect():
            k = r["k"]
            sums[k] = sums.get(k, 0) + np.frombuffer(r["state"], np.float32).astype(np.float64)
            counts[k] = counts.get(k, 0) + 1
        shared.destroy()
        for k, total in sums.items():
            mean = (total / counts[k]).astype(np.float32)
            states[k] = (mean[: SLOTS + 1], mean[SLOTS + 1 :])
    for k in both:
        weights = states[k][0]
        scorers[k] = LinearScorer(weights[:-1].astype(np.float32), float(weights[-1]))
    return scorers


def _scored(lists, scorers):
    """rid, id, and the probability of each scorer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, models = Tokens(*lists.value), scorers.value
        sums = np.zeros((len(store.table), len(models)), np.float32)  # beside the store's table
        for batch in batches:
            out = [[] for _ in models]
            for block, new in store.numbered(batch.column(2)):
                if len(sums) < len(store.table):
                    sums = np.concatenate((sums, np.zeros((len(store.table) - len(sums), len(models)), np.float32)))
                if new:
                    slots = slots_of(new)
                    sums[store.used - len(new) : store.used] = np.stack([m.weights[slots].sum(axis=1) for m in models], axis=1)
                for ids in block:
                    if not len(ids):
                        for column in out:
                            column.append(None)
                        continue
                    distinct = np.unique(ids)
                    own = text_slots(shares(ids, store.table, len(distinct)))
                    of_tokens = sums[distinct].sum(axis=0) / np.sqrt(max(LEAST_TOKENS, len(distinct)))
                    for column, m, z in zip(out, models, of_tokens.tolist(), strict=True):
                        z += m.bias + float(m.weights[own].sum())
                        column.append(1 / (1 + exp(-min(max(z, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, pa.float64()) for v in out]], ["rid", "id", "junk", "abuse"])

    return run


def _some_labelled(labels: DataFrame, parts: tuple[int, ...]) -> DataFrame:
    """LABELLED labels at most, by hash order, of the ids whose crc32 leaves one of parts by 5: id, quality, toxic."""
    kinds = [F.col(c).cast("int").alias(c) if c in labels.columns else F.lit(None).cast("int").alias(c) for c in ("quality", "toxic")]
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return labels.filter("doc_id is not null").filter(part.isin(*parts)).select(F.col("doc_id").alias("id"), *kinds).groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(LABELLED)


def learn_abuse_lists(docs: DataFrame, labelled: DataFrame, *, least: int = 4, odds: float = 20.0) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings that labelled abusive texts hold and others do not: in `least` such texts at
    least, and `odds` times as frequent."""
    rows = docs.join(F.broadcast(labelled.filter("toxic is not null").select("id", "toxic")), "id").filter("text is not null")  # LABELLED rows of two numbers; the texts stay in their partitions
    tokens = rows.select("id", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).filter("length(w) >= 3")
    tokens = tokens.select("id", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("w").alias("w")), F.struct(F.lit(1).alias("k"), F.substring("w", 1, BEGINNING).alias("w")))).alias("x")).select("id", "toxic", "x.*").distinct()
    sizes = rows.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    if not sizes["p"] or not sizes["n"]:
        return frozenset(), frozenset()
    counts = tokens.groupBy("k", "w").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"))
    chosen = counts.filter((F.col("p") >= least) & (F.col("p") / sizes["p"] >= odds * (F.col("n") + 0.5) / sizes["n"])).orderBy(F.desc("p"), "w").limit(LABELLED).collect()
    return frozenset(r["w"] for r in chosen if r["k"] == 0), frozenset(r["w"] for r in chosen if r["k"] == 1)


@in_small_batches
def classify_quality(df: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The quality of every text: rid, id, junk, abuse (probabilities), quality (1 - the higher of the two) and keep.

    Null and blank texts: probabilities null, quality 0, not kept. Repeated rows are scored each. labels (doc_id, quality, toxic) may be
    missing, empty or lack a column: the fixed word list and the labellers' agreement are left then. Of the labels, those
    whose doc_id's crc32 leaves 1 or 2 by 5 teach the abuse lists, 3 or 4 stand at their class, and 0 are held out. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    text = named(df, text_col)
    docs = df.select(F.monotonically_increasing_id().alias("rid"), named(df, id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    kind = docs.schema["id"].dataType.simpleString()
    learned, anchors = (frozenset(), frozenset()), None
    if labels is not None:
        learned = learn_abuse_lists(docs.select("id", "text"), _some_labelled(labels, (1, 2)))
        anchors = _some_labelled(labels, (3, 4))
    lists = spark.sparkContext.broadcast(learned)
    voted = stored(docs.mapInArrow(trimmed(_voted(lists)), f"rid long, id {kind}, h long, pattern string"), "votes")
    counted = voted.filter("pattern is not null")
    if anchors is None:
        counted = counted.withColumns({c: F.lit(None).cast("int") for c in ("quality", "toxic")})
    else:
        counted = counted.join(F.broadcast(anchors), "id", "left")  # LABELLED rows of three numbers
    tell = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c}{v}")
    counted = counted.groupBy("pattern").agg(F.count("*").alias("n"), tell("quality", 1), tell("quality", 0), tell("toxic", 0), tell("toxic", 1)).orderBy("pattern").collect()
    patterns = np.array([[int(c) for c in r["pattern"]] for r in counted], np.int64).reshape(len(counted), len(JUNK) + len(ABUSE))
    counts, gold = np.array([r["n"] for r in counted], float), np.array([r[2:] for r in counted], float).reshape(len(counted), 4)
    posteriors = [label_posteriors(patterns[:, : len(JUNK)], counts, gold[:, :2]), label_posteriors(patterns[:, len(JUNK) :], counts, gold[:, 2:])]
    scorers = _train_scorers(docs, voted, lists, [r["pattern"] for r in counted], posteriors)
    shared = spark.sparkContext.broadcast(scorers)
    out = docs.select("rid", "id", "text").mapInArrow(trimmed(_scored(lists, shared)), f"rid long, id {kind}, junk double, abuse double")
    quality = F.coalesce(1 - F.greatest("junk", "abuse"), F.lit(0.0))
    return out.select("rid", "id", "junk", "abuse", quality.alias("quality"), (quality >= 0.5).alias("keep"))


def _train_scorers(docs: DataFrame, voted: DataFrame, lists, patterns: list[str], posteriors: list[np.ndarray]) -> list[LinearScorer]:
    """For each model a scorer from SAMPLE texts with a posterior in CLEAR_BAD and as many in CLEAR_GOOD, the first by
    the hash of their texts and ids. Only the texts drawn are read for their features; rows with one id and text count once."""
    spark = docs.sparkSession
    drawn = None
    for k, p in enumerate(posteriors):
        for y, (low, high) in enumerate((CLEAR_GOOD, CLEAR_BAD)):
            chosen = [(x,) for x, v in zip(patterns, p, strict=True) if low <= v <= high]
            if not chosen:
                continue
            of_class = voted.join(F.broadcast(spark.createDataFrame(chosen, "pattern string")), "pattern", "left_semi")  # 3^labellers rows at most
            some = of_class.orderBy(F.xxhash64(F.lit(3), "h", "id"), "rid").limit(SAMPLE).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.lit(k).alias("k"), F.lit(y).alias("y")).distinct()
            drawn = some if drawn is None else drawn.unionByName(some)
    if drawn is None:
        return [LinearScorer(np.zeros(SLOTS, np.float32), -1.0) for _ in posteriors]
    drawn = stored(drawn, "drawn")  # 4 * SAMPLE rows at most
    texts = docs.join(F.broadcast(drawn), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h"))).select("k", "y", "_h", "_id", "text").dropDuplicates(["k", "y", "_h", "_id"])
    features = texts.select("k", "y", "text").mapInArrow(trimmed(_features(lists)), "k int, y int, slots array<int>").filter("slots is not null")
    return train_linear(stored(features, "features"), len(posteriors))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk and abuse probabilities of all documents; labels of the held out ones taught nothing."""
    out = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 0).alias("held_out"), "junk", "abuse", "quality", "keep")
