"""Toxicity by weak supervision.

Voters look for words, word beginnings and patterns in a text: fixed lexicons of four languages, and entries
mined from the labelled training rows, where their use differs from chance. A generative label model over the
votes estimates by expectation maximisation how often each voter fires in toxic and in clean texts (its
accuracy), and from what is left of the votes how voters are correlated given the label; correlated voters
share their say. Its posteriors are the soft labels on which a linear classifier over the voters' findings is
trained. Scoring is one pass over all texts with that classifier.

Labels are only ever read of rows outside the held-out fifth (crc32 of the id as text, modulo 5). The model is
fitted on a sample of at most ``TRAIN_ROWS`` of them, by hash order, with one text of each group of copies.

Defined results: a null or empty text scores what the classifier gives without any finding, a text of any length is read
whole; repeated rows score alike, and a score of exactly 0.5 is predicted toxic; a document labelled both ways counts as
toxic; a null id counts as held out; without toxic or without clean training rows the fixed lexicons decide; an empty table gives an
empty table; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TRAIN_ROWS = 16_000
#: Entries that mining may add to the voters.
MINED = 400
FOLDS = 5
PREFIXES = (4, 5, 6)
MIN_SUPPORT = 4
ROUNDS = 25
GOLD_ACCURACY = 0.98
RIDGE = 0.5

# Insults of four languages, by public lexicons of abusive words.
LEXICONS = {
    "de": "abschaum arschloch dummkopf depp idiot idioten miststück schwachkopf trottel versager vollidiot",
    "en": "bastard bitch clown disgusting dumb fool idiot idiots imbecile loser losers moron morons pathetic scum stupid trash vermin worthless",
    "es": "basura cabrón estúpido estúpida gilipollas idiota imbécil inútil mierda patético payaso",
    "fr": "abruti bouffon connard connasse crétin débile idiot imbécile minable ordure pathétique salaud stupide",
}
# Patterns of personal attack.
PATTERNS = {
    "shut up": r"\bshut\s+up\b",
    "go away": r"\b(?:get\s+lost|go\s+to\s+hell|drop\s+dead)\b",
    "you are": r"\byou(?:\s+are|'re)\s+(?:an?\s+|such\s+an?\s+)?(?:idiot|moron|loser|clown|fool|trash|scum|stupid|pathetic|worthless|disgusting)",
    "hate you": r"\bi\s+hate\s+you\b",
}
COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def findings(text: str | None) -> set[str]:
    """Words of a text, and beginnings of its longer words, marked by a hyphen."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    found = set(words)
    for n in PREFIXES:
        found.update([w[:n] + "-" for w in words if len(w) > n])
    return found


class Voters:
    """What fires on a text: each lexicon, each pattern, each mined entry."""

    def __init__(self, mined: list[str]):
        self.names = [f"lexicon {k}" for k in LEXICONS] + [f"pattern {k}" for k in PATTERNS] + mined
        place: dict[str, list[int]] = {}
        for i, words in enumerate(LEXICONS.values()):
            for w in words.split():
                place.setdefault(w, []).append(i)
        for i, entry in enumerate(mined, len(LEXICONS) + len(PATTERNS)):
            place.setdefault(entry, []).append(i)
        self.place = place
        self.words = frozenset(k for k in place if not k.endswith("-"))
        self.beginnings = {n: frozenset(k for k in place if len(k) == n + 1 and k.endswith("-")) for n in PREFIXES}

    def fire(self, text: str | None) -> list[int]:
        if not text:
            return []
        low = text.lower()
        words = set(LETTERS.findall(low))
        hits = words & self.words
        for n, known in self.beginnings.items():
            if known:
                hits |= {w[:n] + "-" for w in words if len(w) > n} & known
        fired = {i for h in hits for i in self.place[h]}
        fired.update(i for i, p in enumerate(COMPILED.values(), len(LEXICONS)) if p.search(low))
        return sorted(fired)


# --- The model, on the driver: at most TRAIN_ROWS rows by MINED + some voters -----------------------


def label_model(fired: np.ndarray, gold: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the rows, and how often each voter fires by label (2 x voters), and its share of say.

    ``gold`` is the training label, itself only a voter of accuracy GOLD_ACCURACY.
    """
    n, voters = fired.shape
    posterior = np.where(gold == 1, GOLD_ACCURACY, 1 - GOLD_ACCURACY)
    say = np.ones(voters)
    trust = math.log(GOLD_ACCURACY / (1 - GOLD_ACCURACY))
    for step in range(rounds):
        weight = np.stack([1 - posterior, posterior])
        rate = (weight @ fired + 0.5 * fired.mean(axis=0) + 1e-3) / (weight.sum(axis=1, keepdims=True) + 0.5 + 2e-3)
        if step in (0, rounds // 2):
            say = shares_of_say(fired, posterior, rate)
        prior = math.log(max(posterior.mean(), 1e-6) / max(1 - posterior.mean(), 1e-6))
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        odds = prior + fired @ (say * (on - off)) + (say * off).sum() + np.where(gold == 1, trust, -trust)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - posterior).max() < 1e-4 and step > rounds // 2:
            break
        posterior = new
    return posterior, rate, say


def shares_of_say(fired: np.ndarray, posterior: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """One over the number of voters that, given the label, a voter amounts to: from the squared correlations of
    what is left of the votes once the label's part is taken off."""
    left = fired - (np.outer(1 - posterior, rate[0]) + np.outer(posterior, rate[1]))
    scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
    correlation = (left.T @ left) / np.outer(scale, scale)
    return 1 / np.maximum((correlation**2).sum(axis=1), 1)


def linear_classifier(fired: np.ndarray, posterior: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method, with a ridge on all but the intercept."""
    x = np.concatenate([fired, np.ones((len(fired), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - posterior) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


# --- Fitting and scoring on tables ------------------------------------------------------------------


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled rows outside the held-out fold, the first by hash."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(rows)
    # At most ``rows`` ids and labels.
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def one_of_copies(rows: DataFrame) -> DataFrame:
    """One row for each group of texts that share the least hash of their runs of four words."""

    def key(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            keys = []
            for text in batch.column(0):
                words = text.as_py().encode().split()
                runs = zip(words, words[1:], words[2:], words[3:], strict=False) if len(words) > 3 else [words]
                keys.append(min(map(xxh64_intdigest, map(b" ".join, runs))) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["text", "toxic", "key"])

    keyed = rows.mapInArrow(key, "text string, toxic int, key long")
    return keyed.groupBy("key").agg(F.min(F.struct(F.length("text").alias("n"), "text", "toxic")).alias("r")).select("r.text", "r.toxic")


def mined_entries(rows: DataFrame, limit: int = MINED) -> list[str]:
    """Entries whose use differs most by label: by the log-likelihood ratio, where it exceeds what the number of
    entries tried would yield by chance."""

    def tally(batches):
        import pyarrow as pa

        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                (toxic if label.as_py() == 1 else clean).update(findings(text.as_py()))
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[k] for k in names], pa.int64()), pa.array([clean[k] for k in names], pa.int64())],
            ["entry", "t", "c"],
        )

    totals = rows.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).first()
    t_all, c_all = totals.t or 0, (totals.n or 0) - (totals.t or 0)
    if not t_all or not c_all:
        return []
    counts = rows.mapInArrow(tally, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t").cast("double"), F.col("c").cast("double")

    def part(seen, rate):
        return F.when(seen > 0, seen * F.log(seen / ((t + c) * rate))).otherwise(F.lit(0.0))

    gain = part(t, t_all / (t_all + c_all)) + part(c, c_all / (t_all + c_all))
    # For rare entries the gain is the log of the chance that all their rows have one label by accident.
    more_toxic = t * c_all > c * t_all
    best = counts.where((t >= MIN_SUPPORT) & more_toxic & (gain >= math.log(20_000))).withColumn("gain", gain)
    return [r.entry for r in best.orderBy(F.desc("gain"), "entry").limit(limit).collect()]


class Scorer:
    """Voters with the trained weights."""

    def __init__(self, voters: Voters, weights: list[float], bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[i] for i in self.voters.fire(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer:
    sample = stored(one_of_copies(training_rows(documents, labels, rows)), "toxicity-sample")
    mined = mined_entries(sample)
    voters = Voters(mined)

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            fired = [voters.fire(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), batch.column(1)], ["fired", "toxic"])

    # At most ``rows`` short lists.
    votes = sample.mapInArrow(vote, "fired array<int>, toxic int").collect()
    gold = np.array([r.toxic for r in votes], dtype=np.int64)
    if not len(votes) or gold.min() == gold.max():
        lexical = len(LEXICONS) + len(PATTERNS)
        return Scorer(voters, [3.0] * lexical + [0.0] * len(mined), -2.0)
    fired = np.zeros((len(votes), len(voters.names)))
    for row, r in zip(fired, votes, strict=True):
        row[r.fired] = 1
    posterior, _, _ = label_model(fired, gold)
    weights, bias = linear_classifier(fired, posterior)
    return Scorer(voters, weights.tolist(), bias)


def scored(documents: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """All columns of the documents, and the score by ``name``, which must be free."""
    from pyspark.sql.types import DoubleType, StructType

    fields = documents.schema.fields
    names = [f.name for f in fields]
    at = names.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, name])

    return documents.mapInArrow(run, StructType(list(fields)).add(name, DoubleType()))


def predictions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(documents.select("doc_id", "text"), fit(documents, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    name = "score"
    while name in documents.columns:
        name += "_"
    return scored(documents, fit(documents, labels), name).where(F.col(name) < 0.5).drop(name)
