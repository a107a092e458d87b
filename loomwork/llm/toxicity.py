"""Toxicity with a weighted finite-state pattern grammar.

A text's clauses are read as sequences of token classes. Five transducers, composed into one, rewrite
them: insult (stronger after an intensifier), threat (stronger after an intention), reported speech,
negation, and target; a second reading, from the clause's end, finds targets that stand after. So an insult or a
threat comes out plain, negated, reported or aimed at somebody, with the weight of its path. A
document's score is a logistic function of what its matched clauses gave, in which negated and reported
ones never raise it, so an isolated word counts by the clause it stands in. The insult lexicon (weighted word
beginnings and short whole words) and the weights are learned from labelled rows; the other classes are
fixed word lists. With no labelled row the prior weights stand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import small_batches, stored
from loomwork.llm.labelled import held_out, training_labels, with_labels

# Fixed word lists in English, German, French and Spanish.
# Threats are known by word beginnings, so that other forms of a verb count too.
THREATS = "kill murder shoot stab hurt destroy strangle töten umbringen erschießen erstechen tuer assassiner poignarder matar asesinar apuñalar".split()
TARGETS = "you your yours u he she they him her them dich dir du euch ihr sie toi vous te tu votre ustedes tú usted os vosotros".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't nicht nie kein keine niemals jamais aucun aucune nunca jamás ningún".split()
REPORTS = "said says wrote writes called calls quoted quote claimed reported sagte schrieb nannte zitierte écrit cité appelé dijo escribió llamó citó".split()
INTENSIFIERS = "so such really total totally complete completely utter utterly very absolute absolutely so'n echt total völlig absolut vraiment tellement complètement tan muy totalmente".split()
INTENTIONS = "will i'll we'll gonna going shall want wants werde werden wirst wird will'n vais allons va voy vamos quiero".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER, INTENTION = "other insult threat target negation report intensifier intention".split()
CLASSES = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER, INTENTION)
WHOLE = "\0"  # ends a lexicon entry that is a whole word
CLAUSE = re.compile(r"[^.!?;:\n]+")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
REACH = 3


@dataclass
class Transducer:
    """Weighted, with one arc at most for a state and a label: (state, label) -> (label, weight, state)."""

    arcs: dict[tuple, tuple[str, float, tuple]]
    start: tuple = (0,)

    def step(self, state: tuple, label: str) -> tuple[str, float, tuple]:
        return self.arcs.get((state, label), (label, 0.0, self.start))

    def compose(self, other: Transducer, labels: set[str]) -> Transducer:
        """What reads as self and then reads its output as other, with the sum of the weights."""
        arcs, start = {}, self.start + other.start
        todo, seen, cut = [start], {start}, len(self.start)
        while todo:
            state = todo.pop()
            for label in labels:
                mid, w1, left = self.step(state[:cut], label)
                out, w2, right = other.step(state[cut:], mid)
                arcs[state, label] = (out, w1 + w2, left + right)
                if left + right not in seen:
                    seen.add(left + right)
                    todo.append(left + right)
        return Transducer(arcs, start)

    def read(self, labels: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for label in labels:
            got, weight, state = self.step(state, label)
            out.append((got, weight))
        return out


def _after(trigger: str, heads: dict[str, str], reach: int | None, labels: set[str], weight: float) -> Transducer:
    """Rewrites each head label that follows the trigger within reach tokens (any number, if None)."""
    arcs: dict[tuple, tuple[str, float, tuple]] = {}
    last = 1 if reach is None else reach
    for n, label in product(range(last + 1), labels):
        then = n if reach is None else max(0, n - 1)
        arcs[(n,), label] = (heads[label], weight, (n,)) if n and label in heads else (label, 0.0, (last if label == trigger else then,))
    return Transducer(arcs)


def grammar() -> Transducer:
    """The composition: insult, threat, reported speech, negation, then target before insult or threat."""
    heads = (INSULT, THREAT)
    reported = {h: f"reported {h}" for h in heads}
    denied = {h: f"negated {h}" for h in heads} | {f"reported {h}": f"negated reported {h}" for h in heads}
    aimed = {h: f"aimed {h}" for h in heads}
    one = set(CLASSES)
    two = one | set(reported.values())
    three = two | set(denied.values())
    speech = _after(REPORT, reported, None, one, -1.0)
    negation = _after(NEGATION, denied, REACH, two, -1.0)
    target = _after(TARGET, aimed, 2 * REACH, three, 1.0)
    insult = _after(INTENSIFIER, {INSULT: INSULT}, 2, one, 1.0)
    threat = _after(INTENTION, {THREAT: THREAT}, REACH, one, 1.0)
    return insult.compose(threat, one).compose(speech, one).compose(negation, one).compose(target, one)


def backward() -> Transducer:
    """Reads the grammar's output from a clause's end: plain heads before a target are aimed at it too."""
    heads = (INSULT, THREAT)
    softened = {f"{how} {h}" for how in ("reported", "negated", "negated reported") for h in heads}
    return _after(TARGET, {h: f"aimed {h}" for h in heads}, REACH, set(CLASSES) | softened | {f"aimed {h}" for h in heads}, 1.0)


#: The features of a document: their names and prior weights in log-odds. Those of SOFTENED never get a weight above 0.
FEATURES = {"bias": -5.0, "strongest clause": 1.0, "evidence": 0.5, "rate": 0.5, "length": 0.0, "softened": -0.2, "aimed threat": 2.5, "other threat": 0.2, "softened threat": -0.2}
SOFTENED = [name.startswith("softened") for name in FEATURES]


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array(list(FEATURES.values())))


def tokens_with_stems(text: str) -> set[str]:
    """Distinct lower-cased tokens of a text."""
    return set(TOKEN.findall(text.lower()))


def _prefixes(tokens: set[str], least: int, most: int) -> set[str]:
    """The beginnings of least to most characters, and shorter tokens as whole words."""
    return {t[:n] for t in tokens for n in range(least, min(len(t), most) + 1)} | {t + WHOLE for t in tokens if len(t) < least}


class Reader:
    """Reads texts with a model's lexicon; made once in each task."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.grammar, self.backward = stems, grammar(), backward()
        self.search = ahocorasick.Automaton()
        for x in (*(s.rstrip(WHOLE) for s in stems), *THREATS):
            self.search.add_word(x, len(x))
        self.search.make_automaton()
        lists = ((INTENSIFIERS, INTENSIFIER), (INTENTIONS, INTENTION), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
        self.kinds = {word: kind for words, kind in lists for word in words}
        self.threats = tuple(THREATS)
        self.longest = max(map(len, stems), default=0)

    def insult(self, token: str) -> float:
        """The greatest weight of the stems that the token starts with, or of the whole word; 0 if none."""
        return max((self.stems.get(token[:n], 0.0) for n in range(1, min(len(token), self.longest) + 1)), default=0.0) or self.stems.get(token + WHOLE, 0.0)

    def label(self, token: str, power: float) -> str:
        return INSULT if power > 0 else self.kinds.get(token) or (THREAT if token.startswith(self.threats) else OTHER)

    def paths(self, labels: list[str]) -> list[tuple[str, float]]:
        """What each token of a clause comes out as, and the weight of its path through the grammar."""
        there = self.grammar.read(labels)
        back = self.backward.read([label for label, _ in reversed(there)])[::-1]
        return [(label, weight + more) for (_, weight), (label, more) in zip(there, back, strict=True)]

    def features(self, text: str) -> np.ndarray:
        """The values of FEATURES: the greatest value of an insult in its clause (above 2.5), the summed values, their rate; the
        greatest values of threats. An insult's value is its weight in the lexicon and that of its path, a threat's is 1 and that of its path."""
        low = text.lower()
        hits = [end - size + 1 for end, size in self.search.iter(low)]
        hits = [at for at in hits if not at or not low[at - 1].isalnum()]
        words = low.count(" ") + low.count("\n") + 1
        strongest = evidence = softened = aimed = threat = denied = 0.0
        read_to = 0
        for at in hits:
            if at < read_to:
                continue
            begin = max(low.rfind(c, read_to, at) for c in ".!?;:\n") + 1
            clause = CLAUSE.match(low, max(begin, read_to))
            read_to = clause.end()
            tokens = TOKEN.findall(clause[0])
            power = [self.insult(t) for t in tokens]
            labels = [self.label(t, p) for t, p in zip(tokens, power, strict=True)]
            for (label, weight), p in zip(self.paths(labels), power, strict=True):
                if label in (INSULT, f"aimed {INSULT}"):
                    strongest, evidence = max(strongest, p + weight), evidence + p + weight
                elif label.endswith(INSULT):
                    softened += p
                elif label == f"aimed {THREAT}":
                    aimed = max(aimed, 1 + weight)
                elif label == THREAT:
                    threat = max(threat, 1 + weight)
                elif label.endswith(THREAT):
                    denied = 1.0
        return np.array([1.0, max(0.0, strongest - 2.5), np.log1p(evidence), np.log1p(100 * evidence / (words + 30)), np.log(words + 30) - 6, np.log1p(softened), aimed, threat, denied])


def learn_stems(rows: DataFrame, least: int = 4, longest: int = 32, ratio: float = 4.0) -> dict[str, float]:
    """Word stems that mark label 1, with the log of how much more usual they are there.

    rows: text, label, bounded by the caller. Stems are word beginnings of least to longest characters (longer
    words are known by their first ones) that are in more label-1 texts than any longer beginning, and whole
    words that are shorter. They are at least `ratio` times as usual in label-1 texts as elsewhere, by more
    than chance allows for so many candidates (likelihood ratio). All candidates are counted and tested as a
    table; only those chosen come to the driver, bounded as the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found[int(label > 0)].update(_prefixes(tokens_with_stems(text or ""), least, longest))
            for label, counts in enumerate(found):
                n = [counts.values(), [0] * len(counts)]
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(n[1 - label]), pa.int64()), pa.array(list(n[label]), pa.int64())], names=["term", "t", "c"])

    totals = rows.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    n1, n0 = totals
    if not n1:
        return {}
    counted = stored(rows.mapInArrow(run, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t > 0"), "stems")
    candidates = counted.count()
    longer = counted.groupBy(F.expr("substring(term, 1, length(term) - 1)").alias("term")).agg(F.max("t").alias("longer"))
    t, c = F.col("t"), F.col("c")
    expected = (t + c) * n1 / (n0 + n1)
    gain = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0.0))
    odds = F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    tested = counted.join(longer, "term", "left").select("term", odds.alias("odds"), gain.alias("gain"), (F.coalesce("longer", F.lit(0)) < t).alias("whole"))
    chosen = tested.filter(F.col("whole") & (F.col("odds") >= float(np.log(ratio))) & (F.col("gain") >= float(2 * np.log(20 * max(candidates, 1)))))
    return {r["term"]: r["odds"] for r in chosen.select("term", "odds").collect()}


def fit_weights(features: np.ndarray, labels: np.ndarray, pull: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to the prior weights where rows say nothing; those of SOFTENED stay at 0 or below."""
    prior = np.array(list(FEATURES.values()))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (p - labels) + pull * (w - prior)
        hess = (features * (p * (1 - p))[:, None]).T @ features + pull * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -2, 2)
        w[SOFTENED] = np.minimum(w[SOFTENED], 0.0)
        if np.abs(move).max() < 1e-6:
            break
    return w


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, most_rows: int = 20_000) -> Model:
    """A model from at most most_rows labelled rows outside the held-out fold."""
    small_batches(spark)
    rows = stored(with_labels(docs, training_labels(labels, "toxic", modulus, remainder, most_rows)), "labelled")
    stems = learn_stems(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for batch in batches:
            x = [reader.features(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toPandas()  # a row for each sampled id: most_rows at most
    if not len(got):
        return Model(stems)
    return Model(stems, fit_weights(np.array(got["x"].tolist()), (got["label"].to_numpy() > 0).astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, 0 to 1; a null text is read as an empty one, which has the score of no match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.stems)
        for batch in batches:
            z = [float(reader.features(t.as_py() or "") @ model.weights) for t in batch.column("text")]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, model: Model, modulus: int = 3, remainder: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, repeated rows and null ids included.

    A null doc_id is not held out. Extra columns of docs are ignored; an empty table gives no rows."""
    rows = score(docs, model)
    return rows.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.stems)
        for batch in batches:
            z = np.array([float(reader.features(t.as_py() or "") @ model.weights) for t in batch.column("text")], dtype=float)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
