"""Toxicity by a weighted finite-state pattern grammar.

Insults are stems learned from labelled documents with their log-odds as weights; threats, targets, negations and
reporting words are fixed closed classes. A text is scanned once by an automaton over all of them; only clauses
that hold an insult or a threat are read further. Such a clause runs through a composition of small transducers:

* targets: does the clause name somebody it is aimed at;
* negation: a negator covers the next few words;
* reported speech: a reporting word or an open quotation covers the rest of the clause;
* scoring: each insult or threat emits its weight for the pattern (kind, targeted, negated, reported).

A document's score is a logistic function of what its matched clauses emitted, by pattern, fitted on labelled
documents. Fitting reads at most ``MAX_LABELLED`` rows (smallest hash of their id); scoring is one scan of whole
texts without a shuffle. Labels, language, source and id are never part of a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 12_000
MAX_STEMS = 400
MIN_LOG_ODDS = 2.5
STEM_LENGTHS = (4, 5, 6)
THRESHOLD = 0.3

# Closed word classes of the grammar, chosen here: whole lower-cased words.
THREATS = ("kill", "hurt", "beat", "destroy", "burn", "strangle", "stab", "shoot", "smash", "hunt", "crush",
           "töte", "töten", "schlage", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "yours", "yourself", "they", "them", "their", "he", "him", "his", "she", "her",
           "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te", "vous", "votre", "vos", "tú", "ti",
           "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "no", "never", "nobody", "nothing", "neither", "nor", "don't", "doesn't", "isn't", "aren't",
             "wasn't", "won't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás")
REPORTING = ("said", "says", "say", "wrote", "called", "calls", "reported", "claimed", "quoted", "according",
             "sagte", "schrieb", "dit", "écrit", "selon", "dijo", "escribió", "según")

INSULT, THREAT, TARGET, NEGATION, REPORT = range(5)
NEGATION_REACH = 3
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»„]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
PATTERNS = 16  # kind x targeted x negated x reported


@dataclass
class Lexicon:
    """Insult stems: text -> (weight, whole word only)."""

    stems: dict[str, tuple[float, bool]] = field(default_factory=dict)

    def insult(self, word: str) -> float:
        """Weight of the longest stem that accepts ``word``, else 0."""
        hit = self.stems.get(word)
        if hit:
            return hit[0]
        for n in sorted(STEM_LENGTHS, reverse=True):
            hit = self.stems.get(word[:n]) if len(word) >= n else None
            if hit and not hit[1]:
                return hit[0]
        return 0.0


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # intercept, then PATTERNS, then the share of matched words
    rate: float


class Grammar:
    """The composed transducers over one clause, and the automaton that finds clauses worth reading."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick
        self.lexicon = lexicon
        self.classes = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS),
                                              (REPORT, REPORTING)) for w in words}
        self.scan = ahocorasick.Automaton()
        for s in [*lexicon.stems, *THREATS]:
            self.scan.add_word(s, len(s))
        self.scan.make_automaton()

    def clauses(self, text: str) -> Iterator[str]:
        """Clauses of a lower-cased text that may hold an insult or a threat, each once."""
        done = 0
        for end, n in self.scan.iter(text):
            at = end - n + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue
            start = max(done, max(text.rfind(c, done, at) for c in ".!?;\n") + 1)
            m = _CLAUSE_END.search(text, end)
            done = m.end() if m else len(text)
            yield text[start:done]

    def read(self, clause: str) -> Iterator[tuple[int, float]]:
        """(pattern, weight) of every insult and threat of a clause."""
        tokens = []
        for word in _TOKEN.findall(clause):
            w = self.lexicon.insult(word)
            tokens.append((INSULT, w) if w else (self.classes.get(word, -1) if word[0].isalpha() else REPORT, 1.0))
        targeted = any(c == TARGET for c, _ in tokens)
        negated, reported = 0, False
        for c, w in tokens:
            if c == NEGATION:
                negated = NEGATION_REACH + 1
            elif c == REPORT:
                reported = True
            elif c in (INSULT, THREAT) and (c == INSULT or targeted):
                yield 8 * (c == THREAT) + 4 * targeted + 2 * (negated > 0) + reported, w
            negated = max(0, negated - 1)

    def features(self, text: str) -> np.ndarray:
        """Weight emitted by pattern, damped, and the share of the text's words that matched."""
        low = text.lower()
        total, hits = np.zeros(PATTERNS), 0
        for clause in self.clauses(low):
            for pattern, w in self.read(clause):
                total[pattern] += w
                hits += 1
        words = sum(1 for _ in _WORD.finditer(low)) if hits else 1
        return np.append(np.log1p(total), 100.0 * hits / max(words, 1))


def _held_out(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most ``MAX_LABELLED`` labelled documents outside the held-out fold."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~_held_out(id_col))
              .groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("__id"), "__id").limit(MAX_LABELLED))
    return (docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text"))
            .join(F.broadcast(chosen), "__id").where("text IS NOT NULL"))  # at most MAX_LABELLED id-label pairs


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Stems and whole words that mark toxic documents, by smoothed log-odds of document counts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    lengths = F.array(*[F.lit(n) for n in STEM_LENGTHS])
    stems = F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(lengths, lambda n: F.length(w) >= n), lambda n: F.substring(w, F.lit(1), n))))
    whole = F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(w, F.lit("$")))
    counts = (labelled.select("toxic", F.explode(F.array_distinct(F.concat(stems, whole))).alias("stem"))
              .groupBy("stem").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b")))
    n = labelled.agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b")).first()
    if not n or not n.a or not n.b:
        return Lexicon()
    odds = F.log((F.col("a") + 0.5) / (n.a + 1)) - F.log((F.col("b") + 0.5) / (n.b + 1))
    top = (counts.where((F.col("a") >= max(3, n.a // 200)) & (odds >= MIN_LOG_ODDS)).withColumn("odds", odds)
           .orderBy(F.desc(F.col("odds") * F.col("a")), "stem").limit(MAX_STEMS).collect())
    out: dict[str, tuple[float, bool]] = {}
    for r in sorted(top, key=lambda r: (len(r.stem), r.stem)):  # a shorter stem makes equally good longer ones idle
        word, only = r.stem.rstrip("$"), r.stem.endswith("$")
        shorter = [out[word[:k]] for k in STEM_LENGTHS if k < len(word) + only and word[:k] in out and not out[word[:k]][1]]
        if not any(w >= r.odds - 0.5 for w, _ in shorter) and word not in out:
            out[word] = (float(r.odds), only)
    return Lexicon(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and weights by Newton steps; the ridge leaves the intercept free."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and logistic weights from labelled rows whose crc32(id) mod 4 is not 2.

    With one class only (or none) the lexicon is empty and every score is that class's smoothed rate.
    """
    labelled = _labelled(docs, labels, id_col, text_col)
    lexicon = learn_lexicon(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            x = [grammar.features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "x array<double>, y int").toArrow()  # MAX_LABELLED rows
    y = rows.column("y").to_numpy().astype(float)
    rate = (y.sum() + 0.5) / (len(y) + 10)  # without labels a text counts as clean
    if not lexicon.stems:
        return Model(lexicon, np.append(math.log(rate / (1 - rate)), np.zeros(PATTERNS + 1)), rate)
    x = np.array(rows.column("x").to_pylist(), dtype=float)
    return Model(lexicon, fit_logistic(x, y), rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts match nothing and get the score of that.

    Repeated rows are scored alike, an empty table gives no rows, other columns are not read.
    """
    lexicon, weights = model.lexicon, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            x = np.array([grammar.features(t.as_py() or "") for t in b.column(1)]).reshape(len(b), PATTERNS + 1)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, "doc_id long, score double"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
