"""Toxicity by a weighted finite-state pattern grammar over clauses.

Two transducers are composed. The lexical one reads characters and writes insults and threats with weights: fixed seed
words, and word stems whose log-odds were learned from labels. The clause one reads the words of a clause that holds
such a hit and keeps three states, a target was named, a negation is open, speech is reported; it writes each hit under
the class of the state it was met in. A document's score is a logistic function of what its clauses add up to.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the grammar.
INSULTS = (
    "clown", "coward", "creep", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "idiotic", "imbecile", "jerk", "loser",
    "lowlife", "moron", "moronic", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "vile", "worthless",
)
THREATS = ("kill", "murder", "strangle", "stab", "shoot", "hurt", "destroy", "crush", "burn")
TARGETS = frozenset(
    "you your yourself he she him her they them their people tu te vous toi du dich dir ihr euch usted ustedes ti vosotros".split()
)
NEGATIONS = frozenset("not no never nobody nothing without isn't aren't wasn't don't ne pas jamais nicht kein keine nie nunca ni sin".split())
REPORTS = frozenset("said says say called calls wrote writes quoted quote claimed claims dit disait sagte sagt nannte dijo dice llamó".split())

#: Words that a negation reaches.
NEGATION_REACH = 4
CLASSES = ("asserted", "targeted", "threat", "negated", "reported")
#: Weights before any label was seen: bias, the classes, hits per 100 words.
PRIOR = np.array([-4.0, 2.0, 2.0, 2.0, 0.3, 0.5, 0.5])
SEED_WEIGHT = 3.0
THRESHOLD = 0.7

_BOUNDARY = re.compile(r"[.!?;:,|\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass
class Grammar:
    """The lexicon (stem or whole word to weight) and the weights of the classes."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def automaton(self):
        """Words and stems as one automaton; whole words end in ``$`` in the lexicon."""
        entries: dict[str, tuple[float, float, bool]] = {}
        for word in INSULTS:
            entries[word] = (max(SEED_WEIGHT, self.stems.get(word + "$", 0.0)), 0.0, True)
        for word in THREATS:
            entries[word] = (0.0, SEED_WEIGHT, True)
        for stem, weight in self.stems.items():
            whole = stem.endswith("$")
            text = stem.rstrip("$")
            if text not in entries or (not whole and entries[text][2]):
                old = entries.get(text, (0.0, 0.0, True))
                entries[text] = (max(weight, old[0]), old[1], whole)
        out = ahocorasick.Automaton()
        for text, (insult, threat, whole) in entries.items():
            out.add_word(text, (len(text), insult, threat, whole))
        out.make_automaton()
        return out


def hits(text: str, automaton) -> dict[int, tuple[float, float]]:
    """Start of a word to the weights of its best insult and threat reading."""
    found: dict[int, tuple[float, float]] = {}
    size = len(text)
    for end, (length, insult, threat, whole) in automaton.iter(text):
        start = end - length + 1
        if start and text[start - 1].isalpha() or whole and end + 1 < size and text[end + 1].isalpha():
            continue
        old = found.get(start, (0.0, 0.0))
        found[start] = (max(old[0], insult), max(old[1], threat))
    return found


def clause_sums(text: str, found: dict[int, tuple[float, float]]) -> np.ndarray:
    """The weights of all hits by class, each read in its clause."""
    sums = np.zeros(len(CLASSES))
    edges = [m.start() for m in _BOUNDARY.finditer(text)]
    clauses: dict[int, list[int]] = {}
    for start in found:
        clauses.setdefault(bisect.bisect_left(edges, start), []).append(start)
    for clause in clauses:
        low = edges[clause - 1] + 1 if clause else 0
        high = edges[clause] if clause < len(edges) else len(text)
        words = []
        for m in _WORD.finditer(text, low, high):
            head, _, tail = m.group().partition("'")
            after = m.start() + len(head) + 1
            # A hit behind an elided article is a word of its own.
            words += [(m.start(), head), (after, tail)] if tail and after in found else [(m.start(), m.group())]
        target = any(w in TARGETS for _, w in words)
        open_negation, reported = 0, False
        for start, word in words:
            hit = found.get(start)
            if hit is not None:
                insult, threat = hit
                if reported:
                    sums[4] += insult + threat
                elif open_negation:
                    sums[3] += insult + threat
                else:
                    sums[1 if target else 0] += insult
                    # A threat needs someone it is aimed at.
                    sums[2] += threat if target else 0.0
            open_negation = NEGATION_REACH if word in NEGATIONS else max(0, open_negation - 1)
            reported = reported or word in REPORTS
    return sums


def features(text: str | None, automaton) -> np.ndarray:
    """1, log-sums of the classes, and the log of hit weight per 100 words."""
    out = np.zeros(len(PRIOR))
    out[0] = 1.0
    if text:
        low = text.lower()
        found = hits(low, automaton)
        if found:
            sums = clause_sums(low, found)
            out[1:6] = np.log1p(sums)
            out[6] = math.log1p(100.0 * float(sums.sum()) / (low.count(" ") + low.count("\n") + 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Logistic regression pulled towards PRIOR, by Newton steps."""
    w = PRIOR.copy()
    if not len(y):
        return w
    for _ in range(30):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + pull * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- Spark -------------------------------------------------------------------------------------------------------------


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out. A null id reads as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def _featured(docs: DataFrame, keep: list[str], grammars: list[Grammar], pick: str | None) -> DataFrame:
    """``keep`` and the features of each text under the grammar that the column ``pick`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [g.automaton() for g in grammars]
        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
            which = columns[pick].to_pylist() if pick else [0] * batch.num_rows
            rows = [features(t, automata[k]) for t, k in zip(columns["text"].to_pylist(), which)]
            yield pa.RecordBatch.from_arrays([*[columns[k] for k in keep], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["features array<double>"]))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, most_stems: int = 2000, least_docs: int = 3) -> Grammar:
    """A grammar from labelled rows that are not held out; at most ``most_rows`` of them, the first by hash of the id.

    Stems are word beginnings of 4 to 8 letters and whole words; a stem's weight is its log-odds over documents. The
    class weights are fitted on features under the stems of the other half of the rows, so that no document is judged by
    a stem it taught. Without labelled rows the seeds and prior weights remain.
    """
    taught = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(fold_of(F.col("doc_id")) != 1)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    # Bounded by most_rows, so it may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").withColumn("half", (fold_of(F.col("doc_id")) / 2).cast("int"))
    sample = texts.persist()
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    beginnings = lambda w: F.concat(
        F.array(F.concat(w, F.lit("$"))),
        F.transform(F.filter(F.array(*[F.lit(n) for n in range(4, 9)]), lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n)),
    )
    stems = sample.select("half", "toxic", F.explode(F.array_distinct(F.flatten(F.transform(words, beginnings)))).alias("stem"))
    count = lambda half, toxic: F.count_if((F.col("half") == half) & (F.col("toxic") == toxic))
    cells = [(h, t) for h in (0, 1) for t in (1, 0)]
    totals = sample.agg(*[count(h, t) for h, t in cells]).first()
    rows = (
        stems.groupBy("stem").agg(*[count(h, t).alias(f"c{h}{t}") for h, t in cells])
        .where(f"c01 + c11 >= {least_docs} and 4 * (c01 + c11) > c00 + c10")
        .orderBy(F.desc(F.expr("c01 + c11 - c00 - c10")), "stem").limit(most_stems).collect()
    )

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        p_all, n_all = (sum(totals[2 * h + i] for h in halves) for i in (0, 1))
        out = {}
        for stem, *c in rows:
            p, n = (sum(c[2 * h + i] for h in halves) for i in (0, 1))
            odds = math.log((p + 0.5) / (p_all + 1)) - math.log((n + 0.5) / (n_all + 1))
            if p >= least_docs and odds >= 2.0:
                out[stem] = odds
        return out

    # Rows of half h are read under the stems of the other half.
    crossed = [Grammar(lexicon((1,))), Grammar(lexicon((0,)))]
    seen = _featured(sample, ["toxic"], crossed, "half").collect()
    sample.unpersist()
    x = np.array([r["features"] for r in seen]).reshape(-1, len(PRIOR))
    y = np.array([r["toxic"] for r in seen], dtype=float)
    return Grammar(lexicon((0, 1)), fit_weights(x, y))


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is scored. Null and empty texts get the score of a text without hits. Rows that repeat get equal
    rows; extra columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for batch in batches:
            doc_id, held_out, text = batch.columns
            scores = [float(_sigmoid(features(t, automaton) @ grammar.weights)) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([doc_id, held_out, pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    slim = docs.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")
    )


def clean_documents(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not judged toxic."""
    kinds = docs.schema
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for batch in batches:
            fine = [float(_sigmoid(features(t, automaton) @ grammar.weights)) < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, kinds)
