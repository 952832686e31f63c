"""Toxicity: a learned lexicon, met exactly or misspelled, weighed by whether its terms are quoted or meant.

The lexicon is learned from labelled documents: words of any length, and stems that many toxic words begin with; every term with
enough support is in it, so it is as large as the labelled documents make it. A trie holds it; the
Levenshtein automaton of every term at once is the trie's nodes paired with the errors made so far. Sets of such pairs are the
states of one deterministic automaton, made as words need them, so a word is read once, letter by letter, and most are dead after
three. What a word is found to be, and the states, are remembered while a task lasts, up to a bound. Around each hit a window of
words tells quotation from abuse: quotation marks, words of reporting, and cues that the labels show, words that stand near hits of
documents nearly none of which is toxic. A logistic regression turns the counts into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release

#: The fit reads at most so many labelled documents, those with the least hash of their id.
FIT_ROWS = 20_000
#: A term must be in so many toxic documents of the fit, which must be this share of all documents that have it.
LEAST_TOXIC, LEAST_SHARE = 4, 0.9
STEM = range(4, 9)
STATES = 100_000
WINDOW = 6
CACHE = 200_000
#: A cue of quotation is near hits of so many labelled documents, of which so few are toxic.
LEAST_CUES, CUE_SHARE = 8, 0.1
# fixed values: marks and words of quotation and reporting, in the corpus' languages
MARKS = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote writes called quote quoted quotes term word insult slur dit mot terme insulte sagte schrieb wort begriff dijo escribió palabra término insulto".split())
EDGE = MARKS + ".,;:!?'()[]{}<>|*#$%&-_~`/\\"
FEATURES = ("meant", "quoted", "misspelled", "misspelled_quoted")


@dataclass
class Automaton:
    """Reads words; ``terms`` that end in ``*`` are stems, met by whatever begins with them.

    A term of 5 to 8 letters may have one error, a longer one two, a shorter one none: letters put in, left out or exchanged.
    """

    terms: tuple[str, ...]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[int, bool]] = field(default_factory=dict)
    reach: list[int] = field(default_factory=lambda: [0])
    states: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)
    steps: list[dict[str, int]] = field(default_factory=list)
    found: list[int] = field(default_factory=list)
    met: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        for term in self.terms:
            word, stem = term.rstrip("*"), term.endswith("*")
            allowed = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
            node = 0
            self.reach[0] = max(self.reach[0], allowed)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node] = (allowed, stem or self.ends.get(node, (0, False))[1])
        self.reset()

    def reset(self) -> None:
        """Forgets the states; they are made anew as words need them."""
        self.states, self.sets, self.steps, self.found, self.met = {}, [], [], [], []
        self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of the state of these pairs and all that leaving letters out leads to, without pairs that a smaller error makes needless."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, errors = todo.pop()
            if errors <= self.reach[node] and errors < best.get(node, 9):
                best[node] = errors
                todo += [(child, errors + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, *self.ends[n]) for n, e in key if n in self.ends]
            self.found.append(min((e for e, allowed, _ in ends if e <= allowed), default=9))
            self.met.append(min((e for e, allowed, stem in ends if stem and e <= allowed), default=9))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        pairs = set()
        for node, errors in self.sets[state]:
            pairs.add((node, errors + 1))
            pairs |= {(child, errors + (x != c)) for x, child in self.children[node].items()}
        self.steps[state][c] = found = self._state(pairs)
        return found

    def errors(self, word: str) -> int:
        """The least errors with which the word is a term or begins with a stem; 9 if it is none."""
        if len(self.sets) > STATES:
            self.reset()
        state, best = 0, 9
        for c in word:
            state = self._step_at(state, c)
            if not self.sets[state]:
                return best
            best = min(best, self.met[state])
        return min(best, self.found[state])

    def _step_at(self, state: int, c: str) -> int:
        known = self.steps[state].get(c)
        return self._step(state, c) if known is None else known


class Reader:
    """Counts FEATURES of texts; remembers words up to ``CACHE``."""

    def __init__(self, terms: tuple[str, ...], cues: frozenset[str] = frozenset()):
        self.automaton, self.known, self.cues = Automaton(terms), {}, REPORTING | cues

    def _word(self, token: str) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[token] = errors = self.automaton.errors(token.lower().strip(EDGE))
        return errors

    def _hits(self, tokens: list[str]) -> Iterator[tuple[int, int]]:
        """(position, errors) of the tokens that are terms."""
        known = self.known
        for i, token in enumerate(tokens):
            errors = known.get(token)
            if errors is None:
                errors = self._word(token)
            if errors < 9:
                yield i, errors

    def features(self, text: str) -> list[int]:
        tokens, out = text.split(), [0, 0, 0, 0]
        for i, errors in self._hits(tokens):
            around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = any(c in x for x in around for c in MARKS) or any(x.lower().strip(EDGE) in self.cues for x in around)
            out[2 * (errors > 0) + quoted] += 1
        return out

    def beside(self, text: str) -> set[str]:
        """The words within the windows of the text's hits that are no hits themselves."""
        tokens = text.split()
        hits = {i for i, _ in self._hits(tokens)}
        near = {j for i in hits for j in range(max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1))}
        return {w for j in near - hits if (w := tokens[j].lower().strip(EDGE))}


def _beginnings(text: str) -> set[str]:
    """The words of a text, marked by a final full stop, and their stems."""
    out = set()
    for token in set(text.split()):
        word = token.lower().strip(EDGE)
        if word:
            out.add(word + ".")
            out.update(word[:n] for n in STEM if n <= len(word))
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every, toxic = Counter(), Counter()
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            own = _beginnings(text.as_py() or "")
            every.update(own)
            if label:
                toxic.update(own)
        yield pa.record_batch([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[x] for x in every], pa.int64())], names=["term", "n", "toxic"])


def learn_lexicon(fit: DataFrame) -> tuple[str, ...]:
    """Terms from (text, toxic): words and stems nearly only toxic documents have. A stem gives way to one longer term that is in
    nearly all of its documents, and a term to a stem that covers it. The driver receives terms of ``LEAST_TOXIC`` documents of the
    fit or more, and the fit is bounded."""
    counts = fit.mapInArrow(_tally, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    good = counts.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= LEAST_SHARE * F.col("n")))
    found = {r.term: r.toxic for r in good.collect()}
    by_start: dict[str, list[str]] = {}
    for t in found:
        for n in STEM:
            by_start.setdefault(t[:n], []).append(t)
    kept = {t for t in found if not any(u != t and len(u) > len(t) and found[u] >= 0.9 * found[t] for u in by_start.get(t, ()) if not t.endswith("."))}
    stems = {t for t in kept if not t.endswith(".")}
    covered = lambda t: any(t.rstrip(".")[:n] in stems for n in STEM if n < len(t.rstrip(".")) + t.endswith("."))
    terms = sorted((t for t in kept if not covered(t)), key=lambda t: (-found[t], t))
    return tuple(t[:-1] if t.endswith(".") else t + "*" for t in terms)


def learn_cues(fit: DataFrame, terms: tuple[str, ...]) -> frozenset[str]:
    """Words from (text, toxic) that stand near hits of ``LEAST_CUES`` documents or more, of which at most ``CUE_SHARE`` are toxic, where
    toxic documents have hits as often as others; a word is no cue merely because few documents are toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for batch in batches:
            every, toxic = Counter(), Counter()
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                own = reader.beside(text.as_py() or "")
                every.update(own)
                if label:
                    toxic.update(own)
            yield pa.record_batch([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[x] for x in every], pa.int64())], names=["term", "n", "toxic"])

    counts = fit.mapInArrow(run, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    return frozenset(r.term for r in counts.where((F.col("n") >= LEAST_CUES) & (F.col("toxic") <= CUE_SHARE * F.col("n"))).select("term").collect())


def _terms(meant, quoted, misspelled, misspelled_quoted) -> list:
    """What the regression weighs: all hits, quoted ones by half, then what sets the other kinds apart from those that are meant.
    A kind that the labels say nothing of keeps the weight of all hits."""
    return [meant + misspelled + 0.5 * (quoted + misspelled_quoted), quoted, misspelled, misspelled_quoted]


def _matrix(counts: np.ndarray) -> np.ndarray:
    columns = _terms(*counts.reshape(-1, len(FEATURES)).astype(np.float64).T)
    return np.column_stack([np.ones(len(counts)), *(x > 0 for x in columns), *map(np.log1p, columns)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id: str) -> Column:
    """Whether a document's label is kept from the fit: the CRC-32 of its id as text is divisible by five. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _counted(lexicon, keep: list[str]):
    """Reads the column ``_text``; lexicon: (terms, cues) or a broadcast of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*(lexicon if isinstance(lexicon, tuple) else lexicon.value))
        for batch in batches:
            counts = [reader.features(x.as_py() or "") for x in batch.column("_text")]
            found = [pa.array(x, pa.int64()) for x in (zip(*counts, strict=True) if counts else [[]] * len(FEATURES))]
            yield pa.record_batch([*(batch.column(c) for c in keep), *found], names=[*keep, *FEATURES])

    return run


def with_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with FEATURES, held_out, score (0 to 1) and predicted (1 from 0.5 on); columns of those names give way.

    Labels are learned from documents that ``held_out`` leaves, ``fit_rows`` at most; labels that are null or of no document
    count for nothing, of several for one id the largest holds. Without labels of both kinds every score is 0. Null and empty
    texts get the score of a text without any term. No rows give no rows. Of ``docs`` only id and text matter to a score.
    """
    spark = docs.sparkSession
    usable = labels.where(~held_out(id) & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = materialise(usable.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    fit = materialise(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id").select("_text", "toxic"))
    terms = learn_lexicon(fit.withColumnRenamed("_text", "text"))
    lexicon = (terms, learn_cues(fit.withColumnRenamed("_text", "text"), terms) if terms else frozenset())
    kinds = ", ".join(f"{f} long" for f in FEATURES)
    weight = None
    if terms:
        seen = np.array([tuple(r) for r in fit.mapInArrow(_counted(lexicon, ["toxic"]), f"toxic int, {kinds}").groupBy("toxic", *FEATURES).count().collect()], np.float64)
        n = seen[:, -1].astype(int)
        if 0 < (seen[:, 0] * n).sum() < n.sum():
            weight = _logistic(np.repeat(_matrix(seen[:, 1:-1]), n, 0), np.repeat(seen[:, 0], n))
    release(chosen, fit)
    own = {*FEATURES, "held_out", "score", "predicted", "_text"}
    keep = [c for c in docs.columns if c not in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    counted = docs.select(*keep, F.col(text).alias("_text")).mapInArrow(_counted(spark.sparkContext.broadcast(lexicon), keep), f"{schema}, {kinds}")
    score = F.lit(0.0)
    if weight is not None:
        z = F.lit(float(weight[0]))
        for k, x in enumerate(_terms(*map(F.col, FEATURES))):
            z = z + F.when(x > 0, float(weight[1 + k])).otherwise(0.0) + float(weight[1 + len(FEATURES) + k]) * F.log1p(x)
        score = 1 / (1 + F.exp(-z))
    done = counted.withColumn("held_out", held_out(id)).withColumn("score", score.cast("double"))
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, FEATURES, held_out, score, predicted) of ``with_toxicity``; other columns are not read."""
    return with_toxicity(docs.select(id, text), labels, id, text, **how).drop(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns they had. The texts are not shuffled."""
    hidden = {c: f"_own_{c}" for c in docs.columns if c in {*FEATURES, "held_out", "score", "predicted"}}
    kept = with_toxicity(docs.withColumnsRenamed(hidden), labels, id, text, **how).where("predicted = 0")
    return kept.drop(*FEATURES, "held_out", "score", "predicted").withColumnsRenamed({v: k for k, v in hidden.items()}).select(*docs.columns)
