"""Toxicity by a weighted finite-state grammar over clauses.

*Transducers.* Each has states, reads symbols and writes them on, with a weight. The first,
*insult*, reads words: a trie of entries (whole words, beginnings of words, and phrases of
two words) that writes classes of tokens. The others read classes and add a mark to what
they hold: *threat* (an intention, then a verb of violence), *target* (a person addressed
holds for four tokens), *negation* (a negator holds for three), *reported speech* (a verb of
saying holds to the end of its clause, a colon after it included; a quotation holds from its
opening mark to its closing one, across sentences, within a line). :func:`compose` makes one
machine of any two: the second reads what the first writes, weights add up.

*Clauses.* A clause ends at a sentence end, semicolon, line end, or a colon that follows no
verb of saying. The target machine also reads the clause from its end ("idiots like you").
A match's weight is its entry's, plus what the path through the machine adds or takes; a
clause's weight is the sum of its matches', and its kind that of the strongest (negated,
reported, targeted or plain). A document's score is a logistic function of its clauses: by
kind, the strongest and the sum, and the number of clauses with a threat.

*Learning.* Entries and their weights come from a bounded sample of labelled rows
(``MOST_TOXIC`` and ``MOST_CLEAN``, smallest hashes of the id first, ties by id): log odds of
documents that have them. The weights of the score are fitted on the same rows, around prior
values. Scores read the text alone. Null and empty texts, and texts without a match, get the
base score. Rows that repeat are scored each; a repeated ``doc_id`` in the sample brings all
its rows, and equal texts have equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pick, prepare, slices, stash, unstash

MOST_TOXIC = 3000
MOST_CLEAN = 6000
SHORTEST, LONGEST = 3, 9

_TOKEN = re.compile(r"\w+n['’]t\b|\w+|[.!?;:\n\"«»“”„]")
CLASSES = OTHER, TARGET, NEGATION, SAYING, INTENT, QUOTE, OPENING, CLOSING, COLON, STOP, LINE, VIOLENCE, INSULT = range(13)
PLAIN, TARGETED, REPORTED, NEGATED = range(4)
#: Marks that transducers add to a symbol.
MATCH, THREAT_MARK, TARGET_MARK, NEGATION_MARK, REPORT_MARK = 1, 2, 4, 8, 16
#: What a mark adds to the weight of a match that has it.
WEIGHTS = {THREAT_MARK: 1.0, TARGET_MARK: 0.5, NEGATION_MARK: -1.0, REPORT_MARK: -1.0}
#: Words of each class in English, German, French and Spanish.
GRAMMAR = {
    VIOLENCE: "kill hurt destroy beat stab shoot strangle murder töten umbringen schlagen erschießen tuer frapper détruire poignarder matar golpear destruir apuñalar",
    TARGET: "you your youre u they them he she him her these those du dich dir ihr euch sie er tu toi te vous ils elle lui tú usted ustedes te ellos ella",
    NEGATION: "not no never isnt arent dont without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin tampoco",
    SAYING: "said says say called calls wrote quoted reported alleged sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió",
    INTENT: "will gonna going shall want werde will werden möchte vais va veux vamos voy quiero",
}
#: Insults known from the start; what the labels show is added to them.
SEEDS = "idiot moron stupid loser scum trash dumbass retard imbecile pathetic worthless disgusting dummkopf trottel abschaum arschloch imbécile crétin connard ordure idiota estúpido imbécil basura escoria"
_SEED_WEIGHT = 2.0
#: Prior weights of the score: the constant, then for each kind the strongest clause and the
#: sum of clauses, then the number of clauses with a threat.
PRIOR = np.array([-3.0, 0.9, 1.2, 0.5, 0.3, 0.3, 0.4, 0.2, 0.1, 1.0])


class Transducer:
    """States from 0, and ``arcs``: (state, symbol) to (state, symbol, weight); a symbol is a
    class of tokens and the marks it has so far."""

    def __init__(self, arcs: dict[tuple[int, tuple[int, int]], tuple[int, tuple[int, int], float]]):
        self.arcs = arcs

    def run(self, symbols: list[tuple[int, int]], state: int = 0) -> list[tuple[tuple[int, int], float]]:
        out = []
        for x in symbols:
            state, y, weight = self.arcs[state, x]
            out.append((y, weight))
        return out


def transducer(step, mark: int, start: tuple = (0,)) -> Transducer:
    """The machine of a rule ``step(state, class) -> (state, holds)``, which marks the matches it
    holds (the threat machine makes matches of its own)."""
    number, arcs, todo = {start: 0}, {}, [start]
    while todo:
        s = todo.pop()
        for c in CLASSES:
            to, holds = step(s, c)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            for marks in range(32):
                own = holds and (marks & MATCH or mark == THREAT_MARK)
                new = marks | (mark | (MATCH if mark == THREAT_MARK else 0) if own else 0)
                arcs[number[s], (c, marks)] = number[to], (c, new), WEIGHTS[mark] if own else 0.0
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer, symbols: list[tuple[int, int]]) -> Transducer:
    """One machine that writes what ``second`` writes on reading what ``first`` writes."""
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        for x in symbols:
            to_a, y, wa = first.arcs[a, x]
            to_b, z, wb = second.arcs[b, y]
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(number)
                todo.append((to_a, to_b))
            arcs[number[a, b], x] = number[to_a, to_b], z, wa + wb
    return Transducer(arcs)


def _hold(cause: int, length: int):
    """Holds for ``length`` tokens after each token of the class ``cause``, within the clause."""

    def step(state: tuple, c: int) -> tuple[tuple, bool]:
        if c in (STOP, LINE):
            return (0,), False
        return (length if c == cause else max(0, state[0] - 1),), state[0] > 0

    return step


def _threat(state: tuple, c: int) -> tuple[tuple, bool]:
    to, armed = _hold(INTENT, 4)(state, c)
    return to, armed and c == VIOLENCE


def _reported(state: tuple, c: int) -> tuple[tuple, bool]:
    said, quoted = state
    if c in (QUOTE, OPENING, CLOSING):
        quoted = 1 if c == OPENING else 0 if c == CLOSING else 1 - quoted
    elif c == LINE:
        said = quoted = 0
    elif c == STOP:
        said = 0
    elif c == SAYING:
        said = 1
    return (said, quoted), bool(state[0] or state[1])


THREAT, TARGETING, NEGATING, REPORTING = transducer(_threat, THREAT_MARK), transducer(_hold(TARGET, 4), TARGET_MARK), transducer(_hold(NEGATION, 3), NEGATION_MARK), transducer(_reported, REPORT_MARK, (0, 0))
#: What the insult transducer writes: an entry is a match.
SYMBOLS = [(c, MATCH if c == INSULT else 0) for c in CLASSES]
MACHINE = compose(compose(compose(THREAT, TARGETING, SYMBOLS), NEGATING, SYMBOLS), REPORTING, SYMBOLS)
#: The state of the machine where a clause begins, outside and inside a quotation.
BEGIN = (0, MACHINE.arcs[0, (OPENING, 0)][0])
_MARKS = {"\n": LINE, ":": COLON, '"': QUOTE, "«": OPENING, "»": CLOSING, "“": QUOTE, "”": CLOSING, "„": OPENING}
_CLASSES = {w: c for c, words in GRAMMAR.items() for w in words.split()} | {x: STOP for x in ".!?;"} | _MARKS


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def beginnings(word: str) -> list[str]:
    """The word itself (marked by a final ``$``) and its beginnings."""
    return [word + "$", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class _Known(dict):
    """The class of each word met, and the weight of an entry above it; made when first met."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        weight = max((self.lexicon.get(b, 0.0) for b in beginnings(word)), default=0.0)
        negates = word.endswith(("n't", "n’t"))
        got = (INSULT, weight) if weight > 0 else (NEGATION if negates else _CLASSES.get(word, OTHER), _SEED_WEIGHT)
        if len(self) > 200_000:
            self.clear()
        self[word] = got
        return got


class Grammar:
    """Lexicon and weights; scores whole texts."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray = PRIOR):
        self.lexicon, self.weights = lexicon, weights
        self._known = _Known(lexicon)
        self._phrases: dict[str, dict[str, float]] = {}
        for x, weight in lexicon.items():
            if " " in x:
                first, second = x.split(" ")
                self._phrases.setdefault(first, {})[second] = weight

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights}

    def __setstate__(self, state):
        self.__init__(**state)

    def read(self, words: list[str]) -> list[tuple[int, float]]:
        """The insult transducer: the class of each token, and an entry's weight where one ends."""
        out = list(map(self._known.__getitem__, words))
        if self._phrases and not self._phrases.keys().isdisjoint(words):
            for i, second in enumerate(words[1:]):
                weight = self._phrases.get(words[i], {}).get(second, 0.0)
                if weight and (out[i + 1][0] != INSULT or out[i + 1][1] < weight):
                    out[i + 1] = INSULT, weight
        return out

    def clauses(self, text: str | None) -> list[tuple[int, float, bool]]:
        """(kind, weight, holds a threat) of every clause with a match. Of the others only the
        quotation marks are read, which may hold over several clauses."""
        read = self.read(tokens(text))
        classes = [c for c, _ in read]
        hits = [i for i, c in enumerate(classes) if c >= VIOLENCE]
        if not hits:
            return []
        out, begin, hit = [], 0, 0
        quoted = quoted_before = 0
        for end in [*(i for i, c in enumerate(classes) if QUOTE <= c <= LINE), len(classes)]:
            c = classes[end] if end < len(classes) else LINE
            if c < COLON:
                quoted = 1 if c == OPENING else 0 if c == CLOSING else 1 - quoted
                continue
            if c == COLON and SAYING in classes[begin:end]:
                continue  # what follows belongs to the clause
            if hit < len(hits) and hits[hit] < end:
                if found := self._matches(read[begin:end], BEGIN[quoted_before]):
                    out.append((-max(found)[1], sum(f[0] for f in found), any(f[2] for f in found)))
                while hit < len(hits) and hits[hit] < end:
                    hit += 1
            quoted = 0 if c == LINE else quoted
            begin, quoted_before = end + 1, quoted
        return out

    @staticmethod
    def _matches(read: list[tuple[int, float]], state: int) -> list[tuple[float, int, bool]]:
        """(weight, kind with a minus, is a threat) of the matches in a clause."""
        marked = MACHINE.run([(c, MATCH if c == INSULT else 0) for c, _ in read], state)
        behind = TARGETING.run([x for x, _ in reversed(marked)])[::-1]
        found = []
        for (_, weight), ((_, marks), path), ((_, after), _) in zip(read, marked, behind, strict=True):
            if marks & MATCH:
                if after & TARGET_MARK and not marks & TARGET_MARK:
                    marks, path = marks | TARGET_MARK, path + WEIGHTS[TARGET_MARK]
                kind = NEGATED if marks & NEGATION_MARK else REPORTED if marks & REPORT_MARK else TARGETED if marks & TARGET_MARK else PLAIN
                found.append((max(0.1, weight + path), -kind, bool(marks & THREAT_MARK)))
        return found

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(len(PRIOR))
        x[0] = 1
        for kind, weight, threat in self.clauses(text):
            x[1 + kind] = max(x[1 + kind], weight)
            x[5 + kind] += weight
            x[9] += threat
        x[5:] = np.log1p(x[5:])
        return x

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array([self.features(t) for t in texts]) @ self.weights, -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression around :data:`PRIOR`, by Newton steps that never go uphill."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def held_out(column: str = "doc_id"):
    """crc32 of the id's decimal text modulo 5 is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count(batches_of: DataFrame, wanted: dict | None, least: int) -> dict[str, int]:
    """In how many of the sample's texts each word, beginning and phrase is; ``wanted`` restricts them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                words = tokens(t)
                seen = {x for w in set(words) if w not in _CLASSES for x in beginnings(w)}
                seen |= {f"{a} {b}" for a, b in pairwise(words) if a not in _CLASSES and b not in _CLASSES}
                n.update(seen if wanted is None else seen & wanted.keys())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["x", "n"])

    rows = batches_of.select("text").mapInArrow(run, "x string, n long").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {r.x: r.n for r in rows.collect()}


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Grammar:
    """Learn lexicon and weights from labelled rows that aren't held out. Without labels
    the seeds and prior weights remain. A document with several labels is toxic if one says so."""
    prepare(docs.sparkSession)
    seeds = {w + "$": _SEED_WEIGHT for w in SEEDS.split()}
    known = labels.where(labels.doc_id.isNotNull() & labels.toxic.isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    ids = pick(docs, "doc_id").where("doc_id is not null").distinct().join(known, "doc_id")
    # the bounded sample: each task hands on its smallest hashes, no label's rows meet
    first = lambda label, most: ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = first(1, most_toxic).unionByName(first(0, most_clean))
    sample = stash(pick(docs, "doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id"), "labelled")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        unstash(sample)
        return Grammar(seeds)
    least = max(3, toxic // 500)
    have = _count(sample.where("toxic = 1"), None, least)
    lack = _count(sample.where("toxic = 0"), have, 1)
    # a beginning stands for many words; one that is nearly always the same word isn't one
    alone = {x[:k] for x, n in have.items() if x[-1] == "$" and " " not in x for k in range(SHORTEST, len(x)) if n >= 0.8 * have.get(x[:k], n)}
    base, sure = toxic / (toxic + clean), np.log(len(have) + 1) + 3
    lexicon = dict(seeds)
    for x, n in have.items():
        m = lack.get(x, 0)
        share = n / (n + m)
        # more toxic than chance allows any of so many candidates to be
        evidence = n * np.log(share / base) + (m * np.log((1 - share) / (1 - base)) if m else 0.0)
        weight = np.log((n + 0.2) / (toxic + 1)) - np.log((m + 0.5) / (clean + 1))
        if weight > np.log(4) and evidence > sure and x not in alone:
            lexicon[x] = max(float(weight), lexicon.get(x, 0.0))
    # a longer beginning that says no more than a shorter one is no entry of its own
    short = {x for x in lexicon if " " not in x and any(lexicon.get(x[:k], -1.0) >= lexicon[x] - 0.3 and have.get(x[:k], 0) >= have.get(x, 0) for k in range(SHORTEST, len(x)))}
    lexicon = {x: w for x, w in lexicon.items() if x not in short or x in seeds}
    # a phrase says more than its words, or it is no entry
    entry = _Known({x: w for x, w in lexicon.items() if " " not in x})
    word_alone = lambda x, w: all(entry[part][0] != INSULT or entry[part][1] < w - 0.3 for part in x.split(" "))
    lexicon = {x: w for x, w in lexicon.items() if " " not in x or word_alone(x, w)}
    grammar = Grammar(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [grammar.features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    x = np.repeat([r.x for r in got], [r["count"] for r in got], axis=0)
    y = np.repeat([float(r.toxic) for r in got], [r["count"] for r in got])
    unstash(sample)
    grammar.weights = fit_weights(x, y)
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` (its columns in the struct ``row``) with ``score`` from 0 to 1."""
    from pyspark.sql import types as T

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(g.score(b.column(1).to_pylist()))], ["row", "score"])

    return base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())]))
