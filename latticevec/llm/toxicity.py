"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of context windows.

The lexicon holds whole terms and word beginnings. A word is read through the
product of the trie and the Levenshtein automata of its terms, made
deterministic as far as words need it: a state is the set of (node, edits) that
the letters so far can have reached, and nearly all words end in the empty
state after a few letters. Long terms are found with one edit, very long ones
with two.

Each hit counts for its context: within quotation marks, or after a word that
reports speech, it is quotation rather than abuse and counts for little. The
best window of words, the sums and their shares of the text are the inputs of a
logistic regression.

The lexicon is a stated list and what the labelled rows teach: words and
beginnings that stand out in toxic documents. Words of clean documents are no
misspellings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticevec.llm.common import fold, labelled_sample

#: Labelled rows that are learned from, at most; characters of their texts that the lexicon is learned from, at most, in all.
SAMPLE = 6000
SAMPLE_CHARS = 40_000_000
THRESHOLD = 0.7
#: The fold of ids whose labels are never read.
FOLDS, HELD_OUT = 3, 1
LEXICON = 400
WINDOW = 20
#: Terms of abuse, and words that report speech.
TERMS = """bastard bitch clown coward creep cretin degenerate despicable dimwit disgusting dumbass fool freak garbage idiot imbecile
jerk liar loser lowlife lunatic maggot moron parasite pathetic pig psycho scum scumbag sick stupid trash ugly vermin vile weasel worthless wretch""".split()
REPORTS = set("said says say wrote writes called calls quoted quotes term word phrase slur sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split())
QUOTES = "\"“”„«»‹›‘’"
_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=\w)[’'](?=\w)")
_CHUNK = 1 << 20


@dataclass
class Lexicon:
    terms: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    ordinary: set[str] = field(default_factory=set)  # words that are no misspellings


class Automaton:
    """The deterministic product of the lexicon's trie and the Levenshtein automata of its terms."""

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.most: list[int] = [0]  # edits that some term below a node allows
        for table, words in ((self.term, lexicon.terms), (self.stem, lexicon.stems)):
            for word, weight in words.items():
                node = 0
                path = [0]
                for c in word:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term.append(0.0)
                        self.stem.append(0.0)
                        self.most.append(0)
                    node = self.children[node][c]
                    path.append(node)
                table[node] = max(table[node], weight)
                if table is self.term:
                    for x in path:
                        self.most[x] = max(self.most[x], self.edits(word))
        self.own = {self._node(w): self.edits(w) for w in lexicon.terms}
        self.ordinary = lexicon.ordinary
        self.states: dict[frozenset[tuple[int, int]], dict[str, frozenset[tuple[int, int]]]] = {}
        self.start = self._closed({(0, 0)})

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 10 else 2

    def _node(self, word: str) -> int:
        node = 0
        for c in word:
            node = self.children[node][c]
        return node

    def _closed(self, state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of terms left out, at one edit each; the fewest edits for each node."""
        best: dict[int, int] = {}
        queue = sorted(state, key=lambda x: x[1])
        while queue:
            node, e = queue.pop()
            if best.get(node, 9) <= e or e > self.most[node] and e:
                continue
            best[node] = e
            queue += [(child, e + 1) for child in self.children[node].values() if e + 1 <= self.most[child]]
        return frozenset(best.items())

    def step(self, state: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]]:
        known = self.states.setdefault(state, {})
        if c not in known:
            out: set[tuple[int, int]] = set()
            for node, e in state:
                for letter, child in self.children[node].items():
                    if letter == c:
                        out.add((child, e))
                    elif e + 1 <= self.most[child]:
                        out.add((child, e + 1))
                if e + 1 <= self.most[node]:
                    out.add((node, e + 1))
            if len(self.states) > 200_000:
                self.states.clear()
                known = self.states.setdefault(state, {})
            known[c] = self._closed(out)
        return known[c]

    def match(self, word: str) -> tuple[float, float]:
        """The weights of the term and of the beginning that a word is, at most; misspelled terms count four fifths."""
        state, node, stem = self.start, 0, 0.0
        for k, c in enumerate(word):
            node = self.children[node].get(c, -1) if node >= 0 else -1
            if node >= 0 and k + 1 < len(word):
                stem = max(stem, self.stem[node])
            state = self.step(state, c)
            if not state:
                return 0.0, stem
        best = 0.0
        for at, e in state:
            if self.term[at] and e <= self.own[at] and (not e or word not in self.ordinary):
                best = max(best, self.term[at] * (0.8 if e else 1.0))
        return best, stem


class Words(dict):
    """What each word is, remembered for as many words as memory allows."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000):
        super().__init__()
        self.automaton, self.most = Automaton(lexicon), most

    def __missing__(self, word: str) -> tuple[float, float] | None:
        found = self.automaton.match(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value = found if found != (0.0, 0.0) else None
        return value


def _chunks(text: str) -> Iterator[str]:
    a = 0
    while a < len(text):
        b = min(len(text), a + _CHUNK)
        while b < len(text) and not text[b].isspace():
            b += 1
        yield text[a:b]
        a = b


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands within quotation marks of its sentence, or after a word that reports speech."""
    before, after = re.split(r"[.!?\n]", text[max(0, start - 80) : start])[-1], re.split(r"[.!?\n]", text[end : end + 80])[0]
    before, after = _APOSTROPHE.sub("", before), _APOSTROPHE.sub("", after)
    if sum(c in QUOTES for c in before) % 2 and any(c in QUOTES for c in after + text[end : end + 2]):
        return True
    return not REPORTS.isdisjoint(_WORD.findall(before)[-4:])


INPUTS = 9


def inputs(text: str, words: Words) -> np.ndarray:
    """What the regression sees of a text."""
    n, hits, spoken, stems, stem_sum = 0, [], 0.0, 0, 0.0
    for chunk in _chunks(text.lower()):
        found = _WORD.findall(chunk)
        kinds = list(map(words.__getitem__, found))
        if any(kinds):
            at = [k for k, x in enumerate(kinds) if x]
            places = list(_WORD.finditer(chunk))
            for k in at:
                term, stem = kinds[k]
                if quoted(chunk, *places[k].span()):
                    spoken += term + stem
                    term, stem = 0.25 * term, 0.25 * stem
                if term:
                    hits.append((n + k, term))
                if stem:
                    stems += 1
                    stem_sum += stem
        n += len(found)
    best, total, low = 0.0, 0.0, 0
    for high in range(len(hits)):
        total += hits[high][1]
        while hits[high][0] - hits[low][0] >= WINDOW:
            total -= hits[low][1]
            low += 1
        best = max(best, total)
    summed, k = sum(x for _, x in hits), max(1, n)
    return np.array([1.0, np.log1p(summed), np.log1p(200 * summed / k), best, np.log1p(spoken), np.log1p(stems), np.log1p(200 * stems / k), np.log1p(100 * stem_sum / k), np.log1p(n) / 5])


def learn_lexicon(texts: list[str], label: np.ndarray) -> Lexicon:
    """The stated terms and what stands out in toxic texts: by rate, at least eight times, and in several of them."""
    rate, total = (Counter(), Counter()), [1, 1]
    for text, y in zip(texts, label, strict=True):
        y = int(y)
        count = Counter(_WORD.findall(text.lower()))
        total[y] += sum(count.values())
        rate[y].update(count)
    # Word beginnings with a mark that no whole word has.
    for y in (0, 1):
        for w, k in list(rate[y].items()):
            for size in range(3, min(9, len(w))):
                rate[y][w[:size] + "*"] += k
    seen: Counter = Counter()
    for text, y in zip(texts, label, strict=True):
        if y:
            words = set(_WORD.findall(text.lower()))
            seen.update({w[:size] + "*" for w in words for size in range(3, min(9, len(w)))} | words)
    toxic = max(1, int(label.sum()))
    found = []
    for w, docs in seen.items():
        if docs >= max(3, 0.01 * toxic):
            ratio = (rate[1][w] / total[1]) / ((rate[0][w] + 3) / total[0])
            if ratio >= 8:
                found.append((docs * np.log(ratio), w, min(3.0, float(np.log(ratio)) / 2)))
    found = sorted(found, reverse=True)[:LEXICON]
    whole = [*TERMS, *[w for _, w, _ in found if not w.endswith("*")]]
    # A beginning that nearly always goes on to one word is that word, which can be misspelled and quoted.
    own = lambda w: any(t.startswith(w[:-1]) and rate[1][t] >= 0.8 * rate[1][w] for t in whole)
    stems = {w[:-1]: x for _, w, x in found if w.endswith("*") and not own(w)}
    terms = {w: 2.0 for w in TERMS} | {w: x for _, w, x in found if not w.endswith("*") and not any(w[:k] in stems for k in range(3, 9))}
    terms = {w: x for w, x in terms.items() if w not in rate[0] or rate[1][w] / total[1] > 8 * rate[0][w] / total[0]}
    near = Automaton(Lexicon(terms))
    return Lexicon(terms, stems, {w for w in rate[0] if w not in terms and near.match(w)[0]})


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge on all inputs but the first."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        beta = beta + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - penalty @ beta), -5, 5)
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray


def train(texts: list[str], label: np.ndarray) -> Model:
    """The lexicon comes from half of the rows, the regression from the other half, so that it sees how the lexicon does on new rows.

    Rows of one label only teach nothing: the stated terms then have stated weights.
    """
    half = np.arange(len(texts)) % 2 == 0
    default = Model(Lexicon({w: 2.0 for w in TERMS}), np.array([-4.0, 2.0, 0.5, 0.5, -0.5, 0.0, 0.0, 0.0, 0.0]))
    if any(len(set(label[part].tolist())) < 2 for part in (half, ~half)):
        return default
    x, y = [], []
    for part in (half, ~half):
        words = Words(learn_lexicon([t for t, p in zip(texts, part, strict=True) if p], label[part]))
        x += [inputs(t, words) for t, p in zip(texts, part, strict=True) if not p]
        y += label[~part].tolist()
    return Model(learn_lexicon(texts, label), regress(np.array(x), np.array(y, float)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model:
    """A model learned from up to ``most`` labelled rows, none of them held out."""
    sample = labelled_sample(docs, labels, label, fold("doc_id", FOLDS) != HELD_OUT, most, doc_id, text)
    rows = sample.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    room = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if room > SAMPLE_CHARS:  # fewer whole rows, not shorter ones
        rows = labelled_sample(docs, labels, label, fold("doc_id", FOLDS) != HELD_OUT, max(1, most * SAMPLE_CHARS // room), doc_id, text).select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(found.column("text").to_pylist(), found.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty, which has a score like any other. Rows without an
    id are scored and count as held out; repeated rows stay. Without labels the
    stated lexicon alone decides. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.lexicon)
        for batch in batches:
            x = np.array([inputs(t or "", words) for t in batch.column(2).to_pylist()]).reshape(-1, INPUTS)
            made = 1 / (1 + np.exp(-np.clip(x @ shared.value.beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.float64())], ["doc_id", "held_out", "score"])

    held = F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held, F.col(text).alias("__lv_text"))
    out = rows.mapInArrow(scan, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
