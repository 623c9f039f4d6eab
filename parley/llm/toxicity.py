"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the tagged words of a text, each rewriting what the one
before it wrote: threat (a verb of harm with somebody as its object, which stands next to it, before it
only where the pronoun can't be a subject; verbs that are harmless as often need a word of
intention before them), reported speech (what follows a verb of saying in its sentence,
or stands in quotes, which stay open over sentence marks, is quoted), negation (what follows one within a few words is denied), target
(what follows a word for a person is aimed at it) and insult (an insult, aimed at somebody or not, or one that a
target follows).  They are composed once into one deterministic machine over tags, whose arcs
emit the events that a clause is scored by.  A clause is scored, not a word: the weights of its events' words are
summed, those of quoted and denied ones apart.

The lexicon is learned: insults are words, and beginnings of words, that labelled
toxic texts hold far more often than others; words that stand there before an object join
the verbs of harm, which are known by stems and endings.  A logistic model over the clause
scores, fitted on the same labelled rows, gives the score.

Null and empty texts have no clauses and get the score of such a text; where no toxic text is known all get about 0.  Repeated rows
each get their result; of events of equal weight in a clause the first of EVENTS names
it.  A very long text is read in one pass, in time that grows with its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from parley.llm.common import map_texts

#: Closed word classes of the grammar in four languages.
CLASSES = {
    "TARGET": "your yours you're u ur he she they their du dein deine ihr tu toi ton ta votre tú tus vosotros",
    "OBJECT": "you yourself yourselves him her them ti usted ustedes",
    "CLITIC": "dich dir euch ihn te vous os",
    "NEGATION": "not no never isn't aren't wasn't don't doesn't won't can't nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco ningún",
    "REPORT": "said says say wrote writes told tells called calls quoted claimed claims sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó",
    "WILL": "will going gonna shall i'll we'll he'll she'll they'll werde werden wird vais va allons voy vamos van",
}
#: Stems of verbs of harm by language, those that mean harm by themselves first, and the endings they take.
HARM = {
    "en": ("kill murder slaughter strangl stab stabb behead", "hurt beat punch burn crush destroy smash shoot", " s e es d ed ing en er"),
    "de": ("töt ermord erwürg erschieß erstech umbring", "schlag verletz verbrenn zerstör prügel", " e en st t est et te ten"),
    "fr": ("tue assassine égorge étrangle", "frappe blesse brûle", " s z r nt rai ras ra rons rez ront"),
    "es": ("mat asesin estrangul degoll", "golpe destroz lastim", "ar o as a amos an aré arás ará arán é ó aron ando"),
}
KINDS = ("THREAT", "HARM")
TAGS = ("INSULT", *CLASSES, *KINDS, "QUOTE", "END", "OTHER")
#: What an arc may emit.
EVENTS = ("insult", "directed", "denied", "quoted", "threat")

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
PIECE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]|[.!?;\n]+")
#: So many words after a negation, a target or a word of intention are in its scope; a target may follow an insult by as many.
SCOPE = 4


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: ``step(state, symbol) -> (state, symbol)``."""

    start: Hashable
    step: Callable[[Hashable, str], tuple[Hashable, str]]


def threat() -> Transducer:
    """Writes ATTACK where a verb of harm and its object have met, and one symbol for all words for persons."""

    def step(state, tag):
        clitic, will, verb = state
        harm = tag == "THREAT" or tag == "HARM" and will > 0
        met = harm and clitic or verb and tag in ("OBJECT", "CLITIC")
        after = tag == "CLITIC" and not met, SCOPE if tag == "WILL" else 0 if tag == "END" else max(0, will - 1), harm and not met
        if met:
            return after, "ATTACK"
        return after, "TARGET" if tag in ("OBJECT", "CLITIC") else "OTHER" if tag in ("WILL", *KINDS) else tag

    return Transducer((False, 0, False), step)


def reported() -> Transducer:
    """Turns insults and attacks into QUOTED ones after a verb of saying and within quotes."""

    def step(state, tag):
        said, quoted = state
        if tag == "QUOTE":
            return (said, not quoted), "OTHER"
        if tag in ("REPORT", "END"):
            return (tag == "REPORT", quoted), "OTHER" if tag == "REPORT" else tag
        return state, f"QUOTED_{tag}" if (said or quoted) and tag in ("INSULT", "ATTACK") else tag

    return Transducer((False, False), step)


def within(openers: tuple[str, ...], marks: dict[str, str]) -> Transducer:
    """For SCOPE words after one of ``openers`` rewrites the tags in ``marks``."""

    def step(left, tag):
        out = marks.get(tag, tag) if left else tag
        return SCOPE if tag in openers else 0 if tag == "END" else max(0, left - 1), out

    return Transducer(0, step)


def insult() -> Transducer:
    """Writes the events: an insult counts alone; one with a target, before it or within SCOPE words after, is directed."""

    def step(left, tag):
        rest = max(0, left - 1)
        if tag in ("END", "AT_INSULT"):
            return 0, "directed" if tag == "AT_INSULT" else tag
        if tag == "INSULT":
            return SCOPE, "insult"
        if tag == "TARGET" and left:
            return 0, "directed"
        if tag == "ATTACK":
            return rest, "threat"
        return rest, tag.split("_")[0].lower() if tag.endswith(("_INSULT", "_ATTACK")) else tag

    return Transducer(0, step)


def compose(*machines: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """The table of next states and of emitted events (-1: none) by state and tag of the machines in a row."""
    start = tuple(m.start for m in machines)
    states, todo = {start: 0}, [start]
    following: list[list[int]] = []
    emitted: list[list[int]] = []
    while len(following) < len(todo):
        state = todo[len(following)]
        row, out = [], []
        for tag in TAGS:
            symbol, after = tag, []
            for m, s in zip(machines, state):
                s, symbol = m.step(s, symbol)
                after.append(s)
            key = tuple(after)
            if key not in states:
                states[key] = len(todo)
                todo.append(key)
            row.append(states[key])
            out.append(EVENTS.index(symbol) if symbol in EVENTS else -1)
        following.append(row)
        emitted.append(out)
    return following, emitted


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    negation = within(("NEGATION",), {"INSULT": "DENIED_INSULT", "ATTACK": "DENIED_ATTACK"})
    target = within(("TARGET", "ATTACK", "DENIED_ATTACK", "QUOTED_ATTACK"), {"INSULT": "AT_INSULT"})
    return compose(threat(), reported(), negation, target, insult())


def verb_of_harm(word: str) -> str | None:
    """THREAT or HARM for a form of a verb of harm."""
    for *stems, endings in HARM.values():
        allowed = endings.split(" ")
        for kind, known in zip(KINDS, stems):
            if any(word.startswith(x) and word[len(x) :] in allowed for x in known.split()):
                return kind
    return None


#: Lengths of the beginnings of words that may become lexicon entries.
PREFIXES = range(4, 8)


@dataclass
class Lexicon:
    words: dict[str, float]
    prefixes: dict[str, float]
    #: Learned words that harm the object that follows them.
    threats: dict[str, float] = field(default_factory=dict)
    fixed: dict[str, str] = field(default_factory=lambda: {w: c for c, ws in CLASSES.items() for w in ws.split()})

    def look(self, word: str) -> tuple[str, float] | None:
        """The tag and weight of a lower-case word, None for OTHER; a word of the closed classes is never an insult."""
        tag = self.fixed.get(word)
        tag = tag or verb_of_harm(word)
        if tag:
            return tag, 1.0
        if word in self.threats:
            return "THREAT", self.threats[word]
        weight = self.words.get(word, 0.0)
        for k in PREFIXES:
            if len(word) > k:
                weight = max(weight, self.prefixes.get(word[:k], 0.0))
        return ("INSULT", weight) if weight else None


def plain(text: str) -> str:
    """The text in lower case, with one kind of apostrophe."""
    return text.lower().replace("’", "'")


def before_objects(text: str) -> set[str]:
    """The words that stand right before an object, of a text in plain form."""
    words = PIECE.findall(text)
    objects = {*CLASSES["OBJECT"].split(), *CLASSES["CLITIC"].split()}
    known = {w for ws in CLASSES.values() for w in ws.split()}
    return {a for a, b in zip(words, words[1:]) if b in objects and a not in known and WORD.fullmatch(a)}


def learn_lexicon(texts: list[str], toxic: list[int], least: int = 4, lift: float = 12.0) -> Lexicon:
    """Words and beginnings found in ``least`` toxic texts and, smoothed, ``lift`` times as often in them as in others.

    A beginning counts only through words that are not entries themselves, and is
    dropped where a shorter beginning already qualifies.  Words right before an object
    that toxic texts have as much more often, and that are no insults, are verbs of harm.
    """
    n = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))

    def sets() -> Iterator[set[str]]:
        return (set(WORD.findall(plain(t))) for t in texts)

    def chosen(items: Iterator[set[str]]) -> dict[str, float]:
        seen = Counter(), Counter()
        for s, y in zip(items, toxic):
            seen[y].update(s)
        out = {}
        for w, k in seen[1].items():
            rate = (k / n[0]) / ((seen[0][w] + 0.5) / n[1])
            if k >= least and rate >= lift:
                out[w] = float(np.log(rate))
        return out

    words = chosen(sets())
    prefixes = chosen({w[:k] for w in s if w not in words for k in PREFIXES if len(w) > k} for s in sets())
    kept = {p: v for p, v in prefixes.items() if not any(p[:k] in prefixes for k in PREFIXES if k < len(p))}
    lexicon = Lexicon(words, kept)
    lexicon.threats = {w: v for w, v in chosen(before_objects(plain(t)) for t in texts).items() if lexicon.look(w) is None}
    return lexicon


@dataclass
class Scanner:
    """Clause features of texts; remembers the words it has looked up."""

    lexicon: Lexicon
    known: dict[str, tuple[str, float] | None] = field(default_factory=dict)
    tables: tuple = field(default_factory=grammar)

    def looked(self, words: set[str]) -> dict[str, tuple[str, float]]:
        if len(self.known) > 400_000:
            self.known.clear()
        hits = {}
        for w in words:
            try:
                found = self.known[w]
            except KeyError:
                found = self.known[w] = self.lexicon.look(w)
            if found:
                hits[w] = found
        return hits

    def clauses(self, text: str | None) -> list[tuple[int, int, list[float]]]:
        """(start, end, weight by event) of each clause with an event; offsets count code points."""
        if not text:
            return []
        hits = self.looked(set(WORD.findall(plain(text))))
        if not any(tag in ("INSULT", *KINDS) for tag, _ in hits.values()):
            return []
        following, emitted = self.tables
        quote, other, stop = (TAGS.index(t) for t in ("QUOTE", "OTHER", "END"))
        out, state, sums, start, end = [], 0, None, 0, 0
        for m in PIECE.finditer(text.replace("’", "'")):
            piece = m[0]
            if piece[0] in ".!?;\n":
                if sums:
                    out.append((start, m.start(), sums))
                # quotes stay open up to the end of the line
                state, sums, start = 0 if "\n" in piece else following[state][stop], None, m.end()
                continue
            end = m.end()
            weight, tag = 1.0, quote if piece[0] in "\"“”«»„" else other
            if tag == other:
                found = hits.get(piece.lower())
                if found:
                    tag, weight = TAGS.index(found[0]), found[1]
            event = emitted[state][tag]
            state = following[state][tag]
            if event >= 0:
                sums = sums or [0.0] * len(EVENTS)
                sums[event] += weight
        if sums:
            out.append((start, end, sums))
        return out

    def features(self, text: str | None, found: list[tuple[int, int, list[float]]] | None = None) -> list[float]:
        """For each event: the number of clauses, the summed and the greatest weight; then clauses a 100 words.  ``found``: the clauses, if known."""
        found = self.clauses(text) if found is None else found
        if not found:
            return [0.0] * (3 * len(EVENTS) + 1)
        sums = np.array([s for _, _, s in found])
        words = text.count(" ") + 1
        return [*np.log1p((sums > 0).sum(axis=0)), *np.log1p(sums.sum(axis=0)), *sums.max(axis=0), min(5.0, 100 * len(found) / words) / 5]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit(texts: list[str], toxic: list[int], steps: int = 400, decay: float = 1e-3) -> Model:
    """Learn the lexicon, then the clause model by Newton steps of a penalised logistic regression.

    The features of a row come from a lexicon learned on the other half of the rows,
    so that the clause model doesn't trust entries that only fit their own rows.
    """
    lexicon = learn_lexicon(texts, toxic)
    width = 3 * len(EVENTS) + 1
    if not any(toxic):
        return Model(lexicon, np.zeros(width), -30.0)
    x = np.zeros((len(texts), width))
    for half in (0, 1):
        other = [i for i in range(len(texts)) if i % 2 != half]
        scanner = Scanner(learn_lexicon([texts[i] for i in other], [toxic[i] for i in other]))
        for i in range(half, len(texts), 2):
            x[i] = scanner.features(texts[i])
    y = np.array(toxic, dtype=float)
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(width + 1)
    ridge = np.diag([decay * max(1, len(x))] * width + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p) + 1e-9)[:, None]) + ridge, full.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, w[:-1], float(w[-1]))


def score(docs: DataFrame, text: Column, *ids: Column, model: Model, spans: bool = True) -> DataFrame:
    """(ids, score, n_clauses, spans): the probability that each whole text is toxic, and its matched clauses with their events."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_clauses", T.LongType())]
    if spans:
        fields.append(T.StructField("spans", T.StringType()))

    def make():
        scanner = Scanner(model.lexicon)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            texts = part.column(part.num_columns - 1).to_pylist()
            found = [scanner.clauses(t) for t in texts]
            x = np.array([scanner.features(t, f) for t, f in zip(texts, found)])
            out: dict[str, list] = {"score": model.score(x).tolist(), "n_clauses": [len(f) for f in found]}
            if spans:
                out["spans"] = [",".join(f"{EVENTS[int(np.argmax(w))]}:{a}:{b}" for a, b, w in f) for f in found]
            return out

        return call

    return map_texts(docs, [*ids, text.alias("_text")], make, T.StructType(fields), len(ids))
