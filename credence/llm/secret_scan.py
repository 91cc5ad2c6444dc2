"""Secret scans by grammar inference.

Three fixed patterns find credentials of known shape. What they find are labelled examples,
of which a bounded sample of each kind is read into a prefix tree over character classes.
A state is the multiset of what follows it in the examples; two states are compatible if
the frequencies of their next classes, of their ends and of the lengths that follow do not
differ significantly (Hoeffding's bound), and so on for the states after them, as long as
both have a least count. From the root on, states are merged with compatible ones or kept,
until what is left is a probabilistic automaton of the kind's formats: a run of random
characters becomes a chain that keeps its length, or a loop where lengths vary.

Every token of every text that is long enough to be accepted is then scored: the log
likelihood of its characters under each kind's automaton, against that under a chain of
character pairs counted over all texts. A token is a further finding if an automaton
accepts it, as likely as the kind's examples are, and the odds against ordinary text are
high enough.

Fitting needs one pass over the texts for examples and pair counts; scoring is one more
pass. Both are narrow; only the bounded sample and the pair counts reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import documents, materialize

#: The fixed patterns of the base findings, and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")

#: Most labelled examples of a kind that are used, those of the least hash, and most characters of them.
MAX_EXAMPLES = 400
MAX_CHARACTERS = 1 << 18
#: States with fewer examples are not tested; the level of a test.
LEAST_COUNT = 16
ALPHA = 0.001
#: The share of examples that the score's threshold lets go.
LET_GO = 0.02
#: Log odds of a finding against ordinary text: a million to one.
ODDS = math.log(1e6)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the fixed patterns, in order of start, then kind."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # a greedy run of hex digits of 24 or more is the same as one found whole
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _covered(found: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of findings that are in order of start."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end, *_ in found:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _outside(text: str, found: list) -> list[str]:
    """The parts of a text that no finding covers."""
    starts, ends = _covered(found)
    return [text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])]


# ---------------------------------------------------------------- the automaton

#: Classes of the characters of credentials: digits, hex letters, other small letters and
#: capitals; signs are classes of their own.
_CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"+/_.=-"]
_CLASS = {c: k + 1 for k, own in enumerate(_CLASSES) for c in own}
_SPREAD = [0.0, *(math.log(len(own)) for own in _CLASSES)]
#: Number of a character in the pair counts; 0 is anything that ends a token.
_NUMBER = {c: k + 1 for k, c in enumerate(_CLASS)}
_NUMBERS = np.zeros(256, np.int64)
_NUMBERS[[ord(c) for c in _NUMBER]] = list(_NUMBER.values())
_SIDE = len(_NUMBER) + 1


class _State:
    """The multiset of places in the examples where one is in this state."""

    def __init__(self, depth: int):
        self.depth, self.places = depth, np.zeros(0, np.int64)
        self.next: dict[int, _State] | None = None  # None: not looked into yet


def _by_class(symbols: np.ndarray, places: np.ndarray) -> dict[int, np.ndarray]:
    """What follows after each class; 0 is the end."""
    own = symbols[places]
    return {int(c): places[own == c] + 1 for c in np.unique(own)}


def compatible(symbols: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float = ALPHA, least: int = LEAST_COUNT) -> bool:
    """Whether the futures of two multisets of places may be of one distribution."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if min(len(a), len(b)) < least:
            continue
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(len(a)) + 1 / math.sqrt(len(b)))
        left, right = (np.sort(ends[x] - x) for x in (a, b))
        lengths = np.union1d(left, right)
        if np.abs(np.searchsorted(left, lengths, "right") / len(a) - np.searchsorted(right, lengths, "right") / len(b)).max() > bound:
            return False
        after_a, after_b = _by_class(symbols, a), _by_class(symbols, b)
        for c in after_a.keys() | after_b.keys():
            x, y = after_a.get(c, ()), after_b.get(c, ())
            if abs(len(x) / len(a) - len(y) / len(b)) > bound:
                return False
            if c and len(x) and len(y):
                todo.append((x, y))
    return True


@dataclass
class Automaton:
    """Of each state, from 0: log chance to end; by class, log chance and next state."""

    end: list[float]
    step: list[dict[int, tuple[float, int]]]
    #: Mean log likelihood by character that a finding needs, and the least length of one.
    least: float = -math.inf
    shortest: int = 1

    def log_likelihood(self, token: str) -> float:
        """Of the token's characters and its end; minus infinity if it is not accepted."""
        state, total = 0, 0.0
        for c in token:
            k = _CLASS.get(c)
            after = self.step[state].get(k)
            if after is None:
                return -math.inf
            total += after[0] - _SPREAD[k]
            state = after[1]
        return total + self.end[state]


def infer(examples: Iterable[str], alpha: float = ALPHA, least: int = LEAST_COUNT) -> Automaton | None:
    """The automaton of examples by merging states; None if there are too few of them.

    States with fewer than `least` examples cannot be tested: they are merged where a state
    has all that they do next, and else left out, so a format that occurs less often is
    not learned.
    """
    examples = sorted(examples)
    if len(examples) < least:
        return None
    coded = [np.array([*(_CLASS[c] for c in e), 0], np.int64) for e in examples]
    symbols = np.concatenate(coded)
    lengths = np.array([len(c) for c in coded])
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths - 1, lengths)
    root = _State(0)
    open_states: list[_State] = []

    def add(state: _State, places: np.ndarray) -> None:
        todo = [(state, places)]
        while todo:
            state, places = todo.pop()
            state.places = np.concatenate([state.places, places])
            if state.next is None:
                continue
            for c, after in _by_class(symbols, places).items():
                if c:
                    if c not in state.next:
                        state.next[c] = _State(state.depth + 1)
                        open_states.append(state.next[c])
                    todo.append((state.next[c], after))

    def keep(state: _State) -> None:
        kept.append(state)
        places, state.places, state.next = state.places, np.zeros(0, np.int64), {}
        add(state, places)

    kept: list[_State] = []
    root.places = starts
    keep(root)
    def fits(into: _State, few: np.ndarray) -> bool:
        """Whether what few examples do next, and the lengths that follow, are known of a state."""
        known = set(symbols[into.places]), set(ends[into.places] - into.places)
        return set(symbols[few]) <= known[0] and set(ends[few] - few) <= known[1]

    while open_states:
        state = min(open_states, key=lambda s: (s.depth, -len(s.places)))
        open_states.remove(state)
        nearest = sorted(kept, key=lambda k: (k.depth != state.depth, -k.depth))
        if len(state.places) >= least:
            same = next((k for k in nearest if compatible(symbols, ends, k.places, state.places, alpha, least)), None)
        else:
            same = next((k for k in nearest if fits(k, state.places)), None)
        if same is None:
            if len(state.places) >= least:
                keep(state)
            continue
        for k in kept:
            for c, target in k.next.items():
                if target is state:
                    k.next[c] = same
        add(same, state.places)
    number = {id(s): k for k, s in enumerate(kept)}
    end, step = [], []
    for s in kept:
        after = _by_class(symbols, s.places)
        n = len(s.places)
        end.append(math.log((len(after.get(0, ())) + 0.01) / (n + 0.01)))
        step.append({c: (math.log(len(after[c]) / n), number[id(t)]) for c, t in s.next.items() if id(t) in number})
    found = Automaton(end, step)
    scores = sorted((score / (len(e) + 1), len(e)) for e in examples if (score := found.log_likelihood(e)) > -math.inf)
    if not scores:
        return None
    # sums in another order may differ in the last digits
    found.least = scores[int(LET_GO * len(scores))][0] - 1e-9
    found.shortest = min(n for score, n in scores if score >= found.least)
    return found


@dataclass
class Model:
    """An automaton for each kind that has enough examples, and the chain of ordinary text."""

    automata: dict[str, Automaton] = field(default_factory=dict)
    #: log chance of a character after another, by their numbers; 0 is the outside.
    chain: np.ndarray = field(default_factory=lambda: np.full((_SIDE, _SIDE), -math.log(_SIDE)))
    odds: float = ODDS

    def background(self, token: str) -> float:
        own = [0, *(_NUMBER[c] for c in token), 0]
        return float(self.chain[own[:-1], own[1:]].sum())

    def accepts(self, token: str) -> bool:
        """Whether some kind's automaton finds the token, and with the odds asked for."""
        for automaton in self.automata.values():
            if len(token) >= automaton.shortest:
                score = automaton.log_likelihood(token)
                if score >= automaton.least * (len(token) + 1) and score - self.background(token) >= self.odds:
                    return True
        return False

    @property
    def candidates(self) -> re.Pattern | None:
        """Runs of credential characters that are long enough to be accepted."""
        if not self.automata:
            return None
        return re.compile("[A-Za-z0-9+/_.=-]{%d,}" % min(a.shortest for a in self.automata.values()))


def pair_chain(counts: np.ndarray) -> np.ndarray:
    """Log chances of the next character from pair counts, each pair seen once more."""
    more = counts.astype(float) + 1
    return np.log(more / more.sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- Spark


def _example_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, secret, n): distinct secrets of a batch; and with kind `pair` the counts of character pairs."""
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(_SIDE * _SIDE, np.int64)
        for batch in batches:
            rows = set()
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                rows |= {(kind, secret) for _, _, kind, secret in base}
                text = " ".join(_outside(text, base))
                own = _NUMBERS[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
                pairs += np.bincount(own[:-1] * _SIDE + own[1:], minlength=len(pairs))
            yield pd.DataFrame([(kind, secret, 0, 0) for kind, secret in sorted(rows)], columns=["kind", "secret", "place", "n"])
        seen = np.flatnonzero(pairs)
        yield pd.DataFrame({"kind": "pair", "secret": "", "place": seen, "n": pairs[seen]})

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(found, "kind string, secret string, place bigint, n bigint")


def train(docs: DataFrame, text_col: str = "text", *, max_examples: int = MAX_EXAMPLES, max_characters: int = MAX_CHARACTERS, odds: float = ODDS) -> Model:
    """Infer the automata from the documents' own base findings.

    Of each kind up to max_examples distinct secrets are read, those of least hash, as many
    of them as have max_characters together. The pair counts are of all texts.
    """
    held = materialize(_example_rows(docs, text_col), "secrets")
    model = Model(odds=odds)
    for kind in KINDS[:3]:
        some = (held.filter(F.col("kind") == kind).select("secret").distinct().withColumn("h", F.xxhash64("secret"))
                .orderBy("h", "secret").limit(max_examples))
        # lengths first: a secret may be as long as a text
        chosen, characters = [], 0
        for row in some.select("h", F.length("secret").alias("length")).collect():
            if characters + row["length"] <= max_characters:
                characters += row["length"]
                chosen.append(row["h"])
        rows = some.filter(F.col("h").isin(chosen)).select("secret").collect() if chosen else []
        automaton = infer(r["secret"] for r in rows)
        if automaton:
            model.automata[kind] = automaton
    counts = np.zeros(_SIDE * _SIDE, np.int64)
    # at most as many rows as there are pairs of characters
    for row in held.filter("kind = 'pair'").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[row["place"]] = row["n"]
    model.chain = pair_chain(counts.reshape(_SIDE, _SIDE))
    return model


def spans(text: str, model: Model | None = None, candidates: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings; those of the automata overlap none of the others.

    A run of credential characters is tried whole, without dots at its end, and else in its
    parts between signs that join words.
    """
    base = [s[:3] for s in base_spans(text)]
    candidates = candidates or (model.candidates if model else None)
    if candidates is None:
        return base
    more: list[tuple[int, int, str]] = []
    starts, ends = _covered(base)
    for m in candidates.finditer(text):
        run = m[0].rstrip(".")
        tries = [(m.start(), run)]
        if re.search(r"[=./]", run):
            tries += [(m.start() + p.start(), p[0]) for p in re.finditer(r"[^=./]+", run)]
        for start, token in tries:
            end = start + len(token)
            known = bisect_left(starts, end) - 1  # the last of the base findings that starts before the token ends
            if not token or known >= 0 and ends[known] > start or more and more[-1][1] > start:
                continue
            if model.accepts(token):
                more.append((start, end, "format"))
                if start == m.start() and token == run:
                    break
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per input row: id and the findings as an array of (start, end, kind).

    Places are code points, ends exclusive; of findings that start in one place the order
    is that of KINDS. Null and empty texts have no findings, rows that repeat each have
    their own, and null ids stay null. Without a model one is inferred from the documents'
    own base findings.
    """
    if model is None:
        model = train(docs, text_col)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        candidates = model.candidates
        for batch in batches:
            batch["spans"] = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t or "", model, candidates)] for t in batch["text"]]
            yield batch[["id", "spans"]]

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if source.schema["id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        # pandas would make floats of a column with nulls
        source = source.withColumn("id", F.col("id").cast("string"))
    kind = source.schema["id"].dataType.simpleString()
    return (source.mapInPandas(found, f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")
            .select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "spans"))


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None, count_col: str | None = None) -> DataFrame:
    """`docs` with each finding replaced by its kind in brackets; overlapping ones by the first's.

    A null text stays null. `count_col` names a column of text lengths to bring up to date.
    """
    if model is None:
        model = train(docs, text_col)
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else mask(t, spans(t, model)))

    out = docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(text_col).isNull(), F.col(count_col)).otherwise(
            F.length(text_col)).cast(docs.schema[count_col].dataType))
    return out


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at, until = [], 0, 0
    for start, end, kind in found:
        if start >= until:
            parts += [text[at:start], f"[{kind}]"]
        until = max(until, end)
        at = until
    return "".join(parts) + text[at:]


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def digest(found: pd.Series) -> pd.DataFrame:
        rows = []
        for own in found:
            own = [(s["kind"], s["start"], s["end"]) for s in own]
            base = [s for s in own if s[0] != "format"]
            joined = [",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in (base, own)]
            rows.append((*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(docs).select("doc_id", digest("spans").alias("d")).select("doc_id", "d.*")
