"""Secret scan: fixed patterns, and automata inferred from the credentials they find.

The values that the patterns find are labelled credentials. They are read as formats: runs
of digits, letters, hexadecimal or mixed characters, punctuation, and a beginning that
all share. From a sample of each kind a prefix tree is built and its statistically
compatible states are merged, which gives a probabilistic automaton of the kind's format,
its lengths and parts included. Ordinary tokens give an automaton in the same way. Every
other token is scored by how much likelier a format is than ordinary text.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.session import materialise

#: The base (fixed values): kind, pattern, group that is measured, least length, texts one of which must occur.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs of hexadecimal digits of the least length; shorter ones fail anyway and runs don't overlap.
_LONG_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}")
_ASSIGN_NAMES = ("password", "passwd", "secret", "token", "api")
LEARNED = "format"
#: A candidate is any token of this least length, the least of the base; no other gate stands before the score.
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{min(LEAST.values())},}}")
_SEGMENT = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_HEX_DIGITS = (frozenset("0123456789abcdef"), frozenset("0123456789ABCDEF"))
END = ""
#: States seen less often aren't tested; probability of what a state has never seen; scores that a task remembers.
SEEN, UNSEEN, REMEMBERED = 10, 1e-5, 100_000
#: A kind with fewer values has no automaton.
LEAST_VALUES = 20


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit: values of a kind and ordinary tokens, with digits and without, that are read, by order of a hash."""

    values: int = 1_000
    ordinary: int = 5_000
    #: Significances of the test that two states differ; the one under which held-out values are likeliest is taken.
    alphas: tuple[float, ...] = (0.2, 0.05, 0.01)


def _class_of(segment: str) -> str:
    """The symbols of a run of letters and digits, one per character."""
    n = len(segment)
    if segment.isdigit():
        return "0" * n
    if segment.isalpha():
        if segment.islower():
            return "a" * n
        if segment.isupper():
            return "A" * n
        return "A" + "a" * (n - 1) if segment[1:].islower() else "b" * n
    for upper, digits in enumerate(_HEX_DIGITS):
        if digits.issuperset(segment):
            return ("h", "H")[upper] * n
    return ("n" if segment == segment.lower() else "N" if segment == segment.upper() else "m") * n


def symbols(value: str) -> str:
    """A token's format: its runs by the characters they are made of, and its punctuation."""
    return "".join(_class_of(s) if s[0].isalnum() else s for s in _SEGMENT.findall(value))


def shared_beginning(values: list[str], share: float = 0.9) -> str:
    """The characters that nearly all values begin with."""
    beginning = ""
    while values:
        following = Counter(v[len(beginning) : len(beginning) + 1] for v in values if v.startswith(beginning))
        character, n = following.most_common(1)[0] if following else ("", 0)
        if not character or n < share * len(values):
            break
        beginning += character
    return beginning


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, value``, by start, then by the order of kinds."""
    found = []
    folded = text.lower() if text.isascii() else text.casefold()
    if any(name in folded for name in _ASSIGN_NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append((m.start(), m.end(), "assign", m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append((m.start(), m.end(), "access", m[0]))
    for m in _LONG_HEX.finditer(text):
        found.append((m.start(), m.end(), "hex", m[0]))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class State:
    """A state: how often it was reached, how often each character (or the end) followed, and where to."""

    reached: int = 0
    counts: Counter = field(default_factory=Counter)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton from example strings, by merging states of their prefix tree."""

    def __init__(self, values: list[str], alpha: float) -> None:
        self.states = [State()]
        for value in values:
            here = 0
            self.states[0].reached += 1
            for character in value:
                self.states[here].counts[character] += 1
                if character not in self.states[here].to:
                    self.states[here].to[character] = len(self.states)
                    self.states.append(State())
                here = self.states[here].to[character]
                self.states[here].reached += 1
            self.states[here].counts[END] += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _merge_all(self) -> None:
        """Settled states grow from the root; each state next to them is merged into one of them or settles."""
        settled, waiting = [0], sorted(self.states[0].to.values())
        while waiting:
            candidate = waiting.pop(0)
            for state in settled:
                if self._compatible(state, candidate):
                    self._redirect(settled, candidate, state)
                    self._fold(state, candidate)
                    break
            else:
                settled.append(candidate)
            inside = set(settled)
            waiting = sorted({t for s in settled for t in self.states[s].to.values()} - inside)
        renumber = {old: new for new, old in enumerate(settled)}
        kept = [self.states[old] for old in settled]
        for state in kept:
            state.to = {c: renumber[t] for c, t in state.to.items()}
        self.states = kept

    def _compatible(self, one: int, other: int) -> bool:
        """Hoeffding's bound on every difference of the two states' shares, ends included, and of the states after them.

        A state that was seen too rarely for a test agrees only with one after which
        everything has been seen that follows it.
        """
        pairs = [(one, other)]
        while pairs:
            a, b = (self.states[i] for i in pairs.pop())
            if min(a.reached, b.reached) < SEEN:
                if not b.counts.keys() <= a.counts.keys():
                    return False
            else:
                bound = self.width * (1 / math.sqrt(a.reached) + 1 / math.sqrt(b.reached))
                for character in {*a.counts, *b.counts}:
                    if abs(a.counts[character] / a.reached - b.counts[character] / b.reached) > bound:
                        return False
            # The second state is the root of a tree, so this ends.
            pairs += [(a.to[c], b.to[c]) for c in b.to if c in a.to]
        return True

    def _redirect(self, settled: list[int], old: int, new: int) -> None:
        for state in settled:
            for character, target in self.states[state].to.items():
                if target == old:
                    self.states[state].to[character] = new

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state and the states after it."""
        pairs = [(into, tree)]
        while pairs:
            a, b = (self.states[i] for i in pairs.pop())
            a.reached += b.reached
            a.counts.update(b.counts)
            for character, target in b.to.items():
                if character in a.to:
                    pairs.append((a.to[character], target))
                else:
                    a.to[character] = target

    def log_likelihood(self, value: str) -> float:
        """Of the whole string, its end included; what a state has never seen leads back to the root."""
        here, total = 0, 0.0
        for character in (*value, END):
            state = self.states[here]
            total += math.log((1 - UNSEEN) * state.counts.get(character, 0) / state.reached + UNSEEN)
            here = state.to.get(character, 0)
        return total


@dataclass(frozen=True)
class Format:
    """What a kind's credentials look like: how they begin, and the automaton of their symbols."""

    beginning: str
    automaton: Automaton

    def read(self, value: str, shape: str) -> str:
        """The symbols, with the shared beginning as itself; its characters are shifted so that they are no classes."""
        if self.beginning and value.startswith(self.beginning):
            return "".join(chr(0xE000 + ord(c)) for c in self.beginning) + shape[len(self.beginning) :]
        return shape

    def log_likelihood(self, value: str, shape: str) -> float:
        return self.automaton.log_likelihood(self.read(value, shape))


@dataclass(frozen=True)
class Grammar:
    """Formats by kind with the number of their values and the least score; automata of ordinary tokens with their numbers."""

    formats: dict[str, tuple[Format, float, float]]
    ordinary: list[tuple[Automaton, float]]
    known: dict[tuple, bool] = field(default_factory=dict, compare=False)

    def score(self, kind: str, value: str, shape: str | None = None) -> float:
        """How many more tokens of this shape are to be expected among the kind's credentials than among ordinary ones, as a logarithm.

        Ordinary tokens are what nobody labelled, so some are credentials; with numbers
        in place of shares a few of them don't outweigh the labelled ones.
        """
        form, number, _ = self.formats[kind]
        shape = symbols(value) if shape is None else shape
        usual = [math.log(n) + automaton.log_likelihood(shape) for automaton, n in self.ordinary]
        top = max(usual, default=0.0)
        return math.log(number) + form.log_likelihood(value, shape) - (top + math.log(sum(math.exp(u - top) for u in usual)) if usual else 0.0)

    def accepts(self, value: str) -> bool:
        if not self.formats:
            return False
        shape = symbols(value)
        key = (shape, *(value.startswith(form.beginning) for form, _, _ in self.formats.values()))
        found = self.known.get(key)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[key] = any(self.score(kind, value, shape) >= least for kind, (_, _, least) in self.formats.items())
        return found


def candidates(text: str, base: list[tuple]) -> Iterator[tuple[int, int, str]]:
    """All tokens outside of the base spans, without the full stop of a sentence."""
    ends = [(s[0], s[1]) for s in base]
    for m in CANDIDATE.finditer(text):
        value = m[0].rstrip(".")
        start = m.start()
        if len(value) >= LEAST["assign"] and (not ends or all(start + len(value) <= s or start >= e for s, e in ends)):
            yield start, start + len(value), value


def _sample(found: set[str], most: int) -> list[tuple[int, str]]:
    """The values of the smallest hashes; those of all values are among those of their parts."""
    return heapq.nsmallest(most, ((zlib.crc32(v.encode()), v) for v in found))


def _labelled(limits: Limits):
    """Distinct values of a batch by kind; tokens outside of them are ``mixed`` with digits, else ``word``. Only samples leave."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[str, set[str]] = {}
            for text in frame["text"]:
                if text:
                    spans = base_spans(text)
                    for _, _, kind, value in spans:
                        found.setdefault(kind, set()).add(value)
                    for _, _, value in candidates(text, spans):
                        found.setdefault("word" if value.isalpha() else "mixed", set()).add(value)
            rows = [
                (kind, place, value) for kind, values in found.items()
                for place, value in _sample(values, limits.values if kind in KINDS else limits.ordinary)
            ]
            yield pd.DataFrame(rows, columns=["kind", "place", "value"])

    return read


def _fitted(values: list[str], alphas: tuple[float, ...]) -> Format:
    """From half of the values, at the significance under which the other half is likeliest."""
    learned, held_out = values[::2], values[1::2]
    beginning = shared_beginning(learned)
    plain = Format(beginning, None)
    shapes = [plain.read(v, symbols(v)) for v in learned]
    found = [Format(beginning, Automaton(shapes, alpha)) for alpha in alphas]
    return max(found, key=lambda f: sum(f.log_likelihood(v, symbols(v)) for v in held_out))


def _number(places: list[int], most: int) -> float:
    """How many distinct values there are, from the largest of the smallest hashes."""
    return float(len(places)) if len(places) < most else (most - 1) * 2**32 / (places[-1] + 1)


def learn(docs: DataFrame, limits: Limits = Limits()) -> Grammar:
    """Automata from the values that the base finds in all documents, a bounded number of each kind.

    Which values are read is decided by a hash of the value. Half of them make the
    automaton, the other half chooses its significance. The threshold lies above all held-out
    ordinary tokens but one in a thousand, a quarter of the way to the score that 98 % of
    the held-out credentials reach. A kind with fewer than 20 values makes no automaton,
    and no token of it is added.
    """
    values = docs.select("text").mapInPandas(_labelled(limits), "kind string, place bigint, value string").distinct()
    values = materialise(values)
    read, number = {}, {}
    for kind in (*KINDS, "word", "mixed"):
        most = limits.values if kind in KINDS else limits.ordinary
        rows = values.where(F.col("kind") == kind).orderBy("place", "value").limit(most).collect()
        read[kind] = [row["value"] for row in rows]
        number[kind] = _number([row["place"] for row in rows], most)
    usual = [([symbols(v) for v in read[k][::2]], number[k]) for k in ("word", "mixed")]
    grammar = Grammar({}, [(Automaton(shapes, limits.alphas[-1]), n) for shapes, n in usual if shapes])
    others = read["word"][1::2] + read["mixed"][1::2]
    for kind in KINDS:
        if len(read[kind]) >= LEAST_VALUES:
            grammar.formats[kind] = (_fitted(read[kind], limits.alphas), number[kind], 0.0)
            reached = sorted(grammar.score(kind, v) for v in read[kind][1::2])
            low = reached[len(reached) // 50]
            high = sorted((grammar.score(kind, v) for v in others), reverse=True)
            high = max(high[len(high) // 1000], 0.0) if high else 0.0
            form, n, _ = grammar.formats[kind]
            grammar.formats[kind] = (form, n, high + max(low - high, 4.0) / 4)
    return grammar


def scan(text: str | None, grammar: Grammar) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str]]]:
    """Base spans with values, and all spans, both by start, then by kind as listed."""
    if not text:
        return [], []
    base = base_spans(text)
    extra = [(start, end, LEARNED) for start, end, value in candidates(text, base) if grammar.accepts(value)] if grammar.formats else []
    order = {kind: i for i, kind in enumerate((*KINDS, LEARNED))}
    return base, sorted([s[:3] for s in base] + extra, key=lambda s: (s[0], order[s[2]]))


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def scan_secrets(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive. Null text is the empty
    text and has none. Texts are read as a whole. Repeated rows each get the same
    result. Other columns are not read. An empty table gives an empty result.
    """
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scanned = [scan(text, grammar) for text in frame["text"]]
            counts = [Counter(s[2] for s in base) for base, _ in scanned]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), **{f"n_{k}": [c[k] for c in counts] for k in KINDS},
                "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in scanned],
                "spans": [listed(spans) for _, spans in scanned],
            })

    return docs.select("doc_id", "text").mapInPandas(
        rows, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def masked(text: str | None, grammar: Grammar) -> str | None:
    """The text with each secret replaced by its kind in brackets; overlapping ones by one."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in scan(text, grammar)[1]:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The same table with secrets masked in ``text`` and ``n_chars`` counted anew."""
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: masked(text, grammar))

    text = F.pandas_udf(mask, "string")(F.col("text"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)
