"""Secrets: fixed patterns, and formats inferred from the credentials that these find.

For each kind of labelled credential a probabilistic automaton is inferred: the prefix tree of the values,
whose states are merged while their frequencies agree within Hoeffding's bound.  Every candidate is
then scored by how much likelier its characters are under a credential's automaton than under that of
ordinary strings.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.llm.common import give_back, text_chunks, whole_text

BASE_KINDS = ("assign", "access", "hex")
FORMAT, PLAIN = "format", "plain"
# fixed patterns and least lengths of the base kinds
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX, _RUN = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"), re.compile(r"[A-Za-z0-9+/_.=-]+")
_LEAST = {"assign": 8, "access": 16, "hex": 32}
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# a run that is not a base match is a candidate from this length on
CANDIDATE = 16
# per kind, the distinct values a model learns from (those of the smallest hashes), and the longest of them
SAMPLE, LONGEST = 400, 128
# confidence of the merge test; log odds from which a candidate counts as found: e times likelier as a credential
# (ordinary strings are learned from all runs that no base pattern marks, unmarked credentials among them)
ALPHA, LEAST_SCORE = 0.05, 1.0
# character sets of a segment between separators, the narrowest that holds it counts; and the separators
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SETS = tuple(map(frozenset, (_DIGITS, _DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _LOWER, _UPPER, _DIGITS + _LOWER, _DIGITS + _UPPER, _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER)))
_SEPARATORS = "+/_.=-"
_SEGMENT = re.compile(rf"[{_SEPARATORS}]|[^{_SEPARATORS}]+")
_UNIFORM, _STRAY = -math.log(len(_SETS[-1]) + len(_SEPARATORS)), math.log(0.001 / CANDIDATE)

Span = tuple[int, str, int, str]  # start, kind, end, value


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base matches by start, then kind; and the runs of candidate length that touch none of them."""
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text) if m.end() - m.start() >= CANDIDATE]
    found: list[Span] = []
    lowered = text.lower()
    if any(word in lowered for word in _KEYWORDS):
        found += [(m.start(), "assign", m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    # both patterns stay within a run, which takes all their characters
    for start, end in runs:
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            found += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text, start, end) if m.end() - m.start() >= _LEAST[kind]]
    found.sort(key=lambda span: (span[0], BASE_KINDS.index(span[1])))
    taken = sorted((start, end) for start, _, end, _ in found)
    rest, at, reach = [], 0, 0
    for start, end in runs:
        while at < len(taken) and taken[at][0] < end:
            reach, at = max(reach, taken[at][1]), at + 1
        if reach <= start:
            rest.append((start, FORMAT, end, text[start:end]))
    return found, rest


def symbols_of(value: str) -> list[int]:
    """For each character the set of its segment, or the separator that it is.

    So an automaton sees the form of a value, and its random characters do not spread the prefix tree.
    """
    symbols: list[int] = []
    for segment in _SEGMENT.findall(value):
        if segment in _SEPARATORS:
            symbols.append(-1 - _SEPARATORS.index(segment))
        else:
            chars = set(segment)
            symbols += [next(number for number, members in enumerate(_SETS) if chars <= members)] * len(segment)
    return symbols


class FormatAutomaton:
    """A deterministic probabilistic automaton over character sets, inferred from examples."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        # prefix tree: per state how many values come by, how many end, and where each symbol leads
        self.seen, self.ends, self.next = [0], [0], [{}]
        for value in values:
            state = 0
            self.seen[0] += 1
            for symbol in symbols_of(value):
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                state = self.next[state][symbol]
                self.seen[state] += 1
            self.ends[state] += 1
        # how often each transition is taken; equal to the count of its target until states are merged
        self.taken = [{symbol: self.seen[to] for symbol, to in step.items()} for step in self.next]
        self._merge_states()

    def _differ(self, a: int, of_a: int, b: int, of_b: int) -> bool:
        return abs(a / of_a - b / of_b) > self.slack * (1 / math.sqrt(of_a) + 1 / math.sqrt(of_b))

    def _compatible(self, one: int, other: int) -> bool:
        """Whether two states end and go on alike, and so do the states they lead to."""
        open_pairs = [(one, other)]
        while open_pairs:
            a, b = open_pairs.pop()
            if self._differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.taken[a].get(symbol, 0), self.seen[a], self.taken[b].get(symbol, 0), self.seen[b]):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    open_pairs.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the counts of a tree of states to those of the states that take its place."""
        open_pairs = [(into, tree)]
        while open_pairs:
            a, b = open_pairs.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for symbol, to in self.next[b].items():
                self.taken[a][symbol] = self.taken[a].get(symbol, 0) + self.taken[b][symbol]
                if symbol in self.next[a]:
                    open_pairs.append((self.next[a][symbol], to))
                else:
                    self.next[a][symbol] = to

    def _merge_states(self) -> None:
        """States are settled from the root outwards, the most frequent first; a new one is merged into a settled
        state that it is compatible with, or is settled itself."""
        settled, place = [0], {0}
        while True:
            fringe = [(-self.taken[state][symbol], state, symbol) for state in settled for symbol, to in self.next[state].items() if to not in place]
            if not fringe:
                break
            _, state, symbol = min(fringe)
            new = self.next[state][symbol]
            for old in settled:
                if self._compatible(old, new):
                    self.next[state][symbol] = old
                    self._fold(old, new)
                    break
            else:
                settled.append(new)
                place.add(new)
        number = {state: n for n, state in enumerate(settled)}
        self.next = [{symbol: number[to] for symbol, to in self.next[state].items()} for state in settled]
        self.taken = [self.taken[state] for state in settled]
        self.seen, self.ends = [self.seen[state] for state in settled], [self.ends[state] for state in settled]

    def log_likelihood(self, value: str) -> float:
        """Of the characters and of the end; minus infinity for a format that the automaton does not have."""
        state, total = 0, 0.0
        for symbol in symbols_of(value):
            if symbol not in self.next[state]:
                return -math.inf
            choices = len(_SETS[symbol]) if symbol >= 0 else 1
            total += math.log(self.taken[state][symbol] / self.seen[state] / choices)
            state = self.next[state][symbol]
        return total + math.log(self.ends[state] / self.seen[state]) if self.ends[state] else -math.inf


class FormatModel:
    """One automaton per kind of credential, and one of ordinary strings."""

    def __init__(self, examples: dict[str, list[str]]) -> None:
        self.formats = {kind: FormatAutomaton(values) for kind, values in examples.items() if values}
        self.plain = self.formats.pop(PLAIN, None)

    def score(self, value: str) -> float:
        """Log odds of the likeliest credential format against an ordinary string; minus infinity without a format."""
        best = max((automaton.log_likelihood(value) for automaton in self.formats.values()), default=-math.inf)
        # an ordinary string is now and then one of any characters
        stray = _STRAY + _UNIFORM * len(value)
        plain = self.plain.log_likelihood(value) if self.plain else -math.inf
        return best - max(plain, stray)


def _learnable(kind: str, value: str) -> bool:
    return len(value) <= LONGEST and (kind != PLAIN or len(value) >= CANDIDATE)


def _smallest(values: dict[str, int], most: int) -> dict[str, int]:
    return dict(sorted(values.items(), key=lambda entry: (entry[1], entry[0]))[:most])


def labelled_examples(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[str, list[str]]:
    """Per kind, up to `sample` distinct values: what the base patterns find, and as `plain` the other runs.

    The sample is that of the smallest hashes of the values of all texts, so that it does not depend on
    how the rows lie; values of more than LONGEST characters teach nothing.  At most (kinds x `sample`) values reach the driver.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {kind: {} for kind in (*BASE_KINDS, PLAIN)}
        for batch in batches:
            for chunk in text_chunks(batch.column(0).to_pylist()):
                for whole in chunk:
                    base, rest = base_spans(whole)
                    for kind, value in [(span[1], span[3]) for span in base] + [(PLAIN, span[3]) for span in rest]:
                        if _learnable(kind, value):
                            held[kind][value] = zlib.crc32(value.encode())
                held = {kind: _smallest(values, sample) if len(values) > 4 * sample else values for kind, values in held.items()}
        give_back()
        rows = [(kind, value, rank) for kind, values in held.items() for value, rank in _smallest(values, sample).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], ["kind", "value", "rank"])

    values = docs.select(whole_text(text)).mapInArrow(found, "kind string, value string, rank long").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("rank", "value"))
    chosen = values.withColumn("place", place).filter(F.col("place") <= sample).collect()
    examples: dict[str, list[str]] = {}
    for row in sorted(chosen, key=lambda row: row.place):
        examples.setdefault(row.kind, []).append(row.value)
    return examples


def fit_formats(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> FormatModel:
    """The model of the credentials that the base patterns find in `docs`; without any it finds nothing."""
    return FormatModel(labelled_examples(docs, text, sample))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def with_secrets(df: DataFrame, model: FormatModel, least: float = LEAST_SCORE, text: str = "text", spans: str = "spans") -> DataFrame:
    """Adds `spans`: array of (kind, start, end, score) by start, then kind in the order assign, access, hex, format.

    Places are code points of the whole text, the end exclusive.  Every base match is there, with the score of
    its value; runs of at least CANDIDATE characters that touch no base match are there as `format` if their
    score is at least `least`.  The score is null where no credential has such a format.  A null or empty text has no
    spans.  A column already called `spans` is replaced; all others pass through.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most kinds x SAMPLE x LONGEST states

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    def scanned(texts: pa.Array) -> pa.Array:
        model, rows = shared.value, []
        for chunk in text_chunks(texts.to_pylist()):
            for whole in chunk:
                base, rest = base_spans(whole)
                scored = [(start, kind, end, model.score(value)) for start, kind, end, value in base]
                scored += [span for start, kind, end, value in rest if (span := (start, kind, end, model.score(value)))[3] >= least]
                scored.sort(key=lambda span: (span[0], (*BASE_KINDS, FORMAT).index(span[1])))
                rows.append([{"kind": kind, "start": start, "end": end, "score": score if score > -math.inf else None} for start, kind, end, score in scored])
        give_back()
        return pa.array(rows, pa.list_(_SPAN))

    return df.withColumn(spans, scanned(whole_text(text)))


def is_base(span: Column) -> Column:
    return span["kind"].isin(*BASE_KINDS)


def spans_of(kind: str, spans: str = "spans") -> Column:
    """How many spans are of one kind."""
    return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ",")
