"""Secret scan: known patterns, and formats inferred as probabilistic automata from the credentials they find.

The values that the patterns label are samples of their kinds' formats. Each kind's sample becomes a prefix tree with
counts; states whose ends, next characters and classes of next characters are statistically compatible (Hoeffding's
bound, along all their continuations) are merged, which leaves a probabilistic automaton, cycles included. Long strings of ordinary text give
one more automaton in the same way. Every candidate of the corpus, a whole run of credential characters, is scored by its
likelihood under each format against its likelihood as ordinary text; formats that win clearly, and explain the candidate
about as well as their own sample, add a span.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.encode import portions
from plumbline.llm.text import whole
from plumbline.session import stored

#: Kinds of the patterns, in their order, with the pattern, the group that holds the value and its least length.
PATTERNS = {
    "assign": (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
ORDINARY = "ordinary"
#: Spans that a format adds are of the kind that taught it, with this before.
LIKE = "like_"
KINDS = [*PATTERNS, *[LIKE + k for k in PATTERNS]]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Distinct values of a kind, and of ordinary text, that formats are inferred from: those with the smallest hash, of at most
#: so many characters.
SAMPLE, ORDINARY_SAMPLE, LONGEST = 2_000, 10_000, 256
#: Fewer labelled values teach no format.
LEAST_SAMPLE = 5
#: One minus the confidence of the bound; weight of a character that a state has not met; characters there are.
ALPHA, UNSEEN, CHARACTERS = 0.01, 1e-3, 68
#: A format must be this much more likely than ordinary text (natural logarithm), and the candidate as likely a character
#: as all but this share of the format's own sample.
LEAST_ODDS, WORST_SHARE = math.log(1e6), 0.01
#: Bytes of text of a batch.
AT_ONCE = 8_000_000

_SPAN = [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
SPAN, VALUE = T.StructType(_SPAN), T.StructType([*_SPAN, T.StructField("value", T.StringType())])


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the patterns' matches by start, then kind as listed; places count code points."""
    found = [(kind, m.start(), m.end(), m.group(group)) for kind, (pattern, group, least) in PATTERNS.items() for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: s[1])


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Whole runs of credential characters that no base span meets."""
    found, k = [], 0
    spans = sorted((a, b) for _, a, b, _ in base)
    reach: list[int] = []  # how far the spans up to each one extend
    for _, b in spans:
        reach.append(max(b, reach[-1] if reach else 0))
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            k += 1
        if not k or reach[k - 1] <= m.start():
            found.append((ORDINARY, m.start(), m.end(), m.group()))
    return found


def character_class(c: str) -> str:
    """Digits, small and capital letters are a class each, and so is every other character."""
    return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c


class Automaton:
    """A probabilistic automaton over characters: per state the visits, the ends and the next states with their counts."""

    def __init__(self) -> None:
        self.visits, self.ends, self.next = [0], [0], [{}]  # type: ignore[var-annotated]

    def add(self, value: str) -> None:
        """Count one more value in the prefix tree."""
        state = 0
        self.visits[0] += 1
        for c in value:
            if c not in self.next[state]:
                self.next[state][c] = [len(self.visits), 0]
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
            edge = self.next[state][c]
            edge[1] += 1
            state = edge[0]
            self.visits[state] += 1
        self.ends[state] += 1

    def _differ(self, a: int, na: int, b: int, nb: int, bound: float) -> bool:
        return abs(a / na - b / nb) > bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether two states agree, and all states that both lead to: in the shares of ends, next characters and their classes."""
        open_pairs, seen = [(a, b)], set()
        while open_pairs:
            a, b = open_pairs.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            na, nb = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], na, self.ends[b], nb, bound):
                return False
            ea, eb = self.next[a], self.next[b]
            classes: dict[str, list[int]] = {}
            for side, edges in enumerate((ea, eb)):
                for c, (_, n) in edges.items():
                    classes.setdefault(character_class(c), [0, 0])[side] += n
            if any(self._differ(x, na, y, nb, bound) for x, y in classes.values()):
                return False
            for c in ea.keys() | eb.keys():
                xa, xb = ea.get(c), eb.get(c)
                if self._differ(xa[1] if xa else 0, na, xb[1] if xb else 0, nb, bound):
                    return False
                if xa and xb:
                    open_pairs.append((xa[0], xb[0]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of a state that still is the root of a tree to another one, all along."""
        open_pairs = [(into, tree)]
        while open_pairs:
            a, b = open_pairs.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (child, count) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += count
                    open_pairs.append((self.next[a][c][0], child))
                else:
                    self.next[a][c] = [child, count]

    def merge(self, alpha: float = ALPHA) -> Automaton:
        """Merge compatible states: each state next to the settled ones joins the first settled one it agrees with, or is settled."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        settled, known = [0], {0}
        # A merge can give a settled state new next states, so all settled ones are looked at until nothing is left.
        found = True
        while found:
            found = False
            for state in settled:
                for c in sorted(self.next[state]):
                    child = self.next[state][c][0]
                    if child in known:
                        continue
                    found = True
                    same = next((s for s in settled if self.compatible(s, child, bound)), None)
                    if same is None:
                        settled.append(child)
                        known.add(child)
                    else:
                        self.next[state][c][0] = same
                        self.fold(same, child)
        return self

    def table(self) -> list[tuple[float, float, dict[str, tuple[int, float]]]]:
        """Per reachable state, numbered anew: log share of ends, log share of an unseen character, next states with log shares."""
        order, number = [0], {0: 0}
        for s in order:
            for c in sorted(self.next[s]):
                child = self.next[s][c][0]
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
        out = []
        for s in order:
            whole_weight = math.log(self.visits[s] + UNSEEN * (CHARACTERS + 1))
            share = lambda n, w=whole_weight: math.log(n + UNSEEN) - w
            out.append((share(self.ends[s]), share(0), {c: (number[t], share(n)) for c, (t, n) in self.next[s].items()}))
        return out


class Format:
    """An inferred format: its automaton's table and the least likelihood a character that passes."""

    def __init__(self, values: list[str]) -> None:
        automaton = Automaton()
        for value in values:
            automaton.add(value)
        self.states = automaton.merge().table()
        own = sorted(self.likelihood(v) / (len(v) + 1) for v in values)
        self.least = own[int(WORST_SHARE * len(own))] if own else 0.0

    def likelihood(self, value: str) -> float:
        """The natural logarithm of a value's probability. A character that a state has not met leaves it as it is."""
        total, states = 0.0, self.states
        end, unseen, edges = states[0]
        for c in value:
            edge = edges.get(c)
            if edge is None:
                total += unseen
            else:
                total += edge[1]
                end, unseen, edges = states[edge[0]]
        return total + end


class Formats:
    """The formats of all kinds and that of ordinary text."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.ordinary = Format(samples.get(ORDINARY, []))
        self.kinds = {k: Format(samples[k]) for k in PATTERNS if len(samples.get(k, [])) >= LEAST_SAMPLE}

    def judge(self, value: str) -> str | None:
        """The kind whose format explains a candidate best, if one does clearly."""
        best, least = None, self.ordinary.likelihood(value) + LEAST_ODDS if self.kinds else math.inf
        for kind, form in self.kinds.items():
            own = form.likelihood(value)
            if own > least and own / (len(value) + 1) >= form.least:
                best, least = LIKE + kind, own
        return best


def found(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id``, ``base`` and ``candidates`` with their values, of every whole text."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), whole(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("base", T.ArrayType(VALUE)), T.StructField("candidates", T.ArrayType(VALUE))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    names = ["kind", "start", "end", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at_once=AT_ONCE):
            base, more = [], []
            for body in batch.column("text").to_pylist():
                spans = base_spans(body)
                base.append([dict(zip(names, s, strict=True)) for s in spans])
                more.append([dict(zip(names, s, strict=True)) for s in candidates(body, spans)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, arrow), pa.array(more, arrow)], names=["id", "base", "candidates"])

    return rows.mapInArrow(run, schema)


def samples(rows: DataFrame, size: int = SAMPLE, ordinary: int = ORDINARY_SAMPLE) -> dict[str, list[str]]:
    """The distinct values with the smallest hash: ``size`` of each kind, ``ordinary`` of the other candidates."""
    values = rows.select(F.explode(F.concat("base", "candidates")).alias("s")).select("s.kind", "s.value").filter(F.char_length("value") <= LONGEST)
    distinct = stored(values.distinct().withColumn("draw", F.xxhash64("value")), "secret-values")
    return {kind: sorted(r["value"] for r in distinct.filter(F.col("kind") == kind).orderBy("draw", "value").limit(n).collect()) for kind, n in [*[(k, size) for k in PATTERNS], (ORDINARY, ordinary)]}


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: the id and ``spans`` (kind, start, end) by start, then kind as in ``KINDS``.

    Base spans are the patterns' matches; ``like_`` spans are candidates that meet no base span and have an inferred
    format. Formats are inferred from at most ``sample`` distinct values of a kind (``ORDINARY_SAMPLE`` of ordinary text),
    drawn by hash from the whole corpus.
    Null and empty texts have no spans. Rows that repeat are treated one by one, other columns are not read, and an empty
    table gives no rows.
    """
    rows = stored(found(docs, id_column, text), "secret-candidates")
    formats = Formats(samples(rows, sample))
    order = {k: i for i, k in enumerate(KINDS)}
    schema = T.StructType([rows.schema["id"], T.StructField("spans", T.ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict: dict[str, str | None] = {}
            out = []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                for s in more:
                    value = s["value"]
                    if value not in verdict:
                        verdict[value] = formats.judge(value)
                    if verdict[value] is not None:
                        spans.append((verdict[value], s["start"], s["end"]))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]]))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, arrow)], names=["id", "spans"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``scan`` as counts of base spans, their digest, and the list of all spans."""
    rows = scan(docs, id_column, text)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col(f"`{id_column}`"), *map(n, PATTERNS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
