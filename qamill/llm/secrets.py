"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials.

The patterns (base kinds) label credentials all over the corpus. For each kind a bounded sample
of them becomes a prefix tree over character classes; statistically compatible states are merged
(ALERGIA, Hoeffding bound) into a probabilistic automaton. Every candidate token of every text is
then scored by its likelihood under the automata against an automaton of ordinary tokens. Tokens
as likely as the labelled ones are reported as kind ``format`` unless a base span covers them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.llm.common import few, first_per_key

#: The base kinds in order. assign: its second group has 6 characters or more.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
HAS_DIGIT = re.compile(r"[0-9]")

SAMPLE = 2000       # labelled credentials per kind, and ordinary tokens, that are learned from
LONGEST = 256       # longer values are not learned from (but are found and scored)
ALPHA = 0.05        # Hoeffding bound of the merge test
MARGIN = math.log(1000.0)  # least log likelihood ratio against ordinary tokens
QUANTILE = 0.02     # of the labelled credentials' likelihood per character, at either end

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_CLASS_SIZES = {"0": 10, "a": 6, "z": 20, "A": 26}


def classes(value: str) -> str:
    """Digits, a-f, g-z and A-Z become one symbol each; other characters stand for themselves."""
    return "".join(
        "0" if "0" <= c <= "9" else "a" if "a" <= c <= "f" else "z" if "g" <= c <= "z"
        else "A" if "A" <= c <= "Z" else c for c in value)


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the credential itself), leftmost and non-overlapping per kind."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return found


class Automaton:
    """A probabilistic automaton: per state the counts of symbols, of endings, and where symbols lead."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        for word in words:
            self._insert(word)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _insert(self, word: str) -> None:
        at = 0
        for symbol in word:
            self.seen[at][symbol] += 1
            if symbol not in self.next[at]:
                self.next[at][symbol] = len(self.next)
                self.next.append({})
                self.seen.append(Counter())
                self.ends.append(0)
            at = self.next[at][symbol]
        self.ends[at] += 1

    def total(self, state: int) -> int:
        return self.seen[state].total() + self.ends[state]

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for symbol in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a][symbol], n, self.seen[b][symbol], m):
                    return False
                if symbol in self.next[a] and symbol in self.next[b]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.seen[a].update(self.seen[b])
            for symbol, child in self.next[b].items():
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], child))
                else:
                    self.next[a][symbol] = child

    def _merge(self) -> None:
        """Blue states (children of settled red ones) join the first compatible red state or settle."""
        red = [0]
        while True:
            settled = set(red)
            edges = [(self.total(child), state, symbol, child) for state in red
                     for symbol, child in self.next[state].items() if child not in settled]
            if not edges:
                break
            _, state, symbol, blue = max(edges, key=lambda e: (e[0], -e[1], e[2]))
            for other in red:
                if self._compatible(other, blue):
                    self.next[state][symbol] = other
                    self._fold(other, blue)
                    break
            else:
                red.append(blue)
        # rows of probabilities for the settled states only
        self.states = {
            s: ({c: math.log((n + 0.1) / (self.total(s) + 2.0)) for c, n in self.seen[s].items()},
                math.log((self.ends[s] + 0.1) / (self.total(s) + 2.0)),
                math.log(0.1 / (self.total(s) + 2.0))) for s in red}

    def score(self, word: str) -> float:
        """Log likelihood of a string of classes; a symbol never seen in a state costs its smoothing."""
        at, score = 0, 0.0
        for symbol in word:
            known, _, unseen = self.states[at]
            score += known.get(symbol, unseen)
            at = self.next[at].get(symbol, at)
        return score + self.states[at][1]


class Model:
    """Automata by kind with the usual range of likelihood per character, and one of ordinary tokens.

    A token may be unlike a credential by being too regular (digits only) as by being too odd.
    """

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.kinds = {}
        for kind, values in sorted(labelled.items()):
            forms = [classes(v) for v in values]
            automaton = Automaton(forms)
            scores = sorted(automaton.score(w) / (len(w) + 1) for w in forms)
            at = int(QUANTILE * len(scores))
            self.kinds[kind] = (automaton, scores[at], scores[-1 - at])
        self.ordinary = Automaton([classes(v) for v in ordinary])

    def score(self, token: str) -> float | None:
        """Best log likelihood ratio over the kinds whose format the token keeps; else None."""
        form = classes(token)
        plain = self.ordinary.score(form)
        best = None
        for automaton, least, most in self.kinds.values():
            own = automaton.score(form)
            typical = least <= own / (len(form) + 1) <= most
            if typical and own - plain >= MARGIN and (best is None or own - plain > best):
                best = own - plain
        return best


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, list[str]], list[str]]:
    """Credentials by base kind and ordinary tokens, at most ``sample`` different ones of each.

    All texts are searched; what is learned from is the bounded sample with the smallest hashes.
    """
    schema = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))

    def values(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = set()
            spans = base_spans(text) if text else []
            for kind, _, end, start in spans:
                if end - start <= LONGEST:
                    found.add((kind, text[start:end]))
            for m in TOKEN.finditer(text or ""):
                if m.end() - m.start() <= LONGEST and not any(s < m.end() and m.start() < e for _, s, e, _ in spans):
                    found.add(("", m[0]))
            out.append(sorted(found))
        return pd.Series(out)

    found = docs.select(F.explode(F.pandas_udf(values, schema)(F.col("text"))).alias("v")).select("v.*").distinct()
    kept = first_per_key(found, "kind", ["value"], sample)
    labelled: dict[str, list[str]] = {}
    for row in few(kept.orderBy("kind", "value"), sample * len(KINDS)):
        labelled.setdefault(row["kind"], []).append(row["value"])
    ordinary = labelled.pop("", [])
    return labelled, ordinary


def scan(text: str | None, model: Model) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text, by start and then kind."""
    if not text:
        return []
    base = base_spans(text)
    out = [(kind, start, end, model.score(text[at:end])) for kind, start, end, at in base]
    covered = sorted((s, e) for _, s, e, _ in base)
    for m in TOKEN.finditer(text):
        if not HAS_DIGIT.search(m[0]) or any(s < m.end() and m.start() < e for s, e in covered):
            continue
        score = model.score(m[0])
        if score is not None:
            out.append(("format", m.start(), m.end(), score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def span_column(text: Column, model: Model, spark) -> Column:
    """Column of spans; the model (bounded by the sample) is sent to every executor once."""
    shared = spark.sparkContext.broadcast(model)
    return F.pandas_udf(lambda texts: pd.Series([scan(t, shared.value) for t in texts]), SPANS)(text)


def learn(docs: DataFrame) -> Model:
    return Model(*labelled_sample(docs))


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and its spans (kind, start, end, score), one row per row of ``docs``.

    Positions are code points, ends exclusive. A null or empty text has no spans; without
    labelled credentials there are no automata and only base spans. Equal rows give equal results;
    other columns are ignored.
    """
    model = model or learn(docs)
    return docs.select("doc_id", span_column(F.col("text"), model, docs.sparkSession).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        of("format").alias("n_format"))


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlapping ones joined) replaced by ``mark``; same columns."""
    model = model or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            pieces, at = [], 0
            for _, start, end, _ in scan(text, shared.value):
                if end <= at:
                    continue
                if start >= at:
                    pieces += [text[at:start], mark]
                at = end
            out.append(text if not pieces else "".join([*pieces, text[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", F.pandas_udf(clean, T.StringType())(F.col("text")))
