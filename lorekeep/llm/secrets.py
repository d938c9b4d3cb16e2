"""Secret scans by grammar inference.

From labelled credentials of each format a prefix tree is built; its statistically compatible states are merged (Hoeffding
bound on the frequencies of each symbol and of ending, as far as the evidence goes) into a probabilistic automaton. A
candidate starts wherever a format's literal stands in a run of credential characters, or, for a format without one, at the
run's start and after each of its marks; its automaton walks on from there and ends it in a state that samples ended in, at a
length that the format has. The score is the mean over its characters of the log likelihood ratio against ordinary text; of
candidates above the threshold that overlap, the first one with a literal stays, or else the best. The base
patterns are always reported; spans of the method lie outside them, and what a base span leaves of a run is scanned.

The labelled credentials are drawn by a seed from the public formats listed below, a few hundred each, so the automata
have a fixed size; they are inferred once and sent with the tasks. One narrow Python stage, no shuffle.

Defined cases: null or empty text: no spans; texts of any length: linear passes, one text at a time; repeated rows and extra columns don't
matter; empty table: empty result. Offsets count code points.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Fixed patterns. On bytes, so that letter case is ASCII's alone.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=\-]{16,}")

#: Public credential formats: parts of literal text, or a class with a number of characters. Fixed values.
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM, URL = UPPER + LOWER + DIGIT, UPPER + LOWER + DIGIT + "-_"
FORMATS: dict[str, list[str | tuple[str, int, int]]] = {
    "source_host": ["ghp_", (ALNUM, 36, 36)],
    "source_host_app": ["ghs_", (ALNUM, 36, 36)],
    "source_lab": ["glpat-", (URL, 20, 20)],
    "chat_bot": ["xoxb-", (DIGIT, 11, 12), "-", (DIGIT, 11, 12), "-", (ALNUM, 24, 24)],
    "payment": ["sk_live_", (ALNUM, 24, 24)],
    "maps_key": ["AIza", (URL, 35, 35)],
    "mail_key": ["SG.", (URL, 22, 22), ".", (URL, 43, 43)],
    "package_index": ["pypi-AgEIcHlwaS5vcmc", (URL, 50, 90)],
    "package_registry": ["npm_", (ALNUM, 36, 36)],
    "web_token": ["eyJ", (URL, 17, 120), ".eyJ", (URL, 20, 600), ".", (URL, 43, 342)],
    "cloud_secret": [(ALNUM + "+/", 40, 40)],
}
KINDS = (*BASE_KINDS, *FORMATS)
#: Formats whose parts may be longer than the drawn ones.
OPEN = {"package_index", "web_token"}
LITERALS = {kind: parts[0] for kind, parts in FORMATS.items() if isinstance(parts[0], str)}
MARKS = re.compile("[^A-Za-z0-9]")
STARTS = re.compile("|".join(f"(?={re.escape(x)})" for x in LITERALS.values()))


def labelled(seed: int = 7, each: int = 240) -> list[tuple[str, str]]:
    """(format, credential), drawn by the formats; credentials of every format, the same for the same seed."""
    draw = random.Random(seed)
    return [
        (
            kind,
            "".join(p if isinstance(p, str) else "".join(draw.choices(p[0], k=draw.randint(p[1], p[2]))) for p in parts),
        ) for kind, parts in FORMATS.items() for _ in range(each)
    ]


def ordinary(seed: int = 9, many: int = 600) -> list[str]:
    """Runs of credential characters that are none: words of letters and numbers, joined by nothing or by a mark, with and without capitals."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices(LOWER, k=draw.randint(2, 9)))
    out = []
    for _ in range(many):
        mark, form = draw.choice(["", "/", "_", "-", "."]), draw.choice([str, str.capitalize, str])
        parts = [form(word()) if draw.random() < 0.85 else str(draw.randint(0, 9999)) for _ in range(16)]
        out.append(mark.join(parts)[: draw.choice((40, 60, 120))])
    return out


class Automaton:
    """Probabilistic automaton of one format, inferred by merging the states of a prefix tree in breadth-first order."""

    def __init__(self, samples: list[str], alpha: float = 0.05) -> None:
        self.seen, self.ends, self.dots = [0], [0], [0]
        self.next: list[dict[str, int]] | dict[int, dict[str, int]] = [{}]
        self.uses: list[dict[str, int]] = [{}]
        self.bound = math.sqrt(0.5 * math.log(2.0 / alpha))
        for s in samples:
            at = 0
            self.seen[0] += 1
            for c in s:
                self.uses[at][c] = self.uses[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.seen)
                    self.seen.append(0), self.ends.append(0), self.next.append({}), self.uses.append({}), self.dots.append(self.dots[at] + (c == "."))
                at = self.next[at][c]
                self.seen[at] += 1
            self.ends[at] += 1
        red = [0]
        while blue := sorted({x for r in red for x in self.next[r].values()} - set(red)):
            b = blue[0]
            parent, symbol = next((r, c) for r in red for c, x in self.next[r].items() if x == b)
            for r in reversed(red):
                # Only with as many dots before: else a token's parts become one and it may end in any of them.
                if self.dots[r] == self.dots[b] and self.compatible(r, b):
                    self.next[parent][symbol] = r
                    self.fold(r, b)
                    break
            else:
                red.append(b)
        self.states = red
        self.table = {r: ({c: math.log(n / self.seen[r]) for c, n in self.uses[r].items()}, math.log(max(self.ends[r], 0.5) / self.seen[r])) for r in red}
        self.missing = {r: math.log(0.5 / (self.seen[r] + 40.0)) for r in red}
        # What is sent with the tasks: the states that are left.
        self.next, self.ends = {r: self.next[r] for r in red}, {r: self.ends[r] for r in red}
        del self.seen, self.uses, self.dots

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def compatible(self, a: int, b: int) -> bool:
        """Same probabilities of ending and of each symbol, here and from the shared successors on."""
        work, past = [(a, b)], set()
        while work:
            a, b = work.pop()
            if (a, b) in past or a == b:
                continue
            past.add((a, b))
            n1, n2 = self.seen[a], self.seen[b]
            if not n1 or not n2:
                continue
            if self.differ(self.ends[a], n1, self.ends[b], n2) or any(
                self.differ(self.uses[a].get(c, 0), n1, self.uses[b].get(c, 0), n2) for c in self.uses[a].keys() | self.uses[b].keys()
            ):
                return False
            # A single repeated literal is evidence of a fixed part: it joins only its like.
            if min(n1, n2) >= 20 and (len(self.uses[a]) == 1) != (len(self.uses[b]) == 1):
                return False
            work += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, a: int, b: int) -> None:
        work = [(a, b)]
        while work:
            a, b = work.pop()
            if a == b:
                continue
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.uses[b].items():
                self.uses[a][c] = self.uses[a].get(c, 0) + n
            for c, x in self.next[b].items():
                if c in self.next[a]:
                    work.append((self.next[a][c], x))
                else:
                    self.next[a][c] = x

    def log_likelihood(self, s: str) -> float:
        at, total = 0, 0.0
        for c in s:
            row = self.table.get(at)
            if row is None or c not in row[0] or c not in self.next[at]:
                return total + self.missing.get(at, -12.0) - 6.0 * (len(s))
            total += row[0][c]
            at = self.next[at][c]
        return total + self.table[at][1] if at in self.table else total - 12.0


@functools.cache
def inferred() -> Grammar:
    """The grammar, inferred once in a process."""
    return Grammar()


class Grammar:
    """All formats' automata and the model of ordinary text (its letters are likelier than digits, capitals and marks)."""

    def __init__(self, kept: float = 0.995) -> None:
        by: dict[str, list[str]] = {}
        for kind, s in labelled():
            by.setdefault(kind, []).append(s)
        self.automata = {kind: Automaton(s) for kind, s in by.items()}
        self.lengths = {kind: tuple(sum(len(p) if isinstance(p, str) else p[i] for p in parts) for i in (1, 2)) for kind, parts in FORMATS.items()}
        self.lengths |= {kind: (self.lengths[kind][0], math.inf) for kind in OPEN}
        self.plain = {c: math.log(0.85 / 26) for c in LOWER} | {c: math.log(0.06 / 26) for c in UPPER} | {c: math.log(0.04 / 10) for c in DIGIT} | {c: math.log(0.05 / 6) for c in "+/_.=-"}
        self.thresholds = self.learnt(kept)

    def learnt(self, kept: float) -> dict[str, float]:
        """Threshold of each format: halfway between what all but 1 - kept of fresh credentials reach and the best of ordinary runs (0 at least, the even chance)."""
        fresh: dict[str, list[float]] = {kind: [] for kind in FORMATS}
        for kind, s in labelled(seed=8):
            fresh[kind].append(self.walk(kind, s, 0, {})[1])
        plain = {kind: max([0.0, *(self.walk(kind, s, 0, {})[1] for s in ordinary() if kind not in LITERALS)]) for kind in FORMATS}
        return {kind: (sorted(scores)[int((1 - kept) * len(scores))] + plain[kind]) / 2 for kind, scores in fresh.items()}

    def score(self, s: str) -> tuple[str, float]:
        """Best format and its mean log likelihood ratio for each character."""
        ordinary = sum(map(self.plain.__getitem__, s))
        return max(
            (
                (
                    kind,
                    (a.log_likelihood(s) - ordinary) / len(s),
                ) for kind, a in self.automata.items() if self.lengths[kind][0] <= len(s) <= self.lengths[kind][1]
            ),
            key=lambda x: x[1],
            default=("", -99.0),
        )

    def walk(self, kind: str, s: str, start: int, met: dict[tuple[int, int], tuple[list, int]]) -> tuple[int, float]:
        """End and mean log likelihood ratio of the format's candidate at start; (-1, -99.0): none.

        met has the states of earlier walks of an open format in s: a walk that meets one goes on as that did, so each place and state is walked once.
        """
        a, (least, most) = self.automata[kind], self.lengths[kind]
        state, total, path, best = 0, 0.0, [], None
        last = min(len(s), start + most)
        at = start
        while True:
            if kind in OPEN:
                if (at, state) in met:
                    other, nth = met[at, state]
                    end, to = other[-1]
                    best = (end, total + to - other[nth]) if end > at else best
                    path.append(total)
                    break
                met[at, state] = (path, len(path))
                path.append(total)
            if a.ends[state] and (kind in OPEN or at - start >= least):
                bounded = at == len(s) or not s[at].isalnum()
                if kind in OPEN:
                    best = (at, total + a.table[state][1])
                elif (bounded or kind in LITERALS) and (best is None or bounded >= best[2]):
                    best = (at, total + a.table[state][1], bounded)
            if at == last or s[at] not in a.table[state][0] or s[at] not in a.next[state]:
                break
            total += a.table[state][0][s[at]] - self.plain[s[at]]
            state = a.next[state][s[at]]
            at += 1
        if kind in OPEN:
            path.append(best[:2] if best else (-1, 0.0))
        if best is None or best[0] - start < least:
            return -1, -99.0
        return best[0], best[1] / (best[0] - start)

    def found(self, s: str) -> list[tuple[int, int, str]]:
        """Candidates of a run of credential characters above the threshold; of those that overlap, one with a literal goes before one without; of the former the first stays, of the latter the best."""
        scored: dict[tuple[int, str], tuple[float, int]] = {}
        starts = [(m.start(), kind) for m in STARTS.finditer(s) for kind, x in LITERALS.items() if s.startswith(x, m.start())]
        starts += [(i, kind) for kind in FORMATS.keys() - LITERALS.keys() for i in (0, *(m.end() for m in MARKS.finditer(s)))]
        met: dict[str, dict] = {kind: {} for kind in FORMATS}
        for start, kind in starts:
            end, score = self.walk(kind, s, start, met[kind])
            if score >= self.thresholds[kind]:
                scored.setdefault((end, kind), (-score, start))
        out: list[tuple[int, int, str]] = []
        first = lambda x: (False, x[1], x[0]) if x[3] in LITERALS else (True, *x)
        for _, start, end, kind in sorted(((score, start, end, kind) for (end, kind), (score, start) in scored.items()), key=first):
            i = bisect.bisect(out, (start, end, kind))
            if (i == 0 or out[i - 1][1] <= start) and (i == len(out) or end <= out[i][0]):
                out.insert(i, (start, end, kind))
        return out


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the base patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"key")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def spans(text: bytes, grammar: Grammar) -> list[tuple[int, int, str]]:
    """Byte spans of base patterns and of the method, by start, then kind."""
    out = base_spans(text)
    taken, end = [], -1
    for a, b, _ in sorted(out):
        if a > end:
            taken.append([a, b])
        else:
            taken[-1][1] = max(taken[-1][1], b)
        end = taken[-1][1]
    at = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        while a < b:
            # The part up to the next base span, then what follows it.
            inside = at < len(taken) and taken[at][0] < b
            end = max(a, taken[at][0]) if inside else b
            if end - a >= 16:
                out += [(a + x, a + y, kind) for x, y, kind in grammar.found(text[a:end].decode("ascii"))]
            if not inside:
                break
            a = taken[at][1]
            if a < b:
                at += 1
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def in_code_points(text: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not found or text.isascii():
        return found
    places, at, count = {}, 0, 0
    for p in sorted({x for a, b, _ in found for x in (a, b)}):
        count += len(text[at:p].decode())
        at = p
        places[p] = count
    return [(places[a], places[b], kind) for a, b, kind in found]


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    common.bounded_batches(docs.sparkSession)
    grammar = inferred()  # a few hundred states, sent with the task
    fields = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True):
                found = in_code_points(text, spans(text, grammar))
                base = [s for s in found if s[2] in BASE_KINDS]
                rows.append((doc_id, *[sum(s[2] == k for s in base) for k in BASE_KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)
                ] if rows else [pa.array([], f.type) for f in fields],
                schema=fields,
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents"))
