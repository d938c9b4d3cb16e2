"""Full-text queries answered from positional postings: a parser that reports errors, and a condition over the positions of a query's words.

Postings hold, for each term, column and document, the sorted positions of the term. They are stored in the order of terms in parts of documents, front-coded and delta-coded by the Parquet writer, so
a query reads the row groups of its words and prefixes and no text. A document's postings of the query's words meet in one row; phrases are intersections of shifted position lists, NEAR is one
pass over the merged lists, AND, OR and NOT combine the answers.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import inverted

WORDS = r"[\p{L}\p{N}]+"


class QueryError(ValueError):
    """A query that can't be parsed."""


class Phrase(NamedTuple):
    """Words that stand together; prefix: the last one may go on. columns: where; none: anywhere."""

    words: tuple[str, ...]
    prefix: bool
    columns: tuple[str, ...]


class Near(NamedTuple):
    """Phrases, in any order, of which the last one to begin has at most gap words between it and the end of each other one."""

    phrases: tuple[Phrase, ...]
    gap: int
    columns: tuple[str, ...]


class Both(NamedTuple):
    left: Node
    right: Node


class Either(NamedTuple):
    left: Node
    right: Node


class Without(NamedTuple):
    left: Node
    right: Node


Node = Phrase | Near | Both | Either | Without
LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(),*:+])|(\w+)|(\S))')


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.sub(r"[\W_]+", " ", text.lower()).split())


class Parser:
    """Precedence from the tightest: words side by side, NOT, AND, OR. Words are letters, digits and underscores; everything else needs quotes."""

    def __init__(self, query: str, columns: tuple[str, ...]) -> None:
        self.columns, self.at, end = columns, 0, len(query.rstrip())
        self.parts: list[tuple[str, str]] = []  # kind (text, mark, word) and value
        at = 0
        while at < end:
            m = LEXEME.match(query, at)
            if m is None or m[4] is not None:
                raise QueryError(f"syntax error near {query[at:].strip()[:20]!r}")
            self.parts.append(("text", m[1].replace('""', '"')) if m[1] is not None else ("mark", m[2]) if m[2] else ("word", m[3]))
            at = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.parts[self.at + ahead] if self.at + ahead < len(self.parts) else ("end", "")

    def take(self, kind: str, *values: str) -> bool:
        if self.peek()[0] == kind and self.peek()[1] in values:
            self.at += 1
            return True
        return False

    def needs(self, mark: str) -> None:
        if not self.take("mark", mark):
            raise QueryError(f"{mark} expected, found {self.peek()[1] or 'the end'!r}")

    def parse(self) -> Node:
        try:
            made = self.either(())
        except RecursionError:
            raise QueryError("too deeply nested") from None
        if self.at < len(self.parts):
            raise QueryError(f"syntax error near {self.peek()[1]!r}")
        return made

    def either(self, within: tuple[str, ...]) -> Node:
        left = self.both(within)
        while self.take("word", "OR"):
            left = Either(left, self.both(within))
        return left

    def both(self, within: tuple[str, ...]) -> Node:
        left = self.negated(within)
        while self.take("word", "AND"):
            left = Both(left, self.negated(within))
        return left

    def negated(self, within: tuple[str, ...]) -> Node:
        left = self.together(within)
        while self.take("word", "NOT"):
            left = Without(left, self.together(within))
        return left

    def together(self, within: tuple[str, ...]) -> Node:
        left = self.one(within)
        while self.peek()[0] == "text" or self.peek() == ("mark", "(") or (self.peek()[0] == "word" and self.peek()[1] not in ("AND", "OR", "NOT")):
            left = Both(left, self.one(within))
        return left

    def one(self, within: tuple[str, ...]) -> Node:
        if self.peek()[0] == "word" and self.peek(1) == ("mark", ":"):
            column = self.peek()[1]
            if column not in self.columns:
                raise QueryError(f"no column {column}")
            self.at += 2
            return self.one((column,) if not within or column in within else ("",))
        if self.take("mark", "("):
            inner = self.either(within)
            self.needs(")")
            return inner
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.at += 2
            return self.near(within)
        return self.phrase(within)

    def near(self, within: tuple[str, ...]) -> Near:
        phrases, gap = [self.phrase(within)], 10
        while self.peek() not in (("mark", ","), ("mark", ")")):
            phrases.append(self.phrase(within))
        if self.take("mark", ","):
            kind, value = self.peek()
            if kind != "word" or not re.fullmatch("[0-9]{1,9}", value):
                raise QueryError(f"a number expected, found {value!r}")
            gap, self.at = int(value), self.at + 1
        self.needs(")")
        return Near(tuple(phrases), gap, within)

    def phrase(self, within: tuple[str, ...]) -> Phrase:
        words: tuple[str, ...] = ()
        while True:
            kind, value = self.peek()
            if kind not in ("text", "word") or (kind == "word" and value in ("AND", "OR", "NOT")):
                raise QueryError(f"a word or phrase expected, found {value or 'the end'!r}")
            words, self.at = words + words_of(value), self.at + 1
            if not self.take("mark", "+"):
                return Phrase(words, self.take("mark", "*") and bool(words), within)


def parse(query: str, columns: tuple[str, ...] = ("content",)) -> Node:
    """The tree of a query, or QueryError."""
    return Parser(query, columns).parse()


def phrases(node: Node, wanted: bool = False) -> Iterator[Phrase]:
    """All phrases of a query; wanted: without those that must not occur."""
    if isinstance(node, Phrase):
        yield node
    elif isinstance(node, Near):
        yield from node.phrases
    else:
        yield from phrases(node.left, wanted)
        if not (wanted and isinstance(node, Without)):
            yield from phrases(node.right, wanted)


def positions(docs: DataFrame, *columns: str) -> DataFrame:
    """term, path, column, positions (from 0, sorted) of each word of some columns of docs, in which a path stands once."""
    each = [inverted.positions(docs, F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", " ")), c) for c in columns]
    return functools.reduce(DataFrame.unionByName, each)


def write_positions(made: DataFrame, to: str) -> None:
    """Each task's positions sorted by term, in small row groups; terms are front-coded and positions delta-coded by the file format, paths by a dictionary. made: of documents that are dealt (inverted.dealt)."""
    coded = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#path": "true", "parquet.enable.dictionary#column": "true"}
    made.sortWithinPartitions("term", "path", "column").write.options(**coded).option("parquet.block.size", 8 << 20).parquet(to)


def write_terms(made: DataFrame, to: str) -> None:
    """The dictionary of terms, sorted and front-coded: a prefix is a range of it."""
    made.repartitionByRange("term").sortWithinPartitions("term").write.options(**{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}).parquet(to)


def within(column: Column, words: dict[tuple[str, bool], str], phrase: Phrase, at: str) -> Column:
    """Where a phrase begins in a column; empty: nowhere."""
    def moved(i: int, word: str) -> Column:
        return F.transform(column[words[word, phrase.prefix and i == len(phrase.words) - 1]][at], lambda x: x - i)

    lists = [moved(i, w) for i, w in enumerate(phrase.words)]
    none = F.array().cast("array<int>")
    return functools.reduce(F.array_intersect, [F.coalesce(x, none) for x in lists]) if lists else none


def close(starts: list[Column], lengths: list[int], gap: int) -> Column:
    """Whether each list has a start that lies near enough before, or at, one start of any of them: one pass over the merged lists."""
    def tag(i: int) -> Column:
        return F.transform(starts[i], lambda x: F.struct(x.alias("at"), F.lit(i).alias("of")))

    tagged = [tag(i) for i in range(len(starts))]
    far = F.lit(-(2**30))
    begun = F.struct(*[far.alias(f"last{i}") for i in range(len(starts))], F.lit(False).alias("found"))

    def step(state: Column, event: Column) -> Column:
        last = [F.when(event["of"] == i, event["at"]).otherwise(state[f"last{i}"]) for i in range(len(starts))]
        near = functools.reduce(lambda a, b: a & b, [x + n + gap >= event["at"] for x, n in zip(last, lengths, strict=True)])
        return F.struct(*[x.alias(f"last{i}") for i, x in enumerate(last)], (state["found"] | near).alias("found"))

    return F.aggregate(F.array_sort(F.flatten(F.array(*tagged))), begun, step)["found"]


def matching(stored: DataFrame, query: str, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """path of each document that a query holds for, from the stored positions."""
    tree = parse(query, columns)
    used = sorted({(w, p.prefix and i == len(p.words) - 1) for p in phrases(tree) for i, w in enumerate(p.words)})
    words = {w: f"w{i}" for i, w in enumerate(used)}
    if not words:
        return stored.select("path").limit(0)
    test = {w: F.col("term").startswith(w[0]) if w[1] else F.col("term") == w[0] for w in used}
    exact = [w for w, prefix in used if not prefix]
    tests = [F.col("term").isin(*exact)] * bool(exact) + [test[w] for w in used if w[1]]
    read = stored.where(functools.reduce(lambda a, b: a | b, tests)).where(F.col("column").isin(*columns))

    def own(w: tuple[str, bool], c: str) -> Column:
        mine = F.when(test[w] & (F.col("column") == c), F.col("positions"))
        return (F.array_sort(F.flatten(F.collect_list(mine))) if w[1] else F.max(mine)).alias(c)

    one = read.groupBy("path").agg(*[F.struct(*[own(w, c) for c in columns]).alias(name) for w, name in words.items()])
    row = F.struct(*words.values())

    def holds(node: Node) -> Column:
        if isinstance(node, Both):
            return holds(node.left) & holds(node.right)
        if isinstance(node, Either):
            return holds(node.left) | holds(node.right)
        if isinstance(node, Without):
            return holds(node.left) & ~holds(node.right)
        places = [c for c in (node.columns or columns) if c]
        if not places:
            return F.lit(False)
        if isinstance(node, Phrase):
            tests = [F.size(within(row, words, node, c)) > 0 for c in places]
        else:
            tests = [close([within(row, words, p, c) for p in node.phrases], [len(p.words) for p in node.phrases], node.gap) for c in places]
        return functools.reduce(lambda a, b: a | b, tests)

    return one.where(holds(tree)).select("path")
