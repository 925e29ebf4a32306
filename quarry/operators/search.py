"""Full-text search: parsing, matching and BM25.

On an inverted index all is joins: ``build`` makes two tables, ``postings`` (term, id, col,
positions) and ``lengths`` (id, len); write them sorted by term and a query reads only its
terms' rows. Without one, ``Scan`` answers a single query in one pass over the texts, as
expressions on arrays of terms: nothing is shuffled but a sum for each phrase.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _folds() -> tuple[str, str]:
    """Accented lower-case Latin letters, and their bases."""
    both = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in range(0xC0, 0x250)]
    both = [(a, b) for a, b in both if b.isascii() and a != b and a == a.lower()]
    return "".join(a for a, _ in both), "".join(b for _, b in both)


def folded(c: Column) -> Column:
    """Lower case without accents on Latin letters; plain texts are spared the table."""
    low = F.lower(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(low, *_folds())).otherwise(low)


def tokens_of(c: Column) -> Column:
    """The terms of a text, in order; none of null."""
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def terms_of(text: str) -> list[str]:
    bare = str.maketrans(*_folds())
    return re.findall(r"[^\W_]+", text.lower().translate(bare))


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame


def build(df: DataFrame, row_id: str, columns: Sequence[str]) -> Index:
    """The index of text ``columns``; null texts have no terms (K4)."""
    parts = []
    for name in columns:
        parts.append(df.select(F.col(row_id).alias("id"), F.lit(name).alias("col"), tokens_of(F.col(name)).alias("tokens")))
    tokens = reduce(DataFrame.unionByName, parts)
    lengths = tokens.groupBy("id").agg(F.sum(F.size("tokens")).alias("len"))
    # positions of a term are gathered within one row: no group crosses rows
    spread = tokens.select("id", "col", F.posexplode("tokens").alias("pos", "term"))
    postings = spread.groupBy("term", "id", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return Index(postings, lengths)


# --- queries -----------------------------------------------------------------------------


class SyntaxFault(ValueError):
    """A search text that isn't a query."""


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    column: str | None = None


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int = 10


@dataclass
class Not:
    left: object
    right: object


@dataclass
class All:
    parts: list = field(default_factory=list)


@dataclass
class Any_:
    parts: list = field(default_factory=list)


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|([()+:,])|([\w\u0080-\U0010FFFF]+)(\*)?|(\S))')


class _Parser:
    """NOT binds closest, then AND (also between neighbours), then OR."""

    def __init__(self, text: str, columns: Sequence[str]):
        self.tokens: list[tuple[str, str, bool]] = []
        self.columns, self.at = set(columns), 0
        text = text.rstrip()
        for m in _TOKEN.finditer(text):
            quoted, star, sign, word, word_star, other = m.groups()
            if other:
                raise SyntaxFault(f"syntax error near {other!r}")
            if quoted is not None:
                self.tokens.append(("text", quoted.replace('""', '"'), bool(star)))
            elif sign:
                self.tokens.append((sign, sign, False))
            else:
                self.tokens.append((word if word in ("AND", "OR", "NOT") else "word", word, bool(word_star)))

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self, kind: str | None = None) -> tuple[str, str, bool]:
        if not self.peek() or (kind and self.peek() != kind):
            raise SyntaxFault("syntax error at the end" if not self.peek() else f"syntax error near {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> object:
        out = self.any_of()
        if self.peek():
            self.take("end")
        return out

    def any_of(self) -> object:
        parts = [self.all_of()]
        while self.peek() == "OR":
            self.take()
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else Any_(parts)

    def all_of(self) -> object:
        parts = [self.without()]
        while self.peek() in ("AND", "word", "text", "("):
            if self.peek() == "AND":
                self.take()
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else All(parts)

    def without(self) -> object:
        out = self.unit()
        while self.peek() == "NOT":
            self.take()
            out = Not(out, self.unit())
        return out

    def unit(self) -> object:
        if self.peek() == "(":
            self.take()
            out = self.any_of()
            self.take(")")
            return out
        if self.peek() == "word" and self.tokens[self.at][1] == "NEAR" and self.peek(1) == "(":
            return self.near()
        column = None
        if self.peek() == "word" and self.peek(1) == ":":
            column = self.take()[1]
            if column not in self.columns:
                raise SyntaxFault(f"no such column: {column}")
            self.take(":")
        return self.phrase(column)

    def phrase(self, column: str | None = None) -> Phrase:
        terms: list[str] = []
        while True:
            kind, text, star = self.take()
            if kind not in ("word", "text"):
                raise SyntaxFault(f"syntax error near {text!r}")
            terms += terms_of(text)
            if self.peek() != "+":
                return Phrase(terms, star, column)
            self.take()

    def near(self) -> Near:
        self.take()
        self.take("(")
        phrases, distance = [], 10
        while self.peek() not in (")", ","):
            phrases.append(self.phrase())
        if self.peek() == ",":
            self.take()
            number = self.take("word")[1]
            if not number.isdigit():
                raise SyntaxFault(f"syntax error near {number!r}")
            distance = int(number)
        self.take(")")
        return Near(phrases, distance)


def parse(text: str, columns: Sequence[str] = ()) -> object:
    """The tree of a search text: words, "phrases", prefixes*, column:x, AND, OR, NOT, NEAR(a b, n)."""
    return _Parser(text, columns).parse()


def tolerant(text: str, columns: Sequence[str] = ()) -> object | None:
    """The tree; of a text that is no query, that of its plain words; None if it has none."""
    try:
        return parse(text, columns)
    except SyntaxFault as fault:
        if not str(fault).startswith("syntax error"):
            raise
        words = re.findall(r"[A-Za-z0-9_]+", text)
        return parse(" ".join(f'"{w}"' for w in words), columns) if words else None


# --- matching ----------------------------------------------------------------------------


def _occurrences(index: Index, p: Phrase) -> DataFrame:
    """(id, col, pos) where a phrase begins."""
    rows = index.postings if p.column is None else index.postings.where(F.col("col") == p.column)
    parts = []
    for k, term in enumerate(p.terms):
        hit = F.col("term").startswith(term) if p.prefix and k == len(p.terms) - 1 else F.col("term") == term
        parts.append(rows.where(hit).select("id", "col", F.explode("positions").alias("pos")).select("id", "col", (F.col("pos") - k).alias("pos"), F.lit(k).alias("part")))
    if len(parts) == 1:
        return parts[0].drop("part")
    found = reduce(DataFrame.unionByName, parts).groupBy("id", "col", "pos").agg(F.count_distinct("part").alias("n"))
    return found.where(F.col("n") == len(p.terms)).drop("n")


def matches(index: Index, tree: object) -> DataFrame:
    """Distinct ids that a tree matches; a phrase without terms matches none."""
    if isinstance(tree, Phrase):
        if not tree.terms:
            return index.lengths.select("id").where(F.lit(False))
        if len(tree.terms) == 1:  # no positions needed
            rows = index.postings if tree.column is None else index.postings.where(F.col("col") == tree.column)
            return rows.where(F.col("term").startswith(tree.terms[0]) if tree.prefix else F.col("term") == tree.terms[0]).select("id").distinct()
        return _occurrences(index, tree).select("id").distinct()
    if isinstance(tree, All):
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), [matches(index, p) for p in tree.parts])
    if isinstance(tree, Any_):
        return reduce(DataFrame.unionByName, [matches(index, p) for p in tree.parts]).distinct()
    if isinstance(tree, Not):
        return matches(index, tree.left).join(matches(index, tree.right), "id", "left_anti")
    if isinstance(tree, Near):
        first = _occurrences(index, tree.phrases[0]).select("id", "col", F.col("pos").alias("low"), (F.col("pos") + len(tree.phrases[0].terms)).alias("high"))
        for p in tree.phrases[1:]:  # the span of all must leave no more than ``distance`` terms between
            other, width = _occurrences(index, p), len(p.terms)
            both = first.join(other, ["id", "col"])
            gap = F.greatest(F.col("pos") - F.col("high"), F.col("low") - F.col("pos") - width, F.lit(0))
            first = both.where(gap <= tree.distance).select("id", "col", F.least("low", "pos").alias("low"), F.greatest("high", F.col("pos") + width).alias("high")).distinct()
        return first.select("id").distinct()
    raise TypeError(tree)


def phrases_of(tree: object) -> list[Phrase]:
    """The phrases that count towards a score: those not under NOT's right."""
    if isinstance(tree, Phrase):
        return [tree] if tree.terms else []
    if isinstance(tree, Not):
        return phrases_of(tree.left)
    return [q for p in (tree.phrases if isinstance(tree, Near) else tree.parts) for q in phrases_of(p)]


def scores(index: Index, tree: object) -> DataFrame:
    """(id, score) of matching rows by BM25, negated: smaller is better."""
    wanted = matches(index, tree)
    corpus = index.lengths.agg(F.count("*").alias("rows"), F.avg("len").alias("mean"))
    parts = []
    for p in phrases_of(tree):
        if len(p.terms) == 1:
            rows = index.postings if p.column is None else index.postings.where(F.col("col") == p.column)
            tf = rows.where(F.col("term").startswith(p.terms[0]) if p.prefix else F.col("term") == p.terms[0]).groupBy("id").agg(F.sum(F.size("positions")).alias("tf"))
        else:
            tf = _occurrences(index, p).groupBy("id").agg(F.count("*").alias("tf"))
        df = tf.agg(F.count("*").alias("df"))
        parts.append(tf.join(F.broadcast(df)))  # one row
    if not parts:
        return wanted.withColumn("score", F.lit(0.0))
    hits = reduce(DataFrame.unionByName, parts).join(wanted, "id", "left_semi").join(index.lengths, "id").join(F.broadcast(corpus))  # one row
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hits.groupBy("id").agg((-F.sum(part)).alias("score"))


class Scan:
    """One query over un-indexed texts: the text ``columns`` of ``df``, each row on its own.

    A row's terms are made once and bound to a lambda variable; as columns they would be
    inlined wherever they are used, and made again for each place of a phrase.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.columns, self.rows = list(columns), df

    def _bound(self, f: Callable[[Column], Column]) -> Column:
        terms = F.struct(*[tokens_of(F.col(c)).alias(c) for c in self.columns])
        return F.get(F.transform(F.array(terms), f), F.lit(0))

    def _terms(self, p: Phrase, row: Column) -> list[Column]:
        return [row[c] for c in ([p.column] if p.column else self.columns)]

    @staticmethod
    def _fits(p: Phrase, k: int) -> Callable[[Column], Column]:
        return (lambda t: t.startswith(p.terms[k])) if p.prefix and k == len(p.terms) - 1 else (lambda t: t == p.terms[k])

    def _starts(self, p: Phrase, terms: Column) -> Column:
        """Places where a phrase begins."""
        places = F.sequence(F.lit(0), F.size(terms) - len(p.terms))
        here = lambda i: reduce(lambda a, b: a & b, [self._fits(p, k)(F.get(terms, i + k)) for k in range(len(p.terms))])
        return F.when(F.size(terms) >= len(p.terms), F.filter(places, here)).otherwise(F.array().cast("array<int>"))

    def _holds(self, tree: object, row: Column) -> Column:
        if isinstance(tree, Phrase):
            if not tree.terms:
                return F.lit(False)
            if len(tree.terms) == 1:
                one = [F.exists(t, self._fits(tree, 0)) if tree.prefix else F.array_contains(t, tree.terms[0]) for t in self._terms(tree, row)]
            else:
                one = [F.size(self._starts(tree, t)) > 0 for t in self._terms(tree, row)]
            return reduce(lambda a, b: a | b, one)
        if isinstance(tree, All):
            return reduce(lambda a, b: a & b, [self._holds(p, row) for p in tree.parts])
        if isinstance(tree, Any_):
            return reduce(lambda a, b: a | b, [self._holds(p, row) for p in tree.parts])
        if isinstance(tree, Not):
            return self._holds(tree.left, row) & ~self._holds(tree.right, row)
        if isinstance(tree, Near):
            return reduce(lambda a, b: a | b, [self._near(tree, row[c]) for c in self.columns])
        raise TypeError(tree)

    def _near(self, tree: Near, terms: Column) -> Column:
        first = tree.phrases[0]
        spans = F.transform(self._starts(first, terms), lambda p: F.struct(p.alias("low"), (p + len(first.terms)).alias("high")))
        for phrase in tree.phrases[1:]:
            spans = self._widened(spans, self._starts(phrase, terms), len(phrase.terms), tree.distance)
        return F.size(spans) > 0

    @staticmethod
    def _widened(spans: Column, starts: Column, width: int, distance: int) -> Column:
        """Spans that take in a further phrase with no more than ``distance`` terms between."""

        def of(s: Column) -> Column:
            near = F.filter(starts, lambda p: F.greatest(p - s["high"], s["low"] - p - width, F.lit(0)) <= distance)
            return F.transform(near, lambda p: F.struct(F.least(s["low"], p).alias("low"), F.greatest(s["high"], p + width).alias("high")))

        return F.array_distinct(F.flatten(F.transform(spans, of)))

    def holds(self, tree: object) -> Column:
        """Whether a row matches."""
        return self._bound(lambda row: self._holds(tree, row))

    def _may(self, tree: object) -> Column | None:
        """What every match meets, without its terms being made: a substring, or letters that may be folded. None: nothing."""
        if isinstance(tree, Phrase):
            def one(c: str) -> Column:
                low = F.lower(F.coalesce(F.col(c), F.lit("")))
                return reduce(lambda a, b: a & b, [low.contains(t) for t in tree.terms]) | low.rlike(r"[^\x00-\x7F]")

            return reduce(lambda a, b: a | b, [one(c) for c in ([tree.column] if tree.column else self.columns)]) if tree.terms else F.lit(False)
        if isinstance(tree, Not):
            return self._may(tree.left)
        parts = [self._may(p) for p in (tree.phrases if isinstance(tree, Near) else tree.parts)]
        if isinstance(tree, Any_):
            return None if any(p is None for p in parts) else reduce(lambda a, b: a | b, parts)
        known = [p for p in parts if p is not None]
        return reduce(lambda a, b: a & b, known) if known else None

    def matches(self, tree: object) -> DataFrame:
        """The matching rows; those that lack a term as a substring are never split into terms."""
        may = self._may(tree)
        return self.rows.where(self.holds(tree) if may is None else F.when(may, self.holds(tree)).otherwise(F.lit(False)))

    def scores(self, tree: object) -> DataFrame:
        """The matching rows with ``score``: BM25 over all rows, negated. Two passes over the texts."""
        phrases = phrases_of(tree)

        def facts(row: Column) -> Column:
            total = lambda parts: reduce(lambda a, b: a + b, parts)
            count = lambda p, t: F.size(F.filter(t, self._fits(p, 0))) if len(p.terms) == 1 else F.size(self._starts(p, t))
            tfs = F.array(*[total([count(p, t) for t in self._terms(p, row)]) for p in phrases]) if phrases else F.array().cast("array<int>")
            return F.struct(self._holds(tree, row).alias("hit"), total([F.size(row[c]) for c in self.columns]).alias("len"), tfs.alias("tf"))

        counted = self.rows.withColumn("__f", self._bound(facts))
        corpus = counted.agg(F.count("*").alias("__rows"), F.avg("__f.len").alias("__mean"), F.array(*[F.count_if(F.get("__f.tf", F.lit(k)) > 0) for k in range(len(phrases))]).alias("__df"))
        joined = counted.join(F.broadcast(corpus)).where("__f.hit")  # one row

        def part(k: int) -> Column:
            df, tf = F.get("__df", F.lit(k)), F.get("__f.tf", F.lit(k))
            idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("__rows") - df + 0.5) / (df + 0.5)))
            return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__f.len") / F.col("__mean")))

        score = -reduce(lambda a, b: a + b, [part(k) for k in range(len(phrases))]) if phrases else F.lit(0.0)
        return joined.select(*self.rows.columns, score.alias("score"))


def find(df: DataFrame, index: Index, text: str, row_id: str, name: str, limit: int = 20, internal: Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Matching rows of ``df``: exact names, then names that begin so, then by score, public before internal (Q1, O1)."""
    tree = tolerant(text, columns)
    if tree is None:
        return df.limit(0).withColumn("score", F.lit(0.0))
    hits = df.join(scores(index, tree).withColumnRenamed("id", "__id"), F.col(row_id) == F.col("__id")).drop("__id")
    tier = F.when(F.col(name) == text, 0).when(F.col(name).ilike(f"{text}%"), 1).otherwise(2)
    return hits.orderBy(tier, "score", *([internal] if internal is not None else []), row_id).limit(limit)
