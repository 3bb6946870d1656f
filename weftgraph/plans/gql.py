"""The graph query language: lexer, parser, and planner to DataFrames.

    FIND kind [WHERE p (AND p)*] [LIMIT n] [OFFSET n]
    TRAVERSE edgeKind FROM name [DEPTH n] [OUTGOING | INCOMING | BOTH]
    PATH FROM name TO name
    COUNT kind [WHERE p (AND p)*] [GROUP BY property]

A predicate is ``property (= | != | CONTAINS | STARTS_WITH) string`` or ``property IN [string ...]``. Values
compare without case; a missing value satisfies no predicate, not even ``!=``. Commas are spaces, ``#`` starts a
comment. Errors are values with a position, not exceptions. ``plan`` builds one lazy DataFrame per part of the
result, so predicates reach the scan and the optimizer sees the whole query.
"""

from __future__ import annotations

import os
import threading
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import first_named, meta
from weftgraph.operators.reach import reach, shortest_path, steps_of

#: The words of the language.
KEYWORDS = {
    "FIND", "TRAVERSE", "PATH", "COUNT", "WHERE", "AND", "NOT", "FROM", "TO", "DEPTH", "OUTGOING", "INCOMING", "BOTH", "LIMIT", "OFFSET", "GROUP", "BY",
    "CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "HAS_MEMBER", "ACCESSES", "OVERRIDES", "BELONGS_TO", "STEP_OF", "HANDLES", "CONTAINS_EDGE",
}
OPERATORS = {"CONTAINS", "STARTS_WITH", "IN"}
DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"
DEFAULT_LIMIT, DEFAULT_DEPTH = 1000, 5


@dataclass(frozen=True)
class Token:
    type: str
    text: str
    pos: int


@dataclass(frozen=True)
class GqlError:
    message: str
    pos: int
    expected: str | None = None
    got: str | None = None


@dataclass(frozen=True)
class Predicate:
    property: str
    op: str
    value: str | tuple[str, ...]


@dataclass(frozen=True)
class Find:
    kind: str
    where: tuple[Predicate, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Traverse:
    edge_kind: str
    start: str
    depth: int | None = None
    direction: str = "OUTGOING"


@dataclass(frozen=True)
class Path:
    start: str
    goal: str


@dataclass(frozen=True)
class Count:
    kind: str
    where: tuple[Predicate, ...] = ()
    group_by: str | None = None


def tokenize(text: str) -> list[Token] | GqlError:
    out: list[Token] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace() or c == ",":
            i += 1
        elif c == "#":
            while i < n and text[i] != "\n":
                i += 1
        elif c in "\"'":
            start, buf = i, []
            i += 1
            while i < n and text[i] != c:
                if text[i] == "\\" and i + 1 < n:
                    i += 1
                    buf.append({"n": "\n", "t": "\t"}.get(text[i], text[i]))
                else:
                    buf.append(text[i])
                i += 1
            if i >= n:
                return GqlError("unterminated string", start)
            i += 1
            out.append(Token("STRING", "".join(buf), start))
        elif c in DIGITS:
            start = i
            while i < n and text[i] in DIGITS:
                i += 1
            out.append(Token("NUMBER", text[start:i], start))
        elif c in "[]*=":
            out.append(Token({"=": "OPERATOR"}.get(c, c), c, i))
            i += 1
        elif text.startswith("!=", i):
            out.append(Token("OPERATOR", "!=", i))
            i += 2
        elif c in LETTERS:
            start = i
            while i < n and (text[i] in LETTERS or text[i] in DIGITS):
                i += 1
            word = text[start:i]
            up = word.upper()
            out.append(Token("OPERATOR" if up in OPERATORS else "KEYWORD" if up in KEYWORDS else "IDENT", up if up in OPERATORS | KEYWORDS else word, start))
        else:
            return GqlError(f"unexpected character {c!r}", i, got=c)
    out.append(Token("EOF", "", n))
    return out


class _Stop(Exception):
    def __init__(self, error: GqlError):
        self.error = error


class _Parser:
    def __init__(self, tokens: list[Token], text: str):
        self.t, self.i, self.text = tokens, 0, text

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def take(self) -> Token:
        self.i += 1
        return self.t[self.i - 1]

    def fail(self, expected: str) -> _Stop:
        got = self.now.text or self.now.type
        return _Stop(GqlError(f"expected {expected}, got {got}", self.now.pos, expected, got))

    def keyword(self, *words: str) -> str | None:
        if self.now.type == "KEYWORD" and self.now.text in words:
            return self.take().text
        return None

    def need(self, word: str) -> None:
        if not self.keyword(word):
            raise self.fail(word)

    def raw(self, t: Token) -> str:
        return self.text[t.pos : t.pos + len(t.text)] if t.type == "KEYWORD" else t.text

    def string(self, what: str = "string") -> str:
        if self.now.type in ("STRING", "IDENT", "KEYWORD"):
            t = self.take()
            return self.raw(t)
        raise self.fail(what)

    def kind(self) -> str:
        if self.now.type == "*":
            self.take()
            return "*"
        if self.now.type in ("IDENT", "KEYWORD"):
            return self.take().text.lower()
        raise self.fail("node kind")

    def number(self) -> int:
        if self.now.type == "NUMBER":
            return int(self.take().text)
        raise self.fail("number")

    def where(self) -> tuple[Predicate, ...]:
        if not self.keyword("WHERE"):
            return ()
        out = [self.predicate()]
        while self.keyword("AND"):
            out.append(self.predicate())
        return tuple(out)

    def predicate(self) -> Predicate:
        if self.now.type not in ("IDENT", "KEYWORD"):
            raise self.fail("property")
        prop = self.take().text.lower()
        if self.now.type != "OPERATOR":
            raise self.fail("operator")
        op = self.take().text
        if op != "IN":
            return Predicate(prop, op, self.string("value"))
        if self.now.type != "[":
            raise self.fail("[")
        self.take()
        values = []
        while self.now.type not in ("]", "EOF"):
            values.append(self.string("value"))
        if self.now.type == "EOF":
            raise self.fail("]")
        self.take()
        return Predicate(prop, op, tuple(values))

    def statement(self) -> Find | Traverse | Path | Count:
        word = self.keyword("FIND", "TRAVERSE", "PATH", "COUNT")
        if word == "FIND":
            kind, where, limit, offset = self.kind(), self.where(), None, None
            while part := self.keyword("LIMIT", "OFFSET"):
                if part == "LIMIT":
                    limit = self.number()
                else:
                    offset = self.number()
            out = Find(kind, where, limit, offset)
        elif word == "TRAVERSE":
            if self.now.type not in ("IDENT", "KEYWORD"):
                raise self.fail("edge kind")
            kind = self.take().text.lower()
            self.need("FROM")
            start, depth = self.string("start name"), None
            if self.keyword("DEPTH"):
                depth = self.number()
            out = Traverse(kind, start, depth, self.keyword("OUTGOING", "INCOMING", "BOTH") or "OUTGOING")
        elif word == "PATH":
            self.need("FROM")
            start = self.string("start name")
            self.need("TO")
            out = Path(start, self.string("target name"))
        elif word == "COUNT":
            kind, where, group = self.kind(), self.where(), None
            if self.keyword("GROUP"):
                self.need("BY")
                if self.now.type not in ("IDENT", "KEYWORD"):
                    raise self.fail("property")
                group = self.take().text.lower()
            out = Count(kind, where, group)
        else:
            raise self.fail("FIND, TRAVERSE, PATH or COUNT")
        if self.now.type != "EOF":
            raise self.fail("end of query")
        return out


def parse(text: str) -> Find | Traverse | Path | Count | GqlError:
    tokens = tokenize(text)
    if isinstance(tokens, GqlError):
        return tokens
    try:
        return _Parser(tokens, text).statement()
    except _Stop as stop:
        return stop.error


def with_limit(ast, limit: int | None):
    """A call-time limit replaces the one of a FIND and leaves other statements alone."""
    return replace(ast, limit=limit) if isinstance(ast, Find) and limit is not None else ast


def property_value(name: str) -> Column:
    if name == "exported":
        return F.col("exported").cast("string")
    return {"name": F.col("name"), "kind": F.col("kind"), "filepath": F.col("file_path")}.get(name, None) if name in ("name", "kind", "filepath") else meta(name)


def condition(p: Predicate) -> Column:
    value = F.lower(property_value(p.property))
    if p.op == "IN":
        return value.isin([v.lower() for v in p.value]) if p.value else F.lit(False)
    given = F.lit(p.value.lower())
    return {"=": value == given, "!=": value != given, "CONTAINS": value.contains(given), "STARTS_WITH": value.startswith(given)}[p.op]


@dataclass
class Result:
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    groups: DataFrame | None = None
    path: DataFrame | None = None
    matched: DataFrame | None = field(default=None, repr=False)

    def total_count(self) -> int:
        """Matches before paging."""
        return self.matched.count() if self.matched is not None else 0


def _matching(kind: str, where: tuple[Predicate, ...], nodes: DataFrame) -> DataFrame:
    out = nodes if kind == "*" else nodes.where(F.col("kind") == kind)
    for p in where:
        out = out.where(condition(p))
    return out


def plan(ast, nodes: DataFrame, edges: DataFrame) -> Result:
    if isinstance(ast, Find):
        hit = _matching(ast.kind, ast.where, nodes)
        return Result(nodes=hit.orderBy("ord", "id").offset(ast.offset or 0).limit(DEFAULT_LIMIT if ast.limit is None else ast.limit), matched=hit)
    if isinstance(ast, Count):
        hit = _matching(ast.kind, ast.where, nodes)
        if ast.group_by is None:
            groups = hit.agg(F.count("*").alias("count")).where(F.col("count") > 0).select(F.lit("total").alias("key"), "count")
        else:
            key = F.coalesce(property_value(ast.group_by), F.lit("(none)"))
            groups = hit.groupBy(key.alias("key")).agg(F.count("*").alias("count"), F.min("ord").alias("__first")).orderBy(F.desc("count"), "__first").select("key", "count")
        return Result(groups=groups, matched=hit)
    if isinstance(ast, Traverse):
        depth = DEFAULT_DEPTH if ast.depth is None else ast.depth
        of_kind = edges.where(F.col("kind") == ast.edge_kind)
        direction = {"OUTGOING": "out", "INCOMING": "in", "BOTH": "both"}[ast.direction]
        ids = nodes.select("id")
        found = reach(first_named(nodes, ast.start).select("id"), steps_of(of_kind, direction=direction), depth, alive=ids)
        inner = found.where(F.col("depth") < depth).select(F.col("id").alias("__x"))
        ends = {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]
        used = None
        for end in ends:
            part = of_kind.join(inner, F.col(end) == F.col("__x"), "left_semi").select("source", "kind", "target")
            used = part if used is None else used.unionByName(part)
        return Result(nodes=nodes.join(found, "id"), edges=used.distinct(), matched=found)
    if isinstance(ast, Path):
        start, goal = first_named(nodes, ast.start).select("id"), first_named(nodes, ast.goal).select("id")
        steps = steps_of(edges, direction="both").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Result(path=shortest_path(start, goal.join(start, "id", "left_anti"), steps))
    raise ValueError(getattr(ast, "message", "not a query"))


def run(text: str, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> Result | GqlError:
    ast = parse(text)
    return ast if isinstance(ast, GqlError) else plan(with_limit(ast, limit), nodes, edges)


#: Fixed value: how long a query may take, in seconds.
DEADLINE = 10.0


def within(df: DataFrame, seconds: float = DEADLINE) -> tuple[list, bool]:
    """(rows that arrived in time, whether the deadline cut the rest off). Rows come partition by partition; at the
    deadline the jobs of the query are cancelled."""
    sc = df.sparkSession.sparkContext
    group, over = f"gql-{uuid.uuid4().hex}", threading.Event()
    sc.setJobGroup(group, "query with a deadline", interruptOnCancel=True)

    def stop() -> None:
        over.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.start()
    rows: list = []
    try:
        for row in df.toLocalIterator():
            if over.is_set():
                break
            rows.append(row)
    except Exception:
        if not over.is_set():
            raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return rows, over.is_set()


def explain(ast, n_nodes: int, n_edges: int) -> dict:
    """Steps and an estimated cost, in nodes or edges touched."""
    if isinstance(ast, Find | Count):
        steps = [f"scan nodes kind={ast.kind}", *[f"filter {p.property} {p.op} {p.value}" for p in ast.where]]
        steps.append(f"limit {ast.limit or DEFAULT_LIMIT}" if isinstance(ast, Find) else f"group by {ast.group_by}" if ast.group_by else "count")
        return {"statement": type(ast).__name__.upper(), "steps": steps, "cost": n_nodes}
    if isinstance(ast, Traverse):
        depth = DEFAULT_DEPTH if ast.depth is None else ast.depth
        return {"statement": "TRAVERSE", "steps": [f"find {ast.start}", f"expand {ast.edge_kind} {ast.direction} depth {depth}"], "cost": min(n_nodes, 4**depth)}
    return {"statement": "PATH", "steps": [f"find {ast.start}", f"find {ast.goal}", "breadth-first search"], "cost": n_nodes + n_edges}


def legacy(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The older pattern form: ``name='X'`` gives all nodes of that name, ``:kind`` the first 50 of a kind; with
    in and out degrees."""
    import re

    if m := re.search(r"name\s*=\s*['\"]([^'\"]+)['\"]", text):
        hit = nodes.where(F.col("name") == m[1])
    elif m := re.search(r":(\w+)", text):
        hit = nodes.where(F.col("kind") == m[1].lower()).orderBy("ord", "id").limit(50)
    else:
        hit = nodes.where(F.lit(False))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    return hit.join(out, "id", "left").join(into, "id", "left").fillna(0, ["n_out", "n_in"])


class SavedQueries:
    """Named queries as ``.gql`` files in one folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def _file(self, name: str) -> str:
        if not name or not all(c.isalnum() or c in "-_" for c in name):
            raise ValueError("a name has letters, digits, - and _ only")
        return os.path.join(self.folder, f"{name}.gql")

    def save(self, name: str, text: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self._file(name), "w", encoding="utf-8") as f:
            f.write(text)

    def load(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        with open(self._file(name), encoding="utf-8") as f:
            return f.read()

    def exists(self, name: str) -> bool:
        return os.path.exists(self._file(name))

    def list(self) -> list[str]:
        return sorted(f[:-4] for f in os.listdir(self.folder) if f.endswith(".gql")) if os.path.isdir(self.folder) else []

    def delete(self, name: str) -> bool:
        if not self.exists(name):
            return False
        os.remove(self._file(name))
        return True
