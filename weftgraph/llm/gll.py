"""Generalised LL recognition with graph-structured stacks, run position by position.

A grammar is compiled to one small automaton per nonterminal. The parser keeps all descriptors (automaton state,
stack node) of the current position at once; all calls of a nonterminal at a position share one stack node with
many return edges, so ambiguous grammars and several dialects run together at no extra cost. Stack nodes are
immutable and interned without their position: two positions, in the same file or in another, with the same
descriptors are the same configuration. The step from a configuration by a token is therefore computed once per
worker and looked up afterwards; the automaton of configurations is grown by the data and thrown away, also within a
text and then but for what the present configuration stands on, when it
exceeds ``MOST`` entries.

Grammars must not be left-recursive and no nonterminal but the start may be empty; both are checked.

Notation: ``rule = a 'literal' (b | C)* d? ;`` lower-case names are rules, upper-case names are token classes.
"""

from __future__ import annotations

import re

MOST = 150_000
#: Tokens between two looks at the size of the tables.
RENEW = 4096
_PIECE = re.compile(r"\s*(?:([a-z_]\w*)|([A-Z]\w*)|'((?:\\.|[^'\\])+)'|([=|;()*+?]))")


class Row(dict):
    """A configuration; as a dict it holds the steps computed so far."""

    __slots__ = ("grammar", "moves", "accepts", "kernel")

    def __missing__(self, token: int) -> Row:
        items = self.moves.get(token)
        row = self.grammar.dead if items is None else self.grammar.row(frozenset(items))
        self[token] = row
        return row


class Grammar:
    def __init__(self, text: str, starts: list[str], hard: set[str] = frozenset()):
        self.terms: dict[str, int] = {}
        self.rules: dict[str, int] = {}
        self.eps: list[set[int]] = []
        self.term_edges: list[list[tuple[int, int]]] = []
        self.call_edges: list[list[tuple[str, int]]] = []
        self.rule_start: dict[str, int] = {}
        self.rule_end: dict[str, int] = {}
        self._read(text)
        words = {t for t in self.terms if t[0].isalpha() and t[0].islower() or t[:1] == "_"}
        self.soft = {self.terms[w] for w in words - set(hard)}
        self._flatten()
        self._check(starts)
        self.starts, self.most = starts, MOST
        self._reset()

    # grammar text to automata

    def _state(self) -> int:
        self.eps.append(set()), self.term_edges.append([]), self.call_edges.append([])
        return len(self.eps) - 1

    def term(self, name: str) -> int:
        return self.terms.setdefault(name, len(self.terms))

    def _read(self, text: str) -> None:
        pieces, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _PIECE.match(text, at)
            if not m:
                raise ValueError(f"grammar text at {text[at : at + 40]!r}")
            at = m.end()
            pieces.append(("rule", m[1]) if m[1] else ("term", m[2]) if m[2] else ("lit", re.sub(r"\\(.)", r"\1", m[3])) if m[3] else ("op", m[4]))
        i = 0

        def alternatives(a: int, b: int) -> None:
            nonlocal i
            sequence(a, b)
            while pieces[i] == ("op", "|"):
                i += 1
                sequence(a, b)

        def sequence(a: int, b: int) -> None:
            nonlocal i
            here = a
            while pieces[i] not in (("op", "|"), ("op", ";"), ("op", ")")):
                s, e = self._state(), self._state()
                kind, value = pieces[i]
                i += 1
                if (kind, value) == ("op", "("):
                    alternatives(s, e)
                    i += 1
                elif kind == "rule":
                    self.call_edges[s].append((value, e))
                else:
                    self.term_edges[s].append((self.term(value), e))
                self.eps[here].add(s)
                if pieces[i][0] == "op" and pieces[i][1] in "*+?":
                    mark = pieces[i][1]
                    i += 1
                    if mark in "*+":
                        self.eps[e].add(s)
                    if mark in "*?":
                        self.eps[s].add(e)
                here = e
            self.eps[here].add(b)

        while i < len(pieces):
            name = pieces[i][1]
            i += 2
            if name not in self.rule_start:
                self.rule_start[name], self.rule_end[name] = self._state(), self._state()
            alternatives(self.rule_start[name], self.rule_end[name])
            i += 1
        ends = {e: n for n, e in self.rule_end.items()}
        self.final = [False] * len(self.eps)
        for e in ends:
            self.final[e] = True

    def _flatten(self) -> None:
        """Removes empty edges: each state gets the edges and the finality of all it reaches."""
        n = len(self.eps)
        terms: list[dict[int, set[int]]] = []
        calls: list[set[tuple[str, int]]] = []
        final = []
        for s in range(n):
            seen, todo = {s}, [s]
            while todo:
                for x in self.eps[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            t: dict[int, set[int]] = {}
            for x in seen:
                for k, e in self.term_edges[x]:
                    t.setdefault(k, set()).add(e)
            if (word := self.terms.get("ID")) in t:
                for k in self.soft:
                    t.setdefault(k, set()).update(t[word])
            terms.append(t)
            calls.append({c for x in seen for c in self.call_edges[x]})
            final.append(any(self.final[x] for x in seen))
        self.t, self.c, self.f = terms, calls, final
        self.bare = [final[s] and not terms[s] and not calls[s] for s in range(n)]

    def _check(self, starts: list[str]) -> None:
        for cs in self.c:
            for name, _ in cs:
                if name not in self.rule_start:
                    raise ValueError(f"no rule {name}")
        for name, s in self.rule_start.items():
            if self.f[s] and name not in starts:
                raise ValueError(f"rule {name} may be empty")
        first = {n: {x for x, _ in self.c[s]} for n, s in self.rule_start.items()}
        colour: dict[str, int] = {}

        def visit(n: str) -> None:
            colour[n] = 1
            for x in first[n]:
                if colour.get(x) == 1:
                    raise ValueError(f"left recursion at {x}")
                if x not in colour:
                    visit(x)
            colour[n] = 2

        for n in first:
            if n not in colour:
                visit(n)

    # recognition

    def _reset(self) -> None:
        self.nodes: list[frozenset[tuple[int, int]]] = [frozenset([(-1, -1)])]
        self.node_ids: dict[tuple[str, frozenset], int] = {}
        self.rows: dict[frozenset, Row] = {}
        self.dead = Row()
        self.dead.grammar, self.dead.moves, self.dead.accepts, self.dead.kernel = self, {}, False, frozenset()
        self.start = self.row(frozenset((self.rule_start[s], 0) for s in self.starts))

    def begin(self) -> Row:
        """The configuration before the first token."""
        if len(self.rows) > self.most:
            self._reset()
        return self.start

    def _renew(self, row: Row) -> Row:
        """Empty tables but for what ``row`` stands on: its part of the graph-structured stack, numbered anew. Parents
        have smaller numbers than the nodes above them, so one pass in their order rebuilds it."""
        names = {n: key[0] for key, n in self.node_ids.items()}
        old, todo, used = self.nodes, [n for _, n in row.kernel], {0}
        while todo:
            n = todo.pop()
            if n not in used and n > 0:
                used.add(n)
                todo += [p for _, p in old[n]]
        self._reset()
        new = {0: 0, -1: -1}
        for n in sorted(used - {0}):
            new[n] = self._node(names[n], frozenset((s, new[p]) for s, p in old[n]))
        return self.row(frozenset((s, new[n]) for s, n in row.kernel))

    def _node(self, name: str, edges: frozenset[tuple[int, int]]) -> int:
        key = (name, edges)
        known = self.node_ids.get(key)
        if known is None:
            known = self.node_ids[key] = len(self.nodes)
            self.nodes.append(edges)
        return known

    def row(self, kernel: frozenset[tuple[int, int]]) -> Row:
        known = self.rows.get(kernel)
        if known is not None:
            return known
        row = Row()
        row.grammar, row.accepts, row.kernel = self, False, kernel
        moves: dict[int, set[tuple[int, int]]] = {}
        callers: dict[str, set] = {}
        todo, seen = list(kernel), set(kernel)
        while todo:
            s, n = todo.pop()
            if s < 0:
                row.accepts = True
                continue
            for k, targets in self.t[s].items():
                moves.setdefault(k, set()).update((e, n) for e in targets)
            for name, back in self.c[s]:
                callers.setdefault(name, set()).add((back, n))
            if self.f[s]:
                for item in self.nodes[n]:
                    if item not in seen:
                        seen.add(item)
                        todo.append(item)
        order = list(callers)
        for name in order:
            for inner, back in self.c[self.rule_start[name]]:
                if inner not in callers:
                    callers[inner] = set()
                    order.append(inner)
                callers[inner].add((back, name))
        made: dict[str, int] = {}

        def build(name: str) -> int:
            if name not in made:
                edges: set[tuple[int, int]] = set()
                for back, parent in callers[name]:
                    p = build(parent) if isinstance(parent, str) else parent
                    if self.bare[back]:  # a call in last place returns to its caller's callers
                        edges |= self.nodes[p]
                    else:
                        edges.add((back, p))
                made[name] = self._node(name, frozenset(edges))
            return made[name]

        for name in order:
            n = build(name)
            for k, targets in self.t[self.rule_start[name]].items():
                moves.setdefault(k, set()).update((e, n) for e in targets)
        row.moves = moves
        self.rows[kernel] = row
        return row

    def accepts(self, tokens: list[int]) -> bool:
        row = self.begin()
        for i in range(0, len(tokens), RENEW):
            for t in tokens[i : i + RENEW]:
                row = row[t]
            if len(self.rows) > self.most and row is not self.dead:
                row = self._renew(row)
        return row.accepts
