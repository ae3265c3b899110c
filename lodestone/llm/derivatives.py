"""Parsing with derivatives: a grammar is a hash-consed language expression, a parse state is the derivative so far.

The derivative of a language by a token is the language of what may follow that token. Every expression is a dictionary
from tokens to derivatives, filled on first use, so a parse of tokens seen in such a state before is a chain of dictionary
look-ups. ``EMPTY`` is the empty language: the token that led to it can't stand there. A text is valid when its last
derivative is nullable; when it isn't, though not empty, the text was cut off.

Grammars are written in EBNF without left recursion: ``'x'`` a token, ``[ ]`` optional, ``{ }`` repeated, ``|`` or, ``( )``.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import getitem


class Node(dict):
    __slots__ = ("kind", "a", "b", "nullable", "grammar")
    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other

    def __missing__(self, token):
        d = self.grammar.derive(self, token)
        self[token] = d
        return d


class Grammar:
    """A grammar and its memo. ``most`` bounds the number of derivatives kept; past it the memo is begun anew, which changes
    the time of a parse but never its outcome."""

    def __init__(self, text: str, start: str, most: int = 400_000):
        self.text, self.start_name, self.most = text, start, most
        self.reset()

    def reset(self) -> None:
        self.table: dict[tuple, Node] = {}
        self.empty, self.eps = self.node("empty", None, None, False), self.node("eps", None, None, True)
        self.rules: dict[str, Node] = {}
        for name, body in re.findall(r"(\w+)\s*=\s*((?:'[^']*'|[^;'])*);", self.text):
            self.rules[name] = self.expression(re.findall(r"'[^']*'|\w+|[\[\]{}()|]", body))
        self.start = self.rules[self.start_name]
        self.settle()

    def node(self, kind, a, b, nullable) -> Node:
        key = (kind, a if isinstance(a, str) else id(a), id(b))
        n = self.table.get(key) if kind != "alt" else self.table.get((kind, a))
        if n is None:
            n = Node()
            n.kind, n.a, n.b, n.nullable, n.grammar = kind, a, b, nullable, self
            self.table[key if kind != "alt" else (kind, a)] = n
        return n

    # Constructors; they keep sequences right-nested and alternatives flat, so equal languages meet in one node.
    def seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == "seq":
            return self.seq(a.a, self.seq(a.b, b))
        return self.node("seq", a, b, None)

    def alt(self, parts) -> Node:
        flat: set[Node] = set()
        for p in parts:
            if p.kind == "alt":
                flat |= p.a
            elif p is not self.empty:
                flat.add(p)
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat))
        return self.node("alt", frozenset(flat), None, None)

    def star(self, a: Node) -> Node:
        return self.node("star", a, None, True)

    def token(self, c: str) -> Node:
        return self.node("tok", c, None, False)

    def ref(self, name: str) -> Node:
        return self.node("ref", name, None, None)

    def expression(self, toks: list[str]) -> Node:
        pos = 0

        def alternatives() -> Node:
            nonlocal pos
            parts = [sequence()]
            while pos < len(toks) and toks[pos] == "|":
                pos += 1
                parts.append(sequence())
            return self.alt(parts)

        def sequence() -> Node:
            nonlocal pos
            items = []
            while pos < len(toks) and toks[pos] not in ("|", ")", "]", "}"):
                t = toks[pos]
                pos += 1
                if t in "([{":
                    inner = alternatives()
                    pos += 1
                    items.append(inner if t == "(" else self.alt([inner, self.eps]) if t == "[" else self.star(inner))
                elif t[0] == "'":
                    items.append(self.token(t[1:-1]))
                else:
                    items.append(self.ref(t))
            out = self.eps
            for x in reversed(items):
                out = self.seq(x, out)
            return out

        return alternatives()

    def settle(self) -> None:
        """Nullability of the grammar's own expressions as a least fixed point; that of derivatives follows from theirs."""
        open_nodes = [n for n in self.table.values() if n.nullable is None]
        for n in open_nodes:
            n.nullable = False
        changed = True
        while changed:
            changed = False
            for n in open_nodes:
                if not n.nullable and self.is_nullable(n):
                    n.nullable = changed = True

    def is_nullable(self, n: Node) -> bool:
        if n.kind == "seq":
            return self.nullable(n.a) and self.nullable(n.b)
        if n.kind == "alt":
            return any(self.nullable(x) for x in n.a)
        return self.nullable(self.rules[n.a])

    def nullable(self, n: Node) -> bool:
        if n.nullable is None:
            n.nullable = self.is_nullable(n)
        return n.nullable

    def derive(self, n: Node, t: str) -> Node:
        kind = n.kind
        if kind == "tok":
            return self.eps if n.a == t else self.empty
        if kind == "seq":
            first = self.seq(n.a[t], n.b)
            return self.alt((first, n.b[t])) if self.nullable(n.a) else first
        if kind == "alt":
            return self.alt([x[t] for x in n.a])
        if kind == "star":
            return self.seq(n.a[t], n)
        if kind == "ref":
            return self.rules[n.a][t]
        return self.empty

    def run(self, classes) -> Node:
        """The derivative of the grammar by a whole list of token classes."""
        if len(self.table) > self.most:
            self.reset()
        return reduce(getitem, classes, self.start)

    def failing(self, classes) -> int:
        """Index of the first token whose derivative is empty; the number of tokens when there is none."""
        s = self.start
        for k, c in enumerate(classes):
            s = s[c]
            if s is self.empty:
                return k
        return len(classes)
