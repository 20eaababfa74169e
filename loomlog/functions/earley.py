"""Weighted context-free grammars and an Earley parser that keeps the highest-scoring parse.

A grammar is text, one rule per line: ``Name: symbol symbol ... @weight``, with ``|`` between alternatives.
Names of rules are nonterminals, every other symbol is a terminal (a token class); ``Name=role`` on the left marks what
the rule spans as a field.  The score of a parse is the sum of its rules' weights.

Parsing is by prefixes: the start symbol may end anywhere, and the best end is kept.  Earley sets depend on the token
classes read so far and on nothing else, so they are kept in a trie over classes: lines of the same shape cost a walk.
An item refers to the set it began in, so that a set lives on only while something began in it or the trie holds it; sets deeper than
``DEPTH`` are not kept in the trie, so a very long line needs memory for what its open rules refer to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Sets of prefixes of up to this many tokens are kept from line to line.
DEPTH = 400

#: (role, first token, token after the last) of the fields of a parse.
Fields = tuple[tuple[str, int, int], ...]


@dataclass(frozen=True)
class Rule:
    left: str
    right: tuple[str, ...]
    weight: float


class Grammar:
    def __init__(self, text: str, start: str):
        self.start = start
        self.rules: dict[str, list[Rule]] = {}
        self.roles: dict[str, str] = {}
        for line in text.strip().splitlines():
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            left, _, right = line.partition(":")
            left, _, role = left.strip().partition("=")
            if role:
                self.roles[left] = role
            for option in re.split(r"\s\|\s", f" {right} "):
                symbols = option.split()
                weight = float(symbols.pop()[1:]) if symbols and symbols[-1].startswith("@") else 0.0
                self.rules.setdefault(left, []).append(Rule(left, tuple(symbols), weight))
        if any(not r.right for rules in self.rules.values() for r in rules):
            raise ValueError("empty rules are not supported; write the alternatives out")


@dataclass(slots=True)
class _Item:
    score: float
    fields: Fields


@dataclass(slots=True, eq=False)
class Node:
    """An Earley set: (rule, dot, set it began in) to the best way to get there; the best complete parse up to here.

    The set itself is written as None in its own keys, which would otherwise keep it alive."""

    items: dict[tuple[Rule, int, "Node | None"], _Item]
    depth: int
    best: tuple[float, int, Fields] | None = None
    next: dict[str, "Node | None"] = field(default_factory=dict)


class Earley:
    def __init__(self, grammar: Grammar, max_nodes: int = 200_000):
        self.grammar = grammar
        self.max_nodes = max_nodes
        self._start()

    def _start(self) -> None:
        self.nodes = 1
        self.root = Node({}, 0)
        for rule in self.grammar.rules[self.grammar.start]:
            self.root.items[rule, 0, None] = _Item(rule.weight, ())
        self._close(self.root)

    def _close(self, node: Node) -> None:
        """Predicts and completes until nothing improves."""
        todo = list(node.items)

        def put(key: tuple[Rule, int, Node | None], score: float, fields: Fields) -> None:
            known = node.items.get(key)
            if known is None or score > known.score + 1e-12:
                node.items[key] = _Item(score, fields)
                todo.append(key)

        while todo:
            key = todo.pop()
            rule, dot, origin = key
            item = node.items[key]
            if dot < len(rule.right):
                symbol = rule.right[dot]
                for r in self.grammar.rules.get(symbol, ()):
                    put((r, 0, None), r.weight, ())
                continue
            fields = item.fields
            if role := self.grammar.roles.get(rule.left):
                fields = (*fields, (role, (origin or node).depth, node.depth))
            if rule.left == self.grammar.start and (origin or node).depth == 0 and (node.best is None or item.score > node.best[0]):
                node.best = item.score, node.depth, fields
            for (r, d, o), waiting in list((origin or node).items.items()):
                if d < len(r.right) and r.right[d] == rule.left:
                    put((r, d + 1, o or origin), waiting.score + item.score, waiting.fields + fields)
        # only items that wait for something are looked at again; finished ones would keep the sets they began in
        node.items = {k: v for k, v in node.items.items() if k[1] < len(k[0].right)}

    def _advance(self, node: Node, kind: str) -> Node | None:
        items = {}
        for (rule, dot, origin), item in node.items.items():
            if dot < len(rule.right) and rule.right[dot] == kind:
                items[rule, dot + 1, origin or node] = _Item(item.score, item.fields)
        if not items:
            return None
        made = Node(items, node.depth + 1)
        self._close(made)
        if node.best is not None and (made.best is None or node.best[0] >= made.best[0]):
            made.best = node.best
        self.nodes += made.depth <= DEPTH
        return made

    def parse(self, kinds) -> tuple[float, int, Fields] | None:
        """(score, tokens used, fields) of the best parse of a prefix of the token classes, which may be lazy."""
        if self.nodes > self.max_nodes:
            self._start()
        node = self.root
        for kind in kinds:
            if kind in node.next:
                after = node.next[kind]
            else:
                after = self._advance(node, kind)
                if node.depth < DEPTH:
                    node.next[kind] = after
            if after is None:
                break
            node = after
        return node.best
