"""Ignore rules of one scope as a trie of path segments: a path meets all rules of the scope in one walk.

An edge is a segment: plain names are looked up, names with wildcards are tried in turn. Rules without a slash, and those
that begin with two stars, hang below a root that is entered again at every segment; two stars inside a rule are a node that
stays as long as it likes. A node lists the rules that end there. Of the rules that a path meets, the last one decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


#: Two stars before a slash; no segment holds one.
DEEP = ("/", None)


@dataclass
class Node:
    plain: dict[str, Node] = field(default_factory=dict)
    wild: dict[str, tuple[re.Pattern, Node]] = field(default_factory=dict)
    #: What follows two stars here: any number of segments may come first.
    deep: Node | None = None
    #: (order of the rule, segments that must follow, whether it un-ignores) of rules that end here.
    ends: list[tuple[int, int, bool]] = field(default_factory=list)

    def at(self, segment: str, pattern: str | None) -> Node:
        if pattern is None:
            return self.plain.setdefault(segment, Node())
        return self.wild.setdefault(segment, (re.compile(pattern), Node()))[1]

    def after(self, segment: str) -> list[Node]:
        found = [self.plain[segment]] if segment in self.plain else []
        return found + [node for rule, node in self.wild.values() if rule.fullmatch(segment)]


def segment_pattern(text: str) -> tuple[str, str | None] | None:
    """One segment of a rule: its plain name, or a regular expression beside it; null where a set of characters holds a slash."""
    out, plain, i, wild = "", "", 0, False
    while i < len(text):
        c = text[i]
        if c == "*":
            while i < len(text) and text[i] == "*":
                i += 1
            out, wild = out + "[^/]*", True
        elif c == "?":
            out, wild, i = out + "[^/]", True, i + 1
        elif c == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            held = character_set(text[i + 1 : end])
            if re.fullmatch(held, "/"):
                return None
            out, wild, i = out + held, True, end + 1
        else:
            i += c == "\\" and i + 1 < len(text)
            out, plain, i = out + re.escape(text[i]), plain + text[i], i + 1
    return (text, out) if wild else (plain, None)


def character_set(body: str) -> str:
    body = "^" + body[1:] if body[0] in "!^" else body
    return "[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]"


class RuleTrie:
    def __init__(self):
        self.root, self.anywhere = Node(), Node()
        #: Rules that need their whole regular expression.
        self.loose: list[tuple[int, re.Pattern, bool]] = []

    def add(self, order: int, pattern: str, regex: str, negated: bool) -> None:
        """A line of a rule file, with what rule_regex makes of it. A line whose sets are no sets fits nothing."""
        line = pattern.rstrip("\r\n")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        line = line[1:] if line.startswith("!") else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        follow = int(line.endswith("/"))
        line = line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        parts = line.split("/")
        if parts[-1] == "**" and len(parts) > 1 and parts[-2] != "**":
            parts, follow = parts[:-1], follow + 1
        try:
            # two stars before a slash stand for any number of segments, elsewhere for one star
            known = [DEEP if p == "**" and k < len(parts) - 1 else segment_pattern(p) for k, p in enumerate(parts)]
            if None in known or "" in parts or re.search(r"\[[^\]]*/|\\/", line):
                self.loose.append((order, re.compile(regex), negated))
                return
            node = self.root if anchored else self.anywhere
            for k in known:
                if k == DEEP:
                    node.deep = node.deep or Node()
                    node = node.deep
                else:
                    node = node.at(*k)
        except re.error:
            return
        node.ends.append((order, follow, negated))

    def last(self, path: str) -> tuple[int, bool] | None:
        """(order, whether it un-ignores) of the last rule that fits a path, which is relative to the scope."""
        segments, best = path.split("/"), None
        now, always = [self.root], [self.anywhere]  # always: what follows two stars that were met
        for k, segment in enumerate(segments):
            left = len(segments) - k - 1
            active = {id(node): node for node in (*now, *always)}
            waiting = list(active.values())
            while waiting:
                node = waiting.pop().deep
                if node is not None and id(node) not in active:
                    active[id(node)] = node
                    always.append(node)
                    waiting.append(node)
            now = [after for node in active.values() for after in node.after(segment)]
            for node in now:
                for order, follow, negated in node.ends:
                    if follow <= left and (best is None or order > best[0]):
                        best = order, negated
        for order, rule, negated in self.loose:
            if (best is None or order > best[0]) and rule.search(path):
                best = order, negated
        return best
