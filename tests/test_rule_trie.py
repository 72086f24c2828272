"""The trie of ignore rules against the rules' own regular expressions."""

from __future__ import annotations

import re

import pytest
from corpusloom.operators import ingest as I
from corpusloom.operators.rule_trie import RuleTrie
from hypothesis import given, settings
from hypothesis import strategies as st

SEGMENT = st.sampled_from(["a", "b", "ab", "a.b", "*", "*.b", "a*", "?", "[ab]", "[!a]", "[a-c]*", "**", "a**", "\\*", "\\*\\*", "\\#a", "x y", "é", ".", "[+-9]", "[z-a]"])
RULE = st.builds(lambda pre, parts, post: pre + "/".join(parts) + post, st.sampled_from(["", "", "/", "!", "!/", "**/"]), st.lists(SEGMENT, min_size=1, max_size=3), st.sampled_from(["", "", "/", "/**", " ", "/**/"]))
PATH = st.lists(st.sampled_from(["a", "b", "c", "ab", "a.b", "x.b", "*", "#a", "x y", "é", ".", "abc"]), min_size=1, max_size=4).map("/".join)


def by_regex(rules, path):
    best = None
    for order, line in enumerate(rules):
        known = I.rule_regex(line)
        try:
            if known and re.search(known[0], path):
                best = order, known[1]
        except re.error:
            pass
    return best


def by_trie(rules, path):
    trie = RuleTrie()
    for order, line in enumerate(rules):
        known = I.rule_regex(line)
        if known:
            trie.add(order, line, *known)
    return trie.last(path)


@settings(max_examples=1500, deadline=None)
@given(st.lists(RULE, min_size=1, max_size=5), PATH)
def test_trie_equals_regular_expressions(rules, path):
    assert by_trie(rules, path) == by_regex(rules, path)


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        (["*.log", "!keep.log"], "a/keep.log", (1, True)), (["a/**/b"], "a/b/x", (0, False)), (["a/**/b"], "a/x/y/b", (0, False)), (["a/**"], "a", None), (["/a"], "b/a", None),
        (["**/a/b/"], "x/a/b", None), (["**/a/b/"], "x/a/b/c", (0, False)), (["dist/", "!dist/keep"], "x/dist/keep", (0, False)), (["**"], "any/thing", (0, False)), (["a//b"], "a/b", None),
    ],
)
def test_known_rules(rules, path, want):
    assert by_trie(rules, path) == want == by_regex(rules, path)


def test_a_walk_does_not_try_every_rule():
    trie = RuleTrie()
    for k in range(3000):
        trie.add(k, f"folder{k}/file.tmp", *I.rule_regex(f"folder{k}/file.tmp"))
        trie.add(3000 + k, f"name{k}", *I.rule_regex(f"name{k}"))
    assert not trie.loose and not trie.root.wild and len(trie.root.plain) == len(trie.anywhere.plain) == 3000
    assert trie.last("folder77/file.tmp") == (77, False) and trie.last("x/name5/y") == (3005, False) and trie.last("x/y") is None


def test_large_repositories_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(I, "PATHS_TOGETHER", 10)
    files = spark.createDataFrame([("r", f"d{i % 7}/f{i}.{'md' if i % 2 else 'ts'}") for i in range(100)] * 2 + [("none", "x.md")], "repo_id string, path string")
    rules = spark.createDataFrame([("r", 1, ".gitignore", 9, "*.md\n[z-a]\n"), ("r", 2, "d3/.gitignore", 9, "!*.md\nf4*")], "repo_id string, seq long, path string, size long, content string")
    got = I.ignored_paths(files, I.parse_rules(rules)).collect()
    want = {("r", f"d{i % 7}/f{i}.{'md' if i % 2 else 'ts'}") for i in range(100) if (i % 2 and i % 7 != 3) or (i % 7 == 3 and str(i).startswith("4"))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
