from __future__ import annotations

import re

import pytest
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.operators import graph as G
from corpusloom.operators import ingest as I
from corpusloom.operators import links as K
from corpusloom.operators import plan as PL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "size", "reason", "depth"),
    [
        ("a/node_modules/b/c.js", 10, "dependencies", 1),
        ("bin/tool.js", 10, None, None),
        ("constructor/toString.ts", 10, None, None),
        ("x/Foo.xcodeproj/p", 10, "editor", 1),
        ("Node_Modules/a.js", 10, None, None),
        ("node_modules", 10, None, None),
        (".env.example", 10, None, None),
        (".env.local", 10, "secret", None),
        ("prod.env", 10, "secret", None),
        ("a/YARN.lock", 10, "lockfile", None),
        ("a/x.min.js", 10, "generated", None),
        ("a/.github/ISSUE_TEMPLATE/b.md", 10, "housekeeping", None),
        ("a.ts", 0, "empty", None),
        ("a.ts", 160_001, "too-large", None),
        ("a.yaml", 160_001, "data", None),
        ("a.json", 60_001, "data", None),
        ("a.json", 60_000, None, None),
        ("run.log", 5, "cache", None),
    ],
)
def test_path_verdict(spark, path, size, reason, depth):
    v = one(spark, P.path_verdict(F.col("p"), F.col("s")), p=path, s=size)
    assert (v["reason"], v["dir_depth"]) == (reason, depth)


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c.ts", "a/c.ts"), ("../a", None), ("/a//b/", "a/b"), ("", ""), ("a/../..", None)])
def test_normalize_path(spark, path, want):
    assert one(spark, P.normalize_path(F.col("p")), p=path) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.TS", "ts"), (".env", ""), ("a.b/c", ""), ("x.tar.gz", "gz"), ("a/.x.y", "y")])
def test_extension(spark, path, want):
    assert one(spark, P.extension(F.col("p")), p=path) == want


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*.log", "a/b.log", True),
        ("/x", "x", True),
        ("/x", "a/x", False),
        ("docs/", "docs", False),
        ("docs/", "a/docs/b.md", True),
        ("a/**/b", "a/b", True),
        ("a/**/b", "a/x/y/b", True),
        ("**/foo", "x/foo/z", True),
        ("a/*.ts", "a/b/c.ts", False),
        ("a?c", "abc", True),
        ("[ab].c", "b.c", True),
        ("[!ab].c", "b.c", False),
        ("x/**", "x/y", True),
        (r"\#a", "#a", True),
        ("a b ", "a b", True),
    ],
)
def test_rule_regex(pattern, path, hit):
    rule, negated = I.rule_regex(pattern)
    assert not negated and bool(re.search(rule, path)) == hit


def test_rule_regex_of_no_rule_and_negation():
    assert I.rule_regex("# x") is None and I.rule_regex("   ") is None
    assert I.rule_regex("!keep.md")[1]


def test_linguist_hints(spark):
    df = spark.createDataFrame([("r", 1, ".gitattributes", 9, "*.pb.go linguist-generated\n# no\nlib/* linguist-vendored=true\n*.md text\nx linguist-generated=false")], "repo_id string, seq long, path string, size long, content string")
    assert I.linguist_patterns(df).first()["content"] == "*.pb.go\nlib/*"


def test_deeper_rules_win(spark):
    rules = spark.createDataFrame([("r", 1, ".gitignore", 9, "*.md"), ("r", 2, "a/.gitignore", 9, "!k.md")], "repo_id string, seq long, path string, size long, content string")
    files = spark.createDataFrame([("r", "x.md"), ("r", "a/k.md"), ("r", "a/b/k.md"), ("r", "y.ts")], "repo_id string, path string")
    assert {r["path"] for r in I.ignored_paths(files, I.parse_rules(rules)).collect()} == {"x.md"}


def test_decode_text(spark):
    for data, want in ((b"a\r\nb\rc", "a\nb\nc"), (b"a\x00b", None), (b"\xef\xbb\xbfx", "x"), (b"\xff" * 20, None), (b"", "")):
        assert one(spark, I.decode_text(F.col("b")), b=bytearray(data)) == want


def test_greedy_trim_passes_over_what_does_not_fit(spark):
    rows = [("r", 1, "README.md", 5, 5, 0, True), ("r", 2, "big", 90, 90, 9, False), ("r", 3, "mid", 60, 60, 8, False), ("r", 4, "small", 30, 30, 1, False)]
    df = spark.createDataFrame(rows, "repo_id string, seq long, path string, bytes long, chars long, importance int, is_readme boolean")
    assert {r["path"] for r in I.greedy_trim(df, 100).filter("kept").collect()} == {"README.md", "big"}


FILES = {
    "tsconfig.json": "{}",
    "src/app/page.tsx": "import { A } from '@/lib/a';\nimport './page.css';\nexport * from '../ui';",
    "src/lib/a.ts": "const b = require('./b.js')",
    "src/lib/b.ts": "",
    "src/ui/index.tsx": "import('../lib/a')",
    "src/app/page.css": "@import 'base';",
    "src/app/_base.scss": "",
    "pkg/mod.py": "from . import util\nfrom pkg.deep import thing\nimport os, pkg.util",
    "pkg/util.py": "",
    "pkg/deep/__init__.py": "",
    "pkg/deep/thing.py": "",
    "main.rs": "mod net;",
    "net/mod.rs": "",
    "src/x.c": '#include "x.h"',
    "include/x.h": "",
    "lib/t.rb": "require 'u'\nrequire_relative 'v'",
    "lib/u.rb": "",
    "lib/v.rb": "",
    "main.go": 'import (\n "m/core"\n)',
    "core/a.go": "",
    "core/a_test.go": "",
    "j/App.java": "import j.util.Tool;",
    "j/util/Tool.java": "",
    "bin/a.dart": "import 'package:demo/z.dart';",
    "lib/z.dart": "",
    "index.html": '<script type="module" src="/src/app/page.tsx"></script>',
    "p/a.php": "<?php require 'b.php';\nuse App\\Model\\User;",
    "p/b.php": "",
    "app/Model/User.php": "",
}


def test_import_edges_of_all_languages(spark):
    files = spark.createDataFrame([("r", p, c) for p, c in FILES.items()], "repo_id string, path string, content string")
    hints = spark.createDataFrame([("r", "m", ["", "src"], [("App\\", "app")], "demo")], "repo_id string, go_module string, py_roots array<string>, psr4 array<struct<prefix:string,dir:string>>, dart_package string")
    edges = G.import_edges(files, G.candidate_paths(files, None, hints), G.folder_imports(files, hints))
    got = {(r["src"], r["dst"]) for r in edges.collect()}
    assert got == {
        ("src/app/page.tsx", "src/lib/a.ts"), ("src/app/page.tsx", "src/app/page.css"), ("src/app/page.tsx", "src/ui/index.tsx"), ("src/lib/a.ts", "src/lib/b.ts"),
        ("src/ui/index.tsx", "src/lib/a.ts"), ("src/app/page.css", "src/app/_base.scss"), ("pkg/mod.py", "pkg/util.py"), ("pkg/mod.py", "pkg/deep/__init__.py"),
        ("pkg/mod.py", "pkg/deep/thing.py"), ("main.rs", "net/mod.rs"), ("src/x.c", "include/x.h"), ("lib/t.rb", "lib/u.rb"), ("lib/t.rb", "lib/v.rb"),
        ("main.go", "core/a.go"), ("j/App.java", "j/util/Tool.java"), ("bin/a.dart", "lib/z.dart"), ("index.html", "src/app/page.tsx"), ("p/a.php", "p/b.php"),
        ("p/a.php", "app/Model/User.php"),
    }


def test_clean_json(spark):
    text = '{"a": "http://x", // c\n "b": [1, 2,], /* d */ "c": ",}"}'
    import json

    assert json.loads(one(spark, G.clean_json(F.col("t")), t=text)) == {"a": "http://x", "b": [1, 2], "c": ",}"}


def test_excerpts_and_registry(spark):
    text = "\n".join(["import x", *[f"l{i}" for i in range(12)], "use name", *[f"m{i}" for i in range(12)], "again name"])
    f = spark.createDataFrame([("r", "p", text)], "repo_id string, path string, content string")
    w = spark.createDataFrame([("r", "p", "k", ["name"])], "repo_id string, path string, key string, names array<string>")
    assert K.excerpts(f, w, around=1).first()["excerpt"] == "l11\nuse name\nm0\n…\nm11\nagain name"
    assert one(spark, K.is_registry(F.col("t")), t="export const A = 'a';\n" * 9) is True


def test_names_in(spark):
    text = "SET_PAGE useState fetchThing 'field_key' className=\"hero\" `div` A_B"
    assert set(one(spark, K.names_in(F.col("t")), t=text)) == {"SET_PAGE", "fetchThing", "field_key"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), max_size=30), st.integers(5, 60))
def test_chunks_round_trip(parts, most):
    text = "\n".join(parts)
    chunks = PL.chunk_text(text, most)
    assert "\n".join(c["text"] for c in chunks) == text
    assert [c["index"] for c in chunks] == list(range(len(chunks))) and chunks[-1]["end_line"] == len(text.split("\n"))
    for c in chunks:
        assert len(c["text"]) <= most or c["start_line"] == c["end_line"]


def test_chunk_prefers_blank_lines():
    text = "a" * 10 + "\n" + "b" * 10 + "\n\nccc\nddd"
    assert [c["text"] for c in PL.chunk_text(text, 28)] == ["a" * 10 + "\n" + "b" * 10 + "\n", "ccc\nddd"]


def test_split_long_chapters(spark):
    rows = [("r", f"s{i}", "interface", i, i % 3 == 0) for i in range(18)]
    df = spark.createDataFrame(rows, "repo_id string, section_id string, chapter string, ord int, is_screen boolean")
    got = [r["chapter"] for r in PL.split_long_chapters(df).orderBy("ord").collect()]
    assert got == ["interface"] * 6 + ["interface:2"] * 6 + ["interface:3"] * 6


def test_place_pairs_and_move_siblings(spark):
    s = spark.createDataFrame([("r", "a", "interface", 0), ("r", "b", "core", 1), ("r", "c", "interface", 2)], "repo_id string, section_id string, chapter string, ord int")
    p = spark.createDataFrame([("r", "x", 9, "a"), ("r", "y", 10, "gone"), ("r", "z", 11, "a")], "repo_id string, section_id string, ord int, after string")
    assert [(r["section_id"], r["chapter"]) for r in PL.place_pairs(s, p).orderBy("ord").collect()] == [("a", "interface"), ("x", "interface"), ("z", "interface"), ("b", "core"), ("y", "core"), ("c", "interface")]
    t = spark.createDataFrame([("r", n, "interface", i, n.isupper()) for i, n in enumerate("AbCdEf")], "repo_id string, section_id string, chapter string, ord int, is_screen boolean")
    g = spark.createDataFrame([("r", "E", "A", 4)], "repo_id string, section_id string, other string, shared int")
    assert "".join(r["section_id"] for r in PL.move_siblings(t, g).orderBy("ord").collect()) == "AbEfCd"


def test_depths_and_tier_order(spark):
    rows = [("r", "src/app/layout.tsx", "entry", 5, 10, 0, 3), ("r", "src/app/page.tsx", "entry", 9, 10, 0, 0), ("r", "src/api/x.ts", "route", 9, 10, 0, 1), ("r", "src/pages/a.ts", "route", 1, 10, 0, 2)]
    df = spark.createDataFrame(rows, "repo_id string, path string, tier_kind string, importance int, lines int, n_importers int, reach int")
    got = [r["path"] for r in PL.tier_order(df).orderBy("tier_kind", "ord").collect()]
    assert got == ["src/app/layout.tsx", "src/app/page.tsx", "src/pages/a.ts", "src/api/x.ts"]


def test_overflow_sections(spark):
    rows = [("r", i, f"src/a/f{i}.ts", "core", i) for i in range(20)] + [("r", 50, "x.ts", "helper", 1)]
    df = spark.createDataFrame(rows, "repo_id string, seq long, path string, category string, importance int")
    got = {r["section_id"]: len(r["paths"]) for r in PL.overflow_sections(df).collect()}
    assert got == {"group:more:core:src/a:0": 16, "group:more:core:src/a:16": 4, None: 1}


@pytest.mark.parametrize(("n", "want"), [(0, "zero"), (42, "forty-two"), (60, "sixty"), (100, "one hundred"), (999, "nine hundred and ninety-nine"), (1000, "1000"), (-1, "-1")])
def test_number_words(spark, n, want):
    assert one(spark, X.number_words(F.col("n")), n=n) == want


def test_natural_key_of_long_numbers(spark):
    names = ["a" + "9" * 25, "a1" + "0" * 25, "a10" + "0" * 24 + "1", "a2", "a007", "a10b2", "a10b10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(PL.natural_key(F.col("n"))).collect()] == ["a2", "a007", "a10b2", "a10b10", "a" + "9" * 25, "a1" + "0" * 25, "a10" + "0" * 24 + "1"]


def test_natural_key_and_elide(spark):
    names = ["file10", "File2", "file1"]
    df = spark.createDataFrame([(n,) for n in names], ["n"])
    assert [r["n"] for r in df.orderBy(PL.natural_key(F.col("n"))).collect()] == ["file1", "File2", "file10"]
    assert one(spark, PL.elide(F.col("a"), 2), a=["x", "y", "z"]) == "x, y and 1 more"


@pytest.mark.parametrize(
    ("url", "error"),
    [("https://a.example.com/v1", None), ("http://a.example.com", "scheme"), ("https://u:p@a.com", "credentials"), ("https://a.com?x=1", "query"), ("https://localhost/v1", "local"), ("https://10.0.0.1", "private"), ("nonsense", "invalid"), (None, "missing")],
)
def test_relay_target(spark, url, error):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(U.relay_target_error(F.col("u")).alias("e")).first()["e"] == error


@pytest.mark.parametrize(("ip", "private"), [("8.8.8.8", False), ("10.1.1.1", True), ("::1", True), ("::ffff:8.8.8.8", False), ("64:ff9b::a00:1", True), ("2002:a00:1::", True), ("fd00::1", True), ("2606:4700::1", False), ("x", True), ("ff02::1", True)])
def test_private_addresses(ip, private):
    assert U._private(ip) is private


def test_base_urls(spark):
    assert one(spark, U.normalise_base_url(F.col("u")), u=" api.x.com/v1/chat/completions/ ") == "https://api.x.com/v1"
    assert one(spark, U.chat_endpoint(F.col("u")), u="https://a/v1/") == "https://a/v1/chat/completions"
    assert one(spark, X.mask_key(F.col("u")), u="sk-1234567890") == "sk-1…7890"
