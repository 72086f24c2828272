from __future__ import annotations

from corpusloom.narrate import pipeline as N
from corpusloom.plans import ingest as PI
from corpusloom.plans import tour as PT
from pyspark.sql import functions as F

CODE = "\n".join(f"export function step{i}() {{ return {i}; }}" for i in range(60))
REPO = [
    ("README.md", b"# Demo\n"),
    (".gitignore", b"secret_notes.md\n/tmp/\n"),
    (".gitattributes", b"*.gen.txt linguist-generated\n"),
    ("package.json", b'{"main": "src/main.ts", "dependencies": {"next": "1"}, }'),
    ("tsconfig.json", b'{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"#lib/*": ["src/lib/*"]}} }'),
    ("src/main.ts", b"import { App } from './App';\nimport '#lib/store';\n" + CODE.encode()),
    ("src/App.tsx", b"import { go } from './tools/go';\n" + CODE.encode()),
    ("src/lib/store.ts", CODE.encode()),
    ("src/pages/home.tsx", b"import x from '../lib/store';\n" + CODE.encode()),
    ("tools/go.ts", CODE.encode()),
    ("tools/alone.ts", CODE.encode()),
    ("src/bad.ts", b"a\x00b"),
    ("src/blank.ts", b" \n\t"),
    ("src/made.ts", b"// Code generated by x. DO NOT EDIT.\nx"),
    ("notes/a.gen.txt", b"text that was generated"),
    ("secret_notes.md", b"hidden"),
    ("tmp/x.ts", b"let a = 1"),
    ("node_modules/a/b.js", b"x"),
    ("node_modules/c/d.js", b"x"),
    ("logo.png", b"x"),
    ("tests/test_a.py", b"import os\nassert os\nassert 1\n"),
]


def entries(spark):
    rows = [("r", i, p, len(b), bytearray(b)) for i, (p, b) in enumerate(REPO)]
    return spark.createDataFrame(rows, "repo_id string, seq long, path string, size long, bytes binary")


def test_ingest_end_to_end(spark):
    out = PI.ingest(entries(spark))
    files = {r["path"]: r for r in out.files.collect()}
    assert set(files) == {"README.md", "package.json", "tsconfig.json", "src/main.ts", "src/App.tsx", "src/lib/store.ts", "src/pages/home.tsx", "tools/go.ts", "tools/alone.ts", "tests/test_a.py"}
    assert {(r["src"], r["dst"]) for r in out.edges.collect()} == {("src/main.ts", "src/App.tsx"), ("src/main.ts", "src/lib/store.ts"), ("src/pages/home.tsx", "src/lib/store.ts")}
    assert files["src/main.ts"]["category"] == "entry" and files["tools/alone.ts"]["category"] == "script" and files["src/pages/home.tsx"]["category"] == "route"
    skipped = {(r["path"], r["reason"], r["is_dir"]) for r in out.skipped.collect()}
    assert skipped == {("node_modules", "dependencies", True), ("logo.png", "asset", False), ("src/bad.ts", "binary", False), ("src/blank.ts", "empty", False), ("src/made.ts", "generated", False), ("notes/a.gen.txt", "generated", False), ("secret_notes.md", "gitignored", False), ("tmp/x.ts", "gitignored", False)}
    stats = out.stats.first()
    assert (stats["included_files"], stats["skipped_entries"]) == (10, 8) and out.readmes.first()["readme_path"] == "README.md"


def test_ingest_trims_to_budget(spark):
    out = PI.ingest(entries(spark), max_bytes=4000)
    assert "README.md" in {r["path"] for r in out.files.collect()}
    assert {r["reason"] for r in out.skipped.collect()} >= {"limit"}


def test_tour_and_narration(spark):
    got = PI.ingest(entries(spark))
    sections = PT.tour(got.files, got.edges, got.readmes).cache()
    rows = sections.orderBy("ord").collect()
    ids = [r["section_id"] for r in rows]
    assert len(set(ids)) == len(ids) and ids[0] == "file:src/main.ts"
    told = [p for r in rows for p in r["paths"]]
    assert len(told) == len(set(told)) and "README.md" not in told and {"src/lib/store.ts", "src/App.tsx", "tools/go.ts"} <= set(told)
    assert rows[0]["chapter_title"] == "Where it all starts"
    assert {r["chapter"] for r in rows} <= {"start", "core", "interface", "support", "setup"}
    ready = PT.narration_input(sections, got.files, edges=got.edges).cache()
    out = N.narrate(ready, N.StubWriter()).collect()
    assert {r["status"] for r in out} == {"done"} and len(out) == len(ids)
    assert "Related code:\nsrc/App.tsx (is used by this file" in next(r["chunks"][-1] for r in ready.collect() if r["section_id"] == "file:src/main.ts")
    facts = PT.tour_facts(got.files, got.readmes).first()["facts"]
    assert facts.startswith("Languages: TypeScript (66%), TypeScript + React (34%).\nMain dependencies: next.\nTerms to explain once: ") and "the repository has 1 test file." in facts and facts.endswith("README:\n# Demo")
    assert [r["text"] for r in PT.tree_outline(got.files, 3).orderBy("line").collect()] == ["src/", "  lib/", "    store.ts", "(and 9 more files)"]


CATEGORIES = {"src/index.js": "entry", "src/main.jsx": "entry"}


def planned(spark, texts: dict[str, str], repo: str = "r"):
    """Ingested texts as the tour sees them."""
    rows = [(repo, i, p, len(t), bytearray(t.encode())) for i, (p, t) in enumerate(texts.items())]
    return PI.ingest(spark.createDataFrame(rows, "repo_id string, seq long, path string, size long, bytes binary"))


def many(n, start="run"):
    return "\n".join(f"{start}{i} = step({i});" for i in range(n))


def screen(name):
    return (
        f"import {{ connect }} from 'react-redux';\nconst map = d => ({{ a: () => d({{ type: {name}_LOADED }}), b: () => d({{ type: UPDATE_FIELD_AUTH }}), onChangeEmail: 1, onChangePassword: 2, submitForm: 3 }});\n"
        + many(60)
    )


def test_tour_keeps_state_and_similar_screens_together(spark):
    got = planned(spark, {
        "package.json": '{ "dependencies": { "react": "16", "redux": "4" } }',
        "src/index.js": "import App from './App';\n" + many(30),
        "src/App.js": "import Login from './components/Login';\nimport Home from './components/Home';\nimport Register from './components/Register';\n" + many(60),
        "src/components/Login.js": screen("LOGIN"),
        "src/components/Home.js": "const x = HOME_LOADED;\n" + many(70),
        "src/components/Register.js": screen("REGISTER"),
        "src/reducers/auth.js": "export default (s, a) => a.type === UPDATE_FIELD_AUTH ? { ...s, onChangeEmail: 1 } : a.type === LOGIN_LOADED ? s : s;\n" + "\n".join(f"run({i});" for i in range(60)),
    })
    rows = PT.tour(got.files, got.edges, got.readmes).orderBy("ord").collect()
    ids = [r["section_id"] for r in rows]
    at = {p: ids.index(f"file:src/{p}.js") for p in ("components/Login", "components/Register", "components/Home", "reducers/auth")}
    assert at["reducers/auth"] == at["components/Login"] + 1 and at["components/Register"] == at["components/Login"] + 2 and at["components/Home"] > at["components/Register"]
    assert rows[at["reducers/auth"]]["chapter"] == rows[at["components/Login"]]["chapter"]


def test_tour_splits_and_names_chapters(spark):
    pages = [f"src/pages/P{i}.jsx" for i in range(6)]
    texts = {
        "package.json": '{ "dependencies": { "react": "19" } }',
        "public/index.html": "<!doctype html>\n<html>\n<head>\n<title>Demo</title>\n</head>\n<body>\n<div id='root'></div>\n</body>\n</html>",
        "src/main.jsx": "import App from './App';\n" + many(30),
        "src/App.jsx": "\n".join(f"import P{i} from './pages/P{i}';" for i in range(6)) + "\n" + many(60),
    }
    for i, p in enumerate(pages):
        texts[p] = f"import A{i} from '../components/A{i}';\nimport B{i} from '../components/B{i}';\n" + many(60, f"p{i}_")
        texts[f"src/components/A{i}.jsx"], texts[f"src/components/B{i}.jsx"] = many(60, f"a{i}_"), many(60, f"b{i}_")
    got = planned(spark, texts)
    rows = PT.tour(got.files, got.edges, got.readmes).orderBy("ord").collect()
    by = {r["section_id"]: r for r in rows}
    assert by["file:public/index.html"]["chapter"] == "start"
    split = [r for r in rows if ":" in r["chapter"]]
    assert split and {r["chapter_title"] for r in split if r["chapter"] == "interface:2"} <= {"More of what you see on screen"}
    assert by["group:config"]["chapter_title"] == "The project setup"


def test_depth_first_order_by_hand(spark, sf_dir):
    from collections import defaultdict

    from corpusloom.operators import graph as G
    from corpusloom.queries.graph import _edges

    m, e = _edges(spark, sf_dir)
    files = m.select("repo_id", "path", (m["seq"] < 20).alias("is_entry")).collect()
    out, into = defaultdict(list), defaultdict(int)
    for r in sorted(e.collect(), key=lambda r: r["ord"]):
        out[r["repo_id"], r["src"]].append(r["dst"])
        into[r["repo_id"], r["dst"]] += 1
    want = {}
    for repo in {r["repo_id"] for r in files}:
        seen: dict[str, int] = {}

        def visit(path, repo=repo, seen=seen):
            if path not in seen:
                seen[path] = len(seen)
                for dst in out[repo, path]:
                    visit(dst)

        for r in sorted((r for r in files if r["repo_id"] == repo and r["is_entry"]), key=lambda r: (into[repo, r["path"]] > 0, r["path"])):
            visit(r["path"])
        want |= {(repo, p): k for p, k in seen.items()}
    from corpusloom.queries import QUERIES

    got = {(r["repo_id"], r["path"]): r["reach"] for r in QUERIES["l4_dfs_reach"](spark, sf_dir).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want
    text = "require('./b');\nimport './a';\nexport { x } from './c';\nconst y = import('./d');"
    assert spark.sql("select 1").select(G.js_specifiers(F.lit(text)).alias("s")).first()["s"] == ["./b", "./a", "./c", "./d"]


def test_outline_by_hand(spark):
    import random

    rng = random.Random(3)
    names = ["a", "B", "c2", "c10", "src"]
    paths = sorted({"/".join([*(rng.choice(names) for _ in range(rng.randrange(5))), rng.choice(["x", "Y", "z10", "z2"]) + ".ts"]) for _ in range(60)})
    root: dict = {}
    for p in paths:
        at = root
        *folders, file = p.split("/")
        for f in folders:
            at = at.setdefault(f, {})
        at[file] = None
    import re

    natural = lambda s: re.sub(r"\d+", lambda m: m[0].rjust(20, "0"), s.lower())
    lines: list[str] = []

    def walk(node, depth):
        for name, below in sorted(node.items(), key=lambda x: (x[1] is None, natural(x[0]), x[0])):
            while below is not None and len(below) == 1 and next(iter(below.values())) is not None:
                only = next(iter(below))
                name, below = f"{name}/{only}", below[only]
            lines.append("  " * depth + name + ("/" if below is not None else ""))
            if below is not None:
                walk(below, depth + 1)

    walk(root, 0)
    files = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    assert [r["text"] for r in PT.tree_outline(files, 500).orderBy("line").collect()] == lines
    short = [r["text"] for r in PT.tree_outline(files, 5).orderBy("line").collect()]
    left = sum(not x.endswith("/") for x in lines[5:])
    assert short == [*lines[:5], f"(and {left} more files)"]
    assert {r["dir"] for r in PT.open_folders(files, small=1, large=10**6).collect()} == {"/".join(p.split("/")[:k]) for p in paths for k in (1, 2) if len(p.split("/")) > k}


def test_chunks_end_where_they_should():
    import random

    from corpusloom.operators.plan import chunk_text

    rng = random.Random(8)
    for _ in range(1500):
        text = "\n".join(rng.choice(["", "  ", "x" * rng.randrange(30), " y" * rng.randrange(9), "zz"]) for _ in range(rng.randrange(1, 40)))
        most, lines = rng.choice([1, 5, 20, 50, 100]), text.split("\n")
        pieces = chunk_text(text, most)
        assert "\n".join(p["text"] for p in pieces) == text and [p["index"] for p in pieces] == list(range(len(pieces)))
        if len(text) <= most:
            assert len(pieces) == 1
            continue
        for p in pieces:
            start, end = p["start_line"] - 1, p["end_line"]
            size = lambda upto, start=start: sum(len(x) + 1 for x in lines[start:upto])
            furthest = max([k for k in range(start + 1, len(lines) + 1) if size(k) <= most], default=start + 1)
            good = [k for k in range(start + 1, min(furthest, len(lines) - 1) + 1) if 0.6 * most < size(k) and not lines[k - 1].strip() and lines[k][:1].strip()]
            assert end == (furthest if furthest == len(lines) or not good else good[-1])
