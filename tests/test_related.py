"""Related code against a plain second form, and narration's helpers."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from corpusloom.narrate import pipeline as N
from corpusloom.operators import related as RL
from corpusloom.queries import tours


def by_hand(files, edges, rare):
    """The choice of links file by file, from plain lists."""
    text = {(r["repo_id"], r["path"]): r["content"] for r in files}
    kind = {(r["repo_id"], r["path"]): r["category"] for r in files}
    holders, names = defaultdict(set), defaultdict(set)
    for r in rare:
        holders[r["repo_id"], r["name"]].add(r["path"])
        names[r["repo_id"], r["path"]].add(r["name"])
    into, out = defaultdict(list), defaultdict(list)
    for r in sorted(edges, key=lambda r: (r["src"], r["dst"])):
        into[r["repo_id"], r["dst"]].append(r["src"])
        out[r["repo_id"], r["src"]].append(r["dst"])
    exports = lambda key: [key[1].split("/")[-1][:-3], *re.findall(r"export function (\w+)", text[key])]

    def lines_of(key, wanted, room, around):
        rows = text[key].split("\n")
        word = re.compile(r"(?<![\w$])(?:" + "|".join(map(re.escape, sorted(wanted))) + r")(?![\w$])") if wanted else None
        hit = [i for i, x in enumerate(rows) if word and len(x) <= 400 and not x.startswith("import") and word.search(x)]
        near = sorted({j for i in hit for j in range(max(0, i - around), min(len(rows) - 1, i + around) + 1) if not rows[j].startswith("import")})
        said, size = [], 0
        for k, i in enumerate(near):
            piece = ("…\n" if k and near[k - 1] != i - 1 else "") + rows[i]
            if size + len(piece) + 1 > room:
                said.append("…")
                break
            said.append(piece)
            size += len(piece) + 1
        return "\n".join(said).strip(" ")

    want = set()
    for repo, path in text:
        key, score, seek, why = (repo, path), defaultdict(float), defaultdict(set), defaultdict(set)
        for n in names[key]:
            for other in holders[repo, n] - {path}:
                score[other] += 4 / len(holders[repo, n])
                seek[other].add(n)
                why[other].add(RL.SHARES)
        for other in into[key]:
            score[other] += 1
            seek[other] |= {x for x in exports(key) if len(x) >= 3}
            why[other].add(RL.USES)
        for other in out[key]:
            score[other] += 1.5
            seek[other] |= {n for n in exports((repo, other)) if len(n) >= 3 and re.search(rf"(?<![\w$]){n}(?![\w$])", text[key])}
            why[other].add(RL.USED)
        chosen, used, taken, hops = [], 0, 0, 0
        for other in sorted(score, key=lambda o: (-round(score[o], 9), o)):
            if taken >= RL.MAX_FILES or used >= RL.TOTAL:
                break
            said = lines_of((repo, other), seek[other], min(RL.PER_FILE, RL.TOTAL - used), 2)
            if not said:
                continue
            shared = sorted(seek[other] & names[key])[:4]
            chosen.append((other, "; ".join(x for x in RL.REASONS if x in why[other]) + (f" ({', '.join(shared)})" if shared else ""), said))
            used, taken = used + len(said), taken + 1
            if other not in into[key] + out[key] and kind[repo, other] in RL.LOGIC and hops < 2 and used < RL.TOTAL:
                via = next((p for p in into[repo, other] if p != path and all(c[0] != p for c in chosen)), None)
                more = via and lines_of((repo, via), {x for x in exports((repo, other)) if len(x) >= 3}, min(RL.HOP_CHARS, RL.TOTAL - used), 1)
                if more:
                    chosen.append((via, f"brings in {other}", more))
                    used, hops = used + len(more), hops + 1
        want |= {(repo, path, i, *c) for i, c in enumerate(chosen)}
    return want


def test_related_code_against_plain_lists(spark, sf_dir):
    files, edges, rare = tours._code(spark, sf_dir)
    want = by_hand(files.collect(), edges.collect(), rare.collect())
    got = {(r["repo_id"], r["path"], r["ord"], r["other"], r["why"], r["text"]) for r in tours.t7_related(spark, sf_dir).collect()}
    assert {x[:5] for x in got} == {x[:5] for x in want} and got == want
    assert any(x[4].startswith("brings in") for x in got) and any(RL.SHARES in x[4] for x in got)


def test_group_excerpts_stay_within_bounds(spark, sf_dir):
    rows = tours.n14_group_excerpts(spark, sf_dir).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["repo_id"], r["section_id"]].append(r)
    assert per
    for (_, section), own in per.items():
        first = int(section.split(":")[1]) * 10
        others = [r["other"] for r in own]
        assert len(set(others)) == len(others) and sum(len(r["text"]) for r in own) <= 3500
        assert not {f"src/m{i}.ts" for i in range(first, first + 10)} & set(others)


@pytest.mark.parametrize(
    ("call", "want"),
    [
        (lambda: N.sentence_case("The Article Editor Form"), "The article editor form"),
        (lambda: N.sentence_case("How the API route talks to OpenAI"), "How the API route talks to OpenAI"),
        (lambda: N.sentence_case("Where React Router fits"), "Where React Router fits"),
        (lambda: N.fallback_title("app/(chat)/api/[id]/chatRoute.ts"), "The chat route file in api"),
        (lambda: N.fallback_title("main.py"), "The main file"),
        (lambda: N.end_at_sentence("One is done. Two is done. Thr"), "One is done. Two is done."),
        (lambda: N.end_at_sentence("Short. And then a very long tail without an end"), "Short. And then a very long tail without an end"),
        (lambda: N.last_paragraph("a\n\n" + "b" * 700), "…" + "b" * 600),
        (lambda: N.halves("a\nb\nc"), ["a\nb", "c"]),
        (lambda: N.halves("x" * 9000), ["x" * 4000 + "\n[… this very long line goes on]"]),
        (lambda: N.halves("x" * 100), None),
        (lambda: N.share_of(200, 300, 1), (200, 300)),
        (lambda: N.share_of(400, 600, 4), (200, 240)),
        (lambda: N.share_of(100, 200, 9), (120, 220)),
    ],
)
def test_text_helpers(call, want):
    assert call() == want


def test_tokens_grow_and_cut_replies_end_at_a_sentence():
    rooms = []

    def writer(system, prompt, room):
        rooms.append(room)
        if room < 40:
            raise N.WriterError("out_of_room")
        return N.Reply("Done here. And more. Cut of", True)

    assert N.ask(writer, "s", "p", 10).text == "Done here. And more." and rooms == [10, 20, 40]
    with pytest.raises(N.WriterError):
        N.ask(lambda *a: (_ for _ in ()).throw(N.WriterError("out_of_room")), "s", "p", 10)


def test_groups_are_cut_once_and_later_failures_keep_what_is_written():
    seen = []

    def small(system, prompt, room):
        seen.append(prompt)
        if len(seen) == 1:
            raise N.WriterError("context")
        return "TITLE: G\nBody of it."

    assert N.draft(small, "g", ["a" * 90 + "\n\n" + "b" * 30], N.Ledger(), None, [], 100, 200, kind="group")["body"] == "Body of it."
    assert seen[1].endswith("a" * 30 + "\n\n" + "b" * 10)

    def second_fails(system, prompt, room):
        if "Part 1:" in prompt:
            assert "The previous part ended with: Body." in prompt
            raise N.WriterError("other")
        return "TITLE: T\nBody."

    assert N.draft(second_fails, "f.ts", ["x", "y"], N.Ledger(), None, [], 100, 200)["body"] == "Body."


def test_refs_results_and_errors(spark, tmp_path):
    from corpusloom.operators import plan as PL
    from corpusloom.sources import results as S
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([("a", 0, "x", "y/z"), ("a", 1, "x/y", "z"), ("b", 0, "q", ""), ("c", 0, "q", "")], "repo_id string, ord int, ref string, subpath string")
    there = spark.createDataFrame([("a", "x/y"), ("a", "main"), ("b", "main")], "repo_id string, ref string")
    assert {tuple(r) for r in S.chosen_refs(asked, there).collect()} == {("a", "x/y", "z", None), ("b", None, None, "bad_ref"), ("c", None, None, "not_found")}
    assert S.load_tours(spark, f"{tmp_path}/none") is None
    tours_ = spark.sql("select 'A b' conv, 'All.' overview, '' closing, array('x') parts union all select 'c', null, '', array('y')")
    S.save_tours(tours_, f"{tmp_path}/t")
    assert [r["conv"] for r in S.load_tours(spark, f"{tmp_path}/t").collect()] == ["A b"]
    S.save_tours(tours_.drop("parts"), f"{tmp_path}/u")
    assert S.load_tours(spark, f"{tmp_path}/u") is None
    S.write_scripts(spark.sql("select 'A b' conv, 'One.\n\nTwo.\n' script"), f"{tmp_path}/s")
    assert [p.read_text() for p in tmp_path.glob("s/tour=a-b/part-*")] == ["One.\n\nTwo.\n"]
    paths = spark.createDataFrame([("b",), ("B",), ("a-1",), ("a",), ("Z",)], "p string")
    assert [r["p"] for r in paths.orderBy(S.path_order(F.col("p"))).collect()] == ["a", "a-1", "b", "B", "Z"]
    codes = spark.createDataFrame([("auth",), ("server",), ("not_found",), (None,)], "c string")
    assert [tuple(r) for r in codes.select(S.error_title(F.col("c")), S.is_resumable(F.col("c")), S.needs_fix(F.col("c"))).collect()] == [
        ("Your API key didn't work", True, True), ("The provider is having trouble", True, False), ("Something went wrong", False, False), ("Something went wrong", False, False),
    ]
    ids = ["file:a/b.ts", "group:config", "group:folder:core:src/lib", "group:folder:core:", "group:more:helper", "group:more:helper:src/ui:16", "group:more:data:rest", "group:tests#2"]
    labels = spark.createDataFrame([(i, ["a/b.ts"]) for i in ids], "s string, p array<string>").select(PL.section_label(F.col("s"), F.col("p")).alias("l")).collect()
    assert [r["l"] for r in labels] == [
        "a/b.ts", "How the project is set up", "Smaller pieces in the lib folder", "Smaller pieces in the project root", "More helpers", "More from the ui folder", "Everything else", "The tests",
    ]
