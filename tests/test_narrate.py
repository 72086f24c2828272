from __future__ import annotations

import io
import tarfile

import pytest
from corpusloom.narrate import assemble as A
from corpusloom.narrate import pipeline as N
from corpusloom.narrate import speech as S
from corpusloom.operators import lint as L
from corpusloom.sources import archive, models
from corpusloom.streaming import run_state as R
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("```js\nx()\n```\nDone.", "Done."),
        ("## Big idea\nIt works", "Big idea.\nIt works"),
        ("- one\n2) two", "one.\ntwo."),
        ("| a | b |\n|---|---|\n| c | d |", "a, b.\n\nc, d."),
        ("See **bold** and *it* and _so_ `code`.", "See bold and it and so code."),
        ("a -> b & c", "a to b and c"),
        ("Use foo.js, e.g. data.json", "Use foo JS, for example, data JSON"),
        ("SET_PAGE and NEXT_API_URL", "set page and next API URL"),
        ("mapStateToProps innerHTML iPhone", "map state to props inner HTML iPhone"),
        ("CommentInput on GitHub", "Comment Input on GitHub"),
        ("APP LOAD then LOGIN via JWT", "app load then login via JWT"),
        ("the src folder, src/lib", "the source folder, src/lib"),
        ("the url and its ids; a key id", "the URL and its IDs; a key id"),
        ("Notice that the list grows.", "The list grows."),
        ("wait... yet done", "wait, yet done"),
        ("ok 🎉 then", "ok then"),
        ("![alt](x.png) [link](y)", "alt link"),
        ("<b>hi</b><!-- no -->", "hi"),
        ("In short: it saves.", "It saves."),
        ("about ~5 items vs many", "about about 5 items versus many"),
    ],
)
def test_to_speakable(text, want):
    assert S.to_speakable(text) == want
    assert S.to_speakable(S.to_speakable(text)) == S.to_speakable(want)


def test_parse_reply_labels():
    r = S.parse_reply("CHAPTER 1: The start.\nBRIDGE 2: And now\nName: no\nNAME: Demo app.\nTITLE: One\nBody here.\n\nMore.\nRECIPES: - add a row\nBUGS: none\nTERMS: “Cache”, none of it\nNOTED: slow loop")
    assert (r["title"], r["name"], r["body"]) == ("One", "Demo app", "Body here.\n\nMore.")
    assert r["chapters"] == {1: "The start"} and r["bridges"] == {2: "And now"}
    assert r["recipes"] == ["add a row"] and r["bugs"] == [] and r["noted"] == ["slow loop"] and r["terms"][0] == "cache"
    again = S.parse_reply(S.format_reply(r))
    assert {k: again[k] for k in ("title", "name", "body", "recipes", "noted")} == {k: r[k] for k in ("title", "name", "body", "recipes", "noted")}


def test_parse_reply_without_labels():
    r = S.parse_reply("# Heading\nJust text")
    assert r["title"] == "Heading" and r["body"] == "Just text" and r["summary"] is None


def test_retries():
    waits, replies = [], iter([N.WriterError("server"), N.WriterError("rate_limit", retry_after=9), "ok"])

    def call():
        x = next(replies)
        if isinstance(x, Exception):
            raise x
        return x

    assert N.with_retries(call, sleep=waits.append) == "ok" and waits == [1.5, 9]
    with pytest.raises(N.WriterError):
        N.with_retries(lambda: (_ for _ in ()).throw(N.WriterError("auth")), sleep=waits.append)
    assert len(waits) == 2


def test_draft_halves_long_chunks():
    seen = []

    def writer(system, prompt, max_tokens):
        source = prompt.split("Source:\n", 1)[1]
        if len(source) > 6000:
            raise N.WriterError("context")
        seen.append(len(source))
        return f"TITLE: T\nSaid {len(source)}.\nFACTS: f{len(seen)}"

    r = N.draft(writer, "a.ts", ["x" * 5999 + "\n" + "y" * 5000], N.Ledger(), None, [], 100, 200)
    assert len(seen) == 2 and r["facts"] == ["f1", "f2"]


def test_revision_is_kept_only_if_long_enough():
    before = S.parse_reply("TITLE: A\none two three four\nFACTS: x")
    assert N.accept_revision(before, S.parse_reply("TITLE: B\none")) is before
    after = N.accept_revision(before, S.parse_reply("TITLE: B\none two three"))
    assert after["title"] == "B" and after["facts"] == ["x"]


def failing_writer(system, prompt, max_tokens):
    if "Part: bad" in prompt:
        raise N.WriterError("model")
    return N.StubWriter()(system, prompt, max_tokens)


def test_narrate_in_order_and_resume(spark):
    rows = [("r", f"s{i}", i, f"f{i}.ts", [f"code {i}"], 50, 90) for i in range(3)] + [("q", "t0", 0, "bad.ts", ["x"], 50, 90), ("q", "t1", 1, "ok.ts", ["x"], 50, 90)]
    df = spark.createDataFrame(rows, "run_key string, section_id string, ord int, label string, chunks array<string>, lo int, hi int")
    out = N.narrate(df, failing_writer).cache()
    state = {r["section_id"]: (r["status"], r["error"]) for r in out.collect()}
    assert state == {"s0": ("done", None), "s1": ("done", None), "s2": ("done", None), "t0": ("failed", "model"), "t1": ("skipped", "model")}
    assert {r["section_id"] for r in N.unfinished(df, out).collect()} == {"t0", "t1"}


def test_script_and_markdown(spark):
    rows = [("c", 0, "start", "Beginnings", "First,", "One", "Body one.", ["a.ts"]), ("c", 1, "start", "Beginnings", None, "Two", "Body two.", [f"p{i}" for i in range(10)]), ("c", 2, "end", "Ends", None, "Three", "Body three.", [])]
    parts = spark.createDataFrame(rows, "conv string, ord int, chapter string, chapter_title string, bridge string, title string, body string, paths array<string>")
    tours = spark.sql("select 'c' conv, 'demo' name, 'All of it.' overview, '' closing, 'Demo' title, '[d](u)' link, 'm' model, timestamp'2024-03-05' created_at, array('x.ts') missing")
    assert A.listening_script(parts, tours).first()["script"] == (
        "A guided tour of demo.\n\nAll of it.\n\nChapter one. Beginnings.\n\nFirst,\n\nPart one. One.\n\nBody one.\n\nPart two. Two.\n\nBody two.\n\nChapter two. Ends.\n\nBody three.\n"
    )
    md = A.markdown(parts, tours).first()["markdown"]
    assert "## Chapter 1: Beginnings\n\n*First,*\n\n### 1. One\n\n`a.ts`" in md and "and 2 more" in md and "March 5, 2024" in md and "generated: x.ts." in md


def test_lint_clean_part_has_no_flags(spark):
    parts = spark.createDataFrame([("c", 1, "The reader opens a page and sees new rows."), ("c", 2, "Saving a form sends one request to the server.")], "conv string, part int, body string")
    assert L.rule_flags(parts).isEmpty() and L.repeats(parts).isEmpty() and L.signposts(parts).isEmpty() and L.same_openings(parts).isEmpty()


def test_folder_openings_and_terms(spark):
    body = "The Card view, in the components folder, shows one row."
    parts = spark.createDataFrame([("c", i, body) for i in range(4)], "conv string, part int, body string")
    assert [r["part"] for r in L.folder_openings(parts).orderBy("part").collect()] == [2, 3]
    more = spark.createDataFrame([("c", 1, "It keeps a cache, which stores rows for later use.")], "conv string, part int, body string")
    terms = spark.createDataFrame([("c", "cache")], "conv string, term string")
    assert L.terms_explained_again(more, terms).count() == 1


def tarball(entries) -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return raw.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "demo.tar.gz").write_bytes(tarball([("demo-1/a/b.ts", b"x" * 10), ("demo-1/package.json", b"{}"), ("demo-1/a/c/d.ts", b"y")]))
    (tmp_path / "broken.tgz").write_bytes(b"\x1f\x8bnothing")
    df = archive.read_archives(spark, str(tmp_path), max_read=4).cache()
    got = {(r["repo_id"], r["path"], r["size"], bytes(r["bytes"]) if r["bytes"] is not None else None, r["error"]) for r in df.collect()}
    assert got == {("demo", "a/b.ts", 10, b"xxxx", None), ("demo", "package.json", 2, b"{}", None), ("demo", "a/c/d.ts", 1, b"y", None), ("broken", None, None, None, "unreadable")}
    assert {r["path"] for r in archive.inside(df, "a").collect()} == {"b.ts", "c/d.ts"}
    assert [r["path"] for r in archive.context_manifests(df.filter("path IS NOT NULL"), "a/c").collect()] == ["package.json"]


def test_models_and_settings(spark):
    df = spark.createDataFrame([('{"data":[{"id":"b"},{"id":"a"},{"x":1}]}',)], "j string")
    assert df.select(models.model_ids(F.col("j")).alias("m")).first()["m"] == ["a", "b"]
    assert models.Settings(concurrency=99, length="x").clamped() == models.Settings(concurrency=8)


def test_streamed_states_equal_batch(spark, tmp_path):
    rows = [(1, i % 3, i, ["section-start", "section-done", "section-failed"][i % 7 % 3]) for i in range(40)]
    schema = "run_id string, section_id string, seq long, type string"
    src = str(tmp_path / "in")
    spark.createDataFrame([(str(a), str(b), c, d) for a, b, c, d in rows], schema).repartition(3).write.parquet(src)
    stream = R.stream_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    last: dict = {}
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: last.update({(r["run_id"], r["section_id"]): r for r in df.collect()})).start()
    query.awaitTermination(120)
    want = {(r["run_id"], r["section_id"]): (r["status"], r["seq"], r["n_events"]) for r in R.latest_states(spark.read.parquet(src)).collect()}
    assert {k: (r["status"], r["seq"], r["n_events"]) for k, r in last.items()} == want
    assert R.progress(R.latest_states(spark.read.parquet(src))).first()["n_sections"] == 3


def test_flags_are_folded(spark):
    rows = [("c", 1, i, f"m{i % 25}") for i in range(60)] + [("c", 2, 0, "x"), ("c", 2, 1, "x")]
    out = L.fold_flags(spark.createDataFrame(rows, "conv string, part int, ord int, message string")).collect()
    assert [r["message"] for r in sorted(out, key=lambda r: (r["part"], r["ord"]))] == [f"m{i}" for i in range(20)] + ["x"]


def test_windowed_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' type union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'b'")
    assert sorted((r["type"], r["n"]) for r in R.windowed_counts(df).collect()) == [("a", 2), ("b", 1)]
