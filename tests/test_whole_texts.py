"""Queries over whole texts against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

from corpusloom.queries import QUERIES

LONG = 'A "quoted" \\ line\n\ttabbed é 😀 ' * 20_000 + "the last words"


def test_notebooks_hold_whole_texts(spark, tmp_path):
    texts = {1: LONG, 2: "short", 3: "", 4: None, 5: "x" * 41 + "\r\n\u2028end"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in QUERIES["g17_notebooks"](spark, str(tmp_path)).collect()}
    for d, t in texts.items():
        want = None if t is None else "# --- Cell 1 (notes) ---\n# " + (t + "\ntwo").replace("\n", "\n# ") + f"\n\n# --- Cell 2 (code) ---\nx = {d}"
        assert (got[d] or None) == want


def test_terms_of_whole_bodies(spark, tmp_path):
    turn = lambda k: " ".join(f"term{k}x{i}" for i in range(13 + k)) + " shared"
    rows = [(c, k, "user", turn(k) if c else turn(0)) for c in (0, 4) for k in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv"], r["part"]): r["known"] for r in QUERIES["w5_terms_seen"](spark, str(tmp_path)).collect()}
    from corpusloom.queries.narration import _parts

    seen, want = defaultdict(set), {}
    for r in sorted(_parts(spark, str(tmp_path)).collect(), key=lambda r: (r["conv"], r["part"])):
        want[r["conv"], r["part"]] = min(40, len(seen[r["conv"]]))
        seen[r["conv"]] |= set(re.sub(r"[^a-z0-9' ]+", " ", r["body"].lower()).split())
    assert got == want
