"""Where runs begin and end: which ref to read, stored results, script files, and what a failure means to a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.store import Store

# --- fixed values: titles of failures, and codes after which a run can't go on -----------------------------------
ERROR_TITLES = {
    "auth": "Your API key didn't work", "credits": "Out of credits", "model": "Model not found", "rate_limit": "The provider is rate-limiting us",
    "context": "Too long for this model", "server": "The provider is having trouble", "network": "Couldn't reach the model provider",
    "bad_request": "The provider turned the request down", "empty": "The model went quiet", "aborted": "Stopped",
}
#: What an answer with an error code is sent with.
ERROR_STATUS = {"invalid_url": 400, "not_found": 404, "too_large": 413, "empty": 422, "rate_limited": 429, "unreachable": 502, "unreadable": 502, "misconfigured": 500, "internal": 500}
FINAL_CODES = ("invalid_url", "not_found", "empty", "too_large")
FIX_FIRST = ("auth", "credits", "model")
TOUR_COLUMNS = {"conv": "string", "overview": "string", "closing": "string", "parts": "array"}


def chosen_refs(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(repo_id, ref, subpath, error): of each repository the first candidate (repo_id, ord, ref, subpath) whose ref exists
    (existing: repo_id, ref). Without one the error says whether the repository has any ref (bad_ref) or none (not_found)."""
    known = existing.select("repo_id", "ref").distinct()
    hits = candidates.join(known, ["repo_id", "ref"], "left_semi").groupBy("repo_id").agg(F.min_by(F.struct("ref", "subpath"), "ord").alias("hit"))
    there = known.select("repo_id").distinct().withColumn("there", F.lit(True))
    asked = candidates.select("repo_id").distinct().join(hits, "repo_id", "left").join(there, "repo_id", "left")
    error = F.when(F.col("hit").isNull(), F.when(F.col("there"), "bad_ref").otherwise("not_found"))
    return asked.select("repo_id", "hit.ref", "hit.subpath", error.alias("error"))


def save_tours(tours: DataFrame, path: str) -> None:
    """Tours (as walkthroughs has them), stored under their key; of a tour the newest save counts. What was stored before
    stays readable until the new rows are complete."""
    Store(tours.sparkSession, path, ("conv",)).save(tours)


def load_tours(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored tours, or None where nothing of that shape is stored. Rows without overview or parts are left out."""
    stored = Store(spark, path, ("conv",)).load()
    kinds = {f.name: f.dataType.typeName() for f in stored.schema.fields} if stored is not None else {}
    if any(kinds.get(name) != kind for name, kind in TOUR_COLUMNS.items()):
        return None
    return stored.filter("overview IS NOT NULL AND parts IS NOT NULL")


def write_scripts(scripts: DataFrame, path: str, column: str = "script") -> None:
    """Scripts or Markdown documents (conv and the column) as text, a folder for each tour; the last
    line break is the one that the writer adds."""
    scripts.select(F.regexp_replace(F.lower("conv"), "[^a-z0-9]+", "-").alias("tour"), F.regexp_replace(column, r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy("tour").text(path)


def path_order(path: Column) -> Column:
    """A sort key for paths as people order them: by the root collation, not by code points."""
    return F.collate(path, "UNICODE")


def error_title(kind: Column) -> Column:
    """What a failure is called."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ERROR_TITLES.items() for x in kv]), kind), F.lit("Something went wrong"))


def is_resumable(code: Column) -> Column:
    """Whether finished parts of a run are worth keeping for another try."""
    return F.coalesce((code != "") & ~code.isin(*FINAL_CODES), F.lit(False))


def needs_fix(code: Column) -> Column:
    """Whether something must change before another try can do better."""
    return F.coalesce(code.isin(*FIX_FIRST), F.lit(False))


def error_status(code: Column) -> Column:
    """The status that an answer has: 200 without an error code, 500 for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in ERROR_STATUS.items() for x in kv])
    return F.when(code.isNull(), 200).otherwise(F.coalesce(F.try_element_at(table, code), F.lit(500)))
