"""Requests to a writer: what parameters it accepts, how many may be under way at once, and how fast they may follow.

A run's requests go out from tasks. `slots` tasks in all hold runs, whatever the planner would merge, and each has at most
`concurrency` requests under way, so slots x concurrency bounds them across the cluster. A limit of requests a minute is
dealt to the slots in equal shares. What a writer refuses is learned once, by a probe before the tasks start, and handed
to all of them; a task that still meets a refusal learns for itself.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SLOTS = 16


class WriterError(Exception):
    def __init__(self, kind: str, message: str = "", retry_after: float = 0.0):
        super().__init__(message or kind)
        self.kind, self.retry_after = kind, retry_after


@dataclass(frozen=True)
class Reply:
    """What a writer wrote; truncated: it ran out of tokens before the end."""

    text: str
    truncated: bool = False


class Writer(Protocol):
    """Writes the reply to a request. A plain text counts as a whole reply."""

    def __call__(self, system: str, prompt: str, max_tokens: int) -> str | Reply: ...


@dataclass(frozen=True)
class Parameters:
    """Under which name a request bounds the reply's tokens (none: not at all), and whether it sets a temperature."""

    token_name: str = "max_tokens"
    temperature: bool = True


class AdaptiveWriter(Writer, Protocol):
    """A writer whose requests have Parameters."""

    parameters: Parameters

    def with_parameters(self, parameters: Parameters) -> AdaptiveWriter: ...


#: The name that a refusal speaks of, one of the words beside it, and the name to use from then on.
TOKEN_NAMES = {"max_tokens": (("max_completion_tokens", "unsupported", "not supported"), "max_completion_tokens"), "max_completion_tokens": (("max_completion_tokens",), "none")}


def learned(sent: Parameters, refusal: str) -> Parameters | None:
    """Parameters to try after a refusal of those that were sent, or None where it is about something else."""
    said = refusal.lower()
    beside, then = TOKEN_NAMES.get(sent.token_name, ((), None))
    of_tokens = then and sent.token_name in said and any(word in said for word in beside) and "max_tokens'" not in (said if then == "none" else "")
    if of_tokens:
        return replace(sent, token_name=then)
    return replace(sent, temperature=False) if sent.temperature and "temperature" in said else None


class Session:
    """A writer in a task. Requests that run side by side share what one of them has learned."""

    def __init__(self, writer: Writer, before: Callable[[], None] = lambda: None):
        self.writer, self.before, self.lock = writer, before, threading.Lock()

    def __call__(self, system: str, prompt: str, max_tokens: int) -> str | Reply:
        while True:
            writer = self.writer
            self.before()
            try:
                return writer(system, prompt, max_tokens)
            except WriterError as e:
                if e.kind != "bad_request" or not hasattr(writer, "with_parameters"):
                    raise
                with self.lock:
                    if self.writer is writer:  # else another request has learned meanwhile
                        found = learned(writer.parameters, str(e))
                        if found is None:
                            raise
                        self.writer = writer.with_parameters(found)
            except Exception as e:
                raise WriterError("server", f"{type(e).__name__}: {e}") from e


def negotiated(spark: SparkSession, writer: AdaptiveWriter) -> AdaptiveWriter:
    """The writer with the parameters that it accepts, learned by one small request from one task. Other failures of the
    probe are left to the requests that follow."""

    def probe(batches):
        for _ in batches:
            session = Session(writer)
            try:
                session("Answer with one word.", "Part: Probe\nSource: ok", 16)
            except WriterError:
                pass
            found = session.writer.parameters
            yield pd.DataFrame([(found.token_name, found.temperature)], columns=["token_name", "temperature"])

    row = spark.range(1, numPartitions=1).mapInPandas(probe, "token_name string, temperature boolean").first()
    return writer.with_parameters(Parameters(row["token_name"], row["temperature"]))


class Pace:
    """Keeps a task's requests apart: its share of so many a minute, one slot of several."""

    def __init__(self, per_minute: float | None, slots: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.next = 60.0 * slots / per_minute if per_minute else 0.0, 0.0
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()

    def __call__(self) -> None:
        if not self.gap:
            return
        with self.lock:
            wait = self.next - self.clock()
            self.next = max(self.next, self.clock()) + self.gap
        if wait > 0:
            self.sleep(wait)


def dealt(runs: DataFrame, slots: int) -> DataFrame:
    """Runs in exactly `slots` partitions, each run in one. The planner merges partitions only where it chose their number."""
    return runs.repartition(slots, "run_key")
