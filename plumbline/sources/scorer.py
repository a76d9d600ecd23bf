"""Where models plug in: batches of rows through a callable in the workers.

Inference is outside the engine.  A scorer is a function from a list of inputs to a list of
outputs; it is made by a factory, once in each task or, where it has a name, once in each worker process, and
must give the same result when a task is run again.  A resource profile places the tasks that hold one, on
executors with accelerators, say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import confidence, without_think
from plumbline.operators import prompts
from plumbline.schemas import SamplingConfig
from plumbline.sources.images import pixels
from plumbline.sources.tables import ship

#: A judge's reply that gives no answer.
NO_VERDICT = '{"extracted_answer": null, "is_correct": false}'


def held(name: str | None, factory: Callable):
    """What the factory makes; with a name it stays in this worker process for later tasks, until another name is
    asked for.  Models are large, so a process keeps one."""
    if name is None:
        return factory()
    import sys
    from types import ModuleType

    # A module of its own: functions that are sent to workers bring copies of what they refer to otherwise.
    kept = sys.modules.setdefault("plumbline_held", ModuleType("plumbline_held")).__dict__.setdefault("models", {})
    if name not in kept:
        kept.clear()
        kept[name] = factory()
    return kept[name]


def scored_batches(df: DataFrame, column: str, out: str, factory: Callable[[], Callable[[list], list]], batch: int = 8, on_error=None, kind: str = "string", workers: int | None = None, name: str | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """df with ``out``: what the scorer says of ``column``, ``batch`` rows at a time.  A batch that
    fails gets ``on_error``, or fails the task where that is an exception class.  ``workers``: tasks that
    hold a scorer, over which rows are dealt evenly; ``name``: that of a scorer that stays in its process
    (``held``); ``profile``: the resources of these tasks."""
    ship(df.sparkSession)
    if workers is not None:
        df = df.repartition(workers)

    def run(frames):
        score = held(name, factory)
        for f in frames:
            got = []
            for i in range(0, len(f), batch):
                part = list(f[column].iloc[i : i + batch])
                try:
                    got += list(score(part))
                except Exception:
                    if isinstance(on_error, type):
                        raise
                    got += [on_error] * len(part)
            yield f.assign(**{out: pd.Series(got, index=f.index, dtype=object)})

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields if x.name != out)
    return df.mapInPandas(run, f"{fields}, `{out}` {kind}", profile=profile)


def generated(df: DataFrame, column: str, factory: Callable[[], Callable[[str, int], list[dict]]], kind: str, config: SamplingConfig = SamplingConfig(), image: str | None = None, name: str | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """One row for each candidate that the generator makes of a row's prompt, with ``pos``; ``kind``
    is the DDL of a candidate.  The generator is asked for ``micro_batch`` candidates at a time until
    there are ``n_samples``.

    With ``retries``, that many failures in a row end a question, a success starts the count anew,
    and the first failure only lowers a larger batch to one.  Without, a failure skips its batch.
    In both cases the question keeps what there is; one without any candidate gives no row.

    ``image``: a column of image files (bytes, or structs with bytes), whose RGB pixels the generator gets as its third
    argument, None where the bytes are null.  Bytes that can't be read are a failure of the question: it gives no
    row.  ``name`` and ``profile`` are those of ``scored_batches``.
    """
    import json

    ship(df.sparkSession)
    if config.workers is not None:
        df = df.repartition(config.workers)

    def candidates(make, prompt: str, *shown) -> list[dict]:
        out: list[dict] = []
        size, asked, failures = config.micro_batch, 0, 0
        while (asked if config.retries is None else len(out)) < config.n_samples and (config.retries is None or failures < config.retries):
            n = min(size, config.n_samples - (asked if config.retries is None else len(out)))
            asked += n
            try:
                out += make(prompt, n, *shown)[:n]
                failures = 0
            except Exception:  # whatever a model may raise
                if config.retries is not None and size > 1:
                    size = 1
                else:
                    failures += 1
        return out

    def seen(make, row: dict) -> list[dict]:
        if image is None:
            return candidates(make, row[column])
        try:
            return candidates(make, row[column], image_of(row[image]))
        except ValueError:
            return []

    def run(frames):
        make = held(name, factory)
        for f in frames:
            rows = [r | {"pos": i, "candidate": json.dumps(c)} for r in f.to_dict("records") for i, c in enumerate(seen(make, r))]
            if rows:
                yield pd.DataFrame(rows)

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    out = df.mapInPandas(run, f"{fields}, pos int, candidate string", profile=profile)
    return out.withColumn("candidate", F.from_json("candidate", kind))


def image_of(cell):
    """The RGB pixels of a cell with ``bytes``, or of bytes, for generators of visual questions; None where they are null.
    Images are decoded where they are used and never travel decoded."""
    raw = cell.get("bytes") if isinstance(cell, dict) else cell
    return pixels(None if raw is None else bytes(raw))


def http_judge(url: str, model: str, key: str = "", timeout: float = 60.0, concurrent: int = 1, retries: int = 0, backoff: float = 0.5, per_second: float | None = None, failed: str | None = NO_VERDICT) -> Callable[[], Callable[[list], list]]:
    """A factory of judges behind a chat-completion endpoint that replies in JSON, at temperature 0.

    ``concurrent`` requests of a batch are under way at a time in a task, and at most ``per_second`` begin (a task's
    share of what the endpoint allows).  A refusal that may pass (429, 5xx, a broken connection) is tried again up to
    ``retries`` times, after as long as the endpoint asks or else ``backoff`` seconds, doubled each time.  What still
    fails is the reply ``failed``: one without an answer, which counts as wrong, or None for tables that keep replies.
    """

    def factory():
        import json
        import time
        from concurrent.futures import ThreadPoolExecutor
        from threading import Lock
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        turn, lock = [0.0], Lock()

        def wait_for_turn():
            if per_second:
                with lock:
                    turn[0] = max(turn[0] + 1 / per_second, time.monotonic())
                    at = turn[0]
                time.sleep(max(0.0, at - time.monotonic()))

        def judge(text: str) -> str | None:
            body = {"model": model, "messages": [{"role": "system", "content": "Reply in JSON."}, {"role": "user", "content": text}], "response_format": {"type": "json_object"}, "temperature": 0.0}
            for attempt in range(retries + 1):
                wait_for_turn()
                pause = backoff * 2**attempt
                try:
                    with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}), timeout=timeout) as got:
                        return json.load(got)["choices"][0]["message"]["content"]
                except HTTPError as e:
                    if e.code != 429 and e.code < 500:
                        return failed
                    asked = e.headers.get("Retry-After", "")
                    pause = float(asked) if asked.isdigit() else pause
                except OSError:  # no connection, or one that breaks
                    pass
                except Exception:  # a reply of another shape
                    return failed
                if attempt < retries:
                    time.sleep(pause)
            return failed

        def judged(texts: list) -> list:
            if concurrent <= 1:
                return [judge(t) for t in texts]
            with ThreadPoolExecutor(concurrent) as pool:
                return list(pool.map(judge, texts))

        return judged

    return factory


def stub_factory() -> Callable[[list], list]:
    """A scorer for tests: a confidence that follows from the text alone."""

    def score(texts: list) -> list:
        return [f"Confidence: {int(hashlib.md5((t or '').encode()).hexdigest()[:6], 16) % 101}%" for t in texts]

    return score


def confidence_scores(slices: DataFrame, factory=stub_factory, batch: int = 8, rubric: str = "path", workers: int | None = None) -> DataFrame:
    """All of ``slices`` but problem and slice (whose closed think blocks are left out), and score: keys travel
    along, so nothing is matched back by position.  A failed batch scores 0."""
    keys = [F.col(f"`{c}`") for c in slices.columns if c not in ("problem", "slice")]
    messages = prompts.verification(F.col("problem"), without_think(F.col("slice")), prompts.RUBRICS[rubric])
    asked = slices.select(*keys, F.to_json(messages).alias("messages"))
    replies = scored_batches(asked, "messages", "reply", factory, batch, on_error="", workers=workers)
    return replies.select(*keys, confidence(F.col("reply")).alias("score"))
