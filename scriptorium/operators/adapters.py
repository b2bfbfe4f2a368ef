"""Models behind one interface: vision adapters, the fluency judge, retries and the batch runner.

No network is used here. A client is any function from a request to an answer's text; ``fake_client``
is a deterministic one for tests. Clients are made once in each task and called row by row; a row
that fails becomes an error, never an invented result.
"""

from __future__ import annotations

import base64
import hashlib
import random
import subprocess
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.judge import parse
from scriptorium.functions.text import base64_line, model_output, nfc, strip
from scriptorium.schemas import SCORE_KEYS

Client = Callable[[dict], str]


class TransientError(Exception):
    """Worth another attempt: rate limits, overload, lost connections."""


def backoff(attempt: int, rng: random.Random) -> float:
    """2 ** attempt seconds and up to one more."""
    return float(2**attempt) + rng.uniform(0.0, 1.0)


def with_retries(call: Callable[[], str], attempts: int, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str:
    """The answer of the first attempt that doesn't fail transiently. Other errors, and the last transient one, come through."""
    rng = rng or random.Random()
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except TransientError:
            if attempt == attempts:
                raise
            sleep(backoff(attempt, rng))
    raise ValueError("attempts must be positive")


def retryable_status(status: int) -> bool:
    """429 and server errors; other client errors aren't."""
    return status == 429 or status >= 500


@dataclass(frozen=True)
class Adapter:
    """How one kind of model is called. ``make_client`` runs on the executor."""

    name: str
    make_client: Callable[[], Client]
    attempts: int = 5
    #: Whether short answers without the script count as refusals and blank ones as empty.
    cleans: bool = True


def fake_client() -> Client:
    """Answers that depend on the request alone."""
    return lambda request: hashlib.sha256(repr(sorted(request.items())).encode()).hexdigest()


def command_client(command: list[str], timeout: float = 60.0) -> Callable[[], Client]:
    """A process that takes the image on its standard input, such as ["tesseract", "stdin", "stdout", "-l", "tel", "--psm", "6"]."""

    def make() -> Client:
        def run(request: dict) -> str:
            done = subprocess.run(command, input=base64.b64decode(request["image"]), capture_output=True, timeout=timeout, check=False)
            if done.returncode:
                raise RuntimeError(f"exit {done.returncode}: {done.stderr.decode(errors='replace')[-500:]}")
            return done.stdout.decode()

        return run

    return make


class Blocked(Exception):
    """The service answered without a text, as for content that its filter holds back."""


class ServiceError(Exception):
    """An answer with an HTTP status; None if the connection was lost."""

    def __init__(self, status: int | None, detail: str = ""):
        super().__init__(f"{'connection lost' if status is None else f'status {status}'}: {detail}".rstrip(": "))
        self.status = status


def guarded(make_client: Callable[[], Client], retried: Callable[[int | None], bool]) -> Callable[[], Client]:
    """A client whose service errors are transient where ``retried`` says so, and whose blocked answers are empty."""

    def make() -> Client:
        client = make_client()

        def call(request: dict) -> str:
            try:
                return client(request)
            except Blocked:
                return ""
            except ServiceError as e:
                if retried(e.status):
                    raise TransientError(str(e)) from e
                raise

        return call

    return make


#: Attempts of each service, and which statuses are tried again (None: a lost connection).
CONTRACTS: dict[str, tuple[int, Callable[[int | None], bool]]] = {
    "gemini": (7, lambda status: status in (429, 503)),
    "claude": (5, lambda status: status is None or retryable_status(status)),
}


def _service(name: str) -> Callable[..., Adapter]:
    attempts, retried = CONTRACTS[name]
    return lambda make_client, **o: Adapter(name, guarded(make_client, retried), **({"attempts": attempts} | o))


def _tesseract(language: str = "tel", mode: int = 6, **options) -> Adapter:
    return Adapter("tesseract", command_client(["tesseract", "stdin", "stdout", "-l", language, "--psm", str(mode)]), **({"attempts": 1, "cleans": False} | options))


_registry: dict[str, Callable[..., Adapter]] = {"fake": lambda **o: Adapter("fake", fake_client, **o), "command": lambda command, **o: Adapter("command", command_client(command), cleans=False, **o), "tesseract": _tesseract, **{name: _service(name) for name in CONTRACTS}}


def register(name: str, make: Callable[..., Adapter]) -> None:
    _registry[name] = make


def adapter(name: str, **options) -> Adapter:
    if name not in _registry:
        raise ValueError(f"unknown adapter {name!r} (known: {', '.join(sorted(_registry))})")
    return _registry[name](**options)


ANSWER = "answer string, latency_ms double, error string"


def _call(df: DataFrame, request: list[str], keys: list[str], chosen: Adapter, tasks: int | None) -> DataFrame:
    """(keys, answer, latency_ms, error); the number of tasks is the number of calls at a time."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = chosen.make_client()
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                began = time.perf_counter()
                wanted = {k: row[k] for k in request}
                try:
                    answer, error = with_retries(lambda w=wanted: client(w), chosen.attempts), None
                except Exception as e:  # one page must not end the run
                    answer, error = None, f"{type(e).__name__}: {e}"
                took = None if error else (time.perf_counter() - began) * 1000
                rows.append((*(row[k] for k in keys), answer, took, error))
            yield pd.DataFrame(rows, columns=[*keys, "answer", "latency_ms", "error"])

    spread = df.repartition(tasks, *keys) if tasks else df
    return spread.select(*dict.fromkeys([*keys, *request])).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ANSWER)


def transcribe(images: DataFrame, chosen: Adapter, keys: tuple[str, ...] = ("book_id", "page_id"), content: str = "content", tasks: int | None = None) -> DataFrame:
    """A manifest row with the text for each image: (keys, model, text, latency_ms, text_length, skipped, error)."""
    asked = images.select(*keys, base64_line(F.col(content)).alias("image"))
    found = _call(asked, ["image"], list(keys), chosen, tasks)
    kept = model_output(F.col("answer")) if chosen.cleans else F.col("answer")
    text = nfc(F.when(F.col("error").isNull(), kept))
    return found.withColumn("text", text).select(*keys, F.lit(chosen.name).alias("model"), "text", F.round("latency_ms", 1).alias("latency_ms"), F.length("text").alias("text_length"), F.lit(False).alias("skipped"), "error")


def judge(transcriptions: DataFrame, chosen: Adapter, template: str, keys: tuple[str, ...] = SCORE_KEYS, text: str = "text", tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ratings (``FLUENCY``) and errors. Blank texts are rated 1 without a call; an answer that can't be parsed is an error and no rating, so a later run tries again."""
    from scriptorium.functions.text import prompt

    blank = F.coalesce(strip(F.col(text)), F.lit("")) == ""
    empty = transcriptions.filter(blank).select(*keys, F.lit(1).alias("fluency_rating"), F.lit("blank text").alias("fluency_reason"), F.lit(0.0).alias("latency_ms"), F.lit(chosen.name).alias("judge_model"))
    asked = transcriptions.filter(~blank).select(*keys, prompt(template, text=F.col(text)).alias("prompt"))
    parsed = _call(asked, ["prompt"], list(keys), chosen, tasks).withColumn("p", parse(F.col("answer")))
    rated = parsed.filter("error is null and p.error is null").select(*keys, F.col("p.rating").alias("fluency_rating"), F.col("p.reason").alias("fluency_reason"), "latency_ms", F.lit(chosen.name).alias("judge_model"))
    failed = parsed.filter("error is not null or p.error is not null").select(*keys, F.coalesce("error", "p.error").alias("error"))
    return empty.unionByName(rated), failed
