"""Ask a model for each prompt and keep the answers in a ledger."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from textquarry import schemas
from textquarry.functions.parsing import SALVAGE_MARKER
from textquarry.session import stage


class CompletionError(Exception):
    """Raised by a completer; a 400 may carry the model's output in ``body``."""

    def __init__(self, status: int | None = None, body: str | None = None):
        super().__init__(status, body)
        self.status = status
        self.body = body


def _has_output(body: str | None) -> bool:
    """Whether ``salvage_error`` will find text in the body; if not, the call is tried again."""
    try:
        parsed = json.loads(body or "")
        text = parsed.get("error", "") if isinstance(parsed, dict) and parsed else body
    except ValueError:
        text = body
    return isinstance(text, str) and bool(text) and not text.endswith(SALVAGE_MARKER)


def complete(
    prompts: DataFrame,
    completer: Callable[[str], str],
    tries: int = 3,
    pause: Callable[[float], None] = time.sleep,
    parallelism: int | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """``(key, response, error_body)``: one answer, or the last salvageable error, per prompt.

    Calls are retried after 1, 2, 4 ... seconds; when every try fails both values are null. The
    calls of one partition run one after another, so ``parallelism`` partitions bound the load on
    the server.
    """

    def ask(prompt: str) -> tuple[str | None, str | None]:
        for attempt in range(tries):
            try:
                return completer(prompt).strip(), None
            except CompletionError as error:
                if error.status == 400 and _has_output(error.body):
                    return None, error.body
            except Exception:  # any failure of the call counts as a failed try
                pass
            pause(2**attempt)
        return None, None

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [ask(prompt) for prompt in frame["prompt"]]
            yield pd.DataFrame(
                {
                    key: frame[key],
                    "response": [a[0] for a in answers],
                    "error_body": [a[1] for a in answers],
                }
            )

    asked = prompts.select(key, "prompt")
    if parallelism is not None:
        asked = asked.repartition(parallelism, key)
    return asked.mapInPandas(batches, schemas.COMPLETION.replace("doc_id", key, 1))


def completion_ledger(prompts: DataFrame, completer: Callable[[str], str], **options) -> DataFrame:
    """``complete`` written once to the shared folder, so no later plan repeats a call."""
    return stage(complete(prompts, completer, **options), "ledger")
