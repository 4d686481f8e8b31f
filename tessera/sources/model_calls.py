"""Calls to a model as a DataFrame source: prompts in, answers out, with retries.

The sender is a function of the caller's, made once per task by ``connect`` (a
client doesn't travel between processes). Nothing here knows a provider.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.arrow import pieces
from tessera.functions.json_text import recover_json

#: Attempts, seconds of back-off per attempt made, the token budget
#: of later attempts at least and at most, and a client error worth another try.
ATTEMPTS, BACK_OFF = 3, 1.0
RETRY_TOKENS, MOST_TOKENS = 16_384, 32_768
TOO_MANY_REQUESTS = 429


class CallFailed(Exception):
    """A call that failed, with the status where there was an answer."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status

    @property
    def final(self) -> bool:
        """Client errors fail alike on every try; being too fast doesn't."""
        return self.status is not None and 400 <= self.status < 500 and self.status != TOO_MANY_REQUESTS


@dataclass(frozen=True)
class Reply:
    content: str | None
    cut_off: bool = False


Send = Callable[[str, int], Reply]


@dataclass(frozen=True)
class CallPolicy:
    """How often a call is tried, how long it waits and what it may cost."""

    max_tokens: int = 8192
    attempts: int = ATTEMPTS
    back_off: float = BACK_OFF

    def budgets(self) -> Iterator[int]:
        """Tokens of each attempt: more after the first, so that a cut-off
        answer can end."""
        yield self.max_tokens
        for _ in range(1, self.attempts):
            yield min(MOST_TOKENS, max(2 * self.max_tokens, RETRY_TOKENS))

    def call(self, send: Send, prompt: str, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
        """The answer, the attempts made, and what went wrong at last. An answer
        cut off is taken if its JSON is whole all the same."""
        wrong = "no attempt was made"
        for made, tokens in enumerate(self.budgets(), 1):
            try:
                reply = send(prompt, tokens)
                if reply.content is None or not reply.content.strip():
                    raise CallFailed("the answer was empty")
                if not reply.cut_off or recover_json(reply.content) is not None:
                    return reply.content.strip(), made, None
                wrong = "the answer was cut off"
                if tokens >= MOST_TOKENS:
                    return None, made, wrong
            except CallFailed as error:
                wrong = str(error)
                if error.final:
                    return None, made, wrong
            if made < self.attempts:
                sleep(self.back_off * made)
        return None, self.attempts, wrong


def ask_model(prompts: DataFrame, connect: Callable[[], Send], policy: CallPolicy | None = None, key: str = "document_id") -> DataFrame:
    """An answer per prompt (key, prompt): key, response_json, attempts, error.

    A failure is a row with an error, not a failed job. A null prompt isn't
    sent and has no answer. Rows are called where they lie: spread them over as
    many partitions as the provider takes at once. A task that is run again
    calls again; write the result before it is used twice.
    """
    rows = prompts.select(key, "prompt")
    key_type, policy = rows.schema[key].dataType.simpleString(), policy or CallPolicy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send: Send | None = None
        for batch in pieces(batches):
            out = []
            for prompt in batch.column(1).to_pylist():
                if prompt is None:
                    out.append((None, 0, "no prompt"))
                    continue
                send = send or connect()
                out.append(policy.call(send, prompt))
            answers, attempts, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(attempts, pa.int32()), pa.array(errors, pa.string())], names=[key, "response_json", "attempts", "error"])

    return rows.mapInArrow(run, f"{key} {key_type}, response_json string, attempts int, error string")
