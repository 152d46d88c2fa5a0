"""Calls of a model with fallbacks: what a service refuses is asked for in another way, and a failure is a row.

A prompt goes through a fixed order of options until one gives an answer: requests for JSON before none, a switch against
thinking aloud before none, then ways to name the token budget. An error or an empty answer leads to the next option, a timeout ends
the prompt. An answer that holds no JSON is asked for once more, more firmly. The model is a callable (prompt, options) -> text that the
caller brings; it is shipped once a task, and equal prompts of a batch are asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.jsonfix import repair

#: Hosts that take a request for JSON; least tokens, tokens a row, tokens besides, spare; the most by host.
JSON_HOSTS = ("api.openai.com", "api.anthropic.com")
LEAST, A_ROW, BESIDES, SPARE, MOST, MOST_ROOMY, ROOMY_HOST = 4096, 200, 1500, 1.2, 16384, 65536, "generativelanguage.googleapis.com"
FIRMER = "\n\nIMPORTANT: reply with the JSON object alone, without explanation and without fences."
RESULT = "raw string, attempts int, option string, problem string"


def token_budget(rows: Column, url: str = "") -> Column:
    """Tokens for an answer with so many table rows, within the host's bounds."""
    return F.greatest(F.lit(LEAST), F.least(F.floor((rows * A_ROW + BESIDES) * SPARE), F.lit(MOST_ROOMY if ROOMY_HOST in url else MOST))).cast("int")


def options(url: str, tokens: int) -> list[dict[str, Any]]:
    """What to ask with, in turn."""
    json_host = any(h in url for h in JSON_HOSTS)
    extras = [{}] if json_host else [{"extra_body": {"chat_template_kwargs": {"enable_thinking": False}}}, {}]
    formats = [{"response_format": {"type": "json_object"}}, {}] if json_host else [{}]
    return [{**extra, **form, **budget} for extra in extras for form in formats for budget in ({"max_tokens": tokens}, {"max_completion_tokens": tokens}, {})]


def call(model: Callable[[str, dict], str], prompt: str, ways: list[dict[str, Any]]) -> tuple[str | None, int, str | None, str | None]:
    """(answer, attempts, names of the option that gave it, problem)."""
    problem = None
    for n, way in enumerate(ways, 1):
        try:
            answer = model(prompt, way)
        except TimeoutError as e:
            return None, n, None, f"timed out: {e}"
        except Exception as e:  # noqa: BLE001  the service's
            problem = f"{type(e).__name__}: {e}"
            continue
        if answer and answer.strip():
            return answer, n, "+".join(sorted(way)), None
    return None, len(ways), None, problem or "empty answer"


def ask_json(model: Callable[[str, dict], str], prompt: str, ways: list[dict[str, Any]]) -> tuple[str | None, int, str | None, str | None]:
    first = call(model, prompt, ways)
    if first[0] is None or repair(first[0]) is not None:
        return first
    again = call(model, prompt + FIRMER, ways)
    attempts = first[1] + again[1]
    if again[0] is None:
        return None, attempts, None, again[3]
    return (again[0], attempts, again[2], None) if repair(again[0]) is not None else (None, attempts, again[2], "no JSON in the answer")


def ask_model(texts: DataFrame, model: Callable[[str, dict], str], url: str = "", prompt: str = "prompt", tokens: str | None = None) -> DataFrame:
    """Adds raw (null where there is none), attempts, option and problem; no error of the service ends a task.

    ``tokens`` names a column with the budget of each answer (see ``token_budget``); without one the least counts. A null prompt is
    not asked. The result is to be written before it is read twice.
    """
    names, at, budget = texts.columns, texts.columns.index(prompt), texts.columns.index(tokens) if tokens else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[str, int], tuple] = {}
            out = []
            for i, text in enumerate(batch.column(at).to_pylist()):
                n = batch.column(budget)[i].as_py() or LEAST if budget is not None else LEAST
                if text is None:
                    out.append((None, 0, None, "no prompt"))
                    continue
                if (text, n) not in known:
                    known[text, n] = ask_json(model, text, options(url, n))
                out.append(known[text, n])
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], [*names, "raw", "attempts", "option", "problem"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, f"{schema}, {RESULT}")
