"""Judges over HTTP, and settings from the environment.

A backend makes answer(prompt) -> (text, refused, input tokens, output tokens) for judge.judged_by: it runs on the executors, one call at a time in each partition, so the number of
partitions bounds how many calls are under way. What fails within its tries raises, and becomes a row that names the failure.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instructions import SYSTEM, answer_schema
from ..operators import judge

PREFIX = "EVIDENTIA_"


@dataclass(frozen=True)
class Settings:
    """Each can be set in the environment, by its name in capitals behind EVIDENTIA_."""

    provider: str = "local"
    url: str = "http://127.0.0.1:11434"
    model: str = ""
    api_key: str = ""
    timeout: float = 300.0
    tries: int = 3
    parallel: int = 4
    context_chars: int = 12_000
    max_tokens: int = 4096
    most_contexts: int = 200
    grounding: str = "cpg"

    @classmethod
    def read(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        """Settings from the environment; one that isn't of its kind is an error that names it."""
        given = {}
        for f in fields(cls):
            text = environment.get(PREFIX + f.name.upper())
            if text is None or not text.strip():
                continue
            try:
                given[f.name] = type(f.default)(text.strip())
            except ValueError as e:
                raise ValueError(f"{PREFIX}{f.name.upper()}: {text!r} is no {type(f.default).__name__}") from e
        if given.get("grounding", "cpg") not in ("cpg", "raw"):
            raise ValueError(f"{PREFIX}GROUNDING must be cpg or raw")
        return cls(**given)


def _posted(url: str, body: dict, headers: dict[str, str], settings: Settings) -> dict:
    """The answer to a POST. Busy and failing servers are tried again, after what they ask for or 1, 2, 4 ... seconds."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})  # noqa: S310
    for k in range(settings.tries):
        try:
            with urllib.request.urlopen(request, timeout=settings.timeout) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if k + 1 == settings.tries or e.code != 429 and e.code < 500:
                raise RuntimeError(f"HTTP {e.code} from {url}: {e.read()[:200].decode(errors='replace')}") from e
            told = e.headers.get("Retry-After", "")
            time.sleep(min(60.0, float(told) if told.replace(".", "", 1).isdigit() else 2.0**k))
        except OSError:
            if k + 1 == settings.tries:
                raise
            time.sleep(2.0**k)
    raise AssertionError("at least one try")


def _cut(prompt: str, settings: Settings) -> str:
    return prompt if len(prompt) <= settings.context_chars else prompt[: settings.context_chars] + "\n... truncated ..."


def local_model(settings: Settings, mode: str) -> Callable[[str], tuple[str, bool, int, int]]:
    """A model server on the own network that takes a chat, a schema as its format and temperature 0."""

    def answer(prompt: str) -> tuple[str, bool, int, int]:
        chat = [{"role": "system", "content": SYSTEM[mode]}, {"role": "user", "content": _cut(prompt, settings)}]
        found = _posted(f"{settings.url.rstrip('/')}/api/chat", {"model": settings.model, "messages": chat, "format": answer_schema(mode), "stream": False, "options": {"temperature": 0}}, {}, settings)
        return found["message"]["content"], False, int(found.get("prompt_eval_count", 0)), int(found.get("eval_count", 0))

    return answer


def hosted_model(settings: Settings, mode: str) -> Callable[[str], tuple[str, bool, int, int]]:
    """A hosted service with chat completions; a message that says `refusal`, or an end by a content filter, is a refusal."""

    def answer(prompt: str) -> tuple[str, bool, int, int]:
        chat = [{"role": "system", "content": SYSTEM[mode]}, {"role": "user", "content": _cut(prompt, settings)}]
        form = {"type": "json_schema", "json_schema": {"name": "findings", "strict": True, "schema": answer_schema(mode)}}
        body = {"model": settings.model, "messages": chat, "response_format": form, "max_tokens": settings.max_tokens, "temperature": 0}
        found = _posted(f"{settings.url.rstrip('/')}/v1/chat/completions", body, {"authorization": f"Bearer {settings.api_key}"}, settings)
        choice, used = found["choices"][0], found.get("usage", {})
        refused = bool(choice["message"].get("refusal")) or choice.get("finish_reason") == "content_filter"
        return choice["message"].get("content") or "", refused, int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0))

    return answer


PROVIDERS = {"local": local_model, "hosted": hosted_model}


def judge_of(settings: Settings, modes: tuple[str, ...] = ("injection", "absence", "hygiene")) -> Callable[[DataFrame], DataFrame]:
    """A judge for analyze: each context goes to the provider under the instructions of its mode, which its id begins with."""
    made = PROVIDERS[settings.provider]

    def run(contexts: DataFrame) -> DataFrame:
        answers = [judge.judged_by(contexts.filter(F.startswith("context_id", F.lit(f"{mode}|"))), made(settings, mode), settings.parallel) for mode in modes]
        out = answers[0]
        for more in answers[1:]:
            out = out.unionByName(more)
        return out

    return run
