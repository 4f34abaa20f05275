"""A client for chat and embedding endpoints of the usual JSON form, and embeddings of whole tables.

The transport is given by the caller: ``transport(method, url, headers, body, timeout) -> (status, text)``, which raises
``TimeoutError`` or ``OSError`` where nothing comes back. :func:`http_transport` is one over the standard library. A client is a
provider for :mod:`penprint.judged.annotations`, built once for each partition on the executors.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame

from penprint.judged.annotations import Template, _finite

Transport = Callable[[str, str, dict, str | None, float], tuple[int, str]]
#: Characters that count as one token in the check of the context window.
CHARACTERS = 4


@dataclass(frozen=True)
class Configuration:
    base_url: str
    model: str
    api_key: str = ""
    embedding_model: str = ""
    context_window: int = 32_786
    max_tokens: int = 32_768
    context_percent: float = 90.0
    retries: int = 3
    delay: float = 2.0
    timeout: float = 1_800.0
    temperature: float = 0.0

    def __post_init__(self) -> None:
        if not self.base_url.startswith(("http://", "https://")):
            raise ValueError("base_url: http or https")
        if not self.model.strip():
            raise ValueError("model: no name")
        for name in ("context_window", "max_tokens", "timeout"):
            if not _finite(getattr(self, name)) or getattr(self, name) <= 0:
                raise ValueError(f"{name}: above 0")
        if not (_finite(self.context_percent) and 0 < self.context_percent <= 100):
            raise ValueError("context_percent: above 0, at most 100")
        for name in ("retries", "delay", "temperature"):
            if not _finite(getattr(self, name)) or getattr(self, name) < 0:
                raise ValueError(f"{name}: at least 0")


def configuration(values: Mapping) -> Configuration:
    """From a mapping, such as a parsed file; unknown keys are an error."""
    known = {f.name for f in fields(Configuration)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"no such setting: {unknown[0]}")
    if missing := [k for k in ("base_url", "model") if not values.get(k)]:
        raise ValueError(f"missing setting: {missing[0]}")
    return Configuration(**values)


def http_transport(method: str, url: str, headers: dict, body: str | None, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, None if body is None else body.encode(), headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


class ClientError(ValueError):
    """An answer that can't be used; its text is the reason that annotations carry."""


class Client:
    """``client(messages, template)`` answers for annotations; failures raise :class:`ClientError` with a short reason."""

    def __init__(self, config: Configuration, transport: Transport = http_transport, sleep: Callable[[float], None] = time.sleep):
        self.config, self.transport, self.sleep = config, transport, sleep

    def __call__(self, messages: list[dict[str, str]], template: Template | None = None) -> str:
        c = self.config
        size = math.ceil(sum(len(m["content"]) for m in messages) / CHARACTERS)
        if size > c.context_window * c.context_percent / 100:
            raise ClientError("context_window_exceeded")
        answer = self._asked("POST", "/chat/completions", {"model": c.model, "messages": messages, "max_tokens": c.max_tokens, "temperature": c.temperature, "response_format": {"type": "json_object"}})
        choices = answer.get("choices")
        if not (isinstance(choices, list) and choices and isinstance(choices[0], dict) and isinstance(choices[0].get("message"), dict)):
            raise ClientError("no_choices")
        said = choices[0]["message"]
        if said.get("refusal") or choices[0].get("finish_reason") == "content_filter":
            raise ClientError("refusal")
        if choices[0].get("finish_reason") == "length":
            raise ClientError("truncated")
        if not isinstance(said.get("content"), str) or not said["content"].strip():
            raise ClientError("empty_answer")
        return said["content"]

    def list_models(self) -> list[str]:
        found = self._asked("GET", "/models", None).get("data")
        if not isinstance(found, list):
            raise ClientError("no_models")
        return [m["id"] for m in found if isinstance(m, dict) and isinstance(m.get("id"), str)]

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        """One vector for each text, in their order, all of one width."""
        if not texts:
            return []
        if not all(isinstance(t, str) and t.strip() for t in texts):
            raise ClientError("empty_text")
        found = self._asked("POST", "/embeddings", {"model": self.config.embedding_model or self.config.model, "input": list(texts)}).get("data")
        if not isinstance(found, list) or len(found) != len(texts) or sorted(d.get("index", -1) for d in found) != list(range(len(texts))):
            raise ClientError("vectors_do_not_match_texts")
        out = [d.get("embedding") for d in sorted(found, key=lambda d: d["index"])]
        if not all(isinstance(v, list) and v and all(map(_finite, v)) for v in out) or len({len(v) for v in out}) > 1:
            raise ClientError("bad_vector")
        return [[float(x) for x in v] for v in out]

    def _asked(self, method: str, path: str, body: dict | None) -> dict:
        """The answer's object; errors of the server and timeouts are tried again, errors of the request are not."""
        c, reason = self.config, ""
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {c.api_key}"} if c.api_key else {})
        for turn in range(c.retries + 1):
            if turn:
                self.sleep(c.delay)
            try:
                status, text = self.transport(method, c.base_url.rstrip("/") + path, headers, None if body is None else json.dumps(body), c.timeout)
            except TimeoutError:
                reason = "timeout"
                continue
            except OSError:
                reason = "no_connection"
                continue
            if status >= 500:
                reason = f"server_error:{status}"
                continue
            if status >= 400:
                raise ClientError(f"request_error:{status}")
            try:
                answer = json.loads(text)
            except json.JSONDecodeError:
                raise ClientError("answer_is_not_json") from None
            if not isinstance(answer, dict):
                raise ClientError("answer_is_not_an_object")
            return answer
        raise ClientError(reason)


def embed(docs: DataFrame, client: Callable[[], Client], batch: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, vector, reason``: texts go out ``batch`` at a time from each partition; a batch that fails gives null vectors and the reason,
    and so does a blank text, which isn't sent."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                texts = part.column(1).to_pylist()
                sent = [j for j, t in enumerate(texts) if t and t.strip()]
                vectors: list = [None] * len(texts)
                reasons: list = [None if t and t.strip() else "empty_text" for t in texts]
                if sent:
                    made = made or client()
                    try:
                        for j, v in zip(sent, made.embed_texts([texts[j] for j in sent]), strict=True):
                            vectors[j] = v
                    except (ValueError, OSError) as e:
                        for j in sent:
                            reasons[j] = str(e)[:200] or type(e).__name__
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array(reasons, pa.string())], ["doc_id", "vector", "reason"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, vector array<double>, reason string")
