"""Embedders and deciders over HTTP, with the transport injected so that nothing here needs a network in tests."""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit

from .gate import Candidate, Decision, GateError, Similar, gate_prompt, parse_decision

MAX_TEXTS, MAX_CHARS, TIMEOUT_S = 64, 96_000, 30
_LOCAL = {"localhost", "127.0.0.1", "::1", "0.0.0.0"}


def post(url: str, body: dict, headers: dict[str, str], timeout: float = TIMEOUT_S) -> tuple[int, str]:
    """Send JSON; status and text of the answer."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.status, answer.read().decode("utf-8", "replace")


def is_local(endpoint: str) -> bool:
    """Whether an http(s) address is of this machine; anything else isn't an endpoint."""
    parts = urlsplit(endpoint)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not an http address: {endpoint!r}")
    return parts.hostname in _LOCAL


def batches(texts: list[str], most: int = MAX_TEXTS, chars: int = MAX_CHARS) -> list[list[str]]:
    """Consecutive texts within both bounds; one that is too long by itself goes alone."""
    out: list[list[str]] = []
    size = 0
    for text in texts:
        if not out or len(out[-1]) >= most or size + len(text) > chars:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def redacted(text: str, key: str | None, most: int = 200) -> str:
    """An answer fit for an error message: the key first, then the length."""
    return (text.replace(key, "[redacted]") if key else text)[:most]


class HttpEmbedder:
    """Vectors from an endpoint that takes {"model", "input": [texts]} and gives {"data": [{"index", "embedding"}]}."""

    def __init__(self, endpoint: str, model: str, dims: int = 384, key: str | None = None, transport: Callable = post):
        if not isinstance(dims, int) or not 1 <= dims <= 8192:
            raise ValueError("dims must be in 1..8192")
        if not is_local(endpoint) and not key:
            raise ValueError("a remote endpoint needs a key")
        self.endpoint, self.model, self.dims, self.key, self.transport = endpoint, model, dims, key, transport

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for batch in batches(texts) for v in self._batch(batch)]

    def _batch(self, texts: list[str]) -> list[list[float]]:
        headers = {"authorization": f"Bearer {self.key}"} if self.key else {}
        status, answer = self.transport(self.endpoint, {"model": self.model, "input": texts}, headers)
        if status != 200:
            raise RuntimeError(f"embedding failed with {status}: {redacted(answer, self.key)}")
        try:
            data = {d["index"]: d["embedding"] for d in json.loads(answer)["data"]}
            vectors = [[float(x) for x in data[i]] for i in range(len(texts))]
        except (ValueError, KeyError, TypeError):
            raise RuntimeError(f"not an embedding answer: {redacted(answer, self.key)}") from None
        for vector in vectors:
            if len(vector) != self.dims or not all(map(math.isfinite, vector)):
                raise RuntimeError(f"expected {self.dims} finite numbers a text")
        return vectors


def http_decider(endpoint: str, model: str, key: str | None = None, transport: Callable = post) -> Callable[[Candidate, list[Similar]], Decision]:
    """A decider that asks a chat endpoint with the gate's prompt and takes the one JSON object of its reply."""
    if not is_local(endpoint) and not key:
        raise ValueError("a remote endpoint needs a key")

    def decide(candidate: Candidate, similar: list[Similar]) -> Decision:
        headers = {"authorization": f"Bearer {key}"} if key else {}
        body = {"model": model, "temperature": 0, "messages": [{"role": "user", "content": gate_prompt(candidate, similar)}]}
        status, answer = transport(endpoint, body, headers)
        if status != 200:
            raise RuntimeError(f"deciding failed with {status}: {redacted(answer, key)}")
        try:
            return parse_decision(json.loads(answer)["choices"][0]["message"]["content"])
        except (ValueError, KeyError, IndexError, TypeError) as error:
            if isinstance(error, GateError):
                raise
            raise RuntimeError(f"not a chat answer: {redacted(answer, key)}") from None

    return decide
