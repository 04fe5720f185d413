"""Models behind one interface: a deterministic offline provider and an HTTP one."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from typing import Protocol

from pydantic import BaseModel, ConfigDict, ValidationError

_WORD = re.compile(r"[a-z0-9]+")


class ProviderError(RuntimeError):
    """A model could not be reached or answered nonsense."""


class Provider(Protocol):
    dim: int
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def generate(self, prompt: str, schema: dict | None = None, temperature: float = 0.2) -> str: ...


class HashProvider:
    """Offline: words hashed into 64 buckets; replies are extracts of the prompt."""

    dim, name = 64, "hash-64"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in _WORD.findall(t.lower()):
                v[int(hashlib.sha256(w.encode()).hexdigest()[:4], 16) % self.dim] += 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    def generate(self, prompt: str, schema: dict | None = None, temperature: float = 0.2) -> str:
        text = prompt.split("\n\n", 1)[-1].strip()
        first = re.split(r"(?<=[.!?])\s|\n", text, maxsplit=1)[0][:200]
        if schema is None:
            return first
        keys = list(schema.get("properties", {}))
        return json.dumps({keys[0]: first}) if keys and keys[0] != "rankings" else json.dumps({"rankings": []})


class HttpProvider:
    """A service with ``/embeddings`` and ``/chat/completions``; retries only on status 429."""

    def __init__(self, base: str, key: str | None, chat_model: str, embedding_model: str, dim: int = 0, allowed: list[str] | None = None, timeout: float = 60.0):
        self.base, self.key, self.chat_model, self.embedding_model, self.dim = base.rstrip("/"), key, chat_model, embedding_model, dim
        self.allowed, self.timeout, self.name = allowed or [], timeout, embedding_model

    def _post(self, path: str, body: dict, attempts: int = 5) -> dict:
        if self.allowed:
            body = body | {"provider": {"only": self.allowed}}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for k in range(attempts):
            try:
                request = urllib.request.Request(self.base + path, json.dumps(body).encode(), headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if e.code != 429 or k == attempts - 1:
                    raise ProviderError(f"{path}: status {e.code}") from e
                time.sleep(2.0 * 2**k)
            except (OSError, ValueError) as e:
                raise ProviderError(f"{path}: {e}") from e
        raise ProviderError(path)

    def embed(self, texts: list[str]) -> list[list[float]]:
        data = self._post("/embeddings", {"model": self.embedding_model, "input": texts}).get("data")
        if not isinstance(data, list) or len(data) != len(texts):
            raise ProviderError("the embeddings don't match the texts")
        data = sorted(data, key=lambda d: d.get("index", 0))
        return [[float(x) for x in d["embedding"]] for d in data]

    def generate(self, prompt: str, schema: dict | None = None, temperature: float = 0.2) -> str:
        body: dict = {"model": self.chat_model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature}
        if schema is not None:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "strict": True, "schema": closed(schema)}}
        choices = self._post("/chat/completions", body).get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""


def closed(schema: dict) -> dict:
    """A JSON schema whose objects allow no further keys, at any depth."""
    if isinstance(schema, dict):
        out = {k: closed(v) for k, v in schema.items()}
        return out | ({"additionalProperties": False} if out.get("type") == "object" else {})
    return [closed(x) for x in schema] if isinstance(schema, list) else schema


class FileSummary(BaseModel):
    model_config = ConfigDict(extra="forbid")
    summary: str


class FolderSummary(BaseModel):
    model_config = ConfigDict(extra="forbid")
    purpose: str


class RankingItem(BaseModel):
    model_config = ConfigDict(extra="forbid")
    chunk_id: int
    score: float


class Ranking(BaseModel):
    model_config = ConfigDict(extra="forbid")
    rankings: list[RankingItem]


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text


def summarize_file(provider: Provider, code: str, name: str) -> str:
    """A file's summary; a reply that is no JSON counts as text, an empty one or an error is said in its place."""
    try:
        reply = provider.generate(f"Summarise this {name.rpartition('.')[2]} file in two sentences.\n\n{code[:3500]}", FileSummary.model_json_schema())
    except Exception as e:  # noqa: BLE001 - whatever the provider raises
        return f"File: {name} (summary failed: {e})"
    try:
        said = FileSummary.model_validate_json(reply).summary.strip()
    except ValidationError:
        said = _bare(reply)
    return said or f"File: {name} (summary failed: empty response)"


def summarize_folder(provider: Provider, lines: list[tuple[str, str]]) -> str:
    """A folder's purpose from its first eight files."""
    if not lines:
        return "Empty folder"
    text = "\n".join(f"- {path.rpartition('/')[2]}: {summary}" for path, summary in lines[:8])
    try:
        reply = provider.generate(f"State the purpose of a folder with these files.\n\n{text}", FolderSummary.model_json_schema())
    except Exception:  # noqa: BLE001
        return "Multiple code files"
    try:
        said = FolderSummary.model_validate_json(reply).purpose.strip()
    except ValidationError:
        said = _bare(reply)
    return said or "Multiple code files"


def rank(provider: Provider, prompt: str, n: int) -> list[tuple[int, float]]:
    """(position, score) in reply order; every candidate scores 5 if nothing valid came back."""
    everyone = [(k, 5.0) for k in range(n)]
    try:
        reply = Ranking.model_validate_json(provider.generate(prompt, Ranking.model_json_schema(), 0.1))
    except Exception:  # noqa: BLE001
        return everyone
    good = [(r.chunk_id, r.score) for r in reply.rankings if 0 <= r.chunk_id < n]
    return good or everyone


def refine(provider: Provider, question: str, blocks: list[str]) -> str:
    """What the chosen chunks say about a question, as a model puts it; raises what the provider raises."""
    prompt = (
        f"Question: {question}\n\nSay in one paragraph how the parts below answer it, then describe each part in a line that starts with its number."
        " Repeat no code.\n\n" + "\n\n".join(blocks)
    )
    return provider.generate(prompt, temperature=0.2).strip()
