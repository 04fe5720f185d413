"""A tool server on standard input and output: one JSON-RPC message a line, one tool, ``query``."""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Callable
from typing import IO

PROTOCOL = "2024-11-05"
TOOL = {
    "name": "query",
    "description": "Index a project (only what changed) and return the context that answers a question about it.",
    "inputSchema": {
        "type": "object",
        "properties": {"query_text": {"type": "string"}, "project_location": {"type": "string"}, "token_limit": {"type": "integer", "default": 15000}},
        "required": ["query_text", "project_location"],
    },
}


def answer(message: dict, ask: Callable[[str, str, int], str]) -> dict | None:
    """The reply to one message; None for notifications."""
    if "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "corvane", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [TOOL]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    a = params.get("arguments") or {}
    if params.get("name") != "query" or not isinstance(a.get("query_text"), str) or not isinstance(a.get("project_location"), str):
        return reply | {"error": {"code": -32602, "message": "query takes query_text and project_location"}}
    try:
        text, failed = ask(a["query_text"], a["project_location"], int(a.get("token_limit", 15_000))), False
    except Exception as e:  # noqa: BLE001 - the caller is told
        text, failed = f"Error during query: {str(e).encode('ascii', 'ignore').decode()}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(ask: Callable[[str, str, int], str], lines: IO[str] | None = None, out: IO[str] | None = None) -> None:
    """Answer messages until the input ends."""
    lines, out = lines or sys.stdin, out or sys.stdout
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(message, ask) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()


def index_of(project: str, base: str) -> str:
    """Where a project's index lies below ``base``: under the first 16 digits of its path's SHA-256."""
    return os.path.join(base, hashlib.sha256(os.path.abspath(project).encode()).hexdigest()[:16])
