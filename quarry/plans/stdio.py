"""The query commands and read-only SQL as two tools over standard streams, a JSON message a line.

Messages follow JSON-RPC 2.0 with the methods ``initialize``, ``tools/list`` and
``tools/call``; whatever a command prints is the text of the answer, up to MOST bytes.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable, Iterable, Mapping
from typing import TextIO

from quarry.plans import api
from quarry.sources.catalog import Catalog

#: Bytes of an answer; a longer one is an error, as the reader would get it cut.
MOST = 50 << 20
COMMANDS: dict[str, Callable] = {
    "find": api.find, "symbol": api.symbol, "show": api.show, "snippet": api.snippet, "overloads": api.overloads, "packages": api.packages, "package-versions": api.package_versions,
    "package-deps": api.package_deps, "source-packages": api.source_packages, "symbols": api.symbols, "evidence": api.evidence,
}
TOOLS = [
    {"name": "query", "description": "Structured search and listings over the catalog.", "inputSchema": {"type": "object", "required": ["command"], "properties": {"command": {"enum": sorted(COMMANDS)}, "arguments": {"type": "object"}}}},
    {"name": "sql", "description": "One reading statement over the catalog's tables.", "inputSchema": {"type": "object", "required": ["sql"], "properties": {"sql": {"type": "string"}, "format": {"enum": ["jsonl", "json", "tsv"]}, "max_rows": {"type": "integer"}}}},
]


def _query(catalog: Catalog, given: Mapping) -> str:
    command, arguments = given["command"], dict(given.get("arguments") or {})
    if command not in COMMANDS:
        raise ValueError(f"no such command: {command}")
    if odd := sorted(set(arguments) - set(inspect.signature(COMMANDS[command]).parameters) - ({"package", "version", "source_package", "kind", "file", "internal"} if command == "evidence" else set())):
        raise ValueError(f"unknown arguments: {', '.join(odd)}")
    return json.dumps(api.envelope(command, lambda: COMMANDS[command](catalog, **arguments)), default=str)


def _sql(catalog: Catalog, given: Mapping) -> str:
    rows = api.sql(catalog, given["sql"], int(given.get("max_rows", 1000)))
    return api.printed([r.asDict(recursive=True) for r in rows], given.get("format", "jsonl"))


def called(catalog: Catalog, name: str, given: Mapping) -> dict:
    """The answer of a tool: an error is a text like any other, and marked."""
    try:
        text = {"query": _query, "sql": _sql}[name](catalog, given)
        if len(text.encode()) > MOST:
            raise ValueError(f"the answer is over {MOST} bytes")
    except Exception as fault:  # noqa: BLE001  whatever a command raises is the caller's to read
        return {"content": [{"type": "text", "text": f"{type(fault).__name__}: {fault}"}], "isError": True}
    return {"content": [{"type": "text", "text": text or "(no rows)"}]}


def serve(catalog: Catalog, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answers each message of ``lines`` until they end; notifications get no answer."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            method, given = message["method"], message.get("params") or {}
        except (ValueError, KeyError, TypeError) as fault:
            print(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(fault)}}), file=out, flush=True)
            continue
        if "id" not in message:
            continue
        answer: dict[str, object] = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            answer["result"] = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": "0"}}
        elif method == "tools/list":
            answer["result"] = {"tools": TOOLS}
        elif method == "tools/call" and given.get("name") in ("query", "sql"):
            answer["result"] = called(catalog, given["name"], given.get("arguments") or {})
        else:
            answer["error"] = {"code": -32601, "message": f"no such method or tool: {method}"}
        print(json.dumps(answer), file=out, flush=True)
