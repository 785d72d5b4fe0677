"""JSON-RPC 2.0 over standard input and over HTTP, on one session and one open index."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from graphloom.api import CodeGraph
from graphloom.operators.lookups import Filters

VERSION = "0.1.0"
MOST_BYTES = 2 << 20
S, I, B = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
L = {"type": "array", "items": S}
_FILTERS = {"kinds": L, "languages": L, "exported": B, "path_prefix": S, "limit": I}


def _filters(a: dict) -> Filters:
    return Filters(a.get("kinds") or [], a.get("languages") or [], a.get("exported"), a.get("path_prefix"), a.get("limit") or 50)


#: name: (what it does, required arguments, optional arguments, call)
TOOLS = {
    "find_definition": ("Where a name is defined.", {"symbol": S}, {}, lambda g, a: g.find_definition(a["symbol"])),
    "find_references": ("What refers to a name.", {"symbol": S}, {}, lambda g, a: g.find_references(a["symbol"])),
    "get_outline": ("The symbols of a file or folder.", {"path": S}, {}, lambda g, a: g.outline(a["path"])),
    "expand_symbol": ("A symbol's body and what it refers to.", {"symbol": S}, {}, lambda g, a: g.expand(a["symbol"])),
    "impact": ("Ranked callers that a change reaches.", {"symbol": S}, {"depth": I}, lambda g, a: g.impact(a["symbol"], a.get("depth", 4))),
    "validate": ("Whether a name exists, and what may be meant.", {"symbol": S}, {}, lambda g, a: g.validate(a["symbol"])),
    "validate_snippet": ("Whether the names that code calls exist.", {"code": S, "language": S}, {}, lambda g, a: g.validate_snippet(a["code"], a["language"])),
    "stats": ("Counts of the index.", {}, {}, lambda g, a: g.stats()),
    "tests_for": ("Tests that reach a symbol.", {"symbol": S}, {}, lambda g, a: g.tests_for(a["symbol"])),
    "connect": ("The shortest chain of calls.", {"from": S, "to": S}, {"depth": I}, lambda g, a: g.connect(a["from"], a["to"], a.get("depth", 8))),
    "export": ("A diagram of calls.", {}, {"format": S, "from": S, "depth": I, "limit": I, "group_by": S, "collapse_tests": B, "exported_only": B}, lambda g, a: g.export(a.get("format", "mermaid"), a.get("from"), a.get("depth", 3), a.get("limit", 800), a.get("group_by", "none"), a.get("collapse_tests", False), a.get("exported_only", False))),
    "context_pack": ("Body, dependencies, callers and tests within a budget.", {"symbol": S}, {"budget": I}, lambda g, a: g.context_pack(a["symbol"], a.get("budget", 1500))),
    "search": ("Symbols by glob or similar name.", {"pattern": S}, _FILTERS, lambda g, a: g.search(a["pattern"], _filters(a))),
    "unused": ("Symbols that nothing refers to.", {}, _FILTERS, lambda g, a: g.unused(_filters(a))),
    "plan_query": ("Which tools to use for a task.", {"task": S}, {"symbol": S}, lambda g, a: g.plan_query(a["task"], a.get("symbol"))),
    "edit_prep": ("All that an edit needs to know.", {"symbol": S}, {"budget": I}, lambda g, a: g.edit_prep(a["symbol"], a.get("budget", 1800))),
    "diff_impact": ("What a diff affects.", {"from": S}, {"to": S, "depth": I}, lambda g, a: g.diff_impact(a["from"], a.get("to", "HEAD"), a.get("depth", 3))),
    "imports": ("What a file or folder imports.", {"path": S}, {}, lambda g, a: g.imports(a["path"])),
    "imported_by": ("What imports a source.", {"source": S}, {}, lambda g, a: g.imported_by(a["source"])),
    "signature": ("A symbol and its members' signatures.", {"symbol": S}, {}, lambda g, a: g.signature(a["symbol"])),
    "siblings": ("What a symbol's callers also call.", {"symbol": S}, {}, lambda g, a: g.siblings(a["symbol"])),
}


def handle(graph: CodeGraph, text: str) -> dict:
    """The reply to one request; requests without an id are answered too."""
    try:
        request = json.loads(text)
        if not isinstance(request, dict):
            raise ValueError("a request is an object")
    except ValueError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"parse error: {e}"}}
    reply = {"jsonrpc": "2.0", "id": request.get("id")}
    try:
        return reply | {"result": _call(graph, request.get("method"), request.get("params") or {})}
    except Exception as e:  # noqa: BLE001  any failure is the caller's answer
        return reply | {"error": {"code": -32000, "message": f"{type(e).__name__}: {e}"[:500]}}


def _call(graph: CodeGraph, method: str | None, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": "2024-11-05", "serverInfo": {"name": "graphloom", "version": VERSION}, "capabilities": {"tools": {}}}
    if method == "notifications/initialized":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": r | o, "required": list(r)}} for n, (d, r, o, _) in TOOLS.items()]}
    if method == "tools/call":
        name, arguments = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            raise ValueError(f"unknown tool: {name}")
        if missing := [k for k in TOOLS[name][1] if k not in arguments]:
            raise ValueError(f"missing argument: {', '.join(missing)}")
        result = TOOLS[name][3](graph, arguments)
        return {"content": [{"type": "text", "text": json.dumps(result, indent=2, default=str)}], "structuredContent": json.loads(json.dumps(result, default=str))}
    raise ValueError(f"unknown method: {method}")


def serve_stdio(graph: CodeGraph, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            print(json.dumps(handle(graph, line)), file=out, flush=True)


def http_server(graph: CodeGraph, host: str = "127.0.0.1", port: int = 8765) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/health":
                info = graph.index.meta()
                self._send(200, json.dumps({"status": "ok", "version": VERSION, "schema_version": info["schema_version"], "root": info["root"], "snapshot": {"exists": True}}))
            elif self.path == "/sse":
                self._send(200, 'event: ready\ndata: {"endpoint":"/mcp"}\n\n', "text/event-stream")
            else:
                self._send(404, '{"error":"not found"}')

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/mcp":
                self._send(404, '{"error":"not found"}')
            elif size > MOST_BYTES:
                self._send(413, '{"error":"request too large"}')
            else:
                self._send(200, json.dumps(handle(graph, self.rfile.read(size).decode("utf-8", "replace"))))

        def log_message(self, *_args) -> None:
            pass

    return HTTPServer((host, port), Handler)
