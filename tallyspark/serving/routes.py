"""HTTP handlers without a framework: a table of routes from (method, path pattern) to functions, and an optional adapter."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..engine import Caller, Engine
from ..errors import EngineError, LimitExceeded, SpecError
from ..plans.request import canonical
from .grid import GridAdapter, edit_to_override

MAX_BODY_BYTES = 2_000_000


@dataclass(frozen=True)
class Call:
    """One HTTP request, decoded."""

    engine: Engine
    caller: Caller
    params: Mapping[str, str]
    query: Mapping[str, str]
    body: Any
    headers: Mapping[str, str]


@dataclass(frozen=True)
class Response:
    status: int
    body: Any
    media_type: str = "application/json"

    def content(self) -> bytes:
        return self.body if isinstance(self.body, bytes) else json.dumps(self.body, default=str).encode()


@dataclass
class Router:
    """Routes in order; `caller_of(headers)` says who asks."""

    engine: Engine
    caller_of: Callable[[Mapping[str, str]], Caller]
    max_body_bytes: int = MAX_BODY_BYTES
    routes: list[tuple[str, str, Callable[[Call], Any]]] = field(default_factory=list)

    def add(self, method: str, path: str, handler: Callable[[Call], Any]) -> None:
        self.routes.append((method, path, handler))

    def handle(self, method: str, path: str, body: bytes = b"", query: Mapping[str, str] | None = None, headers: Mapping[str, str] | None = None) -> Response:
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        try:
            if len(body) > self.max_body_bytes:
                raise LimitExceeded(f"a body holds at most {self.max_body_bytes} bytes")
            for verb, pattern, handler in self.routes:
                found = re.fullmatch(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", pattern), path)
                if found and verb == method:
                    out = handler(Call(self.engine, self.caller_of(headers), found.groupdict(), query or {}, self._json(body), headers))
                    return out if isinstance(out, Response) else Response(200, out)
            return Response(404, {"code": "not_found", "message": f"no route {method} {path}"})
        except EngineError as e:
            return Response(e.status, e.to_dict())

    @staticmethod
    def _json(body: bytes) -> Any:
        try:
            return json.loads(body) if body else None
        except ValueError as e:
            raise SpecError(f"the body is not JSON: {e}", "invalid_request") from None


def _answer(call: Call, result: Any) -> Response:
    if "arrow" in call.headers.get("accept", ""):
        return Response(200, result.to_arrow_ipc(), "application/vnd.apache.arrow.stream")
    return Response(200, result.to_dict(decimals=call.query.get("decimals", "float")))


def _datasets(call: Call) -> list[dict]:
    return [{"id": d.id, "version": d.version, "kind": d.kind} for d in call.engine.catalog.list()]


def _schema(call: Call) -> dict:
    held = call.engine.catalog.get(call.params["id"], call.query.get("version"))
    call.engine.authorize(call.caller, "dataset.read", held)
    return {"id": held.id, "version": held.version, "columns": held.schema.restrict(call.caller.allowed_columns).to_json()}


def _distinct(call: Call) -> dict:
    b = call.body or {}
    return {"values": [canonical(v) for v in call.engine.distinct_values(b.get("dataset"), b.get("column"), b.get("filter"), b.get("limit", 1000), call.caller)]}


def _grid(call: Call) -> dict:
    b = call.body or {}
    return GridAdapter(call.engine, b.get("dataset"), separator=b.get("separator", "_")).rows(b.get("request") or {}, call.caller, b.get("extensions"))


def _operations(call: Call) -> list[dict]:
    return [{"name": o.name, "description": o.description} for o in call.engine.registry.entries["operation"].values()]


def core_router(engine: Engine, caller_of: Callable[[Mapping[str, str]], Caller]) -> Router:
    """All routes of the engine and its plugins. There is no default for who asks, as a default caller would see everything."""
    router = Router(engine, caller_of)
    router.add("POST", "/query", lambda c: _answer(c, c.engine.run(c.body, c.caller)))
    router.add("POST", "/compare", lambda c: _answer(c, c.engine.compare(c.body, c.caller)))
    router.add("POST", "/explain", lambda c: c.engine.explain(c.body, c.caller))
    router.add("POST", "/distinct", _distinct)
    router.add("POST", "/aggrid/rows", _grid)
    router.add("GET", "/datasets", _datasets)
    router.add("GET", "/datasets/{id}/schema", _schema)
    router.add("GET", "/operations", _operations)
    router.add("POST", "/operations/{name}", lambda c: c.engine.call(c.params["name"], c.body, c.caller))
    for hook in engine.registry.routes:
        hook(router)
    return router


def whatif_routes(plugin: Any) -> Callable[[Router], None]:
    """Scenarios, and cell edits of a grid."""

    def show(scenario: Any) -> dict:
        return canonical(scenario)

    def append(call: Call) -> dict:
        b = call.body or {}
        if "expected_version" not in b:
            raise SpecError("expected_version is missing", "invalid_request", "/expected_version")
        return show(plugin.scenarios.append(call.params["id"], b.get("steps") or [], b["expected_version"], call.caller, note=b.get("note"), client_op_id=call.headers.get("idempotency-key") or b.get("client_op_id")))

    def create(call: Call) -> Response:
        b = call.body or {}
        return Response(201, show(plugin.scenarios.create(b.get("name") or "", b.get("dataset"), call.caller, description=b.get("description"), steps=b.get("steps") or ())))

    def fork(call: Call) -> Response:
        b = call.body or {}
        return Response(201, show(plugin.scenarios.fork(call.params["id"], b.get("name") or "", call.caller, version=b.get("version"))))

    def log(call: Call) -> list:
        version = call.query.get("version")
        return [{**vars(e), "step": canonical(e.step)} for e in plugin.scenarios.log(call.params["id"], int(version) if version else None, call.caller)]

    def delete(call: Call) -> Response:
        plugin.scenarios.delete(call.params["id"], call.caller)
        return Response(204, None)

    def hook(router: Router) -> None:
        router.add("POST", "/scenarios", create)
        router.add("GET", "/scenarios", lambda c: [show(s) for s in plugin.scenarios.list(c.caller)])
        router.add("GET", "/scenarios/{id}", lambda c: show(plugin.scenarios.get(c.params["id"], c.caller)))
        router.add("DELETE", "/scenarios/{id}", delete)
        router.add("GET", "/scenarios/{id}/log", log)
        router.add("POST", "/scenarios/{id}/steps", append)
        router.add("POST", "/scenarios/{id}/fork", fork)
        router.add("POST", "/aggrid/edit", lambda c: edit_to_override(c.engine, (c.body or {}).get("dataset"), c.body or {}))

    return hook


def mount_fastapi(router: Router, app: Any, prefix: str = "") -> None:
    """Serves the routes in a FastAPI (or Starlette) application, which is imported only here. Handlers run in its threads."""
    from starlette.concurrency import run_in_threadpool
    from starlette.requests import Request
    from starlette.responses import Response as Reply

    async def serve(request: Request) -> Reply:
        body = await request.body()
        out = await run_in_threadpool(router.handle, request.method, request.url.path.removeprefix(prefix), body, dict(request.query_params), dict(request.headers))
        return Reply(b"" if out.status == 204 else out.content(), out.status, media_type=out.media_type)

    app.add_route(prefix + "/{path:path}", serve, methods=["GET", "POST", "DELETE"])
