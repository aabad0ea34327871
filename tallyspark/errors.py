"""Errors with a stable code, a JSON pointer to the offending part, and an HTTP status."""

from __future__ import annotations


class EngineError(Exception):
    """Anything the engine refuses on purpose."""

    status = 400
    code = "calc_error"

    def __init__(self, message: str, code: str | None = None, path: str | None = None, **detail) -> None:
        super().__init__(message)
        self.message, self.path, self.detail = message, path, detail
        self.code = code or type(self).code

    def to_dict(self) -> dict:
        body = {"code": self.code, "message": self.message, "path": self.path, "detail": self.detail}
        return {k: v for k, v in body.items() if v or k in ("code", "message")}

    def at(self, path: str) -> EngineError:
        """The same error, pointing at `path` unless it already points somewhere."""
        if self.path is None:
            self.path = path
        return self


def _kind(name: str, status: int, code: str, base: type = EngineError) -> type:
    return type(name, (base,), {"status": status, "code": code, "__module__": __name__})


SpecError = _kind("SpecError", 422, "invalid_spec")
ComputeError = _kind("ComputeError", 422, "compute_error")
NotFound = _kind("NotFound", 404, "not_found")
DatasetNotFound = _kind("DatasetNotFound", 404, "dataset_not_found", NotFound)
ScenarioNotFound = _kind("ScenarioNotFound", 404, "scenario_not_found", NotFound)
Forbidden = _kind("Forbidden", 403, "forbidden")
VersionConflict = _kind("VersionConflict", 409, "version_conflict")
LimitExceeded = _kind("LimitExceeded", 413, "limit_exceeded")
EngineBusy = _kind("EngineBusy", 503, "engine_busy")
QueryTimeout = _kind("QueryTimeout", 504, "timeout")


def pointer(base: str, *parts: str | int) -> str:
    """A JSON pointer below `base`."""
    return base + "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def mismatch(message: str) -> EngineError:
    return SpecError(message, "type_mismatch")
