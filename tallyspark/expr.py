"""Expression trees: one node class, JSON in and out, and walking."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

from .errors import SpecError, pointer
from .types import exact, plain

#: Built-in functions with their least and most arguments.
FUNCTIONS = {"abs": (1, 1), "round": (1, 2), "floor": (1, 1), "ceil": (1, 1), "sqrt": (1, 1), "log": (1, 1), "exp": (1, 1), "lower": (1, 1), "upper": (1, 1), "contains": (2, 2), "starts_with": (2, 2), "ends_with": (2, 2), "min": (2, None), "max": (2, None), "coalesce": (2, None), "total": (1, 1)}
FUNCTION_NAME = re.compile(r"[a-z][a-z0-9_]*\Z")
ARITHMETIC = ("add", "sub", "mul", "div", "pow")
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge")
LITERALS = ("null", "bool", "int", "num", "float", "str", "date", "datetime")
CASTS = ("int", "float", "decimal", "str", "date")
#: By kind: the JSON fields that hold children (a trailing * for a list, a ? for one that may be null), then plain fields with their defaults.
SHAPES = {
    "col": ((), {"name": ...}), "lit": ((), {"type": ..., "value": None}), "binary": (("left", "right"), {"op": ...}), "unary": (("arg",), {"op": ...}),
    "cmp": (("left", "right"), {"op": ...}), "logic": (("args*",), {"op": ...}), "in": (("arg", "values*"), {"negate": False}), "is_null": (("arg",), {"negate": False}),
    "if": (("cond", "then", "otherwise?"), {}), "func": (("args*",), {"name": ...}), "cast": (("arg",), {"to": ..., "scale": None}),
}


@dataclass(frozen=True)
class Node:
    """A kind with children and plain fields; `if` without an else has two children."""

    kind: str
    args: tuple[Node, ...] = ()
    data: tuple[tuple[str, object], ...] = field(default=())

    def __getitem__(self, name: str) -> object:
        return dict(self.data)[name]

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.args))

    def columns(self) -> list[str]:
        return list(dict.fromkeys(n["name"] for n in self.walk() if n.kind == "col"))

    def depth(self) -> int:
        level, deepest = [self], 0
        while level:
            level, deepest = [a for n in level for a in n.args], deepest + 1
        return deepest

    def replace(self, columns: dict[str, Node]) -> Node:
        """With column references replaced by other expressions."""
        if self.kind == "col":
            return columns.get(self["name"], self)
        return Node(self.kind, tuple(a.replace(columns) for a in self.args), self.data)


def node(kind: str, *args: Node, **data: object) -> Node:
    return Node(kind, args, tuple(sorted(data.items())))


def col(name: str) -> Node:
    return node("col", name=name)


def literal(kind: str, value: object) -> Node:
    """A literal of that kind, its value in canonical form. ValueError if it does not fit."""
    if kind not in LITERALS:
        raise ValueError(f"unknown literal type {kind!r}")
    if kind == "null":
        if value is not None:
            raise ValueError(f"null with the value {value!r}")
    elif value is None:
        raise ValueError(f"{kind} without a value")
    elif kind == "bool" and not isinstance(value, bool) or kind == "str" and not isinstance(value, str):
        raise ValueError(f"{value!r} is no {kind}")
    elif kind == "int":
        if isinstance(value, bool) or not (isinstance(value, int) or isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+\s*", value)):
            raise ValueError(f"{value!r} is no whole number")
        value = int(value)
    elif kind == "num":
        value = plain(exact(value))
    elif kind == "float":
        value = float(exact(value))
    elif kind in ("date", "datetime"):
        if isinstance(value, str):
            value = (dt.date if kind == "date" else dt.datetime).fromisoformat(value.strip())
        if not isinstance(value, dt.date) or isinstance(value, dt.datetime) != (kind == "datetime") or getattr(value, "tzinfo", None):
            raise ValueError(f"{value!r} is no {kind} without a time zone")
        value = value.isoformat()
    return node("lit", type=kind, value=value)


def lit(value: object) -> Node:
    """A literal of a plain Python value; floats are kept as the decimal that they are written as."""
    kinds = {type(None): "null", bool: "bool", int: "int", float: "num", Decimal: "num", str: "str", dt.date: "date", dt.datetime: "datetime"}
    return literal(kinds[type(value)], value)


def arity_error(name: str, n: int, least: int, most: int | None) -> str:
    wanted = str(least) if least == most else f"{least}+" if most is None else f"{least}-{most}"
    return f"{name}() takes {wanted} arguments, got {n}"


def validate(n: Node) -> Node:
    """Checks that do not need types. ValueError if one fails."""
    if n.kind == "func":
        name = n["name"]
        if not isinstance(name, str) or not FUNCTION_NAME.match(name):
            raise ValueError(f"invalid function name {name!r}")
        least, most = FUNCTIONS.get(name, (0, None))
        if len(n.args) < least or most is not None and len(n.args) > most:
            raise ValueError(arity_error(name, len(n.args), least, most))
    allowed = {"binary": ARITHMETIC, "cmp": COMPARISONS, "logic": ("and", "or"), "unary": ("neg", "not")}.get(n.kind)
    if allowed and n["op"] not in allowed:
        raise ValueError(f"unknown operator {n['op']!r}")
    if n.kind == "logic" and len(n.args) < 2:
        raise ValueError("and/or needs two arguments")
    if n.kind == "col" and (not isinstance(n["name"], str) or not n["name"]):
        raise ValueError("a column needs a name")
    if n.kind == "in" and (len(n.args) < 2 or any(v.kind != "lit" or v["type"] == "null" for v in n.args[1:])):
        raise ValueError("'in' needs a list of literals that are not null")
    if n.kind == "cast":
        if n["to"] not in CASTS:
            raise ValueError(f"unknown cast {n['to']!r}")
        if (n["to"] == "decimal") != (n["scale"] is not None) or n["scale"] is not None and not (type(n["scale"]) is int and 0 <= n["scale"] <= 38):
            raise ValueError("a cast to decimal, and no other, needs a scale from 0 to 38")
    return n


def parse(value: object, path: str = "") -> Node:
    """An expression from a formula, a plain number, boolean or null, or a JSON tree."""
    from .formula import parse_formula

    if isinstance(value, Node):
        return value
    try:
        if isinstance(value, str):
            return parse_formula(value)
        if value is None or isinstance(value, bool | int | float | Decimal):
            return lit(value)
        return _tree(value, path)
    except SpecError as e:
        raise e.at(path)
    except ValueError as e:
        raise SpecError(str(e), "invalid_request", path) from None


def _tree(value: object, path: str) -> Node:
    if not isinstance(value, dict) or value.get("kind") not in SHAPES:
        raise SpecError("expected a formula or an expression tree", "invalid_request", path)
    children, fields = SHAPES[value["kind"]]
    unknown = set(value) - {"kind", *(c.rstrip("*?") for c in children), *fields}
    if unknown:
        raise SpecError(f"unknown field {sorted(unknown)[0]!r}", "invalid_request", pointer(path, sorted(unknown)[0]))
    args: list[Node] = []
    for c in children:
        name, given = c.rstrip("*?"), value.get(c.rstrip("*?"))
        if c.endswith("*"):
            if not isinstance(given, list | tuple):
                raise SpecError(f"{name} must be a list", "invalid_request", pointer(path, name))
            args += [parse(x, pointer(path, name, i)) for i, x in enumerate(given)]
        elif not (c.endswith("?") and given is None):
            if name not in value:
                raise SpecError(f"{name} is missing", "invalid_request", pointer(path, name))
            args.append(parse(given, pointer(path, name)))
    data = {k: value.get(k, default) for k, default in fields.items()}
    if ... in data.values():
        raise SpecError(f"{value['kind']} needs {', '.join(k for k, v in data.items() if v is ...)}", "invalid_request", path)
    return literal(data["type"], data["value"]) if value["kind"] == "lit" else validate(Node(value["kind"], tuple(args), tuple(sorted(data.items()))))


def to_json(n: Node) -> dict:
    """The tree as JSON, defaults left out."""
    children, fields = SHAPES[n.kind]
    out: dict[str, object] = {"kind": n.kind}
    left = list(n.args)
    for c in children:
        if c.endswith("*"):
            out[c[:-1]], left = [to_json(a) for a in left], []
        elif left:
            out[c.rstrip("?")] = to_json(left.pop(0))
    return out | {k: n[k] for k, default in fields.items() if n[k] != default}
