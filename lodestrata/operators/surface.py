"""What Python source offers, by its syntax tree."""

from __future__ import annotations

import ast


def _public(name: str, exported: set[str] | None) -> bool:
    return name in exported if exported is not None else not name.startswith("_")


def _stub(node: ast.AST) -> bool:
    """Whether a body does nothing, or only raises NotImplementedError."""
    body = [x for x in getattr(node, "body", []) if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))]
    if not body:
        return True
    if len(body) > 1:
        return False
    only = body[0]
    if isinstance(only, ast.Raise):
        raised = only.exc.func if isinstance(only.exc, ast.Call) else only.exc
        return isinstance(raised, ast.Name) and raised.id == "NotImplementedError"
    return isinstance(only, ast.Pass)


def _deprecated(node: ast.AST) -> bool:
    marks = {x.func if isinstance(x, ast.Call) else x for x in getattr(node, "decorator_list", [])}
    return any(getattr(m, "id", getattr(m, "attr", "")) == "deprecated" for m in marks) or "deprecated" in (ast.get_docstring(node) or "").lower()


def _first_line(node: ast.AST) -> str:
    return ((ast.get_docstring(node) or "").strip().split("\n") or [""])[0]


def _exported(tree: ast.Module) -> set[str] | None:
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            return {x.value for x in node.value.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)}
    return None


def python_symbols(source: str) -> list[tuple]:
    """(name, kind, owner, line, doc, stub, deprecated) in source order."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [("", "parse_error", None, 0, "", False, False)]
    out, exported = [], _exported(tree)
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and _public(node.name, exported):
            out.append((node.name, "function", None, node.lineno, _first_line(node), _stub(node), _deprecated(node)))
        elif isinstance(node, ast.ClassDef) and _public(node.name, exported):
            bases = {getattr(b, "id", getattr(b, "attr", "")) for b in node.bases}
            enum = bool(bases & {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"})
            out.append((node.name, "enum" if enum else "class", None, node.lineno, _first_line(node), False, _deprecated(node)))
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and (not x.name.startswith("_") or x.name == "__init__"):
                    kind = "property" if any(getattr(d, "id", "") == "property" for d in x.decorator_list) else "method"
                    out.append((x.name, kind, node.name, x.lineno, _first_line(x), _stub(x), _deprecated(x)))
                elif enum and isinstance(x, ast.Assign):
                    out += [(t.id, "member", node.name, x.lineno, "", False, False) for t in x.targets if isinstance(t, ast.Name) and not t.id.startswith("_")]
    return out


def enum_members(source: str, name: str, line: int | None = None) -> list[tuple[str, str]] | None:
    """(name, value) of an enum class in source order: the text of a literal, `auto()`, or empty. Of several classes of one name
    the one at the line; null where that says nothing."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    found = [x for x in ast.walk(tree) if isinstance(x, ast.ClassDef) and x.name == name]
    own = next((x for x in found if x.lineno == line), found[0] if len(found) == 1 else None)
    if own is None:
        return None

    def value(node: ast.expr) -> str:
        if isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) == "auto":
            return "auto()"
        try:
            ast.literal_eval(node)
        except (ValueError, TypeError, SyntaxError):
            return ""
        return ast.get_source_segment(source, node) or ""

    plain = [x for x in own.body if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name)]
    return [(x.targets[0].id, value(x.value)) for x in plain if not x.targets[0].id.startswith("_")]
