"""Static checks of event plugins before they run."""

from __future__ import annotations

import ast

# What a causal plugin has no use for.
MODULES = frozenset("os sys subprocess socket requests urllib random time datetime pathlib shutil pickle importlib builtins".split())
CALLS = frozenset("open exec eval compile input __import__ bfill backfill interpolate".split())


def problems(source: str) -> list[str]:
    """Reasons, with their lines, why a plugin's source is refused; empty if none.

    Numbers other than 0 and 1 belong into the registered parameters; modules with access to clocks, files,
    randomness or the network, and calls that reach forward in time (a negative shift, back-filling, a
    centred window), are not causal."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"{e.lineno}: not valid Python"]
    found: list[tuple[int, str]] = []
    for node in ast.walk(tree):
        line = getattr(node, "lineno", 0)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float) and node.value not in (0, 1):
            found.append((line, f"literal {node.value!r}: register it as a parameter"))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]
            found += [(line, f"import of {n}") for n in names if n.split(".")[0] in MODULES]
        elif isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            words = {k.arg: k.value for k in node.keywords}
            if name in CALLS:
                found.append((line, f"call of {name}"))
            back = words.get("periods", node.args[0] if node.args else None)
            if name == "shift" and isinstance(back, ast.UnaryOp) and isinstance(back.op, ast.USub):
                found.append((line, "negative shift"))
            fill = words.get("method")
            if isinstance(fill, ast.Constant) and fill.value in ("bfill", "backfill"):
                found.append((line, "back-filling"))
            centre = words.get("center")
            if centre is not None and not (isinstance(centre, ast.Constant) and centre.value is False):
                found.append((line, "centred window"))
    return [f"{line}: {what}" for line, what in sorted(set(found))]
