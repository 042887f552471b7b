"""Checks of user code for values from the future: on the source, and on the plan it makes."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Issue:
    line: int
    rule: str
    text: str


#: Methods that read ahead whatever their arguments are.
AHEAD = {"lead": "lead() reads later rows", "bfill": "filling backward reads later rows", "backfill": "filling backward reads later rows"}


def _negative(node: ast.expr | None) -> bool:
    return isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and node.operand.value != 0


def lint_source(source: str, known_context: frozenset[str] = frozenset()) -> list[Issue]:
    """Issues by line: reads of later rows, frames that reach ahead, unknown calls on ``ctx``, assignments to what is read-only there."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [Issue(e.lineno or 0, "syntax", e.msg)]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else ""
            args = [*node.args, *[k.value for k in node.keywords]]
            if name in AHEAD:
                found.append(Issue(node.lineno, "lookahead", AHEAD[name]))
            elif name in ("shift", "lag", "diff", "pct_change", "ref") and any(_negative(a) for a in args):
                found.append(Issue(node.lineno, "lookahead", f"{name}() with a negative distance reads later rows"))
            elif name in ("rowsBetween", "rangeBetween") and len(node.args) == 2:
                end = node.args[1]
                if (isinstance(end, ast.Constant) and isinstance(end.value, int) and end.value > 0) or (isinstance(end, ast.Attribute) and end.attr == "unboundedFollowing"):
                    found.append(Issue(node.lineno, "lookahead", "the frame reaches later rows"))
            elif name == "fillna" and any(k.arg == "method" and isinstance(k.value, ast.Constant) and k.value.value in ("bfill", "backfill") for k in node.keywords):
                found.append(Issue(node.lineno, "lookahead", "filling backward reads later rows"))
            if known_context and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == "ctx" and name not in known_context:
                found.append(Issue(node.lineno, "context", f"ctx has no {name}()"))
        for target in node.targets if isinstance(node, ast.Assign) else []:
            if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "ctx" and target.attr in ("now", "cash", "total_value"):
                found.append(Issue(node.lineno, "readonly", f"ctx.{target.attr} can't be set"))
    return sorted(found, key=lambda i: (i.line, i.rule, i.text))


def lint_plan(df: DataFrame) -> list[str]:
    """What in the analysed plan reads later rows: lead, and frames that end after the current row (a lag by a negative distance has one)."""
    plan = df._jdf.queryExecution().analyzed().toString()
    found = []
    if re.search(r"\blead\(", plan):
        found.append("lead")
    for end in re.findall(r"specifiedwindowframe\((?:Row|Range)Frame, [^,]+, ([^)]+?)\)", plan):
        if end.startswith("unboundedfollowing") or re.match(r"[1-9]", end):
            found.append("frame reaches ahead")
    return sorted(set(found))
