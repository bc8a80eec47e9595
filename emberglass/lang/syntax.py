"""Reading rule texts: a subset of Python's grammar, checked statement by statement."""

from __future__ import annotations

import ast
import hashlib
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from pathlib import Path

from .values import RuleError

_BIN = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.LShift, ast.RShift, ast.BitOr, ast.BitXor, ast.BitAnd)
_CMP = (ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn)


@dataclass
class RuleFile:
    path: str
    assigns: dict[str, ast.expr] = field(default_factory=dict)
    notes: dict[str, ast.expr] = field(default_factory=dict)
    calls: list[ast.Call] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    requires: list[ast.Call] = field(default_factory=list)


def fail(path: str, node: ast.AST | None, why: str) -> RuleError:
    return RuleError(f"{path}:{getattr(node, 'lineno', 1)}: {why}")


def check_expression(path: str, e: ast.expr) -> None:
    """Refuses whatever the language has no meaning for."""
    if isinstance(e, ast.Constant):
        if not (e.value is None or isinstance(e.value, bool | int | float | str)):
            raise fail(path, e, "this literal is not supported")
    elif isinstance(e, ast.Name):
        pass
    elif isinstance(e, ast.List):
        for x in e.elts:
            check_expression(path, x)
    elif isinstance(e, ast.JoinedStr):
        for x in e.values:
            if isinstance(x, ast.FormattedValue) and not (isinstance(x.value, ast.Name) and x.conversion == -1 and x.format_spec is None):
                raise fail(path, e, "an f-string takes bare names only")
    elif isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub | ast.Not):
        check_expression(path, e.operand)
    elif isinstance(e, ast.BinOp) and isinstance(e.op, _BIN):
        check_expression(path, e.left)
        check_expression(path, e.right)
    elif isinstance(e, ast.BoolOp):
        for x in e.values:
            check_expression(path, x)
    elif isinstance(e, ast.Compare):
        if len(e.ops) != 1 or not isinstance(e.ops[0], _CMP):
            raise fail(path, e, "one comparison at a time, without 'is'")
        check_expression(path, e.left)
        check_expression(path, e.comparators[0])
    elif isinstance(e, ast.Call):
        if not isinstance(e.func, ast.Name):
            raise fail(path, e, "only plain functions can be called")
        if e.args or any(k.arg is None for k in e.keywords):
            raise fail(path, e, f"{e.func.id} takes keyword arguments only")
        if len({k.arg for k in e.keywords}) < len(e.keywords):
            raise fail(path, e, f"{e.func.id} gets an argument twice")
        for k in e.keywords:
            check_expression(path, k.value)
    else:
        raise fail(path, e, f"{type(e).__name__} is not part of the language")


def _const_strings(f: RuleFile, call: ast.Call, arg: str) -> list[str]:
    value = next((k.value for k in call.keywords if k.arg == arg), None)
    if not isinstance(value, ast.List) or not all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in value.elts):
        raise fail(f.path, call, f"{arg} must be a list of strings")
    return [x.value for x in value.elts]


def parse_file(path: str, text: str) -> RuleFile:
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        raise RuleError(f"{path}:{e.lineno}: {e.msg}") from None
    f = RuleFile(path)
    for s in tree.body:
        if isinstance(s, ast.Assign | ast.AnnAssign):
            targets = s.targets if isinstance(s, ast.Assign) else [s.target]
            if len(targets) != 1 or not isinstance(targets[0], ast.Name) or s.value is None:
                raise fail(path, s, "an assignment has one name and one value")
            name = targets[0].id
            if name in f.assigns:
                raise fail(path, s, f"{name} is assigned twice")
            check_expression(path, s.value)
            f.assigns[name] = s.value
            if isinstance(s, ast.AnnAssign):
                f.notes[name] = s.annotation
        elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
            check_expression(path, s.value)
            name = s.value.func.id
            if name == "Import":
                paths = _const_strings(f, s.value, "rules")
                if paths != sorted(set(paths)):
                    raise fail(path, s, "imports must be sorted and named once")
                f.imports += paths
            elif name == "Require":
                f.requires.append(s.value)
            else:
                f.calls.append(s.value)
        else:
            raise fail(path, s, "a statement is an assignment or a call")
    return f


@dataclass
class Sources:
    """Rule texts by path, rooted at ``main.sml``, and the configuration."""

    texts: dict[str, str]
    config: dict = field(default_factory=dict)

    @classmethod
    def from_path(cls, root: str) -> Sources:
        """Reads ``*.sml`` files, ``config.yaml`` and ``config/*.yaml`` under a folder."""
        base = Path(root)
        texts = {str(p.relative_to(base)): p.read_text() for p in sorted(base.rglob("*.sml"))}
        config: dict = {}
        files = [p for p in (base / "config.yaml", *sorted((base / "config").glob("*.yaml"))) if p.exists()]
        if files:
            import yaml

            for p in files:
                config.update(yaml.safe_load(p.read_text()) or {})
        return cls(texts, config)

    @property
    def hash(self) -> str:
        """Identity of the rule texts and configuration."""
        return hashlib.sha256(repr((sorted(self.texts.items()), sorted(self.config.items(), key=str))).encode()).hexdigest()

    def files(self) -> dict[str, RuleFile]:
        if "main.sml" not in self.texts:
            raise RuleError("main.sml: missing")
        return {p: parse_file(p, t) for p, t in self.texts.items()}

    def matching(self, pattern: str) -> list[str]:
        return sorted(p for p in self.texts if fnmatchcase(p, pattern))

    def known_action_names(self) -> list[str]:
        """Names of the files under ``actions/``."""
        return sorted(Path(p).stem for p in self.texts if p.startswith("actions/"))


def import_order(files: dict[str, RuleFile]) -> list[str]:
    """Files with each after those it imports; a cycle or a missing file is refused."""
    done: list[str] = []
    at: set[str] = set()

    def visit(p: str, by: str) -> None:
        if p not in files:
            raise RuleError(f"{by}:1: imports {p}, which does not exist")
        if p in at:
            raise RuleError(f"{p}:1: imports must not have cycles")
        if p in done:
            return
        at.add(p)
        for q in files[p].imports:
            visit(q, p)
        at.discard(p)
        done.append(p)

    for p in sorted(files):
        visit(p, p)
    return done
