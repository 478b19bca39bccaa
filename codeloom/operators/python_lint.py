"""Checks of Python source on its syntax tree and lines: a subset of what the well-known checkers find.

errors      E999, UndefinedName, UndefinedLocal, UnusedImport, ImportShadowedByLoopVar, ImportStarUsed, UnusedVariable,
            RedefinedWhileUnused, DuplicateArgument, ReturnOutsideFunction, BreakOutsideLoop, ContinueOutsideLoop,
            FStringMissingPlaceholders, IsLiteral, AssertTuple, IfTuple, RaiseNotImplemented, repeated dictionary keys
style       E501 (100), E302, E303, E305, E401, E701, E703, E711, E712, E722, W191, W291, W292, W293, W391, and those of python_spacing
complexity  cyclomatic complexity of functions, methods and classes above 5, with ranks
security    the tests of python_security
index       maintainability index from Halstead volume, complexity, lines and comments

This is partial parity with those checkers, stated as such in the README.
"""

import ast
import builtins
import math
import re
from collections import Counter
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import python_security, python_spacing
from codeloom.operators.python_code import DEFINING, FUNCTIONS, HOLDERS, INFO, UNPARSED, children, nodes, parsed, python_column, structure, walk
from codeloom.operators.rules import ISSUE, style_score
from codeloom.operators.triage import complexity_issue_columns, complexity_rank

# Severities of error codes; others are info.
SEVERITY = {
    "UndefinedName": "error", "UndefinedLocal": "error", "DuplicateArgument": "error", "ReturnOutsideFunction": "error", "BreakOutsideLoop": "error",
    "ContinueOutsideLoop": "error", "UnusedImport": "warning", "ImportShadowedByLoopVar": "warning", "RedefinedWhileUnused": "warning", "UnusedVariable": "warning",
}
BLOCK = "array<struct<line:int,name:string,complexity:int>>"
SECURITY = "array<struct<line:int,col:int,code:string,message:string,severity:string,category:string,bandit_severity:string,bandit_confidence:string,cwe:string>>"
LOOPS = (ast.For, ast.AsyncFor, ast.While)
SCOPES = (*FUNCTIONS, ast.Lambda, ast.ClassDef)
CLOSED = (*SCOPES, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
IMPORTING = (ast.Import, ast.ImportFrom)
ASSIGNING = (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)
#: Kinds of nodes that a check looks at: those that bind names, that may mean something else, that are decisions.
BINDING = frozenset([ast.Name, *IMPORTING, ast.arg, ast.Global, ast.Nonlocal, *(c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST) and {"name", "rest"} & {*c._fields})])
SUSPECTS = (ast.JoinedStr, ast.Compare, ast.Assert, ast.If, ast.IfExp, ast.Raise, ast.Dict, ast.ImportFrom, ast.ExceptHandler)
DECIDING = frozenset([ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler, *LOOPS, ast.Try, ast.BoolOp, ast.comprehension, ast.match_case])


def found(line: int, col: int, code: str, message: str, severity: str, category: str) -> dict:
    return {"line": line, "col": col, "code": code, "message": message, "severity": severity, "category": category}


#: What parsed() says of a text; functions that take it parse themselves without.
Module = tuple[ast.Module | None, dict | None]


def errors(code: str, module: Module | None = None) -> list[dict]:
    if not code.strip():
        return []
    tree, wrong = module or parsed(code)
    if tree is None:
        return [found(wrong["lineno"] or 0, wrong["offset"] or 0, "E999", f"SyntaxError: {wrong['message']}", "error", "error")]
    out = []

    def flag(node: ast.AST, kind: str, message: str) -> None:
        out.append(found(node.lineno, node.col_offset + 1, kind, message, SEVERITY.get(kind, "info"), "error"))

    used = {n.id for n in nodes(tree, ast.Name) if type(n.ctx) is not ast.Store}
    used |= {c.value for n in nodes(tree, ast.Assign) if any(getattr(t, "id", "") == "__all__" for t in n.targets) for c in walk(n.value) if isinstance(c, ast.Constant)}
    bound = _bound(tree)
    star = any(a.name == "*" for n in nodes(tree, ast.ImportFrom) for a in n.names)
    for n in nodes(tree, ast.Name, ast.Import, ast.ImportFrom, *FUNCTIONS):
        if type(n) is ast.Name:
            if n.id not in bound and not star and type(n.ctx) is ast.Load and not hasattr(builtins, n.id) and n.id not in ("__file__", "__name__"):
                flag(n, "UndefinedName", f"undefined name {n.id!r}")
        elif isinstance(n, IMPORTING) and getattr(n, "module", "") != "__future__":
            for a in n.names:
                name, start = a.asname or a.name.split(".")[0], "" if isinstance(n, ast.Import) else "." * n.level + (n.module or "")
                whole = start + ("" if start.endswith(".") or not start else ".") + a.name
                if a.name != "*" and name not in used:
                    flag(n, "UnusedImport", f"{whole + (f' as {a.asname}' if a.asname else '')!r} imported but unused")
        elif isinstance(n, FUNCTIONS):
            args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *filter(None, (n.args.vararg, n.args.kwarg))]
            times = Counter(a.arg for a in args)
            for a in {a.arg: a for a in args if times[a.arg] > 1}.values():
                flag(n, "DuplicateArgument", f"duplicate argument {a.arg!r} in function definition")
            assigned = [m for m in nodes(n, ast.Assign, ast.AnnAssign) if m.value is not None]
            reads = {m.id for m in nodes(n, ast.Name) if type(m.ctx) is not ast.Store} | {x for m in nodes(n, ast.Global, ast.Nonlocal) for x in m.names} if assigned else set()
            if "locals" not in reads:
                unread = [(m, t) for m in assigned for t in (m.targets if isinstance(m, ast.Assign) else [m.target]) if isinstance(t, ast.Name) and t.id not in reads]
                own = _own(n) if unread else set()
                for m, t in unread:
                    if id(m) in own:
                        flag(t, "UnusedVariable", f"local variable {t.id!r} is assigned to but never used")
    _misplaced(tree.body, False, False, flag)
    _redefined(tree, flag)
    _shadowed(tree, flag)
    _suspicious(tree, flag)
    return sorted(out, key=lambda x: x["line"])


def _in_order(body: list[ast.stmt]):  # noqa: ANN202
    """(name, whether it is read) of a function's own scope in the order of evaluation; an augmented target is read, then written."""
    waiting: list = [(n, None) for n in reversed(body)]
    while waiting:
        node, read = waiting.pop()
        if isinstance(node, ast.Name):
            yield node, isinstance(node.ctx, ast.Load) if read is None else read
            continue
        if isinstance(node, CLOSED):
            continue
        parts = [(p, None) for p in children(node)]
        if isinstance(node, ASSIGNING):
            parts.sort(key=lambda p: p[0] is not node.value)
        elif isinstance(node, ast.For | ast.AsyncFor):
            parts = [(p, None) for p in (node.iter, node.target, *node.body, *node.orelse)]
        if isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
            parts.insert(0, (node.target, True))
        waiting += reversed(parts)


def _shadowed(tree: ast.Module, flag) -> None:  # noqa: ANN001
    """Names of the module that a function reads before it makes them its own, and imports that a loop writes over."""
    lines = {n.id: n.lineno for s in tree.body if not isinstance(s, SCOPES) for n in nodes(s, ast.Name) if type(n.ctx) is ast.Store}
    imported: dict[str, int] = {}
    for n in nodes(tree, *IMPORTING):
        for a in n.names:
            imported.setdefault(a.asname or a.name.split(".")[0], n.lineno)
    for n in nodes(tree, ast.For, ast.AsyncFor, *FUNCTIONS):
        if isinstance(n, ast.For | ast.AsyncFor):
            for t in walk(n.target):
                if isinstance(t, ast.Name) and isinstance(t.ctx, ast.Store) and imported.get(t.id, t.lineno) < t.lineno:
                    flag(t, "ImportShadowedByLoopVar", f"import {t.id!r} from line {imported[t.id]} shadowed by loop variable")
        elif isinstance(n, FUNCTIONS) and lines and any(m.id in lines for m in nodes(n, ast.Name)):
            args = {a.arg for a in nodes(n.args, ast.arg)}
            declared = {x for m in nodes(n, ast.Global, ast.Nonlocal) for x in m.names}
            read, written = {}, args | declared
            for name, reads in _in_order(n.body):
                if reads:
                    read[name.id] = name
                elif name.id not in written:
                    written.add(name.id)
                    if name.id in read and name.id in lines:
                        flag(read[name.id], "UndefinedLocal", f"local variable {name.id!r} defined in enclosing scope on line {lines[name.id]} referenced before assignment")


def _suspicious(tree: ast.Module, flag) -> None:  # noqa: ANN001
    """Expressions that mean something else than they seem to."""
    specs = {id(v.format_spec) for v in nodes(tree, ast.FormattedValue)}
    for n in nodes(tree, *SUSPECTS):
        if isinstance(n, ast.JoinedStr) and id(n) not in specs and not any(isinstance(v, ast.FormattedValue) for v in n.values):
            flag(n, "FStringMissingPlaceholders", "f-string is missing placeholders")
        elif isinstance(n, ast.Compare):
            sides = [n.left, *n.comparators]
            for op, a, b in zip(n.ops, sides, sides[1:], strict=False):
                if isinstance(op, ast.Is | ast.IsNot) and any(_literal(x) for x in (a, b)):
                    flag(n, "IsLiteral", "use ==/!= to compare constant literals (str, bytes, int, float, tuple)")
        elif isinstance(n, ast.Assert) and isinstance(n.test, ast.Tuple) and n.test.elts:
            flag(n, "AssertTuple", "assertion is always true, perhaps remove parentheses?")
        elif isinstance(n, ast.If | ast.IfExp) and isinstance(n.test, ast.Tuple) and n.test.elts:
            flag(n, "IfTuple", "'if tuple literal' is always true, perhaps remove accidental comma?")
        elif isinstance(n, ast.Raise) and getattr(n.exc.func if isinstance(n.exc, ast.Call) else n.exc, "id", "") == "NotImplemented":
            flag(n, "RaiseNotImplemented", "'raise NotImplemented' should be 'raise NotImplementedError'")
        elif isinstance(n, ast.Dict):
            values: dict[str, list] = {}
            for k, v in zip(n.keys, n.values, strict=True):
                if isinstance(k, ast.Constant | ast.Name):
                    values.setdefault(ast.dump(k), []).append((k, ast.dump(v)))
            for k, _ in (x for same in values.values() if len({v for _, v in same}) > 1 for x in same):
                name = k.id if isinstance(k, ast.Name) else repr(k.value)
                flag(k, "MultiValueRepeatedKeyVariable" if isinstance(k, ast.Name) else "MultiValueRepeatedKeyLiteral", f"dictionary key {'variable ' * isinstance(k, ast.Name)}{name} repeated with different values")
        elif isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names):
            flag(n, "ImportStarUsed", f"'from {'.' * n.level}{n.module or ''} import *' used; unable to detect undefined names")
        elif isinstance(n, ast.ExceptHandler) and n.name and not any(isinstance(m, ast.Name) and m.id == n.name and not isinstance(m.ctx, ast.Store) for s in n.body for m in walk(s)):
            flag(n, "UnusedVariable", f"local variable {n.name!r} is assigned to but never used")


def _literal(node: ast.AST) -> bool:
    return (isinstance(node, ast.Tuple) and all(_literal(x) for x in node.elts)) or (isinstance(node, ast.Constant) and isinstance(node.value, str | bytes | int | float) and not isinstance(node.value, bool))


def _own(function: ast.AST) -> set[int]:
    """Identities of the nodes that stand in the function itself, not in a scope inside it."""
    found, waiting = set(), [*children(function)]
    while waiting:
        node = waiting.pop()
        found.add(id(node))
        if not isinstance(node, SCOPES):
            waiting += children(node)
    return found


def _bound(tree: ast.AST) -> set[str]:
    """Every name that the module binds anywhere."""
    names = set()
    for n in nodes(tree, *BINDING):
        if type(n) is ast.Name:
            if type(n.ctx) is not ast.Load:
                names.add(n.id)
        elif isinstance(n, ast.Import | ast.ImportFrom):
            names |= {a.asname or a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.arg):
            names.add(n.arg)
        elif isinstance(n, ast.Global | ast.Nonlocal):
            names |= {*n.names}
        elif name := getattr(n, "name", None) or getattr(n, "rest", None):
            names.add(name if isinstance(name, str) else getattr(name, "id", ""))
    return names


def _misplaced(body: list[ast.stmt], in_function: bool, in_loop: bool, flag) -> None:  # noqa: ANN001
    for n in body:
        if isinstance(n, ast.Return) and not in_function:
            flag(n, "ReturnOutsideFunction", "'return' outside function")
        elif isinstance(n, ast.Break) and not in_loop:
            flag(n, "BreakOutsideLoop", "'break' outside loop")
        elif isinstance(n, ast.Continue) and not in_loop:
            flag(n, "ContinueOutsideLoop", "'continue' not properly in loop")
        elif isinstance(n, FUNCTIONS):
            _misplaced(n.body, True, False, flag)
        elif isinstance(n, ast.ClassDef):
            _misplaced(n.body, False, False, flag)
        elif type(n) in HOLDERS:
            for name in ("body", "orelse", "finalbody"):
                _misplaced(getattr(n, name, []), in_function, in_loop or (isinstance(n, LOOPS) and name == "body"), flag)
            for part in (*getattr(n, "handlers", []), *getattr(n, "cases", [])):
                _misplaced(part.body, in_function, in_loop, flag)


def _redefined(tree: ast.Module, flag) -> None:  # noqa: ANN001
    """Definitions of a module or class body that replace an earlier one that nothing reads in between."""
    for scope in [tree, *nodes(tree, ast.ClassDef)]:
        last: dict[str, int] = {}
        named = [[a.asname or a.name.split(".")[0] for a in n.names] if isinstance(n, IMPORTING) else [n.name] if type(n) in DEFINING else [] for n in scope.body]
        if max(Counter(x for names in named for x in {*names}).values(), default=0) < 2:
            continue
        for n, names in zip(scope.body, named, strict=True):
            decorated = bool(getattr(n, "decorator_list", None))
            reads = {m.id for m in nodes(n, ast.Name) if type(m.ctx) is ast.Load}
            for name in names:
                if name in last and not decorated and name not in reads:
                    flag(n, "RedefinedWhileUnused", f"redefinition of unused {name!r} from line {last[name]}")
            for name in reads:
                last.pop(name, None)
            last |= dict.fromkeys(names, n.lineno)


TOP, CLOSING = re.compile(r"(async def|def|class|@)\b|@"), re.compile(r"[)\]}#]|else|elif|except|finally")
IMPORTED_TWO, BARE_EXCEPT = re.compile(r"\s*import\s+\w[\w.]*\s*,"), re.compile(r"\s*except\s*:")
TO_NONE, TO_TRUTH = re.compile(r"(==|!=)\s*None\b"), re.compile(r"(==|!=)\s*(True|False)\b")
ON_ONE_LINE = re.compile(r"\s*(if|while|for|else|try|with)\b[^#'\"\[{(]*:\s+[^\s#]")


def style(code: str, module: Module | None = None) -> list[dict]:
    if not code.strip():
        return []
    out, lines, blank = [], code.splitlines(), 0

    def flag(line: int, col: int, kind: str, message: str) -> None:
        out.append(found(line, col, kind, message, "error" if kind[0] == "E" else "warning", "style"))

    in_block = False
    for n, line in enumerate(lines, 1):
        bare, indent = line.rstrip(), line[: len(line) - len(line.lstrip())]
        if not bare:
            if line:
                flag(n, 1, "W293", "blank line contains whitespace")
            blank += 1
            continue
        if len(bare) < len(line):
            flag(n, len(bare) + 1, "W291", "trailing whitespace")
        if "\t" in indent:
            flag(n, 1, "W191", "indentation contains tabs")
        if len(line) > 100:
            flag(n, 101, "E501", f"line too long ({len(line)} > 100 characters)")
        top = TOP.match(bare) if bare[0] in "adc@" else None
        before = lines[n - 2 - blank].rstrip() if n - 2 - blank >= 0 else ""
        if blank > 2 or (indent and blank > 1):
            flag(n, len(indent) + 1, "E303", f"too many blank lines ({blank})")
        elif top and blank < 2 and n - 1 - blank > 0 and not before.startswith("@") and not before.startswith("#"):
            flag(n, 1, "E302", f"expected 2 blank lines, found {blank}")
        elif not indent and in_block and not top and blank < 2 and before[:1] in (" ", "\t") and not CLOSING.match(bare):
            flag(n, 1, "E305", f"expected 2 blank lines after class or function definition, found {blank}")
        in_block = bool(top) or (in_block and bool(indent))
        if "import" in bare and IMPORTED_TWO.match(bare):
            flag(n, bare.index(",") + 1, "E401", "multiple imports on one line")
        if "except" in bare and BARE_EXCEPT.match(bare):
            flag(n, len(indent) + 1, "E722", "do not use bare 'except'")
        compared = "==" in bare or "!=" in bare
        if bare.endswith(";"):
            flag(n, len(bare), "E703", "statement ends with a semicolon")
        if compared and (m := TO_NONE.search(bare)):
            flag(n, m.start() + 1, "E711", f"comparison to None should be 'if cond is {'not ' * (m[1] == '!=')}None:'")
        if compared and (m := TO_TRUTH.search(bare)):
            flag(n, m.start() + 1, "E712", f"comparison to {m[2]} should be 'if cond is {m[2]}:' or 'if cond:'")
        if ":" in bare[:-1] and (m := ON_ONE_LINE.match(bare)):
            flag(n, m.end() - 1, "E701", "multiple statements on one line (colon)")
        blank = 0
    if blank:
        flag(len(lines) - blank + 1, 1, "W391", "blank line at end of file")
    elif not code.endswith(("\n", "\r")):
        flag(len(lines), len(lines[-1]) + 1, "W292", "no newline at end of file")
    for finding in python_spacing.findings(code, (module or parsed(code))[0]):
        flag(*finding)
    return out


def branches(node: ast.AST) -> int:
    """Decisions of a block, nested functions included."""
    total = 0
    for n in nodes(node, *DECIDING):
        if isinstance(n, ast.If | ast.IfExp | ast.Assert | ast.ExceptHandler):
            total += 1
        elif isinstance(n, LOOPS):
            total += 1 + bool(n.orelse)
        elif isinstance(n, ast.Try):
            total += bool(n.orelse)
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += 1 + len(n.ifs)
        elif isinstance(n, ast.match_case):
            total += not (isinstance(n.pattern, ast.MatchAs) and n.pattern.pattern is None and n.pattern.name is None)
    return total


def blocks(code: str, module: Module | None = None) -> list[dict]:
    """Functions, methods and classes with their complexity; a class has the mean of its methods and one more."""
    tree, out = (module or parsed(code))[0], []
    for n in tree.body if tree else ():
        if isinstance(n, FUNCTIONS):
            out.append({"line": n.lineno, "name": n.name, "complexity": 1 + branches(n)})
        elif isinstance(n, ast.ClassDef):
            methods = [{"line": m.lineno, "name": m.name, "complexity": 1 + branches(m)} for m in n.body if isinstance(m, FUNCTIONS)]
            mean = sum(m["complexity"] for m in methods) / len(methods) + (len(methods) > 1) if methods else 1
            out += [*methods, {"line": n.lineno, "name": n.name, "complexity": int(mean)}]
    return out


def maintainability(code: str, module: Module | None = None) -> int:
    """0 to 100; 100 for blank or unparsable code."""
    tree = (module or parsed(code))[0] if code.strip() else None
    if tree is None:
        return 100
    operators, operands = Counter(), Counter()
    for n in nodes(tree, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign, ast.Compare):
        kinds = {ast.BinOp: "op", ast.UnaryOp: "op", ast.BoolOp: "op", ast.AugAssign: "op"}
        if type(n) in kinds:
            operators[type(n.op).__name__] += 1
            parts = [n.left, n.right] if isinstance(n, ast.BinOp) else [n.operand] if isinstance(n, ast.UnaryOp) else n.values if isinstance(n, ast.BoolOp) else [n.target, n.value]
        elif isinstance(n, ast.Compare):
            operators.update(type(o).__name__ for o in n.ops)
            parts = [n.left, *n.comparators]
        else:
            continue
        operands.update(ast.dump(p) for p in parts)
    size = sum(operators.values()) + sum(operands.values())
    volume = size * math.log2(max(1, len(operators) + len(operands)))
    lines = [x.strip() for x in code.splitlines() if x.strip()]
    source = sum(not x.startswith("#") for x in lines)
    comments = math.radians(100 * (len(lines) - source) / max(1, len(lines)))
    if volume <= 0 or source <= 0:
        return 100
    index = 171 - 5.2 * math.log(volume) - 0.23 * (1 + branches(tree)) - 16.2 * math.log(source) + 50 * math.sin(math.sqrt(2.4 * comments))
    return max(0, min(100, round(index * 100 / 171)))


def security(code: str, module: Module | None = None) -> list[dict]:
    tree = (module or parsed(code))[0] if code.strip() else None
    out = [
        found(n.lineno, 1, test, message, "error" if severity in ("HIGH", "MEDIUM") else "warning", "security") | {"bandit_severity": severity, "bandit_confidence": confidence, "cwe": str(cwe)}
        for n, test, message, severity, confidence, cwe in (python_security.findings(tree) if tree else ())
    ]
    return sorted(out, key=lambda x: x["line"])


#: Checks and what they give.
LINT = {"errors": f"array<{ISSUE}>", "style_issues": f"array<{ISSUE}>", "security_issues": SECURITY, "_blocks": BLOCK, "maintainability": "int", "ast_info": INFO}
#: Numbers alone, for those who need no more of a check.
NUMBERS = {"_n_style": "int", "complexity": "int"}
#: Columns that are made of what a check of another name gives.
MADE = {"style_score": "_n_style", "complexity_issues": "_blocks"}


def attempt(check: Callable[[str, Module], object], code: str, module: Module, otherwise: Callable[[Exception], object]) -> object:
    """What a check says, or otherwise where an expression is nested too deeply for it: one such file must not end the job."""
    try:
        return check(code, module)
    except UNPARSED as e:
        return otherwise(e)


def lint(code: str, checks: Collection[str] = (*LINT,)) -> dict:
    """What checks of LINT and NUMBERS give, from one parse. A check that a file's nesting defeats finds nothing (errors: E999; index: 100)."""
    module = parsed(code) if code.strip() else (ast.Module([], []), None)
    unexpected = lambda e: [found(0, 0, "E999", f"{type(e).__name__}: {e}", "error", "error")]
    nothing = lambda _: []
    made = {
        "errors": lambda: attempt(errors, code, module, unexpected), "style_issues": lambda: sorted(attempt(style, code, module, nothing), key=lambda x: x["line"]),
        "_n_style": lambda: len(attempt(style, code, module, nothing)), "complexity": lambda: structure(code, module)["complexity"],
        "security_issues": lambda: attempt(security, code, module, nothing), "_blocks": lambda: attempt(blocks, code, module, nothing),
        "maintainability": lambda: attempt(maintainability, code, module, lambda _: 100), "ast_info": lambda: structure(code, module),
    }
    return {name: made[name]() for name in checks}


def with_lint(files: DataFrame, *columns: str) -> DataFrame:
    """Python files with errors, style_issues, style_score, security_issues, complexity_issues, maintainability and ast_info, or with those
    of them that are named (complexity, that of ast_info, may be too): one Python function, which parses a file once and runs no other checks."""
    asked = columns or (*LINT, *MADE)
    wanted = {MADE.get(c, c) for c in asked}
    if "style_issues" in wanted:
        wanted.discard("_n_style")
    kinds = {c: kind for c, kind in (LINT | NUMBERS).items() if c in wanted}
    checks = [*kinds]
    empty = lint("", checks)
    made = files.withColumn("_lint", python_column("code", lambda code: lint(code, checks) if code else empty, f"struct<{','.join(f'{c}:{kind}' for c, kind in kinds.items())}>"))
    made = made.select(*files.columns, "_lint.*")

    def as_issue(b):  # noqa: ANN001, ANN202
        rank = complexity_rank(b["complexity"])
        cols = complexity_issue_columns(b["name"], b["complexity"], rank)
        return F.struct(
            b["line"].alias("line"), F.lit(1).alias("col"), *[c.alias(n) for n, c in cols.items()], b["name"].alias("name"), b["complexity"].alias("complexity"), rank.alias("rank")
        )

    above = F.array_sort(F.filter("_blocks", lambda b: b["complexity"] > 5), lambda a, b: b["complexity"] - a["complexity"])
    more = {"style_score": lambda: style_score(F.col("_n_style") if "_n_style" in checks else F.size("style_issues")), "complexity_issues": lambda: F.transform(above, as_issue)}
    return made.withColumns({name: value() for name, value in more.items() if name in asked}).drop("_blocks", "_n_style")
