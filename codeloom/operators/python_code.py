"""Structure of Python source: one parse per file in Arrow batches, everything else as native expressions on its result."""

import ast
import re
import warnings
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import is_blank, split_lines
from codeloom.operators.retrieval import chunk_rows

FUNCTION = "struct<name:string,lineno:int,args:array<string>,class:string,decorators:array<string>,docstring:string,line_count:int>"
CLASS = "struct<name:string,lineno:int,bases:array<string>,docstring:string>"
INFO = (
    "struct<syntax_ok:boolean,syntax_error:struct<message:string,lineno:int,offset:int,text:string>,"
    f"functions:array<{FUNCTION}>,classes:array<{CLASS}>,imports:array<string>,complexity:int,line_count:int,node_count:int>"
)
CHUNK = "array<struct<name:string,line:int,kind:string,code:string>>"
GRAPH = "struct<nodes:array<struct<node_id:int,label:string,color:string>>,edges:array<struct<src:int,dst:int,label:string>>>"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
DEFINING = frozenset([*FUNCTIONS, ast.ClassDef])
#: Nodes that add a branch each.
BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert)
UNPARSED = (ValueError, RecursionError, MemoryError)
#: Ends of lines as the parser counts them: a form feed, say, ends none.
ENDS = re.compile(r"\r\n|\r|\n")
KINDS = [c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)]
#: Fields of each kind of node in which nodes may stand: in the others are texts, numbers and constants.
FIELDS = {c: tuple(f for f in c._fields if getattr(c, "_field_types", {}).get(f) not in (str, int, object, str | None, int | None, list[str])) for c in KINDS}
#: Kinds of nodes below which definitions may stand.
HOLDERS = frozenset(c for c in KINDS if issubclass(c, ast.mod | ast.excepthandler | ast.match_case) or (issubclass(c, ast.stmt) and "body" in c._fields) or c.__name__ == "Match")


def python_column(column: str, analyse: Callable[[str], object], schema: str) -> Column:
    """analyse(code) of a text column; batches are Arrow."""
    return F.udf(lambda code: analyse(code or ""), schema, useArrow=True)(F.col(column))


def parsed(code: str) -> tuple[ast.Module | None, dict | None]:
    """The module, or what is wrong with it."""
    try:
        with warnings.catch_warnings():  # of escapes in the analysed code: a worker's log is no place for them
            warnings.simplefilter("ignore")
            return ast.parse(code), None
    except SyntaxError as e:
        return None, {"message": str(e.msg), "lineno": e.lineno, "offset": e.offset, "text": e.text or ""}
    except UNPARSED as e:
        return None, {"message": f"{type(e).__name__}: {e}", "lineno": None, "offset": None, "text": ""}


def children(node: ast.AST) -> Sequence[ast.AST]:
    """The nodes below a node, as ast.iter_child_nodes gives them, found once a node."""
    if type(node) is ast.Name:
        return (node.ctx,)
    if not (fields := FIELDS[type(node)]):
        return ()
    if (below := getattr(node, "_below", None)) is None:
        below = []
        for name in fields:
            value = getattr(node, name, None)
            if type(value) is list:
                below += value if None not in value else [v for v in value if v is not None]
            elif value is not None:
                below.append(value)
        node._below = below
    return below


def walk(node: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk, in its order, found once a node."""
    if (known := getattr(node, "_all", None)) is not None:
        return [node, *known]
    found = [node]
    for n in found:
        if FIELDS[type(n)]:
            found += children(n)
    node._all = found[1:]
    return found


def nodes(tree: ast.AST, *kinds: type) -> list[ast.AST]:
    """The nodes of walk that are of some kinds; those of a module are sorted by kind once."""
    if not isinstance(tree, ast.Module):
        kinds = frozenset(kinds)
        return [n for n in walk(tree) if type(n) in kinds]
    if (known := getattr(tree, "_kinds", None)) is None:
        known = tree._kinds = {}
        for place in enumerate(walk(tree)):
            known.setdefault(type(place[1]), []).append(place)
        known.pop(ast.Module, None)  # no cycle, which would wait for the collector
    return [n for _, n in sorted(place for kind in {*kinds} & known.keys() for place in known[kind])]


def outline(tree: ast.AST) -> Iterator[tuple[ast.AST, str | None]]:
    """(node, enclosing class) of statements and what else holds statements, in source order of the tree, parents first."""
    waiting = [(tree, None)]
    while waiting:
        node, owner = waiting.pop()
        yield node, owner
        if type(node) in HOLDERS:
            inner = node.name if isinstance(node, ast.ClassDef) else owner
            waiting += [(child, inner) for child in reversed(children(node)) if isinstance(child, ast.stmt) or type(child) in HOLDERS]


def structure(code: str, module: tuple[ast.Module | None, dict | None] | None = None) -> dict:
    """What INFO holds; module is what parsed() says of the code, if that is known already."""
    info = {"syntax_ok": True, "syntax_error": None, "functions": [], "classes": [], "imports": [], "complexity": 0, "line_count": len(code.splitlines()), "node_count": 0}
    if not code.strip():
        return info
    tree, wrong = module or parsed(code)
    if tree is None:
        return info | {"syntax_ok": False, "syntax_error": wrong}
    outlined = [(n, owner) for n, owner in outline(tree) if type(n) in DEFINING]
    try:
        functions = [
            {
                "name": n.name, "lineno": n.lineno, "args": [a.arg for a in n.args.args], "class": owner, "decorators": [*map(ast.unparse, n.decorator_list)],
                "docstring": ast.get_docstring(n) or "", "line_count": n.end_lineno - n.lineno + 1,
            }
            for n, owner in outlined if isinstance(n, FUNCTIONS)
        ]
        classes = [{"name": n.name, "lineno": n.lineno, "bases": [*map(ast.unparse, n.bases)], "docstring": ast.get_docstring(n) or ""} for n, _ in outlined if isinstance(n, ast.ClassDef)]
    except UNPARSED as e:
        return info | {"syntax_ok": False, "syntax_error": {"message": f"{type(e).__name__}: {e}", "lineno": None, "offset": None, "text": ""}}
    imports = {a.asname or a.name for n in nodes(tree, ast.Import) for a in n.names}
    imports |= {f"{n.module or ''}.{a.name}" for n in nodes(tree, ast.ImportFrom) for a in n.names}
    branches = len(nodes(tree, *BRANCHES)) + sum(len(n.values) - 1 for n in nodes(tree, ast.BoolOp))
    return info | {"functions": functions, "classes": classes, "imports": sorted(imports), "complexity": 1 + branches, "node_count": len(walk(tree))}


def pieces(code: str) -> list[dict]:
    """Top-level functions, and classes after their methods; the whole module where there are none. Texts are whole, however long."""
    lines, tree = ENDS.split(code), parsed(code)[0]

    def piece(node: ast.AST, kind: str, prefix: str = "") -> dict:
        return {"name": prefix + node.name, "line": node.lineno, "kind": kind, "code": "\n".join(lines[node.lineno - 1 : node.end_lineno])}

    found = []
    for node in tree.body if tree else ():
        if isinstance(node, FUNCTIONS):
            found.append(piece(node, "function"))
        elif isinstance(node, ast.ClassDef):
            found += [piece(m, "method", f"{node.name}.") for m in node.body if isinstance(m, FUNCTIONS)]
            found.append(piece(node, "class"))
    return found or [{"name": "module", "line": 1, "kind": "file", "code": code}]


def with_structure(files: DataFrame, code: str = "code", column: str = "ast_info") -> DataFrame:
    """files with ast_info; give it Python files only (see with_any_structure)."""
    return files.withColumn(column, python_column(code, structure, INFO))


def stub(code: Column) -> Column:
    """ast_info of a file of another language: its number of lines."""
    return F.struct(
        F.lit(True).alias("syntax_ok"), F.lit(None).cast("struct<message:string,lineno:int,offset:int,text:string>").alias("syntax_error"),
        F.array().cast(f"array<{FUNCTION}>").alias("functions"), F.array().cast(f"array<{CLASS}>").alias("classes"),
        F.array().cast("array<string>").alias("imports"), F.lit(0).alias("complexity"), F.size(split_lines(code)).alias("line_count"), F.lit(0).alias("node_count"),
    )


def with_any_structure(files: DataFrame, language: str = "language") -> DataFrame:
    """files with ast_info: parsed for Python, a stub with the number of lines for other languages. The branches are
    parted before the Python function, which would run on every row otherwise."""
    python = with_structure(files.where(F.col(language) == "python"))
    others = files.where(F.coalesce(F.col(language), F.lit("")) != "python").withColumn("ast_info", stub(F.col("code")))
    return python.unionByName(others)


def python_chunks(files: DataFrame) -> DataFrame:
    """Chunks of non-blank Python files (path, code), ord from 0 in the file."""
    return chunk_rows(files.where(~is_blank(F.col("code"))), python_column("code", pieces, CHUNK))


# Colours of a control-flow graph's nodes.
COLORS = {"start": "#238636", "end": "#da3633", "def": "#8957e5", "plain": "#1f6feb", "leave": "#f85149", "branch": "#d29922", "join": "#30363d"}


class FlowGraph:
    """Control flow of the first function of a module (the nearest to its root), or of its statements if it has none.

    Each placing method takes the node that control comes from (None where it cannot come) and gives the node it goes on
    from. Nodes are numbered as they are placed; of edges between the same nodes the last label counts."""

    def __init__(self, code: str, tree: ast.Module):
        self.lines, self.nodes, self.edges, self.leaving = code.splitlines(), [], {}, []
        self.places = {ast.If: self._if, ast.For: self._loop, ast.While: self._loop, ast.Try: self._try, ast.Return: self._leave, ast.Raise: self._leave}
        at, body = self._node("START", "start"), tree.body
        if function := nearest(tree):
            at, body = self._from(at, self._node(f"def {function.name}()", "def")), function.body
        at = self._run(body, at)
        end = self._node("END", "end")
        for node in ([] if at is None else [at]) + self.leaving:
            self._from(node, end)

    def _node(self, label: str, color: str) -> int:
        self.nodes.append({"node_id": len(self.nodes), "label": label, "color": COLORS[color]})
        return len(self.nodes) - 1

    def _from(self, source: int | None, to: int, label: str = "") -> int:
        if source is not None:
            self.edges[source, to] = label
        return to

    def _source(self, node: ast.AST) -> str:
        line = getattr(node, "lineno", 0)
        return self.lines[line - 1].strip()[:40] if 0 < line <= len(self.lines) else ast.dump(node)[:40]

    def _run(self, body: list[ast.stmt], at: int | None) -> int | None:
        for node in body:
            at = self.places.get(type(node), self._plain)(node, at)
        return at

    def _plain(self, node: ast.stmt, at: int | None) -> int | None:
        label = self._source(node)
        return self._from(at, self._node(label, "plain")) if label else at

    def _leave(self, node: ast.stmt, at: int | None) -> None:
        self.leaving.append(self._from(at, self._node(self._source(node), "leave")))

    def _if(self, node: ast.If, at: int | None) -> int:
        test = self._from(at, self._node(f"if {ast.unparse(node.test)[:30]}", "branch"))
        ends = [(self._run(node.body, test), "True"), (self._run(node.orelse, test), "False" if node.orelse else "")]
        join = self._node("merge", "join")
        for end, label in ends:
            self._from(end, join, label)
        return join

    def _loop(self, node: ast.For | ast.While, at: int | None) -> int:
        label = f"for {ast.unparse(node.target)[:20]} in ..." if isinstance(node, ast.For) else f"while {ast.unparse(node.test)[:25]}"
        loop = self._from(at, self._node(label, "branch"))
        self._from(self._run(node.body, loop), loop, "loop")
        return self._from(loop, self._node("after loop", "join"), "exit")

    def _try(self, node: ast.Try, at: int | None) -> int:
        start = self._from(at, self._node("try:", "plain"))
        end = self._run(node.body, start)
        join = self._node("except merge", "join")
        self._from(end, join)
        for handler in node.handlers:
            caught = self._node(f"except {ast.unparse(handler.type) if handler.type else 'Exception'}", "leave")
            self._from(self._run(handler.body, self._from(start, caught)), join)
        return join


def nearest(tree: ast.Module) -> ast.AST | None:
    """The first function of a walk by levels; expressions, in which none can stand, are not looked at."""
    level = [tree]
    while level:
        level = [c for n in level if type(n) in HOLDERS for c in children(n) if isinstance(c, ast.stmt) or type(c) in HOLDERS]
        if found := next((n for n in level if isinstance(n, FUNCTIONS)), None):
            return found
    return None


def flow(code: str) -> dict:
    """Nodes and edges; none for blank or unparsable code."""
    tree = parsed(code)[0] if code.strip() else None
    if tree is None:
        return {"nodes": [], "edges": []}
    try:
        graph = FlowGraph(code, tree)
    except UNPARSED:
        return {"nodes": [], "edges": []}
    return {"nodes": graph.nodes, "edges": [{"src": a, "dst": b, "label": label} for (a, b), label in graph.edges.items()]}


def with_flow(files: DataFrame) -> DataFrame:
    """Python files with cfg: struct of nodes and edges."""
    return files.withColumn("cfg", python_column("code", flow, GRAPH))
