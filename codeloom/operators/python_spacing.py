"""Style checks of Python source on its tokens (white space, comments, escapes) and its syntax tree.

E111 E201 E202 E203 E211 E221 E222 E225 E231 E241 E251 E252 E261 E262 E265 E266 E271 E272 E402 E702 E713 E714 E721 E731 E741 E742
E743 W605. What does not parse is no Python, so that nothing is said of the white space between its tokens."""

import ast
import io
import keyword
import re
import tokenize
from collections.abc import Iterator

from codeloom.operators.python_code import FUNCTIONS, nodes

Finding = tuple[int, int, str, str]
SKIPPED = frozenset([tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER])
ENDS = frozenset([tokenize.NEWLINE, tokenize.NL])
SPACED = {
    "==", "!=", "<", ">", "<=", ">=", "->", ":=", "+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=", "and", "or", "in", "is",
}
#: Words and signs beside which something may be wrong; others only end what stands before them.
HEEDED = {*SPACED, *keyword.kwlist, *"()[]{},;:="}
HEEDLESS = frozenset([tokenize.NAME, tokenize.NUMBER, tokenize.OP])
AMBIGUOUS = ("l", "O", "I")
# What may follow a backslash in a text.
ESCAPES = "\n\\'\"abfnrtv01234567xNuU"


def findings(code: str, tree: ast.Module | None) -> Iterator[Finding]:
    if tree is None:
        return
    try:
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type not in SKIPPED]
    except (tokenize.TokenError, SyntaxError, ValueError):
        tokens = []
    yield from on_tokens(tokens)
    yield from on_tree(tree)


def on_tokens(tokens: list[tokenize.TokenInfo]) -> Iterator[Finding]:
    open_, lambdas, texts, before = [], [], 0, None
    signature = annotated = fresh = False
    for k, t in enumerate(tokens):
        after = tokens[k + 1] if k + 1 < len(tokens) else None
        kind, word, (line, col), _, _ = t
        first = before is None or before.type in ENDS
        if not texts and not first and kind in HEEDLESS and word not in HEEDED:
            fresh, before = False, t
            continue
        if kind == tokenize.FSTRING_START:
            texts += 1
        elif kind == tokenize.FSTRING_END:
            texts -= 1
        if texts or kind == tokenize.FSTRING_END:
            before = t
            continue
        gap = col - before.end[1] if not first and before.end[0] == line else None
        tail = after.start[1] - t.end[1] if after and after.type not in ENDS and after.start[0] == t.end[0] else None
        if kind == tokenize.COMMENT:
            yield from comment(t, first, gap)
        elif kind == tokenize.STRING:
            yield from escapes(t)
        if kind not in ENDS and kind != tokenize.COMMENT:
            if (first and not open_) and (fresh or before is None or before.type == tokenize.NEWLINE):
                signature, annotated = word in ("def", "async"), False
                if col % 4 and "\t" not in t.line[:col]:
                    yield line, 1, "E111", "indentation is not a multiple of 4"
            fresh = False
        elif kind == tokenize.NEWLINE or (kind == tokenize.NL and not open_):
            fresh = True
        if kind == tokenize.OP:
            yield from brackets(t, before, gap, tail, open_)
        inner = open_[-1] if open_ else ""
        if word == "lambda" and kind == tokenize.NAME:
            lambdas.append(len(open_))
        elif word == ":" and lambdas and lambdas[-1] == len(open_):
            lambdas.pop()
        elif word == ":" and signature and len(open_) == 1 and inner == "(":
            annotated = True
        elif word == "," and len(open_) == 1:
            annotated = False
        if kind == tokenize.OP and word == "=":
            if lambdas and lambdas[-1] == len(open_) or inner == "(":
                if signature and annotated and len(open_) == 1:
                    if gap == 0 or tail == 0:
                        yield line, col + 1, "E252", "missing whitespace around parameter equals"
                else:
                    for space, at in ((gap, col - (gap or 0)), (tail, t.end[1])):
                        if space:
                            yield line, at + 1, "E251", "unexpected spaces around keyword / parameter equals"
            elif not open_:
                yield from around(t, gap, tail)
        elif word in SPACED and (kind == tokenize.OP or word.isalpha()):
            yield from around(t, gap, tail)
        elif kind == tokenize.OP and word in (",", ";", ":") and tail == 0 and after.type != tokenize.COMMENT:
            if not (word == ":" and inner == "[") and not (word == "," and after.string in ")]"):
                yield line, t.end[1] + 1, "E231", f"missing whitespace after '{word}'"
        elif word == "," and tail and tail > 1 and after.type != tokenize.COMMENT:
            yield line, t.end[1] + 1, "E241", "multiple spaces after ','"
        if word == ";" and after and after.type not in (*ENDS, tokenize.COMMENT):
            yield line, col + 1, "E702", "multiple statements on one line (semicolon)"
        if kind == tokenize.NAME and keyword.iskeyword(word) and word not in SPACED:
            if tail and tail > 1 and after.type != tokenize.COMMENT:
                yield line, t.end[1] + 1, "E271", "multiple spaces after keyword"
            if gap and gap > 1 and before.string != ",":
                yield line, before.end[1] + 1, "E272", "multiple spaces before keyword"
        before = t


def around(t: tokenize.TokenInfo, gap: int | None, tail: int | None) -> Iterator[Finding]:
    """White space on both sides of an operator that wants one space."""
    line, col = t.start
    word = t.string.isalpha()
    if gap == 0 or tail == 0:
        if not word or gap != 0:
            yield line, (col if gap == 0 else t.end[1]) + 1, "E225", "missing whitespace around operator"
        return
    if gap and gap > 1:
        yield line, col - gap + 1, "E272" if word else "E221", f"multiple spaces before {'keyword' if word else 'operator'}"
    if tail and tail > 1:
        yield line, t.end[1] + 1, "E271" if word else "E222", f"multiple spaces after {'keyword' if word else 'operator'}"


def brackets(t: tokenize.TokenInfo, before: tokenize.TokenInfo | None, gap: int | None, tail: int | None, open_: list[str]) -> Iterator[Finding]:
    """White space beside brackets and what ends parts; keeps the stack of open brackets."""
    word, (line, col) = t.string, t.start
    if word in "([{":
        callee = before and (before.string in ")]}" or (before.type == tokenize.NAME and not keyword.iskeyword(before.string) and not keyword.issoftkeyword(before.string)))
        if gap and callee and word != "{" and before.string:
            yield line, before.end[1] + 1, "E211", f"whitespace before '{word}'"
        if tail:
            yield line, t.end[1] + 1, "E201", f"whitespace after '{word}'"
        open_.append(word)
    elif word in ")]}":
        if open_:
            open_.pop()
        if gap and before.string not in (*"([{,",):
            yield line, before.end[1] + 1, "E202", f"whitespace before '{word}'"
    elif word in (",", ";", ":") and gap and before.string not in (*"([{,",):
        yield line, before.end[1] + 1, "E203", f"whitespace before '{word}'"


def comment(t: tokenize.TokenInfo, block: bool, gap: int | None) -> Iterator[Finding]:
    line, col = t.start
    marks = len(t.string) - len(t.string.lstrip("#"))
    rest = t.string[marks:]
    plain = not rest or rest[0] == " "
    if not block:
        if gap is not None and gap < 2:
            yield line, col - gap + 1, "E261", "at least two spaces before inline comment"
        if not (marks == 1 and (plain or rest.startswith(": "))) or rest[:2] == "  ":
            yield line, col + 1, "E262", "inline comment should start with '# '"
    elif marks > 1 and rest.strip():
        yield line, col + 1, "E266", "too many leading '#' for block comment"
    elif marks == 1 and not plain and not rest.startswith(": ") and not (line == 1 and rest[0] == "!"):
        yield line, col + 1, "E265", "block comment should start with '# '"


def escapes(t: tokenize.TokenInfo) -> Iterator[Finding]:
    """Backslashes of a text that begin no known escape."""
    prefix = re.match(r"[A-Za-z]*", t.string)[0].lower()
    if "r" in prefix:
        return
    unknown = "NuU" if "b" in prefix else ""
    for m in re.finditer(r"\\(.)", t.string, re.S):
        if m[1] not in ESCAPES or m[1] in unknown:
            head = t.string[: m.start()]
            col = m.start() + t.start[1] if "\n" not in head else m.start() - head.rindex("\n") - 1
            yield t.start[0] + head.count("\n"), col + 1, "W605", f"invalid escape sequence '{m[0]}'"


def on_tree(tree: ast.Module) -> Iterator[Finding]:
    late = False
    for k, n in enumerate(tree.body):
        if isinstance(n, ast.Import | ast.ImportFrom):
            if late:
                yield n.lineno, n.col_offset + 1, "E402", "module level import not at top of file"
        elif not isinstance(n, ast.If | ast.Try | ast.With) and not (k == 0 and isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant)):
            late = late or not (isinstance(n, ast.Assign) and all(re.fullmatch("__.*__", getattr(x, "id", "")) for x in n.targets))
    for n in nodes(tree, ast.UnaryOp, ast.Compare, ast.Assign, ast.AnnAssign, ast.Name, ast.arg, ast.ClassDef, *FUNCTIONS):
        if type(n) is ast.Name:
            if n.id in AMBIGUOUS and isinstance(n.ctx, ast.Store):
                yield n.lineno, n.col_offset + 1, "E741", f"ambiguous variable name '{n.id}'"
        elif isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not) and isinstance(n.operand, ast.Compare) and len(n.operand.ops) == 1:
            op = n.operand.ops[0]
            if isinstance(op, ast.In):
                yield n.lineno, n.col_offset + 1, "E713", "test for membership should be 'not in'"
            elif isinstance(op, ast.Is):
                yield n.lineno, n.col_offset + 1, "E714", "test for object identity should be 'is not'"
        elif isinstance(n, ast.Compare) and any(type(o) in (ast.Eq, ast.NotEq) for o in n.ops):
            if any(isinstance(x, ast.Call) and getattr(x.func, "id", "") == "type" and len(x.args) == 1 for x in (n.left, *n.comparators)):
                yield n.lineno, n.col_offset + 1, "E721", "do not compare types, for exact checks use `is` / `is not`, for instance checks use `isinstance()`"
        elif isinstance(n, ast.Assign | ast.AnnAssign) and isinstance(n.value, ast.Lambda):
            if isinstance(n.targets[0] if isinstance(n, ast.Assign) else n.target, ast.Name):
                yield n.lineno, n.col_offset + 1, "E731", "do not assign a lambda expression, use a def"
        elif isinstance(n, ast.arg) and n.arg in AMBIGUOUS:
            yield n.lineno, n.col_offset + 1, "E741", f"ambiguous variable name '{n.arg}'"
        elif isinstance(n, ast.ClassDef) and n.name in AMBIGUOUS:
            yield n.lineno, n.col_offset + 1, "E742", f"ambiguous class definition '{n.name}'"
        elif isinstance(n, FUNCTIONS) and n.name in AMBIGUOUS:
            yield n.lineno, n.col_offset + 1, "E743", f"ambiguous function definition '{n.name}'"
