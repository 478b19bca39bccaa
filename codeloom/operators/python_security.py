"""Security checks of Python source on its syntax tree: calls by their qualified name, imports, texts, handlers."""

import ast
import re
from collections.abc import Callable, Iterator

from codeloom.operators.python_code import nodes

# Public identifiers, texts, severities, confidences and weakness numbers of calls, by qualified name.
WEAK_RANDOM = ("B311", "Standard pseudo-random generators are not suitable for security/cryptographic purposes.", "LOW", "HIGH", 330)
UNPICKLED = ("B301", "Pickle and modules that wrap it can be unsafe when used to deserialize untrusted data, possible security issue.", "MEDIUM", "HIGH", 502)
UNMARSHALLED = ("B302", "Deserialization with the marshal module is possibly dangerous.", "MEDIUM", "HIGH", 502)
OPENED = ("B310", "Audit url open for permitted schemes. Allowing use of file:/ or custom schemes is often unexpected.", "MEDIUM", "HIGH", 22)
CALLS = {
    "eval": ("B307", "Use of possibly insecure function - consider using safer ast.literal_eval.", "MEDIUM", "HIGH", 78),
    "exec": ("B102", "Use of exec detected.", "MEDIUM", "HIGH", 78),
    "pickle.load": UNPICKLED, "pickle.loads": UNPICKLED, "pickle.Unpickler": UNPICKLED, "dill.load": UNPICKLED, "dill.loads": UNPICKLED, "shelve.open": UNPICKLED,
    "marshal.load": UNMARSHALLED, "marshal.loads": UNMARSHALLED,
    "tempfile.mktemp": ("B306", "Use of insecure and deprecated function (mktemp).", "MEDIUM", "HIGH", 377),
    "urllib.request.urlopen": OPENED, "urllib.request.urlretrieve": OPENED,
    "random.Random": WEAK_RANDOM, "random.random": WEAK_RANDOM, "random.randrange": WEAK_RANDOM, "random.randint": WEAK_RANDOM, "random.choice": WEAK_RANDOM,
    "random.choices": WEAK_RANDOM, "random.uniform": WEAK_RANDOM, "random.triangular": WEAK_RANDOM, "random.randbytes": WEAK_RANDOM,
    "telnetlib.Telnet": ("B312", "Telnet-related functions are being called. Telnet is considered insecure. Use SSH or some other encrypted protocol.", "HIGH", "HIGH", 319),
    "ftplib.FTP": ("B321", "FTP-related functions are being called. FTP is considered insecure. Use SSH/SFTP/SCP or some other encrypted protocol.", "HIGH", "HIGH", 319),
}
# Imports that are reported.
CONSIDER = "Consider possible security implications associated with the {} module."
IMPORTS = {
    "telnetlib": ("B401", "A telnet-related module is being imported. Telnet is considered insecure.", "HIGH", "HIGH", 319),
    "ftplib": ("B402", "A FTP-related module is being imported. FTP is considered insecure.", "HIGH", "HIGH", 319),
    "pickle": ("B403", CONSIDER.format("pickle"), "LOW", "HIGH", 502), "dill": ("B403", CONSIDER.format("dill"), "LOW", "HIGH", 502), "shelve": ("B403", CONSIDER.format("shelve"), "LOW", "HIGH", 502),
    "subprocess": ("B404", CONSIDER.format("subprocess"), "LOW", "HIGH", 78),
}
SECRET = re.compile(r"pass(word|wd)?$|pwd|token|secret", re.I)
QUERY = re.compile(r"\s*(select\b.*\bfrom\b|insert\s+into\b.*\bvalues\b|update\b.*\bset\b|delete\s+from\b)", re.I | re.S)
TEMPORARY = ("/tmp", "/var/tmp", "/dev/shm")  # noqa: S108
HTTP = ("get", "post", "put", "patch", "delete", "head", "options", "request")
SHELLS = ("os.system", "os.popen")
RUNS = ("subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_call", "subprocess.check_output")

Finding = tuple[ast.AST, str, str, str, str, int]


#: Kinds of nodes that findings looks at.
LOOKED_AT = (ast.Assert, ast.Assign, ast.arguments, ast.Import, ast.ImportFrom, ast.ExceptHandler, ast.Call, ast.Constant, ast.JoinedStr, ast.BinOp)


def names_of(tree: ast.AST) -> dict[str, str]:
    """What each imported name stands for."""
    out = {}
    for n in nodes(tree, ast.Import, ast.ImportFrom):
        if isinstance(n, ast.Import):
            out |= {a.asname: a.name for a in n.names if a.asname}
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            out |= {a.asname or a.name: f"{n.module}.{a.name}" for a in n.names}
    return out


def constant(node: ast.AST | None, kind: type) -> object:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, kind) else None


def call_findings(n: ast.Call, resolve: Callable[[ast.AST], str]) -> Iterator[tuple]:
    """(test, message, severity, confidence, cwe) of a call."""
    name, given = resolve(n.func), {k.arg: k.value for k in n.keywords}
    first = n.args[0] if n.args else None
    if name in CALLS:
        yield CALLS[name]
    if name.startswith("subprocess.") and getattr(given.get("shell"), "value", None):
        yield "B602", "subprocess call with shell=True identified, security issue.", "HIGH", "HIGH", 78
    elif name in RUNS:
        yield "B603", "subprocess call - check for execution of untrusted input.", "LOW", "HIGH", 78
    if name in RUNS:
        program = constant(first.elts[0] if isinstance(first, ast.List | ast.Tuple) and first.elts else first, str)
        if program and not program.startswith(("/", "\\", ".")) and program[1:2] != ":":
            yield "B607", "Starting a process with a partial executable path", "LOW", "HIGH", 78
    if name in SHELLS and first is not None:
        if constant(first, str) is not None:
            yield "B605", "Starting a process with a shell: Seems safe, but may be changed in the future, consider rewriting without shell", "LOW", "HIGH", 78
        else:
            yield "B605", "Starting a process with a shell, possible injection detected, security issue.", "HIGH", "HIGH", 78
    if name == "yaml.load" and "Loader" not in given and len(n.args) < 2:
        yield "B506", "Use of unsafe yaml load. Allows instantiation of arbitrary objects. Consider yaml.safe_load().", "MEDIUM", "HIGH", 20
    if name in ("hashlib.md5", "hashlib.sha1") and constant(given.get("usedforsecurity"), bool) is not False:
        yield "B324", f"Use of weak {name[8:].upper()} hash for security. Consider usedforsecurity=False", "HIGH", "HIGH", 327
    if name == "os.chmod" and len(n.args) > 1 and (mode := constant(n.args[1], int)) and mode & 0o012:
        yield "B103", f"Chmod setting a permissive mask {mode:#o} on file ({constant(first, str) or 'NOT PARSED'}).", "HIGH" if mode & 0o002 else "MEDIUM", "HIGH", 732
    if name.startswith("requests.") and name[9:] in HTTP:
        if "timeout" not in given or (isinstance(given["timeout"], ast.Constant) and given["timeout"].value is None):
            yield "B113", "Call to requests without timeout", "MEDIUM", "LOW", 400
        if constant(given.get("verify"), bool) is False:
            yield "B501", "Call to requests with verify=False disabling SSL certificate checks, security issue.", "HIGH", "HIGH", 295
    if name == "ssl._create_unverified_context":
        yield "B323", "An SSL context that checks neither certificates nor host names is created.", "MEDIUM", "HIGH", 295
    if name.endswith(".run") and constant(given.get("debug"), bool):
        yield "B201", "A Flask app appears to be run with debug=True, which exposes the Werkzeug debugger and allows the execution of arbitrary code.", "HIGH", "MEDIUM", 94
    if name == "jinja2.Environment" and not ("autoescape" in given and constant(given["autoescape"], bool) is not False):
        yield "B701", "By default, jinja2 sets autoescape to False. Consider using autoescape=True or use the select_autoescape function to mitigate XSS vulnerabilities.", "HIGH", "HIGH", 94
    for key, value in given.items():
        if key and SECRET.search(key) and constant(value, str):
            yield "B106", f"Possible hardcoded password: {value.value!r}", "LOW", "MEDIUM", 259


def handler_findings(n: ast.ExceptHandler) -> Iterator[tuple]:
    broad = n.type is None or getattr(n.type, "id", "") == "Exception"
    if broad and len(n.body) == 1 and isinstance(n.body[0], ast.Pass):
        yield "B110", "Try, Except, Pass detected.", "LOW", "HIGH", 703
    elif broad and len(n.body) == 1 and isinstance(n.body[0], ast.Continue):
        yield "B112", "Try, Except, Continue detected.", "LOW", "HIGH", 703


def built_text(n: ast.AST) -> str:
    """The first text of an expression that is put together from texts and values, empty for others."""
    if isinstance(n, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in n.values):
        return "".join(v.value if isinstance(v, ast.Constant) else "?" for v in n.values)
    if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add | ast.Mod):
        both = constant(n.left, str) is not None and constant(n.right, str) is not None
        return "" if both else constant(n.left, str) or ""
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "format":
        return constant(n.func.value, str) or ""
    return ""


def findings(tree: ast.Module) -> Iterator[Finding]:
    """(node, test, message, severity, confidence, cwe), in the order of a walk over the tree."""
    names = names_of(tree)
    documentation = {id(n.value) for n in nodes(tree, ast.Expr)}
    flask = any(x.split(".")[0] == "flask" for x in names.values()) or any(a.name == "flask" for n in nodes(tree, ast.Import) for a in n.names)

    def resolve(node: ast.AST) -> str:
        rest = []
        while isinstance(node, ast.Attribute):
            rest.append(node.attr)
            node = node.value
        head = node.id if isinstance(node, ast.Name) else "?"
        return ".".join([names.get(head, head), *reversed(rest)])

    for n in nodes(tree, *LOOKED_AT):
        if isinstance(n, ast.Assert):
            yield n, "B101", "Use of assert detected. The enclosed code will be removed when compiling to optimised byte code.", "LOW", "HIGH", 703
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            if any(SECRET.search(getattr(t, "id", getattr(t, "attr", ""))) for t in n.targets):
                yield n, "B105", f"Possible hardcoded password: {n.value.value!r}", "LOW", "MEDIUM", 259
        elif isinstance(n, ast.arguments):
            named = [*n.posonlyargs, *n.args]
            pairs = [*zip(named[len(named) - len(n.defaults) :], n.defaults, strict=True), *zip(n.kwonlyargs, n.kw_defaults, strict=True)]
            for a, value in pairs:
                if SECRET.search(a.arg) and constant(value, str):
                    yield a, "B107", f"Possible hardcoded password: {value.value!r}", "LOW", "MEDIUM", 259
        elif isinstance(n, ast.Import | ast.ImportFrom):
            for module in [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""]:
                if module.split(".")[0] in IMPORTS:
                    yield n, *IMPORTS[module.split(".")[0]]
        elif isinstance(n, ast.ExceptHandler):
            yield from ((n, *x) for x in handler_findings(n))
        elif isinstance(n, ast.Call):
            yield from ((n, *x) for x in call_findings(n, resolve) if x[0] != "B201" or flask)
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and id(n) not in documentation:
            if n.value == "0.0.0.0":  # noqa: S104
                yield n, "B104", "Possible binding to all interfaces.", "MEDIUM", "MEDIUM", 605
            elif n.value.startswith(TEMPORARY):
                yield n, "B108", "Probable insecure usage of temp file/directory.", "MEDIUM", "MEDIUM", 377
        elif isinstance(n, ast.JoinedStr | ast.BinOp | ast.Call) and QUERY.match(built_text(n)):
            yield n, "B608", "Possible SQL injection vector through string-based query construction.", "MEDIUM", "LOW", 89
