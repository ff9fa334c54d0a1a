"""Facts in source files: web routes, tables of object mappers and migrations, string literals.

Python is read through its syntax tree. JavaScript, Go and Scala are matched on text whose comments and strings are
blanked out, so that code inside them is no code, while literals are cut out of the original at the same places.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from quarry.functions.elements import _closing, blanked

VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
#: Classes whose instances carry routes.
_APPS = {"Flask", "Blueprint", "FastAPI", "APIRouter"}
_HOLE = "{}"


def _tree(text: str) -> ast.AST | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _last(node: ast.AST | None) -> str | None:
    """The last name of a dotted name or of what is called."""
    if isinstance(node, ast.Call):
        return _last(node.func)
    if isinstance(node, ast.Subscript):
        return _last(node.value)
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _keywords(call: ast.Call) -> dict[str, ast.AST]:
    return {k.arg: k.value for k in call.keywords if k.arg}


# --- routes ---------------------------------------------------------------------------------------------------


def routes(file: str, text: str | None) -> list[tuple[int, str, str]]:
    """(line, method, path with {names}) by the file's suffix."""
    if not text:
        return []
    suffix = file.rsplit(".", 1)[-1].lower()
    reader = {"py": _python_routes, "js": _express_routes, "ts": _express_routes, "mjs": _express_routes, "go": _go_routes, "scala": _akka_routes}.get(suffix)
    return list(dict.fromkeys(reader(text))) if reader else []


def _python_routes(text: str) -> Iterator[tuple[int, str, str]]:
    """Decorators of Flask and FastAPI; a receiver that the file makes itself must be one of their classes."""
    tree = _tree(text)
    if tree is None:
        return
    made: dict[str, str | None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign | ast.AnnAssign) and isinstance(node.value, ast.Call):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                made[_last(target) or ""] = _last(node.value)
    for node in ast.walk(tree):
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        for mark in node.decorator_list:
            if not (isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute)):
                continue
            verb, owner = mark.func.attr, _last(mark.func.value)
            if verb not in ("route", "api_route", *VERBS) or made.get(owner or "", "Flask") not in _APPS:
                continue
            named = _keywords(mark)
            path = _text(mark.args[0] if mark.args else named.get("path", named.get("rule")))
            if path is None:
                continue
            path = re.sub(r"<(?:[^<>:]+:)?([^<>]+)>", r"{\1}", re.sub(r"\{([^{}:]+):[^{}]*\}", r"{\1}", path))
            listed = named.get("methods")
            methods = [m for m in (_text(e) for e in getattr(listed, "elts", [])) if m] if verb in ("route", "api_route") else [verb]
            for method in methods or ["GET"]:
                yield mark.lineno, method.upper(), path


def _literal_at(text: str, code: str, at: int) -> str | None:
    """The plain string literal that begins at a place; None for templates with holes and for anything else."""
    quote = code[at : at + 1]
    if quote not in ("'", '"', "`"):
        return None
    end = code.find(quote, at + 1)
    value = text[at + 1 : end] if end > 0 else None
    return None if value is None or quote == "`" and "${" in value else value


_EXPRESS = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\.\s*(get|post|put|delete|patch|head|options|all)\s*\(\s*(?=['\"`])")


def _express_routes(text: str) -> Iterator[tuple[int, str, str]]:
    """Calls on routers with a path and a handler."""
    code = blanked(text)
    made = {m.group(1): m.group(2) for m in re.finditer(r"(?:\b(?:const|let|var)\s|,)\s*([\w$]+)\s*=\s*(?:new\s+)?(?:[\w$]+\.)*([\w$]+)\s*\(", code)}
    for m in _EXPRESS.finditer(code):
        path = _literal_at(text, code, m.end())
        if path is None or not path.startswith("/") or made.get(m.group(1), "express") not in ("express", "Router", "Koa", "KoaRouter"):
            continue
        end = _closing(code, m.start(), "()")
        if end < 0 or "," not in code[m.end() + len(path) + 2 : end]:
            continue  # no handler: a getter
        method = m.group(2).upper()
        yield text.count("\n", 0, m.start()) + 1, "*" if method == "ALL" else method, re.sub(r":([A-Za-z_]\w*)\??", r"{\1}", path)


def _go_routes(text: str) -> Iterator[tuple[int, str, str]]:
    code = blanked(text)
    for m in re.finditer(r"\.\s*(HandleFunc|Handle|GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch)\s*\(\s*(?=[\"`])", code):
        path = _literal_at(text, code, m.end())
        if path is None:
            continue
        method = "*" if m.group(1).startswith("Handle") else m.group(1).upper()
        prefixed = re.match(r"([A-Z]+)\s+(/.*)$", path)
        if prefixed:
            method, path = prefixed.groups()
        chained = re.match(r"\s*\.\s*Methods\s*\(\s*", code[_closing(code, m.start(), "()") :]) if method == "*" else None
        if chained:
            at = _closing(code, m.start(), "()") + chained.end()
            method = _literal_at(text, code, at) or method
        if path.startswith("/"):
            yield text.count("\n", 0, m.start()) + 1, method, re.sub(r":([A-Za-z_]\w*)", r"{\1}", re.sub(r"\{([^{}:]+):[^{}]*\}", r"{\1}", path))


def _akka_routes(text: str) -> Iterator[tuple[int, str, str]]:
    """Nested pathPrefix, path and method directives; segments that match values are named by their place."""
    code = blanked(text)
    places: list[tuple[int, int, list[str], str | None, int]] = []
    for m in re.finditer(r"\b(pathPrefix|path|pathEnd|pathEndOrSingleSlash|get|post|put|delete|patch)\b\s*(\()?", code):
        word, at = m.group(1), m.start()
        after = _closing(code, m.end() - 1, "()") if m.group(2) else m.end()
        if after < 0 or code[after:].lstrip()[:1] != "{":
            continue
        end = _closing(code, after)
        parts = []
        if word.startswith("path") and m.group(2):
            for part in re.split(r"/", text[m.end() : after - 1]):
                part = part.strip()
                parts.append(part.strip('"') if part.startswith('"') else "{%s}")
        method = word.upper() if not word.startswith("path") else None
        places.append((at, end if end > 0 else len(code), parts, method, m.start()))
    for at, end, _, method, _ in places:
        if method is None:
            continue
        above = [p for a, b, p, mm, _ in places if a < at and end <= b and mm is None] + [p for a, b, p, mm, _ in places if at < a and b <= end and mm is None]
        names = [x for p in above for x in p]
        for k, x in enumerate(names):
            if x == "{%s}":
                names[k] = "{arg%d}" % sum(y.startswith("{arg") for y in names[:k])
        yield text.count("\n", 0, at) + 1, method, "/" + "/".join(names)


# --- calls that leave the process -----------------------------------------------------------------------------

#: Modules and client classes whose verbs are HTTP requests, and calls that start a process.
_HTTP_MODULES, _HTTP_CLIENTS = {"requests", "httpx", "aiohttp"}, {"Session", "Client", "AsyncClient", "ClientSession"}
_PROCESS = {"subprocess": {"run", "Popen", "call", "check_call", "check_output"}, "os": {"system", "popen"}}


def _written(node: ast.AST | None) -> str | None:
    """A literal, or an interpolated one with {} for its holes."""
    if isinstance(node, ast.JoinedStr):
        return "".join(_text(v) if _text(v) is not None else _HOLE for v in node.values)
    return _text(node)


def _names(tree: ast.AST) -> dict[str, str]:
    """Local names of imported modules and of what is imported from them, as dotted names."""
    out = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                out[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom) and node.module:
            for a in node.names:
                out[a.asname or a.name] = f"{node.module}.{a.name}"
    return out


def _called(call: ast.Call, names: dict[str, str]) -> str:
    """The dotted name of what is called, by what its first part was imported as."""
    parts, node = [], call.func
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    first = node.id if isinstance(node, ast.Name) else _last(node) or ""
    return ".".join([names.get(first, first), *reversed(parts)])


def clients(file: str, text: str | None) -> list[tuple[int, str, str, str]]:
    """(line, sink, method, URL with {} for holes) of HTTP requests in Python and JavaScript."""
    if not text:
        return []
    if file.endswith((".js", ".ts", ".mjs", ".jsx", ".tsx")):
        return list(_script_clients(text))
    tree = _tree(text) if file.endswith(".py") else None
    if tree is None:
        return []
    names = _names(tree)
    for node in ast.walk(tree):  # variables that hold a client are as good as its module
        pairs = [(node.targets[0], node.value)] if isinstance(node, ast.Assign) else [(i.optional_vars, i.context_expr) for i in node.items] if isinstance(node, ast.With | ast.AsyncWith) else []
        for target, value in pairs:
            made = _called(value, names).split(".") if isinstance(value, ast.Call) else []
            if isinstance(target, ast.Name) and len(made) > 1 and made[0] in _HTTP_MODULES and made[-1] in _HTTP_CLIENTS:
                names[target.id] = made[0]
    out = []
    for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call)):
        parts = _called(call, names).split(".")
        named, args = _keywords(call), list(call.args)
        if parts[0] in _HTTP_MODULES and len(parts) == 2 and parts[1] in (*VERBS, "request"):
            method = parts[1].upper() if parts[1] != "request" else (_text(args.pop(0) if args else named.get("method")) or "").upper()
            sink = parts[0]
        elif parts[-2:] == ["request", "urlopen"]:
            method, sink = "POST" if "data" in named else "GET", "urllib"
        else:
            continue
        url = _written(args[0] if args else named.get("url"))
        if url is not None and method:
            out.append((call.lineno, sink, method, url))
    return sorted(out)


def _script_value(text: str, code: str, at: int) -> str | None:
    """The literal or template at a place, {} for its holes."""
    if code[at : at + 1] not in ("'", '"', "`"):
        return None
    return next((v for _, _, v in _scanned_literals(text[at:])), None)


def _script_clients(text: str) -> Iterator[tuple[int, str, str, str]]:
    code = blanked(text)
    for m in re.finditer(r"(?<![\w$.])(fetch|axios)\s*(?:\.\s*(get|post|put|delete|patch|head|options))?\s*\(\s*", code):
        if m.group(1) == "fetch" and m.group(2):
            continue
        url = _script_value(text, code, m.end())
        if url is None:
            continue
        end = _closing(code, m.start(), "()")
        given = re.search(r"\bmethod\s*:\s*['\"](\w+)['\"]", text[m.end() : end]) if not m.group(2) else None
        yield text.count("\n", 0, m.start()) + 1, m.group(1), (m.group(2) or (given.group(1) if given else "get")).upper(), url


def processes(file: str, text: str | None) -> list[tuple[int, str]]:
    """(line, program) of processes that Python, JavaScript and Go files start by a literal name."""
    if not text:
        return []
    out = []
    if file.endswith(".py"):
        tree = _tree(text)
        names = _names(tree) if tree is not None else {}
        for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call)) if tree is not None else ():
            parts = _called(call, names).split(".")
            if len(parts) != 2 or parts[1] not in _PROCESS.get(parts[0], ()) or not (call.args or call.keywords):
                continue
            given = call.args[0] if call.args else _keywords(call).get("args")
            word = _written(given.elts[0]) if isinstance(given, ast.List | ast.Tuple) and given.elts else (_written(given) or "").split(" ")[0]
            if word:
                out.append((call.lineno, word))
    elif file.endswith((".js", ".ts", ".mjs", ".go")):
        code = blanked(text)
        rx = r"\bexec\s*\.\s*Command(?:Context)?\s*\(\s*(?:\w+\s*,\s*)?(?=[\"`])" if file.endswith(".go") else r"(?<![\w$])(?:child_process\s*\.\s*)?(?:exec|execSync|execFile|spawn|spawnSync|fork)\s*\(\s*(?=['\"`])"
        for m in re.finditer(rx, code):
            if code[: m.start()].rstrip().endswith("."):
                continue  # a method of something else
            word = (_script_value(text, code, m.end()) or "").split(" ")[0]
            if word:
                out.append((text.count("\n", 0, m.start()) + 1, word))
    return sorted(out)


# --- tables of object mappers ---------------------------------------------------------------------------------


def mapped_columns(file: str, text: str | None) -> list[tuple[int, str, str, str | None]]:
    """(line, table, column, type) of SQLAlchemy and Django models (Python) and Slick tables (Scala)."""
    if not text:
        return []
    if file.endswith(".scala"):
        return list(_slick_columns(text))
    tree = _tree(text) if file.endswith(".py") else None
    if tree is None:
        return []
    app = file.split("/")[-2] if "/" in file else ""
    return [row for node in ast.walk(tree) if isinstance(node, ast.ClassDef) for row in (*_alchemy_columns(node), *_django_columns(node, app))]


def _assigned(cls: ast.ClassDef) -> Iterator[tuple[str, ast.AST | None, ast.stmt]]:
    for stmt in cls.body:
        if isinstance(stmt, ast.Assign) and len(stmt.targets) == 1 and isinstance(stmt.targets[0], ast.Name):
            yield stmt.targets[0].id, stmt.value, stmt
        elif isinstance(stmt, ast.AnnAssign) and isinstance(stmt.target, ast.Name):
            yield stmt.target.id, stmt.value, stmt


def _alchemy_columns(cls: ast.ClassDef) -> Iterator[tuple[int, str, str, str | None]]:
    table = next((_text(v) for k, v, _ in _assigned(cls) if k == "__tablename__"), None)
    if table is None:
        return
    for name, value, stmt in _assigned(cls):
        mapped = _last(getattr(stmt, "annotation", None)) == "Mapped"
        if isinstance(value, ast.Call) and _last(value) in ("Column", "mapped_column"):
            own = _text(value.args[0]) if value.args else None
            kinds = [_last(a) for a in value.args[1 if own is not None else 0 :] if _last(a) != "ForeignKey"]
            kind = kinds[0] if kinds else _inner(stmt) if mapped else None
            yield stmt.lineno, table, _text(_keywords(value).get("name")) or own or name, kind
        elif mapped and value is None:
            yield stmt.lineno, table, name, _inner(stmt)


def _inner(stmt: ast.stmt) -> str | None:
    annotation = getattr(stmt, "annotation", None)
    return ast.unparse(annotation.slice) if isinstance(annotation, ast.Subscript) else None


def _django_columns(cls: ast.ClassDef, app: str) -> Iterator[tuple[int, str, str, str | None]]:
    if not any(isinstance(b, ast.Attribute) and b.attr == "Model" and _last(b.value) == "models" for b in cls.bases):
        return
    meta = next((c for c in cls.body if isinstance(c, ast.ClassDef) and c.name == "Meta"), None)
    options = {k: v for k, v, _ in _assigned(meta)} if meta else {}
    table = _text(options.get("db_table")) or (f"{app}_{cls.name.lower()}" if app else cls.name.lower())
    for name, value, stmt in _assigned(cls):
        column = _django_field(name, value)
        if column:
            yield stmt.lineno, table, *column


def _django_field(name: str, value: ast.AST | None) -> tuple[str, str] | None:
    kind = _last(value) if isinstance(value, ast.Call) else None
    if kind is None or kind == "ManyToManyField" or not (kind.endswith("Field") or kind == "ForeignKey"):
        return None
    linked = kind in ("ForeignKey", "OneToOneField")
    return _text(_keywords(value).get("db_column")) or (f"{name}_id" if linked else name), kind


def _slick_columns(text: str) -> Iterator[tuple[int, str, str, str | None]]:
    code = blanked(text)
    for m in re.finditer(r"\bclass\s+\w+\s*\([^)]*\)\s*extends\s+Table\s*\[[^\]]*\]\s*\(", code):
        head_end = _closing(code, m.end() - 1, "()")
        names = re.findall(r'"([^"]*)"', text[m.end() : head_end])
        body = _closing(code, head_end)
        if not names or body < 0:
            continue
        for c in re.finditer(r"\bcolumn\s*\[([^\n]*?)\]\s*\(\s*(?=\")", code[head_end:body]):
            name = _literal_at(text, code, head_end + c.end())
            if name:
                yield text.count("\n", 0, head_end + c.start()) + 1, names[-1], name, c.group(1)


def migrated_columns(file: str, text: str | None) -> list[tuple[int, str, str, str | None, bool | None, bool | None]]:
    """(line, table, column, type, nullable, primary key) of Django and Alembic migrations; what a migration does not
    say is null."""
    tree = _tree(text) if text and file.endswith(".py") else None
    if tree is None:
        return []
    parts = file.split("/")
    app = parts[-3] if len(parts) > 2 and parts[-2] == "migrations" else ""
    out = []
    for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call)):
        word, named = _last(call), _keywords(call)
        if word == "CreateModel" and _text(named.get("name")):
            options = named.get("options")
            pairs = zip(options.keys, options.values, strict=True) if isinstance(options, ast.Dict) else ()
            table = next((_text(v) for k, v in pairs if _text(k) == "db_table"), None) or (f"{app}_" if app else "") + _text(named["name"]).lower()
            for item in getattr(named.get("fields"), "elts", []):
                if isinstance(item, ast.Tuple) and len(item.elts) == 2 and _text(item.elts[0]):
                    column = _django_field(_text(item.elts[0]), item.elts[1])
                    if column:
                        out.append((item.lineno, table, *column, None, None))
        elif word in ("create_table", "add_column") and isinstance(call.func, ast.Attribute) and _last(call.func.value) in ("op", "batch_op"):
            table = _text(call.args[0]) if call.args else None
            for arg in call.args[1:]:
                if table and isinstance(arg, ast.Call) and _last(arg) == "Column" and arg.args and _text(arg.args[0]):
                    kw = _keywords(arg)
                    flag = lambda k, kw=kw: kw[k].value if isinstance(kw.get(k), ast.Constant) else None
                    out.append((arg.lineno, table, _text(arg.args[0]), _last(arg.args[1]) if len(arg.args) > 1 else None, flag("nullable"), flag("primary_key")))
    return out


# --- API specifications ---------------------------------------------------------------------------------------

#: Keys of a path that are operations.
_OPERATIONS = {"get", "put", "post", "delete", "options", "head", "patch", "trace"}
_KEY = re.compile(r"""(?P<key>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},?-][^#]*?)\s*:(?:\s+(?P<value>.*))?$""")


def yaml_mappings(text: str) -> dict:
    """Nested block mappings of a YAML text with their plain values as strings; lists, flow values and block texts stay out."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    skip: int | None = None  # lines deeper than this belong to a list or a block text
    for raw in text.splitlines():
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.startswith(("---", "%")):
            continue
        depth = len(line) - len(line.lstrip())
        if skip is not None and depth > skip:
            continue
        skip = None
        m = _KEY.match(line.strip())
        if line.lstrip().startswith("- ") or line.strip() == "-" or not m:
            skip = depth
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key, value = m.group("key"), (m.group("value") or "").strip()
        key = key[1:-1] if key[:1] in "'\"" else key
        value = re.sub(r"\s+#.*$", "", value) if value[:1] not in "'\"" else value
        if value[:1] in ("|", ">"):
            skip = depth
        elif value and not value.startswith(("&", "#")):
            stack[-1][1][key] = value[1:-1] if value[:1] in "'\"" and value[-1:] == value[:1] else value
        else:
            inner: dict = {}
            stack[-1][1][key] = inner
            stack.append((depth, inner))
    return root


def endpoints(file: str, text: str | None) -> list[tuple[str, str, str | None, str]]:
    """(path, method, operation, summary) of a Swagger or OpenAPI file, JSON by its suffix, else YAML."""
    if not text:
        return []
    try:
        spec = json.loads(text) if file.lower().endswith(".json") else yaml_mappings(text)
    except ValueError:
        return []
    paths = spec.get("paths") if isinstance(spec, dict) else None
    out = []
    for path, operations in (paths if isinstance(paths, dict) else {}).items():
        for method, op in (operations if isinstance(operations, dict) else {}).items():
            if method.lower() in _OPERATIONS and isinstance(op, dict):
                out.append((path, method.upper(), op.get("operationId"), op.get("summary") or ""))
    return out


# --- string literals ------------------------------------------------------------------------------------------


def literals(file: str, text: str | None, least: int = 3) -> list[tuple[int, int, str]]:
    """(line, column from 0, value) of string literals; holes of interpolated ones read {}."""
    if not text:
        return []
    if not file.endswith(".py"):
        return [x for x in _scanned_literals(text) if len(x[2]) >= least]
    tree = _tree(text)
    if tree is None:
        return []
    inside = {id(c) for n in ast.walk(tree) if isinstance(n, ast.JoinedStr) for c in ast.walk(n) if c is not n}
    docs = {id(n.body[0].value) for n in ast.walk(tree) if isinstance(n, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and n.body and isinstance(n.body[0], ast.Expr)}
    out = []
    for node in ast.walk(tree):
        if id(node) in inside or id(node) in docs:
            continue
        value = _text(node)
        if isinstance(node, ast.JoinedStr):
            value = "".join(_text(v) if _text(v) is not None else _HOLE for v in node.values)
        if value is not None and len(value) >= least:
            out.append((node.lineno, node.col_offset, value))
    return sorted(out)


def _scanned_literals(text: str) -> Iterator[tuple[int, int, str]]:
    code = blanked(text)
    at = 0
    while at < len(code):
        quote = code[at]
        if quote in "'\"":
            end = code.find(quote, at + 1)
            stop = code.find("\n", at + 1)
            if end < 0 or 0 <= stop < end:
                at += 1
                continue
            yield text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1), text[at + 1 : end]
            at = end + 1
        elif quote == "`":
            start, value, k = at, "", at + 1
            while k < len(text) and text[k] != "`":
                if text.startswith("${", k):
                    k = _closing(code if code[k + 1] == "{" else text, k + 1)
                    k = len(text) if k < 0 else k
                    value += _HOLE
                else:
                    value += text[k]
                    k += 1
            yield text.count("\n", 0, start) + 1, start - (text.rfind("\n", 0, start) + 1), value
            at = k + 1
        else:
            at += 1
