"""Structural elements of source files, by language: what a file declares, and on which lines.

Each reader takes (text, module) and yields ``Element`` rows; ``elements_of`` picks the reader by the file's name. Python
is read through its own syntax tree and HTML through the standard parser. The others are scanned: JavaScript and
TypeScript after comments, strings, templates and regular expressions have been blanked out (so that braces and words
inside them count for nothing), the rest line by line. A file that its reader cannot follow has no elements.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple


class Element(NamedTuple):
    language: str
    subtype: str
    qualified_name: str
    signature: str
    line_start: int
    line_end: int
    parent: str | None
    body_sha: str


#: The language of a file name's suffix.
LANGUAGES = {
    ".py": "python", ".html": "html", ".htm": "html", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".mjs": "javascript", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".markdown": "markdown", ".conf": "hocon", ".rst": "rst", ".dockerfile": "dockerfile", ".ini": "ini", ".cfg": "ini",
}
#: Elements of HTML that count without an id or class.
LANDMARKS = {"section", "article", "header", "nav", "main", "footer", "aside", "form", "table"}
BRANCH_LINES = 80  # functions of so many lines have their branches listed


def language_of(file: str) -> str | None:
    name = file.rsplit("/", 1)[-1]
    if name == "Dockerfile" or name.startswith("Dockerfile."):
        return "dockerfile"
    return LANGUAGES.get(name[name.rfind(".") :].lower()) if "." in name else None


def module_of(file: str) -> str:
    """Dotted path without the suffix; a package's ``__init__`` is the package."""
    stem = file.rsplit(".", 1)[0] if "." in file.rsplit("/", 1)[-1] else file
    parts = [p for p in stem.split("/") if p]
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] == "__init__" else parts)


def _element(language: str, subtype: str, name: str, body: str, first: int, last: int, parent: str | None = None) -> Element:
    head = next((x.strip() for x in body.splitlines() if x.strip()), "")
    return Element(language, subtype, name, head, first, last, parent, hashlib.sha256(body.encode("utf-8", "replace")).hexdigest())


def _unique(name: str, seen: set[str]) -> str:
    """The name, or the name with the first number from 2 that is free."""
    k, out = 2, name
    while out in seen:
        out, k = f"{name}_{k}", k + 1
    seen.add(out)
    return out


def _slug(text: str) -> str:
    kept = re.sub(r"[^A-Za-z0-9_\s-]", "", text).strip().lower()
    return re.sub(r"[\s-]+", "_", kept) or "section"


# --- Python ---------------------------------------------------------------------------------------------------


def python(text: str, module: str) -> Iterator[Element]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = text.split("\n")

    def body(node: ast.AST) -> str:
        part = lines[node.lineno - 1 : node.end_lineno]
        part[-1] = part[-1].encode()[: node.end_col_offset].decode("utf-8", "ignore")
        part[0] = part[0].encode()[node.col_offset :].decode("utf-8", "ignore")
        return "\n".join(part)

    def walk(node: ast.AST, parent: str, in_class: bool) -> Iterator[Element]:
        for child in ast.iter_child_nodes(node):
            above = parent if parent != module else None
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "method" if in_class else "async_function" if isinstance(child, ast.AsyncFunctionDef) else "function"
                yield _element("python", kind, f"{parent}.{child.name}", body(child), child.lineno, child.end_lineno, above)
                yield from walk(child, parent, False)
            elif isinstance(child, ast.ClassDef):
                yield _element("python", "class", f"{parent}.{child.name}", body(child), child.lineno, child.end_lineno, above)
                yield from walk(child, f"{parent}.{child.name}", True)
            else:
                targets = child.targets if isinstance(child, ast.Assign) else [child.target] if isinstance(child, ast.AnnAssign) else []
                for target in targets:
                    yield _element("python", "variable", f"{parent}.{ast.unparse(target)}", body(child), child.lineno, child.end_lineno, above)
                yield from walk(child, parent, in_class and not isinstance(child, ast.expr))

    yield from walk(tree, module, False)


# --- JavaScript and TypeScript --------------------------------------------------------------------------------

_VALUE_BEFORE = re.compile(r"[\w$)\]}'\"`]\s*$")
_KEYWORD_BEFORE = re.compile(r"\b(return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await)\s*$")


def blanked(text: str) -> str:
    """The text with the insides of comments, strings, templates and regular expressions as blanks; same length and lines."""
    out, at, n = list(text), 0, len(text)
    holes: list[int] = []  # brace depth at which each open template goes on
    depth = 0

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def template(a: int) -> int:
        """From inside a template to its end, or into its next hole."""
        k = a
        while k < n:
            if text[k] == "\\":
                k += 2
            elif text[k] == "`":
                wipe(a, k)
                return k + 1
            elif text.startswith("${", k):
                wipe(a, k)
                holes.append(depth)
                return k + 2
            else:
                k += 1
        wipe(a, n)
        return n

    while at < n:
        c, two = text[at], text[at : at + 2]
        if two == "//":
            end = text.find("\n", at)
            end = n if end < 0 else end
            wipe(at, end)
            at = end
        elif two == "/*":
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            wipe(at, end)
            at = end
        elif c in "'\"":
            end = at + 1
            while end < n and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            wipe(at + 1, end)
            at = end + 1
        elif c == "`":
            at = template(at + 1)
        elif c == "/":
            before = "".join(out[max(0, at - 24) : at])
            if before.strip() and _VALUE_BEFORE.search(before) and not _KEYWORD_BEFORE.search(before):
                at += 1  # a division
                continue
            end, inside = at + 1, False
            while end < n and text[end] != "\n" and (inside or text[end] != "/"):
                inside = (inside or text[end] == "[") and text[end] != "]"
                end += 2 if text[end] == "\\" else 1
            wipe(at + 1, end)
            at = end + 1
        else:
            if c == "}" and holes and holes[-1] == depth:
                holes.pop()
                at = template(at + 1)
                continue
            depth += (c == "{") - (c == "}")
            at += 1
    return "".join(out)


def _closing(code: str, at: int, pair: str = "{}") -> int:
    """Place after the bracket that closes the first one from ``at`` on; -1 without."""
    at = code.find(pair[0], at)
    depth = 0
    for m in re.finditer(f"[{re.escape(pair)}]", code[at:]) if at >= 0 else ():
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return at + m.end()
    return -1


def _starts_statement(code: str, at: int) -> bool:
    before = code[:at].rstrip()
    return not before or before[-1] in ";{})" or bool(re.search(r"(^|[;{}\s])(export|default|declare|else)$", before)) or ("\n" in code[len(before) : at] and before[-1] not in "=(,:?&|+*[<")


def _statement_end(code: str, at: int) -> int:
    """End of a declaration: its semicolon, or the line end after which nothing can go on."""
    depth, k = 0, at
    while k < len(code):
        c = code[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                return k
            depth -= 1
        elif c == ";" and depth == 0:
            return k + 1
        elif c == "\n" and depth == 0:
            before, after = code[at:k].rstrip(), code[k:].lstrip()
            if before[-1:] not in ("=", ",", ":", "?", "&", "|", "+", "-", "*", "(", ">") and after[:1] not in (".", "?", ":", "&", "|", "+", "*", ",", "=", "("):
                return len(code[:k].rstrip())
        k += 1
    return len(code.rstrip())


_DECLARED = re.compile(r"\b(?:(async\s+)?function\s+([A-Za-z_$][\w$]*)|(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)|(const|let)\s+(?=[A-Za-z_$]))")
_CALLED = re.compile(r"(?<![\w$.])(describe|it|test)\s*\(\s*(['\"])")


def javascript(text: str, module: str, first_line: int = 1, parent: str | None = None) -> Iterator[Element]:
    code = blanked(text)
    line = lambda at: first_line + text.count("\n", 0, at)
    make = lambda kind, name, a, b, up: _element("javascript", kind, name, text[a:b], line(a), line(max(a, b - 1)), up)
    for m in _DECLARED.finditer(code):
        at = m.start()
        looped = bool(re.search(r"\bfor\s*\($", code[:at].rstrip()))
        if not (_starts_statement(code, at) or m.group(4) and looped):
            continue
        if m.group(4):
            yield from _variables(text, code, m, module, make, parent, looped)
            continue
        end = _closing(code, _closing(code, m.end(), "()") if m.group(2) else m.end())
        if end < 0:
            continue
        name = m.group(2) or m.group(3)
        yield make("js_function" if m.group(2) else "js_class", f"{module}.{name}", at, end, parent)
        if m.group(2) and line(end - 1) - line(at) >= BRANCH_LINES:
            yield from _branches(text, code, at, end, f"{module}.{name}", make)
    if parent is None:
        yield from _test_blocks(text, code, module, make)


def _variables(text: str, code: str, m: re.Match, module: str, make, parent: str | None, looped: bool) -> Iterator[Element]:
    end = code.find(";", m.end()) if looped else _statement_end(code, m.end())
    if end < 0 or looped and re.match(r"[\w$]+\s+(of|in)\b", code[m.end() :]):
        return
    exported = bool(re.search(r"\bexport\s+$", code[: m.start()]))
    depth, fresh, typed, k = 0, True, False, m.end()
    while k < end:
        if fresh:
            named = re.compile(r"\s*([A-Za-z_$][\w$]*)").match(code, k)
            if named:
                yield make("js_export" if exported else "variable", f"{module}.{named.group(1)}", m.start(), end, parent)
                k = named.end()
                typed = code[k:].lstrip()[:1] == ":"
            fresh = False
            continue
        typed = typed and not (code[k] == "=" and depth == 0 and code[k + 1 : k + 2] != ">")
        opens, closes = ("([{<", ")]}>") if typed else ("([{", ")]}")
        depth += (code[k] in opens) - (code[k] in closes and code[k - 1 : k + 1] != "=>")
        fresh = code[k] == "," and depth == 0
        k += 1


def _branches(text: str, code: str, at: int, end: int, name: str, make) -> Iterator[Element]:
    seen: set[str] = set()
    for m in re.finditer(r"\bif\s*\(", code[at:end]):
        a = at + m.start()
        head = text[a : text.find("\n", a) if "\n" in text[a:] else len(text)]
        compared, tested = re.search(r"===?\s*['\"](\w+)['\"]", head), re.search(r"if\s*\(\s*([A-Za-z_]\w*)", head)
        if not compared and not tested:
            continue
        condition = _closing(code, a, "()")
        block = code[condition:].lstrip()[:1] == "{"
        stop = _closing(code, condition) if block else _statement_end(code, condition)
        yield make("js_branch", f"{name}.{_unique(f'{(compared or tested).group(1)}_branch', seen)}", a, stop, name)


def _test_blocks(text: str, code: str, module: str, make) -> Iterator[Element]:
    suites: list[tuple[int, str]] = []
    for m in _CALLED.finditer(code):
        end = _closing(code, m.start(), "()")
        close = code.find(m.group(2), m.end())
        if end < 0 or close < 0:
            continue
        while suites and suites[-1][0] <= m.start():
            suites.pop()
        chain = [s for _, s in suites]
        name = text[m.end() : close]
        above = f"{module}::{' > '.join(chain)}" if chain else module
        yield make("js_test_suite" if m.group(1) == "describe" else "js_test_case", f"{module}::{' > '.join([*chain, name])}", m.start(), end, above)
        if m.group(1) == "describe":
            suites.append((end, name))


# --- HTML -----------------------------------------------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.text, self.starts = text, [0]
        for m in re.finditer("\n", text):
            self.starts.append(m.end())
        self.open: list[int] = []
        self.found: list[list] = []  # tag, id, class, start, end
        self.scripts: list[tuple[int, int]] = []
        self.feed(text)
        self.close()
        for k in self.open:
            self.found[k][4] = len(text)

    def at(self) -> int:
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        at = self.at()
        self.found.append([tag, a.get("id"), a.get("class"), at, at + len(self.get_starttag_text() or "")])
        if tag not in _VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if not any(self.found[k][0] == tag for k in self.open):
            return
        end = self.text.find(">", self.at()) + 1 or len(self.text)
        while self.open:
            k = self.open.pop()
            same = self.found[k][0] == tag
            self.found[k][4] = end if same else self.at()
            if same:
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.found[self.open[-1]][0] == "script" and data.strip():
            self.scripts.append((self.at(), len(data)))


def html(text: str, module: str) -> Iterator[Element]:
    """``module`` is the file's path here: elements are named path#id, path.class or path and tag with its number."""
    page = _Page(text)
    seen: set[str] = set()
    number = -1
    for tag, ident, classes, a, b in page.found:
        if tag in ("script", "style"):
            continue
        number += 1
        if not (tag in LANDMARKS or ident or classes):
            continue
        name = f"{module}#{ident}" if ident else f"{module}.{classes.split()[0]}" if classes and classes.split() else f"{module}{tag}[{number}]"
        if name not in seen:
            seen.add(name)
            yield _element("html", "html_element", name, text[a:b], text.count("\n", 0, a) + 1, text.count("\n", 0, max(a, b - 1)) + 1)
    for at, size in page.scripts:
        yield from javascript(text[at : at + size], module, text.count("\n", 0, at) + 1, module)


# --- data and prose -------------------------------------------------------------------------------------------


def json_keys(text: str, module: str) -> Iterator[Element]:
    """Keys of the top object with the lines of their values."""
    decoder, blank = json.JSONDecoder(), re.compile(r"\s*")
    at = blank.match(text).end()
    if text[at : at + 1] != "{":
        return
    at += 1
    try:
        while True:
            at = blank.match(text, at).end()
            if text[at : at + 1] != '"':
                return
            start = at
            key, at = decoder.raw_decode(text, at)
            at = blank.match(text, at).end()
            if text[at : at + 1] != ":":
                return
            _, at = decoder.raw_decode(text, blank.match(text, at + 1).end())
            if key.strip():
                yield _element("json", "json_key", f"{module}.{key.strip()}", text[start:at], text.count("\n", 0, start) + 1, text.count("\n", 0, at) + 1, module)
            at = blank.match(text, at).end()
            if text[at : at + 1] != ",":
                return
            at += 1
    except ValueError:
        return


_YAML_KEY = re.compile(r"""^(?P<key>"[^"]*"|'[^']*'|[^\s#\-\[\]{},&*!|>'"%@`?:][^#:]*?|[^\s#\[\]{},&*!|>'"%@`?:]+?)\s*:(?=\s|$)""")


def yaml_keys(text: str, module: str) -> Iterator[Element]:
    """Keys without indentation, up to the next one; block texts and comments are no keys."""
    lines = text.splitlines()
    starts: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        m = _YAML_KEY.match(line)
        if m and not line.startswith(("---", "...", "- ")):
            starts.append((i, m.group("key").strip().strip("'\"")))
    for (i, key), after in zip(starts, [*(s for s, _ in starts[1:]), len(lines)], strict=True):
        last = after
        while last > i + 1 and (not lines[last - 1].strip() or lines[last - 1].lstrip().startswith("#") or lines[last - 1].startswith(("---", "..."))):
            last -= 1
        yield _element("yaml", "yaml_key", f"{module}.{key}", "\n".join(lines[i:last]), i + 1, last, module)


def markdown(text: str, module: str) -> Iterator[Element]:
    """A section from each heading outside fences to the next one of its level or above."""
    lines = text.splitlines()
    heads, fenced = [], False
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.+?)\s*$", line)):
            heads.append((i, len(m.group(1)), m.group(2)))
    seen: set[str] = set()
    for k, (i, level, title) in enumerate(heads):
        end = next((j for j, other, _ in heads[k + 1 :] if other <= level), len(lines))
        yield _element("markdown", "md_section", f"{module}.{_unique(_slug(title), seen)}", "\n".join(lines[i:end]), i + 1, end, module)


_ADORNED = re.compile(r"([!-/:-@\[-`{-~])\1*\s*$")


def rst(text: str, module: str) -> Iterator[Element]:
    """Sections by adorned titles; the order in which adornments first come gives the levels."""
    lines = text.splitlines()
    styles: list[tuple] = []
    found: list[tuple[int, int, str]] = []
    i = 0
    while i + 1 < len(lines):
        title, under = lines[i], lines[i + 1]
        over = _ADORNED.match(title) and i + 2 < len(lines) and len(title.rstrip()) >= 2 and lines[i + 1].strip() and lines[i + 2].rstrip() == title.rstrip() and not _ADORNED.match(lines[i + 1])
        if over:
            style, text_at, step = (title[0], True), i + 1, 3
        elif title.strip() and not title[0].isspace() and not _ADORNED.match(title) and _ADORNED.match(under) and len(under.rstrip()) >= min(4, len(title.rstrip())):
            style, text_at, step = (under[0], False), i, 2
        else:
            i += 1
            continue
        if style not in styles:
            styles.append(style)
        found.append((text_at, styles.index(style), lines[text_at].strip()))
        i += step
    seen: set[str] = set()
    names: list[tuple[int, str]] = []
    for k, (i, level, title) in enumerate(found):
        while names and names[-1][0] >= level:
            names.pop()
        end = found[k + 1][0] if k + 1 < len(found) else len(lines)
        name = f"{module}.{_unique(_slug(title), seen)}"
        yield _element("rst", "rst_section", name, "\n".join(lines[i:end]), i + 1, end, names[-1][1] if names else module)
        names.append((level, name))


def ini(text: str, module: str) -> Iterator[Element]:
    parent = module
    for i, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if m := re.match(r"\[([^\]]+)\]\s*$", line):
            parent = f"{module}.{m.group(1).strip()}"
            yield _element("ini", "ini_section", parent, line, i, i, module)
        elif m := re.match(r"([A-Za-z0-9_.\-]+)\s*[=:]", line):
            yield _element("ini", "ini_key", f"{parent}.{m.group(1)}", line, i, i, parent)


_HOCON = re.compile(r"""(?P<skip>\#[^\n]*|//[^\n]*|\"\"\"[\s\S]*?\"\"\")|(?P<key>(?:"[^"\n]*"|[\w\-$]+)(?:\.(?:"[^"\n]*"|[\w\-$]+))*)\s*(?P<sep>\+?=|:(?!//)|(?=\{))|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<open>[{\[])|(?P<close>[}\]])""")


def hocon(text: str, module: str) -> Iterator[Element]:
    """Every key path with the lines of its value; keys inside objects hang below them."""
    if re.search(r"(?m)^\s*\[[^\]\n=]+\]\s*$", text):
        yield from ini(text, module)
        return
    stack: list[tuple[str, int, int, str | None]] = []  # bracket, place of its key, its line, name (None: in a list)
    done: list[Element] = []
    at, wanted = 0, None
    line = lambda k: text.count("\n", 0, k) + 1
    while at < len(text):
        m = _HOCON.match(text, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup if m.lastgroup != "sep" else "key"
        inside_list = any(b == "[" for b, *_ in stack)
        if kind == "key" and not inside_list:
            parent = next((s[3] for s in reversed(stack) if s[3]), module)
            wanted = (m.start(), f"{parent}.{m.group('key').replace(chr(34), '')}", parent)
            end = m.end()
            rest = re.compile(r"\s*").match(text, end).end()
            if text[rest : rest + 1] not in ("{", "["):
                stop = text.find("\n", end)
                stop = len(text) if stop < 0 else stop
                value = re.split(r"(?<!:)//|#|[,}]", text[end:stop])[0] if '"' not in text[end:stop] else text[end:stop]
                if text.startswith('"""', rest):
                    stop = text.find('"""', rest + 3) + 3
                    value = text[end:stop]
                done.append(_element("hocon", "hocon_key", wanted[1], text[m.start() : end + len(value)].rstrip(), line(m.start()), line(end + max(0, len(value.rstrip()) - 1)), wanted[2]))
                at = end + len(value)
                continue
            at = rest
            continue
        if kind == "open":
            stack.append((m.group("open"), wanted[0] if wanted else at, line(at), wanted[1] if wanted else None))
            if wanted:
                stack[-1] = (*stack[-1][:3], wanted[1])
                done.append(Element("hocon", "hocon_key", wanted[1], "", line(wanted[0]), 0, wanted[2], str(len(done))))
            wanted = None
        elif kind == "close":
            if not stack:
                return
            _, start, _, name = stack.pop()
            if name:
                k = next(i for i in range(len(done) - 1, -1, -1) if done[i].qualified_name == name and done[i].line_end == 0)
                done[k] = _element("hocon", "hocon_key", name, text[start : m.end()], line(start), line(at), done[k].parent)
        at = max(m.end(), at + 1)
    if not stack:
        yield from done


def dockerfile(text: str, module: str) -> Iterator[Element]:
    """A stage for each FROM, and ENV, ARG and EXPOSE below their stage; continued lines belong together."""
    lines = text.splitlines()
    stage, number, i = None, 0, 0
    while i < len(lines):
        first, parts = i, [lines[i]]
        while parts[-1].rstrip().endswith("\\") and i + 1 < len(lines) and not parts[0].lstrip().startswith("#"):
            i += 1
            parts.append(lines[i])
        i += 1
        body = "\n".join(parts)
        whole = " ".join(p.strip().rstrip("\\").strip() for p in parts if not p.strip().startswith("#"))
        m = re.match(r"(?i)(from|env|arg|expose)\s+(.+)$", whole)
        if not m:
            continue
        word, value = m.group(1).upper(), m.group(2).strip()
        if word == "FROM":
            named = re.search(r"(?i)\s+as\s+(\S+)$", value)
            stage = named.group(1) if named else f"stage{number}"
            number += 1
            yield _element("dockerfile", "dockerfile_stage", stage, body, first + 1, i)
        else:
            key = value.split("=")[0].split()[0]
            yield _element("dockerfile", f"dockerfile_{word.lower()}", f"{stage}.{key}" if stage else key, body, first + 1, i, stage)


READERS = {"python": python, "javascript": javascript, "json": json_keys, "yaml": yaml_keys, "markdown": markdown, "rst": rst, "ini": ini, "hocon": hocon, "dockerfile": dockerfile}


def elements_of(file: str, text: str | None) -> list[Element]:
    language = language_of(file)
    if language is None or not text:
        return []
    if language == "html":
        return list(html(text, file))
    return list(READERS[language](text, module_of(file)))
