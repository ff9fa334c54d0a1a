"""Elements of files of many shapes. Expectations are written by hand: (subtype, name, first line, last line, parent)."""

import pytest

from quarry.functions.elements import blanked, elements_of, language_of, module_of

PYTHON = '''import os
LIMIT: int = 3
a, b = 1, 2

class Outer(Base):
    """class NotMe: def nor_me(): pass"""
    size = 4

    @property
    def area(self):  # def comment(): pass
        def inner():
            return "def text(): pass"
        return inner()

    class Inner:
        async def wait(self): pass

async def main():
    x = 1
    return x
'''
JAVASCRIPT = """import x from 'y';
// function commented() {}
/* class Hidden { } */
export const limit = 3, other = `a ${ { b: "}" }.b } function no() {}`;
async function load(url) {
  const found = /[/}]{2}/.test(url) ? 1 / 2 : "function text() {";
  return found;
}
export default class Store extends Base {
  method() { let local = () => { return 1; }; }
}
const later = function named() {
  return 2;
}
let typed: Map<string, number> = new Map()
for (let i = 0; i < 3; i++) { }
for (const item of list) { }
"""
TESTS = """describe('outer', () => {
  it("works", () => { expect(1).toBe(1) });
  describe('inner', function () {
    test('deep', async () => {});
  });
});
it(`dynamic`, () => {});
obj.test('no', 1);
"""
HTML = """<!doctype html>
<html><body>
<div class="box wide">one<br>two</div>
<p>plain</p>
<section>
 <h1 id="top">T</h1>
</section>
<div class="box">again</div>
<script>
function go() {
  return "</p>";
}
</script>
<!-- <nav>no</nav> -->
</body></html>
"""
JSON = '{"a": 1,\r\n "b": {"c": [1, "x: {"]},\r\n "d\\"e": null}'
YAML = """# top: comment
name: x
"quoted key": 1
list:
  - a: 1
  - b
text: |
  not_a_key: here
  # neither

url: http://h/x:y
---
second: {a: 1}
"""
MARKDOWN = """# Title
text
```py
# not a heading
```
## Part one!
#hash
### Deep
## Part one!
end"""
RST = """=====
Title
=====

Intro
-----
text

Deeper
~~~~~~
.. autoclass:: m.C

Next
----
- - -
"""
INI = "; note\n[main]\nkey = v\nother: w\n\n[two]\nkey=1\n"
HOCON = """# c
a.b = 1 // tail
server {
  host = "x#y"  # z
  ports = [80, { no = 1 }]
  tls : { on = true }
}
server.name = web
"""
DOCKER = """ARG V=1
FROM --platform=x base:${V} AS build
ENV A=1 \\
    B=2
# ENV NO=1
RUN make
FROM scratch
EXPOSE 80/tcp
"""

CASES = [
    ("pkg/mod.py", PYTHON, [
        ("variable", "pkg.mod.LIMIT", 2, 2, None), ("variable", "pkg.mod.(a, b)", 3, 3, None), ("class", "pkg.mod.Outer", 5, 16, None), ("variable", "pkg.mod.Outer.size", 7, 7, "pkg.mod.Outer"),
        ("method", "pkg.mod.Outer.area", 10, 13, "pkg.mod.Outer"), ("function", "pkg.mod.Outer.inner", 11, 12, "pkg.mod.Outer"), ("class", "pkg.mod.Outer.Inner", 15, 16, "pkg.mod.Outer"),
        ("method", "pkg.mod.Outer.Inner.wait", 16, 16, "pkg.mod.Outer.Inner"), ("async_function", "pkg.mod.main", 18, 20, None), ("variable", "pkg.mod.x", 19, 19, None),
    ]),
    ("web/app.ts", JAVASCRIPT, [
        ("js_export", "web.app.limit", 4, 4, None), ("js_export", "web.app.other", 4, 4, None), ("js_function", "web.app.load", 5, 8, None), ("variable", "web.app.found", 6, 6, None),
        ("js_class", "web.app.Store", 9, 11, None), ("variable", "web.app.local", 10, 10, None), ("variable", "web.app.later", 12, 14, None), ("variable", "web.app.typed", 15, 15, None), ("variable", "web.app.i", 16, 16, None),
    ]),
    ("a.test.js", TESTS, [
        ("js_test_suite", "a.test::outer", 1, 6, "a.test"), ("js_test_case", "a.test::outer > works", 2, 2, "a.test::outer"), ("js_test_suite", "a.test::outer > inner", 3, 5, "a.test::outer"),
        ("js_test_case", "a.test::outer > inner > deep", 4, 4, "a.test::outer > inner"),
    ]),
    ("p/i.html", HTML, [("html_element", "p/i.html.box", 3, 3, None), ("html_element", "p/i.htmlsection[5]", 5, 7, None), ("html_element", "p/i.html#top", 6, 6, None), ("js_function", "p/i.html.go", 10, 12, "p/i.html")]),
    ("c/d.json", JSON, [("json_key", "c.d.a", 1, 1, "c.d"), ("json_key", "c.d.b", 2, 2, "c.d"), ("json_key", 'c.d.d"e', 3, 3, "c.d")]),
    ("c/d.yml", YAML, [("yaml_key", "c.d.name", 2, 2, "c.d"), ("yaml_key", "c.d.quoted key", 3, 3, "c.d"), ("yaml_key", "c.d.list", 4, 6, "c.d"), ("yaml_key", "c.d.text", 7, 8, "c.d"), ("yaml_key", "c.d.url", 11, 11, "c.d"), ("yaml_key", "c.d.second", 13, 13, "c.d")]),
    ("R.md", MARKDOWN, [("md_section", "R.title", 1, 10, "R"), ("md_section", "R.part_one", 6, 8, "R"), ("md_section", "R.deep", 8, 8, "R"), ("md_section", "R.part_one_2", 9, 10, "R")]),
    ("R.rst", RST, [("rst_section", "R.title", 2, 4, "R"), ("rst_section", "R.intro", 5, 8, "R.title"), ("rst_section", "R.deeper", 9, 12, "R.intro"), ("rst_section", "R.next", 13, 15, "R.title")]),
    ("s.cfg", INI, [("ini_section", "s.main", 2, 2, "s"), ("ini_key", "s.main.key", 3, 3, "s.main"), ("ini_key", "s.main.other", 4, 4, "s.main"), ("ini_section", "s.two", 6, 6, "s"), ("ini_key", "s.two.key", 7, 7, "s.two")]),
    ("s.conf", INI, [("ini_section", "s.main", 2, 2, "s"), ("ini_key", "s.main.key", 3, 3, "s.main"), ("ini_key", "s.main.other", 4, 4, "s.main"), ("ini_section", "s.two", 6, 6, "s"), ("ini_key", "s.two.key", 7, 7, "s.two")]),
    ("h.conf", HOCON, [
        ("hocon_key", "h.a.b", 2, 2, "h"), ("hocon_key", "h.server", 3, 7, "h"), ("hocon_key", "h.server.host", 4, 4, "h.server"), ("hocon_key", "h.server.ports", 5, 5, "h.server"), ("hocon_key", "h.server.tls", 6, 6, "h.server"),
        ("hocon_key", "h.server.tls.on", 6, 6, "h.server.tls"), ("hocon_key", "h.server.name", 8, 8, "h"),
    ]),
    ("x/Dockerfile", DOCKER, [("dockerfile_arg", "V", 1, 1, None), ("dockerfile_stage", "build", 2, 2, None), ("dockerfile_env", "build.A", 3, 4, "build"), ("dockerfile_stage", "stage1", 7, 7, None), ("dockerfile_expose", "stage1.80/tcp", 8, 8, "stage1")]),
    ("notes.txt", "class A: pass", []),
    ("broken.py", "def f(:\n", []),
    ("broken.json", '{"a": ', []),
    ("broken.conf", "a { b = 1", []),
    ("empty.md", None, []),
]


@pytest.mark.parametrize("file,text,want", CASES, ids=[c[0] for c in CASES])
def test_elements(file, text, want):
    got = [(e.subtype, e.qualified_name, e.line_start, e.line_end, e.parent) for e in elements_of(file, text)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if text and "\r" not in text and file.endswith((".py", ".ts", ".md", ".json")):
        assert sorted((e[0], e[1], e[2]) for e in got) == sorted((e.subtype, e.qualified_name, e.line_start) for e in elements_of(file, text.replace("\n", "\r\n")))


def test_names():
    assert module_of("a/b/__init__.py") == "a.b" and module_of("setup.py") == "setup"
    assert language_of("x/Dockerfile.dev") == "dockerfile" and language_of("a.TSX") == "javascript" and language_of("x.go") is None and language_of("none") is None


def test_blanking_keeps_places():
    assert len(blanked(JAVASCRIPT)) == len(JAVASCRIPT) and blanked(JAVASCRIPT).count("\n") == JAVASCRIPT.count("\n")
    assert blanked("a = b / c / d; // x") == "a = b / c / d;     "


def test_branches_of_long_functions():
    body = "\n".join("  step();" for _ in range(90))
    text = f"function big(mode) {{\n  if (mode === 'fast') {{\n    a();\n  }}\n  if (mode) b();\n  if (mode == \"fast\") {{}}\n{body}\n}}\n"
    got = [(e.qualified_name, e.line_start, e.line_end) for e in elements_of("m.js", text) if e.subtype == "js_branch"]
    assert got == [("m.big.fast_branch", 2, 4), ("m.big.mode_branch", 5, 5), ("m.big.fast_branch_2", 6, 6)]
