"""Routes, mapped tables, migrations and literals in files of many shapes; expectations are written by hand."""

import pytest

from quarry.functions.codefacts import clients, endpoints, literals, mapped_columns, migrated_columns, processes, routes, yaml_mappings

FLASK = '''from flask import Flask
app = Flask(__name__)
cache = Cache()

@app.route("/a/<int:id>", methods=["GET", "POST"])
@login
def a(id): pass

@app.route('/plain')
def plain(): pass

@cache.get("/not-a-route")
def no(): pass

class V:
    @router.get("/items/{item_id:path}")  # imported router
    async def items(self): pass

@app.get(prefix + "/dynamic")
def dynamic(): pass

TEXT = """
@app.get("/in-a-string")
"""
'''
EXPRESS = """const express = require('express');
const app = express();
const map = new Map();
// app.get('/commented', h);
app.get('/users/:id', (req, res) => { map.get('/x', 1); });
router.post("/things/:a/:b?", auth, handler);
app.get('setting');
app.delete(`/t`, h); app.put(`/t/${x}`, h);
const s = "app.get('/text', h)";
app.all('/any', h)
"""
GO = """package main
func main() {
  http.HandleFunc("/health", h)
  r.GET("/users/:id", h) // r.POST("/no", h)
  mux.HandleFunc("POST /things/{id}", h)
  g.HandleFunc("/m/{id:[0-9]+}", h).Methods("PUT")
}
"""
AKKA = """val route = pathPrefix("api") {
  path("users" / IntNumber) { id =>
    get { complete("x") } ~
    delete { complete("y") }
  } ~
  post { path("new") { complete("z") } }
}
"""


@pytest.mark.parametrize(
    "file,text,want",
    [
        ("a.py", FLASK, [(5, "GET", "/a/{id}"), (5, "POST", "/a/{id}"), (9, "GET", "/plain"), (16, "GET", "/items/{item_id}")]),
        ("a.ts", EXPRESS, [(5, "GET", "/users/{id}"), (6, "POST", "/things/{a}/{b}"), (8, "DELETE", "/t"), (10, "*", "/any")]),
        ("a.go", GO, [(3, "*", "/health"), (4, "GET", "/users/{id}"), (5, "POST", "/things/{id}"), (6, "PUT", "/m/{id}")]),
        ("a.scala", AKKA, [(3, "GET", "/api/users/{arg0}"), (4, "DELETE", "/api/users/{arg0}"), (6, "POST", "/api/new")]),
        ("a.rb", "get '/x' do end", []),
        ("broken.py", "@app.get('/x'\ndef f(", []),
        ("a.py", None, []),
    ],
)
def test_routes(file, text, want):
    assert sorted(routes(file, text)) == want


MODELS = '''class User(Base):
    __tablename__ = "users"
    id = Column(Integer, primary_key=True)
    mail = Column("email", String(50))
    team_id: Mapped[int] = mapped_column(ForeignKey("teams.id"))
    nick: Mapped[str | None]
    posts = relationship("Post")
    LIMIT = 3

class NoTable(Base):
    x = Column(Integer)

class Order(models.Model):
    title = models.CharField(max_length=3)
    owner = models.ForeignKey(User, on_delete=models.CASCADE)
    code = models.SlugField(db_column="c0de")
    tags = models.ManyToManyField("Tag")
    class Meta:
        db_table = "orders"

class Line(models.Model):
    n = models.IntegerField()
'''
SLICK = """class Users(tag: Tag) extends Table[(Int, String)](tag, "users") {
  def id = column[Int]("id", O.PrimaryKey) // column[Int]("no")
  def name = column[Option[String]]("full_name")
  def * = (id, name)
}
"""


def test_mapped_columns():
    assert mapped_columns("shop/models.py", MODELS) == [
        (3, "users", "id", "Integer"), (4, "users", "email", "String"), (5, "users", "team_id", "int"), (6, "users", "nick", "str | None"),
        (14, "orders", "title", "CharField"), (15, "orders", "owner_id", "ForeignKey"), (16, "orders", "c0de", "SlugField"), (22, "shop_line", "n", "IntegerField"),
    ]
    assert mapped_columns("Users.scala", SLICK) == [(2, "users", "id", "Int"), (3, "users", "full_name", "Option[String]")]
    assert mapped_columns("a.py", "class (:") == mapped_columns("a.txt", MODELS) == []


def test_migrations():
    django = '''operations = [
    migrations.CreateModel(name="Order", fields=[
        ("id", models.AutoField(primary_key=True)),
        ("owner", models.ForeignKey("User", on_delete=1)),
        ("tags", models.ManyToManyField("Tag")),
    ], options={"ordering": ["id"]}),
    migrations.CreateModel(name="X", fields=[("a", models.TextField())], options={"db_table": "xs"}),
]'''
    assert migrated_columns("shop/migrations/0001.py", django) == [(3, "shop_order", "id", "AutoField", None, None), (4, "shop_order", "owner_id", "ForeignKey", None, None), (7, "xs", "a", "TextField", None, None)]
    alembic = '''def upgrade():
    op.create_table("users", sa.Column("id", sa.Integer(), nullable=False, primary_key=True),
        sa.Column("name", sa.String(20)), sa.PrimaryKeyConstraint("id"))
    op.add_column("users", sa.Column("age", sa.Integer, nullable=True))
    other.create_table("no", sa.Column("a", sa.Integer()))
'''
    assert migrated_columns("versions/1.py", alembic) == [(2, "users", "id", "Integer", False, True), (3, "users", "name", "String", None, None), (4, "users", "age", "Integer", True, None)]


def test_literals():
    python = '"""doc string"""\nq = f"select {col} from t where a = {b!r}"\ndef f():\n    "also doc"\n    return "ab", \'xyz\', b"bytes", "é" "joined"\n# "comment"\n'
    assert literals("a.py", python) == [(2, 4, "select {} from t where a = {}"), (5, 17, "xyz"), (5, 34, "éjoined")]
    script = "const a = 'one' + \"two\"; // 'no'\nconst b = `three ${f('four')} end`;\n/* `no` */ const c = /'no'/;\n"
    assert literals("a.js", script) == [(1, 10, "one"), (1, 18, "two"), (2, 10, "three {} end")]


SPEC = """swagger: "2.0"  # version
info:
  description: |
    paths:
      /not-here:
        get: {}
paths:
  /users/{id}:
    parameters:
      - name: id
        get: no
    get:
      operationId: getUser
      summary: 'One user: by id'
      tags: [a, b]
      responses:
        200:
          description: ok
    delete:
      summary: gone # soon
  "/plain":
    POST:
      operationId: make
    x-note: text
"""


def test_endpoints():
    want = [("/users/{id}", "GET", "getUser", "One user: by id"), ("/users/{id}", "DELETE", None, "gone"), ("/plain", "POST", "make", "")]
    assert endpoints("api.yaml", SPEC) == want == endpoints("api.yml", SPEC.replace("\n", "\r\n"))
    assert endpoints("a.json", '{"paths": {"/x": {"get": {"operationId": "o"}, "parameters": [], "put": null}}}') == [("/x", "GET", "o", "")]
    assert endpoints("a.json", "{") == endpoints("a.json", "[]") == endpoints("a.yaml", "- a") == endpoints("a.yaml", None) == []
    assert yaml_mappings("a: 1\nb:\n    c: 'x'\n    d:\ne: [1]\n") == {"a": "1", "b": {"c": "x", "d": {}}, "e": "[1]"}


def test_clients():
    python = '''import requests as rq, httpx
from requests import get
from urllib.request import urlopen
s = rq.Session()
rq.post(f"http://h/{x}/y", json={})
get("http://g")
s.put(url="http://p")
with httpx.Client() as c:
    c.get("http://c")
rq.request("delete", "http://d")
urlopen("http://u", data=b"")
other.get("http://no"); cache.get("k"); rq.get(url)
"""requests.get('http://text')"""
'''
    assert clients("a.py", python) == [(5, "requests", "POST", "http://h/{}/y"), (6, "requests", "GET", "http://g"), (7, "requests", "PUT", "http://p"), (9, "httpx", "GET", "http://c"), (10, "requests", "DELETE", "http://d"), (11, "urllib", "POST", "http://u")]
    script = "fetch('/a');\nfetch(`/b/${id}`, { method: 'POST' });\naxios.put('/c', x); axios('/d');\n// fetch('/no')\nthis.fetch('/no'); fetch(url);\n"
    assert clients("a.ts", script) == [(1, "fetch", "GET", "/a"), (2, "fetch", "POST", "/b/{}"), (3, "axios", "PUT", "/c"), (3, "axios", "GET", "/d")]
    assert clients("a.rb", python) == clients("a.py", "import (") == clients("a.py", None) == []


def test_processes():
    python = "import subprocess as sp, os\nfrom subprocess import check_output\nsp.run(['git', x])\nos.system('ls -l | wc')\ncheck_output(f'{tool} -v'); sp.run(cmd); self.run(['no'])\nsp.Popen(args=('a', 'b'))\n"
    assert processes("a.py", python) == [(3, "git"), (4, "ls"), (5, "{}"), (6, "a")]
    assert processes("a.js", "const { spawn } = require('child_process');\nspawn('node', ['x']); child_process.exec(`make ${t}`);\n/x/.exec('no'); re.exec('no'); // exec('no')\n") == [(2, "make"), (2, "node")]
    assert processes("a.go", 'cmd := exec.Command("tar", "x")\nexec.CommandContext(ctx, "zip")\nc.Command("no")\n') == [(1, "tar"), (2, "zip")]
