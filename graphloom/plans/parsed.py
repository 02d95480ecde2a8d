"""Queries of the front ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.parsers import go, python, typescript
from graphloom.plans.registry import Registry
from graphloom.plans.scanners import expected
from graphloom.sources import table

QUERIES = Registry()
SOURCES = [
    (1, "myapp/__init__.py", ""),
    (1, "myapp/helpers.py", "def hash_password(p):\n    return _inner(p)\n\n\ndef _inner(p):\n    return p[::-1]\n"),
    (1, "myapp/users.py", "from .helpers import hash_password\n\n\nclass Base:\n    def check(self):\n        pass\n\n\nclass User(Base):\n    def login(self, p):\n        return hash_password(p)\n\n    def save(self):\n        self.login('x')\n        super().check()\n"),
    (1, "myapp/auth.py", "import os\nfrom . import helpers\nfrom .users import User as U\n\n\ndef do_login(name):\n    u = U(name)\n    u.login('x')\n    return helpers.hash_password(name)\n"),
    (1, "myapp/broken.py", "def f(:\n"), (1, "myapp/none.py", None), (2, "myapp/users.py", "import myapp.helpers\n"), (1, "x.go", "package x"),
]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*SOURCES, SOURCES[2]], "repo_id bigint, path string, source string")


@QUERIES.add(
    "python_graph",
    expected(
        [
            (3, "myapp::users", "myapp::helpers"), (3, "myapp::auth", "myapp::helpers"), (3, "myapp::auth", "myapp::users"),
            (4, "myapp::helpers::hash_password", "myapp::helpers::_inner"), (4, "myapp::users::User::login", "myapp::helpers::hash_password"), (4, "myapp::users::User::save", "myapp::users::User::login"),
            (4, "myapp::auth::do_login", "myapp::users::User"), (4, "myapp::auth::do_login", "myapp::helpers::hash_password"), (20, "myapp::users::User", "myapp::users::Base"),
        ],
        "category, src, dst",
    ),
)
def python_graph(spark: SparkSession, root: str) -> DataFrame:
    """The edges of a small package by qualified name: imports, calls and bases."""
    nodes, edges, _ = python.graph(sources(spark))
    a, b = nodes.select(F.col("id").alias("src"), F.col("qname").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("qname").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("category", F.col("a").alias("src"), F.col("b").alias("dst"))


@QUERIES.add(
    "python_nodes",
    expected(
        [
            (1, 1, "myapp", 0), (1, 1, "myapp::helpers", 0), (3, 1, "myapp::helpers::hash_password", 0), (3, 1, "myapp::helpers::_inner", 4), (1, 1, "myapp::users", 0), (2, 1, "myapp::users::Base", 3), (4, 1, "myapp::users::Base::check", 4),
            (2, 1, "myapp::users::User", 8), (4, 1, "myapp::users::User::login", 9), (4, 1, "myapp::users::User::save", 12), (1, 1, "myapp::auth", 0), (3, 1, "myapp::auth::do_login", 5), (1, 2, "myapp::users", 0),
        ],
        "kind, repo_id, qname, start_line",
    ),
)
def python_nodes(spark: SparkSession, root: str) -> DataFrame:
    return python.graph(sources(spark))[0].select("kind", "repo_id", "qname", "start_line")


@QUERIES.add("python_sources")
def python_sources(spark: SparkSession, root: str) -> DataFrame:
    """Nodes and call sites of all Python files of the table by repository and kind."""
    repos = table(spark, root, "repos").select("repo_id", "repo")
    files = table(spark, root, "files").select("file_id", "repo", "path", "source").where("path like '%.py'").join(repos, "repo")
    found = python.parse(files.select("repo_id", "path", "source"))
    once = found.select("repo_id", "file", "ord", "item", "kind", "category").distinct()
    return once.groupBy("repo_id", "item", "kind", "category").agg(F.count("*").alias("items"))


GO = [
    (1, "go.mod", "module example.com/shop\n\ngo 1.22\n"),
    (1, "helpers/helpers.go", "package helpers\n\n// HashPassword( hides.\nfunc HashPassword(p string) string {\n\treturn inner(p) + \"no(\"\n}\n"),
    (1, "helpers/extra.go", "package helpers\n\nfunc inner(p string) string { return p }\n"),
    (1, "users/users.go", "package users\n\nimport \"fmt\"\n\ntype User struct {\n\tName string\n}\n\nfunc (u *User) Login(p string) error { return nil }\n\nfunc (u *User) Save(f func() error) (err error) {\n\tfmt.Println(u.Name)\n\tu.repo.Put(u)\n\treturn u.Login(\"x\")\n}\n"),
    (1, "auth/auth.go", "package auth\n\nimport (\n\th \"example.com/shop/helpers\"\n\t\"example.com/shop/users\"\n)\n\nfunc DoLogin(n string) interface{} {\n\tvar u users.User\n\tif (n == \"\") { u.Login(n) }\n\treturn h.HashPassword(n)\n}\n"),
    (1, "bad.go", "no package"), (1, "null.go", None),
]


@QUERIES.add(
    "go_graph",
    expected(
        [
            (3, "auth", "helpers"), (3, "auth", "users"), (4, "helpers::HashPassword", "helpers::inner"), (4, "users::User::Save", "users::User::Login"), (4, "auth::DoLogin", "helpers::HashPassword"),
        ],
        "category, src, dst",
    ),
)
def go_graph(spark: SparkSession, root: str) -> DataFrame:
    """The edges of a small Go module, one of whose packages has two files."""
    nodes, edges, _ = go.graph(spark.createDataFrame([*GO, GO[1]], "repo_id bigint, path string, source string"))
    a, b = nodes.select(F.col("id").alias("src"), F.col("qname").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("qname").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("category", F.col("a").alias("src"), F.col("b").alias("dst"))


TYPESCRIPT = [
    (1, "src/helpers.ts", "export function hashPassword(p: string): string {\n  // inner2(p)\n  return inner(p);\n}\n\nfunction inner(p: string): string {\n  return p;\n}\n"),
    (1, "src/user.ts", "import { hashPassword as hash } from './helpers';\n\nexport class Base {\n  check(): void {}\n}\n\nexport class User extends Base {\n  login(p: string): string {\n    return hash(p);\n  }\n\n  async save(): Promise<void> {\n    if (this.ok) {\n      await this.login('x(');\n    }\n    super.check();\n  }\n}\n"),
    (1, "src/auth.ts", "import * as helpers from './helpers';\nimport { User } from './user';\nimport fs from 'fs';\n\nexport const doLogin = (n: string) => {\n  const u = new User();\n  u.login(n);\n  return helpers.hashPassword(n);\n};\n"),
    (1, "src/none.ts", None), (1, "src/empty.js", ""),
]


@QUERIES.add(
    "typescript_graph",
    expected(
        [
            (3, "src::user", "src::helpers"), (3, "src::auth", "src::helpers"), (3, "src::auth", "src::user"), (4, "src::helpers::hashPassword", "src::helpers::inner"), (4, "src::user::User::login", "src::helpers::hashPassword"),
            (4, "src::user::User::save", "src::user::User::login"), (4, "src::auth::doLogin", "src::user::User"), (4, "src::auth::doLogin", "src::helpers::hashPassword"), (20, "src::user::User", "src::user::Base"),
        ],
        "category, src, dst",
    ),
)
def typescript_graph(spark: SparkSession, root: str) -> DataFrame:
    """The edges of a few TypeScript modules."""
    nodes, edges, _ = typescript.graph(spark.createDataFrame([*TYPESCRIPT, TYPESCRIPT[0]], "repo_id bigint, path string, source string"))
    a, b = nodes.select(F.col("id").alias("src"), F.col("qname").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("qname").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("category", F.col("a").alias("src"), F.col("b").alias("dst"))
