"""More typed entities out of source text: data stores, services, commands, infrastructure, front ends.

Every operator takes files (file_id, path, source) and gives (file_id, qname), each once; null sources give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = r"""["'`]([^"'`\n]{1,128})["'`]"""
_VERBS = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS"


def _all(pattern: str, group: int = 1, source: str = "source") -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(group))


def _found(files: DataFrame, names: Column, prefix: str = "") -> DataFrame:
    rows = files.select("file_id", F.explode(F.array_distinct(F.array_compact(names))).alias("n")).where("n <> ''")
    return rows.select("file_id", F.concat(F.lit(prefix), "n").alias("qname")).distinct()


def _named(path: str) -> Column:
    return F.col("path").rlike(path)


def nosql_collections(files: DataFrame) -> DataFrame:
    """Collections of Mongo and Beanie and tables of DynamoDB."""
    patterns = [
        rf"(?:mongoose|models)\.model\(\s*{_TEXT}", rf"(?<![A-Za-z0-9_])TableName\s*[:=]\s*{_TEXT}", rf"dynamodb\.Table\(\s*{_TEXT}",
        rf"[A-Za-z0-9_)\]]\.collection\(\s*{_TEXT}", rf"class Settings:[\s\S]{{0,256}}?\bname\s*=\s*{_TEXT}",
    ]
    return _found(files, F.concat(*map(_all, patterns)), "data_entity:nosql:")


def cypher_labels(files: DataFrame) -> DataFrame:
    """Labels of nodes in Cypher patterns."""
    heads = _all(r"(?i)\b(?:MATCH|MERGE|CREATE)\s+(\([^;\"`]{1,256})")
    labels = F.flatten(F.transform(heads, lambda h: F.regexp_extract_all(h, F.lit(r"\([A-Za-z0-9_]*:([A-Za-z_]\w*)"), F.lit(1))))
    return _found(files, labels, "data_entity:cypher:")


def grpc_services(files: DataFrame) -> DataFrame:
    """Services that proto files define or servers register."""
    names = F.when(_named(r"\.proto$"), _all(r"(?m)^\s*service\s+([A-Za-z_]\w*)\s*\{")).otherwise(
        F.concat(_all(r"\bRegister([A-Z]\w*?)Server\("), _all(r"\badd_([A-Z]\w*?)Servicer_to_server\("), _all(r"@GrpcMethod\(\s*[\"']([^\"']+)[\"']"))
    )
    return _found(files, names, "grpc:service:")


def grpc_clients(files: DataFrame) -> DataFrame:
    """Services that clients and stubs are made for."""
    names = F.concat(_all(r"\bNew([A-Z]\w*?)Client\("), _all(r"\b([A-Z]\w*?)Stub\("), _all(r"\bnew\s+([A-Z]\w*?)(?:Service)?Client\("))
    return _found(files.where(F.col("source").rlike(r"(?i)grpc")), names, "grpc:client:")


def graphql_operations(files: DataFrame) -> DataFrame:
    """Named operations of documents in code and of ``.graphql`` files."""
    rows = files.where(_named(r"\.(graphql|gql)$") | F.col("source").rlike(r"\bgql\b|\bgraphql\b"))
    return _found(rows, _all(r"\b(?:query|mutation|subscription)\s+([A-Za-z_]\w*)\s*[({]"), "graphql:operation:")


def graphql_resolvers(files: DataFrame) -> DataFrame:
    """Methods behind resolver decorators, and fields of root types in schemas."""
    decorated = _all(r"@(?:Query|Mutation|Subscription|ResolveField)\([^\n]*\)\s*\n\s*(?:public\s+|async\s+)*([A-Za-z_]\w*)\s*\(")
    bodies = _all(r"\btype\s+(?:Query|Mutation|Subscription)\s*\{([^}]*)\}")
    fields = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^\s*([A-Za-z_]\w*)\s*[(:]"), F.lit(1))))
    return _found(files, F.concat(decorated, fields), "graphql:resolver:")


def websocket_ends(files: DataFrame) -> DataFrame:
    """Handlers and clients of web sockets: what they are called by, or where they connect to."""
    on = F.when(F.col("source").rlike(r"\b(?:io|wss?|WebSocketServer|WebSocketGateway)\b"), _all(rf"\.on\(\s*{_TEXT}")).otherwise(F.array().cast("array<string>"))
    handlers = F.concat(on, _all(rf"@SubscribeMessage\(\s*{_TEXT}"), _all(rf"\.websocket\(\s*{_TEXT}"))
    made = _all(rf"new\s+WebSocket\(\s*{_TEXT}")
    place = F.transform(made, lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"^wss?://[^/]+(/.*)$", 1), F.lit("")), u))
    tag = lambda kind, names: F.transform(names, lambda x: F.concat(F.lit(kind), x))
    return _found(files, F.concat(tag("ws:handler:", handlers), tag("ws:client:", place)))


def cli_commands(files: DataFrame) -> DataFrame:
    """Commands that command-line frameworks are told of, and entry points of manifests."""
    code = F.concat(_all(rf"@(?:\w+\.)?command\(\s*(?:name\s*=\s*)?{_TEXT}"), _all(r"""\.command\(\s*["'`]([A-Za-z][\w:-]*)"""), _all(r"""\bUse:\s*["`]([A-Za-z][\w-]*)"""), _all(rf"add_parser\(\s*{_TEXT}"))
    scripts = _all(r"(?ms)^\[(?:project|tool\.poetry)\.scripts\]\s*?\n(.*?)(?=^\[|\z)")
    entries = F.flatten(F.transform(scripts, lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^([A-Za-z][\w-]*)\s*="), F.lit(1))))
    return _found(files, F.when(_named(r"(^|/)pyproject\.toml$"), entries).otherwise(code), "cli:command:")


def cli_invocations(files: DataFrame) -> DataFrame:
    """Programs that code starts."""
    calls = r"(?:subprocess\.(?:run|call|check_call|check_output|Popen)|execa|spawn(?:Sync)?|execFile(?:Sync)?|exec\.Command|Command::new)"
    return _found(files, F.transform(_all(rf"""\b{calls}\(\s*\[?\s*["'`]([^"'`\s]+)"""), lambda x: F.regexp_extract(x, r"([^/]*)$", 1)), "cli:invocation:")


def docker_env(files: DataFrame) -> DataFrame:
    """Variables that Dockerfiles set."""
    lines = F.transform(_all(r"(?im)^[ \t]*ENV[ \t]+([^#\n]+)"), F.trim)
    keys = F.flatten(F.transform(lines, lambda x: F.when(x.contains("="), F.regexp_extract_all(x, F.lit(r"""(?:^|\s)([A-Za-z_]\w*)=(?:"[^"]*"|'[^']*'|\S*)"""), F.lit(1))).otherwise(F.regexp_extract_all(x, F.lit(r"^([A-Za-z_]\w*)"), F.lit(1)))))
    return _found(files.where(_named(r"(^|/)Dockerfile[^/]*$")), keys, "config:env:")


def _block(head: str) -> Column:
    """The lines below a YAML key that are deeper than it, or list items at its depth."""
    return _all(rf"(?m)^([ \t]*){head}:[ \t]*\n((?:\1[ \t]+\S[^\n]*\n?|\1-[^\n]*\n?|[ \t]*\n)*)", 2)


def compose_env(files: DataFrame) -> DataFrame:
    """Variables of ``environment`` blocks in compose files."""
    keys = F.flatten(F.transform(_block("environment"), lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^[ \t]*(?:-[ \t]*)?[\"']?([A-Za-z_]\w*)[\"']?[ \t]*[=:]"), F.lit(1))))
    return _found(files.where(_named(r"(^|/)(docker-)?compose[^/]*\.ya?ml$")), keys, "config:env:")


def kubernetes_env(files: DataFrame) -> DataFrame:
    """Names in ``env`` blocks of manifests."""
    keys = F.flatten(F.transform(_block("env"), lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^[ \t]*-?[ \t]*name:[ \t]*[\"']?([A-Za-z_]\w*)"), F.lit(1))))
    return _found(files.where(_named(r"\.ya?ml$") & F.col("source").contains("apiVersion:")), keys, "config:env:")


# Kinds of Kubernetes resources that count.
KUBERNETES = "Deployment StatefulSet DaemonSet Service Ingress ConfigMap Secret CronJob Job Pod".split()


def kubernetes_resources(files: DataFrame) -> DataFrame:
    """Resources of manifests by kind and name, and the images that they run."""
    docs = F.split("source", r"\n---")
    one = lambda d, p: F.regexp_extract(d, p, 1)
    kind = lambda d: one(d, r"(?m)^kind:[ \t]*(\w+)")
    name = lambda d: one(d, r"(?m)^metadata:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+name:[ \t]*[\"']?([\w.-]+)")
    image = lambda i: F.concat(F.lit("infra:image:"), F.regexp_extract(F.regexp_replace(i, r"[:@][^/]*$", ""), r"([^/]*)$", 1))
    found = F.flatten(F.transform(docs, lambda d: F.when(kind(d).isin(*KUBERNETES) & (name(d) != ""), F.concat(
        F.array(F.concat(F.lit("infra:k8s:"), F.lower(kind(d)), F.lit(":"), name(d))), F.transform(F.regexp_extract_all(d, F.lit(r"(?m)^[ \t-]*image:[ \t]*[\"']?([^\s\"'$]+)"), F.lit(1)), image)
    )).otherwise(F.array().cast("array<string>"))))
    return _found(files.where(_named(r"\.ya?ml$")), found)


def compose_services(files: DataFrame) -> DataFrame:
    """Services of compose files and their images."""
    block = F.regexp_extract("source", r"(?m)^services:[ \t]*\n((?:[ \t]+[^\n]*\n?|[ \t]*\n)*)", 1)
    indent = F.regexp_extract(block, r"^([ \t]+)[A-Za-z_]", 1)
    names = F.transform(F.filter(F.split(block, "\n"), lambda x: F.regexp_like(x, F.concat(F.lit("^"), indent, F.lit(r"[A-Za-z_][\w.-]*:\s*$")))), lambda x: F.concat(F.lit("infra:compose:"), F.regexp_extract(x, r"([\w.-]+):", 1)))
    images = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+image:[ \t]*[\"']?([^\s\"'$]+)"), F.lit(1)), lambda i: F.concat(F.lit("infra:image:"), F.regexp_extract(F.regexp_replace(i, r"[:@][^/]*$", ""), r"([^/]*)$", 1)))
    return _found(files.where(_named(r"(^|/)(docker-)?compose[^/]*\.ya?ml$")), F.concat(names, images))


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    """Packages that pyproject files depend on, of the project table and of poetry's."""
    lists = F.concat(_all(r"(?ms)^dependencies\s*=\s*\[(.*?)\]"), _all(r"(?ms)^optional-dependencies\s*=\s*\{(.*?)\}"))
    listed = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"""["']([A-Za-z0-9][A-Za-z0-9._-]*)"""), F.lit(1))))
    tables = _all(r"(?ms)^\[tool\.poetry\.(?:dependencies|dev-dependencies|group\.\w+\.dependencies)\]\s*?\n(.*?)(?=^\[|\z)")
    keys = F.flatten(F.transform(tables, lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^([A-Za-z0-9][A-Za-z0-9._-]*)\s*="), F.lit(1))))
    names = F.transform(F.filter(F.concat(listed, keys), lambda x: x != "python"), F.lower)
    return _found(files.where(_named(r"(^|/)pyproject\.toml$")), names, "package:pypi:")


def celery_beat(files: DataFrame) -> DataFrame:
    """Tasks of beat schedules with their schedule expressions."""
    pairs = r"""["']task["']\s*:\s*["']([^"'\n]+)["'][^}]{0,256}?["']schedule["']\s*:\s*([^\n,}]+(?:\([^)\n]*\))?)"""
    both = F.arrays_zip(_all(pairs, 1).alias("task"), _all(pairs, 2).alias("every"))
    return _found(files, F.transform(both, lambda p: F.concat(F.lit("cron:celery:"), p.task, F.lit("@"), F.trim(p.every))))


def file_routes(files: DataFrame) -> DataFrame:
    """Routes that frameworks take from where a file lies: Next.js and SvelteKit, with the verbs that it exports."""
    path = F.regexp_replace("path", r"\.(?:js|jsx|ts|tsx)$", "")
    pages = F.regexp_extract(path, r"(?:^|/)(pages/api/.*)$", 1)
    app = F.regexp_extract(path, r"(?:^|/)(app/api/.*)/route$", 1)
    kit = F.regexp_extract(path, r"(?:^|/)routes/(.*?)/?\+server$", 1)
    bare = F.when(pages != "", F.regexp_replace(F.substring(pages, 7, 1 << 20), "/index$", "")).when(app != "", F.substring(app, 5, 1 << 20)).when(path.rlike(r"(^|/)routes/(.*/)?\+server$"), kit)
    route = F.concat(F.lit("/"), F.regexp_replace(bare, r"\[(?:\.\.\.)?([^\]]+)\]", ":$1"))
    verbs = _all(rf"export\s+(?:async\s+)?(?:function|const)\s+({_VERBS})\b")
    every = F.when(F.size(verbs) > 0, verbs).when(F.col("source").rlike(r"export\s+default"), F.array(F.lit("GET"))).otherwise(F.array().cast("array<string>"))
    rows = files.withColumn("route", route).where("route is not null")
    return _found(rows, F.transform(every, lambda v: F.concat(v, F.lit(" "), F.col("route"))))


def nest_routes(files: DataFrame) -> DataFrame:
    """Routes of NestJS controllers: the controller's prefix before each verb's path."""
    parts = F.filter(F.split("source", r"(?=@Controller\()"), lambda c: c.startswith("@Controller("))
    head = r"""(?m)^\s*@(?:Get|Post|Put|Patch|Delete|Head|Options|All)\([^)\n]*"""
    prefix = lambda c: F.regexp_extract(c, r"""^@Controller\(\s*["'`]([^"'`\n]*)""", 1)
    path = lambda h: F.regexp_extract(h, r"""\(\s*["'`]([^"'`\n]*)""", 1)
    whole = lambda c, h: F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), prefix(c), F.lit("/"), path(h)), "/+", "/"), "(.)/$", "$1")
    named = lambda c, h: F.concat(F.upper(F.regexp_extract(h, r"@(\w+)", 1)), F.lit(" "), whole(c, h))
    one = lambda c: F.transform(F.regexp_extract_all(c, F.lit(head), F.lit(0)), lambda h: named(c, h))
    return _found(files, F.flatten(F.transform(parts, one)))


def react_entities(files: DataFrame) -> DataFrame:
    """Components, hooks and routes of React sources."""
    jsx = F.col("source").rlike("</|/>")
    components = F.concat(_all(r"\bfunction\s+([A-Z]\w*)\s*[(<]"), _all(r"\bconst\s+([A-Z]\w*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|\w+)\s*=>"))
    hooks = F.concat(_all(r"\bfunction\s+(use[A-Z]\w*)\s*[(<]"), _all(r"\bconst\s+(use[A-Z]\w*)\s*="))
    routes = F.filter(_all(rf"<Route\b[^>]*?\bpath=\{{?\s*{_TEXT}"), lambda x: x.startswith("/"))
    tag = lambda kind, names: F.transform(names, lambda x: F.concat(F.lit(kind), x))
    none = F.array().cast("array<string>")
    return _found(files.where(_named(r"\.[jt]sx?$")), F.concat(F.when(jsx, tag("component:", components)).otherwise(none), tag("hook:", hooks), tag("GET ", routes)))


def angular_entities(files: DataFrame) -> DataFrame:
    """Classes behind Angular's decorators, guards, and paths of its routes."""
    pairs = r"@(Component|Directive|Pipe|Injectable)\((?:[^()]|\([^()]*\))*\)\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"
    made = F.zip_with(_all(pairs, 1), _all(pairs, 2), lambda k, n: F.concat(F.when(n.endswith("Guard"), "guard").when(k == "Injectable", "service").otherwise(F.lower(k)), F.lit(":"), n))
    paths = F.transform(_all(rf"\bpath:\s*{_TEXT}"), lambda p: F.concat(F.lit("GET /"), F.regexp_replace(p, "^/", "")))
    return _found(files.where(_named(r"\.ts$") & F.col("source").contains("@angular")), F.concat(made, paths))


def vue_entities(files: DataFrame) -> DataFrame:
    """Components of Vue files by file name, composables and router paths."""
    name = F.regexp_extract("path", r"([^/]+)\.vue$", 1)
    component = F.when(name != "", F.array(F.concat(F.lit("component:"), name))).otherwise(F.array().cast("array<string>"))
    composables = F.transform(F.concat(_all(r"export\s+(?:default\s+)?function\s+(use[A-Z]\w*)"), _all(r"export\s+const\s+(use[A-Z]\w*)\s*=")), lambda x: F.concat(F.lit("composable:"), x))
    paths = F.transform(F.filter(_all(rf"\bpath:\s*{_TEXT}"), lambda x: x.startswith("/")), lambda p: F.concat(F.lit("GET "), p))
    return _found(files.where(_named(r"\.vue$") | F.col("source").rlike(r"from\s+[\"']vue(?:-router)?[\"']")), F.concat(component, composables, paths))


def test_assertions(files: DataFrame) -> DataFrame:
    """What test sources assert: (file_id, subject, relation, expected) of assert statements and calls."""
    patterns = [
        (r"(?m)^\s*assert\s+([^=!<>\n]+?)\s*(==|!=|<=|>=|<|>| in | is )\s*([^\n,]+)", None), (r"assertEquals?\(\s*([^,\n]+),\s*([^,\n)]+)\)", "=="), (r"assertNotEquals?\(\s*([^,\n]+),\s*([^,\n)]+)\)", "!="),
        (r"expect\(([^()\n]*(?:\([^()\n]*\))?[^()\n]*)\)\.to(?:Be|Equal|StrictEqual)\(([^\n;]*?)\)", "=="), (r"expect\(([^()\n]*(?:\([^()\n]*\))?[^()\n]*)\)\.toContain\(([^\n;]*?)\)", "in"), (r"assert_eq!\(\s*([^,\n]+),\s*([^,\n)]+)\)", "=="),
    ]
    parts = []
    for p, fixed in patterns:
        subject, expected = _all(p, 1), _all(p, 3 if fixed is None else 2)
        relation = F.transform(_all(p, 2), F.trim) if fixed is None else F.array_repeat(F.lit(fixed), F.size(subject))
        parts.append(F.arrays_zip(subject.alias("subject"), relation.alias("relation"), expected.alias("expected")))
    rows = files.select("file_id", F.explode(F.concat(*parts)).alias("a"))
    return rows.select("file_id", F.trim("a.subject").alias("subject"), "a.relation", F.trim("a.expected").alias("expected")).distinct()
