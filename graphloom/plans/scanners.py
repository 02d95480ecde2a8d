"""Queries of the scanners over a small fixture of files, as the tables hold hardly any of what they look for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import entities, extract
from graphloom.plans.registry import Registry

QUERIES = Registry()
FILES = [
    (1, "db/models.js", "const U = mongoose.model('User', s);\nconst o = db.collection('orders');\nconst p = { TableName: 'Items' };\nconst q = { MyTableName: 'No' };\n"),
    (2, "db/graph.py", 'q = "MATCH (u:User)-[:KNOWS]->(p:Person) RETURN u"\nr = "MERGE (c:City {name: $n})"\n'),
    (3, "api/users.proto", 'syntax = "proto3";\nservice Users {\n  rpc Get (Id) returns (User);\n}\n service Audit {\n}\n'),
    (4, "cmd/main.go", 'import "google.golang.org/grpc"\nfunc main() {\n c := pb.NewUsersClient(conn)\n pb.RegisterOrdersServer(s, h)\n exec.Command("/usr/bin/git", "status")\n}\nvar root = &cobra.Command{Use: "ship [x]"}\n'),
    (5, "web/api.ts", "const Q = gql`query GetUser($id: ID) { user }`;\nconst M = gql`mutation Save { save }`;\nconst ws = new WebSocket('wss://h.io/live/feed');\n"),
    (6, "srv/users.resolver.ts", "@Resolver()\nclass R {\n  @Query(() => User)\n  async user(@Args('id') id) { return 1; }\n}\nconst t = `type Query {\n  users(first: Int): [User]\n  me: User\n}`;\n"),
    (7, "srv/chat.ts", "@WebSocketGateway()\nclass G {\n  @SubscribeMessage('chat')\n  on() {}\n}\nio.on('connection', (s) => {});\n"),
    (8, "cli/main.py", "@click.command('deploy')\ndef d(): pass\nsub.add_parser('build')\nsubprocess.run(['docker', 'ps'])\n"),
    (9, "Dockerfile", "FROM registry.io/lib/python:3.12\nENV A=1 B=\"x y\"\nENV LONE value # C=3\n"),
    (10, "docker-compose.yml", "services:\n  web:\n    image: nginx:1.2\n    environment:\n      - MODE=dev\n      - TOKEN\n  db:\n    image: docker.io/library/postgres@sha256:aa\n    environment:\n      PGUSER: x\nvolumes:\n  data:\n"),
    (11, "k8s/app.yaml", "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  labels:\n    a: b\n  name: shop\nspec:\n  containers:\n  - image: repo/shop:2\n    env:\n    - name: DB_URL\n      value: x\n    - name: KEY\n---\nkind: Unknown\nmetadata:\n  name: no\n"),
    (12, "pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "Requests>=2",\n  "rich",\n]\n[project.scripts]\nship-it = "x:main"\n[tool.poetry.dependencies]\npython = "^3"\nflask = "*"\n'),
    (13, "jobs/beat.py", "app.conf.beat_schedule = {'a': {'task': 'jobs.clean', 'schedule': crontab(hour=3)}, 'b': {'task': 'jobs.ping', 'schedule': 30.0}}\n"),
    (14, "pages/api/users/[id].ts", "export default function handler(req, res) {}\n"), (15, "app/api/orders/[...rest]/route.ts", "export async function GET() {}\nexport const POST = 1;\n"), (16, "src/routes/shop/+server.ts", "export function DELETE() {}\n"),
    (17, "srv/cats.controller.ts", "@Controller('cats')\nexport class C {\n  @Get()\n  all() {}\n  @Post('/:id/feed')\n  feed() {}\n}\n@Controller()\nclass D {\n  @Delete('x')\n  x() {}\n}\n"),
    (18, "ui/App.tsx", "export function App() { return <Route path=\"/home\" />; }\nconst Card = (p) => <b/>;\nfunction useCart() {}\nconst low = () => 1;\n"),
    (19, "ui/app.component.ts", "import { Component } from '@angular/core';\n@Component({ selector: 'a', host: f(1) })\nexport class AppComponent {}\n@Injectable()\nexport class AuthGuard {}\nconst routes = [{ path: 'admin', component: X }];\n"),
    (20, "ui/Cart.vue", "<template/>\n"), (21, "ui/router.js", "import { createRouter } from 'vue-router';\nexport function useNav() {}\nconst r = [{ path: '/cart' }, { path: 'rel' }];\n"),
    (22, "t/test_a.py", "def test_a():\n    assert f(1) == 2\n    self.assertEqual(g(), 3)\n"), (23, "t/a.test.js", "test('a', () => { expect(add(1, 2)).toBe(3); expect(xs).toContain('y'); });\n"),
    (24, "q/tasks.py", "from celery import shared_task\n@shared_task\ndef run(): pass\nrun.delay(1)\nos.environ['REGION']\n"), (25, "q/kafka.js", "const { Kafka } = require('kafkajs');\nproducer.send({});\nconsumer.subscribe({});\nprocess.env.BROKER;\nbus.on('paid', f);\n"),
    (26, "package.json", '{"name": "x", "dependencies": {"left-pad": "1"}, "devDependencies": {"jest": "2"}}'), (27, "app/server.js", "app.get('/users/:id', h);\nrouter.post(`/login`, h);\n"), (28, ".env", "# c\nexport A=1\nB = 2\n"),
    (29, ".github/workflows/ci.yml", "on:\n  schedule:\n    - cron: '0 3 * * *'\n"), (30, "empty.py", ""), (31, "null.py", None), (32, "db/pg.py", "import psycopg\nc.execute('SELECT a FROM Orders JOIN users')\n"),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "file_id bigint, path string, source string")


def expected(rows: list[tuple], columns: str = "file_id, qname") -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({columns})"


def add(name: str, run: Callable[[DataFrame], DataFrame], rows: list[tuple], columns: str = "file_id, qname") -> None:
    names = columns.split(", ")

    @QUERIES.add(name, expected(rows, columns))
    def query(spark: SparkSession, root: str) -> DataFrame:
        return run(files(spark)).select(*names)


E = entities
add("scan_nosql", E.nosql_collections, [(1, "data_entity:nosql:User"), (1, "data_entity:nosql:orders"), (1, "data_entity:nosql:Items")])
add("scan_cypher", E.cypher_labels, [(2, "data_entity:cypher:User"), (2, "data_entity:cypher:Person"), (2, "data_entity:cypher:City")])
add("scan_grpc_services", E.grpc_services, [(3, "grpc:service:Users"), (3, "grpc:service:Audit"), (4, "grpc:service:Orders")])
add("scan_grpc_clients", E.grpc_clients, [(4, "grpc:client:Users")])
add("scan_graphql_operations", E.graphql_operations, [(5, "graphql:operation:GetUser"), (5, "graphql:operation:Save")])
add("scan_graphql_resolvers", E.graphql_resolvers, [(6, "graphql:resolver:user"), (6, "graphql:resolver:users"), (6, "graphql:resolver:me")])
add("scan_websockets", E.websocket_ends, [(5, "ws:client:/live/feed"), (7, "ws:handler:chat"), (7, "ws:handler:connection")])
add("scan_cli_commands", E.cli_commands, [(4, "cli:command:ship"), (8, "cli:command:deploy"), (8, "cli:command:build"), (12, "cli:command:ship-it")])
add("scan_cli_invocations", E.cli_invocations, [(4, "cli:invocation:git"), (8, "cli:invocation:docker")])
add("scan_docker_env", E.docker_env, [(9, "config:env:A"), (9, "config:env:B"), (9, "config:env:LONE")])
add("scan_compose_env", E.compose_env, [(10, "config:env:MODE"), (10, "config:env:PGUSER")])
add("scan_kubernetes_env", E.kubernetes_env, [(11, "config:env:DB_URL"), (11, "config:env:KEY")])
add("scan_kubernetes", E.kubernetes_resources, [(11, "infra:k8s:deployment:shop"), (11, "infra:image:shop")])
add("scan_compose", E.compose_services, [(10, "infra:compose:web"), (10, "infra:compose:db"), (10, "infra:image:nginx"), (10, "infra:image:postgres")])
add("scan_pyproject", E.pyproject_dependencies, [(12, "package:pypi:requests"), (12, "package:pypi:rich"), (12, "package:pypi:flask")])
add("scan_celery_beat", E.celery_beat, [(13, "cron:celery:jobs.clean@crontab(hour=3)"), (13, "cron:celery:jobs.ping@30.0")])
add("scan_file_routes", E.file_routes, [(14, "GET /api/users/:id"), (15, "GET /api/orders/:rest"), (15, "POST /api/orders/:rest"), (16, "DELETE /shop")])
add("scan_nest_routes", E.nest_routes, [(17, "GET /cats"), (17, "POST /cats/:id/feed"), (17, "DELETE /x")])
add("scan_react", E.react_entities, [(18, "component:App"), (18, "component:Card"), (18, "hook:useCart"), (18, "GET /home"), (21, "hook:useNav")])
add("scan_angular", E.angular_entities, [(19, "component:AppComponent"), (19, "guard:AuthGuard"), (19, "GET /admin")])
add("scan_vue", E.vue_entities, [(20, "component:Cart"), (21, "composable:useNav"), (21, "GET /cart")])
add(
    "scan_assertions", E.test_assertions, [(22, "f(1)", "==", "2"), (22, "g()", "==", "3"), (23, "add(1, 2)", "==", "3"), (23, "xs", "in", "'y'")], "file_id, subject, relation, expected"
)
add("scan_queue_consumers", lambda f: extract.needles(f, extract.QUEUE_CONSUMERS, "queue:"), [(24, "queue:celery"), (25, "queue:kafka")])
add("scan_queue_producers", lambda f: extract.needles(f, extract.QUEUE_PRODUCERS, "queue:"), [(24, "queue:celery"), (25, "queue:kafka")])
add("scan_data_sources", lambda f: extract.needles(f, extract.DATA_SOURCES, "data:"), [(32, "data:postgres"), (1, "data:mongodb")])
add("scan_env_reads", extract.env_reads, [(24, "config:env:REGION"), (25, "config:env:BROKER")])
add("scan_dotenv", extract.dotenv_keys, [(28, "config:env:A"), (28, "config:env:B")])
add("scan_docker_bases", extract.dockerfile_bases, [(9, "infra:image:python")])
add("scan_dependencies", extract.dependencies, [(26, "package:npm:left-pad"), (26, "package:npm:jest")])
add("scan_routes", extract.routes, [(27, "GET", "/users/:id"), (27, "POST", "/login"), (17, "POST", "/:id/feed"), (17, "DELETE", "/x")], "file_id, method, path")
add("scan_cron", extract.cron_schedules, [(29, "cron:0 3 * * *")])
add("scan_sql_tables", extract.sql_tables, [(32, "data_entity:sql:orders"), (32, "data_entity:sql:users")])
add("scan_events", lambda f: extract.calls_with_literal(f, extract.EVENT_HANDLERS, "event:"), [(25, "event:paid"), (7, "event:connection"), (25, "event:.subscribe(")])
