"""Typed entities out of source text: tables of needles and patterns, applied as expressions in one pass over the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Needles with the entity they show, and words of which one must be in the same file (none: any file).
QUEUE_CONSUMERS = [
    ("@celery.task", "celery", ""), ("@shared_task", "celery", ""), ("@dramatiq.actor", "dramatiq", ""),
    ("new Worker(", "bullmq", "bullmq @nestjs/bullmq"), ("BullModule", "bullmq", ""), ("include Sidekiq::Worker", "sidekiq", ""),
    ("include Sidekiq::Job", "sidekiq", ""), ("use Oban.Worker", "oban", ""), ("use Oban.Pro.Worker", "oban", ""),
    ("nc.subscribe", "nats", "nats NATS"), ("channel.consume", "rabbitmq", "amqp amqplib rabbitmq"), ("KafkaConsumer", "kafka", ""),
    ("consumer.subscribe", "kafka", "kafka kafkajs confluent"), (".blpop(", "redislist", "redis Redis ioredis"),
    (".brpop(", "redislist", "redis Redis ioredis"), (".lpop(", "redislist", "redis Redis ioredis"), (".rpop(", "redislist", "redis Redis ioredis"),
    ("ListLeftPop(", "redislist", "StackExchange.Redis"), ("ListLeftPopAsync(", "redislist", "StackExchange.Redis"),
    ("ListRightPop(", "redislist", "StackExchange.Redis"), ("ListRightPopAsync(", "redislist", "StackExchange.Redis"),
]
QUEUE_PRODUCERS = [
    (".delay(", "celery", "celery @celery @shared_task"), (".apply_async(", "celery", ""), (".send(", "dramatiq", "dramatiq"),
    ("queue.add(", "bullmq", "bullmq @nestjs/bullmq"), ("new Queue(", "bullmq", "bullmq @nestjs/bullmq"), ("perform_async", "sidekiq", ""),
    ("perform_in", "sidekiq", ""), ("Oban.insert", "oban", ""), ("nc.publish", "nats", "nats NATS"),
    ("channel.publish", "rabbitmq", "amqp amqplib rabbitmq"), ("channel.basic_publish", "rabbitmq", ""),
    ("producer.send", "kafka", "kafka kafkajs confluent"), ("producer.produce", "kafka", "kafka confluent"),
    (".lpush(", "redislist", "redis Redis ioredis"), (".rpush(", "redislist", "redis Redis ioredis"),
    ("ListLeftPush(", "redislist", "StackExchange.Redis"), ("ListLeftPushAsync(", "redislist", "StackExchange.Redis"),
    ("ListRightPush(", "redislist", "StackExchange.Redis"), ("ListRightPushAsync(", "redislist", "StackExchange.Redis"),
]
DATA_SOURCES = [
    ("pg.", "postgres", ""), ("psycopg", "postgres", ""), ("mysql.", "mysql", ""), ("sqlite", "sqlite", ""), ("MongoClient", "mongodb", ""),
    ("mongoose.", "mongodb", ""), ("Prisma", "prisma", ""), ("TypeORM", "typeorm", ""), ("Sequelize", "sequelize", ""),
    ("sqlalchemy", "sqlalchemy", ""), ("diesel::", "diesel", ""), ("sqlx::", "sqlx", ""), ("ActiveRecord", "activerecord", ""),
    ("Ecto.Repo", "ecto", ""), ("gorm.", "gorm", ""), ("database/sql", "database_sql", ""), ("Redis", "redis", ""), ("redis.", "redis", ""),
    ("Memcached", "memcached", ""), ("memcache", "memcached", ""), ("S3Client", "s3", ""), ("boto3.client('s3')", "s3", ""),
    ("BlobServiceClient", "azure_blob", ""), ("google-cloud-storage", "gcs", ""), ("@google-cloud/storage", "gcs", ""),
    ("Elasticsearch", "elasticsearch", ""), ("OpenSearch", "opensearch", ""), ("Algolia", "algolia", ""), ("Meilisearch", "meilisearch", ""),
    ("Typesense", "typesense", ""), ("SendGrid", "sendgrid", ""), ("Mailgun", "mailgun", ""), ("nodemailer", "nodemailer", ""),
    ("smtplib", "smtp", ""), ("@aws-sdk/client-ses", "ses", ""), ("postmark", "postmark", ""), ("Resend", "resend", ""),
]
EVENT_EMITTERS = [".emit(", ".dispatch(", "Subject.next(", "publish(", ".trigger(", "dispatchEvent("]
EVENT_HANDLERS = [".on(", ".addEventListener(", ".subscribe(", "@EventPattern(", "@OnEvent(", ".addListener("]

_LITERAL = r"""["'`]([^"'`\n]{1,128})["'`]"""
#: Idioms that read an environment variable; the name is the first group.
ENV_READS = [
    r"""(?:os\.)?environ(?:\.get\(|\[)\s*["'`]([A-Za-z_][A-Za-z0-9_]{0,127})["'`]""",
    r"""getenv\(\s*["'`]([A-Za-z_][A-Za-z0-9_]{0,127})["'`]""",
    r"(?:process\.env|import\.meta\.env)\.([A-Za-z_][A-Za-z0-9_]{0,127})",
    r"""(?:process\.env|import\.meta\.env)\[\s*["'`]([A-Za-z_][A-Za-z0-9_]{0,127})["'`]""",
    r"""env::var\(\s*["'`]([A-Za-z_][A-Za-z0-9_]{0,127})["'`]""",
    r"""os\.(?:Getenv|LookupEnv)\(\s*["'`]([A-Za-z_][A-Za-z0-9_]{0,127})["'`]""",
    r"""ENV(?:\[|\.fetch\()\s*["'`]([A-Za-z_][A-Za-z0-9_]{0,127})["'`]""",
    r"""\$_(?:ENV|SERVER)\[\s*["'`]([A-Za-z_][A-Za-z0-9_]{0,127})["'`]""",
]
SQL_TABLE = r"(?i)(?:^|[^A-Za-z0-9_])(?:FROM|JOIN|INTO|UPDATE)[ \t\n]+[\"`\[]?(?:[A-Za-z_]\w*\.)?[\"`\[]?([A-Za-z_]\w{0,127})"
_SQL_SIGNATURE = r"(?i)\b(SELECT\s+.+\s+FROM|INSERT\s+INTO|UPDATE\s+\S+\s+SET|DELETE\s+FROM|CREATE\s+TABLE)\b"
# Words that follow those keywords but name no table.
NOT_TABLES = "select where set values the a an this that these those it them of in on and or not null as by lateral unnest dual".split()


def needles(files: DataFrame, table: list[tuple[str, str, str]], prefix: str, literal: bool = False) -> DataFrame:
    """Entities (file_id, qname) that a table of needles finds in ``source``.

    The first needle of an entity counts. With ``literal`` the entity is the string right behind the needle's first place
    in the file, and the table's name only where there is none. All needles are looked for in one pass.
    """
    s = F.col("source")

    def hit(k: int, needle: str, name: str, signals: str) -> Column:
        seen = s.contains(needle)
        for_ = [s.contains(x) for x in signals.split()]
        if for_:
            any_ = for_[0]
            for x in for_[1:]:
                any_ = any_ | x
            seen = seen & any_
        label = F.lit(name)
        if literal:
            after = F.substr(s, F.locate(needle, s) + len(needle))
            topic = F.regexp_extract(after, r"^\s*\(?\s*" + _LITERAL, 1)
            label = F.when(topic != "", topic).otherwise(F.lit(name))
        return F.when(seen, F.struct(F.lit(k).alias("k"), label.alias("name")))

    hits = F.array_compact(F.array(*[hit(k, *row) for k, row in enumerate(table)]))
    rows = files.select("file_id", F.explode(hits).alias("h")).select("file_id", F.concat(F.lit(prefix), F.col("h.name")).alias("qname"), "h.k")
    return rows.groupBy("file_id", "qname").agg(F.min("k").alias("needle"))


def calls_with_literal(files: DataFrame, calls: list[str], prefix: str) -> DataFrame:
    """Entities named by the literal argument of the first place of each call in a file; by the call itself without one."""
    s = F.col("source")

    def hit(call: str) -> Column:
        name = F.regexp_extract(F.substr(s, F.locate(call, s) + len(call)), r"^\s*" + _LITERAL, 1)
        return F.when(s.contains(call), F.when(name != "", name).otherwise(F.lit(call)))

    names = F.array_distinct(F.array_compact(F.array(*map(hit, calls))))
    return files.select("file_id", F.explode(names).alias("n")).select("file_id", F.concat(F.lit(prefix), "n").alias("qname")).distinct()


def env_reads(files: DataFrame) -> DataFrame:
    """Environment variables that each file reads."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("source", F.lit(p)) for p in ENV_READS])))
    return files.select("file_id", F.explode(found).alias("n")).select("file_id", F.concat(F.lit("config:env:"), "n").alias("qname")).distinct()


def sql_tables(files: DataFrame) -> DataFrame:
    """Tables that SQL in a file reads or writes; files without an SQL statement are passed over."""
    names = F.transform(F.regexp_extract_all("source", F.lit(SQL_TABLE)), F.lower)
    rows = files.where(F.col("source").rlike(_SQL_SIGNATURE)).select("file_id", F.explode(F.array_distinct(names)).alias("n"))
    return rows.where(~F.col("n").isin(*NOT_TABLES)).select("file_id", F.concat(F.lit("data_entity:sql:"), "n").alias("qname")).distinct()


def dotenv_keys(files: DataFrame) -> DataFrame:
    """Variables that dotenv files define."""
    keys = F.regexp_extract_all("source", F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_]{0,127})[ \t]*="))
    return files.where(F.col("path").rlike(r"(^|/)\.env(\.|$)")).select("file_id", F.explode(F.array_distinct(keys)).alias("n")).select(
        "file_id", F.concat(F.lit("config:env:"), "n").alias("qname")
    )


def dockerfile_bases(files: DataFrame) -> DataFrame:
    """Images that Dockerfiles are built from: the part of the name before its tag, without its registry."""
    image = F.regexp_extract_all("source", F.lit(r"(?im)^FROM[ \t]+(?:--\S+[ \t]+)?([^\s:@]+)"))
    rows = files.where(F.col("path").rlike(r"(^|/)Dockerfile[^/]*$")).select("file_id", F.explode(image).alias("n"))
    return rows.select("file_id", F.concat(F.lit("infra:image:"), F.regexp_extract("n", r"([^/]*)$", 1)).alias("qname")).distinct()


def dependencies(files: DataFrame) -> DataFrame:
    """Packages that manifests depend on: package.json, composer.json, requirements, Cargo.toml, go.mod, Gemfile."""
    s, path = F.col("source"), F.col("path")
    keys = lambda q: F.coalesce(F.json_object_keys(F.get_json_object(s, q)), F.array().cast("array<string>"))
    npm = F.concat(*[keys(f"$.{k}") for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])
    composer = F.filter(F.concat(keys("$.require"), keys("$.require-dev")), lambda x: x != "php")
    pypi = F.regexp_extract_all(s, F.lit(r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)"))
    section = F.regexp_extract_all(s, F.lit(r"(?ms)^\[(?:dev-|build-)?dependencies\]\s*?\n(.*?)(?=^\[|\z)"))
    cargo = F.flatten(F.transform(section, lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*="))))
    gomod = F.regexp_extract_all(s, F.lit(r"(?m)^(?:require[ \t]+|[ \t]+)([a-z0-9.-]+\.[a-z]+/\S+)[ \t]+v"))
    gems = F.regexp_extract_all(s, F.lit(r"""(?m)^\s*gem\s+["']([^"']+)["']"""))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = (
        F.when(name == "package.json", F.transform(npm, lambda x: F.concat(F.lit("npm:"), x)))
        .when(name == "composer.json", F.transform(composer, lambda x: F.concat(F.lit("composer:"), x)))
        .when(name.rlike(r"^requirements.*\.txt$"), F.transform(pypi, lambda x: F.concat(F.lit("pypi:"), F.lower(x))))
        .when(name == "Cargo.toml", F.transform(cargo, lambda x: F.concat(F.lit("cargo:"), x)))
        .when(name == "go.mod", F.transform(gomod, lambda x: F.concat(F.lit("gomod:"), x)))
        .when(name == "Gemfile", F.transform(gems, lambda x: F.concat(F.lit("rubygems:"), x)))
    )
    return files.select("file_id", F.explode(F.array_distinct(found)).alias("n")).select("file_id", F.concat(F.lit("package:"), "n").alias("qname"))


def cron_schedules(files: DataFrame) -> DataFrame:
    """Schedules of GitHub workflows, Kubernetes CronJobs, node-cron and ``@Scheduled``, where they look like cron."""
    s, path = F.col("source"), F.col("path")
    found = F.concat(
        F.when(path.contains(".github/workflows/"), F.regexp_extract_all(s, F.lit(r"""cron:\s*["']([^"'\n]+)["']"""))).otherwise(F.array().cast("array<string>")),
        F.when(s.contains("kind: CronJob"), F.regexp_extract_all(s, F.lit(r"""(?m)^\s*schedule:\s*["']?([^"'\n]+)["']?"""))).otherwise(F.array().cast("array<string>")),
        F.regexp_extract_all(s, F.lit(r"""cron\.schedule\(\s*["'`]([^"'`\n]+)["'`]""")),
        F.regexp_extract_all(s, F.lit(r'@Scheduled\([^)]*cron\s*=\s*"([^"\n]+)"')),
    )
    shape = r"^\s*[0-9A-Za-z*/,?#-]+(\s+[0-9A-Za-z*/,?#-]+){4,6}\s*$"
    return files.select("file_id", F.explode(F.array_distinct(found)).alias("n")).where(F.col("n").rlike(shape)).select(
        "file_id", F.concat(F.lit("cron:"), F.trim("n")).alias("qname")
    )


def routes(files: DataFrame) -> DataFrame:
    """HTTP routes of common frameworks: verb and path, one row for each."""
    s = F.col("source")
    verbs = "get|post|put|patch|delete|head|options"
    two = lambda p: F.arrays_zip(F.regexp_extract_all(s, F.lit(p), F.lit(1)).alias("verb"), F.regexp_extract_all(s, F.lit(p), F.lit(2)).alias("path"))
    patterns = [
        rf"""(?:app|router|server|r|e|api|bp|blueprint)\.({verbs}|GET|POST|PUT|PATCH|DELETE)\(\s*["'`](/[^"'`\n]*)["'`]""",
        r"""@(Get|Post|Put|Patch|Delete)(?:Mapping)?\(\s*(?:value\s*=\s*|path\s*=\s*)?["'](/?[^"'\n]*)["']""",
        rf"""#\[({verbs})\(\s*"(/[^"\n]*)\"""",
        r"""Route::(get|post|put|patch|delete|any)\(\s*["'](/?[^"'\n]*)["']""",
    ]
    found = F.concat(*map(two, patterns))
    rows = files.select("file_id", F.explode(found).alias("r")).select("file_id", F.upper("r.verb").alias("method"), F.col("r.path").alias("path"))
    return rows.withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))).distinct()
