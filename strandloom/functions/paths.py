"""Expressions over file paths and imported names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a path a test, of continuous integration, a document or an asset.
TEST_PATTERNS = (
    r"(^|/)(tests?|spec|specs|__tests__|testing)(/|$)",
    r"(^|/)src/(test|it|integrationTest)/",
    r"(^|/)test_[^/]+\.py$",
    r"[^/]+_test\.(go|py|rb|js|ts)$",
    r"[^/]+(Test|Tests|IT|Spec)\.(java|kt|scala|cs)$",
    r"[^/]+\.(test|spec)\.(js|jsx|ts|tsx|mjs)$",
)
CI_PATTERN = r"(^|/)(\.github|\.gitlab|\.circleci|\.azure|ci|\.buildkite)(/|$)"
ASSET_PATTERN = r"(?i)\.(png|jpe?g|gif|svg|ico|woff2?|ttf|eot|otf|pdf|jar|zip)$"
DOC_PATTERN = r"(?i)\.(md|rst|adoc|txt)$"
#: Folders that a walk does not enter.
WALK_EXCLUDE = """
.git .hg .svn .gradle .idea .vscode .mypy_cache .pytest_cache .ruff_cache
.tox .venv venv env node_modules bower_components vendor target build out dist
__pycache__ .next .nuxt .parcel-cache .terraform .serverless coverage htmlcov
bin obj Pods DerivedData .dart_tool .cargo .stack-work _build deps
""".split()
#: Endings of files that are not read as text.
BINARY_EXTENSIONS = """
.jar .war .ear .class .so .dylib .dll .exe .bin .o .a .zip .gz .bz2 .xz .7z
.tar .tgz .rar .png .jpg .jpeg .gif .bmp .ico .webp .svgz .pdf .doc .docx
.xls .xlsx .ppt .pptx .woff .woff2 .ttf .eot .otf .mp3 .mp4 .avi .mov .wav
.db .sqlite .sqlite3 .pyc .pyo .keystore .jks .p12 .pfx .der
""".split()
#: Import prefixes that no repository owns.
THIRD_PARTY = (
    "java.", "javax.", "jakarta.", "jdk.", "sun.", "kotlin.", "scala.", "groovy.",
    "org.springframework.", "org.hibernate.", "org.apache.", "org.slf4j.",
    "org.junit.", "org.mockito.", "org.assertj.", "org.testng.", "org.quartz.",
    "org.json.", "org.yaml.", "org.w3c.", "org.xml.", "org.reactivestreams.",
    "com.google.", "com.fasterxml.", "com.codahale.", "com.jcraft.",
    "com.microsoft.", "com.amazonaws.", "com.azure.", "com.zaxxer", "com.sun.",
    "io.dropwizard.", "io.swagger.", "io.prometheus.", "io.netty.", "io.micrometer.",
    "io.reactivex.", "lombok.", "ch.qos.", "net.sf.", "reactor.", "graphql.",
    "software.amazon.", "feign.", "retrofit2.", "okhttp3.",
    "System.", "Microsoft.", "Newtonsoft.", "AutoMapper.", "Serilog.",
    "FluentValidation.", "Xunit.", "Moq.", "NUnit.", "FluentAssertions.",
)
#: The channel that an import of a library opens, by prefix.
IMPORT_CHANNELS = {
    "javax.ws.rs": "http_in", "jakarta.ws.rs": "http_in", "org.springframework.web.bind.annotation": "http_in",
    "io.dropwizard.jersey": "http_in", "javax.persistence": "persist", "jakarta.persistence": "persist",
    "org.springframework.data": "persist", "org.hibernate": "persist", "org.apache.http": "http_out",
    "okhttp3": "http_out", "retrofit2": "http_out", "java.net.http": "http_out",
    "org.springframework.web.client": "http_out", "com.jcraft.jsch": "ssh_exec", "org.quartz": "schedule",
    "io.dropwizard.jobs": "schedule", "org.springframework.scheduling": "schedule", "io.prometheus": "metric_emit",
    "com.codahale.metrics": "metric_emit", "io.micrometer": "metric_emit", "org.mapstruct": "map",
    "flask": "http_in", "fastapi": "http_in", "django.urls": "http_in", "starlette": "http_in",
    "requests": "http_out", "httpx": "http_out", "aiohttp": "http_out", "urllib.request": "http_out",
    "sqlalchemy": "persist", "psycopg2": "persist", "pymysql": "persist", "pymongo": "persist", "django.db": "persist",
    "celery": "schedule", "apscheduler": "schedule", "paramiko": "ssh_exec", "prometheus_client": "metric_emit",
    "kafka": "event_publish", "pika": "event_publish",
    "express": "http_in", "fastify": "http_in", "koa": "http_in", "@nestjs/common": "http_in",
    "axios": "http_out", "node-fetch": "http_out", "got": "http_out", "typeorm": "persist", "sequelize": "persist",
    "mongoose": "persist", "@prisma/client": "persist", "pg": "persist", "node-cron": "schedule", "bull": "schedule",
    "kafkajs": "event_publish", "amqplib": "event_publish", "prom-client": "metric_emit",
    "net/http": "http_out", "database/sql": "persist", "gorm.io/gorm": "persist",
    "github.com/gin-gonic/gin": "http_in", "github.com/gorilla/mux": "http_in",
    "golang.org/x/crypto/ssh": "ssh_exec", "github.com/prometheus/client_golang": "metric_emit",
    "Microsoft.AspNetCore.Mvc": "http_in", "Microsoft.AspNetCore.Routing": "http_in",
    "Microsoft.EntityFrameworkCore": "persist", "System.Net.Http": "http_out", "Hangfire": "schedule",
}
#: Language and role by file name, and by ending.
BY_NAME = {
    "Dockerfile": ("docker", "build"), "pom.xml": ("maven", "build"), "build.gradle": ("gradle", "build"),
    "build.gradle.kts": ("gradle", "build"), "settings.gradle": ("gradle", "build"), "settings.gradle.kts": ("gradle", "build"),
    "package.json": ("npm", "build"), "go.mod": ("gomod", "build"), "pyproject.toml": ("toml", "build"), "Cargo.toml": ("toml", "build"),
}
BY_EXTENSION = {
    ".java": ("java", "source"), ".py": ("python", "source"), ".js": ("javascript", "source"), ".jsx": ("javascript", "source"),
    ".mjs": ("javascript", "source"), ".ts": ("typescript", "source"), ".tsx": ("typescript", "source"), ".go": ("go", "source"),
    ".cs": ("csharp", "source"), ".scala": ("scala", "source"), ".sql": ("sql", "schema"), ".ddl": ("sql", "schema"),
    ".properties": ("properties", "config"), ".yml": ("yaml", "config"), ".yaml": ("yaml", "config"), ".toml": ("toml", "config"),
    ".ini": ("ini", "config"), ".env": ("env", "config"), ".md": ("markdown", "source"), ".json": ("json", "source"),
    ".xml": ("xml", "source"), ".html": ("html", "source"), ".css": ("css", "source"), ".sh": ("shell", "source"), ".txt": ("text", "source"),
}
PROJECT_ENDINGS = (".csproj", ".fsproj", ".vbproj")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    name = base_name(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1))))


def _looked_up(path: Column, at: int, fallback: str) -> Column:
    """A bounded literal map probed by name, then by ending."""
    names = F.create_map(*[F.lit(x) for k, v in BY_NAME.items() for x in (k, v[at])])
    ends = F.create_map(*[F.lit(x) for k, v in BY_EXTENSION.items() for x in (k, v[at])])
    return F.coalesce(names[base_name(path)], ends[extension(path)], F.lit(fallback))


def language(path: Column) -> Column:
    return F.when(base_name(path).startswith("Dockerfile"), F.lit("docker")).otherwise(_looked_up(path, 0, "unknown"))


def role(path: Column, extractor_role: Column | None = None) -> Column:
    """test, ci, the extractor's own role, asset, docs or source: the first that holds."""
    own = _looked_up(path, 1, "source") if extractor_role is None else extractor_role
    test = path.rlike(TEST_PATTERNS[0])
    for p in TEST_PATTERNS[1:]:
        test = test | path.rlike(p)
    return F.when(test, "test").when(path.rlike(CI_PATTERN), "ci").when(own != "source", own).when(path.rlike(ASSET_PATTERN), "asset").when(path.rlike(DOC_PATTERN), "docs").otherwise("source")


def is_manifest(path: Column) -> Column:
    name = base_name(path)
    found = name.isin(*[k for k in BY_NAME if k != "Dockerfile"])
    for e in PROJECT_ENDINGS:
        found = found | name.endswith(e)
    return found


def is_binary(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*BINARY_EXTENSIONS), F.lit(False))


def has_segment(path: Column, segments) -> Column:
    """Whether any whole segment of the path is one of those named."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in segments]))


def is_third_party(name: Column) -> Column:
    found = F.lit(False)
    for p in THIRD_PARTY:
        found = found | name.startswith(p)
    return found


def looks_third_party(name: Column) -> Column:
    return is_third_party(name) | ~(F.instr(name, ".").cast("boolean") | F.instr(name, "/").cast("boolean"))


def prefixes(name: Column, boundary: str = r"[./]", most: int = 12) -> Column:
    """The name and what is left of it at each of its last ``most`` boundaries, longest first."""
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.char_length(name)), lambda i: F.when(F.substring(name, i, F.lit(1)).rlike(boundary), i - 1)), lambda i: i.isNotNull())
    return F.concat(F.array(name), F.slice(F.transform(F.reverse(cuts), lambda n: F.substring(name, F.lit(1), n)), 1, most))


def path_prefixes(path: Column, depth_from: int = 1) -> Column:
    """Every leading run of segments of a path, shortest first."""
    segments = F.split(path, "/")
    return F.transform(F.sequence(F.lit(depth_from), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))


def rollup(path: Column, depth: int) -> Column:
    """The first ``depth`` folders of a file's path; files at the root are (root)."""
    folder = directory(path)
    return F.when(folder == "", F.lit("(root)")).otherwise(F.array_join(F.slice(F.split(folder, "/"), 1, depth), "/"))
