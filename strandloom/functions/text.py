"""Text expressions. Each takes and returns a Column; none leaves the JVM.

White space follows the Unicode sense (with the separators U+001C to U+001F), and
lines end at every Unicode line break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Prefixes that mark the type of a node id.
NODE_TYPES = ("table", "route", "config", "entity", "process", "library", "migration", "port", "config-file", "sql", "http")
#: Prefixes of facts that are no symbols of a language.
SYNTHETIC = ("config", "table", "entity", "process", "library", "route", "port", "build")


def normalise_ws(x: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, WHITE, " "))


def lines_of(x: Column) -> Column:
    """The lines of a text, without a last empty one."""
    parts = F.split(x, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def truncate(x: Column, n: int) -> Column:
    """At most n characters; a cut text ends in an ellipsis."""
    t = F.trim(x)
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…")))


def slug(x: Column, fallback: str = "x") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def claim_id(*parts: Column) -> Column:
    """Slugs joined by dots; a single one is padded, so that an id always has two."""
    given = [slug(p) for p in parts]
    return F.concat_ws(".", *(given if len(given) > 1 else [*given, F.lit("x")]))


def short_name(x: Column) -> Column:
    """What is left of a name after its path and package: a.b.C#m gives C#m."""
    last = F.substring_index(x, "/", -1)
    member = F.when(F.instr(last, "#") > 0, F.concat(F.lit("#"), F.substring_index(last, "#", -1))).otherwise(F.lit(""))
    return F.concat(F.substring_index(F.substring_index(last, "#", 1), ".", -1), member)


def node_type(x: Column) -> Column:
    """The type a node id carries as prefix, or null for a bare name."""
    head = F.substring_index(x, ":", 1)
    return F.when((F.instr(x, ":") > 0) & head.isin(*NODE_TYPES), head)


def node_name(x: Column) -> Column:
    return F.when(node_type(x).isNotNull(), F.regexp_replace(x, "^[^:]*:", "")).otherwise(x)


def display_label(x: Column) -> Column:
    """The last two dotted segments; a typed id keeps all after its prefix."""
    segments = F.split(x, r"\.")
    return F.when(node_type(x).isNotNull(), node_name(x)).otherwise(F.array_join(F.slice(segments, F.greatest(F.size(segments) - 1, F.lit(1)), 2), "."))


def is_synthetic(x: Column) -> Column:
    return F.substring_index(x, ":", 1).isin(*SYNTHETIC)


def link_path(channel: Column, target: Column) -> Column:
    """What a link target names, without verb, scheme and host; names of tables in lower case."""
    route = F.regexp_replace(F.when(F.instr(target, " ") > 0, F.regexp_replace(target, "^[^ ]* ", "")).otherwise(target), "^route:", "")
    raw = F.regexp_replace(target, "^http:(?!//)", "")
    absolute = raw.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(/.*)?$")
    tail = F.regexp_extract(raw, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(/.*)?$", 1)
    outward = F.when(absolute, F.when(tail == "", F.lit("/")).otherwise(tail)).otherwise(raw)
    return F.when(channel == "http_in", route).when(channel == "http_out", outward).when(channel.isin("persist", "schema_own"), F.lower(target)).otherwise(target)


def link_key(channel: Column, target: Column) -> Column:
    """``link_path`` with path parameters as *, for HTTP alone."""
    path = link_path(channel, target)
    return F.when(channel.isin("http_in", "http_out"), F.regexp_replace(path, r"\{[^{}]*\}|:[A-Za-z_][A-Za-z0-9_]*", "*")).otherwise(path)


def join_route(base: Column, sub: Column) -> Column:
    left, right = F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", ""), F.regexp_replace(F.coalesce(sub, F.lit("")), "^/+", "")
    both = F.when(right == "", left).otherwise(F.concat(left, F.lit("/"), right))
    return F.when(both == "", F.lit("/")).when(both.startswith("/"), both).otherwise(F.concat(F.lit("/"), both))


def first_literal(x: Column) -> Column:
    found = F.regexp_extract(x, r'"([^"\\]*(?:\\.[^"\\]*)*)"', 1)
    return F.when(found != "", found)


def library_root(x: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(x, r"\."), 1, n), ".")


def python_module(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), "/__init__$", ""), "/", ".")


def token_estimate(x: Column) -> Column:
    return F.floor(F.char_length(x) / 4)


def power_of_two(n: Column) -> Column:
    """The next power of two, 1 for what is at most 1, in whole numbers."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-12))).cast("long")


def scope_shape(n_files: Column, languages: Column, roles: Column) -> Column:
    return F.concat_ws("|", power_of_two(n_files).cast("string"), F.array_join(F.array_sort(languages), "+"), F.array_join(F.array_sort(roles), "+"))


def run_id(sha: Column) -> Column:
    return F.concat(F.lit("run-"), F.substring(sha, 1, 12))


def remote_name(url: Column) -> Column:
    """A repository's remote in one form: no scheme, no user, no .git, ':' of scp form as '/'."""
    bare = F.regexp_replace(F.trim(url), r"^[a-z+]+://", "")
    bare = F.regexp_replace(bare, "^[^@/]+@", "")
    bare = F.regexp_replace(bare, r"^([^/:]+):(?!\d)", "$1/")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "/+$", ""), r"\.git$", ""))


def schema_name(x: Column) -> Column:
    clean = F.regexp_replace(F.lower(x), "[^a-z0-9_]+", "_")
    return F.substring(F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean), 1, 63)


def outermost_json(x: Column) -> Column:
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def sql_tables_written(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+[`\"\[]?([A-Za-z_][\w.]*)"), F.lit(1))


def sql_tables_read(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?i)\bFROM\s+[`\"\[]?([A-Za-z_][\w.]*)"), F.lit(1))


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive substring test, in which no character is a wildcard."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def cite(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))
