"""Facts of one source file: what it defines, uses, imports, reads, writes and declares.

Each language has a function from lines to facts. A fact is a tuple (tag, name, kind,
visibility, value, target, channel, line); tags are define, use, io_edge, import, dep
and note. Extractors look at one file and never fail a run: the caller turns an
exception into a note.
"""

from __future__ import annotations

import ast
import json
import re

from strandloom.functions.paths import IMPORT_CHANNELS

COLUMNS = ("tag", "name", "kind", "visibility", "value", "target", "channel", "line")


def fact(tag, name, line, kind=None, visibility=None, value=None, target=None, channel=None):
    return (tag, name, kind, visibility, value, target, channel, line)


def edge(source, target, channel, line):
    return fact("io_edge", source, line, target=target, channel=channel)


def channel_of(name: str) -> str | None:
    """The channel of the longest listed prefix of an import, at a boundary."""
    best = ""
    for p in IMPORT_CHANNELS:
        if len(p) > len(best) and (name == p or name.startswith((p + ".", p + "/"))):
            best = p
    return IMPORT_CHANNELS.get(best)


def import_facts(owner: str, imports: list[tuple[str, int]], root_parts: int = 3):
    seen = set()
    for name, line in imports:
        yield fact("import", name, line)
        c = channel_of(name)
        if c and c not in seen:
            seen.add(c)
            yield edge(owner, "library:" + ".".join(name.split(".")[:root_parts]), c, line)


def without_comments(lines: list[str]) -> list[str]:
    """Lines with block and // comments blanked; a // in a string cuts too."""
    out, inside = [], False
    for line in lines:
        kept, i = "", 0
        while i < len(line):
            if inside:
                j = line.find("*/", i)
                if j < 0:
                    break
                inside, i = False, j + 2
            else:
                block, rest = line.find("/*", i), line.find("//", i)
                if rest >= 0 and (block < 0 or rest < block):
                    kept += line[i:rest]
                    break
                if block < 0:
                    kept += line[i:]
                    break
                kept += line[i:block]
                inside, i = True, block + 2
        out.append(kept)
    return out


def masked(line: str) -> str:
    """A line with what stands in string literals blanked, so that its braces do not count."""
    return re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', lambda m: '"' + " " * (len(m[0]) - 2) + '"', line)


def literal(text: str) -> str | None:
    m = re.search(r'"((?:\\.|[^"\\])*)"', text)
    return m[1] if m else None


def joined(base: str, sub: str) -> str:
    path = base.rstrip("/") + ("/" + sub.lstrip("/") if sub.strip("/") else "")
    return path if path.startswith(("/", "$")) else "/" + path


def path_argument(text: str, owner: str) -> str:
    """The path an annotation names: a literal, or ${Owner.CONST} for a constant."""
    inner = re.search(r"\((.*)\)", text)
    if not inner:
        return ""
    found = literal(inner[1])
    if found is not None:
        return found
    ref = re.search(r"([A-Za-z_][\w.]*)\s*\)?$", inner[1].split("=")[-1].strip())
    if not ref:
        return ""
    parts = ref[1].split(".")
    return "${" + (".".join(parts[-2:]) if len(parts) > 1 else f"{owner}.{parts[0]}") + "}"


#: Annotations of routes, with their verbs.
JAVA_VERBS = {"GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE", "PATCH": "PATCH", "HEAD": "HEAD", "OPTIONS": "OPTIONS", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
JAVA_SCHEDULE = ("Scheduled", "Every", "On", "DelayStart")
JAVA_TYPE = re.compile(r"^\s*((?:(?:public|protected|private|abstract|final|static|sealed|strictfp)\s+)*)(class|interface|enum|record|@interface)\s+(\w+)(.*)$")
JAVA_CONSTANT = re.compile(r"^\s*((?:public|protected|private)?\s*)(?:static\s+final|final\s+static)\s+[\w<>\[\].]+\s+([A-Z][A-Z0-9_]*)\s*=\s*(.*);")
JAVA_METHOD = re.compile(r"^\s*public\s+(?:static\s+|final\s+|abstract\s+|synchronized\s+)*(?:<[^>]+>\s+)?([\w<>\[\],.? ]+?)\s+(\w+)\s*\(([^)]*)")
REPOSITORY = re.compile(r"extends\s+(?:Jpa|Crud|PagingAndSorting|Mongo|Reactive\w*)Repository\s*<\s*([\w.]+)")


def visible(modifiers: str) -> str:
    return next((v for v in ("public", "protected", "private") if v in modifiers), "package")


def java(path: str, lines: list[str]):
    lines = without_comments(lines)
    package = next((m[1] for x in lines[:80] if (m := re.match(r"\s*package\s+([\w.]+)", x))), "")
    imports = [(m[1], i) for i, x in enumerate(lines, 1) if (m := re.match(r"\s*import\s+(?:static\s+)?([\w.*]+)\s*;", x))]
    explicit = {n.rsplit(".", 1)[-1]: n for n, _ in imports if not n.endswith("*")}

    def resolved(short):
        return explicit.get(short) or (f"{package}.{short}" if package else short)

    stack, depth, primary, owners, pending = [], 0, None, {}, []
    facts, declared, by_decl = [], [], []  # declared: (line, fqn, kind)
    for i, line in enumerate(lines, 1):
        flat = masked(line)
        if m := re.match(r"\s*@(\w+)", line):
            if m[1] != "interface":
                pending.append((m[1], line, i))
        t = JAVA_TYPE.match(flat)
        holder = stack[-1][0] if stack else package
        if t:
            kind = "annotation" if t[2] == "@interface" else t[2]
            fqn = f"{holder}.{t[3]}" if holder else t[3]
            facts.append(fact("define", fqn, i, kind=kind, visibility=visible(t[1])))
            primary = primary or fqn
            declared.append((i, fqn, "type"))
            by_decl.append((fqn, "type", pending, i))
            pending = []
            for parent in re.findall(r"(?:extends|implements)\s+([\w.,\s<>]+?)(?=\s*(?:implements|\{|$))", t[4]):
                for name in re.findall(r"[A-Z]\w+", parent):
                    facts.append(fact("use", resolved(name), i))
            if r := REPOSITORY.search(line):
                entity = "entity:" + resolved(r[1].rsplit(".", 1)[-1])
                facts += [edge(fqn, entity, "persist", i), edge(fqn, entity, "read", i)]
            stack.append((fqn, depth + 1))
        elif stack and (c := JAVA_CONSTANT.match(line)):
            value = literal(c[3])
            facts.append(fact("define", f"{holder}.{c[2]}", i, kind="constant", visibility=visible(c[1]), value=(value if value is not None else c[3].strip())[:200]))
            pending = []
        elif stack and (f := JAVA_METHOD.match(flat)) and not f[2].isupper() and f[2] != holder.rsplit(".", 1)[-1]:
            fqn = f"{holder}#{f[2]}"
            facts.append(fact("define", fqn, i, kind="method", visibility="public"))
            declared.append((i, fqn, "method"))
            by_decl.append((fqn, "method", pending, i))
            if f[2] == "main" and "String" in f[3] and "static" in flat:
                facts.append(edge(holder, "process:" + (primary or holder), "process_boundary", i))
            for name in set(re.findall(r"\b[A-Z]\w+", f[1] + " " + f[3])) & explicit.keys():
                facts.append(fact("use", explicit[name], i))
            if any(a == "Mapper" for _, k, ps, _ in by_decl if k == "type" for a, _, _ in ps):
                out = re.sub(r"<.*", "", f[1]).strip()
                for p in re.findall(r"([A-Z]\w+)(?:<[^>]*>)?\s+\w+", f[3]):
                    if p != out and not {p, out} & {"String", "Integer", "Long", "List", "void", "boolean", "int", "long"}:
                        facts.append(edge(resolved(p), resolved(out), "map", i))
            pending = []
        elif flat.strip() and not flat.strip().startswith("@") and ";" in flat:
            for a, text, at in pending:
                if a == "Value" and (k := re.search(r'"\$\{([^:}"]+)', text)):
                    facts.append(edge(holder, "config:" + k[1], "config_read", at))
            pending = []
        depth += flat.count("{") - flat.count("}")
        while stack and depth < stack[-1][1]:
            if "}" not in flat and depth < stack[-1][1]:
                break
            stack.pop()
    primary = primary or ".".join(x for x in (package, path.rsplit("/", 1)[-1].rsplit(".", 1)[0]) if x)
    facts += import_facts(primary, imports)
    facts += [fact("use", n, i) for n, i in imports]
    bases = {}
    for fqn, kind, marks, _ in by_decl:
        names = {a: (text, i) for a, text, i in marks}
        owner = fqn.split("#")[0]
        short = owner.rsplit(".", 1)[-1]
        if kind == "type":
            if "Entity" in names:
                table = literal(names["Table"][0]) if "Table" in names else None
                facts.append(edge(fqn, f"table:{table}" if table else f"entity:{fqn}", "persist", names["Table" if table else "Entity"][1]))
            for a in ("Path", "RequestMapping"):
                if a in names:
                    bases[fqn] = path_argument(names[a][0], short)
            if "ConfigurationProperties" in names:
                facts.append(edge(fqn, "config:" + (literal(names["ConfigurationProperties"][0]) or "?"), "config_read", names["ConfigurationProperties"][1]))
            if "Job" in (n.rsplit(".", 1)[-1] for n, _ in imports) and any(f[0] == "use" and f[1].endswith(".Job") and f[7] == _ for f in facts):
                facts.append(edge(fqn, "scheduler", "schedule", _))
        else:
            verbs = [(JAVA_VERBS[a], text, i) for a, text, i in marks if a in JAVA_VERBS]
            sub = path_argument(names["Path"][0], short) if "Path" in names else ""
            if not verbs and "RequestMapping" in names:
                text, i = names["RequestMapping"]
                verb = re.search(r"RequestMethod\.(\w+)", text)
                verbs = [(verb[1] if verb else "ANY", text, i)]
            for verb, text, i in verbs:
                facts.append(edge(fqn, f"route:{verb} {joined(bases.get(owner, ''), sub or path_argument(text, short))}", "http_in", i))
            for a in JAVA_SCHEDULE:
                if a in names:
                    facts.append(edge(fqn, primary, "schedule", names[a][1]))
    return {"package": package, "primary": primary}, facts


#: Decorators of Python routes, and of jobs.
PY_VERBS = {"get", "post", "put", "delete", "patch", "head", "options", "websocket"}
PY_JOBS = {"task", "shared_task", "periodic_task", "scheduled_job"}
SQL_READ = re.compile(r"\bSELECT\b.*?\bFROM\s+[`\"\[]?([A-Za-z_][\w.]*)", re.I)
SQL_WRITE = re.compile(r"\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+[`\"\[]?([A-Za-z_][\w.]*)", re.I)


def sql_in_code(owner: str, lines: list[str]):
    seen = set()
    for i, line in enumerate(lines, 1):
        for found, channel in ((SQL_READ.search(line), "read"), (SQL_WRITE.search(line), "persist")):
            if found and (found[1], channel) not in seen:
                seen.add((found[1], channel))
                yield edge(owner, "table:" + found[1].lower(), channel, i)
                break


def python(path: str, lines: list[str]):
    module = re.sub(r"(/__init__)?\.pyi?$", "", path).replace("/", ".")
    facts = []
    try:
        tree = ast.parse("\n".join(lines))
    except (SyntaxError, ValueError) as why:
        return {"package": module, "primary": module}, [fact("note", f"syntax:{type(why).__name__}", 1)]
    hidden = lambda n: "private" if n.startswith("__") and not n.endswith("__") else "internal" if n.startswith("_") else "public"

    def dotted(node):
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ".".join(reversed(parts))

    def decorated(node, fqn):
        for d in node.decorator_list:
            call = d.func if isinstance(d, ast.Call) else d
            name = dotted(call)
            leaf = name.rsplit(".", 1)[-1]
            if "." in name and (leaf in PY_VERBS or leaf == "route"):
                first = d.args[0] if isinstance(d, ast.Call) and d.args else None
                where = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else "/"
                facts.append(edge(fqn, f"route:{'ANY' if leaf == 'route' else leaf.upper()} {where}", "http_in", d.lineno))
            elif leaf in PY_JOBS:
                facts.append(edge(fqn, "scheduler", "schedule", d.lineno))

    def walk(body, holder):
        for node in body:
            if isinstance(node, ast.ClassDef):
                fqn = f"{holder}.{node.name}"
                facts.append(fact("define", fqn, node.lineno, kind="class", visibility=hidden(node.name)))
                decorated(node, fqn)
                for b in node.bases:
                    if dotted(b).endswith(("Model", "Base", "Document")):
                        facts.append(edge(fqn, "entity:" + fqn, "persist", node.lineno))
                walk(node.body, fqn)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                fqn = f"{holder}#{node.name}" if holder != module else f"{holder}.{node.name}"
                facts.append(fact("define", fqn, node.lineno, kind="method", visibility=hidden(node.name)))
                decorated(node, fqn)
            elif isinstance(node, ast.Assign) and holder == module:
                for t in node.targets:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                        value = node.value.value if isinstance(node.value, ast.Constant) else ast.unparse(node.value)
                        facts.append(fact("define", f"{module}.{t.id}", node.lineno, kind="constant", visibility="public", value=str(value)[:200]))
            elif isinstance(node, ast.If) and "__main__" in ast.unparse(node.test):
                facts.append(edge(module, "process:" + module, "process_boundary", node.lineno))

    walk(tree.body, module)
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            imports += [(f"{base}.{a.name}" if node.module else base + a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.Call) and dotted(node.func) in ("os.getenv", "os.environ.get", "getenv") and node.args and isinstance(node.args[0], ast.Constant):
            facts.append(edge(module, f"config:{node.args[0].value}", "config_read", node.lineno))
        elif isinstance(node, ast.Subscript) and dotted(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            facts.append(edge(module, f"config:{node.slice.value}", "config_read", node.lineno))
    facts += import_facts(module, imports)
    facts += [fact("use", n, i) for n, i in imports]
    facts += sql_in_code(module, lines)
    return {"package": module, "primary": module}, facts


JS_KINDS = {"function": "method", "class": "class", "const": "constant", "let": "field", "var": "field", "interface": "interface", "type": "class", "enum": "enum"}


def javascript(path: str, lines: list[str]):
    lines = without_comments(lines)
    owner = re.sub(r"\.\w+$", "", path)
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    imports, facts, base, known = [], [], "", set()

    def once(e):
        if e[:7] not in known:
            known.add(e[:7])
            facts.append(e)

    for i, line in enumerate(lines, 1):
        for m in re.finditer(r"(?:from|require\(|import\()\s*['\"]([^'\"]+)['\"]|^\s*import\s+['\"]([^'\"]+)['\"]", line):
            name = m[1] or m[2]
            if name.startswith("."):
                parts = folder.split("/") if folder else []
                for p in name.split("/"):
                    if p == "..":
                        parts = parts[:-1]
                    elif p != ".":
                        parts.append(p)
                name = re.sub(r"\.(js|ts|jsx|tsx|mjs)$", "", "/".join(parts))
            imports.append((name, i))
        if m := re.match(r"(export\s+(?:default\s+)?)?(?:async\s+|abstract\s+)?(function|class|const|let|var|interface|type|enum)\s+(\w+)", line):
            facts.append(fact("define", f"{owner}.{m[3]}", i, kind=JS_KINDS[m[2]], visibility="public" if m[1] else "internal"))
        if m := re.search(r"\b(?:app|router|server|api|fastify)\.(get|post|put|delete|patch|head|options|all)\(\s*['\"`]([^'\"`]+)", line):
            once(edge(owner, f"route:{'ANY' if m[1] == 'all' else m[1].upper()} {joined('', m[2])}", "http_in", i))
        if m := re.search(r"@Controller\(\s*(?:['\"`]([^'\"`]*))?", line):
            base = m[1] or ""
        if m := re.search(r"@(Get|Post|Put|Delete|Patch)\(\s*(?:['\"`]([^'\"`]*))?", line):
            once(edge(owner, f"route:{m[1].upper()} {joined(base, m[2] or '')}", "http_in", i))
        for m in re.finditer(r"process\.env\.(\w+)", line):
            once(edge(owner, "config:" + m[1], "config_read", i))
        if m := re.search(r"\b(?:fetch|got|superagent(?:\.\w+)?|axios(?:\.\w+)?)\(\s*(?:['\"`]([^'\"`]+))?", line):
            once(edge(owner, "http:" + (m[1] or "(dynamic)"), "http_out", i))
    return {"package": folder, "primary": owner}, [*facts, *import_facts(owner, imports), *[fact("use", n, i) for n, i in imports]]


def go(path: str, lines: list[str]):
    lines = without_comments(lines)
    owner = path.rsplit("/", 1)[0] if "/" in path else "."
    imports, facts, block = [], [], False
    for i, line in enumerate(lines, 1):
        if re.match(r"\s*import\s*\(", line):
            block = True
        elif block and line.strip() == ")":
            block = False
        elif (m := re.match(r'\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$', line)) and (block or "import" in line):
            imports.append((m[1], i))
        seen = lambda n: "public" if n[:1].isupper() else "package"
        if m := re.match(r"type\s+(\w+)\s+(struct|interface)?", line):
            facts.append(fact("define", f"{owner}.{m[1]}", i, kind="interface" if m[2] == "interface" else "class", visibility=seen(m[1])))
        if m := re.match(r"func\s+(?:\([^)]*?\*?(\w+)\)\s*)?(\w+)\s*\(", line):
            facts.append(fact("define", f"{owner}.{m[1]}#{m[2]}" if m[1] else f"{owner}.{m[2]}", i, kind="method", visibility=seen(m[2])))
            if m[2] == "main" and not m[1]:
                facts.append(edge(owner, "process:" + owner, "process_boundary", i))
        if m := re.match(r"const\s+(\w+)\s*(?:\w+\s*)?=\s*(.*)", line):
            value = literal(m[2])
            facts.append(fact("define", f"{owner}.{m[1]}", i, kind="constant", visibility=seen(m[1]), value=(value if value is not None else m[2].strip())[:200]))
        if m := re.search(r'\.(?:HandleFunc|Handle|(GET|POST|PUT|DELETE|PATCH))\(\s*"([^"]+)"', line):
            facts.append(edge(owner, f"route:{m[1] or 'ANY'} {m[2]}", "http_in", i))
        for m in re.finditer(r'os\.(?:Getenv|LookupEnv)\("([^"]+)"', line):
            facts.append(edge(owner, "config:" + m[1], "config_read", i))
    facts += sql_in_code(owner, lines)
    return {"package": owner, "primary": owner}, [*facts, *import_facts(owner, imports), *[fact("use", n, i) for n, i in imports]]


def csharp(path: str, lines: list[str]):
    lines = without_comments(lines)
    space = next((m[1] for x in lines if (m := re.match(r"\s*namespace\s+([\w.]+)", x))), "")
    imports = [(m[1], i) for i, x in enumerate(lines, 1) if (m := re.match(r"\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", x))]
    facts, stack, depth, waiting, base, verb = [], [], 0, None, "", None
    primary = None
    for i, line in enumerate(lines, 1):
        flat = masked(line)
        holder = stack[-1][0] if stack else space
        if m := re.search(r'\[Route\(\s*"([^"]*)"', line):
            if not stack:
                base = m[1]
        if m := re.search(r'\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*"([^"]*)")?', line):
            verb = (m[1].upper(), m[2] or "", i)
        t = re.match(r"\s*((?:(?:public|protected|private|internal|abstract|sealed|static|partial|readonly)\s+)*)(class|interface|enum|record|struct)\s+(\w+)", flat)
        if t:
            fqn = f"{holder}.{t[3]}" if holder else t[3]
            facts.append(fact("define", fqn, i, kind=t[2], visibility=next((v for v in ("public", "protected", "private", "internal") if v in t[1]), "internal")))
            primary = primary or fqn
            waiting = (fqn, i)
        elif stack and (f := re.match(r"\s*public\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\],.? ]+?\s+(\w+)\s*\(", flat)):
            name = f"{holder}#{f[1]}"
            facts.append(fact("define", name, i, kind="method", visibility="public"))
            if verb:
                facts.append(edge(name, f"route:{verb[0]} {joined(base.replace('[controller]', holder.rsplit('.', 1)[-1].removesuffix('Controller').lower()), verb[1])}", "http_in", verb[2]))
                verb = None
        if re.search(r"\bstatic\s+(?:async\s+)?(?:void|int|Task(?:<int>)?)\s+Main\s*\(", flat):
            facts.append(edge(holder, "process:" + (primary or holder), "process_boundary", i))
        if m := re.search(r"DbSet<\s*([\w.]+)\s*>", line):
            facts.append(edge(holder, "entity:" + m[1].rsplit(".", 1)[-1], "persist", i))
        for _ in range(flat.count("{")):
            depth += 1
            if waiting:
                stack.append((waiting[0], depth))
                waiting = None
        for _ in range(flat.count("}")):
            if stack and stack[-1][1] == depth:
                stack.pop()
            depth -= 1
        if waiting and (i - waiting[1] > 15 or flat.rstrip().endswith(";")):
            waiting = None
    primary = primary or space or path
    return {"package": space, "primary": primary}, [*facts, *import_facts(primary, imports, 2), *[fact("use", n, i) for n, i in imports]]


def scala(path: str, lines: list[str]):
    lines = without_comments(lines)
    package = next((m[1] for x in lines if (m := re.match(r"\s*package\s+([\w.]+)", x))), "")
    imports, facts, primary = [], [], None
    for i, line in enumerate(lines, 1):
        if m := re.match(r"\s*import\s+(\w+(?:\.\w+)*?)(?:\.\{([^}]*)\}|\._)?\s*$", line):
            if m[2]:
                imports += [(f"{m[1]}.{x.split('=>')[0].strip()}", i) for x in m[2].split(",") if x.strip()]
            else:
                imports.append((m[1], i))
        if m := re.match(r"\s*((?:(?:private|protected|final|sealed|abstract|case|implicit)\s+)*)(class|object|trait)\s+(\w+)", line):
            fqn = f"{package}.{m[3]}" if package else m[3]
            facts.append(fact("define", fqn, i, kind=m[2], visibility=next((v for v in ("private", "protected") if v in m[1]), "public")))
            primary = primary or fqn
            if "extends App" in line:
                facts.append(edge(fqn, "process:" + fqn, "process_boundary", i))
    primary = primary or package or path
    return {"package": package, "primary": primary}, [*facts, *import_facts(primary, imports), *[fact("use", n, i) for n, i in imports]]


def sql(path: str, lines: list[str]):
    name = path.rsplit("/", 1)[-1]
    owner = f"migration:{name}" if re.match(r"[VUR][\w.]*__", name) else f"sql:{path}"
    facts, seen = [], set()
    rules = ((r"\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?", "schema_own"), (r"\bALTER\s+TABLE\s+", "schema_own"), (r"\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+\S+\s+ON\s+", "schema_own"), (r"\bINSERT\s+INTO\s+", "persist"))
    for i, line in enumerate(lines, 1):
        for rule, channel in rules:
            for m in re.finditer(rule + r"[`\"\[]?([A-Za-z_][\w.]*)", line, re.I):
                table = m[1].lower()
                if (table, channel) not in seen:
                    seen.add((table, channel))
                    facts.append(edge(owner, "table:" + table, channel, i))
                    if "TABLE" in m[0].upper() and "CREATE" in m[0].upper():
                        facts.append(fact("define", "table:" + table, i, kind="table", visibility="public"))
    return {"package": "", "primary": owner}, facts


def docker(path: str, lines: list[str]):
    unit = path.rsplit("/", 1)[0] if "/" in path else "root"
    facts = []
    for i, line in enumerate(lines, 1):
        if m := re.match(r"\s*(ENTRYPOINT|CMD)\s+(.*)", line, re.I):
            facts.append(fact("define", f"process:{unit}", i, kind="config_key", visibility="public", value=m[2].strip()[:200]))
            facts.append(edge(unit, f"process:{unit}", "process_boundary", i))
        elif m := re.match(r"\s*EXPOSE\s+(\d+)", line, re.I):
            facts.append(edge(unit, f"port:{m[1]}", "http_in", i))
        elif m := re.match(r"\s*(?:ENV|ARG)\s+(\w+)", line, re.I):
            facts.append(edge(unit, f"config:{m[1]}", "config_read", i))
        elif m := re.match(r"\s*FROM\s+(\S+)", line, re.I):
            facts.append(fact("dep", m[1], i))
    return {"package": "", "primary": f"process:{unit}"}, facts


def config(path: str, lines: list[str]):
    yaml, facts, stack = path.endswith((".yml", ".yaml")), [], []
    owner = f"config-file:{path}"
    for i, line in enumerate(lines, 1):
        if line.strip().startswith(("#", ";", "//", "!")):
            continue
        if m := re.match(r"(\s*)(?:export\s+)?([A-Za-z_][\w.\-]*)\s*[:=]\s*(.*)$", line):
            key = m[2]
            if yaml:
                stack = [*stack[: len(m[1]) // 2], key]
                key = ".".join(stack)
            if m[3].strip() or not yaml:
                facts.append(fact("define", f"config:{key}", i, kind="config_key", visibility="public", value=m[3].strip().strip("'\"")[:200]))
                facts.append(edge(owner, f"config:{key}", "config_read", i))
    return {"package": "", "primary": owner}, facts


GRADLE_DEP = re.compile(r"^\s*(?:api|implementation|compile|compileOnly|runtime|runtimeOnly|annotationProcessor|test\w*)\b[\s(]+(.*)$")


def build(path: str, lines: list[str]):
    name, facts = path.rsplit("/", 1)[-1], []
    text = "\n".join(lines)
    if name.startswith("settings.gradle"):
        for i, line in enumerate(lines, 1):
            if m := re.search(r"rootProject\.name\s*=\s*['\"]([^'\"]+)", line):
                facts.append(fact("define", "build:rootProject.name", i, kind="config_key", visibility="public", value=m[1]))
                facts.append(fact("note", "root_project_name=" + m[1], i))
    elif name.startswith("build.gradle"):
        for i, line in enumerate(lines, 1):
            if m := GRADLE_DEP.match(line):
                p = re.search(r"project\(\s*(?:path:\s*)?['\"]:?([^'\"]+)", m[1])
                d = p or re.search(r"['\"]([^'\"]+)['\"]", m[1])
                if d:
                    facts.append(fact("dep", d[1].replace(":", "/") if p else d[1], i))
    elif name == "pom.xml":
        found = [(m[1], text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"<artifactId>\s*([^<\s]+)\s*</artifactId>", text)]
        facts += [fact("note", "artifact=" + found[0][0], found[0][1])] if found else []
        facts += [fact("dep", n, i) for n, i in found[1:]]
    elif name == "package.json":
        try:
            data = json.loads(text)
        except ValueError:
            return {"package": "", "primary": path}, [fact("note", "malformed", 1)]
        if data.get("name"):
            facts.append(fact("note", "artifact=" + data["name"], 1))
        facts += [fact("dep", d, 1) for k in ("dependencies", "devDependencies", "peerDependencies") for d in data.get(k) or {}]
    elif name == "go.mod":
        for i, line in enumerate(lines, 1):
            if m := re.match(r"module\s+(\S+)", line):
                facts.append(fact("note", "artifact=" + m[1], i))
            elif m := re.match(r"\s*(?:require\s+)?([\w.\-]+(?:/[\w.\-]+)+)\s+v\S+", line):
                facts.append(fact("dep", m[1], i))
    else:
        section = ""
        for i, line in enumerate(lines, 1):
            if m := re.match(r"\s*\[+([^\]]+)\]", line):
                section = m[1]
            elif section.endswith("dependencies") and (m := re.match(r"\s*[\"']?([A-Za-z0-9_.\-]+)[\"']?\s*=", line)):
                facts.append(fact("dep", m[1], i))
            elif section in ("project", "package") and (m := re.match(r"\s*name\s*=\s*[\"']([^\"']+)", line)):
                facts.append(fact("note", "artifact=" + m[1], i))
    return {"package": "", "primary": path}, facts


def toml(path: str, lines: list[str]):
    """A manifest by its name, else configuration like any other."""
    return (build if path.rsplit("/", 1)[-1] in ("pyproject.toml", "Cargo.toml") else config)(path, lines)


def generic(path: str, lines: list[str]):
    return {"package": "", "primary": path}, []


BY_LANGUAGE = {
    "java": java, "python": python, "javascript": javascript, "typescript": javascript, "go": go, "csharp": csharp, "scala": scala,
    "sql": sql, "docker": docker, "properties": config, "yaml": config, "ini": config, "env": config,
    "gradle": build, "maven": build, "npm": build, "gomod": build, "toml": toml,
}


def extract(path: str, language: str, lines: list[str]):
    """(header, facts) of a file; an error becomes a note."""
    try:
        return BY_LANGUAGE.get(language, generic)(path, lines)
    except Exception as why:  # one file must not end a run over all
        return {"package": "", "primary": path}, [fact("note", f"extractor_error:{type(why).__name__}: {why}", 1)]
