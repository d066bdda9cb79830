"""Source code: symbols, imports, calls, inheritance and complexity, and what is counted and drawn from them.

Python is parsed with its own grammar, languages with braces by ``lexer``, others by patterns of their declarations. A file is parsed on
its own, in Arrow batches; everything else is relational.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.classify import is_minified
from marlstone.operators import lexer
from marlstone.plans.deal import dealt
from marlstone.plans.stash import Stash

SYMBOLS = "kind string, name string, qualified string, line int, end_line int, signature string, doc string, complexity int, methods int"
IMPORTS = "module string, name string, line int"
CALLS = "caller string, callee string, line int"
INHERITS = "class string, base string, line int"

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_ONE = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension))
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue, ast.alias, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal))
_COMPOUND = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match, ast.ExceptHandler, ast.match_case))
#: Values of fields below which there is nothing, and fields that hold only such.
_ENDS = _LEAVES | {str, int, bool, type(None)}
_BARE = frozenset("ctx op ops id attr arg type_comment kind names module level is_async simple tag rest kwd_attrs conversion".split())
#: Fields that hold statements, in the order of the grammar.
_BLOCKS = ("body", "handlers", "cases", "orelse", "finalbody")
#: Characters of a file above which it is parsed in pieces.
PIECE = 1 << 18
_CUT = re.compile(r"^(?!(?:else|elif|except|finally|case)\b)[^\W\d]|^@", re.M)


def pieces(code: str, size: int = PIECE) -> Iterator[tuple[ast.Module, int]]:
    """The parts of a file of which none has many more characters than ``size``, and the lines before each.

    A part ends before a line that begins a statement; where it can't be parsed alone (a text or a bracket
    goes on, say), it is taken with as much again of what follows. What can't be parsed to the end raises SyntaxError.
    """
    at, line = 0, 0
    while at < len(code) or not at:
        room = size
        while True:
            cut = _CUT.search(code, at + room) if at + room < len(code) else None
            end = cut.start() if cut else len(code)
            try:
                tree = ast.parse(code[at:end] if at or cut else code)
                break
            except SyntaxError:
                if end == len(code):
                    raise
            room *= 2
        yield tree, line
        line += code.count("\n", at, end)
        at = end
        if not at:
            return


class _Fields(dict):
    """By kind of node, its fields that can hold nodes with children."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = tuple(f for f in kind._fields if f not in _BARE)
        return self[kind]


_FIELDS = _Fields()


def _children(node: ast.AST) -> Iterator[ast.AST]:
    """As ``ast.iter_child_nodes``, without names, constants and other nodes that have no children."""
    for name in _FIELDS[node.__class__]:
        x = getattr(node, name, None)
        kind = x.__class__
        if kind is list:
            for y in x:
                if y.__class__ not in _ENDS:
                    yield y
        elif kind not in _ENDS:
            yield x


def _weight(node: ast.AST) -> int:
    kind = type(node)
    if kind in _ONE:
        return 1
    if kind is ast.BoolOp:
        return len(node.values) - 1
    return len(node.cases) if kind is ast.Match else 0


def complexity(node: ast.AST, known: dict[ast.AST, int] | None = None) -> int:
    """One and a branch each: conditions, loops, handlers, contexts, further operands of and / or, cases.

    ``known`` are the figures of definitions within, so that none is walked twice.
    """
    n, todo = 1, [node]
    while todo:
        x = todo.pop()
        if known and x in known:
            n += known[x] - 1
            continue
        n += _weight(x)
        for name in _FIELDS[x.__class__]:
            y = getattr(x, name, None)
            kind = y.__class__
            if kind is list:
                for z in y:
                    if z.__class__ not in _ENDS:
                        todo.append(z)
            elif kind not in _ENDS:
                todo.append(y)
    return n


def statements(node: ast.AST) -> Iterator[ast.stmt]:
    """All statements below a node, but not what stands within definitions: only statements hold statements."""
    for name in _BLOCKS:
        for x in getattr(node, name, ()):
            yield x
            if x.__class__ in _COMPOUND:
                yield from statements(x)


def _walk(node: ast.AST, above: tuple[str, ...] = (), in_class: bool = False):
    for x in statements(node):
        if isinstance(x, _DEFINITIONS):
            yield x, above, in_class
            yield from _walk(x, (*above, x.name), isinstance(x, ast.ClassDef))


def _name(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_name(node.value)}.{node.attr}".lstrip(".")
    if isinstance(node, ast.Subscript):
        return _name(node.value)
    return ""


def python_symbols(code: str) -> list[tuple]:
    out = []
    for tree, line in pieces(code):
        found = list(_walk(tree))
        known: dict[ast.AST, int] = {}
        for x, _, _ in reversed(found):  # the inner ones first
            known[x] = complexity(x, known)
        for x, above, in_class in found:
            is_class = isinstance(x, ast.ClassDef)
            methods = sum(isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) for m in x.body) if is_class else 0
            signature = f"class {x.name}" if is_class else f"{'async ' * isinstance(x, ast.AsyncFunctionDef)}def {x.name}({_arguments(x.args)})"
            kind = "class" if is_class else "method" if in_class else "function"
            out.append((kind, x.name, ".".join((*above, x.name)), x.lineno + line, x.end_lineno + line, signature, ast.get_docstring(x), known[x], methods))
    return out


def _arguments(args: ast.arguments) -> str:
    """As ``ast.unparse``, which is slow, writes them; plain names are joined here."""
    plain = not (args.posonlyargs or args.vararg or args.kwonlyargs or args.kwarg or args.defaults)
    if plain and all(a.annotation is None for a in args.args):
        return ", ".join(a.arg for a in args.args)
    return ast.unparse(args)


def every_statement(code: str) -> Iterator[tuple[ast.stmt, int]]:
    """Each statement of a file at any depth, with the lines before its piece."""
    for tree, line in pieces(code):
        todo = [tree]
        while todo:
            for x in statements(todo.pop()):
                yield x, line
                if isinstance(x, _DEFINITIONS):
                    todo.append(x)


def python_imports(code: str) -> list[tuple]:
    out = []
    for x, line in every_statement(code):
        if isinstance(x, ast.Import):
            out += [(a.name, None, x.lineno + line) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out += [("." * x.level + (x.module or ""), a.name, x.lineno + line) for a in x.names]
    return sorted(out, key=lambda r: (r[2], r[0], r[1] or ""))


def python_calls(code: str) -> list[tuple]:
    """Calls by name from each function; those outside of any have the caller <module>."""
    out = []

    def visit(node: ast.AST, caller: str, line: int) -> None:
        for x in _children(node):
            if isinstance(x, _DEFINITIONS):
                visit(x, x.name if caller == "<module>" else f"{caller}.{x.name}", line)
                continue
            if isinstance(x, ast.Call) and (name := _name(x.func)):
                out.append((caller, name, x.lineno + line))
            visit(x, caller, line)

    for tree, line in pieces(code):
        visit(tree, "<module>", line)
    return out


def python_inherits(code: str) -> list[tuple]:
    out = []
    for tree, line in pieces(code):
        out += [(".".join((*above, x.name)), _name(b), x.lineno + line) for x, above, _ in _walk(tree) if isinstance(x, ast.ClassDef) for b in x.bases if _name(b)]
    return out


#: Declarations of languages without braces: (kind, pattern with the name in its last group).
DECLARATIONS = {"ruby": (("class", r"^\s*(?:class|module)\s+(\w+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)"))}
_KEYWORDS = set("if for while switch catch return else new sizeof do".split())
_BRANCH_WORDS = re.compile(r"\b(?:if|for|while|case|catch|elif|elsif|unless|when)\b|&&|\|\||\?(?=[^?.:])")


def pattern_symbols(code: str, language: str) -> list[tuple]:
    """Declarations of other languages by line; what one spans lasts to the next one of its file."""
    lines = code.split("\n")
    found = []
    for i, line in enumerate(lines):
        for kind, pattern in DECLARATIONS.get(language, ()):
            m = re.match(pattern, line)
            if m and m[1] not in _KEYWORDS:
                found.append((i, kind, m[1], line.strip().rstrip("{").strip()))
                break
    out, top = [], ""
    for n, (i, kind, name, signature) in enumerate(found):
        end = found[n + 1][0] if n + 1 < len(found) else len(lines)
        while end > i + 1 and not lines[end - 1].strip():
            end -= 1
        top = name if kind == "class" else top
        qualified = f"{top}.{name}" if kind == "method" and top else name
        score = 1 + len(_BRANCH_WORDS.findall("\n".join(lines[i:end])))
        out.append((kind, name, qualified, i + 1, end, signature, None, score, 0))
    return out


#: Rows of a batch that ``parsed`` hands on.
ROWS = 50_000


def parsed(files: DataFrame, schema: str, parse: Callable[[str, str], list[tuple]]) -> DataFrame:
    """(path, ...) rows of ``parse(content, language)`` of files (path, language, content); files that can't be parsed give none.

    Files are dealt out by their paths first, as a small table can hold very many in one partition.
    """
    kinds = [("path", pa.string())] + [(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in schema.split(", ")]
    out_schema = pa.schema(kinds)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, language, content in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content"))):
                try:
                    out += [(path, *r) for r in parse(content or "", language or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
                while len(out) >= ROWS:
                    yield batch(out[:ROWS])
                    out = out[ROWS:]
            if out:
                yield batch(out)

    return dealt(files.select("path", "language", "content"), "path").mapInArrow(run, f"path string, {schema}")


def symbols(files: DataFrame) -> DataFrame:
    """Of Python by its grammar, of languages with braces by their tokens and scopes, of others by patterns."""

    def find(code: str, language: str) -> list[tuple]:
        if language == "python":
            return python_symbols(code)
        return lexer.read(code, language).symbols if language in lexer.LANGUAGES else pattern_symbols(code, language)

    return parsed(files, SYMBOLS, find)


def imports(files: DataFrame) -> DataFrame:
    """Of Python by its grammar, of others by import, require, use and include."""

    def find(code: str, language: str) -> list[tuple]:
        if language == "python":
            return python_imports(code)
        pattern = r"""(?:import\s+(?:[\w*{}\s,$]+\s+from\s+)?|require\(|#include\s*)["'<]([^"'>]+)["'>]|^\s*(?:import(?:\s+static)?|use|using)\s+([\w.:\\]+)"""
        return [(m[1] or m[2], None, i + 1) for i, line in enumerate(code.split("\n")) for m in re.finditer(pattern, line)]

    return parsed(files, IMPORTS, find)


def calls(files: DataFrame) -> DataFrame:
    """Of Python and of languages with braces; those outside of any function have the caller <module>."""
    some = files.where(F.col("language").isin("python", *sorted(lexer.LANGUAGES)))
    return parsed(some, CALLS, lambda code, language: python_calls(code) if language == "python" else lexer.read(code, language).calls)


def inherits(files: DataFrame) -> DataFrame:
    """Classes and their bases, of Python and of languages with braces."""
    some = files.where(F.col("language").isin("python", *sorted(lexer.LANGUAGES)))
    return parsed(some, INHERITS, lambda code, language: python_inherits(code) if language == "python" else lexer.read(code, language).bases)


def statistics(files: DataFrame, found: DataFrame) -> DataFrame:
    """(language, files, lines, functions, classes, complexity, mean_complexity, most_complex) of files (path, language, content) and their symbols."""
    lines = F.size(F.split("content", "\n", -1))
    each = files.select("path", F.coalesce("language", F.lit("unknown")).alias("language"), F.when(F.col("content") == "", 0).otherwise(lines).alias("lines"))
    per = found.groupBy("path").agg(F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.sum(F.when(F.col("kind") != "class", F.col("complexity"))).alias("complexity"))
    zero = F.lit(0).cast("long")
    rows = each.join(per, "path", "left").withColumns({c: F.coalesce(c, zero) for c in ("functions", "classes", "complexity")})
    return rows.groupBy("language").agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("functions").alias("functions"), F.sum("classes").alias("classes"),
        F.sum("complexity").alias("complexity"), F.round(F.avg("complexity"), 2).alias("mean_complexity"), F.max("complexity").alias("most_complex"),
    )


def smells(found: DataFrame, lines: int = 100, methods: int = 20, complex_: int = 20, very: int = 30) -> DataFrame:
    """(path, smell, severity, symbol, line): long functions, classes with many methods, files of high complexity with their worst symbol."""
    found = Stash(found.sparkSession).put(found)  # else each of the three reads the files again
    function = F.col("kind").isin("function", "method")
    long = found.where(function & (F.col("end_line") - F.col("line") > lines)).select("path", F.lit("long_function").alias("smell"), F.lit("medium").alias("severity"), F.col("name").alias("symbol"), "line")
    wide = found.where((F.col("kind") == "class") & (F.col("methods") > methods)).select("path", F.lit("complex_class").alias("smell"), F.lit("medium").alias("severity"), F.col("name").alias("symbol"), "line")
    worst = F.max_by(F.struct("name", "line"), F.struct(F.when(F.col("complexity") > 15, F.col("complexity")).otherwise(0), F.col("end_line") - F.col("line"), -F.col("line")))
    per = found.where(function).groupBy("path").agg(F.sum("complexity").alias("c"), worst.alias("w")).where(F.col("c") > complex_)
    shown = F.when(~(is_minified(F.col("path")) & (F.length("w.name") == 1)), F.col("w.name"))
    high = per.select("path", F.lit("high_complexity").alias("smell"), F.when(F.col("c") > very, "high").otherwise("medium").alias("severity"), shown.alias("symbol"), F.col("w.line").alias("line"))
    return long.unionByName(wide).unionByName(high)


CREATE_TABLE = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"']?(\w+)[`\"']?"
TABLE_NAME = r"""__tablename__\s*=\s*["'](\w+)["']"""
ENTITY = r"""@(?:Table|Entity)\s*\(\s*(?:name\s*=\s*)?["'](\w+)["']"""


def database_tables(files: DataFrame) -> DataFrame:
    """(path, table) that files create or map; temporary ones are left out."""
    content = F.coalesce("content", F.lit(""))
    found = F.when(F.lower("path").endswith(".sql"), F.regexp_extract_all(content, F.lit(CREATE_TABLE), F.lit(1)))
    found = found.when(F.col("language") == "python", F.regexp_extract_all(content, F.lit(TABLE_NAME), F.lit(1)))
    found = found.when(F.col("language").isin("java", "javascript", "typescript"), F.regexp_extract_all(content, F.lit(ENTITY), F.lit(1)))
    return files.select("path", F.explode(F.array_distinct(found)).alias("table")).where(~F.lower("table").rlike("^(temp|tmp)_"))


# Words of imports and settings that name an outside service.
SERVICES = {
    "mysql": "MySQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mongodb": "MongoDB", "redis": "Redis", "elasticsearch": "Elasticsearch",
    "opensearch": "OpenSearch", "kafka": "Kafka", "rabbitmq": "RabbitMQ", "zookeeper": "Zookeeper", "nacos": "Nacos", "consul": "Consul", "etcd": "etcd",
    "minio": "MinIO", "s3": "AWS S3", "dynamodb": "DynamoDB", "cassandra": "Cassandra", "memcached": "Memcached", "nginx": "Nginx", "apache": "Apache",
    "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "celery": "Celery", "ollama": "Ollama",
}


def outside_services(found: DataFrame) -> DataFrame:
    """(service, files) by words of imported modules (path, module)."""
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.lower("module").contains(w), F.lit(s)) for w, s in SERVICES.items()])))
    rows = found.select("path", F.explode(hits).alias("service")).distinct()
    return rows.groupBy("service").agg(F.count("*").alias("files"))


ENDPOINT = r"(?m)^\s*@(?:\w+\.)?(?:get|post|put|delete|patch|route|api_route|websocket|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\s*\("
ROUTE = r"""(?:path\s*:\s*["']|<Route\s)"""


def endpoints(files: DataFrame) -> DataFrame:
    """(path, side, n): handlers of back-end files and routes of front-end router files; others are left out."""
    content = F.coalesce("content", F.lit(""))
    front = F.col("language").isin("javascript", "typescript") & F.lower("path").rlike("rout")
    back = F.regexp_count(content, F.lit(ENDPOINT))
    n = F.when(front, F.regexp_count(content, F.lit(ROUTE))).when(F.col("language").isin("python", "java"), back)
    return files.select("path", F.when(front, "frontend").otherwise("backend").alias("side"), n.alias("n")).where("n > 0")


def module_of(path: Column, levels: int = 2) -> Column:
    """The first folders of a path; files outside of any are in root."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(levels)))
    return F.when(F.size(parts) > 1, F.array_join(folders, "/")).otherwise("root")


def modules(files: DataFrame, found: DataFrame) -> DataFrame:
    """(module, files, lines, symbols, languages) of folders of two levels."""
    lines = F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n", -1)))
    n = found.groupBy("path").agg(F.count("*").alias("n"))
    rows = files.withColumn("lines", lines).join(n, "path", "left")
    out = rows.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.array_sort(F.collect_set("language")).alias("languages"))
    return out


#: Extensions that a local import may leave out.
SUFFIXES = (".py", ".js", ".ts", ".jsx", ".tsx")


def _normal(path: Column) -> Column:
    """Without . and with .. resolved, by a fold over its parts."""
    step = lambda a, p: F.when((p == ".") | (p == ""), a).when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of imports that name a file of the same set: relative ones from their own folder, others as paths; packages from outside have none."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    relative = F.col("module").rlike(r"^\.")
    python = F.col("module").rlike(r"^\.+[\w.]*$") & ~F.col("module").contains("/")
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    up = F.expr("repeat('../', greatest(length(regexp_extract(module, '^([.]+)', 1)) - 1, 0))")
    local = F.when(python, F.concat(up, F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/")))).otherwise(F.col("module"))
    base = F.when(relative, _normal(F.concat_ws("/", folder, local))).when(F.col("module").contains("/"), _normal(F.col("module")))
    names = F.transform(F.array(F.lit(""), *map(F.lit, SUFFIXES)), lambda s: F.concat(base, s))
    rows = found.where(dots.isNotNull()).select(F.col("path").alias("src"), F.posexplode(names).alias("rank", "dst"), "module")
    hits = rows.join(files.select(F.col("path").alias("dst")), "dst")
    one = F.row_number().over(Window.partitionBy("src", "module").orderBy("rank"))
    return hits.withColumn("_n", one).where("_n = 1").select("src", "dst").where("src != dst").distinct()


def module_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, n) of imports between modules of two folder levels, not within one."""
    rows = edges.select(module_of(F.col("src")).alias("src"), module_of(F.col("dst")).alias("dst")).where("src != dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _pieces(text: Column) -> Column:
    """All runs of one to three characters, each once."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: text.substr(i, F.lit(n)))

    return F.array_distinct(F.concat(*map(runs, (1, 2, 3))))


def matched_modules(found: DataFrame, names: DataFrame) -> DataFrame:
    """(module, matched): the known module (name, rank) that an import begins with or holds; else that its first part belongs to; the first by rank.

    What holds a text holds its first three characters, so texts meet by these and are compared then.
    """
    plain = F.regexp_replace("module", r"^[./]+", "")
    rows = found.select("module").distinct().withColumn("_p", plain).withColumn("_f", F.split_part(plain, F.lit("/"), F.lit(1)))
    start = lambda c: F.substring(c, 1, 3)
    holds = rows.select("module", "_p", F.explode(_pieces(F.col("_p"))).alias("_g")).join(names.where("name != ''").withColumn("_g", start("name")), "_g")
    holds = holds.where(F.col("_p").contains(F.col("name"))).select("module", "name", "rank", F.lit(1).alias("_t"))
    parts = names.select("name", "rank", F.explode(_pieces(F.col("name"))).alias("_g"))
    within = rows.where("_f != ''").withColumn("_g", start("_f")).join(parts, "_g").where(F.col("name").contains(F.col("_f")))
    pairs = holds.unionByName(within.select("module", "name", "rank", F.lit(2).alias("_t")))
    best = pairs.groupBy("module").agg(F.min_by("name", F.struct("_t", "rank")).alias("matched"))
    return rows.select("module").join(best, "module", "left")


def architecture(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, confidence) that a set of files shows: model-view-controller, layers, services of their own, a service layer."""
    low = F.lower("path")
    some = lambda *words: F.coalesce(F.bool_or(reduce(lambda a, b: a | b, [low.contains(w) for w in words])), F.lit(False))
    seen = files.agg(some("model").alias("m"), some("view", "component").alias("v"), some("controller", "route").alias("c"), some("api", "route").alias("api"), some("service").alias("s"), some("model", "dao", "repository", "storage").alias("data"))
    out_degree = module_edges(edges).groupBy(F.col("src").alias("module")).agg(F.count("*").alias("n"))
    per = files.select(module_of(F.col("path")).alias("module")).distinct().join(out_degree, "module", "left")
    own = per.agg(F.count("*").alias("modules"), F.count_if(F.coalesce("n", F.lit(0)) < 2).alias("alone"))
    one = seen.join(F.broadcast(own))  # one row each
    names = [("mvc", "high", F.col("m") & F.col("v") & F.col("c")), ("layered", "high", F.col("api") & F.col("s") & F.col("data")), ("microservices", "medium", (F.col("modules") > 5) & (F.col("alone") > 3)), ("service_layer", "high", F.col("s"))]
    found = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("confidence"))) for p, c, holds in names]))
    return one.select(F.explode(found).alias("p")).select("p.*")


def references(found: DataFrame, uses: DataFrame, name: str, path: str) -> DataFrame:
    """(path, line) where a symbol is used: calls of its name or qualified name, without its own file's definition line, each once."""
    own = found.where((F.col("path") == path) & ((F.col("name") == name) | (F.col("qualified") == name)))
    own = own.select(F.col("name").alias("last"), "qualified", F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    rows = uses.withColumn("last", F.substring_index("callee", ".", -1)).join(own, "last")
    dotted = (F.col("callee") == F.col("last")) | (F.col("callee") == F.col("qualified")) | F.col("callee").endswith(F.concat(F.lit("."), F.col("last")))
    return rows.where(dotted & ((F.col("path") != F.col("def_path")) | (F.col("line") != F.col("def_line")))).select("path", "line").distinct()


def compact(content: Column, most: int = 2000) -> Column:
    """What of a file is embedded: doc strings, up to 20 comments, 30 imports and 50 definitions; with little of these also its first 3000 characters."""
    lines = lambda p, n: F.slice(F.regexp_extract_all(content, F.lit(p), F.lit(0)), 1, n)
    docs = F.regexp_extract_all(content, F.lit(r'(?s)"""(.*?)"""'), F.lit(1))
    parts = F.concat(docs, lines(r"(?m)^[ \t]*(?:#|//).*$", 20), lines(r"(?m)^[ \t]*(?:import|from|using|use|#include)\b.*$", 30), lines(r"(?m)^[ \t]*(?:async\s+)?(?:def|class|func|function|fn|public|private|interface)\b.*$", 50))
    text = F.array_join(F.transform(parts, F.trim), "\n")
    text = F.when(F.length(text) < 200, F.concat_ws("\n", F.when(text != "", text), F.substring(content, 1, 3000))).otherwise(text)
    cut = F.substring(text, 1, most)
    at_line = F.regexp_replace(cut, r"\n[^\n]*$", "")
    return F.when(F.length(text) <= most, text).when(F.length(at_line) > most * 0.8, at_line).otherwise(cut)
