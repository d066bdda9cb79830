"""Code, each as one query; files are made of rows, so SQL knows what their symbols are."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import classify as C
from marlstone.operators import code as K
from marlstone.operators import relational
from marlstone.operators import names as N
from marlstone.registry import customer, nation, part, query, region

_BODY = '''"""Module {p}."""
import os, kafka.client
from .m{q} import run as go


class C{p}(Base{r}, abc.ABC):
    """Class doc."""

    def run(self, a, *, b=1):
        if a and b:
            return helper(a)
        for x in a:
            go(x)

    async def stop(self): pass


def helper(x):
'''


def code_files(spark, d):
    """One Python file for each part, in 10 folders; its last function has p_size lines and, for large parts, as many conditions."""
    p = F.col("p_partkey")
    text = F.lit(_BODY)
    for mark, value in (("{p}", p), ("{q}", p % 7), ("{r}", p % 3)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    body = F.concat(text, F.expr("repeat({}, p_size)".format("case when p_partkey % 2 = 0 then '    x += 1\\n' else '    if x: x += 1\\n' end")), F.lit("    return x\n"))
    path = F.concat(F.lit("pkg"), p % 5, F.lit("/"), F.when(p % 2 == 0, "models").otherwise("views"), F.lit("/m"), p, F.lit(".py"))
    return part(spark, d).select("p_partkey", path.alias("path"), F.lit("python").alias("language"), body.alias("content"))


_PATH = "'pkg' || p_partkey % 5 || '/' || case when p_partkey % 2 = 0 then 'models' else 'views' end || '/m' || p_partkey || '.py'"
_HELPER = "case when p_partkey % 2 = 0 then 1 else 1 + p_size end"


@query(f"""with f as (select *, {_PATH} as path, {_HELPER} as h from part)
select path, 'class' as kind, 'C' || p_partkey as qualified, 6 as line, 15 as end_line, 'class C' || p_partkey as signature, 'Class doc.' as doc, 4 as complexity, 2 as methods from f
union all select path, 'method', 'C' || p_partkey || '.run', 9, 13, 'def run(self, a, *, b=1)', null, 4, 0 from f union all select path, 'method', 'C' || p_partkey || '.stop', 15, 15, 'async def stop(self)', null, 1, 0 from f
union all select path, 'function', 'helper', 18, 19 + p_size, 'def helper(x)', null, h, 0 from f""")
def code_symbols(spark, d):
    """Classes, methods and functions with their lines, signatures and complexity."""
    return K.symbols(code_files(spark, d)).drop("name")


@query(f"select {_PATH} as path, unnest(['os', 'kafka.client', '.m' || p_partkey % 7]) as module, unnest([null, null, 'run']) as name, unnest([2, 2, 3]) as line from part")
def code_imports(spark, d):
    return K.imports(code_files(spark, d))


@query(f"select {_PATH} as path, unnest(['C' || p_partkey || '.run', 'C' || p_partkey || '.run']) as caller, unnest(['helper', 'go']) as callee, unnest([11, 13]) as line from part")
def code_calls(spark, d):
    return K.calls(code_files(spark, d))


@query(f"select {_PATH} as path, 'C' || p_partkey as class, unnest(['Base' || p_partkey % 3, 'abc.ABC']) as base, 6 as line from part")
def code_inheritance(spark, d):
    return K.inherits(code_files(spark, d))


@query(f"""select 'python' as language, count(*) as files, cast(sum(20 + p_size) as bigint) as lines, cast(3 * count(*) as bigint) as functions, count(*) as classes, cast(sum(5 + {_HELPER}) as bigint) as complexity, round(avg(5 + {_HELPER}), 2) as mean_complexity, max(5 + {_HELPER}) as most_complex from part""")
def code_statistics(spark, d):
    files = code_files(spark, d)
    return K.statistics(files, K.symbols(files))


@query(f"""with f as (select *, {_PATH} as path, {_HELPER} as h from part) select path, 'long_function' as smell, 'medium' as severity, 'helper' as symbol, 18 as line from f where p_size + 1 > 40
union all select path, 'complex_class', 'medium', 'C' || p_partkey, 6 from f union all select path, 'high_complexity', case when 5 + h > 30 then 'high' else 'medium' end, case when h > 15 or p_size + 1 > 4 then 'helper' else 'run' end, case when h > 15 or p_size + 1 > 4 then 18 else 9 end from f where 5 + h > 20""")
def code_smells(spark, d):
    return K.smells(K.symbols(code_files(spark, d)), lines=40, methods=1)


@query(f"with e as (select {_PATH} as src, 'pkg' || p_partkey % 5 || '/' || case when p_partkey % 2 = 0 then 'models' else 'views' end || '/m' || p_partkey % 7 || '.py' as dst from part) select src, dst from e where dst in (select {_PATH} from part) and src <> dst")
def import_edges(spark, d):
    """Relative imports resolved to files that there are."""
    files = code_files(spark, d)
    return K.import_edges(K.imports(files), files)


_FORMS = ["./x", "../b/y", "lib/z", "react", "./", "/lib/z.ts"]


@query("""select 'a/b/f' || p_partkey || '.ts' as src, case p_partkey % 6 when 0 then 'a/b/x.ts' when 1 then 'a/b/y.js' else 'lib/z.ts' end as dst from part where p_partkey % 6 in (0, 1, 2, 5)""")
def path_imports(spark, d):
    """Imports by paths, with and without extensions; packages from outside have no edge."""
    p = part(spark, d)
    found = p.select(F.concat(F.lit("a/b/f"), "p_partkey", F.lit(".ts")).alias("path"), F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("module"))
    files = spark.sql("select explode(array('a/b/x.ts', 'a/b/x.tsx', 'a/b/y.js', 'lib/z.ts')) as path")
    return K.import_edges(found, files)


@query(f"""select m as module, count(*) as files, cast(sum(20 + p_size) as bigint) as lines, cast(4 * count(*) as bigint) as symbols, 'python' as languages from (select *, 'pkg' || p_partkey % 5 || '/' || case when p_partkey % 2 = 0 then 'models' else 'views' end as m from part) group by 1""")
def code_modules(spark, d):
    files = code_files(spark, d)
    return K.modules(files, K.symbols(files)).withColumn("languages", F.array_join("languages", ","))


@query("select 'pkg' || a.p_partkey % 5 || '/' || a.p_type as src, 'pkg' || b.p_partkey % 5 || '/' || b.p_type as dst, count(*) as n from part a join part b on b.p_partkey = a.p_partkey + 1 where a.p_partkey % 5 <> b.p_partkey % 5 or a.p_type <> b.p_type group by 1, 2")
def module_dependencies(spark, d):
    path = lambda p, t: F.concat(F.lit("pkg"), F.col(p) % 5, F.lit("/"), F.col(t), F.lit("/f"), F.col(p))
    a = part(spark, d).select("p_partkey", path("p_partkey", "p_type").alias("src"))
    b = part(spark, d).select((F.col("p_partkey") - 1).alias("p_partkey"), path("p_partkey", "p_type").alias("dst"))
    return K.module_edges(a.join(b, "p_partkey"))


_LIBRARIES = ["redis.client", "kafka", "os", "celery.app", "pymongo.mongodb", "k8s.redis"]
_SERVED = "(values (0, 'Redis'), (1, 'Kafka'), (3, 'Celery'), (4, 'MongoDB'), (5, 'Redis'), (5, 'Kubernetes')) as v(k, service)"


@query(f"select service, count(*) as files from part join {_SERVED} on k = p_size % 6 group by 1")
def outside_services(spark, d):
    """Services by what the files import, which goes by the sizes of parts; some modules name two."""
    module = F.element_at(F.array(*map(F.lit, _LIBRARIES)), (F.col("p_size") % 6 + 1).cast("int"))
    files = part(spark, d).select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(F.lit("import "), module, F.lit("\nimport sys\n")).alias("content"))
    return K.outside_services(K.imports(files))


@query("""select 's' || p_partkey || '.sql' as path, unnest(case when p_partkey % 3 = 0 then ['t' || p_partkey] when p_partkey % 3 = 1 then ['Users', 'orders'] else [] end) as "table" from part union all select 'm.py', 'users' from part where p_partkey = 1""")
def database_tables(spark, d):
    k = F.col("p_partkey") % 3
    sql = F.when(k == 0, F.concat(F.lit("create table if not exists `t"), "p_partkey", F.lit("` (id int); CREATE TEMPORARY TABLE x(a int); CREATE TABLE tmp_y(b int)"))).when(k == 1, 'CREATE TABLE "Users" (a int);\nCREATE\n TABLE orders (b int); create table orders (c int)').otherwise("select 1")
    files = part(spark, d).select(F.concat(F.lit("s"), "p_partkey", F.lit(".sql")).alias("path"), F.lit("sql").alias("language"), sql.alias("content"))
    return K.database_tables(files.unionByName(spark.sql("""select 'm.py' as path, 'python' as language, '__tablename__ = "users"' as content""")))


@query("""select 'src/a' || p_partkey || '.py' as path, 'backend' as side, p_partkey % 4 as n from part where p_partkey % 4 > 0 and p_partkey % 2 = 0 union all select 'web/router' || p_partkey || '.ts', 'frontend', p_partkey % 3 from part where p_partkey % 3 > 0 and p_partkey % 2 = 1""")
def api_endpoints(spark, d):
    p = F.col("p_partkey")
    back = F.expr("repeat('@router.get(\"/x\")\\ndef f(): pass\\n', cast(p_partkey % 4 as int))")
    front = F.expr("repeat('{ path: \"/x\", component: X },\\n', cast(p_partkey % 3 as int))")
    even = p % 2 == 0
    files = part(spark, d).select(F.when(even, F.concat(F.lit("src/a"), p, F.lit(".py"))).otherwise(F.concat(F.lit("web/router"), p, F.lit(".ts"))).alias("path"), F.when(even, "python").otherwise("typescript").alias("language"), F.when(even, back).otherwise(front).alias("content"))
    return K.endpoints(files)


_KINDS = ["models", "views", "controllers", "services", "api", "storage"]


@query("""with f as (select distinct p_size % 6 as k, 'pkg' || p_partkey % 5 as top from part where p_retailprice >= (select median(p_retailprice) from part)), a as (select bool_or(k = 0) as m, bool_or(k = 1) as v, bool_or(k = 2) as c, bool_or(k = 4) as api, bool_or(k = 3) as s, bool_or(k in (0, 5)) as d, count(*) as n from f)
select 'mvc' as pattern, 'high' as confidence from a where m and v and c union all select 'layered', 'high' from a where api and s and d union all select 'microservices', 'medium' from a where n > 5 union all select 'service_layer', 'high' from a where s""")
def architecture_patterns(spark, d):
    """Of the files of dear parts, in folders by their sizes."""
    names = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_size") % 6 + 1).cast("int"))
    dear = part(spark, d).agg(F.median("p_retailprice").alias("m"))
    some = part(spark, d).join(F.broadcast(dear), F.col("p_retailprice") >= F.col("m"))  # one row
    files = some.select(F.concat(F.lit("pkg"), F.col("p_partkey") % 5, F.lit("/"), names, F.lit("/f"), "p_partkey").alias("path"))
    return K.architecture(files, files.where("false").select(F.col("path").alias("src"), F.col("path").alias("dst")))


@query("""with n as (select 'lib/' || n_name as name, n_nationkey as rank from nation union all select r_name || '/app', r_regionkey - 100 from region), m as (select distinct './lib/' || n_name || '/' || c_mktsegment as module from customer join nation on n_nationkey = c_nationkey union select r_name from region union select 'none/' || r_name from region),
p as (select module, regexp_replace(module, '^[./]+', '') as p from m), t as (select module, name, rank, case when contains(p, name) then 1 when split_part(p, '/', 1) <> '' and contains(name, split_part(p, '/', 1)) then 2 end as t from p join n on contains(p, name) or contains(name, split_part(p, '/', 1)))
select m.module, arg_min(name, t * 1000 + rank) filter (where t is not null) as matched from m left join t using (module) group by 1""")
def imports_matched(spark, d):
    """Imports of folders named after nations and regions, and the modules that they belong to."""
    n = nation(spark, d)
    names = n.select(F.concat(F.lit("lib/"), "n_name").alias("name"), F.col("n_nationkey").cast("int").alias("rank")).unionByName(region(spark, d).select(F.concat("r_name", F.lit("/app")).alias("name"), (F.col("r_regionkey") - 100).cast("int").alias("rank")))
    found = customer(spark, d).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("./lib/"), "n_name", F.lit("/"), "c_mktsegment").alias("module"))
    tops = region(spark, d).select(F.explode(F.array("r_name", F.concat(F.lit("none/"), "r_name"))).alias("module"))
    return K.matched_modules(found.unionByName(tops), names)


@query("select 'pkg' || p_partkey % 5 || '/' || case when p_partkey % 2 = 0 then 'models' else 'views' end || '/m' || p_partkey || '.py' as path, 11 as line from part")
def symbol_references(spark, d):
    """Calls of one file's helper: here of every file, as names are not told apart by import."""
    files = code_files(spark, d)
    own = "pkg1/views/m1.py"
    return K.references(K.symbols(files.where(F.col("path") == own)), K.calls(files), "helper", own)



@query("""select 'A' || p_partkey || '.java' as path, 'class' as kind, 'A' || p_partkey as qualified, 3 as line, 1 as complexity from part where p_partkey % 2 = 0 union all select 'A' || p_partkey || '.java', 'method', 'A' || p_partkey || '.f', 4, 3 from part where p_partkey % 2 = 0
union all select 'A' || p_partkey || '.go', 'function', 'run', 1, 2 from part where p_partkey % 2 = 1""")
def pattern_symbols(spark, d):
    """Symbols of other languages by their declarations."""
    p = F.col("p_partkey")
    java = F.concat(F.lit("package x;\nimport org.y.Z;\npublic class A"), p, F.lit(" {\n  private int f(int a) {\n    if (a > 0 && a < 9) return 1;\n    return 0;\n  }\n}\n"))
    go = F.lit("func run(a int) int {\n  if a > 1 { return 2 }\n  return 1\n}\n")
    files = part(spark, d).select(F.concat(F.lit("A"), p, F.when(p % 2 == 0, ".java").otherwise(".go")).alias("path"), F.when(p % 2 == 0, "java").otherwise("go").alias("language"), F.when(p % 2 == 0, java).otherwise(go).alias("content"))
    return K.symbols(files).select("path", "kind", "qualified", "line", "complexity")


@query(f"""select {_PATH} as path, 'python' as language from part where p_partkey % 5 = 2 order by path limit 20 offset 20""")
def code_file_page(spark, d):
    """A page of the files of a repository by language."""
    files = code_files(spark, d).where("path like 'pkg2/%'").withColumn("language", C.code_language(F.col("path")))
    return relational.page(files.where("language = 'python'"), ["path"], 2, 20).select("path", "language")


@query(f"""select {_PATH} as path, 'run' as found from part order by 1 limit 15""")
def symbol_search(spark, d):
    """Symbols by a part of their names, signatures or documentation, of a kind."""
    found = K.symbols(code_files(spark, d))
    low = [F.lower(F.coalesce(c, F.lit(""))).contains("un(") for c in ("qualified", "signature", "doc")]
    return found.where((low[0] | low[1] | low[2]) & (F.col("kind") == "method")).orderBy("path").limit(15).select("path", F.col("name").alias("found"))


_BRACES = {
    "java": "package x;\n\npublic class A{p} extends Base{r} implements I{q} {\n  String s = \"} {\"; // {\n  int run(int a) {\n{body}    return go{q}(a);\n  }\n}\n",
    "javascript": "class A{p} extends Base{r} {\n  run(a) {\n    const re = /[{]/;\n{body}    return go{q}(`}${a}{`);\n  }\n}\n",
    "go": "type A{p} struct {\n\tBase{r}\n\tn int\n}\n\nfunc (x *A{p}) run(a int) int {\n{body}\treturn go{q}(a)\n}\n",
    "csharp": "namespace N {\nclass A{p} : Base{r}, I{q} {\n  string v = @\"{\"\"\";\n  int run(int a) {\n{body}    return go{q}(a);\n  }\n}\n}\n",
    "php": "<?php\n# {\nclass A{p} extends Base{r} {\n  function run($a) {\n{body}    return go{q}(\"}\");\n  }\n}\n",
}
#: By language: the line of the class and its bases, that of the method, and how many lines follow the body in method, class and file.
_LINES = [("java", 3, "['Base' || p_partkey % 3, 'I' || p_partkey % 7]", 5, 1, 2), ("javascript", 1, "['Base' || p_partkey % 3]", 2, 2, 2), ("go", 1, "['Base' || p_partkey % 3]", 6, 1, None), ("csharp", 2, "['Base' || p_partkey % 3, 'I' || p_partkey % 7]", 4, 1, 2), ("php", 3, "['Base' || p_partkey % 3]", 4, 1, 2)]


def brace_files(spark, d):
    """One file of five languages in turn for each part; its method has p_size conditions, each a block of its own line."""
    p = F.col("p_partkey")
    names = list(_BRACES)
    text = F.element_at(F.array(*[F.lit(_BRACES[x]) for x in names]), (p % 5 + 1).cast("int"))
    for mark, value in (("{p}", p), ("{q}", p % 7), ("{r}", p % 3)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    body = F.expr("repeat('    if (a > 1) { call(a); }\n', p_size)")
    content = F.replace(text, F.lit("{body}"), body)
    return part(spark, d).select(F.concat(F.lit("f"), p).alias("path"), F.element_at(F.array(*map(F.lit, names)), (p % 5 + 1).cast("int")).alias("language"), content.alias("content"))


_FILES = " union all ".join(f"select *, 'A' || p_partkey as c, {k} as class_line, {b} as bases, {m} as method_line, {a} as after, {e or 'null'} as rest from part where p_partkey % 5 = {i}" for i, (_, k, b, m, a, e) in enumerate(_LINES))


@query(f"""with f as ({_FILES}) select 'f' || p_partkey as path, 'class' as kind, c as qualified, class_line as line, case when rest is null then class_line + 3 else method_line + p_size + after + rest end as end_line, 1 as complexity, case when rest is null then 0 else 1 end as methods from f
union all select 'f' || p_partkey, 'method', c || '.run', method_line, method_line + p_size + after + 1, 1 + p_size, 0 from f""")
def brace_symbols(spark, d):
    """Classes and methods of languages with braces, with braces in strings, comments, templates and patterns."""
    return K.symbols(brace_files(spark, d)).select("path", "kind", "qualified", "line", "end_line", "complexity", "methods")


@query(f"with f as ({_FILES}) select 'f' || p_partkey as path, c || '.run' as caller, 'go' || p_partkey % 7 as callee, method_line + p_size + after as line from f union all select 'f' || p_partkey, c || '.run', 'call', method_line + case when p_partkey % 5 = 1 then 1 else 0 end + unnest(generate_series(1, p_size)) from f")
def brace_calls(spark, d):
    return K.calls(brace_files(spark, d))


@query(f"""with f as ({_FILES}) select 'f' || p_partkey as path, c as class, unnest(bases) as base from f""")
def brace_inheritance(spark, d):
    return K.inherits(brace_files(spark, d)).drop("line")


def package_files(spark, d):
    """A file for each part, which takes ``f`` of another part's file through a package that hands it on, under another name; and its own ``f``."""
    p = part(spark, d).select("p_partkey", (F.col("p_partkey") % 10).alias("k"), (F.floor(F.col("p_partkey") / 2)).alias("q"))
    text = F.concat(F.lit("from pkg.hub"), F.col("k"), F.lit(" import f"), F.col("q"), F.lit(" as other\nfrom . import m"), F.col("q"), F.lit(" as mod\n\ndef f():\n    other()\n    mod.f()\n    unknown()\n\nf()\n"))
    files = p.select(F.concat(F.lit("pkg/m"), "p_partkey", F.lit(".py")).alias("path"), text.alias("content"))
    line = F.concat(F.lit("from .deep"), F.col("k"), F.lit(" import f"), F.col("q"), F.lit("\n"))
    hubs = p.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set(line)), "").alias("content")).select(F.concat(F.lit("pkg/hub"), "k", F.lit(".py")).alias("path"), "content")
    line = F.concat(F.lit("from .m"), F.col("q"), F.lit(" import f as f"), F.col("q"), F.lit("\n"))
    deep = p.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set(line)), "").alias("content")).select(F.concat(F.lit("pkg/deep"), "k", F.lit(".py")).alias("path"), "content")
    return files.unionByName(hubs).unionByName(deep).select("path", F.lit("python").alias("language"), "content")


_RESOLVED = """with p as (select p_partkey as p, p_partkey // 2 as q from part), l as (select *, q in (select p from p) as there from p)
select 'pkg/m' || p || '.py' as path, '<module>' as caller, 'f' as callee, 9 as line, 'pkg/m' || p || '.py' as def_path, 'f' as qualified, 4 as def_line from l
union all select 'pkg/m' || p || '.py', 'f', unnest(['other', 'mod.f']), unnest([5, 6]), 'pkg/m' || q || '.py', 'f', 4 from l where there"""


@query(_RESOLVED)
def resolved_calls(spark, d):
    """Calls led through aliases, modules and two packages that hand names on, to the file that defines them: all of them are called f."""
    files = package_files(spark, d)
    return N.resolved_calls(files, K.symbols(files), K.calls(files), K.inherits(files))


@query(f"select path, line, caller from ({_RESOLVED}) where def_path = 'pkg/m3.py'")
def resolved_references(spark, d):
    """Where one file's f is called, of the many of that name."""
    files = package_files(spark, d)
    return N.references_to(N.resolved_calls(files, K.symbols(files), K.calls(files)), "pkg/m3.py", "f")
