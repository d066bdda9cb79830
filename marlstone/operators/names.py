"""What names in code stand for: imports, aliases, re-exports and stars followed to definitions, by joins.

A file binds names to names of other files or to whole files. A name that leads to another binding leads on, by
pointer doubling, so a chain of re-exports takes rounds that grow with the logarithm of its length. Calls are
then looked up in their own file, in the file that their first part stands for, and in the class
that they are called on and its bases.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.code import _normal, every_statement, parsed
from marlstone.plans.stash import Stash

BINDINGS = "local string, module string, name string"
#: Files that a module without an extension can be, the first that there is.
ENDS = {"python": (".py", "/__init__.py"), "script": ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")}
#: Rounds after which names that only lead to each other are given up: by doubling, chains of 2 ** 20.
ROUNDS = 20

_FROM = re.compile(r"\b(?:import|export)\s+(?:type\s+)?([\w$*{}\s,]+?)\s+from\s*[\"']([^\"']+)[\"']")
_STAR = re.compile(r"\bexport\s*\*\s*from\s*[\"']([^\"']+)[\"']")
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*[\"']([^\"']+)[\"']\s*\)")


def _python(code: str) -> list[tuple]:
    out = []
    for x, _ in every_statement(code):
        if isinstance(x, ast.Import):
            out += [(a.asname or a.name, a.name, None) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out += [(a.asname or a.name, "." * x.level + (x.module or ""), a.name) for a in x.names]
    return out


def _script(code: str) -> list[tuple]:
    """Named, default and star imports of modules by path, and what is exported from others; a whole module has no name."""
    out = [("*", m[1], "*") for m in _STAR.finditer(code)]
    for m in [*_FROM.finditer(code), *_REQUIRE.finditer(code)]:
        what, module = m[1], m[2]
        inner = re.search(r"\{([^}]*)\}", what)
        for part in inner[1].split(",") if inner else ():
            names = re.split(r"\s+as\s+|\s*:\s*", part.strip().removeprefix("type "))
            if names[0]:
                out.append((names[-1], module, names[0]))
        for part in re.sub(r"\{[^}]*\}", "", what).split(","):
            star = re.fullmatch(r"\*\s+as\s+([\w$]+)", part.strip())
            if star:
                out.append((star[1], module, None))
            elif part.strip() and part.strip() != "*":
                out.append((part.strip(), module, None if m.re is _REQUIRE else "default"))
    return out


def bindings(files: DataFrame) -> DataFrame:
    """(path, local, module, name) of imports of Python, JavaScript and TypeScript; without a name the whole module, * for all its names."""
    some = files.where(F.col("language").isin("python", "javascript", "typescript"))
    return parsed(some, BINDINGS, lambda code, language: _python(code) if language == "python" else _script(code)).distinct()


def _located(found: DataFrame, files: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """(path, module, file): the file of the set that a module of a file is, if there is one."""
    pairs = found.select("path", "module").distinct()
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    python = F.col("path").endswith(".py")
    up = F.expr("repeat('../', greatest(length(regexp_extract(module, '^([.]+)', 1)) - 1, 0))")
    plain = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.col("module").startswith(".")
    base = F.when(relative, F.array(_normal(F.concat_ws("/", folder, F.when(python, F.concat(up, plain)).otherwise(F.col("module"))))))
    base = base.otherwise(F.array(*[F.concat(F.lit(r), F.when(python, plain).otherwise(F.col("module"))) for r in roots]))
    ends = F.when(python, F.array(*map(F.lit, ENDS["python"]))).otherwise(F.array(*map(F.lit, ENDS["script"])))
    names = F.flatten(F.transform(base, lambda b: F.transform(ends, lambda e: F.ltrim(F.concat(b, e), F.lit("/")))))
    rows = pairs.select("path", "module", F.posexplode(names).alias("rank", "file")).join(files.select(F.col("path").alias("file")).distinct(), "file")
    return rows.groupBy("path", "module").agg(F.min_by("file", "rank").alias("file"))


def resolved_names(files: DataFrame, found: DataFrame, roots: tuple[str, ...] = ("", "src/")) -> tuple[DataFrame, DataFrame]:
    """((path, local, def_path, def_name) of names that lead to definitions, (path, local, file) of those that stand for files).

    ``found`` are the symbols. A name of a file that is also the name of a module below it is taken for both. A
    definition of the file itself comes before what it imports by the same name; names without a
    definition in the set have no row, those that lead to each other in a ring neither.
    """
    spark = files.sparkSession
    stash = Stash(spark)
    bound = stash.put(bindings(files))
    # `from . import x` can name a module
    inner = bound.where("name is not null and name != '*'").select("path", "local", F.concat("module", F.when(F.col("module").rlike(r"\.$|/$"), "").otherwise(F.when(F.col("path").endswith(".py"), ".").otherwise("/")), "name").alias("module"))
    whole = bound.where("name is null").select("path", "local", "module").unionByName(inner)
    place = stash.put(_located(bound.select("path", "module").unionByName(inner.select("path", "module")), files, roots))
    modules = whole.join(place, ["path", "module"]).select("path", "local", "file").distinct()
    defined = found.where("not contains(qualified, '.')").select("path", F.col("name").alias("local")).distinct()
    exported = files.where(F.col("language").isin("javascript", "typescript")).select("path", F.regexp_extract("content", r"\bexport\s+default\s+(?:(?:async\s+)?function\s*\*?|class)?\s*([\w$]+)", 1).alias("name"))
    exported = exported.where("name != ''").select("path", F.lit("default").alias("local"), F.col("path").alias("to"), F.col("name").alias("to_name"))
    links = bound.where("name is not null and name != '*'").join(place, ["path", "module"]).select("path", "local", F.col("file").alias("to"), F.col("name").alias("to_name"))
    links = links.unionByName(exported).join(defined, ["path", "local"], "left_anti")
    stars = bound.where("name = '*'").join(place, ["path", "module"]).select("path", F.col("file").alias("to")).where("path != to").distinct()
    links = stash.put(_with_stars(links, stars, defined, stash))
    # lead on from what is no definition, twice as far in each round
    own = defined.select(F.col("path").alias("to"), F.col("local").alias("to_name"), F.lit(True).alias("is_def"))
    now = stash.put(links.join(own, ["to", "to_name"], "left").withColumn("is_def", F.coalesce("is_def", F.lit(False))))
    for _ in range(ROUNDS):
        then = now.select(F.col("path").alias("to"), F.col("local").alias("to_name"), F.col("to").alias("to2"), F.col("to_name").alias("name2"), F.col("is_def").alias("def2"))
        on = now.where("not is_def").join(then, ["to", "to_name"])
        if on.isEmpty():
            break
        on = on.select("path", "local", F.col("to2").alias("to"), F.col("name2").alias("to_name"), F.col("def2").alias("is_def"))
        before, now = now, stash.put(now.where("is_def").unionByName(on).distinct())
        stash.drop(before)
    names = now.where("is_def").select("path", "local", F.col("to").alias("def_path"), F.col("to_name").alias("def_name")).distinct()
    return names.unionByName(defined.select("path", "local", F.col("path").alias("def_path"), F.col("local").alias("def_name"))), modules


def _with_stars(links: DataFrame, stars: DataFrame, defined: DataFrame, stash: Stash) -> DataFrame:
    """Links and those that a star makes, also of stars that reach further by stars: private names stay where they are."""
    reach = stash.put(stars)
    while not reach.isEmpty():  # pairs of files, twice as far in each round
        further = reach.join(reach.select(F.col("path").alias("to"), F.col("to").alias("to2")), "to").select("path", F.col("to2").alias("to")).where("path != to")
        more = stash.put(reach.unionByName(further).distinct())
        grown = more.count() > reach.count()
        stash.drop(reach)
        reach = more
        if not grown:
            break
    public = defined.unionByName(links.select("path", "local")).where("local not like '\\\\_%'").distinct()
    made = reach.join(public.select(F.col("path").alias("to"), "local"), "to").select("path", "local", "to", F.col("local").alias("to_name"))
    known = links.select("path", "local").unionByName(defined)
    return links.unionByName(made.join(known, ["path", "local"], "left_anti")).distinct()


def _split(name: str) -> tuple[Column, Column]:
    last = F.substring_index(name, ".", -1)
    return F.expr(f"substring({name}, 1, length({name}) - length(substring_index({name}, '.', -1)) - 1)"), last


def resolved_calls(files: DataFrame, found: DataFrame, uses: DataFrame, inherited: DataFrame | None = None, roots: tuple[str, ...] = ("", "src/")) -> DataFrame:
    """(path, caller, callee, line, def_path, qualified, def_line) of the calls whose callee has a definition in the set.

    ``found`` are symbols, ``uses`` calls and ``inherited`` classes with their bases. self.f, this.f and
    Class.f are looked up in the class, then in its bases, the nearest that has it.
    """
    stash = Stash(files.sparkSession)
    found, uses = stash.put(found), stash.put(uses)  # read many times below
    names, modules = resolved_names(files, found, roots)
    names, modules = stash.put(names), stash.put(modules)
    defs = found.select(F.col("path").alias("def_path"), "qualified", F.col("line").alias("def_line"), "kind")
    before, last = _split("callee")
    rows = uses.withColumns({"before": before, "last": last})
    out = ["path", "caller", "callee", "line", "def_path", "qualified"]
    plain = rows.where("before = ''").join(names.withColumnRenamed("local", "last"), ["path", "last"]).select(*out[:-1], F.col("def_name").alias("qualified"))
    of_module = rows.where("before != ''").join(modules.select("path", F.col("local").alias("before"), "file"), ["path", "before"])
    of_module = of_module.join(names.select(F.col("path").alias("file"), F.col("local").alias("last"), "def_path", "def_name"), ["file", "last"])
    of_module = of_module.select(*out[:-1], F.col("def_name").alias("qualified"))
    # members of classes: (path, class) they are looked up in, and the depth of the base
    own = F.col("before").isin("self", "this", "cls", "super")
    owner, _ = _split("caller")
    inside = rows.where(own & F.col("caller").contains(".")).select(*out[:4], "last", F.col("path").alias("in_path"), owner.alias("in_class"))
    named = rows.where((F.col("before") != "") & ~own).join(names.select("path", F.col("local").alias("before"), F.col("def_path").alias("in_path"), F.col("def_name").alias("in_class")), ["path", "before"])
    asked = inside.unionByName(named.select(*inside.columns)).withColumn("depth", F.lit(0))
    members = defs.where("contains(qualified, '.')").select(F.col("def_path").alias("in_path"), "qualified")
    found_in, front = None, stash.put(asked)
    bases = None
    if inherited is not None:
        b_before, b_last = _split("base")
        parts = inherited.withColumns({"before": b_before, "last": b_last})
        straight = parts.where("before = ''").join(names.withColumnRenamed("local", "last"), ["path", "last"]).select("path", "class", "def_path", "def_name")
        by_file = parts.where("before != ''").join(modules.select("path", F.col("local").alias("before"), "file"), ["path", "before"])
        by_file = by_file.join(names.select(F.col("path").alias("file"), F.col("local").alias("last"), "def_path", "def_name"), ["file", "last"]).select("path", "class", "def_path", "def_name")
        bases = stash.put(straight.unionByName(by_file).distinct().select(F.col("path").alias("in_path"), F.col("class").alias("in_class"), F.col("def_path").alias("up_path"), F.col("def_name").alias("up_class")))
    for _ in range(ROUNDS * 5):  # a level of bases each; rings of classes end here
        hit = front.withColumn("qualified", F.concat("in_class", F.lit("."), "last")).join(members, ["in_path", "qualified"], "left_semi")
        found_in = hit if found_in is None else found_in.unionByName(hit)
        if bases is None:
            break
        rest = front.withColumn("qualified", F.concat("in_class", F.lit("."), "last")).join(members, ["in_path", "qualified"], "left_anti")
        up = rest.join(bases, ["in_path", "in_class"]).select(*out[:4], "last", F.col("up_path").alias("in_path"), F.col("up_class").alias("in_class"), (F.col("depth") + 1).alias("depth"))
        front = stash.put(up.distinct())
        if front.isEmpty():
            break
    nearest = Window.partitionBy("path", "caller", "callee", "line").orderBy("depth")
    of_class = found_in.withColumn("_r", F.rank().over(nearest)).where("_r = 1").select(*out[:4], F.col("in_path").alias("def_path"), "qualified")
    every = plain.unionByName(of_module).unionByName(of_class).distinct()
    return every.join(defs.drop("kind"), ["def_path", "qualified"]).select(*out, "def_line")


def references_to(calls: DataFrame, def_path: str, qualified: str) -> DataFrame:
    """(path, line, caller) of the resolved calls of one definition, each once."""
    return calls.where((F.col("def_path") == def_path) & (F.col("qualified") == qualified)).select("path", "line", "caller").distinct()

