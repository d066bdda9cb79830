"""Braces, strings and scopes of other languages, and what names lead to."""

import pytest

from marlstone.operators import code, lexer, names

JAVA = """package x;
/** Doc of A. */
@Table(name = "t {")
public class A<T extends C<T>> extends Base<T> implements I, p.J {
    private int n = make(1); // { not a brace
    String s = "} \\" {";

    public <R> List<R> f(int a, Map<String, R> m) throws E {
        if (a > 0 && check(a)) { return this.g(x -> { return h(x); }); }
        for (R r : m.values()) { switch (a) { case 1: break; } }
        Runnable q = new Runnable() { public void run() { inner(); } };
        return null;
    }
    A(int b) { super(b); new Thing(b).go(); }
    interface In { void no(); default int yes() { return a ? b : c; } }
}
"""
SCRIPT = """/** Doc of f */
export async function f(a, b = g(1)) {
  const re = /[{]"/g;
  return `t ${ h(`{ ${i()} }`) } {` + j();
}
const k = (a) => a && l(a);
const m = async x => {
  n(() => { o(); });
}
class P extends q.R {
  t(u) { if (u) this.v(u); else super.t(u) }
  get w() { return 1 }
}
f(1).then(function () { bb() })
"""
GO = """package main
// Doc of T.
type T struct {
	Base
	*pkg.Other
	n int
}
type I interface {
	Get() int
}
func (t *T) Get(a int, b string) (int, error) {
	if a > 1 && t.ok() { // {
		go func() { t.run(`}`) }()
	}
	for _, v := range x { fmt.Println(v) }
	return helper(a), nil
}
func helper(a int) int { return a }
"""
SHARP = """namespace N.M {
  #region {
  public sealed class A : Base<int>, IThing where T : new() {
    public int P { get; set; } = Make();
    private string v = @"a ""{"" b";
    public async Task<int> RunAsync(int a) { foreach (var x in Items()) { await Do(x); } return a ?? 1; }
    public int Q(int z) => z > 0 ? One(z) : Two(z);
  }
  #endregion
}
"""
PHP = """<p>{</p><?php
# comment {
abstract class C extends D implements E, F {
  public function run(array $a): ?int { if ($a) { return $this->go($a) ?: Other::stop("}{$a['x']}"); } return null; }
  abstract protected function none();
}
function free($x) { return array_map(function ($y) { return strtoupper($y); }, $x); }
"""
RUST = """pub struct S<'a> { x: &'a str }
impl<'a> fmt::Display for S<'a> {
    fn fmt(&self, f: &mut F) -> R { match self { _ if a() => write(f, "{}"), _ => r#"}"#.into() } }
}
fn free() {}
"""
CPP = """#define M(a) do { a; } while (0)
class A : public B, private c::D {
 public:
  virtual int f(int a) const { return a ? g(a) : 0; }
  int later(int);
};
int A::later(int a) { while (a--) h->k(a); return 0; }
int main(int c, char **v) { return l('{'); }
"""

#: (kind, qualified, first line, last line, complexity), calls (caller, callee, line), bases (class, base)
WANT = {
    "java": (JAVA, [("class", "A", 4, 16, 1), ("method", "A.f", 8, 13, 5), ("function", "A.f.run", 11, 11, 1), ("method", "A.A", 14, 14, 1), ("class", "A.In", 15, 15, 1), ("method", "A.In.yes", 15, 15, 2)],
             [("<module>", "Table", 3), ("<module>", "make", 5), ("A.f", "check", 9), ("A.f", "this.g", 9), ("A.f", "h", 9), ("A.f", "m.values", 10), ("A.f", "Runnable", 11), ("A.f.run", "inner", 11), ("A.A", "Thing", 14), ("A.A", "go", 14)],
             [("A", "Base"), ("A", "I"), ("A", "p.J")]),
    "javascript": (SCRIPT, [("function", "f", 2, 5, 1), ("function", "k", 6, 6, 2), ("function", "m", 7, 9, 1), ("class", "P", 10, 13, 1), ("method", "P.t", 11, 11, 2), ("method", "P.w", 12, 12, 1)],
                   [("f", "g", 2), ("f", "j", 4), ("k", "l", 6), ("m", "n", 8), ("m", "o", 8), ("P.t", "this.v", 11), ("P.t", "super.t", 11), ("<module>", "f", 14), ("<module>", "then", 14), ("<module>", "bb", 14)], [("P", "q.R")]),
    "go": (GO, [("class", "T", 3, 7, 1), ("class", "I", 8, 10, 1), ("method", "T.Get", 11, 17, 4), ("function", "helper", 18, 18, 1)],
           [("T.Get", "t.ok", 12), ("T.Get", "t.run", 13), ("T.Get", "fmt.Println", 15), ("T.Get", "helper", 16)], [("T", "Base"), ("T", "pkg.Other")]),
    "csharp": (SHARP, [("class", "A", 3, 8, 1), ("method", "A.RunAsync", 6, 6, 2), ("method", "A.Q", 7, 7, 2)],
               [("<module>", "Make", 4), ("A.RunAsync", "Items", 6), ("A.RunAsync", "Do", 6), ("A.Q", "One", 7), ("A.Q", "Two", 7)], [("A", "Base"), ("A", "IThing")]),
    "php": (PHP, [("class", "C", 3, 6, 1), ("method", "C.run", 4, 4, 2), ("function", "free", 7, 7, 1)],
            [("C.run", "this.go", 4), ("C.run", "Other.stop", 4), ("free", "array_map", 7), ("free", "strtoupper", 7)], [("C", "D"), ("C", "E"), ("C", "F")]),
    "rust": (RUST, [("class", "S", 1, 1, 1), ("method", "S.fmt", 3, 3, 2), ("function", "free", 5, 5, 1)], [("S.fmt", "a", 3), ("S.fmt", "write", 3), ("S.fmt", "into", 3)], [("S", "Display")]),
    "cpp": (CPP, [("class", "A", 2, 6, 1), ("method", "A.f", 4, 4, 2), ("method", "A.later", 7, 7, 2), ("function", "main", 8, 8, 1)], [("A.f", "g", 4), ("A.later", "h.k", 7), ("main", "l", 8)], [("A", "B"), ("A", "c.D")]),
}


@pytest.mark.parametrize("language", sorted(WANT))
def test_scopes_calls_and_bases(language):
    text, symbols, calls, bases = WANT[language]
    got = lexer.read(text, language)
    assert [(s[0], s[2], s[3], s[4], s[7]) for s in got.symbols] == symbols
    assert got.calls == calls
    assert [(c, b) for c, b, _ in got.bases] == bases


def test_documentation_and_methods():
    a = next(s for s in lexer.read(JAVA, "java").symbols if s[1] == "A")
    assert a[6] == "Doc of A." and a[8] == 2
    assert lexer.read(GO, "go").symbols[0][6] == "Doc of T."


@pytest.mark.parametrize("language", sorted(lexer.LANGUAGES))
@pytest.mark.parametrize("text", ["", "}", "{{{", "}}}{", "class", "class {", "f(", "function", '"', "'", "`${`", "/*", "//", "a b c ( { ) }", "<?php", "@\"", "é { ü() }", "x" * 5000, "((((" * 50 + "{" * 50])
def test_broken_files_end(language, text):
    got = lexer.read(text, language)
    assert all(s[4] >= s[3] for s in got.symbols)


def test_files_are_read_in_spark(spark):
    files = spark.createDataFrame([(f"f.{k}", k, v[0]) for k, v in WANT.items()] + [("n", "java", None), ("p.py", "python", "def f(): g()")], "path string, language string, content string")
    got = code.symbols(files).collect()
    assert {(x.path, x.qualified) for x in got} == {(f"f.{k}", s[1]) for k, v in WANT.items() for s in v[1]} | {("p.py", "f")}
    assert code.calls(files).count() == sum(len(v[2]) for v in WANT.values()) + 1
    assert code.inherits(files).count() == sum(len(v[3]) for v in WANT.values())


FILES = {
    "app/a.py": "from .lib import helper as h, Base\nfrom . import tools\nimport app.b\nimport app.b as bb\nfrom app.star import *\n\ndef own():\n    h()\n    tools.saw()\n    app.b.far()\n    bb.far()\n    starred()\n    helper()\n    _private()\n\nclass D(Base):\n    def run(self):\n        self.base_method()\n        self.run()\n        D.static()\n    def static(): own()\n",
    "app/lib/__init__.py": "from .inner import helper, Base\n",
    "app/lib/inner.py": "from ..deep import helper\nfrom .root import Root\n\nclass Base(Root):\n    pass\n",
    "app/lib/root.py": "class Root:\n    def base_method(self): pass\n",
    "app/deep.py": "def helper(): pass\n",
    "app/tools.py": "def saw(): pass\n",
    "app/b.py": "from .c import helper\ndef far(): helper()\n",
    "app/c.py": "def helper(): pass\n",
    "app/star.py": "from app.star2 import *\n",
    "app/star2.py": "def starred(): pass\ndef _private(): pass\n",
    "app/ring1.py": "from .ring2 import x\nx()\n",
    "app/ring2.py": "from .ring1 import x\n",
    "web/m.ts": "import dflt, { a as z, type T } from './n';\nimport * as ns from '../web/o';\nconst { q } = require('./o');\nfunction main() { z(); dflt(); ns.q(); q(); outside(); }\n",
    "web/n.js": "export { a } from './o';\nexport default function theDefault() {}\n",
    "web/o/index.ts": "export function a() {}\nexport const q = () => a();\n",
    "other/z.py": "def helper(): pass\nhelper()\n",
}


def test_names_lead_to_their_definitions(spark):
    language = {"py": "python", "ts": "typescript", "js": "javascript"}
    files = spark.createDataFrame([(p, language[p.rsplit(".", 1)[1]], c) for p, c in FILES.items()], "path string, language string, content string")
    found, uses, inherited = code.symbols(files), code.calls(files), code.inherits(files)
    got = names.resolved_calls(files, found, uses, inherited).cache()
    rows = {(x.path, x.line, x.callee, x.def_path, x.qualified) for x in got.collect()}
    a = "app/a.py"
    assert rows == {
        (a, 8, "h", "app/deep.py", "helper"), (a, 9, "tools.saw", "app/tools.py", "saw"), (a, 10, "app.b.far", "app/b.py", "far"), (a, 11, "bb.far", "app/b.py", "far"),
        (a, 12, "starred", "app/star2.py", "starred"), (a, 18, "self.base_method", "app/lib/root.py", "Root.base_method"), (a, 19, "self.run", a, "D.run"),
        (a, 20, "D.static", a, "D.static"), (a, 21, "own", a, "own"), ("app/b.py", 2, "helper", "app/c.py", "helper"), ("other/z.py", 2, "helper", "other/z.py", "helper"),
        ("web/m.ts", 4, "z", "web/o/index.ts", "a"), ("web/m.ts", 4, "dflt", "web/n.js", "theDefault"), ("web/m.ts", 4, "ns.q", "web/o/index.ts", "q"), ("web/m.ts", 4, "q", "web/o/index.ts", "q"),
        ("web/o/index.ts", 2, "a", "web/o/index.ts", "a"),
    }
    assert {(x.path, x.line) for x in names.references_to(got, "app/c.py", "helper").collect()} == {("app/b.py", 2)}
    assert names.resolved_calls(files.limit(0), found.limit(0), uses.limit(0)).count() == 0


def test_long_chains_of_exports(spark):
    n = 70
    rows = [("m0.py", "python", "def f(): pass\n")] + [(f"m{i}.py", "python", f"from .m{i - 1} import f\n") for i in range(1, n)] + [("use.py", "python", f"from .m{n - 1} import f as g\ng()\n")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    got = names.resolved_calls(files, code.symbols(files), code.calls(files)).collect()
    assert [(x.path, x.def_path, x.qualified) for x in got] == [("use.py", "m0.py", "f")]
