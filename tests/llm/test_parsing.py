import ast
import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import parsing as P
from weftgraph.llm import gll
from weftgraph.llm.gll import Grammar
from weftgraph.llm.grammars import language

GOOD = {
    "js": ["", "#!/usr/bin/env node\nlet a = 1", "const {a, b: [c], ...d} = f(x => x + 1, async (y) => { await y })\nfoo()\n;[1,2].map(v => v)\n", "export default class A extends B { static #p = 1; get x() { return this.#p } async *gen() { yield* a } }", "for (const x of xs) if (x) break; else continue\nlabel: while (1) { do y++; while (y < 3) }", "var re = /[/\\]]+/g.test(s) ? `a${b}` : a / b / c; switch (k) { case 1: f(); default: }", "import x, {y as z} from 'm'; export * from \"n\"; new Foo(...args)?.bar?.[0]; try { a() } catch { b() } finally { c() }", "!function(){var a=b[1],c=!d&&a;if(a!==b){c='x'}else k++;function f(e,n){return e?g(n):75}}();", "(()=>{var m={806:(e,t,n)=>{\nvar a=1}}})()", "async function f() { for await (const a of b) {} }\nlet o = { f() {}, get a() { return 1 }, [k]: v, async *g() {}, b, 'c': 1 }", "return1\n++a\nif (a)\n  b\nelse\n  c\nx = function () {}\n// end"],
    "ts": ["export interface A<T extends B = C> extends D<T>, E { readonly a?: string; [k: string]: unknown; f(x: number): void; new (y: T): A<T> }", "type F = { [K in keyof T]?: T[K] } & (A | B)[] | ((a: string, ...r: number[]) => Promise<void>); enum X { A = 1, B, 'C' = A << 2 }", "abstract class P<T> implements Q { constructor(private readonly a: Map<string, Array<number>>, public b?: X) { super() } abstract go(): void; declare x: number; @dec() m<T>(this: P<T>, a = 1): a is string { return a as unknown as T } }", "declare module 'm' { export function f(a: number): string; }\nexport const g = <T,>(x: T): x is T => x!\nlet v = <any>w; import type { Q } from './q'; export type { Z }\nnamespace N.M { let a: typeof b }", "function over(a: string): void\nfunction over(a: number): void\nfunction over(a: any) {}", "const c = a satisfies B\nlet t: [a: string, b?: number, ...c: X[]] = [1 as const]"],
    "py": ["", "x = 1", "\ufeffimport a\n", "async def f(a, /, b: int = 1, *c, d=2, **e) -> None:\n    async with x as y, z:\n        await g(*a, k=1, **b)\n    return [i async for i in j if i] or (yield)\n", "@dec(1)\nclass A(B, metaclass=C):\n\n    x: int = 0\n    def f(self): return lambda *a, b=1: a[1:2, ::3, ...]\n", "try:\n  pass\nexcept (A, B) as e:\n  raise X from e\nelse: pass\nfinally:\n  del a, b[0]\n", "match p:\n    case [1, *r] if r:\n        pass\n    case {'a': 1, **k} | C(x=2):\n        pass\n", "if (a := f()) and not b is not c: print(f'{a!r}', rb'\\x', '''t\n'''\n 'u')\n# end", "with (open(a) as b, c): pass\nx = {**a, 'b': 1, **c}; y = {*a, 1}; z = {k: v for k, v in w}\nglobal g; a += yield x\n"],
    "go": ["package a\n", 'package a\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T[K comparable, V any] struct {\n\t*B\n\tA, C int `json:"a"`\n\tf func(a int, b ...string) (x, y error)\n}\n\nfunc (t *T[K, V]) Do(ctx context.Context) (err error) {\n\tfor i, v := range t.m {\n\t\tif x, ok := v.(int); ok && i > 0 {\n\t\t\tdefer func() { recover() }()\n\t\t} else if y := f(); y != nil {\n\t\t\tcontinue\n\t\t}\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t\tgo g(v)\n\tdefault:\n\t}\n\tswitch z := x.(type) {\n\tcase int, *string:\n\t\treturn map[string][]int{"a": {1, 2}}\n\t}\n\treturn &T[int, string]{A: 1}\n}', "package a\nconst (\n\tA = iota\n\tB\n)\nvar x, y = 1, 'c'\ntype I interface {\n\tio.Reader\n\tF(int) error\n\t~int | ~string\n}\n"],
    "java": ["package a.b;\nimport static java.util.List.*;\n@Ann(value = {1, 2}, x = @B)\npublic sealed class A<T extends B & C> extends D<T> implements E permits F {\n  private static final Map<String, List<int[]>> m = new HashMap<>() {{ put(\"a\", null); }};\n  static { x = 1; }\n  A(int... a) throws X { this(a, b -> c, D::new, int[]::new); }\n  public <R> R f(final T t) { for (var x : y) { if (x instanceof String s && !s.isEmpty()) continue; } return (R) (Object) t; }\n  enum K { A(1) { void g() {} }, B; int v; }\n  record P(int x, int y) { P { assert x > 0 : \"m\"; } }\n  int sw(int k) { return switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; }\n  @interface Q { int v() default 1; }\n  void t() { try (var r = o(); s) { } catch (A | B e) { throw e; } finally { synchronized (this) { i >>>= 2; } } String b = \"\"\"\n   text \"x\"\n  \"\"\"; }\n}\n", ""],
    "rs": ["#![allow(x)]\nuse std::{io::{self, Read}, fmt::*};\npub(crate) struct A<'a, T: B + 'a = C> where T: D { #[x(y = \"z\")] pub f: &'a mut [T; 3], }\nimpl<T> E<F = T> for A<'_, T> { fn g(&mut self, x: impl Fn(u8) -> bool) -> Result<(), Box<dyn X + Send>> { let Some(y) = z else { return Err(1)?; }; match y { 0..=9 | b'a' if q => 1, P { a, ref mut b, .. } => { 2 } _ => break 'o, }; for (i, _) in v.iter().enumerate() { x[i] += i as f64 * 1.0; } let c = move |a: &u8| -> u8 { *a }; vec![1, 2; 3]; println!(\"{}\", r#\"a\"b\"#); if let Some(t) = u && t > 1 { } 'o: loop { } Ok(()) } }\npub enum K { A(u8), B { x: i64 }, C = 3 }\nmacro_rules! m { ($x:expr) => { $x }; }\nunsafe extern \"C\" { fn f(x: i32, ...); }\nconst X: fn(u8) -> u8 = |x| x;\n"],
    "c": ['#include <a.h>\n#define X(a) \\\n  ((a) + 1)\n#ifdef __cplusplus\nextern "C" {\n#endif\ntypedef struct node { struct node *next; unsigned f : 3; int (*cb)(void *, ...); } node_t;\nstatic inline const char *const *f(int a[static 3], size_t n) {\n  for (int i = 0, *p = &a[0]; i < n; i++, p++) { if (!p) goto out; else if ((size_t)*p == sizeof(int)) continue; }\n  switch (n) { case 1: case \'a\': return "x" "y"; default: break; }\n  node_t z = { .next = NULL, .f = 1 }, arr[] = { [0] = { 0 }, };\n  do { z = *(struct node *)q; } while (0);\nout:\n  return (char *[]){ "a", 0 };\n}\n#ifdef __cplusplus\n}\n#endif\nenum e { A = 1 << 2, B, };\nint x = sizeof(struct node) + a ? b : c, y;\n', ""],
    "rb": ["", "require 'a'\nmodule A\n  class B < C::D\n    attr_reader :x, :y\n    CONST = %w[a b].freeze\n    def initialize(a, b = 1, *c, d: 2, **e, &f)\n      @a, @b = a, b\n      super()\n    end\n    def self.go? = true\n    def run\n      return unless ok?\n      xs.each_with_index do |x, i|\n        puts \"#{x}\" if i > 0 && x =~ /a[b]/\n      end\n      h = { a: 1, 'b' => 2, **o }\n      v = if a then 1 else 2 end\n      case v\n      when 1, 2 then foo 1, b: 2\n      else bar\n      end\n      begin\n        raise Err, 'x'\n      rescue A, B => e\n        retry\n      ensure\n        z&.close\n      end\n      a ||= b ? c : d\n      xs.map(&:to_s).select { |q| q.size > 1 }\n        .first\n      while x < 3 do x += 1 end\n      s = <<~EOS\n        text (\n      EOS\n      ->(k) { k * 2 }.call(3)\n    end\n  end\nend\n", "def f(a)\n  a\nend"],
    "json": ['{"a": [1, -2.5e3, true, null, "x\\u00e9"], "b": {}}', "[]", " 1 "],
}
BAD = {
    "js": ["function f( {", "let = = 3", "a b", "const x = ;", "if (a) { b() ", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "import a\nfoo(", "x = 'abc\n", "def f(x):\n    return x\n", "let a: number = 1", "interface A { b: string }", "class A { foo( }", "foo(1,, 2", "/* open", "a = [1, 2", "x = 1 +", "<html></html>", "a\0b", "return )"],
    "ts": ["let a: = 1", "interface A { b: ", "enum { A }", "function f(a: string: number) {}", "class { foo(): }", "package main\nfunc f() {}", "const a: Map<string = 1"],
    "py": ["def f(x)\n  pass", "if x:\npass", "x = (1", "  x = 1", "for x in y:\n    a\n  b", "x = 'a", "return return", "class A:", "print 'x'", "a = = b", "<<<<<<< a\nx\n=======\n", "x = 08a", "def f():\n\treturn 1\n        return 2\n", "}", "f(a b)", "import", "else:\n  pass", "x = 1\0"],
    "go": ["package a\nfunc f() {", "package a\nfunc f( {\n}", "func f() {}", "package a\nvar x = \n", "package a\nx := 1\n", "package a.b;\n", "package a\nfunc f() { if { } }\n", "package a\nfunc f() { a b }\n", "package a\nimport \"x\n"],
    "java": ["class A {", "class A { void f( { } }", "class A { int x = ; }", "class A { void f() { a b c; } }", "class A { void f() { return 1 } }", "class A { } }", "package a", "public class { }", "class A { String s = \"x; }", "void f() {} extra )"],
    "rs": ["fn f( {", "fn f() { let x = ; }", "fn f() -> { }", "struct A { x u8 }", "fn f() { a b }", "package a", "impl { }", "fn f() { \"abc }", "fn f() { } }"],
    "c": ["int f( {", "int x = ;", "int f() { return 1 }", "int f() { if a { } }", "struct A { int x }", "int f() { \"x }", "int f() { } }", "int f() {"],
    "rb": ["def f", "class A\n  def f\n  end\n", "if x\n", "f(1, 2", "x = \nend", "end", "a = [1, 2", "def f(a, )b\nend", "{ a: 1", "package a\nfoo(\n"],
    "json": ["", " ", "{", '{"a": 1,}', "[1 2]", '{"a" 1}', "{'a': 1}", "01", '"a', "nul", '{"a": 1} x', '["\t"]'],
}


@pytest.mark.parametrize("suffix,text", [(s, t) for s, ts in GOOD.items() for t in ts])
def test_valid(suffix, text):
    assert P.parses(f"r/a.{suffix}", text) is True


@pytest.mark.parametrize("suffix,text", [(s, t) for s, ts in BAD.items() for t in ts])
def test_invalid(suffix, text):
    assert P.parses(f"r/a.{suffix}", text) is False


def test_not_judged():
    assert P.parses("a.yml", ": {") is None and P.parses("a.ts", None) is None and P.parses(None, "x") is None and P.parses("Makefile", "x") is None


def test_very_long_file():
    text = "def f(a):\n    x = [1, 2, {'k': (a, b)}]\n    return g(x, k=h(1))\n\n" * 20000
    assert P.parses("a.py", text) is True and P.parses("a.py", text + "(") is False
    assert P.parses("a.js", "f(" * 3000 + ")" * 3000) is True and P.parses("a.js", "f(" * 3000 + ")" * 2999) is False


def test_mutations_agree_with_ast():
    """Dropping or doubling a token of valid Python: the same verdict as the compiler's parser."""
    base = GOOD["py"][3] + "\n" + GOOD["py"][4]
    rng = random.Random(5)
    wrong = []
    for _ in range(250):
        i, n = rng.randrange(len(base)), rng.randrange(1, 4)
        text = base[:i] + (base[i : i + n] * 2 if rng.random() < 0.3 else "") + base[i + n :]
        try:
            ast.parse(text)
            want = True
        except (SyntaxError, ValueError):
            want = False
        if P.parses("a.py", text) != want:
            wrong.append(text)
    assert len(wrong) <= 12, wrong[:2]  # early errors that are no matter of grammar, such as names given twice


def test_engine_against_enumeration():
    """An ambiguous grammar: the recogniser accepts exactly the derivable strings."""
    g = Grammar("file = s ; s = 'a' s? 'b' | x s | x ; x = 'a' | 'a' 'a' ;", ["file"])
    t = {c: g.term(c) for c in "ab"}
    lang = set()

    def derive(k):
        if k == 0:
            return set()
        below = derive(k - 1)
        return {"a" + m + "b" for m in below | {""}} | {h + m for h in ("a", "aa") for m in below} | {"a", "aa"}

    lang = derive(7)
    for n in range(1, 6):
        for w in map("".join, itertools.product("ab", repeat=n)):
            assert g.accepts([t[c] for c in w]) == (w in lang), w
    with pytest.raises(ValueError):
        Grammar("file = e ; e = e 'a' | 'a' ;", ["file"])
    with pytest.raises(ValueError):
        Grammar("file = e ; e = 'a'? ;", ["file"])


def test_configurations_are_shared():
    g = language("py").grammar
    text = "def f(a):\n    return a\n" * 3
    language("py").parses(text)
    n = len(g.rows)
    language("py").parses(text * 50)
    assert len(g.rows) == n


def test_verdicts(spark):
    rows = [("a", 1, "2031-01-01", "file", "r", "r/a.py", "x = (", None), ("a", 2, "2031-02-01", "file", "r", "r/a.py", "x = 1", '{"language": "Python"}'), ("b", 3, None, "file", "r", "r/b.JS", "f(", "{cut"), ("c", 4, None, "file", "r", "r/c", "(", '{"language": " Perl "}'), ("d", 5, None, "file", "r", "r/d.go", None, None), ("f", 6, None, "function", "r", "r/e.go", "x", None), (None, 7, None, "file", "r", "r/e.go", "x", None)]
    df = spark.createDataFrame(rows, "id string, ord long, t string, kind string, repo string, file_path string, content string, metadata string").withColumn("indexed_at", F.to_timestamp_ntz("t")).withColumn("ok", F.lit("clash"))
    v = P.verdicts(df).cache()
    assert {r.id: (r.language, r.ok) for r in v.collect()} == {"a": ("python", True), "b": ("javascript", False), "c": ("perl", None), "d": ("go", None)}
    assert {(r.language, r.n_files, r.n_bad, r.rate) for r in P.rates(v).collect()} == {("python", 1, 0, 0.0), ("javascript", 1, 1, 1.0)}
    assert P.verdicts(df.where("false")).collect() == [] and P.rates(P.verdicts(df.where("false"))).collect() == []


def test_tables_are_renewed_within_a_text():
    g = Grammar("text = item item* ; item = '(' text ')' | '(' ')' | 'x' ;", ["text"])
    small = Grammar("text = item item* ; item = '(' text ')' | '(' ')' | 'x' ;", ["text"])
    small.most = 10
    a, b, x = (g.term(t) for t in "()x")
    deep = [a] * 9000 + [x] + [b] * 9000
    for tokens in (deep, deep[:-1], deep + [b], [a, b, x] * 5000, [a] * 5000, [x] * 9000 + [b]):
        assert g.accepts(tokens) == small.accepts(tokens)
        assert len(small.rows) <= 2 * gll.RENEW + 10
    assert g.accepts(deep) and not g.accepts(deep[:-1])
