"""Syntax, provenance, documentation pairs and mixing."""

import ast
import datetime as dt

import numpy as np
import pytest

from corvane.llm import doc_pairs as D
from corvane.llm import invalid_files as V
from corvane.llm import mixing as M
from corvane.llm import provenance as P
from corvane.llm.peg import Grammar
from corvane.llm.syntax import check

VALID = {
    "python": ["", "def f(a, /, *, b=1, **k) -> int:\n    return [x async for x in y if x] or {**a, 'b': (yield)}\n", "match x:\n    case [1, *r] if r:\n        pass\n    case _:\n        y = 1\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "s = '''<<<<<<< HEAD\n'''\n", "x = lambda a, *b, c=1: (a if b else c)\nprint(x[1:2, ...], *y, z=1, **k)\nwith (a as b, c): pass\n", "@d(1)\nclass A(B, metaclass=C):\n    x: int = 1; y = 2\n", "if (n := f()) > 1: pass\nelif not a is not b: pass\nelse: del a[0]\n"],
    "javascript": ["", "const f = async ({a, ...b}, [c] = []) => ({...a, [b]: c, get x() { return 1 }});\nlet y = a?.b ?? c ** 2\nfoo()\n", "class A extends B { static #x = 1; constructor(a) { super(a) } async *g() { yield* x; } get y() { return `a${b + `c`}` } }\n", "for (const [k, v] of Object.entries(a)) if (k) continue; else break\nlabel: for (;;) { break label }\n", "const r = /[/\\]]+/g.test(s), q = a / b / c;\nimport d, {e as f} from 'x';\nexport default class {}\n", "switch (x) { case 1: f(); break; default: g() }\ntry { a() } catch { b() } finally { c() }\ndo { x++ } while (x < 3)\n", "!function(){var e=530,v=[87,9];v.push(e)}();"],
    "typescript": ["interface A<T extends B = C> { readonly a?: T[]; [k: string]: unknown; m(x: number): asserts x is string }\ntype U = 'a' | { b: number }[] | ((x: A) => void);\nenum E { X = 1, Y }\nabstract class Q<T> implements A<T> { private constructor(public a: T, b?: string) { super() } get z(): Map<string, Array<T>> { return a as any } }\nfunction f<T>(this: Q<T>, x: T): x is T { return foo<string>(x!) as unknown as boolean }\ndeclare module 'x' { export const a: number }\nconst k = <T,>(x: T) => x;\n"],
    "java": ["package a.b;\nimport static x.*;\n@A(b = {1, 2}) public final class B<T extends C & D> extends E implements F<T> {\n  private static final int[] X = {1, 2};\n  static { x(); }\n  public <R> List<? super R> m(final T t, int... n) throws G, H { for (var x : xs) { if (x instanceof S s && !b) continue; } return (a, b) -> { return (int) a >>> 2; }; }\n  enum K { A(1) { void f() {} }, B; K() {} }\n  record P(int x) {}\n  interface I { default void f() { switch (x) { case 1, 2 -> f(); default -> { } } try (var r = open()) { } } }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v == (T{1}) {\n\t\treturn\n\t}\n\tfor i, x := range []int{1, 2} {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, []string:\n\t\tdefer f(x...)\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t}\n\tvar m = map[string]func(int) error{\"a\": nil}\n\treturn a << 1, nil\n}\n"],
    "rust": ["#![allow(x)]\nuse a::{b as c, d::*};\npub(crate) struct S<'a, T: X + 'a = Y>(pub T, &'a [u8; 4]) where T: Z;\nimpl<T> Tr for S<'_, T> where T: Fn(i32) -> u8 { const N: usize = 1; type O = Vec<Vec<T>>; async unsafe fn f(&mut self, (a, b): (i32, u8)) -> Result<(), Box<dyn E>> { let Some(x) = y else { return Ok(()) }; let z = if let Ok(v) | Err(v) = w? { v as u64 } else { 0..=9 }; match z { 0 | 1 if a => {}, n @ 2..=5 => vec![1; 2].iter().map(|&x| x + 1).collect::<Vec<_>>(), S { p, .. } => loop { break 'a' }, _ => () } 'o: while i < 3 { continue 'o; } Ok(()) } }\nenum E { A { x: i32 }, B(u8) = 3, C }\nmacro_rules! m { ($x:expr) => { $x }; }\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  ((a) + 1)\ntypedef struct n { int a : 3; struct n *next; } n_t;\nstatic const char *const s[] = { \"a\" \"b\", [2] = 'c' };\nint (*cb)(void *, int);\nint f(unsigned long long a, ...) { for (int i = 0, j; i < 3; i++) if (a) goto end; else a = (int) sizeof(n_t) * -b ? c : d; do { } while (0); switch (a) { case 1: default: break; } end: return *p++ & ~0x1fUL; }\n"],
    "cpp": ["#include <map>\nnamespace a::b { template <typename T, int N = 3> class C : public D<T>, private E { public: explicit C(int x) : D<T>(x), y{1} {} virtual ~C() = default; T operator+(const C& o) const noexcept override; private: std::map<std::string, std::vector<int>> m{{\"a\", {1}}}; }; }\nauto f = [&, x = 1](auto&& y) mutable -> int { return static_cast<int>(y) + x; };\nenum class K : int { A, B = 2 };\nint main() { for (const auto& [k, v] : m) { try { throw E(1); } catch (...) { throw; } } if (auto p = g(); p) delete[] new int[3]; return a < b && c > d; }\n"],
}
BROKEN = {
    "python": ["def f(:\n  pass\n", "def f()\n    pass\n", "if x:\n", "x = (1\n", "x = “a”\n", "<<<<<<< HEAD\nx = 1\n=======\n", "Sure, I changed it as you asked.\n", "s = '''open\n", "try:\n    pass\nx = 1\n", "  x = 1\n", "package a;\n", "print 1\n"],
    "javascript": ["function f( {\n}", "if (a) {\n", "let x = ;", "const s = 'open\n", "<<<<<<< HEAD\nx()\n", "@@ -1,2 +1,2 @@ x\n", "Here is the updated file:\n", "x = {a: 1,, b: 2}", "/* open", "<!DOCTYPE html>\n", "import os\nimport re\n", "a b c"],
    "typescript": ["interface A { a: }", "function f(x: ) {}", "const x: number 1;"],
    "java": ["public class A { int f( { } }", "class A { void f() { x = 1 } }", "class A {", "import os\n", "class A { void f() { try { } } }", "int f() { return 1; }", "def f(): pass"],
    "go": ["package a\nfunc f() {\n", "func f() {}\n", "package a\nfunc f() { x := }\n", "package a\nvar x = (1\n", "package a\nif x {}\n"],
    "rust": ["fn f() {", "fn f( {}", "let x = 1;", "fn f() { let x = ; }", "struct A { x i32 }", "fn f() { match x { 1 => } }"],
    "c": ["int f(int a { return 1; }", "int f() { return 1 }", "int f() {", "class A {};", "import os\n", "/* open"],
    "cpp": ["class A { int x; }", "int f() { for (;;) }", "template <typename T int f();", "int main() { return (1; }"],
}


@pytest.mark.parametrize("lang, code", [(lang, c) for lang, cs in VALID.items() for c in cs])
def test_valid(lang, code):
    assert check(code, lang).errors == []
    assert check(code.replace("\n", "\r\n"), lang).errors == []


@pytest.mark.parametrize("lang, code", [(lang, c) for lang, cs in BROKEN.items() for c in cs])
def test_broken(lang, code):
    v = check(code, lang)
    assert not v.valid and v.n_errors == len(v.errors) >= 1 and v.cause and v.line >= 1


def test_python_agrees_with_its_own_parser_on_this_repository():
    import pathlib

    for path in pathlib.Path(__file__).parents[2].rglob("*.py"):
        code = path.read_text()
        ast.parse(code)
        assert check(code, "python").errors == []
        cut = code[: len(code) * 2 // 3]
        try:
            ast.parse(cut)
            ok = True
        except SyntaxError:
            ok = False
        assert check(cut, "python").valid == ok, path


def test_odd_inputs_end():
    assert check("x", "cobol") is None and check("# x", "markdown").valid
    for lang in VALID:
        check("(" * 30_000, lang)
        check("a" * 200_000, lang)
        check("\0☃ " * 100, lang)


T = dt.datetime(2025, 1, 1)
FILES = "index_prefix string, repo_path string, file_path string, lang string, sha256 string, scanned_at timestamp_ntz, code string, verdict string"


def files(spark, rows):
    return spark.createDataFrame([(p, "r", f, lang, str(hash(c)), T + dt.timedelta(days), c, "extra") for p, f, lang, c, days in rows], FILES)


def test_only_current_versions_are_judged(spark):
    f = files(spark, [("i", "a.py", "python", "x = (", 0), ("i", "a.py", "python", "x = 1", 1), ("i", "b.go", "go", "package a\nfunc (", 0), ("i", "b.go", "go", "package a\nfunc (", 0), ("i", "c.py", "python", None, 0), ("i", "d.zig", "zig", "?", 0), ("i", "e.go", "go", "", 0)])
    assert [r.file_path for r in V.invalid_files(f).collect()] == ["b.go"]
    rates = {r.lang: (r.n_files, r.n_invalid, r.accepted) for r in V.validity_rates(f).collect()}
    assert rates["go"] == (2, 1, 0.0) and rates["python"] == (2, 0, 1.0) and rates["zig"] == (1, 0, None)
    assert V.invalid_files(f.limit(0)).count() == 0


def test_provenance(spark):
    body = "def f(a):\n    return a\n" * 20
    lib = "# tool v1.2.3\n# (c) 2019 The Tool Authors, MIT terms\n\n" + body
    rows = [
        ("i", "src/a.py", "python", body.replace("f", "g"), 0), ("i", "src/b.py", "python", "# Code generated by x from y. DO NOT EDIT.\n" + body.replace("f", "h"), 0),
        ("i", "src/w.py", "python", "# Writes stubs. The text 'DO NOT EDIT' goes on top.\n" + body.replace("f", "k"), 0), ("i", "src/t.py", "python", body.replace("f", "q") + "\n# @generated\n", 0),
        ("i", "src/m.js", "javascript", "var a=function(b){return b+1};" * 40, 0), ("i", "src/d.c", "c", "static const int t[] = {\n" + "1, 2, 3, 4, 5, 6, 7, 8,\n" * 60 + "};\n", 0),
        ("i", "third_party/tool-1.2.3/x.py", "python", lib, 0), ("j", "src/copy.py", "python", body, 0), ("j", "src/own.py", "python", body.replace("f", "z"), 0),
        ("i", "node_modules/p/i.js", "javascript", "x()", 0), ("i", "external_links/l.py", "python", body.replace("f", "e"), 0), ("i", "src/n.py", "python", None, 0), ("i", "src/e.py", "python", "", 0), ("i", None, "python", "x", 0),
    ]
    config = spark.createDataFrame([(["node_modules"],)], "ignored_dirs array<string>")
    got = {(r.index_prefix, r.file_path): r.label for r in P.labelled_files(files(spark, rows), config).collect()}
    assert {k: v for k, v in got.items() if v != "handwritten"} == {
        ("i", "src/b.py"): "generated", ("i", "src/t.py"): "generated", ("i", "src/m.js"): "minified", ("i", "src/d.c"): "blob",
        ("i", "third_party/tool-1.2.3/x.py"): "vendored", ("j", "src/copy.py"): "vendored", ("i", "node_modules/p/i.js"): "ignored",
    }
    assert len(got) == 13
    assert P.labelled_files(files(spark, rows).limit(0), config).count() == 0


def test_peg_is_ordered_memoised_and_keeps_offsets():
    g = Grammar("S <- a:('x' S / 'y') !~.~\nT <- 'a'* &'b' b:~.+~")
    assert g.match("xxy", "S") == (3, [("a", 0, 3), ("a", 1, 3), ("a", 2, 3)]) and g.match("xx", "S") is None and g.match("y", "S") == (1, [("a", 0, 1)])
    assert g.match("aab", "T") == (3, [("b", 2, 3)])


@pytest.mark.parametrize(
    "doc, name, good",
    [
        ("Sample rank.", "sample_rank", False), ("The drain token.", "drain_token", False), ("TODO: document", "f", False), ("See above.", "f", False), ("----------", "f", False), ("", "f", False),
        (":param a:\n:return:", "f", False), ("@param strip\n@return", "f", False), ("{@inheritDoc}", "f", False), ("TallyTickPatch ...", "TallyTickPatch", False), ("No description.", "f", False), ("t.b.d.", "f", False),
        ("Must run before the token is sealed.", "f", True), ("Never blocks; drops the oldest row.", "f", True), ("Sample rank.\nCallers expect a cached probe.", "sample_rank", True), ("@param strip the narrow page to start from", "f", True), ("Закрывает ключ и ждёт", "f", True),
    ],
)
def test_informative(doc, name, good):
    assert D.informs(doc, name) == good


CODE = {
    "python": ("# Waits for every reader to leave.\n@d\ndef f(a: int = g('(')) -> x:\n    return a\n\ndef h():\n    r'''Closes what is open.'''\n\nclass C:\n    '''Not a function at all.'''\n", [("1", 2, 4), ("2", 6, 7), ("3", 9, 10)], {"1": "Waits for every reader to leave.", "2": "Closes what is open."}),
    "javascript": ("/** Waits for every reader. */\nexport const f = async (a, {b}) => {\n  return b;\n};\n/** A table of values to use. */\nconst t = { a: 1 };\n/**\n * Opens the box slowly.\n */\n\nfunction g() {}\n", [("1", 2, 4), ("2", 6, 6), ("3", 11, 11)], {"1": "Waits for every reader."}),
    "rust": ("/// Waits for every reader.\n/// And then some.\n#[inline]\npub(crate) fn f<T>(a: &T) -> i64 {\n    1\n}\n", [("1", 4, 6)], {"1": "Waits for every reader.\nAnd then some."}),
    "go": ("package a\n\n// Open waits for every reader.\nfunc (s *Box) Open(a int) int {\n\treturn a\n}\n// TODO\nfunc g() {}\n", [("1", 4, 6), ("2", 8, 8)], {"1": "Open waits for every reader."}),
    "java": ("class A {\n    /** Waits for every reader. */\n    @Override\n    public List<String> f(int a) {\n        return a;\n    }\n}\n", [("1", 3, 6)], {"1": "Waits for every reader."}),
    "cpp": ("/**\n * Waits for every reader.\n */\nstatic std::vector<int> A::f(const char *a) {\n    return 1;\n}\n", [("1", 4, 6)], {"1": "Waits for every reader."}),
}


@pytest.mark.parametrize("lang", CODE)
def test_pairs(lang):
    code, wanted, expected = CODE[lang]
    rows = list(D.functions_of_file(code, lang, wanted + [("bad", None, 1), ("far", 900, 901)]))
    assert {r[0]: r[2] for r in rows} == expected
    for _, _, doc, doc_at, _ in rows:
        assert doc.split("\n")[0].split()[0] in code[doc_at : doc_at + 40]


def test_pairs_use_the_current_file_and_drop_the_rest(spark):
    code = CODE["python"][0]
    f = files(spark, [("i", "a.py", "python", "\n\n" + code, 0), ("i", "a.py", "python", code, 1), ("i", "a.py", "python", code, 1), ("i", "n.py", "python", None, 0)])
    m = spark.createDataFrame(
        [("i", "a.py", c, s, e, "function_definition", "x") for c, s, e in CODE["python"][1]] * 2 + [("i", "a.py", None, 2, 4, "function_definition", "x"), ("i", "gone.py", "9", 1, 2, "function_definition", "x"), ("i", "a.py", "8", 2, 4, "gap_window", "x"), ("i", "n.py", "7", 1, 1, "function_definition", "x")],
        "index_prefix string, file_path string, chunk_id string, start_line int, end_line int, node_type string, lang string",
    )
    full = spark.createDataFrame([("1", "a"), ("1", "b"), ("5", "c")], "chunk_id string, content string")
    got = {r.chunk_id: r.code for r in D.documentation_pairs(m, f, full).collect()}
    assert got == {"1": "b", "2": None}
    assert D.documented_functions(m.limit(0), f).count() == 0


def test_mixture_reaches_shares_within_caps(spark):
    rows = [(n, f"text number {n} about {s} " + "and more words " * (n % 7 + 1), s) for n, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 30)]
    rows += [(5000, None, "a"), (5001, "", "b"), (None, "x", "a"), (3, "again", "a"), (6000, "text about c and more words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.05, 8), ("absent", 0.2, 3), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(docs, targets)
    got = {r.source: r for r in M.shares(mixed, targets).collect()}
    for s, share in (("a", 0.625), ("b", 0.3125), ("c", 0.0625)):
        assert abs(got[s].actual_share - share) < 0.01
    assert got["absent"].n_tokens == 0 and all(r.most_repeats <= r.max_repeats for r in got.values())
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    assert M.mixture(docs.limit(0), targets).count() == 0


def test_classifier_holds_out():
    import random

    rng = random.Random(2)
    topic = {s: [f"{s}{k}" for k in range(40)] for s in "xyz"}
    make = lambda s: " ".join(rng.choice(topic[s]) if rng.random() < 0.3 else f"w{rng.randrange(200)}" for _ in range(60))
    model = M.Classifier(["x", "y", "z"], [(s, make(s)) for s in "xyz" for _ in range(60)])
    tries = [(s, model.labels[int(model.posterior(make(s)).argmax())]) for s in "xyz" for _ in range(40)]
    assert sum(a == b for a, b in tries) / len(tries) > 0.95


def test_unsure_documents_count_for_every_domain(spark):
    rows = [(n, f"{s} {s}{n % 5} " * 8, s) for n, s in enumerate(["a", "b"] * 200)] + [(1000 + n, f"a a{n % 5} b b{n % 5} " * 4, None) for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(docs, targets)
    unsure = mixed.where("source is null and membership < 0.9").collect()
    assert len(unsure) > 150 and all(abs(sum(r.memberships.values()) - 1) < 1e-6 and len(r.memberships) == 2 for r in unsure)
    assert all(abs(r.actual_share - 0.5) < 0.02 for r in M.shares(mixed, targets).collect())


def test_scarce_sources_are_kept_and_do_not_set_the_size_alone(spark):
    rows = [(n, "word " * (40 + n % 30), s) for n, s in enumerate(["big"] * 400 + ["small"] * 50 + ["scarce"] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("scarce", 0.1, 4)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.shares(M.mixture(docs, targets), targets).collect()}
    total = sum(r.n_tokens for r in got.values())
    for r in got.values():
        assert r.n_tokens > 0 and abs(r.n_tokens - r.target_share * total) <= 80
    assert M.mixture_size(np.array([0.6, 0.3, 0.1]), np.array([600.0, 600.0, 10.0])) == pytest.approx(10 / (0.1 - M.SHORTFALL), rel=1e-6)


def test_rates_are_projected_gradient_steps():
    m = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    tokens, cap, goal = np.array([100.0, 100.0, 100.0]), np.array([1.0, 2.0, 1.0]), np.array([90.0, 120.0])
    steps, have = [], tokens @ m
    for _ in range(40):
        steps.append(((M.rates(m, cap, steps) * tokens) @ m - goal) / have)
    r = M.rates(m, cap, steps)
    assert np.allclose((r * tokens) @ m, goal, atol=0.5) and (r >= 0).all() and (r <= cap).all() and len(set(r.round(3))) == 3


def test_propagation_is_exact_on_a_small_tree():
    """Beliefs against the sum over all labellings."""
    import itertools

    rng = np.random.default_rng(4)
    names = ["", "a", "a/vendor", "b"]
    said = rng.normal(size=(4, 5)) * 2
    top = rng.normal(size=5)
    got, _ = P.propagate(names, said, top)
    own = said + np.array([P.place(n.rpartition("/")[2]) for n in names])
    own[0] += top
    true = np.full((4, 5), -np.inf)
    for x in itertools.product(range(5), repeat=4):
        w = sum(own[k, x[k]] for k in range(4)) + P.DIR_GIVEN_DIR[x[0], x[1]] + P.DIR_GIVEN_DIR[x[1], x[2]] + P.DIR_GIVEN_DIR[x[0], x[3]]
        for k in range(4):
            true[k, x[k]] = np.logaddexp(true[k, x[k]], w)
    assert np.allclose(got - got.max(1, keepdims=True), true - true.max(1, keepdims=True))


def test_neighbours_decide_what_a_file_alone_does_not(spark, monkeypatch):
    weak = "// bindings\nint call(int a) {\n    return a;\n}\n"
    sure = "// Code generated by x from y. DO NOT EDIT.\nint call{0}(int a) {{ return {0}; }}\n"
    hand = "int add_{0}(int a) {{\n    return a + {0};\n}}\n"
    rows = [("i", f"api/s{k}.c", "c", sure.format(k), 0) for k in range(8)] + [("i", "api/weak.c", "c", weak, 0)]
    rows += [("i", f"src/h{k}.c", "c", hand.format(k), 0) for k in range(8)] + [("i", "src/weak.c", "c", weak.replace("a", "b"), 0)]
    rows += [("i", f"vendor/x/src/deep/f{k}.c", "c", hand.format(k + 50), 0) for k in range(8)]
    rows += [("i", f"src/notes/n{k}.md", "markdown", "# x\n", 0) for k in range(3)] + [("i", "README.md", "markdown", "", 0)]
    config = spark.createDataFrame([(["node_modules"],)], "ignored_dirs array<string>")
    f = files(spark, rows)
    got = {r.file_path: r.label for r in P.labelled_files(f, config).collect()}
    assert got["api/weak.c"] == "generated" and got["src/weak.c"] == "handwritten"
    assert all(got[f"vendor/x/src/deep/f{k}.c"] == "vendored" for k in range(8)) and got["src/h1.c"] == "handwritten"
    assert got == {r.file_path: r.label for r in P.labelled_files(f, config, block=2).collect()}  # cut into blocks: the same
    alone = {path: P.LABELS[int(np.argmax(P.evidence(code, path)[0]))] for _, path, _, code, _ in rows}
    assert alone["api/weak.c"] == alone["src/weak.c"] and alone["vendor/x/src/deep/f1.c"] == "handwritten"  # without messages


def test_trailing_marks_count_however_long(spark):
    body = "x = 1\ny = 2\n"
    assert P.evidence(body + "# note\n" * 3000 + "# @generated\n" + "# note\n" * 3000, "a.py")[0][1] > 5
    assert P.evidence(body, "a.py")[0][1] < 0


CORNERS = {
"javascript":["#!/usr/bin/env node\nfoo()\n","const a = <div className=\"x\" {...p}>hi {b.map(x => <B key={x}/>)} it's<br/></div>;\nfoo(a)\n","function F() {\n  return (\n    <>\n      <A.B on={() => { go() }}>text</A.B>\n    </>\n  )\n}\n","x = /a(b)[(]/.test(y)"],
"typescript":["type A<T> = T extends [infer U extends string, ...infer R] ? U : never;\n","const f = <T,>(x: T) => x;\nconst y = <any>z;\n","export default function App(): any { return <p>{x}</p>; }\n"],
"c":["int f(void) __attribute__((noreturn));\nint g(int x) { asm volatile(\"nop\" : : \"r\"(x)); __asm__(\"x\"); return _Generic(x, int: 1, default: 2); }\n","int f(a, b)\n  int a;\n  char *b;\n{\n  return a;\n}\n","void f(void) { list_for_each_entry(p, &head, list) { g(p); } }\n","#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return 1;\n}\n#if 0\n garbage (\n#endif\n"],
"cpp":["template <typename T> concept Addable = requires(T a) { a + a; { a.f() } -> std::same_as<int>; };\ntemplate <typename T> requires Addable<T> && std::integral<T> T add(T a, T b) { return a + b; }\ntask f() { auto x = co_await g(); co_return x; }\nauto l = []<typename T>(T x) { return x; };\n"],
"java":["public sealed interface S permits A, B {}\nnon-sealed class A implements S {}\nclass X { int f(Object o) { if (o instanceof P(int x, Q(var y))) { return 1; } return switch (o) { case P(int a, var b) -> a; default -> 0; }; } }\n"],
"rust":["/* a /* b */ c */\nfn f<'a>(x: &'a u8) -> impl Fn() + use<'a> { move || {} }\n"],
}
CORNERS_BROKEN = {"javascript":["x = /(/.test(y)","const a = <div><b></div>;\n","f("*3000],"c":["#ifdef A\nint x;\n","int x;\n#endif\n","int f(){ return g(((1); }"]}


@pytest.mark.parametrize("lang, code", [(lang, c) for lang, cs in CORNERS.items() for c in cs])
def test_valid_corners(lang, code):
    assert check(code, lang).errors == []


@pytest.mark.parametrize("lang, code", [(lang, c) for lang, cs in CORNERS_BROKEN.items() for c in cs])
def test_broken_corners(lang, code):
    v = check(code, lang)
    assert v.valid is False and v.n_errors == len(v.errors) >= 1


def test_too_deep_texts_have_no_verdict_and_keep_errors():
    assert check("x = " + "(" * 30_000 + "1" + ")" * 30_000, "javascript").valid is None
    assert check("let = ;\nx = " + "(" * 30_000 + "1" + ")" * 30_000, "javascript").valid is False
    assert check("f(" * 3000, "java").valid is False


def test_functions_are_extracted_with_stored_offsets_whatever_the_line_ends():
    for lang in CODE:
        code, wanted, expected = CODE[lang]
        for text in (code, code.replace("\n", "\r\n"), code.replace("\n", "\r")):
            got = {f[0]: f for f in D.extract(text, lang)}
            for chunk, start, end in wanted:
                if chunk in expected:
                    first, last, name, doc, at, doc_at = got[start]
                    assert doc == expected[chunk] and last == end
                    assert doc.split()[0] in text[doc_at : doc_at + 40] and name in text[at : at + 80]
            again = list(D.functions_of_file(text, lang, wanted))
            assert {r[0]: r[2] for r in again} == expected and all(r[1] in text[r[4] : r[4] + 80] for r in again)
    assert list(D.extract("", "python")) == list(D.extract("x = 1", "cobol")) == []
