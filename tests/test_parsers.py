"""Facts that the parsers must find in small sources."""

import time

from callweave.sources.parsers import parse_code

NODE = ["id", "name", "kind", "qualified_name", "file_path", "start_line", "end_line", "start_column", "end_column", "signature", "doc"]
CALL = ["caller", "callee", "simple", "scope", "kind", "receiver", "type", "package", "hint", "line", "column"]


def read(path, text, language):
    nodes, calls = parse_code(path, text, language)
    return {n[0].split("::", 1)[1]: dict(zip(NODE, n, strict=True)) for n in nodes}, [dict(zip(CALL, c, strict=True)) for c in calls]


def pairs(calls):
    return {(c["caller"].split("::", 1)[1], c["callee"]) for c in calls}


def test_rust():
    n, c = read(
        "a.rs",
        """/// A counter.
/// Of things.
#[derive(Debug)]
pub struct Counter { n: u32 }

pub enum Mode { On, Off }
pub trait Show { fn show(&self) -> String; }

impl Counter {
    /// Makes one.
    pub fn new(n: u32) -> Self { Counter { n } }
    fn add(&self, k: u32) -> u32 { self.n + k }
    fn twice(&self) -> u32 { self.add(1) + helper("{ not code(").len() as u32 }
}
// plain
fn helper(s: &str) -> String { println!("x"); s.to_string() }
fn free() { let c = Counter::new(3); c.twice(); Vec::<u8>::new(); }
""",
        "rust",
    )
    assert {k: v["kind"] for k, v in n.items()} == {"Counter": "struct", "Mode": "enum", "Show": "trait", "Counter::new": "method", "Counter::add": "method", "Counter::twice": "method", "helper": "function", "free": "function"}
    assert n["Counter"]["doc"] == "/// A counter.\n/// Of things." and n["helper"]["doc"] == "// plain"
    assert n["Counter::new"]["signature"] == "pub fn new(n: u32) -> Self" and n["Counter::new"]["start_line"] == 11
    assert {("Counter::twice", "add"), ("Counter::twice", "helper"), ("free", "Counter::new"), ("free", "twice")} <= pairs(c)
    assert not any(x["callee"] in ("println", "code") for x in c)


def test_go():
    n, c = read(
        "a.go",
        """package shapes

import (
\t"fmt"
\tstore "example.com/x/storage"
)

// Point is one.
type Point struct { X, Y int }

type Shape interface { Area() float64 }

// Distance tells.
func (p *Point) Distance() int { return helper(p.X) }

func helper(x int) int {
\tfmt.Println(x)
\treturn store.Get(x)
}
""",
        "go",
    )
    assert {k: v["kind"] for k, v in n.items()} == {"Point": "struct", "Shape": "interface", "Point::Distance": "method", "helper": "function"}
    assert n["Point"]["signature"].startswith("type Point struct") and n["Point"]["doc"] == "// Point is one."
    by = {x["callee"]: x for x in c}
    assert by["helper"]["kind"] == "function" and by["helper"]["package"] == "shapes"
    assert by["Get"] | {} == by["Get"] and (by["Get"]["kind"], by["Get"]["receiver"], by["Get"]["hint"]) == ("method", "store", "example.com/x/storage")
    assert by["Println"]["hint"] == "fmt"


def test_java_and_routes():
    n, c = read(
        "App.java",
        """package demo;
import demo.net.ChannelPromise;

/** An app. */
public class App {
    private final Helper helper = null;
    public App(int n) { init(n); }
    void init(int n) { if (n > 0) { helper.release(); } }
    /** Runs. */
    public void run(ChannelPromise promise) { promise.tryFailure(1); }
    public static void main(String[] args) { App a = new App(3); a.run(null); }
    interface Inner { void go(); }
}
""",
        "java",
    )
    assert {k: v["kind"] for k, v in n.items()} == {
        "demo::App": "class", "demo::App::App": "constructor", "demo::App::init": "method", "demo::App::run": "method", "demo::App::main": "method",
        "demo::App::Inner": "interface", "demo::App::Inner::go": "method",
    }
    assert n["demo::App"]["doc"] == "/** An app. */" and n["demo::App::run"]["doc"] == "/** Runs. */"
    by = {x["callee"]: x for x in c}
    assert (by["tryFailure"]["kind"], by["tryFailure"]["receiver"], by["tryFailure"]["type"], by["tryFailure"]["package"], by["tryFailure"]["hint"]) == ("method", "promise", "ChannelPromise", "demo", "demo.net.ChannelPromise")
    assert by["release"]["type"] == "Helper" and by["App"]["kind"] == "constructor" and by["App"]["type"] == "App"
    assert {("demo::App::App", "init"), ("demo::App::main", "App"), ("demo::App::main", "run")} <= pairs(c)

    n, c = read(
        "C.java",
        """package web;
@RestController
@RequestMapping("/api/v2")
public class C {
    @GetMapping("/users/{id}")
    public String one(int id) { return load(id); }
    @PostMapping(value = {"/users", "/create"})
    public String make() { return ""; }
    @RequestMapping(path = "/status", method = RequestMethod.POST)
    public String status() { return ""; }
    String load(int id) { return ""; }
}
""",
        "java",
    )
    routes = {v["name"]: v for v in n.values() if v["kind"] == "route"}
    assert set(routes) == {"GET /api/v2/users/{id}", "POST /api/v2/users", "POST /api/v2/create", "POST /api/v2/status"}
    assert routes["GET /api/v2/users/{id}"]["id"] == "C.java::web::C::one::route::GET /api/v2/users/{id}"
    assert {x["callee"] for x in c if "::route::" in x["caller"]} == {"web::C::one", "web::C::make", "web::C::status"}
    assert ("web::C::one", "load") in pairs(c)


def test_c_and_cpp():
    n, c = read(
        "a.c",
        """#include <stdio.h>
#define TWICE(x) helper(x)
struct point { int x; };
// helps
static int helper(int a) { return a; }
int main(void) {
    int (*op)(int) = helper;
    struct point *p;
    p->fn(1);
    if (op(2)) { return MY_MACRO(helper(3)); }
    return 0;
}
""",
        "c",
    )
    assert {k: v["kind"] for k, v in n.items()} == {"point": "struct", "helper": "function", "main": "function"}
    assert n["helper"]["doc"] == "// helps"
    by = {x["callee"]: x for x in c}
    assert (by["helper"]["kind"], by["MY_MACRO"]["kind"], by["op"]["kind"], by["fn"]["kind"], by["fn"]["receiver"]) == ("function", "macro", "indirect", "method", "p")
    n, c = read(
        "a.cpp",
        """namespace demo {
int helper(int a) { return a; }
class Point {
public:
    int sum() const { return helper(x); }
    int far();
private:
    int x;
};
int Point::far() { return sum(); }
int run() { Point p; return p.sum(); }
}
""",
        "cpp",
    )
    assert {k: v["kind"] for k, v in n.items()} == {"demo": "namespace", "demo::helper": "function", "demo::Point": "class", "demo::Point::sum": "method", "demo::Point::far": "method", "demo::run": "function"}
    assert {("demo::Point::sum", "helper"), ("demo::Point::far", "sum"), ("demo::run", "sum")} <= pairs(c)


def test_zig():
    n, c = read(
        "a.zig",
        """const std = @import("std");
const text = "const Fake = struct {";
/// A point.
pub const Point = struct {
    x: i32,
    pub fn sum(self: Point) i32 { return helper(self.x); }
};
const Kind = enum { a, b };
fn helper(x: i32) i32 { return x; }
pub fn makePoint() Point { const p = Point{ .x = 1 }; _ = p.sum(); return p; }
""",
        "zig",
    )
    assert {k: v["kind"] for k, v in n.items()} == {"Point": "struct", "Kind": "enum", "Point::sum": "method", "helper": "function", "makePoint": "function"}
    assert n["Point"]["doc"] == "/// A point."
    assert {("Point::sum", "helper"), ("makePoint", "sum")} <= pairs(c)


def test_broken_sources_do_not_crash():
    for language, path in (("rust", "x.rs"), ("go", "x.go"), ("java", "X.java"), ("c", "x.c"), ("cpp", "x.cpp"), ("zig", "x.zig")):
        for text in ("", "{", "}}}", "fn (", "class {", "((((", '"', "/*", "func (a *", "é fn ü() { ß(); }", "import (", "@GetMapping( class X { void f("):
            parse_code(path, text, language)


UNITS = {
    "rust": "/// Doc.\npub struct S{k} {{ n: u32 }}\nimpl S{k} {{\n    fn new(n: u32) -> Self {{ S{k} {{ n }} }}\n    fn add(&self) -> u32 {{ self.n.max(1) + helper({k}) }}\n}}\nfn free{k}() {{ let c = S{k}::new(3); c.add(); }}\n",
    "go": "// Doc.\ntype S{k} struct {{ n int }}\nfunc (s *S{k}) Add(x int) int {{ return s.n + helper(x) }}\nfunc Free{k}() {{ fmt.Println(Free()) }}\n",
    "java": "    /** Doc. */\n    @GetMapping(\"/x{k}\")\n    public int get{k}(List<String> a) {{ if (a.isEmpty()) {{ return helper(a, {k}); }} return new Foo(a).bar(); }}\n",
    "c": "// Doc.\nstruct s{k} {{ int n; }};\nstatic int f{k}(int x) {{ return g(x) + MAX(x, {k}); }}\n",
    "cpp": "class S{k} {{ public: int get() {{ return helper(n); }} int n; }};\nint S{k}::put(int x) {{ return get() + x; }}\n",
    "zig": "const S{k} = struct {{\n    pub fn get(self: S{k}) i32 {{ return helper(self.n); }}\n}};\nfn free{k}() void {{ S{k}.get(1); }}\n",
}


def test_a_large_file_is_read_in_linear_time():
    """About a megabyte of each language, once in lines and once as a single one."""
    for language, unit in UNITS.items():
        n = 1_000_000 // len(unit)
        body = "".join(unit.format(k=k) for k in range(n))
        text = f"package demo;\n@RestController\nclass Big {{\n{body}}}\n" if language == "java" else body
        began = time.time()
        nodes, calls = parse_code(f"big.{language}", text, language)
        assert time.time() - began < 20, language
        assert len(nodes) >= 2 * n and len(calls) >= n, (language, len(nodes), len(calls), n)
        if language in ("java", "c"):
            began = time.time()
            nodes, _ = parse_code(f"big.{language}", "é " + " ".join(x for x in text.split("\n") if not x.strip().startswith("//")), language)
            assert time.time() - began < 20 and len(nodes) >= n, language
