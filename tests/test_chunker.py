import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrix.chunking.chunker import chunk_text
from quarrix.chunking.languages import LANGUAGES, is_known_source, language_of

# path, then lines; a line that begins with ">" opens a fragment of which it is the symbol, "=" one without or with the outer symbol.
CASES = {
    "ts_class_and_value": ("a.ts", ">const twice = (n: number) => n * 2", "", ">export class Ledger {", "  total = 0", "}", ">export async function load(path: string) {", "}"),
    "ts_types": ("a.ts", ">interface Row { id: number }", ">export type Pair = [Row, Row]", ">enum Side { Left, Right }", ">declare namespace Zoo {", "}"),
    "ts_generator": ("a.ts", ">export function* walk() {", "  yield 1", "}", "=let count = 0"),
    "ts_templates": ("a.ts", ">function page() {", "  return `}${ { a: 1 }.a }`", "}", "=run()"),
    "js_default": ("a.mjs", ">export default class Store {", "}", ">export default function boot() {", "}"),
    "js_division": ("a.js", ">function half(n) {", "  const r = n / 2 / 1 // }", "  return r", "}", "=half(4)"),
    "js_regex": ("a.js", ">function find(s) {", "  return /[{}]/.test(s)", "}", "=find('')"),
    "py_decorated": ("a.py", "=import re", ">@cached", ">async def pull(", "    url,", "):", "    return url"),
    "py_nested": ("a.py", ">class Tree:", "    size = 0", ">    def grow(self):", "        self.size += 1"),
    "py_strings": ("a.py", ">def text():", "    return '''", "def not_code():", "'''", "=value = 1"),
    "go_generic": ("a.go", "=package trees", ">func Map[T any](x []T) {", "}", ">type Stack[T any] struct {", "}", ">type Walker interface {", "}"),
    "go_method": ("a.go", ">func (s *Stack) Push(x int) {", "\ts.a = `}`", "}"),
    "rust_items": ("a.rs", ">pub(crate) struct Node<'a> {", "}", ">impl<'a> Node<'a> {", ">    pub const fn size(&self) -> usize { 1 }", "=}", ">macro_rules! list {", "}"),
    "rust_raw": ("a.rs", ">fn raw() {", '    let s = r##"}"#"##;', "}", ">static LIMIT: u8 = 1;"),
    "java_members": ("A.java", ">public final class Shop {", "    int sold;", ">    protected List<String> names(int k) throws IOException {", "        return null;", "    }", "=    int left;", "}"),
    "java_record": ("A.java", ">record Point(int x, int y) {}", ">@interface Tested {", "}"),
    "kotlin": ("a.kt", ">data class Person(val name: String)", ">suspend fun greet(p: Person) {", "    println(\"}\")", "}", ">companion object {", "}"),
    "scala": ("a.scala", ">case class Cell(v: Int)", ">object Grid {", ">  private[grid] def at(i: Int) = {", "    i", "  }", "=}"),
    "cpp_allman": ("a.cpp", ">int area(int w, int h)", "{", "  return w * h;", "}", ">void Shape::draw() const", "{", "}", "=int total = 0;"),
    "cpp_return_line": ("a.cc", ">>unsigned long sum(int a)", "unsigned long", "sum(int a)", "{", "  return a;", "}", "=int k;"),
    "cpp_template": ("a.hpp", ">template <typename T> class Box {", ">  T get() const { return t; }", "=};", ">namespace deep {", "}"),
    "cpp_constructor": ("a.cpp", ">Shape::Shape(int n) : sides(n) {", "}", ">Shape::~Shape() {", "}"),
    "c_types": ("a.c", ">typedef struct pair {", "  int a;", "} pair;", ">static const char *name(void) {", '  return "}";', "}"),
    "c_calls_are_no_symbols": ("a.c", ">int main(void) {", "  if (ready(1)) {", "    go(2);", "  }", "  return stop(3);", "}"),
    "csharp": ("a.cs", ">namespace Shop {", ">  public sealed record Item(int Id);", ">  internal async Task<int> Count(string path) {", '    var s = @"}""{";', "    return 1;", "  }", "=}"),
    "objc": ("a.m", ">@interface Bird : NSObject", ">- (void)sing:(int)times;", "=@end", ">@implementation Bird", ">- (void)sing:(int)times {", "}"),
    "ruby_shift": ("a.rb", "=x = 1; y = x <<FOO", ">class Late", "end"),
    "ruby_heredoc": ("a.rb", ">def page", "  puts <<~html", "    end", "    def no", "  html", "end", "=page"),
    "ruby_append": ("a.rb", ">def add(list)", "  list <<item", "end", "=add []"),
    "ruby_private": ("a.rb", ">class Safe", ">  private def key = 1", ">  private", ">  def lock", "  end", "=end"),
    "php_page": ("a.php", "=<p>function no() {</p>", "<?php", ">function yes() {", "  return 1;", "}", "?>", "<p>class Neither {</p>", "<?php", ">final class Also {", "}"),
    "php_heredoc": ("a.php", "=<?php", ">function t() {", "  return <<<X", "  }", "  X;", "}"),
    "swift": ("a.swift", ">public struct Deck {", ">  init(n: Int) {", "  }", ">  mutating func shuffle() {", '    let s = #"}"#', "  }", "=}", ">actor Bank {", "}"),
    "bash": ("a.sh", ">function greet {", "  echo hi", "}", ">deploy() {", "  cat <<eof", "}", "eof", "}", "=greet"),
    "bash_arithmetic": ("a.sh", ">f() {", "  x=$((1 <<two))", "}", "=f"),
    "text": ("a.txt", "=def not(code):", "class Nor { }"),
}


@pytest.mark.parametrize("case", CASES)
def test_symbols(case):
    path, *lines = CASES[case]
    if lines[0].startswith(">>"):
        want = [(1, lines[0][2:])]
        lines = lines[1:]
        marked = [(i, x) for i, x in enumerate(lines, 1) if x.startswith(("=", ">"))]
        want += [(i, x[1:].strip()) if x[0] == ">" else (i, None) for i, x in marked]
    else:
        want = [(i, x[1:].strip()) if x[0] == ">" else (i, None) for i, x in enumerate(lines, 1) if x.startswith(("=", ">")) and not x.startswith("=begin")]
    source = "\n".join(x[1:] if x.startswith((">", "=")) else x for x in lines)
    found = chunk_text(source, language_of(path))
    assert [(c.start_line, w and c.symbol) for c, (_, w) in zip(found, want, strict=False)] == want
    assert len(found) == len(want)


def test_known_sources():
    assert is_known_source("a/b.rs") and is_known_source("X.TSX") and not is_known_source("a.unknown") and not is_known_source("Makefile")


def test_long_runs_are_cut_at_blank_lines():
    found = chunk_text("\n".join("" if i == 7 else str(i) for i in range(25)), None, 10)
    assert [(c.start_line, c.end_line) for c in found] == [(1, 8), (9, 18), (19, 25)]


def test_line_ends_and_empty():
    assert chunk_text("", None) == []
    assert [c.content for c in chunk_text("a\r\nb\rc", None)] == ["a\nb\nc"]


def test_summary_skips_comments():
    assert chunk_text("// x\n\n  a  = 1", language_of("a.js"))[0].summary == "a = 1"


@settings(max_examples=100, deadline=None)
@given(st.sampled_from([x.extensions[0] for x in LANGUAGES] + ["txt"]), st.lists(st.sampled_from(["", "}", "{", "def f():", "class A {", "function g() {", "  x = '", "end", "/*", "*/", "`", "return 1", "@end", "fun k() = 1", "<<EOS", "EOS", '"""', "int", "f(int a)", "<?php", "?>", "a" * 30]), max_size=60), st.integers(4, 12))
def test_chunks_tile_the_text(extension, lines, limit):
    text = "\n".join(lines)
    found = chunk_text(text, language_of(f"a.{extension}"), limit)
    assert "\n".join(c.content for c in found) == text or not text
    at = 1
    for c in found:
        assert c.start_line == at and c.end_line >= at and c.end_line - c.start_line + 1 <= limit
        at = c.end_line + 1


@pytest.mark.parametrize("language", LANGUAGES, ids=lambda x: x.name)
def test_every_language_survives_noise(language):
    text = "\n".join(["\\", "'", '"', "`", "<<", "<<<A", "r#\"", "@\"", "#/", "/", "${", "}", "=begin", "*/", "/*"] * 3)
    assert chunk_text(text, language)
