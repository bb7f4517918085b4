"""Operators over inputs given here, against the rows they must give."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarrix.chunking.chunker import Masker, _indent, chunk_files
from quarrix.chunking.languages import BY_EXTENSION, is_known_source, language_of
from quarrix.config import RANGES, EngineConfig, ProviderConfig, in_range
from quarrix.functions import text as T
from quarrix.operators import maintenance, ranking
from quarrix.plans.index import RetrievalIndex
from quarrix.sources import workspace
from quarrix.streaming.watch import snapshot_changes

CASES: dict = {}


def query(schema: str, rows: list[tuple]):
    def register(f):
        CASES[f.__name__] = (f, schema, rows)
        return f

    return register


TOKENS = [
    (0, "语义搜索", "语义|义搜|搜索"), (1, "语义，搜索", "语义|义搜|搜索"), (2, "配", "配"), (3, "连接database池", "连接|database|池"), (4, "。。", ""), (5, "ひらがな", "ひら|らが|がな"), (6, "한국어", "한국|국어"),
    (7, "getHTTPUrl2 x_y", "get|http|url2|x|y"), (8, "café", "caf"), (9, None, ""), (10, "语 义", "语|义"),
]


@query("id int, tokens string, cjk boolean", [(i, t, bool(x) and any(c > "\u3040" for c in x) and x != "。。" if x is not None else None) for i, x, t in TOKENS])
def cjk_tokens(spark, sf_dir):
    rows = spark.createDataFrame([(i, x) for i, x, _ in TOKENS], "id int, text string")
    return rows.select("id", F.array_join(T.tokenize(F.col("text")), "|").alias("tokens"), T.contains_cjk(F.col("text")).alias("cjk"))


@query("id int, tokens string", [(0, "语义搜|义搜索"), (1, "语|义|搜|索"), (2, "语义")])
def cjk_ngrams(spark, sf_dir):
    rows = [("语义搜索", 3), ("语义搜索", 1), ("语义", 3)]
    made = [spark.createDataFrame([(i, t)], "id int, text string").select("id", F.array_join(T.tokenize(F.col("text"), n), "|").alias("tokens")) for i, (t, n) in enumerate(rows)]
    return made[0].unionAll(made[1]).unionAll(made[2])


PATHS = [("src/a.ts", "typescript"), ("b/C.TSX", "typescript"), ("x.mjs", "javascript"), ("m.py", "python"), ("d.go", "go"), ("lib.rs", "rust"), ("A.java", "java"), ("k.kts", "kotlin"), ("s.scala", "scala"), ("v.h", "cpp"), ("v.c", "c"), ("p.cs", "csharp"), ("o.mm", "objectivec"), ("r.rb", "ruby"), ("i.php", "php"), ("w.swift", "swift"), ("z.zsh", "bash"), ("Makefile", None), ("a.tar.gz", None), ("dir.py/file", None), ("", None)]


@query("path string, language string, known boolean", [(p, x, x is not None) for p, x in PATHS])
def path_languages(spark, sf_dir):
    rows = spark.createDataFrame([(p, is_known_source(p)) for p, _ in PATHS], "path string, known boolean")
    return rows.select("path", T.language_for_path(F.col("path")).alias("language"), "known")


@query("language string, n int", [("typescript", 4), ("javascript", 4), ("python", 2), ("go", 1), ("rust", 1), ("java", 1), ("kotlin", 2), ("scala", 2), ("cpp", 7), ("c", 1), ("csharp", 1), ("objectivec", 2), ("ruby", 1), ("php", 1), ("swift", 1), ("bash", 3)])
def languages_by_extension(spark, sf_dir):
    """``h`` belongs to the first language that lists it."""
    rows = spark.createDataFrame([(e, x.name) for e, x in BY_EXTENSION.items()], "extension string, language string")
    return rows.groupBy("language").agg(F.countDistinct("extension").cast("int").alias("n"))


LINES = [
    ("a.ts", "export interface Row {", True), ("a.ts", "return function() {", False), ("a.js", "const go = async (x) => x", True), ("a.py", "  async def f(x):", True), ("a.py", "defer(x)", False), ("a.go", "func (s T) Do() {", True),
    ("a.rs", "pub(crate) async fn run() {", True), ("A.java", "public List<String> all() {", True), ("A.java", "return all();", False), ("a.kt", "sealed interface Shape", True), ("a.scala", "case class P(x: Int)", True),
    ("a.cpp", "void Shape::draw() const", True), ("a.c", "else if (x) {", False), ("a.cs", "internal sealed record Item(int Id);", True), ("a.m", "- (void)sing:(int)n {", True), ("a.rb", "module Deep", True), ("a.php", "abstract class A {", True),
    ("a.swift", "mutating func go() {", True), ("a.sh", "deploy() {", True), ("a.sh", "echo hi", False),
]


@query("path string, line string, opens boolean", LINES)
def symbol_lines(spark, sf_dir):
    return spark.createDataFrame([(p, x, language_of(p).opens_symbol(x)) for p, x, _ in LINES], "path string, line string, opens boolean")


MASKED = [
    ("a.js", 'a = "}" // {', "a =  "), ("a.py", "x = 1 # {", "x = 1 "), ("a.c", "f('{'); /* { */ g();", "f();  g();"), ("a.rb", "y = '{' + z", "y =  + z"), ("a.go", "s := `{` + t", "s :=  + t"), ("a.sh", "echo '{' # }", "echo  "), ("a.cs", 'var s = @"}""{";', "var s = ;"),
]


@query("path string, code string", [(p, c) for p, _, c in MASKED])
def masked_code(spark, sf_dir):
    """What is left of a line without comments and literals."""
    return spark.createDataFrame([(p, Masker(language_of(p)).mask(x)) for p, x, _ in MASKED], "path string, code string")


@query("id int, width int", [(0, 0), (1, 2), (2, 8), (3, 8), (4, 9)])
def leading_indent(spark, sf_dir):
    return spark.createDataFrame([(i, _indent(x, 8)) for i, x in enumerate(["a", "  a", "\ta", "   \ta", "\t a"])], "id int, width int")


@query("name string, least int, default_value int, greatest long", [
    ("max_file_bytes", 1024, 1048576, 1 << 30), ("max_total_bytes", 1024, 536870912, 8 << 30), ("max_lines_per_chunk", 4, 80, 4096), ("ngram", 1, 2, 4), ("top_k", 1, 20, 200),
    ("rrf_k", 1, 60, 1000), ("vector_k", 10, 300, 10000), ("max_files", 10, 20000, 1000000), ("max_chunks", 10, 200000, 5000000), ("watch_debounce_ms", 50, 300, 60000),
])
def config_ranges(spark, sf_dir):
    return spark.createDataFrame([(k, least, value, most) for k, (value, least, most) in RANGES.items()], "name string, least int, default_value int, greatest long")


@query("given double, taken int", [(0.9, None), (1.0, 1), (3.99, 3), (4.5, 4), (5.0, None)])
def floored_or_refused(spark, sf_dir):
    def taken(x):
        try:
            return in_range(x, 1, 4, "ngram")
        except ValueError:
            return None

    return spark.createDataFrame([(x, taken(x)) for x in (0.9, 1.0, 3.99, 4.5, 5.0)], "given double, taken int")


SOURCES = {
    "a.py": "import os\r\n\r\nclass A:\r\n    x = 1\r\n", "b.rs": "// note\nfn go() {\n}\nstatic X: u8 = 1;", "c.txt": "one\rtwo\n\n", "d.cpp": "int area(int w)\n{\n  return w;\n}\nint total;", "e.js": "/* x */\n\n  let   a = 1",
}


@query("rel string, start_line int, end_line int, symbol string, summary string", [
    ("a.py", 1, 2, "", "import os"), ("a.py", 3, 5, "class A:", "class A:"), ("b.rs", 1, 1, "", ""), ("b.rs", 2, 3, "fn go() {", "fn go() {"), ("b.rs", 4, 4, "static X: u8 = 1;", "static X: u8 = 1;"),
    ("c.txt", 1, 4, "", "one"), ("d.cpp", 1, 4, "int area(int w)", "int area(int w)"), ("d.cpp", 5, 5, "", "int total;"), ("e.js", 1, 3, "", "let a = 1"),
])
def code_chunks(spark, sf_dir):
    rows = spark.createDataFrame([(i, rel, x) for i, (rel, x) in enumerate(SOURCES.items())], "file_id long, rel string, content string")
    return chunk_files(rows).select("rel", "start_line", "end_line", "symbol", "summary")


@query("reason string, n long", [("empty", 1), ("not-included", 2), ("too-large", 1), ("binary", 1)])
def skip_reasons(spark, sf_dir):
    rows = [("a.py", 0, False), ("b.exe", 5, False), ("c.png", 9, True), ("d.ts", 2 << 20, False), ("e.md", 7, True), ("f.md", 7, False)]
    return workspace.skip_reasons(spark.createDataFrame(rows, "rel string, size long, is_binary boolean"), EngineConfig().checked())


@query("unit_id long, rank int, vector_score double, lexical_score double", [(2, 1, 0.8, 5.0), (1, 2, 0.9, None), (3, 3, None, 5.0), (4, 4, 0.8, None)])
def fused_ranks(spark, sf_dir):
    """Ties of a channel go by id; a unit of one channel alone stays."""
    v = spark.createDataFrame([(1, 0.9), (2, 0.8), (4, 0.8)], "unit_id long, score double")
    x = spark.createDataFrame([(3, 5.0), (2, 5.0)], "unit_id long, score double")
    rows = ranking.fuse(v, x, 60, 10).collect()
    return spark.createDataFrame([(r.unit_id, i, r.vector_score, r.lexical_score) for i, r in enumerate(rows, 1)], "unit_id long, rank int, vector_score double, lexical_score double")


@query("rel string", [("a",), ("b",)])
def refresh_budget(spark, sf_dir):
    """Of replaced files those before the first that takes the whole over the cap."""
    rows = spark.createDataFrame([(0, "a", 5, 9), (1, "b", 9, 1), (2, "c", 9, 1), (3, "d", 1, 9)], "o long, rel string, new long, old long")
    return maintenance.within_budget(rows, 10, 20, "o", "new", "old").select("rel")


@query("rel string, change string", [("b", "updated"), ("c", "removed"), ("d", "added")])
def polled_changes(spark, sf_dir):
    schema = "rel string, size long, mtime_ms double"
    before = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)], schema)
    return snapshot_changes(before, spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("d", 1, 1.0)], schema))


TREE = {
    "b.py": "def parse_config(path):\n    return path\n", "a/__init__.py": "from .x import y\n", "a/[id].ts": "export class Retry {\n}\n", "z/note.md": "search engine notes\n",
    "A.txt": b"\x80\x80", "node_modules/n.ts": "no", "bin.txt": b"a\0b", "empty.md": "", "pic.png": "x",
}


def _tree() -> str:
    """A small workspace on the driver's machine: these queries, as the source they show, need tasks that see it."""
    root = tempfile.mkdtemp(prefix="quarrix-tree-")
    for rel, content in TREE.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return root


def _config(root: str) -> EngineConfig:
    return EngineConfig(root=root, provider=ProviderConfig("lexical", 64)).checked()


@query("file_ord long, rel string, language string, size long, bytes long, content string", [
    (0, "A.txt", "text", 2, 6, "\ufffd\ufffd"), (1, "b.py", "python", 40, 40, "def parse_config(path):\n    return path\n"), (3, "z/note.md", "text", 20, 20, "search engine notes\n"),
    (4, "a/[id].ts", "typescript", 23, 23, "export class Retry {\n}\n"), (5, "a/__init__.py", "python", 17, 17, "from .x import y\n"),
])
def workspace_scan(spark, sf_dir):
    files, _ = workspace.scan(spark, _config(_tree()))
    return workspace.with_contents(files).select("file_ord", "rel", "language", "size", "bytes", "content")


@query("reason string, n int", [("binary", 1), ("empty", 1), ("not-included", 1)])
def workspace_skips(spark, sf_dir):
    _, listing = workspace.scan(spark, _config(_tree()))
    return spark.createDataFrame(sorted(listing.skipped.items()), "reason string, n int")


@query("file string, start_line int, end_line int, symbol string, snippet string, matched boolean", [
    ("b.py", 1, 3, "def parse_config(path):", "def parse_config(path):\nreturn path", True), ("a/[id].ts", 1, 3, "export class Retry {", "export class Retry {\n}", True),
])
def workspace_hits(spark, sf_dir):
    index = RetrievalIndex(spark, _config(_tree()))
    index.build("full")
    rows = [h for h in index.search("parse retry").hits if h["lexical_score"]]
    return spark.createDataFrame([(h["file"], h["start_line"], h["end_line"], h["symbol"], h["snippet"], h["path"] == f"{index.config.root}/{h['file']}") for h in rows], "file string, start_line int, end_line int, symbol string, snippet string, matched boolean")


@query("step string, added int, updated int, removed int, unchanged int, files long", [("full", 5, 0, 0, 0, 5), ("refresh", 1, 1, 1, 3, 5), ("file", 0, 1, 0, 0, 5), ("gone", 0, 0, 1, 0, 4)])
def workspace_refresh(spark, sf_dir):
    root = _tree()
    index = RetrievalIndex(spark, _config(root))
    done = [("full", index.build("full"))]
    os.unlink(f"{root}/b.py")
    for rel, text in (("z/note.md", "other notes\n"), ("new.go", "func New() {}\n")):
        with open(f"{root}/{rel}", "w") as f:
            f.write(text)
    done.append(("refresh", index.build("refresh")))
    done += [("file", index.reindex_file("new.go")), ("gone", index.reindex_file("missing.go") if index.remove_file("z/note.md") else None)]
    return spark.createDataFrame([(k, r.added, r.updated, r.removed, r.unchanged, r.files) for k, r in done], "step string, added int, updated int, removed int, unchanged int, files long")


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal_case(spark, name):
    f, schema, rows = CASES[name]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    got = [tuple(r[n] for n in names) for r in f(spark, "").select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in rows)
