"""Cuts a text into line fragments that follow its symbols.

A masking scanner first blanks out comments and literals, so that what counts
(braces, indentation, ``end`` words, symbol headers) is code.  Fragments tile
the text: no line is lost or repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .languages import BARE_FUNCTION, BARE_TYPE, Language, language_of

CHUNK = "start_line int, end_line int, symbol string, content string, summary string"


@dataclass(frozen=True)
class Chunk:
    start_line: int
    end_line: int
    symbol: str
    content: str
    summary: str


def collapse(line: str, limit: int = 200) -> str:
    flat = re.sub(r"\s+", " ", line).strip()
    return flat if len(flat) <= limit else flat[: limit - 1] + "…"


def summary_of(lines: list[str], symbol: str, language: Language | None) -> str:
    """The symbol, else the first line that is neither blank nor a comment."""
    if symbol:
        return symbol
    comments = language.comments if language else ()
    return next((collapse(x) for x in lines if x.strip() and not x.strip().startswith(comments or ("\0",))), "")


# What opens a stretch to blank out, tried in this order: name -> (pattern, languages or all).
_TRIPLE = ("python", "java", "kotlin", "scala", "swift")
_NESTED = ("kotlin", "rust", "scala", "swift")
_REGEX_BEFORE = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*~^<>%]|\b(?:return|typeof|case|in|of|throw|void|delete|yield|await))\s*$")


class Masker:
    """Replaces comments and literals by blanks, line by line; keeps what is still open between lines."""

    def __init__(self, language: Language | None):
        self.name = language.name if language else ""
        self.slashes = bool(language) and "//" in language.comments
        self.hashes = bool(language) and "#" in language.comments
        self.open: tuple[str, str] | None = None  # kind, closing text
        self.depth = 0
        self.heredocs: list[tuple[str, bool]] = []
        self.templates: list[int] = []  # brace depth inside each open ${ }
        self.locals: set[str] = set()  # Ruby's local variables so far: after one, << shifts
        self.outside = False  # PHP: in the page around the code

    def mask(self, line: str) -> str:
        if self.heredocs and not self.open:
            end, indented = self.heredocs[0]
            if (line.strip() if indented else line.rstrip()) == end or self.name == "php" and re.match(rf"\s*{re.escape(end)}\b", line):
                self.heredocs.pop(0)
            return ""
        out, i = [], 0
        if self.outside:
            begin = re.search(r"<\?(?:php\b|=)?", line)
            if not begin:
                return ""
            self.outside, i = False, begin.end()
        while i < len(line):
            i = self._inside(line, i) if self.open else self._code(line, i, out)
        if self.open and self.open[0] == "quote":
            self.open = None  # plain literals end with their line
        code = "".join(out)
        if self.name == "ruby":
            self.locals.update(_assigned(code))
        return code

    def _inside(self, line: str, i: int) -> int:
        kind, close = self.open
        if kind == "comment":
            if self.name in _NESTED and line.startswith("/*", i):
                self.depth += 1
                return i + 2
            if line.startswith(close, i):
                self.depth -= 1
                if self.depth <= 0:
                    self.open = None
                return i + len(close)
            return i + 1
        if kind != "raw" and line[i] == "\\":
            return i + 2
        if kind == "template" and line.startswith("${", i):
            self.templates.append(0)
            self.open = None
            return i + 2
        if line.startswith(close, i):
            if kind == "raw" and close == '"' and line.startswith('""', i):
                return i + 2  # a doubled quote stays inside
            self.open = None
            return i + len(close)
        return i + 1

    def _code(self, line: str, i: int, out: list[str]) -> int:
        c, rest = line[i], line[i:]
        if self.templates:
            if c == "{":
                self.templates[-1] += 1
            elif c == "}":
                if self.templates[-1] == 0:
                    self.templates.pop()
                    self.open = ("template", '"' if self.name == "kotlin" else "`")
                    return i + 1
                self.templates[-1] -= 1
        if self.slashes and rest.startswith("//") or self.hashes and c == "#" and (i == 0 or line[i - 1] in " \t;") and not rest.startswith("#["):
            return len(line)
        if self.slashes and rest.startswith("/*"):
            self.open, self.depth = ("comment", "*/"), 1
            return i + 2
        if self.name == "ruby" and i == 0 and rest.startswith("=begin"):
            self.open, self.depth = ("comment", "=end"), 1
            return len(line)
        if self.name == "php" and rest.startswith("?>"):
            begin = re.search(r"<\?(?:php\b|=)?", rest)
            self.outside = not begin
            return i + begin.end() if begin else len(line)
        if rest.startswith("<<") and (m := self._heredoc(rest, "".join(out))):
            self.heredocs.append((m[3], bool(m[1])))
            return i + m.end()
        if self.name == "rust" and (m := re.match(r"[bc]?r(#*)\"", rest)) and not (i and (line[i - 1].isalnum() or line[i - 1] == "_")):
            self.open = ("raw", '"' + m[1])
            return i + m.end()
        if self.name == "swift" and (m := re.match(r"(#+)([\"/])", rest)):
            self.open = ("raw", m[2] + m[1])
            return i + m.end()
        if self.name == "csharp" and (m := re.match(r"\$*\"{3,}|\$?@\$?\"", rest)):
            self.open = ("raw", '"' * m[0].count('"'))
            return i + m.end()
        for quote in ('"""', "'''"):
            if self.name in _TRIPLE and rest.startswith(quote) and (quote == '"""' or self.name == "python"):
                self.open = ("raw" if self.name in ("kotlin", "scala") else "long", quote)
                return i + 3
        if c == "`" and self.name in ("javascript", "typescript", "go"):
            self.open = ("raw" if self.name == "go" else "template", "`")
            return i + 1
        if c == '"' or c == "'":
            return self._quote(line, i, out)
        if c == "/" and self.name in ("javascript", "typescript", "ruby") and _REGEX_BEFORE.search("".join(out)) and (m := re.match(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]])*\]|[^/\\\[])+/", rest)):
            return i + m.end()
        out.append(c)
        return i + 1

    def _heredoc(self, rest: str, before: str) -> re.Match | None:
        """The opening of a literal that fills the lines below, unless ``<<`` shifts a number or appends to a value."""
        if self.name == "php":
            return re.match(r"<<<[ \t]*()(['\"]?)(\w+)\2", rest)
        if self.name == "bash":
            arithmetic = before.count("((") > before.count("))")
            return None if arithmetic else re.match(r"<<(-?)[ \t]*(['\"]?)\\?(\w+)\2", rest)
        if self.name != "ruby":
            return None
        left = re.search(r"([\w@$?!]+|[)\]}])(\s*)$", before)
        value = left and (left[1] in self.locals | _assigned(before) or left[1][0] in "@$)]}0123456789" or not left[2] and re.match(r"\w", left[1]) or left[1] == "class")
        return None if value else re.match(r"<<([-~]?)(['\"`]?)([A-Za-z_]\w*)\2", rest)

    def _quote(self, line: str, i: int, out: list[str]) -> int:
        c, rest = line[i], line[i:]
        if c == "'" and (self.name in ("rust", "scala") and not re.match(r"'(?:\\.[^']*|[^'\\])'", rest) or self.name in ("cpp", "c") and i and line[i - 1].isalnum()):
            return i + 1  # a lifetime, symbol or digit separator
        keeps_open = self.name in ("bash", "php", "ruby")
        self.open = ("template", '"') if self.name == "kotlin" and c == '"' else ("raw" if self.name == "bash" and c == "'" else "long" if keeps_open else "quote", c)
        return i + 1


def _assigned(code: str) -> set[str]:
    """Names that Ruby code makes local variables: assigned, parameters of a method or of a block."""
    found = set(re.findall(r"\b([a-z_]\w*)\s*(?:[-+*/|&]|\|\||&&)?=(?![=~>])", code))
    for params in re.findall(r"\bdef\s+[\w.?!]+[ (]([^)]*)|\|([^|]*)\|", code):
        found.update(re.findall(r"[a-z_]\w*", " ".join(params)))
    return found


_END_OPENERS = re.compile(r"(?:^|;|=|\bthen\b)\s*(?:class|module|def|if|unless|case|begin|while|until|for)\b|\bdo\b")
_ENDLESS = re.compile(r"^\s*def\s+[\w.?!]+(?:\([^)]*\))?\s+=\s")


@dataclass
class _Scope:
    symbol: str
    mode: str
    base: int
    begun: bool = False


def _indent(line: str, tab: int) -> int:
    width = 0
    for c in line:
        if c == "\t":
            width += tab - width % tab
        elif c == " ":
            width += 1
        else:
            break
    return width


def _blankish(line: str) -> bool:
    return line.strip() in ("", "{", "}", ";")


def chunk_text(text: str, language: Language | None, max_lines: int = 80) -> list[Chunk]:
    """Fragments of at most ``max_lines`` lines, each with the innermost symbol it lies in.

    An overlong run is cut after its last blank or lone-brace line beyond half
    the limit, else at the limit.  Without a language only that rule holds.
    """
    text = re.sub(r"\r\n?", "\n", text)
    if not text:
        return []
    lines = text.split("\n")
    chunks: list[Chunk] = []
    scopes: list[_Scope] = []
    start, braces, ends = 0, 0, 0
    masker = Masker(language)
    masker.outside = masker.name == "php" and "<?" in text
    c_like = masker.name in ("c", "cpp", "objectivec")
    before = ""  # the code of the line before, if it can be the type of a declaration that goes on

    def flush(end: int, symbol: str) -> None:
        nonlocal start
        if end > start:
            own = lines[start:end]
            chunks.append(Chunk(start + 1, end, symbol, "\n".join(own), summary_of(own, symbol, language)))
            start = end

    def label() -> str:
        return scopes[-1].symbol if scopes else ""

    for i, line in enumerate(lines):
        inside_literal = masker.open is not None or bool(masker.heredocs)
        code = masker.mask(line) if language else line
        structural = bool(code.strip()) and not inside_literal
        if language and structural:
            while scopes and _over(scopes[-1], code, line, braces, ends):
                flush(i, label())
                scopes.pop()
            split = c_like and bool(before) and bool(BARE_FUNCTION.match(code.strip()))
            if split or language.opens_symbol(code) or (language.name == "typescript" and language.opens_symbol(line)):
                flush(i - split, label())
                mode = "line" if language.name == "python" and code.strip().startswith("@") else language.body
                if language.body == "end" and (_ENDLESS.match(code) or code.strip().split()[0] in ("private", "protected") and "def" not in code):
                    mode = "line"
                if language.name == "scala" and code.rstrip().endswith(":"):
                    mode = "indent"
                at = {"brace": braces, "end": ends, "indent": _indent(line, 8), "objc": braces, "line": 0}[mode]
                scopes.append(_Scope(collapse(f"{before} {line.strip()}" if split else line), mode, at))
        before = code.strip() if c_like and structural and BARE_TYPE.match(code.strip()) and not language.opens_symbol(code) else ""
        braces += code.count("{") - code.count("}")
        if language and language.body == "end":
            ends += len(_END_OPENERS.findall(code)) - len(re.findall(r"\bend\b", code)) - bool(_ENDLESS.match(code))
        for scope in scopes:
            if scope.mode in ("brace", "objc"):
                scope.begun |= "{" in code and braces >= scope.base
            elif scope.mode == "end":
                scope.begun = True
        if language and language.body == "objc" and structural and code.strip().startswith("@end"):
            if i - start + 1 <= max_lines:
                flush(i + 1, label())
            scopes.clear()
        if i - start + 1 > max_lines:
            cut = next((j + 1 for j in range(i - 1, start + max_lines // 2 - 1, -1) if _blankish(lines[j])), start + max_lines)
            flush(cut, label())
    flush(len(lines), label())
    return chunks


def _over(scope: _Scope, code: str, line: str, braces: int, ends: int) -> bool:
    """Whether the scope has ended before this line of code."""
    bare = code.strip()
    if scope.mode == "line":
        return True
    if scope.mode == "indent":
        return _indent(line, 8) <= scope.base and not bare.startswith((")", "]", "}"))
    if scope.mode == "end":
        return scope.begun and ends <= scope.base
    if scope.mode == "objc" and scope.symbol.startswith("@"):
        return False
    if scope.begun:
        return braces <= scope.base
    # Without a body so far: the header goes on over brackets and operators, else it was a declaration.
    return not bare.startswith(("{", ")", "]", ".", ":", "?", "=", "|", "&", "where", "throws", "requires", "->", "extends", "implements")) and not scope_open(scope.symbol)


def scope_open(header: str) -> bool:
    """Whether a header line leaves brackets or an operator open."""
    return header.count("(") > header.count(")") or header.rstrip().endswith((",", "=>", "=", "(", "<", "|", "&", "+", "->", ":"))


def chunk_files(files: DataFrame, max_lines: int = 80) -> DataFrame:
    """``file_id, rel`` of ``files(file_id, rel, content)`` with the columns of ``CHUNK``, a row for each fragment.

    Null contents count as empty and give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), ("rel", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("content", pa.string()), ("summary", pa.string())])
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                rows = [
                    (file_id, rel, c.start_line, c.end_line, c.symbol, c.content, c.summary)
                    for file_id, rel, content in zip(*(x.to_pylist() for x in batch.slice(low, 200).columns), strict=True)
                    for c in chunk_text(content or "", language_of(rel or ""), max_lines)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, schema.types, strict=True)], schema=schema)

    return files.selectExpr("cast(file_id AS long)", "cast(rel AS string)", "cast(content AS string)").mapInArrow(run, f"file_id long, rel string, {CHUNK}")
