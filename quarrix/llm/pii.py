"""Personal data in texts: rules of form, and a semi-Markov conditional random field for what they miss.

The rules take the leftmost matches of each kind and drop those that fail a
check.  A match that runs on into a neighbouring number is dropped as a whole:
two cards in a row, a phone number before an address.  The field looks at the
same places again.  Candidate segments are runs of digit groups (or spelled-out
addresses) of bounded length; features see a whole candidate: its digits and
groups, its separators, its check digit, what stands before and after it.
Dynamic programming over the boundaries then chooses segments and types
together.  Text between candidates has only one reading, so that each island
of candidates is decoded alone and no text is cut short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, staged

KINDS = ("email", "ip", "card", "phone")
_LABELS = ("outside", *KINDS)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match begins where a run of digits does: the first part takes all of it, so a later beginning fails with it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NUMBERS = re.compile(r"[+(]{0,2}[0-9]++(?:[\x20().\-/+]{1,3}[0-9]++)*+")
_AT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s|\s?@\s?", re.IGNORECASE)
_SPELLED = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sdot\s", re.IGNORECASE)
_DOT = re.compile(r"\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-])")
_GROUPS = 8  # digit groups of a segment, at most
_GAP = 2  # characters between neighbours that still know of each other
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right counts double."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _bare(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[Span]:
    """``start, end, kind`` by the rules, in order of start, then kind; time grows with the text alone."""
    found: list[Span] = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            # The part before the sign has no other sign in it.
            low = max(done, text.rfind("@", done, m.start()) + 1)
            start = low + len(text[low : m.start()].rstrip(_LOCAL))
            if start < m.start():
                found.append((start, m.end(), "email"))
                done = m.end()
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _bare(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_bare(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _class(text: str, at: int) -> str:
    """The kind of character at a place; the ends of the text are one of their own."""
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "digit" if c in "0123456789" else "letter" if c.isalpha() else "blank" if c.isspace() else c if c in ".-+@/:=\"'(),#" else "other"


def _around(text: str, start: int, end: int) -> list[str]:
    """What stands before and after; over a blank or point also what comes next."""
    out = []
    for name, at, step in (("before", start - 1, -1), ("after", end, 1)):
        c = _class(text, at)
        out.append(f"{name}={c}{_class(text, at + step) if c in ('blank', '.', '-', '/') else ''}")
    return out


def _number_features(text: str, start: int, end: int, groups: list[str], kind: str) -> list[str]:
    digits = "".join(groups)
    shape = "-".join(str(min(len(g), 20)) for g in groups[:6]) + ("+" if len(groups) > 6 else "")
    seps = "".join(sorted(set(text[start:end]) - set("0123456789")))
    fits = luhn(digits) if kind == "card" else kind == "ip" and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    own = [kind, f"digits={len(digits)}", f"shape={shape}", f"seps={seps}", f"fits={fits}", f"fits={fits},digits={len(digits)}", f"fits={fits},seps={seps}", f"fits={fits},lead={digits[0]}", f"shape={shape},seps={seps}"]
    return [f"{kind}:{f}" for f in own + _around(text, start, end)]


def _email_features(text: str, start: int, end: int, at: str, dots: list[str], last: str) -> list[str]:
    def form(s: str) -> str:
        return re.sub(r"[A-Za-z]+", "w", re.sub(r"\s+", "_", s))

    more = _NAME.match(text, d.end()) is not None if (d := _DOT.match(text, end)) else False
    own = ["email", f"at={form(at)}", f"dots={','.join(sorted({form(d) for d in dots}))}", f"labels={len(dots) + 1}", f"last={'word' if last.isalpha() and 2 <= len(last) <= 12 else 'no'}", f"longer={more}", f"at={form(at)},dot={form(dots[-1])}"]
    return [f"email:{f}" for f in own + _around(text, start, end)]


Candidate = tuple[int, int, int, list[str]]  # start, end, label, features


def candidates(text: str) -> list[Candidate]:
    """All segments that can be an entity, of at most 8 groups of digits or 5 names of a domain."""
    out: list[Candidate] = []
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in _DIGITS.finditer(text, m.start(), m.end())]
        for i, (first, _) in enumerate(groups):
            low = first
            while low > m.start() and low > first - 2 and text[low - 1] in "+(":
                low -= 1
            n, parts = 0, []
            for j in range(i, min(len(groups), i + _GROUPS)):
                a, b = groups[j]
                n += b - a
                if n > 19:
                    break
                parts.append(text[a:b])
                # An opening bracket belongs to the segment only with its closing one.
                start = low if ")" in text[first:b] else low + (text[low:first].rfind("(") + 1)
                between = [text[groups[k][1] : groups[k + 1][0]] for k in range(i, j)]
                for kind, ok in (("ip", len(parts) == 4 and all(s == "." for s in between)), ("card", n >= 12 and "+" not in text[start:b] and "(" not in text[start:b]), ("phone", 7 <= n <= 15)):
                    if ok:
                        out.append((start, b, _LABELS.index(kind), _number_features(text, start, b, parts, kind)))
    if _SPELLED.search(text):
        done = 0
        for m in _AT.finditer(text):
            low = max(done, m.start() - 64)
            start = low + len(text[low : m.start()].rstrip(_LOCAL))
            if start < m.start() and not (start == m.start() - 64 and start and text[start - 1] in _LOCAL):
                at, dots, place = m[0], [], m.end()
                name = _NAME.match(text, place)
                while name and len(dots) < 4 and (dot := _DOT.match(text, name.end())) and (name := _NAME.match(text, dot.end())):
                    dots.append(dot[0])
                    out.append((start, name.end(), 1, _email_features(text, start, name.end(), at, list(dots), name[0])))
            done = m.end()
    return out


def islands(found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Candidates that overlap or nearly touch stay together."""
    now: list[Candidate] = []
    reach = 0
    for c in sorted(found, key=lambda c: c[:3]):
        if now and c[0] > reach + _GAP:
            yield now
            now = []
        reach = c[1] if not now else max(reach, c[1])
        now.append(c)
    if now:
        yield now


@dataclass
class SemiMarkovField:
    """Weights of whole-segment features and of a segment's label after its neighbour's."""

    weights: dict[str, float] = field(default_factory=dict)

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def transitions(self) -> np.ndarray:
        return np.array([[self.weights.get(f"{a}>{b}", 0.0) if b != "outside" else 0.0 for b in _LABELS] for a in _LABELS])

    def decode(self, text: str, island: list[Candidate]) -> list[Candidate]:
        """The best set of segments that do not overlap; none where nothing beats leaving the text outside."""
        lattice = _Lattice(text, island)
        return [island[k] for k in lattice.best(np.array([self.score(c[3]) for c in island]), self.transitions())]


class _Lattice:
    """Boundaries of an island's candidates, steps between them, and segments as edges."""

    def __init__(self, text: str, island: list[Candidate]):
        self.places = sorted({p for c in island for p in c[:2]})
        at = {p: i for i, p in enumerate(self.places)}
        self.label = [c[2] for c in island]
        self.edges = [(at[c[0]], at[c[1]]) for c in island]
        self.ending: list[list[int]] = [[] for _ in self.places]
        self.starting: list[list[int]] = [[] for _ in self.places]
        for k, (a, b) in enumerate(self.edges):
            self.ending[b].append(k)
            self.starting[a].append(k)
        # Over a short gap without letters or digits, the next segment still knows the last one's label.
        self.keeps = [b - a <= _GAP and not any(c.isalnum() for c in text[a:b]) for a, b in zip(self.places, self.places[1:], strict=False)]

    def best(self, scores: np.ndarray, transitions: np.ndarray) -> list[int]:
        n = len(self.places)
        value = np.full((n, len(_LABELS)), -np.inf)
        back: list[list] = [[None] * len(_LABELS) for _ in range(n)]
        value[0, 0] = 0.0
        for p in range(1, n):
            for y in range(len(_LABELS)):
                to = y if self.keeps[p - 1] else 0
                if value[p - 1, y] > value[p, to]:
                    value[p, to], back[p][to] = value[p - 1, y], (p - 1, y, None)
            for k in self.ending[p]:
                before = value[self.edges[k][0]] + transitions[:, self.label[k]]
                y = int(before.argmax())
                if before[y] + scores[k] > value[p, self.label[k]]:
                    value[p, self.label[k]], back[p][self.label[k]] = before[y] + scores[k], (self.edges[k][0], y, k)
        out, p, y = [], n - 1, int(value[n - 1].argmax())
        while p:
            p, y, k = back[p][y]
            if k is not None:
                out.append(k)
        return out[::-1]

    def expected(self, scores: np.ndarray, transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log partition function, probability of each segment, expected transitions into segments."""
        n, m = len(self.places), len(_LABELS)
        alpha, beta = np.full((n, m), -np.inf), np.full((n, m), -np.inf)
        alpha[0, 0] = 0.0
        for p in range(1, n):
            if self.keeps[p - 1]:
                alpha[p] = alpha[p - 1]
            else:
                alpha[p, 0] = np.logaddexp.reduce(alpha[p - 1])
            for k in self.ending[p]:
                y = self.label[k]
                alpha[p, y] = np.logaddexp(alpha[p, y], np.logaddexp.reduce(alpha[self.edges[k][0]] + transitions[:, y]) + scores[k])
        beta[n - 1] = 0.0
        for p in range(n - 2, -1, -1):
            beta[p] = beta[p + 1] if self.keeps[p] else beta[p + 1, 0]
            for k in self.starting[p]:
                y = self.label[k]
                beta[p] = np.logaddexp(beta[p], transitions[:, y] + scores[k] + beta[self.edges[k][1], y])
        total = float(np.logaddexp.reduce(alpha[n - 1]))
        chance, moves = np.zeros(len(self.edges)), np.zeros((m, m))
        for k, (a, b) in enumerate(self.edges):
            y = self.label[k]
            each = np.exp(alpha[a] + transitions[:, y] + scores[k] + beta[b, y] - total)
            chance[k] = each.sum()
            moves[:, y] += each
        return total, chance, moves


def _gold(lattice: _Lattice, island: list[Candidate], spans: set[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Which segments are right, and the transitions along them."""
    right = np.array([(c[0], c[1], _LABELS[c[2]]) in spans for c in island])
    moves, y = np.zeros((len(_LABELS), len(_LABELS))), 0
    starts = {lattice.edges[k][0]: k for k in np.flatnonzero(right).tolist()}
    p = 0
    while p < len(lattice.places) - 1:
        if (k := starts.get(p)) is not None:
            moves[y, lattice.label[k]] += 1
            p, y = lattice.edges[k][1], lattice.label[k]
        else:
            y = y if lattice.keeps[p] else 0
            p += 1
    return right, moves


def fit(examples: list[tuple[str, set[Span]]], epochs: int = 6, rate: float = 0.3, penalty: float = 1e-3, seed: int = 5) -> SemiMarkovField:
    """Maximum conditional likelihood by adaptive gradient steps; ``examples`` are texts with all their entities."""
    names: dict[str, int] = {}
    made = []
    for text, spans in examples:
        for island in islands(candidates(text)):
            lattice = _Lattice(text, island)
            rows = [np.array([names.setdefault(f, len(names)) for f in c[3]]) for c in island]
            made.append((lattice, rows, *_gold(lattice, island, spans)))
    m = len(_LABELS)
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-2)
    t, seen_t = np.zeros((m, m)), np.full((m, m), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(made)).tolist():
            lattice, rows, right, moves = made[i]
            _, chance, walked = lattice.expected(np.array([w[r].sum() for r in rows]), t)
            at = np.concatenate(rows)
            step = np.bincount(at, np.repeat(right - chance, [len(r) for r in rows]), len(w)) - penalty * w
            seen += step**2
            w += rate * step / np.sqrt(seen)
            step = moves - walked - penalty * t
            seen_t += step**2
            t += rate * step / np.sqrt(seen_t)
    weights = {f: float(w[i]) for f, i in names.items()}
    return SemiMarkovField(weights | {f"{a}>{b}": float(t[i, j]) for i, a in enumerate(_LABELS) for j, b in enumerate(_LABELS) if b != "outside"})


def _pieces(text: str) -> Iterator[tuple[str, str]]:
    """``kind, piece`` to learn from: entities by the rules, and numbers that are none ("none")."""
    found = base_spans(text)
    covered = 0
    for start, end, kind in found:
        if start >= covered and end - start <= 100:
            yield kind, text[start:end]
        covered = max(covered, end)
    taken = np.zeros(len(text) + 1, np.int64)
    for start, end, _ in found:
        taken[start] += 1
        taken[end] -= 1
    inside = np.cumsum(taken) > 0
    for m in re.finditer(r"[0-9]+(?:[.\-/:][0-9]+)*", text):
        # A number beside an entity, or part of a longer match that failed, may be one.
        if m.end() - m.start() <= 40 and not inside[max(0, m.start() - 3) : m.end() + 3].any() and not _DIGITS.search(text[max(0, m.start() - 3) : m.start()] + text[m.end() : m.end() + 3]):
            yield "none", m[0]


def pieces(docs: DataFrame, most: int, text_col: str = "text") -> list[tuple[str, str]]:
    """``kind, piece``: of each kind the ``most`` distinct ones of least hash, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {x for t in batch.column(0).to_pylist() if t for x in _pieces(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["kind", "piece"])

    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind string, piece string").distinct()
    hashed = staged(made.select("kind", "piece", F.xxhash64("piece").alias("h")), "pieces")
    rows = [r for kind in (*KINDS, "none") for r in hashed.where(F.col("kind") == kind).orderBy("h", "piece").limit(most).collect()]
    drop(hashed)
    return [(r.kind, r.piece) for r in rows]


def _other_form(rng: np.random.Generator, kind: str, piece: str) -> str:
    """The same entity or number as it is also written; the rules do not know all of these forms."""
    if kind == "email":
        at, dot = [(" [at] ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), (" AT ", " DOT ")][rng.integers(6)]
        return piece.replace("@", at).replace(".", dot) if dot == "." else piece.split("@")[0] + at + piece.split("@")[1].replace(".", dot)
    if kind == "phone":
        digits = _bare(piece)
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits}", f"{digits[:-10] or '1'}-{a}-{b}-{c}"][rng.integers(5)] if len(digits) >= 10 else piece
    if kind in ("card", "none") and re.fullmatch(r"[0-9]{16}", piece):
        return "./- "[rng.integers(4)].join(piece[i : i + 4] for i in range(0, 16, 4))
    return piece


def compose(known: list[tuple[str, str]], n: int, seed: int = 11) -> list[tuple[str, set[Span]]]:
    """``n`` lines of known pieces in a row, in their own and other forms, with the spans of the entities."""
    rng = np.random.default_rng(seed)
    by_kind = {k: [p for kind, p in known if kind == k] for k in (*KINDS, "none")}
    # A number that is no entity for certain: groups of digits as in lists, sums and dates.
    kinds = [k for k in (*KINDS, "none") if by_kind[k]]
    out = []
    for _ in range(n if kinds else 0):
        text, spans = ["", "word ", "of the ", "no. "][rng.integers(4)], set()
        for k in range(1 + int(rng.integers(3))):
            kind = kinds[rng.integers(len(kinds))]
            if rng.random() < 0.25:
                kind, piece = "none", " ".join(str(rng.integers(10 ** int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 7))))
            else:
                piece = by_kind[kind][rng.integers(len(by_kind[kind]))]
                if rng.random() < 0.4:
                    piece = _other_form(rng, kind, piece)
            if k:
                text += [" ", " ", ", ", " and ", "\n"][rng.integers(5)]
            if kind != "none":
                spans.add((len(text), len(text) + len(piece), kind))
            text += piece
        text += ["", ".", " word", ", of"][rng.integers(4)]
        out.append((text, spans))
    return out


def train(docs: DataFrame, most: int = 400, examples: int = 2000, text_col: str = "text") -> SemiMarkovField:
    """Learns from lines composed of at most ``most`` known pieces of each kind; without any, the field adds nothing."""
    return fit(compose(pieces(docs, most, text_col), examples))


def all_spans(text: str, model: SemiMarkovField) -> list[tuple[int, int, str, bool]]:
    """``start, end, kind, base``: spans by the rules, and what the field adds beside them."""
    found = base_spans(text)
    out = [(*s, True) for s in found]
    merged: list[list[int]] = []
    for start, end, _ in found:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    starts = np.array([a for a, _ in merged], np.int64)
    ends = np.array([b for _, b in merged], np.int64)

    def is_free(c: Candidate) -> bool:
        i = int(np.searchsorted(ends, c[0], "right"))
        return i == len(ends) or starts[i] >= c[1]

    # Spans by the rules stay, so readings that overlap one are not open.
    free = [c for c in candidates(text) if is_free(c)]
    for island in islands(free):
        out += [(c[0], c[1], _LABELS[c[2]], False) for c in model.decode(text, island)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_spans(docs: DataFrame, model: SemiMarkovField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row; places are code points, ends exclusive, ordered by start, then kind.

    Null and empty texts have no spans; repeated rows and null ids are rows of
    their own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of a bounded sample's features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [[{"kind": k, "start": a, "end": b, "base": base} for a, b, k, base in all_spans(t, sent.value)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, made)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of the rules' spans by kind, a digest of them, all spans as text, and how many the field added."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), added)
