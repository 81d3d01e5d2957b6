"""Secret scans by one combined deterministic automaton.

Rule regexes are parsed, joined into one non-deterministic automaton, turned deterministic by subset construction,
minimised, and stored as a transition array over byte classes. All rules are scanned in one pass over the bytes: the text
is cut at bytes that send every state back to the start, so that thousands of pieces step through the array together.
Pieces that reach an accepting state are then walked with each rule's own anchored automaton, which gives the spans.

Spans are leftmost and do not overlap within a rule; offsets are code points, the end is exclusive. A match that fails its
rule's check is dropped and the search goes on behind it.

Defined results: a null or empty text has no spans; repeated rows are scanned row by row; an empty table gives an empty
result; texts of any length are scanned whole; no other column is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import chunks, map_arrow, of_kind, texts_of, worker_cache

# --- regex -> automaton -------------------------------------------------------------------------------------------------


class _Parser:
    """A small regex dialect over bytes: literals, classes, groups, |, ?, *, +, {m}, {m,}, {m,n}, \\xHH, (?i:...)."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def parse(self):
        out = self.alternation()
        if self.i != len(self.s):
            raise ValueError(f"cannot parse {self.s!r} at {self.i}")
        return out

    def alternation(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                close = self.s.index("}", self.i)
                low, _, high = self.s[self.i : close].partition(",")
                bounds = (int(low), int(high) if high else None if "," in self.s[self.i : close] else int(low))
                self.i = close + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, *bounds)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            old = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            node = self.alternation()
            if self.take() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.fold = old
            return node
        if c == "[":
            return ("set", self.charset())
        return ("set", self.folded({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def charset(self) -> frozenset[int]:
        out: set[int] = set()
        negated = self.peek() == "^" and bool(self.take())
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                d = self.take()
                out |= set(range(low, (self.escaped() if d == "\\" else ord(d)) + 1))
            else:
                out.add(low)
        return frozenset(range(256)) - out if negated else self.folded(out)

    def folded(self, chars: set[int]) -> frozenset[int]:
        text = bytes(sorted(chars))
        return frozenset(text.lower() + text.upper() if self.fold else text)


class Automaton:
    """The minimal deterministic automaton of some patterns.

    table[state * n_classes + class_of[byte]] is the next state times n_classes; accepts[state] has a bit per pattern. With
    search=True a match may begin at any byte; state 0 is the start. Dead states of anchored automata are numbered -1.
    """

    def __init__(self, patterns: list[str], search: bool):
        self._edges: list[list[tuple[frozenset[int], int]]] = []
        self._empty: list[list[int]] = []
        finals: dict[int, int] = {}
        start = self._state()
        for k, p in enumerate(patterns):
            a, b = self._build(_Parser(p).parse())
            self._empty[start].append(a)
            finals[b] = finals.get(b, 0) | 1 << k
        sets = {s for edges in self._edges for s, _ in edges}
        classes: dict[tuple, int] = {}
        ordered = sorted(sets, key=sorted)
        self.class_of = bytes(classes.setdefault(tuple(c in s for s in ordered), len(classes)) for c in range(256))
        self.n_classes = n = len(classes)
        sample = [self.class_of.index(k) for k in range(n)]
        begin = self._closure({start})
        number, rows, todo = {begin: 0}, [], [begin]
        while todo:
            now = todo.pop(0)
            row = []
            for c in sample:
                to = self._closure({t for q in now for s, t in self._edges[q] if c in s} | ({start} if search else set()))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        accepts = [0] * len(number)
        for members, k in number.items():
            for q in members:
                accepts[k] |= finals.get(q, 0)
        self._minimise(np.array(rows), np.array(accepts), bool(search))

    def _state(self) -> int:
        self._edges.append([])
        self._empty.append([])
        return len(self._edges) - 1

    def _build(self, node) -> tuple[int, int]:
        a, b = self._state(), self._state()
        if node[0] == "set":
            self._edges[a].append((node[1], b))
        elif node[0] == "alt":
            for x in node[1]:
                p, q = self._build(x)
                self._empty[a].append(p)
                self._empty[q].append(b)
        elif node[0] == "seq":
            at = a
            for x in node[1]:
                p, q = self._build(x)
                self._empty[at].append(p)
                at = q
            self._empty[at].append(b)
        else:
            _, inner, low, high = node
            at = a
            for _ in range(low):
                p, q = self._build(inner)
                self._empty[at].append(p)
                at = q
            if high is None:
                p, q = self._build(inner)
                self._empty[at] += [p, b]
                self._empty[q] += [p, b]
            else:
                for _ in range(high - low):
                    p, q = self._build(inner)
                    self._empty[at] += [p, b]
                    at = q
                self._empty[at].append(b)
        return a, b

    def _closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self._empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _minimise(self, rows: np.ndarray, accepts: np.ndarray, search: bool) -> None:
        """Partition refinement: states are equal if they accept alike and all their successors are equal."""
        block = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:
            finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        count = block.max() + 1
        first = np.array([np.flatnonzero(block == k)[0] for k in range(count)])
        # The start comes first, accepting states last: one comparison tells whether a state accepts.
        order = np.lexsort((np.arange(count), accepts[first] != 0, np.arange(count) != block[0]))
        new = np.empty(count, np.int64)
        new[order] = np.arange(count)
        table = new[block[rows[first[order]]]]
        self.accepts = accepts[first[order]].tolist()
        dead = [] if search else [k for k in range(count) if not self.accepts[k] and (table[k] == k).all()]
        flat = table * self.n_classes
        for k in dead:
            flat[table == k] = -1
        self.table = flat.astype(np.int32).ravel()
        self.steps = self.table.tolist()
        self.first_accepting = next((k for k in range(count) if k and self.accepts[k]), count) * self.n_classes
        #: Bytes that send every state to the start: no match goes across them.
        self.resets = bytes(c for c in range(256) if (table[:, self.class_of[c]] == 0).all())

    def longest(self, classes: bytes, begin: int, end: int) -> int:
        """The end of the longest match that begins here, or -1; classes: the bytes' classes."""
        state, best, steps = 0, -1, self.steps
        for i in range(begin, end):
            state = steps[state + classes[i]]
            if state < 0:
                break
            if state >= self.first_accepting:
                best = i + 1
        return best


# --- rules --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """pattern: what a match is; trigger: a pattern that some piece of each wanted match has, for the combined scan; keep: the check of a match."""

    kind: str
    pattern: str
    trigger: str = ""
    keep: Callable[[bytes], bool] | None = field(default=None, compare=False)
    base: bool = True


_ASSIGN_VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


def _assign_keep(match: bytes) -> bool:
    return len(_ASSIGN_VALUE.fullmatch(match)[1]) >= 6


#: The first three are the base rules; the others are well-known shapes of credentials.
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _ASSIGN + r"[A-Za-z0-9+/_.=-]", _assign_keep),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", lambda m: len(m) >= 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", lambda m: len(m) >= 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]", lambda m: len(m) >= 40, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", base=False),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


class Scanner:
    """All rules in one combined automaton, and an anchored one for each."""

    PIECE = 768
    FEW = 48

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.combined = Automaton([r.trigger or r.pattern for r in rules], search=True)
        self.single = [Automaton([r.pattern], search=False) for r in rules]
        starts = [bytes(c for c in range(256) if a.steps[a.class_of[c]] >= 0) for a in self.single]
        self.starts = [re.compile(b"[" + b"".join(b"\\x%02x" % c for c in s) + b"]") for s in starts]
        if b"\n"[0] not in self.combined.resets or any(b"\n"[0] in s for s in starts):
            raise ValueError("no rule may match across a line feed")

    def flagged(self, buffer: bytes) -> list[tuple[int, int]]:
        """The pieces, as byte ranges, that reach an accepting state of the combined automaton: one pass over the bytes."""
        c = self.combined
        classes = np.frombuffer(buffer.translate(c.class_of), np.uint8)
        reset = np.frombuffer(buffer.translate(bytes(x in c.resets for x in range(256))), np.uint8)
        at = np.flatnonzero(reset) + 1
        wanted = np.searchsorted(at, np.arange(self.PIECE, len(buffer), self.PIECE))
        begins = np.unique(np.concatenate([[0], at[wanted[wanted < len(at)]]]))
        begins = begins[begins < len(buffer)]
        lengths = np.diff(np.concatenate([begins, [len(buffer)]]))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        state, hit = np.zeros(len(begins), np.int32), np.zeros(len(begins), bool)
        active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 2), side="right")
        t = 0
        while t < len(active) and active[t] >= self.FEW:
            k = active[t]
            state[:k] = c.table[state[:k] + classes[begins[:k] + t]]
            hit[:k] |= state[:k] >= c.first_accepting
            t += 1
        for k in range(active[t] if t < len(active) else 0):  # the few longest pieces, one at a time
            if not hit[k]:
                s, steps, low = int(state[k]), c.steps, c.first_accepting
                for x in classes[begins[k] + t : begins[k] + lengths[k]].tolist():
                    s = steps[s + x]
                    if s >= low:
                        hit[k] = True
                        break
        return sorted((int(b), int(b + n)) for b, n in zip(begins[hit], lengths[hit], strict=True))

    def spans(self, buffer: bytes, begin: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, rule number) of the kept matches between two cuts, by start."""
        out = []
        for k, (rule, auto, start) in enumerate(zip(self.rules, self.single, self.starts, strict=True)):
            classes, at = buffer[begin:end].translate(auto.class_of), 0
            piece = buffer[begin:end]
            while m := start.search(piece, at):
                stop = auto.longest(classes, m.start(), len(piece))
                if stop < 0:
                    at = m.start() + 1
                    continue
                if rule.keep is None or rule.keep(piece[m.start() : stop]):
                    out.append((begin + m.start(), begin + stop, k))
                at = stop
        return sorted(out, key=lambda x: (x[0], x[2]))

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in code points for each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for a, b in chunks([len(t or b"") for t in texts], 4 << 20):
            buffer = b"\n".join(t or b"" for t in texts[a:b])
            first = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts[a:b]])])
            # Pieces ascend, so a document's table of code points is built once.
            lead = None
            for begin, end in self.flagged(buffer):
                for s, e, k in self.spans(buffer, begin, end):
                    doc = int(np.searchsorted(first, s, side="right")) - 1
                    if lead is None or lead[0] != doc:
                        lead = (doc, np.concatenate([[0], np.cumsum((np.frombuffer(texts[a + doc], np.uint8) & 0xC0) != 0x80)]))
                    o = first[doc]
                    out[a + doc].append((self.rules[k].kind, int(lead[1][s - o]), int(lead[1][e - o])))
        return out


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once per Python worker, while it scans."""
    return worker_cache(("secrets", rules), lambda: Scanner(rules))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep's columns and ``secrets``: an array of (kind, start, end) by start, then in the rules' order. Narrow, no shuffle."""
    columns = docs.select(*keep, F.col(text_col).alias("_text_to_scan"))
    schema = docs.select(*keep).withColumn("secrets", F.lit(None).cast("array<struct<kind:string,start:long,end:long>>")).schema

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        s = scanner(rules)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in s.scan(texts_of(batch, "_text_to_scan"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, to_arrow_type(schema["secrets"].dataType))], names=schema.names)

    return map_arrow(columns, work, schema, ("secrets", rules))


def op5(spark, sf_dir) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in RULES if r.base]
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("secrets", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id", *[F.size(F.filter("secrets", of_kind(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined("secrets").alias("spans"),
    )
