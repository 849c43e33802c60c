"""Secrets in texts: fixed patterns, and literals that are assigned to names which tell of a secret.

A text is read for what assigns in source code and configuration: ``name = value``, annotated and typed declarations, keys of JSON, YAML
and subscripts, calls that set a key, attributes and elements of XML, flags, and passwords inside addresses. Each gives a pair of a name
and an expression of literals and names. Names stand for the literals last given to them, so a literal counts for every name that it
reaches; it's reported where it's written. Reading happens inside tasks, one text at a time and linear in its length; pairs are scored
by column expressions: how much the name tells, and how little the literal looks like a word or a placeholder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, table

#: Patterns of the base and the characters that a match, or its group, has at least. Order: ranks of kinds that start together.
BASE = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run of fewer can't match, and runs are whole
}
LITERAL = "literal"

_NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"
_KEY = r"[A-Za-z_][\w.\- ]*+"
_THEN = r"""[\t ]*+(?:\s++(?=["'`]))?+"""
#: What comes before a value; the group that matched holds the name. Every alternative starts where no earlier start has looked.
TARGET = re.compile(
    rf"""
      \b(?:key|name)\x20*=\x20*["']({_KEY})["']\s*+value\x20*=\s*+                        # <add key="..." value="...">
    | <({_NAME})>                                                                         # <name>...</name>
    | ["']({_KEY})["']\s*+\]?+[\t ]*+(?::=|=>|={{1,3}}|:){_THEN}                           # "key": and x["key"] =
    | \(\s*+["']({_KEY})["']\s*+,\s*+                                                     # set("key", ...
    | --([A-Za-z][\w\-]*+)[=\x20]                                                         # --flag ...
    | (?<![\w$])(?<![\w$][.\-])([\w$]++(?:[.\-][\w$]++)*+)                                # name =, name: type =, name[9] =, name string =
      (?:[\t ]*+\[\d*\]|[\t ]*+:[\t ]*+[A-Za-z_][\w.\[\]]*+(?=[\t ]*+=)|[\t ]++(?:string|str|\[\]byte)(?=[\t ]*+=))?+
      [\t ]*+(?::=|=>|={{1,3}}|:(?!:|//)){_THEN}
    | (?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]*+://[^\s:/@"'<>]++(:)(?=[^\s@/"'<>]++@)           # scheme://user:...@host
    """,
    re.VERBOSE | re.ASCII,
)
#: A literal, a name or a reference; bare values end where a value does in configuration, and aren't calls.
VALUE = re.compile(
    rf"""
      [rbfuRBFU@$]{{0,2}}(?P<open>["'`])(?P<string>(?:(?!(?P=open))[^\\\n]|\\.)*+)(?P=open)
    | \$\{{?(?P<reference>\w+)\}}?(?=[\s"',;]|$) | \{{\{{\s*+(?P<braced>[\w.]+)\s*+\}}\}}
    | (?P<name>{_NAME})(?=[\t ]*+(?:[+.]{{1,2}}[\t ]|[;,)\]}}\n]|:?={{1,2}}(?!=)|$))
    | (?P<bare>[^\s"'`,;<>(){{}}\[\]]++)(?![(\[])
    """,
    re.VERBOSE | re.ASCII,
)
#: A whole string that only names another value.
WRAPPED = re.compile(r"\$\{?(\w+)\}?|\{\{\s*([\w.]+)\s*\}\}|%\((\w+)\)s")
#: A literal of more than WHOLE characters is told by its first and last EDGE ones and those that a score reads wherever they stand:
#: twelve different ones, the first of each class, an opening bracket and a line's end. Its score is the same.
WHOLE, EDGE, DIFFERENT = 256, 64, 12
CLASSES = [re.compile(p) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[ \t\n\x0b\f\r]", r"[^A-Za-z0-9 \t\n\x0b\f\r]", r"\(", r"[\n\r\x85\u2028\u2029]")]
ADDRESS = re.compile(r"[^\s@/\"'<>]++")
JOIN = re.compile(r"[\t ]*+(?:\+|\.\.?(?=[\t ]))\s*+")
CHAIN = re.compile(r"[\t ]*+:?=(?!=)")


class Pair(NamedTuple):
    """A name, the literal that reaches it (or what tells its score), the node of the literal's parts, and whether quotes hold them."""

    name: str
    value: str
    node: int
    quoted: bool


class Node(NamedTuple):
    """Where parts are written, and nodes that hold further ones. A text has no more of them than it has parts, however they are joined."""

    spans: list[tuple[int, int]]
    nodes: list[int]


class Part(NamedTuple):
    """A literal or the name of one, and where the part begins that is joined to it."""

    span: tuple[int, int]
    value: str
    name: str | None
    quoted: bool
    word: bool
    chained: bool
    then: int | None


def kept(text: str) -> str:
    first = "".join(islice(dict.fromkeys(text), DIFFERENT))
    return "".join(dict.fromkeys(first + "".join(m[0] for c in CLASSES if (m := c.search(text)))))


def told(value: str) -> str:
    return value if len(value) <= WHOLE else value[:EDGE] + kept(value[:-1]) + value[-EDGE:]  # a line that ends with the literal is no break


class Chain:
    """Parts that are joined. What is known of the parts from each one on is summed from the end, so every start in a chain shares it."""

    def __init__(self, parts: list[Part], nodes: list[Node]):
        n = len(parts)
        self.parts, self.names, self.kept, self.node, self.broken, self.bare = parts, {}, [""] * (n + 1), [None] * (n + 1), -1, -1
        self.once = parts[-1].name if parts and sum(p.name == parts[-1].name for p in parts) == 1 else None
        for i in reversed(range(n)):
            part = parts[i]
            self.kept[i], self.node[i] = self.kept[i + 1], self.node[i + 1]
            if part.chained:
                self.broken = max(self.broken, i)
            elif part.name:
                self.names.setdefault(part.name, i)  # its last place, latest first
            else:
                self.kept[i] = kept(self.kept[i] + (part.value if i < n - 1 else part.value[:-1]))
                nodes.append(Node([part.span], [] if self.node[i] is None else [self.node[i]]))
                self.node[i] = len(nodes) - 1
                if not part.quoted:
                    self.bare = max(self.bare, i)

    def joined(self, first: Pair, at: int, known_as, nodes: list[Node]) -> Pair | None:
        """first with the parts from at on; None if one is neither a literal nor a name of one."""
        if self.broken >= at:
            return None
        held, quoted_, middle = [first.node], first.quoted and self.bare < at, kept(first.value + self.kept[at])
        for name, last in self.names.items():
            if last < at:
                break
            if (was := known_as(name)) is None:
                return None
            held.append(was.node)
            quoted_, middle = quoted_ and was.quoted, kept(middle + (was.value[:-1] if name == self.once else was.value))
        if self.node[at] is not None:
            held.append(self.node[at])
        value_of = lambda p: known_as(p.name).value if p.name else p.value
        head, k, end = first.value, at, ""
        while k < len(self.parts) and len(head) <= WHOLE:
            head += value_of(self.parts[k])
            k += 1
        e = len(self.parts)
        while e > k and len(end) < EDGE:
            e -= 1
            end = value_of(self.parts[e]) + end
        end = end if e > k or len(end) >= EDGE else head + end
        nodes.append(Node([], held))
        return Pair("", told(head) if k == len(self.parts) else head[:EDGE] + middle + end[-EDGE:], len(nodes) - 1, quoted_)


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end (code points), kind of the fixed patterns: leftmost matches of a kind that don't overlap, short ones left out."""
    for kind, (pattern, group, least) in BASE.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield m.start(), m.end(), kind


def pairs(text: str, nodes: list[Node] | None = None) -> Iterator[Pair]:
    """Names and literals of all assignments of a text, in order; nodes gets the places of their parts."""
    nodes = [] if nodes is None else nodes
    known: dict[str, Pair] = {}
    waiting: list[str] = []  # a = b = "..." gives the literal to both
    chains: dict[int, tuple[Chain, int]] = {}

    def known_as(name: str) -> Pair | None:
        return known.get(name) or known.get(name.rpartition(".")[2])

    def written(span: tuple[int, int]) -> int:
        nodes.append(Node([span], []))
        return len(nodes) - 1

    def part(at: int) -> Part | None:
        if not (m := VALUE.match(text, at)):
            return None
        start, content = (m.start("string"), m["string"]) if m["open"] else (m.start(), m[0])
        name = m["reference"] or m["braced"] or m["name"]
        if m["open"] and (w := WRAPPED.fullmatch(content)):
            name = w[1] or w[2] or w[3]
        j = JOIN.match(text, m.end())
        return Part((start, start + len(content)), told(content), name, bool(m["open"]), bool(m["name"]), bool(m["name"] and CHAIN.match(text, m.end())), j and j.end())

    def chain(at: int) -> tuple[Chain, int] | None:
        """The chain that at lies in and its place there; parts are read once, whatever starts among them."""
        if at not in chains:
            places, parts, p = [], [], at
            while p is not None and p not in chains and (found := part(p)):
                places.append(p)
                parts.append(found)
                p = found.then
            if p in chains:
                parts += chains[p][0].parts[chains[p][1] :]
            made = Chain(parts, nodes)
            chains.update((p, (made, i)) for i, p in enumerate(places))
        return chains.get(at)

    def expression(at: int) -> Pair | None:
        """The literals joined from at on; None if anything in it is neither a literal nor a name of one."""
        first = part(at)
        if first is None or first.chained:
            return None
        was = known_as(first.name) if first.name else Pair("", first.value, written(first.span), first.quoted)
        if was is None:
            if not first.word:
                return None
            was = Pair(first.name, first.value, written(first.span), False)  # a bare word, as in password=hunter
        rest = chain(first.then) if first.then is not None else None
        return was if rest is None else rest[0].joined(was, rest[1], known_as, nodes)

    for m in TARGET.finditer(text):
        if m[7]:  # inside an address
            a = ADDRESS.match(text, m.end())
            if not WRAPPED.fullmatch(a[0]):
                yield Pair("password", told(a[0]), written(a.span()), True)
            continue
        name = m[m.lastindex].strip()
        found = expression(m.end())
        if found is None:
            if not ((v := VALUE.match(text, m.end())) and v["name"] and CHAIN.match(text, v.end())):
                waiting.clear()
                known.pop(name, None)
            else:
                waiting.append(name)
            continue
        for own in (*waiting, name):
            pair = found._replace(name=own)  # a name that is given anything else is no longer this literal
            known[own] = known[own.rpartition(".")[2]] = pair
            yield pair
        waiting.clear()


SPANS = "array<struct<start:int,end:int>>"
FOUND = f"struct<base:array<struct<start:int,rank:int,end:int,kind:string>>,pairs:array<struct<name:string,value:string,node:int,quoted:boolean>>,nodes:array<struct<spans:{SPANS},nodes:array<int>>>>"


def read_texts(text: Column) -> Column:
    """Base spans, pairs and nodes of a text; a null text has none."""
    ranks = list(BASE)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    base = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    named = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("node", pa.int32()), ("quoted", pa.bool_())]))
    held = pa.list_(pa.struct([("spans", spans), ("nodes", pa.list_(pa.int32()))]))

    @F.arrow_udf(FOUND)
    def read(texts: pa.Array) -> pa.Array:
        one, other, parts = [], [], []
        for t in texts:
            t, nodes = t.as_py() or "", []
            one.append([{"start": s, "rank": ranks.index(k), "end": e, "kind": k} for s, e, k in base_spans(t)])
            other.append([p._asdict() for p in pairs(t, nodes)])
            parts.append([{"spans": [{"start": s, "end": e} for s, e in n.spans], "nodes": n.nodes} for n in nodes])
        return pa.StructArray.from_arrays([pa.array(one, base), pa.array(other, named), pa.array(parts, held)], names=["base", "pairs", "nodes"])

    return read(text)


def places(wanted: Column, nodes: Column) -> Column:
    """The spans of all parts that wanted nodes reach, each once, in order."""

    @F.arrow_udf(SPANS)
    def reach(wanted: pa.Array, nodes: pa.Array) -> pa.Array:
        out = []
        for w, n in zip(wanted, nodes):
            todo, held, found = w.as_py() or [], None, set()
            seen = set(todo)
            while todo:
                held = n.as_py() if held is None else held
                node = held[todo.pop()]
                found.update((s["start"], s["end"]) for s in node["spans"])
                new = set(node["nodes"]) - seen
                seen |= new
                todo += new
            out.append([{"start": s, "end": e} for s, e in sorted(found)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return reach(wanted, nodes)


#: Names by what they tell, after camelCase is parted; the last words of names that only speak about a secret; what isn't one.
TELLING = r"passw(or)?d|passphrase|secret|api_?key|(^|[^a-z])(pass|pwd|passcode|tokens?|bearer|credentials?|(access|private|signing|encryption|auth|account|shared|master|session)[_. -]?key)($|[^a-z])"
HINTING = r"(^|[^a-z])(key|auth|creds?|salt|signature|sig|sas|webhook|pin|dsn)($|[^a-z])"
ABOUT = r"(^|[^a-z])(url|uri|path|file|name|id|len|length|size|type|hint|field|label|policy|regex|pattern|count|expiry|expires|ttl|prompt|min|max|enabled|header|format|version|public[_. -]?key)$"
PLACEHOLDER = r"(?i)^(|change.?me.*|(my|your|some|the|a)[_ -].*|example.*|placeholder|dummy.*|todo|x{3,}|\*{3,}|\.{3,}|none|null|nil|undefined|true|false|password|secret|token|<.*>|\$.*|%.*%|\{.*\}|.*\(.*\)|(https?|file)://.*|(process\.)?env[\[.].*)$"
#: Scores from which a literal is a secret: in quotes, and bare as in configuration, where prose looks alike and a digit has to be in it.
QUOTED, BARE = 1.4, 1.6


def name_score(name: Column) -> Column:
    plain = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    told = F.when(plain.rlike(TELLING), 1.0).when(plain.rlike(HINTING), 0.6).otherwise(0.0)
    return F.when(plain.rlike(ABOUT), F.lit(0.0)).otherwise(told)


def literal_score(value: Column) -> Column:
    """From 0 for words, short texts and placeholders to 1 for many kinds of many different characters."""
    kinds = sum((value.rlike(k).cast("int") for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]")), F.lit(0))
    different = F.size(F.array_distinct(F.split(value, "")))
    score = F.least(F.lit(1.0), different / 12.0) * 0.5 + F.least(F.lit(3), kinds) / 3.0 * 0.5
    return F.when((F.length(value) < 6) | value.rlike(PLACEHOLDER), 0.0).when(value.rlike(r"\s"), score - 0.5).otherwise(score)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with a column of secrets: array of (start, rank, end, kind), in that order; code points, end exclusive.

    Kinds are those of ``BASE`` by rank, then ``literal``: the place of a literal that reaches a telling name with score enough, once
    however many names it reaches. A literal counts beside a base span that holds it. A null text has none; one row for each row of docs,
    other columns stay as they are, whatever their names (one named like out, in any case of letters, is replaced).
    """
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*kept).alias("row"), read_texts(F.col(quoted(text)).cast("string")).alias("found"))
    scored = F.transform("found.pairs", lambda p: F.struct(p["node"].alias("node"), p["quoted"].alias("quoted"), p["value"].alias("value"), name_score(p["name"]).alias("told")))
    scored = F.transform(F.filter(scored, lambda p: (p["told"] > 0) & (p["quoted"] | p["value"].rlike("[0-9]"))), lambda p: F.struct(p["node"].alias("node"), p["quoted"].alias("quoted"), (p["told"] + literal_score(p["value"])).alias("score")))
    enough = lambda p: p["score"] >= F.when(p["quoted"], QUOTED).otherwise(BARE)
    wanted = F.array_distinct(F.transform(F.filter(scored, enough), lambda p: p["node"]))
    literals = F.transform(places(wanted, F.col("found.nodes")), lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("rank"), s["end"].alias("end"), F.lit(LITERAL).alias("kind")))
    return rows.select("row", F.array_sort(F.concat("found.base", literals)).alias("secrets_found")).select("row.*", F.col("secrets_found").alias(out))


def op11_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents as ``find_secrets`` gives them, one row for each row of the table; null texts count as empty."""
    found = find_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "secrets")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in (*BASE, LITERAL)]
    base = F.filter("secrets", lambda s: s["kind"] != LITERAL)
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
