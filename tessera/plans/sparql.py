"""Query text: a subset of SPARQL, parsed and lowered to DataFrames over triples, so that Catalyst plans it.

SELECT, ASK, CONSTRUCT and DESCRIBE; patterns with ; , a, literals and p+; OPTIONAL, UNION, nested groups, FILTER with NOT
EXISTS and EXISTS, BIND; GROUP BY with aggregates; ORDER BY, DISTINCT, LIMIT. A variable is a column of terms, struct(v, k, dt,
lang): value, kind, datatype, language; null is unbound. SELECT keeps bags; CONSTRUCT and p+ give sets. A filter counts at
the end of its group, and an error in it, like null, is false. Variables that may be unbound are joined as compatible ones.
Result columns are the values. Parameters are terms given beside the text, so no text is ever put into a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.patterns import path_plus
from ..sources.triples import COLUMNS
from ..sources.vocabulary import PREFIXES

TERM = "struct<v: string, k: string, dt: string, lang: string>"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z-]+)"""
    r"""|(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<bnode>_:\w+)|(?P<name>[A-Za-z_][\w.-]*:[\w/.-]*|:[\w/.-]+)|(?P<word>[A-Za-z]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*+=<>!/-])"""
)
_AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG"}


@dataclass
class Group:
    """One { }: its parts in order and its filters."""

    parts: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Query:
    form: str
    items: list = field(default_factory=list)  # variables, or (expression, name); empty: all
    distinct: bool = False
    template: list = field(default_factory=list)
    where: Group = field(default_factory=Group)
    groups: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None


def constant(v: str, k: str = "iri", dt: str = "", lang: str = "") -> tuple:
    return ("term", v, k, dt, lang)


class Parser:
    def __init__(self, text: str, full: bool):
        self.full, self.prefixes, self.at, self.fresh = full, {}, 0, 0
        self.tokens: list[tuple[str, str]] = []
        place = 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"cannot read the query at {text[place : place + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            place = m.end()
        self.tokens.append(("end", ""))

    def peek(self, *words: str) -> bool:
        kind, text = self.tokens[self.at]
        return (text.upper() if kind == "word" else text) in words and kind in ("word", "op")

    def take(self, *words: str) -> str:
        kind, text = self.tokens[self.at]
        if words and not self.peek(*words):
            raise ValueError(f"{' or '.join(words)} expected, not {text!r}")
        self.at += 1
        return text.upper() if kind == "word" else text

    def maybe(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def iri(self, text: str) -> str:
        """The graph's form of an IRI: full, or with the prefix of its namespace."""
        if text.startswith("<"):
            whole = text[1:-1]
            if self.full:
                return whole
            bases = sorted((PREFIXES | self.prefixes).items(), key=lambda x: -len(x[1]))
            return next((f"{p}:{whole[len(b) :]}" for p, b in bases if whole.startswith(b)), whole)
        prefix, rest = text.split(":", 1)
        known = PREFIXES | self.prefixes
        return known[prefix] + rest if self.full and prefix in known else text

    def query(self) -> Query:
        while self.maybe("PREFIX"):
            self.prefixes[self.take().split(":")[0]] = self.take()[1:-1]
        form = self.take("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        q = Query(form)
        if form == "SELECT":
            q.distinct = self.maybe("DISTINCT")
            while not self.peek("WHERE", "{"):
                if self.maybe("*"):
                    continue
                if self.maybe("("):
                    e = self.expression()
                    self.take("AS")
                    q.items.append((e, self.take()[1:]))
                    self.take(")")
                else:
                    name = self.take()[1:]
                    q.items.append((("var", name), name))
        elif form == "CONSTRUCT":
            self.take("{")
            q.template = self.triples()
            self.take("}")
        elif form == "DESCRIBE":
            q.items = [self.term()]
        if form != "DESCRIBE" or self.peek("WHERE", "{"):
            self.maybe("WHERE")
            q.where = self.group()
        while self.tokens[self.at][0] != "end":
            if self.maybe("GROUP"):
                self.take("BY")
                while self.tokens[self.at][0] == "var":
                    q.groups.append(self.take()[1:])
            elif self.maybe("ORDER"):
                self.take("BY")
                while self.tokens[self.at][0] == "var" or self.peek("ASC", "DESC"):
                    down = self.peek("DESC")
                    q.order.append((self.primary() if not self.maybe("ASC", "DESC") else self.primary(), down))
            else:
                self.take("LIMIT")
                q.limit = int(self.take())
        return q

    def group(self) -> Group:
        out = Group()
        self.take("{")
        while not self.maybe("}"):
            if self.maybe("OPTIONAL"):
                out.parts.append(("optional", self.group()))
            elif self.maybe("FILTER"):
                negated = self.maybe("NOT")
                if self.maybe("EXISTS"):
                    out.filters.append(("exists", self.group(), negated))
                else:
                    out.filters.append(self.primary() if not self.peek("!") else self.expression())
            elif self.maybe("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.parts.append(("bind", e, self.take()[1:]))
                self.take(")")
            elif self.peek("{"):
                found = [self.group()]
                while self.maybe("UNION"):
                    found.append(self.group())
                out.parts.append(("union", found))
            else:
                out.parts += [("triple", x) for x in self.triples()]
            self.maybe(".")
        return out

    def triples(self) -> list:
        out = []
        while not self.peek("}", "OPTIONAL", "FILTER", "BIND", "{"):
            s = self.term()
            while True:
                p = ("term", "rdf:type" if not self.full else PREFIXES["rdf"] + "type", "iri", "", "") if self.maybe("a", "A") else self.term()
                plus = self.maybe("+")
                while True:
                    out.append((s, p, self.term(), plus))
                    if not self.maybe(","):
                        break
                while self.maybe(";"):
                    pass
                if self.peek(".", "}", "OPTIONAL", "FILTER", "BIND", "{"):
                    break
            if not self.maybe("."):
                break
        return out

    def term(self) -> tuple:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "var":
            return ("var", text[1:])
        if kind in ("iri", "name"):
            return constant(self.iri(text))
        if kind == "string":
            body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
            if self.tokens[self.at][0] == "lang":
                return constant(body, "literal", "", self.take()[1:])
            return constant(body, "literal", self.iri(self.take())) if self.maybe("^^") else constant(body, "literal")
        if kind == "number":
            return constant(text, "literal", self.iri("xsd:decimal" if "." in text else "xsd:integer"))
        if kind == "bnode":
            return ("var", "_" + text[2:])
        raise ValueError(f"a term expected, not {text!r}")

    def expression(self, level: int = 0) -> tuple:
        """Operators by binding: || && then comparisons and IN."""
        if level == 2:
            left = self.unary()
            if self.peek("=", "!=", "<", ">", "<=", ">="):
                return ("compare", self.take(), left, self.unary())
            negated = self.maybe("NOT")
            if self.maybe("IN"):
                self.take("(")
                found = [self.expression()]
                while self.maybe(","):
                    found.append(self.expression())
                self.take(")")
                return ("in", left, found, negated)
            return left
        left = self.expression(level + 1)
        while self.maybe("||" if level == 0 else "&&"):
            left = ("or" if level == 0 else "and", left, self.expression(level + 1))
        return left

    def unary(self) -> tuple:
        return ("not", self.unary()) if self.maybe("!") else self.primary()

    def primary(self) -> tuple:
        if self.maybe("("):
            e = self.expression()
            self.take(")")
            return e
        if self.tokens[self.at][0] == "word":
            name = self.take()
            self.take("(")
            distinct, found = self.maybe("DISTINCT"), []
            while not self.maybe(")"):
                found.append(("all",) if self.maybe("*") else self.expression())
                self.maybe(",")
            return ("call", name, found, distinct)
        return self.term()


def _literal(v, dt="", lang="") -> Column:
    v = v if isinstance(v, Column) else F.lit(v)
    lang = lang if isinstance(lang, Column) else F.lit(lang)
    return F.when(v.isNotNull(), F.struct(v.cast("string").alias("v"), F.lit("literal").alias("k"), F.lit(dt).alias("dt"), lang.alias("lang")))


def _constant(t: tuple) -> Column:
    return F.struct(*[F.lit(x).alias(n) for x, n in zip(t[1:], ("v", "k", "dt", "lang"))])


class Evaluator:
    def __init__(self, t: DataFrame, bound: dict[str, tuple]):
        self.t, self.bound = t, bound

    def term(self, e: tuple, known: set[str]) -> Column:
        """The term that an expression gives."""
        kind = e[0]
        if kind == "var":
            return _constant(self.bound[e[1]]) if e[1] in self.bound else F.col(f"`{e[1]}`") if e[1] in known else F.lit(None).cast(TERM)
        if kind == "term":
            return _constant(e)
        if kind != "call":
            return _literal(self.truth(e, known).cast("string"), "xsd:boolean")
        name, args = e[1], e[2]
        if name == "COALESCE":
            return F.coalesce(*[self.term(a, known) for a in args])
        x = [self.term(a, known) for a in args]
        v = [c["v"] for c in x]
        if name in ("STR", "LANG", "DATATYPE"):
            return _literal({"STR": v[0], "LANG": x[0]["lang"], "DATATYPE": x[0]["dt"]}[name])
        if name in ("IRI", "URI"):
            return F.when(v[0].isNotNull(), F.struct(v[0].alias("v"), F.lit("iri").alias("k"), F.lit("").alias("dt"), F.lit("").alias("lang")))
        if name in ("LCASE", "UCASE"):
            return _literal(F.lower(v[0]) if name == "LCASE" else F.upper(v[0]), "", x[0]["lang"])
        if name in ("STRBEFORE", "STRAFTER"):
            at = F.instr(v[0], v[1])
            part = F.left(v[0], at - 1) if name == "STRBEFORE" else F.substr(v[0], at + F.length(v[1]))
            return _literal(F.when(at > 0, part).when(at == 0, ""), "", F.when(at > 0, x[0]["lang"]).otherwise(""))
        if name == "CONCAT":
            return _literal(F.concat(*v))
        if name == "STRLEN":
            return _literal(F.length(v[0]), "xsd:integer")
        return _literal(self.truth(e, known).cast("string"), "xsd:boolean")

    def truth(self, e: tuple, known: set[str]) -> Column:
        kind = e[0]
        if kind in ("and", "or"):
            a, b = self.truth(e[1], known), self.truth(e[2], known)
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.truth(e[1], known)
        if kind == "compare":
            return self.compared(e[1], self.term(e[2], known), self.term(e[3], known))
        if kind == "in":
            x = self.term(e[1], known)
            hit = F.lit(False)
            for y in e[2]:
                hit = hit | self.compared("=", x, self.term(y, known))
            return ~hit if e[3] else hit
        if kind == "call":
            x = [self.term(a, known) for a in e[2]]
            if e[1] in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
                return x[0]["k"] == {"ISLITERAL": "literal", "ISBLANK": "bnode"}.get(e[1], "iri")
            if e[1] == "BOUND":
                return x[0].isNotNull()
            if e[1] in ("STRSTARTS", "STRENDS", "CONTAINS", "REGEX"):
                f = {"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains, "REGEX": F.regexp_like}[e[1]]
                return f(x[0]["v"], x[1]["v"])
        return self.term(e, known)["v"] == "true"

    @staticmethod
    def compared(op: str, a: Column, b: Column) -> Column:
        numeric = a["dt"].endswith("integer") | a["dt"].endswith("decimal") | a["dt"].endswith("double")
        x, y = a["v"].try_cast("double"), b["v"].try_cast("double")
        both = numeric & x.isNotNull() & y.isNotNull()
        if op in ("=", "!="):
            same = F.when(both, x == y).otherwise((a["v"] == b["v"]) & (a["k"] == b["k"]) & (a["lang"] == b["lang"]))
            return same if op == "=" else ~same
        use = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        return F.when(both, use(x, y)).otherwise(use(a["v"], b["v"]))

    def triple(self, x: tuple) -> DataFrame:
        s, p, o, plus = x
        t = self.t
        if plus:
            t = path_plus(t.where((F.col("p") == p[1]) & (F.col("o_kind") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b")))
            t = t.select(F.col("a").alias("s"), F.lit(p[1]).alias("p"), F.col("b").alias("o"), F.when(F.col("b").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
        node = lambda c: F.struct(F.col(c).alias("v"), F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri").alias("k"), F.lit("").alias("dt"), F.lit("").alias("lang"))
        places = {"s": node("s"), "p": node("p"), "o": F.struct(F.col("o").alias("v"), F.col("o_kind").alias("k"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))}
        found: dict[str, str] = {}
        for place, term in (("s", s), ("p", p), ("o", o)):
            term = self.bound.get(term[1], term) if term[0] == "var" else term
            if term[0] == "term":
                t = t.where(F.col(place) == term[1])
                if place == "o":
                    t = t.where((F.col("o_kind") == term[2]) & (F.col("o_lang") == term[4]) & F.col("o_dt").isin(*({term[3], "xsd:string"} if not term[3] and not term[4] else {term[3]})))
            elif term[1] in found:
                t = t.where(places[place]["v"] == places[found[term[1]]]["v"])
            else:
                found[term[1]] = place
        return t.select(*[places[place].alias(name) for name, place in found.items()])

    @staticmethod
    def joined(left: DataFrame, right: DataFrame, unsure: set[str], how: str) -> DataFrame:
        """Join of compatible solutions: variables of unsure may be unbound on either side."""
        shared = [c for c in right.columns if c in left.columns]
        sure = [c for c in shared if c not in unsure]
        if how == "inner" and not shared:
            return left.crossJoin(right)
        r = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in right.columns])
        on = F.lit(True)
        for c in sure:
            on = on & (F.col(f"`{c}`") == F.col(f"`_r_{c}`"))
        for c in set(shared) - set(sure):
            on = on & (F.col(f"`{c}`").isNull() | F.col(f"`_r_{c}`").isNull() | (F.col(f"`{c}`") == F.col(f"`_r_{c}`")))
        if how in ("left_semi", "left_anti"):
            return left.join(r, on, how)
        old = [F.coalesce(f"`{c}`", f"`_r_{c}`").alias(c) if c in shared and c not in sure else F.col(f"`{c}`") for c in left.columns]
        return left.join(r, on, how).select(*old, *[F.col(f"`_r_{c}`").alias(c) for c in right.columns if c not in left.columns])

    def group(self, g: Group) -> tuple[DataFrame, set[str]]:
        """(solutions, variables that may be unbound in them)."""
        out, unsure = None, set()
        todo = list(g.parts)
        while todo:
            # Of a run of patterns one that shares a variable with what is there comes next, so that none is a cross join.
            run = [k for k, x in enumerate(todo) if x[0] == "triple" and all(y[0] == "triple" for y in todo[:k])]
            k = next((k for k in run if out is None or {x[1] for x in todo[k][1][:3] if x[0] == "var"} & set(out.columns)), 0)
            part = todo.pop(k)
            if part[0] == "bind":
                out = self.t.sparkSession.range(1).select() if out is None else out
                out = out.withColumn(part[2], self.term(part[1], set(out.columns)))
                unsure.add(part[2])
                continue
            if part[0] == "triple":
                right, more, how = self.triple(part[1]), set(), "inner"
            elif part[0] == "optional":
                right, more = self.group(part[1])
                how = "left"
                more |= {c for c in right.columns if out is None or c not in out.columns}
            else:
                sides = [self.group(x) for x in part[1]]
                names = list(dict.fromkeys(c for d, _ in sides for c in d.columns))
                right = None
                for d, _ in sides:
                    d = d.select(*[F.col(f"`{c}`") if c in d.columns else F.lit(None).cast(TERM).alias(c) for c in names])
                    right = d if right is None else right.union(d)
                more = {c for d, u in sides for c in names if c in u or c not in d.columns}
                how = "inner"
            out = right if out is None else self.joined(out, right, unsure | more, how)
            unsure |= more
        out = self.t.sparkSession.range(1).select() if out is None else out
        for f in g.filters:
            if f[0] == "exists":
                right, more = self.group(f[1])
                shared = [c for c in right.columns if c in out.columns]
                out = self.joined(out, right.select(*[F.col(f"`{c}`") for c in shared]).distinct(), unsure | more, "left_anti" if f[2] else "left_semi")
            else:
                out = out.where(F.coalesce(self.truth(f, set(out.columns)), F.lit(False)))
        return out, unsure


def query(t: DataFrame, text: str, params: dict[str, str | tuple] | None = None, full: bool = False) -> DataFrame:
    """The answer to a query over triples: rows of values, one row `answer` of ASK, triples of CONSTRUCT and DESCRIBE.

    params: terms of variables; a string is an IRI, or constant(...). full: the graph has full IRIs, not prefixed names.
    """
    q = Parser(text, full).query()
    bound = {k: constant(v) if isinstance(v, str) else v for k, v in (params or {}).items()}
    run = Evaluator(t, bound)
    if q.form == "DESCRIBE":
        if q.items[0][0] == "term":
            return t.where(F.col("s") == q.items[0][1]).select(COLUMNS).distinct()
        nodes, _ = run.group(q.where)
        return t.join(nodes.select(run.term(q.items[0], set(nodes.columns))["v"].alias("s")).distinct(), "s", "left_semi").select(COLUMNS).distinct()
    found, _ = run.group(q.where)
    known = set(found.columns)
    if q.form == "ASK":
        return found.limit(1).agg((F.count("*") > 0).alias("answer"))
    if q.form == "CONSTRUCT":
        each = []
        for s, p, o, _ in q.template:
            s, p, o = (run.term(x, known) for x in (s, p, o))
            each.append(F.struct(s["v"].alias("s"), p["v"].alias("p"), o["v"].alias("o"), o["k"].alias("o_kind"), o["dt"].alias("o_dt"), o["lang"].alias("o_lang")))
        return found.select(F.explode(F.array(*each)).alias("t")).select("t.*").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()
    items = q.items or [(("var", c), c) for c in found.columns if not c.startswith("_")]
    counted = any(e[0] == "call" and e[1] in _AGGREGATES for e, _ in items)
    if counted or q.groups:
        out = []
        for e, name in items:
            if e[0] == "call" and e[1] in _AGGREGATES:
                v = F.lit(1) if e[2][0] == ("all",) else run.term(e[2][0], known)
                if e[1] == "COUNT":
                    out.append((F.countDistinct(v) if e[3] else F.count(v)).alias(name))
                else:
                    n = v["v"].try_cast("double")
                    out.append({"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[e[1]](n if e[1] in ("SUM", "AVG") else v["v"]).alias(name))
            elif e[0] != "var":
                raise ValueError("an expression beside aggregates must be a variable of GROUP BY")
        found = found.groupBy(*[F.col(f"`{g}`") for g in q.groups]).agg(*out)
        names = [name for _, name in items]
        rows = found.select(*[F.col(f"`{c}`.v").alias(c) if c in q.groups else F.col(f"`{c}`") for c in names])
        for e, down in reversed(q.order[:1]):
            rows = rows.orderBy(F.desc(e[1]) if down else F.asc_nulls_first(e[1]), *[F.asc(c) for c in names if c != e[1]])
    else:
        order = [(F.desc_nulls_last if down else F.asc_nulls_first)(F.col(f"`{e[1]}`") if q.distinct else run.term(e, known)["v"]) for e, down in q.order]
        found = found.orderBy(*order) if order and not q.distinct else found
        rows = found.select(*[run.term(e, known)["v"].alias(name) for e, name in items])
        rows = rows.distinct() if q.distinct else rows
        rows = rows.orderBy(*order) if order and q.distinct else rows  # by variables that are selected
    return rows if q.limit is None else rows.limit(q.limit)
