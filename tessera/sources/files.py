"""Files of statements: Turtle and RDF/XML beside N-Triples, names of outputs.

Neither Turtle nor RDF/XML can be split, so a file is parsed by one task; many files are parsed in parallel, N-Triples
line by line. Blank nodes are named after their file and place, so that a task that runs again gives the same names.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .triples import COLUMNS, SCHEMA, detect_format, format_ntriples, read_ntriples, unescaped, write_ntriples
from .vocabulary import PREFIXES, compact, expand
from .workers import ship

RDF, XSD = PREFIXES["rdf"], PREFIXES["xsd"]
_TOKEN = re.compile(
    r'''\s+|\#[^\n]*|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*\'\'\')|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"""|(?P<iri><[^<>"{}|^`\s]*>)|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)|[0-9]*\.[0-9]+|[0-9]+))"""
    r"""|(?P<bnode>_:[\w.-]*[\w-])|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-]|\\.|\.(?=[\w:%-]))*)|(?P<word>[A-Za-z]+)|(?P<op>[.;,\[\]()])""",
    re.DOTALL,
)


def parse_turtle(text: str, name: str = "") -> Iterator[tuple]:
    """(s, p, o, o_kind, o_dt, o_lang) of a Turtle document; ValueError where it is none."""
    mark = f"_:f{zlib.crc32(name.encode()):08x}"
    prefixes: dict[str, str] = {}
    base, fresh, at, tokens = "", 0, 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    place, out = 0, []

    def peek(what: str) -> bool:
        return place < len(tokens) and tokens[place][1] == what

    def take() -> tuple[str, str]:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the document ends within a statement")
        place += 1
        return tokens[place - 1]

    def need(what: str) -> None:
        found = take()[1]
        if found != what:
            raise ValueError(f"{what} expected, not {found!r}")

    def iri(kind: str, word: str) -> str:
        if kind == "iri":
            return urljoin(base, unescaped(word[1:-1])) if base else unescaped(word[1:-1])
        prefix, local = word.split(":", 1)
        if prefix not in prefixes:
            raise ValueError(f"prefix {prefix}: is not declared")
        return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def blank() -> str:
        nonlocal fresh
        fresh += 1
        return f"{mark}b{fresh}"

    def term() -> tuple[str, str, str, str]:
        kind, word = take()
        if kind in ("iri", "name"):
            return iri(kind, word), "iri", "", ""
        if kind == "bnode":
            return f"{mark}n{word[2:]}", "bnode", "", ""
        if kind in ("string", "long"):
            body = unescaped(word[3:-3] if kind == "long" else word[1:-1])
            if place < len(tokens) and tokens[place][0] == "at":
                return body, "literal", "", take()[1][1:].lower()
            if place < len(tokens) and tokens[place][0] == "type":
                take()
                return body, "literal", iri(*take()), ""
            return body, "literal", "", ""
        if kind == "number":
            return word, "literal", XSD + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer"), ""
        if word in ("true", "false"):
            return word, "literal", XSD + "boolean", ""
        if word == "[":
            node = blank()
            if not peek("]"):
                said(node)
            need("]")
            return node, "bnode", "", ""
        if word == "(":
            items = []
            while not peek(")"):
                items.append(term())
            take()
            cells = [blank() for _ in items]
            for k, (cell, item) in enumerate(zip(cells, items)):
                out.append((cell, RDF + "first", *item))
                out.append((cell, RDF + "rest", *((cells[k + 1], "bnode", "", "") if k + 1 < len(cells) else (RDF + "nil", "iri", "", ""))))
            return (cells[0], "bnode", "", "") if cells else (RDF + "nil", "iri", "", "")
        raise ValueError(f"a term expected, not {word!r}")

    def said(s: str) -> None:
        while True:
            kind, word = take()
            p = RDF + "type" if word == "a" else iri(kind, word)
            while True:
                out.append((s, p, *term()))
                if not peek(","):
                    break
                take()
            while peek(";"):
                take()
            if peek(".") or peek("]") or place >= len(tokens):
                return

    while place < len(tokens):
        word = tokens[place][1]
        if word.lower() in ("@prefix", "prefix"):
            take()
            name_ = take()[1]
            prefixes[name_[:-1]] = iri(*take())
            if word.startswith("@"):
                need(".")
        elif word.lower() in ("@base", "base"):
            take()
            base = iri(*take())
            if word.startswith("@"):
                need(".")
        else:
            open_ = peek("[")
            s, kind, _, _ = term()
            if kind == "literal":
                raise ValueError(f"a literal {s!r} is no subject")
            if not (open_ and peek(".")):
                said(s)
            need(".")
        yield from out
        out.clear()


def parse_rdfxml(text: str, name: str = "") -> Iterator[tuple]:
    """(s, p, o, o_kind, o_dt, o_lang) of an RDF/XML document."""
    mark, fresh = f"_:f{zlib.crc32(name.encode()):08x}", 0
    r, lang_ = f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}lang"
    base_ = "{http://www.w3.org/XML/1998/namespace}base"

    def whole(tag: str) -> str:
        return tag[1:].replace("}", "", 1)

    def blank() -> str:
        nonlocal fresh
        fresh += 1
        return f"{mark}b{fresh}"

    def node(e, lang: str, base: str):
        lang, base = e.get(lang_, lang), e.get(base_, base)
        about, own, anonymous = e.get(r + "about"), e.get(r + "ID"), e.get(r + "nodeID")
        s = urljoin(base, about) if about is not None else f"{base}#{own}" if own else f"{mark}n{anonymous}" if anonymous else blank()
        out = [] if e.tag == r + "Description" else [(s, RDF + "type", whole(e.tag), "iri", "", "")]
        for k, v in e.attrib.items():
            if not k.startswith((r, "{http://www.w3.org/XML/1998/namespace}")):
                out.append((s, whole(k), v, "literal", "", lang))
            elif k == r + "type":
                out.append((s, RDF + "type", urljoin(base, v), "iri", "", ""))
        number = 0
        for x in e:
            tag = whole(x.tag)
            if x.tag == r + "li":
                number += 1
                tag = f"{RDF}_{number}"
            out += prop(s, tag, x, x.get(lang_, lang), base)
        return s, out

    def ref(s: str) -> tuple:
        return (s, "bnode" if s.startswith("_:") else "iri", "", "")

    def prop(s: str, p: str, x, lang: str, base: str) -> list[tuple]:
        resource, anonymous, how = x.get(r + "resource"), x.get(r + "nodeID"), x.get(r + "parseType")
        if resource is not None:
            return [(s, p, urljoin(base, resource), "iri", "", "")]
        if anonymous:
            return [(s, p, f"{mark}n{anonymous}", "bnode", "", "")]
        if how == "Resource":
            inner = ET.Element(r + "Description")
            inner.extend(list(x))
            o, more = node(inner, lang, base)
            return [(s, p, *ref(o)), *more]
        if how == "Collection":
            found = [node(y, lang, base) for y in x]
            cells = [blank() for _ in found]
            out = [(s, p, *ref(cells[0] if cells else RDF + "nil"))]
            for k, (cell, (o, more)) in enumerate(zip(cells, found)):
                out += [(cell, RDF + "first", *ref(o)), (cell, RDF + "rest", *ref(cells[k + 1] if k + 1 < len(cells) else RDF + "nil")), *more]
            return out
        if how == "Literal":
            return [(s, p, (x.text or "") + "".join(ET.tostring(y, encoding="unicode") for y in x), "literal", RDF + "XMLLiteral", "")]
        if len(x):
            o, more = node(x[0], lang, base)
            return [(s, p, *ref(o)), *more]
        dt = x.get(r + "datatype", "")
        return [(s, p, x.text or "", "literal", dt, "" if dt else lang.lower())]

    root = ET.fromstring(text)
    base = root.get(base_, "")
    for e in root if root.tag == r + "RDF" else [root]:
        yield from node(e, root.get(lang_, ""), base)[1]


_PARSERS = {"turtle": parse_turtle, "n3": parse_turtle, "xml": parse_rdfxml}


def read_graph(spark: SparkSession, path: str, format: str | None = None, prefixed: bool = True, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Triples of files; the format is told by the extension unless it is named. prefixed: with prefixed names, else full IRIs."""
    ship()
    kind = format or detect_format(path)
    if kind == "nt":
        t = read_ntriples(spark, path)
    elif kind in _PARSERS:
        parse = _PARSERS[kind]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, text in zip(batch["name"], batch["value"]):
                    yield pd.DataFrame(list(parse(text, os.path.basename(name))), columns=COLUMNS)

        t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value").mapInPandas(run, SCHEMA)
    else:
        raise ValueError(f"no reader of {kind}")
    return compact(t, prefixes) if prefixed else t


def turtle_blocks(t: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(s, value): one block of Turtle a subject, its statements in order; names are prefixed where that can be read back."""
    known = PREFIXES | (prefixes or {})
    plain = rf"^({'|'.join(known)}):[A-Za-z0-9_]([A-Za-z0-9_-]*[A-Za-z0-9_])?$"
    name = lambda c: F.when(c.startswith("_:") | c.rlike(plain), c).otherwise(F.concat(F.lit("<"), _full(c, known), F.lit(">")))
    body = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(a), F.lit(b))
    mark = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt") != "", F.concat(F.lit("^^"), name(F.col("o_dt")))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), body, F.lit('"'), mark)).otherwise(name(F.col("o")))
    p = F.when(F.col("p") == "rdf:type", "a").otherwise(name(F.col("p")))
    said = t.select("s", F.struct(p.alias("p"), o.alias("o")).alias("x")).groupBy("s").agg(F.array_sort(F.collect_set("x")).alias("xs"))  # a subject's own statements
    lines = F.array_join(F.transform("xs", lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    ")
    return said.select("s", F.concat(name(F.col("s")), F.lit(" "), lines, F.lit(" .")).alias("value"))


def _full(c, known):
    out = c
    for prefix, base in known.items():
        out = F.when(c.startswith(f"{prefix}:"), F.concat(F.lit(base), F.substr(c, F.lit(len(prefix) + 2)))).otherwise(out)
    return out


def xml_blocks(t: DataFrame) -> DataFrame:
    """(s, value): one rdf:Description a subject; statements whose property cannot be split into namespace and name raise an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, xs in zip(batch["s"], batch["xs"]):
                lines = [f"<rdf:Description {'rdf:nodeID' if s.startswith('_:') else 'rdf:about'}={quoteattr(s[2:] if s.startswith('_:') else s)}>"]
                for x in xs:
                    m = re.fullmatch(r"(.*?)([A-Za-z_][\w.-]*)", x["p"])
                    if not m:
                        raise ValueError(f"{x['p']} has no name that XML allows")
                    tag = f"<p:{m[2]} xmlns:p={quoteattr(m[1])}"
                    if x["o_kind"] == "literal":
                        about = f" xml:lang={quoteattr(x['o_lang'])}" if x["o_lang"] else f" rdf:datatype={quoteattr(x['o_dt'])}" if x["o_dt"] else ""
                        lines.append(f"  {tag}{about}>{escape(x['o'])}</p:{m[2]}>")
                    else:
                        lines.append(f"  {tag} {'rdf:nodeID' if x['o_kind'] == 'bnode' else 'rdf:resource'}={quoteattr(x['o'][2:] if x['o_kind'] == 'bnode' else x['o'])}/>")
                out.append("\n".join([*lines, "</rdf:Description>"]))
            yield pd.DataFrame({"s": batch["s"], "value": out})

    ship()
    said = t.groupBy("s").agg(F.array_sort(F.collect_set(F.struct("p", "o", "o_kind", "o_dt", "o_lang"))).alias("xs"))  # a subject's own statements
    return said.mapInPandas(run, "s string, value string")


def write_graph(t: DataFrame, path: str, format: str = "nt", prefixes: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Text files in folder path. N-Triples are written by all tasks; Turtle and RDF/XML as one file, which has a head."""
    spark, known = t.sparkSession, PREFIXES | (prefixes or {})
    if format == "nt":
        return write_ntriples(expand(t, prefixes), path, mode)
    if format == "turtle":
        head, foot, blocks = "\n".join(f"@prefix {p}: <{b}> ." for p, b in known.items()), None, turtle_blocks(t, prefixes)
    elif format == "xml":
        head, foot, blocks = f'<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>", xml_blocks(expand(t, prefixes))
    else:
        raise ValueError(f"no writer of {format}")
    ends = spark.createDataFrame([(0, "", head)] + ([(2, "", foot)] if foot else []), "part int, s string, value string")
    whole = ends.union(blocks.select(F.lit(1), "s", "value")).repartition(1).sortWithinPartitions("part", "s")
    whole.select("value").write.mode(mode).text(path)


def without_imports(t: DataFrame) -> DataFrame:
    """What a reasoner reads: t without what it would fetch."""
    return t.where("p != 'owl:imports'")


def output_name(path: str, merge: bool) -> str:
    """Beside the input: its name with _merged or _tbox."""
    return os.path.splitext(path)[0] + ("_merged.ttl" if merge else "_tbox.ttl")


def output_title(path: str) -> str:
    stem = os.path.splitext(os.path.basename(path))[0]
    return "Ontologia " + re.sub("[_-]", " ", stem).title()


__all__ = ["format_ntriples", "output_name", "output_title", "parse_rdfxml", "parse_turtle", "read_graph", "turtle_blocks", "without_imports", "write_graph", "xml_blocks"]
