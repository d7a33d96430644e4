"""Refinement of a merged graph: terms purged, entities reshaped, text tagged, what is unused pruned. Graph in, graph out.

Each step is a set of statements to delete and one to add, over the whole graph at once; steps that feed themselves go on
until nothing changes. `refine` runs all of them in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import classify, clean_literal, data_namespace, is_spurious, term_name
from ..sources.triples import COLUMNS, LABEL, TYPE
from .patterns import cut, merged
from .rewrites import materialise_inverses, part_of, redirected
from .schema import COMMENT, CONSTRAINTS, SUBCLASS, rows

CLASS, OBJECT, DATA, NAMED = "owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:NamedIndividual"

#: Levels of access by the first keyword that a label holds: keyword, name of the shared node, label, description.
LEVELS = [
    ("non accessibile", "non-accessibile", "Non accessibile", "Il sito non è accessibile a persone con ridotta mobilità."),
    ("parzialmente", "parzialmente-accessibile", "Parzialmente accessibile", "Il sito è accessibile solo in parte: alcune aree presentano barriere architettoniche."),
    ("totalmente", "totalmente-accessibile", "Totalmente accessibile", "Il sito è interamente accessibile, senza barriere architettoniche."),
    ("completamente", "totalmente-accessibile", "Totalmente accessibile", "Il sito è interamente accessibile, senza barriere architettoniche."),
]
#: Kinds of buildings by the first keyword that a label holds.
KINDS = [
    ("murale", "Murale"), ("lapide", "OperaCommemorativa"), ("tabernacolo", "OperaDevozionale"), ("ponte", "Ponte"), ("torre", "Torre"), ("cimitero", "Cimitero"),
    ("baluardo", "Fortificazione"), ("forte", "Fortificazione"), ("porta", "Porta"), ("stazione", "Stazione"), ("loggia", "Loggia"), ("biblioteca", "Biblioteca"),
    ("stadio", "Stadio"), ("villa", "Villa"), ("galleria", "Museo"), ("uffizi", "Museo"), ("museo", "Museo"), ("palazzo", "Palazzo"), ("piazzale", "Piazza"), ("piazza", "Piazza"),
]
OTHER_KIND = "AltroBeneCulturale"
#: Labels of kinds that are not their names, Italian and English.
KIND_LABELS = {
    "Piazza": ("Piazza", "Square"), "Ponte": ("Ponte", "Bridge"), "Torre": ("Torre", "Tower"), "Cimitero": ("Cimitero", "Cemetery"), "Palazzo": ("Palazzo", "Palace"),
    "Villa": ("Villa", "Villa"), "Biblioteca": ("Biblioteca", "Library"), "Stadio": ("Stadio", "Stadium"), "Fortificazione": ("Fortificazione", "Fortification"),
    "Porta": ("Porta cittadina", "City gate"), "Stazione": ("Stazione", "Station"), "Loggia": ("Loggia", "Loggia"), "Museo": ("Museo", "Museum"), "Murale": ("Murale", "Mural"),
    "OperaCommemorativa": ("Opera commemorativa", "Commemorative work"), "OperaDevozionale": ("Opera devozionale", "Devotional work"),
    "AltroBeneCulturale": ("Altro bene culturale", "Other cultural property"),
}
#: Italian labels of known terms, by local name.
ITALIAN = {
    "CulturalInstituteOrSite": "Istituto culturale o sito", "Site": "Sito", "Address": "Indirizzo", "AccessCondition": "Condizione di accesso", "Email": "Email",
    "Telephone": "Telefono", "WebSite": "Sito web", "Geometria": "Geometria", "Contact": "Contatto", "asWKT": "geometria (WKT)", "name": "nome",
    "fullAddress": "indirizzo completo", "emailAddress": "indirizzo email", "telephoneNumber": "numero di telefono", "URL": "URL", "accessibilityNote": "nota di accessibilità",
    "hasAddress": "ha indirizzo", "hasAccessCondition": "ha condizione di accesso", "hasSite": "ha sito", "haCoordinate": "ha coordinate", "eCoordinataDi": "è coordinata di",
    "haContatti": "ha contatti", "eContattoDi": "è contatto di", "isAddressOf": "è indirizzo di", "isAccessConditionOf": "è condizione di accesso di", "isPartOf": "fa parte di",
}


@dataclass(frozen=True)
class Names:
    """The terms that refinement is about; `own` is the prefix of the terms that it makes."""

    own: str = "ex:"
    main: str = "cis:CulturalInstituteOrSite"
    access: str = "ac:AccessCondition"
    has_access: str = "ac:hasAccessCondition"
    description: str = "l0:description"
    texts: tuple[str, ...] = ("arco:description", "l0:name", "l0:description")
    addresses: tuple[str, ...] = ("cis:siteAddress", "cis:haIndirizzo")
    address: str = "clv:Address"
    wkt: str = "geosparql:asWKT"
    website: str = "sm:WebSite"
    contacts: tuple[str, ...] = ("sm:Email", "sm:Telephone")
    has_website: str = "sm:hasWebSite"
    has_contacts: tuple[str, ...] = ("sm:hasEmail", "sm:hasTelephoneNumber")
    ontology: str = "https://example.org/refined"
    levels: list = field(default_factory=lambda: LEVELS, hash=False)


def facts(t: DataFrame, *said: tuple) -> DataFrame:
    """Constant triples: (s, p, o) of IRIs, (s, p, text, lang) of literals."""
    all_ = [(x[0], x[1], x[2], "iri" if len(x) == 3 else "literal", "", "" if len(x) == 3 else x[3]) for x in said]
    return t.sparkSession.createDataFrame(all_, ", ".join(f"{c} string" for c in COLUMNS))


def members(t: DataFrame, cls: str) -> DataFrame:
    return t.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()


def terms(t: DataFrame, *names: str) -> DataFrame:
    return t.sparkSession.createDataFrame([(x,) for x in names], "s string")


def spliced(t: DataFrame, gone: DataFrame) -> DataFrame:
    """t with the list cells whose value is a term of gone (s) taken out; what pointed to one points to the next that stays."""
    dead = t.where("p = 'rdf:first'").join(gone.select(F.col("s").alias("o")), "o", "left_semi").select(F.col("s").alias("cell")).distinct()
    dead = cut(dead)
    if dead.isEmpty():
        return t
    after = dead.join(t.where("p = 'rdf:rest'").select(F.col("s").alias("cell"), F.col("o").alias("to")), "cell", "left").select("cell", F.coalesce("to", F.lit("rdf:nil")).alias("to"))
    after = cut(after)
    while True:  # runs of dead cells halve in every round
        longer = after.alias("x").join(after.alias("y"), F.col("x.to") == F.col("y.cell"), "left")
        if longer.where("y.cell IS NOT NULL").isEmpty():
            break
        after = cut(longer.select("x.cell", F.coalesce("y.to", "x.to").alias("to")))
    kept = t.join(dead.select(F.col("cell").alias("s")), "s", "left_anti").join(after.select(F.col("cell").alias("o"), "to"), "o", "left")
    return kept.select("s", "p", F.coalesce("to", "o").alias("o"), F.when(F.col("to") == "rdf:nil", "iri").otherwise(F.col("o_kind")).alias("o_kind"), "o_dt", "o_lang")


def purged(t: DataFrame, gone: DataFrame) -> DataFrame:
    """t without the terms of gone (s): what is said of them, where they are objects, restrictions on them and lists' cells.

    Statements that use a term as predicate stay.
    """
    gone = cut(gone.select("s").distinct())
    if gone.isEmpty():
        return t
    objects = gone.select(F.col("s").alias("o"))
    broken = t.where(F.col("p").isin("owl:onProperty", "owl:onClass", "owl:someValuesFrom", "owl:allValuesFrom", "owl:hasValue")).join(objects, "o", "left_semi").select("s").distinct()
    t = t.join(broken, "s", "left_anti").join(broken.select(F.col("s").alias("o"), F.lit(SUBCLASS).alias("p")), ["o", "p"], "left_anti").select(COLUMNS)
    t = spliced(t, gone).join(gone, "s", "left_anti")
    whole = t.where("o_kind != 'literal'").join(objects, "o", "left_anti").select(COLUMNS)
    return whole.unionByName(t.where("o_kind = 'literal'").select(COLUMNS))


def clean_text(t: DataFrame, names: Names) -> DataFrame:
    """t without comments on confidence; labels, names and descriptions without quotes of a bad export."""
    t = t.where(~((F.col("p") == COMMENT) & (F.col("o_kind") == "literal") & F.col("o").contains("confidence:")))
    hit = F.col("p").isin(LABEL, *names.texts) & (F.col("o_kind") == "literal") & F.col("o_dt").isin("", "xsd:string")
    done = t.where(hit).select("s", "p", clean_literal(F.col("o")).alias("o"), "o_kind", F.lit("").alias("o_dt"), "o_lang")
    return merged(t.where(~hit), done)


def without_orphans(t: DataFrame) -> DataFrame:
    """t without IRIs that have labels alone and are nowhere an object."""
    bare = t.where(~F.col("s").startswith("_:")).groupBy("s").agg(F.max(F.col("p") != LABEL).alias("more")).where("NOT more").select("s")
    used = t.where("o_kind = 'iri'").select(F.col("o").alias("s")).distinct()
    return t.join(bare.join(used, "s", "left_anti"), "s", "left_anti")


def one_address(t: DataFrame, names: Names) -> DataFrame:
    """t with one property for addresses, declared; what is said of the old ones goes."""
    new = f"{names.own}hasAddress"
    t = t.where(~F.col("s").isin(*names.addresses)).withColumn("p", F.when(F.col("p").isin(*names.addresses), new).otherwise(F.col("p")))
    said = facts(t, (new, TYPE, OBJECT), (new, TYPE, "owl:FunctionalProperty"), (new, LABEL, "ha indirizzo", "it"), (new, LABEL, "has address", "en"), (new, "rdfs:domain", names.main), (new, "rdfs:range", names.address))
    return merged(t, said)


def geometry(t: DataFrame, names: Names) -> DataFrame:
    """t with geometries as members of one class behind one property, whatever namespaces both had; inverse and text declared."""
    cls, has, back = (names.own + x for x in ("Geometria", "haCoordinate", "eCoordinataDi"))
    every = t.select(F.col("s").alias("x")).union(t.select("p")).union(t.where("o_kind = 'iri'").select("o")).distinct()
    name = F.element_at(F.split(term_name(F.col("x")), ":"), -1)
    old = cut(every.where(~F.col("x").startswith("_:") & name.isin("hasGeometry", "Geometry")).select(F.col("x").alias("s"), (name == "hasGeometry").alias("prop")))
    hits = t.join(old.where("prop").select(F.col("s").alias("p")), "p", "left_semi").select(COLUMNS)
    shapes = hits.select(F.col("o").alias("s")).distinct()
    moved = merged(rows(hits, F.col("s"), has, F.col("o")), rows(shapes, F.col("s"), TYPE, cls), rows(shapes, F.col("s"), TYPE, NAMED))
    rest = t.join(old.where("prop").select(F.col("s").alias("p")), "p", "left_anti").select(COLUMNS)
    rest = purged(rest, old.select("s").union(terms(t, names.wkt)))
    said = facts(
        t, (cls, TYPE, CLASS), (cls, LABEL, "Geometria", "it"), (has, TYPE, OBJECT), (has, LABEL, "ha coordinate", "it"), (has, "rdfs:domain", names.main), (has, "rdfs:range", cls),
        (has, "owl:inverseOf", back), (back, TYPE, OBJECT), (back, LABEL, "è coordinata di", "it"), (back, "rdfs:domain", cls), (back, "rdfs:range", names.main),
        (names.wkt, TYPE, DATA), (names.wkt, LABEL, "geometria (WKT)", "it"), (names.wkt, "rdfs:domain", cls), (names.wkt, "rdfs:range", "xsd:string"),
    )
    return merged(rest, moved, said)


def taxonomy(t: DataFrame, names: Names) -> DataFrame:
    """t with members of the main class typed by the first keyword of their label, and those kinds declared as subclasses."""
    labels = members(t, names.main).join(t.where(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("label")), "s", "left")
    kinds = labels.select("s", classify(F.coalesce("label", F.lit("")), KINDS, OTHER_KIND).alias("kind"))
    known = t.sparkSession.createDataFrame([(k, *v) for k, v in KIND_LABELS.items()], "kind string, it string, en string")
    used, cls = kinds.select("kind").distinct().join(known, "kind"), F.concat(F.lit(names.own), "kind")
    out = rows(kinds, F.col("s"), TYPE, cls).unionByName(rows(used, cls, TYPE, CLASS)).unionByName(rows(used, cls, SUBCLASS, names.main))
    return merged(t, out, rows(used, cls, LABEL, F.col("it"), "literal", "", "it"), rows(used, cls, LABEL, F.col("en"), "literal", "", "en"))


def compact_main(t: DataFrame, names: Names) -> DataFrame:
    """t with the members of the main class's subclasses in the main class itself, and the subclasses purged."""
    below = cut(t.where((F.col("p") == SUBCLASS) & (F.col("o") == names.main) & ~F.col("s").startswith("_:")).select("s").distinct())
    typed = t.where(F.col("p") == TYPE).join(below.select(F.col("s").alias("o")), "o", "left_semi").select("s").distinct()
    return merged(purged(t, below), rows(typed, F.col("s"), TYPE, names.main))


def union_class(t: DataFrame, node: str, *classes: str) -> DataFrame:
    """The triples of an anonymous class, the union of classes; blank nodes are named after node."""
    cells = [f"{node}-{k}" for k in range(len(classes))]
    out = [(node, TYPE, CLASS, "iri"), (node, "owl:unionOf", cells[0], "bnode")]
    for k, (cell, cls) in enumerate(zip(cells, classes)):
        out += [(cell, "rdf:first", cls, "iri"), (cell, "rdf:rest", *((cells[k + 1], "bnode") if k + 1 < len(cells) else ("rdf:nil", "iri")))]
    return t.sparkSession.createDataFrame([(*x, "", "") for x in out], ", ".join(f"{c} string" for c in COLUMNS))


def contacts(t: DataFrame, names: Names) -> DataFrame:
    """t with a website as contact of its holder and e-mail and telephone as contacts of the website; a holder's first website takes them.

    Holders without a website keep theirs. Contact, its subclasses, the property and its inverse are declared.
    """
    kinds = (names.website, *names.contacts)
    if t.where((F.col("p") == TYPE) & F.col("o").isin(*kinds)).isEmpty():
        return t
    contact, has, back = (names.own + x for x in ("Contact", "haContatti", "eContattoDi"))
    web = t.where(F.col("p") == names.has_website).join(members(t, names.main), "s", "left_semi").groupBy("s").agg(F.min("o").alias("web"))
    web = cut(web)
    direct = t.where(F.col("p").isin(*names.has_contacts)).join(web, "s").select("s", "p", "o", "web")
    on_site = t.where(F.col("p").isin(*names.has_contacts)).join(members(t, names.website), "s", "left_semi").select("s", "p", "o")
    first = web.select("s", F.lit(names.has_website).alias("p"), F.col("web").alias("o"))
    gone = direct.select("s", "p", "o").union(on_site).union(first).distinct()
    kept = t.join(gone, ["s", "p", "o"], "left_anti").where(F.col("s") != names.has_website).select(COLUMNS)
    used = kept.where(F.col("p").isin(*names.has_contacts)).select(F.col("p").alias("s")).distinct()
    unused = terms(t, *names.has_contacts).join(used, "s", "left_anti")
    kept = kept.join(unused, "s", "left_anti")
    moved = merged(rows(direct, F.col("web"), has, F.col("o")), rows(on_site, F.col("s"), has, F.col("o")), rows(web, F.col("s"), has, F.col("web")))
    holder, other = union_class(t, "_:holder-of-contacts", names.main, names.website), union_class(t, "_:contacts-of-holder", names.main, names.website)
    said = facts(
        t, (contact, TYPE, CLASS), (contact, LABEL, "Contatto", "it"), (contact, LABEL, "Contact", "en"), (contact, COMMENT, "Recapito di un bene culturale: sito web, email o telefono.", "it"),
        *((x, SUBCLASS, contact) for x in kinds), (has, TYPE, OBJECT), (has, LABEL, "ha contatti", "it"), (has, "rdfs:range", contact), (has, "owl:inverseOf", back),
        (back, TYPE, OBJECT), (back, LABEL, "è contatto di", "it"), (back, "rdfs:domain", contact),
    )
    ends = t.sparkSession.createDataFrame([(has, "rdfs:domain", "_:holder-of-contacts", "bnode", "", ""), (back, "rdfs:range", "_:contacts-of-holder", "bnode", "", "")], ", ".join(f"{c} string" for c in COLUMNS))
    return merged(kept, moved, holder, other, said, ends)


def shared_access(t: DataFrame, names: Names, namespace: str) -> DataFrame:
    """t with conditions of access replaced by one shared node a level; a condition's description becomes its holders' note.

    Conditions whose label tells no level stay, and so do the shared nodes where they are there already.
    """
    own = members(t, names.access)
    slug = {x[1]: x for x in names.levels}
    level = classify(F.coalesce("label", F.lit("")), [(k, s) for k, s, _, _ in names.levels], "")
    labels = t.where(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("label"))
    base = f"{namespace}access-condition/"
    found = own.join(labels, "s", "left").select("s", level.alias("slug")).where((F.col("slug") != "") & ~F.col("s").isin(*[base + k for k in slug]))
    found = cut(found)
    if found.isEmpty():
        return t
    notes = t.where((F.col("p") == names.description) & (F.trim("o") != "")).groupBy("s").agg(F.min("o").alias("note"))
    held = t.where(F.col("p") == names.has_access).select(F.col("s").alias("holder"), F.col("o").alias("s")).join(found, "s").join(notes, "s", "left")
    node, note = F.concat(F.lit(base), "slug"), f"{names.own}accessibilityNote"
    known = t.sparkSession.createDataFrame([(k, x[2], x[3]) for k, x in slug.items()], "slug string, label string, text string").join(found.select("slug").distinct(), "slug")
    new = merged(
        rows(held, F.col("holder"), names.has_access, node), rows(held, F.col("holder"), note, F.col("note"), "literal", "", "it"), rows(known, node, TYPE, names.access), rows(known, node, TYPE, NAMED),
        rows(known, node, LABEL, F.col("label"), "literal", "", "it"), rows(known, node, names.description, F.col("text"), "literal", "", "it"),
        facts(t, (note, TYPE, DATA), (note, LABEL, "nota di accessibilità", "it"), (note, "rdfs:domain", names.main), (note, "rdfs:range", "rdfs:Literal")),
    )
    kept = t.join(found.select("s"), "s", "left_anti").join(found.select(F.col("s").alias("o"), F.lit(names.has_access).alias("p")), ["o", "p"], "left_anti").select(COLUMNS)
    return merged(kept, new)


def parts(t: DataFrame, names: Names) -> DataFrame:
    """t with members of the main class whose label is 'name - rest' as parts of the one labelled 'name', and the property declared."""
    labels = members(t, names.main).join(t.where(F.col("p") == LABEL).groupBy("s").agg(F.min(F.trim("o")).alias("label")), "s")
    found, p = cut(part_of(labels)), f"{names.own}isPartOf"
    if found.isEmpty():
        return t
    said = facts(t, (p, TYPE, OBJECT), (p, TYPE, "owl:TransitiveProperty"), (p, LABEL, "fa parte di", "it"), (p, LABEL, "is part of", "en"), (p, "rdfs:domain", names.main), (p, "rdfs:range", names.main))
    return merged(t, rows(found, F.col("s"), p, F.col("whole")), said)


def tagged_text(t: DataFrame, names: Names) -> DataFrame:
    """t with labels of the main class's members and text in Italian where no language is named; ranges of properties with tagged values are rdfs:Literal."""
    plain = (F.col("o_kind") == "literal") & (F.col("o_lang") == "") & F.col("o_dt").isin("", "xsd:string")
    text = F.col("p").isin(*names.texts, f"{names.own}accessibilityNote")
    own = t.join(members(t, names.main).withColumn("_main", F.lit(True)), "s", "left")
    hit = plain & (text | ((F.col("p") == LABEL) & F.coalesce("_main", F.lit(False))))
    t = own.select("s", "p", "o", "o_kind", F.when(hit, "").otherwise(F.col("o_dt")).alias("o_dt"), F.when(hit, "it").otherwise(F.col("o_lang")).alias("o_lang")).distinct()
    spoken = t.where("o_lang != ''").select(F.col("p").alias("s")).distinct()
    wide = cut(members(t, DATA).join(spoken, "s", "left_semi"))
    old = wide.select("s", F.lit("rdfs:range").alias("p"))
    return merged(t.join(old, ["s", "p"], "left_anti").select(COLUMNS), rows(wide, F.col("s"), "rdfs:range", "rdfs:Literal"))


def described(t: DataFrame, names: Names) -> DataFrame:
    """t with the two description properties told apart by their labels, where anything is said of them."""
    both = {"arco:description": ("descrizione del bene culturale", "cultural property description"), names.description: ("descrizione della condizione di accesso", "access condition description")}
    there = cut(terms(t, *both).join(t.select("s"), "s", "left_semi"))
    new = facts(t, *((p, LABEL, x, lang) for p, xs in both.items() for x, lang in zip(xs, ("it", "en")))).join(there, "s", "left_semi")
    return merged(t.join(there.select("s", F.lit(LABEL).alias("p")), ["s", "p"], "left_anti").select(COLUMNS), new.select(COLUMNS))


def inverses(t: DataFrame, names: Names) -> DataFrame:
    """t with inverses declared for access and address where none is, and all declared inverses materialised both ways."""
    pairs = t.where("p = 'owl:inverseOf'").select(F.col("s").alias("p"), F.col("o").alias("q"))
    declared = pairs.select("p").union(pairs.select("q"))
    nice = t.sparkSession.createDataFrame([(names.has_access, "isAccessConditionOf"), (f"{names.own}hasAddress", "isAddressOf")], "p string, name string")
    new = cut(nice.join(declared, "p", "left_anti").join(t.select("p"), "p", "left_semi"))
    inverse = F.concat(F.lit(names.own), "name")
    said = merged(rows(new, inverse, TYPE, OBJECT), rows(new, inverse, "owl:inverseOf", F.col("p")), rows(new, inverse, LABEL, F.col("name"), "literal", "", "en"))
    return materialise_inverses(merged(t, said), pairs.union(new.select(inverse.alias("p"), F.col("p").alias("q"))).distinct())


def pruned(t: DataFrame, names: Names) -> DataFrame:
    """t without faulty names, superclasses of the main class, properties that no fact uses and empty classes, until none is left.

    A class is empty without members and subclasses, unless it is a domain or range.
    """
    every = t.select("s").union(t.where("o_kind = 'iri'").select("o")).distinct().where(~F.col("s").startswith("_:"))
    t = cut(purged(t, every.where(is_spurious(F.col("s")))))
    t = t.where(~((F.col("s") == names.main) & (F.col("p") == SUBCLASS) & (F.col("o_kind") == "iri") & (F.col("o") != "owl:Thing")))
    declared = members(t, OBJECT).union(members(t, DATA)).distinct()
    t = cut(purged(t, declared.join(t.select(F.col("p").alias("s")), "s", "left_anti")))
    while True:
        used = t.where(F.col("p").isin(TYPE, SUBCLASS, "rdfs:domain", "rdfs:range")).select(F.col("o").alias("s"))
        empty = cut(members(t, CLASS).where(F.col("s") != names.main).join(used, "s", "left_anti"))
        if empty.isEmpty():
            return t
        t = cut(purged(t, empty))


def italian_labels(t: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """t with one label in Italian for each class and property: the known one of its local name, else its smallest Italian one; terms without either stay."""
    declared = t.where((F.col("p") == TYPE) & F.col("o").isin(CLASS, OBJECT, DATA)).select("s").distinct()
    table = t.sparkSession.createDataFrame(list((ITALIAN if known is None else known).items()), "name string, word string")
    said = t.where((F.col("p") == LABEL) & (F.col("o_lang") == "it")).groupBy("s").agg(F.min("o").alias("own"))
    named = declared.withColumn("name", F.element_at(F.split(term_name(F.col("s")), ":"), -1)).join(F.broadcast(table), "name", "left").join(said, "s", "left")
    new = cut(named.select("s", F.coalesce("word", "own").alias("word")).where("word IS NOT NULL"))
    kept = t.join(new.select("s", F.lit(LABEL).alias("p")), ["s", "p"], "left_anti").select(COLUMNS)
    return merged(kept, rows(new, F.col("s"), LABEL, F.col("word"), "literal", "", "it"))


def retitled(t: DataFrame, iri: str) -> DataFrame:
    """t with all that is said of ontologies said of one, with its version."""
    olds = t.where((F.col("p") == TYPE) & (F.col("o") == "owl:Ontology") & (F.col("s") != iri)).select("s").distinct()
    own = t.join(olds, "s", "left_semi").withColumn("s", F.lit(iri)).select(COLUMNS)
    rest = merged(t.join(olds, "s", "left_anti").select(COLUMNS), own)
    rest = rest.where(~((F.col("s") == iri) & F.col("p").isin("owl:versionInfo", "owl:versionIRI")))
    return merged(rest, facts(t, (iri, TYPE, "owl:Ontology"), (iri, "owl:versionInfo", "refined", ""), (iri, "owl:versionIRI", iri.rstrip("/") + "/1.0")))


def data_base(t: DataFrame, names: Names) -> str:
    """The namespace of the main class's members, up to /data/; one of examples if none has any."""
    found = members(t, names.main).select(data_namespace(F.col("s")).alias("x")).agg(F.min("x")).first()[0]
    return found or "https://example.org/data/"


def refine(t: DataFrame, names: Names = Names()) -> DataFrame:
    base = data_base(t, names)
    steps = (
        lambda g: clean_text(g, names), without_orphans, lambda g: one_address(g, names), lambda g: geometry(g, names), lambda g: compact_main(g, names), lambda g: contacts(g, names),
        lambda g: shared_access(g, names, base), lambda g: parts(g, names), lambda g: tagged_text(g, names), lambda g: described(g, names), lambda g: inverses(g, names),
        lambda g: pruned(g, names), italian_labels, lambda g: retitled(g, names.ontology),
    )
    for step in steps:
        t = cut(step(t))
    return t


def merge_sites(t: DataFrame, via: str, cls: str, renames: dict[str, str] | None = None) -> DataFrame:
    """t with what sites behind via say copied to each of their holders, under new names where renames has one.

    The sites go with all their statements, and with them via, their class, renamed properties and restrictions on these.
    """
    held = cut(t.where((F.col("p") == via) & (F.col("o_kind") == "iri") & ~F.col("s").startswith("_:")).select(F.col("s").alias("e"), F.col("o").alias("s")).distinct())
    new = F.col("p")
    for a, b in (renames or {}).items():
        new = F.when(F.col("p") == a, b).otherwise(new)
    copies = t.where(~F.col("p").isin(TYPE, LABEL, "owl:sameAs")).join(held, "s").select(F.col("e").alias("s"), new.alias("p"), "o", "o_kind", "o_dt", "o_lang")
    gone = held.select("s").union(terms(t, via, cls, *(renames or {})))
    return merged(purged(t.where(F.col("p") != via), gone), copies)


def site_sharing(t: DataFrame, via: str) -> DataFrame:
    """(site, n, first, properties) of nodes behind via: how many hold each, the smallest holder, and how many properties it has."""
    held = t.where((F.col("p") == via) & (F.col("o_kind") == "iri")).groupBy(F.col("o").alias("site")).agg(F.countDistinct("s").alias("n"), F.min("s").alias("first"))
    said = t.where(~F.col("p").isin(TYPE, LABEL, "owl:sameAs")).groupBy(F.col("s").alias("site")).agg(F.countDistinct("p").alias("properties"))
    return held.join(said, "site", "left").select("site", "n", "first", F.coalesce("properties", F.lit(0)).alias("properties"))


def flatten(t: DataFrame, via: str, cls: str, properties: list[str]) -> DataFrame:
    """e -via-> n -sub-> v becomes e -sub-> v for members n of cls, which go with via, cls and restrictions on them.

    Each property's domain becomes the commonest class of those that have it then; ties go to the smaller name.
    """
    nodes = cut(members(t, cls))
    hop = t.where(F.col("p") == via).select(F.col("s").alias("e"), F.col("o").alias("s")).join(nodes, "s", "left_semi")
    lifted = t.where(F.col("p").isin(properties)).join(hop, "s").select(F.col("e").alias("s"), "p", "o", "o_kind", "o_dt", "o_lang")
    out = cut(merged(purged(t.where(F.col("p") != via), nodes.union(terms(t, via, cls))), lifted))
    ty = out.where((F.col("p") == TYPE) & ~F.col("o").startswith("owl:")).select("s", F.col("o").alias("cls"))
    best = out.where(F.col("p").isin(properties)).join(ty, "s").groupBy("p", "cls").agg(F.countDistinct("s").alias("n")).groupBy("p").agg(F.min(F.struct(-F.col("n"), F.col("cls"))).getField("cls").alias("cls"))
    best = cut(best)
    old = best.select(F.col("p").alias("s"), F.lit("rdfs:domain").alias("p"))
    return merged(out.join(old, ["s", "p"], "left_anti").select(COLUMNS), rows(best, F.col("p"), "rdfs:domain", F.col("cls")))
