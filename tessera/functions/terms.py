"""Functions of terms and literals as native columns; clean_literal and repair, which loop, are pandas functions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.vocabulary import PREFIXES
from ..sources.workers import ship

EARTH_KM = 6371.0


def local_name(c: Column) -> Column:
    """After the last # if there is one, else after the last /."""
    return F.when(c.contains("#"), F.element_at(F.split(c, "#"), -1)).otherwise(F.element_at(F.split(c, "/"), -1))


def term_name(c: Column) -> Column:
    """Without trailing / and #, after the last /, then after the last #."""
    return path_name(F.regexp_replace(c, "[/#]+$", ""))


def path_name(c: Column) -> Column:
    """After the last /, then after the last #."""
    return F.element_at(F.split(F.element_at(F.split(c, "/"), -1), "#"), -1)


def plain_name(c: Column) -> Column:
    """The local name of a full IRI or of a prefixed name."""
    return F.element_at(F.split(local_name(c), ":"), -1)


def datatype(dt: Column, lang: Column) -> Column:
    """A literal's datatype: the named one, else rdf:langString with a language, else xsd:string."""
    return F.when(dt != "", dt).when(lang != "", "rdf:langString").otherwise("xsd:string")


def short_id(c: Column) -> Column:
    """Without trailing slashes, after the last /, then after the last #."""
    return F.element_at(F.split(F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1), "#"), -1)


def before(c: Column, mark: str) -> Column:
    """What stands before the first mark; empty if there is none."""
    return F.when(F.instr(c, mark) > 0, F.substring_index(c, mark, 1)).otherwise("")


def after(c: Column, mark: str) -> Column:
    """What follows the first mark; empty if there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + F.lit(len(mark)))).otherwise("")


def wkt_point(c: Column) -> Column:
    """struct(lon, lat) of POINT(lon lat), null for anything else."""
    pattern = r"POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)"
    lon, lat = (F.regexp_extract(c, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def short_label(c: Column, limit: int = 42) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))).otherwise(c)


def readable_label(c: Column) -> Column:
    return F.replace(F.coalesce(F.try_url_decode(local_name(c)), local_name(c)), F.lit("_"), F.lit(" "))


def clean_name(c: Column) -> Column:
    """Up to the first ' - ', ' – ' or ':', without double quotes, straight or curly."""
    return F.trim(F.regexp_replace(F.element_at(F.split(c, "\\s[-–]\\s|:"), 1), '["“”]', ""))


def tokens(c: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^0-9a-zà-ÿ]+"), lambda x: F.length(x) >= least))


def distinctive_tokens(c: Column) -> Column:
    """Tokens of four characters or more that are neither stop words nor names of kinds of places."""
    return F.array_except(tokens(c, 4), F.array(*[F.lit(x) for x in STOP_WORDS + GENERIC_WORDS]))


def is_hash_name(c: Column) -> Column:
    """16 characters or more, nine tenths of them hexadecimal digits, without a first part of up to 8 before _, and without - and _."""
    head = F.substring_index(c, "_", 1)
    rest = F.when(c.contains("_") & (F.length(head) <= 8), F.substr(c, F.length(head) + 2)).otherwise(c)
    body = F.regexp_replace(F.lower(rest), "[-_]", "")
    return (F.length(body) >= 16) & (F.length(F.regexp_replace(body, "[^0-9a-f]", "")) >= F.length(body) * 0.9)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def classify(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose keyword the lower-cased text holds."""
    out = None
    for keyword, name in rules:
        hit = F.lower(c).contains(keyword)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def url_host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def clean_literal(c: Column) -> Column:
    """Doubled quotes made single, white space and semicolons taken off the ends and wrapping quotes taken away, until nothing changes."""
    ship()
    return F.pandas_udf(lambda values: values.map(_unwrapped, na_action="ignore"), "string", F.PandasUDFType.SCALAR)(c)


def _unwrapped(text: str) -> str:
    while True:
        new = text.replace('""', '"').strip().strip(";").strip()
        if len(new) > 1 and new[0] == new[-1] == '"':
            new = new[1:-1].strip()
        if new == text:
            return new
        text = new


def repair(c: Column) -> Column:
    """Text whose UTF-8 bytes were once read as Windows-1252, as it was: up to three times over; characters that were lost go."""
    ship()
    return F.pandas_udf(lambda values: values.map(_repaired, na_action="ignore"), "string", F.PandasUDFType.SCALAR)(c)


#: What wrongly decoded text holds, and a lead byte whose no-break space became a blank.
_MARKERS = ("Ã", "â€", "Â")
_WINDOWS = {bytes([b]).decode("cp1252", "replace"): b for b in range(128, 256) if bytes([b]).decode("cp1252", "replace") != "\ufffd"}


def _repaired(text: str) -> str:
    out = re.sub("([ÂÃ]) ", "\\1\u00a0", text)
    for _ in range(3):
        if not any(m in out for m in _MARKERS):
            break
        codes = [_WINDOWS.get(x, ord(x)) for x in out]
        if max(codes) > 0xFF:
            break  # not from such bytes
        out = bytes(codes).decode("utf-8", "replace")
    return out.replace("\ufffd", "") if out != text else text


def valid_id(c: Column) -> Column:
    """Letters, digits, _ and - alone."""
    return c.rlike("^[A-Za-z0-9_-]+$")


#: Names that only a fault makes, and namespaces that are never pruned.
SPURIOUS = r"(?i)^(error|errore|unknown|undefined)\d*$|^(?i:class|ns|node|bnode)\d+$"
STANDARD = ["owl:", "rdfs:", "rdf:", "xsd:", "skos:", "dc:", "dcterms:"]
#: Words that do not tell one place from another.
STOP_WORDS = ["di", "del", "dei", "della", "delle", "degli", "il", "lo", "la", "le", "i", "gli", "e", "a", "al", "alla", "o", "da", "in", "con", "san", "santa", "santo", "santi", "ss"]
GENERIC_WORDS = [
    "palazzo", "piazza", "piazzale", "via", "viale", "ponte", "chiesa", "cimitero", "forte", "museo", "loggia", "monumento", "monumentale", "murale", "lapide", "casa",
    "baluardo", "complesso", "giardino", "torre", "porta", "villa", "stadio", "stazione", "tabernacolo",
]


def is_spurious(c: Column) -> Column:
    """Whether an IRI outside the standard namespaces has a name that only a fault makes."""
    standard = F.lit(False)
    for p in STANDARD:
        standard = standard | c.startswith(p) | c.startswith(PREFIXES[p[:-1]])
    return ~standard & F.element_at(F.split(term_name(c), ":"), -1).rlike(SPURIOUS)


def allowed_edition(c: Column) -> Column:
    """False for IRIs of another language's edition, as de.wikipedia.org; true for Italian, English and all other hosts."""
    lang = F.regexp_extract(F.lower(F.coalesce(url_host(c), F.lit(""))), r"^([a-z]{2})\.(dbpedia\.org|wikipedia\.org)$", 1)
    return lang.isin("", "it", "en")


def data_namespace(c: Column) -> Column:
    """Up to the last /data/; null if there is none."""
    found = F.regexp_extract(c, "^(.*/data/)", 1)
    return F.when(found != "", found)


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves upwards."""
    return F.floor(F.lit(100.0) * part / whole + 0.5).cast("long")


def confidence_text(c: Column) -> Column:
    """A share as percents with one decimal, as number and sign."""
    return F.concat(F.round(c * 100, 1).cast("string"), F.lit("%"))


def salvaged_json(text: str) -> dict | None:
    """The object in an answer that may stand in a code fence or among other words; None if there is none."""
    body = re.sub(r"```(?:json)?", "", text)
    a, b = body.find("{"), body.rfind("}")
    try:
        out = json.loads(body[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None
