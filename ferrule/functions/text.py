"""Column functions over text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def tokens(text) -> Column:
    """Lower-cased words of two characters or more."""
    words = F.split(F.regexp_replace(F.lower(_c(text)), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.filter(words, lambda t: F.length(t) > 1)


def truncated(text, n: int, tail: str = "...") -> Column:
    x = _c(text)
    return x if n <= 0 else F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - len(tail)), F.lit(tail))).otherwise(x)


def source_prefix(source_id, index_source) -> Column:
    raw = F.coalesce(F.nullif(_c(source_id), F.lit("")), F.nullif(_c(index_source), F.lit("")), F.lit("main"))
    return F.substring(F.regexp_replace(F.regexp_replace(raw, r"(?U)[^\w\-]+", "_"), "^_+|_+$", ""), 1, 64)


def relevance(distance) -> Column:
    return F.round(1 - _c(distance), 3)


def strip_html(html) -> Column:
    x = _c(html)
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<[^>]+>"):
        x = F.regexp_replace(x, pattern, " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def unique_texts(values, limit: int, shortest: int = 2) -> Column:
    """First occurrences, white space squeezed, in order."""
    squeezed = F.transform(_c(values), lambda v: F.trim(F.regexp_replace(v, r"(?U)\s+", " ")))
    return F.slice(F.array_distinct(F.filter(squeezed, lambda v: F.length(v) >= shortest)), 1, limit)


def plain_xml_text(values) -> Column:
    return F.array_join(unique_texts(values, 400), "\n")


def csv_list(text) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def line_content(text, n: int = 200) -> Column:
    return F.substring(F.regexp_replace(_c(text), r"^\s+|\s+$", ""), 1, n)


def with_eos(text, eos: str) -> Column:
    return F.when(_c(text).endswith(eos), _c(text)).otherwise(F.concat(_c(text), F.lit(eos)))


def identifier(raw) -> Column:
    """Object identifier in any of its spellings: struct object_type, object_name, node_id."""
    x = F.trim(_c(raw))
    colon, dot = F.split(x, ":", 3), F.split(x, r"\.", 2)
    by_id = (F.size(colon) == 3) & (colon[0] == "metadata")
    name = F.when(by_id, colon[2]).when(F.size(dot) == 2, dot[1]).otherwise(x)
    kind = F.when(by_id, colon[1]).when(F.size(dot) == 2, dot[0])
    node = F.when(by_id, x).when(F.size(dot) == 2, F.concat(F.lit("metadata:"), dot[0], F.lit(":"), dot[1]))
    return F.struct(kind.alias("object_type"), F.when(x == "", F.raise_error(F.lit("blank object identifier"))).otherwise(name).alias("object_name"), node.alias("node_id"))


def path_parts(relative) -> Column:
    """Struct object_type, object_name, module_name of a path below the root."""
    parts = F.split(_c(relative), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    several = F.size(parts) > 1
    return F.struct(
        F.when(several, parts[0]).otherwise(F.lit("Unknown")).alias("object_type"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(stem).alias("object_name"), stem.alias("module_name")
    )


def code_references(code) -> Column:
    """Distinct (object type, object name) of collection accesses in code, in order of first sight."""
    names = "|".join(sorted(K.COLLECTIONS, key=len, reverse=True))
    pattern = rf"(?iuU)\b({names})\.(\w+)"
    known = literal_map({k.lower(): v for k, v in K.COLLECTIONS.items()})
    first = F.regexp_extract_all(_c(code), F.lit(pattern), F.lit(1))
    second = F.regexp_extract_all(_c(code), F.lit(pattern), F.lit(2))
    return F.array_distinct(F.transform(F.arrays_zip(first.alias("t"), second.alias("n")), lambda p: F.struct(F.element_at(known, F.lower(p["t"])).alias("ref_type"), p["n"].alias("ref_name"))))


def rights_target(reference) -> Column:
    """Struct object_type, object_name; null type for prefixes that are unknown."""
    parts = F.split(_c(reference), r"\.")
    return F.struct(F.try_element_at(literal_map(K.RIGHTS_PREFIXES), parts[0]).alias("object_type"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("object_name"))


def template_kind(head, root_tag, declared) -> Column:
    h, root, d = F.lower(F.substring(_c(head), 1, 8000)), F.lower(_c(root_tag)), F.lower(F.replace(F.coalesce(_c(declared), F.lit("")), F.lit(" "), F.lit("")))
    out = F.element_at(literal_map({k.lower(): k for k in K.TEMPLATE_KINDS}), F.when(d.isin([k.lower() for k in K.TEMPLATE_KINDS]), d))
    rules = [
        ("DataCompositionSchema", h.contains("datacompositionschema") | h.contains("data-composition-system")),
        ("SpreadsheetDocument", h.contains("spreadsheet") | (root == "document")),
        ("HTMLDocument", h.contains("<html") | h.contains("htmldocument") | h.contains("text/html")),
        ("GeographicalSchema", h.contains("geographicalschema")), ("GraphicalSchema", h.contains("graphicalschema")), ("ActiveDocument", h.contains("activedocument")),
    ]
    return F.coalesce(out, *[F.when(rule, F.lit(kind)) for kind, rule in rules], F.lit("Template"))


def wants_graph(question) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in K.INTENT_MARKERS]), lambda m: F.contains(F.lower(_c(question)), m))


def usage_pattern(name: str) -> str:
    """A whole-word, case-blind pattern for a literal name (Java)."""
    return r"(?iuU)\b\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E\b"


def distance(a, b, metric: str = "cosine") -> Column:
    """Distance of two float arrays, in doubles. Unknown metrics count as cosine."""
    x, y = _c(a).cast("array<double>"), _c(b).cast("array<double>")

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    if metric == "l2":
        return F.sqrt(total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    if metric == "l1":
        return total(F.zip_with(x, y, lambda p, q: F.abs(p - q)))
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    return 1 - F.try_divide(dot, F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p))))


def toy_embedding(text, dim: int = 16) -> Column:
    """The offline embedder: each character adds to the component of its place; component 0 gains 1."""
    codes = F.transform(F.split(F.coalesce(_c(text), F.lit("")), ""), lambda c: F.when(c == "", 0.0).otherwise((F.ascii(c) % 17) / 17))

    def sums(v):  # v stands for the codes, which are made once
        def total(k):
            places = F.sequence(k, F.size(v) - 1, F.lit(dim))  # each character is met once
            return F.when(F.size(v) > k, F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get(v, i))).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (total(k) + F.when(k == 0, 1.0).otherwise(0.0)).cast("float"))

    return F.get(F.transform(F.array(codes), sums), F.lit(0))


def jaccard(a, b) -> Column:
    x, y = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
