"""Column functions on RDF terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlake.vocab import BNODE, IRI, LANG_STRING, UNDEF_PREFIX, XSD_STRING

# Separates the parts of a key; U+001F cannot occur in RDF text formats unescaped.
_UNIT = chr(31)
_NULL = chr(30)

# Characters that an IRI reference may not hold as such, with all up to the space.
_IRI_ESCAPES = {c: f"\\u{ord(c):04X}" for c in '\\<>"{}|^`' + "".join(map(chr, range(0x21)))}
# Characters that a quoted literal escapes.
_LITERAL_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
# Short escapes of the line formats.
_UNESCAPES = {
    "\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f",
    '\\"': '"', "\\'": "'", "\\\\": "\\",
}


def _replace_all(col: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def key_hash(*parts: Column | str) -> Column:
    """SHA-256 over the parts, NULL kept apart from the empty text."""
    cols = [F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit(_NULL)) for p in parts]
    return F.sha2(F.concat_ws(_UNIT, *cols), 256)


def mint(prefix: str, *parts: Column | str) -> Column:
    """An IRI that depends on its parts only, so a rerun mints the same one."""
    return F.concat(F.lit(prefix), key_hash(*parts))


def packed(iri: Column) -> Column:
    """An IRI with the digits that a minted one ends in as bytes, for keys that are moved; any other as it is."""
    tail = F.right(iri, F.lit(64))
    minted = (F.octet_length(tail) == 64) & F.unhex(tail).isNotNull() & (tail == F.lower(tail))
    return F.struct(
        F.when(minted, F.substr(iri, F.lit(1), F.length(iri) - 64)).otherwise(iri).alias("start"),
        F.when(minted, F.unhex(tail)).alias("digits"))


def unpacked(key: Column) -> Column:
    return F.concat(key["start"], F.coalesce(F.lower(F.hex(key["digits"])), F.lit("")))


def escape_iri(col: Column) -> Column:
    unsafe = col.rlike(r'[\x00-\x20<>"{}|^`\\]')
    return F.when(unsafe, _replace_all(col, _IRI_ESCAPES)).otherwise(col)


def escape_literal(col: Column) -> Column:
    return _replace_all(col, _LITERAL_ESCAPES)


def n3(value: Column, kind: Column, dt: Column, lang: Column) -> Column:
    """A term in N-Triples notation."""
    quoted = F.concat(F.lit('"'), escape_literal(value), F.lit('"'))
    return (
        F.when(kind == IRI, F.concat(F.lit("<"), escape_iri(value), F.lit(">")))
        .when(kind == BNODE, F.concat(F.lit("_:"), value))
        .when(lang != "", F.concat(quoted, F.lit("@"), lang))
        .when(dt.isin("", XSD_STRING, LANG_STRING), quoted)
        .otherwise(F.concat(quoted, F.lit("^^<"), escape_iri(dt), F.lit(">")))
    )


def unescape(col: Column) -> Column:
    """Undo the escapes of N-Triples text: short ones, \\uXXXX and \\UXXXXXXXX."""
    tokens = F.regexp_extract_all(
        col, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]++)"), 1
    )

    def one(token: Column) -> Column:
        code = F.substring(token, 3, 8)
        decoded = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        result = F.when(token.rlike(r"^\\[uU]"), decoded)
        for escaped, plain in _UNESCAPES.items():
            result = result.when(token == escaped, F.lit(plain))
        return result.otherwise(token)

    return F.when(F.contains(col, F.lit("\\")), F.concat_ws("", F.transform(tokens, one))).otherwise(col)


def kind_rank(kind: Column) -> Column:
    """Order of term kinds: blank nodes, IRIs, literals."""
    return F.when(kind == BNODE, 1).when(kind == IRI, 2).otherwise(3)


def skolem(value: Column, kind: Column, base: str) -> Column:
    return F.when(kind == BNODE, F.concat(F.lit(base), value)).otherwise(value)


def or_undef(col: Column, variable: str) -> Column:
    return F.coalesce(col, F.lit(UNDEF_PREFIX + variable))


def headers_map(text: Column) -> Column:
    """A JSON object of strings as a map; NULL for anything else."""
    values = F.map_values(F.from_json(text, "map<string,variant>"))
    strings = F.forall(values, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.when(strings, F.from_json(text, "map<string,string>"))
