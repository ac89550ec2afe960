"""Column functions. All stay inside the JVM; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that counts when values are cleaned.
SPACE = " \t\n\r\f\x0b"
#: A plain number.
NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def null_token(c: Column) -> Column:
    """NULL for the tokens . and ?, else the value untouched."""
    return F.when(~c.isin(".", "?"), c)


def clean(c: Column) -> Column:
    """Trimmed value; NULL where nothing, . or ? is left."""
    t = F.btrim(c, F.lit(SPACE))
    return F.when(~t.isin("", ".", "?"), t)


def as_int(c: Column) -> Column:
    """Integer of the cleaned value, NULL where it isn't one ('12.5' is not)."""
    t = clean(c)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint"))


def as_float(c: Column) -> Column:
    """Double of the cleaned value, NULL where it isn't a plain number (suffixes such as 1.5d aren't)."""
    t = clean(c)
    return F.when(t.rlike(f"^{NUMBER}$"), t.try_cast("double"))


def first_value(*cs: Column) -> Column:
    """First cleaned value that isn't NULL."""
    return F.coalesce(*[clean(c) for c in cs])


def clean_sequence(c: Column) -> Column:
    """Cleaned value without white space inside."""
    return F.regexp_replace(clean(c), r"\s+", "")


def category_name(c: Column) -> Column:
    """Category with its leading underscore."""
    return F.when(c.startswith("_"), c).otherwise(F.concat(F.lit("_"), c))


def provenance(category: Column, source_id: Column) -> Column:
    return F.struct(category.alias("category"), source_id.alias("source_id"))


def entity_sequence(canonical: Column, one_letter: Column) -> Column:
    """Upper-case sequence, the canonical one where it isn't empty; NULL if none is left."""
    s = F.upper(clean_sequence(F.coalesce(F.when(canonical != "", canonical), one_letter)))
    return F.when(s != "", s)


def author_number(auth: Column, label: Column) -> Column:
    """Digits and minus signs of the author's number as an integer, else the label's number."""
    return F.coalesce(F.regexp_replace(auth, "[^0-9-]", "").try_cast("int"), label)


def chain_label(n: Column) -> Column:
    """1 -> A ... 26 -> Z, 27 -> AA ... 702 -> ZZ; beyond, the query fails."""
    two = n - 27
    pair = F.concat(F.char(F.floor(two / 26) + 65), F.char(two % 26 + 65))
    return F.when(n <= 26, F.char(n + 64)).when(n <= 702, pair).otherwise(F.raise_error(F.lit("more than 702 chains in an entry")).cast("string"))


def residue_id(asym: Column, seq: Column) -> Column:
    return F.concat_ws(":", asym, seq.cast("string"))


def altloc_residue_id(seq: Column, comp: Column) -> Column:
    """A missing number is written None."""
    return F.concat(F.coalesce(seq.cast("string"), F.lit("None")), F.lit(":"), comp)


def item_id(*parts: Column) -> Column:
    """Key of a dataset item: entry, entry_chain or entry_chain_chain."""
    return F.concat_ws("_", *parts)


def squared_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    (x, y, z), (u, v, w) = a, b
    return (x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w)


def matches(a: Column, b: Column) -> Column:
    """Number of equal letters at equal places."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda m: m))


def ungapped(a: Column, b: Column) -> Column:
    """identity = matches / longer length, aligned = shorter length, coverage = shorter / longer; zeros where one is empty."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    some = shorter > 0
    m = F.when(some, matches(a, b)).otherwise(0)
    return F.struct(
        m.cast("bigint").alias("matches"),
        F.when(some, m / longer).otherwise(F.lit(0.0)).cast("double").alias("identity"),
        F.when(some, shorter).otherwise(0).cast("bigint").alias("aligned"),
        F.when(some, shorter / longer).otherwise(F.lit(0.0)).cast("double").alias("coverage"),
    )


def source_url(entry: Column, provider: str | None = None, source_uri: str | None = None) -> Column:
    """Where an entry is fetched from: ``source_uri``, or the provider's pattern with its case of the identifier."""
    if source_uri:
        return F.lit(source_uri)
    patterns = {"pdbe": ("https://www.ebi.ac.uk/pdbe/entry-files/download/%s_updated.cif", F.lower), "pdb": ("https://files.rcsb.org/download/%s.cif", F.upper)}
    if provider not in patterns:
        raise ValueError(f"unknown provider: {provider}")
    pattern, case = patterns[provider]
    return F.format_string(pattern, case(entry))


def half_even(x: Column) -> Column:
    """Rounds halves to even."""
    return F.bround(x)


def checksum(*lists: Column) -> Column:
    """SHA-256 of the compact JSON of sorted lists."""
    return F.sha2(F.to_json(F.array(*[F.sort_array(x) for x in lists])), 256)
