"""mmCIF files as tables: ``raw`` rows of all categories, typed tables, diagnostics.

A file is tokenised once, on the executor that reads it; everything after that is projections and joins over rows. Files are the unit
of parallelism (``binaryFile``), and a malformed one becomes a diagnostic instead of failing the job.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions import scalars as S
from residua.operators.metadata import category, item

#: Categories that typed tables hold already and ``raw`` leaves out.
BULK = ("_atom_site", "_atom_site_anisou")
#: An optional category is read where it has all of these items, and is as good as absent elsewhere.
NEEDED = {
    "_entity": ["id", "pdbx_description", "formula_weight", "src_method"],
    "_entity_poly": ["entity_id", "type", "pdbx_seq_one_letter_code", "pdbx_seq_one_letter_code_can", "pdbx_strand_id"],
    "_struct_conn": ["id", "conn_type_id", *[f"ptnr{k}_{x}" for k in (1, 2) for x in ("label_asym_id", "label_comp_id", "label_seq_id", "label_atom_id", "auth_asym_id", "auth_seq_id", "PDB_ins_code", "symmetry")], "pdbx_dist_value", "details"],
    "_pdbx_struct_assembly": ["id", "details", "method_details", "oligomeric_details", "oligomeric_count"],
    "_struct_conf": ["id", "conf_type_id", *[f"{e}_{x}" for e in ("beg", "end") for x in ("label_asym_id", "label_seq_id", "auth_asym_id", "auth_seq_id")]],
    "_struct_sheet_range": ["sheet_id", "id", *[f"{e}_{x}" for e in ("beg", "end") for x in ("label_asym_id", "label_seq_id", "auth_asym_id", "auth_seq_id")]],
}
#: Items of an atom that the typed table has, each a field of ``site``, with NULL for the tokens . and ?; ``cols`` has the others.
SITE = ("id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "auth_seq_id", "auth_comp_id", "auth_asym_id", "auth_atom_id", "pdbx_PDB_model_num")
#: Rows of a batch from Python to Spark.
BATCH = 5000
_TOKEN = re.compile(r"""^;(?P<text>.*?)\n;(?=\s|\Z)|'(?P<one>(?:[^'\n]|'(?=\S))*)'(?=\s|\Z)|"(?P<two>(?:[^"\n]|"(?=\S))*)"(?=\s|\Z)|\#[^\n]*|(?P<bare>[^\s]+)""", re.M | re.S)
_MARK = re.compile(r"""(?<!\S)['"\#]|^;""", re.M)
_MARKS = ("'", '"', "#", ";")
_FIRST = frozenset("_lLdDsS")
_WORD = re.compile(r"(?i)_|loop_|data_|save_|stop_")


class CifError(ValueError):
    """The text isn't a CIF file with one block."""


def tokens(text: str, raw_tokens: bool = False) -> tuple[list[str], set[int]]:
    """(values, places of the quoted ones): quotes, text fields and comments are resolved. What is between them is split at white space."""
    if not any(m in text for m in _MARKS):
        return text.split(), set()
    out: list[str] = []
    quoted: set[int] = set()
    at = 0
    while mark := _MARK.search(text, at):
        out += text[at : mark.start()].split()
        m = _TOKEN.match(text, mark.start())
        kind = m.lastgroup
        if kind:
            if kind != "bare":
                quoted.add(len(out))
            out.append(f"'{m[kind]}'" if raw_tokens and kind != "bare" else m[kind])
        at = m.end()
    return out + text[at:].split(), quoted


def blocks(text: str, raw_tokens: bool = False) -> tuple[str, list[tuple[str, list[str], list[str]]]]:
    """(block name, categories): a category is (name, its items, values row by row). A loop's rows are its category's; single items make one row, the
    first of a name wins; a category that is looped again is what its last loop says. ``raw_tokens`` keeps quotes around quoted values.
    """
    if not text.strip():
        raise CifError("EMPTY_CONTENT")
    values, quoted = tokens(text, raw_tokens)
    n = len(values)
    words = [i for i, v in enumerate(values) if v[:1] in _FIRST and _WORD.match(v) and i not in quoted]
    ends = iter([*words, n])
    end = next(ends)
    name = None
    loops: dict[str, tuple[list[str], list[str]]] = {}
    single: dict[str, dict[str, str]] = {}
    i = 0
    while i < n:
        v = values[i]
        low = v[:5].lower() if i not in quoted else ""
        if low == "data_":
            if name is not None:
                raise CifError("more than one block")
            name, i = v[5:], i + 1
        elif low == "loop_" and len(v) == 5:
            i += 1
            first = i
            while i < n and values[i][:1] == "_" and i not in quoted:
                i += 1
            tags, first = values[first:i], i
            while end < i:
                end = next(ends)
            i = end
            if not tags or (i - first) % len(tags):
                raise CifError(f"a loop of {len(tags)} items has {i - first} values")
            loops[tags[0].partition(".")[0]] = [t.partition(".")[2] or t for t in tags], values[first:i]
        elif low[:1] == "_":
            if i + 1 == n or values[i + 1][:1] == "_" and i + 1 not in quoted:
                raise CifError(f"{v} has no value")
            cat, _, key = v.partition(".")
            single.setdefault(cat, {}).setdefault(key or v, values[i + 1])
            i += 2
        elif low == "save_":
            raise CifError("save frames aren't read")
        else:
            raise CifError(f"unexpected value {v[:40]!r}")
    if name is None:
        raise CifError("no data block")
    return name, [(cat, *t) for cat, t in loops.items()] + [(cat, list(r), list(r.values())) for cat, r in single.items() if cat not in loops]


def parse(text: str, raw_tokens: bool = False) -> tuple[str, list[tuple[str, int, dict[str, str]]]]:
    """(block name, rows) of ``blocks``: a row is (category, place, items)."""
    name, all_ = blocks(text, raw_tokens)
    return name, [(cat, k, dict(zip(keys, values[i : i + len(keys)], strict=True))) for cat, keys, values in all_ for k, i in enumerate(range(0, len(values), len(keys)))]


class _Rows:
    """Rows of many files, column by column, until they make a batch."""

    def __init__(self) -> None:
        self.head: list[list] = [[], [], [], [], [], []]
        self.ends: list[int | None] = []
        self.keys: list[str] = []
        self.values: list[str] = []
        self.site: list[list[str | None]] = [[] for _ in SITE]

    def add(self, n: int, path: str, entry: str, cat: str | None, first: int | None, code: str | None = None, message: str | None = None) -> None:
        for c, v in zip(self.head, (path, entry, cat, None, code, message), strict=True):
            c += [v] * n
        if first is not None:
            self.head[3][-n:] = range(first, first + n)

    def category(self, path: str, entry: str, cat: str, keys: list[str], values: list[str]) -> Iterator[pa.RecordBatch]:
        width = len(keys)
        place = {k: j for j, k in enumerate(keys)}
        taken = [place.pop(k, None) if cat == "_atom_site" else None for k in SITE]
        for first in range(0, len(values) // width, BATCH):
            some = values[first * width : (first + BATCH) * width]
            n = len(some) // width
            self.add(n, path, entry, cat, first)
            for c, j in zip(self.site, taken, strict=True):
                c += [None] * n if j is None else some[j::width]
            if place:
                at = len(self.keys)
                self.ends += range(at, at + n * len(place), len(place))
                self.keys += list(place) * n
                self.values += some if len(place) == width else [some[i + j] for i in range(0, len(some), width) for j in place.values()]
            else:
                self.ends += [None] * n
            if len(self.ends) >= BATCH:
                yield self.batch()

    def failed(self, path: str, entry: str, code: str, message: str) -> None:
        self.add(1, path, entry, None, None, code, message)
        self.ends.append(None)
        for c in self.site:
            c.append(None)

    def batch(self) -> pa.RecordBatch:
        text = pa.string()
        path, entry, cat, order, code, message = self.head
        cols = pa.MapArray.from_arrays(pa.array([*self.ends, len(self.keys)], pa.int32()), pa.array(self.keys, text), pa.array(self.values, text))
        plain = [pa.array(c, text) for c in self.site]
        site = pa.StructArray.from_arrays([pc.if_else(pc.is_in(c, pa.array([".", "?"])), None, c) for c in plain], names=list(SITE))
        arrays = [pa.array(path, text), pa.array(entry, text), pa.array(cat, text), pa.array(order, pa.int32()), cols, pa.array(code, text), pa.array(message, text), site]
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, names=["path", "entry_id", "category", "row_ord", "cols", "code", "message", "site"])


def read_rows(files: DataFrame, raw_tokens: bool = False) -> DataFrame:
    """(path, content) -> (path, entry_id, category, row_ord, cols, code, message, site); a failed file, or one without atoms, has one row with a code and no category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stem = re.sub(r"(\.cif)?(\.gz)?$", "", path.rsplit("/", 1)[-1])
                try:
                    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                    name, all_ = blocks(data.decode("utf-8"), raw_tokens)
                except (CifError, UnicodeDecodeError, OSError, EOFError) as e:
                    code = "EMPTY_CONTENT" if str(e) == "EMPTY_CONTENT" else "CIF_PARSE_ERROR" if isinstance(e, CifError) else "PARSE_ERROR"
                    rows.failed(path, stem, code, str(e)[:500])
                else:
                    if any(c == "_atom_site" and values for c, _, values in all_):
                        for cat, keys, values in all_:
                            yield from rows.category(path, name or stem, cat, keys, values)
                    else:
                        rows.failed(path, name or stem, "NO_MODEL", "the structure contains no models")
                if len(rows.ends) >= BATCH:
                    yield rows.batch()
        if rows.ends:
            yield rows.batch()

    site = ",".join(f"{c}:string" for c in SITE)
    return files.select("path", "content").mapInArrow(run, f"path string, entry_id string, category string, row_ord int, cols map<string,string>, code string, message string, site struct<{site}>")


def read(spark: SparkSession, path: str | list[str], model_num: int = 1, raw_tokens: bool = False) -> dict[str, DataFrame]:
    """All tables of the files under ``path`` (Spark lists no files of 0 bytes): entries, entities, asym_units, atoms, connections, assemblies, conf_records, sheet_strands, raw, diagnostics, status."""
    return tables(read_rows(spark.read.format("binaryFile").load(path), raw_tokens), model_num)


def has_all(rows: DataFrame, cat: str) -> DataFrame:
    """Rows of a category of entries in which every needed item of it occurs."""
    names = NEEDED[cat]
    t = rows.filter(F.col("category") == cat)
    ok = t.groupBy("entry_id").agg(F.array_distinct(F.flatten(F.collect_set(F.map_keys("cols")))).alias("k")).filter(F.size(F.array_intersect("k", F.array(*[F.lit(x) for x in names]))) == len(names))
    return t.join(ok.select("entry_id"), "entry_id", "left_semi")


def _val(name: str) -> Column:
    return S.null_token(item(name))


def _int(name: str) -> Column:
    v = _val(name)
    return F.when(v.rlike("^[+-]?[0-9]+$"), v.try_cast("int"))


def _num(name: str) -> Column:
    return S.as_float(_val(name))


def _blank(c: Column) -> Column:
    return F.when(~c.isin("", " ", "\x00"), c)


def _partner(k: int) -> Column:
    p = f"ptnr{k}_"
    return F.struct(F.coalesce(_val(p + "label_asym_id"), F.lit("")).alias("label_asym_id"), F.coalesce(_val(p + "label_comp_id"), F.lit("")).alias("label_comp_id"), _int(p + "label_seq_id").alias("label_seq_id"), _val(p + "label_atom_id").alias("label_atom_id"), _val(p + "auth_asym_id").alias("auth_asym_id"), _val(p + "auth_seq_id").alias("auth_seq_id"), _val(p + "PDB_ins_code").alias("ins_code"), _val(p + "symmetry").alias("symmetry"))


def _range(extra: list[Column]) -> list[Column]:
    out = ["entry_id", F.col("row_ord").alias("ord"), *extra]
    for p in ("beg", "end"):
        out += [F.coalesce(_val(f"{p}_label_asym_id"), F.lit("")).alias(f"{p}_label_asym_id"), _int(f"{p}_label_seq_id").alias(f"{p}_label_seq_id"), _val(f"{p}_auth_asym_id").alias(f"{p}_auth_asym_id"), _val(f"{p}_auth_seq_id").alias(f"{p}_auth_seq_id")]
    return out


def tables(rows: DataFrame, model_num: int = 1) -> dict[str, DataFrame]:
    """Typed tables from ``read_rows``. Persist or write ``rows`` first where several of them are used."""
    good = rows.filter("code is null")
    failed = rows.filter("code is not null").select("entry_id", F.lit("parsing").alias("stage"), "code", F.lit("error").alias("severity"), "message")
    ids = good.select("entry_id").distinct()
    title = category(good, "_struct").groupBy("entry_id").agg(F.min_by(S.clean(item("title")), "row_ord").alias("title"))
    entries = ids.join(title, "entry_id", "left")

    ent = category(good, "_entity").withColumn("id", item("id"))
    ent = ent.groupBy("entry_id", "id").agg(F.max_by("cols", "row_ord").alias("cols"), F.min("row_ord").alias("row_ord"))
    poly = has_all(good, "_entity_poly").withColumn("id", item("entity_id")).groupBy("entry_id", "id").agg(F.max_by("cols", "row_ord").alias("p"))
    pv = lambda c: S.null_token(item(c, "p"))
    described = has_all(good, "_entity").select("entry_id").distinct().withColumn("_d", F.lit(True))
    told = lambda c: F.when(F.col("_d"), c)
    entities = ent.join(described, "entry_id", "left").join(poly, ["entry_id", "id"], "left").select("entry_id", F.row_number().over(Window.partitionBy("entry_id").orderBy("row_ord")).alias("entity_ord"), "id", F.coalesce(_val("type"), F.lit("non-polymer")).alias("type"), told(_val("pdbx_description")).alias("pdbx_description"), told(_num("formula_weight")).alias("formula_weight"), told(_val("src_method")).alias("src_method"), F.when(F.col("p").isNotNull(), F.struct(pv("type").alias("type"), S.clean_sequence(pv("pdbx_seq_one_letter_code")).alias("seq"), S.clean_sequence(pv("pdbx_seq_one_letter_code_can")).alias("seq_can"), pv("pdbx_strand_id").alias("strand_id"))).alias("poly"))
    entities = entities.withColumn("seq_can", F.coalesce("poly.seq_can", "poly.seq"))

    # Atoms are moved once, by entry, as typed columns and not as maps; model, place and kind are found where they then are. Each item is named
    # once in an expression: code that repeats them outgrows what the JVM compiles (8000 bytes a method) and is interpreted.
    site = good.filter(F.col("category") == "_atom_site").select("entry_id", "row_ord", "site.*")
    whole_number = lambda c, t: F.regexp_extract(c, r"^([+-]?[0-9]+)(?:\r\n|\n|\r)?\z", 1).try_cast(t)
    number = lambda c: F.regexp_extract(c, rf"^[{S.SPACE}]*({S.NUMBER})[{S.SPACE}]*\z", 1).try_cast("double")
    auth = F.coalesce("auth_seq_id", "label_seq_id")
    site = site.select(
        "entry_id",
        "row_ord",
        F.coalesce(whole_number("pdbx_PDB_model_num", "int"), F.lit(1)).alias("model_num"),
        whole_number("id", "int").cast("bigint").alias("id"),
        "type_symbol",
        "label_atom_id",
        "label_alt_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("label_comp_id", "label_asym_id", "label_entity_id")],
        auth.alias("_auth"),
        F.col("pdbx_PDB_ins_code").alias("ins_code"),
        *[number(c).alias(to) for c, to in (("Cartn_x", "x"), ("Cartn_y", "y"), ("Cartn_z", "z"), ("occupancy", "occupancy"), ("B_iso_or_equiv", "b_iso"))],
        "auth_comp_id",
        "auth_asym_id",
        "auth_atom_id",
    )
    chosen = site.groupBy("entry_id").agg(F.bool_or(F.col("model_num") == model_num).alias("has"))
    no_model = chosen.filter(~F.col("has")).select("entry_id", F.lit("parsing").alias("stage"), F.lit("MODEL_NOT_FOUND").alias("code"), F.lit("warning").alias("severity"), F.lit(f"model {model_num} isn't there").alias("message"))
    ordered = Window.partitionBy("entry_id").orderBy("row_ord")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    site = site.withColumns({"_has": F.max(F.col("model_num") == model_num).over(whole), "_first": F.first("model_num").over(whole)})
    site = site.filter(F.col("model_num") == F.when(F.col("_has"), F.lit(model_num)).otherwise(F.col("_first"))).withColumn("atom_ord", F.row_number().over(ordered).cast("bigint"))
    kinds = category(good, "_entity").select("entry_id", item("id").alias("id"), "row_ord", _val("type").alias("type")).filter("id is not null").repartition("entry_id")
    kinds = kinds.groupBy("entry_id", "id").agg(F.max_by(F.struct("type"), "row_ord")["type"].alias("type"))
    kinds = kinds.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.coalesce("type", F.lit("non-polymer"))))).alias("_kinds"))
    ins = _blank(F.col("ins_code"))
    atoms = site.join(kinds, "entry_id", "left").withColumn("_polymer", F.coalesce(F.try_element_at("_kinds", "label_entity_id") == "polymer", F.lit(False))).select(
        "entry_id",
        "atom_ord",
        F.when(F.col("_polymer"), "ATOM").otherwise("HETATM").alias("group_pdb"),
        "id",
        "type_symbol",
        "label_atom_id",
        _blank(F.col("label_alt_id")).alias("label_alt_id"),
        "label_comp_id",
        "label_asym_id",
        "label_entity_id",
        F.when(F.col("_polymer"), F.col("_auth").try_cast("int")).alias("label_seq_id"),
        ins.alias("ins_code"),
        "x",
        "y",
        "z",
        "occupancy",
        "b_iso",
        F.concat("_auth", F.coalesce(ins, F.lit(""))).alias("auth_seq_id"),
        "auth_comp_id",
        "auth_asym_id",
        "auth_atom_id",
        "model_num",
    )
    atoms = atoms.withColumn("id", F.when(F.col("id") > 0, F.col("id")).otherwise(F.col("atom_ord")))
    asym = atoms.groupBy("entry_id", F.col("label_asym_id").alias("id")).agg(F.min_by("label_entity_id", "atom_ord").alias("entity_id"), F.min_by("auth_asym_id", "atom_ord").alias("auth_id"), F.min("atom_ord").alias("_f"))
    asym = asym.join(entities.select("entry_id", F.col("id").alias("entity_id"), "entity_ord"), ["entry_id", "entity_id"], "left")
    asym = asym.withColumn("asym_ord", F.row_number().over(Window.partitionBy("entry_id").orderBy(F.col("entity_ord").asc_nulls_last(), "_f"))).select("entry_id", "asym_ord", "id", "entity_id", "auth_id")

    conn = has_all(good, "_struct_conn").select("entry_id", F.col("row_ord").alias("conn_ord"), item("id").alias("id"), F.coalesce(_val("conn_type_id"), F.lit("covale")).alias("conn_type_id"), _partner(1).alias("ptnr1"), _partner(2).alias("ptnr2"), _num("pdbx_dist_value").alias("dist"), _val("details").alias("details"))
    conf = has_all(good, "_struct_conf").select(*_range([item("id").alias("id"), F.coalesce(_val("conf_type_id"), F.lit("")).alias("conf_type_id")]))
    strands = has_all(good, "_struct_sheet_range").select(*_range([item("sheet_id").alias("sheet_id"), item("id").alias("id")]))

    gen = category(good, "_pdbx_struct_assembly_gen").select("entry_id", "row_ord", item("assembly_id").alias("id"), F.struct(item("assembly_id").alias("assembly_id"), F.array_join(operators(item("oper_expression")), ",").alias("oper_expression"), F.split(F.regexp_replace(item("asym_id_list"), r"\s", ""), ",").alias("asym_id_list")).alias("g"), operators(item("oper_expression")).alias("names"))
    m = F.array(*[F.array(*[_num(f"matrix[{i}][{j}]") for j in (1, 2, 3)]) for i in (1, 2, 3)])
    oper = category(good, "_pdbx_struct_oper_list").select("entry_id", item("id").alias("name"), F.struct(item("id").alias("id"), _val("type").alias("type"), m.alias("matrix"), F.array(*[_num(f"vector[{i}]") for i in (1, 2, 3)]).alias("vector")).alias("op"))
    used = gen.select("entry_id", "id", "row_ord", F.posexplode("names").alias("at", "name")).groupBy("entry_id", "id", "name").agg(F.min(F.struct("row_ord", "at")).alias("o")).join(oper, ["entry_id", "name"])
    used = used.groupBy("entry_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "op"))), lambda x: x["op"]).alias("operators"))
    gens = gen.groupBy("entry_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "g"))), lambda x: x["g"]).alias("generators"))
    reported = has_all(good, "_pdbx_struct_assembly").select("entry_id").distinct().withColumn("_d", F.lit(True))
    asm = category(good, "_pdbx_struct_assembly").join(reported, "entry_id", "left").select("entry_id", F.col("row_ord").alias("assembly_ord"), item("id").alias("id"), told(_val("details")).alias("details"), told(_val("method_details")).alias("method_details"), told(_val("oligomeric_details")).alias("oligomeric_details"), told(_int("oligomeric_count")).alias("oligomeric_count"))
    assemblies = asm.join(gens, ["entry_id", "id"], "left").join(used, ["entry_id", "id"], "left")

    notes = failed.unionByName(no_model)
    status = rows.select("entry_id").distinct().join(notes.groupBy("entry_id").agg(F.max(F.when(F.col("severity") == "error", 2).otherwise(1)).alias("s")), "entry_id", "left")
    status = status.select("entry_id", F.when(F.col("s") == 2, "failed").when(F.col("s") == 1, "warning").otherwise("success").alias("status"))
    return {"entries": entries, "entities": entities, "asym_units": asym, "atoms": atoms, "connections": conn, "assemblies": assemblies, "conf_records": conf, "sheet_strands": strands, "raw": good.filter(~F.col("category").isin(*BULK)).select("entry_id", "category", "row_ord", "cols"), "diagnostics": notes, "status": status}


def operators(expression: Column) -> Column:
    """Names in an operator expression such as 1,2 or (1-3) or (1-2)(3,P): ranges count up, products pair their parts in order, joined by x."""
    groups = F.filter(F.split(F.regexp_replace(F.regexp_replace(expression, r"\s", ""), r"\)\(", "|"), r"\|"), lambda g: g != "")

    def names(g: Column) -> Column:
        parts = F.split(F.regexp_replace(g, r"[()]", ""), ",")
        ranged = lambda p: F.when(p.rlike("^[0-9]+-[0-9]+$"), F.transform(F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(p, F.lit("-"), F.lit(2)).try_cast("int")), lambda i: i.cast("string"))).otherwise(F.array(p))
        return F.flatten(F.transform(parts, ranged))

    start = F.array(F.lit("").cast("string"))
    pair = lambda acc, g: F.flatten(F.transform(acc, lambda a: F.transform(names(g), lambda b: F.when(a == "", b).otherwise(F.concat(a, F.lit("x"), b)))))
    return F.aggregate(groups, start, pair)
