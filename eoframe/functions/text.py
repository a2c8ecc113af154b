"""Text parsing expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv


def strip(col: Column) -> Column:
    """Trim every kind of whitespace; SQL trim would only drop spaces."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def norm(col: Column) -> Column:
    return F.lower(strip(col))


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def hit_count(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [col.contains(w).cast("int") for w in words])


def words_of(col: Column) -> Column:
    """Whitespace words; the empty text has none."""
    return F.filter(F.split(strip(col), r"\s+"), lambda w: w != "")


# --- patch identifiers ------------------------------------------------------------------------------------------------

def patch_date_str(pid: Column) -> Column:
    found = F.regexp_extract(pid, r"(\d{8})T\d{6}", 1)
    return F.when(found == "", F.lit("unknown")).otherwise(found)


def patch_date(pid: Column) -> Column:
    return F.try_to_date(patch_date_str(pid), "yyyyMMdd")


def _patch_part(pid: Column, i: int, default: Column) -> Column:
    parts = F.split(pid, "_")
    return F.when(F.size(parts) >= 8, F.get(parts, F.lit(i))).otherwise(default)


def patch_tile(pid: Column) -> Column:
    return _patch_part(pid, 5, F.lit("unknown"))


def patch_x(pid: Column) -> Column:
    return _patch_part(pid, 6, F.lit("0"))


def patch_y(pid: Column) -> Column:
    return _patch_part(pid, 7, F.lit("0"))


def location_key(pid: Column) -> Column:
    parts = F.split(pid, "_")
    return F.when(
        F.size(parts) >= 8, F.concat_ws("_", F.get(parts, F.lit(5)), F.get(parts, F.lit(6)), F.get(parts, F.lit(7)))
    ).otherwise(pid)


def tile_date_key(pid: Column) -> Column:
    parts = F.split(pid, "_")
    return F.concat_ws("_", F.get(parts, F.lit(5)), F.substring(F.get(parts, F.lit(2)), 1, 8))


# --- archive members --------------------------------------------------------------------------------------------------

def member_patch(path: Column, mode: str) -> Column:
    """Patch id of an archive member. Modes: ``parent`` (split archives), ``s2`` and ``s1`` (any matching folder)."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    if mode == "parent":
        deep = slashed.rlike("^[^/]*/[^/]*/[^/]*/")
        parent = F.substring_index(F.substring_index(slashed, "/", -2), "/", 1)
        return F.when(deep & slashed.endswith(".tif"), parent).otherwise(F.lit(""))
    parts = F.split(slashed, "/")

    def underscores(p: Column) -> Column:
        return F.length(p) - F.length(F.replace(p, F.lit("_"), F.lit("")))

    if mode == "s2":
        hits = F.filter(
            parts, lambda p: p.startswith("S2") & p.contains("_MSIL2A_") & (underscores(p) >= 6)
        )
    elif mode == "s1":
        hits = F.filter(parts, lambda p: p.startswith("S1") & (underscores(p) >= 4))
    else:
        raise ValueError(f"unknown member mode {mode!r}")
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def member_band(path: Column, mode: str) -> Column:
    """Band of a member: text after the last underscore, or the whole stem in the zst layout."""
    stem = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    stem = F.replace(stem, F.lit(".tif"), F.lit(""))
    return F.substring_index(stem, "_", -1) if mode == "parent" else stem


# --- prompts, answers and queries -------------------------------------------------------------------------------------

def infer_prompt_type(text: Column) -> Column:
    out = F
    for kind, phrase in fv.PROMPT_TYPE_PHRASES:
        out = out.when(text.contains(phrase), F.lit(kind))
    return out.otherwise(F.lit("other"))


def audit_type(question_lower: Column) -> Column:
    """Audit task type. "no" is a substring test, so "not" counts: that is the rule being reproduced."""
    q = question_lower
    return (
        F.when(q.contains("answer with") & (q.contains("yes") | q.contains("no")), F.lit("binary_yn"))
        .when(contains_any(q, fv.AUDIT_MCQ_PHRASES), F.lit("mcq"))
        .when(contains_any(q, fv.AUDIT_DESCRIPTION_PHRASES), F.lit("description"))
        .when(contains_any(q, fv.AUDIT_OPEN_PHRASES), F.lit("open_vqa"))
        .when(q.contains("caption"), F.lit("caption"))
        .otherwise(F.lit("other"))
    )


def normalize_yes_no(answer: Column) -> Column:
    a = norm(answer)
    return F.when(a.contains("yes"), F.lit("yes")).when(a.contains("no"), F.lit("no")).otherwise(a)


def normalize_prediction(value: Column, kind: Column) -> Column:
    """``kind`` tells which type the stored text had: bool, none, or anything printable."""
    return (
        F.when((kind == "none") | value.isNull(), F.lit(""))
        .when(kind == "bool", F.when(norm(value).isin("true", "1"), F.lit("true")).otherwise(F.lit("false")))
        .otherwise(norm(value))
    )


def parse_bbox(text: Column) -> Column:
    """First four digit/dot runs as numbers. A minus sign is not part of a run; one bad run empties the box."""
    runs = F.slice(F.regexp_extract_all(text, F.lit(r"([\d.]+)"), F.lit(1)), 1, 4)
    numbers = F.transform(runs, lambda r: r.try_cast("double"))
    return F.when(F.exists(numbers, lambda n: n.isNull()), F.array().cast("array<double>")).otherwise(numbers)


def modality_sections(text: Column) -> dict[str, Column]:
    """Split a sectioned response; each section ends at the nearest later marker, no section means all is fused."""
    def places(upper: Column) -> Column:
        """Where each marker begins, all behind the starts of the others found in the same upper-case text."""
        found = []
        for name, marker in fv.RESPONSE_SECTIONS:
            start = F.locate(marker, upper) + len(marker)
            ends = [F.nullif(_locate_from(upper, other, start), F.lit(0)) for n, other in fv.RESPONSE_SECTIONS if n != name]
            found.append(F.struct(start.alias("start"), F.least(*ends).alias("end")).alias(name))
        return F.struct(*found)

    at = F.get(F.transform(F.array(F.upper(text)), places), F.lit(0))
    raw: dict[str, Column] = {}
    for name, marker in fv.RESPONSE_SECTIONS:
        start = at[name]["start"]
        end = F.coalesce(at[name]["end"], F.length(text) + 1)
        raw[name] = F.when(start > len(marker), strip(F.substring(text, start, end - start))).otherwise(F.lit(""))
    nothing = reduce(lambda a, b: a & b, [c == "" for c in raw.values()])
    raw["fused"] = F.when(nothing, text).otherwise(raw["fused"])
    return raw


def _locate_from(upper: Column, marker: str, start: Column) -> Column:
    return F.call_function("locate", F.lit(marker), upper, start)


def _intent_keyword_task(q: Column) -> Column:
    out = F
    for task, words in fv.INTENT_RULES:
        out = out.when(contains_any(q, words), F.lit(task))
    return out.otherwise(F.lit(None).cast("string"))


def intent_facts(df: DataFrame, query: Column, scope: Column) -> DataFrame:
    """Adds what the verdict reads: the task that keywords name and the one that the scope names. The query is normalised in
    a lambda over a one-element array, which names it for every word test, so it is computed once a row."""
    normal = strip(F.regexp_replace(F.lower(query), r"\s+", " "))

    def facts(q: Column) -> Column:
        shortcut = (
            F.when((scope == "bi_temporal") & contains_any(q, fv.BI_TEMPORAL_WORDS), F.lit("change"))
            .when((scope == "cross_modal") | contains_any(q, fv.CROSS_MODAL_WORDS), F.lit("fusion"))
        )
        return F.struct(_intent_keyword_task(q).alias("keyword"), shortcut.alias("shortcut"))

    return df.withColumn("__intent", F.get(F.transform(F.array(normal), facts), F.lit(0)))


def intent_verdict(scope: Column, hint: Column) -> tuple[Column, Column]:
    """(task, reject reason) over the facts. Scope shortcuts and defaults skip the strict scope check; hints and keywords do
    not."""
    keyword, shortcut = F.col("__intent.keyword"), F.col("__intent.shortcut")
    default = F.when(scope == "bi_temporal", F.lit("change")).otherwise(F.lit("vqa"))
    checked = F.coalesce(hint, F.when(shortcut.isNull(), keyword))
    task = F.coalesce(hint, shortcut, keyword, default)
    wrong = F
    for strict_task, needed in fv.STRICT_SCOPES.items():
        wrong = wrong.when((checked == strict_task) & (scope != needed), F.lit(True))
    reason = F.when(
        F.coalesce(wrong.otherwise(F.lit(False)), F.lit(False)),
        F.concat(F.lit("Task '"), task, F.lit("' is incompatible with input scope '"), scope, F.lit("'")),
    )
    return task, reason


def classify_intent_client(query: Column, file_names: Column, n_files: Column, selected: Column) -> Column:
    """Word-bounded client variant; an explicit selection wins."""
    q, names = F.lower(query), F.lower(file_names)
    radar_file = names.rlike(fv.CLIENT_RADAR_FILE_PATTERN)
    fusion = (
        q.rlike(fv.CLIENT_FUSION_PATTERN)
        | ((radar_file | (n_files >= 2)) & q.rlike(fv.CLIENT_FUSION_PAIR_PATTERN))
        | (radar_file & names.rlike(fv.CLIENT_OPTICAL_FILE_PATTERN))
    )
    return (
        F.when(selected.isin("vqa", "caption", "change", "fusion", "grounding"), selected)
        .when(q.rlike(fv.CLIENT_GROUNDING_PATTERN), F.lit("grounding"))
        .when(fusion, F.lit("fusion"))
        .when((n_files >= 2) | q.rlike(fv.CLIENT_CHANGE_PATTERN), F.lit("change"))
        .when(q.rlike(fv.CLIENT_CAPTION_PATTERN), F.lit("caption"))
        .otherwise(F.lit("vqa"))
    )


# --- image metadata vocabulary ----------------------------------------------------------------------------------------

def normalize_crs(crs: Column, epsg: Column) -> tuple[Column, Column]:
    """(epsg, name). A positive code wins, then the EPSG: prefix, aliases and UTM zone names."""
    s = F.upper(strip(crs))
    code_text = F.get(F.split(strip(F.element_at(F.split(s, "EPSG:"), -1)), r"\s+"), F.lit(0))
    prefixed = F.when(s.contains("EPSG:") & code_text.rlike(r"^\d+$"), code_text.try_cast("int"))
    utm = r"UTM\s*(?:ZONE\s*)?(\d{1,2})\s*([NS])"
    zone = F.regexp_extract(s, utm, 1).try_cast("int")
    base = F.when(F.regexp_extract(s, utm, 2) == "N", F.lit(32600)).otherwise(F.lit(32700))
    code = F.coalesce(
        F.when(epsg > 0, epsg.cast("int")),
        prefixed,
        F.when(s.isin(fv.WGS84_ALIASES), F.lit(4326)).when(s.isin(fv.MERCATOR_ALIASES), F.lit(3857)),
        F.when(zone.between(1, 60), base + zone),
    )
    name = F.when(code.isNotNull(), F.concat(F.lit("EPSG:"), code.cast("string"))).otherwise(
        F.when(s != "", s)
    )
    return code, name


def normalize_format(value: Column) -> Column:
    v = F.upper(strip(value))
    return (
        F.when(v.isin(fv.TIFF_ALIASES), F.when(v.contains("GEO"), F.lit("GEOTIFF")).otherwise(F.lit("TIFF")))
        .when(v.isin(fv.FILE_FORMATS), v)
        .otherwise(F.lit("OTHER"))
    )


def normalize_modality(value: Column) -> Column:
    """Known modality in lower case, or null for the caller's reject branch."""
    v = norm(value)
    return F.when(v.isin(fv.MODALITIES), v)
