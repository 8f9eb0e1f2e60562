"""Path, file-name and language expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .tiles import lit_map


def path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"\\", "/"), "/")


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def game_name(path: Column) -> Column:
    """Dataset name of a capture, tagged by its source root.

    ``root/run_N/gameM[/gameM].jsonl`` -> ``root_run_N_gameM``; ``root/run_N[/run_N].jsonl`` ->
    ``root_run_N``; anything else -> the file stem.
    """
    parts = path_parts(path)
    stem = file_stem(F.element_at(parts, -1))
    above = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))
    nested = F.coalesce(F.try_element_at(above, F.lit(-1)) == stem, F.lit(False))
    above = F.when(nested, F.slice(above, F.lit(1), F.size(above) - 1)).otherwise(above)
    parent = F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit(""))
    grand = F.coalesce(F.try_element_at(above, F.lit(-2)), F.lit("ai"))
    in_run = parent.rlike(r"^run_\d+$") & stem.rlike(r"^game\d+$")
    is_run = stem.rlike(r"^run_\d+$")
    root = F.when(F.size(above) > 0, parent).otherwise("ai")
    return F.when(in_run, F.concat_ws("_", grand, parent, stem)).when(is_run, F.concat_ws("_", root, stem)).otherwise(stem)


def frames_dir(capture: Column) -> Column:
    """Frames folder of a capture: its own folder if that bears its name, else the sibling of its stem."""
    base = file_stem(capture)
    parts = F.split(base, "/")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    parent = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), "/")
    return F.when(F.coalesce((before == last) & (parent != ""), F.lit(False)), parent).otherwise(base)


def capture_for(frames: Column) -> Column:
    """The nested capture a frames folder belongs to."""
    d = F.regexp_replace(frames, "/+$", "")
    return F.concat(d, F.lit("/"), F.element_at(F.split(d, "/"), -1), F.lit(".jsonl"))


def method_fields(method: Column, name: Column) -> Column:
    """(method, action name); only one method carries an action."""
    return F.struct(method.alias("method"), F.when(method == ".lq.ActionPrototype", name).alias("action_name"))


def normalize_language(raw: Column) -> Column:
    """Canonical code of a language string; unknown text passes through trimmed, empty is null."""
    trimmed = F.trim(raw)
    key = F.replace(F.lower(trimmed), F.lit("_"), F.lit("-"))
    aliases = lit_map({a: code for code, names in dims.LANGUAGE_ALIASES.items() for a in names})
    return F.when(trimmed != "", F.coalesce(aliases[key], trimmed))


def resolve_language(server: Column, probe: Column, override: Column) -> Column:
    """Override, else probe, else the server's coarse language, else ``unknown``."""
    return F.coalesce(normalize_language(override), normalize_language(probe), lit_map(dims.SERVER_LANGUAGE)[server], F.lit("unknown"))


def probe_language(entries: Column) -> Column:
    """First entry of an ordered (key, value) array whose key names a language and whose value is known."""
    known = F.filter(entries, lambda e: e["key"].rlike("(?i)lang|locale") & normalize_language(e["value"]).isin(dims.KNOWN_LANGUAGES))
    return F.get(F.transform(known, lambda e: normalize_language(e["value"])), F.lit(0))


def holdout_specs(specs: DataFrame) -> DataFrame:
    """``name:*`` or ``name:k1,k2`` rows to (name, whole, keys); the later spec of a name wins.

    Input: ``ord, spec``; empty specs are ignored.
    """
    d = specs.filter(F.coalesce(F.col("spec") != "", F.lit(False)))
    name, rest = F.substring_index("spec", ":", 1), F.regexp_replace("spec", r"^[^:]*:?", "")
    keys = F.when((rest != "") & (rest != "*"), F.array_distinct(F.split(rest, ","))).otherwise(F.array().cast("array<string>"))
    d = d.select(name.alias("name"), "ord", F.struct((rest == "*").alias("whole"), keys.alias("keys")).alias("_s"))
    return d.groupBy("name").agg(F.max_by("_s", "ord").alias("_s")).select("name", "_s.whole", "_s.keys")
