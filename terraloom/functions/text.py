"""Names, digests and rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")


def format_p(p: Column, floor: float = 1e-4) -> Column:
    return F.when(p.isNull(), "").when(p < floor, f"<{floor:g}").otherwise(F.format_string("%.4f", p))


def resume_key(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of all that decides a result."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts)), 256), 1, 16)


def third_party_id(c: Column) -> Column:
    return c.rlike("^(AF1Q|CIHM|CIAB)") | (F.length(c) > 22)


def years_in_names(paths: list[str]) -> dict[str, int]:
    """Year of each path whose name has exactly one, if no other path has it."""
    found = {p: set(map(int, re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", p.rsplit("/", 1)[-1]))) for p in paths}
    single = {p: next(iter(y)) for p, y in found.items() if len(y) == 1}
    return {p: y for p, y in single.items() if list(single.values()).count(y) == 1}


def parse_reference(ref: str) -> tuple[str, str, str | None]:
    """Engine, step and statistic of @engine.step[stat]."""
    m = re.fullmatch(r"@([A-Za-z_]\w*)\.([\w-]+)(?:\[([\w:.-]+)\])?", ref.strip())
    if not m:
        raise ValueError(f"{ref!r} isn't @engine.step or @engine.step[stat]")
    return m[1], m[2], m[3]
