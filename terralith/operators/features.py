"""All feature categories of segments in one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .context import context
from .geometry import geometry
from .labels import keys
from .spectral import spectral
from .texture import texture

#: Options of each category, by the names they have in extract().
OPTIONS = {
    "spectral": {"band_names": "names", "ratios": "ratios", "nodata": "nodata"},
    "geometry": {"pixel_size": "pixel_size"},
    "texture": {"texture_bands": "bands", "texture_distances": "distances", "texture_levels": "levels", "texture_angles": "angles"},
    "context": {},
}
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"spectral": spectral, "geometry": geometry, "texture": texture, "context": context}


def list_categories() -> list[str]:
    return list(EXTRACTORS)


def merged(tables: list[DataFrame]) -> DataFrame:
    """Feature tables side by side, with the segments of all of them."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, keys(out), "full_outer")
    return out


def extract(px: DataFrame, categories: list[str] | None = None, progress: Callable[[float], None] | None = None, **options) -> DataFrame:
    """The features of the categories, all four unless given, for each segment. No categories give the ids alone.

    progress is told the share of categories whose plan stands; nothing is computed before an action.
    """
    chosen = list(EXTRACTORS) if categories is None else [c.lower() for c in categories]
    if unknown := [c for c in chosen if c not in EXTRACTORS]:
        raise ValueError(f"Unknown feature category: {unknown[0]!r}. Available: {', '.join(EXTRACTORS)}")
    known = {k for of in OPTIONS.values() for k in of}
    if unknown := sorted(set(options) - known):
        raise ValueError(f"Unknown option: {unknown[0]!r}")
    if not chosen:
        return px.select(*keys(px)).limit(0)
    tables = []
    for i, c in enumerate(chosen):
        own = {to: options[k] for k, to in OPTIONS[c].items() if options.get(k) is not None}
        if c == "texture":
            own |= {k: tuple(v) for k, v in own.items() if k in ("distances", "angles")}
        tables.append(EXTRACTORS[c](px, **own))
        if progress:
            progress(100 * (i + 1) / len(chosen))
    return merged(tables)
