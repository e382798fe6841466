"""Relative link resolution as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: scheme, host, path, query and fragment of a link.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME, _HOST, _PATH, _QUERY, _FRAGMENT = range(1, 6)


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _PARTS, index)


def _without_dots(path: Column) -> Column:
    """Drop ``.`` and resolve ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    # Climbing above the root can take the leading slash along.
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def join_url(base: Column, link: Column) -> Column:
    """``link`` made absolute against ``base``; links with their own scheme stay as they are."""
    base_scheme, base_host, base_path = _part(base, _SCHEME), _part(base, _HOST), _part(base, _PATH)
    root = F.concat(base_scheme, F.lit("://"), base_host)
    path, query, fragment = _part(link, _PATH), _part(link, _QUERY), _part(link, _FRAGMENT)

    folder = F.regexp_replace(base_path, "[^/]*$", "")
    # Empty segments inside the joined path are dropped, those at its ends are kept.
    relative = F.concat(
        F.when(folder.startswith("/"), folder).otherwise(F.concat(F.lit("/"), folder)), path
    )
    relative = F.regexp_replace(relative, "(?<=.)/{2,}", "/")
    full_path = F.when(path.startswith("/"), path).otherwise(relative)
    clean = F.when(full_path.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(full_path)).otherwise(full_path)

    return (
        F.when(_part(link, _SCHEME) != "", link)
        .when(link.startswith("//"), F.concat(base_scheme, F.lit(":"), link))
        .when(
            path == "",
            F.concat(root, base_path, F.when(query != "", query).otherwise(_part(base, _QUERY)), fragment),
        )
        .otherwise(F.concat(root, clean, query, fragment))
    )
