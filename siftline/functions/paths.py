"""Predicates and parts of paths."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import constants as K


def filename_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """Lower-cased extension of the file name; null where it has no dot, or only a leading one."""
    name = filename_of(path)
    return F.when(F.locate(".", F.substring(name, 2, 1 << 30)) > 0, F.lower(F.substring_index(name, ".", -1)))


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether a path begins with one of the prefixes (no prefix: all do)."""
    return reduce(or_, (path.startswith(p) for p in prefixes)) if prefixes else F.lit(True)


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below one, by whole components."""
    return reduce(or_, ((path == r) | path.startswith(r.rstrip("/") + "/") for r in roots), F.lit(False))


def _components(parts: list[str]) -> str:
    return "(?:" + "|".join(r"[^/]*\Q" + p[1:] + r"\E" if p.startswith("*") else r"\Q" + p + r"\E" for p in parts) + ")"


def excluded_default(path: Column) -> Column:
    """Whether a component, or a run of them, is one of the artefacts that scans leave out."""
    return F.concat(F.lit("/"), path, F.lit("/")).rlike("/" + _components(K.DEFAULT_EXCLUDES) + "/")


def excluded_home(path: Column) -> Column:
    return F.concat(F.lit("/"), path, F.lit("/")).rlike("/" + _components(K.HOME_EXCLUDES) + "/")


def excluded_os(path: Column) -> Column:
    return under_roots(path, K.OS_EXCLUDES)


def excluded_for(path: Column, preset: str | None) -> Column:
    """What a preset leaves out besides the default artefacts."""
    return excluded_home(path) if preset == "full_home" else excluded_os(path) | excluded_home(path) if preset == "everything" else F.lit(False)


def unlike(path: Column, patterns: list[str]) -> Column:
    """Like none of the patterns, whatever the case."""
    return ~reduce(or_, (path.ilike(p) for p in patterns))


def expand_tilde(path: str, home: str) -> str:
    return home + path[1:] if path == "~" or re.match(r"~[/\\]", path) else path


def preset_roots(preset: str, custom: list[str], home: str, volumes: list[str] = ()) -> list[str]:
    """Roots of a preset and custom ones, in order, each once; an unknown preset is the personal one."""
    base = {"full_home": ["~"], "everything": ["/", *volumes]}.get(preset, K.DEFAULT_ROOTS)
    return list(dict.fromkeys(expand_tilde(p, home) for p in [*base, *custom]))
