"""Feature names, their classes, and the naming rules of files, groups and columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime
from itertools import product
from random import choices
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column names and prefixes of each feature class.
FEATURE_PREFIXES = {
    "len": ["ftlen_abs_length", "ftlen_pct_length"],
    "prm": ["ftprm_"],
    "gc": ["ftgc_pct_GC"],
    "cpg": ["ftcpg_pct_CpG"],
    "oecpg": ["ftoecpg_rat_oeCpG"],
    "rep": ["ftrep_pct_repcon"],
    "kmf": ["ftkmf_pct_k"],
    "tfm": ["fttfm_pct_"],
    "msig": ["ftmsig_"],
    "roi": ["ftroi_"],
    "dnm": ["ftdnm_abs_medprob", "ftdnm_abs_maxprob", "ftdnm_abs_medad"],
    "drv": ["ftdrv"],
    "asc": ["ftasc_"],
}

# Classes computed from the sequence alone.
SEQUENCE_CLASSES = ["len", "prm", "gc", "cpg", "oecpg", "rep", "kmf", "dnm"]

# Column order of BED-like output, and of the alignment map.
BED_ORDER = ["chrom", "start", "end", "name", "score", "strand", "signalValue", "pValue", "qValue"]
MAP_ORDER = {
    ("target", True): ["tchrom", "tstart", "tend", "tstrand", "blockid", "qchrom", "qstart", "qend", "qstrand"],
    ("target", False): ["tchrom", "tstart", "tend", "blockid"],
    ("query", True): ["qchrom", "qstart", "qend", "tstrand", "blockid", "tchrom", "tstart", "tend", "qstrand"],
    ("query", False): ["qchrom", "qstart", "qend", "blockid"],
}


def feature_columns(columns: Iterable[str]) -> list[str]:
    return sorted(c for c in columns if c.startswith("ft"))


def prefixes_of(classes: Iterable[str]) -> list[str]:
    wanted = set(classes)
    return [p for name, prefixes in FEATURE_PREFIXES.items() if name in wanted for p in prefixes]


def class_of(feature: str) -> str:
    """Class of a feature column: the owner of its longest matching prefix."""
    matches = [(len(p), cls) for cls, prefixes in FEATURE_PREFIXES.items() for p in prefixes if feature.startswith(p)]
    if not matches:
        raise ValueError(f"no feature class for column {feature}")
    return max(matches)[1]


def classes_of(features: Iterable[str]) -> list[str]:
    return sorted({class_of(f) for f in features})


def available_from_sequence(classes: Iterable[str]) -> list[str]:
    return [c for c in classes if c in SEQUENCE_CLASSES]


def kmer_columns(k: int, alphabet: str = "ACGTN") -> list[str]:
    return ["ftkmf_pct_k" + "".join(letters) for letters in product(alphabet, repeat=k)]


def select_features(
    columns: Iterable[str], classes: Sequence[str] = (), drop: str = "", keep: str = ""
) -> tuple[list[str], list[str]]:
    """Feature columns after class and pattern selection, and those the pattern removed."""
    chosen = feature_columns(columns)
    if classes:
        prefixes = tuple(prefixes_of(classes))
        chosen = [c for c in chosen if c.startswith(prefixes)]
    if not (drop or keep):
        return chosen, []
    pattern = re.compile((keep or drop).strip('"'))
    stays = [c for c in chosen if bool(pattern.search(c)) == bool(keep)]
    return stays, [c for c in chosen if c not in stays]


def bed_order(columns: Sequence[str]) -> list[str]:
    """BED columns first, in their standard order, then the rest as they come."""
    return [c for c in BED_ORDER if c in columns] + [c for c in columns if c not in BED_ORDER]


def region_order(columns: Sequence[str]) -> list[str]:
    lead = ["chrom", "start", "end", "name", "score"]
    return [c for c in lead if c in columns] + [c for c in columns if c not in lead]


def check_column_names(columns: Sequence[str], name_index: int = -1) -> list[str]:
    """Reject the feature prefix; give repeated names the suffix ``_dup<index>``."""
    reserved = [c for c in columns if c.startswith("ft")]
    if reserved:
        raise ValueError(f"column names may not start with ft: {reserved}")
    fixed = {0, 1, 2, name_index}
    repeated = {c for c in columns if list(columns).count(c) > 1}
    return [f"{c}_dup{i}" if c in repeated and i not in fixed else c for i, c in enumerate(columns)]


def suspicious_headers(fields: Iterable[str]) -> list[str]:
    """Header fields that begin like numbers."""
    return sorted({f for f in fields if re.match(r"[.\-_0-9e]+", f, re.IGNORECASE)})


def split_header(line: str, delimiter: str) -> list[str]:
    text = line.strip().lstrip("#")
    fields = text.split(delimiter)
    if not text or len(fields) < 2:
        raise ValueError(f"cannot read column names from header line: {line!r}")
    return fields


def assembly_name(given: str, path: str) -> str:
    """Assembly name as given, else the alphanumerics a file name starts with."""
    if given:
        return given
    found = re.match(r"[a-zA-Z0-9]+", path.rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"no assembly name in file name {path}")
    return found.group(0)


def group_path(group: str, suffix: str | None = None) -> str:
    path = group if group.startswith("/") else "/" + group
    if suffix and not path.endswith(suffix):
        path = path.rstrip("/") + "/" + suffix.rstrip("/")
    return path


def chrom_name(chrom: Column) -> Column:
    """Chromosome name without spaces and with the ``chr`` prefix."""
    clean = F.replace(F.trim(chrom), F.lit(" "), F.lit(""))
    return F.when(clean.startswith("chr"), clean).otherwise(F.concat(F.lit("chr"), clean))


def matches_from_start(column: Column, pattern: str) -> Column:
    """Regular expression match anchored at the start of the value only."""
    return column.rlike("^(?:" + pattern.strip('"') + ")")


def flatten_nested(items) -> list:
    """Leaves of nested lists, depth first; strings are leaves."""
    if isinstance(items, str) or not hasattr(items, "__iter__"):
        return [items]
    return [leaf for item in items for leaf in flatten_nested(item)]


def file_stamp(moment: datetime | None = None) -> str:
    """Date, time and five random letters for file names."""
    moment = moment or datetime.now()
    return moment.strftime("%Y%m%d_%H%M%S_") + "".join(choices(ascii_letters, k=5))
