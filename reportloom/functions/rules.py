"""Ordered keyword rules: a text's labels are those of the keywords in it, in the rules' order, each once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .exprs import strip

Rules = list[tuple[str, str]]

# Keyword to label, in order.
ICH_STRUCTURES: Rules = [
    ("front", "frontal"), ("pariet", "parietal"), ("occipit", "occipital"), ("tempor", "temporal"), ("insula", "insular"),
    ("lentic", "lentiform"), ("lentif", "lentiform"), ("putamen", "lentiform"), ("caudate", "caudate"), ("thalam", "thalamus"),
    ("cerebel", "cerebellum"), ("brainstem", "brainstem"), ("tronc", "brainstem"), ("pons", "brainstem"), ("mesencephalon", "brainstem"),
]
IVH_STRUCTURES: Rules = [
    ("third", "third"), ("troisieme", "third"), ("fourth", "fourth"), ("quatrieme", "fourth"), ("v3", "third"), ("v4", "fourth"),
    ("lateral", "lateral"), ("occipital", "lateral"), ("frontal", "lateral"), ("corne", "lateral"),
]
PHE_SEVERITIES: Rules = [
    ("mild", "mild"), ("gret", "mild"), ("discret", "mild"), ("small", "mild"), ("tiny", "mild"), ("minime", "mild"), ("minimal", "mild"),
    ("leger", "mild"), ("peu", "mild"), ("moderate", "moderate"), ("modere", "moderate"), ("medium", "moderate"), ("moyen", "moderate"),
    ("severe", "severe"), ("large", "severe"), ("important", "severe"), ("massive", "severe"), ("massif", "severe"),
    ("extensive", "severe"), ("extensif", "severe"), ("volumineux", "severe"), ("grand", "severe"),
]
SIDES = {"left": "lateral_left", "right": "lateral_right", "bilateral": "lateral_left-lateral_right"}


def labels(text: Column, rules: Rules) -> Column:
    """The array of labels of an already folded text."""
    found = F.array(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in rules))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def keyword_map(text: Column, rules: Rules, folded: Column | None = None) -> Column:
    """Labels joined with '-'; a text without any stays as it is, null stays null."""
    joined = F.array_join(labels(F.lower(text) if folded is None else folded, rules), "-")
    return F.when(joined == "", text).otherwise(joined)


def map_ich_structure(structure: Column) -> Column:
    return keyword_map(structure, ICH_STRUCTURES)


def map_ivh_structure(structure: Column, lateralization: Column) -> Column:
    """Each '/'-part of the structure with its side; the last side is repeated where there are fewer sides than parts.

    A part that maps to the lateral ventricle takes its side in; a part that maps to nothing but speaks of a ventricle is
    lateral. Labels of a part are joined with '-', parts with '/'. A missing structure stays missing; a missing side is none.
    """
    sides = F.transform(F.split(F.coalesce(lateralization, F.lit("")), "/"), lambda s: F.lower(strip(s)))

    def one(part: Column, i: Column) -> Column:
        text = F.lower(part)
        side = F.coalesce(F.try_element_at(sides, i + 1), F.element_at(sides, -1))
        found = labels(text, IVH_STRUCTURES)
        found = F.when(F.size(found) > 0, found).when(F.contains(text, F.lit("ventricle")), F.array(F.lit("lateral"))).otherwise(F.array(part))
        sided = F.lit("lateral")
        for word, label in reversed(SIDES.items()):
            sided = F.when(side == word, F.lit(label)).otherwise(sided)
        mapped = F.transform(found, lambda x: F.when(x == "lateral", sided).otherwise(x))
        return F.array_join(mapped, "-")

    parts = F.transform(F.split(structure, "/"), strip)
    return F.array_join(F.transform(parts, one), "/")


@lru_cache(1)
def _combining() -> str:
    """A character class of all code points with a combining class."""
    runs: list[list[int]] = []
    for c in range(0x300, 0x20000):
        if unicodedata.combining(chr(c)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@F.arrow_udf(StringType())
def fold(text: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks, lower-cased; batches go through Arrow kernels."""
    return pc.utf8_lower(pc.replace_substring_regex(pc.utf8_normalize(text, form="NFKD"), _combining(), ""))


def map_phe_severity(size: Column) -> Column:
    return keyword_map(size, PHE_SEVERITIES, fold(size))
