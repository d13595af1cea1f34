"""Salary tests on a parsed posting.

The two sources use different rules on purpose: source A asks for *truthy*
salary fields, source B for *numeric* amounts.  ``{"from": 0}`` passes B but
not A; ``{"salary": "12"}`` passes A but not B.  A posting that is not an
object fails both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.json import as_array, field, is_number, truthy

# ---------------------------------------------------------------------------
# Fixed values.
# Source A: top-level fields, the employment-type list fields (the second is
# used only when the first is falsy), and the fields tested on each entry.
A_TOP_FIELDS = ("salary", "salaryRange")
A_TYPE_LISTS = ("employmentTypes", "employmentType")
A_ENTRY_FIELDS = ("salary", "salaryRange", "from", "to")
# Source B: list, entry fields, and top-level fallback fields.
B_TYPE_LIST = "employmentTypes"
B_ENTRY_FIELDS = ("from", "to")
B_TOP_FIELDS = ("salary_from", "salary_to", "salary")
# ---------------------------------------------------------------------------


def _any_field(v: Column, keys, test) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | test(field(v, k))
    return out


def has_salary_a(v: Column) -> Column:
    """P1 (truthiness rules)."""
    first, second = A_TYPE_LISTS
    types = F.when(truthy(field(v, first)), field(v, first)).otherwise(field(v, second))
    entries = as_array(types)
    in_entries = F.coalesce(
        F.exists(entries, lambda e: _any_field(e, A_ENTRY_FIELDS, truthy)), F.lit(False))
    return _any_field(v, A_TOP_FIELDS, truthy) | in_entries


def has_salary_b(v: Column) -> Column:
    """P2 (numeric rules, 0 counts, numeric strings do not)."""
    entries = as_array(field(v, B_TYPE_LIST))
    in_entries = F.coalesce(
        F.exists(entries, lambda e: _any_field(e, B_ENTRY_FIELDS, is_number)), F.lit(False))
    return in_entries | _any_field(v, B_TOP_FIELDS, is_number)
