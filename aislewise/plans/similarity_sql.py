"""Checking SQL of the token-set similarity."""

from __future__ import annotations


def proc_sql(text):
    """Processed text: small letters and digits, one space between words."""
    return f"trim(regexp_replace(lower({text}), '[^\\pL\\pN]+', ' ', 'g'))"


def token_set_sql(name, pairs):
    """CTEs that end in ``name`` (a, b, score): token-set similarity of the processed texts in ``pairs`` (a, b)."""
    step = "((v + (v & m)) | (v - (v & m)))"
    masks = """list_transform(string_split(rb, ''), lambda c: list_sum(list_transform(range(len(ca)),
        lambda i: case when ca[i + 1] = c then 1::hugeint << i::int else 0::hugeint end))::hugeint)"""
    return f"""{name}w as materialized (select distinct a, b, list_sort(list_distinct(string_split(a, ' '))) as wa,
        list_sort(list_distinct(string_split(b, ' '))) as wb from ({pairs}) where a <> '' and b <> ''),
      {name}s as materialized (select *, list_filter(wa, lambda w: list_contains(wb, w)) as s from {name}w),
      {name}r as materialized (select a, b, len(s) as ns, len(wa) as na, len(wb) as nb, length(array_to_string(s, ' ')) as common,
        length(array_to_string(wa, ' ')) as la, length(array_to_string(wb, ' ')) as lb,
        string_split(array_to_string(list_filter(wa, lambda w: not list_contains(s, w)), ' '), '') as ca,
        array_to_string(list_filter(wb, lambda w: not list_contains(s, w)), ' ') as rb from {name}s),
      {name}m as materialized (select *, (1::hugeint << len(ca)) - 1 as ones, {masks} as masks from {name}r where ns < least(na, nb)),
      {name} as materialized (select a, b, 100e0 as score from {name}r where ns = least(na, nb) union all
        select a, b, greatest(200e0 * (case when ns > 0 then common + 1 else 0 end
            + len(ca) - bit_count((list_reduce(masks, lambda v, m: {step}, ones) & ones)::hugeint)) / (la + lb),
          case when ns > 0 then 200e0 * common / (common + least(la, lb)) else 0e0 end) from {name}m)"""
