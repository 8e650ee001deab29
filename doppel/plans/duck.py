"""DuckDB SQL text for the oracle side of the correctness check.

The same rules as ``doppel.functions`` written a second time, as plain SQL
expressions over DuckDB lists, so that the driver can run them next to the
Spark jobs. Helpers return SQL fragments; ``a``/``b`` are table aliases.
"""

from __future__ import annotations

# Fixed values, stated here once more so that the oracles don't read the code under test.
CITY_SUFFIX_MARKERS = [ "an der", "a.d.", "a. d.", "in der", "i.d.", "i. d.", "am", "a.", "im", "i.", "in", "bei", "b.", "ob der", "o.d.", "o. d.", "vor der", "v.d.", "v. d.", "unter", "u.", ]
DUPLICATE_LABEL_KEYWORDS = ["duplikat", "duplicate", "dublette"]

WS = r"[\s\x0B\x{85}\p{Z}]"


def utrim(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '^{WS}+|{WS}+$', '', 'g')"


def nonblank(x: str) -> str:
    return f"({utrim(x)} <> '')"


def email(x: str) -> str:
    return f"lower({utrim(x)})"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{Nd}}]+')"


def street(x: str) -> str:
    toks = rf"regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[\p{{L}}\p{{Nd}}]+')"
    return f"array_to_string(list_transform({toks}, lambda t: regexp_replace(t, 'str$', 'strasse')), ' ')"


def _city_case(x: str, part: str) -> str:
    v = f"lower({utrim(x)})"
    sl = f"instr({v}, '/')"

    def split(pos: str, skip: int) -> str:
        if part == "main":
            return utrim(f"substr({v}, 1, {pos} - 1)")
        return f"rtrim({utrim(f'substr({v}, {pos} + {skip})')}, '.')"

    parts = [f"WHEN {v} = '' THEN ''", f"WHEN {sl} > 1 THEN {split(sl, 1)}"]
    for marker in CITY_SUFFIX_MARKERS:
        pad = f" {marker} "
        pos = f"instr({v}, '{pad}')"
        parts.append(f"WHEN {pos} > 0 THEN {split(pos, len(pad))}")
    default = v if part == "main" else "''"
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


def city_main(x: str) -> str:
    return _city_case(x, "main")


def city_by(x: str) -> str:
    return _city_case(x, "by")


def subset(s: str, l: str) -> str:
    return f"(len({s}) > 0 AND len({s}) <= len({l}) AND list_has_all({l}, {s}))"


def initials(a: str, b: str) -> str:
    tok = (f"({a}[i] = {b}[i] OR (strlen({a}[i]) = 1 AND starts_with({b}[i], {a}[i])) "
           f"OR (strlen({b}[i]) = 1 AND starts_with({a}[i], {b}[i])))")
    return (f"(len({a}) = len({b}) AND coalesce(list_bool_and(list_transform(range(1, len({a}) + 1), "
            f"lambda i: {tok})), true))")


def fnm(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({a} = {b} OR {subset(a, b)} OR {subset(b, a)} OR {initials(a, b)}))"


def lnm(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({a} = {b} OR {subset(a, b)} OR {subset(b, a)}))"


def suffix_ok(x: str, y: str) -> str:
    return (f"({x} = '' OR {y} = '' OR {x} = {y} "
            f"OR (strlen({x}) = 1 AND strlen({y}) > 1 AND starts_with({y}, {x})) "
            f"OR (strlen({y}) = 1 AND strlen({x}) > 1 AND starts_with({x}, {y})))")


def city_eq(a: str, b: str) -> str:
    return (f"({a}.city_main <> '' AND {b}.city_main <> '' AND {a}.city_main = {b}.city_main "
            f"AND {suffix_ok(f'{a}.city_by', f'{b}.city_by')})")


def couple(a: str, b: str) -> str:
    return (f"({a}.email_n <> '' AND {a}.email_n = {b}.email_n AND {a}.campus_id = {b}.campus_id "
            f"AND {city_eq(a, b)} AND {a}.street_n <> '' AND {a}.street_n = {b}.street_n "
            f"AND NOT {fnm(f'{a}.first_t', f'{b}.first_t')})")


def persons_match(a: str, b: str) -> str:
    same_email = f"({a}.email_n <> '' AND {a}.email_n = {b}.email_n)"
    r1 = (f"({city_eq(a, b)} AND {a}.street_n <> '' AND {a}.street_n = {b}.street_n "
          f"AND {fnm(f'{a}.first_t', f'{b}.first_t')})")
    r2 = f"({fnm(f'{a}.first_t', f'{b}.first_t')} AND {lnm(f'{a}.last_t', f'{b}.last_t')})"
    r3 = f"({fnm(f'{a}.first_t', f'{b}.last_t')} AND {lnm(f'{a}.last_t', f'{b}.first_t')})"
    return f"(CASE WHEN {same_email} THEN NOT {couple(a, b)} ELSE ({r1} OR {r2} OR {r3}) END)"


def features_sql(src: str = "persons") -> str:
    return f"""SELECT CAST(person_id AS BIGINT) AS person_id, coalesce(CAST(campus_id AS INTEGER), 0) AS campus_id,
  {email('email')} AS email_n, {tokens('first_name')} AS first_t, {tokens('last_name')} AS last_t,
  {city_main('city')} AS city_main, {city_by('city')} AS city_by, {street('street')} AS street_n
FROM {src} WHERE person_id > 0"""


def block_keys_sql(f: str = "f", swapped: bool = False) -> str:
    either = f"""
  UNION ALL SELECT person_id, CASE WHEN len(first_t) > 0 AND len(last_t) > 0 THEN
    'sw:' || least(first_t[1], last_t[1]) || '|' || greatest(first_t[1], last_t[1]) END FROM {f}""" if swapped else ""
    return f"""SELECT person_id, k AS block_key FROM (
  SELECT person_id, CASE WHEN len(first_t) > 0 AND city_main <> '' AND street_n <> ''
                         THEN 'fcs:' || first_t[1] || '|' || city_main || '|' || street_n END AS k FROM {f}
  UNION ALL SELECT person_id, CASE WHEN len(first_t) > 0 AND len(last_t) > 0 THEN 'fl:' || first_t[1] || '|' || last_t[1] END FROM {f}
  UNION ALL SELECT person_id, CASE WHEN len(first_t) > 0 AND len(last_t) > 0 THEN 'lf:' || last_t[1] || '|' || first_t[1] END FROM {f}{either}
) t WHERE k IS NOT NULL"""


def components_sql(edges: str) -> str:
    """CTE body text: ``(node, label)`` over an edge CTE ``edges(src, dst)``."""
    return f"""reach(node, lab) AS (
    SELECT src, src FROM {edges} UNION SELECT dst, dst FROM {edges}
    UNION
    SELECT e.b, r.lab FROM reach r JOIN (SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}) e
      ON e.a = r.node
  ),
  comp AS (SELECT node, min(lab) AS label FROM reach GROUP BY node)"""


def duplicate_label(x: str) -> str:
    low = f"lower({utrim(x)})"
    return "(" + " OR ".join(f"contains({low}, '{k}')" for k in DUPLICATE_LABEL_KEYWORDS) + ")"


def format_date(x: str) -> str:
    v = utrim(x)
    d = f"try_strptime(substr({v}, 1, 10), '%Y-%m-%d')"
    return (f"(CASE WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {d} IS NOT NULL "
            f"THEN strftime({d}, '%d.%m.%Y') ELSE {v} END)")
