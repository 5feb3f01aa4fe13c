"""SQL texts shared by the registered queries and by their DuckDB counterparts.

``DIRTY`` and the other base tables are plain SQL that both engines run; the functions below write the
DuckDB reading of single rules and are used by the counterparts only.
"""

from __future__ import annotations

from recordloom import fixed_values as fv
from recordloom.config import Settings

AS_OF = "2026-01-01"
AS_OF_SECONDS = 1767225600

# People with messy fields, ten per hundred of them near copies; grows with customer.
DIRTY = """
select row_id,
  case when row_id % 13 = 0 then '' when row_id % 10 = 9 then upper(substr(first, 1, length(first) - 1)) else concat('  ', first, ' ') end as prenom,
  case when row_id % 17 = 0 then '' else upper(fam) end as nom,
  case when row_id % 11 = 0 then 'not-an-email'
       else concat(first, '.', fam, cast(pid as string), '@',
            case pid % 4 when 0 then 'gmial.com' when 1 then 'yaho.com' when 2 then 'hotmail.com' else 'EXAMPLE.org.' end) end as courriel,
  case row_id % 5 when 0 then concat('0', nsn) when 1 then concat('+213 ', nsn) when 2 then concat('213', nsn)
       when 3 then concat('0', nsn, ' / 021000000') else nsn end as num_tel,
  case row_id % 6 when 0 then concat(dd, '/', mm, '/', yy) when 5 then yy when 4 then '' else concat(yy, '-', mm, '-', dd) end as date_naissance,
  case row_id % 5 when 0 then 'M' when 1 then 'Femme' when 2 then 'ذكر' when 3 then 'unknown' else '' end as sexe,
  case row_id % 6 when 0 then 'Algr' when 1 then 'ORAN' when 2 then 'وهران' when 3 then 'Boumerdess' when 4 then 'nowhere-land' else '31' end as wilaya,
  case row_id % 4 when 0 then 'math; physique' when 1 then 'Mathematiques, chess,  Chess' when 2 then '' else 'anglais|svt' end as matieres,
  case row_id % 9 when 0 then 'prof' when 1 then 'ecole' when 2 then 'alien' else 'élève' end as role,
  n_name as city
from (
  select *,
    concat(case pid % 5 when 0 then 'ami' when 1 then 'kar' when 2 then 'sal' when 3 then 'nou' else 'ras' end,
           case pid % 7 when 0 then 'ne' when 1 then 'im' when 2 then 'ma' when 3 then 'ra' when 4 then 'ed' when 5 then 'lia' else 'oune' end) as first,
    concat('ben', case pid % 11 when 0 then 'ali' when 1 then 'salem' when 2 then 'youcef' when 3 then 'amar' when 4 then 'said' when 5 then 'zid'
           when 6 then 'kaci' when 7 then 'naceur' when 8 then 'messaoud' when 9 then 'aissa' else 'hamou' end) as fam,
    concat('5', lpad(cast(50000000 + (pid * 7919) % 10000000 as string), 8, '0')) as nsn,
    cast(1971 + pid % 40 as string) as yy, lpad(cast(1 + pid % 12 as string), 2, '0') as mm, lpad(cast(1 + pid % 28 as string), 2, '0') as dd
  from (
    select c_custkey as row_id,
           case when c_custkey % 10 = 9 then c_custkey - 1 else c_custkey end as pid,
           n_name
    from customer join nation on c_nationkey = n_nationkey) b) i
"""

# Five headers for every customer, as if each had sent a file.
_HEADERS = ["emial", "telefone", "birthday", "age", "lat", "Prénom", "nom", "phonenumbr", "date naissance",
            "school_type", "E-Mail", "First Name", "lastnamee", "  Nom  de Famille ", "Matières", "wilayaa",
            "activity_score", "location", "الاسم", "Num_Tel", "sexe", "Bio", "full name", "d''ecole"]
_CHOICES = " ".join(f"when {i} then '{h}'" for i, h in enumerate(_HEADERS))
HEADERS = " union all ".join(
    f"select c_custkey as file_id, {p} as position, case (c_custkey * 7 + {p * 5}) % {len(_HEADERS)} {_CHOICES} end as header from customer"
    for p in range(5)
)


def grid(spark_dialect: bool) -> str:
    """Twenty sheets made of line items; blank rows, repeats and one long blank run here and there."""
    def cell(text: str, repeat: str) -> str:
        if spark_dialect:
            return f"named_struct('text', {text}, 'repeat', {repeat})"
        return f"{{'text': {text}, 'repeat': {repeat}}}"

    filled = [cell("concat(' p', cast(l_partkey as string))", "'1'"), cell("''", "case when l_suppkey % 3 = 0 then '2' else 'x' end"),
              cell("case when l_linenumber % 2 = 0 then '' else concat('q', cast(l_suppkey as string)) end", "'-4'"),
              cell("''", "'3'")]
    blank = [cell("''", "'4'")]
    wrap = "array({})" if spark_dialect else "[{}]"
    return f"""
select l_suppkey % 20 as sheet_id, n as row_no,
  case when blank and n % 5 = 0 then '700' when n % 7 = 0 then '3' when n % 11 = 0 then '0' when n % 13 = 0 then 'many' else '1' end as row_repeat,
  case when blank then {wrap.format(", ".join(blank))} else {wrap.format(", ".join(filled))} end as cells
from (select l_suppkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) + l_orderkey * 100 as n,
      l_partkey % 3 = 0 as blank from lineitem) x"""


# ---------------------------------------------------------------- DuckDB readings of single rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_of(mapping: dict[str, str]) -> str:
    return "values " + ", ".join(
        f"({quoted(a)}, {quoted(c)}, {i})" for i, (a, c) in enumerate(mapping.items())
    )


def label_case(column: str, labels: dict[str, list[str]]) -> str:
    return "case " + " ".join(
        f"when {column} in ({', '.join(quoted(x) for x in words)}) then {quoted(value)}" for value, words in labels.items()
    ) + " end"


def norm(c: str) -> str:
    return (
        f"trim(regexp_replace(translate(coalesce({c}, ''), '{fv.EASTERN_DIGITS}', '{fv.WESTERN_DIGITS}'), '\\s+', ' ', 'g'))"
    )


def title(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({text}), ' '), lambda w: "
        "array_to_string(list_transform(string_split(w, '-'), lambda h: "
        "array_to_string(list_transform(string_split(h, ''''), lambda s: upper(s[1:1]) || s[2:]), '''')), '-')), ' ')"
    )


def is_arabic(text: str) -> str:
    return f"regexp_matches({text}, '[\\x{{0600}}-\\x{{06FF}}]')"


def display(text: str) -> str:
    return f"nullif(case when {is_arabic(text)} then {text} else {title(text)} end, '')"


def email(text: str) -> str:
    local = f"regexp_extract(lower({text}), '^(.*)@[^@]*$', 1)"
    domain = f"trim(regexp_extract(lower({text}), '^.*@([^@]*)$', 1), ' .')"
    fixes = " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in fv.EMAIL_DOMAIN_FIXES.items())
    whole = f"({local} || '@' || case {domain} {fixes} else {domain} end)"
    return f"case when contains({text}, '@') and regexp_matches({whole}, {quoted(fv.EMAIL_SHAPE)}) then {whole} end"


def username(text: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_'), '')"


def phone(text: str) -> str:
    """Numbers as they occur in the base table: local, with code, with plus."""
    first = f"trim(regexp_extract({text}, '^([^/|;,،]*)', 1))"
    digits = f"regexp_replace({first}, '\\D', '', 'g')"
    national = f"case when length({digits}) > 10 then regexp_replace({digits}, '^213', '') else regexp_replace({digits}, '^0', '') end"
    return f"case when regexp_matches({national}, {quoted(fv.PHONE_RULES[0][3])}) then '+213' || {national} end"


def dob(text: str) -> str:
    moment = (
        f"case when regexp_full_match({text}, '\\d{{4}}') then try_strptime({text} || '-1-1', '%Y-%m-%d') "
        f"else coalesce(try_strptime({text}, '%Y-%m-%d'), try_strptime({text}, '%d/%m/%Y')) end"
    )
    return f"(select case when m between timestamp '1900-01-01' and timestamp '{AS_OF}' then cast(epoch(m) as bigint) end from (select {moment} as m))"


def slug(text: str) -> str:
    ascii_only = f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(lower({ascii_only}), '[^a-z0-9]+', '_', 'g'), '_')"


def optional(c: str) -> str:
    return f"(case when {c} is null or lower(trim({c})) in ('', 'nan', 'none', 'null') then '' else trim({c}) end)"


def filled(c: str) -> str:
    return f"nullif({optional(c)}, '')"


def last_word(c: str) -> str:
    return f"regexp_extract(trim({c}), '(\\S+)$', 1)"


def compose(name: str, last: str, fallback: str = "null") -> str:
    n, f = filled(name), filled(last)
    ends = f"(lower({n}) = lower({f}) or ends_with(lower({n}), ' ' || lower({f})))"
    return f"case when {n} is null then {fallback} when {f} is null or {ends} then {n} else {n} || ' ' || {f} end"


def suffix(c: str, digits: int = 4) -> str:
    return f"lpad(cast(abs({c}) % {10 ** digits} as varchar), {digits}, '0')"


def lcs_ctes(pairs: str, name: str = "ratios") -> str:
    """CTEs that score every row (a, b) of the table ``pairs``: ``ratios(a, b, score)``.

    Row by row of the table of common subsequences; a row is the running maximum of its raw values.
    """
    return f"""
    {name}_start as (select distinct a, b from {pairs} where a <> '' and b <> ''),
    {name}_rows as (
      select a, b, 0 as i, list_transform(range(0, length(b) + 1), lambda x: 0) as r from {name}_start
      union all
      select a, b, i + 1, list_transform(range(1, len(t) + 1), lambda j: list_max(t[1:j]))
      from (select a, b, i, list_transform(range(1, length(b) + 2), lambda j: case when j = 1 then 0
              else greatest(r[j], r[j - 1] + case when a[i + 1] = b[j - 1] then 1 else 0 end) end) as t
            from {name}_rows where i < length(a)) s),
    {name} as (
      select a, b, 100.0::double * (1.0::double - (length(a) + length(b) - 2 * list_last(r))::double / (length(a) + length(b))) as score
      from {name}_rows where i = length(a))"""


def list_text(c: str) -> str:
    return f"array_to_string({c}, '|')"


SETTINGS = Settings()

# The cleaned table, step by step.
NORMED = "normed as (select row_id, " + ", ".join(
    f"{norm(c)} as {c}" for c in ("prenom", "nom", "courriel", "num_tel", "date_naissance", "sexe", "wilaya", "matieres", "role", "city")
) + " from dirty)"

PROVINCE = (
    f"provinces(alias, canonical, ord) as ({values_of(SETTINGS.provinces)}), "
    "province_pairs as (select distinct lower(wilaya) as a, alias as b from normed, provinces where lower(wilaya) not in (select alias from provinces)), "
    + lcs_ctes("province_pairs", "province_ratios")
    + """, province_best as (
      select a, canonical, score, row_number() over (partition by a order by score desc, ord) as k
      from province_ratios join provinces on b = alias),
    province_of as (
      select alias as text, canonical from provinces
      union all select a, canonical from province_best where k = 1 and score >= 85.0)"""
)

SUBJECT = (
    f"subjects(alias, canonical, ord) as ({values_of(SETTINGS.subjects)}), "
    "items as (select row_id, pos, trim(item) as item from (select row_id, generate_subscripts(s, 1) as pos, unnest(s) as item "
    "from (select row_id, regexp_split_to_array(matieres, '[,;/|،]+') as s from normed) q) p where trim(item) <> ''), "
    "subject_pairs as (select distinct lower(item) as a, alias as b from items, subjects where lower(item) not in (select alias from subjects)), "
    + lcs_ctes("subject_pairs", "subject_ratios")
    + f""", subject_best as (
      select a, canonical, score, row_number() over (partition by a order by score desc, ord) as k
      from subject_ratios join subjects on b = alias),
    subject_of as (
      select alias as text, canonical from subjects
      union all select a, canonical from subject_best where k = 1 and score >= 85.0),
    chosen as (select row_id, pos, coalesce(canonical, {title('item')}) as value from items left join subject_of on lower(item) = text),
    firsts as (select row_id, min(pos) as pos, min_by(value, pos) as value from chosen group by row_id, lower(value)),
    preference_of as (select row_id, list(value order by pos) as preferences from firsts group by row_id)"""
)

CLEANED = f"""cleaned as (
  select n.row_id, {display('prenom')} as name, {display('nom')} as last, {email('courriel')} as email, {phone('num_tel')} as phoneNumber,
    {dob('date_naissance')} as DOB, {label_case('lower(sexe)', fv.GENDER_LABELS)} as gender, p.canonical as wilaya,
    coalesce(f.preferences, []) as preferences, {label_case('lower(role)', fv.USER_TYPE_LABELS)} as userType, {display('city')} as commune
  from normed n left join province_of p on lower(n.wilaya) = p.text left join preference_of f on n.row_id = f.row_id)"""

COMPOSED = f"composed as (select * exclude (name), {compose('name', 'last')} as name from cleaned)"


def with_ctes(*parts: str, select: str) -> str:
    return "with recursive " + ", ".join(parts) + " " + select


def dirty_cte() -> str:
    return f"dirty as ({DIRTY})"


BASE = [dirty_cte(), NORMED]
FULL = [*BASE, PROVINCE, SUBJECT, CLEANED]
NAMED = [*FULL, COMPOSED]
