"""Sources and header mapping."""

from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.catalog import sql as q
from recordloom.catalog.registry import SETTINGS, base, dirty, grid, headers, query, table
from recordloom.functions import text as tx
from recordloom.operators import mapping
from recordloom.operators.mapping import alias_fields
from recordloom.session import new_folder
from recordloom.sources import delimited, json_records, lookups
from recordloom.sources import grid as gr

DIRTY_COLUMNS = ["prenom", "nom", "courriel", "num_tel", "date_naissance", "sexe", "wilaya", "matieres", "role", "city"]
TRIMMED = "select cast(row_id as varchar) as row_id, " + ", ".join(f"trim({c}) as {c}" for c in DIRTY_COLUMNS) + " from dirty"


@query("read_csv_text", q.with_ctes(q.dirty_cte(), select=TRIMMED))
def read_csv_text(spark, folder):
    path = new_folder(spark, "csv")
    dirty(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return delimited.read_csv_text(spark, path)


@query("read_json_records", q.with_ctes(q.dirty_cte(), select=TRIMMED))
def read_json(spark, folder):
    path = new_folder(spark, "json")
    dirty(spark, folder).write.json(path)
    return json_records.read_json_records(spark, path, multi_line=False).select("row_id", *DIRTY_COLUMNS)


# Each customer as a file with three readings of its header line.
READINGS = """
select c_name as path, ord, encoding,
  case when ord = 0 then concat('nom,pr', case when c_custkey % 3 = 0 then '�' else 'é' end, 'nom')
       when ord = 1 then concat('nom,pr', case when c_custkey % 2 = 0 then '?' else 'Ã©' end, 'nom')
       else concat('nom,pr', 'Ã', case when c_custkey % 5 = 0 then ',tel,ville,a,b,c,d,e,f,g' else '' end) end as line
from (select c_name, c_custkey, 0 as ord, 'utf-8' as encoding from customer
      union all select c_name, c_custkey, 1, 'cp1252' from customer
      union all select c_name, c_custkey, 2, 'latin-1' from customer) r
"""
COUNT = "length({0}) - length(replace({0}, '{1}', ''))"
QUALITY = (
    "100 * len(string_split(line, ',')) - 500 * (" + COUNT.format("line", "�") + ") - 20 * (" + COUNT.format("line", "?") + ")"
)


@query("pick_encoding", q.with_ctes(f"readings as ({READINGS})", f"scored as (select *, {QUALITY} as score from readings)", select="""
select path, encoding, cast(score as bigint) as score from (
  select *, row_number() over (partition by path order by case when score >= 1000 then 0 else 1 end,
    case when score >= 1000 then 0 else -score end, ord) as k from scored) s where k = 1"""))
def pick_encoding(spark, folder):
    tried = base(spark, folder, READINGS, "customer").withColumn("headers", F.split("line", ",")).withColumn("splittable", F.lit(True))
    picked = delimited.pick_encoding(tried.withColumn("score", delimited.header_quality(F.col("headers"))))
    return picked.select("path", "encoding", F.col("score").cast("bigint").alias("score"))


@query("header_quality", q.with_ctes(f"readings as ({READINGS})", select=f"select path, ord, cast({QUALITY} as bigint) as score from readings"))
def header_quality(spark, folder):
    df = base(spark, folder, READINGS, "customer")
    return df.select("path", "ord", delimited.header_quality(F.split("line", ",")).cast("bigint").alias("score"))


CELLS = """
select event_id, case event_id % 6 when 0 then 'nan' when 1 then ' nan ' when 2 then 'None' when 3 then concat('  ', event_type) else event_type end as event_type,
  cast(user_id as string) as user_id from events
"""


@query("stringify_cells", q.with_ctes(f"cells as ({CELLS})", select="""
select cast(event_id as varchar) as event_id, trim(case when event_type in ('nan', 'None') then '' else event_type end) as event_type, user_id from cells"""))
def stringify(spark, folder):
    return delimited.stringify_cells(base(spark, folder, CELLS, "events"))


REPEAT = "case when try_cast({0} as bigint) is null or try_cast({0} as bigint) <= 0 then 1 else least(try_cast({0} as bigint), 5000) end"
GRID = f"grid as ({q.grid(False)})"
WIDE = f"wide as (select sheet_id, row_no, {REPEAT.format('row_repeat')} as repeat, flatten(list_transform(cells, lambda c: list_resize([c.text], {REPEAT.format('c.repeat')}, c.text))) as cells from grid)"
TRIM = "case when len(list_filter(cells, lambda c: c <> '')) = 0 then [] else cells[1:list_max(list_transform(range(1, len(cells) + 1), lambda i: case when cells[i] <> '' then i else 0 end))] end"
TIGHT = f"tight as (select sheet_id, row_no, repeat, {TRIM} as cells from wide)"
KEPT = """counted as (select *, len(cells) > 0 as filled,
    sum(case when len(cells) > 0 then 1 else 0 end) over (partition by sheet_id order by row_no) - case when len(cells) > 0 then 1 else 0 end as before from tight),
  runs as (select sheet_id, before, sum(repeat) as run from counted where not filled and before > 0 group by sheet_id, before),
  ends as (select sheet_id, min(before) as stop from runs where run >= 2000 group by sheet_id),
  kept as (select c.* from counted c left join ends e on c.sheet_id = e.sheet_id where filled and (stop is null or before < stop))"""
CAP = 500
WHOLE = """whole as (select sheet_id, row_no, unnest(range(1, repeat + 1)) as copy_no, cells from tight where len(cells) > 0)"""


@query("grid_expand_repeats", q.with_ctes(GRID, WIDE, select="select sheet_id, row_no, unnest(range(1, repeat + 1)) as copy_no, array_to_string(cells, '|') as cells from wide"))
def grid_expand_repeats(spark, folder):
    return gr.expand_repeats(grid(spark, folder), fv.MAX_REPEAT).withColumn("cells", F.array_join("cells", "|"))


@query("grid_trim_trailing", q.with_ctes(GRID, WIDE, TIGHT, select="select sheet_id, row_no, cast(len(cells) as bigint) as used, array_to_string(cells, '|') as cells from tight"))
def grid_trim_trailing(spark, folder):
    rows = gr.normal_rows(grid(spark, folder), fv.MAX_REPEAT)
    return rows.select("sheet_id", "row_no", F.size("cells").cast("bigint").alias("used"), F.array_join("cells", "|").alias("cells"))


@query("grid_drop_blank_rows", q.with_ctes(GRID, WIDE, TIGHT, KEPT, select="select sheet_id, row_no, cast(repeat as bigint) as repeat, array_to_string(cells, '|') as cells from kept"))
def grid_drop_blank_rows(spark, folder):
    kept = gr.drop_blank_rows(gr.normal_rows(grid(spark, folder), fv.MAX_REPEAT), fv.MAX_BLANK_RUN)
    return kept.select("sheet_id", "row_no", F.col("repeat").cast("bigint").alias("repeat"), F.array_join("cells", "|").alias("cells"))


@query("grid_row_cap", q.with_ctes(GRID, WIDE, TIGHT, WHOLE, select="select sheet_id, row_no, cast(copy_no as bigint) as copy_no, array_to_string(cells, '|') as cells from whole"))
def grid_row_cap(spark, folder):
    """Every filled row of every sheet, repeats written out; no limit is set, so nothing is cut."""
    rows = gr.cap_rows(gr.drop_blank_rows(gr.normal_rows(grid(spark, folder))))
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query("grid_cut_report", q.with_ctes(GRID, WIDE, TIGHT, KEPT, select=f"""
select sheet_id, cast(sum(case when len(cells) > 0 then repeat else 0 end) as bigint) as rows,
  (select cast(least({CAP}, coalesce(sum(repeat), 0)) as bigint) from kept k where k.sheet_id = tight.sheet_id) as kept
from tight group by sheet_id having sum(case when len(cells) > 0 then 1 else 0 end) > 0"""))
def grid_cut_report(spark, folder):
    return gr.cut_report(grid(spark, folder), fv.MAX_REPEAT, fv.MAX_BLANK_RUN, CAP)


@query("grid_promote_header", q.with_ctes(GRID, WIDE, TIGHT, WHOLE, """
  sheets as (select sheet_id, max(len(cells)) as width, min_by(cells, row_no * 10000 + copy_no) as head, min(row_no * 10000 + copy_no) as first from whole group by sheet_id),
  body as (select c.sheet_id, row_no, copy_no, unnest(range(0, width)) as position, cells, head from whole c join sheets s on c.sheet_id = s.sheet_id where row_no * 10000 + copy_no <> first)""",
    select="select sheet_id, row_no, copy_no, position, trim(coalesce(head[position + 1], '')) as header, trim(coalesce(cells[position + 1], '')) as value from body"))
def grid_promote_header(spark, folder):
    return gr.read_grid(grid(spark, folder)).withColumn("position", F.col("position").cast("bigint"))


@query("grid_table", q.with_ctes(GRID, WIDE, TIGHT, WHOLE, """
  sheets as (select sheet_id, max(len(cells)) as width, min_by(cells, row_no * 10000 + copy_no) as head, min(row_no * 10000 + copy_no) as first from whole group by sheet_id),
  heads as (select sheet_id, p, coalesce(nullif(trim(coalesce(head[p + 1], '')), ''), 'Unnamed: ' || p) as name from sheets, range(0, 1000) r(p) where p < width),
  names as (select sheet_id, p, name || case when n > 1 then '.' || (n - 1) else '' end as name
    from (select *, row_number() over (partition by sheet_id, name order by p) as n from heads) x)""",
    select="""select c.sheet_id, row_no, copy_no, string_agg(name || '=' || trim(coalesce(cells[p + 1], '')), ';' order by name) as filled
  from whole c join sheets s on c.sheet_id = s.sheet_id join names n on n.sheet_id = c.sheet_id where row_no * 10000 + copy_no <> first group by c.sheet_id, row_no, copy_no"""))
def grid_table(spark, folder):
    """Wide rows under their headers, written as name=value."""
    wide = gr.grid_table(grid(spark, folder))
    places = ("sheet_id", "row_no", "copy_no")
    names = sorted(c for c in wide.columns if c not in places)
    # One function for all columns: generated code for each of them would be a method too large to be compiled.
    cells = F.zip_with(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"`{c}`") for c in names]), lambda name, value: F.concat(name, F.lit("="), value))
    return wide.select(*places, F.array_join(cells, ";").alias("filled"))


# A lookup document per supplier, in the four accepted shapes.
LOOKUPS = """
select s_suppkey as doc, concat('{"Math', cast(s_suppkey % 7 as string), '": ["MATHS", " math ", "nan"], "Phys": {"aliases": ["physique", "', s_name, '"]}, "',
  s_name, '": "Supplier ', cast(s_suppkey as string), '", "Other": ', case when s_suppkey % 2 = 0 then 'null' else '12' end, ', "Late": ["', s_name, '"]}') as body from supplier
"""
LOOKUP_ROWS = """
select doc, alias, canonical from (
  select s_suppkey as doc, lower(concat('Math', cast(s_suppkey % 7 as varchar))) as alias, concat('Math', cast(s_suppkey % 7 as varchar)) as canonical from supplier
  union all select s_suppkey, 'maths', concat('Math', cast(s_suppkey % 7 as varchar)) from supplier
  union all select s_suppkey, 'math', concat('Math', cast(s_suppkey % 7 as varchar)) from supplier
  union all select s_suppkey, 'phys', 'Phys' from supplier
  union all select s_suppkey, 'physique', 'Phys' from supplier
  union all select s_suppkey, lower(s_name), 'Late' from supplier
  union all select s_suppkey, lower(concat('Supplier ', cast(s_suppkey as varchar))), concat('Supplier ', cast(s_suppkey as varchar)) from supplier
  union all select s_suppkey, 'other', 'Other' from supplier
  union all select s_suppkey, 'late', 'Late' from supplier) x
"""


@query("load_lookup", LOOKUP_ROWS)
def load_lookup(spark, folder):
    entries = lookups.entries_of(base(spark, folder, LOOKUPS, "supplier"), "body", ["doc"])
    return lookups.flatten_lookup(entries, ["doc"]).select("doc", "alias", "canonical")


@query("load_field_aliases", """
select s_suppkey as doc, unnest([concat('Math', cast(s_suppkey % 7 as varchar)), 'Phys', s_name, 'Other', 'Late']) as field,
  unnest(['MATHS|math', concat('physique|', s_name), '', '', s_name]) as aliases from supplier""")
def load_field_aliases(spark, folder):
    entries = lookups.entries_of(base(spark, folder, LOOKUPS, "supplier"), "body", ["doc"])
    return lookups.flatten_field_aliases(entries, ["doc"]).select("doc", "field", F.array_join("aliases", "|").alias("aliases"))


# ---------------------------------------------------------------- header mapping

HEAD = f"heads as ({q.HEADERS})"
KEY = "keyed as (select *, trim(regexp_replace(lower(strip_accents(replace(header, '�', ' '))), '\\s+', ' ', 'g')) as key from heads)"


def _in(words):
    return ", ".join(q.quoted(w) for w in words)


LETTERS = "regexp_replace(key, '[^\\p{L}\\p{N}]', '', 'g')"
RULE = f"case when {LETTERS} in ({_in(fv.FIRST_NAME_TOKENS)}) then 'name' when {LETTERS} in ({_in(fv.LAST_NAME_TOKENS)}) then 'last' end"
FAMILY = (
    f"family as (select k.*, coalesce(m.file_id is not null and key in ({_in(fv.FAMILY_NAME_HEADERS)}), false) as family from keyed k "
    f"left join (select distinct file_id from keyed where key in ({_in(fv.FIRST_NAME_MARKERS)})) m on k.file_id = m.file_id)"
)
MAPPED = (
    f"fields(alias, canonical, ord) as ({q.values_of(alias_fields(fv.FIELD_ALIASES))}), "
    f"ruled as (select f.*, {RULE} as rule, e.canonical as equal from family f left join fields e on f.key = e.alias), "
    "pairs as (select distinct key as a, alias as b from ruled, fields where not family and rule is null and equal is null and length(key) > 3), "
    + q.lcs_ctes("pairs")
    + """, near as (select a, b, canonical, score, row_number() over (partition by a order by score desc, ord) as k from ratios join fields on b = alias),
    mapped as (select file_id, position, header,
      case when family then 'last' when rule is not null then rule when equal is not null then equal when score >= 85.0 then canonical end as field,
      case when family then 100.0 when rule is not null then 99.0 when equal is not null then 100.0 else coalesce(score, 0.0) end as score,
      case when family then 'french_name_rule' when rule is not null then 'name_header_heuristic' when equal is not null then key else coalesce(b, '') end as alias
      from ruled left join near on key = a and k = 1 and not family and rule is null and equal is null)"""
)


@query("normalize_header", q.with_ctes(HEAD, KEY, select="select file_id, position, key from keyed"))
def normalize_header(spark, folder):
    return headers(spark, folder).select("file_id", "position", tx.normalize_header(F.col("header")).alias("key"))


@query("name_header_rule", q.with_ctes(HEAD, KEY, select=f"select file_id, position, {RULE} as field from keyed"))
def name_header_rule(spark, folder):
    key = tx.normalize_header(F.col("header"))
    return headers(spark, folder).select("file_id", "position", mapping.name_header_rule(key).alias("field"))


@query("french_name_rule", q.with_ctes(HEAD, KEY, FAMILY, select="select file_id, position, header from family where family"))
def french_name_rule(spark, folder):
    return mapping.french_name_rule(headers(spark, folder)).where("family").select("file_id", "position", "header")


@query("map_columns", q.with_ctes(HEAD, KEY, FAMILY, MAPPED, select="select file_id, position, header, field, round(score, 6) as score, alias from mapped"))
def map_columns(spark, folder):
    mapped = mapping.map_headers(headers(spark, folder), SETTINGS)
    return mapped.withColumn("score", F.round("score", 6))


@query("mapping_audit", q.with_ctes(HEAD, KEY, FAMILY, MAPPED, select="""
select file_id, position, header as original_column, field as mapped_column, round(score, 6) as score, alias as matched_alias from mapped where field is not null"""))
def mapping_audit(spark, folder):
    return mapping.mapping_audit(mapping.map_headers(headers(spark, folder), SETTINGS)).withColumn("score", F.round("score", 6))


TWO_MAILS = """
select c_custkey as row_id, case when c_custkey % 3 = 0 then '' else concat('a', cast(c_custkey as string), '@x.dz') end as mail,
  case when c_custkey % 2 = 0 then '' else concat('b', cast(c_custkey as string), '@x.dz') end as courriel, c_name as fullname from customer
"""


@query("collapse_columns", q.with_ctes(f"two as ({TWO_MAILS})", select="select row_id, coalesce(nullif(mail, ''), nullif(courriel, ''), '') as email, fullname as name from two"))
def collapse_columns(spark, folder):
    df = base(spark, folder, TWO_MAILS, "customer")
    return mapping.map_columns(df, SETTINGS)[0]
