"""Field standardisation, similarity and dictionary matching."""

from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.catalog import sql as q
from recordloom.catalog.registry import SETTINGS, base, dirty, query, table
from recordloom.functions import dates, fields, similarity, structs
from recordloom.functions import text as tx
from recordloom.operators import cleaning, lookup
from recordloom.operators.dedup import composite_score
from recordloom.session import materialise


def both_texts(spark, folder, rule):
    """A text rule over the whole of documents and conversations."""
    docs = table(spark, folder, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    talk = table(spark, folder, "conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), "text")
    return docs.unionByName(talk).select("kind", "id", "turn", rule(F.col("text")).alias("text"))


def texts_sql(expression: str) -> str:
    return (
        "select kind, id, turn, " + expression + " as text from (select 'd' as kind, doc_id as id, cast(0 as bigint) as turn, text from documents "
        "union all select 'c', conv_id, cast(turn as bigint), text from conversations) x"
    )


def over_dirty(columns, names=("row_id",)):
    def run(spark, folder):
        return dirty(spark, folder).select(*names, *[c.alias(n) for n, c in columns().items()])

    return run


def dirty_sql(select: str) -> str:
    return q.with_ctes(*q.BASE, select=select)


@query("normalize_text", texts_sql("md5(" + q.norm("text") + ")"))
def normalize_text(spark, folder):
    return both_texts(spark, folder, lambda c: F.md5(tx.normalize_text(c)))


@query("has_arabic", dirty_sql(f"select row_id, {q.is_arabic('wilaya')} as wilaya, {q.is_arabic('sexe')} as sexe from normed"))
def has_arabic(spark, folder):
    return dirty(spark, folder).select("row_id", *[tx.has_arabic(tx.normalize_text(F.col(c))).alias(c) for c in ("wilaya", "sexe")])


TITLES = "select p_partkey, concat(lower(p_name), '-', upper(p_type), ' o''', p_brand) as label from part"


@query("smart_title", q.with_ctes(f"titles as ({TITLES})", select=f"select p_partkey, {q.title(q.norm('label'))} as label from titles"))
def smart_title(spark, folder):
    return base(spark, folder, TITLES, "part").select("p_partkey", tx.smart_title(tx.normalize_text(F.col("label"))).alias("label"))


@query("clean_name", dirty_sql(f"select row_id, {q.display('prenom')} as name from normed"))
def clean_name(spark, folder):
    return dirty(spark, folder).select("row_id", fields.clean_name(F.col("prenom")).alias("name"))


@query("clean_last", dirty_sql(f"select row_id, {q.display('nom')} as last from normed"))
def clean_last(spark, folder):
    return dirty(spark, folder).select("row_id", fields.clean_last(F.col("nom")).alias("last"))


@query("clean_commune", dirty_sql(f"select row_id, {q.display('city')} as commune from normed"))
def clean_commune(spark, folder):
    return dirty(spark, folder).select("row_id", fields.clean_commune(F.col("city")).alias("commune"))


@query("clean_username", dirty_sql(f"select row_id, {q.username('courriel')} as username, {q.username('role')} as role from normed"))
def clean_username(spark, folder):
    return dirty(spark, folder).select(
        "row_id", fields.clean_username(F.col("courriel")).alias("username"), fields.clean_username(F.col("role")).alias("role"))


@query("clean_email", dirty_sql(f"select row_id, {q.email('courriel')} as email from normed"))
def clean_email(spark, folder):
    return dirty(spark, folder).select("row_id", fields.clean_email(F.col("courriel")).alias("email"))


@query("clean_phone", dirty_sql(f"select row_id, {q.phone('num_tel')} as phone from normed"))
def clean_phone(spark, folder):
    return dirty(spark, folder).select("row_id", fields.clean_phone(F.col("num_tel")).alias("phone"))


@query("clean_dob", dirty_sql(f"select row_id, {q.dob('date_naissance')} as dob from normed"))
def clean_dob(spark, folder):
    return dirty(spark, folder).select("row_id", dates.clean_dob(F.col("date_naissance"), SETTINGS.as_of).alias("dob"))


# First names with a gender, as a user would supply them; those of six letters are of unknown gender.
NAMES = """
select first_name, case when length(first_name) = 6 then 'unknown' when length(first_name) % 2 = 0 then 'mostly_female' else 'male' end as gender
from (select distinct lower(trim(prenom)) as first_name from dirty where trim(prenom) <> '') x
"""
GENDER_IN = """
select row_id, case when row_id % 3 = 0 then sexe else prenom end as label from dirty
"""


def names_table(spark, folder):
    dirty(spark, folder).createOrReplaceTempView("dirty")
    return spark.sql(NAMES)


@query("clean_gender", q.with_ctes(q.dirty_cte(), f"names as ({NAMES})", f"labels as ({GENDER_IN})", f"texts as (select row_id, lower({q.norm('label')}) as label from labels)", select=f"""
select row_id, coalesce({q.label_case('label', fv.GENDER_LABELS)}, case gender when 'mostly_female' then 'female' when 'male' then 'male' end) as gender
from texts left join names on label = first_name"""))
def clean_gender(spark, folder):
    names = names_table(spark, folder)
    labelled = spark.sql(GENDER_IN).withColumn("_text", tx.normalize_text(F.col("label")))
    known = labelled.withColumn("gender", fields.gender_label_of(F.col("_text")))
    return cleaning.gender_from_names(known, names, "_text", "gender").select("row_id", "gender")


@query("clean_user_type", dirty_sql(f"select row_id, {q.label_case('lower(role)', fv.USER_TYPE_LABELS)} as user_type from normed"))
def clean_user_type(spark, folder):
    return dirty(spark, folder).select("row_id", fields.clean_user_type(F.col("role")).alias("user_type"))


SCHOOLS = """
select c_custkey as row_id, case c_custkey % 9 when 0 then ' Privé ' when 1 then 'universite prive' when 2 then 'CRECHE' when 3 then 'جامعة'
  when 4 then 'cours  de soutien' when 5 then 'Etatique' when 6 then 'school' when 7 then 'ecole de langue' else c_mktsegment end as kind from customer
"""


@query("clean_school_type", q.with_ctes(f"schools as ({SCHOOLS})", select=f"select row_id, {q.label_case('lower(' + q.norm('kind') + ')', fv.SCHOOL_TYPE_LABELS)} as school_type from schools"))
def clean_school_type(spark, folder):
    return base(spark, folder, SCHOOLS, "customer").select("row_id", fields.clean_school_type(F.col("kind")).alias("school_type"))


URLS = "select page_id, case page_id % 4 when 0 then upper(url) when 1 then concat(' ', url) else url end as url from pages"


@query("clean_url", q.with_ctes(f"urls as ({URLS})", select=f"select page_id, case when starts_with({q.norm('url')}, 'http://') or starts_with({q.norm('url')}, 'https://') then {q.norm('url')} end as url from urls"))
def clean_url(spark, folder):
    return base(spark, folder, URLS, "pages").select("page_id", fields.clean_url(F.col("url")).alias("url"))


@query("clean_free_text", texts_sql("nullif(" + q.norm("text") + ", '')"))
def clean_free_text(spark, folder):
    return both_texts(spark, folder, fields.clean_free_text)


@query("clean_province", q.with_ctes(*q.BASE, q.PROVINCE, select="select row_id, canonical as wilaya from normed left join province_of on lower(wilaya) = text"))
def clean_province(spark, folder):
    text = tx.normalize_text(F.col("wilaya"))
    return dirty(spark, folder).select("row_id", lookup.fuzzy_lookup(text, SETTINGS.provinces).alias("wilaya"))


@query("clean_preferences", q.with_ctes(*q.BASE, q.SUBJECT, select=f"select n.row_id, {q.list_text('coalesce(preferences, [])')} as preferences from normed n left join preference_of p on n.row_id = p.row_id"))
def clean_preferences(spark, folder):
    text = tx.normalize_text(F.col("matieres"))
    return dirty(spark, folder).select("row_id", F.array_join(lookup.clean_preferences(text, SETTINGS.subjects), "|").alias("preferences"))


WORDS = "select event_id, case event_id % 5 when 0 then ' NaN ' when 1 then 'none' when 2 then concat(' ', upper(event_type), ' ') when 3 then null else event_type end as word from events"


@query("optional_text", q.with_ctes(f"words as ({WORDS})", select=f"select event_id, {q.optional('word')} as word from words"))
def optional_text(spark, folder):
    return base(spark, folder, WORDS, "events").select("event_id", tx.optional_text(F.col("word")).alias("word"))


@query("text_lower", q.with_ctes(f"words as ({WORDS})", select=f"select event_id, lower({q.filled('word')}) as word from words"))
def text_lower(spark, folder):
    return base(spark, folder, WORDS, "events").select("event_id", tx.text_lower(F.col("word")).alias("word"))


@query("is_missing", q.with_ctes(f"words as ({WORDS})", select=f"select event_id, {q.optional('word')} = '' as missing from words"))
def is_missing(spark, folder):
    from recordloom.operators.inference import is_missing as rule

    return base(spark, folder, WORDS, "events").select("event_id", rule(F.col("word")).alias("missing"))


@query("to_double", "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as bad from events")
def to_double(spark, folder):
    props = F.from_json("props", "map<string,string>")
    return table(spark, folder, "events").select(
        "event_id", fields.to_double(F.try_element_at(props, F.lit("k"))).alias("k"), fields.to_double(F.col("event_type")).alias("bad"))


LINKS = "select event_id, case event_id % 3 when 0 then '{\"web\": \" x \", \"none\": \"null\"}' when 1 then '{\"a\": \"\"}' else props end as props from events"


@query("clean_map", q.with_ctes(f"links as ({LINKS})", select="""
select event_id, case event_id % 3 when 0 then 'web=x' when 1 then null else 'k=' || json_extract_string(props, '$.k') end as links from links"""))
def clean_map(spark, folder):
    cleaned = structs.clean_map(F.from_json("props", "map<string,string>"))
    text = F.array_join(F.transform(F.map_entries(cleaned), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return base(spark, folder, LINKS, "events").select("event_id", text.alias("links"))


PLACES = """
select row_id, case when row_id % 7 = 0 then ' somewhere ' end as location, case when row_id % 3 = 0 then 'nan' else wilaya end as wilaya,
  case when row_id % 2 = 0 then '' else city end as commune from dirty
"""
PLACE = f"""places as ({PLACES}), tidy as (select row_id, {q.optional('wilaya')} as w, {q.optional('commune')} as c, {q.optional('location')} as l from places),
  whole as (select *, case when l <> '' then l else array_to_string(list_filter([w, c], lambda x: x <> ''), ', ') end as f from tidy)"""


def places(spark, folder):
    dirty(spark, folder).createOrReplaceTempView("dirty")
    return spark.sql(PLACES)


@query("build_location", q.with_ctes(q.dirty_cte(), PLACE, select="""
select row_id, case when f <> '' then w end as wilaya, case when f <> '' then c end as commune, nullif(f, '') as full_location, cast(null as double) as lat from whole"""))
def build_location(spark, folder):
    place = structs.build_location(F.col("location"), F.col("wilaya"), F.col("commune"))
    return places(spark, folder).select("row_id", place.alias("p")).select(
        "row_id", "p.wilaya", "p.commune", F.col("p.fullLocation").alias("full_location"), F.col("p.coordinates.lat").alias("lat"))


@query("compose_name", q.with_ctes(*q.FULL, q.COMPOSED, select="select row_id, name from composed"))
def compose_name(spark, folder):
    df = dirty(spark, folder).select("row_id", fields.clean_name(F.col("prenom")).alias("name"), fields.clean_last(F.col("nom")).alias("last"))
    return df.select("row_id", fields.compose_name(F.col("name"), F.col("last")).alias("name"))


@query("slugify", dirty_sql(f"select row_id, {q.slug('role')} as role, {q.slug('courriel')} as mail from normed"))
def slugify(spark, folder):
    return dirty(spark, folder).select("row_id", tx.slugify(F.col("role")).alias("role"), tx.slugify(F.col("courriel")).alias("mail"))


def cleaned_table(spark, folder):
    from recordloom.operators.mapping import map_columns

    return cleaning.clean_table(map_columns(dirty(spark, folder), SETTINGS)[0], SETTINGS)


@query("clean_table", q.with_ctes(*q.FULL, select="""
select row_id, name, last, email, phoneNumber, DOB, gender, wilaya, array_to_string(preferences, '|') as preferences, userType, commune,
  array_to_string(list_filter([wilaya, commune], lambda x: x is not null), ', ') as location from cleaned"""))
def clean_table(spark, folder):
    df = cleaned_table(spark, folder)
    return df.withColumn("preferences", F.array_join("preferences", "|")).withColumn("location", F.coalesce(F.col("location.fullLocation"), F.lit("")))


# ---------------------------------------------------------------- similarity

NEIGHBOURS = """
select p_partkey, lower(concat(p_name, ' ', p_type)) as a, lower(concat(p_type, ' ', p_brand, case when p_partkey % 3 = 0 then '' else p_name end)) as b from part
"""


@query("indel_ratio", q.with_ctes(f"pairs as ({NEIGHBOURS})", q.lcs_ctes("pairs"), select="select p_partkey, round(score, 9) as score from pairs p join ratios r on p.a = r.a and p.b = r.b"))
def indel_ratio(spark, folder):
    return base(spark, folder, NEIGHBOURS, "part").select("p_partkey", F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 9).alias("score"))


TYPOS = "select p_partkey, case when p_partkey % 4 = 0 then lower(p_type) else concat(substr(p_type, 1, cast(p_partkey % length(p_type) as int)), substr(p_type, cast(p_partkey % length(p_type) as int) + 2)) end as typed from part"
PART_TYPES = {t.lower(): t for t in ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]}


@query("fuzzy_lookup", q.with_ctes(f"typos as ({TYPOS})", f"types(alias, canonical, ord) as ({q.values_of(PART_TYPES)})",
    "pairs as (select distinct lower(typed) as a, alias as b from typos, types)", q.lcs_ctes("pairs"),
    "best as (select a, canonical, score, row_number() over (partition by a order by score desc, ord) as k from ratios join types on b = alias)",
    select="select p_partkey, canonical as part_type from typos left join best on lower(typed) = a and k = 1 and score >= 85.0"))
def fuzzy_lookup(spark, folder):
    typed = base(spark, folder, TYPOS, "part")
    return typed.select("p_partkey", lookup.fuzzy_lookup(tx.normalize_text(F.col("typed")), PART_TYPES).alias("part_type"))


@query("fuzzy_lookup_large", q.with_ctes(f"typos as ({TYPOS})", "types as (select lower(p_type) as alias, min(p_type) as canonical, min(p_partkey) as ord from part group by 1)",
    "pairs as (select distinct lower(typed) as a, alias as b from typos, types)", q.lcs_ctes("pairs"),
    "best as (select a, canonical, score, row_number() over (partition by a order by score desc, ord) as k from ratios join types on b = alias)",
    select="select a as typed, canonical, round(score, 6) as score from best where k = 1 and score >= 85.0"))
def fuzzy_lookup_large(spark, folder):
    typed = base(spark, folder, TYPOS, "part").select(F.lower("typed").alias("typed"))
    known = table(spark, folder, "part").groupBy(F.lower("p_type").alias("alias")).agg(F.min("p_type").alias("canonical"), F.min("p_partkey").alias("ord"))
    return lookup.match_large_lookup(typed, "typed", known).withColumn("score", F.round("score", 6))


# Each person beside the one with the next number.
BESIDE = "select l.row_id, {l}, {r} from {t} l join {t} r on r.row_id = l.row_id + 1"
SIDES = ("name", "phoneNumber", "DOB", "email")
BESIDE_SQL = BESIDE.format(t="composed", l=", ".join(f"l.{c} as l_{c}" for c in SIDES), r=", ".join(f"r.{c} as r_{c}" for c in SIDES))


def scored_ctes():
    parts = [*q.NAMED, f"beside as materialized ({BESIDE_SQL})"]
    parts.append("texts as (" + " union all ".join(f"select lower(l_{c}) as a, lower(r_{c}) as b from beside where lower(l_{c}) <> lower(r_{c})" for c in ("name", "phoneNumber", "email")) + ")")
    parts.append(q.lcs_ctes("texts"))

    def similar(c):
        return f"case when coalesce(l_{c}, '') = '' or coalesce(r_{c}, '') = '' then 0.0 when lower(l_{c}) = lower(r_{c}) then 100.0 else (select score from ratios where a = lower(l_{c}) and b = lower(r_{c})) end"

    parts.append(
        "scored as (select row_id, " + ", ".join(f"{similar(c)} as {n}" for c, n in (("name", "name_score"), ("phoneNumber", "phone_score"), ("email", "email_score")))
        + ", case when l_DOB = r_DOB then 100.0 else 0.0 end as dob_score from beside)")
    return parts


def composed_rows(spark, folder):
    """The cleaned people with their full names, for queries that read them once: no more columns are computed than they read."""
    return cleaning.compose_display_name(cleaned_table(spark, folder), SETTINGS)


def composed_table(spark, folder):
    """The same, written once for queries that read it several times."""
    return materialise(composed_rows(spark, folder), "composed")


def beside(spark, folder):
    df = composed_table(spark, folder).select("row_id", *SIDES)
    left = df.select("row_id", *[F.col(c).alias(f"l_{c}") for c in SIDES])
    right = df.select((F.col("row_id") - 1).alias("row_id"), *[F.col(c).alias(f"r_{c}") for c in SIDES])
    return left.join(right, "row_id")


def pair_scores(df):
    return df.select(
        "row_id",
        similarity.field_similarity(F.col("l_name"), F.col("r_name")).alias("name_score"),
        similarity.field_similarity(F.col("l_phoneNumber"), F.col("r_phoneNumber")).alias("phone_score"),
        similarity.equality_similarity(F.col("l_DOB"), F.col("r_DOB")).alias("dob_score"),
        similarity.field_similarity(F.col("l_email"), F.col("r_email")).alias("email_score"),
    )


@query("field_similarity", q.with_ctes(*scored_ctes(), select="select row_id, round(name_score, 6) as name_score, round(phone_score, 6) as phone_score, round(email_score, 6) as email_score from scored"))
def field_similarity(spark, folder):
    scored = pair_scores(beside(spark, folder))
    return scored.select("row_id", *[F.round(c, 6).alias(c) for c in ("name_score", "phone_score", "email_score")])


@query("equality_similarity", q.with_ctes(*scored_ctes(), select="select row_id, dob_score from scored"))
def equality_similarity(spark, folder):
    return beside(spark, folder).select("row_id", similarity.equality_similarity(F.col("l_DOB"), F.col("r_DOB")).alias("dob_score"))


@query("composite_score", q.with_ctes(*scored_ctes(), select="select row_id, round(name_score * 0.4::double + phone_score * 0.3::double + dob_score * 0.2::double + email_score * 0.1::double, 6) as score from scored"))
def composite(spark, folder):
    parts = {"name": F.col("name_score"), "phoneNumber": F.col("phone_score"), "DOB": F.col("dob_score"), "email": F.col("email_score")}
    scored = pair_scores(beside(spark, folder))
    return scored.select("row_id", F.round(composite_score(parts, SETTINGS.duplicate_weights), 6).alias("score"))
