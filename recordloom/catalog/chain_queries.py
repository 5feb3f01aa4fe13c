"""Duplicates, inference, outliers, validation and outputs."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.catalog import sql as q
from recordloom.catalog.field_queries import NAMES, beside, cleaned_table, composed_rows, composed_table, names_table, pair_scores, scored_ctes
from recordloom.catalog.registry import SETTINGS, base, dirty, query, table
from recordloom.functions import dates, structs
from recordloom.functions import text as tx
from recordloom.operators import anomaly, dedup, inference, validation
from recordloom.operators.mapping import map_columns
from recordloom.operators.ordering import exact_percentile
from recordloom.plans.run import count_stages, run
from recordloom.session import materialise, new_folder, run_scope
from recordloom.sources import sinks

# ---------------------------------------------------------------- duplicates


@query("strong_signal", q.with_ctes(*scored_ctes(), select="select row_id, phone_score >= 95.0 or dob_score >= 100.0 or name_score >= 92.0 as strong from scored"))
def strong_signal(spark, folder):
    fields = ("name", "phoneNumber", "DOB")
    df = beside(spark, folder)
    signal = dedup.strong_signal({f: F.col(f"l_{f}") for f in fields}, {f: F.col(f"r_{f}") for f in fields})
    return df.select("row_id", signal.alias("strong"))


# People whose e-mail is shared by several: confirmed copies, reused placeholders, strangers.
SHARED = """
select row_id, name, phoneNumber, DOB, case when row_id % 10 in (0, 3) then concat('office', cast(row_id % 40 as string), '@x.dz') else email end as email, wilaya, commune from composed
"""


def shared_table(spark, folder):
    composed_table(spark, folder).createOrReplaceTempView("composed")
    return spark.sql(SHARED)


def sim(a, b, ratios):
    return (f"case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 0.0 when lower({a}) = lower({b}) then 100.0 "
            f"else coalesce((select score from {ratios} z where z.a = lower({a}) and z.b = lower({b})), 0.0) end")


EXACT = [
    *q.NAMED,
    f"shared as materialized ({SHARED})",
    """grouped as materialized (select *, count(*) over (partition by email) as n, min(row_id) over (partition by email) as first_id from shared where coalesce(email, '') <> ''),
  numbers as (select email, row_number() over (order by email) as number from (select distinct email from grouped where n > 1) u),
  against as materialized (select g.row_id, g.email, c.row_id as first_id, g.name as r_name, c.name as l_name, g.phoneNumber as r_phone, c.phoneNumber as l_phone, g.DOB as r_dob, c.DOB as l_dob
    from grouped g join shared c on g.first_id = c.row_id where g.n > 1 and g.row_id <> g.first_id),
  exact_pairs as (select lower(l_name) as a, lower(r_name) as b from against union all select lower(l_phone), lower(r_phone) from against)""",
    q.lcs_ctes("exact_pairs", "exact_ratios"),
    f"""duplicates as materialized (select row_id, email, first_id from against where l_dob = r_dob
      or {sim('l_phone', 'r_phone', 'exact_ratios')} >= 95.0 or {sim('l_name', 'r_name', 'exact_ratios')} >= 92.0),
  involved as (select row_id, email from duplicates union select first_id, email from duplicates),
  flagged as materialized (select s.*, d.row_id is not null as is_duplicate, d.first_id as canonical_row_index,
      case when i.row_id is not null then printf('dup_%06d', number) else '' end as group_id,
      case when i.row_id is not null then 100.0 else 0.0 end as duplicate_score,
      case when i.row_id is not null then 'exact_email_match' else '' end as duplicate_reason
    from shared s left join duplicates d on s.row_id = d.row_id left join involved i on s.row_id = i.row_id left join numbers n on s.email = n.email),
  survivors as materialized (select * from flagged where not is_duplicate)""",
]


def exact_flags(spark, folder):
    return dedup.exact_email(shared_table(spark, folder), SETTINGS)


@query("dedup_exact_email", q.with_ctes(*EXACT, select="select row_id, email, canonical_row_index from flagged where is_duplicate"))
def dedup_exact_email(spark, folder):
    return exact_flags(spark, folder).flagged.where("_is_duplicate").select("row_id", "email", "canonical_row_index")


@query("dup_metadata", q.with_ctes(*EXACT, select="select row_id, group_id, duplicate_score, duplicate_reason from flagged"))
def dup_metadata(spark, folder):
    return exact_flags(spark, folder).flagged.select(
        "row_id", F.col("_duplicate_group_id").alias("group_id"), F.col("_duplicate_score").alias("duplicate_score"),
        F.col("_duplicate_reason").alias("duplicate_reason"))


@query("block_key", q.with_ctes(*q.NAMED, select="select row_id, case when wilaya is not null then lower(wilaya) when commune is not null then '{''wilaya' else '' end as block, case when wilaya is not null then lower(wilaya) else coalesce(lower(commune), '') end as text_block from composed"))
def block_key(spark, folder):
    df = composed_table(spark, folder)
    # Beside the struct that cleaning makes, a location of plain text, blank in its several spellings.
    text = F.coalesce("commune", F.element_at(F.array(F.lit(""), F.lit("nan"), F.lit(" None "), F.lit(None)), (F.col("row_id") % 4 + 1).cast("int")))
    return df.select("row_id", dedup.block_key(F.col("wilaya"), F.col("location").isNotNull()).alias("block"),
                     dedup.block_key(F.col("wilaya"), F.lit(False), text).alias("text_block"))


FUZZY = [
    *EXACT,
    "blocked as materialized (select *, case when wilaya is not null then lower(wilaya) else '' end as block from survivors)",
    """near as materialized (select l.row_id as left_id, r.row_id as right_id, l.name as l_name, r.name as r_name, l.phoneNumber as l_phone, r.phoneNumber as r_phone, l.email as l_email, r.email as r_email
    from blocked l join blocked r on l.DOB = r.DOB and l.row_id < r.row_id and (l.block = r.block or l.block = '' or r.block = '')
    where coalesce(l.name, '') <> '' and coalesce(r.name, '') <> '' and coalesce(l.phoneNumber, '') <> '' and coalesce(r.phoneNumber, '') <> ''),
  near_pairs as (select lower(l_name) as a, lower(r_name) as b from near where lower(l_name) <> lower(r_name)
    union all select l_phone, r_phone from near where l_phone <> r_phone union all select l_email, r_email from near where l_email <> r_email)""",
    q.lcs_ctes("near_pairs", "near_ratios"),
    f"""near_scores as materialized (select *, {sim('l_name', 'r_name', 'near_ratios')} as n, {sim('l_phone', 'r_phone', 'near_ratios')} as p, {sim('l_email', 'r_email', 'near_ratios')} as e from near),
  fuzzy as materialized (select *, n * 0.4::double + p * 0.3::double + 100.0 * 0.2::double + e * 0.1::double as score from near_scores),
  links as materialized (select *, row_number() over (order by left_id, right_id) + (select count(*) from numbers) as number,
      array_to_string(list_filter([case when l_email = r_email then 'email_match' end, case when n >= 90 then 'name_match' end, case when p >= 90 then 'phone_match' end,
        'dob_match', printf('score=%.2f', score)], lambda x: x is not null), ',') as reason from fuzzy where score >= 85.0)""",
]


def deduped(spark, folder):
    return dedup.find_duplicates(shared_table(spark, folder), SETTINGS)


@query("fuzzy_pairs", q.with_ctes(*FUZZY, select="select left_id, right_id, round(score, 6) as score from links"))
def fuzzy_pairs(spark, folder):
    return deduped(spark, folder).pairs.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("dup_group_ids", q.with_ctes(*FUZZY, select="select printf('dup_%06d', number) as group_id, left_id, right_id from links union all select group_id, canonical_row_index, row_id from flagged where is_duplicate"))
def dup_group_ids(spark, folder):
    result = deduped(spark, folder)
    exact = result.review.where("_duplicate_reason = 'exact_email_match' and duplicate_reason = 'exact_email_match'")
    return result.pairs.select("group_id", "left_id", "right_id").unionByName(
        exact.select(F.col("duplicate_group_id").alias("group_id"), F.col("canonical_row_index").alias("left_id"), F.col("row_id").alias("right_id")))


@query("dup_reason", q.with_ctes(*FUZZY, select="select left_id, right_id, reason from links"))
def dup_reason(spark, folder):
    return deduped(spark, folder).pairs.select("left_id", "right_id", "reason")


REVIEW = """select row_id, name, email, group_id, duplicate_reason, canonical_row_index from flagged where is_duplicate
  union all select s.row_id, s.name, s.email, printf('dup_%06d', number), reason, left_id from links join survivors s on s.row_id in (left_id, right_id)"""


@query("dup_review_rows", q.with_ctes(*FUZZY, select=REVIEW))
def dup_review_rows(spark, folder):
    return deduped(spark, folder).review.select(
        "row_id", "name", "email", F.col("duplicate_group_id").alias("group_id"), "duplicate_reason", "canonical_row_index")


@query("dedup_split", q.with_ctes(*EXACT, select="select row_id, name, email, group_id from survivors"))
def dedup_split(spark, folder):
    return deduped(spark, folder).survivors.select("row_id", "name", "email", F.col("_duplicate_group_id").alias("group_id"))


# ---------------------------------------------------------------- inference

LOCAL = "regexp_replace(translate(split_part({0}, '@', 1), '._', '  '), '\\d+', '', 'g')"
INFER = [
    *q.NAMED,
    f"named as materialized (select *, coalesce(name, case when contains(email, '@') then {q.filled(LOCAL.format('email'))} end) as base from composed)",
    f"whole as materialized (select *, {q.compose('base', 'last')} as whole from named)",
    f"""asked as (select *, case when whole is not null then case when s in ('', 'user') then 'user_' || {q.suffix('row_id')} else s end end as candidate
      from (select *, {q.slug("split_part(whole, ' ', 1) || case when contains(whole, ' ') then ' ' || " + q.last_word('whole') + " else '' end")} as s from whole) y)""",
    """served as (select *, row_number() over (partition by candidate order by row_id) - 1 as k from asked),
    users as materialized (select *, case when candidate is null then null when k = 0 then candidate else candidate || '_' || lpad(cast(k as varchar), 2, '0') end as username from served)""",
    f"""mailed as materialized (select * exclude (email), email as old_email, coalesce(email, case when coalesce(whole, username) is not null then
      replace(coalesce(nullif({q.slug('coalesce(whole, username)')}, ''), 'user'), '_', '.') || '.' || {q.suffix('row_id')} || '@gmail.com' end) as email from users),
    filled as materialized (select row_id, coalesce(name, whole) as name, coalesce(last, {q.last_word('whole')}) as last, username, email, coalesce(gender, 'male') as gender,
      coalesce(userType, 'student') as userType, case when coalesce(userType, 'student') = 'school' then 'public' end as schoolType, DOB, phoneNumber, wilaya, commune, preferences,
      'https://example.com/default-avatar.png' as profilePicture from mailed)""",
]


def infer_input(spark, folder):
    return composed_table(spark, folder)


@query("infer_name", q.with_ctes(*INFER, select="select row_id, base as name from named"))
def infer_name(spark, folder):
    df = infer_input(spark, folder)
    found = inference.infer_name(F.col("email"), F.lit(None).cast("string"))
    return df.select("row_id", F.coalesce(inference.present(F.col("name")), found).alias("name"))


@query("infer_username", q.with_ctes(*INFER, select="select row_id, username from users"))
def infer_username(spark, folder):
    return inference.infer_table(infer_input(spark, folder), SETTINGS).select("row_id", "username")


@query("infer_email", q.with_ctes(*INFER, select="select row_id, email from mailed"))
def infer_email(spark, folder):
    return inference.infer_table(infer_input(spark, folder), SETTINGS).select("row_id", "email")


@query("row_suffix", f"select event_id, {q.suffix('event_id * 7 - 20000')} as suffix from events")
def row_suffix(spark, folder):
    return table(spark, folder, "events").select("event_id", inference.row_suffix(F.col("event_id") * 7 - 20000).alias("suffix"))


@query("infer_last", q.with_ctes(*q.NAMED, select=f"select row_id, {q.last_word('name')} as last from composed"))
def infer_last(spark, folder):
    return composed_rows(spark, folder).select("row_id", inference.infer_last(F.col("name")).alias("last"))


@query("infer_gender", q.with_ctes(*q.NAMED, f"names as ({NAMES})", select="""
select row_id, coalesce(c.gender, case n.gender when 'mostly_female' then 'female' when 'male' then 'male' end, 'male') as gender
from composed c left join names n on lower(split_part(c.name, ' ', 1)) = n.first_name"""))
def infer_gender(spark, folder):
    names = names_table(spark, folder)
    return inference.infer_gender(infer_input(spark, folder), "name", SETTINGS, names).select("row_id", "gender")


@query("infer_defaults", q.with_ctes(*INFER, select="select row_id, profilePicture, userType, schoolType, phoneNumber from filled"))
def infer_defaults(spark, folder):
    filled = inference.infer_table(infer_input(spark, folder), SETTINGS)
    return filled.select("row_id", "profilePicture", "userType", "schoolType", "phoneNumber")


AGES = "select event_id, case event_id % 6 when 0 then 'abc' when 1 then '2' when 2 then concat(cast(event_id % 130 as string), '.9') else cast(event_id % 130 as string) end as age from events"


@query("infer_dob_from_age", q.with_ctes(f"ages as ({AGES})", select=f"""
select event_id, case when trunc(try_cast(age as double)) between 3 and 120 then cast(epoch(make_timestamp(2026 - cast(trunc(try_cast(age as double)) as bigint), 1, 1, 0, 0, 0)) as bigint) end as dob from ages"""))
def infer_dob_from_age(spark, folder):
    return base(spark, folder, AGES, "events").select("event_id", dates.dob_from_age(F.col("age"), SETTINGS.as_of).alias("dob"))


@query("infer_table", q.with_ctes(*INFER, select="select row_id, name, last, username, email, gender, userType, schoolType, DOB, phoneNumber from filled"))
def infer_table(spark, folder):
    filled = inference.infer_table(infer_input(spark, folder), SETTINGS)
    return filled.select("row_id", "name", "last", "username", "email", "gender", "userType", "schoolType", "DOB", "phoneNumber")


# ---------------------------------------------------------------- outliers

# Customers with the money they moved as activity.
ACTIVITY = f"""
select c_custkey as row_id, cast({q.AS_OF_SECONDS} - 86400 * cast(3000 + c_custkey % 9000 as bigint) - 43200 + case when c_custkey % 17 = 0 then null when c_custkey % 19 = 0 then 1800000000 else 0 end as bigint) as DOB,
  case when c_custkey % 23 = 0 then 'n/a' else cast(sum(cast(floor(o_totalprice) as bigint)) as string) end as activity_score
from customer left join orders on c_custkey = o_custkey group by c_custkey
"""
AGE = f"case when DOB > 0 and DOB <= {q.AS_OF_SECONDS} then floor(({q.AS_OF_SECONDS} - DOB) / 86400.0) / 365.25 end"
FEATURES = [f"activity as materialized ({ACTIVITY})", f"raw as materialized (select row_id, cast({AGE} as double) as age, try_cast(activity_score as double) as activity from activity)",
            "features as materialized (select row_id, coalesce(age, (select median(age) from raw), 0.0) as age, coalesce(activity, (select median(activity) from raw), 0.0) as activity from raw)"]


def activity(spark, folder):
    return base(spark, folder, ACTIVITY, "customer", "orders")


def features(spark, folder):
    raw = anomaly.raw_features(activity(spark, folder), SETTINGS)
    stats = anomaly.feature_stats(raw)
    return anomaly.fill_features(raw, stats), stats


@query("estimate_age", q.with_ctes(FEATURES[0], select=f"select row_id, round(cast({AGE} as double), 6) as age from activity"))
def estimate_age(spark, folder):
    return activity(spark, folder).select("row_id", F.round(dates.estimate_age(F.col("DOB"), SETTINGS.as_of), 6).alias("age"))


@query("anomaly_features", q.with_ctes(*FEATURES, select="select row_id, round(age, 6) as age, round(activity, 6) as activity from features"))
def anomaly_features(spark, folder):
    filled, _ = features(spark, folder)
    return filled.select("row_id", F.round("age_feature", 6).alias("age"), F.round("activity_feature", 6).alias("activity"))


@query("anomaly_guards", q.with_ctes(*FEATURES, select="""
select segment, count(*) as n, count(*) >= 20 and (min(age) < max(age) or min(activity) < max(activity)) as usable
from (select case when row_id < 15 then 'few' when row_id % 2 = 0 then 'even' else 'odd' end as segment, age, activity from features) x group by segment"""))
def anomaly_guards(spark, folder):
    rows = activity(spark, folder)
    segment = F.when(F.col("row_id") < 15, "few").when(F.col("row_id") % 2 == 0, "even").otherwise("odd")
    return anomaly.group_stats(anomaly.raw_features(rows.withColumn("segment", segment), SETTINGS), "segment")


def scored(spark, folder):
    filled, stats = features(spark, folder)
    filled = materialise(filled, "features")
    forest = anomaly.train_forest(filled, anomaly.FEATURES, stats.rows, SETTINGS)
    return anomaly.score_rows(filled, anomaly.FEATURES, forest, stats.rows, SETTINGS), stats


@query("isolation_forest")
def isolation_forest(spark, folder):
    return scored(spark, folder)[0].select("row_id", F.col("_score").alias("score"))


# A score that SQL knows as well: minus the distance from the mean.
@query("anomaly_threshold", q.with_ctes(*FEATURES, """
  given as (select row_id, -abs(activity - 1000000.0) as score from features),
  ranked as (select score, row_number() over (order by score) - 1 as k, (count(*) over () - 1) * greatest(0.01, least(0.05, 3.0 / count(*) over ())) as r from given),
  cut as (select max(case when k = floor(r) then score end) + (max(r) - floor(max(r))) * (max(case when k = floor(r) + 1 then score end) - max(case when k = floor(r) then score end)) as cut from ranked)""",
    select="select row_id, round(score - cut, 6) as anomaly_score, score - cut < 0 as flagged from given, cut"))
def anomaly_threshold(spark, folder):
    filled, stats = features(spark, folder)
    given = filled.select("row_id", (-F.abs(F.col("activity_feature") - 1_000_000.0)).alias("score"))
    flagged = anomaly.flag_by_share(given, "score", anomaly.contamination(stats.rows))
    return flagged.select("row_id", F.round("anomaly_score", 6).alias("anomaly_score"), F.col("anomaly_flag").alias("flagged"))


@query("anomaly_split")
def anomaly_split(spark, folder):
    result = anomaly.detect_anomalies(activity(spark, folder), SETTINGS)
    return result.quarantine.select("row_id", "anomaly_score", "failure_reason", "row_index")


# ---------------------------------------------------------------- validation

# Rows with every kind of gap.
ROUGH = """
select row_id, case when row_id % 7 = 0 then null else email end as email, case when row_id % 8 = 0 then null else name end as name,
  case when row_id % 5 = 0 then '' else concat('u', cast(row_id as string)) end as username, case when row_id % 3 = 0 then 'none' else last end as last,
  case when row_id % 4 = 0 then 'guest' else userType end as userType, case row_id % 6 when 0 then 'public' when 1 then 'circus' end as schoolType,
  case row_id % 3 when 0 then 'male' when 1 then 'other' end as gender, case row_id % 5 when 0 then 'phone' when 1 then 'fax' end as verificationType,
  DOB, phoneNumber, wilaya, commune, case when row_id % 2 = 0 then 'https://x.dz/p.png' else ' ' end as profilePicture from composed
"""
ROUGH_SQL = [
    *q.NAMED,
    f"rough as materialized ({ROUGH})",
    f"""kinds as (select *, coalesce(case when {q.filled('userType')} in ({', '.join(q.quoted(x) for x in fv.ALLOWED_USER_TYPES)}) then {q.filled('userType')} end,
        case when schoolType in ({', '.join(q.quoted(x) for x in fv.ALLOWED_SCHOOL_TYPES)}) then 'school' end,
        case when {q.filled('last')} is not null or {q.filled('name')} is not null then 'student' end) as kind,
      case when schoolType in ({', '.join(q.quoted(x) for x in fv.ALLOWED_SCHOOL_TYPES)}) then schoolType end as school,
      {q.compose('name', 'last', q.filled('last'))} as display from rough),
    lasts as (select *, coalesce({q.filled('last')}, case when contains(trim(display), ' ') then {q.last_word('display')} end) as family from kinds),
    lacks as (select *, list_filter([case when {q.filled('email')} is null then 'email' end, case when display is null then 'name' end,
        case when {q.filled('username')} is null then 'username' end, case when kind <> 'school' and family is null then 'last' end], lambda x: x is not null) as lacking from lasts),
    judged as materialized (select *, case when kind is null then {q.quoted(fv.REASON_USER_TYPE)} when kind = 'school' and school is null then {q.quoted(fv.REASON_SCHOOL_TYPE)}
      when len(lacking) > 0 then {q.quoted(fv.REASON_MISSING)} || array_to_string(lacking, ', ') end as reason from lacks)""",
]


def rough(spark, folder):
    composed_rows(spark, folder).createOrReplaceTempView("composed")
    return spark.sql(ROUGH)


@query("resolve_user_type", q.with_ctes(*ROUGH_SQL, select="select row_id, kind from kinds"))
def resolve_user_type(spark, folder):
    kind = validation.resolve_user_type(F.col("userType"), F.col("schoolType"), F.col("last"), F.col("name"))
    return rough(spark, folder).select("row_id", kind.alias("kind"))


@query("allowed_value", q.with_ctes(*ROUGH_SQL, select="select row_id, school as school_type, case when gender = 'male' then gender end as gender, case when verificationType = 'phone' then 'phone' end as verification from kinds"))
def allowed_value(spark, folder):
    return rough(spark, folder).select(
        "row_id", validation.allowed_value(F.col("schoolType"), fv.ALLOWED_SCHOOL_TYPES).alias("school_type"),
        validation.allowed_value(F.col("gender"), fv.ALLOWED_GENDERS).alias("gender"),
        validation.allowed_value(F.col("verificationType"), fv.ALLOWED_VERIFICATION).alias("verification"))


@query("missing_fields", q.with_ctes(*ROUGH_SQL, select="select row_id, reason from judged"))
def missing_fields(spark, folder):
    return validation.build_records(rough(spark, folder), SETTINGS).select("row_id", F.col("failure_reason").alias("reason"))


RECORD = "select email, display as name, username, kind as userType, {last} as last, {school} as schoolType, {dob} as DOB, {gender} as gender, case when trim(profilePicture) = '' then 'https://example.com/default-avatar.png' else profilePicture end as profilePicture from judged where reason is null and {which}"
SCHOOL_SQL = RECORD.format(last="cast(null as varchar)", school="school", dob="cast(null as bigint)", gender="cast(null as varchar)", which="kind = 'school'")
PERSON_SQL = RECORD.format(last="family", school="cast(null as varchar)", dob="DOB", gender="case when gender = 'male' then gender end", which="kind <> 'school'")
RECORD_COLUMNS = ("email", "name", "username", "userType", "last", "schoolType", "DOB", "gender", "profilePicture")


@query("school_record", q.with_ctes(*ROUGH_SQL, select=SCHOOL_SQL))
def school_record(spark, folder):
    return validation.build_split(rough(spark, folder), SETTINGS).valid.where("userType = 'school'").select(*RECORD_COLUMNS)


@query("person_record", q.with_ctes(*ROUGH_SQL, select=PERSON_SQL))
def person_record(spark, folder):
    return validation.build_split(rough(spark, folder), SETTINGS).valid.where("userType <> 'school'").select(*RECORD_COLUMNS)


@query("normalize_location", q.with_ctes(*q.NAMED, select="""
select row_id, case when wilaya is not null or commune is not null then coalesce(wilaya, '') end as wilaya, case when wilaya is not null or commune is not null then coalesce(commune, '') end as commune,
  case when wilaya is not null or commune is not null then cast(row_id as double) / 10 end as lat from composed"""))
def normalize_location(spark, folder):
    df = composed_rows(spark, folder)
    place = F.struct(
        F.concat(F.lit(" "), "wilaya").alias("wilaya"), F.coalesce("commune", F.lit("NaN")).alias("commune"),
        F.struct(F.lit("x").alias("lang"), (F.col("row_id") / 10).cast("string").alias("lat")).alias("coordinates"), F.lit("none").alias("fullLocation"))
    tidy = df.select("row_id", structs.tidy_location(place).alias("p"))
    return tidy.select("row_id", "p.wilaya", "p.commune", F.col("p.coordinates.lat").alias("lat"))


@query("normalize_preferences", q.with_ctes(q.dirty_cte(), select="""
select row_id, nullif(array_to_string(list_filter(list_transform(string_split(matieres, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') as from_text,
  nullif(array_to_string(list_filter(list_transform(string_split(matieres, ';'), lambda x: trim(x)), lambda x: x <> ''), '|'), '') as from_list from dirty"""))
def normalize_preferences(spark, folder):
    return dirty(spark, folder).select(
        "row_id", F.array_join(structs.tidy_list_text(F.col("matieres")), "|").alias("from_text"),
        F.array_join(structs.tidy_list(F.split("matieres", ";")), "|").alias("from_list"))


@query("revalidate_dob", q.with_ctes(*q.NAMED, select="select row_id, DOB - 400000000 as dob, case when DOB - 400000000 > 10000000 then DOB - 400000000 end as legacy from composed"))
def revalidate_dob(spark, folder):
    old = replace(SETTINGS, legacy_dob_range=True)
    seconds = F.col("DOB") - 400_000_000
    return composed_rows(spark, folder).select(
        "row_id", validation.revalidate_dob(seconds, SETTINGS).alias("dob"), validation.revalidate_dob(seconds, old).alias("legacy"))


@query("default_picture", q.with_ctes(*ROUGH_SQL, select=f"select row_id, case when trim(profilePicture) = '' then 'https://example.com/default-avatar.png' else profilePicture end as picture, nullif(phoneNumber, '') as phone from rough"))
def default_picture(spark, folder):
    return rough(spark, folder).select(
        "row_id", F.coalesce(validation.filled(F.col("profilePicture")), F.lit(SETTINGS.default_picture)).alias("picture"),
        validation.filled(F.col("phoneNumber")).alias("phone"))


@query("build_split", q.with_ctes(*ROUGH_SQL, select="select row_id, reason as failure_reason, row_id as row_index from judged where reason is not null"))
def build_split(spark, folder):
    return validation.build_split(rough(spark, folder), SETTINGS).rejected.select("row_id", "failure_reason", "row_index")


# ---------------------------------------------------------------- outputs

LEFT_LINES = "select l_orderkey, l_partkey, l_quantity, case when l_quantity > 40 then 'too many' end as failure_reason from lineitem where l_quantity > 25"
RIGHT_LINES = "select l_orderkey, l_suppkey, l_extendedprice from lineitem where l_quantity <= 25 or l_quantity is null"


@query("quarantine_union", f"""select l_orderkey, l_partkey, l_quantity, coalesce(failure_reason, 'schema_rejected') as failure_reason, cast(null as bigint) as l_suppkey, cast(null as double) as l_extendedprice from ({LEFT_LINES}) a
union all select l_orderkey, null, null, 'anomaly_detected', l_suppkey, l_extendedprice from ({RIGHT_LINES}) b""")
def quarantine_union(spark, folder):
    left = base(spark, folder, LEFT_LINES, "lineitem")
    return sinks.quarantine_union(left, spark.sql(RIGHT_LINES))


@query("run_summary", q.with_ctes(*FUZZY, select="""
select (select count(*) from shared) as input_rows, (select count(*) from shared) as mapped_rows, (select count(*) from shared) as cleaned_rows,
  (select count(*) from survivors) as deduped_rows, (select count(*) from survivors where email is not null) as clean_rows,
  (select count(*) from survivors where email is null) as quarantined_rows, (select count(*) from flagged where is_duplicate) + 2 * (select count(*) from links) as duplicate_rows,
  (select count(*) from survivors where email is null and DOB is null) as anomaly_rows"""))
def run_summary(spark, folder):
    shared = shared_table(spark, folder)
    result = dedup.find_duplicates(shared, SETTINGS)
    kept, rest = result.survivors.where("email is not null"), result.survivors.where("email is null")
    return count_stages(shared, result.survivors, kept, rest, result.review, rest.where("DOB is null"))


EXPORT_SQL = """select row_id, name, email, phoneNumber, strftime(make_timestamp(DOB * 1000000), '%d-%m-%Y') as DOB, wilaya,
  case when len(preferences) = 0 then '[]' else '["' || array_to_string(preferences, '","') || '"]' end as preferences from composed"""


def exported(spark, folder):
    df = composed_rows(spark, folder).select("row_id", "name", "last", "email", "phoneNumber", "DOB", "wilaya", "preferences")
    return df


@query("export_projection", q.with_ctes(*q.NAMED, select=EXPORT_SQL))
def export_projection(spark, folder):
    return sinks.export_projection(exported(spark, folder))


@query("write_outputs", q.with_ctes(*q.NAMED, select=EXPORT_SQL))
def write_outputs(spark, folder):
    path = new_folder(spark, "outputs")
    sinks.write_outputs({"clean": exported(spark, folder)}, path)
    return sinks.export_projection(spark.read.parquet(f"{path}/clean"))


@query("run_all")
def run_all(spark, folder):
    """Raw people to clean records."""
    clean = run(dirty(spark, folder), SETTINGS).clean
    return clean.withColumn("location", F.col("location.fullLocation")).withColumn("preferences", F.array_join("preferences", "|")).withColumn(
        "socialLinks", F.to_json("socialLinks"))


@query("run_all_review")
def run_all_review(spark, folder):
    """Raw people to the duplicate-review table."""
    return run(dirty(spark, folder), SETTINGS).duplicates.select(
        "row_id", "name", "email", "duplicate_group_id", "duplicate_reason", "duplicate_score", "canonical_row_index")


@query("run_all_quarantine")
def run_all_quarantine(spark, folder):
    """Raw people to the quarantine table."""
    return run(dirty(spark, folder), SETTINGS).quarantine.select("row_id", "name", "email", "failure_reason", "row_index")


# The chain without the forest, whose random trees SQL does not know.
PLAIN_SETTINGS = replace(SETTINGS, forest_trees=0)
PLAIN = [
    *q.NAMED,
    "shared as materialized (select * from composed)",
    *EXACT[len(q.NAMED) + 1:],
    """blocked as materialized (select *, case when wilaya is not null then lower(wilaya) when commune is not null then '{''wilaya' else '' end as block from survivors)""",
    *FUZZY[len(EXACT) + 1:],
    INFER[len(q.NAMED)].replace("from composed", "from survivors"),
    *INFER[len(q.NAMED) + 1:],
    "rough as materialized (select *, cast(null as varchar) as verificationType from filled)",
    *ROUGH_SQL[len(q.NAMED) + 1:],
]


def plain(spark, folder):
    return run(dirty(spark, folder), PLAIN_SETTINGS)


@query("run_plain", q.with_ctes(*PLAIN, select="""
select email, display as name, username, phoneNumber, profilePicture, kind as userType, case when kind <> 'school' then family end as last,
  case when kind = 'school' then school end as schoolType, case when kind <> 'school' then DOB end as DOB, case when kind <> 'school' then gender end as gender,
  nullif(array_to_string(preferences, '|'), '') as preferences, nullif(array_to_string(list_filter([wilaya, commune], lambda x: x is not null), ', '), '') as location
from judged where reason is null"""))
def run_plain(spark, folder):
    """Raw people to clean records."""
    clean = plain(spark, folder).clean
    return clean.select("email", "name", "username", "phoneNumber", "profilePicture", "userType", "last", "schoolType", "DOB", "gender",
                        F.array_join("preferences", "|").alias("preferences"), F.col("location.fullLocation").alias("location"))


@query("run_plain_review", q.with_ctes(*PLAIN, select="""
select row_id, name, email, group_id as duplicate_group_id, duplicate_reason, 100.0::double as duplicate_score, canonical_row_index from flagged where is_duplicate
union all select s.row_id, s.name, s.email, printf('dup_%06d', number), reason, round(score, 6), left_id from links join survivors s on s.row_id in (left_id, right_id)"""))
def run_plain_review(spark, folder):
    """Raw people to the duplicate-review table."""
    return plain(spark, folder).duplicates.select(
        "row_id", "name", "email", "duplicate_group_id", "duplicate_reason", F.round("duplicate_score", 6).alias("duplicate_score"), "canonical_row_index")


@query("run_plain_quarantine", q.with_ctes(*PLAIN, select="select row_id, name, email, reason as failure_reason, row_id as row_index from judged where reason is not null"))
def run_plain_quarantine(spark, folder):
    """Raw people to the quarantine table."""
    return plain(spark, folder).quarantine.select("row_id", "name", "email", "failure_reason", "row_index")


# What one call writes, read back: the rows of all tables, and the counts in the summary.
WRITTEN = """
select 'clean' as part, count(*) as n from judged where reason is null union all select 'quarantine', count(*) from judged where reason is not null
union all select 'duplicates', (select count(*) from flagged where is_duplicate) + 2 * (select count(*) from links) union all select 'mappings', {mappings}
union all select 'summary: ' || line, 1 from (select unnest([
  'Input rows: ' || (select count(*) from dirty), 'Deduped rows: ' || (select count(*) from survivors), 'Clean records: ' || (select count(*) from judged where reason is null),
  '- prenom -> name (99.0%, name_header_heuristic)', '- nom -> last (100.0%, french_name_rule)']) as line) x"""


@query("write_result", q.with_ctes(*PLAIN, select=WRITTEN.format(mappings=10)))
def write_result(spark, folder):
    """A whole run written and published, then read back."""
    path = new_folder(spark, "result")
    with run_scope(spark):
        sinks.write_result(plain(spark, folder), path)
    tables = sinks.read_result(spark, path)
    found = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in tables.items() if name != "summary"]
    lines = tables["summary"].select(F.explode(F.split("summary", "\n")).alias("line"))
    wanted = F.col("line").rlike(r"^(Input rows|Deduped rows|Clean records|- (prenom|nom) )")
    found.append(lines.where(wanted).select(F.concat(F.lit("summary: "), "line").alias("part"), F.lit(1).cast("bigint").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), found)
