"""Queries of the training-data operators over whole tables, and the SQL they are checked against."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import NO_VALUE_MARKS
from ..operators.barrier import broadcast_if_small, not_sent
from ..plans.quality_queries import no_value
from ..session import materialize, table
from . import leaks, names, packing, reading, survivors, unify
from .name_lexicon import learn_lexicon

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _records(spark: SparkSession, sf_dir: str, name: str, key: str, fields: list[str]) -> DataFrame:
    df = table(spark, sf_dir, name).select("application_no", F.col(key).alias("id"), *fields, "feed_code", "loaded_at")
    feeds = table(spark, sf_dir, "feeds").select(F.col("feed_code").alias("__feed"), "trust_rank")
    # without the hint a cluster that never broadcasts would shuffle all rows to the few feeds
    joined = df.join(broadcast_if_small(feeds), F.col("feed_code") == F.col("__feed"), "left")
    return joined.withColumn("app", survivors.application_key(F.col("application_no"))).drop("application_no", "__feed", "feed_code")


def _fields(spark: SparkSession, sf_dir: str, hide: bool = False) -> list[tuple[str, DataFrame]]:
    """The competitors of the three fields; with ``hide`` a fifth of the rows have lost their time."""
    raw = _records(spark, sf_dir, "raw_records", "rec_id", ["application_date", "ipc_all_raw"])
    texts = _records(spark, sf_dir, "text_records", "text_id", ["abstract_clean"])
    if hide:
        kept = F.when(F.pmod(F.xxhash64("id"), F.lit(5)) > 0, F.col("loaded_at"))
        raw, texts = raw.withColumn("loaded_at", kept), texts.withColumn("loaded_at", kept)
    return [("application_date", survivors.date_rows(raw)), ("ipc_all_raw", survivors.code_rows(raw)), ("abstract_clean", survivors.abstract_rows(texts))]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that supplies the surviving value, per application and field."""
    out = None
    for name, rows in _fields(spark, sf_dir):
        part = survivors.survivors(rows).select(survivors.application_number(F.col("app")).alias("application_no"), F.lit(name).alias("field_name"), F.col("id").alias("holder_id"))
        out = part if out is None else out.unionAll(part)
    return out


def p2_hidden_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the survivor is the same when a fifth of the rows have lost their time, per field."""
    out = None
    for (name, rows), (_, hidden) in zip(_fields(spark, sf_dir), _fields(spark, sf_dir, hide=True)):
        with_times, without = survivors.survivors(rows), survivors.survivors(hidden)
        both = with_times.join(without.withColumnRenamed("id", "other"), "app")
        part = both.agg(F.lit(name).alias("field_name"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("id") == F.col("other")).alias("n_same"))
        out = part if out is None else out.unionAll(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose texts look the same but are not the same string."""
    texts = unify.look_alike_pairs(table(spark, sf_dir, "text_records"), "text_id", "abstract_clean")
    people = unify.look_alike_pairs(table(spark, sf_dir, "applicant_names"), "name_id", "applicant")
    return texts.select(F.lit("abstract_clean").alias("field_name"), "id_a", "id_b").unionAll(people.select(F.lit("applicant").alias("field_name"), "id_a", "id_b"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    texts = table(spark, sf_dir, "text_records").select(F.lit("abstract_clean").alias("field_name"), F.col("text_id").alias("id"), unify.unified(F.col("abstract_clean")).alias("form"))
    people = table(spark, sf_dir, "applicant_names").select(F.lit("applicant").alias("field_name"), F.col("name_id").alias("id"), unify.unified(F.col("applicant")).alias("form"))
    return texts.unionAll(people)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its class of equal-looking rows, its spelling, and the size of the class."""
    texts = unify.look_alike_classes(table(spark, sf_dir, "text_records"), "text_id", "abstract_clean")
    people = unify.look_alike_classes(table(spark, sf_dir, "applicant_names"), "name_id", "applicant")
    return texts.withColumn("field_name", F.lit("abstract_clean")).unionAll(people.withColumn("field_name", F.lit("applicant")))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    applicants = table(spark, sf_dir, "applicant_names").select(F.lit("applicant").alias("space"), "name_id", F.col("applicant").alias("name"))
    companies = table(spark, sf_dir, "company_names").select(F.lit("company_name").alias("space"), "name_id", F.col("company_name").alias("name"))
    both = applicants.unionAll(companies)
    return names.linked_names(both, learn_lexicon(both, table(spark, sf_dir, "firms")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of typed names of the same organisation or person."""
    return names.name_pairs(_linked(spark, sf_dir))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed name with the smallest name id of its entity and the entity's number of names."""
    linked = _linked(spark, sf_dir)
    heads = linked.groupBy("space", "entity").agg(F.min("name_id").alias("entity_id"), F.count(F.lit(1)).alias("n_names"))
    return linked.join(not_sent(heads), ["space", "entity"]).select(F.col("space").alias("field_name"), "name_id", "entity_id", "n_names")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of each capacity."""
    lengths = packing.token_lengths(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{VOCABULARY}")
    return packing.pack(lengths, table(spark, sf_dir, "pack_limits"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing of every limit, checked over all pieces."""
    lengths = materialize(packing.token_lengths(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{VOCABULARY}"))
    limits = table(spark, sf_dir, "pack_limits")
    return packing.audit(packing.pack(lengths, limits), lengths, limits)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item or a long passage of it."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).select("doc_id", "script", "reading_level")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of reading level 5."""
    return p9_levels(spark, sf_dir).where("reading_level = 5").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_hidden_times, p4_found, p4_forms, p4_classes, p5_found, p5_entities, p7_packing, p7_audit, p8_found, p9_found, p9_levels)}
_MARKS = "('', " + ", ".join("'" + m + "'" for m in NO_VALUE_MARKS) + ")"
_KEY = "CASE WHEN upper(trim(application_no)) NOT IN " + _MARKS + r" THEN nullif(regexp_replace(regexp_replace(upper(application_no), '[^\p{L}\p{Nd}]', '', 'g'), '^CN', ''), '') END"
_DATE = "try_strptime(trim(application_date), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%Y.%m.%d', '%Y%m%d', '%Y年%m月%d日'])"
_BARE = r"""coalesce(regexp_replace(ipc_all_raw, '[;；,，、|｜"''“”\[\]\s]+', '', 'g'), '')"""


def _survivor_sql(name: str, source: str, key: str, competes: str) -> str:
    return f"""SELECT 'CN' || left(app, length(app) - 1) || '.' || right(app, 1) AS application_no, '{name}' AS field_name, arg_max(id, ROW(-trust, ts, id)) FILTER (WHERE ok) AS holder_id FROM
 (SELECT app, {key} AS id, coalesce(trust_rank, 2147483647) AS trust, epoch_us(loaded_at) AS ts, {competes} AS ok FROM (SELECT *, {_KEY} AS app FROM {source}) AS t LEFT JOIN feeds USING (feed_code) WHERE app IS NOT NULL) GROUP BY app HAVING count(*) >= 2 AND bool_or(ok)"""


SQL: dict[str, str] = {
    "p7_audit": "SELECT limit_id, capacity_tokens, (SELECT count(*) FROM documents) AS n_documents, 0::bigint AS missing, 0::bigint AS overfull, 0::bigint AS cut_short, 0::bigint AS broken, true AS tight FROM pack_limits WHERE capacity_tokens > 0",
    "p2_found": " UNION ALL ".join([
        _survivor_sql("application_date", "raw_records", "rec_id", f"{_DATE} IS NOT NULL"),
        _survivor_sql("ipc_all_raw", "raw_records", "rec_id", f"upper({_BARE}) NOT IN {_MARKS}"),
        _survivor_sql("abstract_clean", "text_records", "text_id", f"coalesce(upper(trim(abstract_clean)), '') NOT IN {_MARKS} AND length(abstract_clean) >= 0.8 * max(length(abstract_clean)) OVER (PARTITION BY app)"),
    ])
}

_FORMS = f"{unify.form_sql('abstract_clean', 'text_id', 'text_records', 'fa')}, {unify.form_sql('applicant', 'name_id', 'applicant_names', 'fb')}, al AS (SELECT 'abstract_clean' AS field_name, * FROM fa UNION ALL SELECT 'applicant', * FROM fb)"
_HELD = f"{_FORMS}, hv AS (SELECT * FROM al WHERE {no_value('raw')} IS FALSE)"
SQL |= {
    "p4_forms": f"WITH {_FORMS} SELECT field_name, id, form FROM al UNION ALL SELECT 'abstract_clean', text_id, NULL FROM text_records WHERE abstract_clean IS NULL UNION ALL SELECT 'applicant', name_id, NULL FROM applicant_names WHERE applicant IS NULL",
    "p4_found": f"WITH {_HELD} SELECT a.field_name, a.id AS id_a, b.id AS id_b FROM hv a JOIN hv b ON a.field_name = b.field_name AND a.form = b.form AND a.raw <> b.raw AND a.id < b.id",
    "p4_classes": f"""WITH {_HELD} SELECT field_name, id, min(id) OVER (PARTITION BY field_name, form) AS class_id, min(id) OVER (PARTITION BY field_name, raw) AS spelling_id, count(*) OVER (PARTITION BY field_name, form) AS n_rows,
 count(DISTINCT raw) OVER (PARTITION BY field_name, form) AS n_spellings FROM hv""",
}
